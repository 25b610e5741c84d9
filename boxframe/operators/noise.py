"""Sequences filled up with noise reactions, for many images at once (numpy over Arrow batches).

The draws and the reactions are those of ``augment.augmented``, image by image
and part by part. Made as columns, they take a draw for each number, inside
functions over arrays; here a batch's draws are made side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxframe.functions.draws import Draws, whole
from boxframe.functions.geometry import Box
from boxframe.functions.ranges import covered
from boxframe.functions.tokens import Vocabulary, box_tokens
from boxframe.schemas import PRODUCT, REACTANT, ROLES

#: Parts drawn side by side; few of them are drawn in vain.
_AT_ONCE = 4
#: Boxes that a reaction drawn anew has at most in a role, and how often of 100 one is.
_MOST, _FRESH = 3, 20
_LEAST = np.array([1, 0, 1])


def images(v: Vocabulary, boxes: DataFrame, key: str) -> DataFrame:
    """(key, boxes) as ``filled`` takes them, from rows with key, box_idx, rxn_id, role, category_id and corners.

    A box's words are worked out before boxes are collected, outside the aggregation.
    """
    box = Box(*map(F.col, Box._fields))
    rows = boxes.withColumn("five", box_tokens(v, box, F.col("category_id")))
    words = F.concat_ws(" ", *(F.get("five", F.lit(i)).cast("string") for i in range(5)))
    rows = rows.select(key, "box_idx", "rxn_id", F.col("role").cast("int").alias("role"), F.coalesce(box.area != 0, F.lit(False)).alias("full"), words.alias("words"))
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("box_idx", "rxn_id", "role", "full", "words"))).alias("boxes"))


def filled(images: DataFrame, v: Vocabulary, key: str, seed: int, parts: int, most: int) -> DataFrame:
    """(key, noise, n, said, wanted): each image's sequence of reactions, filled up with noise reactions, and its targets, as words.

    ``images`` has ``key`` and ``boxes``. There are up to ``parts`` noise
    reactions, as long as the others leave fewer than ``most`` tokens; noise is
    their number, n that of all tokens, of which the texts have the first
    ``most``. In the targets a noise reaction is padding but for its last
    token, which is noise.
    """
    head = F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))
    rows = images.select(F.col(key), head.alias("head"), "boxes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *_filled(v, batch.column(1), batch.column(2), parts, most)], names=[key, "noise", "n", "said", "wanted"])

    kind = images.schema[key].dataType.simpleString()
    return rows.mapInArrow(work, f"`{key}` {kind}, noise int, n int, said string, wanted string")


class _Images:
    """A batch's boxes by image, and its reactions by role."""

    def __init__(self, heads: pa.Array, boxes: pa.Array, parts: int):
        flat = boxes.flatten()
        take = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
        self.n = boxes.value_lengths().to_numpy().astype(np.int64)
        self.first = np.cumsum(self.n) - self.n
        image = np.repeat(np.arange(len(self.n)), self.n)
        rxn, role, self.full, self.words = take("rxn_id"), take("role"), take("full"), take("words")
        self.size = np.where(self.words == "", 0, 5)
        #: Boxes in the order of reaction, role and number; where a reaction's role begins there, and its number of boxes.
        self.listed = np.lexsort((role, rxn, image))
        new = np.ones(len(image), bool)
        new[1:] = (np.diff(image[self.listed]) != 0) | (np.diff(rxn[self.listed]) != 0)
        of = np.cumsum(new) - 1
        self.image_of = image[self.listed][new]
        self.count = np.bincount(of * len(ROLES) + role[self.listed], minlength=len(ROLES) * len(self.image_of)).reshape(-1, len(ROLES))
        self.start = (np.cumsum(self.count) - self.count.ravel()).reshape(self.count.shape)
        self.reactions = np.bincount(self.image_of, minlength=len(self.n))
        self.first_reaction = np.cumsum(self.reactions) - self.reactions
        self.names = ["fresh", "pick", "kind", "gone", "place", "role", "new", "to", *(f"n:{r}" for r in "rcp"), *(f"{r}:{j}" for r in "rcp" for j in range(_MOST))]
        self.draws = Draws(heads.to_pylist(), [f":{k}:{name}" for k in range(parts) for name in self.names])

    def whole(self, image: np.ndarray, k: np.ndarray, name: np.ndarray, low: np.ndarray | int, high: np.ndarray | int) -> np.ndarray:
        return whole(self.draws(image, k * len(self.names) + name), low, high)

    def roles(self, reaction: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number in ``reaction``, role, place in the role, and box of each of these reactions' boxes."""
        which, at, far = covered(self.start[reaction].ravel(), self.count[reaction].ravel())
        return which // len(ROLES), which % len(ROLES), far, self.listed[at]

    def drawn(self, image: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the part, role, box): the noise reactions ``k`` of images; a role's boxes are in their order."""
        name = {n: i for i, n in enumerate(self.names)}
        last = self.n[image] - 1
        fresh, pick = self.whole(np.tile(image, 2), np.tile(k, 2), np.repeat([name["fresh"], name["pick"]], len(image)), 0, np.concatenate([np.full(len(image), 99), self.reactions[image] - 1])).reshape(2, -1)
        anew, old = np.flatnonzero(fresh < _FRESH), np.flatnonzero(fresh >= _FRESH)
        out = []

        # Of boxes drawn anew: how many in each role, and these.
        counts = self.whole(np.tile(image[anew], 3), np.tile(k[anew], 3), np.repeat([name[f"n:{r}"] for r in "rcp"], len(anew)), np.repeat(_LEAST, len(anew)), _MOST)
        which, _, far = covered(np.zeros(len(counts), np.int64), counts)
        part, role = anew[which % max(1, len(anew))], which // max(1, len(anew))
        box = self.whole(image[part], k[part], name["r:0"] + role * _MOST + far, 0, last[part])
        out.append((part, role, self.first[image[part]] + box))

        # Of a reaction perturbed: what is taken out, what is added and where.
        reaction = self.first_reaction[image[old]] + pick[old]
        count = self.count[reaction]
        can = count > _LEAST
        spare = can.sum(axis=1)
        kind, gone, place, added, new, to = (np.full(len(old), -1) for _ in range(6))
        some = np.flatnonzero(spare > 0)
        kind[spare == 0] = 0
        both = self.whole(np.tile(image[old[some]], 2), np.tile(k[old[some]], 2), np.repeat([name["kind"], name["gone"]], len(some)), 0, np.concatenate([np.full(len(some), 2), spare[some] - 1]))
        kind[some] = both[: len(some)]
        # The role of that number among those that can spare a box.
        gone[some] = np.argmax(np.cumsum(can[some], axis=1) == both[len(some) :, None] + 1, axis=1)
        more, less, moves = np.flatnonzero(kind == 0), np.flatnonzero(kind > 0), np.flatnonzero(kind == 2)
        at = np.concatenate([more, more, less, moves])
        names = np.repeat([name["role"], name["new"], name["place"], name["to"]], [len(more), len(more), len(less), len(moves)])
        high = np.concatenate([np.full(len(more), 2), last[old[more]], count[less, gone[less]] - 1, np.ones(len(moves), np.int64)])
        added[more], new[more], place[less], to[moves] = np.split(self.whole(image[old[at]], k[old[at]], names, 0, high), np.cumsum([len(more), len(more), len(less)]))
        part, role, far, box = self.roles(reaction)
        taken = (kind[part] > 0) & (gone[part] == role) & (place[part] == far)
        out.append((old[part[~taken]], role[~taken], box[~taken]))
        out.append((old[more], added[more], self.first[image[old[more]]] + new[more]))
        moved = self.listed[self.start[reaction[moves], gone[moves]] + place[moves]]
        out.append((old[moves], (gone[moves] + 1 + to[moves]) % 3, moved))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def whole_parts(self, part: np.ndarray, role: np.ndarray, box: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Boxes that have an area, by part, role and box, and each of ``n`` parts' number of tokens: none without a reactant or product."""
        keep = self.full[box]
        part, role, box = part[keep], role[keep], box[keep]
        has = [np.bincount(part[role == r], minlength=n) > 0 for r in (REACTANT, PRODUCT)]
        tokens = np.bincount(part, self.size[box], minlength=n).astype(np.int64) + len(ROLES) + 1
        return part, role, box, np.where(has[0] & has[1], tokens, 0)


def _filled(v: Vocabulary, heads: pa.Array, boxes: pa.Array, parts: int, most: int) -> list[pa.Array]:
    batch = _Images(heads, boxes, parts)
    images = len(batch.n)
    # Words: of each box, of a role's end and of a reaction's.
    ends = [str(v["[Rct]"]), str(v["[Cnd]"]), f"{v['[Prd]']} {v['[Rxn]']}"]
    words = np.concatenate([batch.words, np.array(ends, object)])

    def said(part: np.ndarray, role: np.ndarray, box: np.ndarray, part_image: np.ndarray, tokens: np.ndarray) -> list[str]:
        """By image, the words of the parts that have tokens; parts are in the order of their images."""
        told = np.flatnonzero(tokens)
        keep = (tokens[part] > 0) & (batch.size[box] > 0)
        at = np.concatenate([part[keep] * 6 + role[keep] * 2, (told[:, None] * 6 + np.array([1, 3, 5])).ravel()])
        word = np.concatenate([box[keep], np.tile(len(batch.words) + np.arange(3), len(told))])
        order = np.argsort(at, kind="stable")
        return _joined(words[word[order]], np.bincount(part_image[at // 6], minlength=images))

    part, role, _, box = batch.roles(np.arange(len(batch.image_of)))
    part, role, box, tokens = batch.whole_parts(part, role, box, len(batch.image_of))
    own = said(part, role, box, batch.image_of, tokens)
    n = np.bincount(batch.image_of, tokens, minlength=images).astype(np.int64)

    found, sizes = [], np.zeros((images, parts), np.int64)
    for k in range(0, parts, _AT_ONCE):
        short, step = np.flatnonzero(n < most), min(_AT_ONCE, parts - k)
        part, role, box = batch.drawn(np.repeat(short, step), np.tile(np.arange(k, k + step), len(short)))
        part, role, box, tokens = batch.whole_parts(part, role, box, len(short) * step)
        tokens = tokens.reshape(-1, step)
        before = n[short, None] + np.cumsum(tokens, axis=1) - tokens
        tokens = np.where(before < most, tokens, 0)
        n[short] += tokens.sum(axis=1)
        sizes[short, k : k + step] = tokens
        found.append((short[part // step] * parts + k + part % step, role, box))
    part, role, box = (np.concatenate(c) for c in zip(*found, strict=True))
    noise = said(part, role, box, np.repeat(np.arange(images), parts), sizes.ravel())
    told, number = sizes[sizes > 0], (sizes > 0).sum(axis=1)
    blank = {s: " ".join([str(v["<pad>"])] * (s - 1) + [str(v["[Nos]"])]) for s in np.unique(told).tolist()}
    blanks = _joined(np.array([blank[s] for s in told.tolist()], object), number)
    start, end, over = str(v["<sos>"]), str(v["<eos>"]), (n + 2 - most).tolist()
    cut = lambda text, k: text.rsplit(" ", k)[0] if k > 0 else text
    texts = lambda rest: pa.array([cut(" ".join(filter(None, (start, a, b, end))), k) for a, b, k in zip(own, rest, over, strict=True)], pa.string())
    return [pa.array(number.astype(np.int32)), pa.array((n + 2).astype(np.int32)), texts(noise), texts(blanks)]


def _joined(words: np.ndarray, n: np.ndarray) -> list[str]:
    """Words of each row in one text; rows have ``n`` words."""
    words, past = words.tolist(), np.cumsum(n).tolist()
    return [" ".join(words[a:b]) for a, b in zip([0, *past], past, strict=False)]
