"""``dedup.kept_reactions`` and ``dedup.postprocess`` for many images of few boxes at once (numpy over Arrow batches).

As columns, each overlap is worked out inside functions over arrays; here
those of a batch's images are worked out side by side. An image is one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxframe.functions.ranges import covered, pairs
from boxframe.schemas import DUPLICATE_IOU, EMPTY_SIDE, MATCH_IOU, PRODUCT, REACTANT, ROLES

#: Pairs of boxes that are compared side by side, or those of one image.
_TOGETHER = 1 << 20


def kept_reactions(rxns: DataFrame, image: Sequence[str], with_kept: bool = False, digits: int | None = None) -> DataFrame:
    return _by_image(rxns, image, ["rxn_id", "boxes", *(["kept"] if with_kept else [])], False, digits)


def postprocess(rxns: DataFrame, image: Sequence[str], digits: int | None = None) -> DataFrame:
    return _by_image(rxns, image, ["rxn_id", "boxes"], True, digits)


def _by_image(rxns: DataFrame, image: Sequence[str], columns: list[str], post: bool, digits: int | None) -> DataFrame:
    images = rxns.select(*image, F.struct(*columns).alias("r")).groupBy(*image).agg(F.sort_array(F.collect_list("r")).alias("all"))
    kept = [T.StructField("kept", T.ArrayType(T.LongType()))] if post else []
    out = T.StructType([*(T.StructField(c, rxns.schema[c].dataType) for c in (*image, *columns)), *kept])
    names = list(out.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _cut(batch):
                row, fields = _kept(some.column(len(image)), post, digits)
                yield pa.RecordBatch.from_arrays([*(some.column(i).take(row) for i in range(len(image))), *fields], names=names)

    return images.mapInArrow(work, out)


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with up to ``_TOGETHER`` pairs of boxes, or one image."""
    every = batch.column(batch.num_columns - 1)
    n = every.flatten().field("boxes").value_lengths().to_numpy()
    past = np.cumsum(every.value_lengths().to_numpy())
    boxes = np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], past])])
    first = cost = 0
    for at, more in enumerate((boxes.astype(np.int64) ** 2).tolist()):
        if at > first and cost + more > _TOGETHER:
            yield batch.slice(first, at - first)
            first, cost = at, 0
        cost += more
    if batch.num_rows > first:
        yield batch.slice(first)


class _Boxes:
    """Boxes of a list of reactions; null corners and NaN count as in the column functions."""

    def __init__(self, boxes: pa.Array, digits: int | None):
        flat, self.digits = boxes.flatten(), digits
        self.n = boxes.value_lengths().to_numpy().astype(np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.rxn, _, self.place = covered(self.first, self.n)
        self.role = flat.field("role").fill_null(-1).to_numpy()
        self.null = {c: flat.field(c).is_null().to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2")}
        self.at = {c: flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in self.null}
        self.side = {c: self.at[f"{c}2"] - self.at[f"{c}1"] for c in "xy"}
        self.area = self.side["x"] * self.side["y"]
        self.unknown = np.logical_or.reduce(list(self.null.values()))

    def iou(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shared = {}
        for c in "xy":
            low, high = f"{c}1", f"{c}2"
            low_a, low_b = self.at[low][a], self.at[low][b]
            most = np.where(self.null[low][a], low_b, np.where(self.null[low][b], low_a, np.maximum(low_a, low_b)))
            shared[c] = np.fmin(self.at[high][a], self.at[high][b]) - most
        both = shared["x"] * shared["y"]
        union = self.area[a] + self.area[b] - both
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(self.unknown[a] | self.unknown[b] | (union == 0), 0.0, both / union)
            if self.digits is not None:
                value = np.rint(value * 10.0**self.digits) / 10.0**self.digits
        return np.where((shared["x"] < 0) | (shared["y"] < 0), 0.0, value)

    def equal(self, look: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether reactions are equal as in ``matching.equal``, of whose boxes those are looked at that ``look`` says."""
        out, looked = np.zeros(len(left), bool), np.flatnonzero(look)
        sizes = np.bincount(self.rxn[looked] * len(ROLES) + self.role[looked], minlength=len(ROLES) * len(self.n)).reshape(-1, len(ROLES))
        alike = np.flatnonzero((sizes[left] == sizes[right]).all(axis=1) & (sizes[left].sum(axis=1) > 0))
        if not len(alike):
            return out
        left, right, n = left[alike], right[alike], sizes.sum(axis=1)
        first = np.cumsum(n) - n
        pair, at, _ = covered(first[left], n[left])
        box, other = looked[at], right[pair]
        which, at, far = covered(self.first[other], self.n[other])
        score, starts = self.iou(box[which], at), np.cumsum(self.n[other]) - self.n[other]
        best = np.maximum.reduceat(score, starts)
        top = (score == best[which]) | (np.isnan(score) & np.isnan(best[which]))
        place = np.where(best < MATCH_IOU, -1, np.minimum.reduceat(np.where(top, far, np.iinfo(np.int64).max), starts))
        wanted, at, _ = covered(first[right], n[right])
        want = looked[at]
        # Roles are of equal sizes, so both sides line up.
        found = place[np.lexsort((place, self.role[box], pair))]
        asked = self.place[want][np.lexsort((self.place[want], self.role[want], wanted))]
        out[alike] = np.bincount(wanted, found != asked, minlength=len(alike)) == 0
        return out

    def kept(self) -> np.ndarray:
        """Which boxes ``dedup.kept_boxes`` keeps."""
        turn = np.where(self.role == REACTANT, 0, np.where(self.role == PRODUCT, 1, 2))
        order = np.lexsort((self.place, turn, self.rxn))
        earlier, later = (order[i] for i in pairs(self.n))
        near = ~(self.iou(earlier, later) <= DUPLICATE_IOU)
        empty = (np.abs(self.side["x"]) <= EMPTY_SIDE) | (np.abs(self.side["y"]) <= EMPTY_SIDE)
        return _staying(earlier[near], later[near], ~empty)

    def reactions(self, groups: np.ndarray, kept: np.ndarray | None) -> np.ndarray:
        """Which reactions stay; ``groups`` are numbers of reactions of images, whose reactions follow one another."""
        look = (self.role >= 0) & (self.role < len(ROLES))
        if kept is not None:
            look &= kept
        whole = np.logical_and.reduce([np.bincount(self.rxn[look & (self.role == r)], minlength=len(self.n)) > 0 for r in (REACTANT, PRODUCT)])
        earlier, later = pairs(groups)
        both = whole[earlier] & whole[later]
        earlier, later = earlier[both], later[both]
        same = self.equal(look, earlier, later)
        return _staying(earlier[same], later[same], whole)


def _staying(earlier: np.ndarray, later: np.ndarray, sound: np.ndarray) -> np.ndarray:
    """Of members that are ``sound``, those that none that stays before them excludes; pairs say who excludes whom."""
    gone = ~sound
    while len(earlier):
        open_ = ~gone[earlier] & ~gone[later]
        earlier, later = earlier[open_], later[open_]
        waiting = np.zeros(len(gone), bool)
        waiting[later] = True
        decided = ~waiting[earlier]
        gone[later[decided]] = True
        earlier, later = earlier[~decided], later[~decided]
    return ~gone


def _kept(every: pa.Array, post: bool, digits: int | None) -> tuple[np.ndarray, list[pa.Array]]:
    """(image's row, fields) of the reactions that stay, of images' arrays of reactions."""
    rxns, groups = every.flatten(), every.value_lengths().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(groups)), groups)
    boxes = _Boxes(rxns.field("boxes"), digits)
    kept = _flags(boxes, rxns.field("kept")) if rxns.type.get_field_index("kept") >= 0 else None
    stay = boxes.reactions(groups, kept)
    if post:
        # Those left are judged again by the boxes that are left of them.
        kept = boxes.kept()
        again = np.flatnonzero(stay)
        some = _Boxes(rxns.field("boxes").take(again), digits)
        stay = np.zeros(len(row), bool)
        stay[again[some.reactions(np.bincount(row[again], minlength=len(groups)), kept[covered(boxes.first[again], boxes.n[again])[1]])]] = True
    at = np.flatnonzero(stay)
    fields = [rxns.field(i).take(at) for i in range(rxns.type.num_fields)]
    if post:
        which, box, far = covered(boxes.first[at], boxes.n[at])
        number = np.bincount(which[kept[box]], minlength=len(at))
        fields.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(number)]).astype(np.int32), pa.array(far[kept[box]], pa.int64())))
    return row[at], fields


def _flags(boxes: _Boxes, places: pa.Array) -> np.ndarray:
    """Places of boxes of each reaction as a flag for each box."""
    out = np.zeros(len(boxes.rxn), bool)
    n = places.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    out[np.repeat(boxes.first, n) + places.flatten().to_numpy()] = True
    return out
