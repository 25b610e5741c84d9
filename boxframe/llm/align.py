"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxframe.llm import merge_bpe
from boxframe.llm.common import written

#: Bytes of text of the documents that are aligned, and look up their pairs' counts, together; a longer document is by itself.
BLOCK_BYTES = 2 << 20
#: Places next to the middle that are tried before an interval's other ends are.
NEAR = 3
#: Links of a group from which its distinct ids are multiplied instead of its tokens.
WIDE = 1 << 16
#: Characters of a run from which the library's compiled encoder isn't used.
LONG = 4096
#: Words whose ids a worker remembers before it starts anew; bounds its memory.
REMEMBERED = 400_000
_ADDED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


class Bytes:
    """Ids of a space and a text in a byte-level vocabulary."""

    def __init__(self, path: str):
        self.merges, self.path = merge_bpe.load(path), path
        if min(self.merges.start) < 0:
            raise ValueError(f"{path} lacks single bytes")
        ranks = {self.merges.bytes[i]: i for i in {*self.merges.start, *self.merges.makes}}
        #: Where ids rank tokens in the order of their merges, the library's compiled encoder merges in that order as well.
        self.quick = tiktoken.Encoding("own", pat_str=merge_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}) if self.merges.makes == sorted(self.merges.makes) else None

    def encode(self, text: str, words: list[str]) -> bytes:
        """``words`` are the text cut at spaces. Very long runs, of which compiled patterns can run out of stack, are merged here."""
        if self.quick and (len(text) < LONG or max(map(len, words)) < LONG and len(text.split()) > len(words) - LONG):
            return self.quick.encode_to_numpy(" " + text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return merge_bpe.chunks_of(self.path).encode(" " + text)


class Words:
    """Ids in a sentence-piece vocabulary whose pieces have a space at their start only, or are spaces.

    Then no merge joins a character and a space behind it, so the words of a
    text without spaces side by side are encoded by themselves, and a bounded
    number is remembered.
    """

    def __init__(self, model: sentencepiece.SentencePieceProcessor):
        self.model, self.known = model, {}
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.apart = not any("▁" in p[1:] and p.strip("▁") for p in pieces)
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def learn(self, texts: list[list[str]]) -> None:
        """Encode what isn't known of the words of some texts, in one call."""
        words = set().union(*texts)
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for word, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            self.known[word] = array("I", ids).tobytes()

    def encode(self, text: str, words: list[str]) -> bytes:
        if not self.apart or "" in words:
            return array("I", self.model.encode(text)).tobytes()
        return b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=2)
def _sides(path_a: str, path_b: str) -> tuple[Bytes, Words, np.ndarray, np.ndarray, list[bytes]]:
    """Encoders of both sides, how many bytes each token has, and the strings of which a digest is made."""
    one, two = Bytes(path_a), Words(sentencepiece.SentencePieceProcessor(model_file=path_b))
    spelled = one.merges.bytes, two.bytes
    said = [f"{i}{end}".encode() for known, ends in zip(spelled, (",|", ",;"), strict=True) for end in ends for i in range(len(known))]
    return one, two, *(np.array([len(t) for t in x], np.int64) for x in spelled), said


def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``ends_a`` and in ``ends_b`` of the ends that both have, in order.

    Intervals of ``ends_a`` from ``starts`` to ``stops`` (not included) end at
    a shared end each. All intervals of a level are divided at once: an end
    near an interval's middle is looked up in ``ends_b`` by bisection, first
    the middle itself, then its neighbours, then all ends of the interval, of
    which the nearest counts. Both halves are divided again; an interval
    without a shared end inside is a leaf. A stretch without shared ends is
    read a few times at most, since it's cut off at both of its ends.
    """
    low, high = starts[stops > starts], stops[stops > starts]
    found = [high - 1]
    while len(low):
        inner = high - low > 1
        low, high = low[inner], high[inner]
        mid, cut = (low + high - 1) // 2, np.full(len(low), -1)
        left = np.arange(len(low))
        for off in sorted(range(-NEAR, NEAR + 1), key=abs):
            at = mid[left] + off
            own = (at >= low[left]) & (at < high[left] - 1)
            at, whose = at[own], left[own]
            end = ends_a[at]
            hit = ends_b[np.searchsorted(ends_b, end)] == end
            cut[whose[hit]] = at[hit]
            left = left[cut[left] < 0]
        left = left[high[left] - low[left] > 2 * NEAR + 2]
        if len(left):
            length = high[left] - 1 - low[left]
            own = np.repeat(np.arange(len(left)), length)
            at = low[left][own] + np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
            end = ends_a[at]
            hit = ends_b[np.searchsorted(ends_b, end)] == end
            at, own = at[hit], own[hit]
            nearest = np.lexsort((at, np.abs(at - mid[left][own]), own))
            at, own = at[nearest], own[nearest]
            first = np.append(True, own[1:] != own[:-1])[: len(own)]
            cut[left[own[first]]] = at[first]
        parted = cut >= 0
        low, high, cut = low[parted], high[parted], cut[parted]
        found.append(cut)
        low, high = np.stack((low, cut + 1), axis=1).ravel(), np.stack((cut + 1, high), axis=1).ravel()
    cuts = np.sort(np.concatenate(found))
    return cuts, np.searchsorted(ends_b, ends_a[cuts])


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _pairs(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, doc: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(document << 40 | pair of ids, links) for each document's distinct pairs, in order. Groups have p and q tokens of a and b."""
    wide = p * q >= WIDE
    start_a, start_b, p_, q_ = _starts(p), _starts(q), np.where(wide, 0, p), np.where(wide, 0, q)
    group = np.repeat(np.arange(len(p)), p_)
    at_a = start_a[group] + np.arange(len(group)) - np.repeat(_starts(p_), p_)
    times = q_[group]
    link = np.repeat(np.arange(len(group)), times)
    at_b = start_b[group[link]] + np.arange(len(link)) - np.repeat(_starts(times), times)
    keys, counts = np.unique((doc[group[link]] << 40) | (a[at_a[link]] * base + b[at_b]), return_counts=True)
    if not wide.any():
        return keys, counts
    more, often = [keys], [counts]
    for g in np.flatnonzero(wide):
        ids_a, n_a = np.unique(a[start_a[g] : start_a[g] + p[g]], return_counts=True)
        ids_b, n_b = np.unique(b[start_b[g] : start_b[g] + q[g]], return_counts=True)
        more.append(((doc[g] << 40) | (ids_a[:, None] * base + ids_b)).ravel())
        often.append((n_a[:, None] * n_b).ravel())
    keys, at = np.unique(np.concatenate(more), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, np.concatenate(often))
    return keys, counts


def _packed(numbers: np.ndarray) -> bytes:
    """Small whole numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<i8")).view(np.uint8).reshape(-1, 8).T
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()


def _aligned(texts: list[str | None], path_a: str, path_b: str, with_groups: bool) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For one block of texts: columns by document, distinct pairs, in how many documents each is, and entries.

    An entry is a pair that a document has linked: the document's number times
    the number of pairs, plus the pair's place; and how many links it is.
    """
    side_a, side_b, size_a, size_b, said = _sides(path_a, path_b)
    packed_a, packed_b, spelled_b = [], [], side_b.bytes
    split = [text.split(" ") if text else [] for text in texts]
    side_b.learn(split)
    for text, words in zip(texts, split, strict=True):
        ids_a = ids_b = b""
        if text:
            ids_b = side_b.encode(text, words)
            if b"".join(map(spelled_b.__getitem__, memoryview(ids_b).cast("I"))) == b" " + text.encode():
                ids_a = side_a.encode(text, words)
            else:
                ids_b = b""
        packed_a.append(ids_a)
        packed_b.append(ids_b)
    n_a, n_b = (np.array([len(x) // 4 for x in p], np.int64) for p in (packed_a, packed_b))
    a, b = (np.frombuffer(b"".join(p), "<u4").astype(np.int64) for p in (packed_a, packed_b))
    ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    # A side's tokens of all texts end at one another's ends, and each text's last two at the same byte.
    cut_a, cut_b = shared_ends(ends_a, ends_b, _starts(n_a), np.cumsum(n_a))
    p, q = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    doc = np.searchsorted(np.cumsum(n_a), cut_a, side="right")
    n_groups = np.bincount(doc, minlength=len(texts))
    stops = np.cumsum(n_groups)
    linked = np.append(0, np.cumsum(p * q))
    # In each group A's ids, then B's: a token's place is its own number and that of the other side's tokens before it.
    codes = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[cut_a], last_b[cut_b] = True, True
    codes[np.arange(len(a)) + np.repeat(_starts(q), p)] = a + last_a * len(size_a)
    codes[np.arange(len(b)) + np.repeat(np.cumsum(p), q)] = b + 2 * len(size_a) + last_b * len(size_b)
    digests, at = [], 0
    for n in (n_a + n_b).tolist():
        whole = b"".join(map(said.__getitem__, codes[at : at + n].tolist()))
        digests.append(hashlib.sha256(whole[:-1]).hexdigest() if n else "")
        at += n
    columns = {"n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups, pa.int64()), "n_links": pa.array(linked[stops] - linked[stops - n_groups]), "groups_sha256": pa.array(digests, pa.string())}
    if with_groups:
        lists = [pa.ListArray.from_arrays(pa.array(np.append(0, cut + 1), pa.int32()), pa.array(ids, pa.int32())) for cut, ids in ((cut_a, a), (cut_b, b))]
        began = np.append(0, ends_a)[_starts(n_a)]
        rows = pa.StructArray.from_arrays([pa.array(ends_a[cut_a] - began[doc]), *lists], ["stop", "a", "b"])
        columns["groups"] = pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), rows)
    keys, times = _pairs(a, b, p, q, doc, len(size_b))
    pairs, place = np.unique(keys & ((1 << 40) - 1), return_inverse=True)
    return columns, pairs, np.bincount(place, minlength=len(pairs)), (keys >> 40) * len(pairs) + place, times


def align(df: DataFrame, path_a: str, path_b: str, text_col: str = "text", keep: list[str] | None = None, with_groups: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``keep`` columns of ``df`` (all, if None) with n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and groups.

    A is a byte-level vocabulary (JSON), B a sentence-piece one; A reads a
    space and the text, B the text, before which it puts that space. Byte
    offsets where tokens of both end cut them into ``groups`` (stop, a, b):
    the byte where a group ends, and its ids of both sides. Every token of A
    is linked with every token of B in its group. A pair of ids counts the
    documents that have it linked; a link is best if no pair of its A id
    counts more. ``groups_sha256`` is of ``a1,a2|b1;a3|b2,b3``.

    Documents are aligned in blocks of ``block_bytes``, which are written once
    with each document's pairs and links. Only a block's distinct pairs are
    shuffled, as often as there are blocks that have them; counted, they go
    back to their block. The best of an A id is a table of A's vocabulary at
    most, so it's broadcast.

    Defined cases: null and empty texts, and those that the tokens of either
    side don't spell (B may change characters) have no tokens, zeros and an
    empty digest; repeated rows count as often as they stand; an empty table
    gives an empty result; columns of ``df`` with the names added are
    replaced. A group's distinct ids of A times those of B must fit into
    memory.
    """
    names = [*_ADDED, *["groups"] * with_groups]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    chosen = df.select(*(F.col(c).alias(f"c_{i}") for i, c in enumerate(kept)), F.col(text_col).alias("__text"))
    own = [T.StructField(f"c_{i}", f.dataType) for i, f in enumerate(chosen.schema.fields[:-1])]
    group = T.ArrayType(T.StructType([T.StructField("stop", T.LongType()), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in "ab")]))
    by_doc = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [T.StructField("groups_sha256", T.StringType()), *[T.StructField("groups", group)] * with_groups]
    by_block = [T.StructField(c, T.BinaryType()) for c in ("entries", "times")] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("pairs", "in_docs")]
    kinds = T.StructType([T.StructField("block", T.LongType()), T.StructField("at", T.IntegerType()), *own, *by_doc, *by_block])
    base = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents (``at`` is their place in the block), and behind them their block's row, without ``at``."""
        block = TaskContext.get().partitionId() << 32

        def put(part: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal block
            n = part.num_rows
            columns, pairs, in_docs, entries, times = _aligned(part.column("__text").to_pylist(), path_a, path_b, with_groups)
            rows = [pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), *(part.column(i) for i in range(len(kept))), *columns.values()]
            one = {"block": [block], "entries": [_packed(np.diff(entries, prepend=0))], "times": [_packed(times)], "pairs": [pairs], "in_docs": [in_docs]}
            schema = pa.schema([pa.field("block", pa.int64()), pa.field("at", pa.int32()), *(pa.field(f"c_{i}", part.schema.field(i).type) for i in range(len(kept))), *(pa.field(c, x.type) for c, x in columns.items()), *(pa.field(c, pa.binary()) for c in ("entries", "times")), *(pa.field(c, pa.list_(pa.int64())) for c in ("pairs", "in_docs"))])
            docs = pa.Table.from_arrays([*rows, *(pa.nulls(n, f.type) for f in list(schema)[len(rows) :])], schema=schema)
            last = pa.Table.from_arrays([pa.array(one[f.name], f.type) if f.name in one else pa.nulls(1, f.type) for f in schema], schema=schema)
            block += 1
            yield from docs.combine_chunks().to_batches()
            yield from last.to_batches()

        held, size = [], 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + block_bytes - size, side="right")))
                held.append(pa.Table.from_batches([batch.slice(start, stop - start)]))
                size += int(ends[stop - 1] - before)
                start = stop
                if start < batch.num_rows or size >= block_bytes:
                    yield from put(pa.concat_tables(held))
                    held, size = [], 0
        if held:
            yield from put(pa.concat_tables(held))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's documents with the sums over their links."""
        row = left.filter(pc.is_null(left.column("at")))
        docs = left.filter(pc.is_valid(left.column("at"))).sort_by("at")
        entries, times = np.cumsum(_unpacked(row.column("entries")[0].as_py())), _unpacked(row.column("times")[0].as_py())
        n = max(right.num_rows, 1)
        count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = right.column("place").to_numpy()
        count[place], best[place] = right.column("n").to_numpy(), right.column("best").to_numpy()
        sizes, places = np.bincount(entries // n, minlength=docs.num_rows), entries % n
        stops = np.cumsum(sizes)
        sums = [np.append(0, np.cumsum(times * x[places])) for x in (best, count)]
        n_best, count_sum = (pa.array(s[stops] - s[stops - sizes]) for s in sums)
        columns = {c: docs.column(c) for c in docs.column_names} | {"n_best": n_best, "count_sum": count_sum}
        return pa.Table.from_pydict({c: columns[c] for c in out_names})

    table = written(chosen.mapInArrow(blocks, kinds), "alignment")
    lines = table.filter("at is null").select("block", F.posexplode(F.arrays_zip("pairs", "in_docs")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.in_docs").alias("docs"))
    counted = lines.withColumn("n", F.sum("docs").over(Window.partitionBy("pair"))).withColumn("a", F.expr(f"pair div {base}"))
    most = counted.groupBy("a").agg(F.max("n").alias("most"))
    told = counted.join(F.broadcast(most), "a").select(F.col("block").alias("of_block"), "place", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    out = T.StructType([*own, *(f for f in by_doc), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    out_names = out.fieldNames()
    done = table.drop("pairs", "in_docs").groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(finish, out)
    return done.select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(kept)), *names)
