"""SimHash near-duplicate groups with bit-sliced fingerprint comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxframe.llm.common import checkpointed
from boxframe.llm.components import components

BITS = 64
#: Hashes counted at once for one text; bounds memory for very long texts.
PIECE = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles.

    A-Z become lower case; words are runs of characters other than ASCII white
    space. A text of fewer words than a shingle is one shingle; one of no words
    (or null) has fingerprint 0. Bit i is set if it is set in more than half
    of the shingles' XXH64 values, repeats included.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    hashes = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8", count=n)
    counts = sum(np.unpackbits(hashes[i : i + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, n, PIECE))
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): each row's fingerprint as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], ["id", "fp"])

    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(hashed, T.StructType([T.StructField("id", chosen.schema["id"].dataType), T.StructField("fp", T.LongType())]))


class BitPlanes:
    """Fingerprints stored by bit: plane i holds bit i of all of them.

    Planes are Python integers, so one operation treats as many fingerprints
    as the block has.
    """

    def __init__(self, prints: list[int]):
        self.n = len(prints)
        self.full = (1 << self.n) - 1
        bits = np.unpackbits(np.array(prints, dtype=np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        packed = np.packbits(bits, axis=0, bitorder="little")
        planes = [int.from_bytes(packed[:, i].tobytes(), "little") for i in range(BITS)]
        #: A plane that is all 0 or all 1 adds nothing to any distance within the block.
        self.planes = [(i, p) for i, p in enumerate(planes) if p not in (0, self.full)]

    def within(self, query: int, radius: int, among: int) -> int:
        """Which of ``among`` (a bit set) lie within ``radius`` (3 at most) bits of ``query``, one of the block.

        Two carry-save planes count to three; a carry out of them, or a count
        over the radius, is beyond it. Ends early when no candidate is left.
        """
        ones = twos = 0
        alive = among
        for i, plane in self.planes:
            differ = (self.full ^ plane if query >> i & 1 else plane) & alive
            carry = ones & differ
            ones ^= differ
            over = twos & carry
            twos ^= carry
            alive &= ~(over | (twos if radius < 2 else 0) | (ones & twos if radius < 3 else 0) | (ones if radius < 1 else 0))
            if not alive:
                break
        return alive


def forest(prints: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(i, j) index pairs that join all fingerprints linked within ``radius``.

    A search over the links: each fingerprint leaves the unseen set once, so a
    dense group gives as many pairs as it has members, not their square.
    """
    block = BitPlanes(prints)
    unseen = block.full
    for start in range(block.n):
        if not unseen >> start & 1:
            continue
        unseen ^= 1 << start
        todo = [start]
        while todo and unseen:
            found = block.within(prints[todo.pop()], radius, unseen)
            unseen ^= found
            while found:
                j = found.bit_length() - 1
                found ^= 1 << j
                todo.append(j)
                yield start, j


def _blocks(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``n`` nearly equal parts of a fingerprint."""
    ends = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def links(nodes: DataFrame, radius: int = 3, blocks: int = 5, tile: int = 8192) -> DataFrame:
    """(u, v) pairs of ``nodes`` (node, fp) that join all fingerprints within ``radius`` bits.

    The bits are cut into ``blocks`` parts; two fingerprints that differ in at
    most ``radius`` bits agree on ``blocks - radius`` parts at least, so every
    combination of that many parts is a key, and only fingerprints with a key
    in common meet. Keys of one fingerprint are dropped. A key with more than
    ``tile`` of them is cut into parts by a hash, and every two parts meet in
    a task of their own, so no task holds more than about twice that many and
    no pair is lost.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius is 0 to 3")
    parts = _blocks(blocks)
    masks = [sum(((1 << n) - 1) << a for a, n in chosen) for chosen in combinations(parts, blocks - radius)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keys = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("part")) for k, m in enumerate(signed)))
    keyed = nodes.select("node", "fp", F.explode(keys).alias("key")).select("node", "fp", "key.k", "key.part")
    shared = keyed.groupBy("k", "part").agg(F.count("*").alias("n")).filter("n > 1")
    cut = keyed.join(shared, ["k", "part"]).withColumn("cuts", F.ceil(F.col("n") / tile).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")
    dealt = cut.select("k", "part", "node", "fp", "own", other).select("k", "part", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "fp")
    tiles = dealt.groupBy("k", "part", "a", "b").agg(F.collect_list(F.struct("node", "fp")).alias("members")).filter("size(members) > 1").select("members.node", "members.fp")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for ids, prints in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, j in forest(prints, radius):
                    u.append(ids[i])
                    v.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return tiles.mapInArrow(compared, "u long, v long")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fingerprint, component_id) of every row: near-duplicate groups by SimHash.

    Rows whose fingerprints differ in ``radius`` bits or fewer are linked;
    ``component_id`` is the smallest id reachable over links, the row's own
    included. Rows with equal fingerprints meet as one node (the smallest of
    their ids), so copies cost no comparisons.

    Defined cases: null and empty texts have fingerprint 0 and are linked like
    any other; repeated rows are returned as often as they come; rows without
    id get the component of their fingerprint, and null if no row with that
    fingerprint has an id (such fingerprints take no part in links); an empty
    table gives an empty result; other columns are ignored. Ids are integers.
    """
    prints = checkpointed(fingerprints(df, id_col, text_col, shingle, seed))
    nodes = prints.groupBy("fp").agg(F.min("id").cast("long").alias("node"))
    joined = components(links(nodes.filter("node is not null"), radius))
    groups = nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(groups, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Ids to leave out up to which their table (one number each) is broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """The rows of ``df`` that stay: one of each near-duplicate group, with all columns.

    The row with the group's smallest id stays; of several equal ones, one.
    Which ids go is found among ids and fingerprints alone; texts stay where
    they are while the ids to leave out are few enough to be broadcast.

    Defined cases: null and empty texts have fingerprint 0; where rows share an
    id but not their fingerprint, each is treated by its own fingerprint; rows
    without id stay only if no row with an id has their fingerprint, one for
    each fingerprint; an empty table gives an empty result; other columns may
    have any name.
    """
    names = [f"c_{i}" for i in range(len(df.columns))]
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(df.columns, names, strict=True)), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    groups = checkpointed(simhash_components(rows, "__id", "__text", radius))
    named = groups.filter("__id is not null")
    repeated = checkpointed(named.groupBy("__id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("__id").alias("gone")))
    has_repeated, has_nameless = (bool(x.limit(1).count()) for x in (repeated, groups.filter("__id is null")))
    gone = named.filter("__id <> component_id").select(F.col("__id").alias("gone"))
    gone = checkpointed(gone.union(repeated).distinct() if has_repeated else gone)
    few = gone.count() <= BROADCAST_IDS
    kept = rows.filter("__id is not null").join(F.broadcast(gone) if few else gone, F.col("__id") == F.col("gone"), "left_anti")

    @F.pandas_udf("string")
    def printed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f"{fingerprint(t):016x}").astype(object)

    if has_repeated:
        # Only rows that share their id are compared by id and fingerprint.
        first = named.filter("__id = component_id").select(F.col("__id").alias("gone"), "fingerprint").join(repeated, "gone", "left_semi").distinct()
        own = rows.join(F.broadcast(repeated) if few else repeated, F.col("__id") == F.col("gone"), "left_semi").withColumn("__print", printed("__text"))
        own = own.join(first, (F.col("__id") == F.col("gone")) & (F.col("__print") == F.col("fingerprint")), "left_semi")
        kept = kept.unionByName(own.dropDuplicates(["__id", "__print"]).drop("__print"))
    if has_nameless:
        nameless = rows.filter("__id is null").withColumn("__print", printed("__text"))
        nameless = nameless.join(named.select("fingerprint").distinct(), F.col("__print") == F.col("fingerprint"), "left_anti")
        kept = kept.unionByName(nameless.dropDuplicates(["__print"]).drop("__print"))
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)))
