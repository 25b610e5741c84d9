"""Approximate nearest neighbours by inner product over balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxframe.llm.common import checkpointed


@dataclass
class Index:
    """Centroids of posting lists, a graph over them, and the ratios that select lists.

    Vectors are lifted by one coordinate so that the largest inner product
    becomes the least distance: a stored vector x by sqrt(most^2 - |x|^2), a
    query by 0.
    """

    centroids: np.ndarray
    neighbours: np.ndarray
    most: float
    #: A stored vector goes to lists within this ratio of its nearest, to so many at most.
    copy_ratio: float
    copies: int
    #: A query reads lists within this ratio of its nearest centroid's distance.
    read_ratio: float
    #: A nearest centroid closer than this (as nine queries of ten have it) counts as this far, so that a query near a centroid reads beyond it as well.
    floor: float = 0.0

    def lift(self, vectors: np.ndarray, stored: bool) -> np.ndarray:
        squares = (vectors**2).sum(axis=1)
        extra = np.sqrt(np.maximum(self.most**2 - squares, 0.0)) if stored else np.zeros(len(vectors))
        return np.column_stack([vectors, extra])

    def near(self, points: np.ndarray, ratio: float, floor: float = 0.0) -> np.ndarray:
        """Distances of lifted points to the centroids found within ``ratio`` of the nearest (or of ``floor``); infinite for others.

        Best-first search in the graph from 32 spread entries, one step of all
        points at once: each looks at the neighbours of its closest centroid not yet expanded,
        until that is beyond the ratio and a few more.
        """
        n, k = len(points), len(self.centroids)
        found, ahead = np.full((n, k), np.inf), np.full((n, k), np.inf)
        entries = np.arange(0, k, -(-k // 32))
        found[:, entries] = ahead[:, entries] = _distances(points, self.centroids[entries])
        least, beyond, active = found[:, entries].min(axis=1), np.zeros(n, int), np.arange(n)
        while len(active):
            open_ = ahead[active]
            best = open_.argmin(axis=1)
            distance = open_[np.arange(len(active)), best]
            beyond[active] += distance > ratio**2 * np.maximum(least[active], floor**2)
            on = np.isfinite(distance) & (beyond[active] <= 4)
            active, best = active[on], best[on]
            ahead[active, best] = np.inf
            beside = self.neighbours[best]
            # Only centroids not looked at before.
            at, which = np.nonzero(np.isinf(found[active[:, None], beside]))
            row, own = active[at], beside[at, which]
            new = ((points[row] - self.centroids[own]) ** 2).sum(axis=1)
            found[row, own] = ahead[row, own] = new
            np.minimum.at(least, row, new)
        found[found > ratio**2 * np.maximum(least, floor**2)[:, None]] = np.inf
        return np.sqrt(found)

    def stored_in(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: each vector's nearest list, and a boundary vector's others."""
        found = self.near(self.lift(vectors, True), self.copy_ratio)
        ranked = np.argsort(found, axis=1, kind="stable")[:, : self.copies]
        row, place = np.nonzero(np.isfinite(np.take_along_axis(found, ranked, axis=1)))
        return row, ranked[row, place]

    def read_by(self, vectors: np.ndarray, homes: np.ndarray | None = None, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, distance) triples: the lists a query reads.

        ``homes`` has the number of vectors whose nearest list each is; where
        the lists within the ratio are home to fewer than ``least``, the next
        nearest are read as well, until they are or all lists are read.
        """
        points = self.lift(vectors, False)
        found = self.near(points, self.read_ratio, self.floor)
        if homes is not None:
            for i in np.flatnonzero(np.isfinite(found) @ homes < least):
                away = ((points[i] - self.centroids) ** 2).sum(axis=1)
                order = np.argsort(away, kind="stable")
                more = order[: np.searchsorted(np.cumsum(homes[order]), least) + 1]
                found[i, more] = np.sqrt(away[more])
        row, own = np.nonzero(np.isfinite(found))
        return row, own, found[row, own]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0.0)


def _nearest(points: np.ndarray, centroids: np.ndarray, weight: np.ndarray, block: int = 1024) -> np.ndarray:
    """The place of each point's least weighted distance, a block of points at once."""
    return np.concatenate([(_distances(points[i : i + block], centroids) * weight).argmin(axis=1) for i in range(0, len(points), block)])


def _chain(apart: np.ndarray) -> list[int]:
    """An order in which each is followed by the nearest one left, so that numbers near each other are near in space; ``apart`` is used up."""
    order = [0]
    for _ in range(len(apart) - 1):
        apart[:, order[-1]] = np.inf
        order.append(int(apart[order[-1]].argmin()))
    return order


def fit(sample: np.ndarray, most: float, lists: int, top: int, recall: float = 0.94, copies: int = 3, border: float = 0.2, degree: int = 24, rounds: int = 10, seed: int = 42) -> Index:
    """Balanced centroids of a bounded sample, their graph, and the read ratio that ``recall`` needs.

    Balance: lifted vectors lie on a sphere, and centroids are put on one, since
    means of many vectors would be shorter, so nearer to all others, and draw
    ever more of them; and a cluster's distances are stretched by its share of
    the last round, so crowded clusters give up their border. A vector is at a border if
    its second centroid is nearly as near as the first: the ratio is that which
    a share ``border`` of the sample keeps, so however vectors lie, few are
    stored more than once. The read ratio is one
    with which queries of the sample find their true nearest neighbours in it,
    by brute force, at the recall asked for: the least by distances, raised
    until the lists that the graph search itself finds hold as many. Matrices
    of points by lists are made in blocks; the largest thing held is one of
    lists by lists in single precision, 64 MB for 4,096 lists.
    """
    rng = np.random.default_rng(seed)
    index = Index(np.zeros((1, sample.shape[1] + 1)), np.zeros((1, 1), int), most, 1.0, copies, 1.0)
    lifted = index.lift(sample, True)
    distinct = np.unique(lifted, axis=0)
    lists = max(1, min(lists, len(distinct)))
    centroids = distinct[rng.choice(len(distinct), lists, replace=False)]
    weight = np.ones(lists)
    for _ in range(rounds):
        near = _nearest(lifted, centroids, weight)
        sizes = np.bincount(near, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, lifted)
        means = sums / np.maximum(sizes, 1)[:, None]
        norms = np.linalg.norm(means, axis=1)
        own = norms > 1e-9 * most
        centroids = np.where(own[:, None], means / np.maximum(norms, 1e-300)[:, None], centroids / np.maximum(np.linalg.norm(centroids, axis=1), 1e-300)[:, None]) * norms[own].mean()
        weight = (np.maximum(sizes, 1) * lists / len(lifted)) ** 0.1
    blocks = range(0, lists, 512)
    centroids = centroids[_chain(np.concatenate([_distances(centroids[i : i + 512], centroids).astype(np.float32) for i in blocks]))]
    degree = min(degree, lists)
    neighbours = np.concatenate([np.argsort(_distances(centroids[i : i + 512], centroids), axis=1, kind="stable")[:, :degree] for i in blocks])
    # A ring through all centroids keeps the graph in one piece.
    neighbours[:, -1] = (np.arange(lists) + 1) % lists
    index.centroids, index.neighbours = centroids, neighbours
    asked = rng.choice(len(sample), min(len(sample), 400), replace=False)
    if lists > 1:
        two = np.sqrt(np.sort(_distances(lifted[rng.choice(len(sample), min(len(sample), 1024), replace=False)], centroids), axis=1)[:, :2])
        index.copy_ratio = float(np.clip(np.quantile(two[:, 1] / np.maximum(two[:, 0], 1e-12), border), 1.0, 1.05))
    away = np.sqrt(_distances(index.lift(sample[asked], False), centroids))
    index.floor = float(np.quantile(away.min(axis=1), 0.9))
    trues = []
    for q in asked:
        scores = sample @ sample[q]
        scores[q] = -np.inf
        trues.append(np.argsort(-scores, kind="stable")[: min(top, len(sample) - 1)])
    wanted = np.unique(np.concatenate(trues)) if trues else np.zeros(0, int)
    if not len(wanted):
        return index
    pairs = [index.stored_in(sample[wanted[i : i + 1024]]) for i in range(0, len(wanted), 1024)]
    held_in: dict[int, list[int]] = {}
    for i, (row, own) in enumerate(pairs):
        for r, c in zip(wanted[1024 * i + row].tolist(), own.tolist(), strict=True):
            held_in.setdefault(r, []).append(c)
    nearest_one = np.maximum(away.min(axis=1), index.floor)
    ratios = [max(1.0, away[i][held_in[t]].min() / nearest_one[i]) if nearest_one[i] else 1.0 for i, true in enumerate(trues) for t in true]
    index.read_ratio = max(1.0, float(np.quantile(ratios, recall)) * (1 + 1e-9))
    points = index.lift(sample[asked], False)
    while True:
        reads = np.isfinite(index.near(points, index.read_ratio, index.floor))
        held = np.mean([np.mean([reads[i][held_in[t]].any() for t in true]) for i, true in enumerate(trues)])
        if held >= recall or reads.all():
            break
        index.read_ratio *= 1.02
    return index


def best_of(queries: np.ndarray, least_scores: np.ndarray, vectors: np.ndarray, ids: np.ndarray, allowed: np.ndarray, top: int, scale: float = 1.0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query row: places of its ``top`` best vectors of at least its least score, best first, ties to the smaller id, and scores.

    A matrix product of the vectors over ``scale`` finds all that may be among
    them; the scores of the vectors themselves are then summed in one order, so
    equal vectors have equal scores.
    """
    rough = (queries / scale) @ (vectors / scale).T
    scaled = least_scores / scale / scale
    allowed = allowed & (rough >= (scaled - 1e-9 * (1 + np.abs(np.where(np.isfinite(scaled), scaled, 0.0))))[:, None])
    rough[~allowed] = -np.inf
    for i in range(len(queries)):
        have = int(allowed[i].sum())
        if not have:
            continue
        least = np.partition(rough[i], len(ids) - min(top, have))[len(ids) - min(top, have)]
        at = np.flatnonzero(rough[i] >= least - 1e-9 * (1 + abs(least)))
        at = at[np.isfinite(rough[i][at])]
        with np.errstate(over="ignore", invalid="ignore"):
            exact = (vectors[at] * queries[i]).sum(axis=1)
        at, exact = at[exact >= least_scores[i]], exact[exact >= least_scores[i]]
        order = np.lexsort((ids[at], -exact))[:top]
        yield i, at[order], exact[order]


def nearest(
    df: DataFrame,
    query_rows,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    top: int = 20,
    recall: float = 0.94,
    sample_rows: int = 16_384,
    list_rows: int = 64,
    most_lists: int = 4_096,
    shelf_rows: int = 8_192,
    near_shelves: int = 3,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` largest inner products found for each query.

    ``query_rows`` is a condition that selects the queries among the rows; a
    query's own row is no candidate, but others with the same vector are.

    The index is fit on at most ``sample_rows`` vectors (in the order of a hash
    of their id, then by id and vector): about one posting list for ``list_rows`` rows, up to
    ``most_lists``, so its size is bounded and it goes to every task. Every
    vector is stored in its nearest list, one near a border in up to three.
    Lists lie on shelves of about ``shelf_rows`` stored vectors; a longer list
    is spread over several by a hash, so a crowd of equal vectors is no task
    of its own. A query is sent to the shelves of the lists within the
    distance ratio, and of further ones until these are home to ``top`` others, in packs of bounded size; a task multiplies one shelf
    with one pack and gives at most ``top`` rows for each query. The
    ``near_shelves`` nearest come first; from the others only vectors come
    back that are no worse than the ``top``-th best found there, so what is
    sent doesn't grow with the number of shelves. Nothing found is capped but
    by ``top``.

    Defined cases: rows without id and vectors that are null, empty, zero,
    or hold null or non-finite numbers take no part; vectors of each length are
    searched by themselves, with an index of their own; components may be as
    large as a double can be (the index is built on vectors over the largest
    one), but products beyond doubles are not ranked;
    rows with one id are candidates and queries of their own; fewer candidates give fewer rows; an empty table gives an empty result;
    other columns are ignored.
    """
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), query_rows.alias("asks"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", sound) & F.exists("v", lambda x: x != 0))
    rows = checkpointed(rows.withColumn("asks", F.coalesce("asks", F.lit(False))).withColumn("uid", F.monotonically_increasing_id()))
    largest = F.max(F.array_max(F.transform("v", F.abs)))
    groups = rows.groupBy(F.size("v").alias("wide")).agg(F.count("*").alias("n"), largest.alias("scale"), F.count_if("asks").alias("asks")).orderBy("wide").collect()
    parts = []
    for wide, n, scale, asks in groups:
        if asks and n > 1:
            own = rows.filter(F.size("v") == wide) if len(groups) > 1 else rows
            unit = F.transform("v", lambda x: x / F.lit(scale))  # noqa: B023
            most = own.agg(F.sqrt(F.max(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
            parts.append(_nearest_of_length(own, n, scale, most, wide, top, recall, sample_rows, list_rows, most_lists, shelf_rows, near_shelves))
    if not parts:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts)


def _nearest_of_length(rows: DataFrame, n: int, scale: float, most: float, wide: int, top: int, recall: float, sample_rows: int, list_rows: int, most_lists: int, shelf_rows: int, near_shelves: int) -> DataFrame:
    """``nearest`` among sound rows (uid, id, v, asks) whose ``n`` vectors all have ``wide`` numbers, none above ``scale``, and over it no norm above ``most``."""
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id", "v").select("v").limit(sample_rows).collect()]) / scale
    index = fit(sample, most, int(min(most_lists, max(1, round(n / list_rows)))), top, recall)

    def to_lists(reads: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 1024):
                    part = batch.slice(start, 1024)
                    vectors = np.array(part.column(1).flatten()).reshape(-1, wide) / scale
                    row, own, *more = index.read_by(vectors, homes, top + 1) if reads else index.stored_in(vectors)
                    # A stored vector's first list is its home.
                    more = more or [np.diff(row, prepend=-1) > 0]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(own.astype(np.int32)), *map(pa.array, more)], ["uid", "list", "away" if reads else "home"])

        return run

    slim = rows.select("uid", "v")
    stored = checkpointed(slim.mapInArrow(to_lists(False), "uid long, list int, home boolean"))
    sizes = stored.groupBy("list").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
    # Lists in order fill shelves; there are at most ``most_lists`` of them.
    shelf_of, shelf, filled = [], 0, 0
    homes = np.zeros(len(index.centroids), np.int64)
    for r in sizes.orderBy("list").collect():
        homes[r.list] = r.homes
        cut = -(-r.n // shelf_rows)
        if cut == 1 and filled + r.n > shelf_rows:
            shelf, filled = shelf + 1, 0
        if cut > 1:
            shelf += filled > 0
            shelf_of.append((r.list, shelf, cut))
            shelf, filled = shelf + cut, 0
        else:
            shelf_of.append((r.list, shelf, 1))
            filled += r.n
    pieces = rows.sparkSession.createDataFrame(shelf_of, "list int, shelf int, cut int")
    home = F.col("shelf") + F.pmod(F.xxhash64("uid"), F.col("cut")).cast("int")
    stored = stored.join(F.broadcast(pieces), "list").select("uid", "list", home.alias("shelf"))
    stored = checkpointed(stored.groupBy("uid", "shelf").agg(F.array_sort(F.collect_set("list")).alias("lists")))
    asked = rows.filter("asks").select("uid", "v").mapInArrow(to_lists(True), "uid long, list int, away double").join(F.broadcast(pieces), "list")
    asked = asked.select("uid", "list", "away", F.explode(F.sequence(F.col("shelf"), F.col("shelf") + F.col("cut") - 1)).alias("shelf"))
    # One row for each query and shelf, with the lists it reads there.
    asked = asked.groupBy("uid", "shelf").agg(F.array_sort(F.collect_set("list")).alias("lists"), F.min("away").alias("away"))
    asked = checkpointed(asked.withColumn("turn", F.row_number().over(Window.partitionBy("uid").orderBy("away", "shelf"))))
    ids = rows.select("uid", "id", "v")

    def multiply(key: tuple, questions: pa.Table, answers: pa.Table) -> pa.Table:
        out = [[], [], []]
        if questions.num_rows and answers.num_rows:
            answers = answers.sort_by("uid")
            vectors = np.array(answers["v"].combine_chunks().flatten()).reshape(-1, wide)
            uids, ids = answers["uid"].to_numpy(), answers["id"].to_numpy()
            lists = len(index.centroids)
            holds = np.zeros((len(uids), lists), np.float32)
            counts = np.array(answers["lists"].combine_chunks().value_lengths())
            holds[np.repeat(np.arange(len(uids)), counts), np.array(answers["lists"].combine_chunks().flatten())] = 1
            local = np.flatnonzero(holds.any(axis=0))
            holds = holds[:, local]
            for start in range(0, questions.num_rows, 256):
                part = questions.slice(start, 256).combine_chunks()
                asks = np.array(part["v"].combine_chunks().flatten()).reshape(-1, wide)
                reads = np.zeros((len(asks), lists), np.float32)
                counts = np.array(part["lists"].combine_chunks().value_lengths())
                reads[np.repeat(np.arange(len(asks)), counts), np.array(part["lists"].combine_chunks().flatten())] = 1
                allowed = (reads[:, local] @ holds.T > 0) & (part["uid"].to_numpy()[:, None] != uids)
                names = part["id"].to_numpy(), part["uid"].to_numpy()
                for i, at, scores in best_of(asks, part["least"].to_numpy(), vectors, ids, allowed, top, scale):
                    out[0].append(np.column_stack([np.full(len(at), names[1][i]), np.full(len(at), names[0][i])]))
                    out[1].append(np.column_stack([ids[at], uids[at]]))
                    out[2].append(scores)
        pairs, found = (np.concatenate(x) if x else np.zeros((0, 2), np.int64) for x in out[:2])
        scores = np.concatenate(out[2]) if out[2] else np.zeros(0)
        return pa.table({"query_uid": pairs[:, 0], "query_id": pairs[:, 1], "vec_id": found[:, 0], "uid": found[:, 1], "score": scores})

    def search(asked: DataFrame) -> DataFrame:
        """What queries (uid, shelf, lists, least) find on their shelves, a vector once; packs of queries bound a task."""
        crowd = asked.groupBy("shelf").agg(F.ceil(F.count("*") / F.lit(2048)).cast("int").alias("packs"))
        left = asked.join(crowd, "shelf").withColumn("pack", F.pmod(F.xxhash64("uid"), F.col("packs")).cast("int"))
        right = stored.join(crowd, "shelf").withColumn("pack", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)))
        # Named anew, so that the two sides have no column in common.
        side = lambda of, *more: of.join(ids, "uid").select(*(F.col(c).alias(c, metadata={}) for c in ("shelf", "pack", "uid", "id", "lists", "v", *more)))
        pairs = side(left, "least").groupBy("shelf", "pack").cogroup(side(right).groupBy("shelf", "pack"))
        found = pairs.applyInArrow(multiply, "query_uid long, query_id long, vec_id long, uid long, score double")
        return found.groupBy("query_uid", "query_id", "vec_id", "uid").agg(F.max("score").alias("score"))

    best = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    rank = F.row_number().over(best)
    none = F.lit(float("-inf"))
    near = checkpointed(search(asked.filter(F.col("turn") <= near_shelves).withColumn("least", none)))
    least = near.withColumn("rank", rank).filter(F.col("rank") == top).select(F.col("query_uid").alias("uid"), F.col("score").alias("least"))
    rest = asked.filter(F.col("turn") > near_shelves).join(least, "uid", "left").withColumn("least", F.coalesce("least", none))
    # A border vector may be found on shelves of either round.
    found = near.unionByName(search(rest)).groupBy("query_uid", "query_id", "vec_id", "uid").agg(F.max("score").alias("score"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
