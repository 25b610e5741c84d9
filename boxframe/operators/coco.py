"""Average precision and recall of detections by the public COCO definition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxframe.operators.scan import SEGMENT
from boxframe.storage import written

# Fixed values of the definition: thresholds, recall points, areas of boxes (pixels), detections by image.
IOUS = [round(0.5 + 0.05 * i, 2) for i in range(10)]
LEAST = [min(t, 1 - 1e-10) for t in IOUS]
RECALLS = [i / 100 for i in range(101)]
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
MOST = 100

#: Pairs of boxes whose overlaps are computed at once, and rows scanned at once.
PAIRS, BLOCK = 1 << 20, 1 << 14
#: Numbers that a scan sums: hits and detections that count by threshold, hits among the first one and ten of an image.
BITS, SUMS = len(IOUS), 4 * len(IOUS)
ALL_OUT = (1 << BITS) - 1


def _arrays(rows: pa.RecordBatch | pa.Table) -> dict[str, np.ndarray]:
    return {n: rows.column(n).to_pandas().to_numpy() for n in rows.schema.names}


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Places where any of the columns changes, the first row's among them. Nulls, which Arrow hands over as NaN, are equal."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= (c[1:] != c[:-1]) & ~((c[1:] != c[1:]) & (c[:-1] != c[:-1]))
    return np.flatnonzero(new)


def _overlapping(c: dict[str, np.ndarray], size: np.ndarray, rows: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, IoU) for each of ``rows`` with each of the n rows from ``first`` on, if they overlap enough to match."""
    till, found = np.cumsum(n), [(rows[:0], rows[:0], size[:0])]
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(till, till[at] - n[at] + PAIRS, side="right")))
        k = n[at:end]
        a = np.repeat(rows[at:end], k)
        b = np.arange(len(a)) - np.repeat(np.cumsum(k) - k - first[at:end], k)
        wide = np.minimum(c["x2"][a], c["x2"][b]) - np.maximum(c["x1"][a], c["x1"][b])
        high = np.minimum(c["y2"][a], c["y2"][b]) - np.maximum(c["y1"][a], c["y1"][b])
        both = np.where((wide > 0) & (high > 0), wide * high, 0.0)
        iou = both / np.maximum(size[a] + size[b] - both, 1e-12)
        enough = np.flatnonzero(iou >= IOUS[0])
        found.append((a[enough], b[enough], iou[enough]))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _greedy(pairs: list[tuple[int, int, float]], aside: np.ndarray, hits: np.ndarray, outs: np.ndarray) -> None:
    """Greedy matching of detections that have a choice: ``pairs`` (detection, gold box, IoU) in order, into ``hits`` and ``outs``."""
    own: dict[int, list] = {}
    for a, b, x in pairs:
        own.setdefault(a, []).append((bool(aside[b]), b, x))
    for choices in own.values():
        choices.sort(key=lambda c: c[:2])
    highest = max(x for _, _, x in pairs)
    for bit in [i for i, t in enumerate(LEAST) if highest >= t]:
        taken = set()
        for a, choices in own.items():
            best, at, out = LEAST[bit], -1, False
            for away, b, x in choices:
                if b in taken or x < best:
                    continue
                if at >= 0 and not out and away:
                    break
                best, at, out = x, b, away
            if at >= 0:
                taken.add(at)
                hits[a] |= 1 << bit
                outs[a] = outs[a] & ~(1 << bit) | int(out) << bit


MATCHES = "image_id long, category_id long, area int, rank int, score double, hits int, outs int, total long"
KINDS = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[t]) for n, t in (c.split() for c in MATCHES.split(", "))])


def _rows(columns: dict, n: int) -> pa.Table:
    """A table of ``MATCHES``; single values are those of all n rows, None is null."""
    full = {k: pa.nulls(n) if c is None else np.full(n, c) if isinstance(c, int) else c for k, c in columns.items()}
    return pa.table([(c if isinstance(c, pa.ChunkedArray) else pa.array(c)).cast(KINDS.field(k).type) for k, c in ((k, full[k]) for k in KINDS.names)], schema=KINDS)


def _images(table: pa.Table) -> pa.Table:
    """Whole images, rows sorted as ``evaluate`` does: detections by area where they count at some threshold, and numbers of gold boxes."""
    c = _arrays(table)
    rows = len(c["side"])
    pred = c["side"] == 1
    size = (c["x2"] - c["x1"]) * (c["y2"] - c["y1"])
    groups = _starts(c["image_id"], c["category_id"])
    of_group = np.repeat(np.arange(len(groups)), np.diff(np.append(groups, rows)))
    n_gold = np.add.reduceat((~pred).astype(np.int64), groups)
    rank = np.arange(rows) - (groups + n_gold)[of_group]
    chosen = np.flatnonzero(pred & (rank < MOST))
    of = of_group[chosen]
    a, b, iou = _overlapping(c, size, chosen, groups[of], n_gold[of])
    # Where no box of either side has a choice, a pair is a match at each threshold that it reaches.
    choice = (np.bincount(a, minlength=rows)[a] > 1) | (np.bincount(b, minlength=rows)[b] > 1)
    hard = np.zeros(len(groups), bool)
    hard[of_group[a[choice]]] = True
    hard = hard[of_group[a]]
    ra, rb, reach = a[~hard], b[~hard], (1 << np.searchsorted(LEAST, iou[~hard], side="right")) - 1
    ha, hb, hi = a[hard], b[hard], iou[hard]
    cuts = _starts(of_group[ha]) if len(ha) else []
    crowds = [list(zip(*(x.tolist() for x in part), strict=True)) for part in zip(*(np.split(x, cuts[1:]) for x in (ha, hb, hi)), strict=True)] if len(ha) else []
    out = []
    for area, (least, most) in enumerate(AREAS.values()):
        aside = ~((size >= least) & (size <= most))
        hits, outs = np.zeros(rows, np.int32), np.where(aside, ALL_OUT, 0).astype(np.int32)
        hits[ra] = reach
        outs[ra] = outs[ra] & ~reach | np.where(aside[rb], reach, 0)
        for pairs in crowds:
            _greedy(pairs, aside, hits, outs)
        shown = chosen[outs[chosen] != ALL_OUT]
        at = pa.array(shown)
        own = {"rank": rank[shown], "hits": hits[shown], "outs": outs[shown], "total": None}
        out.append(_rows({**{n: table[n].take(at) for n in ("image_id", "category_id", "score")}, "area": area, **own}, len(shown)))
        counted = table.select(["category_id"]).filter(pa.array(~pred & ~aside)).group_by("category_id").aggregate([([], "count_all")])
        none = dict.fromkeys(("image_id", "rank", "score", "hits", "outs"))
        out.append(_rows({**none, "category_id": counted["category_id"], "area": area, "total": counted["count_all"]}, counted.num_rows))
    return pa.concat_tables(out)




def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_images`` of batches whose borders lie anywhere: an image's rows wait for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(_starts(_arrays(batch.select(["image_id"]))["image_id"])[-1])
        new = held and held[-1]["image_id"][-1].as_py() != batch["image_id"][0].as_py()
        if new or last:
            done = [*held, batch.slice(0, last)] if last else held
            yield from _images(pa.Table.from_batches(done).combine_chunks()).to_batches()
            held = []
        held.append(batch.slice(last))
    if held:
        yield from _images(pa.Table.from_batches(held).combine_chunks()).to_batches()


BLOCKS = f"{SEGMENT} int, category_id long, area int, marks binary, start array<long>, own array<long>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment's detections, in order, as rows of up to ``BLOCK``: marks (hits that count and detections that count, a bit a threshold), sums of its own and of the curve's before it in the segment."""
    curve, before = None, np.zeros(SUMS, np.int64)
    for batch in batches:
        c, rows = _arrays(batch), []
        cuts = np.append(_starts(c["category_id"], c["area"]), batch.num_rows) if batch.num_rows else []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            key = (batch["category_id"][int(low)].as_py(), int(c["area"][low]))
            if key != curve:
                curve, before = key, np.zeros(SUMS, np.int64)
            for at in range(low, high, BLOCK):
                part = slice(at, min(at + BLOCK, high))
                counts = ALL_OUT & ~c["outs"][part]
                hits, rank = c["hits"][part] & counts, c["rank"][part]
                own = np.concatenate([_bits(x).sum(axis=1) for x in (hits, counts, hits[rank < 1], hits[rank < 10])])
                rows.append((int(c[SEGMENT][0]), *key, (hits | counts << BITS).astype("<i4").tobytes(), before.tolist(), own.tolist()))
                before = before + own
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])


def _bits(marks: np.ndarray) -> np.ndarray:
    """A row for each threshold."""
    return (marks[None] >> np.arange(BITS)[:, None] & 1).astype(np.int64)


POINTS = "category_id long, area int, iou double, place long, best double"


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best precision at a block's hits by curve, threshold and recall point."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            marks = np.frombuffer(row["marks"], "<i4")
            before = np.array(row["before"])
            hits, counts = (np.cumsum(_bits(x), axis=1) + before[k : k + BITS, None] for x, k in ((marks & ALL_OUT, 0), (marks >> BITS, BITS)))
            for i, t in enumerate(IOUS):
                at = np.flatnonzero(marks >> i & 1)
                if not len(at):
                    continue
                h, n = hits[i][at], counts[i][at]
                recall = h / row["total"] + 1e-12
                k = np.floor(recall * 100).astype(np.int64)
                place = np.minimum(np.where((k + 1) / 100.0 <= recall, k + 1, np.where(k / 100.0 > recall, k - 1, k)), 100)
                new = _starts(place)
                best = np.maximum.reduceat(h / n, new)
                out += [(row["category_id"], row["area"], t, int(p), float(x)) for p, x in zip(place[new], best, strict=True)]
        kinds = (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.float64())
        columns = zip(*out, strict=True) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in POINTS.split(", ")])


def evaluate(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row of twelve numbers: ap, ap50, ap75, aps, apm, apl, ar1, ar10, ar100, ars, arm, arl.

    ``gold`` is (image_id, category_id, box, corners in pixels), ``pred`` has
    score as well. Images without predictions don't count at all. Matching is
    greedy by score within an image and category, the one step that is not a
    plain aggregate; boxes are sorted rows there, and its rows, one for each
    area where a detection counts, are written once. Detections of a category
    and area are then dealt by ranges of their scores, so equal scores or one
    large category don't meet in a task; each task writes its segment as rows
    of thousands of detections with their sums, and a table with a row a
    segment carries sums across borders. A curve's precision is best where it
    reaches a hit, and only the best between two recall points counts, so
    curves are aggregates. Without detections all are 0; areas without gold
    boxes are -1.
    """
    columns = ("image_id", "category_id", "box", "x1", "y1", "x2", "y2")
    both = gold.select(*columns, F.lit(0.0).alias("score"), F.lit(0).alias("side")).unionByName(pred.select(*columns, "score", F.lit(1).alias("side")))
    # The window also deals out the images: a plain repartition over a union may be left out by Spark 4.1, and its sides' partitions then merged apart.
    order = [F.asc("category_id"), F.asc("side"), F.desc("score"), *map(F.asc, ("box", "x1", "y1", "x2", "y2"))]
    seen = F.max("side").over(Window.partitionBy("image_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = both.withColumn("seen", seen).filter("seen = 1").sortWithinPartitions(F.asc("image_id"), *order).drop("box", "seen")
    found = written(rows.mapInArrow(_matched, MATCHES), "matches")
    curve = ["category_id", "area"]
    total = found.filter("total is not null").groupBy(*curve).agg(F.sum("total").alias("total"))
    order = [F.asc("category_id"), F.asc("area"), F.desc("score"), F.asc("image_id"), F.asc("rank")]
    ranges = found.filter("total is null").drop("total").repartitionByRange(*order).withColumn(SEGMENT, F.spark_partition_id()).sortWithinPartitions(*order)
    blocks = written(ranges.mapInArrow(_blocks, BLOCKS), "blocks")
    sums = blocks.groupBy(SEGMENT, *curve).agg(*(F.sum(F.col("own")[i]).alias(f"s{i}") for i in range(SUMS)))
    earlier = Window.partitionBy(*curve).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(SEGMENT, *curve, F.array(*(F.coalesce(F.sum(f"s{i}").over(earlier), F.lit(0)) for i in range(SUMS))).alias("carried"))
    placed = blocks.join(carried, [SEGMENT, *curve]).join(total, curve).select(*curve, "total", "marks", F.zip_with("start", "carried", lambda a, b: a + b).alias("before"))
    best = written(placed.mapInArrow(_points, POINTS), "points").groupBy(*curve, "iou", "place").agg(F.max("best").alias("best"))
    # Each recall point takes the best precision at it or later: a hundred and one rows a curve.
    own = Window.partitionBy(*curve, "iou").orderBy("place")
    best = best.withColumn("best", F.max("best").over(own.rowsBetween(0, Window.unboundedFollowing))).withColumn("since", F.coalesce(F.lag("place").over(own), F.lit(-1)))
    aps = best.groupBy(*curve, "iou").agg((F.sum(F.col("best") * (F.col("place") - F.col("since"))) / len(RECALLS)).alias("ap"))
    hits = {100: 0, 1: 2 * BITS, 10: 3 * BITS}
    counts = sums.groupBy(*curve).agg(*(F.sum(f"s{k + i}").alias(f"h{most}_{i}") for most, k in hits.items() for i in range(BITS)))
    counts = counts.select(*curve, F.explode(F.array(*(F.struct(F.lit(t).alias("iou"), *(F.col(f"h{most}_{i}").alias(f"hits{most}") for most in hits)) for i, t in enumerate(IOUS)))).alias("x")).select(*curve, "x.*")
    cell = [*curve, "iou"]
    table = total.withColumn("iou", F.explode(F.array(*map(F.lit, IOUS)))).join(aps, cell, "left").join(counts, cell, "left")
    mean = lambda c, when: F.coalesce(F.avg(F.when(when, F.coalesce(c, F.lit(0.0)))), F.lit(-1.0))
    area = lambda a: F.col("area") == list(AREAS).index(a)
    numbers = [mean(F.col("ap"), area("all")).alias("ap"), *(mean(F.col("ap"), area("all") & (F.col("iou") == t)).alias(n) for n, t in (("ap50", 0.5), ("ap75", 0.75)))]
    numbers += [mean(F.col("ap"), area(a)).alias(f"ap{a[0]}") for a in ("small", "medium", "large")]
    numbers += [mean(F.col(f"hits{k}") / F.col("total"), area("all")).alias(f"ar{k}") for k in (1, 10, 100)]
    numbers += [mean(F.col("hits100") / F.col("total"), area(a)).alias(f"ar{a[0]}") for a in ("small", "medium", "large")]
    return table.agg(*numbers)
