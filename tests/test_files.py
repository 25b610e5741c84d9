"""Files in and out, model hooks and streaming."""

import glob
import gzip
import json
import os
import struct

import pytest

from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxframe.operators import dedup, inference, matching, metrics
from boxframe.plans import files
from boxframe.sources import annotations as A
from boxframe.storage import shared_path
from boxframe.streaming import evaluate as S

GOLD = {"images": [{"id": 7, "file_name": "a.png", "width": 100, "height": 200, "diagram_type": "single", "bboxes": [{"category_id": 1, "bbox": [0, 0, 50, 100]}, {"category_id": 2, "bbox": [60, 0, 20, 20]}, {"category_id": 1, "bbox": [0, 150, 50, 50]}], "reactions": [{"reactants": [0], "conditions": [1], "products": [2]}]}, {"id": 8, "file_name": "b.png", "width": 10, "height": 10, "diagram_type": "tree", "bboxes": [], "reactions": []}]}
PRED = {"reaction": [[{"reactants": [{"category": "[Mol]", "category_id": 1, "bbox": [0, 0, 0.5, 0.5]}], "conditions": [{"category": "[Txt]", "category_id": 2, "bbox": [0.6, 0, 0.8, 0.1]}], "products": [{"category": "[Mol]", "category_id": 1, "bbox": [0, 0.75, 0.5, 1]}]}], []], "file_name": ["a.png", "b.png"]}


def test_folds_and_evaluation(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"test{i}.json").write_text(json.dumps(GOLD))
        (tmp_path / f"{i}").mkdir()
        (tmp_path / f"{i}" / f"prediction_test{i}.json").write_text(json.dumps(PRED))
    images, predictions = A.read_folds(spark, str(tmp_path), str(tmp_path), splits=2)
    assert images.count() == 4 and {r.dataset for r in images.collect()} == {"test0", "test1"}
    keys = ["split", "ordinal"]
    gold, pred = A.gold_reactions(images, keys), A.pred_reactions(predictions, keys)
    assert gold.first().boxes[0].y2 == 0.5 and pred.count() == 2
    flags = matching.hits(gold, dedup.kept_reactions(pred, keys), keys)
    for mode in ("exact", "soft"):
        r = metrics.evaluate(metrics.per_image(flags, images.select(*keys, "diagram_type"), keys, mode)).first()
        assert (r.gold_hits, r.gold_total, r.pred_hits, r.pred_total, r.images, r.f1) == (2, 2, 2, 2, 4, 1.0)
    out = str(tmp_path / "out")
    A.write_json(gold.select(*keys, A.reaction_json(gold).alias("reaction")), out)
    back = json.loads(spark.read.json(out).first().reaction)
    assert back["conditions"][0]["bbox"] == [0.6, 0.0, 0.8, 0.1] and set(back) == {"reactants", "conditions", "products"}
    assert A.read_split(spark, str(tmp_path / "test0.json"), first=1).count() == 1
    assert A.missing(images, spark.createDataFrame([("x/a.png",)], "path string")).distinct().collect()[0].file_name == "b.png"


def test_lists_and_merges(spark, tmp_path):
    (tmp_path / "dois.txt").write_text("10.1/a\n\n10.1/b")
    assert [r.doi for r in A.read_articles(spark, str(tmp_path / "dois.txt")).collect()] == ["10.1/a", "10.1/b"]
    df = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "x", 0)], "idx int, p string, at int")
    assert {r.idx: r.p for r in A.merge_predictions(df, "idx", "p", ["at"]).collect()} == {1: "new", 2: "x"}


def test_model_hooks(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.png").write_bytes(bytes([i] * (i + 1)))
    pictures = A.read_pictures(spark, str(tmp_path / "*.png"))

    def load():
        return lambda contents: [[len(c), c[0], len(contents)] for c in contents]

    got = {r.path[-5]: r.tokens for r in inference.predict_tokens(pictures.coalesce(1), load, batch=2).collect()}
    assert {k: v[:2] for k, v in got.items()} == {str(i): [i + 1, i] for i in range(5)} and max(v[2] for v in got.values()) == 2
    boxes = spark.createDataFrame([(1, bytearray(b"m1")), (2, bytearray(b"t1")), (1, bytearray(b"m2")), (1, None)], "category_id int, crop binary").coalesce(1)
    done = inference.enrich(boxes, lambda crops: [(c.decode(), "") for c in crops], lambda c: [c.decode(), "w"]).collect()
    assert [(r.smiles, r.molfile, r.text) for r in done] == [("m1", None, None), (None, None, ["t1", "w"]), ("m2", None, None), (None, None, None)]
    assert inference.draw_specs(spark.createDataFrame([(0, 2)], "role int, category_id int")).first().label == "[Txt]"


def test_streaming(spark, tmp_path):
    kind = T.StructType([T.StructField(c, T.LongType()) for c in metrics.NUMBERS] + [T.StructField("at", T.TimestampType())])
    at = F.to_timestamp(F.lit("2026-01-01 00:05:00"))
    rows = spark.createDataFrame([(1, 2, 1, 1), (0, 1, 0, 3)], ", ".join(f"{c} long" for c in metrics.NUMBERS)).withColumn("at", at)
    rows.write.parquet(str(tmp_path / "in"))
    counts = S.stream_counts(spark, str(tmp_path / "in"), kind)
    for name, df, mode in (("running", S.running_scores(counts), "complete"), ("windowed", S.windowed_scores(counts), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(60)
        r = spark.table(name).first()
        assert (r.gold_hits, r.gold_total, r.precision) == (1, 3, 0.25)


def test_picture_sizes(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\x08\x02\0\0\0"
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + bytes(14) + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, 300, 200) + bytes(12)
    files = {"a.png": png, "b.jpg": jpeg, "c.gif": b"GIF89a" + struct.pack("<HH", 7, 9), "d.bmp": b"BM" + bytes(16) + struct.pack("<ii", 5, -6), "e.txt": b"text", "f.jpg": b"\xff\xd8"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in A.with_sizes(A.read_pictures(spark, str(tmp_path))).collect()}
    assert got == {"a.png": (640, 480), "b.jpg": (200, 300), "c.gif": (7, 9), "d.bmp": (5, 6), "e.txt": (None, None), "f.jpg": (None, None)}


def test_meters_take_numbers_only(spark):
    from boxframe.operators import meters

    with pytest.raises(TypeError):
        meters.running(spark.createDataFrame([("a", "x", 1)], "name string, value string, i long"), "name", "value", ["i"])


def test_many_documents_are_few_files(spark, tmp_path):
    """Hundreds of groups don't make hundreds of files, and come back whole."""
    own = "named_struct('category_id', 1, 'bbox', array(0d, 1d, 2d, 3d))"
    images = spark.range(900).selectExpr("id", "concat(id, '.png') AS file_name", "10 AS width", "20 AS height", "'x' AS diagram_type", f"array({own}) AS bboxes", "array(named_struct('reactants', array(0), 'conditions', cast(array() as array<int>), 'products', array(0))) AS reactions", "id % 3 AS split", "id div 3 AS block")
    path, by = str(tmp_path / "splits"), ["split", "block"]
    A.write_splits(images.repartition(3, "split"), path, by, "id")
    assert len(list((tmp_path / "splits").rglob("*.json"))) <= 4
    rows = A.read_split(spark, path, by=by).collect()
    assert sorted((r.split, r.block, r.ordinal, r.id) for r in rows) == sorted((i % 3, i // 3, 0, i) for i in range(900))
    A.write_predictions(images.select(*by, "id", "file_name", F.expr("array()").alias("reaction")), str(tmp_path / "said"), by, "id")
    assert len(list((tmp_path / "said").rglob("*.json"))) <= 4
    assert sorted(r.file_name for r in A.read_predictions(spark, str(tmp_path / "said"), by=by).collect()) == sorted(f"{i}.png" for i in range(900))


def test_documents_pair_up_whole(spark, tmp_path):
    """Documents of one side only, shorter lists and pictures without boxes or reactions count as if they met picture by picture; files are gzipped."""
    box = "named_struct('category_id', 1, 'bbox', array(0d, 1d, 2d, 3d))"
    own = f"if(id % 7 = 3, null, array({box}, {box}))"
    rxn = "if(id % 5 = 1, null, transform(sequence(0L, id % 3), i -> named_struct('reactants', array(0), 'conditions', if(i = 1, null, cast(array() as array<int>)), 'products', array(int(i % 2)))))"
    images = spark.range(60).selectExpr("id", "concat(id, '.png') AS file_name", "10 AS width", "20 AS height", "'x' AS diagram_type", f"{own} AS bboxes", f"if(id % 7 = 3, null, {rxn}) AS reactions", "id % 3 AS split", "id div 9 AS block")
    said = "named_struct('category', '[Mol]', 'category_id', 1, 'bbox', array(0d, 0.05d, 0.2d, 0.2d), 'score', null, 'smiles', null, 'molfile', null, 'text', null)"
    predicted = images.filter("block <> 2 and id <> 44").selectExpr("split", "block", "id", "file_name", f"if(id % 4 = 1, null, transform(sequence(0L, id % 2), i -> named_struct('reactants', array({said}), 'conditions', array(), 'products', if(id % 11 = 2, array(), array({said}))))) AS reaction")
    by, keys = ["split", "block"], ["split", "block", "ordinal"]
    paths = [str(tmp_path / n) for n in ("splits", "said")]
    A.write_splits(images.filter("block <> 4"), paths[0], by, "id")
    A.write_predictions(predicted, paths[1], by, "id")
    written = [f.name for f in tmp_path.rglob("part-*")]
    assert written and all(n.endswith(".json.gz") for n in written)
    gold, pred = A.read_split(spark, paths[0], by=by), A.read_predictions(spark, paths[1], by=by)
    want = matching.image_counts(A.gold_reactions(gold, keys), A.pred_reactions(pred, keys), gold.select(*keys).join(pred.select(*keys).distinct(), keys), keys, "exact", 9)
    ready = lambda c: F.transform(c, lambda b: matching.prepared(b))
    got = A.paired(spark, *paths, by).select(*keys, matching.counted(ready("gold"), ready("pred"), 9).alias("h")).select(*keys, "h.*")
    want, got = (sorted(map(tuple, df.select(*keys, *metrics.NUMBERS).collect())) for df in (want, got))
    assert got == want and 20 < len(got) < 55 and len({r[3:] for r in got}) > 5


@pytest.mark.parametrize("name", ["_splits", "_predicted"])
def test_documents_are_shuffled_once_as_narrow_rows(spark, sf_dir, name):
    """Boxes are dealt out by document before they are numbered, and not again when they're collected."""
    made = getattr(files, name)(spark, sf_dir)
    df = made if name == "_splits" else files._documents(spark, sf_dir, made)
    assert df._jdf.queryExecution().sparkPlan().toString().count("Window") == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange for the pictures, one for the boxes.
    assert plan.count("Exchange ") == 2


def test_written_files_are_small(spark, sf_dir):
    """Files of a scoring take a fraction of the JSON that they hold."""
    old = set(_written(spark))
    assert files.eval_files(spark, sf_dir).count() == 1
    new = [p for p in _written(spark) if p not in old and "/scores-" not in p]
    assert new and all(p.endswith(".json.gz") for p in new)
    assert 4 * sum(os.path.getsize(p) for p in new) < sum(len(gzip.open(p).read()) for p in new)


def _written(spark):
    return glob.glob(os.path.dirname(shared_path(spark, "x")).removeprefix("file:") + "/**/part-*.json*", recursive=True)
