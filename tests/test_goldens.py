"""Small reactions, token streams and curves with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from boxframe.functions import geometry as G
from boxframe.functions import grammar, tokens, vectors
from boxframe.operators import augment, coco, dedup, matching, meters, metrics
from boxframe.schemas import BOX

KIND = f"image_id long, rxn_id long, boxes array<{BOX}>"


def box(role, x, y=0.0, w=0.1, h=0.1, cat=1, idx=0):
    return (role, idx, cat, x, y, x + w, y + h)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def arr(*boxes):
    """A literal array of boxes."""
    names = ("role", "idx", "category_id")
    one = lambda b: F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip(names, b)), *(F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), b[3:])))
    return F.array(*map(one, boxes)) if boxes else F.expr(f"cast(array() as array<{BOX}>)")


def test_match_at_the_threshold_and_ties(spark):
    wide, half = box(0, 0.0, w=1.0, h=1.0), box(0, 0.0, w=0.5, h=1.0)
    m = value(spark, matching.box_match(arr(wide), arr(half, half)))
    assert m[0].place == 0 and m[0].iou == 0.5
    assert value(spark, matching.box_match(arr(wide), arr(box(0, 0.0, w=0.49, h=1.0))))[0].place == -1
    assert value(spark, matching.box_match(arr(wide), arr()))[0].place == -1
    assert value(spark, matching.box_match(arr(wide), arr(box(0, 0.0, w=1.0, h=1.0, cat=2)), match_category=True))[0].place == -1


def test_two_boxes_may_match_one_but_arent_equal(spark):
    a, b = box(0, 0.0), box(0, 0.01)
    assert [m.place for m in value(spark, matching.box_match(arr(a, b), arr(a, box(0, 0.8))))] == [0, 0]
    assert value(spark, matching.compare(arr(a, b), arr(a, box(0, 0.8)))) is False
    assert value(spark, matching.compare(arr(a, box(2, 0.5)), arr(a, box(2, 0.5)))) is True
    assert value(spark, matching.compare(arr(a, box(2, 0.5)), arr(a, box(1, 0.5)))) is False
    assert value(spark, matching.compare(arr(), arr())) is False


def test_molecules_only_falls_back_but_not_for_conditions(spark):
    r = arr(box(0, 0.0, cat=2), box(1, 0.3, cat=2), box(2, 0.6, cat=1), box(2, 0.8, cat=3))
    sizes = [len(value(spark, matching.role_places(r, role, True))) for role in range(3)]
    assert sizes == [1, 0, 1]
    other = arr(box(0, 0.0, cat=2), box(2, 0.6, cat=1))
    assert value(spark, matching.compare(r, other, mol_only=True)) is True and value(spark, matching.compare(r, other)) is False
    moved = arr(box(0, 0.0), box(1, 0.3), box(2, 0.6)), arr(box(0, 0.3), box(1, 0.0), box(2, 0.6))
    assert value(spark, matching.compare(*moved)) is False and value(spark, matching.compare(*moved, merge_condition=True)) is True


def test_a_box_out_of_its_role_still_takes_the_match(spark):
    """The right reaction's place 1 is out of its role, yet matches better than place 0."""
    left, right = arr(box(0, 0.0), box(2, 0.5)), arr(box(0, 0.02), box(0, 0.0), box(2, 0.5))
    kept = F.array(F.lit(0), F.lit(2)).cast("array<bigint>")
    assert value(spark, matching.compare(left, right, right_kept=kept)) is False


def test_box_duplicates(spark):
    """Products come before conditions; a box near one that went stays; nearly empty ones go."""
    r = arr(box(0, 0.0, w=1.0, h=1.0), box(1, 0.0, w=0.65, h=1.0), box(2, 0.35, w=0.65, h=1.0), box(2, 0.8, w=0.005), box(0, 0.0, y=2.0))
    assert value(spark, dedup.kept_boxes(r)) == [0, 4]
    chain = arr(box(0, 0.0, w=1.0, h=1.0), box(0, 0.0, w=0.65, h=1.0), box(0, 0.0, w=0.42, h=1.0))
    assert value(spark, dedup.kept_boxes(chain)) == [0, 2]
    assert value(spark, dedup.all_earlier(chain)) == [0]


def test_reaction_duplicates(spark):
    whole, twin, half = [box(0, 0.0), box(2, 0.5)], [box(0, 0.01), box(2, 0.5)], [box(0, 0.0)]
    df = spark.createDataFrame([(1, 0, half), (1, 1, whole), (1, 2, twin), (2, 0, twin), (1, 3, [box(0, 0.0), box(2, 0.9)])], KIND)
    kept = sorted((r.image_id, r.rxn_id) for r in dedup.kept_reactions(df, ["image_id"]).collect())
    assert kept == [(1, 1), (1, 3), (2, 0)]
    again = dedup.kept_reactions(dedup.kept_reactions(df, ["image_id"]), ["image_id"])
    assert sorted((r.image_id, r.rxn_id) for r in again.collect()) == kept
    done = dedup.in_roles(dedup.postprocess(df, ["image_id"])).collect()
    assert sorted((r.image_id, r.rxn_id, len(r.boxes)) for r in done) == [(1, 1, 2), (1, 3, 2), (2, 0, 2)]


def test_hits_and_scores(spark):
    """Two gold twins are hit by one prediction; an image without predictions counts its gold."""
    whole = [box(0, 0.0), box(2, 0.5)]
    gold = spark.createDataFrame([(1, 0, whole), (1, 1, whole), (2, 0, whole)], KIND)
    pred = spark.createDataFrame([(1, 0, whole), (1, 1, [box(0, 0.3), box(2, 0.8)])], KIND)
    images = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "image_id long, diagram_type string")
    counts = metrics.per_image(matching.hits(gold, pred, ["image_id"]), images, ["image_id"], "exact")
    direct = matching.image_counts(gold, pred, images, ["image_id"])
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, counts.select(direct.columns).collect()))
    r = metrics.evaluate(counts).first()
    assert (r.gold_hits, r.gold_total, r.pred_hits, r.pred_total, r.images) == (2, 3, 1, 2, 3)
    assert r.precision == 0.5 and r.recall == pytest.approx(2 / 3) and r.f1 == pytest.approx(2 * 0.5 * (2 / 3) / (0.5 + 2 / 3))
    sizes = {r.size: r.images for r in metrics.summarize(counts).collect()}
    assert sizes == {None: 3, 0: 1, 1: 1, 2: 1}
    assert metrics.evaluate(counts.limit(0)).first().f1 == 0


V = tokens.Vocabulary.of(pix2seq=True)
NAMES = V.ids


def seq(*words):
    return F.array(*(F.lit(NAMES[w] if isinstance(w, str) else w).cast("long") for w in words))


GOOD = (10, 20, 30, 40, "[Mol]")


def parsed(spark, *words):
    return [tuple(len(r[n]) for n in ("reactants", "conditions", "products")) for r in value(spark, tokens.parse_reactions(V, seq(*words)))]


def test_parsing_of_odd_streams(spark):
    whole = (*GOOD, "[Rct]", "[Cnd]", *GOOD, "[Prd]")
    assert parsed(spark, "<sos>", *whole, "[Rxn]", "<eos>") == [(1, 0, 1)]
    assert parsed(spark, *whole, "[Nos]", *whole, "[Rxn]") == [(1, 0, 1), (1, 0, 1)]
    assert parsed(spark, *whole) == [] and parsed(spark, "<eos>", *whole, "[Rxn]") == []
    assert parsed(spark, *GOOD, "[Rct]", "[Cnd]", "[Prd]", "[Rxn]") == []
    assert parsed(spark, 5, *whole, "[Rxn]") == [(1, 0, 1)]
    assert parsed(spark, 30, 20, 10, 40, "[Mol]", *whole, "[Rxn]") == [(1, 0, 1)]
    assert parsed(spark, *whole, *GOOD, "[Rxn]") == [(1, 0, 1)]
    assert parsed(spark, 10, 20, 30, 40, "[Nos]", *whole, "[Rxn]") == [(1, 0, 1)]
    assert value(spark, tokens.parse_reactions(V, F.expr("cast(array() as array<bigint>)"))) == []


def test_vocabularies():
    plain = tokens.Vocabulary.of(pix2seq=False)
    assert (plain["[Rxn]"], plain["[Nos]"], plain.first, plain["<eos>"]) == (5, 13, 14, 2)
    assert (V["<pad>"], V["[Sup]"], V["<eos>"], V.size) == (2001, 2013, 2092, 2094)


def test_quantisation(spark):
    v = tokens.Vocabulary(bins=6, sep_xy=False, pix2seq=False)
    assert [value(spark, v.x_token(F.lit(x))) - v.first for x in (0.1, 0.3, 0.5, -0.0005, 1.0005)] == [0, 2, 2, 0, 5]
    with pytest.raises(Exception, match="outside"):
        value(spark, v.x_token(F.lit(1.002)))
    sep = tokens.Vocabulary.of(pix2seq=False)
    y = sep.y_token(F.lit(1.0))
    assert value(spark, sep.y_value(y, 0.5)) == 2.0 and value(spark, sep.y_value(y, 0.5, multiply=True)) == 0.5 and value(spark, sep.y_value(F.lit(20))) == -1


def test_encoding(spark):
    assert value(spark, tokens.box_tokens(V, G.Box(*map(F.lit, (0.5, 0.0, 0.5, 1.0))), F.lit(1))) == []
    assert value(spark, tokens.box_tokens(V, G.Box(*map(F.lit, (0.0, 0.0, 1.0, 1.0))), F.lit(9)))[-1] == V["[Nos]"]
    r = arr(box(0, 0.0), box(0, 0.5, w=0.0), box(2, 0.5))
    said = value(spark, tokens.reaction_tokens(V, r))
    assert len(said) == 14 and said[5] == V["[Rct]"] and said[6] == V["[Cnd]"] and said[-2:] == [V["[Prd]"], V["[Rxn]"]]
    assert value(spark, tokens.reaction_tokens(V, arr(box(0, 0.0, w=0.0), box(2, 0.5)))) == []
    both = tokens.sequence(V, F.array(seq(1, 2)), F.array(seq(3, 4, 5)))
    assert value(spark, both[0]) == [V["<sos>"], 1, 2, 3, 4, 5, V["<eos>"]]
    assert value(spark, both[1]) == [V["<sos>"], 1, 2, V["<pad>"], V["<pad>"], V["[Nos]"], V["<eos>"]]


def test_round_trip_error(spark):
    b = G.Box(*map(F.lit, (0.1234567, 0.2, 0.7777777, 0.9)))
    back = value(spark, tokens.box_of(V, tokens.box_tokens(V, b, F.lit(3))))
    assert back.category_id == 3 and abs(back.x1 - 0.1234567) <= 0.5 / 1999 and abs(back.x2 - 0.7777777) <= 0.5 / 1999


def test_grammar(spark):
    words = (*GOOD, "[Rct]", "[Cnd]", *GOOD, "[Prd]", "[Rxn]", "<eos>")
    said = value(spark, grammar.states(V, seq(*words)))
    assert said == ["Rct,x1", "Rct,y1", "Rct,x2", "Rct,y2", "Rct,c", "Rct,e", "Cnd,e", "Prd,x1", "Prd,y1", "Prd,x2", "Prd,y2", "Prd,c", "Prd,e", "Rxn,e", "EOS,e"]
    count = lambda s: sum(not x for x in value(spark, grammar.output_mask(V, F.lit(s))))
    assert [count(s) for s in ("Rct,y2", "Rct,c", "Cnd,e", "Prd,e", "Rxn,e", "Rct,x1")] == [4, 2001, 2000, 2, 2001, 2000]


def test_losses_and_decoding(spark):
    logits = F.array(*map(F.lit, (1.0, 3.0, 3.0, -50000.0)))
    assert value(spark, vectors.argmax(logits)) == 1
    assert value(spark, vectors.greedy(logits, 1)).token == 0
    assert sum(__import__("math").exp(x) for x in value(spark, vectors.log_softmax(logits))) == pytest.approx(1)
    assert value(spark, vectors.end_length(seq(5, 6, 7), 9)) == 0 and value(spark, vectors.end_length(seq(5, 9, 9), 9)) == 1
    assert value(spark, vectors.sampled(logits, F.lit(1), temperature=0)) == 1 and value(spark, vectors.sampled(logits, F.lit(3), 1.0, 2)) in (1, 2)
    assert value(spark, vectors.smoothed_kl(vectors.log_softmax(logits), F.lit(0), 0.1, 0)) == 0
    drawn = spark.range(3000).select(vectors.sampled(F.array(F.lit(0.0), F.lit(1.0986122886681098)), F.col("id")).alias("t")).agg(F.avg("t")).first()[0]
    assert abs(drawn - 0.75) < 0.03


def test_geometry_properties(spark):
    box_ = G.Box(*map(F.lit, (0.1, 0.2, 0.4, 0.9)))
    back = G.hflip(G.hflip(box_, F.lit(1.0)), F.lit(1.0))
    turned, w, h = box_, F.lit(1.0), F.lit(2.0)
    for _ in range(4):
        turned, w, h = G.rotate90(turned, w), h, w
    for b in (back, turned):
        assert [value(spark, c) for c in b] == pytest.approx([0.1, 0.2, 0.4, 0.9])
    assert value(spark, G.iou(box_, box_)) == pytest.approx(1) and value(spark, G.iou(box_, G.Box(*map(F.lit, (0.5, 0.5, 0.6, 0.6))))) == 0
    assert [value(spark, c) for c in G.crop_rectangle(G.Box(*map(F.lit, (-0.1, 0.25, 0.999, 1.5))), F.lit(10), F.lit(10))] == [0, 2, 9, 10]
    assert [value(spark, c) for c in G.crop(box_, F.lit(0.5), F.lit(0.0), F.lit(0.2), F.lit(1.0))] == pytest.approx([0, 0.2, 0, 0.9])


def test_seeded_augmentation(spark):
    rows = spark.range(2000).select("id", F.array(*map(F.lit, range(5))).alias("a"))
    got = rows.select(augment.shuffled(F.col("a"), 1, F.col("id")).alias("s"), augment.perturbed(F.array(F.slice("a", 1, 2), F.slice("a", 3, 1), F.slice("a", 4, 2)), F.lit(9), 2, F.col("id")).alias("p"), *augment.random_box(F.lit(4.0), F.lit(3.0), 3, F.col("id")).named(), augment.jitter(G.Box(*map(F.lit, (1.0, 1.0, 50.0, 60.0))), F.lit(100.0), F.lit(80.0), 4, keys=(F.col("id"),))[0].x2.alias("jx")).collect()
    assert all(sorted(r.s) == list(range(5)) for r in got) and len({tuple(r.s) for r in got}) == 120
    # Added, taken out or moved: never the same, and a reactant and a product stay.
    assert {sum(map(len, r.p)) for r in got} == {4, 5, 6} and all(list(map(list, r.p)) != [[0, 1], [2], [3, 4]] and r.p[0] and r.p[2] for r in got)
    assert {tuple(map(len, r.p)) for r in got} == {(3, 1, 2), (2, 2, 2), (2, 1, 3), (1, 1, 2), (2, 0, 2), (2, 1, 1), (1, 2, 2), (1, 1, 3), (3, 0, 2), (2, 0, 3), (3, 1, 1), (2, 2, 1)}
    least = rows.select(augment.perturbed(F.array(F.slice("a", 1, 1), F.slice("a", 1, 0), F.slice("a", 4, 1)), F.lit(9), 2, F.col("id")).alias("p")).collect()
    assert all(sum(map(len, r.p)) == 3 for r in least)
    assert all(0 <= r.x1 <= r.x2 <= 4 and 0 <= r.y1 <= r.y2 <= 3 for r in got)
    assert all(0 <= r.jx <= 1333 for r in got)
    flips = rows.select((augment.uniform(7, F.col("id")) < 0.5).cast("int").alias("f")).agg(F.avg("f")).first()[0]
    assert abs(flips - 0.5) < 0.05
    made = augment.composites(spark.range(500).select(F.col("id").alias("idx")), 5, F.lit(500), 9)
    assert abs(made.count() / 500 - 3.5) < 0.2 and made.filter("slot > 0 and source = idx").count() == 0


def test_crop_regions_cut_no_reaction(spark):
    spans = spark.createDataFrame([(1, 100.0, 300.0), (1, 250.0, 400.0), (1, 600.0, 700.0), (2, 0.0, 1000.0)], "k long, low double, high double")
    free = sorted((r.k, r.start, r.stop) for r in augment.free_spans(spans, ["k"], "low", "high", F.lit(1000)).collect())
    assert free == [(1, 0, 100), (1, 400, 600), (1, 700, 1000), (2, 0, 0), (2, 1000, 1000)]
    for seed in range(5):
        got = {r.k: (r.low, r.high) for r in augment.crop_region(augment.free_spans(spans, ["k"], "low", "high", F.lit(1000)), ["k"], seed).collect()}
        assert got[2] == (0, 1000) and all(not 100 < x < 400 and not 600 < x < 700 for x in got[1])


def test_meters(spark):
    df = spark.range(30).select(F.col("id").alias("i"), F.lit("m").alias("name"), F.col("id").cast("double").alias("v"))
    last = meters.running(df, "name", "v", ["i"]).orderBy(F.desc("i")).first()
    assert (last.median, last.avg, last.max, last.value_now, last.global_avg) == (19.0, 19.5, 29.0, 29.0, 14.5)
    assert [r.i for r in meters.logged(df.drop("i").withColumn("t", F.col("v")), "name", ["t"], 10, "v").orderBy("i").collect()] == [0, 10, 20, 29]


def test_coco(spark):
    kind = "image_id long, category_id long, box long, x1 double, y1 double, x2 double, y2 double"
    gold = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 50.0, 50.0), (1, 1, 1, 200.0, 0.0, 250.0, 50.0), (9, 1, 0, 0.0, 0.0, 50.0, 50.0)], kind)
    perfect = gold.filter("image_id = 1").withColumn("score", F.lit(0.9))
    r = coco.evaluate(gold, perfect).first()
    assert r.ap == pytest.approx(1) and r.ar100 == 1 and r.ar1 == 0.5 and r.aps == -1 and r.apm == pytest.approx(1)
    wrong = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 50.0, 50.0, 0.9), (1, 1, 1, 400.0, 400.0, 450.0, 450.0, 0.95)], kind + ", score double")
    r = coco.evaluate(gold, wrong).first()
    assert r.ap50 == pytest.approx(51 / 101 * 0.5) and r.ar100 == 0.5
