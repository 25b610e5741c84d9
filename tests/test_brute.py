"""Random inputs against plain, step-by-step versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from boxframe.functions import tokens
from boxframe.operators import coco, decoding, dedup, matching
from boxframe.schemas import BOX

KIND = f"image_id long, rxn_id long, boxes array<{BOX}>"


def iou(a, b):
    w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
    if w < 0 or h < 0:
        return 0.0
    union = (a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - w * h
    return w * h / union if union else 0.0


def looked_at(boxes, role, kept, mol):
    places = [i for i, b in enumerate(boxes) if b[0] == role and (kept is None or i in kept)]
    mols = [i for i in places if boxes[i][2] == 1]
    return places if not mol or (role != 1 and not mols) else mols


def same(left, right, mol=False, merge=False, lk=None, rk=None):
    ls, rs = ([looked_at(x, r, k, mol) for r in range(3)] for x, k in ((left, lk), (right, rk)))
    if merge:
        ls, rs = ([x[0] + x[1], x[2]] for x in (ls, rs))
    if sum(map(len, ls)) != sum(map(len, rs)) or not sum(map(len, ls)):
        return False
    for mine, theirs in zip(ls, rs):
        found = []
        for i in mine:
            scores = [iou(left[i], b) for b in right]
            found.append(scores.index(max(scores)) if max(scores) >= 0.5 else -1)
        if sorted(found) != sorted(theirs):
            return False
    return True


def kept_boxes(boxes):
    stay = []
    for turn in (0, 2, 1):
        for i, b in enumerate(boxes):
            if b[0] == turn and abs(b[5] - b[3]) > 0.01 and abs(b[6] - b[4]) > 0.01 and not any(iou(boxes[k], b) > 0.6 for k in stay):
                stay.append(i)
    return sorted(stay)


def kept_reactions(rxns):
    """rxns: (rxn_id, boxes, kept) in order."""
    stay = []
    for r in rxns:
        roles = {b[0] for i, b in enumerate(r[1]) if r[2] is None or i in r[2]}
        if {0, 2} <= roles and not any(same(s[1], r[1], lk=s[2], rk=r[2]) for s in stay):
            stay.append(r)
    return stay


def made(rng):
    spots = [(0.0, 0.0, 0.3, 0.3), (0.02, 0.0, 0.32, 0.3), (0.1, 0.0, 0.4, 0.3), (0.5, 0.5, 0.9, 0.9), (0.5, 0.52, 0.9, 0.92), (0.6, 0.1, 0.605, 0.4)]
    return sorted((rng.choice([0, 0, 1, 2, 2]), i, rng.choice([1, 1, 2, 3]), *rng.choice(spots)) for i in range(rng.randrange(1, 6)))


def test_comparison_and_duplicates(spark):
    rng = random.Random(11)
    rows = [(i, r, made(rng)) for i in range(60) for r in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, KIND)
    pairs = df.alias("a").join(df.alias("b"), "image_id").select("image_id", F.col("a.rxn_id").alias("l"), F.col("b.rxn_id").alias("r"), matching.compare(F.col("a.boxes"), F.col("b.boxes")).alias("exact"), matching.compare(F.col("a.boxes"), F.col("b.boxes"), mol_only=True, merge_condition=True).alias("soft"))
    boxes = {(i, r): b for i, r, b in rows}
    seen = set()
    for p in pairs.collect():
        left, right = boxes[p.image_id, p.l], boxes[p.image_id, p.r]
        assert (p.exact, p.soft) == (same(left, right), same(left, right, True, True))
        seen.add((p.exact, p.soft))
    assert len(seen) >= 3
    assert {(r.image_id, r.rxn_id): r.k for r in df.select("image_id", "rxn_id", dedup.kept_boxes(F.col("boxes")).alias("k")).collect()} == {k: kept_boxes(b) for k, b in boxes.items()}
    wanted = set()
    for i in range(60):
        once = kept_reactions([(r, b, None) for (j, r), b in sorted(boxes.items()) if j == i])
        wanted |= {(i, r, tuple(k)) for r, _, k in kept_reactions([(r, b, kept_boxes(b)) for r, b, _ in once])}
    assert {(r.image_id, r.rxn_id, tuple(r.kept)) for r in dedup.postprocess(df, ["image_id"]).collect()} == wanted


def parse(v, ids):
    """The rules of reading, one token at a time."""
    names = {i: n for n, i in v.ids.items()}
    numbers = {v["[Mol]"]: 1, v["[Txt]"]: 2, v["[Idt]"]: 3, v["[Sup]"]: 4}
    out, now, role, i = [], ([], [], []), 0, 0
    while i < len(ids):
        name = names.get(ids[i])
        if name == "<eos>":
            break
        if name in ("[Rxn]", "[Nos]"):
            if now[0] and now[2]:
                out.append(now)
            now, role = ([], [], []), 0
        elif name in ("[Rct]", "[Cnd]", "[Prd]"):
            role = {"[Rct]": 1, "[Cnd]": 2, "[Prd]": None}[name]
        elif name is None and role is not None and i + 5 <= len(ids):
            five = ids[i : i + 5]
            if all(0 <= x < 2000 for x in five[:4]) and five[0] < five[2] and five[1] < five[3] and five[4] in numbers:
                now[role].append((*(x / 1999 for x in five[:4]), numbers[five[4]]))
                i += 4
        i += 1
    return out


def test_reading_random_streams(spark):
    v, rng = tokens.Vocabulary.of(pix2seq=True), random.Random(5)
    special = [v[n] for n in tokens.SPECIAL]

    def box():
        x, y = rng.randrange(1000), rng.randrange(1000)
        return [x, y, x + rng.choice([-3, 0, 5, 5, 900, 900]), y + rng.choice([0, 7, 7, 900, 900]), rng.choice(special[8:])]

    def stream():
        """Whole reactions, some with tokens put in, taken out or changed."""
        out = [v["<sos>"]]
        for _ in range(rng.randrange(1, 5)):
            part = []
            for closer in ("[Rct]", "[Cnd]", "[Prd]"):
                for _ in range(rng.randrange(3)):
                    part += box()
                part.append(v[closer])
            part.append(v[rng.choice(["[Rxn]", "[Rxn]", "[Nos]"])])
            for _ in range(rng.choice([0, 0, 1, 3])):
                at = rng.randrange(len(part))
                part[at : at + rng.randrange(2)] = [rng.choice([rng.randrange(2100), rng.choice(special)])] * rng.randrange(2)
            out += part
        return out + [v["<eos>"]] * rng.randrange(2) + box() * rng.randrange(2)

    streams = [stream() for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(streams)), "i long, t array<bigint>").select("i", tokens.parse_reactions(v, F.col("t")).alias("r"))
    found = 0
    for r in df.collect():
        wanted = parse(v, streams[r.i])
        got = [tuple([(b.x1, b.y1, b.x2, b.y2, b.category_id) for b in x] for x in (q.reactants, q.conditions, q.products)) for q in r.r]
        assert got == wanted
        found += len(wanted)
    assert found > 50


def test_beam_search(spark):
    rng = np.random.default_rng(3)
    logits = rng.normal(size=(20, 6, 5))
    logp = logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))
    df = spark.createDataFrame([(r, s, logp[r, s].tolist()) for r in range(20) for s in range(6)], "run long, step long, logp array<double>")
    got = {r.run: (list(r.tokens), r.score) for r in decoding.beam_search(df, "run", beams=3, n_best=1, eos=0, min_length=2, max_length=6).collect()}
    for r in range(20):
        beams, ended = [(0.0, [])], []
        for s in range(6):
            grown = sorted((-(p + (-1e20 if t == 0 and s + 1 < 2 else logp[r, s, t])) / (s + 1), p + (-1e20 if t == 0 and s + 1 < 2 else logp[r, s, t]), [*q, t]) for p, q in beams for t in range(5))[:3]
            over = [g for g in grown if g[2][-1] == 0 or s == 5]
            ended += over
            beams = [(g[1], g[2]) for g in grown if g not in over]
            if grown[0] in over and ended or not beams:
                break
        best = min(ended)
        assert got[r][0] == best[2] and abs(got[r][1] + best[0]) < 1e-12


def test_average_precision_of_random_boxes(spark):
    """AP50 and recall of one category against a direct walk down the ranking."""
    rng = random.Random(8)
    kind = "image_id long, category_id long, box long, x1 double, y1 double, x2 double, y2 double"
    gold, pred = [], []
    for i in range(25):
        for k in range(rng.randrange(1, 5)):
            x, y = rng.random() * 300, rng.random() * 300
            gold.append((i, 1, k, x, y, x + 60, y + 60))
            if rng.random() < 0.8:
                pred.append((i, 1, k, x + rng.random() * 30, y, x + 60 + rng.random() * 10, y + 60, rng.random()))
        pred.append((i, 1, 9, 500.0, 500.0, 560.0, 560.0, rng.random()))
    r = coco.evaluate(spark.createDataFrame(gold, kind), spark.createDataFrame(pred, kind + ", score double")).first()
    used, hits = set(), []
    for p in sorted(pred, key=lambda p: -p[7]):
        best = max(((iou((0, 0, 0, *g[3:]), (0, 0, 0, *p[3:7])), g[2]) for g in gold if g[0] == p[0] and (g[0], g[2]) not in used), default=(0, None))
        hits.append(best[0] >= 0.5)
        if hits[-1]:
            used.add((p[0], best[1]))
    tp = np.cumsum(hits)
    precision, recall = tp / np.arange(1, len(hits) + 1), tp / len(gold)
    envelope = [max(precision[recall >= t - 1e-12], default=0.0) for t in np.arange(101) / 100]
    assert abs(r.ap50 - np.mean(envelope)) < 1e-9 and 0 < r.ap <= r.ap50
