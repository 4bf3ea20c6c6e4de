"""Parallel greedy operators against sequential loops on seeded random inputs."""

import random

from pyspark.sql import functions as F

from parcelworks.functions.bbox import Box
from parcelworks.operators import greedy as G
from parcelworks.operators.detections import bbox_iou_join


def boxes(seed, n=120, groups=2):
    rnd, out = random.Random(seed), []
    for i in range(n):
        side = rnd.choice([3, 10, 40])
        x, y = rnd.randint(0, 60), rnd.randint(0, 60)
        w, h = side + rnd.randint(0, side), side + rnd.randint(0, side)
        out.append((i, rnd.randrange(groups), float(x), float(y), float(x + w), float(y + h), rnd.randint(0, 20) / 20))
    copies = [(n + j, *out[rnd.randrange(8)][1:6], rnd.randint(0, 20) / 20) for j in range(60)]  # a pile of copies
    flat = [(n + 60 + j, 0, 5.0, 5.0, 5.0, 9.0, 0.5) for j in range(3)]
    return out + copies + flat


SCHEMA = "det_id bigint, image_id int, x1 double, y1 double, x2 double, y2 double, score double"


def area(b):
    return (b[4] - b[2]) * (b[5] - b[3])


def common(a, b):
    return max(0.0, min(a[4], b[4]) - max(a[2], b[2])) * max(0.0, min(a[5], b[5]) - max(a[3], b[3]))


def iou(a, b):
    c = common(a, b)
    return c / (area(a) + area(b) - c) if c > 0 else 0.0


def sequential(items, priority, limit):
    kept = []
    for b in sorted(items, key=lambda b: (-priority(b), b[0])):
        if all(k[1] != b[1] or iou(k, b) < limit for k in kept):
            kept.append(b)
    return {b[0] for b in kept}


def test_suppress_boxes_by_area_and_score(spark):
    for seed, limit, top in ((1, 0.5, 16), (2, 0.35, 2)):
        items = boxes(seed)
        df = spark.createDataFrame(items, SCHEMA)
        for column, priority in ((Box.of().area, area), (F.col("score"), lambda b: b[6])):
            found = {r[0] for r in G.suppress_boxes(df, ["image_id"], "det_id", column, limit, top=top).collect()}
            assert found == sequential(items, priority, limit)


def test_iou_join_finds_each_pair_once(spark):
    items = boxes(5)
    found = [(r.id_a, r.id_b) for r in bbox_iou_join(spark.createDataFrame(items, SCHEMA), ["image_id"], "det_id", 0.15).collect()]
    want = {(a[0], b[0]) for a in items for b in items if a[0] < b[0] and a[1] == b[1] and iou(a, b) >= 0.15}
    assert len(found) == len(set(found)) and set(found) == want


def test_suppress_edges(spark):
    rnd = random.Random(9)
    nodes = list(range(150))
    edges = {tuple(sorted(rnd.sample(nodes, 2))) for _ in range(400)}  # smaller node has priority
    kept = []
    for n in nodes:
        if not any((k, n) in edges for k in kept):
            kept.append(n)
    df = spark.createDataFrame([(n,) for n in nodes], "id bigint")
    e = spark.createDataFrame(list(edges), "winner bigint, loser bigint")
    assert {r[0] for r in G.suppress_edges(df, "id", e).collect()} == set(kept)


def candidates(seed, n=60):
    rnd = random.Random(seed)
    rows = []
    for b in boxes(seed, n, 2)[:n]:
        rows.append((b[1], b[0], *b[2:6], b[6], area(b), rnd.random(), rnd.random(), rnd.random()))
    return rows


def test_diverse_select(spark):
    rows = candidates(4)
    df = spark.createDataFrame(rows, "image_id int, key bigint, x1 double, y1 double, x2 double, y2 double, score double, area double, base double, area_score double, center_distance double")
    found = {(r.image_id, r.key, r.turn) for r in G.diverse_select(df, "image_id", 5).collect()}
    want = set()
    box = lambda r: (0, 0, *r[2:6])
    for image in {r[0] for r in rows}:
        chosen, left = [], [r for r in rows if r[0] == image]
        for turn in range(5):
            best = None
            for r in left:
                overlaps = [(common(box(r), box(c)), c) for c in chosen]
                if any(k > 0 and (iou(box(r), box(c)) >= 0.35 or k / max(1, area(box(r))) >= 0.6 or k / max(1, area(box(c))) >= 0.6) for k, c in overlaps):
                    continue
                worst = max([iou(box(r), box(c)) for c in chosen], default=0.0)
                key = (r[8] - 0.55 * worst, r[8], r[6], r[7], -r[1])
                if best is None or key > best[0]:
                    best = (key, r)
            if best is None:
                break
            chosen.append(best[1])
            left.remove(best[1])
            want.add((image, best[1][1], turn))
    assert found == want


def test_spatially_diverse_select(spark):
    rows = candidates(6)
    df = spark.createDataFrame(rows, "image_id int, key bigint, x1 double, y1 double, x2 double, y2 double, score double, area double, base double, area_score double, center_distance double")
    found = {(r.image_id, r.key, r.turn) for r in G.spatially_diverse_select(df, "image_id", 5, 140.0, 140.0).collect()}
    want, diagonal = set(), (2 * 140.0**2) ** 0.5
    box = lambda r: (0, 0, *r[2:6])
    mid = lambda b: ((b[2] + b[4]) / 2, (b[3] + b[5]) / 2)
    for image in {r[0] for r in rows}:
        chosen, left = [], [r for r in rows if r[0] == image]
        for turn in range(5):
            left = [r for r in left if not any(iou(box(r), box(c)) >= 0.75 or common(box(r), box(c)) / min(max(1, area(box(r))), max(1, area(box(c)))) >= 0.85 for c in chosen)]
            outer = turn % 3 == 2
            fits = [r for r in left if (r[10] > 0.6) == outer] or left
            best = None
            for r in fits:
                near = min([1.0] + [((mid(box(r))[0] - mid(box(c))[0]) ** 2 + (mid(box(r))[1] - mid(box(c))[1]) ** 2) ** 0.5 / diagonal for c in chosen])
                worst = max([iou(box(r), box(c)) for c in chosen], default=0.0)
                suits = r[10] if outer else 1 - r[10]
                key = (0.1 * r[6] + 0.15 * r[9] + 0.55 * near + 0.2 * suits - 0.3 * worst, near, r[7], r[6], -r[1])
                if best is None or key > best[0]:
                    best = (key, r)
            if best is None:
                break
            chosen.append(best[1])
            left.remove(best[1])
            want.add((image, best[1][1], turn))
    assert found == want


def test_group_proposals_joins_neighbours_and_pads(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 12.0, 0.0, 20.0, 10.0), (1, 3, 80.0, 80.0, 90.0, 90.0), (2, 4, 0.0, 0.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "image_id int, key bigint, x1 double, y1 double, x2 double, y2 double")
    out = {(r.image_id, r.ids): (r.x1, r.y1, r.x2, r.y2) for r in G.group_proposals(df, "image_id", 100.0, 100.0).collect()}
    assert out == {(1, "1,2"): (0.0, 0.0, 28.0, 18.0), (1, "3"): (72.0, 72.0, 98.0, 98.0), (2, "4"): (0.0, 0.0, 13.0, 13.0)}


def test_greedy_match(spark):
    rnd = random.Random(12)
    pairs = [(p, 100 + t, round(rnd.uniform(0.5, 1), 3)) for p in range(30) for t in range(30) if rnd.random() < 0.2]
    score = {p: rnd.random() for p in range(30)}
    taken, want = set(), set()
    for p in sorted(score, key=lambda p: -score[p]):
        options = [(i, -t, t) for q, t, i in pairs if q == p and t not in taken]
        if options:
            t = max(options)[2]
            taken.add(t)
            want.add((p, t))
    df = spark.createDataFrame([(p, t, i, score[p]) for p, t, i in pairs], "pred bigint, truth bigint, iou double, rank double")
    assert {(r.pred, r.truth) for r in G.greedy_match(df).collect()} == want


def test_object_metrics_on_a_perfect_match(spark):
    pairs = spark.createDataFrame([(1, 10, 0.9), (2, 11, 0.8)], "pred bigint, truth bigint, iou double")
    preds = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.1)], "pred bigint, score double")
    truths = spark.createDataFrame([(10,), (11,)], "truth bigint")
    row = G.object_metrics(pairs, preds, truths).first()
    assert (row.tp, row.recall, row.average_precision) == (2, 1.0, 1.0) and abs(row.precision - 2 / 3) < 1e-12
