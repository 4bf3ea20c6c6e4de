"""Exact greedy suppression and selection in parallel rounds.

Greedy suppression by priority keeps an item when no kept item of higher priority
conflicts with it. An item may be decided as soon as every conflicting item above it is
decided, so all such items of all images are decided together in one round. Rounds end
when nothing is open; their number follows the longest chain of conflicts, not the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parcelworks.functions import bbox as B
from parcelworks.functions.bbox import Box
from parcelworks.operators.detections import levels_for, size_level, with_cells
from parcelworks.session import materialize, spread

SIDES = ["x1", "y1", "x2", "y2"]
FEW = 40  # boxes of an image up to which plain numbers are faster than arrays


def _is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def _cell_count(min_iou: float) -> Column:
    """How many cells ``with_cells`` gives a box."""
    box = Box.of()

    def at(level: Column) -> Column:
        side = F.pow(F.lit(2.0), level)
        span = lambda low, high: F.floor(high / side) - F.floor(low / side) + 1
        return span(box.x1, box.x2) * span(box.y1, box.y2)

    levels = F.sequence(size_level(box), size_level(box) + levels_for(min_iou))
    return F.aggregate(F.transform(levels, at), F.lit(0).cast("bigint"), lambda a, v: a + v)


def suppress_boxes(boxes: DataFrame, group: list[str], key: str, priority: Column, min_iou: float, top: int = 16) -> DataFrame:
    """Keys kept by greedy suppression at IoU >= ``min_iou`` within ``group``.

    Order: ``priority`` descending, then ``key`` ascending. No all-pairs step: only the
    ``top`` best open boxes of a cell are compared with each other, and kept boxes (a
    handful per cell) with the open ones. A box is decided once it is among the best in
    every cell it touches, since any box that overlaps it enough shares a cell with it.
    Exact copies are folded into their best member first, so a pile of copies costs nothing.
    """
    ranked = boxes.select(*group, *SIDES, F.struct(priority.alias("p"), (-F.col(key)).alias("k")).alias("rank"))
    flat = Box.of().area <= 0
    empty = ranked.filter(flat).select((-F.col("rank.k")).alias(key))  # overlaps nothing
    folded = ranked.filter(~flat).groupBy(*group, *SIDES).agg(F.max("rank").alias("rank"))
    open_ = materialize(folded.withColumn("_cells", _cell_count(min_iou)), "open")
    place = [*group, "level", "cell_x", "cell_y"]
    decided: list[DataFrame] = []
    overlaps = lambda a, b: B.iou_exact(a, b) >= min_iou
    while not _is_empty(open_):
        cells = with_cells(open_, min_iou)
        place_order = W.partitionBy(*place).orderBy(F.col("rank").desc())
        best = cells.withColumn("_r", F.row_number().over(place_order)).filter(F.col("_r") <= top)
        named = lambda df, p: df.select(*place, *(F.col(c).alias(f"{p}_{c}") for c in [*SIDES, "rank"]))
        pairs = named(best, "a").join(named(best, "b"), place).filter((F.col("a_rank") > F.col("b_rank")) & overlaps(Box.of("a_"), Box.of("b_")))
        complete = best.groupBy("rank", "_cells").count().filter(F.col("count") == F.col("_cells")).select("rank")
        kept_ranks = complete.join(pairs.select(F.col("b_rank").alias("rank")).distinct(), "rank", "left_anti")
        kept = materialize(open_.join(kept_ranks, "rank", "left_semi"), "kept")
        decided.append(kept)
        hit = named(with_cells(kept, min_iou), "a").join(named(cells, "b"), place).filter((F.col("a_rank") > F.col("b_rank")) & overlaps(Box.of("a_"), Box.of("b_")))
        gone = hit.select(F.col("b_rank").alias("rank")).union(kept.select("rank")).distinct()
        open_ = materialize(open_.join(gone, "rank", "left_anti"), "open")
    result = empty
    for part in decided:
        result = result.union(part.select((-F.col("rank.k")).alias(key)))
    return result


def first_kept(kept: DataFrame, boxes: DataFrame, group: list[str], key: str, priority: Column, most: int) -> DataFrame:
    """The ``most`` best kept boxes of each group, where a caller wants no more: later ones never change earlier ones.

    The rank filter is a limit per group, which Spark applies before the shuffle.
    """
    place = F.row_number().over(W.partitionBy(*group).orderBy(priority.desc(), key))
    return boxes.join(kept, key, "left_semi").withColumn("_place", place).filter(F.col("_place") <= most).select(key)


def suppress_edges(nodes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """``nodes`` kept by greedy suppression along ``edges`` (winner, loser).

    Each round keeps winners that lose to no open item, drops what they beat and forgets
    the decided edges; the edge table shrinks every round.
    """
    open_ = materialize(edges.select("winner", "loser"), "edges")
    dropped: list[DataFrame] = []
    while not _is_empty(open_):
        losers = open_.select(F.col("loser").alias("winner")).distinct()
        beaten = materialize(open_.join(losers, "winner", "left_anti").select("loser").distinct(), "beaten")
        dropped.append(beaten)
        without = open_.join(beaten, "loser", "left_anti").join(beaten.select(F.col("loser").alias("winner")), "winner", "left_anti")
        open_ = materialize(without, "edges")
    if not dropped:
        return nodes
    gone = dropped[0]
    for part in dropped[1:]:
        gone = gone.union(part)
    return nodes.join(gone.select(F.col("loser").alias(key)), key, "left_anti")


def mask_conflicts(pairs: DataFrame, priority: DataFrame, condition: Column) -> DataFrame:
    """Overlap pairs that meet ``condition`` as (winner, loser) by ``priority`` (mask_id, rank struct)."""
    side = lambda name: priority.select(F.col("mask_id").alias(f"id_{name}"), F.col("rank").alias(f"_r{name}"))
    judged = pairs.filter(condition).join(side("a"), "id_a").join(side("b"), "id_b")
    first = F.col("_ra") > F.col("_rb")
    return judged.select(F.when(first, F.col("id_a")).otherwise(F.col("id_b")).alias("winner"), F.when(first, F.col("id_b")).otherwise(F.col("id_a")).alias("loser"))


# ---- k picks per image ---------------------------------------------------------------

def _pick_rounds(state: DataFrame, group: str, picks: int, choose, update) -> DataFrame:
    """``picks`` rounds of one pick per group: an aggregate and a join, all groups together.

    The pick is a max with map-side combine, so a group with very many candidates needs no
    gathering. ``choose(round)`` gives the pick order (struct with the key last, NULL when
    not eligible), ``update(df)`` the candidate columns after the pick ``_p``.
    """
    current, chosen = materialize(state, "state"), []
    for turn in range(picks):
        order = choose(turn)
        best = current.filter(order.isNotNull()).groupBy(group).agg(F.max_by(F.struct("key", *SIDES), order).alias("_p"))
        best = materialize(best.withColumn("turn", F.lit(turn)), "pick")
        if _is_empty(best):
            break
        chosen.append(best.select(group, F.col("_p.key").alias("key"), "turn"))
        if turn + 1 < picks:
            joined = current.join(best.select(group, "_p"), group).filter(F.col("key") != F.col("_p.key"))
            current = materialize(update(joined).drop("_p"), "state")
    if not chosen:
        return current.select(group, "key", F.lit(0).alias("turn")).limit(0)
    result = chosen[0]
    for part in chosen[1:]:
        result = result.union(part)
    return result


def diverse_select(proposals: DataFrame, group: str, picks: int, duplicate_iou: float = 0.35, coverage: float = 0.60, penalty: float = 0.55) -> DataFrame:
    """Repeatedly the best ``base - penalty * max IoU with the chosen``, near duplicates removed.

    ``proposals``: group, key, box, base, score, area.
    """
    mine, other = Box.of(), Box(*(F.col(f"_p.{s}") for s in SIDES))
    common = B.intersection_area(mine, other)
    share = lambda box: common / F.greatest(box.area, F.lit(1.0))
    close = (B.iou(mine, other) >= duplicate_iou) | (share(mine) >= coverage) | (share(other) >= coverage)

    def update(df: DataFrame) -> DataFrame:
        left = df.filter(~((common > 0) & close))
        return left.withColumn("max_iou", F.greatest("max_iou", F.when(common > 0, B.iou(mine, other)).otherwise(0.0)))

    order = F.struct((F.col("base") - penalty * F.col("max_iou")).alias("s"), "base", "score", "area", (-F.col("key")).alias("k"))
    return _pick_rounds(proposals.withColumn("max_iou", F.lit(0.0)), group, picks, lambda turn: order, update)


def spatially_diverse_select(
    boxes: DataFrame, group: str, picks: int, width: float, height: float, duplicate_iou: float = 0.75, containment: float = 0.85,
    confidence: float = 0.10, area: float = 0.15, distance: float = 0.55, region: float = 0.20, overlap: float = 0.30,
) -> DataFrame:
    """Spread picks over the image in an inner, inner, outer rhythm.

    ``boxes``: group, key, box, score, area, area_score, center_distance.
    """
    diagonal = max(1.0, (width**2 + height**2) ** 0.5)
    mine, other = Box.of(), Box(*(F.col(f"_p.{s}") for s in SIDES))

    def update(df: DataFrame) -> DataFrame:
        left = df.filter((B.iou(mine, other) < duplicate_iou) & (B.containment(mine, other) < containment))
        near = F.least(F.col("min_distance"), B.center_distance(mine, other) / diagonal)
        return left.withColumn("min_distance", near).withColumn("max_iou", F.greatest("max_iou", B.iou(mine, other)))

    def choose(turn: int) -> Column:
        outer = turn % 3 == 2
        away = F.col("center_distance")
        fits = (away > 0.60) if outer else (away <= 0.60)
        suits = away if outer else F.lit(1.0) - away
        value = confidence * F.col("score") + area * F.col("area_score") + distance * F.col("min_distance") + region * suits - overlap * F.col("max_iou")
        return F.struct(fits.alias("fits"), value.alias("s"), "min_distance", "area", "score", (-F.col("key")).alias("k"))

    state = boxes.withColumn("min_distance", F.lit(1.0)).withColumn("max_iou", F.lit(0.0))
    return _pick_rounds(state, group, picks, choose, update)


def group_proposals(
    proposals: DataFrame, group: str, width: float, height: float, gap_ratio: float = 0.8, area_ratio: float = 0.12, side_ratio: float = 0.35,
    pad_ratio: float = 0.08, pad_min: float = 8.0,
) -> DataFrame:
    """Join the closest mergeable proposals of an image until none is left, then pad the groups.

    ``proposals``: group, key, box. Each step changes what is closest in its image, so an image is
    one group; it holds each box and its nearest partner, nothing in the square of their number.
    Images come one after the other in the order of a task's rows, so many small ones cost no call each.
    """
    import numpy as np
    import pyarrow as pa

    infinite = float("inf")

    def few(box: list, reach: list, keys: list) -> tuple[list, list]:
        """The steps of ``many`` in plain numbers, for the images whose boxes are too few to pay for array calls."""
        count, members = len(box), [[k] for k in keys]
        alive, cost, partner = [True] * count, [infinite] * count, [0] * count

        def gap(i: int, j: int) -> float:
            a, b = box[i], box[j]
            across, down = max(a[2], b[2]) - min(a[0], b[0]), max(a[3], b[3]) - min(a[1], b[1])
            if across / width > side_ratio or down / height > side_ratio or across * down / (width * height) > area_ratio:
                return infinite
            apart = max(max(a[0], b[0]) - min(a[2], b[2]), max(a[1], b[1]) - min(a[3], b[3]))
            if apart < 0:
                return 0.0
            return apart if apart <= gap_ratio * (reach[i] + reach[j]) / 2 else infinite

        def nearest(i: int) -> None:
            cost[i] = infinite
            for j in range(i + 1, count):
                if alive[j] and (to := gap(i, j)) < cost[i]:
                    cost[i], partner[i] = to, j

        for i in range(count):
            nearest(i)
        while count and (least := min(cost)) < infinite:
            i = cost.index(least)
            j, a, b = partner[i], box[i], box[partner[i]]
            box[i] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
            reach[i] = max(float(np.hypot(box[i][2] - box[i][0], box[i][3] - box[i][1])), 1.0)
            members[i] += members[j]
            alive[j], cost[j] = False, infinite
            for k in range(count):
                if k == i or (alive[k] and cost[k] < infinite and (partner[k] == i or partner[k] == j)):
                    nearest(k)
            for k in range(i):
                if alive[k] and ((to := gap(k, i)), i) < (cost[k], partner[k]) and to < infinite:
                    cost[k], partner[k] = to, i
        return [x for x, a in zip(box, alive, strict=True) if a], [m for m, a in zip(members, alive, strict=True) if a]

    def many(box: np.ndarray, keys: list) -> tuple[list, list]:
        members, alive = [[k] for k in keys], np.ones(len(box), bool)

        def gaps(i: int) -> np.ndarray:
            """Gap from box i to every other box, infinite where the two may not be joined."""
            size = np.maximum(box[i, 2:], box[:, 2:]) - np.minimum(box[i, :2], box[:, :2])
            inner = np.minimum(box[i, 2:], box[:, 2:]) - np.maximum(box[i, :2], box[:, :2])
            gap = np.maximum(-inner, 0).max(axis=1)
            reach = np.maximum(np.hypot(*(box[:, 2:] - box[:, :2]).T), 1.0)
            near = (inner > 0).all(axis=1) | (gap <= gap_ratio * (reach[i] + reach) / 2)
            fits = (size[:, 0] / width <= side_ratio) & (size[:, 1] / height <= side_ratio) & (size.prod(axis=1) / (width * height) <= area_ratio)
            return np.where(near & fits & alive & (np.arange(len(box)) != i), gap, np.inf)

        cost, partner = np.full(len(box), np.inf), np.zeros(len(box), int)

        def nearest(i: int) -> None:
            later = gaps(i)[i + 1 :]
            if len(later):
                partner[i] = i + 1 + int(later.argmin())
                cost[i] = later[partner[i] - i - 1]

        for i in range(len(box)):
            nearest(i)
        while len(box) and np.isfinite(cost.min()):
            i = int(cost.argmin())
            j = int(partner[i])
            box[i] = [*np.minimum(box[i, :2], box[j, :2]), *np.maximum(box[i, 2:], box[j, 2:])]
            members[i] += members[j]
            alive[j], cost[j] = False, np.inf
            for k in np.flatnonzero(alive & ((partner == j) | (partner == i)) & np.isfinite(cost)):
                nearest(int(k))
            nearest(i)
            to = gaps(i)
            for k in np.flatnonzero(to[:i] < np.inf):
                if (to[k], i) < (cost[k], partner[k]):
                    cost[k], partner[k] = to[k], i
        return box[alive].tolist(), [m for m, a in zip(members, alive, strict=True) if a]

    def merge(table: pa.Table) -> pa.RecordBatch:
        """All groups of ``table``, which holds each of its groups whole and in key order."""
        names, keys = table.column(0).combine_chunks(), table.column(1).to_pylist()
        codes = names.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        boxes = np.stack([table.column(2 + n).to_numpy() for n in range(4)], axis=1).astype(float)
        reach = np.maximum(np.hypot(*(boxes[:, 2:] - boxes[:, :2]).T), 1.0).tolist()
        plain, known = boxes.tolist(), np.isfinite(boxes).all(axis=1)
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        at, first, size, ids, joined = [], [], [], [], []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high - low <= FEW and known[low:high].all():
                found, members = few(plain[low:high], reach[low:high], keys[low:high])
            else:
                found, members = many(boxes[low:high].copy(), keys[low:high])
            at += [low] * len(found)
            joined += found
            first += [min(m) for m in members]
            size += [len(m) for m in members]
            ids += [",".join(map(str, sorted(m))) for m in members]
        sides = np.array(joined, float).reshape(-1, 4)
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(at, pa.int64())), pa.array(first, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.string()), *(pa.array(np.ascontiguousarray(sides[:, n])) for n in range(4))],
            [group, "first_key", "members", "ids", *SIDES],
        )

    def run(batches):
        held = []  # slices of the group that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0)
            codes = names.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            same = bool(held) and held[0].column(0)[0].as_py() == names[0].as_py()
            turns = np.flatnonzero(np.diff(codes)) + 1
            if held and (not same or len(turns)):
                whole = int(turns[-1]) if len(turns) else 0
                yield merge(pa.Table.from_batches([*held, batch.slice(0, whole)]))
                held = [batch.slice(whole)]
            elif len(turns):
                yield merge(pa.Table.from_batches([batch.slice(0, int(turns[-1]))]))
                held = [batch.slice(int(turns[-1]))]
            else:
                held.append(batch)
        if held:
            yield merge(pa.Table.from_batches(held))

    kind = dict(proposals.dtypes)[group]
    schema = f"{group} {kind}, first_key bigint, members bigint, ids string, x1 double, y1 double, x2 double, y2 double"
    columns = [group, F.col("key").cast("bigint").alias("key"), *(F.col(c).cast("double").alias(c) for c in SIDES)]
    # the count of parts is given: the rows are few, the work on them is not
    merged = spread(proposals.select(*columns), group).sortWithinPartitions(group, "key").mapInArrow(run, schema)
    padded = B.pad(Box.of(), F.lit(float(width)), F.lit(float(height)), B.pad_amount(Box.of(), pad_ratio, pad_min))
    return merged.select(group, "first_key", "members", "ids", *padded.columns())


# ---- matching for object scores ------------------------------------------------------

def greedy_match(candidates: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Predictions in score order take their best free truth: ``candidates`` (keys, pred, truth, iou, rank).

    A prediction is settled when it is the highest open one for the truth it prefers. All ``keys`` (such as IoU thresholds) go
    through the same rounds.
    """
    pred, truth = [*keys, "pred"], [*keys, "truth"]
    open_, matched = materialize(candidates, "match"), []
    while not _is_empty(open_):
        wish = open_.groupBy(*pred).agg(F.max_by("truth", F.struct("iou", -F.col("truth"))).alias("truth"))
        owner = open_.groupBy(*truth).agg(F.max_by("pred", "rank").alias("pred"))
        settled = materialize(wish.join(owner, [*keys, "pred", "truth"]), "settled")
        matched.append(settled.select(*keys, "pred", "truth"))
        left = open_.join(settled.select(*pred), pred, "left_anti").join(settled.select(*truth), truth, "left_anti")
        open_ = materialize(left, "match")
    result = matched[0] if matched else candidates.select(*keys, "pred", "truth").limit(0)
    for part in matched[1:]:
        result = result.unionByName(part)
    return result


def object_metrics(pairs: DataFrame, preds: DataFrame, truths: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Object precision, recall, F1 and average precision at one IoU threshold.

    ``pairs`` (pred, truth, iou); ``preds`` (pred, score); ``truths`` (truth). The average
    precision is the mean over truths of precision at each hit: two global ranks give it
    without a running window over everything.
    """
    from parcelworks.operators.ordering import rank_by_range

    rank = F.struct("score", (-F.col("pred")).alias("k"))
    candidates = pairs.filter(F.col("iou") >= threshold).join(preds, "pred").select("pred", "truth", "iou", rank.alias("rank"))
    hits = greedy_match(candidates).select("pred").withColumn("hit", F.lit(1))
    order = [F.col("score").desc(), F.col("pred")]
    ranked = rank_by_range(preds, order).select("pred", "score", (F.col("rank0") + 1).alias("position"))
    found = ranked.join(hits, "pred")
    nth = rank_by_range(found, order).withColumn("precision_at", (F.col("rank0") + 1) / F.col("position"))
    sums = nth.agg(F.count("*").alias("tp"), F.coalesce(F.sum("precision_at"), F.lit(0.0)).alias("area"))
    counts = preds.agg(F.count("*").alias("n_pred")).join(truths.agg(F.count("*").alias("n_truth"))).join(sums)
    one = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    precision, recall = F.col("tp") / one("n_pred"), F.col("tp") / one("n_truth")
    return counts.select(
        F.lit(threshold).alias("threshold"), "n_pred", "n_truth", "tp", precision.alias("precision"), recall.alias("recall"),
        (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-8))).alias("f1"), (F.col("area") / one("n_truth")).alias("average_precision"),
    )


def object_metrics_range(pairs: DataFrame, preds: DataFrame, truths: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision, recall, F1 and average precision at each IoU threshold, and the mean of the average precisions.

    Precision counts with its envelope: at every hit the best precision of this or a lower score. Hits are ranked by threshold in
    cells of the score order, and the envelope runs over the same cells from the other end.
    """
    from parcelworks.operators.ordering import rank_by_range, rank_within, running_before

    rank = F.struct("score", (-F.col("pred")).alias("k"))
    levels = F.filter(F.array(*map(F.lit, thresholds)), lambda v: v <= F.col("iou"))
    scored = pairs.join(preds, "pred").select("pred", "truth", "iou", rank.alias("rank"), F.explode(levels).alias("threshold"))
    hits = greedy_match(scored, ("threshold",)).select("threshold", "pred")
    ranked = rank_by_range(preds, [F.col("score").desc(), F.col("pred")]).select("pred", (F.col("rank0") + 1).alias("position"))
    nth = materialize(rank_within(hits.join(ranked, "pred"), "threshold", "position").select("threshold", "position", (-F.col("position")).alias("back"), ((F.col("rank0") + 1) / F.col("position")).alias("precision_at")), "hits")
    enveloped = running_before(nth, "threshold", "back", {"later": ("max", F.col("precision_at"))})
    best = F.greatest("precision_at", F.coalesce("later", F.lit(0.0)))
    sums = enveloped.groupBy("threshold").agg(F.count("*").alias("tp"), F.sum(best).alias("area")).withColumnRenamed("threshold", "_t")
    every = preds.agg(F.count("*").alias("n_pred")).join(truths.agg(F.count("*").alias("n_truth"))).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))  # two one-row tables
    full = every.join(sums, F.col("threshold") == F.col("_t"), "left").withColumns({"tp": F.coalesce("tp", F.lit(0)), "area": F.coalesce("area", F.lit(0.0))})
    one = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    precision, recall = F.col("tp") / one("n_pred"), F.col("tp") / one("n_truth")
    ap = F.col("area") / one("n_truth")
    return full.select(
        "threshold", "n_pred", "n_truth", "tp", precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-8))).alias("f1"),
        ap.alias("average_precision"), F.avg(ap).over(W.partitionBy()).alias("mean_average_precision"),
    )
