"""Segmentation scores from (truth, pred) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.functions.numbers import count_where


def confusion_matrix(pairs: DataFrame, classes: int, ignore: int = 255) -> DataFrame:
    """All C x C cells, zeros included.

    Pixels collapse to at most C x C counts before the cells are spread out.
    """
    both = pairs.filter(F.col("truth") != ignore)
    cells = [(t, p) for t in range(classes) for p in range(classes)]
    sums = [count_where((F.col("truth") == t) & (F.col("pred") == p)).alias(f"_{t}_{p}") for t, p in cells]
    wide = both.agg(*sums)
    rows = F.array(*(F.struct(F.lit(t).alias("truth"), F.lit(p).alias("pred"), F.coalesce(F.col(f"_{t}_{p}"), F.lit(0)).alias("n")) for t, p in cells))
    return wide.select(F.inline(rows))


def seg_metrics(pairs: DataFrame, keys: list[str], classes: int, ignore: int = 255) -> DataFrame:
    """IoU and F1 per class, their means, pixel accuracy and the boundary class, in one aggregate."""
    valid = F.col("truth") != ignore
    aggregates = [count_where(valid).alias("_n"), count_where(valid & (F.col("truth") == F.col("pred"))).alias("_hit")]
    for c in range(classes):
        t, p = valid & (F.col("truth") == c), valid & (F.col("pred") == c)
        aggregates += [count_where(t & p).alias(f"_tp{c}"), count_where(t).alias(f"_t{c}"), count_where(p).alias(f"_p{c}")]
    sums = pairs.groupBy(*keys).agg(*aggregates) if keys else pairs.agg(*aggregates)
    one = lambda c: F.greatest(c, F.lit(1)).cast("double")
    scored = sums
    for c in range(classes):
        tp, t, p = F.col(f"_tp{c}"), F.col(f"_t{c}"), F.col(f"_p{c}")
        precision, recall = tp / one(p), tp / one(t)
        scored = scored.withColumn(f"class_{c}_iou", tp / one(t + p - tp))
        scored = scored.withColumn(f"class_{c}_f1", precision * recall * 2 / F.greatest(precision + recall, F.lit(1e-8)))
    mean = lambda kind: sum((F.col(f"class_{c}_{kind}") for c in range(1, classes)), F.col(f"class_0_{kind}")) / classes
    boundary = lambda kind: F.col(f"class_2_{kind}") if classes > 2 else F.lit(0.0)
    per_class = [f"class_{c}_{kind}" for c in range(classes) for kind in ("iou", "f1")]
    return scored.select(
        *keys, (F.col("_hit") / one(F.col("_n"))).alias("pixel_accuracy"), mean("iou").alias("miou"), mean("f1").alias("macro_f1"),
        boundary("iou").alias("boundary_iou"), boundary("f1").alias("boundary_f1"), *per_class,
    )


def dice_table(predictions: DataFrame, keys: list[str], weights: list[float], ignore: int = 255) -> DataFrame:
    """Weighted multiclass dice loss and its log-cosh, from class sums over a ``probs`` array."""
    valid = F.col("truth") != ignore
    aggregates = []
    for c in range(len(weights)):
        p = F.element_at("probs", c + 1)
        hit = valid & (F.col("truth") == c)
        aggregates += [
            F.coalesce(F.sum(F.when(hit, p)), F.lit(0.0)).alias(f"_i{c}"), F.coalesce(F.sum(F.when(valid, p)), F.lit(0.0)).alias(f"_p{c}"),
            count_where(hit).cast("double").alias(f"_t{c}"),
        ]
    sums = (predictions.groupBy(*keys) if keys else predictions.groupBy()).agg(count_where(valid).alias("_n"), *aggregates)
    loss = F.lit(0.0)
    for c, w in enumerate(weights):
        dice = (F.col(f"_i{c}") * 2.0 + 1e-5) / (F.col(f"_p{c}") + F.col(f"_t{c}") + 1e-5)
        loss = loss + F.lit(w) * (F.lit(1.0) - dice)
    total = F.when(F.col("_n") == 0, 0.0).otherwise(loss / max(sum(weights), 1e-6))
    return sums.withColumn("dice_loss", total).select(*keys, "dice_loss", F.log(F.cosh("dice_loss")).alias("log_cosh"))


def evaluation_report(scores: DataFrame, key: str, top: list[str]) -> DataFrame:
    """Numbered metric rows, columns in report order."""
    from parcelworks.operators.ordering import rank_by_id

    numbered = rank_by_id(scores, key)
    return numbered.select((F.col("rank0") + 1).alias("id"), key, *top)
