"""Global ranks and running values that never gather one big group in one task.

A plain window over everything (or over one hot key) runs in a single task. Here the
order is cut into cells first, each cell is ranked on its own, and the small table of
cell sizes carries the offsets. NULL keys and NULL order values keep their rows: they
form a cell of their own that comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parcelworks.functions.hashing import draw_key
from parcelworks.session import materialize

ID_CELL = 1 << 20  # ids per cell; an integer id is unique, so a cell holds at most this many rows


def _with_offsets(celled: DataFrame, order: list[Column], weight: Column | None = None) -> DataFrame:
    """``celled`` has ``_cell``; adds rank0 (or cum_before/cum) and total."""
    amount = F.lit(1).cast("bigint") if weight is None else weight
    sizes = celled.groupBy("_cell").agg(F.sum(amount).alias("_size"))
    # one row per cell: a bounded or N/2^20 sized table, ordered in one task
    every = W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_cell").alias("_ocell"),
        F.coalesce(F.sum("_size").over(every), F.lit(0)).alias("_before"),
        F.sum("_size").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
    )
    inside = W.partitionBy("_cell").orderBy(*order)
    if weight is None:
        local = celled.withColumn("_local", F.row_number().over(inside).cast("bigint") - 1)
        joined = local.join(offsets, F.col("_cell").eqNullSafe(F.col("_ocell")))
        return joined.withColumn("rank0", F.col("_before") + F.col("_local")).drop("_cell", "_ocell", "_local", "_before")
    local = celled.withColumn("_local", F.sum(amount).over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn("_own", amount)
    joined = local.join(offsets, F.col("_cell").eqNullSafe(F.col("_ocell")))
    return (
        joined.withColumn("cum", F.col("_before") + F.col("_local"))
        .withColumn("cum_before", F.col("cum") - F.col("_own"))
        .drop("_cell", "_ocell", "_local", "_before", "_own")
    )


def rank_by_draw(df: DataFrame, seed: int, key: str, hex_digits: int = 4) -> DataFrame:
    """rank0 and total under the seeded pseudo-random order of ``key``.

    Cells are hash prefixes: 65,536 of equal expected size whatever the key looks like.
    """
    drawn = df.withColumn("_draw", draw_key(seed, F.col(key)))
    celled = drawn.withColumn("_cell", F.conv(F.substring("_draw", 1, hex_digits), 16, 10).cast("int"))
    return _with_offsets(celled, [F.col("_draw"), F.col(key)]).drop("_draw")


def rank_by_id(df: DataFrame, key: str, width: int = ID_CELL) -> DataFrame:
    """rank0 and total by a unique integer key."""
    return _with_offsets(df.withColumn("_cell", F.floor(F.col(key) / F.lit(width))), [F.col(key)])


def cumulative_by_id(df: DataFrame, key: str, weight: Column, width: int = ID_CELL) -> DataFrame:
    """cum_before, cum and total of an integer weight in the order of a unique integer key."""
    return _with_offsets(df.withColumn("_cell", F.floor(F.col(key) / F.lit(width))), [F.col(key)], weight)


def rank_by_range(df: DataFrame, order: list[Column]) -> DataFrame:
    """rank0 and total under any total order.

    Range partitions are the cells. The partitioned table is written once, because the
    sampled range bounds must not change between counting and ranking.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("_cell", F.spark_partition_id()), "ranged")
    return _with_offsets(ranged, order)


def running_before(df: DataFrame, key: str, seq: str, extremes: dict[str, tuple[str, Column]], width: int = ID_CELL) -> DataFrame:
    """Adds each running extreme over all earlier rows of ``key`` (NULL at the first row).

    ``extremes`` maps a new column to ("min" or "max", value). A key with very many rows
    is cut into cells of ``seq``; the extremes of earlier cells are carried over.
    """
    pick = {"min": (F.min, F.least), "max": (F.max, F.greatest)}
    celled = df.withColumn("_cell", F.floor(F.col(seq) / F.lit(width)))
    inside = W.partitionBy(key, "_cell").orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(key).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = celled.groupBy(key, "_cell").agg(*(pick[k][0](v).alias(f"_c_{n}") for n, (k, v) in extremes.items()))
    carried = cells.select(
        F.col(key).alias("_k"),
        F.col("_cell").alias("_kcell"),
        *(pick[k][0](f"_c_{n}").over(before).alias(f"_b_{n}") for n, (k, _) in extremes.items()),
    )
    local = celled.select("*", *(pick[k][0](v).over(inside).alias(f"_l_{n}") for n, (k, v) in extremes.items()))
    joined = local.join(carried, F.col(key).eqNullSafe(F.col("_k")) & F.col("_cell").eqNullSafe(F.col("_kcell")))
    return joined.select(*df.columns, *(pick[k][1](f"_l_{n}", f"_b_{n}").alias(n) for n, (k, _) in extremes.items()))


def previous_value(df: DataFrame, key: str, seq: str, value: str, name: str = "previous", width: int = ID_CELL) -> DataFrame:
    """``lag(value)`` per key by a unique integer ``seq``, cut into cells."""
    celled = df.withColumn("_cell", F.floor(F.col(seq) / F.lit(width)))
    inside = W.partitionBy(key, "_cell").orderBy(seq)
    local = celled.select("*", F.row_number().over(inside).alias("_n"), F.lag(value).over(inside).alias("_lag"))
    ends = celled.groupBy(key, "_cell").agg(F.max_by(value, seq).alias("_end"))
    carried = ends.select(
        F.col(key).alias("_k"), F.col("_cell").alias("_kcell"), F.lag("_end").over(W.partitionBy(key).orderBy("_cell")).alias("_carry")
    )
    joined = local.join(carried, F.col(key).eqNullSafe(F.col("_k")) & F.col("_cell").eqNullSafe(F.col("_kcell")))
    return joined.select(*df.columns, F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_lag")).alias(name))


def rank_within(df: DataFrame, key: str, seq: str, width: int = ID_CELL) -> DataFrame:
    """rank0 inside each ``key`` by a unique integer ``seq``; a hot key is ranked in cells."""
    celled = df.withColumn("_cell", F.floor(F.col(seq) / F.lit(width)))
    sizes = celled.groupBy(key, "_cell").agg(F.count("*").alias("_size"))
    before = W.partitionBy(key).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col(key).alias("_k"), F.col("_cell").alias("_kcell"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    local = celled.withColumn("_local", F.row_number().over(W.partitionBy(key, "_cell").orderBy(seq)).cast("bigint") - 1)
    joined = local.join(offsets, F.col(key).eqNullSafe(F.col("_k")) & F.col("_cell").eqNullSafe(F.col("_kcell")))
    return joined.withColumn("rank0", F.col("_before") + F.col("_local")).drop("_k", "_kcell", "_cell", "_local", "_before")


def rank_within_by(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """rank0 inside each ``key`` by any order (``order`` must be total within a key)."""
    ranked = rank_by_range(df, [F.col(key), *order])
    first = ranked.groupBy(F.col(key).alias("_k")).agg(F.min("rank0").alias("_first"))
    joined = ranked.join(first, F.col(key).eqNullSafe(F.col("_k")))
    return joined.withColumn("rank0", F.col("rank0") - F.col("_first")).drop("_k", "_first", "total")
