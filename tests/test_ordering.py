"""Cell-wise ranks and running values against plain windows, with tiny cells."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelworks.operators import ordering as O
from parcelworks.operators.quantiles import exact_quantiles


def rows(spark, n=200, seed=3):
    rnd = random.Random(seed)
    data = [(i * 3 + 1, "hot" if rnd.random() < 0.6 else rnd.choice("ab"), rnd.randint(0, 9) / 2.0, rnd.choice("xyz")) for i in range(n)]
    return spark.createDataFrame(data, "id bigint, k string, v double, s string").repartition(5)


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_rank_by_id(spark):
    df = rows(spark)
    plain = df.select("id", (F.row_number().over(W.orderBy("id")) - 1).cast("bigint"))
    same(O.rank_by_id(df, "id", width=7).select("id", "rank0"), plain)


def test_rank_by_range(spark):
    df = rows(spark)
    plain = df.select("id", (F.row_number().over(W.orderBy(F.col("v").desc(), "id")) - 1).cast("bigint"))
    same(O.rank_by_range(df, [F.col("v").desc(), F.col("id")]).select("id", "rank0"), plain)


def test_cumulative(spark):
    df = rows(spark)
    plain = df.select("id", F.sum(F.col("v").cast("bigint")).over(W.orderBy("id").rowsBetween(W.unboundedPreceding, 0)))
    same(O.cumulative_by_id(df, "id", F.col("v").cast("bigint"), width=7).select("id", "cum"), plain)


def test_rank_within(spark):
    df = rows(spark)
    plain = df.select("id", (F.row_number().over(W.partitionBy("k").orderBy("id")) - 1).cast("bigint"))
    same(O.rank_within(df, "k", "id", width=7).select("id", "rank0"), plain)
    plain = df.select("id", (F.row_number().over(W.partitionBy("k").orderBy("v", "id")) - 1).cast("bigint"))
    same(O.rank_within_by(df, "k", [F.col("v"), F.col("id")]).select("id", "rank0"), plain)


def test_running_before(spark):
    df = rows(spark)
    before = W.partitionBy("k").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    plain = df.select("id", F.min("v").over(before).alias("lo"), F.max("v").over(before).alias("hi"))
    found = O.running_before(df, "k", "id", {"lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}, width=7).select("id", "lo", "hi")
    key = lambda r: r[0]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


def test_previous_value(spark):
    df = rows(spark)
    plain = df.select("id", F.coalesce(F.lag("s").over(W.partitionBy("k").orderBy("id")), F.lit("-")))
    same(O.previous_value(df, "k", "id", "s", "p", width=7).select("id", F.coalesce("p", F.lit("-"))), plain)


def test_exact_quantiles_match_builtin(spark):
    df = rows(spark, 500).withColumn("w", F.exp("v") * F.col("id"))
    found = exact_quantiles(df, ["k"], F.col("w"), {"a": 0.02, "b": 0.5, "c": 0.99})
    plain = df.groupBy("k").agg(*(F.percentile("w", p) for p in (0.02, 0.5, 0.99)))
    for x, y in zip(sorted(found.collect()), sorted(plain.collect())):
        assert x[0] == y[0] and all(abs(p - q) < 1e-6 * max(1, abs(q)) for p, q in zip(x[1:], y[1:]))
