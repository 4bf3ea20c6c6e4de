"""Packing: optimal length buckets, and batches of a token budget inside each.

The lengths of all texts go into one global histogram. Dynamic programming over it picks the bucket boundaries that make the padding
least: every text is padded to its bucket's boundary. Lengths up to ``FINE`` have a bin each, longer ones share bins of about 1/256 of
their length whose value is the longest in it, so the histogram has a few thousand rows whatever the data. Inside a bucket, texts are
numbered in the order of a hash from the counts of its cells, which hold about ``CELL`` rows each, and every ``budget // boundary`` of them form
a batch; no task sorts a bucket. Only lengths and hashes are written; the texts themselves move once, to the place where they are numbered.
Numbering by place in the scan would move none, but a scan may be cut anew when executors come or go, and numbers would then be given twice.

The default length is the number of blank-separated words, so a budget is one of words, and a text without blanks has length 1 whatever its
size; give ``length`` (such as the number of a tokenizer's pieces) to pack by tokens.

Defined cases: null and empty texts have length 0 and are packed like others; a text longer than the budget is a batch by itself;
equal rows are packed each, ties of the hash in any order; an empty table gives no rows; other columns pass through inside ``row``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelworks.llm.columns import words
from parcelworks.session import materialize

BUDGET = 8192
BUCKETS = 12
FINE = 1024
#: Rows in a cell of a bucket, about.
CELL = 8192


def length_bin(length: Column) -> Column:
    """The length itself, or the number of a bin that holds about 1/256 of its length."""
    scale = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(length, F.lit(1)) / FINE)) + 3).cast("int")
    width = F.pow(F.lit(2.0), scale).cast("long")
    return F.when(length <= FINE, length).otherwise(F.floor(length / width) * width).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Boundaries of at most ``buckets`` buckets with the least sum of count * (boundary - length); ``lengths`` ascend.

    best[j] is the least cost of the first j bins; one more bucket tries every cut before j. The tokens themselves are in every
    solution, so count * boundary is what is made least.
    """
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    best, cuts = np.full(n + 1, np.inf), []
    best[0] = 0
    for _ in range(min(buckets, n)):
        nxt, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        nxt[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + (rows[j] - rows[:j]) * lengths[j - 1]
            cut[j] = int(cost.argmin())
            nxt[j] = cost[cut[j]]
        best, cuts = nxt, [*cuts, cut]
    found, j = [], n
    for cut in reversed(cuts):
        if j:
            found.append(int(lengths[j - 1]))
            j = cut[j]
    return sorted(found)


def pack(docs: DataFrame, keep: list[str], text: str = "text", budget: int = BUDGET, buckets: int = BUCKETS, length: Column | None = None) -> DataFrame:
    """Kept columns as struct ``row``, n_tokens, bucket (its boundary), batch (number in the bucket) and padding."""
    measure = F.size(words(F.col(text))).cast("long") if length is None else F.coalesce(length.cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.struct(*keep).alias("row"), measure.alias("n_tokens"), F.xxhash64(F.struct(*keep), F.col(text)).alias("code"))
    lengths = materialize(rows.select("n_tokens", "code"), "lengths")
    histogram = lengths.groupBy(length_bin(F.col("n_tokens")).alias("bin")).agg(F.max("n_tokens").alias("longest"), F.count("*").alias("n")).orderBy("bin").collect()
    cells = max(1, -(-sum(r["n"] for r in histogram) // CELL))
    found = boundaries(np.array([r["longest"] for r in histogram]), np.array([r["n"] for r in histogram]), buckets)
    if not found:
        return rows.select("row", "n_tokens", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("padding"))
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(b)) for b in found]).cast("long")
    deal = lambda df: df.withColumns({"bucket": bucket, "cell": F.pmod("code", F.lit(cells))})
    sizes = deal(lengths).groupBy("bucket", "cell").agg(F.count("*").alias("n"))  # a row for about CELL texts
    before = sizes.select(F.col("bucket").alias("b"), F.col("cell").alias("c"), (F.sum("n").over(W.partitionBy("bucket").orderBy("cell")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("bucket", "cell").orderBy("code"))
    numbered = deal(rows).withColumn("inside", inside).join(before, (F.col("bucket") == F.col("b")) & (F.col("cell") == F.col("c")))
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1)))).cast("long")
    number = F.floor((F.col("before") + F.col("inside") - 1) / each).cast("long")
    return numbered.select("row", "n_tokens", "bucket", number.alias("batch"), (F.col("bucket") - F.col("n_tokens")).alias("padding"))


def query(spark, folder: str) -> DataFrame:
    """op8: bucket and batch of every document."""
    return pack(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"]).select("row.doc_id", "n_tokens", "bucket", "batch", "padding")
