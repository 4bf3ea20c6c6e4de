"""Exact top-k by inner product: every query row scatters its weights over the postings of its terms.

Vectors become integer weights. A block of candidates is a posting column for each term; a query block goes through it term at a
time, adding weight times posting into a dense score array, keeps the best by partition selection, and the blocks' lists are merged.

The queries are a stated set. They go to the candidates, which stay where they are: in passes of at most ``PASS`` bytes of queries, each
broadcast, every task scores its candidates block by block and keeps a running list of the k best for each query. Only these lists are
shuffled, k rows for each query and task, however many candidates there are.

Defined cases: every query row has a list of its own, also rows with equal ids; vectors that are null or hold a null or a non-finite
component take no part; missing terms of a shorter vector count 0; repeated rows are candidates each, but a row with the query's own id is
none of its candidates; a row with a null id is a candidate and comes last among ties; ties go to the smaller id; fewer candidates than k
give all; an empty table gives no rows; other columns are not read. Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelworks.session import materialize

SCALE = 1024
#: Bytes of query weights in a pass at most.
PASS = 64 << 20
#: Weights in a candidate block at most, 8 bytes each.
BLOCK = 1 << 17


def weights(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _postings(vectors: list) -> np.ndarray:
    """Term-major postings: one run of weights, a column for each vector, for every term."""
    out = np.zeros((max(map(len, vectors), default=0), len(vectors)), np.int64)
    for k, v in enumerate(vectors):
        out[: len(v), k] = v
    return out


def _blocks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, whether an id is null, postings) of bounded runs of candidates."""
    ids, vectors, longest = [], [], 1

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = pd.isna(np.array(ids, object))
        return np.array([0 if x else i for i, x in zip(ids, none, strict=True)], np.int64), none, _postings(vectors)

    for pdf in batches:
        for i, v in zip(pdf["id"].astype(object), pdf["w"], strict=True):
            if ids and (len(ids) + 1) * max(longest, len(v)) > size:
                yield block()
                ids, vectors, longest = [], [], 1
            ids.append(i)
            vectors.append(v)
            longest = max(longest, len(v))
    if ids:
        yield block()


def _best(ids: np.ndarray, none: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, nulls after ids, then the smaller id."""
    at = np.arange(len(ids))
    if len(at) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(at) - k)[len(at) - k])  # with all ties of the last place
    return at[np.lexsort((ids[at], none[at], -scores[at]))][:k]


def _scorer(asked: list[tuple[int, int, list]], k: int, block: int):
    """Running lists of one task for a pass of queries (number, id, weights)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}
        for ids, none, posts in _blocks(batches, block):
            for no, q, w in asked:
                scores = np.zeros(len(ids), np.int64)
                for t in np.flatnonzero(w[: len(posts)]):
                    scores += w[t] * posts[t]
                others = none | (ids != q)
                found = (ids[others], none[others], scores[others])
                if no in held:
                    found = tuple(np.concatenate(x) for x in zip(held[no], found, strict=True))
                best = _best(*found, k)
                held[no] = tuple(x[best] for x in found)
        who = np.repeat([no for no in held], [len(x[0]) for x in held.values()]).astype(np.int64)
        ids, none, scores = (np.concatenate(x) for x in zip(*held.values(), strict=True)) if held else (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        known = pd.array(ids, "Int64")
        known[none] = pd.NA
        yield pd.DataFrame({"no": who, "vec_id": known, "score": scores})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, size: int = PASS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for (id long, w array<long>) of both sides; query ids are not null."""
    asked = materialize(queries.withColumn("no", F.monotonically_increasing_id()), "queries")
    weight = asked.agg(F.sum(F.size("w") * 8 + 64)).first()[0] or 0
    passes, context = -(-2 * weight // size), vectors.sparkSession.sparkContext
    lists = None
    for p in range(max(1, passes)):
        # numbers fall evenly into the passes, so a pass holds about half of ``size``
        mine = asked.where(F.pmod(F.xxhash64("no"), F.lit(max(1, passes))) == p).collect()
        shared = context.broadcast([(r["no"], r["id"], np.array(r["w"], np.int64)) for r in mine])
        found = vectors.select("id", "w").mapInPandas(lambda batches, shared=shared: _scorer(shared.value, k, block)(batches), "no long, vec_id long, score long")
        lists = found if lists is None else lists.union(found)
    best = W.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("no", F.col("id").alias("query_id")), "no").select("query_id", "rank", "vec_id", "score")


def query(spark, folder: str) -> DataFrame:
    """op6: the ten best of every hundredth vector."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").where(usable(F.col("embedding")))
    vectors = rows.select(F.col("vec_id").alias("id"), weights(F.col("embedding")).alias("w"))
    return search(vectors, vectors.where(F.col("id") % 100 == 0))


SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id IS DISTINCT FROM c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
