"""Near-duplicate vectors by a robust-pruned flat graph, searched by range.

* Shards: vectors go to the ``OVERLAP`` nearest of centres that are drawn from their shard; a shard of more than ``SHARD`` vectors is cut again
  by centres of its own, so no task gathers more, however many vectors lie together. Equal vectors are one class with a number of copies.
* Graph: in each shard a vector gets neighbours by robust pruning (a candidate goes if a chosen neighbour is ``ALPHA`` times nearer to it than
  the vector is), from its nearest ones and from a random part of the shard, and every edge is used both ways. The adjacency lists of all
  shards are united by vector; a list carries each edge's cosine.
* Search: every class is a query in all its shards. A greedy search begins at the shard's medoid and at the query's own vertex, keeps the ``BEAM``
  best and expands the best open one; whatever lies in range is expanded too, until nothing in range is open.
* United lists lead out of a shard. From a neighbour v in range of q, an edge to u goes on only if angle(v, u) - angle(q, v) still allows the
  range. Such pairs are checked on the vectors by joins and expanded in turn, in rounds, until no new pair is found.
* Audit: ``AUDIT`` queries are compared with all vectors. If their recall is below ``RECALL``, overlap, degree and beam are doubled.

The index covers every vector; centres and audit are the only samples. Links are cosines in double precision, never estimates. Nothing limits
the number of links of a vector, so the work inside a group of m mutually linked, different vectors is m * m pairs, of two longs each.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so are their own component;
components missing in a shorter vector count 0; equal vectors link with each other; rows with equal ids are vectors each; a row with a
null id takes part, and its component is the least id found; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelworks.llm.columns import let
from parcelworks.llm.graph import components
from parcelworks.llm.topk import usable
from parcelworks.session import materialize

LIMIT = 0.9
SHARD = 2048
OVERLAP = 3
CENTRES = 256
LEVELS = 6
DEGREE = 24
ALPHA = 1.2
BEAM = 16
AUDIT = 512
RECALL = 0.95
PIECE = 1 << 16
#: Edges that a step of a search looks at together, at most; bounds its memory in a group of many mutual links.
STEP = 1 << 19


def unit(vector: Column) -> Column:
    """The vector with length 1; null if it has no direction."""
    largest = F.array_max(F.transform(vector, F.abs))

    def divided(scaled: Column) -> Column:
        norm = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x * x))
        return let(norm, lambda n: F.transform(scaled, lambda x: x / n + F.lit(0.0)))

    return let(largest, lambda m: F.when(m > 0, let(F.transform(vector, lambda x: x / m), divided)))


def _matrix(vectors: pd.Series, kind: type = np.float64) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors), default=1)), kind)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _widen(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _assign(many: int):
    """Vectors to their ``many`` nearest centres, or, if they are a second copy already, to the nearest one."""

    def run(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(theirs):  # no centre was drawn: cut again with the next level's draw
            return mine[["shard", "c", "v", "first"]]
        v, centre = _matrix(mine["v"], np.float32), _matrix(theirs.sort_values("k")["centre"], np.float32)
        width = max(v.shape[1], centre.shape[1]) if len(mine) else 1
        near = np.argsort(-(_widen(v, width) @ _widen(centre, width).T), axis=1, kind="stable")[:, :many] if len(mine) else np.zeros((0, 1), int)
        ranks = np.tile(np.arange(near.shape[1]), len(mine))
        rows = np.repeat(np.arange(len(mine)), near.shape[1])
        keep = (ranks == 0) | (mine["first"].to_numpy()[rows])
        rows, ranks, to = rows[keep], ranks[keep], near.ravel()[keep]
        names = [f"{s}/{t}" for s, t in zip(mine["shard"].to_numpy()[rows], to, strict=True)]
        return pd.DataFrame({"shard": names, "c": mine["c"].to_numpy()[rows], "v": mine["v"].to_numpy()[rows], "first": ranks == 0})

    return run


def shards(classes: DataFrame, overlap: int = OVERLAP, shard: int = SHARD) -> DataFrame:
    """(shard, c, v) of all classes (c, v): shards of at most ``shard`` vectors, or blocks of them by hash where no centres can tell them apart."""
    done, state = [], classes.select(F.lit("").alias("shard"), "c", "v", F.lit(True).alias("first"))
    for level in range(LEVELS):
        sizes = materialize(state.groupBy("shard").agg(F.count("*").alias("size")), "sizes")
        sized = state.join(sizes.withColumnRenamed("shard", "s"), F.col("shard") == F.col("s")).drop("s")
        done.append(sized.where(F.col("size") <= shard).select("shard", "c", "v"))
        large = sized.where(F.col("size") > shard)
        if not sizes.where(F.col("size") > shard).limit(1).count():
            break
        wanted = F.least(F.lit(CENTRES), F.ceil(F.col("size") * 2 * overlap / shard)).cast("int")
        pieces = F.ceil(F.col("size") / PIECE).cast("int")
        code = F.xxhash64("c", F.lit(level))
        drawn = large.where(F.pmod(code, F.col("size")) < 4 * wanted).select("shard", F.col("v").alias("centre"), code.alias("code"), wanted.alias("wanted"), pieces.alias("pieces"))
        chosen = drawn.withColumn("k", F.row_number().over(W.partitionBy("shard").orderBy("code"))).where(F.col("k") <= F.col("wanted"))
        centres = materialize(chosen.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("shard", "piece", "k", "centre"), "centres")
        by_piece = large.withColumn("piece", F.pmod(F.xxhash64("c"), pieces).cast("int")).groupBy("shard", "piece")
        state = materialize(by_piece.cogroup(centres.groupBy("shard", "piece")).applyInPandas(_assign(overlap if level == 0 else 2), "shard string, c long, v array<float>, first boolean"), "shards")
    else:
        sizes = state.groupBy(F.col("shard").alias("s")).agg(F.count("*").alias("size"))
        block = F.pmod(F.xxhash64("c"), F.ceil(F.col("size") * 2 / shard))
        done.append(state.join(sizes, F.col("shard") == F.col("s")).select(F.concat_ws("#", "shard", F.when(F.col("size") > shard, block)).alias("shard"), "c", "v"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def robust_prune(near: np.ndarray, sims: np.ndarray, degree: int, alpha: float = ALPHA) -> list[np.ndarray]:
    """For every row up to ``degree`` of its candidates ``near``, the nearest first: (rows, chosen) of each round."""
    mine = np.take_along_axis(sims, near, 1)
    order = np.argsort(-mine, axis=1, kind="stable")
    near, mine = np.take_along_axis(near, order, 1), np.take_along_axis(mine, order, 1)
    alive, rows, out = near != np.arange(len(near))[:, None], np.arange(len(near)), []
    for _ in range(degree):
        rows = rows[alive[rows].any(1)]
        if not len(rows):
            break
        chosen = near[rows, alive[rows].argmax(1)]
        out.append((rows, chosen))
        alive[rows] &= alpha * (1 - sims[chosen[:, None], near[rows]]) > 1 - mine[rows]
        alive[rows] &= near[rows] != chosen[:, None]
    return out


def shard_edges(v: np.ndarray, degree: int, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, cosine) of the pruned graph of one shard, both ways."""
    n = len(v)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    sims = v @ v.T
    many = min(n, 2 * degree + 1)
    closest = np.argpartition(-sims, many - 1, axis=1)[:, :many]
    far = np.random.default_rng(n).integers(0, n, (n, degree))
    picked = robust_prune(closest, sims, degree - degree // 3, alpha) + robust_prune(far, sims, degree // 3, alpha)
    a, b = (np.concatenate(x) for x in zip(*picked, strict=True)) if picked else (np.zeros(0, np.int64),) * 2
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = pairs // n, pairs % n
    return a[a != b], b[a != b], sims[a[a != b], b[a != b]]


def build(sharded: DataFrame, degree: int = DEGREE) -> DataFrame:
    """(c, edges): the united adjacency lists of all shards."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["c"].to_numpy()
        a, b, s = shard_edges(_matrix(pdf["v"], np.float32), degree)
        return pd.DataFrame({"c": ids[a], "to": ids[b], "cosine": s})

    edges = sharded.groupBy("shard").applyInPandas(run, "c long, to long, cosine float")
    united = edges.groupBy("c", "to").agg(F.min("cosine").alias("cosine"))
    return united.groupBy("c").agg(F.collect_list(F.struct("to", "cosine")).alias("edges"))


def range_search(v: np.ndarray, begins: np.ndarray, to: np.ndarray, limit: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vertex, cosine) of all pairs in range that the searches of all vertices of a shard find, step by step together."""
    n = len(v)
    mean = v.mean(0)
    medoid = int((v @ mean).argmax())
    seen = np.zeros((n, n), bool)

    def look(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs = np.unique(q * n + x)
        q, x = pairs // n, pairs % n
        new = ~seen[q, x]
        q, x = q[new], x[new]
        seen[q, x] = True
        parts = [np.einsum("ij,ij->i", v[q[i : i + 32768]], v[x[i : i + 32768]]) for i in range(0, len(q), 32768)]
        return q, x, np.concatenate(parts) if parts else np.zeros(0)

    every = np.arange(n)
    q, x, s = look(np.concatenate([every, every]), np.concatenate([np.full(n, medoid), every]))
    live, found = np.ones(len(q), bool), []
    while True:
        order = np.lexsort((-s, q))
        q, x, s, live = q[order], x[order], s[order], live[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = (rank < beam) | (live & (s >= limit))
        q, x, s, live = q[keep], x[keep], s[keep], live[keep]
        at = np.flatnonzero(live)
        pick = np.zeros(len(q), bool)
        pick[at[np.unique(q[at], return_index=True)[1]]] = True
        pick |= live & (s >= limit)
        if not pick.any():
            break
        chosen = np.flatnonzero(pick)
        pick[chosen[max(1, int(np.searchsorted(np.cumsum(begins[x[chosen] + 1] - begins[x[chosen]]), STEP))) :]] = False  # the others stay open
        live &= ~pick
        hit = pick & (s >= limit)
        found.append((q[hit], x[hit], s[hit]))
        eq, ex = q[pick], x[pick]
        degree = begins[ex + 1] - begins[ex]
        next_q = np.repeat(eq, degree)
        next_x = to[np.repeat(begins[ex] - (np.cumsum(degree) - degree), degree) + np.arange(degree.sum())]
        more = look(next_q, next_x)
        q, x, s = np.concatenate([q, more[0]]), np.concatenate([x, more[1]]), np.concatenate([s, more[2]])
        live = np.concatenate([live, np.ones(len(more[0]), bool)])
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _search(limit: float, beam: int):
    angle = np.arccos(limit) + 1e-6

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, v = pdf["c"].to_numpy(), _matrix(pdf["v"])
        order = np.argsort(ids)
        lists = [np.array([(e["to"], e["cosine"]) for e in edges], [("to", np.int64), ("cosine", np.float32)]) for edges in pdf["edges"]]
        flat, owner = np.concatenate(lists), np.repeat(np.arange(len(ids)), [len(e) for e in lists])
        place = np.minimum(np.searchsorted(ids, flat["to"], sorter=order), len(ids) - 1)
        place = order[place]
        inside = ids[place] == flat["to"]
        begins = np.concatenate([[0], np.cumsum(np.bincount(owner[inside], minlength=len(ids)))])
        q, x, s = range_search(v, begins, place[inside], limit, beam)
        out_of, leads = owner[~inside], flat[~inside]
        starts = np.searchsorted(out_of, np.arange(len(ids) + 1))
        linked = ids[q] != ids[x]
        pairs = [(ids[q][linked], ids[x][linked])]
        degrees = starts[x + 1] - starts[x]
        cuts = np.flatnonzero(np.diff(np.cumsum(degrees) // STEP)) + 1
        for mine in np.split(np.arange(len(x)), cuts):
            degree = degrees[mine]
            at = np.repeat(starts[x[mine]] - (np.cumsum(degree) - degree), degree) + np.arange(degree.sum())
            near = np.arccos(np.clip(leads["cosine"][at], -1, 1)) - np.arccos(np.clip(np.repeat(s[mine], degree), -1, 1)) <= angle + 1e-3
            pairs.append(np.unique(np.stack([np.repeat(ids[q[mine]], degree)[near], leads["to"][at[near]]]), axis=1))
        a, b = (np.concatenate(c) for c in zip(*pairs, strict=True))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "found": np.arange(len(a)) < linked.sum()}).drop_duplicates()

    return run


def _cosine(one: Column, other: Column) -> Column:
    products = F.zip_with(one, other, lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda t, x: t + x)


def links(classes: DataFrame, limit: float = LIMIT, overlap: int = OVERLAP, shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """(a, b), a < b: pairs of classes (c, v) with a cosine of ``limit`` or more that the searches find."""
    sharded = materialize(shards(classes.select("c", F.col("v").cast("array<float>").alias("v")), overlap, shard), "sharded")
    edges = materialize(build(sharded, degree), "graph").withColumnRenamed("c", "e")
    none = F.array().cast("array<struct<to: bigint, cosine: float>>")
    nodes = materialize(classes.select("c", "v").join(edges, F.col("c") == F.col("e"), "left").select("c", "v", F.coalesce("edges", none).alias("edges")), "nodes")
    members = sharded.select("shard", F.col("c").alias("m")).join(nodes, F.col("m") == F.col("c")).select("shard", "c", "v", "edges")
    results = materialize(members.groupBy("shard").applyInPandas(_search(limit, beam), "a long, b long, found boolean").groupBy("a", "b").agg(F.max("found").alias("found")), "search")
    pairs = results.where("found").select("a", "b")
    seen, open_pairs = results.select("a", "b"), results.where("NOT found").select("a", "b")
    of = lambda name: nodes.select(F.col("c").alias(name), F.col("v").alias(f"v_{name}"), F.col("edges").alias(f"e_{name}"))
    angle = float(np.arccos(limit)) + 2e-3
    while open_pairs.limit(1).count():
        met = open_pairs.join(of("a"), "a").join(of("b"), "b").withColumn("cosine", _cosine(F.col("v_a"), F.col("v_b"))).where(F.col("cosine") >= limit)
        fresh = materialize(met.select("a", "b", "cosine", "e_a", "e_b"), "fresh")
        pairs = pairs.union(fresh.select("a", "b"))
        both = fresh.select(F.col("a").alias("q"), "cosine", F.explode("e_b").alias("e")).union(fresh.select(F.col("b").alias("q"), "cosine", F.explode("e_a").alias("e")))
        ahead = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("e.cosine")))) - F.acos(F.least(F.lit(1.0), F.col("cosine"))) <= angle
        onward = both.where(ahead & (F.col("q") != F.col("e.to"))).select(F.least("q", "e.to").alias("a"), F.greatest("q", "e.to").alias("b")).distinct()
        open_pairs = materialize(onward.join(seen, ["a", "b"], "left_anti"), "onward")
        seen = seen.union(open_pairs)
    return materialize(pairs, "pairs")


def audit(classes: DataFrame, pairs: DataFrame, limit: float = LIMIT, sample: int = AUDIT) -> float:
    """Share of the links of ``sample`` queries, compared with all classes, that are among ``pairs``; 1 if they have none."""
    picked = classes.select("c", "v").orderBy(F.xxhash64("c"), "c").limit(sample).toPandas()
    if not len(picked):
        return 1.0
    ids, asked = picked["c"].to_numpy(), _matrix(picked["v"])

    def run(batches):
        for pdf in batches:
            v = _matrix(pdf["v"])
            width = max(v.shape[1], asked.shape[1])
            x, q = np.nonzero(_widen(v, width) @ _widen(asked, width).T >= limit)
            a, b = ids[q], pdf["c"].to_numpy()[x]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})[a != b]

    true = materialize(classes.select("c", "v").mapInPandas(run, "a long, b long").distinct(), "audit")
    row = true.join(pairs.withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0


def group(rows: DataFrame, keep: list[str], vec_id: str = "vec_id", vector: str = "embedding", limit: float = LIMIT, shard: int = SHARD, overlap: int = OVERLAP, least: float = RECALL) -> DataFrame:
    """Kept columns as struct ``row``, id, n_links, component_id and the audited ``recall``."""
    direction = F.when(usable(F.col(vector)), unit(F.col(vector).cast("array<double>")))
    read = materialize(rows.select(F.struct(*keep).alias("row"), F.col(vec_id).cast("long").alias("id"), direction.alias("v")), "vectors")
    grouped = read.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(grouped.withColumn("c", F.monotonically_increasing_id()), "classes")
    effort = 1
    while True:
        pairs = links(classes, limit, overlap * effort, shard, DEGREE * effort, BEAM * effort)
        recall = audit(classes, pairs, limit)
        if recall >= least or effort == 4:
            break
        effort *= 2
    sides = pairs.union(pairs.select("b", "a"))
    copies = classes.select(F.col("c").alias("b"), "copies")
    counts = sides.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("others"))
    labels = components(pairs)
    labelled = classes.select("c", "v", "least", "copies").join(labels, F.col("c") == F.col("node"), "left").withColumn("label", F.coalesce("label", "c")).drop("node")
    first = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    known = materialize(labelled.join(first, "label").join(counts, F.col("c") == F.col("a"), "left").select(F.col("v").alias("k"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "known")
    out = read.join(known, F.col("v") == F.col("k"), "left")
    component = F.when(F.col("k").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("row", "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.lit(recall).alias("recall"))


def query(spark, folder: str) -> DataFrame:
    """op13: links and component of every vector."""
    out = group(spark.read.parquet(f"{folder}/embeddings.parquet"), ["vec_id"])
    return out.select("row.vec_id", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


#: The exact answer by comparing all pairs; the searches are to find the same.
SQL = """
WITH RECURSIVE rows AS (
  SELECT vec_id, embedding, row_number() OVER () AS r, CASE WHEN embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    THEN sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) END AS norm FROM embeddings
), links AS (
  SELECT a.r AS a, b.r AS b FROM rows a JOIN rows b ON a.r <> b.r AND a.norm > 0 AND b.norm > 0
  WHERE list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (a.norm * b.norm) >= 0.9
), reached AS (
  SELECT a, b FROM links UNION SELECT x.a, l.b FROM reached x JOIN links l ON x.b = l.a
), least AS (
  SELECT x.a AS r, min(v.vec_id) AS least FROM reached x JOIN rows v ON v.r = x.b GROUP BY x.a
), counts AS (
  SELECT a AS r, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, least(v.vec_id, coalesce(m.least, v.vec_id)) AS component_id, v.vec_id IS NOT DISTINCT FROM least(v.vec_id, coalesce(m.least, v.vec_id)) AS kept
FROM rows v LEFT JOIN counts c ON c.r = v.r LEFT JOIN least m ON m.r = v.r
"""
