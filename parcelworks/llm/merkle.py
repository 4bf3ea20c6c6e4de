"""Merkle manifest of a dataset: leaves, roots and a proof for every row, by butterfly exchange.

The rows of a group, in the order of their ids, are the leaves of its tree; every ``FANOUT`` consecutive nodes become their hash until one
node remains, the group's subroot. The subroots, in the order of the groups, are the leaves of the tree above them.

A block holds ``FANOUT ** DEPTH`` consecutive leaves, so it is a subtree of its own, hashed by one task. Then blocks exchange: in round r
the blocks below one node of that round's level are an aligned set of up to ``FANOUT`` parts; every block sends the root that it has so far
to its partner in each other part, so that every block gets all roots of the set, hashes the parent itself and writes the others down as its
next siblings. After as many rounds as there are levels every block holds the root and the upper proof of its leaves, without a way back
down. If the last part has fewer blocks than the others, its blocks send to several partners each. A round moves a row per block and
partner; texts are hashed where they are read and never move.

Positions come from range partitions and the counts of (partition, group), so no group, however large, is numbered in one task.

Defined cases: a null group is a tree of its own and comes first; null ids come first in their group; rows with equal ids are ordered by
their leaf, so repeated rows are leaves each; null values and empty texts have different leaves; a lone leaf is its tree's root and its
proof is empty; an empty table gives no rows; other columns pass through inside ``row``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelworks.llm.language import fold as crc_fold
from parcelworks.session import materialize

FANOUT = 3
DEPTH = 8
_PATH = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def refold(claim: Column, path: Column) -> Column:
    """Root that follows from a leaf and its siblings, level by level."""
    return F.aggregate(path, claim, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def positions(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``pos`` (from 0) in each tree and ``leaves``, their number, for a written table of ``rows``."""
    by = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by, F.col("tie")).sortWithinPartitions(*by, "tie")
    numbered = materialize(ranged.drop("tie").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ranged")
    runs = numbered.groupBy("part", tree).agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a row for each partition and tree in it
    every = W.partitionBy(tree)
    offsets = runs.select(F.col("part").alias("o_part"), F.col(tree).alias("o_tree"), "first", (F.sum("n").over(every.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(every).alias("leaves"))
    placed = numbered.join(offsets, (F.col("part") == F.col("o_part")) & F.col(tree).eqNullSafe(F.col("o_tree")))
    return placed.withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "o_part", "o_tree", "first", "before")


def _parents(nodes: list[str], fanout: int) -> list[str]:
    return [hashlib.sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]


def subtree(leaves: list[str], alone: bool, fanout: int, depth: int) -> list[list[str]]:
    """All levels of a block, from its leaves to its root. A block that is not alone in its tree has ``depth`` levels above the leaves."""
    levels = [leaves]
    while len(levels[-1]) > 1 if alone else len(levels) <= depth:
        levels.append(_parents(levels[-1], fanout))
    return levels


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole blocks; a block begins with its head, the row at position -1."""
    held: list = []
    for batch in batches:
        heads, begin = np.flatnonzero(batch.column("pos").to_numpy() < 0), 0
        for cut in heads:
            if held or cut > begin:
                yield pa.Table.from_batches([*held, batch.slice(begin, cut - begin)])
            held, begin = [], cut
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _dealt(placed: DataFrame, heads: DataFrame, depth: int, fanout: int) -> DataFrame:
    """Rows and block heads, every block whole and in order inside one partition."""
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = fanout**depth
    rows = placed.withColumns({"block": F.floor(F.col("pos") / size), "alone": F.col("leaves") <= size})
    return rows.unionByName(heads, allowMissingColumns=True).repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", "pos")


def exchange(blocks: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, block, top, path) from (tree, block, blocks, node): after the rounds every block knows its tree's root and the way there."""
    state = blocks.select("tree", "block", "blocks", "node", F.array().cast(_PATH).alias("path"))
    most = state.agg(F.max("blocks")).first()[0] or 0
    width = 1
    while width < most:
        block, count = F.col("block"), F.col("blocks")
        own, low = block - block % width, block % width
        mine = F.least(F.lit(width), count - own)
        group = block - block % (width * fanout)
        targets = [F.array(block)]
        for slot in range(fanout):
            begin = group + slot * width
            size = F.least(F.lit(width), count - begin)
            targets.append(F.when((begin != own) & (size > low), F.sequence(begin + low, begin + size - 1, mine)))
        slot_of = lambda b: F.floor(b / width) % fanout
        active, done = state.where(count > width), state.where(count <= width)
        sent = active.select("tree", "blocks", "node", slot_of(block).alias("slot"), F.col("block").alias("sender"), "path", F.explode(F.flatten(F.filter(F.array(*targets), lambda t: t.isNotNull()))).alias("block"))
        met = sent.groupBy("tree", "block").agg(
            F.max("blocks").alias("blocks"), F.sort_array(F.collect_list(F.struct("slot", "node"))).alias("got"), F.max(F.when(F.col("sender") == F.col("block"), F.col("path"))).alias("path")
        )
        joined = lambda keep: F.array_join(F.transform(F.filter("got", keep), lambda g: g["node"]), "")
        at = slot_of(F.col("block"))
        step = F.struct(joined(lambda g: g["slot"] < at).alias("left"), joined(lambda g: g["slot"] > at).alias("right"))
        state = materialize(met.select("tree", "block", "blocks", F.sha2(joined(lambda g: F.lit(True)), 256).alias("node"), F.concat("path", F.array(step)).alias("path")).unionByName(done), "exchange")
        width *= fanout
    return state.select("tree", "block", F.col("node").alias("top"), "path")


def grow(placed: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(tree, block, top, path) of all blocks of a table with tree, leaf, pos and leaves."""
    size = fanout**depth
    heads = placed.where(F.col("pos") % size == 0).select("tree", F.floor(F.col("pos") / size).alias("block"), F.lit(-1).cast("long").alias("pos"), F.ceil(F.col("leaves") / size).alias("blocks"))
    rows = _dealt(placed.select("tree", "leaf", "pos", "leaves"), heads, depth, fanout).select("tree", "block", "blocks", "pos", "leaf")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            head = table.slice(0, 1).combine_chunks()
            top = subtree(table.column("leaf").to_pylist()[1:], head.column("blocks")[0].as_py() == 1, fanout, depth)[-1][0]
            yield pa.RecordBatch.from_arrays([*(head.column(c).chunk(0) for c in ("tree", "block", "blocks")), pa.array([top])], ["tree", "block", "blocks", "node"])

    kind = rows.schema["tree"].dataType.simpleString()
    return exchange(materialize(rows.mapInArrow(roots, f"tree {kind}, block long, blocks long, node string"), "roots"), fanout)


def prove(placed: DataFrame, tops: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``row``, leaf, claim, subroot, root and ``path`` of all rows of ``placed``; ``tops`` has tree, block, subroot, root and the upper path."""
    heads = tops.select("tree", "block", F.lit(-1).cast("long").alias("pos"), "subroot", "root", "path")
    dealt = _dealt(placed.select("row", "tree", "leaf", "claim", "pos", "leaves"), heads, depth, fanout)
    rows = dealt.select("row", "leaf", "claim", "pos", "alone", "subroot", "root", "path")

    def around(nodes: list[str]) -> tuple[np.ndarray, np.ndarray]:
        runs = [(i, i - i % fanout, i - i % fanout + fanout) for i in range(len(nodes))]
        return np.array(["".join(nodes[a:i]) for i, a, _ in runs], object), np.array(["".join(nodes[i + 1 : b]) for i, _, b in runs], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            subroot, root, upper = (table.column(c)[0].as_py() for c in ("subroot", "root", "path"))
            body = table.slice(1).combine_chunks()
            n = len(body)
            levels = subtree(body.column("leaf").to_pylist(), body.column("alone")[0].as_py(), fanout, depth)[:-1]
            left, right = np.empty((n, len(levels) + len(upper)), object), np.empty((n, len(levels) + len(upper)), object)
            for k, nodes in enumerate(levels):
                at = np.arange(n) // fanout**k
                before, after = around(nodes)
                left[:, k], right[:, k] = before[at], after[at]
            for k, s in enumerate(upper, len(levels)):
                left[:, k], right[:, k] = s["left"], s["right"]
            pairs = pa.StructArray.from_arrays([pa.array(left.ravel(), pa.string()), pa.array(right.ravel(), pa.string())], ["left", "right"])
            path = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * left.shape[1], pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([*(body.column(c).chunk(0) for c in ("row", "leaf", "claim")), pa.array([subroot] * n), pa.array([root] * n), path], ["row", "leaf", "claim", "subroot", "root", "path"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, leaf string, claim string, subroot string, root string, path {_PATH}")


def manifest(docs: DataFrame, keep: list[str], fields: list[str], tree: str = "source", order: str = "doc_id", claim: Column | None = None, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """Kept columns as struct ``row``, leaf, claim, subroot, root and ``path``: the siblings left and right of every node from the leaf up.

    ``claim`` is the leaf to be checked against the manifest, by default the leaf itself; ``refold(claim, path)`` is the root it leads to.
    """
    own = leaf(*map(F.col, fields))
    leaves = materialize(docs.select(F.struct(*keep).alias("row"), F.col(tree).alias("tree"), F.col(order).alias("id"), own.alias("leaf"), (own if claim is None else claim).alias("claim")), "leaves")
    placed = materialize(positions(leaves, "tree", ["id", "leaf"]), "placed")
    tops = materialize(grow(placed, fanout, depth), "tops")
    groups = tops.where(F.col("block") == 0).select(F.struct(F.col("tree").alias("group")).alias("row"), F.lit(0).alias("tree"), F.col("tree").alias("group"), F.col("top").alias("leaf"), F.col("top").alias("claim"))
    above = materialize(positions(groups, "tree", ["group"]), "groups")
    proved = prove(above, grow(above, fanout, depth).select("tree", "block", F.col("top").alias("subroot"), F.col("top").alias("root"), "path"), fanout, depth)
    ways = materialize(proved.select("row.group", F.col("leaf").alias("subroot"), "root", F.col("path").alias("above")), "ways")
    met = tops.join(ways, F.col("tree").eqNullSafe(F.col("group")))
    return prove(placed, met.select("tree", "block", "subroot", "root", F.concat("path", "above").alias("path")), fanout, depth)


def query(spark, folder: str) -> DataFrame:
    """op11: proof of every document, and whether its copy, from which line ends may be missing, still leads to the root."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    untouched = F.col("text").isNull() | (crc_fold(F.col("doc_id"), 2) != 0)
    copy = leaf(*[F.col(c) for c in fields[:-1]], F.when(untouched, F.col("text")).otherwise(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    out = manifest(docs, ["doc_id"], fields, claim=copy).withColumn("folded_root", refold(F.col("claim"), F.col("path")))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    return out.select("row.doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, coalesce(CAST(doc_id AS VARCHAR), '') AS id_text FROM documents
), parity AS (
  SELECT *, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(id_text, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda crc, byte: CASE WHEN xor(crc, byte) % 2 = 1 THEN xor(xor(crc, byte) // 2, CAST(3988292384 AS BIGINT)) ELSE xor(crc, byte) // 2 END) AS crc FROM d
), f AS (
  SELECT *, CASE WHEN crc % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS copy,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head FROM parity
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(copy) || ':' || copy, '-')) AS claim FROM f
), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS pos FROM leaves
), nodes AS (
  SELECT source, 0 AS level, pos AS i, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM placed
  UNION ALL
  SELECT source, any_value(level) + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, i // 3
), tops AS (
  SELECT source, node AS subroot, CAST(row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS BIGINT) AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper_nodes AS (
  SELECT 0 AS level, pos AS i, subroot AS node, n FROM tops
  UNION ALL
  SELECT any_value(level) + 1, i // 3, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM upper_nodes WHERE n > 1 GROUP BY i // 3
), sides AS (
  SELECT a.source, a.level, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.source, a.level, a.i
), upper_sides AS (
  SELECT a.level, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM upper_nodes a JOIN upper_nodes b ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.level, a.i
), steps AS (
  SELECT p.source, p.pos, s.level, s.l, s.r FROM placed p JOIN sides s ON p.source IS NOT DISTINCT FROM s.source AND s.i = p.pos // CAST(pow(3, s.level) AS BIGINT)
  UNION ALL
  SELECT p.source, p.pos, 1000 + s.level, s.l, s.r FROM placed p JOIN tops t ON p.source IS NOT DISTINCT FROM t.source JOIN upper_sides s ON s.i = t.pos // CAST(pow(3, s.level) AS BIGINT)
), ways AS (
  SELECT source, pos, string_agg(l || r, '' ORDER BY level) AS proof, list({'l': l, 'r': r} ORDER BY level) AS way FROM steps GROUP BY source, pos
), folded AS (
  SELECT p.doc_id, p.leaf, p.source, coalesce(w.proof, '') AS proof, list_reduce(list_concat([{'l': p.claim, 'r': ''}], coalesce(w.way, [])), lambda x, y: {'l': sha256(y.l || x.l || y.r), 'r': ''}).l AS folded_root
  FROM placed p LEFT JOIN ways w ON p.source IS NOT DISTINCT FROM w.source AND p.pos = w.pos
)
SELECT f.doc_id, f.leaf, t.subroot, r.node AS root, sha256(f.proof) AS proof_sha256, f.folded_root, f.folded_root = r.node AS verified
FROM folded f JOIN tops t ON f.source IS NOT DISTINCT FROM t.source CROSS JOIN (SELECT node FROM upper_nodes WHERE n = 1) r
"""
