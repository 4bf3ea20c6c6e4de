"""Merkle manifest against trees built in plain Python, with blocks of one, three and many leaves."""

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from parcelworks.llm import merkle

SF = "/root/testdata/sf0.001"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, fanout=3):
    """Root, and for every node its siblings (left, right) level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i - i % fanout : i - i % fanout + fanout]
            ways[k].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
            at[k] = i // fanout
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], ways


def brute(rows):
    """Expected rows of op11 for tuples in the order of FIELDS."""
    first = lambda v: (v is not None, v)
    groups = collections.defaultdict(list)
    for r in rows:
        copy = r[4] if r[4] is None or zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 else r[4].replace("\n", "")
        groups[r[1]].append((first(r[0]), leaf_of(r), r[0], leaf_of((*r[:4], copy))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {g: climb([x[1] for x in sorted(groups[g])]) for g in names}
    root, upper = climb([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, upper, strict=True):
        for (_, leaf, doc_id, claim), way in zip(sorted(groups[g]), trees[g][1], strict=True):
            folded = claim
            for left, right in way + above:
                folded = h(left, folded, right)
            out.append((doc_id, leaf, trees[g][0], root, h(*[x for s in way + above for x in s]), folded, folded == root))
    return out


@pytest.mark.parametrize("folder", ["edges", SF])
def test_query(spark, docs_folder, folder):
    folder = docs_folder if folder == "edges" else folder
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(*FIELDS).collect()]
    found = [tuple(r) for r in merkle.query(spark, folder).collect()]
    assert collections.Counter(found) == collections.Counter(brute(rows))


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_exchange_of_small_blocks(spark, depth):
    """Trees of 1 to 200 leaves in blocks of 1, 3 and 9, so that the last parts are ragged in every way."""
    sizes = {"a": 1, "b": 2, "c": 9, "d": 10, "e": 28, "é": 82, None: 200}
    rows = [(i, s, None, i, f"t{i}\n") for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    out = merkle.manifest(docs, ["doc_id", "source"], FIELDS, depth=depth).select("row.doc_id", "leaf", "subroot", "root", "path", merkle.refold(F.col("claim"), F.col("path")).alias("folded")).collect()
    assert len(out) == len(rows) and all(r.folded == r.root for r in out)
    expected = {(x[0], x[1]): x for x in brute(rows)}
    for r in out:
        want = expected[r.doc_id, r.leaf]
        assert (r.subroot, r.root, h(*[x for s in r.path for x in s])) == want[2:5]


def test_other_fanout(spark):
    docs = spark.createDataFrame([(i, "s", None, 1, str(i)) for i in range(77)], "doc_id long, source string, lang string, n_chars long, text string")
    out = merkle.manifest(docs, ["doc_id"], FIELDS, fanout=4, depth=1).select("root", merkle.refold(F.col("claim"), F.col("path")).alias("folded")).distinct().collect()
    root, _ = climb([leaf_of((i, "s", None, 1, str(i))) for i in range(77)], 4)
    assert [(r.root, r.folded) for r in out] == [(root, root)]


def test_tampering_shows(spark):
    docs = spark.createDataFrame([(1, "s", "en", 3, "a\nb"), (2, "s", "en", 2, "ab")], "doc_id long, source string, lang string, n_chars long, text string")
    claim = merkle.leaf(*[F.col(c) for c in FIELDS[:-1]], F.lit("ab"))
    out = merkle.manifest(docs, ["doc_id"], FIELDS, claim=claim).select("row.doc_id", (merkle.refold(F.col("claim"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert {r.doc_id: r.ok for r in out} == {1: False, 2: True}
