"""Near-duplicate vectors against all pairs, on groups of every size, with shards cut several times."""

import collections

import numpy as np
import pytest

from parcelworks.llm import flatgraph

SCHEMA = "vec_id long, embedding array<float>, label int, c int, v int"


def brute(rows, limit=0.9):
    """vec_id -> (n_links, component_id, kept), as often as they are there."""
    ok = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(rows[k][1]) for k in ok), default=1)
    m = np.array([list(rows[k][1]) + [0.0] * (width - len(rows[k][1])) for k in ok], np.float64).reshape(len(ok), width)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= limit
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n = [0] * len(rows)
    for a, b in zip(*np.nonzero(near), strict=True):
        if a != b:
            n[ok[a]] += 1
            parent[root(ok[a])] = root(ok[b])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return collections.Counter((i, n[k], least.get(root(k)), i == least.get(root(k))) for k, (i, _) in enumerate(rows))


def groups_of(seed, sizes, singles, noise=0.03, dim=32):
    rng = np.random.default_rng(seed)
    out = []
    for size in sizes:
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        out += list(centre + rng.normal(size=(size, dim)) * noise)
    out += list(rng.normal(size=(singles, dim)))
    return [np.asarray(out[k], np.float32).tolist() for k in rng.permutation(len(out))]


def ask(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA).repartition(3)
    out = flatgraph.group(frame, ["vec_id", "label"], **options)
    return out.select("row.vec_id", "n_links", "component_id", "recall").collect()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [1.0, 0.1]), (None, [1.0, 0.05]), (9, None), (8, []), (7, [0.0, 0.0]), (6, [1.0, None]), (5, [nan, 1.0]), (4, [inf, 1.0]),
            (3, [1.0]), (10, [-1.0, 0.0]), (11, [0.0, 1.0, 0.0]), (12, [0.0, 5.0]), (13, [3e38, 3e38]), (14, [1e-40, 1e-40]), (15, [-0.0, 1.0])]
    found = collections.Counter((r.vec_id, r.n_links, r.component_id, r.vec_id is not None and r.vec_id == r.component_id) for r in ask(spark, rows))
    assert found == brute(rows)


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert flatgraph.group(frame, ["vec_id"]).count() == 0


@pytest.mark.parametrize("shard", [2048, 64])
def test_groups(spark, shard):
    """A third of the vectors in one group that no shard can hold; every link is found here."""
    vectors = groups_of(3, [300, 40, 7, 2, 2, 2], 500)
    rows = list(enumerate(vectors + vectors[:5]))
    out = ask(spark, rows, shard=shard)
    expected = brute(rows)
    found = collections.Counter((r.vec_id, r.n_links, r.component_id, r.vec_id == r.component_id) for r in out)
    true = sum(n for _, n, _, _ in expected)
    assert out[0].recall >= flatgraph.RECALL
    assert sum(r.n_links for r in out) >= 0.9 * true
    if shard == 2048:
        assert found == expected


def test_no_false_links(spark):
    """Pairs on both sides of the limit: none below it is linked."""
    angles = [np.arccos(0.9 + d) for d in (-1e-6, -1e-9, 1e-9, 1e-6)]
    rows, i = [], 0
    for k, a in enumerate(angles):
        for v in ([1.0, 0.0], [float(np.cos(a)), float(np.sin(a))]):
            rows.append((i, [0.0] * (2 * k) + v))
            i += 1
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r.vec_id: r.n_links for r in flatgraph.group(frame, ["vec_id"]).select("row.vec_id", "n_links").collect()}
    assert [out[i] for i in range(8)] == [0, 0, 0, 0, 1, 1, 1, 1]


def test_pruning():
    """A candidate behind a nearer neighbour goes; one on another side stays."""
    v = np.array([[1, 0], [0.99, 0.14], [0.98, 0.2], [0.99, -0.14]], np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = np.tile(np.arange(4), (4, 1))
    chosen = [(r, c) for rows, picks in flatgraph.robust_prune(near, v @ v.T, 3) for r, c in zip(rows, picks, strict=True)]
    assert {c for r, c in chosen if r == 0} == {1, 3}


def test_range_search_expands():
    """A chain of near vectors: the search reaches exactly those in range of the query."""
    a = np.linspace(0, 3, 61)
    v = np.stack([np.cos(a), np.sin(a)], 1)
    to = np.concatenate([[k for k in (i - 1, i + 1) if 0 <= k < 61] for i in range(61)])
    begins = np.concatenate([[0], np.cumsum([1, *[2] * 59, 1])])
    q, x, _ = flatgraph.range_search(v, begins, to, 0.9, 4)
    assert set(zip(q.tolist(), x.tolist(), strict=True)) == set(zip(*(c.tolist() for c in np.nonzero(v @ v.T >= 0.9)), strict=True))
