"""URL filter and exact top-k: brute force, edge cases, empty tables."""

import math
import random

import duckdb
import pytest

from parcelworks.llm import queries, topk, urls

SF = "/root/testdata/sf0.001"


def test_topk_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(topk.SQL).fetchall()
    assert sorted(map(tuple, topk.query(spark, SF).select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)


def test_topk_edges(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.5, -0.25, 0.125, 0.0]) for _ in range(6)], i) for i in range(205)]
    rows += [(300, None, 1), (301, [None, 1.0], 1), (302, [math.nan], 1), (303, [math.inf, 0.0], 1), (400, [0.3], 1), (5, [1.0] * 6, 1), (100, rows[100][1], 1), (None, [1.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    ok = [(i, [math.floor(1024 * float(__import__("numpy").float32(x))) for x in v]) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, mine in ok:  # every query row has a list of its own, also the two with id 100
        if q is not None and q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(mine, v)), i is None, i or 0) for i, v in ok if i != q)[:10]
            want += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored)]
    assert len(want) == 50
    order = lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3])
    assert sorted(map(tuple, topk.query(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()), key=order) == sorted(want, key=order)


def test_topk_null_ids_are_candidates(spark):
    """A row without an id is found, after the others of the same score; two query rows of one id keep their own lists."""
    rows = [(None, [5]), (1, [5]), (2, [5]), (7, [1]), (7, [-1])]
    df = spark.createDataFrame(rows, "id long, w array<long>")
    found = sorted((r.query_id, r["rank"], -1 if r.vec_id is None else r.vec_id, r.score) for r in topk.search(df, df.where("id = 7"), 3).collect())
    assert found == [(7, 1, 1, -5), (7, 1, 1, 5), (7, 2, 2, -5), (7, 2, 2, 5), (7, 3, -1, -5), (7, 3, -1, 5)]


def test_topk_small_blocks(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.randint(-9, 9) for _ in range(5)]) for i in range(120)]
    df = spark.createDataFrame(vectors, "id long, w array<long>")
    got = topk.search(df, df.where("id % 3 = 0"), 4, size=3000, block=40).collect()
    for q, v in vectors[::3]:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q)[:4]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(i, -s) for s, i in best]


def folder_with(spark, path, pages, labels=()):
    spark.createDataFrame(pages, "page_id long, url string, html string, host string, template int").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["op4_url_filter", "op6_exact_topk", "op13_embedding_neardup"])
def test_empty_table(spark, tmp_path, name):
    folder = folder_with(spark, tmp_path, [])
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    assert queries.QUERIES[name](spark, folder).count() == 0


def test_urls(spark, tmp_path):
    given = {
        1: ("https://A.Example.COM/en/5?x=/fr/", "a.example.com", "/en/5", "example.com/en/", "block"),
        2: ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        3: ("http://other.com/", "other.com", "/", "com/", "allow"),
        4: ("http://other.com", "other.com", "", None, "allow"),
        5: ("x://a.net/es/1#y", "a.net", "/es/1", "net/es/", "block"),
        6: ("x://anet/es/1", "anet", "/es/1", None, "allow"),
        7: (None, "", "", None, "allow"),
        8: ("no scheme/en/", "", "", None, "allow"),
        9: ("a://b.org/" + "s/" * 3000 + "?q", "b.org", "/" + "s/" * 3000, None, "allow"),
    }
    pages = [(k, v[0], None, "h", 1) for k, v in given.items()] + [(None, None, None, None, None), (1, given[1][0], "again", None, None)]
    rows = urls.query(spark, folder_with(spark, tmp_path, pages)).collect()
    assert len(rows) == len(pages)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows if r.page_id} == {k: v[1:] for k, v in given.items()}


def test_url_templates(spark, tmp_path):
    """A branch with bad labels is kept apart from its siblings and rejected; ids become wildcards."""
    pages = [(k, f"http://h.org/{'spam' if k % 2 else 'news'}/{k}", None, None, None) for k in range(400)]
    labels = [(k, int(k % 2 == 0), 0) for k in range(0, 400, 3)] + [(k, int(k % 2 == 0), 0) for k in range(1, 400, 3)] + [(None, 0, 1)]
    rows = urls.query(spark, folder_with(spark, tmp_path, pages, labels)).collect()
    assert {(r.template, r.verdict) for r in rows} == {("/spam/*", "block"), ("/news/*", "allow")} or {(r.path.split("/")[1], r.verdict) for r in rows} == {("spam", "block"), ("news", "allow")}


def labelled_paths(spark, paths):
    return spark.createDataFrame([("h.org", p, bad) for p, bad in paths], "host string, path string, bad boolean")


def test_small_bad_branch_of_a_large_host(spark):
    """A branch with 1 % of its host's urls, all bad, is kept apart from its good siblings."""
    paths = [(f"/s{k % 60}/{k}", False) for k in range(6000)] + [(f"/spam/{k}", True) for k in range(60)]
    found = {r.path.split("/")[1]: r for r in urls.learn(labelled_paths(spark, paths)).collect()}
    assert found["spam"].template == "/spam/*" and found["spam"].purity > urls.REJECT
    assert all(r.purity < urls.REJECT for k, r in found.items() if k != "spam")


def test_bad_section_below_the_fourth_segment(spark):
    """Siblings at segments five and seven are told apart; what never splits ends in ``**`` as before."""
    paths = [(f"/a/b/c/d/{'spam' if k % 2 else 'news'}/{k}", k % 2 == 1) for k in range(200)]
    paths += [(f"/a/b/c/e/f/g/{'bad' if k % 2 else 'ok'}/{k}/x", k % 2 == 1) for k in range(200)] + [(f"/q/b/c/d/{k}/z/{k}", False) for k in range(50)]
    rows = urls.learn(labelled_paths(spark, paths)).collect()
    assert len(rows) == len(paths)
    for r in rows:
        assert (r.purity >= urls.REJECT) == ("spam" in r.path or "bad" in r.path), r
    assert all(r.template.endswith("/**") and r.template.count("/") == 5 for r in rows if r.path.startswith("/q/"))
