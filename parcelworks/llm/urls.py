"""URL filter: per host a tree of path templates, learned from the urls themselves, judged by smoothed labelled purity.

The tree grows one path segment at a time. Below each node a segment is variable where its form says so (digits, long or hex-like)
or where fewer than ``SUPPORT`` urls have it; variable segments become ``*``. A literal branch is merged into ``*`` too unless its
share of bad labels differs from its siblings' by ``Z`` standard errors. ``DEPTH`` levels are always spelled out. Below them the tree grows
on in every node that can still split, however deep; what follows the last branch that stays is ``**``, no url is left out. A template's
purity is its bad share, smoothed towards its host's, which is smoothed towards the global one.

Defined cases: a null url, or one without ``://``, has an empty host and path and the template of the empty path; repeated rows are
judged each; urls without any label get the prior; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.columns import lower_ascii
from parcelworks.session import materialize

DEPTH = 4
SUPPORT = 20
Z = 2.58
PRIOR = 10.0
REJECT = 0.5

# Host and its subdomains, beginning of the path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_VARIABLE = r"^[0-9]|[0-9]{3}|^.{25,}$|^[0-9a-f-]{8,}$"


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; the rules are a given short list."""
    fits = lambda r: ((host == r[0]) | F.endswith(host, F.lit("." + r[0]))) & F.startswith(path, F.lit(r[1]))
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    named = lambda r: F.struct(F.lit(r[0] + r[1]).alias("rule"), F.lit(r[2]).alias("verdict"))
    return F.coalesce(*[F.when(fits(r), named(r)) for r in ordered])


def templates(urls: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, path, template) for the distinct (host, path, n, labelled, bad) of ``urls``.

    Each level sums (node, segment) map-side first, so a host with a third of all urls is no task of its own; the join that brings the
    decision back is split by Spark where it is skewed. Below ``depth`` only the urls of open nodes go on. A node with fewer than
    ``SUPPORT`` urls, or whose labels all agree, is closed: none of its branches can differ by more than one standard error.
    """
    pieces = F.filter(F.split("path", "/"), lambda s: s != "")
    sums = [F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad")]
    table = materialize(urls.select("*", pieces.alias("pieces"), F.lit("").alias("template")), "urls")
    for level in range(depth):
        table = materialize(_grow(table, level).drop("stays"), f"level{level}")
    open_node = (F.col("all_n") >= SUPPORT) & (F.col("all_bad") > 0) & (F.col("all_bad") < F.col("all_labelled"))
    table = table.withColumns({"settled": F.col("template"), "cut": F.lit(depth)})
    done, level = [], depth
    while True:
        deeper = F.size("pieces") > level
        nodes = table.where(deeper).groupBy("host", "template").agg(*sums).where(open_node).select("host", "template", F.lit(True).alias("opens"))
        nodes = materialize(nodes, f"open{level}")
        if nodes.isEmpty():
            break
        marked = materialize(table.join(nodes, ["host", "template"], "left").withColumn("opens", deeper & F.coalesce("opens", F.lit(False))), f"marked{level}")
        done.append(marked.where(~F.col("opens")).drop("opens"))
        grown = _grow(marked.where("opens").drop("opens"), level)
        settled = {"settled": F.when(F.col("stays"), F.col("template")).otherwise(F.col("settled")), "cut": F.when(F.col("stays"), level + 1).otherwise(F.col("cut"))}
        table = materialize(grown.withColumns(settled).drop("stays"), f"level{level}")
        level += 1
    for part in done:
        table = table.unionByName(part)
    return table.select(*urls.columns, F.when(F.size("pieces") > F.col("cut"), F.concat("settled", F.lit("/**"))).otherwise(F.col("settled")).alias("template"))


def _grow(table: DataFrame, level: int) -> DataFrame:
    """``table`` with its templates one segment longer, and ``stays`` where that segment is a branch of its own."""
    piece = F.when(F.get("pieces", F.lit(level)).rlike(_VARIABLE), "*").otherwise(F.get("pieces", F.lit(level)))
    here = table.select("host", "template", piece.alias("piece"), "n", "labelled", "bad").where(F.col("piece").isNotNull())
    branches = here.groupBy("host", "template", "piece").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
    nodes = branches.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad")])
    literal = branches.where((F.col("piece") != "*") & (F.col("n") >= SUPPORT)).join(nodes, ["host", "template"])
    rest, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
    pooled = (F.col("all_bad") + 1) / (F.col("all_labelled") + 2)
    gap = F.abs((F.col("bad") + pooled) / (F.col("labelled") + 1) - (rest_bad + pooled) / (rest + 1))
    error = F.sqrt(pooled * (1 - pooled) * (1 / (F.col("labelled") + 1) + 1 / (rest + 1)))
    kept = literal.where(gap >= Z * error).select("host", "template", F.col("piece").alias("own"), F.lit(True).alias("stays"))
    stepped = table.withColumn("own", piece).join(kept, ["host", "template", "own"], "left")
    step = F.when(F.col("own").isNull(), "").when(F.col("stays"), F.concat(F.lit("/"), "own")).otherwise("/*")
    return stepped.select(*[c for c in table.columns if c != "template"], F.concat("template", step).alias("template"), F.coalesce("stays", F.lit(False)).alias("stays"))


def learn(labelled: DataFrame, depth: int = DEPTH, prior: float = PRIOR) -> DataFrame:
    """(host, path, template, purity): ``purity`` is the smoothed share of bad labels; input (host, path, bad boolean or null)."""
    urls = labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0))).alias("bad"))
    grown = templates(urls, depth)
    by_template = materialize(grown.groupBy("host", "template").agg(F.sum("labelled").alias("t_labelled"), F.sum("bad").alias("t_bad")), "templates")
    by_host = by_template.groupBy("host").agg(F.sum("t_labelled").alias("h_labelled"), F.sum("t_bad").alias("h_bad"))
    everything = by_template.agg(F.sum("t_labelled").alias("n"), F.sum("t_bad").alias("bad")).first()
    overall = (everything["bad"] or 0) / everything["n"] if everything["n"] else 0.0
    host_share = (F.col("h_bad") + prior * overall) / (F.col("h_labelled") + prior)
    purity = (F.col("t_bad") + prior * host_share) / (F.col("t_labelled") + prior)
    judged = by_template.join(by_host, "host").select("host", "template", purity.alias("purity"))
    return grown.select("host", "path", "template").join(judged, ["host", "template"])


def judge(pages: DataFrame, keep: list[str], bad: Column, url: str = "url", rules: list[tuple[str, str, str]] | None = None, reject: float = REJECT) -> DataFrame:
    """Kept columns as struct ``row``, host, path, rule, verdict, template and purity; a rule goes before the template."""
    rows = materialize(pages.select(F.struct(*keep).alias("row"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), bad.alias("bad")), "pages")
    learned = learn(rows.select("host", "path", "bad"))
    fit = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    said = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return rows.join(learned, ["host", "path"]).withColumn("fit", fit).select("row", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", said).alias("verdict"), "template", "purity")


def query(spark, folder: str) -> DataFrame:
    """op4: verdict of every page. The number that ends a path is the document that the page shows; its label is the page's."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(F.col("doc_id").isNotNull())
    bad = labels.groupBy(F.col("doc_id").cast("string").alias("shown")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", F.regexp_extract(url_path(F.col("url")), r"/([0-9]+)(\.html)?/?$", 1).alias("number"))
    labelled = pages.join(bad, F.when(pages["number"] != "", pages["number"]) == F.col("shown"), "left")
    out = judge(labelled, ["page_id"], F.col("bad"))
    return out.select("row.page_id", "host", "path", "rule", "verdict", "template", "purity")
