"""Quality rules with thresholds learned from the data: one mergeable quantile sketch per language, source and measure.

The sketch is a count per logarithmic bin: every value lies within ``ACCURACY`` of its bin's value, sketches are merged by
adding counts, and the order of the rows does not matter. A group's fences come from its own sketch, or from the merged sketch
of its language, or of everything, whichever is the first that holds ``MIN_ROWS`` documents. All of it is SQL.

Fences are meant for what is far from a group's own documents, and leave the ordinary ones alone. The upper fence lies in the widest gap of the
sketch above the bulk: two neighbouring bins whose values differ by a factor of ``GAP`` or more (values below ``FLOOR`` count as it), with a share of
``TAIL`` to ``MOST`` of the documents above. Where there is no such gap, it is the quantile that leaves ``TAIL`` of them above, one bin's width
added. The lower fence is the quantile that leaves ``TAIL`` below; measures whose median is 0 have none.

Defined cases: a null or blank text has no words, all measures 0 and fails the base rule; null languages and sources are groups of
their own; repeated rows are judged each; other columns are never read, so their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parcelworks.llm.columns import SPACES, count_of, let, total, words
from parcelworks.session import materialize

ACCURACY = 0.01
MIN_ROWS = 200
TAIL = 0.005
MOST = 0.12
GAP = 3.0
FLOOR = 0.05
MEASURES = ("symbols", "repeated_lines", "repeated_words", "capitals", "word_length")
SYMBOLS = "#*$%&|<>"
_GAMMA = math.log((1 + ACCURACY) / (1 - ACCURACY))
_ZERO_BIN = -100_000


def _repeat_words(w: Column) -> Column:
    """Words that lie in a window of three words found twice or more: sorted windows put equal ones side by side.

    Windows are compared by a 64-bit hash. A text without equal ones, the usual case, is done after one pass.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: let(starts(s), lambda p: total(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))))))

    none = F.lit(0).cast("long")
    return F.when(F.size(w) >= 3, let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))).otherwise(none)


def measures(text: Column) -> Column:
    """Struct of the counts of one whole text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column, ln: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            (F.length(text) - count_of(text, SPACES)).cast("long").alias("word_chars"),
            count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(ln).cast("long").alias("n_lines"),
            count_of(text, "A-Z").cast("long").alias("n_capitals"),
        )

    return let(words(text), lambda w: let(lines, lambda ln: of(w, ln)))


def _ratios(c: Column) -> dict[str, Column]:
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "symbols": per(c["n_symbols"], c["n_words"]),
        "repeated_lines": per(c["n_dup_lines"], c["n_lines"]),
        "repeated_words": per(c["n_repeat_words"], c["n_words"]),
        "capitals": per(c["n_capitals"], c["word_chars"]),
        "word_length": per(c["word_chars"], c["n_words"]),
    }


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): the sketches of all groups, counted map-side first."""
    rows = measured.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in _ratios(F.col("counts")).items()])).alias("m"))
    at = F.when(F.col("m.value") > 0, F.ceil(F.log(F.col("m.value")) / _GAMMA)).otherwise(F.lit(_ZERO_BIN)).cast("int")
    return rows.groupBy("lang", "source", F.col("m.measure").alias("measure"), at.alias("bin")).agg(F.count("*").alias("n"))


def _quantiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """Median, tail quantiles and the begin of the widest gap of each merged sketch; a window holds the bins of one sketch, whose number the accuracy bounds."""
    merged = sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*keys, "measure")
    value = F.when(F.col("bin") == _ZERO_BIN, F.lit(0.0)).otherwise(F.exp(F.col("bin") * _GAMMA) * (1 - ACCURACY))
    cum = merged.withColumns({"below": F.sum("n").over(by.orderBy("bin")), "rows": F.sum("n").over(by), "value": value})
    cum = cum.withColumn("gap", F.greatest(F.lead("value").over(by.orderBy("bin")), F.lit(FLOOR)) / F.greatest("value", F.lit(FLOOR)))
    pick = lambda q: F.min(F.when(F.col("below") >= F.col("rows") * q, F.col("value")))
    above = F.col("rows") - F.col("below")
    wide = (F.col("gap") >= GAP) & (above >= TAIL * F.col("rows")) & (above <= MOST * F.col("rows"))
    widest = F.max(F.when(wide, F.struct("gap", (-F.col("bin")).alias("bin"), F.greatest("value", F.lit(FLOOR)).alias("value"))))["value"]
    return cum.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), pick(TAIL).alias("low"), pick(0.5).alias("mid"), pick(1 - TAIL).alias("high"), widest.alias("cut"))


def thresholds(sketches: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(lang, source, fences): for every group the lower and upper fence of each measure, and whether the upper one lies in a gap."""
    own, language, all_rows = _quantiles(sketches, "lang", "source"), _quantiles(sketches, "lang"), _quantiles(sketches)
    q = F.struct("rows", "low", "mid", "high", "cut")
    o = own.select("lang", "source", "measure", q.alias("a"))
    lang = language.select(F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"), q.alias("b"))
    every = all_rows.select(F.col("measure").alias("g_measure"), q.alias("c"))
    joined = o.join(lang, o["lang"].eqNullSafe(F.col("l_lang")) & (o["measure"] == F.col("l_measure"))).join(every, o["measure"] == F.col("g_measure"))
    used = F.when(F.col("a.rows") >= min_rows, F.col("a")).when(F.col("b.rows") >= min_rows, F.col("b")).otherwise(F.col("c"))
    fences = joined.select("lang", "source", "measure", used.alias("u")).select(
        "lang", "source", "measure",
        F.when(F.col("u.mid") > 0, F.col("u.low") * (1 - 2 * ACCURACY)).otherwise(-1.0).alias("lower"),
        (F.coalesce("u.cut", "u.high") * (1 + 2 * ACCURACY)).alias("upper"), F.col("u.cut").isNotNull().alias("gap"),
    )
    by = {m: F.max(F.when(F.col("measure") == m, F.struct("lower", "upper", "gap"))).alias(m) for m in MEASURES}
    return fences.groupBy("lang", "source").agg(*by.values())


def judge(docs: DataFrame, keep: list[str] | None = None, text: str = "text", lang: str = "lang", source: str = "source", min_words: int = 50, repeat_share: float = 0.5) -> DataFrame:
    """Every row as struct ``row`` (all columns, or those of ``keep``), its ``counts``, ``base_failed`` and ``kept``.

    The texts are measured once; counts and row are written to the shared folder, and so are the sketches, so that neither the
    three merges nor a lost executor repeats that work. The fences, one row per (language, source), are joined to the documents;
    Spark broadcasts them only where their written size is small.
    """
    row = F.struct(*[F.col(c) for c in (keep or docs.columns)]).alias("row")
    measured = materialize(docs.select(row, F.col(lang).alias("lang"), F.col(source).alias("source"), measures(F.col(text)).alias("counts")), "quality")
    fences = materialize(thresholds(materialize(sketch(measured), "sketch")), "fences").withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    joined = measured.join(fences, measured["lang"].eqNullSafe(F.col("f_lang")) & measured["source"].eqNullSafe(F.col("f_source")), "left")
    inside = F.lit(True)
    for name, value in _ratios(F.col("counts")).items():
        inside &= F.coalesce(value.between(F.col(f"{name}.lower"), F.col(f"{name}.upper")), F.lit(True))
    failed = (F.col("counts.n_words") < min_words) | (F.col("counts.n_repeat_words") > repeat_share * F.col("counts.n_words"))
    return joined.select("row", "counts", failed.alias("base_failed"), (~failed & inside).alias("kept"))


def query(spark, folder: str) -> DataFrame:
    """op9: verdict of every document."""
    judged = judge(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("row.doc_id", *[f"counts.{n}" for n in names], "base_failed", "kept")


def stage(docs: DataFrame) -> DataFrame:
    """Documents that pass, with their own columns."""
    return judge(docs).where("kept").select("row.*")
