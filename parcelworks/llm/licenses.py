"""License scan: a positional index of rare licence words, intersected by relative position and confirmed by key phrases.

Every template is a run of words. The index posts each of its words with its position. A file is looked up by its own highest-IDF
licence words (none that more than ``common`` of all files have) and by each template's anchor, the rarest word of its key phrases. A find
needs all key words, so it holds the anchor however common that is, and no template can be missed; a hit at file position i for template
position p proposes the template's start i - p. A template without key phrases has as anchors the rarest words that together weigh
more than a find may lack. There, the postings are intersected with the file's words
by relative position: a start counts if all words of the key phrases stand at their places and the words found carry enough of the
template's IDF weight. IDF comes from the files themselves. All of it is DataFrame work.

The base phrases are templates that are key phrases throughout. Defined cases: a null or empty text has no words and no labels,
score 0; repeated rows are scanned each; a text of any length is scanned whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.columns import let, lower_ascii, words
from parcelworks.session import materialize

#: Characters between words, once A-Z is lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases with their labels.
BASE_PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Public licence notices; the key phrases of each stand in brackets.
NOTICES = [
    ("MIT", "[released under the mit license]"),
    ("MIT", "[permission is hereby granted] free of charge to any person obtaining a copy of [this software and associated documentation files]"),
    ("Apache-2.0", "[licensed under the apache license version 2 0]"),
    ("GPL", "this work is licensed [under the gnu general public license] version"),
    ("GPL", "this program is free software you can redistribute it and or modify it [under the terms of the gnu general public license]"),
    ("LGPL", "[gnu lesser general public license]"),
    ("AGPL", "[gnu affero general public license]"),
    ("CC-BY-NC", "licensed under [cc by nc]"),
    ("CC-BY-SA", "licensed under [cc by sa]"),
    ("CC0", "[cc0 1 0 universal]"),
    ("BSD", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"),
    ("MPL-2.0", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    ("ISC", "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted"),
    ("Unlicense", "this is [free and unencumbered software released into the public domain]"),
]


def index(base=tuple(BASE_PHRASES), notices=tuple(NOTICES)) -> list[tuple]:
    """Postings (word, template, position, is_key, base, label); ``is_key`` marks the words of key phrases."""
    rows = []
    for number, (text, label, is_base) in enumerate([(f"[{t}]", label, True) for t, label in base] + [(t, label, False) for label, t in notices]):
        inside, position = False, 0
        for token in text.replace("[", " [ ").replace("]", " ] ").split():
            if token in "[]":
                inside = token == "["
            else:
                rows.append((token, number, position, inside, is_base, label))
                position += 1
    return rows


POSTING = "word string, template int, position int, is_key boolean, base boolean, label string, anchor boolean, weight double, all_keys int, all_weight double"


def scan(docs: DataFrame, keep: list[str], text: str = "text", lookups: int = 6, common: float = 0.02, enough: float = 0.6, postings: list[tuple] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, finds): struct ``row`` of the kept columns, ``key`` and n_words of every file; every place where a template stands.

    The texts are read once; what is written to the shared folder is the licence words with their positions. The postings are
    the templates' own words, a few hundred rows whatever the data, so they are broadcast; IDF has one number for each.
    """
    spark = docs.sparkSession
    postings = postings if postings is not None else index()
    vocabulary = sorted({p[0] for p in postings})

    def hits_of(w: Column) -> Column:
        hits = F.filter(F.transform(w, lambda x, i: F.when(x.isin(vocabulary), F.struct(x.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
        return F.struct(F.size(w).cast("long").alias("n_words"), hits.alias("hits"))

    lowered = lower_ascii(F.coalesce(F.col(text), F.lit("")))
    read = docs.select(F.struct(*keep).alias("row"), F.monotonically_increasing_id().alias("key"), let(words(lowered, GAP), hits_of).alias("f"))
    files = materialize(read, "licences").select("row", "key", "f.n_words", "f.hits")

    seen = files.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("word")).groupBy("word").agg(F.count("*").alias("files"))
    counts = {r["word"]: r["files"] for r in seen.collect()}  # one row for each word of the templates at most
    lines = _weighed(postings, counts, total := files.count(), enough)
    order = {w: k for k, w in enumerate(sorted((w for w in vocabulary if counts.get(w, 0) <= common * total), key=lambda w: (counts.get(w, 0), w)))}
    anchors = sorted({p[0] for p in lines if p[6]})
    posted = F.broadcast(spark.createDataFrame(lines, POSTING))

    found = files.where(F.size("hits") > 0).withColumnRenamed("key", "file")
    looked = found.select("file", F.explode(let(_rarest(F.col("hits"), order, lookups), lambda rare: F.filter("hits", lambda h: F.array_contains(rare, h["w"]) | h["w"].isin(anchors)))).alias("h"))
    starts = looked.join(posted, F.col("h.w") == F.col("word")).select("file", "template", (F.col("h.i") - F.col("position")).alias("start")).distinct()

    wanted = starts.join(posted, "template").select("file", "template", "start", "word", (F.col("start") + F.col("position")).alias("i"), "is_key", "base", "label", "weight", "all_keys", "all_weight")
    there = found.join(starts.select("file").distinct(), "file", "left_semi").select("file", F.explode("hits").alias("h")).select("file", F.col("h.w").alias("word"), F.col("h.i").alias("i"))
    places = wanted.join(there, ["file", "word", "i"]).groupBy("file", "template", "start").agg(
        F.sum(F.col("is_key").cast("int")).alias("keys"), F.sum("weight").alias("weight"),
        F.max("all_keys").alias("all_keys"), F.max("all_weight").alias("all_weight"), F.max("base").alias("base"), F.max("label").alias("label"),
    )
    finds = places.where((F.col("keys") == F.col("all_keys")) & (F.col("base") | (F.col("weight") >= enough * F.col("all_weight"))))
    return files, finds.select("file", "label", "base", F.col("start").cast("long").alias("start"), F.least(F.lit(1.0), F.col("weight") / F.col("all_weight")).alias("score"))


def _rarest(hits: Column, order: dict[str, int], lookups: int) -> Column:
    """The file's licence words of highest IDF, at most ``lookups`` of those in ``order``."""
    if not order:
        return F.array().cast("array<string>")
    place = F.create_map(*[F.lit(x) for w, k in order.items() for x in (w, k)])
    own = F.filter(F.array_distinct(F.transform(hits, lambda h: h["w"])), lambda w: w.isin(list(order)))
    ranked = F.sort_array(F.transform(own, lambda w: F.named_struct(F.lit("o"), F.element_at(place, w), F.lit("w"), w)))
    return F.transform(F.slice(ranked, 1, lookups), lambda r: r["w"])


def _weighed(postings: list[tuple], counts: dict[str, int], files: int, enough: float) -> list[tuple]:
    """Postings with IDF weight, each template's anchors and its sums; every find holds an anchor."""
    idf = {p[0]: math.log((files + 1) / (counts.get(p[0], 0) + 1)) + 1e-3 for p in postings}
    needed: dict[int, set[str]] = defaultdict(set)
    keys: dict[int, int] = defaultdict(int)
    weights: dict[int, float] = defaultdict(float)
    own: dict[int, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for word, template, _, is_key, _, _ in postings:
        keys[template] += is_key
        weights[template] += idf[word]
        own[template][word] += idf[word]
        if is_key:
            needed[template].add(word)
    rarity = lambda w: (counts.get(w, 0), w)
    anchors = {template: {min(found, key=rarity)} for template, found in needed.items()}
    for template in own.keys() - needed.keys():
        anchors[template], held = set(), 0.0
        for word in sorted(own[template], key=rarity):
            if held <= (1 - enough) * weights[template]:
                anchors[template].add(word)
                held += own[template][word]
    return [(*p, p[0] in anchors[p[1]], idf[p[0]], keys[p[1]], weights[p[1]]) for p in postings]


def query(spark, folder: str) -> DataFrame:
    """op5: words, base places and labels of every document."""
    files, finds = scan(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"])
    base = lambda x: F.when(F.col("base"), x)
    joined = lambda labels: F.array_join(F.sort_array(labels), ",")
    by_file = finds.groupBy("file").agg(
        F.count(base(F.lit(1))).alias("n_base"), F.min(base(F.col("start"))).alias("first_word"), F.max(base(F.col("start"))).alias("last_word"),
        joined(F.collect_set(base(F.col("label")))).alias("base_labels"), joined(F.collect_set("label")).alias("labels"), F.max("score").alias("score"),
    )
    out = files.select("row.doc_id", "key", "n_words").join(by_file, F.col("key") == F.col("file"), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
