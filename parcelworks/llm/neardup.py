"""Near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

Texts with equal shingle sets are one class. A class has ``COORDINATES`` min-hash values and is posted under each (coordinate, value).
Two classes of the wanted similarity agree in ``matches`` coordinates or more (all but about 2 pairs in 100,000 right at the
threshold, fewer above). From that count:

* skip: a value that only one class has cannot collide. Its posting is skipped, and a class with fewer than ``matches`` other values is done.
* prefix: with its values ordered by how many classes share them, a class is posted under its n - matches + 1 rarest shared values
  only; two classes that agree often enough meet under one of them. Long lists are mostly not merged at all.

In a list, every class first meets the list's most central one, and links found there are confirmed and joined to components. Only lists
that still hold several components are merged in full: blocks of a list are compared by signature, each pair in the first list it shares,
and pairs of different components that collide often enough are confirmed on the sets in the same blocks. So a large group costs rows in
proportion to its members, its pairs are never emitted, and no list is cut.

Defined cases: a text without words has no shingles, links with nothing and is its own component; repeated rows are one class; a
row with a null id takes part, its component is the least id found, null if there is none; an empty table gives no rows; texts are
read whole; other columns pass through inside ``row``. Shingles and sets are compared by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelworks.llm.columns import let
from parcelworks.llm.graph import components
from parcelworks.llm.kernel import distinct_sets, mix, shingle_prints, slices, text_bytes, word_bounds, word_prints
from parcelworks.session import materialize

COORDINATES = 64
BLOCK = 1024
#: Standard deviations that a pair at the threshold may fall below its expected number of agreeing coordinates.
SLACK = 4.3
#: Most bits of the filter in front of a join; it only saves shuffle, so no result depends on it.
FILTER_BITS = 1 << 27

_MULTIPLIERS = np.array([pow(0xB492B66FBE98F273, k + 1, 1 << 64) for k in range(COORDINATES)], np.uint64)


def matches_for(percent: int, coordinates: int = COORDINATES) -> int:
    share = percent / 100
    return max(1, int(coordinates * share - SLACK * (coordinates * share * (1 - share)) ** 0.5))


def _sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    starts, ends, firsts = word_bounds(data, offsets)
    return distinct_sets(*shingle_prints(word_prints(data, starts, ends), firsts, width), len(column))


def _identity(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprint of each set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets + np.uint64(0x51ED27)), dtype=np.uint64)])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Least value of every coordinate's hash over each non-empty set."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, COORDINATES), np.int32)
    for k in range(COORDINATES if len(full) else 0):
        values = ((sets ^ (sets >> np.uint64(31))) * _MULTIPLIERS[k]) >> np.uint64(32)
        out[full, k] = np.minimum.reduceat(values, bounds[:-1][full]).astype(np.uint32).view(np.int32)
    return out


def sketch(docs: DataFrame, keep: list[str], doc_id: str, text: str, width: int) -> DataFrame:
    """Kept columns as struct ``row``, id, code of the text, n_shingles, key of the set (null if empty) and signature."""
    rows = docs.select(F.struct(*keep).alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("code"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                sets, bounds = _sets(part.column(3), width)
                sizes = np.diff(bounds)
                signature = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sizes) + 1) * COORDINATES, COORDINATES), pa.int32()), pa.array(_signatures(sets, bounds).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(sizes), pa.array(_identity(sets, bounds), mask=sizes == 0), signature], ["row", "id", "code", "n_shingles", "key", "signature"]
                )

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, id long, code long, n_shingles long, key long, signature array<int>")


def may_be_asked(rows: DataFrame, column: str, asked: DataFrame, name: str) -> DataFrame:
    """Rows whose ``column`` (a 64-bit hash) may be in ``name`` of ``asked``, a written table; a join afterwards decides.

    Tasks add up the words of a filter of one bit for each hash, of 16 bits for each row asked for up to ``FILTER_BITS``.
    """
    bits, many = 64, asked.count()
    while bits < min(FILTER_BITS, 16 * many):
        bits *= 2
    place = asked.where(F.col(name).isNotNull()).select(F.pmod(F.col(name), F.lit(bits).cast("long")).alias("p"))
    words = place.selectExpr("shiftright(p, 6) AS w", "shiftleft(1L, CAST(p % 64 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    held = np.zeros(bits // 64, np.uint64)
    held[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def found(hashes: pd.Series) -> pd.Series:
        at = hashes.to_numpy().view(np.uint64) & np.uint64(bits - 1)
        return pd.Series((shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool))

    return rows.where(found(column))


def full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(key, members): the shingle set of every wanted class, from the text of its representative (key, id, code)."""
    texts = docs.select(F.col(doc_id).cast("long").alias("d"), F.xxhash64(text).alias("c"), F.col(text).alias("t"))
    # the same plan at every size: classes grow with the corpus, so they are never sent to every task
    texts = may_be_asked(texts, "c", wanted, "code")
    met = texts.hint("merge").join(wanted.hint("merge"), F.col("d").eqNullSafe(F.col("id")) & (F.col("c") == F.col("code"))).select("key", "t").dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                sets, bounds = _sets(part.column(1), width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64)))], ["key", "members"])

    return materialize(met.mapInArrow(run, "key long, members array<long>"), "sets")


def _coordinate(position: Column, value: Column) -> Column:
    return F.shiftleft(position.cast("long"), 32) + value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def _similar(shared: Column, one: Column, other: Column, percent: int) -> Column:
    return shared * 100 >= percent * (one + other - shared)


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Sorted batches as tables of whole (cv, i, j) groups, with the row at which each group begins."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        changes = np.zeros(max(0, len(table) - 1), bool)
        for name in ("cv", "i", "j"):
            changes |= np.diff(table.column(name).to_numpy()) != 0
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist()]
        if cuts[-1]:
            yield table.slice(0, cuts[-1]), cuts[:-1]
        held = table.slice(cuts[-1])
    if held is not None and len(held):
        yield held, [0]


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy().reshape(len(table), COORDINATES)


def _candidates(matches: int, percent: int):
    """For one pair of blocks of a list: each class with its partners of other components that agree often enough, the closest first.

    A pair counts in the first list that it shares, by the order of the prefix, so no other list gives it again. Classes that are
    partners only come without partners of their own.
    """
    schema = pa.schema([("cv", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("key", pa.int64()), ("label", pa.int64()), ("partners", pa.list_(pa.int64()))])

    def pairs(cv: int, same: bool, keys, labels, sizes, signs, shares, left, right) -> Iterator[tuple[int, np.ndarray]]:
        for p in left:
            q = right[(labels[right] != labels[p]) & (np.minimum(sizes[right], sizes[p]) * 100 >= percent * np.maximum(sizes[right], sizes[p]))]
            q = q[keys[q] > keys[p]] if same else q
            agree = signs[q] == signs[p]
            often = agree.sum(1)
            q, agree, often = q[often >= matches], agree[often >= matches], often[often >= matches]
            if not len(q):
                continue
            values = (np.arange(COORDINATES, dtype=np.int64) << 32) + (signs[p].astype(np.int64) & 0xFFFFFFFF)
            order = np.lexsort((values, shares[p]))
            first = values[order[agree[:, order].argmax(1)]] == cv
            if first.any():
                yield p, q[first][np.argsort(-often[first], kind="stable")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _blocks_of(batches):
            cv, i, j, block, keys, labels, sizes = (table.column(c).to_numpy() for c in ("cv", "i", "j", "block", "key", "label", "n"))
            signs, shares, rows = _matrix(table, "signature"), _matrix(table, "shares"), []
            for begin, end in zip(cuts, [*cuts[1:], len(table)], strict=True):
                here = np.arange(begin, end)
                left, right = here[block[begin:end] == i[begin]], here[block[begin:end] == j[begin]]
                found = dict(pairs(cv[begin], i[begin] == j[begin], keys, labels, sizes, signs, shares, left, right))
                needed = np.unique(np.concatenate([[*found], *found.values()]).astype(np.int64)) if found else []
                rows += [(cv[k], i[k], j[k], keys[k], labels[k], keys[found[k]].tolist() if k in found else []) for k in needed]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _confirm(percent: int):
    """The links between components in one pair of blocks, on the full sets; one link for each two components joined here."""

    def links(keys: list, labels: list, members: list, partners: list) -> Iterator[tuple[int, int]]:
        parent: dict = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        at = {k: n for n, k in enumerate(keys)}
        sizes = np.array([len(m) for m in members])
        flat, owner = np.concatenate(members), np.repeat(np.arange(len(sizes)), sizes)
        by_value = np.argsort(flat, kind="stable")
        flat, owner = flat[by_value], owner[by_value]
        for x, mine in enumerate(members):
            others = [at[k] for k in partners[x] if root(labels[at[k]]) != root(labels[x])]
            if not others:
                continue
            low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
            counts = high - low
            hits = owner[np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
            shared = np.bincount(hits, minlength=len(sizes))
            for y in others:
                if shared[y] * 100 >= percent * (sizes[x] + sizes[y] - shared[y]) and root(labels[y]) != root(labels[x]):
                    parent[root(labels[x])] = root(labels[y])
                    yield keys[x], keys[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _blocks_of(batches):
            found: list = []
            for begin, end in zip(cuts, [*cuts[1:], len(table)], strict=True):
                part = table.slice(begin, end - begin)
                members = [m.values.to_numpy() for m in part.column("members").combine_chunks()]
                found += links(part.column("key").to_pylist(), part.column("label").to_pylist(), members, part.column("partners").to_pylist())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return run


def link(docs: DataFrame, classes: DataFrame, percent: int, width: int, doc_id: str, text: str) -> DataFrame:
    """(node, label) of all classes (key, id, code, n, signature) that have a link."""
    matches = matches_for(percent)
    posts = classes.select("key", F.posexplode("signature").alias("k", "v")).select("key", "k", _coordinate(F.col("k"), F.col("v")).alias("cv"))
    shared = posts.withColumn("share", F.count("*").over(W.partitionBy("cv")).cast("int")).where(F.col("share") > 1)  # posts move once
    met = materialize(shared.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("share", "cv", "k"))).alias("shared")).where(F.size("shared") >= matches), "met")
    share_of = F.map_from_entries(F.transform("shared", lambda s: F.struct(s["k"].alias("k"), s["share"].alias("s"))))
    by_coordinate = let(share_of, lambda m: F.transform(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda k: F.coalesce(F.element_at(m, k), F.lit(0))))
    central = F.aggregate("shared", F.lit(0).cast("long"), lambda a, s: a + s["share"])
    left = materialize(
        met.join(may_be_asked(classes, "key", met, "key"), "key").select("key", "id", "code", "n", "signature", by_coordinate.alias("shares"), central.alias("central"), F.slice("shared", 1, F.size("shared") - matches + 1).alias("prefix")), "classes"
    )
    lists = materialize(left.select("key", "central", F.explode("prefix").alias("p")).select("key", "central", F.col("p.cv").alias("cv")), "lists")

    centres = lists.groupBy("cv").agg(F.max(F.struct("central", "key")).alias("top"), F.count("*").alias("members")).where(F.col("members") > 1).select("cv", F.col("top.key").alias("b"))
    side = lambda name: left.select(F.col("key").alias(name), F.col("n").alias(f"n_{name}"), F.col("signature").alias(f"s_{name}"))
    met_centre = lists.join(centres, "cv").select(F.col("key").alias("a"), "b").where(F.col("a") != F.col("b")).distinct()
    agree = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    close = met_centre.join(side("a"), "a").join(side("b"), "b").withColumn("agree", agree).where((F.col("agree") >= matches) & (F.least("n_a", "n_b") * 100 >= percent * F.greatest("n_a", "n_b")))
    best = materialize(close.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("top")).select("a", F.col("top.b").alias("b")), "centres")

    sets = full_sets(docs, left.select("key", "id", "code"), doc_id, text, width)
    of = lambda name: sets.select(F.col("key").alias(name), F.col("members").alias(f"m_{name}"))
    inter = F.size(F.array_intersect("m_a", "m_b"))
    stars = materialize(best.join(of("a"), "a").join(of("b"), "b").where(_similar(inter, F.size("m_a"), F.size("m_b"), percent)).select("a", "b"), "links")
    labels = components(stars)

    labelled = left.join(labels, F.col("key") == F.col("node"), "left").select("key", "n", "signature", "shares", F.coalesce("label", "key").alias("label"))
    mixed = lists.select("key", "cv").join(labelled.select("key", "label"), "key").groupBy("cv").agg(F.count("*").alias("members"), F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") != F.col("high"))
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = lists.select("key", "cv").join(mixed.select("cv", parts.alias("parts")), "cv").withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "cv", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda rows: rows.repartition(tasks, "cv", "i", "j").sortWithinPartitions("cv", "i", "j")
    asked = blocks(pairs.join(labelled, "key")).mapInArrow(_candidates(matches, percent), "cv long, i int, j int, key long, label long, partners array<long>")
    found = blocks(materialize(asked, "pairs").join(sets, "key")).mapInArrow(_confirm(percent), "a long, b long")
    return components(stars.union(materialize(found, "more")))


def group(docs: DataFrame, keep: list[str], percent: int, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Kept columns as struct ``row``, id, code of the text, n_shingles, ``label`` of the component and component_id, its least id."""
    rows = materialize(sketch(docs, keep, doc_id, text, width), "sketch")
    full = rows.where(F.col("key").isNotNull())
    first = F.struct(F.col("id").isNull().alias("none"), "id", "code")
    named = full.groupBy("key").agg(F.min(first).alias("r"), F.max("n_shingles").alias("n"), F.min_by("signature", first).alias("signature"))
    classes = materialize(named.select("key", "r.id", "r.code", "n", "signature"), "heads")
    labels = link(docs, classes, percent, width, doc_id, text)
    labelled = classes.join(labels, F.col("key") == F.col("node"), "left").select("key", "id", F.coalesce("label", "key").alias("label"))
    least = labelled.groupBy("label").agg(F.min("id").alias("component_id"))
    known = materialize(labelled.join(least, "label").select(F.col("key").alias("k"), "label", "component_id"), "components")
    out = rows.select("row", "id", "code", "n_shingles", "key").join(known, F.col("key") == F.col("k"), "left")
    return out.select("row", "id", "code", "n_shingles", "label", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark, folder: str) -> DataFrame:
    """op3: component of every document, three words and a similarity of 0.85."""
    out = group(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"], 85, 3)
    return out.select("row.doc_id", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage(docs: DataFrame, percent: int = 80, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the least id, and every document without words.

    Only ids and codes of texts are grouped; the rows with their texts are met by one join with the documents to leave out, and
    rows that are there several times with the same id and text are reduced to one.
    """
    found = group(docs, [doc_id], percent, width, doc_id, text).where(F.col("label").isNotNull())
    decided = materialize(found.groupBy("label", "id", "code", "component_id").agg(F.count("*").alias("n")), "decided")
    first = decided.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy(F.col("label").alias("f_label")).agg(F.min("code").alias("f_code"))
    marked = decided.join(first, (F.col("label") == F.col("f_label")) & (F.col("code") == F.col("f_code")) & F.col("id").eqNullSafe(F.col("component_id")), "left")
    marks = materialize(marked.where(F.col("f_label").isNull() | (F.col("n") > 1)).select(F.col("id").alias("m_id"), F.col("code").alias("m_code"), F.col("f_label").isNotNull().alias("again")), "marks")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("code"))
    met = rows.join(marks, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("code") == F.col("m_code")), "left")
    return met.where(F.col("m_code").isNull()).select("row.*").union(met.where("again").dropDuplicates(["id", "code"]).select("row.*"))
