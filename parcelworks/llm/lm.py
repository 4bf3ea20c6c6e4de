"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

All n-grams of the training texts are counted, words and pairs of words, by 64-bit fingerprint: summed in each task first, then
over the cluster. A count c is stored as its level 1 + floor(log2 c): the filter holds (n-gram, 1) ... (n-gram, level), and asking for
(n-gram, 1), (n-gram, 2), ... until the first miss gives the level back, too high only with the filter's small error at each probe.

The filter is broadcast, so its size has a bound, ``BITS``. What it holds is chosen by one rule at every size: the n-grams whose
level is at least the lowest for which all items fit with ``BITS_PER_ITEM`` bits each. Those below are not lost: where a text's n-gram
is not in the filter but in a second one, of those below, its level comes from a join with the written counts, so a score does not
depend on the filter's size. What is joined is rare, so no key of that join is hot. The probability of a word after another is

    (count of the pair + STRENGTH * p(word)) / (count of the first word + STRENGTH),  p(word) = (count + 0.1) / (N + 0.1 (V + 1))

with counts from the probes. The exact base score joins the tokens' exact counts: tokens with at least 1 / ``FREQUENT`` of all
occurrences are at most FREQUENT many and are broadcast; each of the others is rarer than that, so no key of the join is hot.

Defined cases: a null or empty text is one end; a null id counts as the empty text in the fold, so it is held out; repeated rows are
scored each; texts are read whole; an empty table gives no rows; without training tokens every count is 0; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.kernel import mix, slices, text_bytes, word_bounds, word_prints
from parcelworks.llm.language import fold
from parcelworks.session import materialize

BITS = 1 << 27
BITS_PER_ITEM = 12
PROBES = 4
BLOCK_BITS = 1 << 12
BLOCKS = BITS // BLOCK_BITS
FREQUENT = 1_000_000
STRENGTH = 100.0
MAX_LEVEL = 62
_WORD = np.uint64(1 << 63)
END = np.uint64(0xE17A14650C5B9D31)
_PAIR = np.uint64(0x9FB21C651E98DF25)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all texts' tokens, each text's words and then one end, and where each text begins. The top bit marks a word."""
    data, offsets = text_bytes(column)
    starts, ends, firsts = word_bounds(data, offsets)
    prints = word_prints(data, starts, ends) | _WORD
    out = np.full(len(prints) + len(column), END, np.uint64)
    out[np.arange(len(prints)) + np.repeat(np.arange(len(column)), np.diff(firsts))] = prints
    return out, firsts + np.arange(len(firsts))


def pairs(found: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Fingerprint, in 48 bits, of each token with the one before it; 0 for a text's first token."""
    out = np.zeros(len(found), np.uint64)
    out[1:] = (mix(found[:-1] * _PAIR + found[1:]) >> np.uint64(16)) | np.uint64(1)
    out[firsts[:-1]] = 0
    return out


def count_ngrams(texts: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n) of all words and pairs, dealt by the filter's blocks; each task sums its own texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(held: list) -> Iterator[pa.RecordBatch]:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(grams), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(grams[i : i + (1 << 18)].view(np.int64)), pa.array(counts[i : i + (1 << 18)])], ["gram", "n"])

        held, many = [], 0
        for batch in batches:
            for part in slices(batch, text):
                found, firsts = tokens(part.column(0))
                two = pairs(found, firsts)
                held += [found, two[two != 0]]
                many += len(found)
                if many > 4_000_000:
                    yield from summed(held)
                    held, many = [], 0
        if held:
            yield from summed(held)

    counted = texts.select(text).mapInArrow(run, "gram long, n long")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counted.withColumn("block", F.pmod("gram", F.lit(BLOCKS)).cast("int")).repartition(parts, "block").groupBy("block", "gram").agg(F.sum("n").alias("n")).select("gram", "n")


def _places(grams: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each (n-gram, level), and its PROBES bits there."""
    code = mix(grams + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    step = (code >> np.uint64(40)) | np.uint64(1)
    bits = (code[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(BLOCK_BITS)
    return grams.view(np.int64) % BLOCKS, bits.astype(np.int64)


def levels(blocks: np.ndarray, grams: np.ndarray, least: int) -> np.ndarray:
    """Stored level of each n-gram by probing ``least``, least + 1, ... until the first miss; 0 if it is not there."""
    out, left = np.zeros(len(grams), np.int64), np.arange(len(grams))
    for level in range(least, MAX_LEVEL):
        where, bits = _places(grams[left], level)
        left = left[((blocks[where[:, None], bits >> 3] >> (bits & 7).astype(np.uint8)) & 1).all(1)]
        if not len(left):
            break
        out[left] = level
    return out


def build_filter(counts: DataFrame, least: int) -> np.ndarray:
    """All blocks as rows of bytes. Tasks fill the blocks of their n-grams; the driver gets ``BITS`` bits, and joins a block that two tasks hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((BLOCKS, BLOCK_BITS // 8), np.uint8)
        for batch in batches:
            grams, stored = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for level in range(least, int(stored.max(initial=0)) + 1):
                where, bits = _places(grams[stored >= level], level)
                np.bitwise_or.at(held, (np.repeat(where, PROBES), (bits >> 3).ravel()), (np.uint8(1) << (bits & 7).astype(np.uint8)).ravel())
        full = np.flatnonzero(held.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([held[b].tobytes() for b in full], pa.binary())], ["block", "bits"])

    filled = counts.where(F.col("level") >= least).select("gram", "level").mapInArrow(run, "block int, bits binary")
    blocks = np.zeros((BLOCKS, BLOCK_BITS // 8), np.uint8)
    for row in filled.toLocalIterator():
        blocks[row["block"]] |= np.frombuffer(row["bits"], np.uint8)
    return blocks


def train(texts: DataFrame, text: str = "text") -> tuple[DataFrame, dict]:
    """Written counts (gram, n, level; pairs seen once are left out, they are no evidence), and the model: filter, its least level, sums."""
    level = (F.floor(F.log2("n")) + 1).cast("int")
    counts = materialize(count_ngrams(texts, text).where((F.col("gram") < 0) | (F.col("n") > 1)).withColumn("level", level), "counts")
    by_level = counts.groupBy("level", (F.col("gram") < 0).alias("word")).agg(F.count("*").alias("grams"), F.sum("n").alias("n")).collect()
    room, least = BITS // BITS_PER_ITEM, 1
    while sum(r["grams"] * max(0, r["level"] - least + 1) for r in by_level) > room:
        least += 1
    words = [r for r in by_level if r["word"]]
    total, kinds = sum(r["n"] for r in words), sum(r["grams"] for r in words)
    # the n-grams below the least level, so that a text asks the join for those only; where many crowd this filter, it asks for more
    below = build_filter(counts.where(F.col("level") < least).select("gram", F.lit(1).alias("level")), 1) if least > 1 else None
    return counts, {"filter": build_filter(counts, least), "least": least, "below": below, "tokens": total, "kinds": kinds}


def filter_levels(model: dict, grams: np.ndarray) -> np.ndarray:
    distinct, back = np.unique(grams, return_inverse=True)
    return levels(model["filter"], distinct, model["least"])[back]


def text_scores(model: dict, word: np.ndarray, pair: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """log10 probability of every text from the levels of its tokens and of the pairs that end there."""
    mean = np.concatenate([[0.0], [(2.0 ** (k - 1) + 2.0**k - 1) / 2 for k in range(1, MAX_LEVEL)]])
    if len(firsts) < 2:
        return np.zeros(0)
    word = mean[word]
    single = (np.where(word > 0, word, 0.1) + 0.1) / (model["tokens"] + 0.1 * (model["kinds"] + 1))
    before = np.concatenate([[0.0], word[:-1]])
    chance = (np.minimum(mean[pair], before) + STRENGTH * single) / (before + STRENGTH)
    chance[firsts[:-1]] = single[firsts[:-1]]  # no token before
    return np.add.reduceat(np.log10(chance), firsts[:-1])


def with_missed_levels(read: DataFrame, counts: DataFrame, model: dict) -> DataFrame:
    """``read`` with the score of every row: levels below the filter's least are joined to the places that asked for them."""
    asked = read.select("key", F.explode("asked").alias("a")).select("key", "a.at", "a.gram")
    below = counts.where(F.col("level") < model["least"]).select("gram", F.col("level").cast("tinyint").alias("level"))
    found = asked.join(below.hint("merge"), "gram").groupBy(F.col("key").alias("_k")).agg(F.collect_list(F.struct("at", "level")).alias("found"))
    joined = read.drop("asked").join(found, F.col("key") == F.col("_k"), "left").drop("_k")
    shared = read.sparkSession.sparkContext.broadcast({k: model[k] for k in ("tokens", "kinds")})
    keep = [c for c in joined.columns if c not in ("levels", "found", "score")]
    kinds = dict(joined.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "levels"):
                stored, found = part.column("levels"), part.column("found")
                firsts = np.concatenate([[0], np.cumsum(pc.binary_length(stored).to_numpy())])
                level = np.frombuffer(b"".join(stored.to_pylist()), np.uint8).copy()
                places = pc.list_flatten(found)
                at = np.repeat(firsts[:-1], pc.fill_null(pc.list_value_length(found), 0).to_numpy()) + pc.struct_field(places, "at").to_numpy()
                level[at] = pc.struct_field(places, "level").to_numpy().astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(text_scores(shared.value, level[0::2], level[1::2], firsts // 2))], [*keep, "score"])

    return joined.select(*keep, "levels", "found").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", score double")


def score(docs: DataFrame, counts: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """Kept columns as struct ``row``, n_tokens, n_known, base_score and score."""
    spark = docs.sparkSession
    total = max(1, model["tokens"])
    words = counts.where(F.col("gram") < 0).select("gram", "n")
    often = words.where(F.col("n") * FREQUENT >= total).orderBy("gram").toArrow()  # at most FREQUENT rows, since their counts add up to the total
    shared = spark.sparkContext.broadcast((model, often.column("gram").to_numpy(), often.column("n").to_numpy()))
    scale = float(np.log10(model["tokens"] + 0.1 * (model["kinds"] + 1)))
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("t"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, grams, counted = shared.value
        for batch in batches:
            for part in slices(batch, "t"):
                found, firsts = tokens(part.column(1))
                code = found.view(np.int64)
                at = np.minimum(np.searchsorted(grams, code), max(0, len(grams) - 1))
                common = grams[at] == code if len(grams) else np.zeros(len(code), bool)
                share = np.where(common, np.log10((counted[at] if len(grams) else 0) + 0.1) - scale, 0.0)
                sums = lambda x: np.add.reduceat(x, firsts[:-1])
                rare = ~common
                cuts = np.concatenate([[0], np.cumsum(sums(rare.astype(np.int64)))])
                two = pairs(found, firsts)
                level = np.zeros((len(found), 2), np.uint8)  # of the token, of its pair
                level[:, 0], level[:, 1] = filter_levels(model, found), np.where(two != 0, filter_levels(model, two), 0)
                columns = [part.column(0), pa.array(np.diff(firsts)), pa.array(sums(common.astype(np.int64))), pa.array(sums(share)),
                           pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(code[rare]))]
                if whole:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(text_scores(model, level[:, 0], level[:, 1], firsts))], [*names, "score"])
                    continue
                # a common token's count is here; the other tokens and pairs that the filter does not hold are asked for
                here = common & (level[:, 0] == 0)
                level[here, 0] = np.frexp(counted[at[here]].astype(float))[1]  # 1 + floor(log2 n)
                missed, asking = (level == 0) & np.stack([rare, two != 0], axis=1), np.stack([found, two], axis=1)
                missed[missed] = levels(model["below"], asking[missed], 1) > 0
                place = np.arange(2 * len(found)).reshape(-1, 2) - 2 * np.repeat(firsts[:-1], np.diff(firsts))[:, None]
                asked = np.concatenate([[0], np.cumsum(sums(missed.sum(1)))])
                wanted = pa.StructArray.from_arrays([pa.array(place[missed].astype(np.int32)), pa.array(asking[missed].view(np.int64))], ["at", "gram"])
                stored = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((2 * firsts).astype(np.int32)), pa.py_buffer(level)])
                yield pa.RecordBatch.from_arrays([*columns, stored, pa.ListArray.from_arrays(pa.array(asked, pa.int32()), wanted)], [*names, "levels", "asked"])

    names, whole = ["row", "n_tokens", "common", "share", "rare"], model["least"] == 1
    more = "score double" if whole else "levels binary, asked array<struct<at:int,gram:long>>"
    read = rows.mapInArrow(run, f"row {kind}, n_tokens long, common long, share double, rare array<long>, {more}")
    read = materialize(read.withColumn("key", F.monotonically_increasing_id()), "scored")
    single = read.select("key", F.explode("rare").alias("gram")).groupBy("key", "gram").agg(F.count("*").alias("times"))
    known = single.join(words.where(F.col("n") * FREQUENT < total), "gram", "left")
    tail = known.groupBy(F.col("key").alias("k")).agg(
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 0.1) - scale)).alias("tail"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("seen")
    )
    scored = read.drop("rare") if whole else with_missed_levels(read.drop("rare"), counts, model)
    out = scored.join(tail, F.col("key") == F.col("k"), "left")
    zero = F.lit(0).cast("long")
    return out.select("row", "n_tokens", (F.col("common") + F.coalesce("seen", zero)).alias("n_known"), (F.col("share") + F.coalesce("tail", F.lit(0.0))).alias("base_score"), "score")


def query(spark, folder: str) -> DataFrame:
    """op2: scores of every document, learned from the rows outside the held-out fold."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    counts, model = train(docs.where(fold(F.col("doc_id"), 10) != 0))
    out = score(docs, counts, model, ["doc_id"])
    return out.select("row.doc_id", (fold(F.col("row.doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
