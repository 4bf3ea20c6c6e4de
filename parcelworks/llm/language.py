"""Language ID by a convolutional network over bytes, trained here in numpy.

A window of ``WINDOW`` bytes goes through a byte embedding, filters of several widths, max pooling over the window and a softmax.
Every text is cut into such windows from end to end; its languages' log-odds are the windows' means, weighted by their letters.
ASCII characters that are no letters count as blanks and A-Z as a-z, so digits and symbols tell nothing.

Training takes a bounded sample of the labelled rows: ``SAMPLE`` windows for each language, picked by hashes of the id. It is the only part
with a bound; every language is learned. Sums run in a fixed order, so the same rows give the same weights.

Defined cases: a letter is a character of the Unicode category L; a null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing was learned; rows are
judged each, also repeated ones; texts of any length are read whole; an empty table gives no rows; a null id counts as the empty text
in the fold; other columns pass through inside ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelworks.llm.kernel import slices, text_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 24
EMBEDDING = 8
SAMPLE = 1200
EPOCHS = 6
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Rows of a language that are ordered for its sample, as a multiple of it; so no task orders all its rows.
SPARE = 3


def _classes() -> np.ndarray:
    table = np.arange(256)
    table[:128] = 0x20
    for upper in range(ord("A"), ord("Z") + 1):
        table[upper] = table[upper + 32] = upper + 32
    return table


_CLASS = _classes()


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts as rows of byte classes, and the text of each; the last one is filled up with blanks."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    begin = offsets[:-1][owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
    at = begin[:, None] + np.arange(WINDOW)
    rows = _CLASS[data[np.minimum(at, max(len(data) - 1, 0))]] if len(data) else np.zeros(at.shape, np.int64)
    rows[at >= offsets[1:][owner][:, None]] = 0x20
    return rows, owner


class ByteNetwork:
    """Weights as plain arrays, so that the trained network travels with the task."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), "bias": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _pooled(self, rows: np.ndarray) -> tuple[np.ndarray, dict]:
        x = self.p["e"][rows]
        best, at = [], {}
        for w in WIDTHS:
            kernel, steps = self.p[f"w{w}"].reshape(w, EMBEDDING, FILTERS), WINDOW - w + 1
            z = x[:, :steps] @ kernel[0]
            for k in range(1, w):
                z += x[:, k : k + steps] @ kernel[k]
            at[w] = z.argmax(1)
            best.append(np.take_along_axis(z, at[w][:, None, :], 1)[:, 0] + self.p[f"b{w}"])
        return np.concatenate(best, 1), at

    def logits(self, rows: np.ndarray) -> np.ndarray:
        parts = [np.maximum(self._pooled(rows[i : i + 256])[0], 0) @ self.p["out"] + self.p["bias"] for i in range(0, len(rows), 256)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def _gradients(self, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Only the pooled positions have a gradient, so the backward pass gathers just their bytes."""
        pooled, at = self._pooled(rows)
        active = np.maximum(pooled, 0)
        scores = active @ self.p["out"] + self.p["bias"]
        odds = np.exp(scores - scores.max(1, keepdims=True))
        odds /= odds.sum(1, keepdims=True)
        odds[np.arange(len(rows)), labels] -= 1
        odds /= len(rows)
        g = {"out": active.T @ odds, "bias": odds.sum(0), "e": np.zeros_like(self.p["e"])}
        back = (odds @ self.p["out"].T) * (pooled > 0)
        for i, w in enumerate(WIDTHS):
            d = back[:, i * FILTERS : (i + 1) * FILTERS]
            chosen = rows[np.arange(len(rows))[:, None, None], at[w][:, :, None] + np.arange(w)]
            patch = self.p["e"][chosen].reshape(len(rows), FILTERS, -1)
            g[f"w{w}"] = np.einsum("nf,nfk->kf", d, patch)
            g[f"b{w}"] = d.sum(0)
            to_bytes = d[:, :, None, None] * self.p[f"w{w}"].T.reshape(1, FILTERS, w, EMBEDDING)
            np.add.at(g["e"], chosen.ravel(), to_bytes.reshape(-1, EMBEDDING))
        return g

    def train(self, rows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 64) -> ByteNetwork:
        rng, step = np.random.default_rng(11), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(rows), batch):
                step += 1
                for k, g in self._gradients(rows[order[i : i + batch]], labels[order[i : i + batch]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> ByteNetwork | None:
    """Network for the languages of ``labelled``; null if there is no labelled text with a letter.

    A sampled row is one window of ``WINDOW`` characters at a place given by the hash, so at most ``sample`` windows of each language reach the driver.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    code = F.xxhash64(F.col(doc_id).cast("string"), F.substring(F.col(text), 1, 64))
    start = F.pmod(code, F.greatest(F.lit(1), F.length(F.col(text)) - WINDOW + 1)) + 1
    piece = F.substring(F.col(text), start.cast("int"), F.lit(WINDOW))
    coded = rows.select(F.col(lang).alias("l"), code.alias("c"), piece.alias("t"))
    # one row for each language, all of which the network holds as well; about SPARE times the sample is left to be ordered
    sizes = F.broadcast(coded.groupBy("l").agg(F.count("*").alias("n")))
    thinned = coded.join(sizes, "l").where(F.pmod(F.xxhash64("c"), F.col("n")) < SPARE * sample)
    first = F.row_number().over(W.partitionBy("l").orderBy("c", "t"))
    picked = sorted((r["c"], r["l"], r["t"]) for r in thinned.withColumn("r", first).where(F.col("r") <= sample).select("c", "l", "t").collect())
    if not picked:
        return None
    names = sorted({lab for _, lab, _ in picked})
    data, offsets = text_bytes(pa.array([t for _, _, t in picked]))
    x, owner = windows(data, offsets)
    return ByteNetwork(names).train(x, np.array([names.index(lab) for _, lab, _ in picked])[owner])


def _judge(network: ByteNetwork, column: pa.Array) -> tuple[list[str], list[float]]:
    data, offsets = text_bytes(column)
    rows, owner = windows(data, offsets)
    letters = (rows != 0x20).sum(1)
    sums, weight = np.zeros((len(column), len(network.languages))), np.zeros(len(column))
    np.add.at(sums, owner, network.logits(rows) * letters[:, None])
    np.add.at(weight, owner, letters)
    mean = sums / np.maximum(weight, 1)[:, None]
    odds = np.exp(mean - mean.max(1, keepdims=True))
    odds /= odds.sum(1, keepdims=True)
    best = odds.argmax(1)
    known = [t is not None and _LETTER.search(t) is not None for t in column.to_pylist()]
    return [network.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], [float(o[b]) if k else 0.0 for o, b, k in zip(odds, best, known, strict=True)]


def detect(docs: DataFrame, network: ByteNetwork | None, keep: list[str], text: str = "text") -> DataFrame:
    """Kept columns as struct ``row``, lang_pred, score."""
    rows = docs.select(F.struct(*keep).alias("row"), *([] if text in keep else [F.col(text).alias("t")]))
    if network is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(text) if text in keep else batch.column(1)  # a text that is kept travels once
            for part in slices(pa.RecordBatch.from_arrays([batch.column(0), texts], ["row", "t"]), "t"):
                names, scores = _judge(network, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    return rows.mapInArrow(label, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def query(spark, folder: str) -> DataFrame:
    """op10: language of every document, learned from the rows outside the held-out fold."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    network = train(docs.where(fold(F.col("doc_id"), 5) != 0))
    out = detect(docs, network, ["doc_id"])
    return out.select("row.doc_id", (fold(F.col("row.doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def stage(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """Documents whose language is recognised, with their own columns."""
    found = detect(docs, train(docs), docs.columns)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
