"""SentencePiece encoding and decoding: the best segmentation into pieces of a given model, by max-plus algebra.

A text is normalised as the model's files are meant: blanks become ``▁``, one is put in front. Its encoding is the sequence of pieces with
the greatest sum of the scores in the model file (the unigram lattice; characters without a piece cost more than any piece and become
byte pieces). No piece crosses the begin of a word, so words are segmented once for each batch, all of one length together.

A giant document is cut into chunks of ``CHUNK`` characters at any place. The state at a boundary is how far the piece that crosses it
reaches. Each chunk yields its transfer matrix, best score from entry state to exit state; matrices are combined associatively from the
end by a doubling scan in the (max, +) algebra; from the best scores to the end follows each boundary's state, and then every chunk is
traced back on its own between its two states. Only matrices of one document meet in a task, 2 KB for each chunk.

Defined cases: a null or empty text has no pieces; repeated rows are encoded each; texts of any length are encoded whole; a ``▁`` in a text
decodes to a blank, as the model has it; among equally good segmentations any one; an empty table gives no rows; other columns pass
through inside ``row``. The model's path is a parameter; the file is read on the driver, its pieces (a fixed list) travel to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.kernel import slices
from parcelworks.session import materialize

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 131072
#: (Word, place) cells of a block that is segmented together; one takes about 34 bytes.
CELLS = 1 << 19
#: Words and pieces that a task keeps at most.
KEPT_WORDS, KEPT_PIECES = 200_000, 4_000_000
BLANK = "▁"
UNKNOWN_PENALTY = 10.0
_ROOT = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_NONE = -np.inf
#: A word begins at a blank after something else; no piece reaches over such a place.
_WORD_END = re.compile(f"(?<=[^{BLANK}]){BLANK}")
_WORD = re.compile(f"{BLANK}+[^{BLANK}]*")


class Pieces:
    """The model's pieces with scores, and a hash table for whole arrays of substrings."""

    def __init__(self, names: list[str], scores: list[float], normal: list[bool], byte: list[bool]):
        self.names, self.byte = names, byte
        self.spelled = [bytes([int(n[3:5], 16)]) if byte[i] else n.encode() for i, n in enumerate(names)]
        self.byte_ids = {int(n[3:5], 16): i for i, n in enumerate(names) if byte[i]}
        self.table = {n: (i, s) for i, (n, s, ok) in enumerate(zip(names, scores, normal, strict=True)) if ok}
        self.unknown = min((s for _, s in self.table.values()), default=0.0) - UNKNOWN_PENALTY
        if crossing := [n for n in self.table if _WORD_END.search(n)]:
            raise ValueError(f"pieces that cross the begin of a word are not supported: {crossing[:3]}")
        self.longest = max(map(len, self.table), default=1)
        self.scores = np.array([self.table[n][1] if n in self.table else 0.0 for n in names])
        self.up = np.multiply.accumulate(np.array([1] + [_ROOT] * 4096, np.uint64))
        self.down = np.multiply.accumulate(np.array([1] + [pow(_ROOT, -1, 1 << 64)] * 4096, np.uint64))
        ids = np.array([i for i, _ in self.table.values()], np.int64)
        keys = np.array([sum((ord(c) + 1) * int(self.up[k]) for k, c in enumerate(n)) % (1 << 64) for n in self.table], np.uint64)
        self.keys = np.zeros(len(names) + 1, np.uint64)
        self.keys[ids] = keys
        self.likely = np.zeros(1 << 22, bool)
        self.likely[(keys * _SPREAD) >> np.uint64(42)] = True
        self.slots = []
        while len(ids):  # pieces that share a slot go to the next table
            slots = np.full(1 << 18, len(names), np.int32)
            at = self._slot(self.keys[ids], len(self.slots))
            slots[at] = ids
            self.slots.append(slots)
            ids = ids[slots[at] != ids]

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        byte = [model.is_byte(i) for i in every]
        return cls([model.id_to_piece(i) for i in every], [model.get_score(i) for i in every], [not (byte[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in every], byte)

    @staticmethod
    def _slot(keys: np.ndarray, table: int) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(46 - 7 * table)) & np.uint64((1 << 18) - 1)

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are pieces, and their ids. One table of bits sends most others away."""
        at = np.flatnonzero(self.likely[(keys * _SPREAD) >> np.uint64(42)])
        keys, out = keys[at], np.full(len(at), -1, np.int32)
        for k, slots in enumerate(self.slots):
            found = slots[self._slot(keys, k)]
            out = np.where((self.keys[found] == keys) & (found < len(self.names)), found, out)
        return at[out >= 0], out[out >= 0]

    def unknown_ids(self, character: str) -> list[int]:
        return [self.byte_ids.get(b, 0) for b in character.encode("utf-8", "replace")]

    def forward(self, text: str, entries: int, begin: int, stop: int) -> np.ndarray:
        """Best scores (position, entry state): entry r starts at begin + r; pieces begin before ``stop``."""
        best = np.full((len(text) + 1, entries), _NONE)
        for r in range(entries):
            if begin + r <= len(text):
                best[begin + r, r] = 0.0
        for i in range(begin, min(stop, len(text))):
            here = best[i]
            if not np.isfinite(here).any():
                continue
            found = False
            for size in range(1, min(self.longest, len(text) - i) + 1):
                piece = self.table.get(text[i : i + size])
                if piece:
                    found |= size == 1
                    np.maximum(best[i + size], here + piece[1], out=best[i + size])
                if size < len(text) - i and text[i + size] == BLANK != text[i + size - 1]:
                    break
            if not found:
                np.maximum(best[i + 1], here + self.unknown, out=best[i + 1])
        return best

    def trace(self, text: str, begin: int, stop: int, end: int) -> tuple[list[int], float]:
        """Ids and score of the best path from ``begin`` to ``end``, whose pieces begin before ``stop``."""
        best, back = [_NONE] * (len(text) + 1), [(0, -1)] * (len(text) + 1)
        best[begin] = 0.0
        for i in range(begin, min(stop, end)):
            if best[i] == _NONE:
                continue
            found = False
            for size in range(1, min(self.longest, end - i) + 1):
                piece = self.table.get(text[i : i + size])
                if piece:
                    found |= size == 1
                    if best[i] + piece[1] > best[i + size]:
                        best[i + size], back[i + size] = best[i] + piece[1], (i, piece[0])
            if not found and best[i] + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + self.unknown, (i, -1)
        ids, at = [], end
        while at > begin:
            i, piece = back[at]
            ids.append([piece] if piece >= 0 else self.unknown_ids(text[i]))
            at = i
        return [x for part in reversed(ids) for x in part], best[end]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids behind each other, where each word's begin, scores): all words of about one length go step by step together."""
        sizes = np.array([len(w) for w in words])
        ids: list = [None] * len(words)
        scores = np.zeros(len(words))
        for k in np.flatnonzero(sizes > 256):
            ids[k], scores[k] = self.trace(words[k], 0, sizes[k], sizes[k])
        order = np.argsort(-sizes, kind="stable")
        order = order[(sizes[order] <= 256) & (sizes[order] > 0)]
        begin = 0
        while begin < len(order):
            end = begin + max(1, min(1 << 15, CELLS // (int(sizes[order[begin]]) + 1)))
            self._step(words, sizes, order[begin:end], ids, scores)
            begin = end
        counts = np.array([0 if x is None else len(x) for x in ids])
        flat = np.concatenate([np.asarray(x, np.int32) for x in ids if x is not None]) if counts.any() else np.zeros(0, np.int32)
        return flat, np.concatenate([[0], np.cumsum(counts)]), scores

    def _step(self, words: list[str], sizes: np.ndarray, chosen: np.ndarray, ids: list, scores: np.ndarray) -> None:
        n, size = len(chosen), sizes[chosen]
        longest = int(size[0])
        characters = np.zeros((n, longest), np.uint32)
        characters[np.arange(longest) < size[:, None]] = np.frombuffer("".join(words[k] for k in chosen).encode("utf-32-le", "surrogatepass"), np.uint32)
        sums = np.zeros((longest + 1, n), np.uint64)
        np.cumsum((characters.T.astype(np.uint64) + np.uint64(1)) * self.up[:longest, None], axis=0, out=sums[1:])
        best, back, piece = np.full((longest + 1, n), _NONE), np.zeros((longest + 1, n), np.int16), np.full((longest + 1, n), -1, np.int32)
        best[0] = 0.0
        for j in range(1, longest + 1):
            live = int(np.searchsorted(-size, -j, "right"))
            top, length, which = best[j - 1, :live] + self.unknown, np.ones(live, np.int16), np.full(live, -1, np.int32)
            for w in range(1, min(self.longest, j) + 1):
                at, found = self.lookup((sums[j, :live] - sums[j - w, :live]) * self.down[j - w])
                value = best[j - w, at] + self.scores[found]
                better = (value > top[at]) | (w == 1)  # a character that is a piece is never unknown
                at, found, value = at[better], found[better], value[better]
                top[at], length[at], which[at] = value, w, found
            best[j, :live], back[j, :live], piece[j, :live] = top, length, which
        at, rows, steps = size.copy(), np.arange(n), []
        scores[chosen] = best[size, rows]
        while at.any():
            steps.append(np.where(at > 0, np.where(piece[at, rows] >= 0, piece[at, rows], -2 - characters[rows, np.maximum(at - 1, 0)].astype(np.int64)), -1))
            at = at - np.where(at > 0, back[at, rows], 0)
        path = np.stack(steps[::-1], 1)
        kept = path != -1
        for row, k in zip(np.split(path[kept], np.cumsum(kept.sum(1))[:-1]), chosen, strict=True):
            ids[k] = row
        for r in np.flatnonzero((path < -1).any(1)):
            ids[chosen[r]] = np.array([x for p in path[r][kept[r]] for x in ([p] if p >= 0 else self.unknown_ids(chr(-2 - p)))], np.int64)

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.spelled[i] for i in ids]).decode("utf-8", "replace").replace(BLANK, " ")[1:]


def normalise(text: str | None) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


class WordCache:
    """Segmented words of a task, kept from batch to batch; emptied when it holds ``KEPT_WORDS`` words or ``KEPT_PIECES`` pieces."""

    def __init__(self, pieces: Pieces, words: int = KEPT_WORDS, many: int = KEPT_PIECES):
        self.pieces, self.words, self.many, self.known = pieces, words, many, {}
        self.flat, self.begins, self.scores = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0)

    @staticmethod
    def _append(held: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
        """``held`` with ``new`` behind its first ``used`` values; it doubles when it is full."""
        if used + len(new) > len(held):
            held = np.concatenate([held[:used], np.zeros(used + len(new), held.dtype)])
        held[used : used + len(new)] = new
        return held

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[float]]:
        """Ids and scores of normalised texts."""
        if len(self.known) > self.words or self.begins[len(self.known)] > self.many:
            self.__init__(self.pieces, self.words, self.many)
        known, before = self.known, len(self.known)
        of = [np.array([known.setdefault(w, len(known)) for w in _WORD.findall(t)], np.int64) for t in texts]
        if len(known) > before:
            flat, begins, scores = self.pieces.words(list(islice(known, before, None)))
            used = int(self.begins[before])
            self.flat = self._append(self.flat, used, flat)
            self.begins, self.scores = self._append(self.begins, before + 1, begins[1:] + used), self._append(self.scores, before, scores)
        ids, sums = [], []
        for w in of:
            counts = self.begins[w + 1] - self.begins[w]
            ids.append(self.flat[np.repeat(self.begins[w] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())])
            sums.append(float(self.scores[w].sum()))
        return ids, sums


def _word_begins(text: str, begin: int, end: int) -> tuple[int, int]:
    """First and last begin of a word in [begin, end), -1 if there is none."""
    match = _WORD_END.search(text, begin, end)
    if not match:
        return -1, -1
    last = text.rfind(BLANK, begin, end)
    while text[last - 1] == BLANK:
        last -= 1
    return match.start(), last


def transfer(cache: WordCache, text: str, size: int, last: bool) -> np.ndarray:
    """Max-plus matrix (entry state, exit state) of a chunk: its first ``size`` characters, with what follows as far as a piece reaches."""
    pieces = cache.pieces
    states = pieces.longest
    out = np.full((states, states), _NONE)
    first, final = _word_begins(text, 0, size)

    def exits(best: np.ndarray) -> np.ndarray:  # (exit, entry); beyond the chunk's end only pieces that begin inside it arrive
        return np.stack([best[size + r] if size + r < len(best) and (r == 0 or not last) else np.full(best.shape[1], _NONE) for r in range(states)])

    if first < 0:
        return exits(pieces.forward(text, states, 0, size)).T
    head = pieces.forward(text[:first], states, 0, first)[first]
    middle = cache.encode([text[first:final]])[1][0] if final > first else 0.0
    tail = exits(np.concatenate([np.full((final, 1), _NONE), pieces.forward(text[final:], 1, 0, size - final)]))
    return np.maximum(out, head[:, None] + middle + tail[:, 0][None, :])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(-2)


def boundary_states(matrices: np.ndarray) -> tuple[np.ndarray, float]:
    """State at every boundary on a best path, and its score. The matrices' products to the end come from a doubling scan."""
    to_end, step = matrices.copy(), 1
    while step < len(to_end):
        left, right = to_end[:-step], to_end[step:]
        to_end[:-step] = np.concatenate([product(left[i : i + 256], right[i : i + 256]) for i in range(0, len(left), 256)])
        step *= 2
    states = [0]
    for k in range(len(matrices)):
        rest = to_end[k + 1][:, 0] if k + 1 < len(matrices) else np.where(np.arange(matrices.shape[1]) == 0, 0.0, _NONE)
        states.append(int((matrices[k][states[-1]] + rest).argmax()))
    return np.array(states), float(to_end[0][0, 0])


def encode(docs: DataFrame, keep: list[str], path: str = MODEL, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Kept columns as struct ``row``, ``ids`` and ``score``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Pieces.load(path))
    reach = shared.value.longest - 1
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("t"))
    kind = rows.schema["row"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(shared.value)
        for batch in batches:
            texts = batch.column(0).field(text) if text in keep else batch.column(1)  # a text that is kept travels once
            for part in slices(pa.RecordBatch.from_arrays([batch.column(0), texts], ["row", "t"]), "t"):
                ids, scores = cache.encode([normalise(t) for t in part.column(1).to_pylist()])
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat.astype(np.int32))), pa.array(scores, pa.float64())], ["row", "ids", "score"])

    below = rows.where(F.coalesce(F.length("t"), F.lit(0)) < chunk)
    short = (below.select("row") if text in keep else below).mapInArrow(whole, f"row {kind}, ids array<int>, score double")

    giant = materialize(rows.where(F.length("t") >= chunk).withColumn("key", F.monotonically_increasing_id()), "giants")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every giant text once, from its begin to its end."""
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = normalise(t.as_py())
                for no, begin in enumerate(range(0, len(body), chunk)):
                    columns = [[key], [no], [body[begin : begin + chunk + reach]], [min(chunk, len(body) - begin)], [begin + chunk >= len(body)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.bool_()), strict=True)], ["key", "no", "part", "size", "last"])

    pieced = giant.select("key", "t").mapInArrow(cut, "key long, no int, part string, size int, last boolean")
    chunks = materialize(pieced.repartition(parts, "key", "no"), "chunks")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordCache(shared.value)
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "no": pdf["no"], "matrix": [transfer(cache, r.part, r.size, r.last).tobytes() for r in pdf.itertuples()]})

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        states, score = boundary_states(np.stack([np.frombuffer(m).reshape(reach + 1, reach + 1) for m in pdf["matrix"]]))
        return pd.DataFrame({"key": pdf["key"], "no": pdf["no"], "enter": states[:-1], "leave": states[1:], "score": score})

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordCache(shared.value)
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "no": pdf["no"], "score": pdf["score"], "ids": [_trace_chunk(cache, r.part, r.size, r.enter, r.leave) for r in pdf.itertuples()]})

    states = chunks.mapInPandas(matrices, "key long, no int, matrix binary").groupBy("key").applyInPandas(scan, "key long, no int, enter int, leave int, score double")
    traced = chunks.join(states, ["key", "no"]).mapInPandas(back, "key long, no int, score double, ids array<int>")
    joined = traced.groupBy("key").agg(F.max("score").alias("score"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("no", "ids"))), lambda c: c["ids"])).alias("ids"))
    return short.unionByName(giant.select("key", "row").join(joined, "key").select("row", "ids", "score"))


def _trace_chunk(cache: WordCache, text: str, size: int, enter: int, leave: int) -> np.ndarray:
    """Ids of one chunk between its two boundary states."""
    pieces = cache.pieces
    end = size + leave
    first, final = _word_begins(text, enter, size)
    if first < 0:
        return np.array(pieces.trace(text, enter, size, end)[0], np.int32)
    head = pieces.trace(text, enter, first, first)[0]
    middle = cache.encode([text[first:final]])[0][0] if final > first else []
    return np.concatenate([head, middle, pieces.trace(text[final:], 0, size - final, end - final)[0]]).astype(np.int32)


def decode(encoded: DataFrame, path: str = MODEL, ids: str = "ids") -> DataFrame:
    """All columns and ``decoded``, the text of the ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(path))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            begins, flat, there = column.offsets.to_numpy(), column.values.to_numpy(), column.is_valid().to_pylist()
            # row by row: the ids of a whole batch as Python numbers would take hundreds of MB
            texts = [shared.value.decode(flat[begins[k] : begins[k + 1]].tolist()) if ok else None for k, ok in enumerate(there)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def query(spark, folder: str) -> DataFrame:
    """op7: pieces of every document, and whether decoding gives the text back."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = decode(encode(docs, ["doc_id", "text"]))
    same = F.coalesce("row.text", F.lit("")) == F.col("decoded")
    return out.select("row.doc_id", F.size("ids").cast("long").alias("n_pieces"), "score", F.xxhash64("ids").alias("ids_hash"), same.alias("round_trip"))
