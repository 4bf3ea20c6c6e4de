"""Phrase collocation mining by HAT-trie counting.

Every task reads its texts into a shallow trie of word ids with hash containers at its ends: under a language and a prefix partition,
hash containers count (first, second, third word); a container that holds ``BURST`` entries bursts into ``SPREAD`` ones, each for a part of the
first words, and these in turn by the second words. A container is a pair of arrays, into which a whole batch is probed at once. An entry is a window of three words, its end filled up at the end of a piece, so each place in a text is counted once:
the counts of one and two words are sums below a node.

If a trie holds more than ``ENTRIES`` entries, whole subtrees, those of the largest prefix partitions first, are spilled as sorted runs: the run's
words in order, and for each node its children and counts as packed arrays. A prefix partition is a hash of the first two words, so a frequent
word is spread over all of them. The runs of one (language, partition) are merged in one place, in bounded steps: what is held there are its
distinct entries. Only phrases with at least ``LEAST`` occurrences leave the merge; no part of such a phrase is rarer than the phrase.

Scores are Spark SQL on exact decimals: counts below 10^16.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count each; words never reach over the marks
``.,;:!?`` and line ends; texts of any length are read in chunks, whole; equal scores are ordered by count, then phrase; an empty table gives no
rows; other columns are never read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelworks.llm.kernel import mix, slices
from parcelworks.session import materialize

LEAST = 10
TOP = 2000
BURST = 1 << 16
#: Children of a container that has burst.
SPREAD = 16
ENTRIES = 1 << 21
VOCABULARY = 1 << 20
CHUNK = 1 << 20
#: Prefix partitions for each shuffle partition.
FACTOR = 1
_MARK = b"."
#: A-Z to a-z, tab to blank, and every mark to the one mark, which is no word.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 9)
_SHIFT, _LOW = 21, (1 << 21) - 1
_NAMES = ["lang", "prefix", "words", "first", "second", "third", "seconds", "thirds", "counts"]
_RUN = "lang string, prefix int, words binary, first binary, second binary, third binary, seconds binary, thirds binary, counts binary"


def chunks(text: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, cut at blanks and marks, so that words stay whole."""
    begin = 0
    while begin < len(text):
        end = begin + size
        if end < len(text):
            found = re.compile(rb"[ .]").search(text, end)
            end = found.end() if found else len(text)
        yield text[begin:end]
        begin = end


class Container:
    """A hash table of packed windows with open addressing; a whole array of them is added in a few rounds of probes."""

    __slots__ = ("keys", "counts", "size")

    def __init__(self, slots: int = 64):
        self.keys, self.counts, self.size = np.zeros(slots, np.int64), np.zeros(slots, np.int32), 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct windows; no window is packed as 0."""
        slots = len(self.keys)
        while 3 * (self.size + len(keys)) > 2 * slots:
            slots *= 2
        if slots > len(self.keys):
            old = np.flatnonzero(self.keys)
            known, n = self.keys[old], self.counts[old]
            self.__init__(slots)
            self._probe(known, n)
        self._probe(keys, counts)

    def _probe(self, keys: np.ndarray, counts: np.ndarray) -> None:
        mask = len(self.keys) - 1
        at = (mix(keys.view(np.uint64)) & np.uint64(mask)).astype(np.int64)
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]  # of several for one slot one stays
            mine = self.keys[at] == keys
            self.size += int((free & mine).sum())
            self.counts[at[mine]] += counts[mine].astype(np.int32)
            keys, counts, at = keys[~mine], counts[~mine], (at[~mine] + 1) & mask


class Node:
    """A container, or, once that has burst, ``SPREAD`` nodes for parts of the first words, and below these for parts of the second words."""

    __slots__ = ("children", "container", "depth")

    def __init__(self, depth: int = 0):
        self.depth, self.container, self.children = depth, Container(), None

    def put(self, keys: np.ndarray, counts: np.ndarray, burst: int) -> None:
        if self.children is None:
            self.container.add(keys, counts)
            if self.container.size > burst and self.depth < 2:
                held, n = self.entries()
                self.children, self.container = [Node(self.depth + 1) for _ in range(SPREAD)], None
                self._deal(held, n, burst)
        else:
            self._deal(keys, counts, burst)

    def _deal(self, keys: np.ndarray, counts: np.ndarray, burst: int) -> None:
        part = (keys >> _SHIFT * (2 - self.depth)) % SPREAD
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(SPREAD + 1))
        for child, begin, end in zip(self.children, cuts, cuts[1:]):
            if end > begin:
                child.put(keys[order[begin:end]], counts[order[begin:end]], burst)

    def __len__(self) -> int:
        return self.container.size if self.children is None else sum(map(len, self.children))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """All windows below, and their counts."""
        if self.children is None:
            at = np.flatnonzero(self.container.keys)
            return self.container.keys[at], self.container.counts[at]
        return tuple(np.concatenate(x) for x in zip(*(c.entries() for c in self.children), strict=True))


def _pack(values: np.ndarray) -> bytes:
    """The values in the smallest unsigned type, whose width comes first."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where each run of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


class HatTrie:
    """Counts of three-word windows of one task, by language and prefix partition."""

    def __init__(self, partitions: int, entries: int = ENTRIES, burst: int = BURST, vocabulary: int = VOCABULARY):
        self.partitions, self.entries, self.burst, self.most = partitions, entries, burst, vocabulary
        self._reset()

    def _reset(self) -> None:
        self.ids: dict = defaultdict(count().__next__)
        _ = self.ids[_MARK]  # id 0 fills up the windows at the end of a piece
        self.prints, self.held = np.zeros(1, np.uint64), 0
        self.roots: dict[tuple[str, int], Node] = {}
        self.sizes: dict[tuple[str, int], int] = {}

    def _word_prints(self) -> np.ndarray:
        """Hash of each word; the same word has the same one in every task."""
        if len(self.prints) < len(self.ids):
            new = list(islice(self.ids, len(self.prints), None))
            sizes = np.array([len(w) for w in new])
            begins = np.cumsum(sizes) - sizes
            letters = np.frombuffer(b"".join(new), np.uint8).astype(np.uint64)
            at = (np.arange(len(letters)) - np.repeat(begins, sizes)).astype(np.uint64)
            self.prints = np.concatenate([self.prints, np.add.reduceat(mix(letters + (at << np.uint64(8)) + np.uint64(1)), begins)])
        return self.prints

    def add(self, lang: str, texts: list[bytes | None]) -> Iterator[tuple]:
        """Count the windows of texts of one language; yields the runs that had to be spilled."""
        held, many = [], 0
        for text in texts:
            for part in chunks((text or b"").translate(_TABLE)):
                tokens = part.replace(_MARK, b" . ").split()
                held.append(np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens)))
                many += len(tokens)
                if many >= 1 << 19:
                    ids = np.concatenate(held)
                    yield from self._insert(lang, ids)
                    rest = ids[-2:]
                    if len(self.ids) > self.most:
                        words = list(self.ids)
                        yield from self.spill(0)
                        rest = np.array([self.ids[words[i]] for i in rest], np.int64)
                    held, many = [rest], 0
            held.append(np.zeros(1, np.int64))
        yield from self._insert(lang, np.concatenate([*held, np.zeros(2, np.int64)]))
        if len(self.ids) > self.most:
            yield from self.spill(0)

    def _insert(self, lang: str, ids: np.ndarray) -> Iterator[tuple]:
        """Count the windows that begin at all but the last two places."""
        first, second, third = ids[:-2], ids[1:-1], ids[2:]
        third = np.where(second == 0, 0, third)
        keys, counts = np.unique(((first << 2 * _SHIFT) | (second << _SHIFT) | third)[first != 0], return_counts=True)
        if not len(keys):
            return
        prints = self._word_prints()
        prefix = (mix(prints[keys >> 2 * _SHIFT] * np.uint64(0x9E3779B97F4A7C15) + prints[(keys >> _SHIFT) & _LOW]) >> np.uint64(33)).astype(np.int64) % self.partitions
        order = np.argsort(prefix, kind="stable")
        keys, counts, prefix = keys[order], counts[order], prefix[order]
        begins = _changes(prefix)
        for begin, end in zip(begins, [*begins[1:], len(keys)], strict=True):
            root = (lang, int(prefix[begin]))
            if root not in self.roots:
                self.roots[root] = Node()
            before = self.sizes.get(root, 0)
            self.roots[root].put(keys[begin:end], counts[begin:end], self.burst)
            self.sizes[root] = len(self.roots[root])
            self.held += self.sizes[root] - before
        if self.held > self.entries:
            yield from self.spill(self.entries // 2)

    def spill(self, leave: int) -> Iterator[tuple]:
        """Runs of whole subtrees, the largest first, until at most ``leave`` entries are left; with 0 the words are forgotten too."""
        words = list(self.ids)
        by_word = sorted(range(len(words)), key=words.__getitem__)
        rank = np.empty(len(words), np.int64)
        rank[by_word] = np.arange(len(words))
        ordered = [words[i] for i in by_word]
        for root in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.held <= leave:
                break
            self.held -= self.sizes.pop(root)
            yield (*root, *self._run(self.roots.pop(root), rank, ordered))
        if not leave:
            self._reset()

    def _run(self, node: Node, rank: np.ndarray, ordered: list[bytes]) -> tuple:
        """A subtree as a sorted run: its words, and for each level the nodes with the number of their children."""
        keys, counts = node.entries()
        first, second, third = rank[keys >> 2 * _SHIFT], rank[(keys >> _SHIFT) & _LOW], rank[keys & _LOW]
        order = np.argsort((first << 2 * _SHIFT) | (second << _SHIFT) | third)
        first, second, third, counts = first[order], second[order], third[order], counts[order]
        present = np.zeros(len(ordered), bool)
        for column in (first, second, third):
            present[column] = True
        used = np.flatnonzero(present)
        local = np.cumsum(present) - 1
        ones, twos = _changes(first), _changes(first, second)
        seconds, thirds = np.diff(np.append(np.searchsorted(twos, ones), len(twos))), np.diff(np.append(twos, len(keys)))
        return (b" ".join([ordered[i] for i in used.tolist()]), *map(_pack, (local[first[ones]], local[second[twos]], local[third], seconds, thirds, counts)))


class Merge:
    """Runs of one prefix partition of a language, summed in steps."""

    def __init__(self, step: int = 1 << 19):
        self.step, self.ids, self.pending, self.many = step, {_MARK: 0}, [], 0
        self.merged = np.zeros((4, 0), np.int64)

    def add(self, words: bytes, first: bytes, second: bytes, third: bytes, seconds: bytes, thirds: bytes, counts: bytes) -> None:
        gid = np.array([self.ids.setdefault(w, len(self.ids)) for w in words.split(b" ")], np.int64)
        ones, twos, threes, seconds, thirds, counts = map(_unpack, (first, second, third, seconds, thirds, counts))
        self.pending.append(np.stack([gid[np.repeat(np.repeat(ones, seconds), thirds)], gid[np.repeat(twos, thirds)], gid[threes], counts]))
        self.many += len(counts)
        if self.many > max(self.step, self.merged.shape[1]):
            self.compact()

    def compact(self) -> None:
        rows = np.concatenate([self.merged, *self.pending], 1)
        if len(self.ids) <= _LOW:
            order = np.argsort((rows[0] << 2 * _SHIFT) | (rows[1] << _SHIFT) | rows[2], kind="stable")
        else:
            order = np.lexsort((rows[2], rows[1], rows[0]))
        rows = rows[:, order]
        begins = _changes(*rows[:3]) if rows.shape[1] else np.zeros(0, np.int64)
        self.merged = np.concatenate([rows[:3, begins], np.add.reduceat(rows[3], begins)[None] if len(begins) else rows[3:]])
        self.pending, self.many = [], 0

    def phrases(self, least: int) -> tuple[list[int], list[bytes], list[int]]:
        """(size, phrase, count) of all phrases of two and three words with ``least`` occurrences, and the part of each word's count found here."""
        self.compact()
        words, (first, second, third, n) = list(self.ids), self.merged
        twos, ones = _changes(first, second), _changes(first)
        pair, single = np.add.reduceat(n, twos), np.add.reduceat(n, ones)
        three = np.flatnonzero((n >= least) & (third != 0))
        two = np.flatnonzero((pair >= least) & (second[twos] != 0))
        at = twos[two]
        found = [b" ".join((words[a], words[b], words[c])) for a, b, c in zip(first[three], second[three], third[three], strict=True)]
        found += [b" ".join((words[a], words[b])) for a, b in zip(first[at], second[at], strict=True)]
        found += [words[a] for a in first[ones]]
        return [3] * len(three) + [2] * len(two) + [1] * len(ones), found, [*n[three].tolist(), *pair[two].tolist(), *single.tolist()]


def count_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, entries: int = ENTRIES, burst: int = BURST) -> DataFrame:
    """(lang, size, phrase, n): all words, and the phrases of two and three words that occur ``least`` times or more."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("t")).where(F.length("t") > 0)

    def as_batch(runs: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), *[pa.binary()] * 7]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*runs, strict=True), kinds, strict=True)], _NAMES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, runs = HatTrie(parts * FACTOR, entries, burst), []
        for batch in batches:
            for part in slices(batch, "t"):
                for name in pc.unique(part.column(0)).to_pylist():
                    texts = part.column(1).filter(pc.equal(part.column(0), name)).cast(pa.large_binary()).to_pylist()
                    for run in trie.add(name, texts):
                        runs.append(run)
                        if len(runs) >= 256:
                            yield as_batch(runs)
                            runs = []
        for run in trie.spill(0):
            runs.append(run)
            if len(runs) >= 256:
                yield as_batch(runs)
                runs = []
        if runs:
            yield as_batch(runs)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> Iterator[pa.RecordBatch]:
            sizes, found, counts = group.phrases(least)
            for i in range(0, len(sizes), 1 << 16):
                words = pa.array(found[i : i + (1 << 16)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([at[0]] * len(words)), pa.array(sizes[i : i + (1 << 16)], pa.int32()), words, pa.array(counts[i : i + (1 << 16)], pa.int64())], ["lang", "size", "phrase", "n"])

        at, group = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                lang, prefix, *run = (c[k].as_py() for c in batch.columns)
                if (lang, prefix) != at:
                    if group:
                        yield from close()
                    at, group = (lang, prefix), Merge()
                group.add(*run)
        if group:
            yield from close()

    runs = rows.mapInArrow(read, _RUN).repartition(parts, "lang", "prefix").sortWithinPartitions("lang", "prefix")
    counted = runs.mapInArrow(merge, "lang string, size int, phrase string, n long")
    return counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def collocations(counts: DataFrame, least: int = LEAST, absorb: int = 50, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score; ``counts`` is a written table of ``count_phrases``."""
    words = counts.where(F.col("size") == 1).groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = counts.where(F.col("n") >= least)
    w = F.split("phrase", " ")
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
    joined = lambda *at: F.concat_ws(" ", *[F.get(w, i) for i in at])
    cuts = F.when(F.col("size") == 2, F.array(cut(1, joined(0), joined(1)))).otherwise(F.array(cut(1, joined(0), joined(1, 2)), cut(2, joined(0, 1), joined(2))))
    part = lambda name: frequent.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_phrase"), F.col("n").alias(name))
    both = frequent.where(F.col("size") > 1).select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(cuts).alias("cut"))
    both = both.join(part("l"), (F.col("lang") == F.col("l_lang")) & (F.col("cut.left") == F.col("l_phrase"))).join(part("r"), (F.col("lang") == F.col("r_lang")) & (F.col("cut.right") == F.col("r_phrase")))
    big = lambda c: F.col(c).cast("decimal(16,0)")
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (big("a") * big("a")), big("l") * big("r"))
    scored = both.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), F.col("cut.k").alias("k"), "l", "r")).alias("best"))

    longer = frequent.where(F.col("size") == 3).select("lang", F.explode(F.array(joined(0, 1), joined(1, 2))).alias("inside"), F.col("n").alias("f"))
    longest = longer.groupBy("lang", "inside").agg(F.max("f").alias("f")).withColumnRenamed("lang", "i_lang")
    met = scored.join(longest, (F.col("size") == 2) & (F.col("lang") == F.col("i_lang")) & (F.col("phrase") == F.col("inside")), "left")
    left = met.where(F.coalesce(100 * F.col("f") < absorb * F.col("a"), F.lit(True))).select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    # a language is cut into cells first, so that only the best of each are ordered together
    best = left.withColumn("cell", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("place", place("lang", "cell")).where(F.col("place") <= top)
    ranked = best.withColumn("rank", place("lang").cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, folder: str) -> DataFrame:
    """op12: the first 2,000 phrases of every language."""
    return collocations(materialize(count_phrases(spark.read.parquet(f"{folder}/documents.parquet")), "phrases"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), windows AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM w WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda p: p[1] || ' ' || p[2] || ' ' || p[3])) FROM w WHERE len(w) > 2
), f AS (
  SELECT lang, size, phrase, count(*) AS n FROM windows GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, phrase, size, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10
), cuts AS (
  SELECT *, 1 AS k, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM candidates UNION ALL SELECT *, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE size = 3
), scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, l.n AS l, r.n AS r, CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.lp JOIN f r ON r.lang = c.lang AND r.phrase = c.rp
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, inside, max(a) AS longest FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS inside FROM candidates WHERE size = 3) GROUP BY lang, inside
), kept AS (
  SELECT x.* FROM lowest x LEFT JOIN inside y ON x.size = 2 AND x.lang = y.lang AND x.phrase = y.inside WHERE y.longest IS NULL OR 100 * y.longest < 50 * x.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank, k.phrase, k.a, k.l, k.r, t.n, k.score FROM kept k JOIN totals t ON t.lang = k.lang
) WHERE rank <= 2000
"""
