"""Phrase mining against counts in plain Python, with tries that burst and spill at every size."""

import collections
import re

import pytest

from parcelworks.llm import phrases

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    """(lang, words) -> occurrences, for phrases of one to three words."""
    out = collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            out.update((lang or "und", tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    return out


def brute(rows, top=2000):
    f, out = counted(rows), []
    for lang in {g for g, _ in f}:
        n = sum(c for (g, p), c in f.items() if g == lang and len(p) == 1)
        cands = {p: a for (g, p), a in f.items() if g == lang and len(p) > 1 and a >= 10}
        longest = collections.Counter()
        for p, a in cands.items():
            if len(p) == 3:
                longest[p[:2]], longest[p[1:]] = max(longest[p[:2]], a), max(longest[p[1:]], a)
        kept = []
        for p, a in cands.items():
            if longest[p] and 100 * longest[p] >= 50 * a:
                continue
            score, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return out


@pytest.fixture(scope="module")
def wordy(spark):
    """Few words, so that every phrase is frequent, with all marks, ties, repeated rows and odd bytes."""
    letters = ["a", "B", "c", "é", "日本", "\x00", "\x1f", "_", "\xa0"]
    marks = [" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\x0b", "\x0c", "\r", " : ", "!?", "; "]
    state, texts = 7, []
    for k in range(60):
        out = []
        for _ in range(k * 3):
            state = (state * 1103515245 + 12345) % 2**31
            out += [letters[(state >> 8) % len(letters)], marks[(state >> 16) % len(marks)]]
        texts.append("".join(out))
    rows = [(["en", None, "und", "fr"][i % 4], t) for i, t in enumerate(texts + texts[:20] + [None, ""])]
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, text string, prefix int, words string, n int").repartition(3)


@pytest.mark.parametrize(("entries", "burst"), [(1 << 20, 1 << 14), (50, 4), (1, 1)])
def test_counts(spark, wordy, entries, burst):
    rows = [(r.lang, r.text) for r in wordy.collect()]
    expected = {(g, " ".join(p)): n for (g, p), n in counted(rows).items() if len(p) == 1 or n >= 10}
    found = phrases.count_phrases(wordy, entries=entries, burst=burst).collect()
    assert {(r.lang, r.phrase): r.n for r in found} == expected
    assert len(found) == len(expected) and all(r.size == len(r.phrase.split(" ")) for r in found)


def test_chunks_and_vocabulary():
    """Texts cut anywhere, words forgotten in the middle of a text: the same windows."""
    text = b" ".join(b"w%d" % (i * i % 37) + (b"." if i % 11 == 0 else b"") for i in range(4000))
    expected = counted([("x", text.decode())])
    chunk, phrases.CHUNK = phrases.CHUNK, 100
    try:
        trie = phrases.HatTrie(5, entries=100, burst=10, vocabulary=10)
        cut = b"".join(phrases.chunks(text, 100))
        runs = [*trie.add("x", [text]), *trie.spill(0)]
    finally:
        phrases.CHUNK = chunk
    assert cut == text
    groups = collections.defaultdict(lambda: phrases.Merge(step=7))
    for _, prefix, *run in runs:
        groups[prefix].add(*run)
    found = collections.Counter()
    for g in groups.values():
        for _, p, n in zip(*g.phrases(1), strict=True):
            found["x", tuple(p.decode().split(" "))] += n
    assert found == expected


@pytest.mark.parametrize("folder", ["edges", SF])
def test_query(spark, docs_folder, folder):
    folder = docs_folder if folder == "edges" else folder
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("lang", "text").collect()]
    assert sorted(tuple(r) for r in phrases.query(spark, folder).collect()) == sorted(brute(rows))


def test_ranking(spark, wordy):
    rows = [(r.lang, r.text) for r in wordy.collect()]
    found = phrases.collocations(phrases.count_phrases(wordy), top=15)
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(rows, 15))


def test_exact_beyond_64_bits(spark):
    big = 3_000_000_000_007
    counts = spark.createDataFrame([("x", 1, "a", big), ("x", 1, "b", big + 4), ("x", 2, "a b", big - 10)], "lang string, size int, phrase string, n long")
    (row,) = phrases.collocations(counts).collect()
    assert row.score == 1_000_000 * (big - 10) ** 2 // (big * (big + 4))
