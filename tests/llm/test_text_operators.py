"""Operators over documents: brute force on the edge cases, empty tables, and the pipeline."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from parcelworks.llm import language, licenses, lm, neardup, packing, pieces, pii, quality, queries

SPACE = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"
DOCUMENT_QUERIES = [q for q in queries.QUERIES if q not in ("op4_url_filter", "op6_exact_topk", "op13_embedding_neardup")]


def texts_of(spark, folder):
    """Rows by (doc_id, text), as often as they are there."""
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def held_out(doc_id, folds):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == 0


def same(rows, expected):
    assert collections.Counter(rows) == collections.Counter(expected)


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_empty_table(spark, empty_folder, name):
    assert queries.QUERIES[name](spark, empty_folder).count() == 0


@pytest.mark.parametrize("folder", ["edges", SF])
def test_pii_base(spark, docs_folder, folder):
    folder = docs_folder if folder == "edges" else folder
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def digest(text):
        spans = []
        for k, (kind, pattern) in enumerate(patterns.items()):
            for m in re.finditer(pattern, text):
                d = re.sub("[^0-9]", "", m[0])
                luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
                if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                    spans.append((m.start(), k, kind, m.end()))
        n = collections.Counter(s[2] for s in spans)
        return (*[n[k] for k in patterns], hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)).encode()).hexdigest())

    rows = pii.query(spark, folder).collect()
    same([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows], [(i, *digest(t)) for i, t in texts_of(spark, folder)])


def test_pii_spans():
    text = "mail x.y@h.example.org or 12 4111 1111 1111 1111 or +49 30 1234567 and 1.2.3.4, 1.2.3.400"
    assert [text[s:e] for s, e, _ in pii.base_spans(text)] == ["x.y@h.example.org", "+49 30 1234567", "1.2.3.4"]
    x, y, _ = pii.training_rows([text], 1)
    held_x, held_y, _ = pii.training_rows([text] * 30, 2)
    x, y, kinds = pii.training_rows(["some words before and after "] * 150, 3)
    model = pii.BoostedTrees().fit(x, y).calibrate(held_x, held_y)
    _, spans = pii.find_spans(text, model, dict.fromkeys(pii.KINDS, 0.5))
    assert "4111 1111 1111 1111" in [text[s:e] for s, e, _ in spans]
    assert ((model.probability(held_x) > 0.5) == (held_y > 0.5)).mean() > 0.9
    assert pii.redact_text("a b@c.de f", [(2, 8, "email")]) == "a [EMAIL] f"
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000) == []


class Even:
    """Every candidate is as likely as the others, but for those whose features say that they are longer."""

    def probability(self, x):
        return 0.6 + x[:, 4] / 1000


def test_pii_choice_in_any_order():
    """Against the plain rule: best first, nothing that overlaps a base span or a better one."""
    rng = random.Random(9)
    for _ in range(200):
        parts = ["bob (at) host (dot) com", "4111 1111 1111 1111 12", "555-123-4567", "+1 555 123 4567 89 12 34 56", "a@b.cd", "x", "1.2.3.4", "00 49 30 1234567 8"]
        text = rng.choice([" ", ""]).join(rng.choice(parts) for _ in range(rng.randrange(12)))
        base, spans = pii.find_spans(text, Even(), dict.fromkeys(pii.KINDS, 0.5))
        more = [c for c in pii.candidates(text) if all(c[1] <= a or c[0] >= b for a, b, _ in base)]
        order, want = sorted(range(len(more)), key=lambda k: -(0.6 + pii.features(text, more[k])[4] / 1000)), list(base)
        for k in order:
            if all(more[k][1] <= a or more[k][0] >= b for a, b, _ in want):
                want.append(more[k])
        assert sorted(spans) == sorted(want)


def test_pii_many_candidates_take_linear_time():
    import time

    def seconds(n):
        begin = time.perf_counter()
        pii.find_spans(" ".join(f"bob{k} (at) host (dot) com and a{k}@b.cd," for k in range(n)), Even(), dict.fromkeys(pii.KINDS, 0.5))
        return time.perf_counter() - begin

    seconds(500)
    assert seconds(16_000) < 16 * max(seconds(2_000), 0.02)


@pytest.mark.parametrize("folder", ["edges", SF])
def test_lm_base(spark, docs_folder, folder):
    folder = docs_folder if folder == "edges" else folder
    docs = [(i, [*SPACE.findall(t.translate(LOWER)), None]) for i, t in texts_of(spark, folder)]
    counts = collections.Counter(w for i, ws in docs if not held_out(i, 10) for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = lm.query(spark, folder).collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows],
         [(i, held_out(i, 10), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for i, ws in docs])
    assert all(r.score < 0 for r in rows)


def test_lm_filter_gives_levels_back(spark):
    rng = np.random.default_rng(3)
    grams, level = rng.integers(1, 2**47, 3000), rng.integers(1, 8, 3000)
    blocks = lm.build_filter(spark.createDataFrame([(int(g), int(k)) for g, k in zip(grams, level)], "gram long, level int"), 1)
    assert (lm.levels(blocks, grams.view(np.uint64), 1) >= level).all()
    assert (lm.levels(blocks, grams.view(np.uint64), 1) == level).mean() > 0.99
    assert (lm.levels(blocks, rng.integers(1, 2**47, 3000).view(np.uint64), 1) == 0).mean() > 0.99


def components_by_force(docs, width, percent):
    sets = []
    for _, t in docs:
        w = SPACE.findall(t.translate(LOWER))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(docs)]


@pytest.mark.parametrize("folder", ["edges", SF])
def test_neardup(spark, docs_folder, folder):
    folder = docs_folder if folder == "edges" else folder
    rows = neardup.query(spark, folder).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in rows], components_by_force(texts_of(spark, folder), 3, 85))
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_neardup_in_a_large_group(spark, monkeypatch):
    """A chain and a cloud of near copies around the threshold, in blocks of a few classes."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng, base = random.Random(4), [f"w{k}" for k in range(120)]
    docs = []
    for i in range(90):
        words = list(base)
        for k in rng.sample(range(120), rng.choice([1, 2, 3, 4, 6])):
            words[k] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    out = neardup.group(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"], 85, 3).collect()
    same([(r.id, r.n_shingles, r.component_id) for r in out], components_by_force(docs, 3, 85))


@pytest.mark.parametrize("folder", ["edges", SF])
def test_licenses(spark, docs_folder, folder):
    folder = docs_folder if folder == "edges" else folder

    def base(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(LOWER))
        places, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES:
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places, labels = places + at, labels | ({label} if at else set())
        return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))

    rows = licenses.query(spark, folder).collect()
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows], [(i, *base(t)) for i, t in texts_of(spark, folder)])
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 for r in rows)


def test_license_templates(spark):
    docs = [(1, "x y Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (2, "software copy person"), (3, None), (3, "This is Apache License. cc BY cc by-nc")]
    files, finds = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"])
    found = finds.join(files, finds["file"] == files["key"]).collect()
    same([(r.row.doc_id, r.label, r.start) for r in found if r.base], [(3, "apache", 2), (3, "cc-by", 4), (3, "cc-by", 6)])
    assert ("MIT", 2) in {(r.label, r.start) for r in found if r.row.doc_id == 1}


def test_license_with_altered_rare_word(spark):
    """A notice whose rarest word was reworded is found by its key phrase, in a file full of rarer licence words and though all files carry it."""
    notice = "Redistribution and use in source and binary forms, with or without modification, are permitted if the following conditions are met"
    others = "mozilla affero universal unencumbered isc cc0 nc sa domain"
    docs = [(k, f"{others} x{k} {notice}") for k in range(60)] + [(100 + k, "provided that" if k < 30 else "x") for k in range(400)]
    _, finds = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"])
    assert finds.where("label = 'BSD'").count() == 60


def test_license_anchor_is_mandatory():
    """Every template's anchor is one of its key words; without key words the anchors weigh more than a find may lack."""
    counts = {p[0]: 1 + k % 7 for k, p in enumerate(licenses.index())}
    for _, template, _, is_key, *_, anchor, _, _, _ in (lines := licenses._weighed(licenses.index(), counts, 100, 0.6)):
        assert is_key or not anchor or any(x[6] and x[3] and x[1] == template for x in lines)
    assert {x[1] for x in lines if x[6] and x[3]} == {x[1] for x in lines}
    plain = licenses._weighed([(w, 0, k, False, False, "x") for k, w in enumerate("a b c d e".split())], {w: 5 for w in "abcde"}, 100, 0.6)
    assert sum(x[7] for x in plain if x[6]) > 0.4 * plain[0][9]


@pytest.mark.parametrize("folder", ["edges", SF])
def test_quality(spark, docs_folder, folder):
    folder = docs_folder if folder == "edges" else folder

    def counts(text):
        w = SPACE.findall(text)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)

    rows = quality.query(spark, folder).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows], [(i, *counts(t)) for i, t in texts_of(spark, folder)])
    assert not any(r.kept and r.base_failed for r in rows)


def test_quality_fences(spark):
    """Ordinary documents stay, one full of symbols goes; quantiles lie within the sketch's accuracy."""
    rng = random.Random(1)
    clean = [(i, " ".join(rng.choice(["plain", "words", "here", "stand"]) + str(rng.randrange(10**6)) for _ in range(60)), "en", "s") for i in range(300)]
    odd = [(999, " ".join(f"w{k}$$$" for k in range(60)), "en", "s")]
    out = {r.row.doc_id: r.kept for r in quality.judge(spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert [i for i, kept in out.items() if not kept] == [999]


def test_quality_fences_follow_the_group(spark):
    """The same text passes where its group is like it and fails where its group is far from it; ordinary documents of both groups stay."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    short = [(i, " ".join(word(rng.choice([4, 5, 6])) for _ in range(80)), "en", "short") for i in range(300)]
    loose = [(1000 + i, " ".join(word(4 + i % 5) for _ in range(80)), "en", "loose") for i in range(300)]
    signs = [(2000 + i, " ".join(word(5) + ("$" if i % 10 == 0 and k % 10 == 0 else "") for k in range(80)), "en", "signs") for i in range(300)]
    odd = [(k, " ".join(word(6) + "x" for _ in range(80)), "en", so) for k, so in ((901, "short"), (902, "loose"))]
    odd += [(k, " ".join(word(5) + ("$" if j % 12 == 0 else "") for j in range(80)), "en", so) for k, so in ((903, "short"), (904, "signs"))]
    docs = spark.createDataFrame(short + loose + signs + odd, "doc_id long, text string, lang string, source string")
    out = {r.row.doc_id: r.kept for r in quality.judge(docs, ["doc_id"]).collect()}
    assert {i: out[i] for i in (902, 904)} == {902: True, 904: True}
    assert not out[901]
    assert [i for i, kept in out.items() if not kept and i not in (901, 903)] == []


def test_language(spark, docs_folder):
    rows = language.query(spark, docs_folder).collect()
    same([(r.doc_id, r.held_out) for r in rows], [(i, held_out(i, 5)) for i, _ in texts_of(spark, docs_folder)])
    unknown = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert unknown == {4, 5, 6, 13, None} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert {r.lang_pred for r in rows} <= {"en", "de", "fr", "und"}


def test_language_letters_and_many_languages(spark):
    """A letter is one by Unicode category; every language is learned, also a 70th; a hot language's sample is picked in cells."""
    alphabet = [chr(0x4E00 + k) for k in range(70)]
    rows = [(i, alphabet[i % 70] * 40, f"l{i % 70:02}") for i in range(700)] + [(1000 + i, "zz " * 30, "hot") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    network = language.train(docs, sample=30)
    assert network.languages == sorted({r[2] for r in rows})
    odd = spark.createDataFrame(list(enumerate(["²", "½ 12", "Ⅷ", "١٢", "_", "a", "ª", "日"])), "doc_id long, text string")
    found = {r.row.doc_id: r.lang_pred for r in language.detect(odd, network, ["doc_id"]).collect()}
    assert [found[i] == "und" for i in range(8)] == [True] * 5 + [False] * 3


def test_language_forward_by_hand(spark):
    """One text through the network in plain loops: embedding, filters of every width, max over the window, softmax."""
    network = language.ByteNetwork(["a", "b", "c"], 3)
    text = "Some Words, naïve 123 and more"
    data = [c if c >= 128 else (c | 32 if chr(c).isalpha() else 32) for c in text.encode()]
    data += [32] * (language.WINDOW - len(data))
    pooled = []
    for w in language.WIDTHS:
        for f in range(language.FILTERS):
            at = [sum(float(network.p["e"][data[i + k]][d]) * float(network.p[f"w{w}"][k * language.EMBEDDING + d][f]) for k in range(w) for d in range(language.EMBEDDING)) for i in range(len(data) - w + 1)]
            pooled.append(max(0.0, max(at) + float(network.p[f"b{w}"][f])))
    z = [sum(p * float(network.p["out"][k][c]) for k, p in enumerate(pooled)) + float(network.p["bias"][c]) for c in range(3)]
    odds = [math.exp(v) / sum(map(math.exp, z)) for v in z]
    (row,) = language.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), network, ["doc_id"]).collect()
    assert row.lang_pred == "abc"[odds.index(max(odds))] and abs(row.score - max(odds)) < 1e-4


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in language.query(spark, folder).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.95


def test_language_gradient():
    network = language.ByteNetwork(["a", "b"], 1)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    x, y = np.random.default_rng(2).integers(0, 256, (4, language.WINDOW)), np.array([0, 1, 1, 0])

    def loss():
        z = network.logits(x)
        return -np.mean([z[k, c] - np.log(np.exp(z[k]).sum()) for k, c in enumerate(y)])

    g = network._gradients(x, y)
    for name, at in (("w3", (1, 2)), ("out", (3, 1)), ("b2", (4,)), ("bias", (0,)), ("e", (int(x[0, 5]), 1))):
        network.p[name][at] += 1e-6
        up = loss()
        network.p[name][at] -= 2e-6
        assert abs((up - loss()) / 2e-6 - g[name][at]) < 1e-4
        network.p[name][at] += 1e-6


def test_pieces_round_trip(spark, docs_folder):
    rows = pieces.query(spark, docs_folder).collect()
    assert len(rows) == len(texts_of(spark, docs_folder)) and all(r.round_trip for r in rows)
    assert all((r.n_pieces == 0) == (not t) for (i, t) in texts_of(spark, docs_folder) for r in rows if r.doc_id == i and i is not None)


@pytest.mark.parametrize("chunk", [17, 64, 211])
def test_pieces_chunks_equal_whole(spark, chunk):
    """Chunked documents against a step-by-step search over the whole text."""
    rng = random.Random(chunk)
    texts = ["".join(rng.choice("abcthe ing\nü日") for _ in range(rng.randrange(1, 700))) for _ in range(25)] + ["a" * 300, " " * 90, "no blank" + "x" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pieces.Pieces.load(pieces.MODEL)
    for r in pieces.decode(pieces.encode(docs, ["doc_id", "text"], chunk=chunk)).collect():
        whole = pieces.normalise(r.row.text)
        assert r.score == model.trace(whole, 0, len(whole), len(whole))[1] and r.decoded == r.row.text


def test_pieces_scan_is_associative():
    rng = np.random.default_rng(1)
    m = rng.integers(-50, 0, (9, 4, 4)).astype(float)
    states, score = pieces.boundary_states(m)
    assert score == sum(m[k][states[k], states[k + 1]] for k in range(9)) and states[0] == states[-1] == 0
    total = m[0]
    for k in range(1, 9):
        total = pieces.product(total[None], m[k][None])[0]
    assert total[0, 0] == score


def test_boundaries_are_optimal():
    import itertools

    rng = random.Random(2)
    for _ in range(20):
        lengths = sorted(rng.sample(range(1, 60), 8))
        counts = [rng.randint(1, 9) for _ in lengths]
        cost = lambda cuts: sum(c * (min(b for b in cuts if b >= x) - x) for x, c in zip(lengths, counts))
        best = min(cost((*cuts, lengths[-1])) for cuts in itertools.combinations(lengths[:-1], 2))
        assert cost(packing.boundaries(np.array(lengths), np.array(counts), 3)) == best
    assert packing.boundaries(np.array([]), np.array([])) == []


def test_packing(spark, docs_folder):
    rows = packing.query(spark, docs_folder).collect()
    same([(r.doc_id, r.n_tokens) for r in rows], [(i, len(SPACE.findall(t))) for i, t in texts_of(spark, docs_folder)])
    batches = collections.Counter((r.bucket, r.batch) for r in rows)
    assert all(n == 1 or n * bucket <= packing.BUDGET for (bucket, _), n in batches.items())
    assert all(r.n_tokens <= r.bucket and r.padding == r.bucket - r.n_tokens for r in rows)
    for bucket in {b for b, _ in batches}:
        full = max(1, packing.BUDGET // max(1, bucket))
        sizes = [n for (b, _), n in batches.items() if b == bucket]
        assert sum(n < full for n in sizes) <= 1


def test_pipeline_stages(spark, docs_folder, edge_docs):
    """Each stage judged on its own input: what it keeps has the columns of documents and its decisions hold."""
    docs = spark.read.parquet(f"{docs_folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, docs_folder), name)
        assert out.columns == docs.columns
    left = neardup.stage(docs).collect()
    groups = components_by_force([(r["doc_id"], r["text"] or "") for r in docs.collect()], 5, 80)
    kept = collections.Counter(r["doc_id"] for r in left)
    assert kept[1] == 1 and kept[2] == 0 and kept[3] == 0 and kept[4] == 1
    assert set(kept) == {i for i, n, c in groups if n == 0 or i == c}
    clean = pii.stage(docs).where("doc_id = 12").first()
    assert "[EMAIL]" in clean["text"] and "[IP]" in clean["text"] and clean["n_chars"] == len(clean["text"])


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < len(rows) < documents and len({r["doc_id"] for r in rows}) == len(rows)


def test_language_model_scores_do_not_depend_on_the_filter_size(spark, monkeypatch):
    """A filter too small for all levels leaves the rest to a join: the scores stay those of a filter that holds everything."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 80")
    monkeypatch.setattr(lm, "BITS_PER_ITEM", 64)
    monkeypatch.setattr(lm, "slices", lambda batch, text: (batch.slice(i, 7) for i in range(0, batch.num_rows, 7)))
    found = []
    for bits in (1 << 24, 1 << 16):
        monkeypatch.setattr(lm, "BITS", bits)
        monkeypatch.setattr(lm, "BLOCKS", bits // lm.BLOCK_BITS)
        counts, model = lm.train(docs)
        rows = lm.score(docs, counts, model, ["doc_id"]).collect()
        found.append((model["least"], {r.row.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in rows}))
    (one, full), (some, small) = found
    assert one == 1 and some > 1 and full.keys() == small.keys() and len(full) > 20
    assert all(a[:2] == small[k][:2] and abs(a[2] - small[k][2]) < 1e-6 * abs(a[2]) and abs(a[3] - small[k][3]) < 1e-3 * abs(a[3]) for k, a in full.items())
