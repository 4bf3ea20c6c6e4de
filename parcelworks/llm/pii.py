"""Personal data: candidate spans from generators of high recall, judged by boosted trees with calibrated thresholds.

Generators propose overlapping spans of four kinds. Those of the base patterns are always kept. The others are what the patterns miss:
parts of digit runs that fail as a whole, national phone numbers in groups of 3, 3 and 4 digits, e-mail addresses with a bracketed "at", and IPv6
addresses with all eight groups. Trees see format features (digit
groups, separators, Luhn sum, parts) and context features (neighbouring characters, words before the span); a span is added if its
calibrated probability reaches its kind's threshold and it overlaps no kept one, best first (equal ones from left to right).

The trees are trained here on a bounded sample: ``CONTEXTS`` pieces of ``PIECE`` characters of the given texts, picked by hash, into
which generated personal data and look-alikes are put, so that every candidate's label is known. A part of them calibrates the scores
and sets the thresholds at the wanted precision.

Defined cases: a null or empty text has no spans (a null stays null when redacted); very long texts are read whole, all patterns run in
linear time; repeated rows are judged each; overlapping base spans of different kinds all stay, and are redacted as one; an empty table
gives no rows; other columns pass through inside ``row``. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.boosting import BoostedTrees
from parcelworks.llm.kernel import slices

KINDS = ("email", "ip", "card", "phone")
CONTEXTS = 400
PIECE = 400
PER_CONTEXT = 8
PRECISION = 0.99
NEAR = 32

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"[\[({] ?at ?[\])}]", re.I)
_SPELLED_DOMAIN = re.compile(r" ?[A-Za-z0-9-]+(?:(?:\.| ?[\[({] ?dot ?[\])}] ?)[A-Za-z0-9-]+)+", re.I)
_NATIONAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_PREFIXED = re.compile(r"(?<![0-9+])00[1-9][ ().0-9-]+[0-9]")
_IPV6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_DIGITS = re.compile(r"[0-9]+")
_LEADING_ZEROS = re.compile(r"^0+(?=[0-9])")
_HINTS = [re.compile(p, re.I) for p in (r"phone|tel\b|call|mobile|fax", r"card|visa|credit|payment", r"mail|contact|write", r"\bip\b|host|server|address", r"order|invoice|\bid\b|ref|serial|isbn|version|token|number|no\.")]


def digits_of(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _is_ip(text: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (_LEADING_ZEROS.sub("", x) for x in text.split(".")))


def _is_card(text: str) -> bool:
    digits = digits_of(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _is_phone(text: str) -> bool:
    return 9 <= len(digits_of(text)) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's matches, found from each @ outwards so that a long run of letters is walked once."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        match = _DOMAIN.match(text, at + 1) if begin < at else None
        if match:
            yield begin, match.end()
            done = match.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns: leftmost, non-overlapping for each kind, failing matches dropped."""
    found = [(s, e, "email") for s, e in _emails(text)]
    found += [(*m.span(), "ip") for m in _IP.finditer(text) if _is_ip(m[0])]
    found += [(*m.span(), "card") for m in _CARD.finditer(text) if _is_card(m[0])]
    found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if _is_phone(m[0])]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _runs(match: re.Match, least: int, most: int, from_start: bool) -> Iterator[tuple[int, int]]:
    """Runs of whole digit groups inside a match that hold ``least`` to ``most`` digits."""
    groups = [m.span() for m in _DIGITS.finditer(match[0])]
    for i in range(1 if from_start else len(groups)):
        n = 0
        for s, e in groups[i:]:
            n += e - s
            if n > most:
                break
            if n >= least:
                yield match.start() + (0 if from_start else groups[i][0]), match.start() + e


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans that the base patterns do not give; they may overlap."""
    found: set = set()
    for m in _AT.finditer(text):
        begin = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
        stop = begin
        while begin > 0 and begin > stop - 65 and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _SPELLED_DOMAIN.match(text, m.end())
        if begin < stop and domain:
            found.add((begin, domain.end(), "email"))
    found |= {(*m.span(), "ip") for m in _IPV6.finditer(text)}
    for m in _CARD.finditer(text):
        if not _is_card(m[0]):
            found |= {(s, e, "card") for s, e in _runs(m, 12, 19, False)}
    for m in _PHONE.finditer(text):
        if not _is_phone(m[0]):
            found |= {(s, e, "phone") for s, e in _runs(m, 9, 15, True)}
    found |= {(*m.span(), "phone") for m in _NATIONAL.finditer(text)}
    for m in _PREFIXED.finditer(text):
        found |= {(s, e, "phone") for s, e in _runs(m, 9, 15, True)}
    return sorted(found)


def features(text: str, span: tuple[int, int, str]) -> list[float]:
    s, e, kind = span
    inside, before, after = text[s:e], text[max(0, s - NEAR) : s], text[e : e + NEAR]
    groups = _DIGITS.findall(inside)
    digits = "".join(groups)
    separators = [c for c in inside if not c.isalnum()]
    neighbour = lambda c: 0 if not c or c.isspace() else 1 if c.isdigit() else 2 if c.isalpha() else 3
    sizes = [len(g) for g in groups] or [0]
    tail = re.split(r"[^A-Za-z0-9]+", inside.rstrip(")]}"))[-1]
    return [
        *(float(kind == k) for k in KINDS), e - s, len(digits), sum(c.isalpha() for c in inside), len(separators), len(set(separators)), float(bool(digits) and luhn(digits)),
        len(groups), sizes[0], sizes[-1], max(sizes), min(sizes), int(digits[0]) if digits else -1, len(set(digits)), float("+" in inside), float("(" in inside),
        neighbour(before[-1:]), neighbour(after[:1]), neighbour(before[-2:-1]), neighbour(after[1:2]), sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
        len(tail), float(tail.isalpha()), float(bool(re.search("dot", inside, re.I)) or "." in inside), *(float(bool(h.search(before))) for h in _HINTS),
    ]


def _examples(rng: random.Random) -> tuple[str, str, str, bool]:
    """(text before, span, kind, personal) of one generated example."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))

    def card(valid: bool) -> str:
        number = rng.choice("3456") + d(rng.choice([11, 13, 14, 14, 14]))
        number += str(next(c for c in range(10) if luhn(number + str(c)) == valid))
        gap = rng.choice([" ", "-", ""])
        return gap.join(number[i : i + 4] for i in range(0, len(number), 4))

    kind, good = rng.choice(KINDS), rng.random() < 0.5
    if kind == "email":
        domain = rng.choice([" (dot) ", "(dot)", " [dot] ", "."]).join([name(), rng.choice(["com", "org", "net", "de", "example.com"])])
        plain = rng.choice([" [at] ", " (at) ", "(at)", " {at} "])
        return "", f"{name()}.{d(2)}{plain}{domain}" if good else f"{name()}{plain}{d(2)}.{d(2)}", kind, good
    if kind == "ip":
        part = lambda: f"{rng.randrange(1 << 16):x}"
        return "", ":".join(part() for _ in range(8)) if good else ":".join(d(2) for _ in range(8)), kind, good
    if kind == "card":
        return rng.choice(["", "", d(2) + " ", d(rng.randint(4, 6)) + " ", d(4) + "-"]) if good else "", card(good), kind, good
    if good:
        number = rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"00{rng.randint(1, 9)}{d(1)} {d(3)} {d(6)}"])
        return rng.choice(["", "call ", "phone ", "tel "]), number, kind, True
    return rng.choice(["order ", "id ", "version ", "", ""]), rng.choice([f"{d(3)} {d(3)} {d(4)} {d(5)} {d(3)}", f"000{d(4)} {d(2)} {d(6)}", f"{d(3)}.{d(3)}.{d(4)}.{d(2)}", f"+{d(1)} {d(9)} {d(9)} {d(9)}"]), kind, False


def training_rows(contexts: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of all candidates of the generated texts; a candidate is right if it is the personal span itself."""
    rng, rows, labels, kinds = random.Random(seed), [], [], []
    for context in contexts or [""]:
        for _ in range(PER_CONTEXT):
            lead, span, kind, good = _examples(rng)
            cut = rng.randint(0, len(context))
            tail = rng.choice([" ", ". ", ", ", f" {rng.randrange(10_000)} "])
            text = f"{context[:cut]} {lead}{span}{tail}{context[cut:]}"
            begin = cut + 1 + len(lead)
            for s, e, k in candidates(text):
                touches = s < begin + len(span) and e > begin
                if touches:
                    rows.append(features(text, (s, e, k)))
                    labels.append(float(good and (s, e, k) == (begin, begin + len(span), kind)))
                    kinds.append(KINDS.index(k))
    return np.array(rows, float), np.array(labels), np.array(kinds)


def train(docs: DataFrame, text: str = "text", contexts: int = CONTEXTS, precision: float = PRECISION) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees and each kind's threshold: the least calibrated probability from which on held-out candidates have the wanted precision."""
    code = F.xxhash64(text)
    piece = F.substring(F.col(text), (F.pmod(code, F.greatest(F.lit(1), F.length(F.col(text)) - PIECE + 1)) + 1).cast("int"), F.lit(PIECE))
    picked = docs.where(F.col(text).isNotNull()).select(code.alias("c"), piece.alias("t")).distinct().orderBy("c", "t").limit(contexts).collect()
    x, y, kinds = training_rows([r["t"] for r in picked])
    held = np.arange(len(x)) % 3 == 0
    model = BoostedTrees().fit(x[~held], y[~held]).calibrate(x[held], y[held])
    p, least = model.probability(x[held]), {}
    for k, kind in enumerate(KINDS):
        mine = np.flatnonzero(kinds[held] == k)
        order = mine[np.argsort(-p[mine], kind="stable")]
        right = np.cumsum(y[held][order]) / np.arange(1, len(order) + 1)
        fits = np.flatnonzero(right >= precision)
        least[kind] = max(0.5, float(p[order[fits[-1]]])) if len(fits) else 1.1
    return model, least


def find_spans(text: str, model: BoostedTrees, least: dict[str, float]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of one text."""
    base = base_spans(text)
    known, taken = set(base), _Places()
    for s, e in _merged(base):
        taken.add(s, e)
    # what touches a base span can never be added, so it must not stand in another one's way either
    more = [c for c in candidates(text) if c not in known and taken.free(c[0], c[1])]
    if not more:
        return base, base
    p = model.probability(np.array([features(text, c) for c in more], float))
    added = []
    for k in np.argsort(-p, kind="stable"):
        s, e, kind = more[k]
        if p[k] >= least[kind] and taken.free(s, e):
            taken.add(s, e)
            added.append(more[k])
    return base, sorted([*base, *added], key=lambda x: (x[0], KINDS.index(x[2])))


def _merged(spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Spans sorted by their start, overlapping ones as one."""
    begin = end = -1
    for s, e, _ in spans:
        if s >= end:
            if end >= 0:
                yield begin, end
            begin, end = s, e
        end = max(end, e)
    if end >= 0:
        yield begin, end


class _Places:
    """Disjoint spans in order: a new one is compared with its two neighbours only."""

    def __init__(self):
        self.starts, self.ends = [], []

    def free(self, s: int, e: int) -> bool:
        k = bisect_left(self.starts, e)
        return k == 0 or self.ends[k - 1] <= s

    def add(self, s: int, e: int) -> None:
        k = bisect_left(self.starts, s)
        self.starts.insert(k, s)
        self.ends.insert(k, e)


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Every span, or run of overlapping ones, as the name of its first kind in brackets."""
    out, done = [], 0
    for s, e, kind in spans:
        if s >= done:
            out += [text[done:s], f"[{kind.upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def find(docs: DataFrame, model: BoostedTrees, least: dict[str, float], keep: list[str], text: str = "text") -> DataFrame:
    """Kept columns as struct ``row``, ``base`` and ``spans`` (arrays of kind, start, stop), and ``redacted``."""
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("t"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [{"kind": k, "start": s, "stop": e} for s, e, k in spans]
        for batch in batches:
            for part in slices(batch, "t"):
                texts = part.column(1).to_pylist()
                both = [find_spans(t or "", model, least) for t in texts]
                redacted = [t if t is None else redact_text(t, spans) for t, (_, spans) in zip(texts, both, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([named(b) for b, _ in both], span), pa.array([named(a) for _, a in both], span), pa.array(redacted, pa.string())], ["row", "base", "spans", "redacted"])

    kind = "array<struct<kind:string,start:bigint,stop:bigint>>"
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, base {kind}, spans {kind}, redacted string")


def query(spark, folder: str) -> DataFrame:
    """op1: spans of every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    out = find(docs, *train(docs), ["doc_id"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("row.doc_id", *map(of_kind, KINDS), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def stage(docs: DataFrame) -> DataFrame:
    """All documents with their personal data redacted, and n_chars, if there is one, counted anew."""
    out = find(docs, *train(docs), docs.columns)
    changed = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])
