"""Whole Arrow batches of text as byte arrays: words, fingerprints and shingles without a Python loop per word.

White space is the byte 0x20 and 0x09-0x0D. UTF-8 never uses these bytes inside another character, so words found on
bytes are the words found on code points. Fingerprints have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 4 << 20
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ROOT = 0x9E3779B97F4A7C15
_ROOT_INVERSE = pow(_ROOT, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts behind each other, and where each text begins and ends; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    group = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(begin, end - begin)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and for each text the number of its first word (one entry more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = values.copy()
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


def _power(kind: str, root: int, count: int) -> np.ndarray:
    if len(_powers.get(kind, ())) < count:
        steps = np.full(max(count, CHUNK_BYTES + 1024), root, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:count]


def word_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit fingerprint of every word, A-Z lower-cased if asked: a polynomial of its bytes, read off prefix sums."""
    out = np.empty(len(starts), np.uint64)
    begin = 0
    while begin < len(starts):
        first = starts[begin]
        end = max(begin + 1, int(np.searchsorted(ends, first + CHUNK_BYTES, "right")))
        part = data[first : ends[end - 1]]
        terms = (_LOWER[part] if lower else part).astype(np.uint64)
        terms += np.uint64(1)
        terms *= _power("up", _ROOT, len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        s, e = starts[begin:end] - first, ends[begin:end] - first
        out[begin:end] = (sums[e] - sums[s]) * _power("down", _ROOT_INVERSE, len(part))[s] + (e - s).astype(np.uint64)
        begin = end
    return mix(out)


_ORDER = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)


def shingle_prints(prints: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each text's runs of ``width`` words, and the text of each; a shorter text is one run of all its words."""
    counts = np.diff(firsts)
    total = np.zeros(max(0, len(prints) - width + 1), np.uint64)
    for k in range(width):
        total += prints[k : k + len(total)] * _ORDER[k]
    owner = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
    long = counts >= width
    at = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(counts - width + 1, 0)) - np.maximum(counts - width + 1, 0), np.maximum(counts - width + 1, 0))
    found = mix(total[firsts[:-1][owner] + at]) if len(owner) else np.zeros(0, np.uint64)
    short = np.flatnonzero(~long & (counts > 0))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            whole[has] += prints[firsts[:-1][short][has] + k] * _ORDER[k]
        whole = mix(whole + counts[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        found, owner = np.concatenate([found, whole]), np.concatenate([owner, short])
    return found, owner


def distinct_sets(prints: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints text by text, and where each text's begin (one entry more than texts)."""
    order = np.lexsort((prints, owner))
    prints, owner = prints[order], owner[order]
    keep = np.ones(len(prints), bool)
    keep[1:] = (prints[1:] != prints[:-1]) | (owner[1:] != owner[:-1])
    prints, owner = prints[keep], owner[keep]
    return prints, np.searchsorted(owner, np.arange(texts + 1))
