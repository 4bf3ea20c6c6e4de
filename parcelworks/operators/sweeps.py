"""Sweeps over raster rows: segments travel as packets of summed events and are swept in Arrow batches.

An event is the change of cover at a column. Every task adds up the events of the segments it holds and sends one packet for each image and
band of rows, so what is shuffled and ordered are packets, not segments, and equal places of many segments are one event.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from parcelworks.session import spread

SHIFT = 6  # a band is 64 raster rows
LIMIT = 1 << 18  # events or runs taken at a time


def key_codes(columns: list[pa.Array]) -> np.ndarray:
    """A number for each row, equal for equal keys (null is a key); structs are compared by their fields."""
    flat = []
    for column in columns:
        flat += [column.is_null(), *column.flatten()] if pa.types.is_struct(column.type) else [column]
    code = np.zeros(len(columns[0]), np.int64)
    for column in flat:
        each = column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (len(column) + 1) + each, return_inverse=True)[1]
    return code


def ordered(*columns: np.ndarray) -> np.ndarray:
    """Order by the columns, the first one first."""
    size, key = 1, None
    for c in columns:
        low, span = int(c.min()), int(c.max()) - int(c.min()) + 1
        size *= span
        if size >= 1 << 62:
            return np.lexsort(columns[::-1])
        key = c - low if key is None else key * span + (c - low)
    return np.argsort(key, kind="stable")


def changes(*columns: np.ndarray) -> np.ndarray:
    """Places where any of the columns differs from the row before, the first place included."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[0] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def summed(group: np.ndarray, y: np.ndarray, x: np.ndarray, d: np.ndarray, bar: np.ndarray | None = None):
    """Events by group, row and column, those of one place as one; places where nothing changes are left out."""
    order = ordered(group, y, x)
    group, y, x = group[order], y[order], x[order]
    first = changes(group, y, x)
    total = np.add.reduceat(d[order], first)
    left = total != 0
    first, total = first[left], total[left]
    return group[first], y[first], x[first], total, None if bar is None else bar[order][first]


def plain_binaries(content: np.ndarray, first: np.ndarray) -> pa.Array:
    """Rows of an int32 table as they are, one binary for each part that begins at ``first``."""
    width = content.shape[1] * 4
    offsets = np.append(first, len(content)).astype(np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(content, np.int32))]).cast(pa.binary())


def binaries(content: np.ndarray, first: np.ndarray) -> pa.Array:
    """Rows of an int32 table as one binary for each part that begins at ``first``.

    A binary holds, for each column, the number of bytes of a value and the least value, then byte by byte the rest of the values: the
    bytes of one kind lie together, which leaves little to shuffle.
    """
    n, width = content.shape
    values = np.ascontiguousarray(content.T, np.int64)
    least = np.stack([np.minimum.reduceat(v, first) for v in values])
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    values -= least[:, of]
    sizes = [max((int(v.max()).bit_length() + 7) // 8, int(c == 0)) for c, v in enumerate(values)]  # the first column tells the number of rows
    count = np.diff(np.append(first, n))
    offsets = np.append(0, np.cumsum(5 * width + count * sum(sizes)))
    out = np.zeros(offsets[-1], np.uint8)
    for c, size in enumerate(sizes):
        out[offsets[:-1] + 5 * c] = size
        for k in range(4):
            out[offsets[:-1] + 5 * c + 1 + k] = (least[c] >> 8 * k) & 255
    at = offsets[:-1][of] + 5 * width + np.arange(n) - first[of]
    for v, size in zip(values, sizes, strict=True):
        for k in range(size):
            out[at] = (v >> 8 * k) & 255
            at += count[of]
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def contents(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all binaries of a column, and for each the place of its binary."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros((0, width), np.int32), np.zeros(0, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    begin, length = offsets[:-1], np.diff(offsets)
    some = np.flatnonzero(length)
    sizes = np.zeros((width, len(column)), np.int64)
    least = np.zeros((width, len(column)), np.int64)
    for c in range(width):
        sizes[c, some] = data[begin[some] + 5 * c]
        for k in range(4):
            least[c, some] |= data[begin[some] + 5 * c + 1 + k].astype(np.int64) << 8 * k
    least = np.where(least >> 31, least - (1 << 32), least)
    count = np.zeros(len(column), np.int64)
    each = sizes.sum(0)
    count[some] = (length[some] - 5 * width) // each[some]
    of = np.repeat(np.arange(len(column)), count)
    table = np.empty((len(of), width), np.int32)
    at = begin[of] + 5 * width + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    step, most = count[of], sizes[:, of]
    for c in range(width):
        value = least[c][of]
        for k in range(int(sizes[c].max())):
            has = most[c] > k
            if has.all():
                value += data[at].astype(np.int64) << 8 * k
                at += step
            else:
                value[has] += data[at[has]].astype(np.int64) << 8 * k
                at[has] += step[has]
        table[:, c] = value
    return table, of


def slices(batch: pa.RecordBatch, column: int, width: int):
    """Parts of a batch whose binaries hold about LIMIT rows, of at least one byte for each column, or fewer."""
    offsets = np.frombuffer(batch.column(column).buffers()[1], np.int32, len(batch) + 1, batch.column(column).offset * 4).astype(np.int64)
    place = (offsets[:-1] - offsets[0]) // (width * LIMIT)
    for first, last in zip(edges := changes(place), [*edges[1:], len(batch)], strict=True):
        yield batch.slice(int(first), int(last - first))


def whole_groups(batches, column: int, width: int, n_keys: int, fold):
    """Parts of sorted packets in which every (key, band) is whole; ``fold`` shortens what is held of the last one."""
    held = None
    for batch in batches:
        for part in slices(batch, column, width) if len(batch) else ():
            if held is not None:
                part = pa.concat_batches([held, part])
            group = np.zeros(len(part), np.int64) if len(part) == 1 else np.searchsorted(changes(key_codes(part.columns[:n_keys]), part.column("_band").to_numpy()), np.arange(len(part)), side="right") - 1
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield part.slice(0, last), group[:last]
            held = part.slice(last)
            if len(held) > 1:
                held = fold(held)
    if held is not None:
        yield held, np.zeros(len(held), np.int64)


def gathered(batches, rows: int = LIMIT):
    """The same rows in fewer batches, so that more of them are added up before they are sent."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count >= rows:
            yield pa.concat_batches(held)
            held, count = [], 0
    if count:
        yield pa.concat_batches(held)


def _packets(segments: DataFrame, keys: list[str], keep: list[str], reach: int | None) -> DataFrame:
    """Packets (keys, keep, _band, _events) of segments (keys, keep, y, x_start, x_end, _d); with ``reach`` every segment covers so many rows above and below, and an event knows the number of rows around its own."""
    names = [*keys, *keep]
    n = len(names)

    def run(batches):
        for batch in gathered(batches):
            y, start, end, d = (batch.column(n + k).to_numpy().astype(np.int64) for k in range(4))
            row = np.arange(len(batch))
            bar = None
            if reach is not None:
                bottom = batch.column(names.index("height")).to_numpy().astype(np.int64) - 1
                low, high = np.maximum(y - reach, 0), np.minimum(y + reach, bottom)
                count = np.maximum(high - low + 1, 0)
                row = np.repeat(row, count)
                y = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low[row]
                bar = np.minimum(y + reach, bottom[row]) - np.maximum(y - reach, 0) + 1
                bar = np.concatenate([bar, bar])
            if not len(row):
                continue
            code = key_codes(batch.columns[: len(keys)])
            at = np.zeros(code.max() + 1, np.int64)
            at[code] = np.arange(len(code))  # some row of each key
            group, y, x, d, bar = summed(np.tile(code[row], 2), np.tile(y, 2), np.concatenate([start[row], end[row] + 1]), np.concatenate([d[row], -d[row]]), bar)
            if not len(group):
                continue
            band = y >> SHIFT
            first = changes(group, band)
            columns = [y, x, d] if bar is None else [y, x, d, bar]
            taken = batch.select(names).take(pa.array(at[group[first]]))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(band[first]), binaries(np.stack(columns, 1), first)], [*names, "_band", "_events"])

    fields = [segments.schema[c] for c in names]
    schema = StructType([*fields, StructField("_band", LongType()), StructField("_events", BinaryType())])
    return segments.select(*names, "y", "x_start", "x_end", "_d").dropna(subset=["y", "x_start", "x_end"]).mapInArrow(run, schema)


def swept(segments: DataFrame, keys: list[str], keep: list[str] = (), need: int = 1, exactly: bool = False, reach: int | None = None) -> DataFrame:
    """Maximal runs (keys, y, keep, x_start, x_end) where the sum of the ``_d`` of the segments above them is at least ``need`` (or exactly that).

    With ``reach`` a segment covers so many rows above and below its own, and all rows around a place must cover it; ``keep`` then holds ``height``.
    """
    keys, keep = list(keys), list(keep)
    return swept_packets(_packets(segments, keys, keep, reach), keys, keep, need, exactly, reach is not None, isinstance(segments.schema["y"].dataType, LongType))


def swept_packets(packed: DataFrame, keys: list[str], keep: list[str] = (), need: int = 1, exactly: bool = False, barred: bool = False, long_y: bool = False) -> DataFrame:
    """``swept`` on packets of events (keys, keep, _band, _events): rows of y, x, change and, if ``barred``, the number of rows that must cover the place."""
    keys, keep = list(keys), list(keep)
    names, n = [*keys, *keep], len(keys) + len(keep)
    width = 4 if barred else 3
    placed = spread(packed, *keys, "_band").sortWithinPartitions(*keys, "_band")

    def opened(part, group):
        table, row = contents(part.column(n + 1), width)
        table = table.astype(np.int64)
        return summed(group[row], table[:, 0], table[:, 1], table[:, 2], table[:, 3] if width == 4 else None)

    def fold(part):
        group, y, x, d, bar = opened(part, np.zeros(len(part), np.int64))
        columns = [y, x, d] if bar is None else [y, x, d, bar]
        one = part.slice(0, 1)
        content = binaries(np.stack(columns, 1), np.zeros(1, np.int64)) if len(y) else pa.array([b""], pa.binary())
        return pa.RecordBatch.from_arrays([*one.columns[: n + 1], content], schema=part.schema)

    y_arrow = pa.int64() if long_y else pa.int32()

    def run(batches):
        for part, group in whole_groups(batches, n + 1, width, len(keys), fold):
            first = changes(group)
            group, y, x, d, bar = opened(part, group)
            if not len(group):
                continue
            cover = np.cumsum(d)  # the events of a row add up to nothing
            on = cover == need if exactly else cover >= (need if bar is None else bar)
            was = np.append(False, on[:-1])
            begin, stop = np.flatnonzero(on & ~was), np.flatnonzero(was & ~on)
            taken = part.select(names).take(pa.array(first[group[begin]]))
            yield pa.RecordBatch.from_arrays([*taken.columns[: len(keys)], pa.array(y[begin]).cast(y_arrow), *taken.columns[len(keys) :], pa.array(x[begin].astype(np.int32)), pa.array((x[stop] - 1).astype(np.int32))], [*keys, "y", *keep, "x_start", "x_end"])

    ends = [StructField("x_start", IntegerType()), StructField("x_end", IntegerType())]
    schema = StructType([*(packed.schema[c] for c in keys), StructField("y", LongType() if long_y else IntegerType()), *(packed.schema[c] for c in keep), *ends])
    return placed.mapInArrow(run, schema)


def run_packets(runs: DataFrame, keys: list[str], banded: bool = True, halo: int = 0) -> DataFrame:
    """Packets (keys, _band, _runs) of runs, three numbers for each, placed by key and band and in their order; all rows are one band without ``banded``.

    With ``halo`` a band also holds the runs of so many rows (fewer than a band has) above and below it.
    """
    n = len(keys)

    def run(batches):
        for batch in gathered(batches):
            y, start, end = (batch.column(n + k).to_numpy().astype(np.int64) for k in range(3))
            code = key_codes(batch.columns[:n])
            row, band = np.arange(len(y)), y >> SHIFT if banded else np.zeros(len(y), np.int64)
            for edge in (y - halo >> SHIFT, y + halo >> SHIFT) if halo else ():
                more = np.flatnonzero(edge != y >> SHIFT)
                row, band = np.append(row, more), np.append(band, edge[more])
            order = ordered(code[row], band, y[row], start[row])
            row, band = row[order], band[order]
            first = changes(code[row], band)
            taken = batch.select(keys).take(pa.array(row[first]))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(band[first]), binaries(np.stack([y, start, end], 1)[row], first)], [*keys, "_band", "_runs"])

    schema = StructType([*(runs.schema[c] for c in keys), StructField("_band", LongType()), StructField("_runs", BinaryType())])
    packed = runs.select(*keys, "y", "x_start", "x_end").dropna(subset=["y", "x_start", "x_end"]).mapInArrow(run, schema)
    return spread(packed, *keys, "_band").sortWithinPartitions(*keys, "_band")


def opened_runs(batches, n_keys: int):
    """Of sorted run packets: the rows of some whole groups, the first row of each, and group, y, start and end of their runs in order."""

    def joined(part):
        table, _ = contents(part.column(n_keys + 1), 3)
        return pa.RecordBatch.from_arrays([*part.slice(0, 1).columns[: n_keys + 1], binaries(table, np.zeros(1, np.int64))], schema=part.schema)

    for part, group in whole_groups(batches, n_keys + 1, 3, n_keys, joined):
        table, row = contents(part.column(n_keys + 1), 3)
        y, start, end = table.astype(np.int64).T
        of = group[row]
        order = ordered(of, y, start)
        yield part, changes(group), of[order], y[order], start[order], end[order]
