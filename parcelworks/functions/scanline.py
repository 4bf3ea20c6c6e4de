"""One raster row held as an array: horizontal work without a shuffle.

A mask is stored as ``(image_id, y, cls ARRAY<INT>)``, one row per scanline. Rows are
bounded by the raster width, so every expression here is bounded too. Generators are the ``_outer`` ones: rows are never empty, and the plain ones
make the optimizer add a size filter that computes the whole array a second time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def run_starts(row: Column) -> Column:
    """Positions where the value differs from its left neighbour."""
    return F.filter(
        F.sequence(F.lit(0), F.size(row) - 1),
        lambda i: (i == 0) | (F.get(row, i) != F.get(row, i - 1)),
    )


def runs(row: Column, starts: Column) -> Column:
    """ARRAY<STRUCT<x_start, x_end, cls>>, inclusive ends, left to right."""
    return F.transform(
        starts,
        lambda s, k: F.struct(
            s.alias("x_start"),
            (F.coalesce(F.get(starts, k + 1), F.size(row)) - 1).cast("int").alias("x_end"),
            F.get(row, s).alias("cls"),
        ),
    )


def explode_runs(rows: DataFrame, row_col: str = "cls", classes: list[int] | None = None) -> DataFrame:
    """Scanlines to ``(..., x_start, x_end, cls)`` runs, computed inside each row, a batch of rows at a time.

    With ``classes`` the values in it are one, and only their runs are given. A null value ends no run.
    """
    keep = [c for c in rows.columns if c != row_col]
    at = len(keep)

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            values, lengths = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            if not len(values):
                continue
            plain = values.to_numpy(zero_copy_only=False) if pa.types.is_integer(values.type) and not values.null_count else values.dictionary_encode().indices.fill_null(-1).to_numpy()
            known = np.ones(len(values), bool) if not values.null_count else values.is_valid().to_numpy(zero_copy_only=False)
            if classes is not None:
                plain = pc.fill_null(pc.is_in(values, pa.array(classes, values.type)), False).to_numpy(zero_copy_only=False)
            begin = np.cumsum(lengths) - lengths
            fresh = np.append(True, (plain[1:] != plain[:-1]) & known[1:] & known[:-1])
            fresh[begin[lengths > 0]] = True
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(values)) - 1
            if classes is not None:
                first, last = first[plain[first]], last[plain[first]]
            row = np.repeat(np.arange(len(batch)), lengths)[first]
            taken = batch.select(range(at)).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array((first - begin[row]).astype(np.int32)), pa.array((last - begin[row]).astype(np.int32)), values.take(pa.array(first))], names)

    names = [*keep, "x_start", "x_end", "cls"]
    fields = [*(rows.schema[c] for c in keep), StructField("x_start", IntegerType()), StructField("x_end", IntegerType()), StructField("cls", rows.schema[row_col].dataType.elementType)]
    return rows.select(*keep, row_col).mapInArrow(run, StructType(fields))


def explode_pixels(rows: DataFrame, row_col: str = "cls") -> DataFrame:
    keep = [c for c in rows.columns if c != row_col]
    return rows.select(*keep, F.posexplode_outer(row_col).alias("x", row_col))


def count_equal(row: Column, value: int) -> Column:
    return F.size(F.filter(row, lambda v: v == F.lit(value)))
