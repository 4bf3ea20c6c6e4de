"""Readers and writers at the edges: listings, indexes, label files, GeoJSON, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelworks.functions import paths as P
from parcelworks.operators import annotations, catalog, selection

MANIFEST_SCHEMA = "image_path string, mask_path string, split string, country string, sample_id string"
PATCH_INDEX_SCHEMA = (
    "patch_name string, patch_id string, source_tif string, x string, y string, width string, height string, image_path string, mask_path string, "
    "cropland_ratio string, ignore_ratio string, interior_ratio string, boundary_ratio string, background_ratio string, patch_type string, split string"
)
# Column order of the written tables.
PATCH_INDEX_COLUMNS = (
    "patch_name", "source_tif", "x", "y", "width", "height", "cropland_ratio", "ignore_ratio", "interior_ratio",
    "boundary_ratio", "background_ratio", "patch_type", "split", "image_path", "mask_path",
)


def list_files(spark: SparkSession, root: str, suffixes=P.IMAGE_SUFFIXES, skip_masks: bool = True) -> DataFrame:
    """Recursive listing below ``root`` (path, length), contents unread."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return catalog.scan_files(listing, suffixes=suffixes, skip_masks=skip_masks).orderBy("path")


def read_manifest(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Manifest with a header row; columns are matched by the fixed schema."""
    raw = spark.read.csv(path, header=True, schema=MANIFEST_SCHEMA, enforceSchema=False)
    return catalog.normalize_manifest(raw, root)


def read_patch_index(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Any subset of the index columns; missing ones are NULL, all read as text."""
    raw = spark.read.csv(path, header=True)
    wanted = [c.split()[0] for c in PATCH_INDEX_SCHEMA.split(", ")]
    full = raw.select(*(F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in wanted))
    return catalog.normalize_patch_index(full, root, selection.bucket_of)


def read_label_files(spark: SparkSession, folder: str) -> DataFrame:
    """All label text files of a folder as parsed rows with their file name."""
    lines = spark.read.text(f"{folder}/*.txt").select(F.col("value").alias("line"), P.file_name(F.col("_metadata.file_path")).alias("label_file"))
    return annotations.read_label_lines(lines, "line")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(F.col("value").alias("collection"))
    return annotations.read_geojson(texts, "collection")


def write_index(rows: DataFrame, path: str, columns=PATCH_INDEX_COLUMNS, fmt: str = "parquet", files_per_split: int = 0) -> None:
    """Index partitioned by split in fixed column order.

    Rows go to disk from the tasks that hold them; ``files_per_split`` > 0 first spreads
    them over that many files per split by key hash (never one task per split).
    """
    out = rows.select(*columns)
    if files_per_split:
        out = out.repartition(files_per_split * 3, "split", F.pmod(F.xxhash64(columns[0]), F.lit(files_per_split)))
    writer = out.write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation summary documents back to one row per sample."""
    schema = "count bigint, samples array<struct<id:bigint, sample_id:string, metrics:map<string,double>>>"
    return spark.read.schema(schema).json(path).select("count", F.explode("samples").alias("s")).select("count", "s.*")


def summary_texts(scores: DataFrame, key: str, metrics: list[str], *, chunk: int) -> DataFrame:
    """Summary documents (count and samples), cut by ranges of the running id."""
    from parcelworks.operators.ordering import rank_by_id

    ranked = rank_by_id(scores, key).withColumn("id", F.col("rank0") + 1)
    values = F.create_map(*(v for m in metrics for v in (F.lit(m), F.col(m))))
    sample = F.struct(F.col("id"), F.col(key).cast("string").alias("sample_id"), values.alias("metrics"))
    parts = ranked.groupBy(F.floor((F.col("id") - 1) / chunk).alias("part")).agg(F.collect_list(F.struct("id", sample.alias("s"))).alias("_u"))
    by_id = F.array_sort("_u", lambda a, b: F.when(a["id"] < b["id"], -1).otherwise(1))
    parts = parts.withColumn("_l", by_id)
    document = F.to_json(F.struct(F.size("_l").alias("count"), F.transform("_l", lambda e: e["s"]).alias("samples")))
    return parts.select("part", document.alias("summary"))
