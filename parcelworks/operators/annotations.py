"""Detections and features as text: GeoJSON, JSON lists, label lines, prompts, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.functions import ring as R
from parcelworks.functions.bbox import Box, from_center_form

# Scene words that are never features.
LARGE_SCALE_WORDS = (
    "city", "town", "village", "country", "continent", "region", "landscape",
    "area", "scene", "view", "field", "terrain", "forest", "mountain",
    "valley", "coast", "shore", "horizon", "suburb", "district", "neighborhood",
)


def box_ring(box: Box) -> Column:
    """Closed ring: top left, top right, bottom right, bottom left, top left."""
    return R.ring_of([(box.x1, box.y1), (box.x2, box.y1), (box.x2, box.y2), (box.x1, box.y2), (box.x1, box.y1)])


def polygon_feature(ring: Column, properties: list[Column]) -> Column:
    """GeoJSON Feature text of one ring."""
    points = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")))


def collect_features(features: DataFrame, group: str, key: str, text: str = "feature", *, chunk: int, crs: str | None = None) -> DataFrame:
    """Valid FeatureCollections per group, cut by ranges of the unique key.

    One text for a whole layer would be gathered in one task; each part holds at most
    ``chunk`` features and the parts of a layer are complete together.
    """
    parts = features.groupBy(group, F.floor(F.col(key) / chunk).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(key, text))).alias("_items")
    )
    body = F.array_join(F.transform("_items", lambda i: i[text]), ",")
    named = f',"crs":"{crs}"' if crs else ""
    collection = F.concat(
        F.lit('{"type":"FeatureCollection","features":['), body, F.lit('],"num_detections":'), F.size("_items").cast("string"), F.lit(named + "}")
    )
    return parts.select(group, "part", F.size("_items").cast("bigint").alias("num_detections"), collection.alias("collection"))


def read_geojson(collections: DataFrame, text: str) -> DataFrame:
    """FeatureCollection texts to one row per polygon feature with its outer ring."""
    schema = (
        "type string, features array<struct<type:string, properties:map<string,string>, "
        "geometry:struct<type:string, coordinates:array<array<array<double>>>>>>"
    )
    parsed = collections.withColumn("_fc", F.from_json(text, schema)).select("*", F.posexplode("_fc.features").alias("position", "_f"))
    ring = F.transform(F.get(F.col("_f.geometry.coordinates"), F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return parsed.withColumn("properties", F.col("_f.properties")).withColumn("ring", ring).drop("_fc", "_f", text)


def read_label_lines(lines: DataFrame, text: str) -> DataFrame:
    """``class xc yc w h`` lines; blank and short lines are skipped."""
    parts = lines.withColumn("_p", F.split(F.trim(text), r"\s+")).filter(F.size("_p") >= 5)
    number = lambda i: F.element_at("_p", i).try_cast("double")
    read = parts.select(
        *[c for c in lines.columns if c != text],
        F.element_at("_p", 1).try_cast("int").alias("class_id"),
        number(2).alias("cx"), number(3).alias("cy"), number(4).alias("w"), number(5).alias("h"),
    )
    return read


def label_to_pixels(cx: Column, cy: Column, w: Column, h: Column, x0: Column, y0: Column, width: Column, height: Column) -> Box:
    """Tile-relative centre box to image pixels."""
    return from_center_form(cx * width + x0, cy * height + y0, w * width, h * height)


def label_to_map(cx: Column, cy: Column, w: Column, h: Column, west: Column, south: Column, east: Column, north: Column) -> Box:
    """Tile-relative centre box to map units; y grows north there."""
    wide, tall = east - west, north - south
    x, y = west + cx * wide, north - cy * tall
    return Box(x - w * wide / 2.0, y + h * tall / 2.0, x + w * wide / 2.0, y - h * tall / 2.0)


def parse_box_prompts(texts: DataFrame, text: str) -> DataFrame:
    """``x1,y1,x2,y2``: four numbers or rejected."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double").cast("int"))
    valid = (F.size(parts) == 4) & F.forall(parts, lambda v: v.isNotNull())
    named = [F.when(valid, F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    return texts.select(*[c for c in texts.columns if c != text], F.coalesce(valid, F.lit(False)).alias("accepted"), *named)


def parse_point_prompts(texts: DataFrame, text: str) -> DataFrame:
    """``[[x, y, label], ...]`` to one row per point; a bad list gives one rejected row."""
    points = F.from_json(F.col(text), "array<array<int>>")
    valid = points.isNotNull() & F.forall(points, lambda p: (F.size(p) == 3) & F.forall(p, lambda v: v.isNotNull()))
    checked = texts.withColumn("accepted", F.coalesce(valid, F.lit(False))).withColumn("_p", F.when(F.col("accepted"), points))
    keep = [c for c in texts.columns if c != text]
    opened = checked.select(*keep, "accepted", F.posexplode_outer("_p").alias("position", "_q"))
    part = lambda i: F.get(F.col("_q"), F.lit(i))
    return opened.select(*keep, "accepted", "position", part(0).alias("x"), part(1).alias("y"), part(2).alias("label"))


def flatten_vocabulary(documents: DataFrame, text: str) -> DataFrame:
    """{category: [names] or {group: [names]}} texts to the distinct names."""
    entries = documents.select(F.explode(F.from_json(F.col(text), "map<string,string>")).alias("category", "_body"))
    flat = F.from_json("_body", "array<string>")
    grouped = F.flatten(F.map_values(F.from_json("_body", "map<string,array<string>>")))
    return entries.select(F.explode(F.when(F.col("_body").startswith("["), flat).otherwise(grouped)).alias("name")).distinct()


def tokens(text: Column) -> Column:
    """Lower-cased letter runs, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def phrases(words: Column, length: int) -> Column:
    """All runs of ``length`` neighbouring words, joined by a blank."""
    last = F.size(words) - length + 1
    return F.when(
        last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, length), " "))
    ).otherwise(F.array().cast("array<string>"))


def caption_features(captions: DataFrame, key: str, text: str, vocabulary: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Vocabulary names found in each caption; all words when nothing is found.

    Captions are reduced to their distinct words and phrases, as long as the longest phrase
    of the vocabulary ``(phrase, name)``, before the join; its side is chosen from its size.
    """
    longest = vocabulary.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    banned = F.array(*(F.lit(w) for w in LARGE_SCALE_WORDS + tuple(e.lower().replace("_", " ") for e in exclude)))
    words = captions.select(key, tokens(F.col(text)).alias("_w"))
    usable = words.select(key, F.array_except(F.array_distinct("_w"), banned).alias("_single"), *(phrases(F.col("_w"), n).alias(f"_p{n}") for n in range(2, longest + 1)))
    candidates = F.array_distinct(F.concat("_single", *(f"_p{n}" for n in range(2, longest + 1))))
    found = (
        usable.select(key, F.explode(candidates).alias("phrase"))
        .join(vocabulary, "phrase")
        .groupBy(key)
        .agg(F.array_sort(F.collect_set("name")).alias("_found"))
    )
    return usable.join(found, key, "left").select(
        key, F.coalesce("_found", F.array_sort("_single")).alias("features"), F.col("_found").isNotNull().alias("matched")
    )
