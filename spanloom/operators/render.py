"""Render records: slides that stand, the band of the captions, and of each clip its record with whole lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators import intervals

CELL = 10_000
# What a style without a colour of its own gets; of each platform the limit of the captions' band and the band where a face leaves no room,
# in ten-thousandths of the frame's height; its height, its distance to the face and the frame's upper edge.
PALETTE = {"primary": "#f5c542", "secondary": "#37bdf8", "accent": "#34c759", "bg": "#07121c"}
STYLE_COLORS = {"primary": "gold", "secondary": "red", "accent": "green", "bg": "background"}
BANDS = {"tiktok": (8600, 6000, 7800), "instagram": (8400, 5800, 7600), "youtube": (9000, 6200, 8200), "generic": (8800, 6000, 8000)}
BAND_HEIGHT, BAND_GAP, BAND_TOP = 1300, 250, 500
#: Types of slides that are made by machine; figures are left to overlays.
MADE_TYPES = ("text", "list", "logo", "person")


def timed(slides: DataFrame) -> DataFrame:
    """slides: (..., start, end), seconds as they come in JSON, numbers or strings of numbers. Those with both, in whole milliseconds: (..., start_ms, end_ms). A null, a
    word or a value that isn't finite drops the slide."""
    ms = lambda c: F.rint(F.col(c).cast("string").try_cast("double") * 1000)
    finite = lambda c: F.abs(F.col(c)) < 1e15  # noqa: E731 - false for NaN, too: that is larger than all numbers
    made = slides.withColumns({"__a": ms("start"), "__b": ms("end")}).where(finite("__a") & finite("__b"))
    return made.select(*(c for c in slides.columns if c not in ("start", "end")), F.col("__a").cast("long").alias("start_ms"), F.col("__b").cast("long").alias("end_ms"))


def first_at_start(spans: DataFrame, key: str, span_id: str) -> DataFrame:
    """(key, start_ms, end_ms, span_id): of the spans with one start that with the least id. A run from left to right keeps no other of them, so their order is their ids', not their ends'."""
    first = F.min(F.struct(span_id, "end_ms")).alias("__x")
    return spans.groupBy(key, "start_ms").agg(first).select(key, "start_ms", "__x.end_ms", f"__x.{span_id}")


def made_slides(slides: DataFrame, gaps: DataFrame, types: Sequence[str] = MADE_TYPES, most: int | None = None) -> DataFrame:
    """slides: (source_id, place, type, start, end, ...), as a model or a rule proposes them; place, once in a source, is their order. gaps: (source_id, start_ms, end_ms). Slides of known types with times that are
    numbers, fitted into the gaps (what lies in none goes), from left to right those that don't begin before the last kept one ends; of several with one start the first by place. Null types are unknown."""
    known = timed(slides.where(F.col("type").isin(*types)))
    fitted = intervals.in_gap(known, gaps, "source_id", "place", CELL)
    kept = intervals.greedy(first_at_start(fitted, "source_id", "place"), "source_id", "place", most)
    return kept.select("source_id", "place", "start_ms", "end_ms").join(known.drop("start_ms", "end_ms"), ["source_id", "place"])


def standing_slides(manual: DataFrame, made: DataFrame, overlays: DataFrame, lengths: DataFrame) -> DataFrame:
    """manual, made: (source_id, start_ms, end_ms, ...), the same columns; lengths: (source_id, dur). Manual slides win over made ones that overlap them, and of all those stay that end after
    they start, at most 50 ms past the clip, and overlap no overlay."""
    merged = manual.unionByName(intervals.without_overlap(made, manual, ["source_id"], CELL))
    fine = merged.join(lengths.select("source_id", F.col("dur").alias("__dur")), "source_id").where("end_ms > start_ms and end_ms <= __dur + 50").drop("__dur")
    return intervals.without_overlap(fine, overlays, ["source_id"], CELL)


def band(face_top: Column, face_bottom: Column, platform: Column) -> Column:
    """The captions' band (top, bottom), shares of the frame's height; a face's edges in ten-thousandths. Below the face if that fits above the platform's limit, else above it if that fits below the
    frame's upper edge, else the platform's own band; that, too, where there is no face (null). A platform that isn't known is generic."""
    known = F.when(platform.isin(*BANDS), platform).otherwise("generic")
    of = lambda k: F.element_at(F.create_map(*(F.lit(x) for p, v in BANDS.items() for x in (p, v[k]))), known)
    below, above = face_bottom + BAND_GAP, face_top - BAND_GAP - BAND_HEIGHT
    top = F.when(below + BAND_HEIGHT <= of(0), below).when(above >= BAND_TOP, above)
    share = lambda x: (x / 10_000).cast("double")
    return F.struct(share(F.coalesce(top, of(1))).alias("top"), share(F.coalesce(top + BAND_HEIGHT, of(2))).alias("bottom"))


def palette(look: Column) -> Column:
    """The four colours from a style's row, a struct with gold, red, green and background; null there, or no row at all: the palette's own."""
    return F.struct(*(F.coalesce(look[STYLE_COLORS[name]], F.lit(color)).alias(name) for name, color in PALETTE.items()))


def seconds(ms: Column) -> Column:
    return (ms / 1000).cast("double")


def documents(clips: DataFrame, fields: Sequence[str], lists: Mapping[str, DataFrame]) -> DataFrame:
    """(source_id, props): of each clip one JSON object, its columns ``fields`` and, for each name in lists, the array of that list's items. A list: (source_id, start_ms, end_ms, item), item a struct;
    its order is start, end, then the item. A clip without any has an empty array. A record is one row by nature, as long as its clip; each list is gathered on
    its own, so that one dealt by source already isn't shuffled again."""
    made = clips
    for name, rows in lists.items():
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "item"))), lambda x: x["item"])
        made = made.join(rows.groupBy("source_id").agg(ordered.alias(f"__{name}")), "source_id", "left")
    whole = [F.coalesce(f"__{name}", F.array()).alias(name) for name in lists]
    return made.select("source_id", F.to_json(F.struct(*fields, *whole)).alias("props"))


def slide_color(kind: Column, own: Column, colors: Column) -> Column:
    """A slide's own colour, else its type's out of colours as palette() gives them."""
    return F.coalesce(own, F.when(kind == "stat", colors["accent"]).when(kind == "list", colors["secondary"]).otherwise(colors["primary"]))


def with_pictures(slides: DataFrame, pictures: DataFrame) -> DataFrame:
    """slides: (type, key, name, ...); pictures: (wanted, src), each wanted once. Logos and persons get the picture of their key, else of their name, as ``wanted`` and ``src``; where there is none the slide goes. Others have nulls there."""
    asks = F.col("type").isin("logo", "person")
    known = slides.withColumn("wanted", F.when(asks, F.coalesce("key", "name", F.lit("")))).join(pictures.select("wanted", "src"), "wanted", "left")
    return known.where(~F.coalesce(asks, F.lit(False)) | F.col("src").isNotNull())
