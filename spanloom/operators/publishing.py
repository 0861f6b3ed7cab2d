"""Metadata records, the posting calendar and the networks' payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators.ranks import numbered

WIDTH, HEIGHT = 1080, 1920
# Fixed values.
NETWORKS = ("facebook", "instagram", "tiktok", "youtube", "linkedin", "threads", "twitter")
MOST_TAGS, TITLE_CHARS = 10, 100


def keywords(found: Column, overline: Column) -> Column:
    """found: an array in order. Each once whatever its case, in the spelling met first, blanks and nulls out; the overline goes before them unless it is one, letter by letter; dashes last."""
    named = F.filter(F.transform(found, lambda x: F.btrim(x, F.lit(" \t\n\r\x0b\x0c"))), lambda x: x.isNotNull() & (x != ""))

    def once(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda y: F.lower(y) == F.lower(x)), kept).otherwise(F.array_append(kept, x))

    kept = F.aggregate(named, F.array().cast("array<string>"), once)
    over = F.btrim(F.coalesce(overline, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    every = F.when((over != "") & ~F.array_contains(kept, over), F.array_prepend(kept, over)).otherwise(kept)
    return F.transform(every, T.without_dashes)


def metadata(clips: DataFrame) -> DataFrame:
    """clips: (source, short, hook_text, overline, caption, instagram_caption, reasoning, entities array, callouts array of texts, viral_score, duration_ms, cover, own_thumb, deliverable).
    The record of each clip whose folder's name tells its rank (``short-<digits>-``), and no row for others."""
    rank = F.regexp_extract("short", r"^short-(\d+)-", 1)
    trimmed = lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    described = F.when(F.col("caption").isNotNull(), trimmed(F.col("caption"))).otherwise(trimmed(F.col("instagram_caption")))
    texts = F.transform(F.filter(F.coalesce("callouts", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), T.without_dashes)
    seconds = F.when(F.col("deliverable").isNotNull(), F.bround(F.col("duration_ms") / 1000.0, 2))
    return clips.where(rank != "").select(
        "source", "short", rank.cast("int").alias("rank"), T.without_dashes(trimmed(F.col("hook_text"))).alias("title"), T.without_dashes(trimmed(F.col("overline"))).alias("label"),
        T.without_dashes(described).alias("description"), T.without_dashes(trimmed(F.col("reasoning"))).alias("summary"), keywords(F.coalesce("entities", F.array().cast("array<string>")), F.col("overline")).alias("keywords"),
        texts.alias("callouts"), "viral_score", seconds.alias("duration_seconds"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.coalesce("cover", "own_thumb").alias("thumbnail"), "deliverable",
    )


def scheduled(items: DataFrame, order: Sequence[str], start: str, times: Sequence[str], per_day: int) -> DataFrame:
    """items with publish_at: the first ``per_day`` of the times each day from ``start`` on, by the items' places in one order over all (exact, with no task that sees all items)."""
    times = list(times)[:per_day]
    k = F.col("__place")
    day = F.date_format(F.date_add(F.lit(start).cast("date"), F.floor(k / len(times)).cast("int")), "yyyy-MM-dd")
    at = F.concat(day, F.lit("T"), F.get(F.array(*map(F.lit, times)), (k % len(times)).cast("int")), F.lit(":00"))
    return numbered(items, order, "__place").withColumn("publish_at", at).drop("__place")


def network_blocks(networks: Sequence[str], title: Column, tags: Column) -> Column:
    """The blocks of the networks asked for, one struct; a network that isn't known has none."""
    few = F.slice(tags, 1, MOST_TAGS)
    block = {
        "facebook": F.struct(F.lit("REEL").alias("type"), title.alias("title")),
        "instagram": F.struct(F.lit("REEL").alias("type"), F.lit(True).alias("showReelOnFeed")),
        "tiktok": F.struct(title.alias("title")),
        "youtube": F.struct(title.alias("title"), F.lit("short").alias("type"), F.lit("public").alias("privacy"), F.lit(False).alias("madeForKids"), few.alias("tags")),
        "linkedin": F.create_map().cast("map<string,string>"),
        "threads": F.create_map().cast("map<string,string>"),
        "twitter": F.struct(F.array().cast("array<string>").alias("tags")),
    }
    return F.struct(*(block[n].alias(f"{n}Data") for n in NETWORKS if n in networks))


def payloads(items: DataFrame, networks: Sequence[str], blog_id: str, start: str, times: Sequence[str], per_day: int, zone: str, offset: str = "") -> DataFrame:
    """items: (base, media, caption, title, tags array, score). Those with media and a caption, best first, with the record that is sent: (base, date, info, JSON). The networks' title is the caption's
    first line, else the record's own title."""
    kept = items.where("coalesce(media, '') <> '' and caption is not null").withColumn("caption", F.btrim("caption", F.lit(" \t\n\r\x0b\x0c")))
    line = T.first_line(F.col("caption"), TITLE_CHARS)
    own = F.substring(F.coalesce(F.nullif(F.col("title"), F.lit("")), line), 1, TITLE_CHARS)
    kept = kept.withColumn("__title", F.coalesce(F.nullif(line, F.lit("")), own)).withColumn("__down", -F.coalesce("score", F.lit(0)))
    placed = scheduled(kept, ["__down", "base"], start, times, per_day)
    date = F.struct(F.col("publish_at").alias("dateTime"), F.lit(zone).alias("timezone"))
    info = F.struct(
        F.lit(True).alias("autoPublish"), F.lit(False).alias("draft"), F.col("caption").alias("text"), F.array("media").alias("media"), F.array().cast("array<string>").alias("mediaAltText"), F.lit(False).alias("shortener"),
        F.struct(F.array().cast("array<string>").alias("ids")).alias("smartLinkData"), F.lit("").alias("firstCommentText"), date.alias("publicationDate"), F.array(*(F.struct(F.lit(n).alias("network")) for n in networks)).alias("providers"),
        network_blocks(networks, F.col("__title"), F.coalesce("tags", F.array().cast("array<string>"))).alias("__blocks"),
    )
    placed = placed.select("base", F.concat("publish_at", F.lit(offset)).alias("date"), info.alias("info"))
    heads = [f.name for f in placed.schema["info"].dataType.fields if f.name != "__blocks"]
    blocks = [f.name for f in placed.schema["info"].dataType["__blocks"].dataType.fields]
    whole = F.struct(*(F.col(f"info.{h}").alias(h) for h in heads), *(F.col(f"info.__blocks.{b}").alias(b) for b in blocks))
    return placed.select("base", "date", F.to_json(F.struct(F.lit(blog_id).alias("blogId"), "date", "base", whole.alias("info"))).alias("payload"))
