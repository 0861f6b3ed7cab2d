"""Clips as a picker answers with them, one JSON record each, made whole or dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T

# Seconds.
LEAST, MOST, SLACK = 5.0, 180.0, 1.0
HOOK, CALLOUT = 10.0, 1.6
SCORE, COLOR, SLUG_CHARS = 5, "cyan", 40
SPACE = " \t\n\r\x0b\x0c"

RECORD = "start string, end string, hook_start string, hook_end string, hook_text string, slug string, viral_score string, rank string, reasoning string, instagram_caption string, segments array<string>, callouts array<string>"
SPOKEN = "local_start string, duration string, text string, accent array<string>, eyebrow string, color string"


def _number(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACE)).try_cast("double")


def _given(keys: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(keys, name), F.lit(False))


def callouts(records: Column) -> Column:
    """JSON records to callouts (local_start, duration, text, accent, eyebrow, color): without a time or text, or with a time that isn't a number, they go; what is absent gets its default, an explicit null in a number's place
    counts as no number, one in a text's place as the word None."""

    def one(parsed: Column) -> Column:
        x, keys = parsed["x"], parsed["keys"]
        length = F.when(_given(keys, "duration"), _number(x["duration"])).otherwise(F.lit(CALLOUT))
        said = lambda name, default: F.btrim(F.when(_given(keys, name), F.coalesce(x[name], F.lit("None"))).otherwise(F.lit(default)), F.lit(SPACE))
        start = _number(x["local_start"])
        made = F.struct(
            start.alias("local_start"), length.alias("duration"), said("text", "").alias("text"), F.coalesce(x["accent"], F.array().cast("array<string>")).alias("accent"),
            said("eyebrow", "").alias("eyebrow"), F.lower(said("color", COLOR)).alias("color"),
        )
        return F.when(start.isNotNull() & length.isNotNull() & _given(keys, "text"), made)

    # parsed in a step of its own: a lambda computes anew what it names twice
    parsed = F.transform(F.coalesce(records, F.array().cast("array<string>")), lambda r: F.struct(F.from_json(r, SPOKEN).alias("x"), F.json_object_keys(r).alias("keys")))
    return F.filter(F.transform(parsed, one), lambda c: c.isNotNull())


def segments(parts: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """JSON parts, each {"start": .., "end": ..} or a pair, to those that run forwards (the whole clip, where none is left); and whether one is malformed. Nulls, empty ones and lists that
    aren't pairs are passed over; a pair that isn't two numbers, or a part that is neither, is malformed."""

    def read_one(part: Column) -> Column:
        named = F.transform(F.array(F.from_json(part, "start string, end string")), lambda x: F.array(x["start"], x["end"]))[0]
        return F.struct(part.alias("part"), F.when(F.startswith(part, F.lit("{")), named).otherwise(F.from_json(part, "array<string>")).alias("both"))

    def one(given: Column) -> Column:
        part, both = given["part"], given["both"]
        empty = part.isNull() | F.regexp_replace(part, r"\s", "").isin("", "[]", "{}", "null", "0", "0.0", "false")
        skipped = empty | F.coalesce(F.size(both) != 2, F.lit(False)) & F.startswith(part, F.lit("["))
        s, e = _number(F.get(both, F.lit(0))), _number(F.get(both, F.lit(1)))
        return F.struct(skipped.alias("skip"), s.alias("s"), e.alias("e"))

    read = F.filter(F.transform(F.transform(F.coalesce(parts, F.array().cast("array<string>")), read_one), one), lambda x: ~x["skip"])
    good = F.transform(F.filter(read, lambda x: x["e"] > x["s"]), lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end")))
    whole = F.array(F.struct(start.alias("start"), end.alias("end")))
    return F.when(F.size(good) > 0, good).otherwise(whole), F.exists(read, lambda x: x["s"].isNull() | x["e"].isNull())


def normalized(raw: DataFrame, lengths: DataFrame) -> DataFrame:
    """raw: (source_id, place, record): each source's clips in the order they were given (place from 0), as JSON. lengths: (source_id, last_end), seconds. The clips that are whole: they run forwards, end a second behind the source's last
    word at the latest and last 5 to 180 s; a number that isn't one, in a segment too, drops the clip. Ranked by score, then by the rank they came with."""
    r = F.col("record")
    # generated, so that no condition below is pushed down into a parse of its own
    parsed = F.inline(F.array(F.struct(F.from_json(r, RECORD).alias("x"), F.json_object_keys(r).alias("keys"))))
    x = raw.select("source_id", "place", "record", parsed).join(lengths, "source_id", "left")
    keys = F.col("keys")
    number = lambda name, default: F.when(_given(keys, name), _number(F.col(f"x.{name}"))).otherwise(default)
    text = lambda name: F.coalesce(F.col(f"x.{name}"), F.lit(""))
    x = x.withColumns({"start": _number(F.col("x.start")), "end": _number(F.col("x.end"))})
    score = F.when(_given(keys, "viral_score"), F.coalesce(F.col("x.viral_score").try_cast("int"), F.when(~F.col("x.viral_score").rlike('[^0-9.eE+-]'), F.col("x.viral_score").try_cast("double").cast("int")))).otherwise(F.lit(SCORE))
    seconds = F.col("end") - F.col("start")
    # what is cheap to ask goes first: few records' segments and callouts are read
    x = x.where((F.col("end") > F.col("start")) & (F.col("end") <= F.coalesce("last_end", F.lit(0.0)) + SLACK) & seconds.between(LEAST, MOST))
    parts, malformed = segments(F.col("x.segments"), F.col("start"), F.col("end"))
    x = x.withColumns({
        "hook_start": number("hook_start", F.col("start")), "hook_end": number("hook_end", F.least(F.col("start") + HOOK, F.col("end"))), "viral_score": score, "segments": parts, "bad": malformed,
        "given": F.when(_given(keys, "rank"), _number(F.col("x.rank"))).otherwise(F.col("place") + 1),
    })
    fine = F.col("hook_start").isNotNull() & F.col("hook_end").isNotNull() & F.col("viral_score").isNotNull() & ~F.col("bad")
    own = F.concat(F.lit("clip-"), (F.col("place") + 1).cast("string"))
    named = T.slug(F.coalesce(F.nullif(text("slug"), F.lit("")), F.nullif(text("hook_text"), F.lit("")), own), SLUG_CHARS)
    order = Window.partitionBy("source_id").orderBy(F.desc("viral_score"), "given", "place")
    return x.where(fine).select(
        "source_id", F.row_number().over(order).alias("rank"), "place", "start", "end", "hook_start", "hook_end", text("hook_text").alias("hook_text"), "viral_score", text("reasoning").alias("reasoning"), "segments",
        F.coalesce(F.nullif(named, F.lit("")), own).alias("slug"), F.btrim(text("instagram_caption"), F.lit(SPACE)).alias("instagram_caption"), callouts(F.col("x.callouts")).alias("callouts"), F.get_json_object(r, "$.hook").alias("hook"),
    )
