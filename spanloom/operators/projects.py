"""Projects of clips: a folder each, with its record, page, words and caption, as rows of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as T

# Fixed values.
WIDTH, HEIGHT, FPS, NAME_LENGTH = 1080, 1920, 30, 60
MEDIA = ("vertical_path", "enhanced_path", "cleaned_path", "raw_path")
KEPT = ("viral_score", "hook_text", "hook_start", "hook_end", "reasoning")
#: A page; its slots are filled by page().
PAGE = '<!doctype html>\n<html><head><meta charset="utf-8"><title>{title}</title></head>\n<body><div id="{id}" data-duration="{duration}">\n<video src="assets/clip-edit.mp4"></video>\n{cues}\n</div></body></html>\n'


def given(*names: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))


def projects(manifests: DataFrame, clips: DataFrame) -> DataFrame:
    """(source_id, rank, folder, title, media, duration_ms, meta, caption). manifests: (source_id, rank, slug, the paths of MEDIA, snapped_segments, source_video, duration_ms), a row a clip that was cut; clips: (source_id,
    rank, slug, the columns of KEPT, segments, instagram_caption), a rank once in a source. A manifest without its clip makes none. The slug is the clip's, else the manifest's, else its rank; the media
    the last step's path that there is; meta the record as JSON, nulls in it; the caption the clip's or one made of its hook and reasoning, without hashtags and long dashes."""
    c = clips.select("source_id", "rank", F.col("slug").alias("__slug"), *KEPT, "segments", "instagram_caption")
    m = manifests.join(c, ["source_id", "rank"])
    named = m.withColumn("__name", F.coalesce(given("__slug", "slug"), F.concat(F.lit("clip-"), F.col("rank").cast("string"))))
    folder = F.format_string("short-%02d-%s", F.col("rank"), F.col("__name"))
    title = F.format_string("Short %02d — %s", F.col("rank"), F.col("__name"))
    shown = F.format_string("Short %02d — %s", F.col("rank"), F.coalesce(F.left("hook_text", F.lit(NAME_LENGTH)), F.lit("")))
    clip = F.struct(*KEPT, "source_video", F.col("segments").alias("source_segments"), "snapped_segments", (F.col("duration_ms") / 1000).alias("duration"))
    meta = F.struct(folder.alias("id"), shown.alias("name"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(FPS).alias("fps"), clip.alias("clip"))
    hook = F.trim(F.coalesce(given("hook_text"), F.replace(F.coalesce("__slug", F.lit("")), F.lit("-"), F.lit(" "))))
    caption = T.without_dashes(T.without_hashtags(F.coalesce(given("instagram_caption"), T.fallback_caption(hook, F.coalesce("reasoning", F.lit(""))))))
    return named.select("source_id", "rank", folder.alias("folder"), title.alias("title"), given(*MEDIA).alias("media"), "duration_ms", F.to_json(meta, {"ignoreNullFields": "false"}).alias("meta"), caption.alias("caption"))


def seconds(ms: Column) -> Column:
    """Text, to the millisecond."""
    return F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def cue_html(track: Column, style: Column, color: Column, start_ms: Column, duration_ms: Column, html: Column) -> Column:
    put = (F.lit('<div class="cue '), style, F.lit(" "), color, F.lit('" data-track-index="'), track.cast("string"), F.lit('" data-start="'), seconds(start_ms), F.lit('" data-duration="'), seconds(duration_ms), F.lit('">'), html, F.lit("</div>"))
    return F.concat(*put)


def page(folder: Column, title: Column, duration_ms: Column, cues: Column, template: str = PAGE) -> Column:
    """The template with its slots filled; what is filled in isn't looked at for slots. Title and id are escaped, cues are HTML already."""
    slots = {"{title}": T.html(title), "{id}": T.html(folder), "{duration}": seconds(duration_ms), "{cues}": cues}
    parts, rest = [], template
    while rest:
        at, slot = min(((rest.find(s), s) for s in slots if s in rest), default=(len(rest), ""))
        parts += [F.lit(rest[:at]), *([slots[slot]] if slot else [])]
        rest = rest[at + len(slot) :]
    return F.concat(*parts)


def files(made: DataFrame, cues: DataFrame, words: DataFrame, template: str = PAGE) -> DataFrame:
    """(path, content), the files of each project as projects() makes them: its page, record, words and caption, and the caption once more beside the folder. cues: (source_id, rank, track, style, color, start_ms, duration_ms,
    html); words: (source_id, rank, start_ms, end_ms, item: struct). A page and a list of words are one file each by nature, a clip's."""
    keys = ["source_id", "rank"]
    shown = cue_html(*(F.col(c) for c in ("track", "style", "color", "start_ms", "duration_ms", "html")))
    lines = cues.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("track", "start_ms", shown.alias("x")))), lambda x: x["x"]), "\n").alias("__cues"))
    said = words.groupBy(*keys).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "item"))), lambda x: x["item"])).alias("__words"))
    whole = made.join(lines, keys, "left").join(said, keys, "left")
    root = F.concat(F.col("source_id").cast("string"), F.lit("/"), F.col("folder"))
    file = lambda name, content: F.struct(F.concat(root, F.lit(name)).alias("path"), content.alias("content"))
    note = F.concat("caption", F.lit("\n"))
    every = F.array(
        file("/index.html", page(F.col("folder"), F.col("title"), F.col("duration_ms"), F.coalesce("__cues", F.lit("")), template)),
        file("/meta.json", F.col("meta")),
        file("/assets/words.json", F.coalesce("__words", F.lit("[]"))),
        file("/caption.txt", note),
        file(".txt", note),
    )
    return whole.select(F.inline(every))
