"""Catalogues, quality checks, work planning, publishing and secret scans, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import publishing, reports, stats
from spanloom.plans.common import Queries, quoted, table

Q = Queries()

# Fixed values.
CATEGORIES = (
    ("cash register", "money"), ("kaching", "money"), ("register", "money"), ("coin", "money"), ("riser", "riser"), ("whip", "whip"), ("fastwhoosh", "whoosh-fast"),
    ("camera", "camera"), ("whoosh", "whoosh"), ("swipe", "whoosh"), ("shine", "magic"), ("sparkle", "magic"), ("bell", "ding"), ("ding", "ding"), ("chime", "ding"),
    ("notification", "ding"), ("gong", "impact"), ("impact", "impact"), ("boom", "impact"), ("thud", "impact"), ("error", "error"), ("buzz", "error"), ("click", "click"),
    ("tap", "click"), ("mouse", "click"), ("pop", "pop"), ("beep", "beep"), ("icon", "ui"),
)
SLOTS = {
    "money": ("cash-register",), "ding": ("ding",), "magic": ("ding",), "beep": ("ding",), "whip": ("swipe-in", "swipe-out"), "whoosh-fast": ("swipe-in", "swipe-out", "whoosh"),
    "whoosh": ("whoosh", "swipe-in", "swipe-out", "hook-impact"), "camera": ("hook-impact", "whoosh"), "impact": ("hook-impact",), "riser": ("hook-impact",),
    "click": ("ding",), "pop": ("ding",), "error": ("wrong-answer",), "ui": ("ding", "swipe-in"), "unknown": (),
}
IDEAL_MS = {"wrong-answer": (500, 2000), "swipe-in": (150, 550), "swipe-out": (150, 550), "hook-impact": (400, 1500), "cash-register": (500, 2000), "ding": (300, 1200), "whoosh": (300, 1000)}


def suggested(category: Column, ms: Column) -> Column:
    """The category's slots whose ideal length, half as much again either way, fits; all of them if none does or no length is known."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, slots in SLOTS.items():
        every = F.array(*map(F.lit, slots)).cast("array<string>")
        fit = F.array_compact(F.array(*(F.when((2 * ms >= IDEAL_MS[s][0]) & (2 * ms <= 3 * IDEAL_MS[s][1]), F.lit(s)) for s in slots)).cast("array<string>"))
        out = out.when(category == name, F.when(ms.isNull() | (ms == 0) | (F.size(fit) == 0), every).otherwise(fit))
    return out


def sql_category(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({x}), '{k}') THEN '{v}'" for k, v in CATEGORIES) + " ELSE 'unknown' END"


def sql_slots() -> str:
    each = []
    for name, slots in SLOTS.items():
        every = "[" + ", ".join(f"'{s}'" for s in slots) + "]::VARCHAR[]"
        fit = f"list_filter({every}, lambda s: " + (" OR ".join(f"(s = '{s}' AND 2 * ms BETWEEN {IDEAL_MS[s][0]} AND {3 * IDEAL_MS[s][1]})" for s in slots) or "false") + ")"
        each.append(f"WHEN category = '{name}' THEN CASE WHEN ms IS NULL OR ms = 0 OR len({fit}) = 0 THEN {every} ELSE {fit} END")
    return "CASE " + " ".join(each) + " END"


FILES = f"""
f AS (SELECT page_id, {sql_category('html')} AS category, CASE WHEN page_id % 9 = 0 THEN NULL ELSE length(html) % 2500 END AS ms, CASE WHEN page_id % 11 = 0 THEN NULL ELSE -(page_id % 25) END AS peak FROM pages),
c AS (SELECT *, {sql_slots()} AS slots,
  CASE WHEN ms IS NULL THEN 'unknown' WHEN ms < 250 THEN 'very-short' WHEN ms < 600 THEN 'short' WHEN ms < 1500 THEN 'medium' ELSE 'long' END AS long,
  CASE WHEN peak IS NULL THEN 'unknown' WHEN peak >= -3 THEN 'loud' WHEN peak >= -9 THEN 'normal' WHEN peak >= -18 THEN 'soft' ELSE 'quiet' END AS loud FROM f)"""


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN10 over pages: a category by the words in a page, a length and a peak made from its size and id."""
    p = table(spark, sf_dir, "pages")
    f = p.select("page_id", T.first_match(F.col("html"), CATEGORIES, "unknown").alias("category"), F.when(F.col("page_id") % 9 != 0, F.length("html") % 2500).alias("ms"), F.when(F.col("page_id") % 11 != 0, -(F.col("page_id") % 25)).alias("peak"))
    long = F.when(F.col("ms").isNull(), "unknown").when(F.col("ms") < 250, "very-short").when(F.col("ms") < 600, "short").when(F.col("ms") < 1500, "medium").otherwise("long")
    loud = F.when(F.col("peak").isNull(), "unknown").when(F.col("peak") >= -3, "loud").when(F.col("peak") >= -9, "normal").when(F.col("peak") >= -18, "soft").otherwise("quiet")
    return f.withColumn("slots", suggested(F.col("category"), F.col("ms"))).withColumn("long", long).withColumn("loud", loud)


@Q.add(f"WITH {FILES.strip()} SELECT page_id, category, CAST(ms AS INTEGER) AS ms, array_to_string(slots, ',') AS slots, trim(replace(long || ' ' || loud || ' ' || category, 'unknown ', '')) AS description, CAST(-20 - coalesce(peak, -20) AS BIGINT) AS gain_db FROM c")
def sound_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN10, SCL18, SCL19, SCL22, SCL30, SRC5."""
    c = catalog_rows(spark, sf_dir)
    description = F.trim(F.replace(F.concat_ws(" ", "long", "loud", "category"), F.lit("unknown "), F.lit("")))
    return c.select("page_id", "category", "ms", F.array_join("slots", ",").alias("slots"), description.alias("description"), (-20 - F.coalesce("peak", F.lit(-20))).alias("gain_db"))


@Q.add(
    f"""WITH {FILES.strip()}, s AS (SELECT unnest([{', '.join(f"'{s}'" for s in IDEAL_MS)}]) AS slot), g AS (SELECT slots[1] AS slot, page_id, row_number() OVER (PARTITION BY slots[1] ORDER BY coalesce(ms, 0), page_id) AS place, count(*) OVER (PARTITION BY slots[1]) AS n FROM c WHERE len(slots) > 0)
SELECT slot, CAST(coalesce(n, 0) AS BIGINT) AS n, place, page_id FROM s LEFT JOIN g USING (slot)"""
)
def slot_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG9, AGG10, AGG16, SNK3: how many files each slot has, and each file's place in order of length; slots without any too."""
    slots = spark.createDataFrame([(s,) for s in IDEAL_MS], "slot string")
    files = catalog_rows(spark, sf_dir).where("size(slots) > 0").select(F.get("slots", F.lit(0)).alias("slot"), F.coalesce("ms", F.lit(0)).alias("ms"), "page_id")
    lines = reports.sections(files, "slot", ["ms", "page_id"], F.col("page_id").cast("string"), F.col("n").cast("string"))
    sizes = files.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    every = F.broadcast(slots).join(sizes, "slot", "left")  # fixed, a row a slot
    placed = lines.where("place > 0").select("slot", "place", F.col("line").cast("long").alias("page_id"))
    return every.join(placed, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("n"), "place", "page_id")


@Q.add(
    f"""WITH {FILES.strip()}, g AS (SELECT coalesce(slots[1], 'unmapped') AS slot, page_id, ms,
  '| ' || page_id || ' | ' || CASE WHEN ms IS NULL THEN '—' ELSE ((ms + 5) // 10) // 100 || '.' || lpad(CAST(((ms + 5) // 10) % 100 AS VARCHAR), 2, '0') || 's' END || ' | ' || CASE WHEN peak IS NULL THEN '—' WHEN peak >= 0 THEN '+' || peak || '.0 dB' ELSE peak || '.0 dB' END || ' | ' || category || ' | ' || CASE WHEN len(slots) > 1 THEN array_to_string(slots[2:], ', ') ELSE '—' END || ' |' AS line FROM c),
h AS (SELECT slot, 1 AS kind, coalesce(ms, 0) AS ms, page_id, line FROM g UNION ALL SELECT slot, 0, 0, 0, '## ' || slot || ' (' || count(*) || CASE WHEN count(*) = 1 THEN ' file)' ELSE ' files)' END FROM g GROUP BY slot)
SELECT slot, row_number() OVER (ORDER BY slot, kind, ms, page_id) - 1 AS line_no, line FROM h"""
)
def catalog_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: the catalogue as text, a line a row: of each slot that has files, and of those without a slot, a head and the files, shortest first. sources.records.write_lines writes it in order."""
    c, ms, peak = catalog_rows(spark, sf_dir), F.col("ms"), F.col("peak")
    hundredths = F.floor((ms + 5) / 10).cast("long")
    length = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit("s"))
    loud = F.concat(F.when(peak >= 0, "+").otherwise(""), peak.cast("string"), F.lit(".0 dB"))
    also = F.array_join(F.slice("slots", 2, 99), ", ")
    cells = (F.col("page_id").cast("string"), F.coalesce(length, F.lit("—")), F.coalesce(loud, F.lit("—")), F.col("category"), F.when(F.size("slots") > 1, also).otherwise("—"))
    files = c.select(F.coalesce(F.get("slots", F.lit(0)), F.lit("unmapped")).alias("slot"), F.coalesce(ms, F.lit(0)).alias("ms"), "page_id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("shown"))
    head = F.concat(F.lit("## "), "slot", F.lit(" ("), F.col("n").cast("string"), F.when(F.col("n") == 1, " file)").otherwise(" files)"))
    return reports.sections(files, "slot", ["ms", "page_id"], F.col("shown"), head).select("slot", "line_no", "line")


CHECKS = """
m AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id),
cap AS (SELECT conv_id, min(text) FILTER (turn = 1) AS caption FROM conversations GROUP BY conv_id),
th AS (SELECT DISTINCT page_id FROM pages WHERE page_id % 5 <> 0),
v AS (SELECT d.doc_id AS base, strlen(d.text) AS bytes, d.doc_id % 17 <> 0 AS audio, CASE WHEN d.doc_id % 23 = 0 THEN 720 ELSE 1080 END AS w, n_chars / 100.0 AS dur, caption, m.doc_id IS NOT NULL AS meta, quality, th.page_id IS NOT NULL AS thumb
  FROM documents d LEFT JOIN m USING (doc_id) LEFT JOIN cap ON cap.conv_id = d.doc_id LEFT JOIN th ON th.page_id = d.doc_id),
i AS (SELECT base, bytes,
  list_filter([CASE WHEN bytes = 0 THEN 'video: empty' END, CASE WHEN bytes > 0 AND NOT audio THEN 'video: silent' END, CASE WHEN bytes > 0 AND w <> 1080 THEN 'video: ' || w || ' wide' END,
    CASE WHEN bytes > 0 AND dur < 5 THEN 'video: short' END, CASE WHEN trim(coalesce(caption, '')) = '' THEN 'caption: none' END], lambda x: x IS NOT NULL) AS hard,
  list_filter([CASE WHEN NOT meta THEN 'record: none' END, CASE WHEN quality = 0 THEN 'record: no title' END, CASE WHEN NOT thumb THEN 'thumbnail: none' END], lambda x: x IS NOT NULL) AS soft FROM v)"""


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliverables with the captions, records and thumbnails that go with them: three left joins on the base name."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    m = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.lit(True).alias("meta"))
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min(F.when(F.col("turn") == 1, F.col("text"))).alias("caption"))
    thumbs = table(spark, sf_dir, "pages").where("page_id % 5 <> 0").select(F.col("page_id").alias("doc_id"), F.lit(True).alias("thumb")).distinct()
    v = d.join(m, "doc_id", "left").join(c, "doc_id", "left").join(thumbs, "doc_id", "left").withColumn("bytes", F.octet_length("text").cast("long"))
    there, width = F.col("bytes") > 0, F.when(F.col("doc_id") % 23 == 0, 720).otherwise(1080)
    hard = F.array_compact(
        F.array(
            F.when(~there, "video: empty"),
            F.when(there & (F.col("doc_id") % 17 == 0), "video: silent"),
            F.when(there & (width != 1080), F.concat(F.lit("video: "), width.cast("string"), F.lit(" wide"))),
            F.when(there & (F.col("n_chars") / 100 < 5), "video: short"),
            F.when(F.trim(F.coalesce("caption", F.lit(""))) == "", "caption: none"),
        )
    )
    soft = F.array_compact(F.array(F.when(F.col("meta").isNull(), "record: none"), F.when(F.col("quality") == 0, "record: no title"), F.when(F.col("thumb").isNull(), "thumbnail: none")))
    return v.select(F.col("doc_id").alias("base"), "bytes", hard.alias("hard"), soft.alias("soft"))


STATUS = "CASE WHEN len(hard) > 0 THEN 'FAIL' WHEN len(soft) > 0 THEN 'warn' ELSE 'ok' END"


def status() -> Column:
    return F.when(F.size("hard") > 0, "FAIL").when(F.size("soft") > 0, "warn").otherwise("ok")


@Q.add(f"WITH {CHECKS.strip()} SELECT base, {STATUS} AS status, array_to_string(list_concat(hard, soft), '; ') AS issues FROM i")
def deliverable_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN11, JOI11, FLT13."""
    return checked(spark, sf_dir).select("base", status().alias("status"), F.array_join(F.concat("hard", "soft"), "; ").alias("issues"))


@Q.add(f"WITH {CHECKS.strip()} SELECT {STATUS} AS status, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM i GROUP BY 1")
def deliverable_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11."""
    return checked(spark, sf_dir).groupBy(status().alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


SQL_SECRETS = ", ".join(f"({k}, '{name}', '{p.replace(chr(39), chr(39) * 2)}', {int('(?i)' in p)})" for k, (name, p) in enumerate(T.SECRETS.items()))


#: Names for the documents, so that some are files that aren't scanned.
NAMES = ("a.py", "notes", "b.txt", "clip.MP4", "c.md", "uv.lock", "d.tar.gz", "e.json", "package-lock.json", "f.lock")


@Q.add(
    rf"""WITH f AS (SELECT * FROM documents WHERE NOT list_contains([3, 5, 6, 8], doc_id % 10)), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM f),
h AS (SELECT doc_id, line_no, name, CASE WHEN g = 1 THEN regexp_extract(line, p, 1) ELSE regexp_extract(line, p, 0) END AS s FROM l, (VALUES {SQL_SECRETS}) v(k, name, p, g) WHERE regexp_matches(line, p) AND NOT regexp_matches(line, '{T.OPT_OUT}'))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, name, CASE WHEN length(s) <= 12 THEN repeat('*', length(s)) ELSE s[1:4] || '...' || s[-4:] END AS shown FROM h"""
)
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN13, FLT14, SCL23."""
    files = table(spark, sf_dir, "documents").where(~F.coalesce(T.skipped(F.get(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 10).cast("int"))), F.lit(False)))
    lines = files.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).where(~F.col("line").rlike(T.OPT_OUT))
    # one array of the patterns that match, so lines without any aren't multiplied
    hits = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.struct(F.lit(name).alias("name"), F.regexp_extract("line", p, int("(?i)" in p)).alias("s"))) for name, p in T.SECRETS.items())))
    found = lines.select("doc_id", (F.col("k") + 1).alias("line_no"), F.explode(hits).alias("h"))
    return found.select("doc_id", "line_no", "h.name", T.redacted(F.col("h.s")).alias("shown"))


TIMES = ("09:00", "13:30", "18:00", "21:15")
PER_DAY = 3


@Q.add(
    f"""WITH c AS (SELECT doc_id AS base, text FROM documents), u AS (SELECT CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) ELSE page_id || '.mp4' END AS key, url FROM pages), m AS (SELECT doc_id, max(quality * 10 + toxic) AS score FROM labels GROUP BY doc_id),
items AS (SELECT base, coalesce(u1.url, u2.url) AS media, text, coalesce(score, 0) AS score FROM c LEFT JOIN u u1 ON u1.key = base || '.mp4' LEFT JOIN u u2 ON u2.key = CAST(base AS VARCHAR) LEFT JOIN m ON m.doc_id = base WHERE coalesce(u1.url, u2.url) IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, base) AS k FROM items),
l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: s <> '') AS ls FROM r)
SELECT base, media, CAST(score AS INTEGER) AS score, strftime(DATE '2026-01-05' + CAST((k - 1) // {PER_DAY} AS INTEGER), '%Y-%m-%d') || 'T' || [{', '.join(f"'{t}'" for t in TIMES)}][(k - 1) % {PER_DAY} + 1] || ':00' AS publish_at, coalesce(ls[1], '')[1:100] AS title FROM l"""
)
def publish_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN12, JOI12, JOI13, TIM13, SRT4, SCL16, LIM3: three posts a day, a slot for every item, the best first."""
    items = publishable(spark, sf_dir).select("base", "media", "score", T.first_line(F.col("caption")).alias("title"), (-F.col("score")).alias("down"))
    return publishing.scheduled(items, ["down", "base"], "2026-01-05", TIMES, PER_DAY).select("base", "media", "score", "publish_at", "title")


def publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as captions with an address among the pages, by the name with or without its ending; their best score, and tags of their language, source and first words."""
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("base"), F.col("text").alias("caption"), F.concat(F.array("lang", "source"), F.regexp_extract_all(F.substring("text", 1, 200), F.lit("([A-Za-z]+)"), F.lit(1))).alias("tags"))
    p = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string")).otherwise(F.concat(F.col("page_id").cast("string"), F.lit(".mp4"))).alias("key"), "url")
    m = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("base")).agg(F.max(F.col("quality") * 10 + F.col("toxic")).alias("score"))
    first, second = p.toDF("k1", "u1"), p.toDF("k2", "u2")
    both = c.join(first, F.concat(F.col("base").cast("string"), F.lit(".mp4")) == F.col("k1"), "left").join(second, F.col("base").cast("string") == F.col("k2"), "left")
    items = both.withColumn("media", F.coalesce("u1", "u2")).where("media is not null").join(m, "base", "left")
    return items.select("base", "media", "caption", "tags", F.coalesce("score", F.lit(0)).alias("score"))


POSTED = ("facebook", "instagram", "tiktok", "youtube", "linkedin", "threads")


@Q.add(
    f"""WITH c AS (SELECT doc_id AS base, regexp_replace(text, '^[ \t\n\r\v\f]+|[ \t\n\r\v\f]+$', '', 'g') AS caption, list_concat([lang, source], regexp_extract_all(text[1:200], '[A-Za-z]+'))[1:10] AS tags FROM documents),
u AS (SELECT CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) ELSE page_id || '.mp4' END AS key, url FROM pages), m AS (SELECT doc_id, max(quality * 10 + toxic) AS score FROM labels GROUP BY doc_id),
items AS (SELECT base, coalesce(u1.url, u2.url) AS media, caption, tags, coalesce(score, 0) AS score FROM c LEFT JOIN u u1 ON u1.key = base || '.mp4' LEFT JOIN u u2 ON u2.key = CAST(base AS VARCHAR) LEFT JOIN m ON m.doc_id = base WHERE coalesce(u1.url, u2.url) IS NOT NULL AND caption IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, base) AS k, coalesce(list_filter(list_transform(string_split(caption, chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(13))), lambda s: s <> '')[1], '')[1:100] AS title FROM items),
d AS (SELECT *, strftime(DATE '2026-03-01' + CAST((k - 1) // 2 AS INTEGER), '%Y-%m-%d') || 'T' || ['09:00', '18:00'][(k - 1) % 2 + 1] || ':00' AS due FROM r)
SELECT base, due || '-06:00' AS date, md5(CAST(json_object('blogId', 'b-1', 'date', due || '-06:00', 'base', base, 'info', json_object('autoPublish', true, 'draft', false, 'text', caption, 'media', [media], 'mediaAltText', CAST([] AS VARCHAR[]), 'shortener', false,
  'smartLinkData', json_object('ids', CAST([] AS VARCHAR[])), 'firstCommentText', '', 'publicationDate', json_object('dateTime', due, 'timezone', 'America/Chicago'), 'providers', list_transform([{quoted(POSTED)}], lambda n: json_object('network', n)),
  'facebookData', json_object('type', 'REEL', 'title', title), 'instagramData', json_object('type', 'REEL', 'showReelOnFeed', true), 'tiktokData', json_object('title', title), 'youtubeData', json_object('title', title, 'type', 'short', 'privacy', 'public', 'madeForKids', false, 'tags', tags),
  'linkedinData', json_object(), 'threadsData', json_object())) AS VARCHAR)) AS payload_md5 FROM d"""
)
def publish_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN12, SNK6: the records that are sent, with their networks' blocks and tags, two a day."""
    items = publishable(spark, sf_dir).withColumn("title", F.lit(None).cast("string"))
    made = publishing.payloads(items, POSTED, "b-1", "2026-03-01", ("09:00", "18:00"), 3, "America/Chicago", "-06:00")
    return made.select("base", "date", F.md5("payload").alias("payload_md5"))


@Q.add(
    """WITH l AS (SELECT DISTINCT doc_id FROM labels), e AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id)
SELECT doc_id, CASE WHEN l.doc_id IS NULL AND n_chars > 100 THEN 'transcribe' WHEN l.doc_id IS NULL THEN 'skip' WHEN e.user_id IS NULL OR epoch_us(e.last) < epoch_us(TIMESTAMP '2024-01-15') + doc_id * 86400000000 THEN 'redo' ELSE 'done' END AS plan FROM documents LEFT JOIN l USING (doc_id) LEFT JOIN e ON e.user_id = documents.doc_id"""
)
def work_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI19, JOI20, SNK9, JOI8: what has no result yet, what is older than its input, what is done."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    done = table(spark, sf_dir, "labels").select("doc_id").distinct()
    made = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last"))
    new = d.join(done, "doc_id", "left_anti").select("doc_id", F.when(F.col("n_chars") > 100, "transcribe").otherwise("skip").alias("plan"))
    old = d.join(done, "doc_id", "left_semi").join(made, "doc_id", "left")
    needed = F.unix_micros(F.lit("2024-01-15").cast("timestamp")) + F.col("doc_id") * 86_400_000_000
    return new.unionByName(old.select("doc_id", F.when(F.col("last").isNull() | (F.col("last") < needed), "redo").otherwise("done").alias("plan")))


@Q.add(
    """WITH b AS (SELECT o_custkey AS k, o_orderkey, o_orderstatus, o_orderdate, o_totalprice FROM orders),
r AS (SELECT k, o_orderkey, row_number() OVER (PARTITION BY k ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS p FROM b)
SELECT c_custkey, c_name, n_name, o_orderkey AS best_order FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN r ON r.k = c_custkey AND p = 1"""
)
def preferred_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI7, JOI8, JOI10, TOP1: by preference of kind, then the newest."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    best = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderkey", F.struct(kind.alias("kind"), (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("age"), F.col("o_orderkey").alias("tie"))).alias("best_order"))
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(best, "c_custkey", "left").select("c_custkey", "c_name", "n_name", "best_order")


@Q.add(
    """WITH r AS (SELECT *, -CAST(floor(o_totalprice / 50000) AS INTEGER) AS s FROM orders WHERE o_totalprice >= 100000),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) AS rank FROM r)
SELECT o_custkey, CAST(rank AS INTEGER) AS rank, o_orderkey, -s AS score FROM k WHERE rank <= 5"""
)
def ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT2, WIN11, SRT1, LIM1, LIM2."""
    o = table(spark, sf_dir, "orders").where("o_totalprice >= 100000").withColumn("score", F.floor(F.col("o_totalprice") / 50000).cast("int"))
    ranked = o.withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("score"), "o_orderkey")))
    return ranked.where("rank <= 5").select("o_custkey", "rank", "o_orderkey", "score")


DETECTIONS = """
raw AS (SELECT l_suppkey AS clip_id, l_extendedprice / 25.0 AS cx, l_quantity * 40.0 AS cy, 100.0 + l_partkey % 400 AS h FROM lineitem),
a AS (SELECT *, h >= 180.0 AS p0 FROM raw),
h90 AS (SELECT clip_id, list_sort(list(h))[greatest(1, CAST(floor(count(*) * 0.9) AS BIGINT))] AS h90 FROM a WHERE p0 GROUP BY clip_id),
b AS (SELECT a.*, coalesce(p0 AND h >= 0.7 * h90, false) AS p1 FROM a LEFT JOIN h90 USING (clip_id)),
q AS (SELECT clip_id, count(*) AS n, list_sort(list(cx)) AS xs, list_sort(list(cy)) AS ys FROM b WHERE p1 GROUP BY clip_id),
i AS (SELECT clip_id, n, xs[n // 4 + 1] AS x1, xs[3 * n // 4 + 1] AS x3, ys[n // 4 + 1] AS y1, ys[3 * n // 4 + 1] AS y3 FROM q),
c AS (SELECT b.*, p1 AND (n < 6 OR (cx BETWEEN x1 - 2.5 * greatest(x3 - x1, 1.0) AND x3 + 2.5 * greatest(x3 - x1, 1.0) AND cy BETWEEN y1 - 2.5 * greatest(y3 - y1, 1.0) AND y3 + 2.5 * greatest(y3 - y1, 1.0))) AS p2 FROM b LEFT JOIN i USING (clip_id)),
t AS (SELECT *, count(*) FILTER (p0) OVER (PARTITION BY clip_id) AS n0, count(*) FILTER (p2) OVER (PARTITION BY clip_id) AS n2 FROM c),
m AS (SELECT clip_id, count(*) AS n_used, median(cx) AS cx, median(cy) AS cy, median(h) AS h FROM t WHERE CASE WHEN n2 >= 8 THEN p2 WHEN n0 >= 8 THEN p0 ELSE true END GROUP BY clip_id),
s AS (SELECT *, cx BETWEEN 384.0 AND 3456.0 AND cy BETWEEN 216.0 AND 1944.0 AS safe FROM m),
z AS (SELECT *, CASE WHEN safe THEN cx ELSE greatest(384.0, least(cx, 3456.0)) END AS x, CASE WHEN safe THEN cy ELSE greatest(216.0, least(cy, 1944.0)) END AS y, greatest(614.4 / h, 1920.0 / 2160.0) AS zoom FROM s)"""


@Q.add(
    f"""WITH {DETECTIONS.strip()}
SELECT clip_id, n_used, CAST(cx AS DOUBLE) AS cx, CAST(cy AS DOUBLE) AS cy, CAST(h AS DOUBLE) AS h, CAST(zoom AS DOUBLE) AS zoom,
  CAST(round_even(greatest(0.0, least(x - 540.0 / zoom, 3840.0 - 1080.0 / zoom)), 0) AS BIGINT) AS crop_x, CAST(round_even(greatest(0.0, least(y - 768.0 / zoom, 2160.0 - 1920.0 / zoom)), 0) AS BIGINT) AS crop_y,
  CAST(round_even(1080.0 / zoom, 0) AS BIGINT) AS crop_w, CAST(round_even(1920.0 / zoom, 0) AS BIGINT) AS crop_h FROM z"""
)
def robust_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN9, FLT6, FLT7, FLT8, FLT9, AGG4, AGG5, AGG6, AGG8, TIM14."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("clip_id"), (F.col("l_extendedprice") / 25.0).alias("cx"), (F.col("l_quantity") * 40.0).alias("cy"), (100.0 + F.col("l_partkey") % 400).alias("h"))
    return stats.robust_center(d, 3840, 2160)


@Q.add(
    """WITH g AS (SELECT p_brand, list_sort(list(p_retailprice)) AS v, count(*) AS n FROM part GROUP BY p_brand)
SELECT p_brand, v[CAST(round_even(0.1 * (n - 1), 0) AS BIGINT) + 1] AS p10, v[CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1] AS p50, v[CAST(round_even(0.9 * (n - 1), 0) AS BIGINT) + 1] AS p90 FROM g"""
)
def nearest_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7."""
    return stats.percentiles(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
