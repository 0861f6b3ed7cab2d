"""Text, JSON and time functions over whole columns, small set operations, sources and logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions import timecalc as C
from spanloom.plans.common import Queries, table
from spanloom.plans.timeline import WORDS, timeline

Q = Queries()

D = T.DASHES
SQL_DASHED = rf"""
dashed AS (SELECT doc_id, source, replace(replace(text, ' the ', ' — '), ' la ', '–') || ' 2020 – 2021 #tag-x ok' AS t FROM documents),
d1 AS (SELECT *, regexp_replace(t, '([0-9])\s*[{D}]\s*([0-9])', '\1-\2', 'g') AS a FROM dashed),
d2 AS (SELECT *, regexp_replace(regexp_replace(a, '\s*[{D}]\s*', ', ', 'g'), '\s+([,.!?;:])', '\1', 'g') AS b FROM d1),
d3 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(b, ',\s*,', ',', 'g'), '(^|\n)\s*,\s*', '\1', 'g'), '[ \t][ \t]+', ' ', 'g') AS clean FROM d2),
h1 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]*#[\pL\pN_][\pL\pN_-]*', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g') AS bare FROM d3)"""


def dashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with dashes and a tag put in, since the tables have none."""
    t = F.concat(F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" — ")), F.lit(" la "), F.lit("–")), F.lit(" 2020 – 2021 #tag-x ok"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", t.alias("t"))


@Q.add(rf"WITH {SQL_DASHED.strip()} SELECT doc_id, md5(clean) AS clean_md5, CAST(length(clean) AS INTEGER) AS n_clean, md5(trim(bare, ' ' || chr(9) || chr(10) || chr(13))) AS bare_md5 FROM h1")
def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL11, SCL12."""
    d = dashed(spark, sf_dir).select("doc_id", T.without_dashes(F.col("t")).alias("clean"), T.without_hashtags(F.col("t")).alias("bare"))
    return d.select("doc_id", F.md5("clean").alias("clean_md5"), F.length("clean").alias("n_clean"), F.md5("bare").alias("bare_md5"))


@Q.add(
    rf"""SELECT p_partkey, trim(regexp_replace(replace(replace(replace(translate(lower('Łódź œuvre Щи ' || p_name || ' É' || p_type), 'éłóź', 'eloz'), 'œ', 'oe'), 'щ', 'shch'), 'и', 'i'), '[^a-z0-9]+', '-', 'g'), '-')[1:40] AS slug,
  regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, regexp_matches(p_type, '[$£€]|[0-9]') AS has_number, length(p_name) AS n,
  CASE WHEN length(p_name) <= 12 THEN repeat('*', length(p_name)) ELSE p_name[1:4] || '...' || p_name[-4:] END AS hidden,
  sha1(p_type) AS type_sha1,
  'rgba(245, 200, 66, ' || CAST(p_size AS VARCHAR) || ')' AS tint, upper(p_name) || chr(10) || chr(10) || 'Follow for more.' AS caption FROM part"""
)
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL1, SCL2, SCL9, SCL23, SCL27."""
    p = table(spark, sf_dir, "part")
    name = F.col("p_name")
    return p.select(
        "p_partkey",
        T.slug(F.concat(F.lit("Łódź œuvre Щи "), name, F.lit(" É"), "p_type"), 40).alias("slug"),
        T.letters_and_digits(name).alias("key"),
        F.col("p_type").rlike("[$£€]|[0-9]").alias("has_number"),
        F.length(name).cast("long").alias("n"),
        T.redacted(name).alias("hidden"),
        F.sha1("p_type").alias("type_sha1"),
        T.with_alpha(F.lit("#f5c842"), F.col("p_size")).alias("tint"),
        F.concat(F.upper(name), F.lit("\n\nFollow for more.")).alias("caption"),
    )


ACCENTS = ("idiot", "the", "Licensed")


@Q.add(
    rf"""WITH l AS (SELECT item_id, string_split(text, chr(10)) AS ls FROM benchmark),
w AS (SELECT item_id, list_transform(ls, lambda s: array_to_string(list_transform(string_split(replace(upper(s), 'ẞ', 'SS'), ' '), lambda w:
  CASE WHEN upper(rtrim(trim(w), '.,!?:;')) IN ('IDIOT', 'THE', 'LICENSED') THEN '<span class="em-gold">' || replace(replace(replace(replace(replace(w, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') || '</span>'
  ELSE replace(replace(replace(replace(replace(w, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') END), ' ')) AS ls FROM l)
SELECT item_id, array_to_string(ls, '<br>') AS html FROM w"""
)
def overlay_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL14."""
    return table(spark, sf_dir, "benchmark").select("item_id", T.overlay(F.col("text"), ACCENTS, "gold").alias("html"))


@Q.add(
    r"""WITH r AS (SELECT event_id, 'Here: ```json' || chr(10) || '[' || props || ', ' || props || ']' || chr(10) || '``` done' AS a, 'log' || chr(10) || '{"input_i": "' || CAST(event_id % 40 - 30 AS VARCHAR) || '"}' AS b, user_id, event_type FROM events),
x AS (SELECT *, regexp_extract(a, '(?s)\[.*\]') AS arr, regexp_extract(b, '(?s)\{.*\}') AS obj FROM r)
SELECT event_id, CAST(json_array_length(arr) AS INTEGER) AS n, CAST(json_extract(arr, '$[1].k') AS BIGINT) AS k, CAST(json_extract_string(obj, '$.input_i') AS BIGINT) AS loudness,
  'loudnorm=I=-14.0:measured_I=' || json_extract_string(obj, '$.input_i') AS apply_filter, 'between(t,' || user_id || ',' || (user_id + 5) || ')+between(t,' || (user_id + 9) || ',' || (user_id + 12) || ')' AS select_filter,
  CASE WHEN contains(event_type, 'click') THEN 'tap' WHEN contains(event_type, 'view') THEN 'look' ELSE 'other' END AS hint FROM x"""
)
def json_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL20, SCL21, SCL29, SCL34."""
    e = table(spark, sf_dir, "events")
    a = F.concat(F.lit("Here: ```json\n["), "props", F.lit(", "), "props", F.lit("]\n``` done"))
    b = F.concat(F.lit('log\n{"input_i": "'), (F.col("event_id") % 40 - 30).cast("string"), F.lit('"}'))
    x = e.withColumn("arr", F.from_json(T.json_array_slice(a), "array<struct<k:bigint>>")).withColumn("obj", F.from_json(T.json_object_slice(b), "struct<input_i:string>"))
    between = lambda p, q: F.concat(F.lit("between(t,"), (F.col("user_id") + p).cast("string"), F.lit(","), (F.col("user_id") + q).cast("string"), F.lit(")"))
    return x.select(
        "event_id",
        F.size("arr").alias("n"),
        F.get("arr", F.lit(1))["k"].alias("k"),
        F.col("obj.input_i").cast("long").alias("loudness"),
        F.concat(F.lit("loudnorm=I=-14.0:measured_I="), "obj.input_i").alias("apply_filter"),
        F.array_join(F.array(between(0, 5), between(9, 12)), "+").alias("select_filter"),
        T.first_match(F.col("event_type"), (("click", "tap"), ("view", "look")), "other").alias("hint"),
    )


@Q.add(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '{"facebookData":{"type":"REEL","title":"' || s_name || '"},"threadsData":{}}' ELSE '{"tiktokData":{"title":"' || s_name || '"}}' END AS network_data,
  CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN (CAST(floor(b * 10 / 1024 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor(b * 10 / 1024 + 0.5) AS BIGINT) % 10) || ' KB' WHEN b < 1073741824 THEN (CAST(floor(b * 10 / 1048576 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor(b * 10 / 1048576 + 0.5) AS BIGINT) % 10) || ' MB' ELSE (CAST(floor(b * 10 / 1073741824 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor(b * 10 / 1073741824 + 0.5) AS BIGINT) % 10) || ' GB' END AS size,
  format('{:,}', b) AS count_up, CASE s_nationkey % 3 WHEN 0 THEN '#f5c842' WHEN 1 THEN '#ff3653' ELSE coalesce(nullif(s_name[1:0], ''), '#ffffff') END AS color
FROM (SELECT *, s_suppkey * s_suppkey * 7919 AS b FROM supplier)"""
)
def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL24, SCL33, SCL36."""
    b = F.col("s_suppkey") * F.col("s_suppkey") * 7919
    even = F.col("s_suppkey") % 2 == 0
    record = F.to_json(
        F.struct(
            F.when(even, F.struct(F.lit("REEL").alias("type"), F.col("s_name").alias("title"))).alias("facebookData"),
            F.when(~even, F.struct(F.col("s_name").alias("title"))).alias("tiktokData"),
            F.when(even, F.expr("map()").cast("map<string,string>")).alias("threadsData"),
        )
    )
    color = T.lookup((F.col("s_nationkey") % 3).cast("string"), {"0": "#f5c842", "1": "#ff3653"}, "#ffffff")
    return table(spark, sf_dir, "supplier").select("s_suppkey", record.alias("network_data"), T.human_bytes(b).alias("size"), F.format_number(b, 0).alias("count_up"), color.alias("color"))


SQL_ENVELOPES = """
f AS (SELECT event_id, value * 3 AS len, unnest(range(0, 10)) AS i FROM events WHERE value > 0),
t AS (SELECT event_id, len, i, i * 0.3 AS t FROM f)"""


@Q.add(
    f"""WITH {SQL_ENVELOPES.strip()}
SELECT event_id, round(sum(CASE WHEN t <= len THEN sin(pi() * t / len) ELSE 0 END), 6) AS bell, round(sum(CASE WHEN t / len > 1 THEN 0 WHEN t / len < 0.25 THEN t / len / 0.25 ELSE (1 - t / len) / 0.75 END), 6) AS ramp,
  round(sum(greatest(0, least(1, least(t / (len / 4), (len - t) / (len / 4))))), 6) AS fade FROM t GROUP BY event_id"""
)
def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIM11: curves of each event sampled at ten times."""
    e = table(spark, sf_dir, "events").where("value > 0").select("event_id", (F.col("value") * 3).alias("len"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    e = e.withColumn("t", F.col("i") * 0.3)
    t, n = F.col("t"), F.col("len")
    return e.groupBy("event_id").agg(F.round(F.sum(C.bell(t, n)), 6).alias("bell"), F.round(F.sum(C.ramp(t, n)), 6).alias("ramp"), F.round(F.sum(C.fade(t, n, n / 4)), 6).alias("fade"))


@Q.add(
    f"""WITH {WORDS}, z AS (SELECT *, start_ms - min(start_ms) OVER (PARTITION BY source_id) AS s0, max(end_ms) OVER (PARTITION BY source_id) AS dur FROM words)
SELECT source_id, CAST(sum(CAST(floor(s0 * 30 / 1000.0 + 0.5) AS BIGINT)) AS BIGINT) AS frames, CAST(sum(greatest(1, CAST(floor((end_ms - start_ms) * 30 / 1000.0 + 0.5) AS BIGINT))) AS BIGINT) AS lengths, CAST(ceil(max(dur) * 30 / 1000.0) AS BIGINT) AS total,
  CAST(greatest(300, least(max(dur) // 2, max(dur) - 100)) AS BIGINT) AS thumb_ms, CAST(count(*) FILTER (start_ms - 50 <= dur // 2 AND dur // 2 < end_ms + 50) AS BIGINT) AS active, CAST(count(*) FILTER (end_ms + 50 <= dur // 2) AS BIGINT) AS spoken FROM z GROUP BY source_id"""
)
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIM1, TIM7, TIM10, TIM12."""
    whole = Window.partitionBy("source_id")
    w = timeline(spark, sf_dir).withColumn("s0", F.col("start_ms") - F.min("start_ms").over(whole)).withColumn("dur", F.max("end_ms").over(whole))
    first, _ = C.frames(F.col("s0"), F.col("s0"), 30)
    _, many = C.frames(F.col("start_ms"), F.col("end_ms"), 30)
    half = F.expr("dur div 2")
    dur = F.max("dur")
    return w.groupBy("source_id").agg(
        F.sum(first).alias("frames"),
        F.sum(many).alias("lengths"),
        F.ceil(dur * 30 / 1000).cast("long").alias("total"),
        C.clamp(F.floor(dur / 2), F.lit(300), dur - 100).cast("long").alias("thumb_ms"),
        F.count_if((F.col("start_ms") - 50 <= half) & (half < F.col("end_ms") + 50)).alias("active"),
        F.count_if(F.col("end_ms") + 50 <= half).alias("spoken"),
    )


@Q.add(
    f"""WITH {WORDS},
ch AS (SELECT source_id, pos // 5 AS chunk, min(start_ms) AS s, max(end_ms) AS e FROM words GROUP BY ALL),
tt AS (SELECT source_id, k, max(end_ms) * k // 9 AS t FROM words, (SELECT unnest(range(1, 10)) AS k) GROUP BY source_id, k)
SELECT tt.source_id, CAST(k AS INTEGER) AS k, coalesce(min(chunk) FILTER (t BETWEEN s - 50 AND e + 250), max(chunk) FILTER (t > e)) AS chunk FROM tt LEFT JOIN ch ON ch.source_id = tt.source_id AND s - 50 <= t GROUP BY tt.source_id, k"""
)
def chunk_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN16: the first chunk that ends 250 ms before a time at the earliest, if it has begun 50 ms after it at the latest; else the last one that ended before.
    Chunks follow one another, so both are neighbours in one sorted stream of chunks' ends and times, looked at from either side."""
    w = timeline(spark, sf_dir)
    ch = w.groupBy("source_id", F.floor(F.col("pos") / 5).alias("chunk")).agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e")).withColumn("c", F.struct("chunk", "s", "e"))
    times = w.groupBy("source_id").agg(F.max("end_ms").alias("l")).select("source_id", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("k"), "l").withColumn("t", F.expr("l * k div 9"))
    none = F.lit(None).cast(dict(ch.dtypes)["c"])
    ends = ch.select("source_id", F.explode(F.array(F.struct((F.col("e") + 250).alias("at"), F.col("c").alias("o"), none.alias("p")), F.struct(F.col("e").alias("at"), none.alias("o"), F.col("c").alias("p")))).alias("x"))
    stream = ends.select("source_id", F.lit(0).alias("k"), "x.*").unionByName(times.select("source_id", "k", F.col("t").alias("at"), none.alias("o"), none.alias("p")))
    # at one time: the ends 250 ms later stand before the times from behind, the ends themselves behind the times from the front
    so_far = (Window.unboundedPreceding, 0)
    back = Window.partitionBy("source_id").orderBy(F.desc("at"), "k", F.desc("o.chunk")).rowsBetween(*so_far)
    forth = Window.partitionBy("source_id").orderBy("at", F.desc("k"), "p.chunk").rowsBetween(*so_far)
    seen = stream.withColumn("ahead", F.last("o", True).over(back)).withColumn("behind", F.last("p", True).over(forth)).where("k > 0")
    return seen.select("source_id", "k", F.when(F.col("ahead.s") - 50 <= F.col("at"), F.col("ahead.chunk")).otherwise(F.col("behind.chunk")).alias("chunk"))


@Q.add(
    """WITH u AS (SELECT n_name AS k, 0 AS o FROM nation UNION ALL SELECT upper(r_name), 1 FROM region UNION ALL SELECT c_mktsegment, 2 FROM customer),
f AS (SELECT k, o, row_number() OVER (PARTITION BY k ORDER BY o) AS r FROM u)
SELECT k, CAST(o AS INTEGER) AS o, k NOT IN (SELECT r_name FROM region) AS new_key FROM f WHERE r = 1"""
)
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET3, SET4, SRC17."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("k"), F.lit(0).alias("o"))
    r = table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("k"), F.lit(2).alias("o"))
    first = n.union(r.select(F.upper("r_name"), F.lit(1))).union(c).groupBy("k").agg(F.min("o").alias("o"))
    old = r.select(F.col("r_name").alias("k"), F.lit(True).alias("old")).distinct()
    return first.join(old, "k", "left").select("k", "o", F.col("old").isNull().alias("new_key"))


@Q.add(
    """SELECT user_id, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS ok, string_agg(DISTINCT CAST(event_id % 10 AS VARCHAR), ',' ORDER BY CAST(event_id % 10 AS VARCHAR)) AS steps,
  bool_or(event_id % 10 = 3) AS step3 FROM events GROUP BY user_id"""
)
def progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG17, SNK7: what an append-only log of steps says is done."""
    e = table(spark, sf_dir, "events")
    step = (F.col("event_id") % 10).cast("string")
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("ok"), F.array_join(F.sort_array(F.collect_set(step)), ",").alias("steps"), F.bool_or(F.col("event_id") % 10 == 3).alias("step3"))


@Q.add(
    """WITH a AS (SELECT p_partkey % 50 AS slot, p_partkey AS file FROM part), e AS (SELECT ps AS slot, file FROM (SELECT p_partkey % 50 AS ps, p_partkey AS file FROM part WHERE p_size > 10))
SELECT CAST(slot AS BIGINT) AS slot, count(*) AS n, string_agg(CAST(file AS VARCHAR), ',' ORDER BY file) AS files FROM a SEMI JOIN e USING (slot, file) GROUP BY slot"""
)
def existing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4: a pack's files that exist, slots without any gone."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("slot"), F.col("p_partkey").alias("file"), "p_size")
    there = p.where("p_size > 10").select("slot", "file")
    kept = p.select("slot", "file").join(there, ["slot", "file"], "left_semi")
    files = F.array_join(F.transform(F.sort_array(F.collect_list("file")), lambda x: x.cast("string")), ",")
    return kept.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), files.alias("files"))


@Q.add(
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 43200000000 THEN 0 ELSE 1 END AS o FROM events),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of streaming.sessions: events no more than twelve hours apart."""
    from spanloom.streaming.sessions import sessions

    return sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "12 hours")
