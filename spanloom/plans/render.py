"""Records for rendering: cleaned callouts, their tracks and key times, slides that fit, file predicates, API answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import cues, intervals, projects
from spanloom.plans.common import Queries, table

Q = Queries()

DURATION = 30_000
SQL_CALLOUTS = f"""
raw AS (SELECT conv_id, turn, trim(text) AS text, turn * 6500 AS t, 400 + turn * 900 AS len, ['explosion', 'Punch', 'bigstat', 'hero', 'caption'][turn % 5 + 1] AS style, ['orange', 'cyan', 'gold', 'Green', 'mauve'][(conv_id + turn) % 5 + 1] AS color FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
s AS (SELECT *, greatest(0, least(t, {DURATION} - 500)) AS start_ms FROM raw WHERE text <> ''),
co AS (SELECT conv_id, turn, CAST(start_ms AS BIGINT) AS start_ms, CAST(greatest(600, least(len, {DURATION} - start_ms)) AS BIGINT) AS duration_ms,
  CASE WHEN lower(style) IN ('caption', 'punch', 'bigstat', 'hero') THEN lower(style) ELSE 'caption' END AS style,
  CASE lower(color) WHEN 'orange' THEN 'red' WHEN 'cyan' THEN 'gold' WHEN 'gold' THEN 'gold' WHEN 'red' THEN 'red' WHEN 'green' THEN 'green' ELSE 'gold' END AS color,
  CAST(10 + row_number() OVER (PARTITION BY conv_id ORDER BY start_ms, turn) AS INTEGER) AS track FROM s)"""


def callouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as callouts: blank ones dropped, times held to the clip, styles and colours to the known ones, tracks by time."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null and trim(text) <> ''")
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), k.cast("int"))
    style = F.lower(pick(("explosion", "Punch", "bigstat", "hero", "caption"), F.col("turn") % 5))
    color = F.lower(pick(("orange", "cyan", "gold", "Green", "mauve"), (F.col("conv_id") + F.col("turn")) % 5))
    start = F.greatest(F.lit(0), F.least(F.col("turn") * 6500, F.lit(DURATION - 500)))
    made = c.select("conv_id", "turn", start.cast("long").alias("start_ms"), (400 + F.col("turn") * 900).alias("len"), style.alias("style"), color.alias("color"))
    order = Window.partitionBy("conv_id").orderBy("start_ms", "turn")
    return made.select(
        "conv_id",
        "turn",
        "start_ms",
        F.greatest(F.lit(600), F.least(F.col("len"), DURATION - F.col("start_ms"))).cast("long").alias("duration_ms"),
        F.when(F.col("style").isin("caption", "punch", "bigstat", "hero"), F.col("style")).otherwise("caption").alias("style"),
        T.lookup(F.col("color"), {"orange": "red", "cyan": "gold", "gold": "gold", "red": "red", "green": "green"}, "gold").alias("color"),
        (10 + F.row_number().over(order)).alias("track"),
    )


SQL_HOOKS = """
hk AS (SELECT conv_id, CAST(NULL AS BIGINT) AS turn, CAST(0 AS BIGINT) AS start_ms, CAST(1500 + conv_id % 4 * 500 AS BIGINT) AS duration_ms, 'hook' AS style, CASE WHEN conv_id % 2 = 0 THEN 'gold' ELSE 'red' END AS color, 9 AS track, CASE WHEN conv_id % 4 = 0 THEN '' ELSE 'Overline' END AS overline
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL AND conv_id % 3 <> 0)),
cues AS (SELECT conv_id, turn, start_ms, duration_ms, style, color, track, NULL AS overline FROM co UNION ALL SELECT * FROM hk)"""


def hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three conversations open with a hook, some of them with an overline."""
    k = table(spark, sf_dir, "conversations").where("conv_id % 3 <> 0").select("conv_id").distinct()
    return k.select("conv_id", F.lit(None).cast("long").alias("turn"), (1500 + F.col("conv_id") % 4 * 500).alias("duration_ms"), F.when(F.col("conv_id") % 2 == 0, "gold").otherwise("red").alias("color"), F.when(F.col("conv_id") % 4 == 0, "").otherwise("Overline").alias("overline"))


def all_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = callouts(spark, sf_dir).withColumn("overline", F.lit(None).cast("string"))
    return cues.on_tracks(said, hooks(spark, sf_dir), "conv_id", "turn")


@Q.add(f"""WITH {SQL_CALLOUTS.strip()}, {SQL_HOOKS.strip()} SELECT conv_id, turn, '{{"track":' || track || ',"style":"' || style || '","color":"' || color || '","start_ms":' || start_ms || ',"duration_ms":' || duration_ms || '}}' AS record FROM cues""")
def callout_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT12, TIM2, TIM8, TIM16, SNK2, SNK5, SNK6: the hook at 0 on track 9, callouts on the tracks from 11 on."""
    return all_cues(spark, sf_dir).select("conv_id", "turn", F.to_json(F.struct(F.col("track").cast("int").alias("track"), "style", "color", "start_ms", "duration_ms")).alias("record"))


@Q.add(
    f"""WITH {SQL_CALLOUTS.strip()}, {SQL_HOOKS.strip()},
k AS (SELECT * FROM (VALUES ('punch', 'in', 0, 0, 400), ('punch', 'out', 1, -350, 350), ('bigstat', 'in', 0, 0, 300), ('bigstat', 'eyebrow', 0, 50, 450), ('bigstat', 'number', 0, 180, 600), ('bigstat', 'subline', 0, 550, 500),
  ('bigstat', 'out', 1, -400, 400), ('hero', 'in', 0, 0, 550), ('hero', 'out', 1, -400, 400), ('caption', 'in', 0, 0, 550), ('caption', 'out', 1, -400, 400), ('hook', 'background', 0, 0, 180), ('hook', 'flash', 0, 30, 120),
  ('hook', 'flash-out', 0, 180, 450), ('hook', 'overline', 0, 140, 420), ('hook', 'headline', 0, 200, 500), ('hook', 'rule', 0, 700, 450), ('hook', 'out', 1, -420, 420)) v(style, name, tail, off, len))
SELECT conv_id, turn, style, name, CAST(start_ms + tail * duration_ms + off AS BIGINT) AS at_ms, CAST(len AS INTEGER) AS len_ms FROM cues JOIN k USING (style) WHERE name <> 'overline' OR overline <> ''"""
)
def key_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIM17: one row a key frame of each callout's style, and of the hook."""
    return cues.key_frames(all_cues(spark, sf_dir)).select("conv_id", "turn", "style", "name", "at_ms", "len_ms")


@Q.add(f"""WITH d AS (SELECT event_id, 5000 + event_id % 20001 AS dur FROM events) SELECT event_id, unnest(['zoom-in', 'zoom-out']) AS name, CAST(unnest([0, dur // 2]) AS BIGINT) AS at_ms, CAST(unnest([dur // 2, dur - dur // 2]) AS BIGINT) AS len_ms FROM d""")
def camera_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIM17: the camera's two moves over a clip."""
    return cues.camera(table(spark, sf_dir, "events").select("event_id", (5000 + F.col("event_id") % 20001).alias("duration_ms"))).drop("duration_ms")


@Q.add(
    f"""WITH {SQL_CALLOUTS.strip()},
sl AS (SELECT conv_id, turn AS slide, turn * 4100 AS start_ms, turn * 4100 + 2000 - (turn % 4) * 700 AS end_ms FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
SELECT conv_id, slide, start_ms, end_ms FROM sl WHERE end_ms > start_ms AND end_ms <= {DURATION} + 50 AND NOT EXISTS (SELECT 1 FROM co WHERE co.conv_id = sl.conv_id AND sl.start_ms < co.start_ms + co.duration_ms AND sl.end_ms > co.start_ms)"""
)
def valid_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT10, JOI5: slides that run forwards, end with the clip and meet no callout."""
    s = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    s = s.select("conv_id", F.col("turn").alias("slide"), (F.col("turn") * 4100).alias("start_ms"), (F.col("turn") * 4100 + 2000 - F.col("turn") % 4 * 700).alias("end_ms"))
    c = callouts(spark, sf_dir).select("conv_id", "start_ms", (F.col("start_ms") + F.col("duration_ms")).alias("end_ms"))
    return intervals.without_overlap(s.where(f"end_ms > start_ms and end_ms <= {DURATION + 50}"), c, ["conv_id"], 5000)


@Q.add(
    r"""SELECT page_id, hex(encode(html))[1:4] IN ('FFD8', '8950', '4749') AND strlen(html) >= 2048 AS is_image, strlen(html) >= 2048 AS is_large, regexp_matches(split_part(url, '/', -1), '^(final_remotion|final_sfx|_)') AS is_output,
  CASE url[-1] WHEN '1' THEN 'bold' WHEN '2' THEN 'minimal' ELSE 'default' END AS style, regexp_replace(url, '[0-9]+', '0.00', 'g') AS timeless FROM pages"""
)
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT15, FLT16, SRC8."""
    p = table(spark, sf_dir, "pages")
    magic = F.hex(F.substring(F.encode("html", "UTF-8"), 1, 2))
    large = F.octet_length("html") >= 2048
    return p.select(
        "page_id",
        (magic.isin("FFD8", "8950", "4749") & large).alias("is_image"),
        large.alias("is_large"),
        F.substring_index("url", "/", -1).rlike("^(final_remotion|final_sfx|_)").alias("is_output"),
        T.lookup(F.right("url", F.lit(1)), {"1": "bold", "2": "minimal"}, "default").alias("style"),
        F.regexp_replace("url", "[0-9]+", "0.00").alias("timeless"),
    )


@Q.add(
    """WITH j AS (SELECT event_id, '{"a":{"w":' || event_id % 1000 || ',"url":"u' || event_id || '"},"b":{"w":' || user_id * 7 || ',"url":"v' || event_id || '"}}' AS answer FROM events),
x AS (SELECT event_id, unnest(['a', 'b']) AS key, answer FROM j)
SELECT event_id, json_extract_string(answer, '$.' || key || '.url') AS url, CAST(json_extract(answer, '$.' || key || '.w') AS INTEGER) AS width FROM x WHERE CAST(json_extract(answer, '$.' || key || '.w') AS INTEGER) >= 600"""
)
def api_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12's parsing half: the pictures that an answer's map names, if wide enough."""
    e = table(spark, sf_dir, "events")
    part = lambda key, w, u: F.concat(F.lit(f'"{key}":{{"w":'), w.cast("string"), F.lit(f',"url":"{u}'), F.col("event_id").cast("string"), F.lit('"}'))
    answer = F.concat(F.lit("{"), part("a", F.col("event_id") % 1000, "u"), F.lit(","), part("b", F.col("user_id") * 7, "v"), F.lit("}"))
    each = e.select("event_id", F.explode(F.map_values(F.from_json(answer, "map<string,struct<w:int,url:string>>"))).alias("x"))
    return each.select("event_id", "x.url", F.col("x.w").alias("width")).where("width >= 600")


# ---------------------------------------------------------------- projects

HEAD, TAIL = projects.PAGE.split("{title}")[0], projects.PAGE.split("{cues}")[1]


def as_sql(text: str) -> str:
    """A text for SQL, its line ends by their number."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@Q.add(
    f"""WITH {SQL_CALLOUTS.strip()},
cl AS (SELECT conv_id AS source_id, 1 + conv_id % 120 AS rank, CASE conv_id % 3 WHEN 0 THEN 'talk-' || conv_id WHEN 1 THEN '' END AS slug, CASE WHEN conv_id % 4 > 0 THEN 'What "' || conv_id || '" means' END AS hook_text, CASE WHEN conv_id % 5 > 0 THEN 'It lands.' END AS reasoning,
  CASE WHEN conv_id % 2 = 0 THEN 'Look — here #now ' || conv_id END AS told FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) k WHERE conv_id % 11 <> 0),
p AS (SELECT *, coalesce(nullif(slug, ''), CASE WHEN conv_k % 2 = 0 THEN 'cut-' || conv_k ELSE 'clip-' || rank END) AS name, 9000 + conv_k % 977 * 13 AS dur FROM (SELECT *, source_id AS conv_k FROM cl)),
q AS (SELECT *, 'short-' || CASE WHEN rank < 10 THEN '0' ELSE '' END || rank || '-' || name AS folder, trim(coalesce(hook_text, replace(coalesce(slug, ''), '-', ' '))) AS hook FROM p),
cap AS (SELECT *, CASE WHEN told IS NOT NULL THEN 'Look, here ' || source_id ELSE CASE WHEN hook <> '' THEN upper(hook) ELSE hook END || chr(10) || chr(10) || coalesce(reasoning, 'Save this for later, it lands harder the second time.') || chr(10) || chr(10) || 'Follow for more.' END || chr(10) AS caption FROM q),
cu AS (SELECT conv_id AS source_id, string_agg('<div class="cue ' || style || ' ' || color || '" data-track-index="' || track || '" data-start="' || start_ms // 1000 || '.' || lpad(CAST(start_ms % 1000 AS VARCHAR), 3, '0') || '" data-duration="' || duration_ms // 1000 || '.' || lpad(CAST(duration_ms % 1000 AS VARCHAR), 3, '0') || '">turn ' || turn || '</div>', chr(10) ORDER BY track) AS cues FROM co GROUP BY conv_id),
wo AS (SELECT conv_id AS source_id, string_agg('{{"text":"' || role || '","start":' || CAST(turn * 6500 / 1000.0 AS DOUBLE) || ',"end":' || CAST((turn * 6500 + 400) / 1000.0 AS DOUBLE) || '}}', ',' ORDER BY turn, role) AS words FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id),
f AS (SELECT source_id || '/' || folder AS root, *, '{{"id":"' || folder || '","name":"Short ' || CASE WHEN rank < 10 THEN '0' ELSE '' END || rank || ' — ' || coalesce(replace(hook_text, '"', chr(92) || '"'), '') || '","width":1080,"height":1920,"fps":30,"clip":{{"viral_score":' || CASE WHEN source_id % 7 = 0 THEN 'null' ELSE CAST(source_id % 10 AS VARCHAR) END || ',"hook_text":' || coalesce('"' || replace(hook_text, '"', chr(92) || '"') || '"', 'null')
  || ',"hook_start":0.0,"hook_end":null,"reasoning":' || coalesce('"' || reasoning || '"', 'null') || ',"source_video":"v' || source_id || '.mp4","source_segments":[[0.0,' || CAST(dur / 1000.0 AS DOUBLE) || ']],"snapped_segments":null,"duration":' || CAST(dur / 1000.0 AS DOUBLE) || '}}}}' AS meta FROM cap LEFT JOIN cu USING (source_id) LEFT JOIN wo USING (source_id))
SELECT root || '/index.html' AS path, {as_sql(HEAD)} || 'Short ' || CASE WHEN rank < 10 THEN '0' ELSE '' END || rank || ' — ' || name || '</title></head>' || chr(10) || '<body><div id="' || folder || '" data-duration="' || dur // 1000 || '.' || lpad(CAST(dur % 1000 AS VARCHAR), 3, '0') || '">' || chr(10) || '<video src="assets/clip-edit.mp4"></video>' || chr(10) || coalesce(cues, '') || {as_sql(TAIL)} AS content FROM f
UNION ALL SELECT root || '/meta.json', meta FROM f UNION ALL SELECT root || '/assets/words.json', '[' || coalesce(words, '') || ']' FROM f UNION ALL SELECT root || '/caption.txt', caption FROM f UNION ALL SELECT root || '.txt', caption FROM f"""
)
def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2: of each conversation as a clip its project's files: page, record, words and captions. One of eleven has no clip, and no project."""
    k = F.col("conv_id")
    c = table(spark, sf_dir, "conversations").where("conv_id is not null")
    each = c.select("conv_id").distinct().withColumn("rank", (1 + k % 120).cast("int"))
    length = 9000 + k % 977 * 13
    none = F.lit(None).cast("string")
    clips = each.where("conv_id % 11 <> 0").select(
        k.alias("source_id"), "rank", F.when(k % 3 == 0, F.concat(F.lit("talk-"), k.cast("string"))).when(k % 3 == 1, "").alias("slug"), F.when(k % 7 != 0, k % 10).alias("viral_score"), F.when(k % 4 > 0, F.concat(F.lit('What "'), k.cast("string"), F.lit('" means'))).alias("hook_text"),
        F.lit(0.0).alias("hook_start"), F.lit(None).cast("double").alias("hook_end"), F.when(k % 5 > 0, "It lands.").alias("reasoning"), F.array(F.array(F.lit(0.0), length / 1000)).alias("segments"), F.when(k % 2 == 0, F.concat(F.lit("Look — here #now "), k.cast("string"))).alias("instagram_caption"),
    )
    path = lambda n, name: F.when(k % n == 0, name).alias(name)
    manifests = each.select(
        k.alias("source_id"), "rank", F.when(k % 2 == 0, F.concat(F.lit("cut-"), k.cast("string"))).alias("slug"), path(2, "vertical_path"), path(3, "enhanced_path"), path(5, "cleaned_path"), path(1, "raw_path"),
        none.alias("snapped_segments"), F.concat(F.lit("v"), k.cast("string"), F.lit(".mp4")).alias("source_video"), length.cast("long").alias("duration_ms"),
    )
    made = projects.projects(manifests, clips)
    shown = callouts(spark, sf_dir).select(k.alias("source_id"), (1 + k % 120).cast("int").alias("rank"), "track", "style", "color", "start_ms", "duration_ms", F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("html"))
    at = F.col("turn") * 6500
    said = c.where("turn is not null").select(k.alias("source_id"), (1 + k % 120).cast("int").alias("rank"), at.alias("start_ms"), (at + 400).alias("end_ms"), F.struct(F.col("role").alias("text"), (at / 1000).alias("start"), ((at + 400) / 1000).alias("end")).alias("item"))
    return projects.files(made, shown, said)
