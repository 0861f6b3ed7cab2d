"""Plans put together from several operators: entity slides, clips, render records, effects; and the look-ups and checks before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import params as P
from spanloom.functions import text as T
from spanloom.operators import checks, clips, effects, entities, folders, intervals, lookups, publishing, render, styles, words
from spanloom.plans.common import Queries, quoted, table
from spanloom.plans.planning import CALLOUTS, FX, OVERLAYS, SLIDES, callouts, lengths, marks, overlays, semantic, sounding
from spanloom.plans.timeline import WORDS, timeline

Q = Queries()


def either(*values: str | None, at: Column) -> Column:
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), at.cast("int"))


# ---------------------------------------------------------------- slides of entities

#: type, key in lower case, name, milliseconds; in the order they are placed. A type that isn't a slide's is dropped.
ENTITIES = (
    ("logo", "which", "Which", 2200), ("logo", "in the", "In", 2200), ("logo", "avec", "Avec", 2200), ("logo", "of the", "Of", 2200), ("logo", "from", "From", 2200), ("logo", "have", "From", 2200),
    ("logo", "und", "Und", 2200), ("clip", "que", "Que", 2200), ("person", "para", "Para", 3500), ("person", "nicht", "Nicht", 3500), ("person", "la de", "Lade", 3500), ("person", "the", "The", 3500),
)
CAP = 4
#: Of the queries' styles.
DEFAULT_STYLE = "algeria"
ENTITY_ROWS = [(k, *e, len(e[1].split())) for k, e in enumerate(ENTITIES)]
EDGE = r"[^\pL\pN_]"


@Q.add(
    rf"""WITH RECURSIVE {WORDS.strip()}, {CALLOUTS.strip()}, {OVERLAYS.strip()},
rows AS (SELECT source_id, start_ms, end_ms, 0 AS last FROM ov UNION ALL SELECT source_id, dur, NULL, 1 FROM dur),
cur AS (SELECT *, greatest(0, coalesce(max(end_ms) OVER (PARTITION BY source_id ORDER BY last, start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS cursor FROM rows),
gaps AS (SELECT source_id, cursor + 200 AS ga, start_ms - 200 AS gb FROM cur WHERE start_ms - cursor >= 2400),
lexi AS (SELECT * FROM (VALUES {', '.join(map(str, ENTITY_ROWS))}) v(k, type, key, name, len, n)),
gm AS (SELECT source_id, start_ms, trim(lower(text), '.,!?') AS b1, trim(lower(text), '.,!?') || ' ' || trim(lower(lead(text) OVER (PARTITION BY source_id ORDER BY pos)), '.,!?') AS b2 FROM words),
hit AS (SELECT source_id, k, min(start_ms) AS t FROM gm JOIN lexi ON key = CASE n WHEN 1 THEN b1 ELSE b2 END GROUP BY ALL),
low AS (SELECT source_id, lower(array_to_string(toks, ' ')) AS low FROM w0),
held AS (SELECT hit.*, type, name, len FROM hit JOIN lexi USING (k) JOIN low USING (source_id) WHERE CASE type WHEN 'person' THEN contains(low, key) ELSE regexp_matches(low, '(^|{EDGE})' || key || '($|{EDGE})') END),
once AS (SELECT * FROM held QUALIFY type = 'person' OR row_number() OVER (PARTITION BY source_id, type = 'person', name ORDER BY k) = 1),
want AS (SELECT source_id, k AS pos, type, name, t AS start_ms, t + len AS end_ms FROM once),
p AS (SELECT w.*, q, CASE q WHEN 0 THEN start_ms + end_ms WHEN 1 THEN 2 * start_ms ELSE 2 * end_ms END AS t2 FROM want w, (SELECT unnest([0, 1, 2]) AS q)),
b AS (SELECT p.*, ga, gb, row_number() OVER (PARTITION BY p.source_id, pos ORDER BY q, ga) AS r FROM p JOIN gaps g ON p.source_id = g.source_id AND t2 BETWEEN 2 * ga AND 2 * gb),
fit AS (SELECT source_id, pos, type, name, greatest(ga, least(start_ms, gb - size)) AS start_ms, greatest(ga, least(start_ms, gb - size)) + size AS end_ms FROM (SELECT *, least(greatest(end_ms - start_ms, 2000), 4500, gb - ga) AS size FROM b WHERE r = 1)),
own AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pos) AS place FROM (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY source_id, start_ms, end_ms ORDER BY pos) = 1)),
o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, pos) AS k FROM own WHERE place <= {CAP} AND type IN ({quoted(render.MADE_TYPES)})),
g2(source_id, k, reach, kept) AS (SELECT source_id, k, end_ms, true FROM o WHERE k = 1 UNION ALL SELECT o.source_id, o.k, CASE WHEN o.start_ms >= reach THEN o.end_ms ELSE reach END, o.start_ms >= reach FROM g2 JOIN o ON o.source_id = g2.source_id AND o.k = g2.k + 1)
SELECT source_id, CAST(pos AS INTEGER) AS entity, type, name, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms FROM o JOIN g2 USING (source_id, k) WHERE kept"""
)
def entity_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN7, JOI16, SEQ5, FLT11, SEQ4, LIM2: slides of entities at their first mention, in the lexicon's order into what the overlays leave free. A mention
    needs the words in a row and the key in the joined text (a logo's between word edges). A logo's name counts once, by its first key that is mentioned; no
    two slides get the same span, and there are CAP at most; of those that overlap the earlier stays."""
    lexicon = spark.createDataFrame([r[:-1] for r in ENTITY_ROWS], "k int, type string, key string, name string, len int")
    starts, sizes = words.phrase_starts(timeline(spark, sf_dir), lexicon.select(F.col("key").alias("phrase")))
    grams = [(F.concat(F.lit("="), F.array_join(F.slice("next", 1, n), " ")), F.array_contains("sizes", n) & (F.size("next") >= n)) for n in sizes]
    m = marks(starts, *grams)
    ends = lengths(m)
    gaps = intervals.free_gaps(overlays(callouts(spark, sf_dir, ends), ends), ends.withColumnRenamed("dur", "duration_ms"), "source_id")
    first_said = m.where("slot like '=%'").groupBy("source_id", F.expr("substring(slot, 2)").alias("key")).agg(F.min("t").alias("t"))
    joined = F.lower(F.array_join(F.regexp_extract_all("text", F.lit(r"([^ \t\n\r]+)"), F.lit(1)), " "))
    texts = table(spark, sf_dir, "documents").where("text is not null and doc_id is not null").select(F.col("doc_id").alias("source_id"), joined.alias("text"))
    made = entities.slides(entities.mentioned(first_said, texts, lexicon), gaps, render.MADE_TYPES, CAP)
    return made.select("source_id", F.col("entity").cast("int").alias("entity"), "type", "name", "start_ms", "end_ms")


# ---------------------------------------------------------------- clips

CLIPS = f"""
last AS (SELECT source_id, arg_max(end_ms, pos) AS max_t FROM words GROUP BY source_id),
raw AS (SELECT o_custkey AS source_id, o_orderkey AS k, CASE WHEN o_orderkey % 19 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 97 * 1000 AS VARCHAR) END AS s0, o_orderkey % 97 * 1000 + CAST(floor(o_totalprice) AS BIGINT) % 200 * 1000 - 2000 AS end_ms, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 10 END AS score, o_orderpriority AS hook FROM orders),
cast_ AS (SELECT *, TRY_CAST(s0 AS BIGINT) AS start_ms FROM raw),
ok AS (SELECT c.*, coalesce(score, 5) AS s FROM cast_ c LEFT JOIN last USING (source_id) WHERE end_ms > start_ms AND end_ms <= coalesce(max_t, 0) + 1000 AND end_ms - start_ms BETWEEN 5000 AND 180000),
co AS (SELECT *, [{{'ls': CAST(k % 10 AS VARCHAR), 'd': NULL, 't': ' Hi ' || k, 'c': NULL}}, {{'ls': CASE WHEN k % 2 = 0 THEN 'soon' ELSE '2.5' END, 'd': '1', 't': 'x', 'c': ' RED '}}, {{'ls': '3', 'd': CASE WHEN k % 3 = 0 THEN '2' ELSE 'long' END, 't': CASE WHEN k % 4 = 0 THEN NULL ELSE 'y' END, 'c': 'Gold'}}] AS raw_co FROM ok)"""


@Q.add(
    f"""WITH {WORDS}, {CLIPS.strip()}
SELECT source_id, k, CAST(row_number() OVER (PARTITION BY source_id ORDER BY s DESC, k) AS INTEGER) AS rank, start_ms, CAST(end_ms AS BIGINT) AS end_ms, CAST(s AS BIGINT) AS score, CAST(least(start_ms + 10000, end_ms) AS BIGINT) AS hook_end_ms, trim(regexp_replace(lower(hook), '[^a-z0-9]+', '-', 'g'), '-')[1:40] AS slug,
  CASE WHEN k % 3 = 0 THEN start_ms ELSE start_ms + 1000 END AS first_start_ms, CASE WHEN k % 3 = 0 THEN 1 ELSE 2 END AS n_segments,
  array_to_string(list_transform(list_filter(raw_co, lambda x: TRY_CAST(x.ls AS DOUBLE) IS NOT NULL AND x.t IS NOT NULL AND (x.d IS NULL OR TRY_CAST(x.d AS DOUBLE) IS NOT NULL)),
    lambda x: CAST(CAST(round(CAST(x.ls AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round(coalesce(CAST(x.d AS DOUBLE), 1.6) * 1000) AS BIGINT) AS VARCHAR) || ':' || trim(x.t) || ':' || lower(trim(coalesce(x.c, 'cyan')))), '|') AS callouts FROM co"""
)
def normalized_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN6, FLT1, FLT3, FLT4, SCL1, SCL37, WIN11: orders in the part of raw clips, some malformed; a clip ends a second behind the source's last word at the latest. Segments
    that don't run forwards are dropped, and the whole clip stands where none is left; callouts without a time or text, or with a bad value, go, and the others get their defaults."""
    last = timeline(spark, sf_dir).groupBy("source_id").agg(F.max_by("end_ms", "pos").alias("max_t"))
    k = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("source_id"),
        k.alias("k"),
        F.when(k % 19 == 0, "n/a").otherwise((k % 97 * 1000).cast("string")).try_cast("long").alias("start_ms"),
        (k % 97 * 1000 + F.floor("o_totalprice") % 200 * 1000 - 2000).alias("end_ms"),
        F.coalesce(F.when(k % 5 != 0, k % 10), F.lit(5)).alias("score"),
        F.col("o_orderpriority").alias("hook"),
    )
    ok = raw.join(last, "source_id", "left").where("end_ms > start_ms and end_ms <= coalesce(max_t, 0) + 1000 and end_ms - start_ms between 5000 and 180000")
    parts = F.expr("case when k % 3 = 0 then array(struct(end_ms as s, start_ms as e)) else array(struct(start_ms + 1000 as s, end_ms as e), struct(start_ms as s, start_ms + 1000 as e), struct(end_ms as s, end_ms as e)) end")
    good = F.filter(parts, lambda x: x["e"] > x["s"])
    good = F.when(F.size(good) > 0, good).otherwise(F.expr("array(struct(start_ms as s, end_ms as e))"))
    said = F.expr(
        """array(struct(cast(k % 10 as string) as ls, cast(null as string) as d, concat(' Hi ', k) as t, cast(null as string) as c), struct(if(k % 2 = 0, 'soon', '2.5') as ls, '1' as d, 'x' as t, ' RED ' as c),
        struct('3' as ls, if(k % 3 = 0, '2', 'long') as d, if(k % 4 = 0, null, 'y') as t, 'Gold' as c))"""
    )
    fine = F.filter(said, lambda x: x["ls"].try_cast("double").isNotNull() & x["t"].isNotNull() & (x["d"].isNull() | x["d"].try_cast("double").isNotNull()))
    in_ms = lambda x: F.round(x * 1000).cast("long").cast("string")
    shown = F.transform(fine, lambda x: F.concat_ws(":", in_ms(x["ls"].try_cast("double")), in_ms(F.coalesce(x["d"].try_cast("double"), F.lit(1.6))), F.trim(x["t"]), F.lower(F.trim(F.coalesce(x["c"], F.lit("cyan"))))))
    made = ok.withColumn("segments", good).withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "k")))
    return made.select("source_id", "k", "rank", "start_ms", "end_ms", "score", F.least(F.col("start_ms") + 10000, F.col("end_ms")).alias("hook_end_ms"), T.slug(F.col("hook"), 40).alias("slug"), F.get("segments", F.lit(0))["s"].alias("first_start_ms"), F.size("segments").alias("n_segments"), F.array_join(shown, "|").alias("callouts"))


@Q.add(
    """WITH r AS (SELECT o_custkey AS source_id, o_orderkey AS k, o_orderkey % 97 AS s, o_orderkey % 97 + o_orderkey % 61 + 2 AS e, o_orderpriority AS p, coalesce(last, 0) AS last FROM orders LEFT JOIN (SELECT c_custkey, c_custkey % 90 + 20 AS last FROM customer WHERE c_custkey % 10 <> 0) ON c_custkey = o_custkey),
f AS (SELECT *, CASE k % 7 WHEN 1 THEN 5 ELSE k % 10 END AS score FROM r WHERE k % 19 <> 0 AND e - s BETWEEN 5 AND 180 AND e <= last + 1 AND k % 6 NOT IN (3, 5) AND k % 7 <> 0)
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY score DESC, k) AS INTEGER) AS rank, k, CAST(s * 1000 AS BIGINT) AS start_ms, CAST(e * 1000 AS BIGINT) AS end_ms, CAST(score AS INTEGER) AS score, CAST(least(s + 10, e) * 1000 AS BIGINT) AS hook_end_ms,
  trim(regexp_replace(lower(p), '[^a-z0-9]+', '-', 'g'), '-')[1:40] AS slug, CASE k % 6 WHEN 1 THEN (s + 1) * 1000 ELSE s * 1000 END || '-' || e * 1000 AS segments, k % 5 * 1000 || ':1600:Hi ' || k || ':::cyan|2500:2000:y:A:E:red' AS callouts FROM f"""
)
def clip_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN6, FLT1, FLT3, FLT4, SCL1, SCL37, WIN11: orders as a picker's answers, a JSON record each, of several shapes, some malformed."""
    k = F.col("o_orderkey")
    s, e = (k % 97).cast("string"), (k % 97 + k % 61 + 2).cast("string")
    part = {1: F.concat(F.lit("[["), (k % 97 + 1).cast("string"), F.lit(","), e, F.lit("],["), e, F.lit(","), s, F.lit("]]")), 2: F.concat(F.lit('[{"start":"'), s, F.lit('","end":'), e, F.lit('},{"start":'), e, F.lit(',"end":'), s, F.lit("}]")), 3: F.lit('[["x",5]]'), 4: F.lit("[[1],[],null]"), 5: F.lit("[7]")}
    parts = F.when(F.lit(False), F.lit(""))
    for n, x in part.items():
        parts = parts.when(k % 6 == n, F.concat(F.lit(',"segments":'), x))
    score = F.when(k % 7 == 0, ',"viral_score":"x"').when(k % 7 == 1, "").otherwise(F.concat(F.lit(',"viral_score":'), (k % 10).cast("string")))
    said = F.concat(F.lit(',"callouts":[{"local_start":'), (k % 5).cast("string"), F.lit(',"text":" Hi '), k.cast("string"), F.lit(' "},{"local_start":"x","text":"t"},{"local_start":"2.5","duration":"2","text":"y","accent":["A"],"eyebrow":" E ","color":" RED "}]'))
    record = F.concat(F.lit('{"start":'), F.when(k % 19 == 0, '"x"').otherwise(s), F.lit(',"end":'), e, F.lit(',"hook_text":"'), "o_orderpriority", F.lit('"'), F.coalesce(parts, F.lit("")), score, said, F.lit("}"))
    raw = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), k.alias("place"), record.alias("record"))
    lengths = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") % 90 + 20).cast("double").alias("last_end"))
    ms = lambda x: (x * 1000).cast("long")
    shown = F.transform("callouts", lambda c: F.concat_ws(":", ms(c["local_start"]).cast("string"), ms(c["duration"]).cast("string"), c["text"], F.array_join(c["accent"], ","), c["eyebrow"], c["color"]))
    spans = F.transform("segments", lambda x: F.concat(ms(x["start"]).cast("string"), F.lit("-"), ms(x["end"]).cast("string")))
    made = clips.normalized(raw, lengths)
    return made.select("source_id", "rank", F.col("place").alias("k"), ms(F.col("start")).alias("start_ms"), ms(F.col("end")).alias("end_ms"), F.col("viral_score").alias("score"), ms(F.col("hook_end")).alias("hook_end_ms"), "slug", F.array_join(spans, "|").alias("segments"), F.array_join(shown, "|").alias("callouts"))


# ---------------------------------------------------------------- render records

PALETTE = render.PALETTE
RENDER = f"""
n AS (SELECT source_id, count(*) FILTER (trim(lower(text), '.,!?;:—-') NOT IN ({quoted([f for f in P.TABLE_FILLERS if ' ' not in f])})) AS n_words FROM words GROUP BY source_id),
man AS (SELECT source_id, i, i * 9000 + source_id % 7 * 300 AS a, i * 9000 + source_id % 7 * 300 + 2500 - i % 3 * 1300 AS b FROM dur, (SELECT unnest(range(0, 5)) AS i)),
auto AS (SELECT source_id, i, i * 4700 + 3000 AS a, i * 4700 + 6000 AS b FROM dur, (SELECT unnest(range(0, 9)) AS i)),
mrg AS (SELECT * FROM man UNION ALL SELECT * FROM auto WHERE NOT EXISTS (SELECT 1 FROM man m WHERE m.source_id = auto.source_id AND auto.a < m.b AND auto.b > m.a)),
br AS (SELECT m.*, (source_id + i) % 3 = 0 AS badge FROM mrg m JOIN dur USING (source_id) WHERE b > a AND b <= dur + 50 AND NOT EXISTS (SELECT 1 FROM ov WHERE ov.source_id = m.source_id AND m.a < ov.end_ms AND m.b > ov.start_ms)),
brs AS (SELECT source_id, count(*) AS n_broll, count(*) FILTER (NOT badge) AS n_full, string_agg(a || '-' || b || CASE WHEN badge THEN 'b' ELSE '' END, ',' ORDER BY a, b) AS broll FROM br GROUP BY source_id),
ovs AS (SELECT source_id, count(*) AS n_overlays FROM ov GROUP BY source_id),
fx AS (SELECT source_id, CAST(sum(m) AS BIGINT) AS n_fx FROM (SELECT source_id, 3 AS m, 50 AS t FROM words WHERE pos = 0 UNION ALL SELECT source_id, 1, t FROM c WHERE ding UNION ALL SELECT source_id, 2, t FROM lex WHERE k = 1) e JOIN dur USING (source_id) WHERE t <= dur GROUP BY source_id)"""


def full_slides(ends: DataFrame, over: DataFrame) -> DataFrame:
    """Of each source the manual and automatic slides that stand, badges among them."""
    a = F.col("i") * 9000 + F.col("source_id") % 7 * 300
    manual = ends.select("source_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("source_id", "i", a.cast("long").alias("start_ms"), (a + 2500 - F.col("i") % 3 * 1300).cast("long").alias("end_ms"))
    auto = ends.select("source_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i")).select("source_id", "i", (F.col("i") * 4700 + 3000).cast("long").alias("start_ms"), (F.col("i") * 4700 + 6000).cast("long").alias("end_ms"))
    return render.standing_slides(manual, auto, over, ends).withColumn("badge", (F.col("source_id") + F.col("i")) % 3 == 0)


@Q.add(
    f"""WITH {WORDS}, {CALLOUTS.strip()}, {OVERLAYS.strip()}, {RENDER.strip()}
SELECT source_id, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, 'overlay' AS kind FROM ov UNION ALL SELECT source_id, CAST(a AS BIGINT), CAST(b AS BIGINT), 'slide' FROM br WHERE NOT badge"""
)
def caption_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET5: the windows in which captions yield, badges not among them."""
    ends = lengths(marks(timeline(spark, sf_dir)))
    over = overlays(callouts(spark, sf_dir, ends), ends)
    return styles.yields(over, full_slides(ends, over))


@Q.add(
    f"""WITH st AS (SELECT lower(n_name) AS name, '#' || lpad(CAST(n_nationkey * 37 AS VARCHAR), 6, '0') AS gold, CASE WHEN n_nationkey % 3 > 0 THEN '#' || lpad(CAST(n_nationkey * 91 AS VARCHAR), 6, '0') END AS red FROM nation WHERE n_nationkey % 2 = 0),
c AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'unheard-of' ELSE lower(n_name) END AS style FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, coalesce(a.name, d.name) AS style, coalesce(CASE WHEN a.name IS NULL THEN d.gold ELSE a.gold END, '{PALETTE['primary']}') AS color_primary, coalesce(CASE WHEN a.name IS NULL THEN d.red ELSE a.red END, '{PALETTE['secondary']}') AS color_secondary, CAST(round_even(c_acctbal / 8.0 * 1000, 0) AS BIGINT) AS delay_ms
FROM c LEFT JOIN st a ON a.name = c.style LEFT JOIN st d ON d.name = 'algeria'"""
)
def styled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8, SCL38, TIM9: each customer's style, the default one where it names none that there is, and its colours, those of the palette where the style has none."""
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("name"))
    hexed = lambda x: F.concat(F.lit("#"), F.lpad(x.cast("string"), 6, "0"))
    looks = nation.where("n_nationkey % 2 = 0").select("name", hexed(n * 37).alias("gold"), F.when(n % 3 > 0, hexed(n * 91)).alias("red"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == n).select("c_custkey", "c_acctbal", F.when(k % 5 == 0, None).when(k % 7 == 0, "unheard-of").otherwise(F.col("name")).alias("style"))
    made = styles.with_style(c, "style", looks, DEFAULT_STYLE)
    return made.select("c_custkey", F.col("look.name").alias("style"), F.coalesce("look.gold", F.lit(PALETTE["primary"])).alias("color_primary"), F.coalesce("look.red", F.lit(PALETTE["secondary"])).alias("color_secondary"), styles.delay_ms(F.col("c_acctbal") / 8.0).alias("delay_ms"))


@Q.add(
    f"""WITH {WORDS}, {CALLOUTS.strip()}, {OVERLAYS.strip()}, {RENDER.strip()}
SELECT source_id, dur AS duration_ms, n_words, coalesce(n_overlays, 0) AS n_overlays, coalesce(n_broll, 0) AS n_broll, coalesce(broll, '') AS broll, coalesce(n_overlays, 0) + coalesce(n_full, 0) AS n_yield, coalesce(n_fx, 0) AS n_fx,
  CASE WHEN source_id % 4 = 1 THEN '#aa8800' ELSE '{PALETTE['primary']}' END AS color_primary, CASE WHEN source_id % 4 IN (1, 2) THEN '#990000' ELSE '{PALETTE['secondary']}' END AS color_secondary,
  CAST(round(CASE WHEN bot + 250 + 1300 <= lim THEN bot + 250 WHEN top - 1550 >= 500 THEN top - 1550 ELSE dt END / 10000.0, 4) AS DOUBLE) AS band_top
FROM dur JOIN n USING (source_id) LEFT JOIN ovs USING (source_id) LEFT JOIN brs USING (source_id) LEFT JOIN fx USING (source_id)
JOIN (SELECT source_id, source_id % 100 * 100 AS top, source_id % 100 * 100 + 2000 AS bot, ['tiktok', 'instagram', 'youtube', 'generic'][source_id % 4 + 1] AS platform FROM dur) f USING (source_id)
JOIN (VALUES ('tiktok', 8600, 6000), ('instagram', 8400, 5800), ('youtube', 9000, 6200), ('generic', 8800, 6000)) v(platform, lim, dt) USING (platform)"""
)
def render_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN8 as one plan, with FLT5, TIM4, JOI4, FLT10, JOI5, SET2, SET5, TIM15, SCL25 and PLN2: of each source its caption words, overlays, slides (manual ones win over
    automatic ones, and none may run backwards, past the end or into an overlay), the windows in which captions yield (badges don't count), effects, colours and caption band."""
    w = timeline(spark, sf_dir)
    bare = F.btrim(F.lower("text"), F.lit(".,!?;:—-"))
    kept = ~bare.isin([f for f in P.TABLE_FILLERS if " " not in f])
    m = marks(w, *semantic())
    ends = lengths(m)
    per = ends.join(w.where(kept).groupBy("source_id").agg(F.count(F.lit(1)).alias("n_words")), "source_id", "left").withColumn("n_words", F.coalesce("n_words", F.lit(0).cast("long")))
    said = callouts(spark, sf_dir, ends)
    over = overlays(said, ends)
    slides = full_slides(ends, over)
    shown = F.concat(F.col("start_ms").cast("string"), F.lit("-"), F.col("end_ms").cast("string"), F.when(F.col("badge"), "b").otherwise(""))
    broll = slides.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_broll"), F.count_if(~F.col("badge")).alias("n_full"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", shown.alias("shown")))), lambda x: x["shown"]), ",").alias("broll"))
    numbers = over.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_overlays"))
    events = sounding(m, "sparing").unionByName(said.where("ding").select("source_id", F.col("t").cast("long").alias("t"), F.lit("ding").alias("slot"))).join(ends, "source_id").where("t <= dur")
    many = T.lookup(F.col("slot"), {s: str(len(x)) for s, x in P.EFFECTS.items()}, "0").cast("long")
    fx = events.groupBy("source_id").agg(F.sum(many).alias("n_fx"))
    style = F.col("source_id") % 4
    colors = F.when(style == 1, F.create_map(F.lit("gold"), F.lit("#aa8800"), F.lit("red"), F.lit("#990000"))).when(style == 2, F.create_map(F.lit("red"), F.lit("#990000")))
    top, bottom = F.col("source_id") % 100 * 100, F.col("source_id") % 100 * 100 + 2000
    platform = either("tiktok", "instagram", "youtube", "generic", at=style)
    band = render.band(top, bottom, platform)["top"]
    made = per.join(numbers, "source_id", "left").join(broll, "source_id", "left").join(fx, "source_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    return made.select(
        "source_id", F.col("dur").alias("duration_ms"), "n_words", none("n_overlays").alias("n_overlays"), none("n_broll").alias("n_broll"), F.coalesce("broll", F.lit("")).alias("broll"), (none("n_overlays") + none("n_full")).alias("n_yield"), none("n_fx").alias("n_fx"),
        F.coalesce(colors["gold"], F.lit(PALETTE["primary"])).alias("color_primary"), F.coalesce(colors["red"], F.lit(PALETTE["secondary"])).alias("color_secondary"), band.alias("band_top"),
    )


# ---------------------------------------------------------------- render records with whole lists

SLIDE_KINDS = ("text", "list", "logo", "person", "stat", "unheard-of", None)
PROPOSED = f"""
ask AS (SELECT o_custkey AS source_id, o_orderkey AS pos, [{', '.join('NULL' if k is None else f"'{k}'" for k in SLIDE_KINDS)}][o_orderkey % {len(SLIDE_KINDS)} + 1] AS type,
  CASE o_orderkey % 11 WHEN 3 THEN 'soon' WHEN 5 THEN NULL WHEN 7 THEN 'NaN' ELSE CAST(o_orderkey % 1901 / 100.0 AS VARCHAR) END AS a, CASE o_orderkey % 13 WHEN 4 THEN '' ELSE CAST(o_orderkey % 1901 / 100.0 + o_orderkey % 6 AS VARCHAR) END AS b FROM orders),
want AS (SELECT source_id, pos, type, CAST(round_even(CAST(a AS DOUBLE) * 1000, 0) AS BIGINT) AS start_ms, CAST(round_even(CAST(b AS DOUBLE) * 1000, 0) AS BIGINT) AS end_ms FROM ask
  WHERE type IN ({quoted(render.MADE_TYPES)}) AND isfinite(TRY_CAST(a AS DOUBLE)) AND isfinite(TRY_CAST(b AS DOUBLE))),"""


def proposed_sql() -> str:
    """The slides' SQL over proposals instead of words."""
    lines = SLIDES.strip().split("\n")
    return "\n".join(PROPOSED.strip() if x.startswith("want AS") else x.replace("start_ms, end_ms, pos) AS k", "start_ms, pos) AS k") for x in lines)


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides as a model might propose them for the sources: types and times that are wrong among them."""
    k = F.col("o_orderkey")
    at = k % 1901 / F.lit(100.0)
    start = F.when(k % 11 == 3, "soon").when(k % 11 == 5, None).when(k % 11 == 7, "NaN").otherwise(at.cast("string"))
    end = F.when(k % 13 == 4, "").otherwise((at + k % 6).cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), k.alias("place"), either(*SLIDE_KINDS, at=k % len(SLIDE_KINDS)).alias("type"), start.alias("start"), end.alias("end"))


@Q.add(
    f"""WITH RECURSIVE {WORDS.strip()}, {CALLOUTS.strip()}, {OVERLAYS.strip()}, {proposed_sql()}
SELECT source_id, pos AS place, type, CAST(o.start_ms AS BIGINT) AS start_ms, CAST(o.end_ms AS BIGINT) AS end_ms FROM o JOIN g2 USING (source_id, k) JOIN (SELECT source_id, pos, type FROM want) USING (source_id, pos) WHERE kept"""
)
def made_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT11, with WIN6 and SEQ4: proposed slides of known types with times that are numbers, fitted into what the overlays leave free."""
    ends = lengths(marks(timeline(spark, sf_dir)))
    gaps = intervals.free_gaps(overlays(callouts(spark, sf_dir, ends), ends), ends.withColumnRenamed("dur", "duration_ms"), "source_id")
    return render.made_slides(proposals(spark, sf_dir), gaps).select("source_id", "place", "type", "start_ms", "end_ms")


SECONDS = "CAST({} / 1000.0 AS DOUBLE)"
ITEMS = f"""
pic AS (SELECT e.source_id, t AS start_ms, t + duration_ms AS end_ms, effect, color, duration_ms FROM (SELECT source_id, 50 AS t, 'hook-impact' AS slot FROM words WHERE pos = 0 UNION ALL SELECT source_id, t, 'ding' FROM c WHERE ding UNION ALL SELECT source_id, t, slot FROM lex WHERE k = 1) e
  JOIN dur USING (source_id) JOIN (VALUES {', '.join(map(str, FX))}) v(slot, effect, color, duration_ms) USING (slot) WHERE t BETWEEN 0 AND dur),
items AS (
  SELECT source_id, 'words' AS part, start_ms, end_ms, '{{"text":' || to_json(text) || ',"start":' || {SECONDS.format('start_ms')} || ',"end":' || {SECONDS.format('end_ms')} || '}}' AS item FROM words WHERE trim(lower(text), '.,!?;:—-') NOT IN ({quoted([f for f in P.TABLE_FILLERS if ' ' not in f])})
  UNION ALL SELECT source_id, 'overlayWindows', start_ms, end_ms, '{{"start":' || {SECONDS.format('start_ms')} || ',"end":' || {SECONDS.format('end_ms')} || '}}' FROM ov
  UNION ALL SELECT source_id, 'broll', a, b, '{{"start":' || {SECONDS.format('a')} || ',"end":' || {SECONDS.format('b')} || ',"mode":"' || CASE WHEN badge THEN 'badge' ELSE 'full' END || '"}}' FROM br
  UNION ALL SELECT source_id, 'vfxEvents', start_ms, end_ms, '{{"t":' || {SECONDS.format('start_ms')} || ',"effect":"' || effect || '","color":"' || color || '","intensity":1.0,"durationMs":' || duration_ms || '}}' FROM pic)"""


def render_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Sources with their lengths, and the lists of a render record by name."""
    w = timeline(spark, sf_dir)
    m = marks(w, *semantic())
    ends = lengths(m)
    said = callouts(spark, sf_dir, ends)
    over = overlays(said, ends)
    bare = F.btrim(F.lower("text"), F.lit(".,!?;:—-"))
    start, end = render.seconds(F.col("start_ms")).alias("start"), render.seconds(F.col("end_ms")).alias("end")
    fx = F.broadcast(spark.createDataFrame(FX, "slot string, effect string, color string, duration_ms int"))  # as many rows as there are slots and effects
    dings = said.where("ding").select("source_id", F.col("t").cast("long").alias("t"), F.lit("ding").alias("slot"))
    events = sounding(m, "sparing").unionByName(dings).join(ends, "source_id").where("t between 0 and dur").join(fx, "slot")
    event = F.struct(render.seconds(F.col("t")).alias("t"), "effect", "color", F.lit(1.0).alias("intensity"), F.col("duration_ms").alias("durationMs"))
    window = lambda d, item: d.select("source_id", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), item.alias("item"))
    return ends, {
        "words": window(w.where(~bare.isin([f for f in P.TABLE_FILLERS if " " not in f])), F.struct("text", start, end)),
        "overlayWindows": window(over, F.struct(start, end)),
        "broll": window(full_slides(ends, over), F.struct(start, end, F.when(F.col("badge"), "badge").otherwise("full").alias("mode"))),
        "vfxEvents": window(events.withColumns({"start_ms": F.col("t"), "end_ms": F.col("t") + F.col("duration_ms")}), event),
    }


@Q.add(f"""WITH {WORDS}, {CALLOUTS.strip()}, {OVERLAYS.strip()}, {RENDER.strip()}, {ITEMS.strip()} SELECT source_id, part, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, item FROM items""")
def render_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN8: caption words, overlay windows, slides and effects as records, a row each; nothing is gathered."""
    _, lists = render_lists(spark, sf_dir)
    made = [rows.select("source_id", F.lit(name).alias("part"), "start_ms", "end_ms", F.to_json("item").alias("item")) for name, rows in lists.items()]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


@Q.add(
    f"""WITH {WORDS}, {CALLOUTS.strip()}, {OVERLAYS.strip()}, {RENDER.strip()}, {ITEMS.strip()},
l AS (SELECT source_id, string_agg(item, ',' ORDER BY start_ms, end_ms, item) FILTER (part = 'words') AS w, string_agg(item, ',' ORDER BY start_ms, end_ms) FILTER (part = 'overlayWindows') AS o, string_agg(item, ',' ORDER BY start_ms, end_ms, item) FILTER (part = 'broll') AS b, string_agg(item, ',' ORDER BY start_ms, end_ms, item) FILTER (part = 'vfxEvents') AS v FROM items GROUP BY source_id),
looks AS (SELECT lower(n_name) AS name, '#' || lpad(CAST(n_nationkey * 37 AS VARCHAR), 6, '0') AS gold, CASE WHEN n_nationkey % 3 > 0 THEN '#' || lpad(CAST(n_nationkey * 91 AS VARCHAR), 6, '0') END AS red FROM nation WHERE n_nationkey % 2 = 0),
f AS (SELECT source_id, dur, CASE WHEN source_id % 9 <> 0 THEN source_id % 100 * 100 END AS top, CASE WHEN source_id % 9 <> 0 THEN source_id % 100 * 100 + 2000 END AS bot, ['tiktok', 'instagram', 'youtube', 'other'][source_id % 4 + 1] AS platform, lower(n.n_name) AS style FROM dur LEFT JOIN nation n ON n_nationkey = source_id % 30),
p AS (SELECT f.*, lim, dt, db, CASE WHEN bot + 250 + 1300 <= lim THEN bot + 250 WHEN top - 1550 >= 500 THEN top - 1550 END AS bt FROM f JOIN (VALUES ('tiktok', 8600, 6000, 7800), ('instagram', 8400, 5800, 7600), ('youtube', 9000, 6200, 8200), ('other', 8800, 6000, 8000)) v(platform, lim, dt, db) USING (platform))
SELECT source_id, '{{"baseVideo":"renders/' || source_id || '.mp4","durationInSeconds":' || {SECONDS.format('dur')} || ',"fps":30,"captionsEnabled":true,"captionBand":{{"top":' || CAST(coalesce(bt, dt) / 10000.0 AS DOUBLE) || ',"bottom":' || CAST(coalesce(bt + 1300, db) / 10000.0 AS DOUBLE)
  || '}},"captionMaxWords":3,"captionFadeSeconds":0.2,"palette":{{"primary":"' || coalesce(CASE WHEN a.name IS NULL THEN d.gold ELSE a.gold END, '{PALETTE['primary']}') || '","secondary":"' || coalesce(CASE WHEN a.name IS NULL THEN d.red ELSE a.red END, '{PALETTE['secondary']}')
  || '","accent":"{PALETTE['accent']}","bg":"{PALETTE['bg']}"}},"words":[' || coalesce(w, '') || '],"overlayWindows":[' || coalesce(o, '') || '],"broll":[' || coalesce(b, '') || '],"vfxEvents":[' || coalesce(v, '') || ']}}' AS props
FROM p LEFT JOIN l USING (source_id) LEFT JOIN looks a ON a.name = p.style LEFT JOIN looks d ON d.name = '{DEFAULT_STYLE}'"""
)
def render_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN8 in full, with FLT5, TIM4, JOI4, FLT10, TIM15, SCL25, SRC8 and PLN2: of each source its whole render record as JSON, with lists of words, overlays, slides and effects."""
    ends, lists = render_lists(spark, sf_dir)
    k, n = F.col("source_id"), F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("name"))
    hexed = lambda x: F.concat(F.lit("#"), F.lpad(x.cast("string"), 6, "0"))
    none = F.lit(None).cast("string")
    looks = nation.where("n_nationkey % 2 = 0").select("name", hexed(n * 37).alias("gold"), F.when(n % 3 > 0, hexed(n * 91)).alias("red"), none.alias("green"), none.alias("background"))
    named = ends.join(nation, n == k % 30, "left").select("source_id", "dur", F.col("name").alias("style"))
    seen = k % 9 != 0
    band = render.band(F.when(seen, k % 100 * 100), F.when(seen, k % 100 * 100 + 2000), either("tiktok", "instagram", "youtube", "other", at=k % 4))
    made = styles.with_style(named, "style", looks, DEFAULT_STYLE).select(
        "source_id", F.concat(F.lit("renders/"), k.cast("string"), F.lit(".mp4")).alias("baseVideo"), render.seconds(F.col("dur")).alias("durationInSeconds"), F.lit(30).alias("fps"), F.lit(True).alias("captionsEnabled"),
        band.alias("captionBand"), F.lit(3).alias("captionMaxWords"), F.lit(0.2).alias("captionFadeSeconds"), render.palette(F.col("look")).alias("palette"),
    )
    return render.documents(made, made.columns[1:], lists)


# ---------------------------------------------------------------- detections and effects


@Q.add(
    """WITH d AS (SELECT l_suppkey AS clip_id, l_orderkey % 60 AS frame, l_discount * 10 AS score, l_extendedprice / 25.0 AS x, l_quantity * 40.0 AS y, 100.0 + l_partkey % 400 AS h, l_orderkey, l_linenumber FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame ORDER BY score DESC, l_orderkey, l_linenumber) AS r FROM d WHERE frame % 5 = 0)
SELECT clip_id, frame, CAST(x + h / 4.0 AS DOUBLE) AS cx, CAST(y + h / 2.0 AS DOUBLE) AS cy, CAST(h AS DOUBLE) AS h, CAST(score AS DOUBLE) AS score FROM b WHERE r = 1 AND score >= 0.6"""
)
def sampled_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC15: of every fifth frame the detection with the best score, if that is good enough."""
    h = 100.0 + F.col("l_partkey") % 400
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("clip_id"), (F.col("l_orderkey") % 60).alias("frame"), (F.col("l_discount") * 10).alias("score"), (F.col("l_extendedprice") / 25.0).alias("x"), (F.col("l_quantity") * 40.0).alias("y"), (h / 2.0).alias("w"), h.alias("h"), "l_orderkey", "l_linenumber")
    return effects.best_faces(d, ["clip_id"], ["l_orderkey", "l_linenumber"])


FADE, REACH = 200, 280
EFFECT_LENGTHS = (90, 220, 280)


@Q.add(
    f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 // 7200 * 40 AS a, [90, 220, 280][event_id % 3 + 1] AS len, (event_id % 4 + 1) / 4.0 AS strength FROM events),
s AS (SELECT DISTINCT user_id, a + 60 AS t FROM e),
p AS (SELECT s.user_id, t, max(CASE WHEN t - a BETWEEN 0 AND len THEN sin(pi() * (t - a) / len) * 0.04 * strength END) AS bump, min(CASE WHEN event_id % 5 = 0 AND t > a - {FADE} AND t < a + len + {FADE} THEN CASE WHEN t < a THEN (a - t) / {FADE}.0 WHEN t > a + len THEN (t - a - len) / {FADE}.0 ELSE 0.0 END END) AS op
  FROM s JOIN e ON s.user_id = e.user_id AND t > a - {FADE} AND t < a + len + {FADE} GROUP BY ALL)
SELECT user_id, CAST(t AS BIGINT) AS t_ms, round(1 + coalesce(bump, 0), 6) AS scale, round(CAST(coalesce(op, 1) AS DOUBLE), 6) AS opacity, round(1 + 0.18 * (t % 1000) / 1000.0, 6)::DOUBLE AS zoom,
  round(CASE user_id % 5 WHEN 1 THEN 4 - 8 * (t % 1000) / 1000.0 WHEN 2 THEN 8 * (t % 1000) / 1000.0 - 4 ELSE 0 END, 6)::DOUBLE AS pan_x FROM s LEFT JOIN p USING (user_id, t)"""
)
def overlapping_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14, AGG15, TIM11: at sample times the largest of the bumps that overlap there (not their sum), the least opacity of the fade windows, and a slide's zoom and
    pan. Effects and times meet by time cells."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000 div 7200 * 40").alias("start_ms"), F.get(F.array(*map(F.lit, EFFECT_LENGTHS)), (F.col("event_id") % 3).cast("int")).alias("len"), ((F.col("event_id") % 4 + 1) / 4.0).alias("strength"), (F.col("event_id") % 5 == 0).alias("fades"))
    made = effects.at_times(e, e.select("user_id", (F.col("start_ms") + 60).alias("t")).distinct(), "user_id", FADE, REACH)
    share = (F.col("t") % 1000) / 1000.0
    motion = either("in", "left", "right", "in", "in", at=F.col("user_id") % 5)
    return made.select("user_id", F.col("t").alias("t_ms"), F.round("scale", 6).alias("scale"), F.round("opacity", 6).alias("opacity"), F.round(effects.zoom(share, motion), 6).alias("zoom"), F.round(effects.shift(share, motion)["x"], 6).alias("pan_x"))


# ---------------------------------------------------------------- settings and checks

CONFIGS = """
c AS (SELECT c_custkey AS k, CASE WHEN c_nationkey % 2 = 0 THEN 'hosted' ELSE 'local' END AS picker, CASE WHEN c_custkey % 3 = 1 THEN 'neural' ELSE 'classic' END AS enhancer, c_custkey % 3 <> 0 AS has_key, c_custkey % 4 <> 0 AS has_kit, c_custkey % 5 <> 0 AS has_template, c_custkey % 7 <> 1 AS has_enhancer, c_custkey % 11 AS step, c_custkey % 13 <> 0 AS enhance FROM customer)"""


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.when(F.col("c_nationkey") % 2 == 0, "hosted").otherwise("local").alias("picker"), F.when(k % 3 == 1, "neural").otherwise("classic").alias("enhancer"), (k % 3 != 0).alias("has_key"), (k % 4 != 0).alias("has_kit"), (k % 5 != 0).alias("has_template"), (k % 7 != 1).alias("has_enhancer"), (k % 11).alias("step"), (k % 13 != 0).alias("enhance"))


@Q.add(
    f"""WITH {CONFIGS.strip()},
p AS (SELECT *, list_filter([CASE WHEN picker = 'hosted' AND NOT has_key THEN 'key' END, CASE WHEN NOT has_kit THEN 'kit' END, CASE WHEN NOT has_template THEN 'template' END, CASE WHEN enhancer = 'neural' AND NOT has_enhancer THEN 'enhancer' END], lambda x: x IS NOT NULL) AS every FROM c)
SELECT k, array_to_string(every, ',') AS problems, array_to_string(list_filter(every, lambda x: (step <= 2 OR x <> 'key') AND ((enhance AND step <= 5 AND enhancer = 'neural') OR x <> 'enhancer') AND (step <= 8 OR x NOT IN ('kit', 'template'))), ',') AS relevant,
  array_to_string(list_filter(['neural', 'classic', 'none'], lambda x: x <> enhancer), ',') AS fallbacks FROM p"""
)
def config_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT17, SET6: a setting's problems, those that the steps still to run have to do with, and the engines to fall back on."""
    c = checks.problems(configs(spark, sf_dir))
    return c.select("k", *(F.array_join(name, ",").alias(name) for name in ("problems", "relevant", "fallbacks")))


@Q.add(
    f"""WITH {CONFIGS.strip()},
r AS (SELECT k, unnest([{{'name': 'enhancer', 's': CASE WHEN has_enhancer THEN 'OK' WHEN enhancer = 'neural' THEN 'FAIL' ELSE 'WARN' END}}, {{'name': 'kit', 's': CASE WHEN has_kit THEN 'OK' ELSE 'FAIL' END}}, {{'name': 'template', 's': CASE WHEN has_template THEN 'OK' ELSE 'WARN' END}},
  {{'name': 'sounds', 's': CASE WHEN k % 8 = 7 THEN 'OK' ELSE 'WARN' END}}, {{'name': 'picker', 's': CASE WHEN picker <> 'hosted' THEN 'WARN' WHEN has_key THEN 'OK' ELSE 'FAIL' END}}]) AS x FROM c)
SELECT k, string_agg(x.name || '=' || x.s, ' ' ORDER BY x.name) AS rows, count(*) FILTER (x.s = 'FAIL') AS n_fail, CASE WHEN count(*) FILTER (x.s = 'FAIL') > 0 THEN 1 ELSE 0 END AS exit_code FROM r GROUP BY k"""
)
def doctor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT18: a status table of checks a setting, and its failures."""
    return checks.summary(checks.status(configs(spark, sf_dir), "k", F.col("k") % 8 == 7), "k")


# ---------------------------------------------------------------- look-ups


@Q.add(
    """WITH v AS (SELECT c_custkey, lower(c_name) AS stem FROM customer), t AS (SELECT s_suppkey, lower(CASE s_suppkey % 4 WHEN 0 THEN right(s_name, 3) WHEN 1 THEN right(s_name, 2) WHEN 2 THEN 'r#' || right(s_name, 9) ELSE '' END) AS tag FROM supplier)
SELECT c_custkey, arg_min(s_suppkey, tag || '/' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0')) AS transcript FROM v JOIN t ON tag <> '' AND contains(stem, tag) GROUP BY c_custkey"""
)
def reused_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3: of each video the first transcript, by tag, whose tag its stem contains."""
    v = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_name").alias("stem"))
    k, name = F.col("s_suppkey"), F.col("s_name")
    tag = F.lower(F.when(k % 4 == 0, F.right(name, F.lit(3))).when(k % 4 == 1, F.right(name, F.lit(2))).when(k % 4 == 2, F.concat(F.lit("r#"), F.right(name, F.lit(9)))).otherwise(""))
    tags = table(spark, sf_dir, "supplier").select(k, tag.alias("tag")).where("tag <> ''")
    first = lookups.held(v, "c_custkey", "stem", tags, first=True)
    return first.join(tags.groupBy("tag").agg(F.min("s_suppkey").alias("transcript")), "tag").select("c_custkey", "transcript")


@Q.add(
    """WITH m AS (SELECT p_brand AS pack, p_partkey % 5 AS slot, p_partkey AS file FROM part WHERE p_size > 30 AND right(p_brand, 1) <> '5'),
fb AS (SELECT p_brand AS pack, p_partkey % 5 AS slot, min(p_partkey % 3) AS ext FROM part WHERE p_size % 4 = 0 GROUP BY ALL),
a AS (SELECT pack, slot, string_agg(CAST(file AS VARCHAR), ',' ORDER BY file) AS files FROM m GROUP BY ALL)
SELECT pack, slot, files FROM a UNION ALL SELECT pack, slot, ['.wav', '.mp3', '.ogg'][ext + 1] FROM fb WHERE pack NOT IN (SELECT pack FROM m)"""
)
def sound_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4: a pack's listed files that exist, slots without any gone; where a pack has none at all, the files named after their slots, by the order of their kinds."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("pack"), (F.col("p_partkey") % 5).alias("slot"), F.col("p_partkey").alias("file"), "p_size")
    there = p.where("p_size > 30 and right(pack, 1) <> '5'").select(F.col("file").cast("string").alias("file"))
    kind = F.col("file") % 3
    named = p.where("p_size % 4 = 0").select("pack", "slot", either(".wav", ".mp3", ".ogg", at=kind).alias("file"), kind.alias("kind"))
    files = folders.pack_files(p.withColumn("file", F.col("file").cast("string")), there, named)
    return files.groupBy("pack", "slot").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.expr("try_cast(file as bigint)").alias("n"), "file"))), lambda x: x["file"]), ",").alias("files"))


@Q.add(
    """WITH v AS (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-')[1:60] AS dir FROM part WHERE p_size % 5 < 3), d AS (SELECT DISTINCT trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-')[1:60] AS dir FROM part)
SELECT dir, min(p_partkey) AS video FROM d LEFT JOIN v USING (dir) GROUP BY dir"""
)
def source_of_work_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI9: the first video (of a kind that is one) whose slug is a work folder's name."""
    name = F.concat_ws(" ", "p_name", "p_brand")
    p = table(spark, sf_dir, "part")
    dirs = p.select(T.slug(name, folders.SLUG).alias("dir")).distinct()
    return folders.video_of(dirs, "dir", p.where("p_size % 5 < 3"), name, "p_partkey").withColumnRenamed("p_partkey", "video")


@Q.add(
    """WITH f AS (SELECT o_custkey, CASE WHEN o_orderkey % 9 = 0 THEN 'shot-' ELSE 'short-' END || lpad(CAST(o_orderkey % 6 + 1 AS VARCHAR), 2, '0') || '-' || lower(o_orderstatus) AS folder FROM orders),
r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT DISTINCT f.o_custkey, folder, o_orderkey AS clip FROM f LEFT JOIN r ON r.o_custkey = f.o_custkey AND rank = TRY_CAST(nullif(regexp_extract(folder, '^short-(\\d+)-', 1), '') AS BIGINT)"""
)
def clip_of_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9: the rank that a folder's name tells, and the clip of that rank; none where the name doesn't parse."""
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.when(F.col("o_orderkey") % 9 == 0, "shot-").otherwise("short-"), F.lpad((F.col("o_orderkey") % 6 + 1).cast("string"), 2, "0"), F.lit("-"), F.lower("o_orderstatus"))
    named = o.select("o_custkey", name.alias("folder")).distinct()
    made = folders.clip_of(named, "o_custkey", "folder", o.select("o_custkey", "o_orderkey", "o_totalprice"), (F.desc("o_totalprice"), F.asc("o_orderkey")))
    return made.select("o_custkey", "folder", F.col("clip.o_orderkey").alias("clip"))


@Q.add(
    """WITH c AS (SELECT user_id, event_id, 'u' || event_id % 500 AS url, event_id % 1000 AS w, 0 AS engine FROM events UNION ALL SELECT user_id, event_id, 'u' || event_id % 700, user_id * 7, 1 FROM events),
f AS (SELECT user_id, url, min(engine * 1000000000 + event_id) AS place FROM c WHERE w >= 600 GROUP BY ALL)
SELECT user_id, arg_min(url, place) AS url, count(*) AS n FROM f GROUP BY user_id"""
)
def asset_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI18: candidates of two engines in one pool, each picture once, and the first that is usable."""
    e = table(spark, sf_dir, "events")
    part = lambda n, w: e.select("user_id", "event_id", F.concat(F.lit("u"), (F.col("event_id") % n).cast("string")).alias("url"), w.alias("w"))
    return folders.usable([part(500, F.col("event_id") % 1000), part(700, F.col("user_id") * 7)], "user_id", "url", "event_id", F.col("w") >= 600)


# ---------------------------------------------------------------- records


def sql_dashes(x: str) -> str:
    """The same as functions.text.without_dashes, for DuckDB (a dash between digits that touch no other such dash)."""
    d = T.DASHES
    for pattern, by in ((rf"([0-9])\s*[{d}]\s*([0-9])", r"\1-\2"), (rf"\s*[{d}]\s*", ", "), (r"\s+([,.!?;:])", r"\1"), (r",\s*,", ","), (r"(^|\n)\s*,\s*", r"\1"), (r"[ \t][ \t]+", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


NESTED = """
r AS (SELECT turn, conv_id, CASE WHEN turn % 2 = 0 THEN replace(text, ', ', ' — ') ELSE text END AS title, [role, CASE WHEN conv_id % 3 = 0 THEN 'a – b' ELSE 'a-b' END] AS tags, CASE WHEN turn % 3 = 0 THEN 'x—y' ELSE 'xy' END AS note FROM conversations)"""


@Q.add(
    f"""WITH {NESTED.strip()},
n AS (SELECT *, {sql_dashes('title')} AS t2, list_transform(tags, lambda s: {sql_dashes('s')}) AS g2, {sql_dashes('note')} AS n2 FROM r)
SELECT conv_id, turn, md5(t2) AS title_md5, array_to_string(g2, '|') AS tags, n2 AS note, coalesce(t2 <> title OR g2 <> tags OR n2 <> note, false) AS changed FROM n"""
)
def normalized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL17: every string of a nested record normalised, and whether any changed."""
    c = table(spark, sf_dir, "conversations")
    record = F.struct(
        F.when(F.col("turn") % 2 == 0, F.replace("text", F.lit(", "), F.lit(" — "))).otherwise(F.col("text")).alias("title"),
        F.array("role", F.when(F.col("conv_id") % 3 == 0, "a – b").otherwise("a-b")).alias("tags"),
        F.create_map(F.lit("note"), F.when(F.col("turn") % 3 == 0, "x—y").otherwise("xy")).alias("meta"),
    )
    x = c.select("conv_id", "turn", record.alias("x"))
    x = x.withColumn("y", T.every_string("x", x.schema["x"].dataType, T.without_dashes))
    unlike = lambda k: F.to_json(F.struct(f"x.{k}")) != F.to_json(F.struct(f"y.{k}"))
    return x.select("conv_id", "turn", F.md5("y.title").alias("title_md5"), F.array_join("y.tags", "|").alias("tags"), F.col("y.meta")["note"].alias("note"), (unlike("title") | unlike("tags") | unlike("meta")).alias("changed"))


ANY = """
r AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN replace(text, ', ', ' — ') ELSE text END AS t, role FROM conversations),"""


def sql_any(t: str, tag: str, deep: str, note: str) -> str:
    """Four shapes of records in one column."""
    return f"""CASE (conv_id + turn) % 4 WHEN 0 THEN '{{"title":' || to_json({t}) || ',"tags":[' || to_json(role) || ', "{tag}"],"n":' || turn || '}}'
    WHEN 1 THEN '[ ' || to_json({t}) || ', {{"x — y" : {{"list": [1, null, true, "{deep}", "a\\"b", ""], "n—n": -1.50e3}}}}]' WHEN 2 THEN CAST(to_json({t}) AS VARCHAR) ELSE '{{"n":1.5,"t":true,"z":null,"note":"{note}"}}' END"""


@Q.add(
    f"""WITH {ANY.strip()} n AS (SELECT *, {sql_dashes('t')} AS t2 FROM r), j AS (SELECT conv_id, turn, {sql_any('t', 'a – b', 'r—s', 'plain')} AS old, {sql_any('t2', 'a, b', 'r, s', 'plain')} AS new FROM n)
SELECT conv_id, turn, md5(new) AS json_md5, new <> old AS changed FROM j"""
)
def normalized_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL17: every string of JSON of any shape normalised, members' names left, and whether any changed."""
    text = F.when(F.col("turn") % 2 == 0, F.replace("text", F.lit(", "), F.lit(" — "))).otherwise(F.col("text"))
    quote = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    t, role, kind = quote(text), quote(F.col("role")), (F.col("conv_id") + F.col("turn")) % 4
    shapes = (
        F.concat(F.lit('{"title":'), t, F.lit(',"tags":['), role, F.lit(', "a – b"],"n":'), F.col("turn").cast("string"), F.lit("}")),
        F.concat(F.lit("[ "), t, F.lit(', {"x — y" : {"list": [1, null, true, "r—s", "a\\"b", ""], "n—n": -1.50e3}}]')),
        t,
        F.lit('{"n":1.5,"t":true,"z":null,"note":"plain"}'),
    )
    record = F.when(kind == 0, shapes[0]).when(kind == 1, shapes[1]).when(kind == 2, shapes[2]).otherwise(shapes[3])
    made = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.every_json_string(record, T.without_dashes).alias("x"))
    return made.select("conv_id", "turn", F.md5("x.value").alias("json_md5"), F.col("x.changed").alias("changed"))


@Q.add(
    f"""WITH s AS (SELECT o_orderkey AS k, ['text', 'stat', 'list', 'logo', 'person'][o_orderkey % 5 + 1] AS type, CASE WHEN o_orderkey % 7 = 0 THEN '#123456' END AS color, CASE WHEN o_orderkey % 2 = 0 THEN 'Brand' || o_orderkey % 50 END AS key_, CASE WHEN o_orderkey % 3 > 0 THEN 'Name' || o_orderkey % 50 END AS name, o_orderkey % 4 AS style FROM orders),
p AS (SELECT *, CASE WHEN style = 1 THEN '#aa8800' ELSE '{PALETTE['primary']}' END AS c1, CASE WHEN style IN (1, 2) THEN '#990000' ELSE '{PALETTE['secondary']}' END AS c2, CASE WHEN style = 3 THEN '#00aa00' ELSE '{PALETTE['accent']}' END AS c3, CASE WHEN type IN ('logo', 'person') THEN coalesce(key_, name, '') END AS wanted FROM s)
SELECT k, type, coalesce(color, CASE type WHEN 'stat' THEN c3 WHEN 'list' THEN c2 ELSE c1 END) AS color, wanted, CASE WHEN wanted IS NOT NULL THEN regexp_replace(lower(wanted), '[^a-z0-9]', '', 'g') || '.png' END AS src FROM p WHERE wanted IS NULL OR (wanted <> '' AND right(wanted, 1) <> '3')"""
)
def slide_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL25, SCL26, SCL38: a slide's colour, its own or its type's out of the style's palette with defaults; and its picture by brand or person, else by name; slides whose picture isn't found go."""
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select(k.alias("k"), either("text", "stat", "list", "logo", "person", at=k % 5).alias("type"), F.when(k % 7 == 0, "#123456").alias("color"), F.when(k % 2 == 0, F.concat(F.lit("Brand"), (k % 50).cast("string"))).alias("key"), F.when(k % 3 > 0, F.concat(F.lit("Name"), (k % 50).cast("string"))).alias("name"), (k % 4).alias("style"))
    none = F.lit(None).cast("string")
    look = F.struct(F.when(F.col("style") == 1, "#aa8800").alias("gold"), F.when(F.col("style").isin(1, 2), "#990000").alias("red"), F.when(F.col("style") == 3, "#00aa00").alias("green"), none.alias("background"))
    wanted = s.select(F.explode(F.array("key", "name")).alias("wanted")).where("wanted is not null and right(wanted, 1) <> '3'").distinct()
    pictures = wanted.withColumn("src", F.concat(T.letters_and_digits(F.col("wanted")), F.lit(".png")))
    found = render.with_pictures(s, pictures)
    return found.select("k", "type", render.slide_color(F.col("type"), F.col("color"), render.palette(look)).alias("color"), "wanted", "src")


@Q.add(
    """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN 'Why ' || o_orderpriority || '?' ELSE 'On ' || o_orderpriority END AS hook0, lower(o_orderpriority) AS slug, CASE WHEN o_orderkey % 3 = 0 THEN 'It lands.' ELSE ' ' END AS why, CAST(floor(o_totalprice) AS BIGINT) AS cents FROM orders),
h AS (SELECT *, trim(CASE WHEN hook0 <> '' THEN hook0 ELSE replace(slug, '-', ' ') END) AS hook FROM o)
SELECT k, CASE WHEN hook <> '' AND right(hook, 1) <> '?' THEN upper(hook) ELSE hook END || chr(10) || chr(10) || CASE WHEN trim(why) <> '' THEN trim(why) ELSE 'Save this for later, it lands harder the second time.' END || chr(10) || chr(10) || 'Follow for more.' AS caption,
  '<div data-duration="' || cents // 100 || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || '">const TOTAL = ' || cents // 100 || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || ';' AS html,
  'loudnorm=I=-14.0:TP=-1.5:LRA=11.0:print_format=json' AS measure_filter,
  'loudnorm=I=-14.0:TP=-1.5:LRA=11.0:measured_I=-' || k % 40 || ':measured_TP=-' || k % 7 || ':measured_LRA=' || k % 9 || ':measured_thresh=-' || k % 50 || ':offset=' || k % 3 || ':linear=true:print_format=summary' AS apply_filter FROM h"""
)
def clip_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL13, SCL15, SCL28: a caption where a clip has none, a template with its length put in, and the filters of the two loudness passes."""
    k, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    given = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("Why "), priority, F.lit("?"))).otherwise(F.concat(F.lit("On "), priority))
    hook = F.trim(F.coalesce(F.nullif(given, F.lit("")), F.replace(F.lower(priority), F.lit("-"), F.lit(" "))))
    why = F.when(k % 3 == 0, "It lands.").otherwise(" ")
    cents = F.floor("o_totalprice").cast("long")
    seconds = F.concat(F.expr("cast(cast(floor(o_totalprice) as bigint) div 100 as string)"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    html = T.with_duration(F.lit('<div data-duration="18.84">const TOTAL = 18.84;'), seconds)
    measured = {"measured_I": F.concat(F.lit("-"), (k % 40).cast("string")), "measured_TP": F.concat(F.lit("-"), (k % 7).cast("string")), "measured_LRA": (k % 9).cast("string"), "measured_thresh": F.concat(F.lit("-"), (k % 50).cast("string")), "offset": (k % 3).cast("string")}
    return table(spark, sf_dir, "orders").select(k.alias("k"), T.fallback_caption(hook, why).alias("caption"), html.alias("html"), T.loudness_filter(-14.0, -1.5, 11.0).alias("measure_filter"), T.loudness_filter(-14.0, -1.5, 11.0, measured).alias("apply_filter"))


@Q.add(
    """WITH u AS (SELECT page_id, url || ['', '/a.PNG', '/b.svg?x=1', '/c.jpeg?y=.png', '/d.gif', '/e.webp'][page_id % 6 + 1] AS url FROM pages), l AS (SELECT *, split_part(lower(url), '?', 1) AS low FROM u)
SELECT page_id, sha1(url) || CASE WHEN suffix(low, '.svg') THEN '.svg' WHEN suffix(low, '.png') THEN '.png' WHEN suffix(low, '.jpg') THEN '.jpg' WHEN suffix(low, '.jpeg') THEN '.jpeg' WHEN suffix(low, '.webp') THEN '.webp' WHEN suffix(low, '.json') THEN '.json' ELSE '' END AS cache_path FROM l"""
)
def cache_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL31: a file name that an address always has, with the ending that it shows."""
    url = F.concat("url", either("", "/a.PNG", "/b.svg?x=1", "/c.jpeg?y=.png", "/d.gif", "/e.webp", at=F.col("page_id") % 6))
    return table(spark, sf_dir, "pages").select("page_id", T.cache_path(url).alias("cache_path"))


@Q.add(
    f"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE text END AS text, regexp_extract(text, '^[^ ]+') AS kw FROM conversations),
low AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(trim(kw)) ORDER BY turn) AS n FROM c WHERE trim(kw) <> ''),
g AS (SELECT conv_id, list({sql_dashes('text')} ORDER BY turn) FILTER (text <> '') AS said, min(text) FILTER (turn = 0) AS title0, min(text) FILTER (turn = 1) AS told FROM c GROUP BY conv_id),
k AS (SELECT conv_id, list(trim(kw) ORDER BY turn) AS ks FROM low WHERE n = 1 GROUP BY conv_id),
x AS (SELECT g.*, coalesce(ks, []) AS ks, CASE conv_id % 4 WHEN 0 THEN 'Étion' WHEN 1 THEN 'étion' WHEN 2 THEN ' In — Thing ' END AS over FROM g LEFT JOIN k USING (conv_id)),
y AS (SELECT *, CASE WHEN coalesce(trim(over), '') <> '' AND NOT list_contains(ks, trim(over)) THEN list_prepend(trim(over), ks) ELSE ks END AS words FROM x)
SELECT conv_id, CAST(conv_id % 90 + 1 AS INTEGER) AS rank, md5({sql_dashes("trim(coalesce(title0, ''), ' ' || chr(9) || chr(10) || chr(13))")}) AS title_md5, {sql_dashes("trim(coalesce(over, ''))")} AS label, md5({sql_dashes("trim(CASE WHEN conv_id % 5 = 0 THEN 'none' ELSE coalesce(told, '') END, ' ' || chr(9) || chr(10) || chr(13))")}) AS description_md5,
  CAST(coalesce(len(said), 0) AS INTEGER) AS n_callouts, md5(array_to_string(coalesce(said, []), '|')) AS callouts_md5, array_to_string(list_transform(words, lambda s: {sql_dashes('s')}), '|') AS keywords,
  CASE WHEN conv_id % 3 > 0 THEN round_even((conv_id % 977 * 1231 + 5) / 1000.0, 2) END::DOUBLE AS duration_seconds, CASE WHEN conv_id % 2 = 0 THEN 'all/' || conv_id || '.jpg' WHEN conv_id % 7 > 0 THEN 'own/' || conv_id || '.jpg' END AS thumbnail
FROM y WHERE conv_id % 11 <> 0"""
)
def clip_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN14, SNK5, SCL35, SCL11: the record of each conversation as a clip; one of eleven has a folder without a rank in its name, and no record."""
    k = F.col("conv_id")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("text")).alias("text"), F.regexp_extract("text", "^[^ ]+", 0).alias("kw"))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", "kw"))).alias("r"), F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("hook_text"), F.min(F.when(F.col("turn") == 1, F.col("text"))).alias("told"))
    clips = g.select(
        k, F.lit("talk").alias("source"), F.when(k % 11 == 0, "notes").otherwise(F.concat(F.lit("short-"), F.lpad((k % 90 + 1).cast("string"), 2, "0"), F.lit("-"), k.cast("string"))).alias("short"), "hook_text",
        either("Étion", "étion", " In — Thing ", None, at=k % 4).alias("overline"), F.when(k % 5 == 0, "none").alias("caption"), F.col("told").alias("instagram_caption"), F.lit("why").alias("reasoning"),
        F.transform("r", lambda x: x["kw"]).alias("entities"), F.transform("r", lambda x: x["text"]).alias("callouts"), F.lit(5).alias("viral_score"), (k % 977 * 1231 + 5).alias("duration_ms"),
        F.when(k % 2 == 0, F.concat(F.lit("all/"), k.cast("string"), F.lit(".jpg"))).alias("cover"), F.when(k % 7 > 0, F.concat(F.lit("own/"), k.cast("string"), F.lit(".jpg"))).alias("own_thumb"), F.when(k % 3 > 0, "final.mp4").alias("deliverable"),
    )
    m = publishing.metadata(clips.withColumn("source", k.cast("string"))).withColumn("conv_id", F.col("source").cast("long"))
    joined = lambda c: F.array_join(c, "|")
    return m.select("conv_id", "rank", F.md5("title").alias("title_md5"), "label", F.md5("description").alias("description_md5"), F.size("callouts").alias("n_callouts"), F.md5(joined("callouts")).alias("callouts_md5"), joined("keywords").alias("keywords"), "duration_seconds", "thumbnail")
