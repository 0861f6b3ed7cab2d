"""Event planners: sound and picture events from hooks, callouts and words; slides; publish metadata; caption layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import params as P
from spanloom.functions import text as T
from spanloom.operators import intervals, sounds, words
from spanloom.plans.common import Queries, quoted, table
from spanloom.plans.timeline import STEM, WORDS, timeline

Q = Queries()

CALLOUTS = """
dur AS (SELECT source_id, max(end_ms) AS dur FROM words GROUP BY source_id),
co AS (SELECT conv_id AS source_id, turn, text, turn * 7000 AS ls, 1000 + turn * 500 AS len, CASE turn % 3 WHEN 0 THEN 'bigstat' WHEN 1 THEN 'punch' ELSE 'caption' END AS style FROM conversations WHERE text IS NOT NULL),
c AS (SELECT co.*, dur, greatest(0, least(ls, dur)) AS t, style = 'bigstat' AND regexp_matches(text, '[$£€]|[0-9]') AS ding FROM co JOIN dur USING (source_id)),
st AS (SELECT source_id, pos, start_ms, rtrim(lower(trim(text)), '.,!?:;"'')') AS s FROM words),
lex AS (
  SELECT source_id, start_ms AS t, 'cash-register' AS slot, row_number() OVER (PARTITION BY source_id ORDER BY pos) AS k FROM st WHERE s IN (""" + quoted(P.TABLE_MONEY) + """) OR contains(s, '$') OR regexp_full_match(s, '[0-9]+[km]?')
  UNION ALL SELECT source_id, start_ms, 'wrong-answer', row_number() OVER (PARTITION BY source_id ORDER BY pos) FROM st WHERE s IN (""" + quoted(P.TABLE_NEGATIVE) + """))"""  # fmt: skip


def marks(w: DataFrame, *found: tuple[str | Column, Column]) -> DataFrame:
    """(source_id, slot, pos, t) from one pass over the words: of each source its start (slot hook-impact, at 50), its end (slot end), and the words for
    which one of ``found``, a slot and a condition, holds. All that reads it shares one small shuffle: rows are packed into an array before it, so that
    readers of fewer columns ask for the same one."""
    row = lambda slot, t, when: F.when(when, F.struct((F.lit(slot) if isinstance(slot, str) else slot).alias("slot"), "pos", t.cast("long").alias("t")))
    ends = F.lead("pos").over(words.by_pos()).isNull()
    rows = (row("end", F.col("end_ms"), F.col("ends")), row("hook-impact", F.lit(50), F.col("pos") == 0), *(row(slot, F.col("start_ms"), when) for slot, when in found))
    packed = w.withColumn("ends", ends).select("source_id", F.array_compact(F.array(*rows)).alias("m")).where("size(m) > 0")
    # repartition by the same key would be optimised out, and each reader would cut the texts into words for itself
    return packed.hint("rebalance", "source_id").select("source_id", F.inline("m"))


def lengths(m: DataFrame) -> DataFrame:
    """Of marks: each source's end."""
    return m.where("slot = 'end'").select("source_id", F.col("t").alias("dur"))


def callouts(spark: SparkSession, sf_dir: str, ends: DataFrame) -> DataFrame:
    """Turns of the conversation with a source's number as its callouts, held to the source's length."""
    c = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("source_id"), "turn", "text", (F.col("turn") * 7000).alias("ls"), (1000 + F.col("turn") * 500).alias("len"))
    style = F.when(F.col("turn") % 3 == 0, "bigstat").when(F.col("turn") % 3 == 1, "punch").otherwise("caption")
    c = c.withColumn("style", style).join(ends, "source_id")
    return c.withColumn("t", F.greatest(F.lit(0), F.least("ls", "dur"))).withColumn("ding", (F.col("style") == "bigstat") & F.col("text").rlike("[$£€]|[0-9]"))


def semantic() -> tuple[tuple[str, Column], ...]:
    """What marks finds: both lists' words."""
    bare = words.stem(F.col("text"), words.EDGES)
    money = bare.isin(list(P.TABLE_MONEY)) | bare.contains("$") | bare.rlike(r"^\d+[km]?$")
    return ("cash-register", money), ("wrong-answer", bare.isin(list(P.TABLE_NEGATIVE)))


def sounding(m: DataFrame, mode: str) -> DataFrame:
    """(source_id, t, slot) of marks, the ends aside; in the sparing mode the first word of each list only, none where the mode is off."""
    m = m.where("slot = 'hook-impact'" if mode == "off" else "slot <> 'end'")
    if mode == "sparing":
        m = m.withColumn("k", F.row_number().over(Window.partitionBy("source_id", "slot").orderBy("pos"))).where("k = 1 or slot = 'hook-impact'")
    return m.select("source_id", "t", "slot")


#: Packs of the queries: files of each slot.
PACKS = {"full": P.SLOT_FILES, "poor": {"swipe-in": 1, "swipe-out": 0, "cash-register": 2, "ding": 0}}
GAINS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.SLOT_GAIN.items())


def sound_query(mode: str, pack: str = "full", swipe_out: bool = True):
    """PLN1, SEQ3, WIN13, WIN14, TIM8: the hook's, callouts' and words' sounds, near repeats gone, variants in turn."""

    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = marks(timeline(spark, sf_dir), *semantic())
        ends = lengths(m)
        mentions = m.where(F.col("slot").isin("cash-register", "wrong-answer")).join(ends, "source_id")
        return sounds.sound_events(m.where("slot = 'hook-impact'"), callouts(spark, sf_dir, ends), mentions, PACKS[pack], mode, swipe_out)

    plan.__doc__ = sound_query.__doc__
    return plan


def sound_sql(mode: str, pack: str = "full", swipe_out: bool = True) -> str:
    files = {k: n for k, n in PACKS[pack].items() if n}
    dings = "ding" if "ding" in files and mode != "off" else "false"
    first = "AND k = 1" if mode == "sparing" else "AND false" if mode == "off" else ""
    return f"""WITH RECURSIVE {WORDS.strip()}, {CALLOUTS.strip()},
e0 AS (SELECT source_id, 50 AS t, 'hook-impact' AS slot FROM words WHERE pos = 0 UNION ALL SELECT source_id, t, CASE WHEN {dings} THEN 'ding' ELSE 'swipe-in' END FROM c UNION ALL SELECT source_id, least(t + len, dur), 'swipe-out' FROM c WHERE {str(swipe_out).lower()}
  UNION ALL SELECT source_id, t, slot FROM lex JOIN dur USING (source_id) WHERE t BETWEEN 0 AND dur {first}),
e AS (SELECT * FROM e0 WHERE slot IN ({quoted(files)})),
o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY t, slot) AS k FROM e),
g(source_id, k, lt, ls, kept) AS (SELECT source_id, k, t, slot, true FROM o WHERE k = 1 UNION ALL
  SELECT o.source_id, o.k, CASE WHEN o.slot = ls AND o.t - lt < 80 THEN lt ELSE o.t END, CASE WHEN o.slot = ls AND o.t - lt < 80 THEN ls ELSE o.slot END, NOT (o.slot = ls AND o.t - lt < 80) FROM g JOIN o ON o.source_id = g.source_id AND o.k = g.k + 1),
f AS (SELECT source_id, t, slot FROM o JOIN g USING (source_id, k) WHERE kept)
SELECT source_id, CAST(t AS BIGINT) AS t_ms, slot, CAST(CASE slot {GAINS} ELSE 1.0 END AS DOUBLE) AS gain, CAST((row_number() OVER (PARTITION BY source_id, slot ORDER BY t) - 1) % n AS INTEGER) AS variant FROM f JOIN (VALUES {', '.join(f"('{k}', {n})" for k, n in files.items())}) v(slot, n) USING (slot)"""


# PLN1, SEQ3, WIN13, WIN14, TIM8
Q.put("sound_events_sparing", sound_query("sparing"), sound_sql("sparing"))
Q.put("sound_events_every", sound_query("every"), sound_sql("every"))
Q.put("sound_events_poor_pack", sound_query("every", "poor", False), sound_sql("every", "poor", False))
Q.put("sound_events_off", sound_query("off", "full", False), sound_sql("off", "full", False))

FX = [(slot, fx, P.EFFECT_COLORS[slot], P.EFFECT_MS[fx]) for slot, names in P.EFFECTS.items() for fx in names]


def picture_query(mode: str):
    """PLN2, JOI17, SCL32, SRT2: the effects of each slot at once, within the clip; the hook's alone where the mode is off."""

    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = marks(timeline(spark, sf_dir), *semantic())
        ends = lengths(m)
        dings = callouts(spark, sf_dir, ends).where(F.col("ding") & F.lit(mode != "off")).select("source_id", F.col("t").cast("long").alias("t"), F.lit("ding").alias("slot"))
        fx = spark.createDataFrame(FX, "slot string, effect string, color string, duration_ms int")  # as many rows as there are slots and effects
        e = sounding(m, mode).unionByName(dings).join(ends, "source_id").where("t between 0 and dur").join(F.broadcast(fx), "slot")
        return e.select("source_id", F.col("t").cast("long").alias("t_ms"), "effect", "color", F.lit(1.0).alias("intensity"), "duration_ms")

    plan.__doc__ = picture_query.__doc__
    return plan


def picture_sql(mode: str) -> str:
    on, first = ("true", "k = 1") if mode == "sparing" else ("true", "true") if mode == "every" else ("false", "false")
    return f"""WITH {WORDS}, {CALLOUTS.strip()},
e AS (SELECT source_id, 50 AS t, 'hook-impact' AS slot FROM words WHERE pos = 0 UNION ALL SELECT source_id, t, 'ding' FROM c WHERE ding AND {on} UNION ALL SELECT source_id, t, slot FROM lex WHERE {first})
SELECT e.source_id, CAST(t AS BIGINT) AS t_ms, effect, color, 1.0::DOUBLE AS intensity, duration_ms FROM e JOIN dur USING (source_id) JOIN (VALUES {', '.join(map(str, FX))}) v(slot, effect, color, duration_ms) USING (slot) WHERE t BETWEEN 0 AND dur"""


Q.put("picture_events", picture_query("sparing"), picture_sql("sparing"))
Q.put("picture_events_every", picture_query("every"), picture_sql("every"))
Q.put("picture_events_off", picture_query("off"), picture_sql("off"))


OVERLAYS = """
ov AS (
  SELECT source_id, 0 AS start_ms, CAST(greatest(1500, least(2600, greatest(2000, 3 * dur // 10))) AS BIGINT) AS end_ms FROM dur
  UNION ALL SELECT source_id, s, s + greatest(600, least(len, dur - s)) FROM (SELECT *, greatest(0, least(ls, greatest(0, dur - 500))) AS s FROM c))"""


def overlays(c: DataFrame, ends: DataFrame) -> DataFrame:
    """The hook's window, and the callouts', held to the clip."""
    hook = ends.select("source_id", F.lit(0).cast("long").alias("start_ms"), F.greatest(F.lit(1500), F.least(F.lit(2600), F.greatest(F.lit(2000), F.expr("3 * dur div 10")))).cast("long").alias("end_ms"))
    s = c.withColumn("s", F.greatest(F.lit(0), F.least(F.col("ls"), F.greatest(F.lit(0), F.col("dur") - 500))))
    return hook.unionByName(s.select("source_id", F.col("s").cast("long").alias("start_ms"), (F.col("s") + F.greatest(F.lit(600), F.least(F.col("len"), F.col("dur") - F.col("s")))).cast("long").alias("end_ms")))


@Q.add(f"WITH {WORDS}, {CALLOUTS.strip()}, {OVERLAYS.strip()} SELECT source_id, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms FROM ov")
def overlay_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIM2, TIM3, TIM4."""
    ends = lengths(marks(timeline(spark, sf_dir)))
    return overlays(callouts(spark, sf_dir, ends), ends)


SLIDES = """
rows AS (SELECT source_id, start_ms, end_ms, 0 AS last FROM ov UNION ALL SELECT source_id, dur, NULL, 1 FROM dur),
cur AS (SELECT *, greatest(0, coalesce(max(end_ms) OVER (PARTITION BY source_id ORDER BY last, start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS cursor FROM rows),
gaps AS (SELECT source_id, cursor + 200 AS ga, start_ms - 200 AS gb FROM cur WHERE start_ms - cursor >= 2400),
want AS (SELECT source_id, pos, start_ms, start_ms + 3000 AS end_ms FROM st WHERE s IN ({names})),
p AS (SELECT w.*, k, CASE k WHEN 0 THEN start_ms + end_ms WHEN 1 THEN 2 * start_ms ELSE 2 * end_ms END AS t2 FROM want w, (SELECT unnest([0, 1, 2]) AS k)),
b AS (SELECT p.*, ga, gb, row_number() OVER (PARTITION BY p.source_id, pos ORDER BY k, ga) AS r FROM p JOIN gaps g ON p.source_id = g.source_id AND t2 BETWEEN 2 * ga AND 2 * gb),
fit AS (SELECT source_id, pos, greatest(ga, least(start_ms, gb - size)) AS start_ms, greatest(ga, least(start_ms, gb - size)) + size AS end_ms FROM (SELECT *, least(greatest(end_ms - start_ms, 2000), 4500, gb - ga) AS size FROM b WHERE r = 1)),
o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, end_ms, pos) AS k FROM fit),
g2(source_id, k, reach, kept) AS (SELECT source_id, k, end_ms, true FROM o WHERE k = 1 UNION ALL SELECT o.source_id, o.k, CASE WHEN o.start_ms >= reach THEN o.end_ms ELSE reach END, o.start_ms >= reach FROM g2 JOIN o ON o.source_id = g2.source_id AND o.k = g2.k + 1)"""
ENTITIES = ("which", "avec", "nicht", "para", "from", "have")
N_SLIDES = 4


@Q.add(
    f"""WITH RECURSIVE {WORDS.strip()}, {CALLOUTS.strip()}, {OVERLAYS.strip()}, {SLIDES.strip().format(names=quoted(ENTITIES))},
k AS (SELECT source_id, pos, start_ms, end_ms, row_number() OVER (PARTITION BY source_id ORDER BY start_ms) AS n FROM o JOIN g2 USING (source_id, k) WHERE kept)
SELECT source_id, pos, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms FROM k WHERE n <= {N_SLIDES}"""
)
def slide_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ4, LIM2: slides at entities' words, fitted into what the overlays leave free, the first few that don't overlap."""
    m = marks(timeline(spark, sf_dir), ("slide", words.stem(F.col("text"), words.EDGES).isin(list(ENTITIES))))
    ends = lengths(m)
    gaps = intervals.free_gaps(overlays(callouts(spark, sf_dir, ends), ends), ends.withColumnRenamed("dur", "duration_ms"), "source_id")
    want = m.where("slot = 'slide'").select("source_id", "pos", F.col("t").alias("start_ms"), (F.col("t") + 3000).alias("end_ms"))
    kept = intervals.greedy(intervals.in_gap(want, gaps, "source_id", "pos", 60_000), "source_id", "pos")
    ranked = kept.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy("start_ms")))
    return ranked.where(f"n <= {N_SLIDES}").select("source_id", "pos", "start_ms", "end_ms")


@Q.add(
    f"""WITH {WORDS},
n AS (SELECT *, trim(lower(text), '.,!?;:—-') AS s FROM words),
k AS (SELECT source_id, count(*) AS n_words, string_agg(text, ' ' ORDER BY pos) AS line FROM n WHERE s NOT IN ({quoted([f for f in P.TABLE_FILLERS if ' ' not in f])}) GROUP BY source_id),
b AS (SELECT source_id, n_words, line, source_id % 100 / 100.0 AS top, source_id % 100 / 100.0 + 0.2 AS bot, ['tiktok', 'instagram', 'youtube', 'generic'][source_id % 4 + 1] AS platform FROM k)
SELECT source_id, n_words, md5(line) AS line_md5, platform,
  CAST(round(CASE WHEN bot + 0.025 + 0.13 <= lim THEN bot + 0.025 WHEN top - 0.155 >= 0.05 THEN top - 0.155 ELSE dt END, 4) AS DOUBLE) AS band_top
FROM b JOIN (VALUES ('tiktok', 0.86, 0.60), ('instagram', 0.84, 0.58), ('youtube', 0.90, 0.62), ('generic', 0.88, 0.60)) v(platform, lim, dt) USING (platform)"""
)
def caption_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT5, SCL6, TIM15: caption words without fillers, and the band they stand in."""
    w = timeline(spark, sf_dir)
    bare = F.btrim(F.lower("text"), F.lit(".,!?;:—-"))
    kept = w.where(~bare.isin([f for f in P.TABLE_FILLERS if " " not in f]))
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    k = kept.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_words"), F.md5(line).alias("line_md5"))
    # hundredths of a per cent, so that both engines compare whole numbers
    top, bottom = F.col("source_id") % 100 * 100, F.col("source_id") % 100 * 100 + 2000
    platform = F.get(F.array(*map(F.lit, ("tiktok", "instagram", "youtube", "generic"))), (F.col("source_id") % 4).cast("int"))
    limit = T.lookup(F.col("platform"), {"tiktok": "8600", "instagram": "8400", "youtube": "9000"}, "8800").cast("long")
    default = T.lookup(F.col("platform"), {"tiktok": "6000", "instagram": "5800", "youtube": "6200"}, "6000").cast("long")
    band = F.when(bottom + 250 + 1300 <= limit, bottom + 250).when(top - 1550 >= 500, top - 1550).otherwise(default)
    return k.withColumn("platform", platform).select("source_id", "n_words", "line_md5", "platform", (band / 10000).alias("band_top"))


@Q.add(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS BIGINT) AS k FROM documents),
w AS (SELECT doc_id, k, regexp_extract(trim(s), '^[^ ]+') AS kw FROM l WHERE trim(s) <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(kw) ORDER BY k) AS r FROM w WHERE kw <> ''),
g AS (SELECT doc_id, string_agg(kw, '|' ORDER BY k) AS kws, list(kw ORDER BY k) AS ks FROM f WHERE r = 1 GROUP BY doc_id),
h AS (SELECT doc_id, max(quality) AS score FROM labels GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(ks), 0) AS INTEGER) AS n_keywords, coalesce(array_to_string(list_concat([upper(source)], ks)[1:10], '|'), upper(source)) AS keywords, score,
  trim(replace(replace(replace(replace(replace(d.text, ' — ', ', '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')[1:100]) AS title
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN h USING (doc_id)"""
)
def publish_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN14, AGG12, LIM3, JOI8: first words of a text's lines as keywords, first occurrence kept, the source put before them."""
    d = table(spark, sf_dir, "documents")
    first = F.transform(F.split("text", "\n"), lambda s: F.regexp_extract(F.trim(s), "^[^ ]+", 0))
    named = F.filter(first, lambda s: s != "")
    # each lower-case form once, and of those shown the spelling met first
    k = d.withColumn("named", named).withColumn("low", F.transform("named", F.lower)).withColumn("each", F.array_distinct("low"))
    kws = F.transform(F.slice("each", 1, 9), lambda s: F.get("named", F.array_position(F.col("low"), s).cast("int") - 1))
    k = k.withColumn("kws", kws)
    score = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("score"))
    title = F.replace(F.col("text"), F.lit(" — "), F.lit(", "))
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        title = F.replace(title, F.lit(plain), F.lit(code))
    joined = F.array_join(F.slice(F.concat(F.array(F.upper("source")), "kws"), 1, 10), "|")
    return k.join(score, "doc_id", "left").select("doc_id", F.size("each").alias("n_keywords"), joined.alias("keywords"), "score", F.trim(F.substring(title, 1, 100)).alias("title"))
