"""Queries over word timelines of documents and over events, with the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from spanloom.functions import params as P
from spanloom.functions import text as T
from spanloom.operators import intervals, stats, words
from spanloom.operators.folds import along
from spanloom.plans.common import Queries, quoted, table

Q = Queries()

WORDS = r"""
w0 AS (SELECT doc_id AS source_id, regexp_extract_all(text, '[^ \t\n\r]+') AS toks FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
w1 AS (SELECT source_id, unnest(toks) AS text, CAST(unnest(range(0, len(toks))) AS BIGINT) AS pos FROM w0),
w2 AS (SELECT *, 60 * length(text) AS dur, CASE WHEN (pos * 7919 + source_id * 104729) % 97 = 0 THEN 900 WHEN regexp_matches(text, '[.!?]$') THEN 400 WHEN regexp_matches(text, ',$') THEN 250 ELSE 40 END AS gap FROM w1),
w3 AS (SELECT source_id, pos, text, dur, CAST(sum(dur + gap) OVER (PARTITION BY source_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - gap AS BIGINT) AS end_ms FROM w2),
words AS (SELECT source_id, pos, text, end_ms - dur AS start_ms, end_ms FROM w3)"""

STEM = "rtrim(lower(trim(text)), '{}')"
CUTS = f""",
near AS (SELECT *, {STEM.format(',.?!:;-')} AS s1, {STEM.format(',.?!:;')} AS s2, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS ns, lead(start_ms, 2) OVER w AS ns2, lead(end_ms) OVER w AS ne FROM words WINDOW w AS (PARTITION BY source_id ORDER BY pos)),
silence AS (SELECT source_id, end_ms + 300 AS start_ms, ns - 300 AS end_ms, 'silence' AS kind FROM near WHERE ns - end_ms > 800 AND ns - 300 > end_ms + 300 + 50),
st1 AS (SELECT *, CASE WHEN s1 <> '' AND s1 = lag(s1) OVER w AND start_ms - pe <= 350 THEN 0 ELSE 1 END AS o FROM near WINDOW w AS (PARTITION BY source_id ORDER BY pos)),
st2 AS (SELECT *, sum(o) OVER (PARTITION BY source_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM st1),
st3 AS (SELECT source_id, count(*) AS n, greatest(min(start_ms), coalesce(arg_min(coalesce(pe, -1), pos), -1) + 1) AS a, max(start_ms) AS b FROM st2 GROUP BY source_id, run),
stutter AS (SELECT source_id, a AS start_ms, b AS end_ms, 'stutter' AS kind FROM st3 WHERE n >= 2 AND b > a + 20),
f1 AS (SELECT *, s2 IN ({quoted([f for f in P.TABLE_FILLERS if ' ' not in f])}) AS one, coalesce(s2 || ' ' || lead(s2) OVER w IN ({quoted([f for f in P.TABLE_FILLERS if ' ' in f])}), false) AS two FROM near WINDOW w AS (PARTITION BY source_id ORDER BY pos)),
f2 AS (SELECT *, two AND NOT one AS pair, pos - row_number() OVER (PARTITION BY source_id, two AND NOT one ORDER BY pos) AS island FROM f1),
f3 AS (SELECT *, pair AND row_number() OVER (PARTITION BY source_id, pair, island ORDER BY pos) % 2 = 1 AS taken FROM f2),
f4 AS (SELECT *, one AND NOT coalesce(lag(taken) OVER (PARTITION BY source_id ORDER BY pos), false) AS alone FROM f3),
filler AS (
  SELECT source_id, greatest(coalesce(pe, 0) + 1, start_ms - 60) AS start_ms,
    CASE WHEN taken THEN least(coalesce(ns2, ne + 1000) - 1, ne + 60) ELSE least(coalesce(ns, end_ms + 1000) - 1, end_ms + 60) END AS end_ms, 'filler' AS kind
  FROM f4 WHERE alone OR taken),
cuts AS (SELECT * FROM silence UNION ALL SELECT * FROM stutter UNION ALL SELECT * FROM filler WHERE end_ms > start_ms)"""

MERGED = """,
m1 AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 20 THEN 0 ELSE 1 END AS o FROM cuts),
m2 AS (SELECT *, sum(o) OVER (PARTITION BY source_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM m1),
merged AS (SELECT source_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM m2 GROUP BY source_id, island)"""

#: By an inequality join, unlike the engine's streams.
RETIMED = """,
hit AS (SELECT DISTINCT w.source_id, w.pos FROM words w JOIN merged c ON w.source_id = c.source_id AND w.start_ms < c.end_ms AND w.end_ms > c.start_ms),
shift AS (SELECT w.source_id, w.pos, coalesce(sum(c.end_ms - c.start_ms), 0) AS gone FROM words w LEFT JOIN merged c ON w.source_id = c.source_id AND c.end_ms <= w.start_ms GROUP BY ALL),
retimed AS (SELECT w.source_id, w.pos, w.text, CAST(w.start_ms - gone AS BIGINT) AS start_ms, CAST(w.end_ms - gone AS BIGINT) AS end_ms FROM words w JOIN shift USING (source_id, pos) ANTI JOIN hit USING (source_id, pos))"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.from_documents(table(spark, sf_dir, "documents"))


@Q.add(f"WITH {WORDS} SELECT source_id, count(*) AS n, max(end_ms) AS last_ms, CAST(sum(start_ms * (pos % 7 + 1)) AS BIGINT) AS checksum FROM words GROUP BY source_id")
def words_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1."""
    w = timeline(spark, sf_dir)
    return w.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max("end_ms").alias("last_ms"), F.sum(F.col("start_ms") * (F.col("pos") % 7 + 1)).alias("checksum"))


@Q.add(f"WITH {WORDS}{CUTS} SELECT source_id, kind, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, CAST(sum(start_ms) AS BIGINT) AS starts FROM cuts GROUP BY ALL")
def cut_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN3, WIN9, WIN10, SET1, JOI15, SCL3, SCL4."""
    cuts = words.all_cuts(timeline(spark, sf_dir), P.TABLE_FILLERS)
    return cuts.groupBy("source_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.sum("start_ms").alias("starts"))


@Q.add(f"WITH {WORDS}{CUTS}{MERGED} SELECT source_id, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms FROM merged")
def merged_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN3, WIN5."""
    return intervals.merge(words.all_cuts(timeline(spark, sf_dir), P.TABLE_FILLERS), "source_id").select("source_id", F.col("start_ms").cast("long"), F.col("end_ms").cast("long"))


@Q.add(
    f"""WITH {WORDS}{CUTS}{MERGED}{RETIMED},
k AS (SELECT source_id, count(*) AS kept_words, max(end_ms) AS last_ms, sum(start_ms * (pos % 7 + 1)) AS checksum FROM retimed GROUP BY source_id),
c AS (SELECT source_id, count(*) AS n_cuts, sum(end_ms - start_ms) AS removed_ms FROM merged GROUP BY source_id)
SELECT source_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(kept_words, 0) AS BIGINT) AS kept_words, CAST(coalesce(n_cuts, 0) AS BIGINT) AS n_cuts, CAST(coalesce(removed_ms, 0) AS BIGINT) AS removed_ms, last_ms, CAST(checksum AS BIGINT) AS checksum
FROM (SELECT source_id, count(*) AS n_words FROM words GROUP BY source_id) LEFT JOIN k USING (source_id) LEFT JOIN c USING (source_id)"""
)
def clean_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN3, PLN4, JOI3, WIN4, AGG1, AGG3: the flagship."""
    w = timeline(spark, sf_dir)
    stream = words.timeline_stream(w, intervals.merge(words.all_cuts(w, P.TABLE_FILLERS), "source_id"))
    word, cut, kept = F.col("cs").isNull(), F.col("cs").isNotNull(), F.col("kept")
    start = F.col("start_ms") - F.col("gone")
    return stream.groupBy("source_id").agg(
        F.count_if(word).alias("n_words"),
        F.count_if(kept).alias("kept_words"),
        F.count_if(cut).alias("n_cuts"),
        F.coalesce(F.sum(F.when(cut, F.col("ce") - F.col("cs"))), F.lit(0)).cast("long").alias("removed_ms"),
        F.max(F.when(kept, F.col("end_ms") - F.col("gone"))).cast("long").alias("last_ms"),
        F.sum(F.when(kept, start * (F.col("pos") % 7 + 1))).cast("long").alias("checksum"),
    )


@Q.add(
    f"""WITH {WORDS},
p1 AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w <= 450 THEN 0 ELSE 1 END AS o FROM words WINDOW w AS (PARTITION BY source_id ORDER BY pos)),
p2 AS (SELECT *, sum(o) OVER (PARTITION BY source_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS session FROM p1),
p3 AS (SELECT *, (row_number() OVER (PARTITION BY source_id, session ORDER BY pos) - 1) // 4 AS part FROM p2)
SELECT source_id, min(pos) AS first_pos, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY pos) AS text FROM p3 GROUP BY source_id, session, part"""
)
def phrase_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN7, AGG13."""
    return words.phrases(timeline(spark, sf_dir))


@Q.add(f"WITH {WORDS} SELECT source_id, pos // 6 AS chunk, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n, greatest(min(start_ms) - 120, 0) AS show_ms, max(end_ms) + 350 AS hide_ms FROM words GROUP BY ALL")
def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN8, TIM18."""
    made = words.chunks(timeline(spark, sf_dir), 6)
    return made.withColumn("show_ms", F.greatest(F.col("start_ms") - 120, F.lit(0))).withColumn("hide_ms", F.col("end_ms") + 350)


SEGMENTS = """,
ends AS (SELECT source_id, max(end_ms) AS l FROM words GROUP BY source_id),
segments AS (SELECT source_id, 0 AS seg_no, l // 2 AS seg_start, l AS seg_end FROM ends UNION ALL SELECT source_id, 1, l // 10, l * 4 // 10 FROM ends UNION ALL SELECT source_id, 2, l * 3 // 10, l * 6 // 10 FROM ends)"""


def segments(w: DataFrame) -> DataFrame:
    """Three stretches of each source, out of order and overlapping."""
    ends = w.groupBy("source_id").agg(F.max("end_ms").alias("l"))
    parts = "array(struct(0 as seg_no, l div 2 as seg_start, l as seg_end), struct(1 as seg_no, l div 10 as seg_start, l * 4 div 10 as seg_end), struct(2 as seg_no, l * 3 div 10 as seg_start, l * 6 div 10 as seg_end))"
    return ends.select("source_id", F.inline(F.expr(parts)))


@Q.add(
    f"""WITH {WORDS}{SEGMENTS},
o AS (SELECT *, coalesce(sum(seg_end - seg_start) OVER (PARTITION BY source_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, coalesce(sum(seg_end - seg_start) OVER (PARTITION BY source_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - seg_no * 80 AS seam FROM segments)
SELECT o.source_id, o.seg_no, CAST(off AS BIGINT) AS offset_ms, CAST(seam AS BIGINT) AS seam_ms, count(pos) AS n, CAST(min(start_ms - seg_start + off) AS BIGINT) AS first_ms, CAST(max(end_ms - seg_start + off) AS BIGINT) AS last_ms, CAST(sum((start_ms - seg_start + off) * (pos % 7 + 1)) AS BIGINT) AS checksum
FROM o LEFT JOIN words w ON o.source_id = w.source_id AND start_ms >= seg_start AND end_ms <= seg_end GROUP BY ALL"""
)
def segment_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI1, WIN1, WIN15, AGG2."""
    w = timeline(spark, sf_dir)
    parts = segments(w)
    before = Window.partitionBy("source_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset_ms", F.coalesce(F.sum(F.col("seg_end") - F.col("seg_start")).over(before), F.lit(0)).cast("long"))
    made = words.slice_segments(w, parts).groupBy("source_id", "seg_no").agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.sum(F.col("start_ms") * (F.col("pos") % 7 + 1)).alias("checksum"))
    return offsets.join(made, ["source_id", "seg_no"], "left").select("source_id", "seg_no", "offset_ms", (F.col("offset_ms") - F.col("seg_no") * 80).alias("seam_ms"), F.coalesce("n", F.lit(0)).alias("n"), "first_ms", "last_ms", "checksum")


SNAP = """,
ends AS (SELECT source_id, max(end_ms) AS l, count(*) AS nw FROM words GROUP BY source_id),
targets AS (SELECT source_id, nw, k AS target, l * k // 7 AS t_ms, k % 2 = 1 AS after FROM ends, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 9]) AS k)),
g AS (SELECT *, lead(start_ms) OVER (PARTITION BY source_id ORDER BY pos) AS ns FROM words),
gaps AS (SELECT source_id, pos, text, ns - end_ms AS gap, end_ms + ns AS mid2 FROM g WHERE ns > end_ms),
c AS (SELECT t.source_id, target, pos, mid2, gap, text, abs(mid2 - 2 * t_ms) AS d, after AND mid2 >= 2 * t_ms AS wide, after FROM targets t JOIN gaps USING (source_id)),
tier AS (SELECT *, CASE
    WHEN regexp_matches(trim(text), '[.!?]["”]?$') AND gap >= 200 AND d <= CASE WHEN wide THEN 3600 ELSE 1200 END THEN 0
    WHEN gap >= 350 AND d <= CASE WHEN wide THEN 3600 ELSE 1200 END THEN 1
    WHEN d <= CASE WHEN wide THEN 6000 ELSE 3000 END THEN 2 WHEN d <= CASE WHEN wide THEN 9600 ELSE 6000 END THEN 3 END AS tier FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id, target ORDER BY tier IS NULL, tier, CASE WHEN tier IS NULL THEN d WHEN wide THEN d * 7 WHEN after THEN d * 13 ELSE d * 10 END, pos) AS k FROM tier),
snapped AS (SELECT t.source_id, target, t_ms, after, CASE WHEN nw < 2 THEN 2 * t_ms ELSE r.mid2 END AS mid2, r.tier FROM targets t LEFT JOIN (SELECT source_id, target, mid2, tier FROM r WHERE k = 1) r USING (source_id, target))"""


def targets(w: DataFrame) -> DataFrame:
    ends = w.groupBy("source_id").agg(F.max("end_ms").alias("l"))
    return ends.select("source_id", "l", F.explode(F.expr("array(0, 1, 2, 3, 4, 5, 6, 9)")).alias("target")).select("source_id", "target", F.expr("l * target div 7").alias("t_ms"), (F.col("target") % 2 == 1).alias("after"))


@Q.add(f"WITH {WORDS}{SNAP} SELECT source_id, CAST(target AS INTEGER) AS target, t_ms, after, mid2, tier FROM snapped")
def boundary_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI2, WIN2, TOP2, SCL10."""
    w = timeline(spark, sf_dir)
    return words.snap(targets(w), w)


@Q.add(
    f"""WITH {WORDS}{SNAP},
pairs AS (SELECT a.source_id, a.target, a.t_ms AS raw_a, b.t_ms AS raw_b, a.mid2 AS a2, b.mid2 AS b2 FROM snapped a JOIN snapped b ON a.source_id = b.source_id AND b.target = a.target + 1 WHERE a.target IN (0, 2, 4)),
ok AS (SELECT source_id, count(*) AS n, sum(b2 - a2) AS d2 FROM pairs WHERE b2 - a2 >= 1000 GROUP BY source_id)
SELECT source_id, CAST(coalesce(n, 0) AS BIGINT) AS n_segments, CAST(coalesce(d2 / 2, raw) AS DOUBLE) AS duration_ms FROM (SELECT source_id, sum(raw_b - raw_a) AS raw FROM pairs GROUP BY source_id) LEFT JOIN ok USING (source_id)"""
)
def snapped_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLN5, TIM6: segments whose ends both snap and lie half a second apart; all of them as they were, if none does."""
    w = timeline(spark, sf_dir)
    found = words.snap(targets(w), w)
    first = F.col("target") % 2 == 0
    side = lambda c, at: F.max(F.when(at, F.col(c)))
    pairs = found.where("target between 0 and 5").groupBy("source_id", F.expr("target div 2").alias("pair")).agg(side("mid2", first).alias("a2"), side("mid2", ~first).alias("b2"), (side("t_ms", ~first) - side("t_ms", first)).alias("raw"))
    long = F.col("b2") - F.col("a2")
    fits = F.coalesce(long >= 1000, F.lit(False))
    made = pairs.groupBy("source_id").agg(F.count_if(fits).alias("n_segments"), F.sum(F.when(fits, long)).alias("d2"), F.sum("raw").alias("raw"))
    return made.select("source_id", "n_segments", F.coalesce(F.col("d2") / 2, F.col("raw").cast("double")).alias("duration_ms"))


@Q.add(
    f"""WITH {WORDS},
b AS (SELECT *, rtrim(lower(trim(text)), '.,!?:;"'')') AS s FROM words),
h AS (SELECT source_id, pos, start_ms, 'money' AS list FROM b WHERE s IN ({quoted(P.TABLE_MONEY)}) OR contains(s, '$') OR regexp_full_match(s, '[0-9]+[km]?') UNION ALL SELECT source_id, pos, start_ms, 'negative' FROM b WHERE s IN ({quoted(P.TABLE_NEGATIVE)}))
SELECT source_id, list, count(*) AS n, min(start_ms) AS first_ms FROM h GROUP BY ALL"""
)
def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI14, WIN13, SCL5, SCL8."""
    w = timeline(spark, sf_dir)
    both = words.lexicon_hits(w, P.TABLE_MONEY, True).withColumn("list", F.lit("money")).unionByName(words.lexicon_hits(w, P.TABLE_NEGATIVE).withColumn("list", F.lit("negative")))
    return both.groupBy("source_id", "list").agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("first_ms"))


@Q.add(
    f"""WITH {WORDS},
b AS (SELECT source_id, pos, start_ms, trim(lower(text), '.,!?') AS s FROM words),
c AS (SELECT source_id, start_ms, s || ' ' || lead(s, 1) OVER w AS g2, g2 || ' ' || lead(s, 2) OVER w AS g3, g3 || ' ' || lead(s, 3) OVER w AS g4, g4 || ' ' || lead(s, 4) OVER w AS g5 FROM b WINDOW w AS (PARTITION BY source_id ORDER BY pos)),
g AS (SELECT source_id, start_ms, unnest([g2, g3, g4, g5]) AS gram FROM c),
i AS (SELECT DISTINCT item_id AS phrase_id, unnest(list_transform(range(2, 6), lambda n: array_to_string(list_transform(t[1:n], lambda x: trim(lower(x), '.,!?')), ' '))) AS phrase FROM (SELECT item_id, regexp_extract_all(text, '[^ \\t\\n\\r]+') AS t FROM benchmark) WHERE len(t) > 4)
SELECT source_id, phrase_id, count(*) AS n, min(start_ms) AS first_ms FROM g JOIN i ON gram = phrase GROUP BY ALL"""
)
def phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI15, SCL7: the first two, three, four and five words of each benchmark item, wherever they stand."""
    t = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), F.regexp_extract_all("text", F.lit(r"([^ \t\n\r]+)"), F.lit(1)).alias("t")).where("size(t) > 4")
    phrases = t.select("phrase_id", F.explode(F.transform(F.sequence(F.lit(2), F.lit(5)), lambda n: F.array_join(F.transform(F.slice("t", F.lit(1), n), words.bare), " "))).alias("phrase"))
    return words.phrase_hits(timeline(spark, sf_dir), phrases)


def spoken(marked: DataFrame, line: str, second: str) -> DataFrame:
    """Words (source_id, pos, text, start_ms, line) to one row a line: its start, a mark made of it, and its words."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    lines = marked.groupBy("source_id", line).agg(F.min("start_ms").alias("start_ms"), joined.alias("words"), F.min_by("code", "pos").alias("code") if "code" in marked.columns else F.lit(None).alias("code"))
    return lines.select("source_id", line, "code", F.concat(F.lit("\n[t="), F.expr(second).cast("string"), F.lit("s]\n")).alias("mark"), "words")


def whole(lines: DataFrame, line: str, shown: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(line, shown.alias("shown")))), lambda x: x["shown"]), "\n")


def transcript(marker_ms: int, second: str):
    """SEQ1, SEQ2. The transcript with a mark at each word that starts so long after the last mark's word: one fold along each source's words."""

    def step(last: list, start: int) -> bool:
        if start - last[0] < marker_ms:
            return False
        last[0] = start
        return True

    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = timeline(spark, sf_dir).select("source_id", "pos", "text", "start_ms")
        marked = along(w, "source_id", ["pos"], ["start_ms"], "mark", BooleanType(), lambda: [-marker_ms], step)
        marked = marked.withColumn("line", F.sum(F.col("mark").cast("int")).over(words.by_pos().rowsBetween(Window.unboundedPreceding, 0)))
        lines = spoken(marked, "line", second)
        made = lines.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_markers"), whole(lines, "line", F.concat("mark", "words")).alias("text"))
        return made.select("source_id", "n_markers", F.substr("text", F.lit(2)).alias("text"))

    plan.__doc__ = transcript.__doc__
    return plan


def transcript_sql(ms: int, second: str) -> str:
    return f"""WITH RECURSIVE {WORDS.strip()},
m(source_id, mk) AS (
  SELECT source_id, min(start_ms) FROM words GROUP BY source_id
  UNION ALL SELECT m.source_id, (SELECT min(w.start_ms) FROM words w WHERE w.source_id = m.source_id AND w.start_ms >= m.mk + {ms}) FROM m WHERE m.mk IS NOT NULL),
l AS (SELECT w.source_id, m.mk, string_agg(w.text, ' ' ORDER BY w.pos) AS line FROM words w ASOF JOIN (SELECT * FROM m WHERE mk IS NOT NULL) m ON w.source_id = m.source_id AND w.start_ms >= m.mk GROUP BY ALL)
SELECT source_id, count(*) AS n_markers, ltrim(string_agg(chr(10) || '[t=' || CAST({second} AS BIGINT) || 's]' || chr(10) || line, chr(10) ORDER BY mk), chr(10)) AS text FROM l GROUP BY source_id"""


Q.put("transcript_10s", transcript(10_000, "start_ms div 1000"), transcript_sql(10_000, "mk // 1000"))  # SEQ1
Q.put("transcript_8s", transcript(8_000, "cast(bround(start_ms / 1000) as long)"), transcript_sql(8_000, "round_even(mk / 1000.0, 0)"))  # SEQ2, TIM9


@Q.add(
    f"""WITH RECURSIVE {WORDS.strip()},
l AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY source_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - length(text) - 1 AS c FROM words),
b(source_id, pos, start_ms, c, last, before) AS (
  SELECT source_id, pos, start_ms, c, CAST(-10 AS BIGINT), CAST(NULL AS BOOLEAN) FROM l WHERE pos = 0
  UNION ALL
  SELECT source_id, x.pos, x.start_ms, x.c, CASE WHEN start_ms // 1000 - last >= 9 THEN start_ms // 1000 ELSE last END, start_ms // 1000 - last >= 9
  FROM (SELECT b.*, (SELECT min({{'pos': l.pos, 'start_ms': l.start_ms, 'c': l.c}}) FROM l WHERE l.source_id = b.source_id AND l.pos > b.pos AND (l.start_ms - b.start_ms > 10000 OR l.c - b.c - 1 > 350)) AS x FROM b) WHERE x IS NOT NULL),
k AS (SELECT source_id, pos AS block, start_ms, coalesce(lead(before) OVER (PARTITION BY source_id ORDER BY pos), true) AS marked FROM b),
t AS (SELECT w.source_id, block, k.start_ms, marked, string_agg(w.text, ' ' ORDER BY w.pos) AS line FROM words w ASOF JOIN k ON w.source_id = k.source_id AND w.pos >= k.block GROUP BY ALL)
SELECT source_id, count(*) AS n_blocks, count(*) FILTER (marked) AS n_markers, string_agg(CASE WHEN marked THEN chr(10) || '[t=' || start_ms // 1000 || 's]' || chr(10) ELSE '' END || line, chr(10) ORDER BY block) AS text FROM t GROUP BY source_id"""
)
def transcript_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ6: a block ends when it is ten seconds old or longer than 350 characters; it gets a mark nine seconds after the last one, the last block always."""

    def step(s: list, start: int, size: int) -> int:
        """0: the block goes on; 1: a new one, no mark for the one before; 2: a new one, and a mark."""
        if s[0] is None:
            s[:] = start, size, -10
            return 1
        if start - s[0] <= 10_000 and s[1] <= 350:
            s[1] += size + 1
            return 0
        second = s[0] // 1000
        marks = second - s[2] >= 9
        s[:] = start, size, second if marks else s[2]
        return 1 + marks

    w = timeline(spark, sf_dir).select("source_id", "pos", "text", "start_ms", F.length("text").alias("size"))
    coded = along(w, "source_id", ["pos"], ["start_ms", "size"], "code", LongType(), lambda: [None, 0, 0], step)
    coded = coded.withColumn("block", F.sum((F.col("code") > 0).cast("int")).over(words.by_pos().rowsBetween(Window.unboundedPreceding, 0)))
    lines = spoken(coded, "block", "start_ms div 1000")
    marked = lines.withColumn("marked", F.coalesce(F.lead("code").over(Window.partitionBy("source_id").orderBy("block")) == 2, F.lit(True)))
    shown = F.concat(F.when(F.col("marked"), F.col("mark")).otherwise(""), "words")
    return marked.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if("marked").alias("n_markers"), whole(marked, "block", shown).alias("text"))


EVENTS = """
e0 AS (SELECT event_id, user_id, event_type, CAST(epoch_us(ts) // 1000 AS BIGINT) AS start_ms, CAST(epoch_us(ts) // 1000 AS BIGINT) + 60000 + CAST(floor(value * 100000 + 0.5) AS BIGINT) AS end_ms FROM events)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event lasts a minute and 100 s for each unit of its value."""
    e = table(spark, sf_dir, "events")
    start = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    return e.select("event_id", "user_id", "event_type", start.alias("start_ms"), (start + 60000 + F.floor(F.col("value") * 100000 + 0.5)).cast("long").alias("end_ms"))


CELL = 3_600_000
SLICE = 24 * CELL


@Q.add(
    f"""WITH {EVENTS.strip()}, cuts AS (SELECT user_id AS source_id, start_ms, end_ms FROM e0){MERGED} SELECT source_id AS user_id, start_ms, end_ms FROM merged"""
)
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN5 on events."""
    return intervals.merge(events(spark, sf_dir), "user_id", cell_ms=SLICE)


@Q.add(
    f"""WITH {EVENTS.strip()},
a AS (SELECT * FROM e0 WHERE event_id % 2 = 0), m AS (SELECT * FROM e0 WHERE event_id % 2 = 1),
s AS (SELECT a.*, 'auto' AS origin FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = a.user_id AND a.start_ms < m.end_ms AND a.end_ms > m.start_ms) UNION ALL SELECT *, 'manual' FROM m)
SELECT event_id, user_id, start_ms, end_ms, origin FROM s"""
)
def manual_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI4, JOI5, SET2: odd events stay, even ones where they overlap none of them."""
    e = events(spark, sf_dir).select("event_id", "user_id", "start_ms", "end_ms")
    manual = e.where("event_id % 2 = 1")
    auto = intervals.without_overlap(e.where("event_id % 2 = 0"), manual, ["user_id"], CELL)
    return auto.withColumn("origin", F.lit("auto")).unionByName(manual.withColumn("origin", F.lit("manual")))


DAY = 86_400_000
GAPS = f"""
d AS (SELECT user_id, start_ms - first_value(start_ms) OVER w AS start_ms, end_ms - first_value(start_ms) OVER w AS end_ms, event_id FROM e0 WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, event_id ROWS UNBOUNDED PRECEDING)),
len AS (SELECT user_id, max(start_ms) + {DAY} AS duration_ms FROM d GROUP BY user_id),
rows AS (SELECT user_id, start_ms, end_ms, 0 AS last FROM d UNION ALL SELECT user_id, duration_ms, NULL, 1 FROM len),
cur AS (SELECT *, greatest(0, coalesce(max(end_ms) OVER (PARTITION BY user_id ORDER BY last, start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS cursor FROM rows),
gaps AS (SELECT user_id, CAST(cursor + 200 AS BIGINT) AS start_ms, CAST(start_ms - 200 AS BIGINT) AS end_ms FROM cur WHERE start_ms - cursor >= 2400)"""


def from_first(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    first = F.min("start_ms").over(Window.partitionBy("user_id"))
    d = e.select("event_id", "user_id", (F.col("start_ms") - first).alias("start_ms"), (F.col("end_ms") - first).alias("end_ms"))
    return d, d.groupBy("user_id").agg((F.max("start_ms") + DAY).alias("duration_ms"))


@Q.add(f"WITH {EVENTS.strip()}, {GAPS.strip()} SELECT user_id, start_ms, end_ms FROM gaps")
def free_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN6."""
    d, lengths = from_first(events(spark, sf_dir))
    return intervals.free_gaps(d, lengths, "user_id", cell_ms=SLICE)


FIT = f"""
want AS (SELECT user_id, event_id, start_ms + 30000000 AS start_ms, start_ms + 30000000 + (event_id % 7) * 1000 AS end_ms FROM d),
p AS (SELECT w.*, k, CASE k WHEN 0 THEN start_ms + end_ms WHEN 1 THEN 2 * start_ms ELSE 2 * end_ms END AS t2 FROM want w, (SELECT unnest([0, 1, 2]) AS k)),
b AS (SELECT p.*, g.start_ms AS ga, g.end_ms AS gb, row_number() OVER (PARTITION BY p.user_id, event_id ORDER BY k, g.start_ms) AS r FROM p JOIN gaps g ON p.user_id = g.user_id AND t2 BETWEEN 2 * g.start_ms AND 2 * g.end_ms),
f AS (SELECT user_id, event_id, ga, gb, start_ms, least(greatest(end_ms - start_ms, 2000), 4500, gb - ga) AS size FROM b WHERE r = 1),
fitted AS (SELECT user_id, event_id, CAST(greatest(ga, least(start_ms, gb - size)) AS BIGINT) AS start_ms, CAST(greatest(ga, least(start_ms, gb - size)) + size AS BIGINT) AS end_ms FROM f)"""


def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lengths = from_first(events(spark, sf_dir))
    want = d.select("user_id", "event_id", (F.col("start_ms") + 30_000_000).alias("start_ms"), (F.col("start_ms") + 30_000_000 + F.col("event_id") % 7 * 1000).alias("end_ms"))
    return intervals.in_gap(want, intervals.free_gaps(d, lengths, "user_id"), "user_id", "event_id", CELL)


@Q.add(f"WITH {EVENTS.strip()}, {GAPS.strip()}, {FIT.strip()} SELECT user_id, event_id, start_ms, end_ms FROM fitted")
def fitted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI6, TIM5."""
    return fitted(spark, sf_dir)


@Q.add(
    f"""WITH RECURSIVE {EVENTS.strip()}, {GAPS.strip()}, {FIT.strip()},
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, end_ms, event_id) AS k FROM fitted),
g2(user_id, k, reach, kept) AS (SELECT user_id, k, end_ms, true FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, CASE WHEN o.start_ms >= reach THEN o.end_ms ELSE reach END, o.start_ms >= reach FROM g2 JOIN o ON o.user_id = g2.user_id AND o.k = g2.k + 1)
SELECT user_id, event_id, start_ms, end_ms FROM o JOIN g2 USING (user_id, k) WHERE kept"""
)
def greedy_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ4, SRT3, PLN7's last steps."""
    return intervals.greedy(fitted(spark, sf_dir), "user_id", "event_id", most=stats.MOST)


@Q.add(
    """WITH RECURSIVE e AS (SELECT user_id, event_type AS slot, epoch_us(ts) // 1000000 // 7200 * 40 AS t_ms, event_id FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_ms, slot, event_id) AS k FROM e),
g(user_id, k, t, s, kept) AS (SELECT user_id, k, t_ms, slot, true FROM o WHERE k = 1 UNION ALL
  SELECT o.user_id, o.k, CASE WHEN o.slot = s AND o.t_ms - t < 80 THEN t ELSE o.t_ms END, CASE WHEN o.slot = s AND o.t_ms - t < 80 THEN s ELSE o.slot END, NOT (o.slot = s AND o.t_ms - t < 80) FROM g JOIN o ON o.user_id = g.user_id AND o.k = g.k + 1),
f AS (SELECT user_id, t_ms, slot, event_id FROM o JOIN g USING (user_id, k) WHERE kept)
SELECT user_id, CAST(t_ms AS BIGINT) AS t_ms, slot, event_id, CAST((row_number() OVER (PARTITION BY user_id, slot ORDER BY t_ms, event_id) - 1) % n AS INTEGER) AS variant FROM f JOIN (VALUES ('signup', 1), ('purchase', 2), ('view', 3), ('click', 4)) v(slot, n) USING (slot)"""
)
def spaced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ3, WIN12, WIN14, SRT2."""
    e = table(spark, sf_dir, "events").select("user_id", F.expr("unix_micros(cast(ts as timestamp)) div 1000000 div 7200 * 40").alias("t_ms"), F.col("event_type").alias("slot"), "event_id")
    kept = intervals.apart(e, "user_id", most=stats.MOST)
    order = Window.partitionBy("user_id", "slot").orderBy("t_ms", "event_id")
    n = T.lookup(F.col("slot"), {"signup": "1", "purchase": "2", "view": "3", "click": "4"}, "0").cast("int")  # a slot without a file gives no event
    return kept.withColumn("n", n).where("n > 0").select("user_id", "t_ms", "slot", "event_id", ((F.row_number().over(order) - 1) % F.col("n")).alias("variant"))
