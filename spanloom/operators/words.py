"""Operators over words on a timeline: (source_id, pos, text, start_ms, end_ms)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from spanloom.functions import params as P
from spanloom.operators.folds import along
from spanloom.operators.scan import running
from spanloom.operators.tables import written


def by_pos() -> WindowSpec:
    return Window.partitionBy("source_id").orderBy("pos")


#: Bytes of text for a task: as rows of a sort its words take some 15 times as much, and a plan holds several sorts at once.
TASK_BYTES = 4 << 20


def from_documents(docs: DataFrame) -> DataFrame:
    """A timeline for texts: a word lasts 60 ms a character; pauses follow punctuation, and now and then a long one.
    Texts are dealt by source before they are cut up, so every window by source below needs no other shuffle; whole texts are less to write than lists of words, and their bytes, counted first, say into how many parts."""
    texts = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").alias("source_id"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = texts.repartition(1 + size // TASK_BYTES, "source_id")
    # the outer form, since of the plain one Spark infers conditions that cut every text up once more before it is dealt
    cut = dealt.select("source_id", F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0)).alias("w")).select("source_id", F.posexplode_outer("w").alias("pos", "text"))
    words = cut.where("text is not null").withColumn("pos", F.col("pos").cast("long"))
    gap = F.expr("case when (pos * 7919 + source_id * 104729) % 97 = 0 then 900 when endswith(text, '.') or endswith(text, '!') or endswith(text, '?') then 400 when endswith(text, ',') then 250 else 40 end")
    timed = words.withColumn("dur", 60 * F.length("text")).withColumn("gap", gap)
    end = F.sum(F.col("dur") + F.col("gap")).over(by_pos().rowsBetween(Window.unboundedPreceding, 0)) - F.col("gap")
    return timed.withColumn("end_ms", end.cast("long")).select("source_id", "pos", "text", (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms")


def stem(text: Column, drop: str) -> Column:
    """Lower case, without the given characters at the end."""
    return F.rtrim(F.lower(F.trim(text)), F.lit(drop))


#: What a list's words may end with.
EDGES = ".,!?:;\"')"


def gaps(words: DataFrame) -> DataFrame:
    """Each positive gap between a word and the next, with its middle in half milliseconds."""
    return words.withColumn("next_ms", F.lead("start_ms").over(by_pos())).where("next_ms > end_ms").withColumn("mid2", F.col("end_ms") + F.col("next_ms"))


def silence_cuts(words: DataFrame) -> DataFrame:
    following = words.withColumn("next_ms", F.lead("start_ms").over(by_pos())).where(F.col("next_ms") - F.col("end_ms") > P.SILENCE)
    cut = following.select("source_id", (F.col("end_ms") + P.SILENCE_MARGIN).alias("start_ms"), (F.col("next_ms") - P.SILENCE_MARGIN).alias("end_ms"))
    return cut.where(f"end_ms > start_ms + {P.SILENCE_LEAST}").withColumn("kind", F.lit("silence"))


def stutter_cuts(words: DataFrame, least: int = 2) -> DataFrame:
    """Of a run of equal stems at small gaps all but the last."""
    marked = words.withColumn("stem", stem(F.col("text"), ",.?!:;-")).withColumn("before_ms", F.lag("end_ms").over(by_pos())).withColumn("same", F.lag("stem").over(by_pos()) == F.col("stem"))
    opens = ~F.coalesce(F.col("same") & (F.col("stem") != "") & (F.col("start_ms") - F.col("before_ms") <= P.STUTTER_GAP), F.lit(False))
    runs = marked.withColumn("run", F.sum(opens.cast("int")).over(by_pos().rowsBetween(Window.unboundedPreceding, 0)))
    run = runs.groupBy("source_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("first"), F.max("start_ms").alias("end_ms"), F.min_by("before_ms", "pos").alias("before_ms"))
    cut = run.where(F.col("n") >= least).select("source_id", F.greatest("first", F.col("before_ms") + 1).alias("start_ms"), "end_ms")
    return cut.where(f"end_ms > start_ms + {P.STUTTER_LEAST}").withColumn("kind", F.lit("stutter"))


def _fillers(w: DataFrame, fillers: Sequence[str]) -> DataFrame:
    """w: with s2, the stem. Adds the words that the filler beginning here uses up (0: none), its end and what follows it. From left to right a word
    is looked at alone first, then the phrases in the list's order, of any length; a phrase uses up all its words."""
    order = by_pos()
    phrases = [f.split() for f in fillers if len(f.split()) > 1]
    lengths = sorted({len(p) for p in phrases})
    w = w.withColumns({f"__s{k}": F.lead("s2", k).over(order) for k in range(1, max(lengths, default=1))} | {f"__e{n}": F.lead("end_ms", n - 1).over(order) for n in lengths} | {f"__a{n}": F.lead("start_ms", n).over(order) for n in (1, *lengths)})
    alone = F.col("s2").isin([f for f in fillers if len(f.split()) == 1])
    stood = F.lit(0)
    for p in reversed(phrases):
        same = F.col("s2") == p[0]
        for k in range(1, len(p)):
            same = same & (F.col(f"__s{k}") == p[k])
        stood = F.when(F.coalesce(same, F.lit(False)), len(p)).otherwise(stood)
    w = w.withColumn("size", F.when(alone, 1).otherwise(stood).cast("long"))
    if max(lengths, default=2) == 2:
        # of pairs that start at one word after another every second one overlaps the one before
        pair = F.col("size") == 2
        so_far = order.rowsBetween(Window.unboundedPreceding, 0)
        w = w.withColumn("__pairs", F.sum(pair.cast("int")).over(so_far))
        w = w.withColumn("__taken", pair & ((F.col("__pairs") - F.coalesce(F.last(F.when(~pair, F.col("__pairs")), True).over(so_far), F.lit(0))) % 2 == 1)).drop("__pairs")
        used = F.col("__taken") | (F.col("size") == 1) & ~F.coalesce(F.lag("__taken").over(order), F.lit(False))
        w = w.withColumn("size", F.when(used, F.col("size")).otherwise(0)).drop("__taken")
    else:

        def step(left: list, size: int) -> int:
            if left[0]:
                left[0] -= 1
                return 0
            left[0] = max(size - 1, 0)
            return size

        w = along(w.withColumnRenamed("size", "__size"), "source_id", ["pos"], ["__size"], "size", LongType(), lambda: [0], step).drop("__size")
    last, after = F.col("end_ms"), F.col("__a1")
    for n in lengths:
        last, after = F.when(F.col("size") == n, F.col(f"__e{n}")).otherwise(last), F.when(F.col("size") == n, F.col(f"__a{n}")).otherwise(after)
    return w.withColumn("last", last).withColumn("after", F.coalesce(after, F.col("last") + 1000)).drop(*(c for c in w.columns if c[:3] in ("__s", "__e", "__a") and c[3:].isdigit()))


def _filler(before: Column) -> tuple[Column, Column]:
    return F.greatest(F.coalesce(before, F.lit(0)) + 1, F.col("start_ms") - P.FILLER_PAD), F.least(F.col("after") - 1, F.col("last") + P.FILLER_PAD)


def filler_cuts(words: DataFrame, fillers: Sequence[str]) -> DataFrame:
    seen = _fillers(words.withColumn("s2", stem(F.col("text"), ",.?!:;")).withColumn("before_ms", F.lag("end_ms").over(by_pos())), fillers).where("size > 0")
    start, end = _filler(F.col("before_ms"))
    return seen.select("source_id", start.alias("start_ms"), end.alias("end_ms")).where("end_ms > start_ms").withColumn("kind", F.lit("filler"))


def all_cuts(words: DataFrame, fillers: Sequence[str]) -> DataFrame:
    """The three kinds of cuts, bag union, in one pass over the words: the same as filler_cuts, stutter_cuts and silence_cuts apart."""
    order, so_far = by_pos(), by_pos().rowsBetween(Window.unboundedPreceding, 0)
    w = words.withColumn("s1", stem(F.col("text"), ",.?!:;-")).withColumn("s2", stem(F.col("text"), ",.?!:;")).drop("text")
    w = w.withColumns({"before_ms": F.lag("end_ms").over(order), "s1_before": F.lag("s1").over(order), "next_ms": F.lead("start_ms").over(order)})
    same = F.coalesce((F.col("s1_before") == F.col("s1")) & (F.col("s1") != "") & (F.col("start_ms") - F.col("before_ms") <= P.STUTTER_GAP), F.lit(False))
    w = _fillers(w.withColumn("opens", ~same).drop("s1", "s1_before"), fillers).drop("s2")
    # where the run of a word's equals began, and what stood before it; whether the run ends here
    head = lambda c: F.last(F.when(F.col("opens"), F.struct(F.col(c).alias("v"))), True).over(so_far)["v"]
    w = w.withColumns({"first": head("start_ms"), "first_before": head("before_ms"), "closes": F.coalesce(F.lead("opens").over(order), F.lit(True))})
    cut = lambda kind, start, end, least: F.when(end > start + least, F.struct(start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), F.lit(kind).alias("kind")))
    stutter = F.when(F.col("closes") & ~F.col("opens"), cut("stutter", F.greatest("first", F.col("first_before") + 1), F.col("start_ms"), P.STUTTER_LEAST))
    silence = F.when(F.col("next_ms") - F.col("end_ms") > P.SILENCE, cut("silence", F.col("end_ms") + P.SILENCE_MARGIN, F.col("next_ms") - P.SILENCE_MARGIN, P.SILENCE_LEAST))
    filler = F.when(F.col("size") > 0, cut("filler", *_filler(F.col("before_ms")), 0))
    return w.select("source_id", F.inline(F.array_compact(F.array(filler, stutter, silence))))


def timeline_stream(words: DataFrame, cuts: DataFrame, cell_ms: int | None = None) -> DataFrame:
    """Words and disjoint cuts (cs, ce) as one sorted stream for each source, instead of a join by range: of each word
    whether no cut overlaps it (kept) and, if so, how much is cut before it (gone): all cuts that begin before a kept word ends lie before it, so one order serves both. With cell_ms the stream is cut into slices of so much time, so that one very long source is many tasks' work; the
    stream is written first, as it is read several times."""
    rows = words.select("source_id", "pos", "text", "start_ms", "end_ms", F.lit(None).cast("long").alias("cs"), F.lit(None).cast("long").alias("ce")).unionByName(
        cuts.select("source_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("text"), "start_ms", "end_ms", F.col("start_ms").alias("cs"), F.col("end_ms").alias("ce"))
    )
    is_cut = F.col("cs").isNotNull()
    so_far = (Window.unboundedPreceding, 0)
    begin, length = F.when(is_cut, F.col("cs")).otherwise(F.col("end_ms")), F.col("ce") - F.col("cs")
    if cell_ms:
        seen = running(written(rows), ["source_id"], F.floor(begin / cell_ms), [begin, is_cut, "pos"], {"reach": ("max", F.col("ce")), "gone": ("sum", length)})
    else:
        by_begin = Window.partitionBy("source_id").orderBy(begin, is_cut, "pos").rowsBetween(*so_far)
        seen = rows.withColumns({"reach": F.max("ce").over(by_begin), "gone": F.sum(length).over(by_begin)})
    seen = seen.withColumn("gone", F.coalesce("gone", F.lit(0)))
    return seen.withColumn("kept", F.col("cs").isNull() & (F.col("reach").isNull() | (F.col("reach") <= F.col("start_ms"))))


def retime(words: DataFrame, cuts: DataFrame, cell_ms: int | None = None) -> DataFrame:
    """words without those that overlap a cut, moved left by all that is cut before. cuts: disjoint."""
    kept = timeline_stream(words, cuts, cell_ms).where("kept")
    return kept.select("source_id", "pos", "text", (F.col("start_ms") - F.col("gone")).cast("long").alias("start_ms"), (F.col("end_ms") - F.col("gone")).cast("long").alias("end_ms"))


def phrases(words: DataFrame) -> DataFrame:
    """Words together up to a gap or a number of words; sizes count anew after each gap."""
    opens = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(by_pos()) > P.PHRASE_GAP, F.lit(True))
    run = words.withColumn("opens", opens.cast("int")).withColumn("session", F.sum("opens").over(by_pos().rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("source_id", "session").orderBy("pos")
    part = run.withColumn("part", F.floor((F.row_number().over(within) - 1) / P.PHRASE_WORDS))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    made = part.groupBy("source_id", "session", "part").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), texts.alias("text"))
    return made.select("source_id", "first_pos", "n", "start_ms", "end_ms", "text")


def chunks(words: DataFrame, size: int) -> DataFrame:
    """Words in chunks of one size by place, whatever the gaps."""
    return words.groupBy("source_id", F.floor(F.col("pos") / size).alias("chunk")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n"))


SLICE_CELL = 60_000
SLICE_SEGMENTS = 4096


def slice_segments(words: DataFrame, segments: DataFrame) -> DataFrame:
    """segments: (source_id, seg_no, seg_start, seg_end), in the order they play. Words that lie in one, on the new timeline."""
    placed = running(segments, ["source_id"], F.expr(f"seg_no div {SLICE_SEGMENTS}"), ["seg_no"], {"offset": ("sum", F.col("seg_end") - F.col("seg_start"))}, inclusive=False).withColumn("offset", F.coalesce("offset", F.lit(0)))
    placed = placed.withColumn("cell", F.explode(F.expr(f"sequence(seg_start div {SLICE_CELL}, seg_end div {SLICE_CELL})")))
    # a word stands in the cell of its start, a segment in all that it meets: equal keys, and each pair meets once
    both = words.withColumn("cell", F.expr(f"start_ms div {SLICE_CELL}")).join(placed, ["source_id", "cell"]).where("start_ms >= seg_start and end_ms <= seg_end")
    moved = F.col("offset") - F.col("seg_start")
    return both.select("source_id", "seg_no", "pos", "text", (F.col("start_ms") + moved).cast("long").alias("start_ms"), (F.col("end_ms") + moved).cast("long").alias("end_ms"))


def snap(targets: DataFrame, words: DataFrame) -> DataFrame:
    """targets: (source_id, target, t_ms, after). The middle (in half milliseconds) of the word gap that suits each best:
    sentence ends before breaths before near gaps before far ones, then the nearest; else the nearest gap of all (null: there is none). Where a source has fewer than two words, targets stay where they are. Words and targets run along
    one sorted stream: of sentence ends, of breaths and of all gaps only the nearest on each side of a target can be its best."""
    base = 2 * P.SNAP_WINDOW
    next_ms = F.lead("start_ms").over(by_pos())
    w = words.withColumn("next_ms", F.when(next_ms > F.col("end_ms"), next_ms)).withColumn("mid2", F.col("end_ms") + F.col("next_ms"))
    size = F.col("next_ms") - F.col("end_ms")
    ends, breath = (size >= P.SNAP_SILENCE) & F.trim("text").rlike('[.!?]["”]?$'), size >= P.SNAP_BREATH
    kinds = {"ends": F.coalesce(ends, F.lit(False)), "breath": F.coalesce(breath, F.lit(False)), "gap": F.col("mid2").isNotNull()}
    spoken = w.select("source_id", F.coalesce("mid2", 2 * F.col("end_ms")).alias("at"), F.lit(False).alias("is_target"), "pos", "mid2", *(v.alias(k) for k, v in kinds.items()))
    asked = targets.select("source_id", (2 * F.col("t_ms")).alias("at"), F.lit(True).alias("is_target"), "target", "t_ms", "after")
    stream = spoken.unionByName(asked, allowMissingColumns=True)
    forth = Window.partitionBy("source_id").orderBy("at", "is_target", "pos", "target").rowsBetween(Window.unboundedPreceding, 0)
    stream = stream.withColumns({"k": F.count_if("is_target").over(forth), "n": F.count_if(~F.col("is_target")).over(forth)})
    stream = stream.withColumns({f"{c}_left": F.max(F.when(F.col(c), F.struct("mid2", (-F.col("pos")).alias("less")))).over(forth) for c in kinds})
    # behind a target only the first gap of each kind counts; of the words, whether there are two
    before = forth.rowsBetween(Window.unboundedPreceding, -1)
    stream = stream.withColumns({f"{c}_first": F.col(c) & ~F.coalesce(F.max(F.when(F.col(c), F.col("k"))).over(before) == F.col("k"), F.lit(False)) for c in kinds})
    few = stream.where("is_target or ends_first or breath_first or gap_first or n <= 2")
    # the nearest to the right by the order turned round: a frame that ends at the last row costs the square of its rows
    back = Window.partitionBy("source_id").orderBy(F.desc("at"), "is_target", F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    few = few.withColumns({f"{c}_right": F.min(F.when(F.col(c), F.struct("mid2", "pos"))).over(back) for c in kinds})
    few = few.withColumn("n_words", F.max("n").over(Window.partitionBy("source_id"))).where("is_target")
    found = []
    for side, pos in (("left", lambda g: -g["less"]), ("right", lambda g: g["pos"])):
        for c in kinds:
            g = F.col(f"{c}_{side}")
            d = F.abs(g["mid2"] - F.col("at"))
            wide = F.col("after") & (g["mid2"] >= F.col("at"))
            within = lambda a, b: d <= F.when(wide, base * a).otherwise(base * b)  # noqa: B023, E731
            tier = {"ends": F.when(within(3, 1), 0), "breath": F.when(within(3, 1), 1), "gap": F.when(within(5, 2.5), 2).when(within(8, 5), 3).otherwise(4)}[c]
            key = F.when(tier == 4, d).otherwise(d * F.when(wide, 7).when(F.col("after"), 13).otherwise(10))
            found.append(F.when(g.isNotNull() & tier.isNotNull(), F.struct(tier.alias("tier"), key.alias("key"), pos(g).alias("pos"), g["mid2"].alias("mid2"))))
    made = few.withColumn("b", F.least(*found))
    mid2 = F.when(F.col("n_words") < 2, F.col("at")).otherwise(F.col("b.mid2"))
    return made.select("source_id", "target", "t_ms", "after", mid2.alias("mid2"), F.when((F.col("n_words") >= 2) & (F.col("b.tier") < 4), F.col("b.tier")).alias("tier"))


def lexicon_hits(words: DataFrame, lexicon: Sequence[str], numbers: bool = False, mode: str = "every") -> DataFrame:
    """Words of a list (and money amounts); the first of each source only where mode is sparing."""
    bare = stem(F.col("text"), EDGES)
    hit = bare.isin(list(lexicon))
    if numbers:
        hit = hit | bare.contains("$") | bare.rlike(r"^\d+[km]?$")
    found = words.where(hit)
    if mode == "sparing":
        found = found.withColumn("k", F.row_number().over(by_pos())).where("k = 1").drop("k")
    return found


#: First words of phrases of so many bytes together are sent to all tasks; more are joined.
FIRSTS_BYTES = 8 << 20


def bare(text: Column) -> Column:
    """A word as phrases are compared: lower case, without .,!? around it."""
    return F.btrim(F.lower(text), F.lit(".,!?"))


def phrase_starts(words: DataFrame, phrases: DataFrame) -> tuple[DataFrame, list[int]]:
    """phrases: (phrase), of one word or more, single spaces between. words with ``next``, the bare words from each on, as many as the longest phrase has, and ``sizes``, the lengths of the phrases
    that begin with this word (null: none does); and all lengths. This is a trie's first level; its other levels are the few grams that ``next`` and ``sizes`` give."""
    parts = F.split("phrase", " ")
    firsts = phrases.where("phrase <> ''").groupBy(F.get(parts, F.lit(0)).alias("__first")).agg(F.collect_set(F.size(parts)).alias("sizes"))
    size, lengths = firsts.agg(F.sum(F.octet_length("__first") + 8 * F.size("sizes")), F.array_sort(F.array_distinct(F.flatten(F.collect_set("sizes"))))).first()
    longest = max(lengths, default=1)
    ahead = F.collect_list("__bare").over(by_pos().rowsBetween(0, longest - 1)) if longest > 1 else F.array("__bare")
    seen = words.withColumn("__bare", bare(F.col("text"))).withColumn("next", ahead)
    return seen.join(F.broadcast(firsts) if (size or 0) <= FIRSTS_BYTES else firsts, F.col("__bare") == F.col("__first"), "left").drop("__bare", "__first"), lengths


def phrase_hits(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrases: (phrase_id, phrase), a table of any size, phrases of any length. How often and where first each stands in each source: grams, counted by source before they
    are shuffled, meet phrases by equality."""
    starts, _ = phrase_starts(words, phrases)
    grams = starts.where("sizes is not null").select("source_id", "start_ms", "next", F.explode("sizes").alias("__n")).where("__n <= size(next)")
    counted = grams.groupBy("source_id", F.array_join(F.slice("next", F.lit(1), F.col("__n")), " ").alias("phrase")).agg(F.count(F.lit(1)).alias("n"), F.min("start_ms").alias("first_ms"))
    return counted.join(phrases.select("phrase_id", "phrase").distinct(), "phrase").groupBy("source_id", "phrase_id").agg(F.sum("n").alias("n"), F.min("first_ms").alias("first_ms"))
