"""Quality rules with risk-controlled cutoffs. DataFrame functions only.

Rules: four ratios of a text, each of which rejects above a cutoff. Strata: languages. For each rule
and stratum the cutoffs of a fixed grid are tested from the mildest to the strictest (fixed-sequence
testing) on the labelled good documents of that stratum. The null hypothesis of a test is "this rule
with this cutoff rejects a good document with probability above RISK / number of rules"; its p-value
is the exact binomial tail P(Bin(n, that) <= documents rejected). A cutoff is certified while
all tests up to it have p <= ERROR / (rules x strata) (Bonferroni over sequences), and of those
the one is used that rejects most bad documents, less COST times the good ones (ties: the mildest); a stratum
without one gets no cutoff and rejects nothing. All certified cutoffs hold together, so with
probability 1 - ERROR at least the rules reject at most RISK of the good documents of every stratum.

All labelled documents are the holdout: the grid is fixed beforehand, so nothing is fitted to other rows.
A doc_id with several labels counts as good only if all say so; null ids and null qualities aren't
labels. Null texts have no words, so the base rule rejects them. A null lang is a stratum of its own.
Repeated rows are judged alike. Very long texts: whole. Other columns, whatever their names, aren't read; keep_good passes them on. Ties
between cutoffs: the mildest. Empty tables: an empty result, or no cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import stash

RISK = 0.04
ERROR = 0.05
COST = 3
#: Of each rule: its value in whole thousandths, so that no engine rounds otherwise; and its grid of
#: cutoffs in thousandths: the mildest, the strictest, the step.
RULES = {
    "symbols": ("(1000 * n_symbols) div word_chars", (500, 20, 20)),
    "dup_lines": ("(1000 * n_dup_lines) div n_lines", (950, 50, 50)),
    "repeats": ("(1000 * n_repeat_words) div n_words", (500, 50, 50)),
    "capitals": ("(1000 * n_capitals) div word_chars", (950, 50, 50)),
}
BLANK = " \t\n\x0b\f\r"


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANK))) > 0)


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more. Windows are told apart by a 64-bit hash
    chained over their words; equal ones are neighbours after a sort, and their places, sorted again, give the union."""
    n = F.size(words)
    windows = F.when(n >= 4, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("i")))).otherwise(F.expr("array()"))
    return F.sort_array(windows)


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns named and: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    and n_lines (with a word) and n_capitals for the rules."""
    text = F.coalesce("text", F.lit(""))
    step = docs.select(
        *keep,
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("__w"),
        F.length(F.translate(text, BLANK, "")).alias("__chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).alias("__symbols"),
        _lines_with_words(text).alias("__lines"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-ZÀ-ÖØ-Þ]", ""))).alias("__capitals"),
    )
    step = step.withColumn("__s", _repeated(F.col("__w")))
    same = F.filter("__s", lambda x, k: (x["h"] == F.try_element_at("__s", k + 2)["h"]) | (F.when(k > 0, F.try_element_at("__s", k)["h"]) == x["h"]))
    step = step.withColumn("__at", F.sort_array(F.transform(same, lambda x: x["i"])))
    covered = F.aggregate("__at", F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    made = {
        "n_words": F.size("__w"),
        "word_chars": F.col("__chars"),
        "n_symbols": F.col("__symbols"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_lines": F.size("__lines"),
        "n_repeat_words": covered,
        "n_capitals": F.col("__capitals"),
    }
    # a generator of one row: a filter on its columns can't be pushed below it, where each use would compute the words anew
    made = step.select(*keep, F.inline_outer(F.array(F.struct(*(x.cast("long").alias(name) for name, x in made.items())))))
    return made.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def _value(rule: str) -> Column:
    over, under = RULES[rule][0].split(" div ")
    return F.expr(f"case when {under} > 0 then {over} div {under} else 0 end")


def _ln_gamma(x: Column) -> Column:
    """Stirling's series, eight steps up, where its error is below 1e-11."""
    y = x + 8
    series = (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return series - F.ln(product)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k); 1 where k is not below n p. From k downwards the terms shrink; they are added as far as
    ten standard deviations and 60 go, beyond which nothing is left that a double could hold."""
    x, y = n.cast("double"), k.cast("double")
    log_term = _ln_gamma(x + 1) - _ln_gamma(y + 1) - _ln_gamma(x - y + 1) + y * F.log(F.lit(p)) + (x - y) * F.log1p(F.lit(-p))
    many = F.least(k.cast("long"), (60 + 10 * F.sqrt(x * p)).cast("long"))
    down = F.when(many >= 1, F.sequence(F.lit(0).cast("long"), many - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(a: Column, j: Column) -> Column:
        term = a["term"] * ((y - j) / (x - y + j + 1) * ((1 - p) / p))
        return F.struct((a["sum"] + term).alias("sum"), term.alias("term"))

    return F.when(y >= x * p, F.lit(1.0)).otherwise(F.exp(log_term) * F.aggregate(down, start, add, lambda a: a["sum"]))


def cutoffs(marked: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """marked: features with doc_id and stratum. (stratum, and for each rule its cutoff or null)."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = marked.where("not base_failed").select("doc_id", "stratum", *(_value(r).alias(r) for r in RULES)).join(good, "doc_id")
    values = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES)))
    bins = labelled.select("stratum", "quality", values.alias("x")).groupBy("stratum", "x.rule", "x.value").agg(F.count_if(F.col("quality") >= 1).alias("good"), F.count_if(F.col("quality") < 1).alias("bad"))
    bins = stash(bins.groupBy("stratum", "rule").agg(F.collect_list(F.struct("value", "good", "bad")).alias("bins"), F.sum("good").alias("n")))
    level = error / max(1, bins.count())
    grid = F.expr("case rule " + " ".join(f"when '{r}' then sequence({a}, {b}, -{s})" for r, (_, (a, b, s)) in RULES.items()) + " end")
    over = lambda c, what: F.aggregate("bins", F.lit(0).cast("long"), lambda a, x: a + F.when(x["value"] > c, x[what]).otherwise(0))
    tried = bins.select("stratum", "rule", "n", F.posexplode(F.transform(grid, lambda c: F.struct(c.alias("cutoff"), over(c, "good").alias("good"), over(c, "bad").alias("bad")))).alias("k", "t")).select("stratum", "rule", "k", "n", "t.*")
    tried = tried.withColumn("p", binomial_tail(F.col("n"), F.col("good"), risk / len(RULES)))
    so_far = Window.partitionBy("stratum", "rule").orderBy("k")
    certified = tried.withColumn("worst", F.max("p").over(so_far)).where(F.col("worst") <= level)
    best = certified.groupBy("stratum", "rule").agg(F.max(F.struct((F.col("bad") - COST * F.col("good")).alias("gain"), "cutoff")).alias("b"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("b.cutoff"))).alias(f"cut_{r}") for r in RULES))


def _stratum(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def judged(marked: DataFrame, found: DataFrame) -> DataFrame:
    """marked with kept. The cutoffs, one row a stratum, are broadcast up to 10,000 strata."""
    found = stash(found)
    found = F.broadcast(found) if found.count() <= 10_000 else found
    beyond = [F.coalesce(_value(r) > F.col(f"cut_{r}"), F.lit(False)) for r in RULES]
    rejected = beyond[0]
    for b in beyond[1:]:
        rejected = rejected | b
    return marked.join(found, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected)


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    named = docs.select("doc_id", "text", _stratum(F.col("lang")).alias("stratum"))
    marked = stash(features(named, "doc_id", "stratum"))
    return judged(marked, cutoffs(marked, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the base rule and the certified cutoffs keep. Features are computed once and written beside their rows."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text", _stratum(F.col("lang")).alias("stratum"))
    marked = stash(features(rows, "__row", "stratum"))
    return judged(marked, cutoffs(marked.withColumn("doc_id", F.col("__row.doc_id")), labels)).where("kept").select("__row.*")
