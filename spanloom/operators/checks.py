"""Settings' problems and status tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENGINES = ("neural", "classic", "none")


def holding(conditions: Mapping[str, Column]) -> Column:
    """Array of the names whose condition holds, in their order; a null condition doesn't."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in conditions.items())))


def problems(settings: DataFrame, engines: Sequence[str] = ENGINES) -> DataFrame:
    """settings: (picker, enhancer, has_key, has_kit, has_template, has_enhancer, enhance, step, ...), step the first step still to run. Beside its columns: ``problems``, those of ``problems`` that
    the steps still to run have to do with as ``relevant``, and as ``fallbacks`` the enhancing engines but the chosen one. A flag that is null is not there; a null step is the first."""
    missing = lambda name: ~F.coalesce(name, F.lit(False))
    step, neural = F.coalesce("step", F.lit(0)), F.col("enhancer") == "neural"
    every = holding({"key": (F.col("picker") == "hosted") & missing("has_key"), "kit": missing("has_kit"), "template": missing("has_template"), "enhancer": neural & missing("has_enhancer")})
    needed = holding({"key": step <= 2, "kit": step <= 8, "template": step <= 8, "enhancer": F.col("enhance") & (step <= 5) & neural})
    others = F.filter(F.array(*map(F.lit, engines)), lambda x: ~x.eqNullSafe(F.col("enhancer")))
    return settings.withColumns({"problems": every, "relevant": F.array_intersect(every, needed), "fallbacks": others})


def status(settings: DataFrame, key: str, sounds: Column) -> DataFrame:
    """(key, name, status), a row a check of settings as problems() takes them: OK, FAIL for what is needed and not there, WARN for what can be done without. sounds: whether there is a pack of sounds."""
    has = lambda name: F.coalesce(name, F.lit(False))
    needed = lambda c: F.when(c, "FAIL").otherwise("WARN")
    found = {
        "enhancer": F.when(has("has_enhancer"), "OK").otherwise(needed(F.col("enhancer") == "neural")),
        "kit": F.when(has("has_kit"), "OK").otherwise("FAIL"),
        "template": F.when(has("has_template"), "OK").otherwise("WARN"),
        "sounds": F.when(sounds, "OK").otherwise("WARN"),
        "picker": F.when(F.col("picker") == "hosted", F.when(has("has_key"), "OK").otherwise("FAIL")).otherwise("WARN"),
    }
    return settings.select(key, F.inline(F.array(*(F.struct(F.lit(name).alias("name"), s.alias("status")) for name, s in found.items()))))


def summary(rows: DataFrame, key: str) -> DataFrame:
    """(key, rows, n_fail, exit_code) of rows as status() gives them: a line of name=status by name, the failures, and 1 if there are any."""
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "status"))), lambda x: F.concat_ws("=", x["name"], x["status"])), " ")  # as many as there are checks
    fails = F.count_if(F.col("status") == "FAIL")
    return rows.groupBy(key).agg(line.alias("rows"), fails.alias("n_fail")).withColumn("exit_code", F.when(F.col("n_fail") > 0, 1).otherwise(0))
