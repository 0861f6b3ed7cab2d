"""Readers of word lists, clip lists, settings and logs, and their writers."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "text string, word string, start double, end double"
CLIP = (
    "rank int, start double, end double, hook_start double, hook_end double, hook_text string, viral_score int, reasoning string, segments array<array<double>>, slug string, "
    "instagram_caption string, callouts array<struct<local_start:double,duration:double,text:string,accent:array<string>,eyebrow:string,color:string>>, "
    "hook struct<overline:string,text:string,accent:array<string>,color:string,duration:double>"
)


def ms(seconds: Column) -> Column:
    return F.floor(seconds * 1000 + 0.5).cast("long")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of words a file: (source, pos, text, start_ms, end_ms). A word's text may be named text or word."""
    read = spark.read.schema("value string").text(path, wholetext=True).select(F.input_file_name().alias("source"), F.from_json("value", f"array<struct<{_fields(WORD)}>>").alias("w"))
    each = read.select("source", F.posexplode("w").alias("pos", "x"))
    return each.select("source", F.col("pos").cast("long").alias("pos"), F.coalesce(F.nullif("x.text", F.lit("")), "x.word").alias("text"), ms(F.col("x.start")).alias("start_ms"), ms(F.col("x.end")).alias("end_ms"))


def _fields(ddl: str) -> str:
    """name type, ... at the top level to name:type, ..."""
    out, depth = [], 0
    for c in ddl.replace(", ", ","):
        depth += (c == "<") - (c == ">")
        out.append(c)
    fields, start, depth, text = [], 0, 0, "".join(out)
    for k, c in enumerate(text + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = text[start:k].split(" ", 1)
            fields.append(f"`{name}`:{kind}")
            start = k + 1
    return ",".join(fields)


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLIP).json(path, multiLine=True).withColumn("source", F.input_file_name())


def read_settings(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """KEY=VALUE lines, comments and blank ones skipped; keys in known (key) are set already and stay out."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#') and contains(v, '=')")
    pairs = lines.select(F.trim(F.substring_index("v", "=", 1)).alias("key"), F.btrim(F.trim(F.expr("substring(v, instr(v, '=') + 1)")), F.lit("\"'")).alias("value"))
    return pairs.join(known.select("key"), "key", "left_anti")


def merge_settings(old: DataFrame, new: DataFrame) -> DataFrame:
    """old: (line_no, line); new: (key, value). Lines in their order, values of known keys replaced, unknown lines kept, new keys at the end."""
    keyed = old.withColumn("key", F.when(F.col("line").contains("=") & ~F.ltrim("line").startswith("#"), F.trim(F.substring_index("line", "=", 1))))
    both = keyed.join(new, "key", "full_outer")
    line = F.when(F.col("value").isNull(), F.col("line")).otherwise(F.concat("key", F.lit("="), "value"))
    return both.select("line_no", "key", line.alias("line")).orderBy(F.col("line_no").asc_nulls_last(), "key").select("line")


def read_ok(spark: SparkSession, path: str) -> DataFrame:
    """Inputs that a worker's JSON lines log as done; other lines are skipped."""
    return spark.read.text(path).select(F.from_json("value", "struct<event:string,`in`:string>").alias("x")).where("x.event = 'ok'").select(F.col("x.in").alias("input")).distinct()


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, bytes, modified, location) of files below root; their contents aren't read. location: pack, for what lies in root's folder of that name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    bare = lambda x: F.regexp_replace(x, "^[a-z0-9]+:/+", "/")
    inside = F.startswith(bare(F.col("path")), bare(F.lit(f"{root.rstrip('/')}/pack/")))
    return found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.when(inside, "pack").otherwise("library").alias("location"))


def list_roots(spark: SparkSession, roots: Sequence[str], pattern: str) -> DataFrame:
    """The files below several roots, each once."""
    return functools.reduce(DataFrame.union, (list_files(spark, r, pattern) for r in roots)).dropDuplicates(["path"])


def read_slides(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(source, slide, kind, start, end) out of JSON files of slides. A file that isn't a list has none, or is an error if strict; a slide whose
    times aren't numbers has null ones."""
    text = F.trim("value")
    files = spark.read.schema("value string").text(path, wholetext=True).select(F.input_file_name().alias("source"), text.alias("t"))
    slides = F.from_json("t", "array<struct<type:string,start:string,end:string>>")
    listed = F.startswith("t", F.lit("[")) & slides.isNotNull()
    checked = F.when(listed, slides).otherwise(F.raise_error(F.concat(F.lit("not a list of slides: "), "source")) if strict else F.lit(None))
    each = files.select("source", F.posexplode(checked).alias("slide", "x"))
    return each.select("source", "slide", F.col("x.type").alias("kind"), F.col("x.start").try_cast("double").alias("start"), F.col("x.end").try_cast("double").alias("end"))


PROGRESS = "work string, step string, op string, at long"


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(work, steps: sorted array) by a log of steps done and of works reset: a step counts if it was done after the work's last reset. A log that isn't there yet has none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "work string, steps array<string>")
    log = spark.read.schema(PROGRESS).parquet(path)
    last = log.where("op = 'reset'").groupBy("work").agg(F.max("at").alias("since"))
    done = log.where("op = 'done'").join(last, "work", "left").where("since is null or at > since")
    return done.groupBy("work").agg(F.sort_array(F.collect_set("step")).alias("steps"))


def mark_done(steps: DataFrame, path: str, at: int) -> None:
    """steps: (work, step). Those not done yet are appended to the log; marking one again adds nothing."""
    spark = steps.sparkSession
    known = progress(spark, path).select("work", F.explode("steps").alias("step"))
    new = steps.select("work", "step").distinct().join(known, ["work", "step"], "left_anti")
    new.select("work", "step", F.lit("done").alias("op"), F.lit(at).cast("long").alias("at")).write.mode("append").parquet(path)


def reset(works: DataFrame, path: str, at: int) -> None:
    """works: (work). Their steps up to now count no more; the log only grows."""
    works.select("work", F.lit(None).cast("string").alias("step"), F.lit("reset").alias("op"), F.lit(at).cast("long").alias("at")).distinct().write.mode("append").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_missing(df: DataFrame, key: str, path: str) -> None:
    """Only rows whose key the table at path hasn't yet; made if it isn't there."""
    spark = df.sparkSession
    if _exists(spark, path):
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    df.write.mode("append").parquet(path)


def write_lines(lines: DataFrame, path: str, parts: int | None = None) -> None:
    """lines: (line_no, line), as operators.reports gives them. A folder of text files that, one after another by name, are the text: dealt by ranges of line numbers, so no task has all of it."""
    dealt = lines.select("line_no", "line")
    dealt = dealt.repartitionByRange(parts, "line_no") if parts else dealt.repartitionByRange("line_no")
    dealt.sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


def write_files(files: DataFrame, root: str) -> None:
    """files: (path, content), a path once. Each is a partition of a table of texts below root, its content to the letter; a path's slashes are escaped in the folder's name. read_files has them back."""
    files.select(F.col("content").alias("value"), "path").write.mode("overwrite").partitionBy("path").option("lineSep", "\x00").text(root)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of what write_files wrote."""
    read = spark.read.schema("value string, path string").text(root, wholetext=True)
    return read.select("path", F.left("value", F.length("value") - 1).alias("content"))
