"""Batches of work: replayed ones add nothing."""

import glob
import json
import os

from pyspark.sql import functions as F

from spanloom.streaming import work

SCHEMA = "name string, changed long, size long"
OUT = "name string, changed long, kind string"


def test_each_version_once(spark, tmp_path):
    src, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    os.makedirs(src)

    def put(file, *rows):
        with open(f"{src}/{file}.json", "w", encoding="utf-8") as f:
            f.writelines(json.dumps(dict(zip(("name", "changed", "size"), r, strict=True))) + "\n" for r in rows)

    def run():
        stream = spark.readStream.schema(SCHEMA).json(src)
        made = lambda batch: batch.select("name", "changed", F.when(F.col("size") > 10, "long").otherwise("short").alias("kind"))
        query = work.process_new(stream, ["name", "changed"], made, out, check)
        query.awaitTermination(60)
        assert query.exception() is None
        return sorted((x.name, x.changed, x.kind) for x in work.results(spark, out, OUT).collect())

    put("1", ("a", 1, 5), ("b", 1, 50), ("a", 1, 5))
    first = run()
    assert first == [("a", 1, "short"), ("b", 1, "long")]
    put("2", ("a", 1, 5), ("c", 2, 50), ("b", 3, 1))
    second = run()
    assert second == sorted([*first, ("b", 3, "short"), ("c", 2, "long")])
    assert run() == second  # nothing new
    done = work.results(spark, out, OUT)
    assert sorted((x.name, x.kind) for x in work.latest(done, "name", "changed").collect()) == [("a", "short"), ("b", "short"), ("c", "long")]
    # the last batch's commit is lost, as if the driver had died after its write: it runs again under its number
    commits = sorted((p for p in glob.glob(f"{check}/commits/*") if os.path.basename(p).isdigit()), key=lambda p: int(os.path.basename(p)))
    before = {x.batch_id for x in done.collect()}
    os.remove(commits[-1])
    for crc in glob.glob(f"{check}/commits/.{os.path.basename(commits[-1])}.crc"):
        os.remove(crc)
    assert run() == second and {x.batch_id for x in work.results(spark, out, OUT).collect()} == before


def test_marks(spark):
    done = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2), ("c", 4)], "name string, at long")
    resets = spark.createDataFrame([("a", 3), ("b", 2), ("d", 9)], "name string, at long")
    assert sorted(map(tuple, work.marks(done, resets, "name", "at").collect())) == [("a", 5), ("c", 4)]
