import json

import pytest

from spanloom.sources import records
from spanloom.streaming.sessions import sessions


def test_words_and_clips(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps([{"text": "a", "start": 0.0, "end": 0.5}, {"word": "b", "start": 0.5, "end": 1.0005}, {"text": "", "word": "c", "start": 1, "end": 2}]))
    got = records.read_words(spark, str(tmp_path / "w.json")).orderBy("pos").collect()
    assert [(x.text, x.start_ms, x.end_ms) for x in got] == [("a", 0, 500), ("b", 500, 1001), ("c", 1000, 2000)]
    (tmp_path / "c.json").write_text(json.dumps([{"rank": 2, "start": 1.5, "segments": [[1, 2], [3, 4]], "hook": {"text": "x"}}, {"rank": 1}]))
    assert [x.rank for x in records.read_clips(spark, str(tmp_path / "c.json")).orderBy("rank").collect()] == [1, 2]


def test_settings(spark, tmp_path):
    (tmp_path / "env").write_text("# note\nA=1\n\nB = 'two'\nC=x=y\n")
    known = spark.createDataFrame([("A",)], "key string")
    assert sorted(tuple(x) for x in records.read_settings(spark, str(tmp_path / "env"), known).collect()) == [("B", "two"), ("C", "x=y")]
    old = spark.createDataFrame([(0, "# note"), (1, "A=1"), (2, "Z=9")], "line_no int, line string")
    new = spark.createDataFrame([("A", "5"), ("N", "7")], "key string, value string")
    assert [x.line for x in records.merge_settings(old, new).collect()] == ["# note", "A=5", "Z=9", "N=7"]


def test_logs_files_and_sinks(spark, tmp_path):
    (tmp_path / "log").write_text('{"event": "ok", "in": "a"}\nnoise\n{"event": "fail", "in": "b"}\n{"event": "ok", "in": "a"}\n')
    assert [x.input for x in records.read_ok(spark, str(tmp_path / "log")).collect()] == ["a"]
    (tmp_path / "pack").mkdir()
    (tmp_path / "pack/x.wav").write_bytes(b"12")
    (tmp_path / "y.wav").write_bytes(b"123")
    assert sorted((x.bytes, x.location) for x in records.list_files(spark, str(tmp_path), "*.wav").collect()) == [(2, "pack"), (3, "library")]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    to = str(tmp_path / "out")
    records.write_missing(df.where("k = 1"), "k", to)
    records.write_missing(df, "k", to)
    assert spark.read.parquet(to).count() == 2
    records.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_files_of_several_roots(spark, tmp_path):
    for name in ("lib/pack/a.wav", "lib/sub/pack/b.wav", "lib/c.wav", "more/d.wav"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    got = sorted((x.path.rsplit("/", 1)[1], x.location) for x in records.list_files(spark, str(tmp_path / "lib"), "*.wav").collect())
    assert got == [("a.wav", "pack"), ("b.wav", "library"), ("c.wav", "library")]
    roots = [str(tmp_path / r) for r in ("lib", "lib", "more")]
    assert records.list_roots(spark, roots, "*.wav").count() == 4


def test_slides_of_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"type": "logo", "start": 1.5, "end": "3"}, {"type": "stat", "start": "soon"}]')
    (tmp_path / "b.json").write_text('{"type": "logo", "start": 1, "end": 2}')
    got = [(x.slide, x.kind, x.start, x.end) for x in records.read_slides(spark, str(tmp_path)).orderBy("slide").collect()]
    assert got == [(0, "logo", 1.5, 3.0), (1, "stat", None, None)]
    with pytest.raises(Exception, match="not a list of slides"):
        records.read_slides(spark, str(tmp_path), strict=True).collect()


def test_progress(spark, tmp_path):
    log = str(tmp_path / "log")
    steps = lambda *x: spark.createDataFrame(x, "work string, step string")
    done = lambda: {x.work: x.steps for x in records.progress(spark, log).collect()}
    assert done() == {}
    records.mark_done(steps(("a", "1"), ("a", "2"), ("b", "1"), ("a", "1")), log, 1)
    records.mark_done(steps(("a", "2"), ("b", "2")), log, 2)
    assert done() == {"a": ["1", "2"], "b": ["1", "2"]} and spark.read.parquet(log).count() == 4
    records.reset(spark.createDataFrame([("a",)], "work string"), log, 3)
    assert done() == {"b": ["1", "2"]}
    records.mark_done(steps(("a", "1"), ("b", "1")), log, 4)
    assert done() == {"a": ["1"], "b": ["1", "2"]} and spark.read.parquet(log).count() == 6


def test_stream_of_sessions(spark, tmp_path):
    events = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 05:00:00"), (1, "2024-01-02 00:00:00"), (9, "2024-03-01 00:00:00")]
    df = spark.createDataFrame(events, "user_id long, ts string").selectExpr("user_id", "cast(ts as timestamp) as ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = sessions(stream, "12 hours", "1 day").writeStream.format("memory").queryName("made").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = sorted((x.user_id, x.n) for x in spark.table("made").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]  # the last one is still open
    assert sorted((x.user_id, x.n) for x in sessions(df, "12 hours").collect()) == [*got, (9, 1)]
