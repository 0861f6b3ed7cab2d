"""Operators on tables of one's own: checks, folders, pictures, faces, effects."""

import math
import random

from pyspark.sql import functions as F

from spanloom.operators import checks, effects, folders, render

SETTINGS = "k long, picker string, enhancer string, has_key boolean, has_kit boolean, has_template boolean, has_enhancer boolean, enhance boolean, step int"


def test_problems(spark):
    rows = [
        (1, "hosted", "neural", False, False, False, False, True, 1),
        (2, "hosted", "neural", False, False, False, False, False, 6),
        (3, "local", "classic", False, True, True, False, True, 1),
        (4, "hosted", None, None, None, True, None, True, None),
        (5, "hosted", "neural", False, False, False, False, True, 9),
    ]
    got = {x.k: (x.problems, x.relevant, x.fallbacks) for x in checks.problems(spark.createDataFrame(rows, SETTINGS)).collect()}
    every = ["key", "kit", "template", "enhancer"]
    assert got[1] == (every, every, ["classic", "none"])
    assert got[2] == (every, ["kit", "template"], ["classic", "none"])
    assert got[3] == ([], [], ["neural", "none"])
    assert got[4] == (["key", "kit"], ["key", "kit"], ["neural", "classic", "none"])
    assert got[5] == (every, [], ["classic", "none"])


def test_status(spark):
    rows = [(1, "hosted", "neural", False, False, False, False, True, 1), (2, "local", "classic", None, True, None, None, True, 1)]
    got = {x.k: (x.rows, x.n_fail, x.exit_code) for x in checks.summary(checks.status(spark.createDataFrame(rows, SETTINGS), "k", F.col("k") == 2), "k").collect()}
    assert got == {1: ("enhancer=FAIL kit=FAIL picker=FAIL sounds=WARN template=WARN", 3, 1), 2: ("enhancer=WARN kit=OK picker=WARN sounds=OK template=WARN", 0, 0)}


def test_video_of(spark):
    videos = spark.createDataFrame([(7, "Big Talk!"), (3, "big  talk"), (5, None), (9, "Łódź")], "id long, title string")
    dirs = spark.createDataFrame([("big-talk", 1), ("lodz", 2), ("none", 3), (None, 4)], "dir string, n int")
    got = folders.video_of(dirs, "dir", videos, F.col("title"), "id").orderBy("n").collect()
    assert [x.id for x in got] == [3, 9, None, None]


def test_clip_of(spark):
    clips = spark.createDataFrame([(1, "a", 5.0), (1, "b", 9.0), (1, "c", 5.0), (2, "d", 1.0)], "src long, name string, score double")
    dirs = spark.createDataFrame([(1, "short-01-x"), (1, "short-3-y"), (1, "short-04-z"), (1, "notes"), (2, "short-01-"), (2, "xshort-01-a"), (None, "short-01-q"), (1, None)], "src long, dir string")
    got = {(x.src, x.dir): x.clip and x.clip.name for x in folders.clip_of(dirs, "src", "dir", clips, (F.desc("score"), F.asc("name"))).collect()}
    assert got == {(1, "short-01-x"): "b", (1, "short-3-y"): "c", (1, "short-04-z"): None, (1, "notes"): None, (2, "short-01-"): "d", (2, "xshort-01-a"): None, (None, "short-01-q"): None, (1, None): None}


def test_pack_files(spark):
    rows = "pack string, slot string, file string"
    listed = spark.createDataFrame([("p", "ding", "a"), ("p", "ding", "b"), ("p", "swipe", "gone"), ("q", "ding", "gone"), ("p", "ding", "a")], rows)
    there = spark.createDataFrame([("a",), ("b",), ("a",)], "file string")
    named = spark.createDataFrame([("p", "swipe", "swipe.wav", 0), ("q", "ding", "ding.ogg", 2), ("q", "ding", "ding.mp3", 1), ("r", "ding", "ding.wav", 0)], rows + ", kind int")
    got = sorted(tuple(x) for x in folders.pack_files(listed, there, named).collect())
    assert got == [("p", "ding", "a"), ("p", "ding", "a"), ("p", "ding", "b"), ("q", "ding", "ding.mp3"), ("r", "ding", "ding.wav")]


def test_usable(spark):
    pool = lambda *rows: spark.createDataFrame(list(rows), "k long, url string, place long, w int")
    first = pool((1, "small", 0, 10), (1, "x", 5, 900), (2, "small", 1, 1))
    second = pool((1, "y", 0, 900), (1, "x", 1, 900), (2, "z", 9, 700), (3, "no", 1, 599))
    got = sorted(tuple(x) for x in folders.usable([first, second], "k", "url", "place", F.col("w") >= 600).collect())
    assert got == [(1, "x", 2), (2, "z", 1)]


def test_with_pictures(spark):
    slides = spark.createDataFrame([(1, "logo", "B", "N"), (2, "logo", None, "N"), (3, "person", None, None), (4, "text", None, None), (5, "person", "gone", "N"), (6, None, "B", None)], "k long, type string, key string, name string")
    pictures = spark.createDataFrame([("B", "b.png"), ("N", "n.png")], "wanted string, src string")
    got = {x.k: x.src for x in render.with_pictures(slides, pictures).collect()}
    assert got == {1: "b.png", 2: "n.png", 4: None, 6: None}


def test_slide_color(spark):
    d = spark.createDataFrame([("stat", None), ("list", None), ("logo", None), ("stat", "#own"), (None, None)], "type string, color string")
    colors = F.struct(F.lit("a").alias("accent"), F.lit("s").alias("secondary"), F.lit("p").alias("primary"))
    assert [x[0] for x in d.select(render.slide_color(F.col("type"), F.col("color"), colors)).collect()] == ["a", "s", "p", "#own", "p"]


def test_best_faces(spark):
    rows = [(1, 0, 0.9, 10.0, 20.0, 4.0, 8.0, 1), (1, 0, 0.9, 30.0, 20.0, 4.0, 8.0, 2), (1, 1, 1.0, 0.0, 0.0, 1.0, 1.0, 3), (1, 5, 0.59, 0.0, 0.0, 1.0, 1.0, 4), (1, 10, 0.6, 0.0, 2.0, 2.0, 2.0, 5)]
    d = spark.createDataFrame(rows, "clip long, frame int, score double, x double, y double, w double, h double, id long")
    got = sorted(tuple(x) for x in effects.best_faces(d, ["clip"], ["id"]).collect())
    assert got == [(1, 0, 12.0, 24.0, 8.0, 0.9), (1, 10, 1.0, 3.0, 2.0, 0.6)]


def test_best_faces_alike(spark):
    """Detections alike in score and tie: the least box, in whatever order they come."""
    rows = [(1, 0, 0.9, x, y, 2.0, h, 7) for x, y, h in ((30.0, 1.0, 2.0), (10.0, 5.0, 2.0), (10.0, 4.0, 8.0), (10.0, 4.0, 6.0), (20.0, 0.0, 2.0))]
    for some in (rows, rows[::-1]):
        d = spark.createDataFrame(some, "clip long, frame int, score double, x double, y double, w double, h double, id long").coalesce(1)
        assert [tuple(x) for x in effects.best_faces(d, ["clip"], ["id"]).collect()] == [(1, 0, 11.0, 7.0, 6.0, 0.9)]


def test_effects_at_times_by_brute_force(spark):
    r = random.Random(2)
    rows = [(r.randrange(3), r.randrange(-300, 5000), r.choice([90, 220, 280]), r.choice([0.25, 1.0]), r.random() < 0.5) for _ in range(120)]
    times = [(k, t) for k in range(4) for t in range(-500, 6000, 170)]
    e = spark.createDataFrame(rows, "k long, start_ms long, len long, strength double, fades boolean")
    got = {(x.k, x.t): (x.scale, x.opacity) for x in effects.at_times(e, spark.createDataFrame(times, "k long, t long"), "k", 200, 280).collect()}
    assert len(got) == len(times)
    for k, t in times:
        mine = [(t - a, n, s, f) for key, a, n, s, f in rows if key == k]
        bump = max((math.sin(math.pi * x / n) * 0.04 * s for x, n, s, f in mine if 0 <= x <= n), default=0)
        fade = min(((-x if x < 0 else x - n if x > n else 0) / 200 for x, n, s, f in mine if f and -200 < x < n + 200), default=1)
        assert abs(got[k, t][0] - 1 - bump) < 1e-9 and abs(got[k, t][1] - fade) < 1e-9


def test_motion(spark):
    d = spark.createDataFrame([(k, x) for k in ("in", "out", "left", "right", "up", "down", None) for x in (0.0, 0.25, 1.0)], "m string, p double")
    for x in d.select("m", "p", effects.zoom(F.col("p"), F.col("m")).alias("z"), effects.shift(F.col("p"), F.col("m")).alias("s")).collect():
        way = -4 + 8 * x.p
        assert abs(x.z - (1.18 - 0.18 * x.p if x.m == "out" else 1 + 0.18 * x.p)) < 1e-12
        assert tuple(x.s) == {"left": (-way, 0), "right": (way, 0), "up": (0, -way), "down": (0, way)}.get(x.m, (0, 0))
