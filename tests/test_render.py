"""Render records: slides that stand, the captions' band, colours, whole records."""

import json
import random

from pyspark.sql import functions as F

from spanloom.operators import render

SLIDES = "source_id long, place long, type string, start string, end string"
SPANS = "source_id long, start_ms long, end_ms long"


def test_timed_drops_bad_values(spark):
    rows = [(1, 0, "text", "1.5", "3"), (1, 1, "text", None, "3"), (1, 2, "text", "x", "3"), (1, 3, "text", "NaN", "3"), (1, 4, "text", "1", "Infinity"), (1, 5, "text", "", "3"), (1, 6, "text", " 2 ", "1e1")]
    got = render.timed(spark.createDataFrame(rows, SLIDES)).orderBy("place").collect()
    assert [(x.place, x.start_ms, x.end_ms) for x in got] == [(0, 1500, 3000), (6, 2000, 10000)]


def fit(a, b, gaps):
    """The first gap with the middle, else the start, else the end; the span held to it."""
    for point in ((a + b) / 2, a, b):
        for ga, gb in gaps:
            if ga <= point <= gb:
                size = min(max(b - a, 2000), 4500, gb - ga)
                start = max(ga, min(a, gb - size))
                return start, start + size


def test_made_slides_by_brute_force(spark):
    r = random.Random(3)
    gaps = {s: [(200, 6200), (9200, 12000), (15000, 30000)][: s + 1] for s in range(4)}
    rows = [(s, k, r.choice(["text", "list", "logo", "person", "stat", "clip", None]), str(r.randrange(0, 320) / 10), str(r.randrange(0, 320) / 10)) for s in range(5) for k in range(60)]
    want = []
    for s in range(5):
        fitted = []
        for _, k, kind, a, b in (x for x in rows if x[0] == s and x[2] in ("text", "list", "logo", "person")):
            if got := fit(round(float(a) * 1000), round(float(b) * 1000), gaps.get(s, [])):
                fitted.append((*got, k, kind))
        last = None
        for a, b, k, kind in sorted(fitted, key=lambda x: x[0]):  # stable: of one start the first by place
            if last is None or a >= last:
                want.append((s, k, kind, a, b))
                last = b
    free = spark.createDataFrame([(s, a, b) for s, x in gaps.items() for a, b in x], SPANS)
    for most in (None, 10):  # a fold, and chains of pointers
        got = render.made_slides(spark.createDataFrame(rows, SLIDES), free, most=most).collect()
        assert sorted((x.source_id, x.place, x.type, x.start_ms, x.end_ms) for x in got) == sorted(want)
    assert len(want) > 12 and any(x[1] for x in want)


def test_standing_slides(spark):
    d = lambda *rows: spark.createDataFrame(list(rows), SPANS + ", name string")
    manual = d((1, 1000, 3000, "m"), (1, 5000, 4000, "backwards"), (1, 19000, 20050, "edge"), (1, 19000, 20051, "past"))
    made = d((1, 2999, 4000, "over manual"), (1, 3000, 4500, "touches"), (1, 6500, 8000, "in overlay"), (1, 8000, 9000, "after overlay"), (2, 0, 1000, "no length"))
    over = spark.createDataFrame([(1, 6000, 8000)], SPANS)
    lengths = spark.createDataFrame([(1, 20000)], "source_id long, dur long")
    got = render.standing_slides(manual, made, over, lengths).collect()
    assert sorted(x.name for x in got) == ["after overlay", "edge", "m", "touches"]


def test_band(spark):
    rows = [(2000, 5000, "tiktok"), (3000, 7500, "tiktok"), (1000, 8000, "tiktok"), (None, None, "youtube"), (3000, 7060, "instagram"), (2050, 9900, "elsewhere"), (2049, 9900, None)]
    d = spark.createDataFrame(rows, "t long, b long, p string")
    got = [tuple(x[0]) for x in d.select(render.band(F.col("t"), F.col("b"), F.col("p"))).collect()]
    assert got == [(0.525, 0.655), (0.145, 0.275), (0.6, 0.78), (0.62, 0.82), (0.145, 0.275), (0.05, 0.18), (0.6, 0.8)]


def test_palette(spark):
    look = "struct<gold: string, red: string, green: string, background: string>"
    d = spark.createDataFrame([(("#1", None, "#3", None),), (None,)], f"look {look}")
    got = [tuple(x[0]) for x in d.select(render.palette(F.col("look"))).collect()]
    assert got == [("#1", "#37bdf8", "#3", "#07121c"), ("#f5c542", "#37bdf8", "#34c759", "#07121c")]


def test_documents(spark):
    item = "source_id long, start_ms long, end_ms long, item struct<text: string, start: double>"
    words = spark.createDataFrame([(1, 500, 600, ("b\"\\", 0.5)), (1, 0, 400, ("ä", 0.0)), (3, 0, 1, ("not a clip's", 0.0))], item)
    clips = spark.createDataFrame([(1, 30), (2, 25)], "source_id long, fps int")
    got = {x.source_id: json.loads(x.props) for x in render.documents(clips, ["fps"], {"words": words, "broll": words.where("false")}).collect()}
    assert got == {1: {"fps": 30, "words": [{"text": "ä", "start": 0.0}, {"text": 'b"\\', "start": 0.5}], "broll": []}, 2: {"fps": 25, "words": [], "broll": []}}
    assert render.documents(clips.where("false"), ["fps"], {"words": words}).count() == 0
