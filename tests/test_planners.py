"""Sounds, cues, metadata and payloads: known answers."""

import json

import pytest

from spanloom.operators import cues, publishing, sounds


def said(spark, rows):
    """(start, length, whether a big figure) in ms, of one clip of 30 s."""
    return spark.createDataFrame([(1, t, n, 30_000, d) for t, n, d in rows], "source_id long, t long, len long, dur long, ding boolean")


def mentioned(spark, rows):
    return spark.createDataFrame([(1, t, 30_000, slot, pos) for pos, (t, slot) in enumerate(rows)], "source_id long, t long, dur long, slot string, pos long")


def events(spark, callouts, mentions, files, *rest, **more):
    hooks = spark.createDataFrame([(1,)], "source_id long")
    found = sounds.sound_events(hooks, said(spark, callouts), mentioned(spark, mentions), files, *rest, **more)
    return sorted((x.t_ms, x.slot, x.variant) for x in found.collect())


FULL = {"swipe-in": 3, "swipe-out": 2, "hook-impact": 1, "cash-register": 2, "wrong-answer": 3, "ding": 4}
CALLOUTS = [(4000, 2000, False), (8000, 2000, True), (29_000, 2000, False)]
MENTIONS = [(100, "cash-register"), (5000, "wrong-answer"), (6000, "cash-register"), (40_000, "wrong-answer")]


def test_modes(spark):
    swipes = [(4000, "swipe-in", 0), (29_000, "swipe-in", 1)]
    assert events(spark, CALLOUTS, MENTIONS, FULL) == sorted([(50, "hook-impact", 0), *swipes, (8000, "ding", 0), (100, "cash-register", 0), (5000, "wrong-answer", 0)])
    assert (6000, "cash-register", 1) in events(spark, CALLOUTS, MENTIONS, FULL, "every") and len(events(spark, CALLOUTS, MENTIONS, FULL, "every")) == 7
    off = events(spark, CALLOUTS, MENTIONS, FULL, "off")
    assert off == [(50, "hook-impact", 0), (4000, "swipe-in", 0), (8000, "swipe-in", 1), (29_000, "swipe-in", 2)]
    out = events(spark, CALLOUTS, MENTIONS, FULL, "off", swipe_out=True)
    assert [x for x in out if x[1] == "swipe-out"] == [(6000, "swipe-out", 0), (10_000, "swipe-out", 1), (30_000, "swipe-out", 0)]
    with pytest.raises(ValueError):
        events(spark, CALLOUTS, MENTIONS, FULL, "loud")


def test_a_slot_without_files_parts_no_repeats(spark):
    """ding at 0, a sound without a file at 10, ding at 20 ms: one ding."""
    callouts, mentions = [(0, 1000, True), (20, 1000, True)], [(10, "cash-register")]
    assert events(spark, callouts, mentions, {"ding": 1, "cash-register": 0}, "every") == [(0, "ding", 0)]
    assert events(spark, callouts, mentions, {"ding": 1, "cash-register": 1}, "every") == [(0, "ding", 0), (10, "cash-register", 0), (20, "ding", 0)]


def test_without_a_ding_figures_swipe(spark):
    assert events(spark, [(0, 1000, True)], [], {"swipe-in": 2, "ding": 0}) == [(0, "swipe-in", 0)]
    assert events(spark, [(0, 1000, True)], [], {"ding": 0}) == []


def frames(spark, style, start, length, overline=None):
    c = spark.createDataFrame([(style, start, length, overline)], "style string, start_ms long, duration_ms long, overline string")
    return {x.name: (x.at_ms, x.len_ms) for x in cues.key_frames(c).collect()}


def test_key_frames(spark):
    """By the page's script: in 0.4 s and out 0.35 s for a punch; 0.55 and 0.4 for a hero and a caption; five for a big figure; the hook's exit 0.42 s before its end."""
    assert frames(spark, "punch", 1000, 2000) == {"in": (1000, 400), "out": (2650, 350)}
    assert frames(spark, "hero", 0, 3000) == {"in": (0, 550), "out": (2600, 400)} == frames(spark, "unheard-of", 0, 3000)
    assert frames(spark, "bigstat", 500, 2500) == {"in": (500, 300), "eyebrow": (550, 450), "number": (680, 600), "subline": (1050, 500), "out": (2600, 400)}
    hook = frames(spark, "hook", 0, 2400, "x")
    assert hook["out"] == (1980, 420) and hook["headline"] == (200, 500) and "overline" in hook and "overline" not in frames(spark, "hook", 0, 2400, "")
    clip = spark.createDataFrame([(18_841,)], "duration_ms long")
    assert [tuple(x) for x in cues.camera(clip).collect()] == [(18_841, "zoom-in", 0, 9420), (18_841, "zoom-out", 9420, 9421)]


def test_tracks(spark):
    c = spark.createDataFrame([(1, k, "punch", "red", t, 900) for k, t in enumerate((5000, 1000, 1000))], "clip long, n long, style string, color string, start_ms long, duration_ms long")
    h = spark.createDataFrame([(1, None, "gold", 2000), (2, None, "red", 1500)], "clip long, n long, color string, duration_ms long")
    got = sorted((x.clip, x.track, x.style, x.start_ms) for x in cues.on_tracks(c, h, "clip", "n").collect())
    assert got == [(1, 9, "hook", 0), (1, 11, "punch", 1000), (1, 12, "punch", 1000), (1, 13, "punch", 5000), (2, 9, "hook", 0)]


CLIP = "source string, short string, hook_text string, overline string, caption string, instagram_caption string, reasoning string, entities array<string>, callouts array<string>, viral_score int, duration_ms long, cover string, own_thumb string, deliverable string"


def test_metadata(spark):
    rows = [
        ("talk", "short-07-a", " Big — win ", " Money ", None, " told ", None, ["Apple", " apple", "", None, "APPLE", "a—b", "Bob"], ["x — y", "", None], 8, 12_345, None, "t.jpg", "f.mp4"),
        ("talk", "short-1-b", None, "Apple", "cap\n", "told", "so", ["apple", "Bob"], None, None, 1, "c.jpg", "t.jpg", None),
        ("talk", "short-2-c", "t", "Bob", "c", "d", "e", ["Bob"], [], 1, 1, None, None, None),
        ("talk", "notes", "t", "o", "c", "i", "r", [], [], 1, 1, None, None, None),
    ]
    a, b, c = sorted((x.asDict() for x in publishing.metadata(spark.createDataFrame(rows, CLIP)).collect()), key=lambda x: -x["rank"])
    assert (a["title"], a["label"], a["description"], a["summary"]) == ("Big, win", "Money", "told", "")
    assert a["keywords"] == ["Money", "Apple", "a, b", "Bob"] and a["callouts"] == ["x, y"]
    assert (a["rank"], a["duration_seconds"], a["thumbnail"], a["deliverable"]) == (7, 12.35, "t.jpg", "f.mp4") or a["duration_seconds"] == 12.34
    # the headline stands beside a keyword that differs in case alone; one that is the same isn't put in twice
    assert c["keywords"] == ["Apple", "apple", "Bob"] and c["thumbnail"] == "c.jpg" and c["duration_seconds"] is None and c["description"] == "cap"
    assert b["keywords"] == ["Bob"]


def test_payloads(spark):
    rows = [("b", "u1", " First line \nmore", None, ["t1"] * 12, 3), ("a", "u2", "\n", "Own", [], 3), ("c", None, "x", None, [], 9), ("d", "u4", "z", None, None, None)]
    items = spark.createDataFrame(rows, "base string, media string, caption string, title string, tags array<string>, score int")
    made = {x.base: json.loads(x.payload) for x in publishing.payloads(items, ("youtube", "twitter", "linkedin"), "blog", "2026-01-31", ("09:00", "13:00"), 2, "UTC").collect()}
    assert set(made) == {"a", "b", "d"}
    assert [made[k]["date"] for k in "abd"] == ["2026-01-31T09:00:00", "2026-01-31T13:00:00", "2026-02-01T09:00:00"]
    b = made["b"]["info"]
    assert b["youtubeData"] == {"title": "First line", "type": "short", "privacy": "public", "madeForKids": False, "tags": ["t1"] * 10}
    assert b["twitterData"] == {"tags": []} and b["linkedinData"] == {} and "tiktokData" not in b and b["text"] == "First line \nmore"
    assert b["providers"] == [{"network": n} for n in ("youtube", "twitter", "linkedin")] and b["publicationDate"] == {"dateTime": "2026-01-31T13:00:00", "timezone": "UTC"}
    assert made["a"]["info"]["youtubeData"]["title"] == "Own"
