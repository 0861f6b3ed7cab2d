"""Clips from records of many shapes, against a plain reading of them."""

import json
import random
import re

from spanloom.operators import clips


def plain(place, c, last):
    """One record read field by field; None where something in it can't be."""
    try:
        start, end = float(c["start"]), float(c["end"])
        if end <= start or end > last + 1 or not 5 <= end - start <= 180:
            return None
        parts = []
        for s in c.get("segments") or [[start, end]]:
            s = [s.get("start"), s.get("end")] if isinstance(s, dict) and s else s
            if not s or len(s) != 2:
                continue
            a, b = float(s[0]), float(s[1])
            parts += [(a, b)] if b > a else []
        said = []
        for o in c.get("callouts") or []:
            try:
                said.append((float(o["local_start"]), float(o.get("duration", 1.6)), str(o["text"]).strip(), list(o.get("accent") or []), str(o.get("eyebrow", "")).strip(), str(o.get("color", "cyan")).strip().lower()))
            except (KeyError, TypeError, ValueError):
                pass
        slug = re.sub("[^a-z0-9]+", "-", str(c.get("slug") or c.get("hook_text") or f"clip-{place + 1}").lower()).strip("-")[:40] or f"clip-{place + 1}"
        return {"given": c.get("rank", place + 1), "start": start, "end": end, "hook": (float(c.get("hook_start", start)), float(c.get("hook_end", min(start + 10, end)))), "score": int(c.get("viral_score", 5)), "segments": parts or [(start, end)], "slug": slug, "caption": (c.get("instagram_caption") or "").strip(), "callouts": said}
    except (KeyError, TypeError, ValueError):
        return None


def record(r):
    pick = lambda *x: r.choice(x)
    start = r.choice([0, 1.5, "2", 10, "x", 3])
    c = {"start": start, "end": pick(9, "20.5", 40, 250, 30, 12)}
    shapes = ([[1, 5], [9, 2]], [{"start": 2, "end": "8"}], [["x", 5]], [[1], [], None], [], [{"start": 3}], [[1, 2, 3], [4, 6]], None, [7], [{}])
    optional = {
        "segments": pick(*shapes[:2], *shapes), "viral_score": pick(3, 9, "7", 8), "rank": pick(1, 2, 3), "slug": pick("", "A b!", None), "hook_text": pick("", "Why — now?", "!!"), "instagram_caption": pick(" hi \n", None), "hook_end": pick(4, 5.5, "6"),
        "callouts": pick(None, [{"local_start": 1, "text": " Hi "}, {"local_start": "x", "text": "t"}, {"text": "no"}], [{"local_start": "2.5", "duration": None, "text": "t"}, {"local_start": 0, "duration": "2", "text": "y", "accent": ["A", "b"], "eyebrow": " E ", "color": " RED "}]),
    }
    if r.random() < 0.1:
        optional["viral_score"] = pick("x", None)
    return c | {k: v for k, v in optional.items() if r.random() < 0.7}


def test_records_of_many_shapes(spark):
    r = random.Random(11)
    raw = [(s, k, record(r)) for s in range(12) for k in range(30)]
    lengths = {s: 60.0 if s % 3 else 15.0 for s in range(11)}  # the last source has no word
    d = spark.createDataFrame([(s, k, json.dumps(c)) for s, k, c in raw], "source_id long, place int, record string")
    got = {(x.source_id, x.rank): x for x in clips.normalized(d, spark.createDataFrame(list(lengths.items()), "source_id long, last_end double")).collect()}
    want = {}
    for s in range(12):
        own = [(m, k) for t, k, c in raw if t == s and (m := plain(k, c, lengths.get(s, 0.0)))]
        for rank, (m, k) in enumerate(sorted(own, key=lambda x: (-x[0]["score"], x[0]["given"], x[1])), 1):
            want[s, rank] = m | {"place": k}
    assert set(got) == set(want) and len(want) > 60
    for key, m in want.items():
        x = got[key]
        assert (x.place, x.start, x.end, (x.hook_start, x.hook_end), x.viral_score, x.slug, x.instagram_caption) == (m["place"], m["start"], m["end"], m["hook"], m["score"], m["slug"], m["caption"])
        assert [tuple(s) for s in x.segments] == m["segments"]
        assert [tuple(c) for c in x.callouts] == m["callouts"]
