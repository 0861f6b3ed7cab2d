"""Projects of clips as files."""

import json

from pyspark.sql import functions as F

from spanloom.operators import projects
from spanloom.sources import records

MANIFESTS = "source_id long, rank int, slug string, vertical_path string, enhanced_path string, cleaned_path string, raw_path string, snapped_segments string, source_video string, duration_ms long"
CLIPS = "source_id long, rank int, slug string, viral_score int, hook_text string, hook_start double, hook_end double, reasoning string, segments array<array<double>>, instagram_caption string"


def made(spark):
    manifests = spark.createDataFrame(
        [
            (1, 1, "m", "v.mp4", "e.mp4", None, "r.mp4", None, "talk.mkv", 12345),
            (1, 100, "m", None, "", "c.mp4", "r.mp4", None, "talk.mkv", 1000),
            (1, 3, None, None, None, None, "r.mp4", None, "talk.mkv", 50),
            (1, 4, "no-clip", None, None, None, "r.mp4", None, "talk.mkv", 50),
            (2, 1, "m", None, None, None, "r.mp4", None, "other.mkv", 60),
        ],
        MANIFESTS,
    )
    clips = spark.createDataFrame(
        [
            (1, 1, "own", 9, "Is it \"so\"?" + "x" * 60, 1.5, 11.5, "Why not.", [[1.5, 4.0], [5.0, 13.0]], "Look — here #tag"),
            (1, 100, "", None, None, None, None, None, None, ""),
            (1, 3, None, 5, "", None, None, None, None, None),
        ],
        CLIPS,
    )
    return projects.projects(manifests, clips)


def test_projects(spark):
    got = {x["rank"]: x for x in made(spark).collect()}
    assert {k: (x.folder, x.title, x.media) for k, x in got.items()} == {1: ("short-01-own", "Short 01 — own", "v.mp4"), 100: ("short-100-m", "Short 100 — m", "c.mp4"), 3: ("short-03-clip-3", "Short 03 — clip-3", "r.mp4")}
    first, bare = json.loads(got[1].meta), json.loads(got[100].meta)
    hook = "Is it \"so\"?" + "x" * 60
    assert first == {
        "id": "short-01-own", "name": "Short 01 — " + hook[:60], "width": 1080, "height": 1920, "fps": 30,
        "clip": {"viral_score": 9, "hook_text": hook, "hook_start": 1.5, "hook_end": 11.5, "reasoning": "Why not.", "source_video": "talk.mkv", "source_segments": [[1.5, 4.0], [5.0, 13.0]], "snapped_segments": None, "duration": 12.345},
    }
    assert bare["name"] == "Short 100 — " and bare["clip"]["hook_text"] is None and "viral_score" in bare["clip"]
    assert got[1].caption == "Look, here"
    assert got[3].caption == "Save this for later, it lands harder the second time.\n\nFollow for more."


def test_page(spark):
    d = spark.createDataFrame([("short-01-a", "A <b> & \"{cues}\"", 61007, "<i>{title}</i>")], "f string, t string, n long, c string")
    page = d.select(projects.page(F.col("f"), F.col("t"), F.col("n"), F.col("c"), "{id}|{title}|{duration}|{cues}|{other}{id}")).first()[0]
    assert page == "short-01-a|A &lt;b&gt; &amp; &quot;{cues}&quot;|61.007|<i>{title}</i>|{other}short-01-a"
    assert d.select(projects.page(F.col("f"), F.col("t"), F.col("n"), F.col("c"), "plain")).first()[0] == "plain"


def test_files_written_and_read(spark, tmp_path):
    cues = spark.createDataFrame([(1, 1, 12, "punch", "gold", 2500, 900, "B<br>b"), (1, 1, 11, "hero", "red", 0, 1600, "A"), (1, 9, 11, "hero", "red", 0, 1, "no project's")], "source_id long, rank int, track int, style string, color string, start_ms long, duration_ms long, html string")
    words = spark.createDataFrame([(1, 1, 900, 1000, ("zwei\n\"", 0.9)), (1, 1, 0, 400, ("é", 0.0))], "source_id long, rank int, start_ms long, end_ms long, item struct<text: string, start: double>")
    files = projects.files(made(spark), cues, words)
    got = {x.path: x.content for x in files.collect()}
    assert len(got) == 15 and files.count() == 15
    own = "1/short-01-own"
    assert json.loads(got[own + "/assets/words.json"]) == [{"text": "é", "start": 0.0}, {"text": 'zwei\n"', "start": 0.9}]
    assert got["1/short-100-m/assets/words.json"] == "[]"
    assert got[own + "/caption.txt"] == got[own + ".txt"] == "Look, here\n"
    shown = [x for x in got[own + "/index.html"].split("\n") if x.startswith('<div class="cue')]
    assert shown == ['<div class="cue hero red" data-track-index="11" data-start="0.000" data-duration="1.600">A</div>', '<div class="cue punch gold" data-track-index="12" data-start="2.500" data-duration="0.900">B<br>b</div>']
    assert 'class="cue' not in got["1/short-03-clip-3/index.html"]
    root = str(tmp_path / "projects")
    records.write_files(files, root)
    assert {x.path: x.content for x in records.read_files(spark, root).collect()} == got
