"""Containment of many tags, against plain search."""

import random

import pytest

from spanloom.operators import lookups

ALL, NONE = 1 << 30, -1


def plain(texts, tags):
    def edge(c):
        return not (c.isalnum() or c == "_")

    def has(text, tag, edges):
        at = text.find(tag)
        while at >= 0:
            if not edges or (at == 0 or edge(text[at - 1])) and (at + len(tag) == len(text) or edge(text[at + len(tag)])):
                return True
            at = text.find(tag, at + 1)
        return False

    return sorted((k, tag) for k, text in texts if text is not None for tag, edges in tags.items() if has(text, tag, edges))


@pytest.mark.parametrize("most", [ALL, NONE])
@pytest.mark.parametrize("seed", range(3))
def test_held(spark, most, seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choices("abé _-", k=n))
    texts = [(k, word(r.randrange(25))) for k in range(120)] + [(900, None), (901, ""), (902, "x" * 50_000 + "ab")]
    tags = {word(r.randrange(1, 5)): r.random() < 0.5 for _ in range(60)}
    rows = [*tags.items(), (None, True), ("", False)]
    t, g = spark.createDataFrame(texts, "k long, body string"), spark.createDataFrame(rows, "tag string, edges boolean")
    want = plain(texts, tags)
    got = lookups.held(t, "k", "body", g, most_bytes=most).collect()
    assert sorted(tuple(x)[:2] for x in got) == want and len(want) > 50
    assert sorted(tuple(x)[:2] for x in got if x.at_edges) == plain(texts, dict.fromkeys(tags, True))
    least = {}
    for k, tag in want:
        least[k] = min(least.get(k, tag), tag, key=str.encode)
    assert dict(map(tuple, lookups.held(t, "k", "body", g, first=True, most_bytes=most).collect())) == least


@pytest.mark.parametrize("most", [ALL, NONE])
def test_no_tags_no_texts(spark, most):
    t, g = spark.createDataFrame([(1, "a")], "k long, body string"), spark.createDataFrame([("a",), ("a",)], "tag string")
    assert [tuple(x) for x in lookups.held(t, "k", "body", g, most_bytes=most).collect()] == [(1, "a", True)]
    assert lookups.held(t, "k", "body", g.limit(0), most_bytes=most).collect() == []
    assert lookups.held(t.limit(0), "k", "body", g, most_bytes=most).collect() == []


def test_no_candidate_that_is_no_hit(spark):
    """All tags begin alike, as all texts do: what the join brings are hits, not texts times tags."""
    texts = spark.createDataFrame([(k, f"video#{k:09d}") for k in range(400)], "k long, body string")
    tags = spark.createDataFrame([(f"video#{k:09d}",) for k in range(0, 4000, 10)], "tag string")
    candidates = lookups.met(texts.withColumnRenamed("body", "__text"), lookups._known(tags))
    assert candidates.count() == 40 == lookups.held(texts, "k", "body", tags, most_bytes=NONE).count()
    plan = candidates._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
