"""Every query of the engine's own operators against its SQL, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from spanloom.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        raise TypeError("a decimal came out")
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=str)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    made = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in made.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows(df.columns, df.collect()), rows(names, made.fetchall())
    assert len(got) == len(want)
    unlike = [x for x in zip(got, want) if x[0] != x[1]]
    assert not unlike[:2]


#: Sequential by nature: a fold along sorted rows; and an automaton.
FOLDS = {"reused_transcripts", "greedy_spans", "spaced_events", "sound_events_sparing", "sound_events_every", "sound_events_poor_pack", "sound_events_off", "slide_plan", "entity_slides", "made_slides", "transcript_10s", "transcript_8s", "transcript_blocks"}


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in ("slot_coverage",)])
def test_no_nested_loops(spark, name):
    """No join without equal keys, no Python in the plans but for the folds."""
    plan = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert name in FOLDS or "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", ["sound_events_sparing", "sound_events_every", "picture_events", "overlay_windows", "slide_plan", "entity_slides"])
def test_words_are_cut_once(spark, name):
    """In the plan as it ran, the texts become words at one place; every other reader shares that shuffle."""
    df = registry.QUERIES[name](spark, DIR)
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert ran.count("Generate posexplode(w#") == 1
    assert ran.count("REBALANCE_PARTITIONS_BY_COL") >= 1


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
