"""A report as lines in order, written in parts."""

import glob

from pyspark.sql import functions as F

from spanloom.operators import reports
from spanloom.sources import records


def test_sections_in_order(spark, tmp_path):
    rows = [(s, k * 7 % 50, k) for k in range(200) for s in ("b", "a", None)] + [("z", 1, 1)]
    d = spark.createDataFrame(rows, "section string, ms int, id int").repartition(5)
    head = F.concat(F.lit("# "), F.coalesce("section", F.lit("none")), F.lit(" "), F.col("n").cast("string"))
    made = reports.sections(d, "section", ["ms", "id"], F.concat_ws(" ", "section", "ms", "id"), head)
    want = []
    for s in (None, "a", "b", "z"):
        own = sorted(x[1:] for x in rows if x[0] == s)
        want += [f"# {s or 'none'} {len(own)}", *(" ".join(([s] if s else []) + [str(a), str(b)]) for a, b in own)]
    got = sorted(made.collect(), key=lambda x: x.line_no)
    assert [x.line for x in got] == want and [x.line_no for x in got] == list(range(len(want)))
    assert [x.place for x in got if x.section == "a"] == list(range(201))
    records.write_lines(made, f"{tmp_path}/report", 3)
    parts = sorted(glob.glob(f"{tmp_path}/report/part-*"))
    assert len(parts) == 3 and "".join(open(p, encoding="utf-8").read() for p in parts).splitlines() == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan
