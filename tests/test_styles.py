from pyspark.sql import functions as F

from spanloom.operators import styles


def test_with_style(spark):
    looks = spark.createDataFrame([("default", "#111"), ("bold", None)], "name string, gold string")
    rows = spark.createDataFrame([(1, "bold"), (2, "none"), (3, None), (4, "default")], "k int, style string")
    got = {x.k: x.look and tuple(x.look) for x in styles.with_style(rows, "style", looks, "default").collect()}
    assert got == {1: ("bold", None), 2: ("default", "#111"), 3: ("default", "#111"), 4: ("default", "#111")}
    none = styles.with_style(rows, "style", looks.where("name = 'bold'"), "default").collect()
    assert {x.k: x.look is None for x in none} == {1: False, 2: True, 3: True, 4: True}


def test_yields_and_delays(spark):
    o = spark.createDataFrame([(1, 0, 10)], "source_id long, start_ms long, end_ms long")
    s = spark.createDataFrame([(1, 20, 30, True), (1, 40, 50, False), (1, 60, 70, None)], "source_id long, start_ms long, end_ms long, badge boolean")
    assert sorted(tuple(x) for x in styles.yields(o, s).collect()) == [(1, 0, 10, "overlay"), (1, 40, 50, "slide"), (1, 60, 70, "slide")]
    d = spark.createDataFrame([(0.0005,), (0.0015,), (0.05,), (1.2345,), (2.0625,)], "t double")
    assert [x[0] for x in d.select(styles.delay_ms(F.col("t"))).collect()] == [round(t * 1000) for t in (0.0005, 0.0015, 0.05, 1.2345, 2.0625)]
