"""Steps that must not grow faster than their input (findings of round 3)."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from panelrisk.operators import prep, windows
from panelrisk.spec import FIXTURE_SPEC as S


def test_medians_count_few_values(spark, monkeypatch):
    """Exact medians, with NULLs, NaN and ties, from a table of few distinct values; also with bad cuts."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=4000), rng.integers(0, 2, 4000).astype(float)
    rows = [(float(a), None if i % 7 == 0 else float(b), float("nan") if i % 5 == 0 else float(i)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x double, y double, z double").withColumn("none", F.lit(None).cast("double"))
    want = {"x": np.median(x), "y": np.median([r[1] for r in rows if r[1] is not None]), "z": np.median([r[2] for r in rows if r[2] == r[2]])}
    sizes = []
    counted = prep.quantiles_of_counts
    monkeypatch.setattr(prep, "quantiles_of_counts", lambda g, *a: sizes.append(g.count()) or counted(g, *a))
    for look, near in ((50_000, 0.015), (40, 0.0)):  # the second guess is too narrow, so features are counted again
        got = {r.feature: r.median for r in prep.numeric_medians(df, ["x", "y", "z", "none"], look, near).collect()}
        assert got == want
    assert sizes[0] < 400  # of 7,200 distinct ones


def test_running_windows_equal_sliding_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(e, dt.date(2020, 1, 1) + dt.timedelta(days=i), None if rng.random() < 0.1 else int(rng.integers(-5, 900)), int(rng.random() < 0.2)) for e in (1, 2) for i in range(150)]
    df = spark.createDataFrame(rows, "entity_id long, date date, use_today long, event int")
    w = windows.by_entity(S).rowsBetween(-90, -1)
    out = df.select(windows.rolling_std_before("use_today", S).alias("a"), windows.rolling_std_before("use_today", S, whole=True).alias("b"),
                    F.coalesce(F.sum("event").over(w), F.lit(0)).alias("c"), windows.past_sum("event", S, 90).alias("d"))
    got = out.toPandas()
    assert np.allclose(got.a.astype(float), got.b.astype(float), rtol=1e-12, equal_nan=True) and (got.c == got.d).all()
    plan = df.select(windows.past_sum("event", S, 90))._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RowFrame, -90, -1)" not in plan


def test_months_arrive_whole(spark, tmp_path, monkeypatch):
    """The files of a month do not grow with the partitions of the panel; no entity's month is cut."""
    from panelrisk.queries import q_streaming

    rows = [(e, dt.date(2020, 1, 1) + dt.timedelta(days=7 * i)) for e in range(40) for i in range(12)]
    df = spark.createDataFrame(rows, "entity_id long, date date").repartition(16)
    assert q_streaming.write_months(df, str(tmp_path / "one")) == 1
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 3
    monkeypatch.setattr(q_streaming, "FILE_ROWS", 100)
    files = q_streaming.write_months(df, str(tmp_path / "more"))
    back = spark.read.parquet(str(tmp_path / "more")).select("*", F.col("_metadata.file_path").alias("file"))
    assert files == 2 and back.count() == len(rows)
    cut = back.groupBy("entity_id", F.trunc("date", "month")).agg(F.countDistinct("file").alias("n")).filter("n > 1")
    assert cut.count() == 0


def test_plain_numbers_need_no_regular_expression(spark):
    """Texts of numbers are written and read as before; only unusual ones reach the regular expressions."""
    from panelrisk.sources import csv

    texts = ["7", "-12", "+5", "007", "45,0", "12345678901234567890", " 8 ", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [None if r.n is None else int(r.n) for r in df.select(csv.whole_number(F.col("t"), "t").alias("n")).collect()]
    assert got == [7, -12, 5, 7, 45, 12345678901234567890, 8, None, None]
    numbers = spark.createDataFrame([(0.5,), (10.0,), (-100.25,), (1e-5,), (0.0,), (None,)], "x double")
    wrote = [r.s for r in numbers.select(csv.format_decimal_comma(F.col("x")).alias("s")).collect()]
    assert wrote == ["0,5", "10,0", "-100,25", "0,00001", "0,0", None]
    assert "regexp" not in numbers.select(csv.format_decimal_comma(F.col("x")))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_attach_leaves_the_large_side_in_place(spark):
    """A few groups are broadcast: the rows are not dealt by a key of four values."""
    from panelrisk.operators.positions import attach

    rows = spark.range(3_000_000).withColumn("g", F.when(F.col("id") % 4 > 0, F.col("id") % 4))  # more than Spark broadcasts; NULL is a group
    out = attach(rows, rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), ["g"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert out.filter("n = 750000").count() == 3_000_000


def test_lines_are_grouped_by_entity_and_day_once(spark):
    from panelrisk.sources.fixture import fixture_panel

    plan = fixture_panel(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(l_suppkey") == 1


def test_sums_of_a_series_stay_in_its_task(spark):
    """No row is multiplied by its terms before a shuffle; the sums are those of the segments between the edges."""
    from panelrisk.operators import normal

    rows = [(e, dt.date(2020, 1, 5) + dt.timedelta(days=7 * i), float(i % 5)) for e in (1, 2) for i in range(60)]
    ts = spark.createDataFrame(rows, "entity_id long, ds date, y double")
    assert "Generate" not in normal.fit_series(ts, ["entity_id"])._jdf.queryExecution().optimizedPlan().toString()
    rng = np.random.default_rng(7)
    epoch, y, r = rng.permutation(np.arange(18000.0, 18090)), rng.normal(size=90), rng.normal(size=90)
    r[::4] = np.nan
    edges = np.array([0.0, 17.0, 17.5, 60.0, 200.0])
    got = normal._prefix_products(18000, edges, epoch, y, [r], True)
    vec = lambda i: [1.0, (epoch[i] - 18000) / normal.DAY_SCALE, *[f(epoch[i] * (2 * np.pi * k / p)) for p, k in normal._terms(True) for f in (np.sin, np.cos)],
                     0.0 if np.isnan(r[i]) else r[i], 0.0 if np.isnan(r[i]) else 1.0, y[i]]
    for s in range(len(edges) + 1):
        x = np.array([vec(i) for i in range(90) if (edges < epoch[i] - 18000).sum() <= s]).reshape(-1, 31)
        assert np.allclose(got[s], x.T @ x)
    assert normal._prefix_products(0, edges, np.zeros(0), np.zeros(0), [], False).shape == (6, 23, 23)


def test_drawn_rows_are_not_shuffled(spark):
    """The same rows as sorting by the hash; lines and their draws stay where they are, equal draws and missing keys included."""
    import hashlib

    from panelrisk.operators import sampling

    rows = [(e, dt.date(2020, 1, 1) + dt.timedelta(days=i), f"line {e} {i}") for e in range(20) for i in range(30)]
    rows += [(3, dt.date(2020, 1, 5), "again"), (None, dt.date(2020, 1, 5), "no key"), (None, dt.date(2020, 1, 6), "no key")]
    df = spark.createDataFrame(rows, "entity_id long, date date, line string")
    draw = lambda r: (r[0] is None, hashlib.md5(f"{r[0]}|{r[1]}-42".encode()).hexdigest()[:26])
    order = sorted(rows, key=draw)
    for n in (0, 1, 100, 601, 602, 603, 700):
        out = sampling.first_drawn(df, S, n)
        got = [tuple(r) for r in out.collect()]
        assert len(got) == min(n, 603) and sorted(map(draw, got)) == [draw(r) for r in order[:n]] and len(set(got)) == len(got)
    assert "Exchange" not in sampling.first_drawn(df, S, 100)._jdf.queryExecution().executedPlan().toString()
    again = [i for i, r in enumerate(order) if draw(r) == draw((3, dt.date(2020, 1, 5)))]
    assert len(again) == 2 and len(sampling.first_drawn(df, S, again[1]).collect()) == again[1]
    numbers = spark.createDataFrame([(5,), (5,), (0,), (1 << 52,), ((1 << 52) - 1,)], "a long")
    assert [sampling.nth_smallest(numbers, "a", n) for n in range(1, 7)] == [(0, 0), (5, 1), (5, 1), ((1 << 52) - 1, 3), (1 << 52, 4), None]


def test_lines_are_not_dealt_by_their_file(spark, tmp_path):
    from panelrisk.sources import csv

    (tmp_path / "a.csv").write_text("k;v\n1;x\n2;y\n")
    (tmp_path / "b.csv").write_text("k;v\n3;z\n")
    header, lines = csv.read_raw_lines(spark, str(tmp_path))
    assert header == "k;v" and [r.line for r in lines.orderBy("line_no").collect()] == ["1;x", "2;y", "3;z"]
    assert "hashpartitioning" not in lines._jdf.queryExecution().executedPlan().toString()


def test_a_series_is_counted_once(spark):
    """The calendar's bounds and the join read the finished series, not its rows twice."""
    from panelrisk.operators import series

    rows = spark.createDataFrame([(dt.date(2020, 1, d), 1) for d in (1, 1, 4)], "ds date, y int")
    out = series.densify(series.daily_sum(rows, "ds", "y"), {"y": 0})
    assert "LogicalRDD" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.y for r in out.orderBy("ds").collect()] == [2, 0, 0, 1]
