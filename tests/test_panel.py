"""Panel invariants on a small fixture: past-only controls, whole horizons, event clock."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators import panel as P

DATES = pd.bdate_range("2024-01-01", periods=120).date


def bars(spark, drop=None, scale_after=None):
    rows = []
    for t in ("AA", "BB", "SP"):
        for i, d in enumerate(DATES):
            if drop == (t, i):
                continue
            close = 100 + i + math.sin(i)
            rows.append((t, d, close * (3 if scale_after is not None and i > scale_after else 1), 10000.0 + i))
    return spark.createDataFrame(rows, "ticker string, date date, close double, volume double")


def sessions(spark):
    return spark.createDataFrame([(i, d) for i, d in enumerate(DATES)], "session int, date date")


def wide(spark, **kw):
    dense = P.moves(P.densify(bars(spark, **kw), sessions(spark)))
    out = dense.select("ticker", "session", "date", P.past_return(5).alias("past"), P.rolling_std(20).alias("vol"), P.forward_return(5).alias("fwd"),
                       P.forward_return(1).alias("fwd1"), P.target_end(5).alias("end"))
    return out.where("ticker = 'AA'").orderBy("session").toPandas()


def test_forward_return_and_target_end(spark):
    out = wide(spark)
    c = [100 + i + math.sin(i) for i in range(120)]
    assert out.fwd[40] == pytest.approx(c[45] / c[40] - 1)
    assert out.end[40] == DATES[45]
    assert math.isnan(out.fwd1[119])


def test_future_change_leaves_past_controls(spark):
    a, b = wide(spark), wide(spark, scale_after=70)
    pd.testing.assert_frame_equal(a.loc[:70, ["past", "vol"]], b.loc[:70, ["past", "vol"]])


def test_missing_bar_does_not_shorten_a_horizon(spark):
    out = wide(spark, drop=("AA", 42))
    assert len(out) == 120
    assert math.isnan(out.fwd[40]) and math.isnan(out.fwd[42])
    assert not math.isnan(out.fwd[43])


def test_event_clock_aligns_forward(spark):
    rows = spark.createDataFrame([("f", DATES[4]), ("late", DATES[119])], "id string, filed date").withColumn("available", F.date_add("filed", 1))
    got = {r["id"]: r["session"] for r in P.align_forward(rows, sessions(spark), "available").collect()}
    assert got == {"f": 5, "late": None}


def test_session_shift_keeps_gaps(spark):
    rows = spark.createDataFrame([("A", 0, 1.0), ("A", 2, 3.0)], "ticker string, session int, x double")
    one = J.shifted(rows, "x", 1, "y").where("y is not null").count()
    two = J.shifted(rows, "x", 2, "y").where("y is not null").collect()
    assert one == 0 and [(r["session"], r["y"]) for r in two] == [(2, 1.0)]


def test_marks_never_use_the_future(spark):
    rows = spark.createDataFrame([("A", 0, None), ("A", 1, 3.0), ("A", 2, None), ("A", 3, 99.0)], "ticker string, session int, m double")
    one, age = J.aged_mark("m", 1)
    none, _ = J.aged_mark("m", 0)
    got = rows.select("session", one.alias("v"), age.alias("age"), none.alias("z")).orderBy("session").collect()
    assert (got[2]["v"], got[2]["age"], got[2]["z"]) == (3.0, 1, None)


def test_year_starts_from_the_value_before_it(spark):
    from tidemark.operators import options as O

    rows = [("A", 2001, i, f"2001-01-{i + 1:02d}", 150_000.0, 100_000.0) for i in range(5)] + [("A", 2002, i + 5, f"2002-01-{i + 1:02d}", 150_000.0, 150_000.0) for i in range(5)]
    rows += [("A", 2003, i + 10, f"2003-01-{i + 1:02d}", 150_000.0, None) for i in range(5)]
    nav = spark.createDataFrame(rows, "ticker string, year long, session int, date string, nav double, first double").selectExpr("ticker", "year", "session", "cast(date as date) date", "nav", "first")
    got = {r.year: r for r in O.performance(nav, ["ticker", "year"], "first", 0.0).collect()}
    assert got[2001].annualized_return > 1 and got[2002].annualized_return == 0 and got[2003].annualized_return is None and got[2003].status == "inconclusive"


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    import pytest

    from tidemark.session import shared_folder

    def session(master):
        context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda key: None), getCheckpointDir=lambda: None, setCheckpointDir=lambda folder: None, master=master)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)

    assert shared_folder(session("local[8]")).startswith("/tmp/")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            shared_folder(session(master))
