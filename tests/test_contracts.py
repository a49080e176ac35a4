"""Nearest listed strikes and contract marks against plain loops."""

import random

from pyspark.sql import functions as F

from tidemark.operators import contracts as C
from tidemark.operators import joins as J


def test_nearest_listed(spark):
    rng = random.Random(2)
    listed = sorted({(k, round(rng.uniform(10, 20), 1)) for k in "ab" for _ in range(30)})
    goals = [(i, rng.choice("abc"), round(rng.uniform(8, 22), 2)) for i in range(300)] + [(900 + i, "a", v) for i, (k, v) in enumerate(listed) if k == "a"]
    a = spark.createDataFrame(goals, "id int, k string, goal double")
    b = spark.createDataFrame([(k, v, f"{k}{v}") for k, v in listed], "k string, strike double, contract string")
    got = {r["id"]: r["near"] for r in J.nearest_listed(a, b, ["k"], "goal", "strike", lambda row, near: F.abs(near["strike"] - row["goal"])).collect()}
    for i, k, goal in goals:
        own = [v for q, v in listed if q == k]
        if own:
            assert got[i]["strike"] == min(own, key=lambda v: (abs(v - goal), v)) and got[i]["contract"] == f"{k}{got[i]['strike']}"
        else:
            assert got[i] is None


def test_latest_mark_within_its_age(spark):
    rng = random.Random(4)
    marks = {(rng.choice("abc"), rng.randrange(60)): rng.random() for _ in range(60)}
    asked = [(i, rng.choice("abcd"), rng.randrange(-3, 66)) for i in range(300)]
    m = spark.createDataFrame([(c, s, v) for (c, s), v in marks.items()], "contract string, session int, price double")
    q = spark.createDataFrame(asked, "id int, contract string, session int")
    for age in (0, 1, 7):
        got = {r["id"]: r["mark"] for r in C.latest(q, m, age, ["price"]).collect()}
        assert len(got) == len(asked)
        for i, c, s in asked:
            fit = [t for (d, t) in marks if d == c and s - age <= t <= s]
            assert (got[i]["session"], got[i]["price"]) == (max(fit), marks[c, max(fit)]) if fit else got[i] is None
