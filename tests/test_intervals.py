"""Interval joins against all pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import intervals as IV


def day(i):
    return dt.date(1970, 1, 1) + dt.timedelta(days=i)


@pytest.mark.parametrize("most", [100_000, 0])
def test_dates_in_windows(spark, most):
    """All lengths, dates before the epoch, copies, open ends, empty windows, missing points."""
    rng = random.Random(most)
    spans = [(i, day(a := rng.randint(-900, 900)), day(a + rng.choice([-3, 0, 0, 1, 2, 7, 8, 31, 365, 1500]))) for i in range(150)]
    spans += [(150, None, day(-500)), (151, day(600), None), (152, None, None), spans[3]]
    points = [(i, day(rng.randint(-1000, 1000))) for i in range(120)] + [(120, None), (0, day(0)), (0, day(0))]
    p = spark.createDataFrame([(*r, "x") for r in points], "i int, date date, grid string")
    v = spark.createDataFrame([(*r, 1) for r in spans], "id int, a date, b date, cell int")
    got = IV.interval_join(p, v, "date", "a", "b", most)
    assert got.columns == ["i", "date", "grid", "id", "a", "b", "cell"]
    want = sorted((i, w) for i, d in points if d for w, a, b in spans if (a is None or a <= d) and (b is None or d <= b))
    assert sorted((r.i, r.id) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert IV.interval_join(p, v.limit(0), "date", "a", "b").count() == 0 and IV.interval_join(p.limit(0), v, "date", "a", "b").count() == 0
    facts = IV.by_point(p, v, "date", "a", "b", {"n": F.count(F.lit(1)), "low": F.min("id")}).collect()
    hits = {d: [w for w, a, b in spans if (a is None or a <= d) and (b is None or d <= b)] for _, d in points if d}
    assert {r.date: (r.n, r.low) for r in facts} == {d: (len(w), min(w)) for d, w in hits.items() if w}


def test_timestamps_and_numbers(spark):
    base = dt.datetime(2024, 1, 1)
    points = [(i, base + dt.timedelta(microseconds=i * 777_777)) for i in range(60)]
    spans = [(i, base + dt.timedelta(seconds=i), base + dt.timedelta(seconds=i * 1.5)) for i in range(30)]
    got = IV.interval_join(spark.createDataFrame(points, "i int, t timestamp"), spark.createDataFrame(spans, "id int, a timestamp, b timestamp"), "t", "a", "b")
    assert sorted((r.i, r.id) for r in got.collect()) == sorted((i, w) for i, t in points for w, a, b in spans if a <= t <= b)
    ints = IV.interval_join(spark.range(-50, 50), spark.createDataFrame([(1, -5, 5), (2, 0, 0), (3, -64, -1)], "w int, a int, b int"), "id", "a", "b")
    assert sorted((r.id, r.w) for r in ints.collect()) == sorted([(i, 1) for i in range(-5, 6)] + [(0, 2)] + [(i, 3) for i in range(-50, 0)])
    with pytest.raises(TypeError):
        IV.interval_join(spark.createDataFrame([("a",)], "s string"), spark.createDataFrame([(1, 2)], "a int, b int"), "s", "a", "b")


def test_facts_merged_without_pairs(spark):
    """The same facts as by pairs; rows in the plan of the facts are cells, not intervals times days."""
    rng = random.Random(7)
    spans = [(i, day(a := rng.randint(-900, 900)), day(a + rng.choice([-3, 0, 1, 2, 7, 31, 365, 1500]))) for i in range(200)]
    spans += [(200, None, day(-500)), (201, day(600), None), (202, None, None), (203, day(5000), None), spans[3]]
    p = spark.createDataFrame([(day(rng.randint(-1000, 1000)),) for _ in range(150)] + [(None,)], "date date")
    v = spark.createDataFrame(spans, "id int, a date, b date")
    facts = {"n": F.count(F.lit(1)), "low": F.min("id"), "ending": F.count("b")}
    merge = {"n": F.sum, "low": F.min, "ending": F.sum}
    rows = lambda **more: sorted(map(tuple, IV.by_point(p, v, "date", "a", "b", facts, **more).collect()))
    assert rows(merge=merge) == rows() and rows()
    assert IV.by_point(p.limit(0), v, "date", "a", "b", facts, merge).count() == 0 == IV.by_point(p, v.limit(0), "date", "a", "b", facts, merge).count()
    times = spark.range(40).selectExpr("timestamp_micros(id * 777777) AS t")
    w = spark.range(30).selectExpr("id", "timestamp_micros(id * 1000000) AS a", "IF(id % 5 > 0, timestamp_micros(id * 1500000), NULL) AS b")
    of = lambda **more: sorted(map(tuple, IV.by_point(times, w, "t", "a", "b", {"n": F.count(F.lit(1))}, **more).collect()))
    assert of(merge={"n": F.sum}) == of()
