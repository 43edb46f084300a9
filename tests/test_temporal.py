"""Interval and as-of joins against brute force, with a hot key, borders, ties and nulls."""

import random

import pytest

from framelark.operators.temporal import asof_join, interval_join


def keys_and_times(seed, n, prefix):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot"] * 6 + ["b", None]), rnd.choice([None, 10.0, 20.0, -5.0] + [rnd.uniform(-30, 60)] * 9), f"{prefix}{i}") for i in range(n)]
    return rows + rows[:3]


@pytest.mark.parametrize("cell", [0.5, 10.0, 1000.0])
def test_interval_join(spark, cell):
    points = keys_and_times(1, 120, "p")
    rnd = random.Random(2)
    spans = [(k, t, None if t is None else t + rnd.choice([0.0, -1.0, 0.1, 5.0, 10.0, 45.0]), n) for k, t, n in keys_and_times(3, 60, "s")]
    spans += [("b", 0.0, None, "open"), ("b", 0.0, 10.0, "border"), ("b", 10.0, 20.0, "next")]
    p = spark.createDataFrame(points, "k string, t double, p string")
    s = spark.createDataFrame(spans, "k string, lo double, hi double, s string")
    for how in ("inner", "left"):
        want = []
        for k, t, name in points:
            hits = [n for j, lo, hi, n in spans if j == k and None not in (t, lo, hi) and lo <= t < hi]
            want += [(k, name, n) for n in hits] or ([(k, name, None)] if how == "left" else [])
        got = interval_join(p, s, ["k"], "t", "lo", "hi", cell, how)
        assert got.columns == ["k", "t", "p", "lo", "hi", "s"]
        assert sorted(((r.k, r.p, r.s) for r in got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 1.5])
@pytest.mark.parametrize("cell", [0.7, 1000.0])
def test_asof_join(spark, direction, tolerance, cell):
    left, right = keys_and_times(4, 90, "l"), keys_and_times(5, 40, "r")
    want = []
    for k, t, name in left:
        best = []
        for j, u, n in right:
            if j != k or t is None or u is None or (tolerance is not None and abs(t - u) > tolerance):
                continue
            if direction == "nearest" or (u <= t if direction == "backward" else u >= t):
                best.append((abs(t - u), u, n))
        near = [b for b in best if b[0] == min(best)[0]]
        first = min((b[1] for b in near), default=None)
        want.append((k, name, first, max((b[2] for b in near if b[1] == first), default=None)))
    l = spark.createDataFrame(left, "k string, t double, l string")  # noqa: E741
    r = spark.createDataFrame(right, "k string, u double, r string")
    got = asof_join(l, r, ["k"], "t", "u", ["r"], cell, direction, tolerance)
    assert got.columns == ["k", "t", "l", "u", "r"]
    assert sorted(((x.k, x.l, x.u, x.r) for x in got.collect()), key=repr) == sorted(want, key=repr)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "k string, t double, l string")
    one = spark.createDataFrame([("a", 1.0, "x")], "k string, u double, r string")
    assert asof_join(none, one, ["k"], "t", "u", ["r"], 5.0).collect() == []
    got = asof_join(one.toDF("k", "t", "l"), none.toDF("k", "u", "r"), ["k"], "t", "u", ["r"], 5.0, "nearest").collect()
    assert [tuple(x) for x in got] == [("a", 1.0, "x", None, None)]
