"""Pareto sets and hulls against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from groupwise.operators.pareto import pareto_flags, pareto_hull


def brute(v, eps=0.0):
    kept = []
    for i in range(len(v)):
        others = np.delete(v, i, axis=0)
        kept.append(bool(((v[i] - others < eps).any(axis=1)).all()))
    if not any(kept):
        kept[int(np.argmin(v.sum(axis=1)))] = True
    return kept


@pytest.mark.parametrize("chunk", [20_000, 3])
@pytest.mark.parametrize("eps", [0.0, 1.0])
@pytest.mark.parametrize("dims", [1, 2, 4])
def test_flags(spark, chunk, eps, dims):
    v = np.random.default_rng(dims).integers(0, 6, size=(40, dims)).astype(float)
    names = [f"o{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(v.tolist())], "id long, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: bool(r["kept"]) for r in pareto_flags(df.repartition(5), "id", names, eps, chunk).collect()}
    assert [got[i] for i in range(40)] == brute(v, eps)


def test_a_long_front_is_swept_in_ranges(spark):
    """Every one of 100,000 opposed vectors is on the front; the dominated ones beside it go."""
    from groupwise.operators.pareto import skyline

    front = spark.range(100_000).selectExpr("cast(id as double) as a", "cast(-id as double) as b")
    inside = front.selectExpr("a + 1.5 as a", "b + 0.5 as b")
    got = skyline(front.unionByName(inside).repartition(7), ["a", "b"])
    assert got.count() == 100_000 and got.join(front, ["a", "b"]).count() == 100_000


def test_a_task_holds_a_bounded_front(spark, monkeypatch):
    from groupwise.operators import pareto

    v = np.random.default_rng(1).random((300, 3))
    df = spark.createDataFrame([tuple(r) for r in v.tolist()], "a double, b double, c double").repartition(2)
    want = {tuple(r) for r in pareto._skyline(v)}
    monkeypatch.setattr(pareto, "HELD", 5)
    assert {tuple(r) for r in pareto.skyline(df, ["a", "b", "c"]).collect()} == want


def test_all_equal_keeps_the_first(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0) for i in range(4)], "id long, a double, b double")
    assert {r["id"]: r["kept"] for r in pareto_flags(df, "id", ["a", "b"]).collect()} == {0: 1, 1: 0, 2: 0, 3: 0}


def test_negative_margin_is_refused(spark):
    with pytest.raises(ValueError):
        pareto_flags(spark.range(2).selectExpr("id", "id as a"), "id", ["a"], eps=-1)


def on_hull(p, points):
    """A point of the lower-left chain: some non-negative direction has it as its unique lowest point."""
    for a in np.linspace(0, np.pi / 2, 20_001):
        d = points @ np.array([np.cos(a), np.sin(a)])
        if p @ np.array([np.cos(a), np.sin(a)]) <= d.min() + 1e-12:
            return True
    return False


def test_hull(spark):
    rng = np.random.default_rng(5)
    points = {k: rng.uniform(size=(30, 2)) for k in "ab"}
    rows = [(k, *p) for k, v in points.items() for p in v.tolist()]
    rows += [("few", 0.0, 1.0), ("few", 1.0, 0.0)] + [("line", float(i), 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(7)
    got = pareto_hull(df, "x", "y", ["k"]).toPandas()
    assert set(got["k"]) == {"a", "b"}
    for k, v in points.items():
        chain = got[got.k == k].sort_values("x")[["x", "y"]].to_numpy()
        assert (np.diff(chain[:, 0]) > 0).all() and (np.diff(chain[:, 1]) <= 0).all()
        assert chain[0, 0] == v[:, 0].min() and chain[-1, 1] == v[:, 1].min()
        want = {tuple(p) for p in v if on_hull(p, v)}
        assert {tuple(p) for p in chain} == want
