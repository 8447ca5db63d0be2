"""Series over stretches and ranges: no group, nor the whole table, in one window."""

import numpy as np
import pytest

from tessera.operators import clean, stats


@pytest.mark.parametrize("stretch", [1 << 20, 13, 3])
def test_autocorrelation_over_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(stats, "STRETCH", stretch)
    r = np.random.default_rng(1)
    y = np.cumsum(r.normal(size=90))
    rows = [(i, float(v)) for i, v in enumerate(y)] + [(1000 + i, None) for i in range(9)]
    df = spark.createDataFrame(rows, "t int, y double").repartition(4)
    plan = stats.autocorrelation(df, "t", "y", 5)
    got = {x["lag"]: x["r"] for x in plan.collect()}
    assert got == pytest.approx({k: np.corrcoef(y[k:], y[:-k])[0, 1] for k in range(1, 6)})
    assert [x["r"] for x in stats.autocorrelation(df.limit(0), "t", "y", 2).collect()] == [None, None]


@pytest.mark.parametrize("backward", [False, True])
def test_fills_of_a_group_of_nearly_all_rows(spark, backward):
    r = np.random.default_rng(2)
    rows = [(i, None if i % 29 == 0 else "hot" if i % 10 else "few", None if r.random() < 0.7 else float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "i int, g string, x double").repartition(5)
    got = {x["i"]: x["x"] for x in clean.fill_forward(df, "x", "i", ["g"], backward=backward).collect()}
    last, want = {}, {}
    for i, g, x in reversed(rows) if backward else rows:
        last[g] = x if x is not None else last.get(g)
        want[i] = last[g]
    assert got == want and clean.fill_forward(df, "x", "i", ["g"]).columns == df.columns


@pytest.mark.parametrize("backward", [False, True])
def test_fill_of_all_rows_reads_each_row_once(spark, backward):
    rows = [(i, None if i % 7 else i) for i in range(4_000)]
    df = spark.createDataFrame(rows, "i int, x int").repartition(5)
    filled = clean.fill_forward(df, "x", "i", backward=backward)
    # a frame up to the last row takes the square of a range's rows
    assert "unboundedfollowing" not in filled._jdf.queryExecution().optimizedPlan().toString().lower()
    want = {i: (-(-i // 7) * 7 if -(-i // 7) * 7 < 4_000 else None) if backward else i // 7 * 7 for i in range(4_000)}
    assert {r["i"]: r["x"] for r in filled.collect()} == want
