"""Exact quantiles by range counts against numpy."""

import math

import numpy as np
import pytest

from gleaner.operators import stats

SHARES = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("rows, ranges", [(65_536, 1024), (20, 40)])
def test_quantiles(spark, monkeypatch, rows, ranges):
    """Hot and null groups, ties, one value, extremes far apart, subnormal steps, nulls and NaN."""
    monkeypatch.setattr(stats, "RANGE_ROWS", rows)
    monkeypatch.setattr(stats, "RANGES", ranges)
    r = np.random.default_rng(3)
    groups = {"hot": r.normal(size=3000).round(2), None: r.random(50), "same": np.full(400, 7.0), "one": np.array([3.5]), "far": np.concatenate([[-1e300, 1e300], r.random(100) * 1e-3]), "tiny": np.array([0.0, 5e-324, 1e-323] * 30), "two": np.array([1.0, 2.0]), "spread": np.repeat(2.0 ** np.arange(-60, 60), 3), "ends": np.array([-np.inf, *range(50), np.inf])}
    data = [(k, float(x)) for k, v in groups.items() for x in v] + [("one", None), ("two", float("nan")), ("none", None)]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    got = {r["g"]: r["q"] for r in stats.quantiles(df, "x", SHARES, ["g"]).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        v = np.sort(v)
        for s, q in zip(SHARES, got[k], strict=True):
            at = s * (len(v) - 1)
            low, part = v[math.floor(at)], at - math.floor(at)
            want = low * (1 - part) + v[math.ceil(at)] * part
            assert q == want or math.isclose(q, want, rel_tol=1e-12) or (math.isnan(q) and math.isnan(want))


def test_of_whole_tables(spark):
    df = spark.range(1, 1002).selectExpr("CAST(id AS DOUBLE) AS x")
    assert stats.quantiles(df, "x", [0.5]).first()["q"] == [501.0]
    assert stats.target_size(df.where("false"), df["x"]).first()["target"] == 1024
    plan = stats.distribution(df, "x")._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()
    empty = stats.distribution(df.where("false"), "x").first()
    assert empty["mean"] is None and empty["p25"] is None
