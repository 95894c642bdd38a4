"""Hard negatives against all products of anchors and rows, and the bounds they rest on."""

import math

import numpy as np
import pytest

from gleaner.llm import negatives


def mined(rows, every=100, positives=5, n=10):
    """The result from (id, label, vector), by all products."""
    given = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        given[i, label, tuple(v)] = [math.floor(256 * x) for x in v]
    out = []
    for (i, label, v), own in given.items():
        if i % every:
            continue
        score = {k: sum(x * y for x, y in zip(own, other, strict=False)) for k, other in given.items() if k != (i, label, v)}
        first = lambda keys, k, score=score: sorted(keys, key=lambda o: (-score[o], o[0]))[:k]
        for p in first([o for o in score if o[1] == label], positives):
            low, high = 30 * score[p], 90 * score[p]
            found = first([o for o in score if o[1] != label and low <= 100 * score[o] <= high], n)
            out += [(i, p[0], k, o[0], score[p], score[o]) for k, o in enumerate(found, 1)]
    return sorted(out)


def got(spark, rows, kind="float", **how):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>, id long, tie string, v int")
    return sorted(tuple(r) for r in negatives.mined(df, **how).collect())


def wide(rows):
    return [(*r, 1, "x", 2) for r in rows]


def side(rng, n, width=64, labels=4):
    rows = np.floor(256 * rng.normal(0, 0.12, (n, width)))
    return negatives.Side(np.arange(n), rng.integers(0, labels, n), np.zeros(n, np.int64), rows, *negatives.summaries(rows))


def test_bounds_hold_and_narrow_ones_are_tighter():
    rng = np.random.default_rng(0)
    a, b = side(rng, 50), side(rng, 80)
    exact = a.rows @ b.rows.T
    reach = []
    for level in (0, 1):
        low, high = negatives.bounds(a, b, level)
        assert (low <= exact).all() and (exact <= high).all()
        i, j = np.nonzero(np.ones_like(exact))
        assert np.allclose(negatives.bounds(a, b, level, (i, j))[1], high.reshape(-1))
        reach.append((high - low).mean())
    assert reach[1] < reach[0]
    wide_m, wide_d = negatives.widened(*negatives.summaries(a.rows))
    cut = a.rows.reshape(50, -1, 16)
    assert np.allclose(wide_m, cut.mean(axis=2)) and np.allclose(wide_d, cut.std(axis=2))


@pytest.mark.parametrize("tile", [7, 1024])
def test_filters_leave_what_counts(monkeypatch, tile):
    monkeypatch.setattr(negatives, "TILE", tile)
    rng = np.random.default_rng(1)
    smooth = np.repeat(rng.normal(0, 0.12, (300, 16)), 4, axis=1) + rng.normal(0, 0.01, (300, 64))  # segments of like components
    rows = np.floor(256 * smooth)
    b = negatives.Side(np.arange(300), rng.integers(0, 4, 300), np.zeros(300, np.int64), rows, *negatives.summaries(rows))
    a = b.part(np.arange(0, 300, 20))
    exact = (a.rows @ b.rows.T).astype(int)
    seen = {}
    owner, score, ids, _ = negatives.nearest_alike(a, b, 5, seen)
    for k in range(len(a)):
        want = sorted((-exact[k, j], j) for j in range(300) if b.labels[j] == a.labels[k] and b.ids[j] != a.ids[k])[:5]
        assert [(-s, i) for s, i in zip(score[owner == k].tolist(), ids[owner == k].tolist(), strict=True)] == want
    assert seen["narrow"] < seen["wide"] <= seen["all"]
    own = np.repeat(np.arange(len(a)), 2)
    low, high = np.tile([10, 500], len(a)), np.tile([3000, 2000], len(a))
    owner, score, ids, _ = negatives.best_within(a, b, own, low, high, 10, seen)
    for w in range(len(own)):
        k = own[w]
        want = sorted((-exact[k, j], j) for j in range(300) if b.labels[j] != a.labels[k] and low[w] <= exact[k, j] <= high[w])[:10]
        assert [(-s, i) for s, i in zip(score[owner == w].tolist(), ids[owner == w].tolist(), strict=True)] == want


def test_all_products(spark, monkeypatch):
    """Several blocks of anchors and rows, copies of one vector, ties, rows that take no part, vectors of other lengths."""
    monkeypatch.setattr(negatives, "FEW_ROWS", 90)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.integers(0, 10)), [float(np.float32(x)) for x in rng.normal(0.05, 0.15, 24)]) for k in range(700)]
    rows += [(k, k % 10, rows[3][2]) for k in range(700, 900)]
    rows += [(900, 1, None), (901, None, rows[0][2]), (None, 1, rows[0][2]), (1000, 2, [None, 1.0]), (1100, 2, [float("nan")] * 24), (1200, 2, [float("inf")] * 24)]
    rows += [(1300, 3, [0.5, 0.25]), (1301, 3, []), (1400, 4, []), (1500, 5, [0.01] * 40), (5, rows[5][1], rows[5][2]), (8, 3, rows[9][2]), (-100, 3, rows[9][2])]
    assert got(spark, wide(rows)) == mined(rows)


def test_few_rows(spark):
    assert got(spark, wide([(0, 1, [1.0, 2.0])])) == [] == mined([(0, 1, [1.0, 2.0])])
    rows = [(100, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.5, 0.0]), (3, 1, [0.0, 0.0]), (4, 2, [0.0, 1.0])]
    assert got(spark, wide(rows)) == mined(rows) != []
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.mined(empty).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert not negatives.mined(empty).count()


def test_large_components(spark):
    """Sums of products that doubles cannot hold exactly."""
    rng = np.random.default_rng(6)
    rows = [(k * 20, k % 3, [float(x) for x in rng.normal(3e4, 1e4, 8)]) for k in range(60)]
    assert got(spark, wide(rows), "double") == mined(rows)
    rows = [(i, label, [x * 30 for x in v]) for i, label, v in rows]
    assert got(spark, wide(rows), "double") == mined(rows)
