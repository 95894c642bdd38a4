"""Cells laid into boxes, and overlaps of masks, against plain loops."""

import numpy as np
import pytest

from gleaner.operators import grids, selection


def test_cells_are_placed_by_their_grid_alone(spark):
    r = np.random.default_rng(2)
    cells = [(g, y, x, 100 * g + 10 * y + x) for g in range(12) for y in range(-1, 6) for x in range(-1, 8)]
    boxes = [(g, *r.integers(-4, 8, 2).tolist(), *r.integers(5, 20, 2).tolist()) for g in range(12)] + [(0, 3, 3, 3, 9)]
    want = []
    for g, x1, y1, x2, y2 in boxes:
        x1, y1, x2, y2 = max(0, min(x1, 12)), max(0, min(y1, 8)), max(0, min(x2, 13)), max(0, min(y2, 9))
        want += [(g, ty, tx, 100 * g + 10 * ((ty - y1) * 5 // (y2 - y1)) + (tx - x1) * 7 // (x2 - x1)) for ty in range(y1, y2) for tx in range(x1, x2)]
    out = grids.placed(spark.createDataFrame(cells, "grid_id long, y long, x long, v long"), spark.createDataFrame(boxes, "grid_id long, x1 long, y1 long, x2 long, y2 long"), 7, 5, 13, 9)
    assert sorted(tuple(row) for row in out.collect()) == sorted(want)
    assert "ty" not in next(line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line)


@pytest.mark.parametrize("most", [1_000_000, 90, 0])
def test_masks_of_an_image_are_met_in_one_task(spark, monkeypatch, most):
    monkeypatch.setattr(selection, "PASS_CELLS", most, raising=False)
    monkeypatch.setattr(selection, "BLOCK", 50, raising=False)
    r = np.random.default_rng(3)
    masks = {(g, p, s): {(int(y), int(x)) for y, x in r.integers(0, 4, (int(r.integers(3, 14)), 2))} for g in range(6) for p in range(6 + g) for s in "ab" if r.random() > 0.1}
    over = lambda a, b: bool(a & b) and len(a & b) / len(a | b) > 0.3
    want = []
    for g in range(6):
        kept = []
        for p in range(6 + g):
            m = lambda q, s: masks.get((g, q, s), set())  # noqa: B023, E731
            if not any((over(m(p, "a"), m(q, "a")) and over(m(p, "b"), m(q, "b"))) or (over(m(p, "a"), m(q, "b")) and over(m(p, "b"), m(q, "a"))) for q in kept):
                kept.append(p)
        want += [(g, p) for p in kept]
    cells = spark.createDataFrame([(*k, y, x) for k, m in masks.items() for y, x in m], "image_id long, pair_id long, side string, y long, x long")
    pairs = spark.createDataFrame([(g, p) for g in range(6) for p in range(6 + g)], "image_id long, pair_id long")
    out = selection.dedup_pairs(pairs, cells, 0.3)
    assert sorted(tuple(row) for row in out.collect()) == want
    on_cells = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in line and "(y#" in line]
    assert bool(on_cells) == (most < 1_000_000)
