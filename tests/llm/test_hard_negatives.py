"""Hard negatives against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from returnlens.llm import hard_negatives as mining

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vector string, anchor string, i string, piece int"


def frame(spark, rows):
    return spark.createDataFrame([(*row, None, "x", "y", "z", 1) for row in rows], SCHEMA).repartition(3)


def expected(rows, every=10, most=5):
    """All pairs, in whole numbers of Python."""
    known = {}
    for key, vector, label in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2] is None, r[2] or 0)):
        if key is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        known.setdefault(key, (label, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in vector]))
    out = []
    for anchor, (label, own) in known.items():
        if anchor % every:
            continue
        scores = {k: sum(a * b for a, b in zip(own, v)) for k, (_, v) in known.items() if k != anchor}
        order = sorted(scores, key=lambda k: (-scores[k], k))
        for positive in [k for k in order if known[k][0] == label][:most]:
            top = scores[positive]
            fitting = [k for k in order if known[k][0] != label and 80 * top <= 100 * scores[k] <= 100 * top]
            out += [(anchor, positive, n, k, top, scores[k]) for n, k in enumerate(fitting[:most], 1)]
    return sorted(out)


def mined(spark, rows, every=10):
    found = mining.hard_negatives(frame(spark, rows), F.col("vec_id") % every == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def test_clusters_ties_and_copies(spark, monkeypatch):
    """Rounds of few rows, small pieces and blocks, so that certificates and cuts matter."""
    for name, value in {"FIRST_ROWS": 16, "GROWTH": 2, "PIECE": 7, "ANCHORS": 5, "ROWS_PER_CELL": 6}.items():
        monkeypatch.setattr(mining, name, value)
    random = np.random.default_rng(3)
    centres = random.standard_normal((6, 8))
    rows = [(k, (centres[k % 6] + 0.2 * random.standard_normal(8)).tolist(), int(k % 6) // 2) for k in range(150)]
    rows += [(k, rows[0][1], k % 2) for k in range(150, 190)]  # one vector under two labels
    rows += [(k, np.round(random.standard_normal(8)).tolist(), k % 3) for k in range(190, 230)]  # ties
    assert mined(spark, rows) == expected(rows)


def test_rows_that_take_no_part(spark):
    good = [(k, [1.0, 0.1 * k, -0.2, 0.5], k % 2) for k in range(20)]
    bad = [
        (None, [1.0, 1.0, 1.0, 1.0], 1), (30, None, 1), (40, [1.0, None, 0.0, 0.0], 0), (50, [1.0, 2.0, 3.0, 4.0], None),
        (60, [float("nan"), 1.0, 0.0, 0.0], 0), (70, [float("inf"), 1.0, 0.0, 0.0], 1),
    ]
    odd = [(80, [0.0, 0.0, 0.0, 0.0], 0), (90, [], 1), (91, [2.0], 0), (92, [-1.0, 0.5, 0.0, 0.0, 3.0], 1)]
    padded = [(k, (v + [0.0] * 5)[:5], label) for k, v, label in good + odd]
    huge = [(100, [1e9, 0.0, 0.0, 0.0], 0)]
    assert mined(spark, good + bad + odd + huge) == expected(padded)


def test_repeated_keys_are_one_row(spark):
    rows = [(k, [1.0, 0.1 * k], k % 2) for k in range(12)]
    again = [(3, [0.5, 0.5], 0), (3, [9.0, 9.0], 1), (10, [1.0, 1.0], 0)]
    smallest = [r for r in rows if r[0] != 3] + [(3, [0.5, 0.5], 0)]
    assert mined(spark, rows + again + rows) == expected(smallest)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 1)], [(10, [1.0], 0)]])
def test_nothing_to_mine(spark, rows):
    assert mined(spark, rows) == []


def test_visits_are_in_order_and_bounds_hold():
    random = np.random.default_rng(5)
    rows = random.integers(-300, 300, (400, 6)).astype(float)
    halves = mining.codebook(rows[:, :3], 7), mining.codebook(rows[:, 3:], 7)
    own = mining.nearest(rows[:, :3], halves[0]), mining.nearest(rows[:, 3:], halves[1])
    radii = tuple(
        np.array([np.linalg.norm(part[o == w] - words[w], axis=1).max(initial=0) for w in range(len(words))])
        for part, words, o in zip((rows[:, :3], rows[:, 3:]), halves, own)
    )
    cells = {}
    for cell in zip(*map(np.ndarray.tolist, own)):
        cells[cell] = cells.get(cell, 0) + 1
    index = mining.Index(halves, radii, cells)
    for vector in rows[:20]:
        found = list(index.visits(vector))
        assert sorted((i, j) for _, i, j in found) == sorted(cells)
        bounds = [b for b, _, _ in found]
        assert bounds == sorted(bounds, reverse=True)
        for bound, i, j in found:
            assert (rows[(own[0] == i) & (own[1] == j)] @ vector).max() <= bound


def test_products_of_large_numbers_are_exact():
    a = np.array([[2.0**20 - 1, -(2.0**20) + 3]] * 2)
    wide = np.tile(a, (1, 8192))
    assert mining.products(wide, wide)[0, 0] == sum(int(x) ** 2 for x in wide[0])
