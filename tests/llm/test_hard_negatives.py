"""Hard negatives against all products, and the intervals of the codes against exact products."""

import math
import random

import numpy as np
import pytest

from pagewright.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def plainly(rows):
    """All products, sorted."""
    fine = set()
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        fine.add((i, (label + 1) % 10 if i % 7 == 0 else label, v))
    out = []
    for a in (r for r in fine if r[0] % 100 == 0):
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1] == a[1]) for b in fine if b != a)
        for s, i, _ in [x for x in scored if x[2]][:5]:
            fit = [x for x in scored if not x[2] and -30 * s <= -100 * x[0] <= -90 * s]
            out += [(a[0], i, no + 1, x[1], -s, -x[0]) for no, x in enumerate(fit[:10])]
    return sorted(out)


def vectors(seed, n, width=24):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, .3) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        label = rng.randrange(6)
        rows.append((i, [c + rng.gauss(0, .3) for c in centres[label]], label, "clash"))
    same = [.25] * width
    rows += [(n + i, same, i % 3, "clash") for i in range(120)]  # one very common vector: ties
    rows += rows[:5] + [(100, same, 4, "clash"), (100, None, 1, "x"), (None, same, 1, "x"), (200, same, None, "x"),
                        (300, [math.nan] * width, 1, "x"), (400, [.1, None], 1, "x"), (500, [math.inf], 1, "x"),
                        (600, [], 1, "x"), (700, [.5, -.5], 2, "x"), (-100, [1e5] + same, 1, "x")]
    return rows


def answers(spark, rows, **options):
    out = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), **options)
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"block_rows": 50, "block_anchors": 3})])
def test_equals_all_products(spark, seed, options):
    rows = vectors(seed, 700)
    got, want = answers(spark, rows, **options), plainly(rows)
    assert len(want) > 100 and got == want


def test_empty(spark):
    assert answers(spark, []) == [] and answers(spark, [(100, [1.0], 1, "x")]) == []


@pytest.mark.parametrize("width, size", [(1, 3), (64, 256), (100, 5000), (130, 1 << 26)])
def test_intervals_hold_the_product(width, size):
    rng = np.random.default_rng(width)
    rows = rng.integers(-size, size, (300, width)).astype(np.int32)
    rows[0], rows[1] = 0, rows[2]
    anchors = np.vstack([rows[:3], np.zeros((1, width), np.int32), rng.integers(-size, size, (10, width)).astype(np.int32)])
    lower, upper = hn.Codes(rows).intervals(anchors)
    exact = anchors.astype(object) @ rows.T.astype(object)
    assert (lower <= exact).all() and (upper >= exact).all()
    turned = hn.rotated(rows)
    assert np.allclose(turned @ turned.T, hn.padded(width) ** 2 * (rows.astype(float) @ rows.T.astype(float)))


def test_codes_exclude_most_rows():
    rng = np.random.default_rng(5)
    rows = rng.normal(0, 40, (4000, 64)).astype(np.int32)
    lower, upper = hn.Codes(rows).intervals(rows[:20])
    kept = [hn.reachable(lower[i], upper[i], np.ones(4000, bool), 5).mean() for i in range(20)]
    assert np.mean(kept) < .1
