import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfglass.llm import hard_negatives, residues

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, id string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def brute(rows, is_anchor, positives=5, negatives=3):
    usable = []
    for key, vec, label in rows:
        if key is None or vec is None or label is None or any(
                x is None or not math.isfinite(x) for x in vec):
            continue
        row = (key, [math.floor(256 * float(np.float32(x))) for x in vec], label)
        if row not in usable:
            usable.append(row)
    out = []
    for a in usable:
        if not is_anchor(a[0]):
            continue
        scored = [(-sum(x * y for x, y in zip(a[1], r[1], strict=True)), r[0], r[2]) for r in usable
                  if r[0] != a[0] and len(r[1]) == len(a[1])]
        for p in sorted(s for s in scored if s[2] == a[2])[:positives]:
            fits = [s for s in sorted(scored) if s[2] != a[2]
                    and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:negatives]
            out += [(a[0], p[1], i + 1, s[1], -p[0], -s[0]) for i, s in enumerate(fits)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**31), st.integers(0, 150), st.sampled_from([1, 40, 9000, 2**20, 2**22]))
def test_products_are_exact(seed, depth, most):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(-most, most + 1, (n, depth)) for n in (3, 5))
    bound = max([int((m.astype(object) ** 2).sum(axis=1).max()) for m in (a, b)]) if depth else 0
    primes = residues.primes_for(bound)
    got = residues.product(residues.Residues(a, primes), slice(0, 3), residues.Residues(b, primes), slice(1, 4))
    assert (got == (a.astype(object) @ b.T.astype(object))[:, 1:4]).all()


def test_extreme_products_are_exact():
    """Every residue at its largest, and the largest scores that are allowed."""
    for value, depth in ((359, 64), (360, 64), (2**23, 64), (2**25, 4)):
        a = np.full((2, depth), value)
        a[1] = -a[1]
        primes = residues.primes_for(depth * value * value)
        whole = residues.Residues(a, primes)
        got = residues.product(whole, slice(0, 2), whole, slice(0, 2))
        assert got.tolist() == [[depth * value**2, -depth * value**2], [-depth * value**2, depth * value**2]]
    with pytest.raises(ValueError):
        residues.primes_for(2**53)


def made(n=300, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(4, dims))
    rows = []
    for k in range(n):
        label = int(rng.integers(0, 4))
        rows.append((k, [float(np.float32(x)) for x in centers[label] * rng.choice([0.3, 0.6, 1.0])
                         + rng.normal(size=dims) * 0.5], label))
    return rows


def test_matches_brute_force(spark):
    rows = made()
    hot = [float(x) for x in np.float32([0.5] * 8)]
    rows += [(k, hot, k % 3) for k in range(400, 550)]  # a vector that a third of all rows share
    got = hard_negatives.mine(frame(spark, rows), F.expr("id % 20 = 0"))
    want = brute(rows, lambda k: k % 20 == 0)
    assert rows_of(got) == want and want


def test_groups_and_blocks_change_nothing(spark, monkeypatch):
    rows = made(120)
    want = brute(rows, lambda k: k % 10 == 0)
    monkeypatch.setattr(hard_negatives, "TASK_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "TASK_ANCHORS", 5)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 3)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 2)
    assert rows_of(hard_negatives.mine(frame(spark, rows), F.expr("id % 10 = 0"))) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, v, x) for k, v, x in made(60)]
    rows += [(None, rows[0][1], 1), (60, None, 1), (61, [None] * 8, 1), (62, [nan] * 8, 1),
             (63, [inf] + [0.0] * 7, 1), (64, rows[0][1], None), (65, [], 1), (70, [], 2), (80, [], 1),
             (66, [0.0] * 8, 1), (67, [1.0, 2.0], 1), (90, [1.0, 2.0], 1), (68, [0.9, 1.5], 2),
             (10, rows[3][1], 2), rows[20], rows[20], (100, rows[20][1], rows[20][2])]
    got = hard_negatives.mine(frame(spark, rows), F.expr("id % 10 = 0"))
    assert rows_of(got) == brute(rows, lambda k: k % 10 == 0)
    for few in ([], [(None, None, None)], rows[:1]):
        assert rows_of(hard_negatives.mine(frame(spark, few), F.expr("id % 10 = 0"))) == []


def test_scores_beyond_a_long_are_an_error(spark):
    with pytest.raises(Exception, match="scale the vectors down"):
        hard_negatives.mine(frame(spark, [(0, [1e9], 1), (1, [1e9], 1)]), F.expr("id = 0")).collect()
