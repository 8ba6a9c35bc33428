import zlib

import numpy as np
import pytest
from conftest_llm import ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfglass.llm import cotraining, hnsw, toxicity

DIM = 16


def brute_segments(scores):
    """Ruzzo and Tompa by definition: the best segment, then the same on both sides of it."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or total > best[2] + 1e-9):
                best = (a, b + 1, total)
    if best is None:
        return []
    a, b, _ = best
    right = [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]
    return brute_segments(scores[:a]) + [best] + right


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([None, 1.37, 2.11, 0.53]), max_size=14))
def test_maximal_segments(found):
    rest = -0.71
    places = [i for i, s in enumerate(found) if s]
    got = toxicity.maximal_segments(places, [found[i] for i in places], rest)
    want = brute_segments([rest if s is None else s for s in found])
    assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in want))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def corpus(n=600):
    rng = np.random.default_rng(8)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for k in range(n):
        text = [words[i] for i in rng.integers(0, 300, rng.integers(5, 80))]
        bad = k % 7 == 0
        junk = k % 5 == 0
        if bad:
            for _ in range(3):
                text.insert(int(rng.integers(0, len(text))), rng.choice(["scoundrel", "vermin"]))
        if junk:
            text = [w.upper() + "!!" for w in text]
        rows.append((k, " ".join(text), f"s{k % 3}"))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, int(not junk), int(bad)))
    return rows, labels


def split(rows, column):
    truth = {k: v for k, _, v in column} if isinstance(column, list) else column
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows
               if r["doc_id"] is not None)
    return np.mean([r["predicted"] == truth[r["doc_id"]] for r in held])


def test_toxicity_on_held_out_rows(spark, make_docs):
    rows, labels = corpus()
    frame = spark.createDataFrame([(k, t) for k, _, t in labels] + [(3, None), (None, 1)],
                                  "doc_id long, toxic int")
    out = toxicity.score_toxicity(make_docs(rows + [(k + 10_000, t) for k, t in ODD if k]), frame)
    got = out.collect()
    assert len(got) == len(rows) + len(ODD) - 1 and all(0 <= r["score"] <= 1 for r in got)
    assert split(got, {k: int(k % 7 == 0) for k, *_ in rows}) > 0.97


def test_quality_on_held_out_rows(spark, make_docs):
    rows, labels = corpus()
    frame = spark.createDataFrame([(k, q) for k, q, _ in labels] + [(3, None), (None, 1)],
                                  "doc_id long, quality int")
    got = cotraining.score_quality(make_docs(rows + [(k + 10_000, t) for k, t in ODD if k]),
                                   frame).collect()
    assert len(got) == len(rows) + len(ODD) - 1 and all(0 <= r["score"] <= 1 for r in got)
    assert split(got, {k: int(k % 5 != 0) for k, *_ in rows}) > 0.95


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (4, 0)]])
def test_too_few_labels(spark, odd, make_docs, labels):
    for op, name in ((toxicity.score_toxicity, "toxic"), (cotraining.score_quality, "quality")):
        frame = spark.createDataFrame(labels, f"doc_id long, {name} int")
        got = op(odd, frame).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
        if name == "toxic" and not labels:
            assert not any(r["predicted"] for r in got)
        assert op(make_docs([]), frame).collect() == []


def test_views_exchange_labels():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 4000).astype(float)
    views = [np.c_[y * 3 + rng.normal(size=4000), rng.normal(size=4000)] for _ in range(2)]
    learn, pool = [v[:40] for v in views], [v[40:3000] for v in views]
    models = cotraining.cotrain(learn, y[:40], pool)
    for m, v in zip(models, views, strict=True):
        assert ((m.log_odds(v[3000:]) > 0) == (y[3000:] > 0)).mean() > 0.9


def vectors(n=700):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(12, DIM))
    x = (centers[rng.integers(0, 12, n)] + rng.normal(size=(n, DIM)) * 0.4).astype(np.float32)
    x[200:420] = x[200]  # a vector that a third of all rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows[3] = (3, None)
    rows[4] = (4, [0.0] * DIM)
    rows[6] = (6, [float("nan")] * DIM)
    rows[7] = (7, [None] * DIM)
    rows[8] = (8, [float("inf")] * DIM)
    return rows + [rows[9], (None, rows[10][1]), (5000, []), (5001, [1.0] * 3)]


@pytest.mark.parametrize("shard", [100, 5000])
def test_nearest_against_brute_force(spark, shard):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in hnsw.nearest(frame, frame.filter("vec_id % 20 = 0"), shard_nodes=shard).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and len(v) == DIM
            and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    hits = total = 0
    for q in [i for i in good if i % 20 == 0]:
        near = sorted((float(np.sqrt(((good[i] - good[q]) ** 2).sum())), i) for i in good if i != q)
        found = sorted(got[q])
        assert [r for r, *_ in found] == list(range(1, 11))
        assert all(s == pytest.approx(float(np.sqrt(((good[i] - good[q]) ** 2).sum())), abs=1e-12)
                   for _, i, s in found)
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hits += len({i for _, i in near[:10]} & {i for _, i, _ in found})
        total += 10
    assert set(got) == {i for i in good if i % 20 == 0} and hits / total >= 0.95


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (20, [3.0, 1.0])],
                                  "vec_id long, embedding array<float>")
    got = hnsw.nearest(frame, frame.filter("vec_id % 20 = 0")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [
        (0, 1, 1), (0, 2, 20), (20, 1, 0), (20, 2, 1)]
    assert hnsw.nearest(frame.limit(0), frame.limit(0)).collect() == []
