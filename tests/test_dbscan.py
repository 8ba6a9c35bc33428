import numpy as np
import pytest

from pyspark.sql import functions as F

from shelfglass.operators import dbscan as D
from shelfglass.operators.components import component_labels
from shelfglass.operators.dbscan import add_features, chosen_settings, dbscan
from shelfglass.plans.analysis import sweep_long
from shelfglass.staging import stage


def brute(points, eps, min_samples):
    """All pairs; clusters numbered by their first core point, border takes the lowest."""
    x = np.asarray(points, float)
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd)
    near = ((z[:, None] - z[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= min_samples
    label, n = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = n
                    todo += [k for k in np.flatnonzero(near[j] & core) if label[k] < 0]
            n += 1
    for i in range(len(x)):
        if not core[i]:
            owners = label[near[i] & core]
            label[i] = owners.min() if len(owners) else -1
    return list(label)


def frame(spark, groups, schema="id bigint, grp string, height double, width double, depth double"):
    rows = [(g, *map(float, p)) for g, pts in groups.items() for p in pts]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema), rows


def got(df, **kw):
    out = dbscan(df, ["grp"], "id", **kw).collect()
    return {(r["eps"], r["min_samples"], r["id"]): r["cluster"] for r in out}


def blobs(seed, n, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(5, 60, (4, 3))
    return np.vstack([c + rng.normal(0, spread, (n // 5, 3)) for c in centres]
                     + [rng.uniform(1, 70, (n // 5, 3))])


@pytest.mark.parametrize("leaf", [2, 64])
def test_equals_brute_force_on_raw_dimensions(spark, leaf):
    groups = {"a": blobs(1, 200), "b": blobs(2, 120, 3.0), "one": [[1, 2, 3]],
              "grid": [[i % 6, i // 6, 1] for i in range(36)]}
    df, rows = frame(spark, groups)
    configs = [(0.3, 4), (0.9, 3)] if leaf == 2 else [(2.5, 2)]
    result = got(df, configs=configs, settings=["size"], drop_nonpositive=False, leaf=leaf)
    start = 0
    for pts in groups.values():
        for eps, m in configs:
            want = brute(pts, eps * 1.0000001, m)
            assert [result[(eps, m, start + i)] for i in range(len(pts))] == want
        start += len(pts)


def test_equals_brute_force_on_all_features(spark):
    pts = np.abs(blobs(5, 150, 2.0)) + 0.5
    df, _ = frame(spark, {"a": pts})
    h, w, d = pts.T
    features = np.column_stack([h, w, d, h / (w + 1e-6), w / (d + 1e-6), h / (d + 1e-6), h * w * d])
    configs = [(1.0, 4), (0.5, 3)]
    result = got(df, configs=configs)
    for eps, m in configs:
        assert [result[(eps, m, i)] for i in range(len(pts))] == brute(features, eps, m)


def test_dense_cells_copies_and_row_order(spark):
    """Two thick slabs whose gap is just below, then just above eps; copies; a reversed order."""
    rng = np.random.default_rng(7)
    a = np.column_stack([rng.uniform(0, 1, 100), rng.uniform(0, 1, 100), np.zeros(100)])
    groups = {str(s): np.vstack([a, a + [s, 0, 0]]) for s in (1.6, 1.9, 2.3)}
    groups["copies"] = [[5, 5, 5]] * 4 + [[50, 50, 50]] * 3 + [[90, 1, 30]]
    groups["order"] = blobs(9, 100)
    groups["reversed"] = groups["order"][::-1]
    df, _ = frame(spark, groups)
    result = got(df, configs=[(1.0, 4), (0.4, 4)], settings=["size"], drop_nonpositive=False, leaf=2)
    start, noise = 0, {}
    for name, pts in groups.items():
        for eps in (1.0, 0.4):
            mine = [result[(eps, 4, start + i)] for i in range(len(pts))]
            assert mine == brute(pts, eps, 4), name
            noise[(name, eps)] = [c == -1 for c in mine]
        # Noise shrinks as eps grows.
        assert all(x or not y for x, y in zip(noise[(name, 0.4)], noise[(name, 1.0)], strict=True))
        start += len(pts)
    assert noise[("copies", 0.4)] == [False] * 4 + [True] * 4
    assert noise[("order", 0.4)] == noise[("reversed", 0.4)][::-1]


def test_unusable_rows_take_no_part(spark):
    rows = [(i, "a", float(i), 1.0, 1.0) for i in range(1, 6)] + [
        (6, "a", None, 1.0, 1.0), (7, "a", 0.0, 1.0, 1.0), (8, "a", -1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id bigint, grp string, height double, width double, depth double")
    result = got(df)
    assert [result[(1.0, 4, i)] for i in (6, 7, 8)] == [None] * 3
    assert None not in [result[(1.0, 4, i)] for i in range(1, 6)]


def test_sweep_runs_only_with_enough_rows(spark):
    rows = [(i, "a", 1.0 + i, 2.0, 3.0) for i in range(3)] + [(9, "b", 0.0, 1.0, 1.0), (10, "b", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "product_id bigint, category string, height double, width double, depth double")
    out = {(r["product_id"], r["min_samples"]): r for r in sweep_long(df, [(3.0, 2), (3.0, 4)]).collect()}
    assert out[(0, 4)]["executed"] is False and out[(0, 4)]["outliers"] is None
    assert out[(0, 2)]["status"] == 1 and out[(0, 2)]["cluster_items_per"] == 100.0
    # b has two rows but one usable: executed without outliers and without statuses.
    assert out[(10, 2)]["executed"] and out[(10, 2)]["outliers"] == 0 and out[(10, 2)]["status"] is None


def test_feature_choice(spark):
    assert chosen_settings(["VOLUME ", "colour"]) == ["volume"]
    assert chosen_settings([]) == chosen_settings(["none"]) == ["size", "shape", "volume"]
    df = spark.createDataFrame([(2.0, 4.0, 8.0)], "height double, width double, depth double")
    featured, names = add_features(df, ["volume"])
    assert names == ["f_volume"] and featured.first()["f_volume"] == 64.0


def test_components_of_paths_hubs_and_rings(spark):
    edges = [(1, i, i + 1) for i in range(40)]                       # a path
    edges += [(2, 100, i) for i in range(200, 260)]                   # a hub
    edges += [(3, i, (i + 1) % 9) for i in range(9)] + [(3, 20, 21), (3, 21, 22)]
    edges += [(4, 5, 9), (4, 9, 7), (4, 7, 8), (4, 6, 8), (4, 1, 2)]
    rng = np.random.default_rng(2)
    edges += [(5, int(a), int(b)) for a, b in rng.integers(0, 80, (70, 2)) if a != b]
    df = spark.createDataFrame(edges, "g bigint, u bigint, v bigint")
    got_labels = {(r["g"], r["node"]): r["label"] for r in component_labels(df, ["g"]).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for g, u, v in edges:
        a, b = root((g, u)), root((g, v))
        parent[max(a, b)] = min(a, b)
    assert got_labels == {n: root(n)[1] for n in list(parent)}


def test_no_edges(spark):
    df = spark.createDataFrame([], "g bigint, u bigint, v bigint")
    assert component_labels(df, ["g"]).count() == 0


def spread_cells(spark, n, d, side, eps):
    """Cells of points spread evenly over a square that grows with their number; the other features
    follow from the place, so density stays the same."""
    rng = np.random.default_rng(n + d)
    x, y = rng.uniform(0, side, n), rng.uniform(0, side, n)
    z = np.stack([x, y] + [np.sin(x * (i + 1)) * 2 for i in range(d - 2)], axis=1)
    rows = [(0, 0, eps, i, 1, *map(float, p)) for i, p in enumerate(z)]
    points = spark.createDataFrame(rows, "g int, k int, eps double, first int, v int, " + ", ".join(
        f"z{i} double" for i in range(d))).withColumn("cell", D._cell_at(0, d))
    cells = stage(points.groupBy("g", "k", "eps", "cell").agg(*D._summary(d, F.sum)), "cells")
    return cells, cells.count()


@pytest.mark.parametrize("d", [2, 4, 7])
def test_pairs_formed_grow_with_pairs_within_reach(spark, d):
    formed, reach, cells = {}, {}, {}
    for n, side in ((500, 25.0), (2000, 50.0)):
        table, cells[n] = spread_cells(spark, n, d, side, 1.0)
        formed[n] = []
        pairs = D.cell_pairs(table, d, formed[n])
        rows = table.collect()
        lo = np.array([[r[f"lo{i}"] for i in range(d)] for r in rows])
        hi = np.array([[r[f"hi{i}"] for i in range(d)] for r in rows])
        node = np.array([r["node"] for r in rows])
        gap = np.maximum(0, np.maximum(lo[:, None] - hi[None], lo[None] - hi[:, None]))
        near = ((gap ** 2).sum(-1) <= 1.0) & (node[:, None] < node[None])
        want = {(int(node[i]), int(node[j])) for i, j in zip(*np.nonzero(near), strict=True)}
        assert {(r["a_node"], r["b_node"]) for r in pairs.collect()} == want
        reach[n] = len(want) + cells[n]
    growth = sum(formed[2000]) / sum(formed[500])
    assert growth < 1.6 * reach[2000] / reach[500]
    assert sum(formed[2000]) < cells[2000] ** 2 / 6


def test_settings_of_one_eps_share_their_grid(spark, monkeypatch):
    seen = []
    real = D.cell_pairs
    monkeypatch.setattr(D, "cell_pairs", lambda cells, d, formed=None: (
        seen.append(cells.select("g", "k").distinct().count()), real(cells, d, formed))[1])
    groups = {"a": blobs(7, 150), "b": blobs(8, 100, 2.0)}
    df, _ = frame(spark, groups)
    configs = [(e, m) for m in (4, 2, 3) for e in (0.5, 1.0)]
    result = got(df, configs=configs, settings=["size"], drop_nonpositive=False)
    assert seen == [4]  # two groups under two eps, not under six settings
    for (e, m) in configs:
        for start, pts in ((0, groups["a"]), (150, groups["b"])):
            want = brute(pts, e * 1.0000001, m)
            assert [result[(e, m, start + i)] for i in range(len(pts))] == want


def test_rows_of_a_sweep_are_not_shuffled_per_setting(spark):
    """Rows are repeated for the settings above all joins; figures are counted over points."""
    df = spark.createDataFrame(
        [(i, "a", 1.0 + i % 3, 1.0, 1.0) for i in range(6)] + [(6, "a", None, 1.0, 1.0)],
        "product_id long, category string, height double, width double, depth double")
    long = sweep_long(df, [(3.0, 2), (3.0, 7)])
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < min(plan.index(x) for x in ("Exchange", "Join"))
    got = {(r.product_id, r.min_samples): (r.executed, r.outliers, r.status, r.cluster_items,
                                           r.cluster_items_per) for r in long.collect()}
    assert got[0, 2] == (True, 0, 1, 6, 100.0)
    assert got[6, 2] == (True, 0, None, None, None)
    assert got[0, 7] == (True, 0, None, None, None)
