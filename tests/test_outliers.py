import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfglass.operators import outliers as O
from shelfglass.operators.numbering import id_bucket, running_number
from shelfglass.operators.quantiles import group_quantiles


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, g, t, float(h), float(w), float(d)) for i, (g, t, h, w, d) in enumerate(rows)],
        "id bigint, grp string, kind string, height double, width double, depth double")


def test_quartile_worked_example(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "v double")
    row = group_quantiles(df, [], ["v"]).first()
    assert (row["v_q1"], row["v_q3"], row["v_min"], row["v_max"], row["n"]) == (1.75, 5.5, 1, 10, 4)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]),
                          st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in group_quantiles(df, ["k"], ["v"], (0.0, 0.3, 1.0), ("a", "b", "c")).collect()}
    for k in {r[0] for r in rows}:
        values = [v for g, v in rows if g == k]
        want = np.quantile(values, [0.0, 0.3, 1.0])
        assert [got[k][f"v_{n}"] for n in "abc"] == pytest.approx(list(want), rel=1e-9, abs=1e-9)
        assert got[k]["n"] == len(values)


def test_copies_and_hot_group_quantiles(spark):
    values = [5.0] * 3000 + [7.0] * 10 + [1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = group_quantiles(df, [], ["v"], (0.25, 0.999), ("a", "b")).first()
    assert [row["v_a"], row["v_b"]] == pytest.approx(list(np.quantile(values, [0.25, 0.999])))


def test_small_groups_and_untyped_rows(spark):
    rows = [("g", "t", h, 1, 1) for h in (1, 2, 3, 4, 100)] + [("g", None, h, 1, 1) for h in range(6)]
    rows += [("g", "small", 9999, 1, 1)]
    flagged = O.flag_outside(O.with_type_bounds(frame(spark, rows), "kind", ["grp"])).collect()
    by = {r["id"]: r for r in flagged}
    assert by[4]["iqr_is_outlier"] and not by[0]["iqr_is_outlier"]
    assert by[7]["n"] == 0 and by[7]["height_upper"] == 0.0 and not by[7]["iqr_is_outlier"]
    assert by[11]["n"] == 1 and by[11]["height_lower"] == 0.0 and not by[11]["iqr_is_outlier"]


def test_untyped_population_is_its_own_group(spark):
    rows = [("g", None, h, 1, 1) for h in (1, 2, 3, 4, 100)]
    flagged = O.flag_outside(O.with_type_bounds(frame(spark, rows), "kind", ["grp"]))
    assert [r["id"] for r in flagged.filter("iqr_is_outlier").collect()] == [4]


def test_clipping_changes_bounds_not_flags(spark):
    rng = np.random.default_rng(3)
    rows = [("g", "t", *v) for v in rng.lognormal(2, 1, (80, 3))]
    df = frame(spark, rows)
    flags = []
    for clip in (True, False):
        out = O.flag_outside(O.with_type_bounds(df, None, ["grp"], clip=clip))
        flags.append({r["id"] for r in out.filter("iqr_is_outlier").collect()})
    assert flags[0] == flags[1] != set()
    wide = O.flag_outside(O.with_type_bounds(df, None, ["grp"], multipliers=3.0))
    assert {r["id"] for r in wide.filter("iqr_is_outlier").collect()} < flags[0]


def test_constant_dimension_standardises_to_zero(spark):
    df = frame(spark, [("g", "t", 5, i, 1) for i in range(4)])
    row = O.standardized(df, ["grp"], ["height", "width"]).orderBy("id").first()
    assert row["z_height"] == 0.0 and row["z_width"] == pytest.approx(-1.5 / np.std([0, 1, 2, 3]))


def test_top_outliers_and_extents(spark):
    df = frame(spark, [("g", "t", h, 1, 1) for h in (1, 2, 3, 4, 100, 300)])
    flagged = O.flag_outside(O.with_type_bounds(df, None, ["grp"], multipliers=0.1))
    assert O.top_outliers(flagged, "iqr_is_outlier", "id", 1).first()["id"] == 5
    ext = O.axis_extents(df).first()
    assert ext["height_from"] == 1 - 0.15 * 299 and ext["width_to"] == 6


def test_running_number_over_buckets(spark):
    ids = [3, 70000, 65536, 10, 200000]
    df = spark.createDataFrame([(k, i) for k in "ab" for i in ids], "k string, i bigint")
    out = running_number(df, ["k"], "i", id_bucket("i"), "n").filter("k = 'b'").orderBy("i").collect()
    assert [(r["i"], r["n"]) for r in out] == [(3, 1), (10, 2), (65536, 3), (70000, 4), (200000, 5)]


def test_totals_count_excluded_rows(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    row = O.outlier_totals(df, "f").first()
    assert (row["total"], row["outliers"], row["normals"], row["excluded"], row["outlier_pct"]) == (
        3, 1, 1, 1, 33.33)


def test_crowded_bands_are_split_until_they_fit(spark, monkeypatch):
    """A million distinct values within one band, and as many copies of one value."""
    from shelfglass.operators import quantiles as Q

    most, seen = 5_000, []
    real = Q.null_safe_join

    def watched(left, right, keys, how="inner"):
        joined = real(left, right, keys, how)
        if "_values" in right.columns and "_v" in left.columns:  # what a window is going to order
            seen.append(joined.groupBy(*keys).count().agg({"count": "max"}).first()[0] or 0)
        return joined

    monkeypatch.setattr(Q, "null_safe_join", watched)
    n = 1_000_000
    df = spark.range(n).selectExpr(
        "id % 2 AS g", "1 + pmod(id * 7919, 1000000) * 1e-9 AS x", "CASE WHEN id % 3 = 0 THEN id * 1.0 ELSE 5.0 END AS y")
    rows = {r["g"]: r for r in Q.group_quantiles(df, ["g"], ["x", "y"], most=most).collect()}
    assert max(seen) <= most and len(seen) > 1
    ids = np.arange(n)
    x = 1 + (ids * 7919 % 1_000_000) * 1e-9
    y = np.where(ids % 3 == 0, ids * 1.0, 5.0)
    for g in (0, 1):
        for c, v in (("x", x), ("y", y)):
            q1, q3 = np.quantile(v[ids % 2 == g], [0.25, 0.75])
            assert rows[g][f"{c}_q1"] == pytest.approx(q1, rel=1e-12)
            assert rows[g][f"{c}_q3"] == pytest.approx(q3, rel=1e-12)
