import pytest
from pyspark.sql import functions as F

from shelfglass.functions import predicates as Q
from shelfglass.plans import iterations as I
from shelfglass.plans import matching as M
from shelfglass.plans.analysis import combine_flags

ATTRIBUTES = (M.Attribute(1, "sku", 35, "sku"), M.Attribute(2, "part_number", 35, "sku"),
              M.Attribute(3, "url", 40, "url", "url"), M.Attribute(4, "price", 25, "price", "number"))


@pytest.fixture()
def tables(spark):
    products = spark.createDataFrame(
        [(1, 101, "ab-12", "PN 1", 100.0, "http://a.com/p/red-chair", "B", "C", "T", "n")],
        "product_id bigint, system_product_id bigint, sku string, part_number string, price double, "
        "url string, brand string, category string, product_type string, name string")
    offers = spark.createDataFrame(
        [(11, 101, 1, "ab-99", 120.0, "http://b.net/red-sofa"), (12, 101, 2, "pn 1", 999.0, None),
         (13, 101, 3, "zz", 9.0, "http://b.net/x"), (14, 999, 3, "ab-12", 125.0, "x")],
        "competitor_product_id bigint, system_product_id bigint, competitor_id bigint, sku string, price double, url string")
    return products, offers


def scored(tables, **options):
    c = M.MatchConfig(ATTRIBUTES, algorithms=("custom",), **options)
    return {r["competitor_product_id"]: r for r in M.run_pairs(*tables, c).collect()}


def test_pair_score_worked_example(tables):
    rows = scored(tables)
    assert sorted(rows) == [11, 12, 13]
    r = rows[11]
    assert (r["sku_custom"], r["part_number_custom"], r["price_custom"]) == (50.0, 0.0, 50.0)
    assert r["url_custom"] == 33.33
    assert r["final_score"] == round((50 * 35 + 100 / 3 * 40 + 50 * 25) / 100, 2)


def test_perfect_match_and_zero_rule(tables):
    rows = scored(tables)
    assert rows[12]["final_score"] == 100.0 and rows[12]["status"] == "Matched"
    assert rows[13]["final_score"] == 0.0
    bulk = {r["competitor_product_id"]: r for r in M.run_pairs(*tables, M.bulk(
        M.MatchConfig(ATTRIBUTES, algorithms=("custom",)))).collect()}
    assert bulk[12]["final_score"] == 35.0 and bulk[12]["status"] == "Not Matched"


def test_selection_weights_and_grouping(tables):
    rows = scored(tables, selected=("price", "url"), weights={"price": 3, "url": 1}, perfect=False)
    assert rows[11]["final_score"] == round((50 * 3 + 100 / 3) / 4, 2)
    flat = {r["competitor_product_id"]: r for r in M.run_pairs(*tables, M.ungrouped(
        M.MatchConfig(ATTRIBUTES, algorithms=("custom",)))).collect()}
    assert flat[12]["final_score"] == round(100 * 35 / 135, 2)


def test_several_algorithms_are_averaged(tables):
    rows = scored(tables)
    c = M.MatchConfig(ATTRIBUTES, algorithms=("custom", "sku", "missing"), selected=("sku",))
    both = {r["competitor_product_id"]: r for r in M.run_pairs(*tables, c).collect()}
    assert both[11]["sku_sku"] == both[11]["sku_custom"] == rows[11]["sku_custom"]
    assert both[11]["final_score"] == 50.0
    with pytest.raises(ValueError, match="margin_diff"):
        M.MatchConfig(ATTRIBUTES, prices={"margin_diff": 1})


def test_best_offer_tie_takes_lowest_id(spark):
    pairs = spark.createDataFrame([(1, 7, 50.0, "x"), (1, 5, 50.0, "y"), (1, 9, 10.0, "z")],
                                  "system_product_id int, competitor_product_id int, final_score double, status string")
    assert M.best_offers(pairs).first()["competitor_product_id"] == 5


def test_recalculation_ignores_unweighted_parts(spark):
    scores = spark.createDataFrame([(1, 10, 100), (2, 10, 101)], "score_id int, system_product_id int, competitor_product_id int")
    parts = spark.createDataFrame([(1, 1, "custom", 80.0), (1, 3, "custom", None), (1, 4, "custom", 20.0), (2, 9, "custom", 50.0)],
                                  "score_id int, attribute_id int, algorithm_id string, score double")
    attributes = spark.createDataFrame([(1, "sku"), (3, "url"), (4, "price")], "attribute_id int, attribute_name string")
    out = {r["score_id"]: r["total_score"] for r in M.recalculated(
        scores, parts, attributes, {"sku": 3, "url": 5, "price": 1}, "custom").collect()}
    assert out == {1: 65.0, 2: 0.0}


def test_votes(spark):
    rows = [("p", "IQR", 0, 0), ("p", "IQR", 1, 0), ("p", "DBSCAN", 1, 0), ("q", "IQR", 1, 0),
            ("r", "DBSCAN", 0, 1), ("r", "IQR", 0, 0), ("s", "IQR", 0, 0), ("s", "IQR", 1, 0), ("s", "IQR", 1, 0)]
    results = spark.createDataFrame([(*r, "C", "b") for r in rows],
                                    "system_product_id string, algo_id string, status int, outlier_mode int, category string, brand string")
    votes = {r[0]: tuple(r)[1:] for r in I.majority_vote(results, "C").select(
        "system_product_id", "iqr_status", "dbs_status", "final_status", "outlier_mode").collect()}
    assert votes == {"p": (0, 1, 0, 0), "q": (1, None, 1, None), "r": (0, 0, 0, 1), "s": (1, None, 1, None)}


def test_averaged_status(spark):
    items = spark.createDataFrame([("a", 1, None), ("a", 0, 1), ("b", 0, 0), ("b", 0, None), ("c", 1, None)],
                                  "system_product_id string, status int, outlier_mode int")
    out = {r["system_product_id"]: (r["dbs_status"], r["final_status"], r["outlier_mode"])
           for r in I.averaged_status(items).collect()}
    assert out == {"a": (1, 0, 1), "b": (0, 0, None), "c": (1, 1, None)}


def test_predicates(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 1)], "id int, s int")
    ids = lambda c: [r["id"] for r in df.filter(c).orderBy("id").collect()]
    assert ids(Q.status_choice(["Pending", "Outlier"], "s")) == [1, 2]
    assert ids(Q.skip_choice(["No"], "s")) == [1, 2] and ids(Q.skip_choice(["Yes"], "s")) == [3]
    assert Q.skip_choice(["Yes", "No"], "s") is None and Q.criteria({}) is None
    assert ids(Q.criteria({"and": [("id", ">", 1), ("s", "=", 1)], "or": [("s", "is_null", True)]})) == [1, 3]
    assert ids(Q.all_of()) == [1, 2, 3]
    with pytest.raises(ValueError, match="almost"):
        Q.condition("id", "almost", 1)


def test_combined_flags(spark):
    df = spark.createDataFrame([(True, None), (True, True), (False, True)], "a boolean, b boolean")
    both = [r[0] for r in df.select(combine_flags(["a", "b"])).collect()]
    either = [r[0] for r in df.select(combine_flags(["a", "b"], "any")).collect()]
    assert both == [False, True, False] and either == [True, True, True]
    with pytest.raises(ValueError):
        combine_flags(["a"], "some")


def test_swap_needs_dimensions(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "height double, width double, depth double")
    row = I.swap_dimensions(df, F.lit(True), "height", "depth").first()
    assert (row["height"], row["depth"]) == (3.0, 1.0)
    with pytest.raises(ValueError, match="weight"):
        I.swap_dimensions(df, F.lit(True), "height", "weight")


def test_an_item_goes_to_the_one_header_that_fits_best(spark):
    headers = spark.createDataFrame(
        [(1, None, None, 1.0), (2, "X", None, 1.0), (3, None, "C", 1.0), (4, "X", "C", 1.0), (5, "X", None, 2.0), (6, "X", None, 1.0)],
        "iteration_id bigint, brand string, category string, eps double")
    items = spark.createDataFrame(
        [("a", "X", "C", 1.0), ("b", "X", "D", 1.0), ("c", "Y", "C", 1.0), ("d", "Y", "D", 1.0), ("e", "X", "C", 2.0), ("f", "Y", "D", 2.0),
         ("g", None, "C", 1.0), ("h", None, None, 1.0), ("b", "X", "D", 1.0)],
        "system_product_id string, brand string, category string, eps double")
    found = I.items_to_headers(items, headers, ["brand", "category", "eps"])
    got = sorted((r["system_product_id"], r["iteration_id"]) for r in found.collect())
    assert got == [("a", 4), ("b", 2), ("b", 2), ("c", 3), ("d", 1), ("e", 5), ("g", 3), ("h", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_saved_scores_are_found_by_the_next_step(spark):
    scores = spark.createDataFrame([(5, 1, 11, "custom", 50.0, "Review")], "score_id bigint, system_product_id bigint, "
                                   "competitor_product_id bigint, algorithm_id string, total_score double, score_status string")
    parts = spark.createDataFrame([(9, 5, 1, 1, 11, "custom", 50.0)], "score_attribute_id bigint, score_id bigint, attribute_id int, "
                                  "system_product_id bigint, competitor_product_id bigint, algorithm_id string, score double")
    new = scores.drop("score_id").limit(0).union(spark.createDataFrame(
        [(2, 21, "custom", 10.0, "Not Matched"), (1, 12, "custom", 90.0, "Matched"), (1, 11, "custom", 70.0, "Review")], scores.drop("score_id").schema))
    new_parts = spark.createDataFrame([(1, 2, 21, "custom", 20.0), (1, 1, 12, "custom", 90.0), (1, 1, 11, "custom", 70.0)],
                                      "attribute_id int, system_product_id bigint, competitor_product_id bigint, algorithm_id string, score double")
    saved, saved_parts = M.save_scores(scores, parts, new, new_parts)
    assert sorted((r["score_id"], r["competitor_product_id"], r["total_score"]) for r in saved.collect()) == [(5, 11, 70.0), (6, 12, 90.0), (7, 21, 10.0)]
    assert sorted((r["score_attribute_id"], r["score_id"], r["score"]) for r in saved_parts.collect()) == [(9, 5, 70.0), (10, 6, 90.0), (11, 7, 20.0)]
    attributes = spark.createDataFrame([(1, "sku")], "attribute_id int, attribute_name string")
    again = M.recalculated(saved, saved_parts, attributes, {"sku": 1.0}, "custom")
    assert sorted((r["score_id"], r["total_score"]) for r in again.collect()) == [(5, 70.0), (6, 90.0), (7, 20.0)]


def test_scores_are_saved_from_one_run_of_the_scoring(spark):
    rows = spark.createDataFrame([(1, 10, 80.0, 70.0, "Review", "name")],
                                 "system_product_id long, competitor_product_id long, sku_custom double, "
                                 "final_score double, status string, sku string")
    config = M.MatchConfig((M.Attribute(1, "sku", 35.0, "sku"),), ("custom",))
    kept = M.scored_once(rows, config)
    assert kept.columns == ["system_product_id", "competitor_product_id", "sku_custom", "final_score", "status"]
    assert "parquet" in kept._jdf.queryExecution().executedPlan().toString().lower()
