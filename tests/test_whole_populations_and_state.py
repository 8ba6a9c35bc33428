"""No row is lost or doubled: small and NULL populations, repeated decisions, several headers, pages."""

import pytest
from pyspark.sql import functions as F

from shelfglass.functions.display import to_number
from shelfglass.operators.quantiles import group_quantiles
from shelfglass.plans import analysis, iterations, matching
from shelfglass.plans import grid as G
from shelfglass.sources import imports


def products(spark, sizes):
    rows, n = [], 0
    for category, count in sizes:
        for i in range(count):
            n += 1
            rows.append((n, category, "t", 10.0 + i, 5.0, 3.0))
    return spark.createDataFrame(
        rows, "product_id long, category string, product_type string, height double, width double, "
              "depth double")


def test_small_and_null_populations_stay(spark):
    rows = products(spark, [("A", 6), ("B", 3), (None, 5)])
    out = analysis.label_outliers(rows, ["category"]).collect()
    assert sorted(r["product_id"] for r in out) == list(range(1, 15))
    for r in out:
        small = r["category"] == "B"
        assert (r["dbscan_cluster"] is None) == small
        assert (r["is_outlier_combined"] is None) == small


def test_items_count_clusters_of_their_population(spark):
    rows = products(spark, [("A", 6), ("C", 6)]).withColumns({
        "brand": F.lit("x"), "system_product_id": F.col("product_id")})
    labelled = rows.withColumn("dbscan_cluster", F.lit(0))
    items = analysis.run_items(labelled, ["category"]).collect()
    assert len(items) == 12 and {r["cluster_items"] for r in items} == {6}


def test_items_go_to_their_own_header(spark):
    schema = "iteration_id long, category string, eps double, sample int"
    saved, items = iterations.save_run(
        spark.createDataFrame([(4, "OLD", 1.0, 4)], schema),
        spark.createDataFrame([], "id long, iteration_id long, category string, eps double"),
        spark.createDataFrame([("A", 1.0, 4), ("A", 2.0, 4), ("B", 1.0, 4)],
                              "category string, eps double, sample int"),
        spark.createDataFrame([("A", 1.0), ("A", 2.0), ("B", 1.0)], "category string, eps double"))
    ids = {(r["category"], r["eps"]): r["iteration_id"] for r in saved.collect()}
    got = [(r["category"], r["eps"], r["iteration_id"]) for r in items.collect()]
    assert sorted(got) == sorted((c, e, ids[c, e]) for c, e in ids if c != "OLD")


def test_two_decisions_for_one_product(spark):
    base = spark.createDataFrame(
        [(1, None, None, None), (2, None, None, None)],
        "system_product_id long, competitor_product_id long, matched_date string, review_status int")
    offers = spark.createDataFrame([(10, 1), (11, 1), (12, 2)],
                                   "competitor_product_id long, system_product_id long")
    decisions = spark.createDataFrame([(10, "rejected", 1), (11, "approved", 2), (12, "x", 1)],
                                      "competitor_product_id long, decision string, decided_at int")
    for given in (decisions, decisions.drop("decided_at")):
        out = matching.apply_decisions(base, offers, given, F.lit("now")).collect()
        assert sorted((r["system_product_id"], r["competitor_product_id"], r["review_status"])
                      for r in out) == [(1, 11, 1), (2, None, 0)]


def test_bad_values_reject_their_row(spark):
    raw = spark.createDataFrame([("1", "n/a"), ("2", "7.5"), ("3", "")], "sku string, cost string")
    schema = spark.createDataFrame([], "id int, price double").schema
    mapping = {"sku": "id", "cost": "price"}
    rows = imports.mapped_rows(raw, mapping, schema, reject=True)
    base = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, price double")
    after = imports.run_import(base, rows, "update", ["id"]).collect()
    assert sorted(map(tuple, after)) == [(1, 5.0), (2, 7.5)]
    many = spark.createDataFrame([(str(i), "bad") for i in range(9)], "sku string, cost string")
    assert imports.cast_errors(many, mapping, schema).count() == 9


def test_infinity_is_no_measurement(spark):
    texts = spark.createDataFrame([("inf",), ("1e400",), ("-Infinity",), ("2.5",)], "x string")
    assert [r[0] for r in texts.select(to_number(F.col("x"))).collect()] == [None, None, None, 2.5]
    values = spark.createDataFrame([(float("inf"),), (1.0,), (3.0,)], "v double")
    assert group_quantiles(values, [], ["v"]).first()["n"] == 2


def grid_frame(spark, n):
    return spark.range(n).selectExpr(
        "id AS product_id", "concat('C', id % 7) AS category", "CASE WHEN id % 11 = 0 THEN NULL ELSE CAST(id % 13 AS INT) END AS cluster_items",
        "CASE WHEN id % 5 = 0 THEN NULL ELSE concat('Cluster ', id % 3) END AS cluster", "CASE WHEN id % 9 = 0 THEN 'n/a' ELSE CAST((id * 37) % 1000 AS STRING) END AS system_product_id",
        "CASE WHEN id % 4 = 0 THEN NULL ELSE (id * 7919 % 1000) / 10.0 END AS height").repartition(6)


@pytest.mark.parametrize("column, direction", [(None, "asc"), ("height", "desc"), ("height", "asc"), ("system_product_id", "desc")])
def test_pages_by_index_and_by_last_row_equal_offset_pages(spark, column, direction):
    rows = grid_frame(spark, 230)
    index, last = G.page_index(rows, column, direction), None
    for number in range(1, 9):
        want = [r["product_id"] for r in G.page(rows, number, 30, column, direction).collect()]
        assert [r["product_id"] for r in index.page(number, 30).collect()] == want
        after = G.page_after(rows, 30, last, column, direction).collect()
        assert [r["product_id"] for r in after] == want
        last = after[-1].asDict() if after else last
    assert index.page(9, 30).count() == 0


def test_a_deep_page_reads_few_rows(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set(coalesce, "false")
    try:
        index = G.page_index(grid_frame(spark, 100_000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset(coalesce)
    page = index.page(1_000, 50)
    assert page.count() == 50
    rows = page.drop("_x")
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan()
    todo, read = [plan], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name.startswith("Scan"):
            read += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert 0 < read < 100_000 / 8
