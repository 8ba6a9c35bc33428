import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfglass import schema
from shelfglass.operators.keyed import apply_updates, delete_where, merge, set_where, upsert
from shelfglass.operators.numbering import number_in_order
from shelfglass.sources import exports as E
from shelfglass.sources import imports as I
from shelfglass.sources import product_files as P

SCHEMA = (T.StructType().add("id", "long").add("code", "string").add("name", "string")
          .add("price", "double"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def base(spark):
    return spark.createDataFrame([(1, "7", "old", 1.0), (2, "B", "keep", 2.0)], SCHEMA)


@pytest.fixture()
def news(spark):
    data = [(0, "07", "first", 9.0), (1, "7", "second", 8.0), (2, "C", None, 3.0), (3, None, "x", 4.0),
            (4, None, "x", 5.0), (5, "C", "again", 6.0)]
    return spark.createDataFrame(data, "line bigint, code string, name string, price double")


def test_insert_modes(base, news):
    out = rows_of(I.run_import(base, news, "insert_with_identity", ["code"], "line"))
    assert out == sorted([(1, "7", "old", 1.0), (2, "B", "keep", 2.0), (None, "C", None, 3.0),
                          (None, None, "x", 4.0), (None, None, "x", 5.0)], key=repr)
    assert I.run_import(base, news.drop("line"), "insert_direct").count() == 8


def test_update_overwrites_with_null_and_first_row_wins(base, news, spark):
    out = rows_of(I.run_import(base, news, "update", ["code"], "line"))
    assert out == sorted([(1, "7", "first", 9.0), (2, "B", "keep", 2.0)], key=repr)
    blank = spark.createDataFrame([(0, "B", None, None)], news.schema)
    assert (2, "B", None, None) in rows_of(I.run_import(base, blank, "update", ["code"], "line"))


def test_upsert_and_report(base, news):
    out = rows_of(I.run_import(base, news, "insert_update", ["code"], "line"))
    assert len(out) == 5 and (1, "7", "first", 9.0) in out
    report = I.import_report(base, news, "insert_update", ["code"], "line").first()
    assert tuple(report) == (6, 3, 1, 2)
    assert tuple(I.import_report(base, news, "insert_direct").first()) == (6, 6, 0, 0)


def test_two_identity_columns(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, n int, v string")
    news = spark.createDataFrame([("a", 1, "new"), ("b", 1, "in")], "k string, n int, v string")
    out = rows_of(I.run_import(base, news, "insert_update", ["k", "n"]))
    assert out == [("a", 1, "new"), ("a", 2, "y"), ("b", 1, "in")]


def test_mapping_checks(spark):
    ddl = lambda text: spark.createDataFrame([], text).schema
    table = ddl("id bigint NOT NULL, code string NOT NULL, name string NOT NULL, note string")
    I.check_mapping(table, {"a": "code", "b": "name"}, "insert_direct", generated=["id"])
    with pytest.raises(ValueError, match="id, name"):
        I.check_mapping(table, {"a": "code"}, "insert_direct")
    with pytest.raises(ValueError, match="identity"):
        I.check_mapping(table, {"a": "code", "b": "name"}, "update", generated=["id"])
    for bad in ((None, {"a": "code"}, "update"), (table, {}, "update"), (table, {"a": "code"}, None)):
        with pytest.raises(ValueError):
            I.check_mapping(*bad, ["code"])
    assert I.required_columns(table, ["id"]) == ["code", "name"]
    assert I.required_columns(ddl(schema.PRODUCT)) == ["product_id", "group_id"]


def test_catalog_and_parameters(spark, base):
    base.createOrReplaceTempView("import_base")
    assert "import_base" in I.tables(spark)
    assert I.fetch_one(spark, "SELECT name FROM import_base WHERE id = :i", {"i": 2}) == "keep"
    assert I.fetch_one(spark, "SELECT name FROM import_base WHERE id = :i", {"i": 9}) is None
    assert I.fetch_row(spark, "SELECT * FROM import_base").count() == 1


def test_mapped_rows_and_cast_errors(spark):
    raw = spark.createDataFrame([(" A ", "1.5"), ("", "n/a")], "Code string, Cost string")
    mapping = {"Code": "code", "Cost": "price"}
    assert rows_of(I.mapped_rows(raw, mapping, SCHEMA)) == [("A", 1.5), (None, None)]
    assert rows_of(I.cast_errors(raw, mapping, SCHEMA)) == [("price", "n/a")]


def test_product_file_headers(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Sku,WEB_ID,Type,H,height,W,D,ImageUrl\n"
                                    ",w1,t,,' ',2,3,u\ns2,w2,t, 12 ,5,2,3,u\ns3,w3,t,n/a,7,2,3,u\n")
    (tmp_path / "a.csv").write_text("SKU,H,W\nx,1,2\n")
    (tmp_path / "note.txt").write_text("no")
    assert [r["file"] for r in P.list_files(spark, str(tmp_path)).collect()] == ["a.csv", "b.csv"]
    rows = P.load_products(spark, str(tmp_path / "b.csv"))
    assert rows.columns == ["SKU", "Type", "H", "W", "D", "imageUrl"]
    assert {(r["SKU"], r["H"]) for r in rows.collect()} == {("s2", 12.0)}
    with pytest.raises(ValueError, match="no column for D"):
        P.load_products(spark, str(tmp_path / "a.csv"))
    with pytest.raises(ValueError):
        P.filtered(rows, [])


def test_row_order_and_dropped_stages(spark):
    from shelfglass.staging import drop_stages

    drop_stages(spark)
    rows = P.with_row_order(spark.range(100).repartition(5))
    assert rows.select("row_order").distinct().count() == 100
    assert drop_stages(spark) == 1


def test_fields_over_several_lines_on_request(spark, tmp_path):
    (tmp_path / "m.csv").write_text('SKU,Name,H,W,D\ns1,"two\nlines",1,2,3\ns2,one,4,5,6\n')
    rows = P.load_products(spark, str(tmp_path / "m.csv"), multi_line=True)
    assert {(r["SKU"], r["Name"]) for r in rows.collect()} == {("s1", "two\nlines"), ("s2", "one")}


def test_large_files_are_split(spark, tmp_path):
    (tmp_path / "big.csv").write_text("SKU,H,W,D\n" + "s,1,2,3\n" * 200_000)
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "256k")
    try:
        rows = P.load_products(spark, str(tmp_path / "big.csv"))
        assert rows.rdd.getNumPartitions() > 3 and rows.count() == 200_000
    finally:
        spark.conf.set(size, before)


def test_few_rows_are_an_error(spark):
    df = spark.createDataFrame([("c", "b")] * 3, "Category string, Brand string")
    with pytest.raises(ValueError, match="3 rows are too few"):
        P.filtered(df, ["c"])
    assert P.filtered(df.union(df), "c").count() == 6


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s1", "b", "c", "Yes"), ("s2", "b", "c", "No")],
                               "SKU string, Brand string, Category string, final_status string")
    E.write_by_status(df, str(tmp_path / "out"))
    back = P.read_file(spark, str(tmp_path / "out"))
    assert {(r["web_id"], r["final_status"]) for r in back.collect()} == {("s1", "Yes"), ("s2", "No")}
    empty = df.withColumn("gone", F.lit(None).cast("string"))
    assert "gone" not in E.drop_empty_columns(empty).columns
    export = df.withColumn("iqr_status", F.col("final_status"))
    assert E.split_export(export, "outliers").count() == 1 and E.split_export(export).count() == 2


def test_files_follow_the_size_of_their_key(spark, tmp_path):
    rows = spark.range(2_000).selectExpr(
        "concat('s', id) AS SKU", "CASE WHEN id < 1800 THEN 'big' WHEN id % 40 = 0 THEN NULL ELSE concat('b', id % 5) END AS Brand",
        "'c' AS Category", "'Yes' AS final_status").repartition(16)
    E.write_by_brand_category(rows, str(tmp_path / "out"), rows_per_file=300)
    files = {}
    for f in (tmp_path / "out").rglob("part-*.csv"):
        files[f.parts[-4]] = files.get(f.parts[-4], 0) + 1
    assert 6 <= files.pop("brand=big") <= 12
    assert set(files.values()) == {1} and len(files) == 6
    assert P.read_file(spark, str(tmp_path / "out")).count() == 2_000


def test_keyed_changes(spark, base):
    news = spark.createDataFrame([(2, None), (9, "nine")], "id bigint, name string")
    assert rows_of(apply_updates(base, news, ["id"]).select("id", "name")) == [(1, "old"), (2, None)]
    assert upsert(base, news, ["id"]).count() == 3
    twice = spark.createDataFrame([(2, "a"), (2, "b"), (None, "x"), (None, "y")], "id bigint, name string")
    assert rows_of(apply_updates(base, twice, ["id"]).select("id", "name")) == [(1, "old"), (2, "b")]
    assert upsert(base, twice, ["id"]).count() == 4
    null_row = spark.createDataFrame([(3, None, "n", None)], SCHEMA)
    table = base.union(null_row)
    cheap = F.col("price") < 2
    assert [r["name"] for r in set_where(table, cheap, {"name": "c"}).orderBy("id").collect()] == ["c", "keep", "n"]
    assert [r["id"] for r in delete_where(table, cheap).orderBy("id").collect()] == [2, 3]


def test_merge_is_one_join(spark, base):
    news = spark.createDataFrame([(2, None, 5.0), (9, "nine", None), (None, "z", 1.0)], "id bigint, name string, price double")
    both = merge(base, news, ["id"], keep_on_null=["name"], flag="change", unique=True)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Join FullOuter" in plan
    got = {(r["id"], r["name"], r["price"], r["change"]) for r in both.collect()}
    old = {r["id"]: r for r in base.collect()}
    assert got == {(1, old[1]["name"], old[1]["price"], "kept"), (2, old[2]["name"], 5.0, "updated"),
                   (9, "nine", None, "inserted"), (None, "z", 1.0, "inserted")}
    update_only = merge(base, news, ["id"], insert=False, unique=True)
    assert update_only.count() == 2
    insert_only = merge(base, news, ["id"], update=False, unique=True)
    assert {r["name"] for r in insert_only.filter("id = 2").collect()} == {old[2]["name"]}


def test_rejected_rows_are_counted(spark):
    base = spark.createDataFrame([(1, "A", "old", 1.0), (2, "B", "keep", 2.0)], "id bigint, code string, name string, price double")
    raw = spark.createDataFrame([("0", "A", "n1", "5"), ("1", "A", "n2", "6"), ("2", "B", "x", "n/a"), ("3", "C", "new", "7"), ("4", "D", "bad", "1,5")],
                                "Line string, Code string, Label string, Cost string")
    schema_ = base.withColumn("line", F.lit(0).cast("bigint")).schema
    mapping = {"Code": "code", "Label": "name", "Cost": "price", "Line": "line"}
    done = I.import_rows(base, raw, mapping, schema_, "insert_update", ["code"], "line")
    assert done.report.first().asDict() == {"total": 5, "inserted": 1, "updated": 1, "duplicates": 1, "ignored": 0, "errors": 2}
    assert {tuple(r) for r in done.rejected.collect()} == {(2, "price", "n/a", "not a double"), (4, "price", "1,5", "not a double")}
    assert {(r["code"], r["name"], r["price"]) for r in done.table.collect()} == {("A", "n1", 5.0), ("B", "keep", 2.0), ("C", "new", 7.0)}
    only = I.import_rows(base, raw, mapping, schema_, "update", ["code"], "line").report.first()
    assert (only["inserted"], only["updated"], only["ignored"]) == (0, 1, 1)


def test_numbers_follow_the_order_over_many_parts(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("same prefix "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("k"), "id").repartition(7)
    got = number_in_order(rows, ["k"], "n").filter("n <> id + 1").count()
    assert got == 0
