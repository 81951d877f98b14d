import pytest
from pyspark.sql import functions as F

from quillframe.functions import columns as C
from quillframe.functions.roles import detect_roles, excluded_driver_fields
from quillframe.operators import charts as V
from quillframe.operators import groups as G
from quillframe.operators import keyed as K
from quillframe.session import local_table
from quillframe.sources.catalog import Catalog, DatasetMeta, lineage_closure, sample_rows, schema_table
from quillframe.sources.compare import tables_equal
from quillframe.sources.sqlguard import SQLGuardError, guarded_sql


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_headers():
    assert C.normalize_headers(["A b", "a-B ", "a b 2", "", "!"]) == ["a_b", "a_b_2", "a_b_2_2", "column", "column_2"]


def test_finite_or_null(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double")
    assert [r["v"] for r in C.with_finite(df).collect()] == [1.5, None, None, None, None]


def test_filters(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5), (None, None)], "k string, v int")
    eq, gt = {"column": "k", "op": "eq", "value": "a"}, {"column": "v", "op": "gt", "value": 2}
    assert rows_of(C.filter_rows(df, [eq, gt])) == [("a", 5)]
    with pytest.raises(ValueError):
        C.filter_rows(df, [{"column": "v", "op": "like", "value": 1}])
    with pytest.raises(ValueError):
        C.filter_rows(df, [{"column": "w", "op": "eq", "value": 1}])


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = C.filter_rows(df, [{"column": "l_returnflag", "op": "eq", "value": "R"}]).select("l_quantity")
    plan = out._jdf.queryExecution().explainString(out._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) \
        if hasattr(out, "_jvm") else out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    assert "EqualTo(l_returnflag,R)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def test_bins_match_interval_labels():
    assert C.interval_labels([0, 18, 30], True) == ["(-0.001, 18.0]", "(18.0, 30.0]"]
    assert C.interval_labels([0, 18, 30], False) == ["(0, 18]", "(18, 30]"]
    assert C.interval_labels([0.5, 1.5], False) == ["(0.5, 1.5]"]


@pytest.mark.parametrize("aggregation", ["count", "mean", "sum", "median", "min", "max"])
def test_null_groups_and_null_metrics(spark, aggregation):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("a", 4.0), (None, 2.0), ("empty", None)], "g string, m double")
    got = {r[0]: r[1] for r in G.grouped_analysis(df, "g", "m", aggregation).collect()}
    assert got == {
        "count": {"a": 3, None: 1, "empty": 1},
        "mean": {"a": 2.5, None: 2.0, "empty": None},
        "sum": {"a": 5.0, None: 2.0, "empty": 0.0},
        "median": {"a": 2.5, None: 2.0, "empty": None},
        "min": {"a": 1.0, None: 2.0, "empty": None},
        "max": {"a": 4.0, None: 2.0, "empty": None},
    }[aggregation]


def test_group_errors(spark, passengers):
    with pytest.raises(ValueError):
        G.grouped_analysis(passengers, "sex", "fare", "mode")
    with pytest.raises(ValueError):
        G.grouped_analysis(passengers, "nope")
    with pytest.raises(ValueError):
        G.grouped_analysis(passengers, "sex", None, "mean")


def test_three_groups_cover_all_rows(passengers):
    groups = G.grouped_analysis(passengers, "pclass", "survived", "positive_rate").collect()
    assert len(groups) == 3 and sum(g["sample_size"] for g in groups) == 12


def test_positive_rate_counts_null_as_negative(spark):
    df = spark.createDataFrame([("g", "Yes"), ("g", None), ("g", " yes"), ("g", "positive")], "g string, m string")
    assert G.grouped_analysis(df, "g", "m", "positive_rate").first()["positive_rate"] == 25.0


def test_trend_periods_and_bad_dates(spark):
    df = spark.createDataFrame(
        [("2024-01-31", 1.0), ("2024-02-01", 2.0), ("bad", 9.0), (None, 9.0), ("2025-02-10", None)], "d string, m double")
    assert rows_of(G.trend_analysis(df, "d", "m", "M", "sum")) == [("2024-01", 1.0), ("2024-02", 2.0), ("2025-02", 0.0)]
    assert rows_of(G.trend_analysis(df, "d", None, "Y")) == [("2024", 2.0), ("2025", 1.0)]
    assert rows_of(G.trend_analysis(df, "d", None, "Q")) == [("2024Q1", 2.0), ("2025Q1", 1.0)]
    assert rows_of(G.trend_analysis(df, "d", None, "D"))[0] == ("2024-01-31", 1.0)
    assert rows_of(G.trend_analysis(df, "d", None, "W"))[0] == ("2024-01-29/2024-02-04", 2.0)


def test_small_groups_do_not_compete(spark):
    df = spark.createDataFrame(
        [("clear", 200.0, 1000), ("rain", 100.0, 100), ("heavy_rain", 5.0, 2)], "w string, m double, sample_size long")
    got = {r["which"]: r["w"] for r in G.group_extremes(df, "m", "w").collect()}
    assert got == {"highest": "clear", "lowest": "rain"}


def test_roles(spark, shop):
    roles = detect_roles(shop)
    assert roles["revenue"] == "revenue" and roles["orders"] == "order_id" and roles["date"] == "order_date"
    odd = spark.createDataFrame([("x", 1, 2.0)], "sales string, buyer_id int, gross_margin double")
    found = detect_roles(odd, {"region": "sales"})
    assert found["revenue"] is None  # text cannot be a measure
    assert found["customers"] == "buyer_id" and found["profit"] == "gross_margin" and found["region"] == "sales"


def test_driver_exclusions():
    reasons = excluded_driver_fields(["y", "row_id", "boat", "age"], "y", {"boat": "Known after the outcome"})
    assert set(reasons) == {"y", "row_id", "boat"}


# -- SQL ----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("text", [
    "", ";", "DROP TABLE t", "SELECT 1; DELETE FROM t", "INSERT INTO t VALUES (1)", "SELECT * FROM missing_table",
    "SELECT missing FROM t", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT java_method ('a', 'b')",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "SET x = 1", "CREATE TABLE z AS SELECT 1",
])
def test_guard_rejects(spark, text):
    with pytest.raises(SQLGuardError):
        guarded_sql(spark, text, {"t": spark.range(3)})


def test_guard_accepts_and_caps(spark):
    tables = {"t": spark.range(30)}
    capped = guarded_sql(spark, "SELECT id FROM t ORDER BY id DESC LIMIT 20;", tables, max_rows=5)
    assert [r["id"] for r in capped.rows.collect()] == [29, 28, 27, 26, 25] and capped.truncated
    whole = guarded_sql(spark, "SELECT id, 'drop; -- me' AS note FROM t -- tail", tables)
    assert whole.rows.count() == 30 and not whole.truncated
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


# -- catalog ------------------------------------------------------------------------------------------
def test_csv_versions_and_lineage(spark, tmp_path):
    (tmp_path / "up.csv").write_text("Customer Name,Revenue,Revenue\nA,10.5,1\nB,,2\nB,,2\n")
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    raw = catalog.ingest_csv(str(tmp_path / "up.csv"), "My Upload")
    assert (raw.name, raw.table, raw.rows) == ("my_upload", "upload_my_upload_raw", 3)
    assert catalog.dataframe(raw).columns == ["customer_name", "revenue", "revenue_1"]
    again = catalog.ingest_csv(str(tmp_path / "up.csv"), "My Upload")
    assert again.name == "my_upload_2"

    first = catalog.apply_cleaning(raw, [{"operation": "impute_numeric", "column": "revenue"}])
    second = catalog.apply_cleaning(raw, [{"operation": "drop_duplicates"}])
    third = catalog.apply_features(first, [{"operation": "log1p", "column": "revenue"}])
    assert [m.version for m in (first, second, third)] == ["clean_v1", "clean_v2", "features_v1"]
    assert third.table == "upload_my_upload_features_v1" and third.parent_id == first.id
    assert first.transformations[0]["value"] == 10.5
    assert catalog.dataframe(raw).where("revenue IS NULL").count() == 2  # the parent is untouched
    assert {m.id for m in catalog.family(third)} == {raw.id, first.id, second.id, third.id}
    assert [m.id for m in catalog.children(raw)] == [second.id, first.id]
    assert catalog.parent(third).id == first.id and catalog.find("my_upload").version in {"raw"}


def test_csv_limits(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("a,b\n")
    (tmp_path / "two.csv").write_text("a,b\n1,2\n3,4\n")
    catalog = Catalog(spark, str(tmp_path / "c"))
    with pytest.raises(ValueError):
        catalog.ingest_csv(str(tmp_path / "empty.csv"), "x")
    with pytest.raises(ValueError):
        catalog.ingest_csv(str(tmp_path / "two.csv"), "x", max_rows=1)


def test_batch_loader(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a\n1\n")
    entries = [{"name": n, "table": f"{n}_raw", "default_target": "a"} for n in ("one", "absent")]
    catalog = Catalog(spark, str(tmp_path / "c"))
    assert catalog.load_all(entries, str(tmp_path)) == {"one": "loaded", "absent": "skipped"}
    assert catalog.load_all(entries, str(tmp_path), only_missing=True) == {"one": "kept", "absent": "skipped"}
    before = catalog.find("one")
    (tmp_path / "one.csv").write_text("a\n1\n2\n")
    assert catalog.load_all(entries, str(tmp_path))["one"] == "loaded"
    after = catalog.find("one")
    assert (after.id, after.rows, catalog.registry().count()) == (before.id, 2, 1)


def test_copy_checks_everything_first(spark, tmp_path):
    source, target = Catalog(spark, str(tmp_path / "s")), Catalog(spark, str(tmp_path / "t"))
    spark.range(4).write.parquet(source.path("n_raw"))
    raw = source.register(DatasetMeta("n", "n_raw", rows=4, columns=1))
    child = source.write_version(raw, spark.range(3), "clean", [])
    assert source.copy_to(target) == 2 and source.copy_to(target) == 0
    assert target.parent(target.find(child.name)).id == raw.id
    with pytest.raises(ValueError):
        source.copy_to(source)

    other = Catalog(spark, str(tmp_path / "o"))
    spark.range(4).write.parquet(other.path("n_raw"))
    kept = other.register(DatasetMeta("n", "n_raw", rows=4, columns=1))
    with pytest.raises(ValueError):
        source.copy_to(other)  # equal content, but merging was not asked for
    assert not other.table_exists("n_clean_v1")
    assert source.copy_to(other, merge_equivalent=True) == 1
    assert other.find("n_clean_v1").parent_id == kept.id

    differs = Catalog(spark, str(tmp_path / "d"))
    spark.range(1, 5).write.parquet(differs.path("n_raw"))
    differs.register(DatasetMeta("n", "n_raw", rows=4, columns=1))
    with pytest.raises(ValueError):
        source.copy_to(differs, merge_equivalent=True)


def test_lineage_cycle(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    a = catalog.register(DatasetMeta("a", "a_raw", id="a", parent_id="b"))
    catalog.register(DatasetMeta("b", "b_raw", id="b", parent_id="a"))
    with pytest.raises(ValueError):
        catalog.family(a)
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string")
    assert rows_of(lineage_closure(edges, "a")) == [("a", 0), ("b", 1)]


def test_equality(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, True)], "k int, v boolean")
    b = spark.createDataFrame([(2, 1), (1, None), (1, None)], "k int, v int")
    assert tables_equal(a, b)
    assert not tables_equal(a, b.distinct())
    assert not tables_equal(a, b.toDF("k", "w"))


def test_schema_and_sample(spark, passengers):
    table = {r["column_name"]: r for r in schema_table(passengers, {"age": "in years"}).collect()}
    assert table["sex"]["is_numeric"] is False and table["age"]["description"] == "in years"
    assert sample_rows(spark.range(500), ["id"], 1000).count() == 100
    assert sample_rows(spark.range(500), ["id"], 0).count() == 1


# -- keyed tables and charts ----------------------------------------------------------------------------
def test_run_rates(spark):
    log = spark.createDataFrame([("completed",), ("completed_with_errors",), ("failed",), ("running",)], "status string")
    assert tuple(K.run_rates(log).first()) == (4, 0.5, 0.25)
    assert tuple(K.run_rates(log.limit(0)).first()) == (0, None, None)


def test_keywords(spark):
    docs = spark.createDataFrame([(1, "The  cat\nsat"), (2, None), (3, "cat cat CAT"), (4, "the cat sat down")], "id int, t string")
    got = [tuple(r) for r in K.keyword_topk(docs, "t", "id", "the SAT cat", 3).collect()]
    assert got == [(1, 3), (4, 3), (3, 1)]


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, ts int, v string")
    new = spark.createDataFrame([("a", 2, "z"), (None, 1, "n")], "k string, ts int, v string")
    latest = K.upsert_latest([old, new], ["k"], ["ts"])
    assert rows_of(latest) == sorted([("a", 2, "z"), ("b", 1, "y"), (None, 1, "n")], key=repr)
    left = K.delete_by_key(latest, spark.createDataFrame([("a",)], "k string"), ["k"])
    assert rows_of(left) == sorted([("b", 1, "y"), (None, 1, "n")], key=repr)


def test_charts(spark, passengers):
    with pytest.raises(ValueError):
        V.chart_data(passengers, {"chart_type": "radar"})
    with pytest.raises(ValueError):
        V.chart_data(passengers, {"chart_type": "bar", "x": "nope"})
    bars = V.chart_data(passengers, {"chart_type": "bar", "x": "sex", "y": "fare", "aggregation": "mean"})
    assert bars.count() == 2
    histogram = V.histogram(passengers, "age", 4)
    assert histogram.count() == 4 and histogram.agg(F.sum("count")).first()[0] == 11
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert rows_of(V.histogram(same, "v", 5)) == [(0, 3.0, 3.0, 2)]
    first = rows_of(V.sample_points(passengers, ["fare"], ["fare"], limit=5))
    assert first == rows_of(V.sample_points(passengers.repartition(3), ["fare"], ["fare"], limit=5))
    assert V.heatmap(passengers).count() == 36


def test_box_whiskers(spark):
    df = spark.createDataFrame([(None, v) for v in [1.0, 2.0, 3.0, 4.0, 100.0]] + [("a", 1.0)], "x string, y double")
    got = {r["x"]: tuple(r)[1:] for r in V.box(df, "x", "y").collect()}
    assert got == {None: (2.0, 3.0, 4.0, 1.0, 4.0), "a": (1.0, 1.0, 1.0, 1.0, 1.0)}


@pytest.mark.parametrize("text", [
    "SELECT 1 AS `'`, reflect('java.lang.System', 'getProperty', 'user.dir') AS `x'`",
    r"SELECT r'\' AS a, reflect('java.lang.System', 'getProperty', 'user.dir') AS b",
    "SELECT IDENTIFIER('ref'||'lect')('java.lang.System', 'getProperty', 'user.dir')",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.dir')",
    "SELECT (SELECT java_method('java.lang.System', 'getProperty', 'user.dir')) AS x FROM t",
    "WITH c AS (SELECT try_reflect('java.lang.System', 'getProperty', 'user.dir') AS x) SELECT * FROM c, t",
    "SELECT id FROM t WHERE EXISTS (SELECT reflect('java.lang.System', 'getProperty', 'user.dir'))",
])
def test_guard_sees_through_disguised_calls(spark, text):
    with pytest.raises(SQLGuardError):
        guarded_sql(spark, text, {"t": spark.range(3)})


def test_guard_leaves_no_view_and_allows_harmless_text(spark):
    spark.range(7).createOrReplaceTempView("kept_view")
    found = guarded_sql(spark, "SELECT 'reflect(' AS x, id FROM gone_view UNION ALL SELECT 'y', id FROM kept_view",
                        {"gone_view": spark.range(2), "kept_view": spark.range(3)})
    assert found.rows.count() == 5 and spark.table("kept_view").count() == 7
    assert not spark.catalog.tableExists("gone_view")
    spark.catalog.dropTempView("kept_view")


def test_csv_with_quotes_line_breaks_and_missing_texts(spark, tmp_path):
    (tmp_path / "odd.csv").write_text('name,score,flag,day\n"a ""b"", c",1,true,2020-01-05\n"line1\nline2",NA,false,N/A\nnull,2.5,,2020-02-01\n')
    frame = Catalog(spark, str(tmp_path / "root")).read_csv(str(tmp_path / "odd.csv"))
    assert [t for _, t in frame.dtypes] == ["string", "double", "boolean", "timestamp_ntz"]
    rows = frame.collect()
    assert [r["name"] for r in rows] == ['a "b", c', "line1\nline2", None]
    assert [r["score"] for r in rows] == [1.0, None, 2.5] and rows[1]["day"] is None


def test_dates_and_numbers_in_texts(spark):
    texts = ["2020-01-02", "01/02/2020", "Jan 2, 2020", "January 2, 2020", "2 Jan 2020", "2020-1-2 3:04 PM", "2020/01/02", "12:30", "soon", None]
    frame = local_table(spark, [(t,) for t in texts], "d string")
    days = [r[0] and r[0].strftime("%Y-%m-%d %H:%M") for r in frame.select(C.as_timestamp(frame, "d")).collect()]
    assert days == ["2020-01-02 00:00"] * 5 + ["2020-01-02 15:04", "2020-01-02 00:00", None, None, None]
    numbers = local_table(spark, [(t,) for t in ["1d", "1f", "0x1", "1e3", " 2 ", "inf", "x", None]], "v string")
    assert [r[0] for r in numbers.select(C.as_number(F.col("v"))).collect()] == [None, None, None, 1000.0, 2.0, None, None, None]
    assert local_table(spark, [("\u00a0ab\u3000",)], "v string").select(C.strip(F.col("v"))).first()[0] == "ab"


def test_delete_tells_what_it_found(spark):
    table = local_table(spark, [(1,), (1,), (2,), (None,)], "k int")
    gone = K.remove_keys(table, local_table(spark, [(1,), (9,)], "k int"), ["k"])
    assert gone.found and gone.removed == 2 and gone.kept.count() == 2
    assert not K.remove_keys(table, local_table(spark, [(9,)], "k int"), ["k"]).found
    assert K.clear(table).removed == 4 and K.clear(table).kept.count() == 0


def test_wide_keys_are_not_held_on_the_driver(spark):
    from quillframe.operators.lookup import lookup_join, small_table

    table = spark.range(50).select(F.concat(F.repeat(F.lit("x"), 1000), "id").alias("k"), F.col("id").alias("v"))
    assert small_table(table) is not None and small_table(table, most_bytes=10_000) is None
    assert lookup_join(table.select("k"), table, "k").where("v IS NULL").count() == 0


def test_trend_by_hour_and_spread(spark):
    rows = local_table(spark, [("2024-01-01 10:10:00", 1), ("2024-01-01 10:50:00", 3), ("2024-01-01 11:00:00", 3)], "t string, v int")
    assert rows_of(G.trend_analysis(rows, "t", "v", "H", "nunique")) == [("2024-01-01 10:00", 2.0), ("2024-01-01 11:00", 1.0)]
    assert rows_of(G.trend_analysis(rows, "t", "v", "D", "std")) == [("2024-01-01", pytest.approx(1.1547005))]


def test_aggregation_comes_first_for_every_chart(spark):
    rows = local_table(spark, [("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    for kind in ("bar", "line", "donut", "scatter"):
        assert rows_of(V.chart_data(rows, {"chart_type": kind, "x": "g", "y": "v", "aggregation": "mean"})) == [("a", 2.0), ("b", 5.0)]
    assert V.chart_data(rows, {"chart_type": "box", "x": "g", "y": "v", "aggregation": "mean"}).count() == 2
