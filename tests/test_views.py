import pytest
from pyspark.sql import functions as F

from tests.data import as_dicts, at, raw, transactions
from tillroll.operators import cube, dashboard, explore, profiling


def test_end_date_is_its_midnight(spark):
    sales = transactions(
        spark, [{"InvoiceDate": at("2020-01-05 00:00")}, {"InvoiceDate": at("2020-01-05 00:01"), "StockCode": "b"}]
    )
    assert dashboard.filter_sales(sales, "2020-01-05", "2020-01-05").count() == 1
    assert dashboard.filter_sales(sales, end="2020-01-05 00:01:00").count() == 2


def test_filters_reach_the_scan(spark, tmp_path):
    # Plans cut long filter lists by default.
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = str(tmp_path / "tx")
    transactions(spark, [{}]).write.parquet(path)
    chosen = dashboard.filter_sales(spark.read.parquet(path), start="2020-01-01", country="Home")
    plan = chosen.select("TotalPrice")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(Country,Home)" in plan and "GreaterThanOrEqual(InvoiceDate" in plan
    assert "ReadSchema: struct<InvoiceDate:timestamp_ntz,Country:string,TotalPrice:double>" in plan


def test_kpis_of_nothing_are_zero(spark):
    empty = transactions(spark, [{}]).filter("Quantity > 5")
    assert as_dicts(dashboard.kpis(empty)) == [
        {"total_revenue": 0.0, "total_transactions": 0, "total_customers": 0, "avg_order_value": 0.0}
    ]
    assert [r["Revenue"] for r in as_dicts(explore.guest_split(empty))] == [0.0, 0.0]


def test_weekdays_without_sales_stay(spark):
    sales = transactions(spark, [{"InvoiceDate": at("2020-01-08 10:00")}])
    assert [r["Revenue"] for r in as_dicts(explore.weekday_revenue(sales))] == [None, None, 1.0, None, None, None, None]


def test_others_bucket(spark):
    totals = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 1.0), ("d", 2.0)], "k string, v double")
    assert sorted(map(tuple, explore.top_with_others(totals, "k", "v", 2).collect())) == [
        ("Others", 3.0), ("a", 5.0), ("b", 5.0),
    ]
    assert explore.top_with_others(totals, "k", "v", 4).count() == 4


def test_rolling_mean_needs_a_full_window(spark):
    days = [(p, at(f"2020-01-{d:02d}"), d) for p, n in (("six", 6), ("gaps", 7)) for d in range(1, 2 * n, 2)]
    df = spark.createDataFrame(days, "p string, d timestamp_ntz, v int")
    smooth = df.select("p", "d", explore.rolling_mean(df, "v", ["p"], "d", 7).alias("s"))
    last = {r["p"]: r["s"] for r in smooth.groupBy("p").agg(F.max_by("s", "d").alias("s")).collect()}
    assert last == {"six": None, "gaps": 7.0}


def test_issues_that_do_not_occur_are_left_out(spark):
    df = raw(spark, [{}, {}, {"CustomerID": None, "StockCode": "x"}])
    assert [(r["issue"], r["count"], r["severity"]) for r in as_dicts(profiling.quality_issues(df))] == [
        ("Missing CustomerID", 1, "HIGH"), ("Duplicate Rows", 1, "MEDIUM"),
    ]


def test_top_values_are_cut_before_the_shuffle(spark):
    plan = profiling.top_values(raw(spark, [{}]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_sample_is_stable(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"))
    first = {r["id"] for r in dashboard.stable_sample(df, "id", 100).collect()}
    again = {r["id"] for r in dashboard.stable_sample(df.repartition(7), "id", 100).collect()}
    assert first == again and len(first) == 100
    assert dashboard.stable_sample(df.limit(10), "id", 100).count() == 10


def test_summary_with_sketched_quartiles(spark):
    df = spark.range(1, 101).select(F.col("id").alias("x"))
    exact, sketched = (as_dicts(profiling.numeric_summary(df, approximate=a))[0] for a in (False, True))
    assert (exact["q25"], exact["median"], exact["q75"]) == (25.75, 50.5, 75.25)
    assert abs(sketched["median"] - 50.5) <= 1 and sketched["mean"] == exact["mean"] == 50.5


_LINES = [
    {"InvoiceDate": at("2020-01-05 00:00"), "CustomerID": "Guest"},
    {"InvoiceDate": at("2020-01-05 00:01"), "StockCode": "b", "CustomerID": "Guest"},
    {"InvoiceDate": at("2020-01-05 23:59"), "InvoiceNo": "2", "Description": "other", "Quantity": 3},
    {"InvoiceDate": at("2020-01-06 10:00"), "InvoiceNo": "2", "Country": "Away", "CustomerID": "d"},
    {"InvoiceDate": at("2020-01-06 10:00"), "InvoiceNo": None, "Country": None, "CustomerID": None},
    {"InvoiceDate": None, "InvoiceNo": "3", "Description": None},
]


@pytest.mark.parametrize(
    "choice",
    [
        {},
        {"end": "2020-01-05"},
        {"start": "2020-01-05", "end": "2020-01-06"},
        {"start": "2020-01-06"},
        {"country": "Home"},
        {"product": "other"},
        {"customer_type": "Guest"},
        {"customer_type": "Registered", "country": "Away"},
        {"country": "nowhere"},
    ],
    ids=str,
)
def test_the_cube_gives_the_figures_of_its_sales(spark, choice, tmp_path_factory):
    sales = transactions(spark, _LINES)
    path = str(tmp_path_factory.getbasetemp() / "cube")
    built = cube.read(spark, path) if (tmp_path_factory.getbasetemp() / "cube").exists() else cube.build(sales, path)
    chosen, part = dashboard.filter_sales(sales, **choice), cube.choose(built, **choice)
    assert as_dicts(cube.kpis(part)) == as_dicts(dashboard.kpis(chosen))
    for figure in (dashboard.top_countries, dashboard.top_products, dashboard.hourly_revenue, explore.all_series, explore.weekday_revenue):
        rows = [sorted(map(str, figure(df).collect())) for df in (part.cells, chosen)]
        assert rows[0] == rows[1]
    assert as_dicts(explore.guest_split(part.cells)) == as_dicts(explore.guest_split(chosen))


def test_a_cube_counts_many_members_in_few_words(spark):
    lines = spark.range(5000).selectExpr(
        "CAST(id % 1500 AS string) AS InvoiceNo", "IF(id % 3 = 0, 'Guest', CAST(id % 700 AS string)) AS CustomerID",
        "timestamp_ntz'2020-01-06 10:00:00' AS InvoiceDate", "'Home' AS Country", "'thing' AS Description",
        "1 AS Quantity", "1.0D AS TotalPrice", "10 AS Hour",
    )
    built = cube.build(lines)
    assert as_dicts(cube.distinct_members(built)) == [{"invoices": 1500, "customers": 701}]
    # Two cells, of guests and of others.
    assert built.members.filter("Kind = 'invoice'").count() <= 2 * (1500 // 64 + 2)
    assert cube.build(lines.limit(0)).cells.isEmpty()


def test_a_cube_refuses_times_of_day(spark):
    with pytest.raises(ValueError, match="whole days"):
        cube.choose(cube.Cube(None, None), start="2020-01-05 10:00")


def test_reports_over_a_stored_table_copy_nothing(spark, tmp_path):
    path = str(tmp_path / "sales")
    transactions(spark, [{}]).write.parquet(path)
    for report in (explore.summary_panels, explore.insights):
        files = report(spark.read.parquet(path)).inputFiles()
        assert files and all(path in file for file in files)


def test_a_cube_reads_its_sales_twice(spark):
    lines = transactions(spark, [{"InvoiceNo": str(i % 9) if i % 9 else None, "CustomerID": [None, "Guest", "a", "b"][i % 4],
                                  "Country": ["X", None, "Y"][i % 3], "InvoiceDate": at(f"2020-01-0{1 + i % 5} 0{i % 7}:00")} for i in range(90)])
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    built = cube.build(lines.mapInArrow(counted, lines.schema))
    assert read.value == 2 * 90
    assert as_dicts(cube.distinct_members(built)) == [{"invoices": 8, "customers": 3}]
    per_country = {r["Country"]: (r["invoices"], r["customers"]) for r in as_dicts(cube.distinct_members(built, "Country"))}
    expected = lines.groupBy("Country").agg(F.count_distinct("InvoiceNo"), F.count_distinct("CustomerID")).collect()
    assert per_country == {r[0]: (r[1], r[2]) for r in expected}
    assert built.cells.agg(F.sum("Lines")).first()[0] == 90


def test_top_values_copy_no_row_per_column(spark):
    lines = raw(spark, [{"InvoiceNo": str(i % 3), "StockCode": str(i), "CustomerID": None, "Country": "ab"[i % 2]} for i in range(8)])
    found = profiling.top_values(lines, 2)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r["column"], r["rank"]): (r["value"], r["count"]) for r in as_dicts(found)}
    assert rows == {
        ("InvoiceNo", 1): ("0", 3), ("InvoiceNo", 2): ("1", 3), ("StockCode", 1): ("0", 1), ("StockCode", 2): ("1", 1),
        ("Description", 1): ("thing", 8), ("Country", 1): ("a", 4), ("Country", 2): ("b", 4),
    }
