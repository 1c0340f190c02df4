"""Identities and cases worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from pricewright.functions import columns as C
from pricewright.functions.udfs import geometric_prices, median_daily_price
from pricewright.operators import aggregates, cleaning, facts, indexes, joins, outliers, sets, windows
from pricewright.sources.tables import load

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def lineitem(spark, sf_dir):
    return load(spark, sf_dir, "lineitem")


@pytest.fixture(scope="module")
def lines(spark, sf_dir, lineitem):
    return facts.branded_lines(lineitem, load(spark, sf_dir, "part"))


def test_index_identities(lines):
    sales = facts.period_sales(lines, "p_brand", F.year("l_shipdate"))
    for r in indexes.price_index(sales, "p_brand", 1995).collect():
        assert r["fisher"] == pytest.approx(math.sqrt(r["laspeyres"] * r["paasche"]))
        if r["period"] == 1995:
            assert [r[c] for c in ("laspeyres", "paasche", "fisher", "jevons")] == pytest.approx([1, 1, 1, 1])


def test_index_by_hand(spark):
    rows = [("a", 1, 10.0, 4.0), ("a", 2, 20.0, 2.0), ("b", 1, 5.0, 8.0), ("b", 2, 5.0, 8.0), ("new", 2, 9.0, 1.0), ("gone", 1, 3.0, 1.0), (None, 1, 1.0, 1.0)]
    sales = spark.createDataFrame(rows, "item string, period int, price double, quantity double")
    r = indexes.price_index(sales, "item", 1).filter("period = 2").first()
    assert r["units"] == 2
    assert r["laspeyres"] == pytest.approx(120 / 80)  # (20*4 + 5*8) / (10*4 + 5*8)
    assert r["paasche"] == pytest.approx(80 / 60)  # (20*2 + 5*8) / (10*2 + 5*8)
    assert r["jevons"] == pytest.approx(math.sqrt(2))


def test_revenue_split_adds_up(lineitem):
    r = indexes.revenue_split(lineitem, 1996, 1997).first()
    parts = sum(r[c] for c in ("new_items", "lost_items", "price_effect", "volume_effect", "mix_effect"))
    assert parts == pytest.approx(r["revenue_2"] - r["revenue_1"], abs=0.01)


def test_cube_totals(lineitem):
    whole = lineitem.agg(F.sum(C.money("l_extendedprice")), F.count(F.lit(1))).first()
    cube = aggregates.revenue_cube(lineitem)
    for flags, statuses in ((0, 0), (0, 1), (1, 0), (1, 1)):
        level = cube.filter((F.col("all_flags") == flags) & (F.col("all_statuses") == statuses))
        assert tuple(level.agg(F.sum("amount"), F.sum("lines")).first()) == tuple(whole)


def test_market_price_leaves_one_out(lineitem):
    own = windows.supplier_prices(lineitem).groupBy("l_partkey").agg(F.sum("price").alias("total"), F.count(F.lit(1)).alias("n"))
    back = windows.market_gap(lineitem).join(own, "l_partkey").filter("n > 1")
    off = back.filter(F.abs(F.col("price") + F.col("market_price") * (F.col("n") - 1) - F.col("total")) > 1e-6)
    assert off.isEmpty()


def test_one_supplier_zero_and_null_quantity(spark):
    rows = [(1, 7, 2.0, 10.0), (2, 7, 0.0, 10.0), (2, 8, None, 10.0), (3, 7, 4.0, None)]
    df = spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double")
    prices = {(r[0], r[1]): r[2] for r in df.select("l_partkey", "l_suppkey", C.unit_price()).collect()}
    assert prices == {(1, 7): 5.0, (2, 7): None, (2, 8): None, (3, 7): None}
    alone = windows.market_gap(df.filter("l_partkey = 1")).first()
    assert (alone["price"], alone["market_price"], alone["gap"]) == (5.0, None, None)


def test_dedupe_keeps_one_whole_row(spark, lineitem):
    kept = cleaning.dedupe_lines(lineitem)
    assert kept.count() == lineitem.select("l_orderkey", "l_linenumber").distinct().count()
    assert kept.exceptAll(lineitem).isEmpty()


def test_quality_report_sees_faults(spark):
    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz"
    rows = [(1, 1, 1.0, 5.0, 0.05, DAY), (1, 1, 0.0, 5.0, 0.5, DAY), (2, 1, None, -1.0, None, DAY), (None, 1, 1.0, 1.0, 0.0, DAY)]
    r = cleaning.quality_report(spark.createDataFrame(rows, schema)).first()
    assert (r["rows"], r["surplus_keys"]) == (4, 1)
    assert (r["null_share_quantity"], r["null_share_discount"], r["null_share_shipdate"]) == (0.25, 0.25, 0.0)
    assert (r["bad_discount"], r["bad_quantity"], r["bad_price"]) == (1, 1, 1)


def _events(spark, rows):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.createDataFrame([(i, DAY + dt.timedelta(minutes=m), u, t, v, None) for i, m, u, t, v in rows], schema)


def test_asof_finds_a_row_with_null_and_counts_ties(spark):
    events = _events(spark, [
        (1, 0, 1, "view", 5.0), (2, 5, 1, "view", None), (3, 6, 1, "purchase", 9.0),
        (4, 10, 2, "view", 7.0), (5, 10, 2, "purchase", 9.0), (6, 20, 3, "purchase", 9.0), (7, 30, 3, "view", 1.0),
    ])
    for rows in (1 << 40, 0):
        got = {r["event_id"]: (r["view_ts"], r["view_value"]) for r in joins.last_view_before_purchase(events, rows).collect()}
        assert got == {3: (DAY + dt.timedelta(minutes=5), None), 5: (DAY + dt.timedelta(minutes=10), 7.0), 6: (None, None)}


def test_bands_at_their_edges(spark):
    prices = [0.0, 0.5, 99.99, 100.0, 499.99, 500.0, 1000.0, 4999.99, 5000.0, 2.0**45]
    df = spark.createDataFrame([(p,) for p in prices], "unit_price double")
    got = [r["band"] for r in joins.in_bands(df, joins.price_bands(spark)).orderBy("unit_price").collect()]
    assert got == ["under 100"] * 3 + ["100-500"] * 2 + ["500-1000"] + ["1000-5000"] * 2 + ["5000 up"] * 2


def test_semi_and_anti_cover_the_orders(spark, sf_dir, lineitem):
    orders = load(spark, sf_dir, "orders")
    assert joins.orders_with_lines(orders, lineitem).count() + joins.orders_without_lines(orders, lineitem).count() == orders.count()


def test_bag_difference(spark):
    def sold(year, n):
        return [(1, dt.datetime(year, 3, 1))] * n

    lines = spark.createDataFrame(sold(1996, 5) + sold(1997, 2), "l_partkey long, l_shipdate timestamp_ntz")
    for block in (1, 2, 1_000_000):
        assert sets.surplus_sales(lines, 1996, 1997, block).count() == 3
    assert sets.sold_only_first(lines, 1996, 1997).count() == 0
    assert sets.sold_in_both(lines, 1996, 1997).count() == 1


def test_bag_difference_is_except_all(lineitem):
    a, b = (facts.in_year(lineitem, y).select("l_partkey") for y in (1996, 1997))
    got, want = sets.surplus_sales(lineitem, 1996, 1997, 2), a.exceptAll(b)
    assert sorted(got.collect()) == sorted(want.collect())


def test_discount_bands_on_their_edges(spark):
    df = spark.createDataFrame([(d / 100,) for d in range(11)], "l_discount double")
    assert [r[0] for r in df.select(C.discount_band()).collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5]


def test_price_change_and_rolling_by_hand(spark):
    at = lambda d: DAY + dt.timedelta(days=d)
    rows = [(1, at(0), 1.0, 10.0), (1, at(0), 3.0, 10.0), (1, at(10), 1.0, 8.0), (1, at(41), 1.0, 6.0)]
    daily = facts.daily_prices(spark.createDataFrame(rows, "l_partkey long, l_shipdate timestamp_ntz, l_quantity double, l_extendedprice double"))
    change = windows.price_change(daily).orderBy("day").collect()
    assert [(r["price"], r["previous_price"], r["days_since"], r["change"]) for r in change] == [
        (5.0, None, None, None), (8.0, 5.0, 10, 3.0), (6.0, 8.0, 31, -2.0)]
    rolling = windows.rolling_price(daily).orderBy("day").collect()
    assert [(r["lines"], round(r["rolling_price"], 6)) for r in rolling] == [(2, 6.666667), (3, 7.111111), (1, 6.0)]
    years = windows.open_close(daily).collect()
    assert [(r["open"], r["close"], r["high"], r["low"]) for r in years] == [(5.0, 6.0, 8.0, 5.0)]


def test_classes_cover_everything(lineitem):
    out = windows.revenue_classes(lineitem)
    assert out.agg(F.max("cum_share")).first()[0] == pytest.approx(1.0)
    assert out.count() == lineitem.select("l_partkey").distinct().count()


def test_outliers_by_hand(spark):
    df = spark.createDataFrame([("b", float(p)) for p in [10, 11, 12, 13, 14, 100]], "p_brand string, unit_price double")
    assert [r["unit_price"] for r in outliers.quartile_outliers(df).collect()] == [100.0]
    r = outliers.median_deviation(df).first()
    assert (r["median_price"], r["mad"]) == (12.5, 1.5)


def test_python_functions_agree_with_built_ins(lines, lineitem):
    daily = facts.period_sales(lines, "p_brand", F.to_date("l_shipdate"), "day")
    geo = geometric_prices(daily, "p_brand").withColumn("off", F.abs(F.col("geo_price") - F.col("geo_price_check")))
    assert geo.agg(F.max("off")).first()[0] < 1e-6
    days = facts.daily_prices(lineitem)
    both = median_daily_price(days).join(days.groupBy("l_partkey").agg(F.median("price").alias("m")), "l_partkey")
    assert both.filter(F.abs(F.col("median_price") - F.col("m")) > 1e-9).isEmpty()


def test_money_past_2_53_cents(spark):
    df = spark.range(20_000).select(F.lit(9_999_999_999_999.37).alias("x"))
    got, want = df.agg(C.summed_money("x"), F.sum(F.col("x").cast("decimal(18,2)")).cast("double")).first()
    assert got == want


def test_bands_below_zero(spark):
    bands = spark.createDataFrame([("loss", -100.0, 0.0), ("deep", float("-inf"), -100.0), ("gain", 0.0, float("inf"))], "band string, low double, high double")
    prices = [-1e9, -100.1, -100.0, -5.0, -0.5, 0.0, 3.0]
    df = spark.createDataFrame([(p,) for p in prices], "unit_price double")
    got = [r["band"] for r in joins.in_bands(df, bands).orderBy("unit_price").collect()]
    assert got == ["deep"] * 2 + ["loss"] * 3 + ["gain"] * 2


def test_years_follow_the_data(spark):
    lines = spark.createDataFrame([("b", 2.0, dt.datetime(y, 5, 1)) for y in (1999, 2002)], "p_brand string, unit_price double, l_shipdate timestamp_ntz")
    years = aggregates.years_of(lines, "l_shipdate")
    matrix = aggregates.price_matrix(lines.withColumn("year", F.year("l_shipdate")), years)
    assert matrix.columns == ["p_brand", "y1999", "y2000", "y2001", "y2002"]
    assert aggregates.price_list(matrix, years).filter("mean_price is not null").count() == 2
