"""Split forms for heavy keys give what the plain forms give."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from pricewright.operators import joins, skew, windows
from pricewright.operators.quantiles import exact_quantiles, group_quantiles
from pricewright.sources.tables import load

NEVER = 1 << 40  # no key is heavy
T0 = dt.datetime(2024, 1, 1)


def rows_of(df, places=6):
    names = sorted(df.columns)
    tidy = lambda v: round(float(v), places) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(tidy(r[n]) for n in names) for r in df.collect()), key=repr)


def same(plain, split, places=6):
    assert rows_of(plain, places) == rows_of(split, places)


@pytest.fixture(scope="module")
def lineitem(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").cache()


@pytest.fixture(scope="module")
def lopsided_lines(spark):
    """A third of the lines are of one product, many at one price."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        part = 1 if i % 3 == 0 else rng.randrange(2, 60)
        if part == 1 and i % 2:
            price = 20.0
        else:
            price = rng.choice([5.0, 7.5, 20.0, 1e6, round(rng.uniform(1, 500), 2)])
        quantity = float(rng.randrange(1, 5))
        rows.append((i, part, rng.randrange(0, 400_000) if part == 1 else rng.randrange(0, 20), 1, quantity, price * quantity))
    return spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").cache()


@pytest.fixture(scope="module")
def lopsided_events(spark):
    """A third of the events are one user's, another part has no user; some
    share an instant and some values are null."""
    rng = random.Random(6)
    rows = []
    for i in range(2400):
        user = 1 if i % 3 == 0 else (None if i % 7 == 0 else rng.randrange(2, 40))
        at = T0 + dt.timedelta(seconds=rng.randrange(0, 4 * 86400, 20))
        value = None if rng.random() < 0.1 else round(rng.uniform(0, 90), 2)
        rows.append((i, at, user, rng.choice(["view", "purchase", "click"]), value, None))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.createDataFrame(rows, schema).cache()


@pytest.mark.parametrize("rows", [0, 40, 500])
@pytest.mark.parametrize("op", [windows.supplier_position, windows.market_gap, windows.median_gap])
def test_products(lopsided_lines, op, rows):
    same(op(lopsided_lines, rows=NEVER), op(lopsided_lines, rows=rows), 4)


@pytest.mark.parametrize("op", [windows.supplier_position, windows.market_gap, windows.median_gap])
def test_products_given_table(lineitem, op):
    same(op(lineitem, rows=NEVER), op(lineitem, rows=30), 4)


def test_positions_without_a_product(spark):
    """A null product is one of its own, apart from product 0, also where prices tie."""
    rows = [(i, (None, 0, 5)[i % 3], i // 3, 1, float(i % 2 + 1), (10.0, 10.05, 30.0, 10.0)[i % 4]) for i in range(300)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").cache()
    for limit in (0, 15, 40):
        same(windows.supplier_position(lines, rows=NEVER), windows.supplier_position(lines, rows=limit), 4)


def test_positions_shuffle_few_times(lopsided_lines):
    """Prices are shuffled to their cells; only cell totals go further."""
    split = windows.supplier_position(lopsided_lines, rows=600)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange hashpartitioning") <= 5


@pytest.mark.parametrize("rows", [0, 50, 500])
@pytest.mark.parametrize("op", [windows.rolling_activity, joins.last_view_before_purchase])
def test_users(lopsided_events, op, rows):
    same(op(lopsided_events, rows=NEVER), op(lopsided_events, rows=rows))


def test_users_by_number(lopsided_events):
    known = lopsided_events.filter("user_id is not null")
    same(joins.last_view_by_number(known, NEVER), joins.last_view_by_number(known, 50))
    same(joins.last_view_by_number(known, 50), joins.last_view_before_purchase(known, NEVER))


def test_asof_against_all_pairs(lopsided_events):
    """Brute force on a small table."""
    events = [r.asDict() for r in lopsided_events.collect()]
    views = [e for e in events if e["event_type"] == "view"]
    expected = []
    for p in events:
        if p["event_type"] != "purchase":
            continue
        before = [v for v in views if v["user_id"] == p["user_id"] and p["user_id"] is not None and v["ts"] <= p["ts"]]
        last = max(before, key=lambda v: (v["ts"], v["event_id"]), default=None)
        expected.append((p["event_id"], last and last["ts"], last and last["value"]))
    for rows in (NEVER, 0):
        got = joins.last_view_before_purchase(lopsided_events, rows).select("event_id", "view_ts", "view_value").collect()
        assert sorted(map(tuple, got)) == sorted(expected)
        left = lopsided_events.filter("event_type = 'purchase'")
        right = lopsided_events.filter("event_type = 'view'")
        two = joins.asof_join(left, right, "user_id", "ts", "ts", ["ts", "value"], "event_id", rows=rows)
        assert sorted(map(tuple, two.select("event_id", "last_ts", "last_value").collect())) == sorted(expected)


def test_interval_against_all_pairs(lopsided_events):
    events = lopsided_events.collect()
    hour = dt.timedelta(hours=1)
    expected = sorted(
        (v["event_id"], p["event_id"])
        for v in events
        for p in events
        if v["event_type"] == "view" and p["event_type"] == "purchase" and v["user_id"] is not None
        and v["user_id"] == p["user_id"] and v["ts"] <= p["ts"] <= v["ts"] + hour
    )
    got = joins.views_then_purchases(lopsided_events).select("view_id", "purchase_id").collect()
    assert sorted(map(tuple, got)) == expected


def test_no_heavy_key_means_the_plain_plan(lopsided_lines):
    out = skew.by_heat(lopsided_lines, ["l_partkey"], lambda df: df, lambda df: 1 / 0, NEVER)
    assert out is lopsided_lines


def test_running_total(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([1, 1, 1, 5, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long")
    got = skew.running_total(df, [F.desc("v"), F.asc("id")], "v", "running", "total")
    w = Window.orderBy(F.desc("v"), F.asc("id")).rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("running", F.sum("v").over(w)).withColumn("total", F.lit(sum(v for _, v in rows)))
    same(want, got)


def test_list_price_position_heavy_prices(spark):
    rows = [(i, 10.0 if i % 3 == 0 else float(i % 50)) for i in range(300)] + [(900, None)]
    part = spark.createDataFrame(rows, "p_partkey long, p_retailprice double")
    w = Window.orderBy("p_retailprice")
    want = part.select("*", F.percent_rank().over(w).alias("percent_rank"), F.cume_dist().over(w).alias("cume_dist"))
    for heavy in (NEVER, 3):
        same(want, windows.list_price_position(part, heavy))


def test_exact_quantiles(spark):
    rng = random.Random(8)
    rows = [("ties", 3.0)] * 40 + [("one", -2.5), ("null", None), (None, 4.0), (None, 8.0)]
    rows += [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-6, 9)) for _ in range(300)] + [("wide", 0.0)] * 7
    rows += [("near", 100 + rng.random() * 1e-3) for _ in range(200)] + [("near", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p90": 0.9, "high": 1.0}
    same(group_quantiles(df, ["k"], "v", probs), exact_quantiles(df, ["k"], "v", probs))


def test_price_step_keeps_order(spark):
    from pricewright.functions.columns import price_step

    values = [float("-inf"), -1e300, -7.0, -1e-300, 0.0, 5e-324, 1e-9, 0.5, 1.0, 1.001, 2.0, 1e5, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    steps = [r[0] for r in df.orderBy("i").select(price_step("v")).collect()]
    assert steps == sorted(steps)


def test_rolling_activity_against_a_range_frame(lopsided_events):
    frame = "(partition by user_id order by ts range between interval 1 day preceding and current row)"
    value = "coalesce(sum(cast(value as decimal(18,2))) over " + frame + ", 0) as value_1d"
    want = lopsided_events.selectExpr("event_id", "user_id", "ts", f"count(1) over {frame} as events_1d", value)
    same(want, windows.rolling_activity(lopsided_events, NEVER))


@pytest.mark.parametrize("op", [windows.rolling_activity, joins.last_view_before_purchase, joins.last_view_by_number])
def test_one_busy_user_in_one_instant(spark, op):
    """With times of day grain a key's rows are cut all the same."""
    rows = [(i, T0, 1, "view" if i % 2 else "purchase", float(i), None) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    same(op(events, rows=NEVER), op(events, rows=10))


def test_cells_cut_an_instant(spark):
    rows = [(1, T0, i) for i in range(1000)]
    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # else a small table is one partition
    spark.conf.set(merge, "false")
    try:
        cells = skew.in_cells(spark.createDataFrame(rows, "k long, t timestamp_ntz, i long"), ["k", "t", "i"], "cell")
    finally:
        spark.conf.set(merge, "true")
    assert cells.select("cell").distinct().count() > 1


def test_asof_join_with_a_map_column(spark):
    left = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=m)) for m in range(50)], "k long, t timestamp_ntz")
    right = spark.createDataFrame([(1, T0 + dt.timedelta(minutes=2 * m), m, {"m": m}) for m in range(20)], "k long, t timestamp_ntz, i long, props map<string,int>")
    plain, split = (joins.asof_join(left, right, "k", "t", "t", ["props"], "i", rows=n).selectExpr("t", "last_props['m'] as m") for n in (NEVER, 5))
    same(plain, split)
