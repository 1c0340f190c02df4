"""The registered queries: operators on the given tables, with fixed output types.

Rounding and casts live here, not in the operators: they only make results
comparable with those of another engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricewright.functions import columns as C, udfs
from pricewright.operators import aggregates, cleaning, facts, indexes, joins, outliers, quantiles, sets, sketches, windows
from pricewright.session import fresh_path, written
from pricewright.sources.sinks import write_by_year
from pricewright.sources.tables import load, load_stream, stream_path
from pricewright.streaming import activity
from pricewright.streaming.run import SLICE_ROWS, StreamTable, stream_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# A key with more rows is heavy in the ``*_split`` queries, which test the split forms.
FEW_ROWS = 20
QUARTILES = {"p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Round, with a billionth added first: prices often end in an exact half
    in decimal, which engines see on either side in binary."""
    return df.withColumns({c: F.round(F.col(c).cast("double") + 1e-9, places) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _branded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.branded_lines(load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.daily_prices(load(spark, sf_dir, "lineitem"))


# -- sources, sinks, cleaning ------------------------------------------------------


@query
def price_fact(spark, sf_dir):
    fact = facts.price_fact(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", "p_brand", "n_name", "r_name", "unit_price",
        "net_price", "discount_amount", "year", "month",
    )
    return longs(doubles(fact, "net_price", "discount_amount"), "l_linenumber", "year", "month")


@query
def written_by_year(spark, sf_dir):
    """Write by year and read all of it back."""
    path = fresh_path(spark, "by-year")
    write_by_year(load(spark, sf_dir, "lineitem"), path)
    back = spark.read.parquet(path)
    out = back.groupBy("y").agg(F.count(F.lit(1)).alias("lines"), F.sum(C.money("l_extendedprice")).alias("amount"))
    return doubles(longs(out, "y"), "amount")


@query
def deduped_lines(spark, sf_dir):
    kept = cleaning.dedupe_lines(load(spark, sf_dir, "lineitem"))
    return longs(kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "l_linenumber")


@query
def quality_report(spark, sf_dir):
    return cleaning.quality_report(load(spark, sf_dir, "lineitem"))


# -- aggregates --------------------------------------------------------------------


@query
def price_summary(spark, sf_dir):
    out = aggregates.price_summary(_branded(spark, sf_dir))
    return rounded(out, "mean_price", "sd_price", "min_price", "max_price", "weighted_price")


@query
def price_quantiles(spark, sf_dir):
    return rounded(quantiles.exact_quantiles(_branded(spark, sf_dir), ["p_brand"], "unit_price", QUARTILES), *QUARTILES)


@query
def price_quantiles_approx(spark, sf_dir):
    """Whether each estimate's rank is as near as promised."""
    accuracy, lines = 1000, _branded(spark, sf_dir).select("p_brand", "unit_price")
    estimates = aggregates.approx_quantiles(lines, "p_brand", QUARTILES, accuracy)
    ranks = lines.join(estimates, "p_brand").groupBy("p_brand").agg(
        F.count("unit_price").alias("n"),
        *[F.count_if(F.col("unit_price") < F.col(q)).alias(f"{q}_below") for q in QUARTILES],
        *[F.count_if(F.col("unit_price") <= F.col(q)).alias(f"{q}_upto") for q in QUARTILES],
    )
    slack = F.col("n") / accuracy + 1
    near = [(F.col(f"{q}_below") - slack <= p * F.col("n")) & (p * F.col("n") <= F.col(f"{q}_upto") + slack) for q, p in QUARTILES.items()]
    return ranks.select("p_brand", "n", *[ok.alias(f"{q}_near") for q, ok in zip(QUARTILES, near, strict=True)])


@query
def products_approx(spark, sf_dir):
    """The exact count, and whether the estimate is within three deviations."""
    rsd, lines = 0.02, _branded(spark, sf_dir).select("p_brand", "l_partkey")
    exact = lines.groupBy("p_brand").agg(F.count_distinct("l_partkey").alias("exact"))
    both = exact.join(aggregates.approx_products(lines, "p_brand", rsd), "p_brand")
    near = F.abs(F.col("products") - F.col("exact")) <= 3 * rsd * F.col("exact") + 1
    return both.select("p_brand", F.col("exact").alias("products"), near.alias("near"))


@query
def products_by_year_sketched(spark, sf_dir):
    """The exact count per brand and year, and whether that of merged daily sketches is within three deviations."""
    lines = _branded(spark, sf_dir).select("p_brand", "l_partkey", "l_shipdate")
    stored = written(sketches.daily_sketches(lines, ["p_brand"], "l_partkey", "l_shipdate"), "daily-sketches")
    estimates = sketches.merged_counts(stored, ["p_brand"], F.year("day"), "year")
    exact = lines.groupBy("p_brand", F.year("l_shipdate").alias("year")).agg(F.count_distinct("l_partkey").alias("products"))
    near = F.abs(F.col("items") - F.col("products")) <= 3 * sketches.ERROR * F.col("products") + 1
    return longs(exact.join(estimates, ["p_brand", "year"]), "year").select("p_brand", "year", "products", near.alias("near"))


@query
def price_shape(spark, sf_dir):
    return rounded(aggregates.price_shape(_branded(spark, sf_dir)), "skewness", "kurtosis")


@query
def revenue_cube(spark, sf_dir):
    out = aggregates.revenue_cube(load(spark, sf_dir, "lineitem"))
    return doubles(longs(out, "all_flags", "all_statuses", "lines"), "amount", "net")


@query
def revenue_rollup(spark, sf_dir):
    out = aggregates.revenue_rollup(load(spark, sf_dir, "lineitem"))
    return doubles(longs(out, "level", "lines"), "amount", "net")


@query
def revenue_grouping_sets(spark, sf_dir):
    out = aggregates.revenue_grouping_sets(load(spark, sf_dir, "lineitem"))
    return doubles(longs(out, "level", "lines"), "amount", "net")


@query
def net_revenue(spark, sf_dir):
    out = aggregates.net_revenue(load(spark, sf_dir, "lineitem"), F.year("l_shipdate").alias("year"), "l_returnflag")
    return doubles(longs(out, "year"), "gross", "discount", "net")


@query
def discount_bands(spark, sf_dir):
    return rounded(longs(aggregates.discount_bands(load(spark, sf_dir, "lineitem")), "band"), "mean_price", "share")


@query
def lead_time_curve(spark, sf_dir):
    out = aggregates.lead_time_curve(load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders"))
    return rounded(out, "mean_price", "mean_discount")


@query
def seasonal_index(spark, sf_dir):
    return rounded(longs(aggregates.seasonal_index(load(spark, sf_dir, "lineitem")), "month"), "mean_price", "seasonal")


@query
def price_elasticity(spark, sf_dir):
    return rounded(aggregates.price_elasticity(_branded(spark, sf_dir)), "slope", "intercept", "r2")


def _matrix(spark, sf_dir):
    """The matrix over all years of the table, and those years."""
    lines = _branded(spark, sf_dir).withColumn("year", F.year("l_shipdate"))
    years = aggregates.years_of(load(spark, sf_dir, "lineitem"), "l_shipdate")
    return aggregates.price_matrix(lines, years), years


@query
def price_matrix(spark, sf_dir):
    matrix, years = _matrix(spark, sf_dir)
    return rounded(matrix, *[f"y{y}" for y in years])


@query
def price_list(spark, sf_dir):
    return rounded(longs(aggregates.price_list(*_matrix(spark, sf_dir)), "year"), "mean_price")


# -- joins ---------------------------------------------------------------------------


@query
def asof_last_view(spark, sf_dir):
    return joins.last_view_before_purchase(load(spark, sf_dir, "events"))


@query
def asof_two_tables(spark, sf_dir):
    """As-of between two frames: each error with the user's last click."""
    events = load(spark, sf_dir, "events")
    errors = events.filter(F.col("event_type") == "error").select("event_id", "user_id", "ts")
    clicks = events.filter(F.col("event_type") == "click").select("event_id", "user_id", "ts", "value")
    return joins.asof_join(errors, clicks, "user_id", "ts", "ts", ["ts", "value"], "event_id")


@query
def asof_by_number(spark, sf_dir):
    return joins.last_view_by_number(load(spark, sf_dir, "events"))


@query
def interval_join(spark, sf_dir):
    return joins.views_then_purchases(load(spark, sf_dir, "events"))


@query
def band_join(spark, sf_dir):
    lines = facts.priced_lines(load(spark, sf_dir, "lineitem"))
    out = joins.in_bands(lines, joins.price_bands(spark)).groupBy("band").agg(
        F.count(F.lit(1)).alias("lines"), F.avg("unit_price").alias("mean_price")
    )
    return rounded(out, "mean_price")


@query
def orders_with_lines(spark, sf_dir):
    out = joins.orders_with_lines(load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem"))
    return out.select("o_orderkey", "o_custkey", "o_totalprice")


@query
def orders_without_lines(spark, sf_dir):
    out = joins.orders_without_lines(load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem"))
    return out.select("o_orderkey", "o_custkey", "o_totalprice")


@query
def matched_periods(spark, sf_dir):
    return joins.match_periods(load(spark, sf_dir, "lineitem"), 1996, 1997)


# -- windows ---------------------------------------------------------------------------


@query
def supplier_position(spark, sf_dir):
    return longs(windows.supplier_position(load(spark, sf_dir, "lineitem")), "rank", "dense_rank", "tile")


@query
def market_gap(spark, sf_dir):
    return rounded(windows.market_gap(load(spark, sf_dir, "lineitem")), "market_price", "gap", places=4)


@query
def median_gap(spark, sf_dir):
    return rounded(longs(windows.median_gap(load(spark, sf_dir, "lineitem")), "l_linenumber"), "median_price", "gap", places=4)


@query
def price_change(spark, sf_dir):
    return longs(windows.price_change(_daily(spark, sf_dir)), "days_since")


@query
def rolling_price(spark, sf_dir):
    return rounded(windows.rolling_price(_daily(spark, sf_dir)), "rolling_price", places=4)


@query
def rolling_activity(spark, sf_dir):
    return doubles(longs(windows.rolling_activity(load(spark, sf_dir, "events")), "events_1d"), "value_1d")


@query
def open_close(spark, sf_dir):
    return longs(windows.open_close(_daily(spark, sf_dir)), "year")


@query
def revenue_classes(spark, sf_dir):
    return rounded(doubles(windows.revenue_classes(load(spark, sf_dir, "lineitem")), "revenue"), "cum_share")


@query
def list_price_position(spark, sf_dir):
    return rounded(windows.list_price_position(load(spark, sf_dir, "part")), "percent_rank", "cume_dist")


@query
def top_prices(spark, sf_dir):
    return longs(windows.top_prices(_branded(spark, sf_dir)), "place", "l_linenumber")


# -- the forms for heavy keys, with keys that count as heavy early -----------------------


@query
def asof_last_view_split(spark, sf_dir):
    return joins.last_view_before_purchase(load(spark, sf_dir, "events"), FEW_ROWS)


@query
def asof_by_number_split(spark, sf_dir):
    return joins.last_view_by_number(load(spark, sf_dir, "events"), FEW_ROWS)


@query
def supplier_position_split(spark, sf_dir):
    return longs(windows.supplier_position(load(spark, sf_dir, "lineitem"), rows=FEW_ROWS), "rank", "dense_rank", "tile")


@query
def market_gap_split(spark, sf_dir):
    return rounded(windows.market_gap(load(spark, sf_dir, "lineitem"), FEW_ROWS), "market_price", "gap", places=4)


@query
def median_gap_split(spark, sf_dir):
    return rounded(longs(windows.median_gap(load(spark, sf_dir, "lineitem"), FEW_ROWS), "l_linenumber"), "median_price", "gap", places=4)


@query
def rolling_activity_split(spark, sf_dir):
    return doubles(longs(windows.rolling_activity(load(spark, sf_dir, "events"), FEW_ROWS), "events_1d"), "value_1d")


# -- indexes, outliers, sets -------------------------------------------------------------


@query
def price_index(spark, sf_dir):
    sales = facts.period_sales(_branded(spark, sf_dir), "p_brand", F.year("l_shipdate"))
    out = longs(indexes.price_index(sales, "p_brand", 1995), "period")
    return rounded(out, "laspeyres", "paasche", "fisher", "jevons")


@query
def revenue_split(spark, sf_dir):
    out = indexes.revenue_split(load(spark, sf_dir, "lineitem"), 1996, 1997)
    return rounded(out, *out.columns, places=2)


@query
def quartile_outliers(spark, sf_dir):
    out = outliers.quartile_outliers(_branded(spark, sf_dir))
    out = out.select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "unit_price", "low", "high")
    return rounded(longs(out, "l_linenumber"), "low", "high", places=4)


@query
def median_deviation(spark, sf_dir):
    return rounded(outliers.median_deviation(_branded(spark, sf_dir)), "median_price", "mad")


@query
def sold_in_both_years(spark, sf_dir):
    return sets.sold_in_both(load(spark, sf_dir, "lineitem"), 1996, 1997)


@query
def sold_only_first_year(spark, sf_dir):
    return sets.sold_only_first(load(spark, sf_dir, "lineitem"), 1996, 1997)


@query
def surplus_sales(spark, sf_dir):
    return sets.surplus_sales(load(spark, sf_dir, "lineitem"), 1996, 1997)


@query
def stacked_series(spark, sf_dir):
    return doubles(sets.stacked_series(load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "events")), "amount")


# -- scalar functions ----------------------------------------------------------------------


@query
def number_functions(spark, sf_dir):
    p = C.unit_price()
    out = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice",
        F.ln(p).alias("ln_price"),
        F.exp(-F.col("l_discount")).alias("exp_discount"),
        F.sqrt("l_quantity").alias("sqrt_quantity"),
        F.floor(p).alias("floor_price"),
        F.abs(F.col("l_discount") - F.col("l_tax")).alias("abs_spread"),
        F.coalesce(F.nullif("l_tax", F.lit(0.0)), F.lit(-1.0)).alias("tax_or_none"),
        F.when(F.col("l_quantity") >= 25, "bulk").otherwise("retail").alias("size"),
    )
    return rounded(out, "ln_price", "exp_discount", "sqrt_quantity", "abs_spread")


@query
def date_functions(spark, sf_dir):
    out = load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        C.iso_weekday("o_orderdate").alias("weekday"),
        C.month_start("o_orderdate").alias("month_start"),
        F.datediff(F.lit("2002-01-01").cast("date"), "o_orderdate").alias("age_days"),
    )
    return longs(out, "year", "month", "weekday", "age_days")


@query
def text_functions(spark, sf_dir):
    out = load(spark, sf_dir, "part").select(
        "p_partkey",
        C.name_word("p_name", 1).alias("colour"),
        F.upper(C.name_word("p_name", 2)).alias("kind"),
        C.brand_number().alias("brand_number"),
    )
    return longs(out, "brand_number")


@query
def json_functions(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", C.prop("k").cast("bigint").alias("k"))


# -- streams -----------------------------------------------------------------------------------


def _emitted(spark, sf_dir, label: str, build: Callable[[Callable[[], DataFrame]], DataFrame]) -> DataFrame:
    """What ``build``, given a maker of event streams, emits over the stored events."""
    return stream_table(
        spark,
        stream_path(sf_dir, "events"),
        load(spark, sf_dir, "events"),
        lambda folder: build(lambda: load_stream(spark, folder, "events")),
        label,
        SLICE_ROWS,
    )


def _clock(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _windows(spark, sf_dir, label: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    emitted = _emitted(spark, sf_dir, label, lambda events: operator(events()))
    return doubles(_clock(emitted, "window_start", "window_end"), "value")


@query
def stream_tumbling(spark, sf_dir):
    return _windows(spark, sf_dir, "tumbling", activity.tumbling_activity)


@query
def stream_sliding(spark, sf_dir):
    return _windows(spark, sf_dir, "sliding", activity.sliding_activity)


@query
def stream_sessions(spark, sf_dir):
    return _windows(spark, sf_dir, "sessions", activity.session_activity)


@query
def stream_without_duplicates(spark, sf_dir):
    """The events sent twice, kept once."""

    def kept(events):
        distinct = activity.without_duplicates(events().unionByName(events()))
        return distinct.select("event_id", "ts", "user_id", "event_type", "value")

    return _clock(_emitted(spark, sf_dir, "distinct-events", kept), "ts")


@query
def stream_interval_join(spark, sf_dir):
    pairs = _emitted(spark, sf_dir, "pairs", lambda events: activity.view_purchase_pairs(events(), events()))
    return _clock(pairs, "view_ts", "purchase_ts")


@query
def stream_previous_value(spark, sf_dir):
    return _clock(_emitted(spark, sf_dir, "previous", lambda events: activity.previous_value(events())), "ts")


@query
def stream_late_rows(spark, sf_dir):
    """Events from 15 January 2024 arrive first, the earlier ones too late."""
    events = load(spark, sf_dir, "events")
    late = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    table = StreamTable(spark, "late-rows", expect_late=True)
    for arrived in (events.filter(~late), events.filter(late)):
        table.arrive(arrived, lambda: activity.without_duplicates(load_stream(spark, table.arrivals, "events")), closes=F.col("ts"))
    came = spark.read.schema(events.schema).parquet(table.arrivals)
    dropped = spark.read.schema(events.schema).parquet(table.late_path)
    both = came.select(F.lit(1).alias("came"), F.lit(0).alias("late")).unionByName(dropped.select(F.lit(0).alias("came"), F.lit(1).alias("late")))
    return both.agg(F.sum("came").cast("bigint").alias("input_rows"), F.sum("late").cast("bigint").alias("dropped_rows"))


@query
def stream_batch_sink(spark, sf_dir):
    """A stateless stream into one directory per batch."""
    stream = load_stream(spark, stream_path(sf_dir, "events")).select("event_id", "ts", "user_id", "event_type", "value")
    return _clock(StreamTable(spark, "batches").append_batches(stream).read(stream).select(*stream.columns), "ts")


# -- user functions ------------------------------------------------------------------------------


@query
def udf_geometric_mean(spark, sf_dir):
    daily = facts.period_sales(_branded(spark, sf_dir), "p_brand", F.to_date("l_shipdate"), "day")
    return rounded(longs(udfs.geometric_prices(daily, "p_brand"), "year"), "geo_price", "geo_price_check")


@query
def udf_price_trend(spark, sf_dir):
    return rounded(udfs.price_trend(_branded(spark, sf_dir)), "slope")


@query
def udtf_price_steps(spark, sf_dir):
    ranges = _branded(spark, sf_dir).groupBy("p_brand").agg(F.min("unit_price").alias("low"), F.max("unit_price").alias("high"))
    return rounded(longs(udfs.price_steps(ranges, "p_brand", 4), "step"), "low", "high", places=4)


@query
def udf_median_daily_price(spark, sf_dir):
    return rounded(udfs.median_daily_price(_daily(spark, sf_dir)), "median_price")
