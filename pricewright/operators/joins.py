"""As-of, interval, band and matching joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

from pricewright.functions import columns as C
from pricewright.operators.facts import in_year, period_sales
from pricewright.operators.skew import HOT_ROWS, by_heat, in_cells, latest, with_carry
from pricewright.session import written

# -- as-of -----------------------------------------------------------------------
#
# Both sides lie in one frame: _key, _t, _kind (0 to look up, 1 looking), _tie,
# and a struct per side. A struct, since the row found may hold nulls.


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_ts: str,
    right_ts: str,
    take: list[str],
    tie: str,
    prefix: str = "last_",
    rows: int = HOT_ROWS,
) -> DataFrame:
    """Each left row with the ``take`` columns of the latest right row of its
    key at or before it, or nulls. ``tie`` orders right rows of one instant."""
    found = F.struct(*[F.col(c).alias(prefix + c) for c in take])
    looking = left.select(
        F.col(key).alias("_key"), F.col(left_ts).alias("_t"), F.lit(1).alias("_kind"), F.struct("*").alias("_left")
    )
    lookup = right.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(right_ts).alias("_t"), F.lit(0).alias("_kind"), F.col(tie).alias("_tie"), found.alias("_right")
    )
    return _fill(looking.unionByName(lookup, allowMissingColumns=True), [prefix + c for c in take], rows)


def last_view_before_purchase(events: DataFrame, rows: int = HOT_ROWS) -> DataFrame:
    """The last view of the user before each purchase; one scan for both sides."""
    view = F.col("event_type") == "view"
    both = events.filter(F.col("event_type").isin("view", "purchase")).select(
        F.col("user_id").alias("_key"),
        F.col("ts").alias("_t"),
        F.when(view, 0).otherwise(1).alias("_kind"),
        F.when(view, F.col("event_id")).alias("_tie"),
        F.struct("event_id", "user_id", "ts", "value").alias("_left"),
        F.when(view & F.col("user_id").isNotNull(), F.struct(F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))).alias("_right"),
    )
    return _fill(both, ["view_ts", "view_value"], rows)


def _fill(both: DataFrame, take: list[str], rows: int) -> DataFrame:
    found = by_heat(both, ["_key"], _fill_plain, _fill_split, rows)
    return found.select("_left.*", *[F.col("_found")[c].alias(c) for c in take])


def _in_order(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("_t", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)


def _fill_plain(both: DataFrame) -> DataFrame:
    found = both.withColumn("_found", F.last("_right", ignorenulls=True).over(_in_order("_key")))
    return found.filter(F.col("_kind") == 1).select("_left", "_found")


def _fill_split(both: DataFrame) -> DataFrame:
    """Within a cell by a window, across cells by each cell's last row."""
    cells = in_cells(both, ["_key", "_t", "_kind", "_tie"], "_cell")
    newest = F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct("_t", "_tie")))
    cells = with_carry(cells, ["_key"], "_cell", {"_carry": (newest, latest)})
    here = F.last("_right", ignorenulls=True).over(_in_order("_key", "_cell"))
    found = cells.withColumn("_found", F.coalesce(here, F.col("_carry")))
    return found.filter(F.col("_kind") == 1).select("_left", "_found")


def last_view_by_number(events: DataFrame, rows: int = HOT_ROWS) -> DataFrame:
    """The same answer in another shape, as a cross-check.

    Views are numbered per user; a purchase carries the number of the views
    before it. Equality on (user, number) then finds the view, so no pair of
    rows is formed that is not in the result.
    """
    both = events.filter(F.col("event_type").isin("view", "purchase")).select(
        "event_id",
        F.col("user_id").alias("_key"),
        F.col("ts").alias("_t"),
        F.when(F.col("event_type") == "view", 0).otherwise(1).alias("_kind"),
        F.when(F.col("event_type") == "view", F.col("event_id")).alias("_tie"),
        "value",
    )
    numbered = written(by_heat(both, ["_key"], _number_plain, _number_split, rows), "numbered")  # used twice
    views = numbered.filter(F.col("_kind") == 0).select("_key", "_number", F.col("_t").alias("view_ts"), F.col("value").alias("view_value"))
    bought = numbered.filter(F.col("_kind") == 1)
    return bought.join(views, ["_key", "_number"], "left").select(
        "event_id", F.col("_key").alias("user_id"), F.col("_t").alias("ts"), "value", "view_ts", "view_value"
    )


def _is_view() -> Column:
    return F.when(F.col("_kind") == 0, 1)


def _number_plain(both: DataFrame) -> DataFrame:
    return both.withColumn("_number", F.count(_is_view()).over(_in_order("_key")))


def _number_split(both: DataFrame) -> DataFrame:
    cells = in_cells(both, ["_key", "_t", "_kind", "_tie"], "_cell")
    cells = with_carry(cells, ["_key"], "_cell", {"_views": (F.count(_is_view()), F.sum)})
    here = F.count(_is_view()).over(_in_order("_key", "_cell"))
    return cells.withColumn("_number", F.coalesce("_views", F.lit(0)) + here).drop("_cell", "_views")


# -- intervals -----------------------------------------------------------------------


def views_then_purchases(events: DataFrame) -> DataFrame:
    """Every view with every purchase of the same user within the next hour.

    The hour is part of the join key: a purchase belongs to its own hour and a
    view to its own and the next, so a user's rows spread over hours and rows
    far apart in time never meet.
    """
    views = events.filter(F.col("event_type") == "view").select(
        "user_id",
        F.col("event_id").alias("view_id"),
        F.col("ts").alias("view_ts"),
        F.col("value").alias("view_value"),
        F.explode(F.array(C.hour_number("ts"), C.hour_number("ts") + 1)).alias("hour"),
    )
    purchases = events.filter(F.col("event_type") == "purchase").select(
        "user_id",
        F.col("event_id").alias("purchase_id"),
        F.col("ts").alias("purchase_ts"),
        F.col("value").alias("purchase_value"),
        C.hour_number("ts").alias("hour"),
    )
    close = F.col("purchase_ts").between(F.col("view_ts"), F.col("view_ts") + F.expr("interval 1 hour"))
    return views.join(purchases, ["user_id", "hour"]).filter(close).drop("hour")


# Price bands by lower edge; the last is open (fixed values).
PRICE_BANDS = [("under 100", 0.0), ("100-500", 100.0), ("500-1000", 500.0), ("1000-5000", 1000.0), ("5000 up", 5000.0)]


def price_bands(spark: SparkSession) -> DataFrame:
    edges = [low for _, low in PRICE_BANDS[1:]] + [float("inf")]
    bands = [
        F.struct(F.lit(name).alias("band"), F.lit(low).alias("low"), F.lit(high).alias("high"))
        for (name, low), high in zip(PRICE_BANDS, edges)
    ]
    return spark.range(1).select(F.inline(F.array(*bands)))


def in_bands(lines: DataFrame, bands: DataFrame, top: int = 40) -> DataFrame:
    """Unit prices into the band with ``low <= price < high``.

    Bands and prices meet on the sign and power of two they lie in, so this is a
    hash join with a check and not a nested loop over all bands. Amounts from
    2 ** ``top`` up share the last cell of their sign. Only nulls, NaN and
    prices in no band are left out.
    """
    def cell(c: Column) -> Column:
        power = F.when(F.abs(c) < 1, 0).otherwise(F.least(F.floor(F.log2(F.abs(c))) + 1, F.lit(top)))
        return F.when(c == float("inf"), top).when(c == float("-inf"), -top).otherwise(F.when(c < 0, -power).otherwise(power)).cast("int")

    covered = bands.withColumn("_cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    priced = lines.filter(~F.isnan("unit_price")).withColumn("_cell", cell(F.col("unit_price")))
    inside = (F.col("low") <= F.col("unit_price")) & (F.col("unit_price") < F.col("high"))
    return priced.join(covered, "_cell").filter(inside).drop("_cell")


# -- matching ----------------------------------------------------------------------------


def orders_with_lines(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Semi join. Line keys are made distinct first, on the map side, so an
    order with very many lines reaches the join as one row."""
    return orders.join(_line_orders(lineitem), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


def orders_without_lines(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    return orders.join(_line_orders(lineitem), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


def _line_orders(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey").distinct()


def match_periods(lineitem: DataFrame, first: int, second: int) -> DataFrame:
    """Full outer match of product sales in two years."""
    def year_sales(year: int, suffix: str) -> DataFrame:
        sales = period_sales(in_year(lineitem, year), "l_partkey", F.lit(year))
        return sales.select("l_partkey", *[F.col(c).alias(f"{c}_{suffix}") for c in ("quantity", "amount", "price")])

    return year_sales(first, "1").join(year_sales(second, "2"), "l_partkey", "full")
