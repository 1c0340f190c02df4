"""Price positions and changes within products, users and brands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from pricewright.functions import columns as C
from pricewright.operators.quantiles import exact_quantiles
from pricewright.operators.skew import HOT_ROWS, by_heat, in_cells, join_on, joined_back, running_total, with_carry
from pricewright.session import written


def supplier_prices(lineitem: DataFrame) -> DataFrame:
    """Average price each supplier took for each product."""
    return lineitem.groupBy("l_partkey", "l_suppkey").agg(_price())


def _price() -> Column:
    return (C.summed_money("l_extendedprice") / F.nullif(F.sum("l_quantity"), F.lit(0.0))).alias("price")


def _supplier_columns(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


# -- position between suppliers ----------------------------------------------


def supplier_position(lineitem: DataFrame, tiles: int = 4, rows: int = HOT_ROWS) -> DataFrame:
    """Rank, dense rank and tile of each supplier's price within the product.

    Products with more than ``rows`` priced lines take the split form.
    """
    prices = lineitem.groupBy("l_partkey", "l_suppkey").agg(_price(), F.count(F.lit(1)).alias("_lines"))
    return by_heat(
        written(prices.filter(F.col("price").isNotNull()), "prices"),
        ["l_partkey"],
        lambda light: _position_plain(light, tiles),
        lambda heavy: _position_split(heavy, tiles, rows),
        rows,
        "_lines",
    )


def _position_plain(prices: DataFrame, tiles: int) -> DataFrame:
    # The finer order comes first, so that one sort serves both windows.
    product = Window.partitionBy("l_partkey")
    tiled = prices.withColumn("tile", F.ntile(tiles).over(product.orderBy("price", "l_suppkey")))
    by_price = product.orderBy("price")
    return tiled.select(
        "l_partkey",
        "l_suppkey",
        "price",
        F.rank().over(by_price).alias("rank"),
        F.dense_rank().over(by_price).alias("dense_rank"),
        "tile",
    )


def _position_split(prices: DataFrame, tiles: int, rows: int) -> DataFrame:
    """The same from positions inside a price cell plus what lies below it.

    A cell is one step of prices. Of a heavy one, equal prices are counted once
    per price, and suppliers that share one are placed in steps of the supplier
    key, so a price that everyone asks does not gather in one task either.
    """
    # A null product is one of its own; joins on keys without nulls leave rows where they are.
    known = F.coalesce("l_partkey", F.lit(0).cast("bigint"))
    cell = ["_part", "_null", "_step"]
    stepped = prices.select(known.alias("_part"), F.col("l_partkey").isNull().alias("_null"), C.price_step("price").alias("_step"), "l_suppkey", "price")
    placed = by_heat(stepped, cell, lambda light: _placed_plain(light, cell), lambda heavy: _placed_split(heavy, cell), rows)

    totals = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), F.max("_dense").alias("_n_prices"))
    product = Window.partitionBy("_part", "_null")
    lower = product.orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    carry = totals.select(
        *cell,
        F.coalesce(F.sum("_n").over(lower), zero).alias("_below"),
        F.coalesce(F.sum("_n_prices").over(lower), zero).alias("_below_prices"),
        F.sum("_n").over(product).alias("_total"),
    )
    return placed.join(carry, cell).select(
        F.when(~F.col("_null"), F.col("_part")).alias("l_partkey"),
        "l_suppkey",
        "price",
        (F.col("_below") + F.col("_rank")).cast("int").alias("rank"),
        (F.col("_below_prices") + F.col("_dense")).cast("int").alias("dense_rank"),
        _tile(F.col("_below") + F.col("_place"), F.col("_total"), tiles).cast("int").alias("tile"),
    )


def _placed_plain(prices: DataFrame, cell: list[str]) -> DataFrame:
    """Place, rank and dense rank of each supplier within its cell."""
    inside = Window.partitionBy(*cell)
    # The finer order comes first, so that one sort serves both windows.
    placed = prices.withColumn("_place", F.row_number().over(inside.orderBy("price", "l_suppkey")).cast("bigint"))
    ranks = {"_rank": F.rank(), "_dense": F.dense_rank()}
    return placed.withColumns({name: rank.over(inside.orderBy("price")).cast("bigint") for name, rank in ranks.items()})


def _placed_split(prices: DataFrame, cell: list[str]) -> DataFrame:
    """The same from one row per price, and from blocks of the suppliers that share a price."""
    prices = written(prices, "prices")
    inside = Window.partitionBy(*cell).orderBy("price")
    zero = F.lit(0)
    per_price = prices.groupBy(*cell, "price").agg(F.count(F.lit(1)).alias("_n"))
    per_price = per_price.select(
        *cell,
        "price",
        (F.coalesce(F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), zero) + 1).alias("_rank"),
        F.row_number().over(inside).cast("bigint").alias("_dense"),
        "_n",
    )
    tie = [*cell, "price"]
    blocks = prices.withColumn("_block", F.floor(F.col("l_suppkey") / 100_000))
    blocks = with_carry(blocks, tie, "_block", {"_earlier": (F.count(F.lit(1)), F.sum)})
    in_block = F.row_number().over(Window.partitionBy(*tie, "_block").orderBy("l_suppkey"))
    placed = blocks.withColumn("_within", F.coalesce("_earlier", zero) + in_block)
    out = joined_back(placed, per_price, tie, "_n")
    return out.select(*prices.columns, (F.col("_rank") + F.col("_within") - 1).alias("_place"), "_rank", "_dense")


def _tile(position: Column, total: Column, tiles: int) -> Column:
    """Tile of a 1-based position when the first tiles take the remainder."""
    size = F.floor(total / tiles)
    larger = total % tiles
    edge = larger * (size + 1)
    return F.when(position <= edge, F.ceil(position / (size + 1))).otherwise(
        larger + F.ceil((position - edge) / F.nullif(size, F.lit(0)))
    )


# -- market price -------------------------------------------------------------


def market_gap(lineitem: DataFrame, rows: int = HOT_ROWS) -> DataFrame:
    """Each supplier's price against the mean of the others for the product."""
    return by_heat(
        _supplier_columns(lineitem),
        ["l_partkey"],
        lambda lines: _gap_plain(supplier_prices(lines)),
        lambda lines: _gap_split(supplier_prices(lines)),
        rows,
    )


def _gap(df: DataFrame, total: Column, n: Column) -> DataFrame:
    others = F.when(F.col("price").isNull(), total / F.nullif(n, F.lit(0))).otherwise(
        (total - F.col("price")) / F.nullif(n - 1, F.lit(0))
    )
    return df.withColumn("market_price", others).select(
        "l_partkey", "l_suppkey", "price", "market_price", (F.col("price") - F.col("market_price")).alias("gap")
    )


def _gap_plain(prices: DataFrame) -> DataFrame:
    product = Window.partitionBy("l_partkey")
    return _gap(prices, F.sum("price").over(product), F.count("price").over(product))


def _gap_split(prices: DataFrame) -> DataFrame:
    totals = prices.groupBy("l_partkey").agg(F.sum("price").alias("_total"), F.count("price").alias("_n"))
    return _gap(join_on(prices, totals, ["l_partkey"]), F.col("_total"), F.col("_n"))


def median_gap(lineitem: DataFrame, rows: int = HOT_ROWS) -> DataFrame:
    """Each line's unit price against the median of its product."""
    lines = lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.unit_price().alias("unit_price")
    )
    return by_heat(lines, ["l_partkey"], _median_plain, _median_split, rows)


def _median_plain(lines: DataFrame) -> DataFrame:
    median = F.median("unit_price").over(Window.partitionBy("l_partkey"))
    return lines.withColumn("median_price", median).withColumn("gap", F.col("unit_price") - F.col("median_price"))


def _median_split(lines: DataFrame) -> DataFrame:
    medians = exact_quantiles(lines, ["l_partkey"], "unit_price", {"median_price": 0.5}).drop("n")
    both = join_on(lines, medians, ["l_partkey"], "left")
    return both.withColumn("gap", F.col("unit_price") - F.col("median_price"))


# -- changes over days (at most one row per product and calendar day) ----------


def price_change(daily: DataFrame) -> DataFrame:
    """Price of each product and day against its previous day with sales."""
    days = Window.partitionBy("l_partkey").orderBy("day")
    return daily.select(
        "l_partkey",
        "day",
        "price",
        F.lag("price").over(days).alias("previous_price"),
        F.datediff("day", F.lag("day").over(days)).alias("days_since"),
    ).withColumn("change", F.col("price") - F.col("previous_price"))


def rolling_price(daily: DataFrame, days: int = 30) -> DataFrame:
    """Mean unit price over the last ``days`` days up to and with each day."""
    recent = Window.partitionBy("l_partkey").orderBy(F.unix_date("day")).rangeBetween(-days, 0)
    return daily.select(
        "l_partkey",
        "day",
        F.sum("lines").over(recent).alias("lines"),
        (F.sum("price_sum").over(recent) / F.sum("lines").over(recent)).alias("rolling_price"),
    )


def open_close(daily: DataFrame) -> DataFrame:
    """First and last daily price, with high and low, per product and year."""
    return daily.groupBy("l_partkey", F.year("day").alias("year")).agg(
        F.min_by("price", "day").alias("open"),
        F.max_by("price", "day").alias("close"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
    )


# -- rolling user activity ------------------------------------------------------


def rolling_activity(events: DataFrame, rows: int = HOT_ROWS) -> DataFrame:
    """Per event, count and value of its user's events in the day up to it.

    A running sum in which every event is taken back one day later. Spark adds
    up a sliding range frame anew for each row, which for a user with many
    events a day is quadratic; a running sum is not, and it splits into cells.
    An event still counts at exactly one day, so its withdrawal sorts after
    the events of that instant.
    """
    value = F.col("value").cast("decimal(18,2)")
    steps = F.array(
        F.struct(F.col("ts").alias("at"), F.lit(1).alias("n"), value.alias("v")),
        F.struct(F.expr("ts + interval 1 day").alias("at"), F.lit(-1).alias("n"), (-value).alias("v")),
    )
    both = events.select("event_id", "user_id", "ts", F.inline(steps))
    summed = by_heat(both, ["user_id"], _activity_plain, _activity_split, rows)
    return summed.filter(F.col("n") == 1).select(
        "event_id", "user_id", "ts", "events_1d", F.col("value_1d").cast("decimal(28,2)").alias("value_1d")
    )


def _activity_plain(both: DataFrame) -> DataFrame:
    return _running(both, Window.partitionBy("user_id"))


def _activity_split(both: DataFrame) -> DataFrame:
    """The same from one row per user and instant, cut into cells.

    An event sees what came up to its instant less what was withdrawn before.
    """
    def of(sign: int, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("n") == sign, F.col(column))), F.lit(0))

    instants = both.groupBy("user_id", "at").agg(
        of(1, "n").alias("came_n"), of(-1, "n").alias("went_n"), of(1, "v").alias("came_v"), of(-1, "v").alias("went_v")
    )
    cells = in_cells(instants, ["user_id", "at"], "_cell")
    whole = {f"_{x}0": (F.sum(F.col(f"came_{x}") + F.col(f"went_{x}")), F.sum) for x in "nv"}
    cells = with_carry(cells, ["user_id"], "_cell", whole)
    within = Window.partitionBy("user_id", "_cell").orderBy("at")
    upto, before = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)

    def running(x: str) -> Column:
        return F.coalesce(f"_{x}0", F.lit(0)) + F.sum(f"came_{x}").over(upto) + F.coalesce(F.sum(f"went_{x}").over(before), F.lit(0))

    summed = cells.select("user_id", "at", running("n").alias("events_1d"), running("v").alias("value_1d"))
    return join_on(both.filter("n = 1"), summed, ["user_id", "at"])


def _running(both: DataFrame, within: WindowSpec) -> DataFrame:
    # Events of one instant see each other, as in a range frame.
    upto = within.orderBy("at", F.desc("n")).rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumns(
        {"events_1d": F.sum("n").over(upto), "value_1d": F.coalesce(F.sum("v").over(upto), F.lit(0))}
    )


# -- whole-table order ------------------------------------------------------------


def revenue_classes(lineitem: DataFrame, a: float = 0.8, b: float = 0.95) -> DataFrame:
    """Products by falling revenue with their cumulative share and class A, B or C."""
    revenue = lineitem.groupBy("l_partkey").agg(F.sum(C.net_price()).alias("revenue"))
    ranked = running_total(revenue, [F.desc_nulls_last("revenue"), F.asc("l_partkey")], "revenue", "running", "total")
    share = F.col("running").cast("double") / F.nullif(F.col("total").cast("double"), F.lit(0.0))
    return ranked.select(
        "l_partkey",
        "revenue",
        share.alias("cum_share"),
        F.when(share <= a, "A").when(share <= b, "B").otherwise("C").alias("class"),
    )


def list_price_position(part: DataFrame, rows: int = HOT_ROWS) -> DataFrame:
    """Percent rank and cumulative distribution of every list price.

    Prices are counted once per distinct value, placed in the whole table's
    order, and joined back to the products.
    """
    prices = part.groupBy("p_retailprice").agg(F.count(F.lit(1)).alias("n"))
    placed = running_total(prices, [F.asc_nulls_first("p_retailprice")], "n", "upto", "total")
    placed = placed.select(
        "p_retailprice",
        "n",
        F.coalesce((F.col("upto") - F.col("n")) / F.nullif(F.col("total") - 1, F.lit(0)), F.lit(0.0)).alias("percent_rank"),
        (F.col("upto") / F.col("total")).alias("cume_dist"),
    )
    return joined_back(part, placed, ["p_retailprice"], "n", rows).select(
        "p_partkey", "p_retailprice", "percent_rank", "cume_dist"
    )


def top_prices(lines: DataFrame, by: str = "p_brand", k: int = 3) -> DataFrame:
    """The ``k`` highest unit prices per group.

    The filter becomes a group limit on the map side: a task sends at most
    ``k`` rows per group, so a group's size does not matter as long as ``k`` is at
    most ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000 by default).
    """
    order = [F.desc("unit_price"), *[F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]]
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return lines.withColumn("place", place).filter(F.col("place") <= k).select(
        by, "place", "l_orderkey", "l_linenumber", "l_partkey", "unit_price"
    )
