"""Column expressions shared by the operators. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Steps per factor e of the price grid: about 0.25 % per step.
PRICE_STEPS = 400


def money(col: str | Column) -> Column:
    """Cents as an exact decimal; doubles summed in any order drift."""
    return _c(col).cast("decimal(12,2)")


def summed_money(col: str | Column) -> Column:
    """Sum of an amount as a double, added up in whole cents.

    Whole numbers add exactly in any order. Their high and low bits are added
    apart, so that no group in sight outgrows a sum (one that did would raise).
    """
    cents = F.rint(_c(col) * 100).cast("bigint")
    high = F.sum(F.shiftright(cents, 20)).cast("decimal(20,0)")
    low = F.sum(cents.bitwiseAND(F.lit((1 << 20) - 1).cast("bigint")))
    return (high * F.lit(1 << 20) + low).cast("double") / 100


def rate(col: str | Column) -> Column:
    """A discount or tax rate in whole percent as an exact decimal."""
    return _c(col).cast("decimal(4,2)")


def unit_price(amount: str | Column = "l_extendedprice", quantity: str | Column = "l_quantity") -> Column:
    """Price of one piece; null when the quantity is zero or missing."""
    return _c(amount) / F.nullif(_c(quantity), F.lit(0.0))


def net_price(amount: str | Column = "l_extendedprice", discount: str | Column = "l_discount") -> Column:
    return money(amount) * (F.lit(1).cast("decimal(1,0)") - rate(discount))


def discount_amount(amount: str | Column = "l_extendedprice", discount: str | Column = "l_discount") -> Column:
    return money(amount) * rate(discount)


def price_step(value: str | Column, steps: int = PRICE_STEPS) -> Column:
    """Number of the logarithmic grid cell a value falls in.

    Never decreases as the value grows, over negative numbers, zero and
    positive numbers (NaN last), so cells can stand in for the order.
    """
    v = _c(value)
    shift = 800 * steps  # ln of the smallest positive double is above -746

    def cell(x: Column) -> Column:
        return (F.floor(F.log(x) * steps) + shift).cast("bigint")

    top = F.lit(2 * shift).cast("bigint")
    return (
        F.when(F.isnan(v), top + 1)
        .when(v == float("inf"), top)
        .when(v == float("-inf"), -top)
        .when(v > 0, cell(v))
        .when(v < 0, -cell(-v))
        .when(v == 0, F.lit(0).cast("bigint"))
    )


def minute_number(ts: str | Column) -> Column:
    """Minutes since 1970 on the column's own clock, with no time-zone shift."""
    t = _c(ts)
    day = F.unix_date(F.to_date(t)).cast("bigint")
    return day * 1440 + F.hour(t) * 60 + F.minute(t)


def hour_number(ts: str | Column) -> Column:
    t = _c(ts)
    return F.unix_date(F.to_date(t)).cast("bigint") * 24 + F.hour(t)


def brand_number(brand: str | Column = "p_brand") -> Column:
    return F.regexp_replace(_c(brand), "^Brand#", "").cast("int")


def name_word(name: str | Column, n: int) -> Column:
    return F.split_part(_c(name), F.lit(" "), F.lit(n))


def iso_weekday(ts: str | Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(_c(ts)) + 1


def month_start(ts: str | Column) -> Column:
    return F.trunc(F.to_date(_c(ts)), "month")


def discount_band(discount: str | Column = "l_discount") -> Column:
    """Two-point bands 0-1, 2-3, ... percent, from whole percents.

    The rates sit on band edges, where arithmetic on doubles is off by one.
    """
    return F.floor(F.round(_c(discount) * 100) / 2).cast("int")


def lead_band(days: str | Column) -> Column:
    """Days between order and shipment as 0-7, 8-30, 31-90 or 91+."""
    d = _c(days)
    return F.when(d <= 7, "0-7").when(d <= 30, "8-30").when(d <= 90, "31-90").otherwise("91+")


def prop(key: str, props: str | Column = "props") -> Column:
    """One value of a JSON property column, as text."""
    return F.get_json_object(_c(props), f"$.{key}")


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col
