"""Windowed and stateful event operators.

The frames may be streams or, except for duplicate removal and state, tables.
In append mode a window appears once the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricewright.functions import columns as C
from pricewright.operators import skew
from pricewright.streaming.chain import PreviousValues

DELAY = "10 minutes"


def tumbling_activity(events: DataFrame, size: str = "1 hour", delay: str = DELAY) -> DataFrame:
    return _windowed(events, F.window("ts", size), delay, "event_type")


def sliding_activity(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    return _windowed(events, F.window("ts", size, step), delay, "event_type")


def session_activity(events: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Sessions per user; two events exactly ``gap`` apart share one."""
    return _windowed(events, F.session_window("ts", gap), delay, "user_id")


def _windowed(events: DataFrame, window: Column, delay: str, by: str) -> DataFrame:
    return (
        events.withWatermark("ts", delay)
        .groupBy(window.alias("w"), by)
        .agg(F.count(F.lit(1)).alias("events"), F.sum(C.money("value")).alias("value"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "events", "value")
    )


def without_duplicates(events: DataFrame, key: str = "event_id", delay: str = DELAY) -> DataFrame:
    """Drop later copies of an event; its key is forgotten after ``delay``."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def view_purchase_pairs(views: DataFrame, purchases: DataFrame, delay: str = DELAY) -> DataFrame:
    """Views with the user's purchases in the next hour, between two streams.

    Both watermarks and the time bound let the state be dropped. The hour in
    the key spreads a busy user's state over the hours.
    """
    v = views.filter(F.col("event_type") == "view").withWatermark("ts", delay).select(
        F.col("user_id").alias("v_user"),
        F.col("event_id").alias("view_id"),
        F.col("ts").alias("view_ts"),
        F.col("value").alias("view_value"),
        F.explode(F.array(C.hour_number("ts"), C.hour_number("ts") + 1)).alias("v_hour"),
    )
    p = purchases.filter(F.col("event_type") == "purchase").withWatermark("ts", delay).select(
        "user_id",
        F.col("event_id").alias("purchase_id"),
        F.col("ts").alias("purchase_ts"),
        F.col("value").alias("purchase_value"),
        C.hour_number("ts").alias("hour"),
    )
    near = (
        (F.col("user_id") == F.col("v_user"))
        & (F.col("hour") == F.col("v_hour"))
        & (F.col("purchase_ts") >= F.col("view_ts"))
        & (F.col("purchase_ts") <= F.col("view_ts") + F.expr("interval 1 hour"))
    )
    return v.join(p, near).select("user_id", "view_id", "view_ts", "view_value", "purchase_id", "purchase_ts", "purchase_value")


def previous_value(events: DataFrame, delay: str = DELAY, forget_days: int | None = None, hot_rows: int = skew.HOT_ROWS) -> PreviousValues:
    """Each event with its user's value before it, for ``StreamTable.append``.

    Events wait until the watermark has passed them and leave in the order of
    their time, so files may come in any order within ``delay``. Events without
    a time never leave. A user's last value is kept for good; only a live stream
    may ask to forget it when ``forget_days`` pass without an event, which makes
    the result depend on how the events are cut into batches. Between batches one value is kept for each user;
    users with more than ``hot_rows`` rows in a batch are chained in cells.
    """
    return PreviousValues(events.select("event_id", "ts", "user_id", "value"), delay, forget_days, hot_rows)
