"""Streams against batch, late and repeated rows, replays."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from compare import connect, differences
from pricewright.plans import catalog
from pricewright.plans.catalog import QUERIES
from pricewright.plans.oracle import ORACLE
from pricewright.session import fresh_path
from pricewright.sources.sinks import write_batch, write_by_year
from pricewright.sources.tables import load, load_stream, stream_path
from pricewright.streaming import activity
from pricewright.streaming.run import LateRowsError, StreamTable, stream_table

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
END = dt.datetime(2030, 1, 1)


def arrive(spark, folder, rows):
    df = rows if hasattr(rows, "write") else spark.createDataFrame(rows, SCHEMA)
    df.write.mode("append").parquet(folder)


def closing(spark):
    return [(-1, END, -1, "closing", 0.0, None)]


@pytest.fixture(scope="module")
def arrivals(spark, sf_dir):
    folder = fresh_path(spark, "arrivals")
    arrive(spark, folder, load(spark, sf_dir, "events"))
    return folder


@pytest.fixture(scope="module")
def closed(spark, sf_dir):
    """The events and, in a later run, one far in the future."""
    folder = fresh_path(spark, "arrivals")
    arrive(spark, folder, load(spark, sf_dir, "events").unionByName(spark.createDataFrame(closing(spark), SCHEMA)))
    return folder


@pytest.mark.parametrize("op", [activity.tumbling_activity, activity.sliding_activity, activity.session_activity])
def test_windows_equal_batch_once_closed(spark, sf_dir, closed, op):
    stream = op(load_stream(spark, closed))
    got = StreamTable(spark, "t").append(stream).read(stream).filter(F.col("window_start") < F.lit(END))
    events = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    want = op(events)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.count() > 0


def test_session_edge(spark):
    folder = fresh_path(spark, "arrivals")
    t = dt.datetime(2024, 1, 1)
    at = [0, 30, 61]
    arrive(spark, folder, [(i, t + dt.timedelta(minutes=m), 1, "view", 1.0, None) for i, m in enumerate(at)] + closing(spark))
    stream = activity.session_activity(load_stream(spark, folder))
    got = StreamTable(spark, "t").append(stream).read(stream).filter("user_id = 1").orderBy("window_start").collect()
    assert [r["events"] for r in got] == [2, 1]


def test_late_rows_are_dropped_and_counted(spark):
    table = StreamTable(spark, "t", expect_late=True)
    t = dt.datetime(2024, 1, 1, 12)
    stream = lambda: activity.tumbling_activity(load_stream(spark, table.arrivals))
    closes = F.window(F.col("ts").cast("timestamp"), "1 hour")["end"]
    come = lambda rows: table.arrive(spark.createDataFrame(rows, SCHEMA), stream, closes)
    come([(1, t, 1, "view", 1.0, None)])
    late = [(10 + i, t - dt.timedelta(hours=3), 1, "view", 1.0, None) for i in range(10)]
    come([*late, (3, t - dt.timedelta(minutes=5), 1, "view", 1.0, None)])
    come(closing(spark))
    got = table.read(stream()).orderBy("window_start").collect()
    assert (table.input_rows, table.late_rows) == (13, 10)
    assert spark.read.parquet(table.late_path).count() == 10
    assert [(r["window_start"].hour, r["events"]) for r in got] == [(11, 1), (12, 1)]


def test_unexpected_late_rows_raise(spark):
    table = StreamTable(spark, "t")
    t = dt.datetime(2024, 1, 1, 12)
    stream = lambda: activity.tumbling_activity(load_stream(spark, table.arrivals))
    table.arrive(spark.createDataFrame([(1, t, 1, "view", 1.0, None)], SCHEMA), stream)
    with pytest.raises(LateRowsError):
        table.arrive(spark.createDataFrame([(2, t - dt.timedelta(hours=3), 1, "view", 1.0, None)], SCHEMA), stream)


@pytest.fixture(scope="module")
def many_files(spark, sf_dir, tmp_path_factory):
    """The tables with events as a folder of eight files in no order of time."""
    folder = str(tmp_path_factory.mktemp("tables"))
    load(spark, sf_dir, "events").repartition(8, F.hash("event_id")).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("rows", [1 << 40, 150])
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("stream_")))
def test_streams_over_many_files(spark, sf_dir, many_files, monkeypatch, name, rows):
    """Also in many slices, the same result as SQL over the one file."""
    monkeypatch.setattr(catalog, "SLICE_ROWS", rows)
    assert differences(QUERIES[name](spark, many_files), connect(sf_dir), ORACLE[name]) == []


def test_duplicates_across_batches(spark):
    folder = fresh_path(spark, "arrivals")
    table = StreamTable(spark, "t")
    t = dt.datetime(2024, 1, 1, 12)
    stream = lambda: activity.without_duplicates(load_stream(spark, folder))
    row = (1, t, 1, "view", 1.0, None)
    arrive(spark, folder, [row, row, (2, t, 1, "view", 1.0, None)])
    table.append(stream())
    arrive(spark, folder, [row, (3, t, 1, "view", 1.0, None)])
    got = table.append(stream()).read(stream())
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2, 3]


def test_interval_join_equals_batch(spark, sf_dir, arrivals):
    from pricewright.operators.joins import views_then_purchases

    stream = activity.view_purchase_pairs(load_stream(spark, arrivals), load_stream(spark, arrivals))
    got = StreamTable(spark, "t").append(stream).read(stream).select("view_id", "purchase_id")
    want = views_then_purchases(load(spark, sf_dir, "events")).select("view_id", "purchase_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_previous_value_across_batches(spark):
    """Rows of one batch in any order; the last ones wait for the watermark."""
    folder = fresh_path(spark, "arrivals")
    table = StreamTable(spark, "t")
    t = dt.datetime(2024, 1, 1, 12)
    stream = lambda: activity.previous_value(load_stream(spark, folder))
    arrive(spark, folder, [(2, t + dt.timedelta(minutes=1), 1, "view", 2.0, None), (1, t, 1, "view", 1.0, None), (3, t, 2, "view", 9.0, None)])
    table.append(stream())
    arrive(spark, folder, [(5, t + dt.timedelta(minutes=3), 1, "view", None, None), (4, t + dt.timedelta(minutes=2), 1, "view", 3.0, None)])
    table.append(stream())
    arrive(spark, folder, [(6, t + dt.timedelta(minutes=4), 1, "view", 5.0, None), *closing(spark)])
    got = table.append(stream()).read(stream())
    assert {r["event_id"]: r["previous"] for r in got.collect()} == {1: None, 2: 1.0, 3: None, 4: 2.0, 5: 3.0, 6: None}


def test_previous_value_of_a_busy_user(spark):
    """Chained in cells within a batch; one row per user and what waits goes on to the next."""
    folder = fresh_path(spark, "arrivals")
    table = StreamTable(spark, "t")
    t = dt.datetime(2024, 1, 1, 12)
    stream = lambda: activity.previous_value(load_stream(spark, folder), hot_rows=20)
    rows = [(i, t + dt.timedelta(minutes=i // 3), 1 if i % 3 else 2 + i % 7, "view", None if i % 11 == 0 else float(i), None) for i in range(400)]
    for part in (rows[:150], rows[150:], [(-1, t + dt.timedelta(days=2), -1, "closing", 0.0, None)]):
        arrive(spark, folder, part[::-1])
        table.append(stream())
    got = {r["event_id"]: r["previous"] for r in table.read(stream()).collect()}
    last, want = {}, {}
    for event, _, user, _, value, _ in rows:
        want[event], last[user] = last.get(user), value
    assert got == want
    kept = spark.read.parquet(f"{table.root}/state/batch=2")
    assert sorted((r["user_id"], r["fresh"]) for r in kept.collect()) == sorted([*((u, False) for u in last), (-1, True)])


@pytest.mark.parametrize("rows", [1 << 40, 2])
def test_previous_value_over_a_long_gap(spark, rows, tmp_path):
    """A stored table gives the same in one batch and in slices, however long a user was away."""
    t = dt.datetime(2020, 1, 1)
    days = [(1, 1), (2, 2), (3, 2), (600, 2), (601, 2), (1200, 1), (1201, 1), (1300, 3)]
    arrive(spark, f"{tmp_path}/events.parquet", [(i, t + dt.timedelta(days=d), user, "view", float(i), None) for i, (d, user) in enumerate(days)])
    emitted = stream_table(
        spark, stream_path(str(tmp_path), "events"), load(spark, str(tmp_path), "events"), lambda folder: activity.previous_value(load_stream(spark, folder)), "gap", rows
    )
    assert {r["event_id"]: r["previous"] for r in emitted.collect()} == {0: None, 1: None, 2: 1.0, 3: 2.0, 4: 3.0, 5: 0.0, 6: 5.0}


def test_late_events_of_previous_value(spark):
    folder = fresh_path(spark, "arrivals")
    t = dt.datetime(2024, 1, 1, 12)
    stream = lambda: activity.previous_value(load_stream(spark, folder))
    table = StreamTable(spark, "t")
    arrive(spark, folder, [(1, t, 1, "view", 1.0, None)])
    table.append(stream())
    arrive(spark, folder, [(2, t - dt.timedelta(hours=3), 1, "view", 1.0, None)])
    with pytest.raises(LateRowsError):
        table.append(stream())


def test_a_replayed_batch_counts_once(spark):
    root = fresh_path(spark, "batches")
    first, again = (spark.range(n).withColumnRenamed("id", "event_id") for n in (3, 5))
    write_batch(first, 0, root)
    write_batch(first, 1, root)
    write_batch(again, 1, root)
    got = spark.read.parquet(root).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in got} == {0: 3, 1: 5}


def test_batch_sink_over_runs(spark):
    folder = fresh_path(spark, "arrivals")
    table = StreamTable(spark, "t")
    t = dt.datetime(2024, 1, 1, 12)
    for i in range(3):
        arrive(spark, folder, [(i, t, 1, "view", 1.0, None)])
        table.append_batches(load_stream(spark, folder).select("event_id"))
    assert sorted(r["event_id"] for r in spark.read.parquet(table.path).collect()) == [0, 1, 2]


def test_year_partitions_are_pruned(spark, sf_dir):
    path = fresh_path(spark, "by-year")
    lineitem = load(spark, sf_dir, "lineitem")
    write_by_year(lineitem, path)
    back = spark.read.parquet(path)
    assert back.count() == lineitem.count()
    plan = back.filter("y = 1996")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(y" in plan
