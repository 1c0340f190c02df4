"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from pricewright import session


def _session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app"))


def test_the_named_folder_is_used():
    assert session.shared_dir(_session("yarn", "hdfs:///shared/")) == "hdfs:///shared"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        session.shared_dir(_session("yarn"))


def test_local_sessions_keep_one_folder():
    local = _session("local[2]")
    assert session.shared_dir(local) == session.shared_dir(local)


def test_written_tables_keep_schema_and_rows(spark):
    df = spark.range(5).selectExpr("id", "cast(id as decimal(12,2)) as v", "timestamp_ntz'2024-01-01 00:00:00' as t")
    back = session.written(df, "t")
    assert back.dtypes == df.dtypes
    assert sorted(back.collect()) == sorted(df.collect())


def test_intermediates_are_removed(spark, tmp_path):
    import os

    made = session._made.get(spark.sparkContext.applicationId, [])
    before, session._made[spark.sparkContext.applicationId] = list(made), []
    path = session.fresh_path(spark, "t")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path)
    assert session.remove_intermediates(spark) == 1 and not os.path.isdir(path)
    session._made[spark.sparkContext.applicationId] = before
