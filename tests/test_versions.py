"""Tables that are replaced in whole, by partition and by key."""

import pytest
from pyspark.sql import functions as F

from tillweave.sources.versions import TableChanged, VersionedTable

SCHEMA = "k int, part string, v double"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files_of(table):
    """The current folder of each partition: a partition that keeps its folder keeps its files."""
    return {tuple(r) for r in table._parts(table.versions()[-1]).collect()}


@pytest.fixture
def table(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", by=["part"])
    table.replace(spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0), (4, None, 4.0), (5, "x=y/ü", 5.0)], SCHEMA))
    return table


def test_replace_in_whole_and_by_partition(spark, table):
    assert table.versions() == [1] and len(rows_of(table.read())) == 5
    before = files_of(table)
    table.replace_partitions(spark.createDataFrame([(9, "a", 9.0), (8, None, 8.0), (7, "new", 7.0)], SCHEMA))
    assert rows_of(table.read()) == sorted([(9, "a", 9.0), (3, "b", 3.0), (8, None, 8.0), (7, "new", 7.0), (5, "x=y/ü", 5.0)], key=str)
    assert len(before & files_of(table)) == 2  # those of b and x=y/ü
    assert len(rows_of(table.read(1))) == 5  # the older version is still there
    table.replace(spark.createDataFrame([(1, "z", 1.0)], SCHEMA))
    assert rows_of(table.read()) == [(1, "z", 1.0)] and table.versions() == [1, 2, 3]
    assert table.read().schema == spark.createDataFrame([], SCHEMA).schema


def test_failed_attempt_leaves_the_last_version(spark, table):
    want = rows_of(table.read())
    bad = spark.range(1000).select(
        F.when(F.col("id") < 990, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")).cast("int").alias("k"), F.lit("a").alias("part"), F.lit(0.0).alias("v")
    ).repartition(4)
    for change in (table.replace, table.replace_partitions):
        with pytest.raises(Exception, match="broken"):
            change(bad)
        assert rows_of(table.read()) == want and table.versions() == [1]
    table.replace_partitions(spark.createDataFrame([(9, "b", 9.0)], SCHEMA))
    assert table.versions() == [1, 2]


def test_second_writer_is_refused(spark, table, monkeypatch):
    other = VersionedTable(spark, table.root, by=["part"])
    write = table._write

    def slow_write(df):
        parts = write(df)
        other.replace(spark.createDataFrame([(1, "other", 1.0)], SCHEMA))
        return parts

    monkeypatch.setattr(table, "_write", slow_write)
    with pytest.raises(TableChanged):
        table.replace(spark.createDataFrame([(2, "mine", 2.0)], SCHEMA))
    assert rows_of(table.read()) == [(1, "other", 1.0)]


def test_merge_writes_touched_partitions_only_and_can_be_repeated(spark, table):
    before = files_of(table)
    changes = spark.createDataFrame([(1, "a", 10.0, False), (3, "c", 30.0, None), (5, "x=y/ü", 0.0, True), (6, "c", 6.0, False), (77, "q", 1.0, True)], SCHEMA + ", gone boolean")
    for _ in range(2):
        table.merge(changes, ["k"], deleted="gone")
        assert rows_of(table.read()) == sorted([(1, "a", 10.0), (2, "a", 2.0), (3, "c", 30.0), (4, None, 4.0), (6, "c", 6.0)], key=str)
    assert len(before & files_of(table)) == 1  # that of the NULL partition


def test_merge_of_null_and_repeated_keys(spark, table):
    table.merge(spark.createDataFrame([(None, "a", 0.5)], SCHEMA), ["k"])
    table.merge(spark.createDataFrame([(None, "a", 0.5)], SCHEMA), ["k"])
    assert table.read().where("k is null").count() == 2
    with pytest.raises(ValueError, match="more than once"):
        table.merge(spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5)], SCHEMA), ["k"])
    with pytest.raises(ValueError, match="differ"):
        table.merge(spark.createDataFrame([(1, "a")], "k int, part string"), ["k"])


def test_unpartitioned_and_empty_tables(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/u")
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(spark.createDataFrame([], "k int, v double"))
    assert table.read().count() == 0 and table.read().columns == ["k", "v"]
    table.merge(spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double"), ["k"])
    table.merge(spark.createDataFrame([(2, 3.0)], "k int, v double"), ["k"])
    assert rows_of(table.read()) == [(1, 1.0), (2, 3.0)]
    table.replace_partitions(spark.createDataFrame([(5, 5.0)], "k int, v double"))  # one partition: the whole table
    assert rows_of(table.read()) == [(5, 5.0)]
    with pytest.raises(ValueError, match="run"):
        table.replace(spark.createDataFrame([(1,)], "run int"))


def test_merge_gathers_no_partition_in_one_task(spark, table, monkeypatch):
    """However large the changes, the rows of a table partition do not meet the touched partitions by a shuffle on it."""
    plans, write = [], table._write

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(table, "_write", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        table.merge(spark.createDataFrame([(1, "a", 10.0), (3, "c", 30.0)], SCHEMA), ["k"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(coalesce(part" not in plans[0]
    assert rows_of(table.read()) == sorted([(1, "a", 10.0), (2, "a", 2.0), (3, "c", 30.0), (4, None, 4.0), (5, "x=y/ü", 5.0)], key=str)
