"""Versioned tables: a rewrite counts as a whole or not at all."""

import threading

import pytest

from cutledger.sources import tables
from cutledger.sources.versioned import Conflict, VersionedTable

ROW = "id long, kind string, n long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    made = VersionedTable(spark, str(tmp_path / "t"))
    made.create(spark.createDataFrame([(1, "a/b", 1), (2, "a/b", 2), (3, "c d", 3), (4, None, 4), (5, "", 5)], ROW), "kind")
    return made


def test_upsert_rewrites_touched_partitions_only(spark, table):
    before = table.version()
    table.upsert(spark.createDataFrame([(2, "a/b", 20), (6, "new", 6), (4, None, 40)], ROW), ["id"])
    after = table.version()
    assert rows(table.read()) == rows(spark.createDataFrame([(1, "a/b", 1), (2, "a/b", 20), (3, "c d", 3), (4, None, 40), (5, "", 5), (6, "new", 6)], ROW))
    assert rows(table.read(0)) == rows(spark.createDataFrame([(1, "a/b", 1), (2, "a/b", 2), (3, "c d", 3), (4, None, 4), (5, "", 5)], ROW))
    assert [n for n in before.folders if after.folders[n] == before.folders[n]] == ["_part=c d"]
    assert rows(table.read(partitions=["new"])) == [(6, "new", 6)] and table.read(partitions=["none"]).count() == 0


def test_a_writer_that_dies_leaves_the_old_table(spark, table, monkeypatch):
    old = rows(table.read())
    monkeypatch.setattr(VersionedTable, "_commit", lambda self, new: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        tables.write_upsert(table.root, spark.createDataFrame([(2, "a/b", 20)], ROW), ["id"])
    monkeypatch.undo()
    assert rows(table.read()) == old and table.numbers() == [0]
    tables.write_upsert(table.root, spark.createDataFrame([(2, "a/b", 20)], ROW), ["id"])
    assert (2, "a/b", 20) in rows(table.read())


def test_a_version_is_made_once(spark, table):
    first = table.version()
    table.upsert(spark.createDataFrame([(1, "a/b", 10)], ROW), ["id"])
    with pytest.raises(Conflict):
        table._commit(type(first)(1, first.schema, first.partition_by, first.folders))
    assert (1, "a/b", 10) in rows(table.read())


def test_two_writers_both_count(spark, table):
    updates = [spark.createDataFrame([(1, "a/b", 100)], ROW), spark.createDataFrame([(2, "a/b", 200)], ROW), spark.createDataFrame([(7, "c d", 7)], ROW)]
    threads = [threading.Thread(target=table.upsert, args=(u, ["id"])) for u in updates]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert {(1, "a/b", 100), (2, "a/b", 200), (7, "c d", 7), (3, "c d", 3)} <= set(map(tuple, rows(table.read()))) and table.numbers() == [0, 1, 2, 3]


def test_rows_may_not_leave_their_partition(spark, table):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        table.rewrite(["a/b"], lambda rows: rows.withColumn("kind", F.lit("c d")))
    table.rewrite(["a/b"], lambda rows: rows.where("id = 0"))
    assert rows(table.read(partitions=["a/b"])) == [] and table.read().count() == 3


def test_expired_versions_go_and_their_data_with_them(spark, table):
    for n in range(3):
        table.upsert(spark.createDataFrame([(1, "a/b", n)], ROW), ["id"])
    kept = rows(table.read(2)), rows(table.read())
    assert table.expire(2) == 2 and table.numbers() == [2, 3]
    assert (rows(table.read(2)), rows(table.read())) == kept
    with pytest.raises(FileNotFoundError):
        VersionedTable(spark, table.root + "x").read()
