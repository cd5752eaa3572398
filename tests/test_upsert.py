"""Upserts that are killed and repeated."""

import pytest
from pyspark.sql import functions as F

from oarframe.sources.upsert import BUCKET, UpsertTable, with_new_ids

KIND = "id long, part string, value string"


class Killed(Exception):
    pass


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    stored = [(i, "a", f"old {i}") for i in range(200)] + [(None, "a", "old null"), (5, None, "old none")]
    return UpsertTable(spark, f"{tmp_path}/t", ["id", "part"], buckets=7).create(spark.createDataFrame(stored, KIND))


CHANGES = [(3, "a", "new 3"), (3, "b", "added"), (None, "a", "new null"), (5, None, "new none"), (900, "a", "added"), (17, "a", None)]


def after(changes):
    stored = {(i, "a"): f"old {i}" for i in range(200)} | {(None, "a"): "old null", (5, None): "old none"}
    return sorted(((*k, v) for k, v in (stored | {c[:2]: c[2] for c in changes}).items()), key=repr)


def test_upsert_replaces_and_adds(spark, table):
    assert table.upsert(spark.createDataFrame(CHANGES, KIND), "r1")
    assert rows_of(table.read()) == after(CHANGES) and table.read().columns == ["id", "part", "value"]
    assert not table.upsert(spark.createDataFrame([(3, "a", "other")], KIND), "r1")  # that run is done
    assert rows_of(table.read()) == after(CHANGES)
    more = [(3, "a", "newer"), (4, "a", "new 4")]
    assert table.upsert(spark.createDataFrame(more, KIND), "r2") and rows_of(table.read()) == after(CHANGES + more)
    assert table.upsert(spark.createDataFrame([], KIND), "r3") and rows_of(table.read()) == after(CHANGES + more)


def test_untouched_buckets_stay_as_they_are(spark, table, tmp_path):
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob(f"t/data/{BUCKET}=*/*.parquet")}
    table.upsert(spark.createDataFrame([(3, "a", "new")], KIND), "r1")
    now = {p: p.stat().st_mtime_ns for p in tmp_path.glob(f"t/data/{BUCKET}=*/*.parquet")}
    assert len(before) == len(now) == 7 and len(set(before.items()) & set(now.items())) == 6


def test_killed_before_the_result_is_aside(spark, table, monkeypatch):
    def fail(self, df, folder, replace):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(UpsertTable, "_write", fail)
        with pytest.raises(Killed):
            table.upsert(spark.createDataFrame(CHANGES, KIND), "r1")
    assert rows_of(table.read()) == after([])
    assert table.upsert(spark.createDataFrame(CHANGES, KIND), "r1") and rows_of(table.read()) == after(CHANGES)


@pytest.mark.parametrize("replaced", [0, 1, 3])
def test_killed_between_two_buckets(spark, table, monkeypatch, replaced):
    whole = UpsertTable._replace

    def some(self, result):
        first = sorted(r[0] for r in result.select(BUCKET).distinct().collect())[:replaced]
        if first:
            whole(self, result.filter(F.col(BUCKET).isin(*first)))
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(UpsertTable, "_replace", some)
        with pytest.raises(Killed):
            table.upsert(spark.createDataFrame(CHANGES, KIND), "r1")
    # Repeated, it needs nothing but what it has written aside.
    assert table.upsert(spark.createDataFrame([], KIND), "r1") and rows_of(table.read()) == after(CHANGES)


def test_new_rows_get_numbers_in_order(spark):
    stored = spark.createDataFrame([(4,), (9,)], "id long")
    rows = spark.createDataFrame([(None, 30), (4, 1), (None, 10), (None, 20)], "id long, doc long")
    assert sorted(tuple(r) for r in with_new_ids(rows, stored, "doc").collect()) == [(4, 1), (10, 10), (11, 20), (12, 30)]
    assert [tuple(r) for r in with_new_ids(rows.filter("doc = 10"), stored.limit(0), "doc").collect()] == [(1, 10)]
