"""Operators that were rebuilt for large groups, against plain loops, and the plans that this is about."""

import datetime as dt
import os
import random
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from oarframe.adapters import duckdb_ctes
from oarframe.operators import audits, joins, rollups
from oarframe.plans import audits as plans
from oarframe.plans import registry
from oarframe.sources import scans


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_years_are_date_ranges(spark, tmp_path):
    rows = [(i, dt.date(1990 + i % 12, 1 + i % 12, 1 + i % 28)) for i in range(400)] + [(-1, None), (-2, dt.date(1995, 12, 31)), (-3, dt.date(1996, 1, 1))]
    spark.createDataFrame(rows, "id long, date date").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    for years in ([1993], [1993, 1994, 1999], []):
        assert {r["id"] for r in scans.scan_by_year(docs, years).collect()} == {i for i, d in rows if d and d.year in years}
    assert "GreaterThanOrEqual(date,1993-01-01)" in executed(scans.scan_by_year(docs, [1993, 1994]))
    twice = rollups.scan_years(docs, [1995, 1993, 1995])
    assert sorted(r["id"] for r in twice.collect()) == sorted([i for i, d in rows if d and d.year == 1993] + 2 * [i for i, d in rows if d and d.year == 1995])
    assert executed(twice).count("Scan parquet") == 1 and twice.columns == docs.columns


def islands_one_by_one(rows):
    """(source, position, name, date) rows in order; the number of the run of each, by source."""
    out, last = {}, {}
    for source, position, name, closes in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "")):
        before = last.get(source)
        number = before[1] + (0 if before and before[0] is not None and before[0] == name and not before[2] else 1) if before else 1
        last[source] = (name, number, closes)
        out[source, position] = number
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_islands_over_several_ranges(spark, parts):
    rng = random.Random(parts)
    rows = [(source, i, rng.choice(["a", "a", "a", "a", "b", None]), rng.random() < 0.05) for source, n in (("one", 900), ("two", 30), ("three", 1)) for i in range(n)]
    rows += [("same", i, "a", False) for i in range(300)]
    frame = spark.createDataFrame(rows, "source string, pos long, name string, closes boolean").repartition(4)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rollups.with_islands(frame, "source", "pos", ["name"], "closes").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    numbers = {(r["source"], r["pos"]): r["island"] for r in got}
    assert len(got) == len(rows) and numbers == islands_one_by_one(rows)


def greedy_one_by_one(pairs):
    taken, out, seen = set(), {}, set()
    for order, left, right_order, right in sorted((p[1], p[0], p[3], p[2]) for p in set(pairs)):
        if left not in out and right not in taken:
            out[left] = right
            taken.add(right)
        seen.add(order)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_pairs_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    left_order, right_order = ({i: rng.randint(0, 9) for i in range(40)} for _ in range(2))
    pairs = [(a, left_order[a], b, right_order[b]) for a in range(40) for b in range(40) if a % 4 == b % 4 and rng.random() < 0.4]
    frame = spark.createDataFrame(pairs + pairs[:20], "l long, left_order int, r long, right_order int").repartition(3)
    got = {r["l"]: r["r"] for r in joins.greedy_pairs(frame, "l", "r").collect()}
    assert got == greedy_one_by_one(pairs)
    assert joins.greedy_pairs(frame.limit(0), "l", "r").count() == 0


def test_boats_without_branch_take_any(spark):
    keys = (1, 5, "MALE", "ABSOLUT")
    rows = spark.createDataFrame([(1, *keys, None), (2, *keys, "B"), (3, *keys, None), (4, *keys, None)], "id long, race_id long, club_id long, gender string, category string, branch string")
    docs = spark.createDataFrame([(10, 0, *keys, "B"), (11, 1, *keys, None), (12, 2, *keys, "B")], "doc_id long, pos int, race_id long, club_id long, gender string, category string, letter string")
    # The first row takes the B boat that is offered first, so the second one gets the other.
    assert {r["id"]: r["doc_id"] for r in joins.match_participants(rows, docs).collect()} == {1: 10, 2: 12, 3: 11}


def test_tokens_that_all_names_have_join_no_rows(spark):
    items = spark.createDataFrame([(i, ["trofeo", "bandera", f"w{i}"]) for i in range(300)] + [(1000, []), (1001, ["trofeo", "trofeo"])], "item_id long, tokens array<string>")
    wanted = [(1, ["trofeo", "w5"]), (2, ["bandera", "trofeo", "w7", "w7"]), (3, ["w1", "w2"]), (4, []), (5, ["nowhere", "trofeo"]), (6, ["trofeo", "bandera"]), (7, ["trofeo", "w5"])]
    queries = spark.createDataFrame(wanted, "query_id long, tokens array<string>")
    got = joins.containing_tokens(queries, items).collect()
    found = {(r["query_id"], r["item_id"]) for r in got}
    assert found == {(1, 5), (2, 7), (7, 5)} | {(6, i) for i in range(300)} and len(got) == len(found)
    choices = queries.select("query_id", F.array("tokens", F.array(F.lit("w1"))).alias("alternatives"))
    assert {(r[0], r[1]) for r in rollups.any_alternative(choices, items).collect()} == found | {(q, 1) for q, _ in wanted}


def test_equal_races_as_groups(spark):
    boats = [(race, club, [time]) for race, results in {1: [(1, 9)], 2: [(1, 9)], 3: [(1, 8)], 4: [(1, 9)], 5: [(2, None)], 6: [(2, None)]}.items() for club, time in results]
    races = [(1, None), (2, 1), (3, None), (4, 3), (5, 5), (6, 99)]
    t = SimpleNamespace(race=spark.createDataFrame(races, "id long, same_as_id long"), boat=spark.createDataFrame(boats, "race_id long, club_id long, laps_ms array<long>"))
    groups = {r["id"]: (r["group_id"], r["races"], r["pairs"]) for r in audits.identical_groups(t.race, t.boat).collect()}
    pairs = {(r["id"], r["other_id"]) for r in audits.identical_results(t.race, t.boat).collect()}
    assert groups == {1: (1, 3, 5), 2: (1, 3, 5), 4: (1, 3, 5), 5: (5, 2, 2), 6: (5, 2, 2)}
    assert pairs == {(2, 1), (1, 4), (4, 1), (2, 4), (4, 2), (5, 6), (6, 5)}


def test_groups_keep_every_pair(spark):
    boats = [(race, club, [time]) for race, club, time in ((1, 1, 9), (2, 1, 9), (3, 1, 8), (4, 1, 9), (5, 2, None), (6, 2, None), (7, 3, 1), (8, 4, 1), (0, 4, 1), (9, 5, 5))]
    # The ids 0 and 9 occur twice, and 9 has no race but itself.
    races = [(1, None), (2, 1), (3, None), (4, 3), (5, 5), (6, 99), (7, None), (8, 0), (0, 8), (0, None), (9, None), (9, 9)]
    t = SimpleNamespace(race=spark.createDataFrame(races, "id long, same_as_id long"), boat=spark.createDataFrame(boats, "race_id long, club_id long, laps_ms array<long>"))
    groups = audits.linked_groups(t.race, t.boat)
    got = {(r["id"], r["group_id"], r["races"], r["links"], r["pairs"], r["same_id"]) for r in groups.collect()}
    of_one = {(1, 1, 3, 1, 5, None), (2, 1, 3, 2, 5, 1), (4, 1, 3, 2, 5, None)}
    assert got == of_one | {(5, 5, 2, 1, 2, None), (6, 5, 2, 1, 2, None), (8, 0, 2, 1, 1, 0), (0, 0, 2, 0, 1, 8), (0, 0, 2, 0, 1, None)}
    want = sorted(tuple(r) for r in audits.identical_results(t.race, t.boat).collect())
    assert sorted(tuple(r) for r in audits.pairs_of_groups(groups).collect()) == want and groups.count() == 8


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_coarse_groups_hold_the_pairs_of_the_former_sql(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("orders", "lineitem", "supplier", "region", "part"):
        con.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    key = "(club_id % 3, laps_ms[-1] // 60000) ORDER BY club_id % 3, laps_ms[-1] // 60000 NULLS FIRST"
    former = f"""WITH {duckdb_ctes()}, {plans._TWINS}, a AS (SELECT race_id, same_as_id, list({key}) AS k FROM p JOIN r ON r.id = race_id GROUP BY race_id, same_as_id)
        SELECT a.race_id AS id, b.race_id AS other_id FROM a JOIN a AS b ON a.k = b.k AND a.race_id <> b.race_id AND (b.same_as_id IS NULL OR b.same_as_id <> a.race_id)"""
    pairs, coarse = con.sql(former).fetchall(), registry.queries()["aud_7_identical_coarse"](spark, sf)
    assert pairs and sorted(tuple(r) for r in audits.pairs_of_groups(coarse).collect()) == sorted(pairs)
    assert sum(r["links"] for r in coarse.collect()) == len(pairs)


def test_unknown_speeds_come_first(spark):
    races = spark.createDataFrame([(1, dt.date(1998, 5, 1), 2, False)], "id long, date date, league_id int, cancelled boolean")
    boats = spark.createDataFrame([(1, 1, 5000, [900000]), (2, 1, None, [900000]), (3, 1, 6000, [900000])], "id long, race_id long, distance int, laps_ms array<long>").withColumn("club_names", F.array())
    none = spark.createDataFrame([], "participant_id long, disqualification boolean")
    assert [r["id"] for r in audits.league_speeds(races, boats.withColumn("club_names", F.expr("array('X')")), none, 2, 1998).collect()] == [2, 3, 1]


def test_keyed_references_are_not_shuffled(spark):
    from oarframe.operators import filters
    from oarframe.sources.keyed import keyed

    refs = keyed(spark.createDataFrame([(i, "act", str(i)) for i in range(500)], "race_id long, datasource_name string, ref_id string"), ["datasource_name", "ref_id"], buckets=4)
    docs = spark.createDataFrame([("act", str(i)) for i in range(490, 510)] + [("arc", "1")], "datasource string, ref_id string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made, rows in ((scans.drop_known(docs, refs), 11), (filters.ref_exists(refs, docs.withColumnRenamed("datasource", "datasource_name")), 10)):
            text = executed(made)
            # The one exchange is that of the documents.
            assert text.count("Exchange") == 1 and "SelectedBucketsCount: 4 out of 4" in text and made.count() == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
