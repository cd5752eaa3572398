"""Small frames that restate expected values and the notes on nulls, ties and ambiguity."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from oarframe.functions import laps, metadata, text
from oarframe.operators import filters, joins, merge, quality, rollups, speeds


def column(spark, value, kind, make):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x"))).first()[0]


def boats(spark, rows):
    return spark.createDataFrame(rows, "id long, race_id long, date date, year int, distance int, laps_ms array<long>")


def test_year_speeds_by_race(spark):
    rows = boats(spark, [
        (1, 1, dt.date(2022, 7, 1), 2022, 5556, [100000, 1290210]),
        (2, 2, dt.date(2009, 7, 1), 2009, 5556, [1298210]),
    ])
    got = {r["year"]: r["speeds"] for r in speeds.year_speeds(rows).collect()}
    assert got[2022] == pytest.approx([15.502592601204455], abs=1e-9)
    assert got[2009] == pytest.approx([15.407060490983739], abs=1e-9)


def test_nth_speed_and_null_speeds(spark):
    rows = boats(spark, [(1, 1, dt.date(2022, 7, 1), 2022, 5556, [1290210]), (2, 1, dt.date(2022, 7, 1), 2022, None, [1298210])])
    assert speeds.nth_speed(rows, 1).first()["speed"] is None  # nulls come first, as they are stored
    assert speeds.nth_speed(rows, 1, keep_null_speeds=False).first()["speed"] == pytest.approx(15.502592601204455, abs=1e-9)
    assert speeds.nth_speed(rows, 3).count() == 0
    assert [x is None for x in speeds.year_speeds(rows).first()["speeds"]] == [True, False]
    assert speeds.year_speeds(rows.limit(0), normalize=True).count() == 0


@pytest.mark.parametrize("written, ms", [("05:31.19", 331190), ("21:30.210000", 1290210), ("59:59.9", 3599900), ("60:00.0", None), ("x", None), (None, None)])
def test_lap_ms(spark, written, ms):
    assert column(spark, written, "string", laps.lap_ms) == ms


def test_empty_laps(spark):
    row = spark.createDataFrame([(5000, [])], "distance int, laps_ms array<long>").select(speeds.speed_of(), laps.last_lap(F.col("laps_ms"))).first()
    assert tuple(row) == (None, None)


@pytest.mark.parametrize("written, date", [("03/07/2022", dt.date(2022, 7, 3)), ("2022-07-03", None), ("31/02/2022", None), (None, None)])
def test_source_date(spark, written, date):
    assert column(spark, written, "string", laps.source_date) == date


def test_strip_branch_faithful_strips_a_character_set(spark):
    assert column(spark, "CLUB B", "string", lambda c: text.strip_branch(c, faithful=True)) == "CLU"
    assert column(spark, "CLUB B", "string", text.strip_branch) == "CLUB"


def test_roman(spark):
    got = spark.createDataFrame([(i,) for i in (0, 4, 9, 14, 40, 199)], "x int").select(joins.roman(F.col("x"))).collect()
    assert [r[0] for r in got] == [None, "IV", "IX", "XIV", "XL", "CXCIX"]


def test_two_boats_of_a_club(spark):
    races = spark.createDataFrame([(1, dt.date(2022, 1, 1))], "id long, date date")
    p = spark.createDataFrame([(1, 7), (1, 7)], "race_id long, club_id long")
    assert filters.filter_races(races, p, participant=7).count() == 1
    assert filters.filter_races(races, p, faithful=True, participant=7).count() == 2
    assert filters.filter_races(races, nothing=3).count() == 1


def test_status_of_matches(spark):
    matches = spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "q long, m long")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "q long")
    got = {r["q"]: (r["m"], r["status"]) for r in filters.with_status(matches, "q", "m", queries).collect()}
    assert got == {1: (10, "unique"), 2: (None, "ambiguous"), 3: (None, "none")}


def test_merge_race_keeps_four_laps_and_widens(spark):
    el = "struct<datasource_name:string,ref_id:string>"
    pairs = spark.createDataFrame(
        [(1, [("act", "1")], "MALE", "ABSOLUT", ["A"], 4, 3, None, None, ("act", "2"), "FEMALE", "ABSOLUT", ["B"], 2, 4, "S", 3)],
        f"id long, metadata array<{el}>, gender string, category string, race_names array<string>, laps int, lanes int, sponsor string, place_id long, new_metadata {el}, new_gender string, new_category string, new_race_names array<string>, new_laps int, new_lanes int, new_sponsor string, new_place_id long",
    )
    r = merge.merge_race(pairs).first()
    assert (r["gender"], r["category"], r["laps"], r["lanes"], r["sponsor"], r["place_id"], r["race_names"], len(r["metadata"])) == ("ALL", "ABSOLUT", 4, 4, "S", 3, ["A", "B"], 2)


def test_add_element_rejects_duplicates(spark):
    el = "struct<datasource_name:string,ref_id:string>"
    df = spark.createDataFrame([([("act", None)], ("act", None)), ([], ("act", "1"))], f"m array<{el}>, e {el}")
    assert [len(r[0]) for r in df.select(metadata.add_element(F.col("m"), F.col("e"))).collect()] == [1, 1]


def test_fold_consecutive_future_ends_a_run(spark):
    day = lambda d: dt.date(2022, 1, d)
    docs = spark.createDataFrame([("s", 1, "A", "1", "MALE", 2, day(1)), ("s", 2, "A", "2", "FEMALE", 1, day(2)), ("s", 3, "A", "3", "MALE", 1, day(30)), ("s", 4, "A", "4", "MALE", 1, day(3))], "src string, pos int, name string, ref_id string, gender string, boats int, date date")
    got = sorted((r["first"], r["ref_ids"], r["boats"], r["gender"]) for r in rollups.fold_consecutive(docs, "src", "pos", "2022-01-10").collect())
    assert got == [(1, ["1", "2"], 3, "ALL"), (4, ["4"], 1, "MALE")]


def test_participant_count_violation(spark):
    p = spark.createDataFrame([(1,)], "race_id long")
    docs = spark.createDataFrame([(1, 0), (2, 0)], "race_id long, expected int")
    assert [tuple(r) for r in rollups.participant_count_check(p, docs).collect()] == [(1, 1, 0)]


def test_metadata_shape(spark):
    good = '[{"ref_id":"1","datasource_name":"act","values":{"details_page":"http://x"}}]'
    extra = good.replace('"ref_id"', '"other":1,"ref_id"')
    missing = '[{"ref_id":"1","datasource_name":"act"}]'
    listed = '[{"ref_id":"1","datasource_name":"act","values":[1]}]'
    df = spark.createDataFrame([(i, j) for i, j in enumerate((good, extra, missing, listed, None))], "id int, json string")
    assert {r["row_key"]: r["detail"] for r in quality.metadata_shape(df, "id", "json", "race").collect()} == {"1": "extra other", "2": "missing values", "3": "values"}


def test_unanimous_and_single_distinct(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", None), ("c", 2), ("c", 2), ("d", None)], "k string, v int")
    got = {r["k"]: (r["u"], r["s"]) for r in df.groupBy("k").agg(rollups.unanimous("v").alias("u"), rollups.single_distinct("v").alias("s")).collect()}
    assert got == {"a": (1, 1), "b": (None, 1), "c": (2, 2), "d": (None, None)}


def test_substring_pairs_with_short_parts(spark):
    parts = spark.createDataFrame([(1, "AB"), (1, "RAMA"), (2, "Q")], "query_id long, part string")
    names = spark.createDataFrame([(10, "CABO"), (11, "PANORAMA"), (12, "A")], "entity_id long, text string")
    assert {(r["query_id"], r["entity_id"]) for r in joins.substring_pairs(parts, names).collect()} == {(1, 10), (1, 11)}
