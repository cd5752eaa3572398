"""Whole documents through the ingest chain: the merge cases restated with hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from oarframe.functions.text import name_tokens
from oarframe.operators import digest, merge
from oarframe.sources import documents

META = "array<struct<ref_id:string,datasource_name:string,values:map<string,string>>>"
RACE = (
    "id long, laps int, lanes int, type string, date date, day int, cancelled boolean, race_names array<string>, trophy_id long, trophy_edition int, flag_id long, flag_edition int, "
    f"league_id int, modality string, gender string, category string, organizer_id long, sponsor string, place_id long, metadata {META}"
)
BOAT = "id long, race_id long, club_id long, gender string, category string, branch string, club_names array<string>, laps_ms array<long>, lane int, distance int, series int, retired boolean, absent boolean, metadata array<struct<datasource_name:string,ref_id:string>>"


def race(i, **changes):
    row = {
        "id": i, "laps": 6, "lanes": 3, "type": "CONVENTIONAL", "date": dt.date(2020, 8, 22), "day": 1, "cancelled": False, "race_names": ["OLD NAME"], "trophy_id": None, "trophy_edition": None, "flag_id": 5,
        "flag_edition": 15, "league_id": 4, "modality": "TRAINERA", "gender": "MALE", "category": "ABSOLUT", "organizer_id": 25, "sponsor": None, "place_id": 3, "metadata": [("88", "act", {})],
    }
    return tuple((row | changes).values())


def doc(**changes):
    row = {
        "name": "XV BANDEIRA CONCELLO DE A POBRA", "date": "22/08/2020", "day": 1, "modality": "TRAINERA", "type": "CONVENTIONAL", "league": "LIGA GALEGA B", "town": None, "organizer": None, "sponsor": None,
        "normalized_names": [["BANDEIRA CONCELLO DE A POBRA", "15"]], "race_ids": ["1"], "url": "test", "datasource": "traineras", "gender": "MALE", "category": "ABSOLUT", "race_notes": None, "race_laps": 6, "race_lanes": 4,
        "cancelled": False, "participants": [],
    }
    return row | changes


def boat(club, name=None, laps=("05:31.000000", "22:24.190000"), **changes):
    return {"gender": "MALE", "category": "ABSOLUT", "club_name": name or f"C.R. {club}", "lane": 5, "series": 2, "laps": list(laps), "distance": 5556, "participant": club} | changes


@pytest.fixture(scope="module")
def world(spark):
    """The stored tables beside races and boats."""
    items = lambda rows: spark.createDataFrame(rows, "item_id long, name string").withColumn("tokens", name_tokens(F.col("name")))
    entities = spark.createDataFrame([(i, n, n, [], "CLUB", True) for i, n in ((25, "PUEBLA"), (1, "ARES"), (2, "CHAPELA"), (3, "CASTROPOL"))], "id long, name string, normalized_name string, known_names array<string>, type string, is_active boolean")
    return {
        "trophies": items([(7, "TROFEO TERESA HERRERA"), (8, "PLAY OFF")]), "flags": items([(5, "BANDEIRA CONCELLO DE A POBRA"), (6, "BANDERA CONCELLO DE REDONDELA")]),
        "leagues": spark.createDataFrame([(4, "LIGA GALEGA B")], "id int, name string"), "entities": entities, "places": spark.createDataFrame([(3, "A POBRA"), (9, "REDONDELA")], "id long, name string"),
    }


@pytest.fixture
def landed(spark, tmp_path):
    """Documents written as they land and read by the library's reader, in the given order."""
    import json

    def land(*docs):
        with open(f"{tmp_path}/docs.json", "w") as f:
            f.writelines(json.dumps(d | {"race_laps": d["race_laps"]}) + "\n" for d in docs)
        read = documents.read_race_documents(spark, f"{tmp_path}/docs.json", lines=True)
        return digest.prepared(read.withColumn("order", F.monotonically_increasing_id()).coalesce(1), "order")

    return land


def plan(spark, world, docs, races, **options):
    return {r["doc_id"]: r for r in digest.digest_races(docs, spark.createDataFrame(races, RACE), **world, **options).collect()}


def test_merge_changes_fields(spark, world, landed):
    got = plan(spark, world, landed(doc(gender="FEMALE", town="A POBRA")), [race(15)])[0]
    assert (got["status"], got["race_id"], got["lanes"], got["laps"], got["gender"], got["category"]) == ("MERGED", 15, 4, 6, "ALL", "ABSOLUT")
    assert sorted(got["race_names"]) == ["OLD NAME", "XV BANDEIRA CONCELLO DE A POBRA"] and got["trophy_id"] is None and got["flag_edition"] == 15
    assert [(m["ref_id"], m["datasource_name"], m["values"]) for m in got["metadata"]] == [("88", "act", {}), ("1", "traineras", {"details_page": "test"})]


def test_missing_place_and_organizer_are_filled(spark, world, landed):
    got = plan(spark, world, landed(doc(date="22/08/1890")), [race(15), race(16, date=dt.date(2019, 8, 1), flag_edition=14)])[0]
    assert (got["status"], got["race_id"], got["place_id"], got["organizer_id"], got["league_id"], got["flag_id"], got["flag_edition"]) == ("NEW", None, 3, 25, 4, 5, 15)
    assert got["date"] == dt.date(1890, 8, 22) and got["metadata"][0]["ref_id"] == "1"


def test_force_gender(spark, world, landed):
    docs = landed(doc(name="BANDERA CONCELLO DE REDONDELA", normalized_names=[["BANDERA CONCELLO DE REDONDELA", "3"]], league=None, gender="FEMALE"))
    stored = [race(20, flag_id=6, flag_edition=3, league_id=None)]
    assert plan(spark, world, docs, stored)[0]["status"] == "MERGED"
    assert plan(spark, world, docs, stored, force_gender=True)[0]["status"] == "NEW"
    # A policy that merges nothing leaves the match as the associated race.
    never = plan(spark, world, docs, stored, merge="never")[0]
    assert (never["status"], never["race_id"], never["associated_id"]) == ("NEW", None, 20)
    assert plan(spark, world, docs, stored, merge="review")[0]["status"] == "REVIEW"


def test_editions_hints_and_other_days(spark, world, landed):
    name = "MEMORIAL CUP"
    docs = landed(
        doc(normalized_names=[["NOBODY KNOWS THIS", "4"]], name=name, league=None, date="01/07/2021"),  # no competition yet
        doc(normalized_names=[["MEMORIAL X", "99"], ["BANDEIRA CONCELLO DE A POBRA", None], ["NOBODY KNOWS THIS", "17"]], name=name, league=None, date="02/07/2021"),  # a later name's edition
        doc(normalized_names=[["NOBODY KNOWS THIS", "18"]], name=name, league=None, date="03/07/2021"),  # by the hint of the second
        doc(normalized_names=[["BANDEIRA CONCELLO DE A POBRA", None]], name="OTHER", league=None, date="04/07/2021"),  # inferred from the year before
        doc(normalized_names=[["BANDEIRA CONCELLO DE A POBRA", "15"]], date="23/08/2020", day=2),  # the second day
    )
    got = plan(spark, world, docs, [race(15)])
    assert [got[i]["status"] for i in range(5)] == ["IGNORED", "NEW", "NEW", "NEW", "NEW"]
    assert [(got[i]["flag_id"], got[i]["flag_edition"]) for i in range(5)] == [(None, None), (5, 17), (5, 18), (5, 16), (5, 15)]
    assert [got[i]["associated_id"] for i in range(5)] == [None, None, None, None, 15]


def test_several_stored_races_are_reviewed(spark, world, landed):
    got = plan(spark, world, landed(doc(league=None)), [race(15), race(16, league_id=None)])
    assert (got[0]["status"], got[0]["race_id"]) == ("REVIEW", None)
    assert plan(spark, world, landed(doc()).limit(0), [race(15)]) == {}


def test_boats_of_a_document(spark, world, landed):
    docs = landed(
        doc(
            participants=[
                boat("ARES"), boat("CHAPELA", laps=("05:32.000000", "22:27.130000", "22:40.000000"), penalty={"reason": "SINKING", "disqualification": True}, retired=True),
                boat("CASTROPOL", handicap="01:00.5", absent=True), boat("CASTROPOL B", lane=1), boat("NOBODY KNOWS THIS"),
            ],
            race_notes=" windy ",
        ),
        doc(date="22/08/1999", type="TIME_TRIAL", league=None, participants=[boat("ARES B"), boat("ARES"), boat("CHAPELA", retired=True, penalty={"reason": "SINKING", "disqualification": True})]),
    )
    stored = spark.createDataFrame(
        [
            (100, 15, 1, "MALE", "ABSOLUT", None, ["CR ARES"], [331000, 1344190], 5, 5556, 2, False, False, [("traineras", None)]),
            (101, 15, 2, "MALE", "ABSOLUT", None, ["CHAPELA"], [332000], 4, 5000, 1, False, False, []),
        ],
        BOAT,
    )
    decisions = digest.digest_races(docs, spark.createDataFrame([race(15)], RACE), **world)
    boats = digest.digest_participants(docs, decisions, stored, world["entities"], normalized=lambda c: F.regexp_replace(F.trim(c), " [BCD]$", ""))
    got = {(r["doc_id"], r["boat"]): r for r in boats.collect()}
    first, second = got[0, 0], got[0, 1]
    assert (first["status"], first["participant_id"], first["club_names"], len(first["refs"])) == ("EXISTING", 100, ["CR ARES"], 1)
    assert (second["status"], second["participant_id"], second["laps_ms"], second["lane"], second["distance"]) == ("MERGED", 101, [332000, 1347130, 1360000], 5, 5000)
    assert second["club_names"] == ["CHAPELA", "CR CHAPELA"] and [r["datasource_name"] for r in second["refs"]] == ["traineras"]
    assert (got[0, 2]["status"], got[0, 2]["handicap_ms"], got[0, 2]["absent"], got[0, 2]["laps_ms"]) == ("NEW", 60500, True, [331000, 1344190])
    assert (got[0, 3]["branch"], got[0, 3]["lane"]) == (None, 1)  # a league's boat is no branch
    assert (got[0, 4]["status"], got[0, 4]["club_id"]) == ("REVIEW", None)
    assert [(got[1, i]["status"], got[1, i]["branch"], got[1, i]["lane"], got[1, i]["retired"]) for i in range(3)] == [("NEW", "B", 1, False), ("NEW", None, 1, False), ("NEW", None, 1, False)]
    fines = digest.digest_penalties(docs, boats)
    kept = merge.upsert_penalty(fines, spark.createDataFrame([], "participant_id long, reason string, disqualification boolean, notes array<string>"), order="at").collect()
    assert [tuple(r) for r in kept] == [(101, "SINKING", True, ["windy"], "CREATED")]
