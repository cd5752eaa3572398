"""Batches whose later documents meet what earlier ones stored, against plain loops in document order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from oarframe.operators import merge

RACE = "id long, date date, day int, trophy_id long, trophy_edition int, flag_id long, flag_edition int, league_id int, modality string"


def saved_one_by_one(new, stored, auto_before):
    """The contract of save_races as a loop: rows are (id, date, day, trophy, its edition, flag, its edition, league, modality)."""
    keys = lambda r: [("t", r[3], r[7], r[4], r[8])] * (None not in (r[3], r[7], r[4], r[8])) + [("f", r[5], r[7], r[6], r[8])] * (None not in (r[5], r[7], r[6], r[8]))
    taken, firsts, out = set(), {}, {}

    def keep(r, day):
        taken.update((k, day) for k in keys(r))
        if day == 1:
            firsts.setdefault((r[3:], r[1].year), r[0])

    for r in sorted(stored):
        keep(r, r[2])
    for r in sorted(new):
        full = lambda day: any((k, day) in taken for k in keys(r))  # noqa: E731, B023
        first = firsts.get((r[3:], r[1].year))
        saved = "SAVE" if r[1].year < auto_before else "REVIEW"
        if r[2] == 1 and not full(1):
            out[r[0]], day = (1, saved, None), 1
        elif first is None or full(2):
            out[r[0]] = (r[2], "REJECT", None)
            continue
        else:
            out[r[0]], day = (2, "SAVE_AS_DAY_2" if r[2] == 1 else saved, first), 2
        keep(r, day)
    return out


def some_races(rng, ids):
    rows = []
    for i in ids:
        trophy, flag = rng.choice([(1, None), (None, 2), (1, 2), (3, 2), (3, None)])
        date = dt.date(rng.choice([1999, 1999, 2005]), 7, 1)
        rows.append((i, date, rng.choice([1, 1, 2]), trophy, trophy and rng.choice([5, 6]), flag, flag and rng.choice([7, 8]), rng.choice([None, 4, 4]), rng.choice(["A", "A", "B"])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_races_of_a_batch_meet_each_other(spark, seed):
    rng = random.Random(seed)
    stored, new = some_races(rng, range(20)), some_races(rng, range(100, 180))
    frame = lambda rows: spark.createDataFrame(rows, RACE).repartition(3)
    got = merge.save_races(frame(new), frame(stored), auto_before=2003).collect()
    assert {r["id"]: (r["day"], r["action"], r["associated_id"]) for r in got} == saved_one_by_one(new, stored, 2003)


def test_a_key_taken_three_times_in_one_batch(spark):
    row = lambda i, day=1: (i, dt.date(1999, 7, i), day, 1, 5, None, None, 4, "A")
    frame = lambda rows: spark.createDataFrame(rows, RACE)
    got = merge.save_races(frame([row(1), row(2), row(3), row(4, 2)]), frame([]), auto_before=2003).orderBy("id").collect()
    assert [(r["day"], r["action"], r["associated_id"]) for r in got] == [(1, "SAVE", None), (2, "SAVE_AS_DAY_2", 1), (1, "REJECT", None), (2, "REJECT", None)]
    assert merge.save_races(frame([]), frame([row(1)])).count() == 0


def test_undecided_races_are_left_for_review(spark):
    # Trophies and flags take turns, so each race waits for the one before it.
    chain = [(i, dt.date(1999, 7, 1), 1, 10 + i // 2, 5, 20 + (i + 1) // 2, 5, 4, "A") for i in range(8)]
    frame = spark.createDataFrame(chain, RACE)
    whole = {r["id"]: (r["day"], r["action"], r["associated_id"]) for r in merge.save_races(frame, frame.limit(0), auto_before=2003).collect()}
    assert whole == saved_one_by_one(chain, [], 2003)
    short = {r["id"]: r["action"] for r in merge.save_races(frame, frame.limit(0), auto_before=2003, max_rounds=2).collect()}
    assert sum(a == "REVIEW" for a in short.values()) == 8 - sum(a != "REVIEW" for a in short.values()) > 0 and len(short) == 8


def test_penalties_of_a_batch_meet_each_other(spark):
    rng = random.Random(7)
    reasons = [None, "", "COLLISION", "SINKING"]
    stored = [(b, rng.choice(reasons), rng.random() < 0.5, [f"n{k}"]) for b in range(12) for k in range(rng.choice([0, 1, 2]))]
    new = [(b, rng.choice(["COLLISION", "SINKING", None]), rng.random() < 0.5, rng.choice([None, "", "x", "y"]), k) for b in range(14) for k in range(rng.choice([1, 2, 4]))]
    want = []
    for boat in range(14):
        held = [[r or None, out, list(notes), None] for b, r, out, notes in stored if b == boat]
        for _, reason, out, note, _ in sorted((n for n in new if n[0] == boat), key=lambda n: n[4]):
            meant = held if len(held) == 1 else [h for h in held if h[0] is not None and h[0] == reason]
            if len(meant) == 1 and (not meant[0][0] or meant[0][0] == reason):
                one = meant[0]
                one[0], one[3] = one[0] or reason, one[3] or "UPDATED"
                if note and note not in one[2]:
                    one[2].append(note)
            else:
                held.append([reason, out, [note] if note else [], "CREATED"])
        want += [(boat, *h) for h in held if h[3]]
    news = spark.createDataFrame(new, "participant_id long, reason string, disqualification boolean, note string, pos int").repartition(3)
    old = spark.createDataFrame(stored, "participant_id long, reason string, disqualification boolean, notes array<string>")
    got = [tuple(r) for r in merge.upsert_penalty(news, old, order="pos").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert merge.upsert_penalty(news.limit(0).drop("pos"), old).count() == 0


def test_tries_share_one_join(spark):
    from oarframe.operators import filters

    races = spark.createDataFrame(
        [(1, dt.date(2020, 7, 1), 1, "MALE", "ABSOLUT", 1, None, None), (2, dt.date(2020, 7, 1), 1, "FEMALE", "ALL", 1, None, None), (3, dt.date(2020, 7, 1), 1, "ALL", "ALL", None, 9, 4)],
        "id long, date date, day int, gender string, category string, trophy_id long, flag_id long, league_id int",
    )
    docs = spark.createDataFrame(
        [
            (10, dt.date(2020, 7, 1), 1, "MALE", "ABSOLUT", 1, None, None, None, None),  # full
            (11, dt.date(2020, 7, 1), 1, "FEMALE", "VETERAN", 1, None, None, None, 9),  # the hint's race
            (12, dt.date(2020, 7, 1), 1, "ALL", "VETERAN", 1, None, None, None, None),  # two without gender
            (13, dt.date(2020, 7, 1), 1, "MALE", "ABSOLUT", None, None, 4, None, None),  # no competition
            (14, dt.date(2020, 7, 2), 1, "MALE", "ABSOLUT", 1, None, None, None, None),  # another day
        ],
        "query_id long, date date, day int, gender string, category string, trophy_id long, flag_id long, league_id int, hint_trophy_id long, hint_flag_id long",
    )
    tiers = filters.closest_tiers(races, docs)
    got = {r["query_id"]: (r["race_id"], r["status"]) for r in filters.first_unique(tiers).collect()}
    assert got == {10: (1, "unique"), 11: (3, "unique"), 12: (None, "ambiguous")}
    plan = merge.plan_races(docs.withColumns({"trophy_edition": F.lit(3), "flag_edition": F.lit(None).cast("int")}), races.withColumns({"trophy_edition": F.lit(3), "flag_edition": F.lit(None).cast("int")}), spark.sql("select 1L as id, 'TROFEO' as name"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") <= 15


BOAT = "id long, race_id long, club_id long, gender string, category string, branch string, club_names array<string>, laps_ms array<long>, lane int, metadata array<struct<datasource_name:string,ref_id:string>>"


def planned_one_by_one(docs, stored, update):
    """The contract of plan_participants as a loop over dictionaries, for races without a league."""
    boats = {b["id"]: dict(b) for b in stored}
    out = {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        same = [b for b in boats.values() if all(b[k] == d[k] for k in ("race_id", "club_id", "branch"))]
        letter = d["raw_name"][-1] if d["raw_name"] and d["raw_name"][-2:] in (" B", " C") else None
        if len(same) > 1 and d["raw_name"] is not None:
            same = [b for b in same if b["branch"] == letter]
        if len(same) > 1:
            out[d["doc_id"]] = ("REVIEW", None)
            continue
        ref = (d["datasource"], d["ref_id"])
        old = same[0] if same else None
        if old is not None:
            longer, lane = len(d["laps_ms"]) > len(old["laps_ms"]), d["lane"] is not None and d["lane"] != old["lane"]
            status = "MERGED" if (longer or lane) and update else "EXISTING" if not (longer or lane) else None
            if status is None:
                status = "MERGED" if all(m[0] != ref[0] for m in old["metadata"]) else "NEW"
            if status != "NEW":
                if update and longer:
                    old["laps_ms"] = d["laps_ms"]
                if update and lane:
                    old["lane"] = d["lane"]
                if ref not in old["metadata"]:
                    old["metadata"] = [*old["metadata"], ref]
                    old["club_names"] = sorted({*old["club_names"], d["club_name"]})
                out[d["doc_id"]] = (status, old["id"], old["laps_ms"], old["lane"], old["club_names"], old["branch"], old["metadata"])
                continue
        new = {
            "id": -1 - d["doc_id"], "race_id": d["race_id"], "club_id": d["club_id"], "laps_ms": d["laps_ms"], "lane": d["lane"], "branch": d["branch"] if d["can_be_branch"] else None,
            "club_names": sorted({d["club_name"], *(old["club_names"] if old else ())}), "metadata": [ref],
        }
        boats[new["id"]] = new
        out[d["doc_id"]] = ("NEW", None, new["laps_ms"], new["lane"], new["club_names"], new["branch"], new["metadata"])
    return out


@pytest.mark.parametrize("update", [True, False])
def test_boats_of_a_batch_meet_each_other(spark, update):
    rng = random.Random(update)
    shape = lambda: {"race_id": rng.randrange(3), "club_id": rng.randrange(3), "branch": rng.choice([None, None, "B"]), "laps_ms": [100] * rng.randint(0, 3), "lane": rng.choice([None, 1, 2])}
    stored = [{"id": i, **shape(), "club_names": ["OLD"], "metadata": rng.choice([[], [("act", None)]])} for i in range(8)]
    docs = [
        {"doc_id": i, **shape(), "raw_name": rng.choice([None, "X", "X B"]), "can_be_branch": rng.random() < 0.5, "club_name": rng.choice(["N1", "N2"]), "datasource": rng.choice(["act", "arc"]), "ref_id": rng.choice([None, "7"])}
        for i in range(40)
    ]
    fixed = {"gender": "MALE", "category": "ABSOLUT"}
    boats = spark.createDataFrame([fixed | b for b in stored], BOAT)
    kind = "doc_id long, race_id long, club_id long, gender string, category string, branch string, raw_name string, has_league boolean, time_trial boolean, can_be_branch boolean, laps_ms array<long>, lane int, club_name string, datasource string, ref_id string"
    frame = spark.createDataFrame([fixed | {"has_league": False, "time_trial": False} | d for d in docs], kind).repartition(3)
    got = {}
    for r in merge.plan_participants_in_order(frame, boats, "always" if update else "never").collect():
        row = (r["status"], r["participant_id"], r["laps_ms"], r["lane"], r["club_names"] and sorted(r["club_names"]), r["branch"], r["refs"] and [tuple(m) for m in r["refs"]])
        got[r["doc_id"]] = row if r["status"] != "REVIEW" else row[:2]
    want = planned_one_by_one(docs, stored, update)
    assert got == {i: (w[0], w[1], *w[2:]) for i, w in want.items()} and {w[0] for w in want.values()} >= {"NEW", "EXISTING"}
    assert {r["status"] for r in merge.plan_participants_in_order(frame, boats, max_rounds=1).collect()} >= {"REVIEW"}
    assert merge.plan_participants_in_order(frame.limit(0), boats).count() == 0
