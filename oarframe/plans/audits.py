"""Queries of the audits (AUD)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.laps import last_lap
from ..operators import audits
from .registry import query

PLAY = "(SELECT r.{} FROM race AS r JOIN trophy ON trophy.id = r.trophy_id WHERE upper(name) LIKE '%PLAY%')"


@query(
    "aud_1_lanes_in_time_trials",
    f"SELECT p.id, p.race_id FROM participant AS p JOIN race AS a ON a.id = p.race_id WHERE a.type = 'TIME_TRIAL' AND (SELECT count(DISTINCT b.lane) FROM participant AS b WHERE b.race_id = a.id) > 1 AND a.id NOT IN {PLAY.format('id')}",
)
def _(t):
    return audits.lanes_in_time_trials(t.race, t.participant, t.trophy)


@query(
    "aud_2_without_laps",
    """SELECT p.id, p.race_id, (SELECT array_to_string(list(datasource_name || ':' || ref_id ORDER BY pos), ',') FROM race_ref AS f WHERE f.race_id = p.race_id) AS refs FROM participant AS p JOIN race AS r ON r.id = p.race_id
    WHERE len(laps_ms) = 0 AND NOT absent AND NOT retired AND NOT cancelled AND NOT EXISTS (SELECT 1 FROM penalty AS x WHERE x.participant_id = p.id)""",
)
def _(t):
    found = audits.without_laps(t.race_with_metadata, t.participant, t.penalty)
    return found.select("id", "race_id", F.array_join(F.transform("metadata", lambda m: F.concat(m["datasource_name"], F.lit(":"), m["ref_id"])), ",").alias("refs"))


def _varying(measure: str) -> None:
    keys = [k for k in ("place_id", "league_id", "trophy_id", "flag_id") if k != measure]
    same = " AND ".join(f"b.{k} IS NOT DISTINCT FROM a.{k}" for k in keys)

    @query(
        f"aud_3_{measure.removesuffix('_id')}",
        f"SELECT a.id, a.{measure} FROM race AS a WHERE a.type <> 'TIME_TRIAL' AND (SELECT count(DISTINCT b.{measure}) FROM race AS b WHERE b.gender = a.gender AND b.type = a.type AND b.type <> 'TIME_TRIAL' AND {same}) > 1 AND a.id NOT IN {PLAY.format('id')}",
    )
    def _(t):
        return audits.varying(t.race, t.trophy, measure)


for _measure in ("laps", "lanes", "place_id", "organizer_id"):
    _varying(_measure)


@query(
    "aud_4_lane_count",
    f"""SELECT a.id, a.lanes, (SELECT count(DISTINCT lane) FROM participant AS p WHERE p.race_id = a.id) AS used FROM race AS a
    WHERE (SELECT count(lane) FROM participant AS p WHERE p.race_id = a.id) > 1 AND a.lanes <> (SELECT count(DISTINCT lane) FROM participant AS p WHERE p.race_id = a.id) AND a.id NOT IN {PLAY.format('id')}""",
)
def _(t):
    return audits.lane_count_differs(t.race, t.participant, t.trophy)


@query(
    "aud_5_field_size",
    f"""WITH n AS (SELECT race_id, count(*) AS n FROM participant WHERE NOT guest GROUP BY race_id),
    big AS (SELECT league_id, gender, yr, max(n) AS largest FROM n JOIN race ON id = race_id WHERE NOT cancelled GROUP BY ALL)
    SELECT a.id, coalesce(n.n, 0) AS boats, largest FROM race AS a JOIN big USING (league_id, gender, yr) LEFT JOIN n ON n.race_id = a.id
    WHERE NOT cancelled AND league_id NOT IN (14, 15) AND a.date NOT IN {PLAY.format('date')} AND coalesce(n.n, 0) <> largest""",
)
def _(t):
    return audits.field_size_differs(t.race, t.participant, t.trophy)


#: Every boat, and for those of one race in fifty another that was an hour slower.
_PACED = """boats AS (SELECT id, race_id, laps_ms FROM participant UNION ALL SELECT -id, race_id, [laps_ms[-1] + 3600000] FROM participant WHERE race_id % 50 = 0 AND len(laps_ms) > 0)"""


def _paced(t):
    slower = F.array(last_lap(F.col("laps_ms")) + 3600000)
    late = t.participant.filter((F.col("race_id") % 50 == 0) & (F.size("laps_ms") > 0)).select((-F.col("id")).alias("id"), "race_id", slower.alias("laps_ms"))
    return t.participant.select("id", "race_id", "laps_ms").unionByName(late)


def _tied(name: str, resolution: int) -> None:
    @query(
        name,
        f"""WITH {_PACED} SELECT p.id, p.race_id FROM boats AS p WHERE p.laps_ms[-1] > 0 AND EXISTS (SELECT 1 FROM boats AS q WHERE q.race_id = p.race_id AND q.id <> p.id
        AND q.laps_ms[-1] % 3600000 // {resolution} = p.laps_ms[-1] % 3600000 // {resolution})""",
    )
    def _(t):
        return audits.tied(_paced(t), resolution)


_tied("aud_6_tied", 1)
_tied("aud_6_tied_second", 1000)

#: Every race, and for one in thirty a second one with the same boats; half of these are marked as the same.
_TWINS = """r AS (SELECT id, same_as_id FROM race UNION ALL SELECT -id, CASE WHEN id % 60 = 0 THEN id END FROM race WHERE id % 30 = 0),
    p AS (SELECT race_id, club_id, laps_ms FROM participant UNION ALL SELECT -race_id, club_id, laps_ms FROM participant WHERE race_id % 30 = 0)"""


def _twins(t):
    races = t.race.select("id", "same_as_id")
    twin = races.filter("id % 30 = 0").select((-F.col("id")).alias("id"), F.when(F.col("id") % 60 == 0, F.col("id")).alias("same_as_id"))
    boats = t.participant.select("race_id", "club_id", "laps_ms")
    again = boats.filter("race_id % 30 = 0").withColumn("race_id", -F.col("race_id"))
    return races.unionByName(twin), boats.unionByName(again)


def _identical(name: str, club: str, time: str, spark_club, spark_time) -> None:
    @query(
        name,
        f"""WITH {_TWINS}, a AS (SELECT race_id, same_as_id, list(({club}, {time}) ORDER BY {club}, {time} NULLS FIRST) AS k FROM p JOIN r ON r.id = race_id GROUP BY race_id, same_as_id)
        SELECT a.race_id AS id, b.race_id AS other_id FROM a JOIN a AS b ON a.k = b.k AND a.race_id <> b.race_id AND (b.same_as_id IS NULL OR b.same_as_id <> a.race_id)""",
    )
    def _(t):
        return audits.identical_results(*_twins(t), club=spark_club(), time=spark_time())


_identical("aud_7_identical", "club_id", "laps_ms[-1]", lambda: None, lambda: None)


def _grouped(name: str, club: str, time: str, spark_club, spark_time) -> None:
    @query(
        name,
        f"""WITH {_TWINS}, a AS (SELECT race_id, same_as_id, list(({club}, {time}) ORDER BY {club}, {time} NULLS FIRST) AS k FROM p JOIN r ON r.id = race_id GROUP BY race_id, same_as_id),
        g AS (SELECT *, count(*) OVER (PARTITION BY k) AS races, min(race_id) OVER (PARTITION BY k) AS group_id FROM a),
        m AS (SELECT g.group_id, count(*) AS marks FROM g JOIN g AS o ON o.race_id = g.same_as_id AND o.group_id = g.group_id AND o.race_id <> g.race_id GROUP BY g.group_id)
        SELECT race_id AS id, group_id, races, races * (races - 1) - coalesce(marks, 0) AS pairs FROM g LEFT JOIN m USING (group_id) WHERE races > 1""",
    )
    def _(t):
        return audits.identical_groups(*_twins(t), club=spark_club(), time=spark_time())


_grouped("aud_7_identical_groups", "club_id", "laps_ms[-1]", lambda: None, lambda: None)


# Pairs at this grain grow with the square of the races, so each race comes with its group, its number of links and its mark.
@query(
    "aud_7_identical_coarse",
    f"""WITH {_TWINS}, a AS (SELECT race_id, same_as_id, list((club_id % 3, laps_ms[-1] // 60000) ORDER BY club_id % 3, laps_ms[-1] // 60000 NULLS FIRST) AS k FROM p JOIN r ON r.id = race_id GROUP BY race_id, same_as_id),
    g AS (SELECT k, min(race_id) AS group_id, count(DISTINCT race_id) AS races, count(*) AS n FROM a GROUP BY k HAVING min(race_id) <> max(race_id)),
    m AS (SELECT race_id, same_as_id, group_id, races, n - count(*) OVER (PARTITION BY group_id, race_id) AS others FROM a JOIN g USING (k)),
    o AS (SELECT group_id, race_id FROM m GROUP BY ALL),
    x AS (SELECT group_id, same_as_id AS race_id, count(*) AS marks FROM m WHERE same_as_id <> race_id GROUP BY ALL),
    y AS (SELECT m.race_id AS id, m.group_id, races, others - coalesce(marks, 0) AS links, o.race_id AS same_id FROM m LEFT JOIN x ON x.group_id = m.group_id AND x.race_id = m.race_id
      LEFT JOIN o ON o.group_id = m.group_id AND o.race_id = m.same_as_id AND o.race_id <> m.race_id)
    SELECT id, group_id, races, links, CAST(sum(links) OVER (PARTITION BY group_id) AS BIGINT) AS pairs, same_id FROM y""",
)
def _(t):
    return audits.linked_groups(*_twins(t), club=F.col("club_id") % 3, time=F.floor(last_lap(F.col("laps_ms")) / 60000))


@query(
    "aud_8_league_speeds",
    """SELECT p.id, race_id, yr AS year, round(distance / (laps_ms[-1] / 1000.0::DOUBLE) * 3.6::DOUBLE, 6) AS speed FROM participant AS p JOIN race AS r ON r.id = race_id
    WHERE league_id = 2 AND yr = 1998 AND NOT cancelled AND len(laps_ms) > 0 AND laps_ms[-1] > 0 AND len(list_filter(club_names, lambda n: n LIKE '% B')) = 0
      AND p.id NOT IN (SELECT participant_id FROM penalty WHERE disqualification)""",
)
def _(t):
    return audits.league_speeds(t.race, t.participant, t.penalty, 2, 1998).withColumn("speed", F.round("speed", 6))
