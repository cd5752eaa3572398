"""Queries of the data-quality rules (DQ), one row for each violation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from .registry import query

_REPEATED = "SELECT '{rule}' AS rule, '{table}' AS entry, concat_ws('|', {shown}) AS row_key, count(*)::VARCHAR AS detail FROM {source} WHERE {present} GROUP BY {keys} HAVING count(*) > 1"


def _repeated(rule: str, table: str, source: str, keys: list[str], test: str = "true") -> str:
    present = " AND ".join([*(f"{k} IS NOT NULL" for k in keys), test])
    return _REPEATED.format(rule=rule, table=table, source=source, shown=", ".join(f"{k}::VARCHAR" for k in keys), keys=", ".join(keys), present=present)


@query("dq_1_unique_edition", " UNION ALL ".join(_repeated("unique_edition", k, "race", [f"{k}_id", "league_id", f"{k}_edition", "modality", "day"]) for k in ("trophy", "flag")))
def _(t):
    return quality.unique_editions(t.race)


@query("dq_2_league_date", _repeated("league_day", "race", "race", ["league_id", "date"], "same_as_id IS NULL"))
def _(t):
    return quality.one_race_per_league_day(t.race)


_BROKEN = "(SELECT * REPLACE (CASE WHEN id % 11 = 0 THEN 0 ELSE flag_edition END AS flag_edition, CASE WHEN id % 23 = 0 THEN NULL ELSE trophy_id END AS trophy_id) FROM race)"


@query("dq_3_paired_edition", " UNION ALL ".join(f"SELECT 'paired_edition' AS rule, '{k}' AS entry, id::VARCHAR AS row_key, NULL::VARCHAR AS detail FROM {_BROKEN} WHERE ({k}_id IS NOT NULL) <> (coalesce({k}_edition, 0) <> 0)" for k in ("flag", "trophy")))
def _(t):
    races = t.race.withColumn("flag_edition", F.when(F.col("id") % 11 == 0, 0).otherwise(F.col("flag_edition"))).withColumn("trophy_id", F.when(F.col("id") % 23 != 0, F.col("trophy_id")))
    return quality.paired_editions(races)


@query("dq_4_second_day_linked", "SELECT 'second_day_linked' AS rule, 'race' AS entry, id::VARCHAR AS row_key, NULL::VARCHAR AS detail FROM race WHERE day = 2 AND same_as_id IS NULL")
def _(t):
    return quality.second_day_linked(t.race.withColumnRenamed("same_as_id", "associated_id"))


@query("dq_5_one_boat", _repeated("one_boat", "participant", "(SELECT * FROM participant WHERE race_id IN (SELECT id FROM race WHERE league_id IS NOT NULL))", ["race_id", "club_id"]))
def _(t):
    return quality.one_boat_per_club(t.participant, t.race)


@query(
    "dq_6_metadata_shape",
    """SELECT 'metadata_shape' AS rule, 'race' AS entry, race_id::VARCHAR AS row_key, concat_ws(';', CASE WHEN race_id % 5 = 0 THEN 'missing values' END, CASE WHEN race_id % 7 = 0 THEN 'extra gender' END, CASE WHEN race_id % 5 <> 0 AND race_id % 6 = 0 THEN 'values' END) AS detail
    FROM race_ref WHERE race_id % 5 = 0 OR race_id % 7 = 0 OR (race_id % 5 <> 0 AND race_id % 6 = 0)""",
)
def _(t):
    part = lambda n, text, other="": F.when(F.col("race_id") % n == 0, F.lit(text)).otherwise(F.lit(other))
    values = F.when(F.col("race_id") % 5 == 0, "").when(F.col("race_id") % 6 == 0, ',"values":{"lanes":4}').otherwise(',"values":{"details_page":"http://x"}')
    json = F.concat(F.lit('[{"ref_id":"'), F.col("ref_id"), F.lit('","datasource_name":"'), F.col("datasource_name"), F.lit('"'), values, part(7, ',"gender":"MALE"'), F.lit("}]"))
    return quality.metadata_shape(t.race_ref.withColumn("json", json), "race_id", "json", "race")


@query(
    "dq_7_domains",
    """SELECT 'domain_gender' AS rule, 'participant' AS entry, id::VARCHAR AS row_key, 'ALL' AS detail FROM participant WHERE id % 97 = 0
    UNION ALL SELECT 'domain_type', 'race', id::VARCHAR, 'SPRINT' FROM race WHERE id % 101 = 0
    UNION ALL SELECT 'domain_reason', 'penalty', participant_id::VARCHAR, 'LATE' FROM penalty WHERE participant_id % 7 = 0
    UNION ALL SELECT 'domain_type', 'entity', id::VARCHAR, 'TEAM' FROM club WHERE id % 5 = 0""",
)
def _(t):
    races = t.race.withColumn("type", F.when(F.col("id") % 101 == 0, "SPRINT").otherwise(F.col("type")))
    boats = t.participant.withColumn("gender", F.when(F.col("id") % 97 == 0, "ALL").otherwise(F.col("gender")))
    penalties = t.penalty.withColumn("reason", F.when(F.col("participant_id") % 7 == 0, "LATE").otherwise(F.col("reason")))
    return quality.domains(races, boats, penalties, t.club.withColumn("type", F.when(F.col("id") % 5 == 0, "TEAM").otherwise("CLUB")))


@query(
    "dq_8_references",
    """SELECT 'race_exists' AS rule, 'participant' AS entry, id::VARCHAR AS row_key, race_id::VARCHAR AS detail FROM participant WHERE race_id % 31 = 0
    UNION ALL SELECT 'club_exists', 'participant', id::VARCHAR, club_id::VARCHAR FROM participant WHERE club_id % 37 = 0
    UNION ALL SELECT 'part_is_no_partnership', 'entity', id::VARCHAR, NULL FROM club WHERE fused_into IS NOT NULL AND id % 20 = 3
    UNION ALL SELECT 'club_is_a_club', 'participant', id::VARCHAR, 'PRIVATE' FROM participant WHERE club_id % 41 = 0 AND club_id % 37 <> 0
    UNION ALL SELECT 'trophy_exists', 'race', id::VARCHAR, trophy_id::VARCHAR FROM race WHERE trophy_id = 4 UNION ALL SELECT 'flag_exists', 'race', id::VARCHAR, flag_id::VARCHAR FROM race WHERE flag_id = 5
    UNION ALL SELECT 'league_exists', 'race', id::VARCHAR, league_id::VARCHAR FROM race WHERE league_id = 2 UNION ALL SELECT 'place_exists', 'race', id::VARCHAR, place_id::VARCHAR FROM race WHERE place_id = 3
    UNION ALL SELECT 'organizer_exists', 'race', id::VARCHAR, organizer_id::VARCHAR FROM race WHERE organizer_id = 7 UNION ALL SELECT 'town_exists', 'place', id::VARCHAR, town_id::VARCHAR FROM place WHERE town_id = 1""",
)
def _(t):
    clubs = t.club.withColumn("is_partnership", F.col("id") % 20 == 3).withColumn("type", F.when(F.col("id") % 41 == 0, "PRIVATE").otherwise("CLUB"))
    links = (
        (t.race, "race", "trophy_id", t.trophy.filter("id <> 4"), "trophy"), (t.race, "race", "flag_id", t.flag.filter("id <> 5"), "flag"),
        (t.race, "race", "league_id", t.league.filter("id <> 2"), "league"), (t.race, "race", "place_id", t.place.filter("id <> 3"), "place"),
        (t.race, "race", "organizer_id", clubs.filter("id <> 7"), "organizer"), (t.place, "place", "town_id", t.town.filter("id <> 1"), "town"),
    )
    # Boats have lost one club in 37; the clubs themselves are all tested.
    return quality.references(t.participant, t.race.filter("id % 31 <> 0"), clubs.filter("id % 37 <> 0"), links, clubs)


@query("dq_9_unique_names", f"{_repeated('unique_name', 'entity', 'part', ['p_name'])} UNION ALL {_repeated('unique_name', 'place', '(SELECT o_custkey % 5 AS town, o_orderpriority AS name FROM orders)', ['name', 'town'])}")
def _(t):
    places = t.orders.select((F.col("o_custkey") % 5).alias("town"), F.col("o_orderpriority").alias("name"))
    return quality.unique_names({"entity": (t.part, ["p_name"]), "place": (places, ["name", "town"])})


@query("dq_10_not_negative", "SELECT 'not_negative_' || c AS rule, 'participant' AS entry, id::VARCHAR AS row_key, v::VARCHAR AS detail FROM (SELECT id, 'distance' AS c, distance - 5100 AS v FROM participant UNION ALL SELECT id, 'lane', lane - 1 FROM participant) WHERE v < 0")
def _(t):
    return quality.not_negative(t.participant.withColumn("distance", F.col("distance") - 5100).withColumn("lane", F.col("lane") - 1), "participant", ["distance", "lane"])
