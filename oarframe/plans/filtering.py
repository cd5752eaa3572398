"""Queries of the filters and lookups (FLT) and of the sort orders (SRT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metadata import metadata_contains
from ..operators import filters, sorting, speeds
from ..sources.keyed import keyed
from ..sources.scans import drop_known
from .registry import query

FOLD = "upper(strip_accents({}))"


@query("flt_1_filter_races", "SELECT id, date, league_id FROM race WHERE yr = 1996 AND day = 1 AND league_id = 2")
def _(t):
    return filters.filter_races(t.race, year=1996, day=1, league=2, unheard_of=9).select("id", "date", "league_id")


@query("flt_2_participant", "SELECT id, date FROM race WHERE id IN (SELECT race_id FROM participant WHERE club_id = 7)")
def _(t):
    return filters.filter_races(t.race, t.participant, participant=7).select("id", "date")


@query("flt_2_participant_faithful", "SELECT race.id, date FROM race JOIN participant AS p ON p.race_id = race.id WHERE club_id = 7")
def _(t):
    return filters.filter_races(t.race, t.participant, faithful=True, participant=7).select("id", "date")


@query(
    "flt_3_keyword_search",
    """SELECT r.id FROM race AS r LEFT JOIN trophy ON trophy.id = trophy_id LEFT JOIN flag ON flag.id = flag_id
    LEFT JOIN league ON league.id = league_id LEFT JOIN place ON place.id = place_id
    WHERE contains(upper(strip_accents(concat_ws('|', trophy.name, flag.name, league.name, place.name, r.sponsor))), 'BANDERA 3')""",
)
def _(t):
    return filters.keyword_search(t.race, t.trophy, t.flag, t.league, t.place, "bandéra de (3)").select("id")


@query("flt_4_metadata_contains", "SELECT DISTINCT race_id AS id FROM race_ref WHERE datasource_name = 'traineras'")
def _(t):
    return t.race_with_metadata.filter(metadata_contains(F.col("metadata"), "traineras")).select("id")


_WANTED = "wanted AS (SELECT pos AS query_id, datasource AS datasource_name, ref_id, CASE WHEN pos % 8 = 0 THEN day END AS day FROM doc)"


def _wanted(t):
    return t.doc.select(F.col("pos").alias("query_id"), F.col("datasource").alias("datasource_name"), "ref_id", F.when(F.col("pos") % 8 == 0, F.col("day")).alias("day"))


@query(
    "flt_5_race_by_ref",
    f"""WITH {_WANTED}
    SELECT w.query_id, CASE WHEN count(DISTINCT r.id) = 1 THEN min(r.id) END AS race_id,
      CASE count(DISTINCT r.id) WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status
    FROM wanted AS w LEFT JOIN race_ref AS f ON f.datasource_name = w.datasource_name AND f.ref_id = w.ref_id
    LEFT JOIN race AS r ON r.id = f.race_id AND (w.day IS NULL OR w.day = r.day) GROUP BY w.query_id""",
)
def _(t):
    return filters.race_by_ref(t.race_ref, t.race, _wanted(t))


@query("flt_6_ref_exists", f"WITH {_WANTED} SELECT query_id FROM wanted AS w WHERE EXISTS (SELECT 1 FROM race_ref AS f WHERE f.datasource_name = w.datasource_name AND f.ref_id = w.ref_id)")
def _(t):
    return filters.ref_exists(t.race_ref, _wanted(t)).select("query_id")


@query(
    "flt_6_keyed_references",
    f"""WITH {_WANTED},
    found AS (SELECT w.query_id, count(DISTINCT r.id) AS n, min(r.id) AS race_id FROM wanted AS w LEFT JOIN race_ref AS f ON f.datasource_name = w.datasource_name AND f.ref_id = w.ref_id
      LEFT JOIN race AS r ON r.id = f.race_id AND (w.day IS NULL OR w.day = r.day) GROUP BY w.query_id)
    SELECT 'race' AS lookup, query_id, CASE WHEN n = 1 THEN race_id END AS race_id FROM found
    UNION ALL SELECT 'known', query_id, NULL FROM wanted AS w WHERE EXISTS (SELECT 1 FROM race_ref AS f WHERE f.datasource_name = w.datasource_name AND f.ref_id = w.ref_id)
    UNION ALL SELECT 'new', pos, NULL FROM doc AS d WHERE NOT EXISTS (SELECT 1 FROM race_ref AS f WHERE f.datasource_name = d.datasource AND f.ref_id = d.ref_id)""",
)
def _(t):
    # Three lookups in one bucketed table, which none of them shuffles.
    refs, none = keyed(t.race_ref, ["datasource_name", "ref_id"], buckets=16), F.lit(None).cast("long").alias("race_id")
    found = filters.race_by_ref(refs, t.race, _wanted(t)).select(F.lit("race").alias("lookup"), "query_id", "race_id")
    known = filters.ref_exists(refs, _wanted(t)).select(F.lit("known").alias("lookup"), "query_id", none)
    new = drop_known(t.doc, refs).select(F.lit("new").alias("lookup"), F.col("pos").alias("query_id"), none)
    return found.unionByName(known).unionByName(new)


@query("flt_7_active", "SELECT id, name FROM club WHERE is_active")
def _(t):
    return filters.active(t.club).select("id", "name")


_Q = "q AS (SELECT pos AS query_id, date, day, CASE WHEN pos % 9 = 0 THEN NULL ELSE gender END AS gender, CASE WHEN pos % 13 = 0 THEN NULL ELSE category END AS category, trophy_id, flag_id, CASE WHEN pos % 5 = 0 THEN NULL ELSE CAST(substring(league, 6, 1) AS INT) END AS league_id FROM doc)"


def _q(t):
    none = lambda n, c: F.when(F.col("pos") % n != 0, F.col(c)).alias(c)
    league = F.when(F.col("pos") % 5 != 0, F.substring("league", 6, 1).cast("int")).alias("league_id")
    return t.doc.select(F.col("pos").alias("query_id"), "date", "day", none(9, "gender"), none(13, "category"), "trophy_id", "flag_id", league)


@query(
    "flt_8_races_by_competition",
    """WITH q AS (SELECT DISTINCT o_custkey % 40 AS flag_id FROM orders WHERE o_custkey % 3 <> 0)
    SELECT q.flag_id AS query_id, race.id AS race_id FROM q JOIN race ON race.flag_id = q.flag_id AND race.trophy_id IS NULL AND race.league_id IS NULL""",
)
def _(t):
    none = F.lit(None).cast("long")
    return filters.races_by_competition(t.race, t.flag.select(F.col("id").alias("query_id"), F.col("id").alias("flag_id"), none.alias("trophy_id"), none.alias("league_id")))


_CLOSEST = """SELECT q.query_id, CASE WHEN count(r.id) = 1 THEN min(r.id) END AS race_id,
  CASE count(r.id) WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status
  FROM {q} AS q LEFT JOIN race AS r ON r.date = q.date AND r.day = q.day
    AND (q.gender IS NULL OR (r.gender IN (q.gender, 'ALL') AND r.category IN (coalesce(q.category, 'ALL'), 'ALL')))
    AND (q.trophy_id IS NULL OR r.trophy_id = q.trophy_id) AND (q.flag_id IS NULL OR r.flag_id = q.flag_id) AND (q.league_id IS NULL OR r.league_id = q.league_id)
  GROUP BY q.query_id"""


@query("flt_9_closest_match", f"WITH {_Q} {_CLOSEST.format(q='q')}")
def _(t):
    return filters.closest_match(t.race, _q(t))


@query(
    "flt_10_closest_match_by_name",
    f"""WITH {_Q}, one AS ({_CLOSEST.format(q='q')}),
    again AS (SELECT query_id, date, day, NULL AS gender, NULL AS category, trophy_id, flag_id, league_id FROM q WHERE query_id IN (SELECT query_id FROM one WHERE status = 'none'))
    SELECT * FROM one WHERE status <> 'none' UNION ALL ({_CLOSEST.format(q='again')})""",
)
def _(t):
    return filters.closest_match_by_name(t.race, _q(t))


@query(
    "flt_11_matching_race",
    f"""WITH {_Q} SELECT q.query_id, CASE WHEN count(r.id) = 1 THEN min(r.id) END AS race_id,
      CASE count(r.id) WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status
    FROM q LEFT JOIN race AS r ON r.date = q.date AND r.day = q.day AND r.gender = q.gender AND r.category = q.category
      AND r.trophy_id IS NOT DISTINCT FROM q.trophy_id AND r.flag_id IS NOT DISTINCT FROM q.flag_id AND r.league_id IS NOT DISTINCT FROM q.league_id
    GROUP BY q.query_id""",
)
def _(t):
    return filters.matching_race(t.race, _q(t))


#: The races, some of them with a trophy and a flag, and some without an edition.
_PAIRED = """x AS (SELECT id, date, yr, day, league_id, CASE WHEN id % 9 = 0 THEN coalesce(trophy_id, id % 11) ELSE trophy_id END AS trophy_id, CASE WHEN id % 9 = 0 THEN coalesce(flag_id, id % 40) ELSE flag_id END AS flag_id,
    CASE WHEN id % 23 <> 0 THEN coalesce(trophy_edition, CASE WHEN id % 9 = 0 THEN flag_edition END) END AS trophy_edition, CASE WHEN id % 29 <> 0 THEN coalesce(flag_edition, CASE WHEN id % 9 = 0 THEN trophy_edition END) END AS flag_edition FROM race)"""


def _paired(t):
    ninth = lambda value: F.when(F.col("id") % 9 == 0, value)
    return t.race.select(
        "id", "date", "day", "league_id", F.coalesce("trophy_id", ninth(F.col("id") % 11)).alias("trophy_id"), F.coalesce("flag_id", ninth(F.col("id") % 40)).alias("flag_id"),
        F.when(F.col("id") % 23 != 0, F.coalesce("trophy_edition", ninth(F.col("flag_edition")))).alias("trophy_edition"),
        F.when(F.col("id") % 29 != 0, F.coalesce("flag_edition", ninth(F.col("trophy_edition")))).alias("flag_edition"),
    )


@query(
    "flt_12_analogous_race",
    f"""WITH {_PAIRED} SELECT a.id AS query_id, CASE WHEN count(*) = 1 THEN min(b.id) END AS race_id, CASE WHEN count(*) = 1 THEN 'unique' ELSE 'ambiguous' END AS status
    FROM x AS a LEFT JOIN trophy AS p ON p.id = a.trophy_id JOIN x AS b ON a.yr = b.yr AND b.day = CASE WHEN a.day = 2 THEN 1 ELSE 2 END
      AND (a.trophy_id IS NULL OR (a.trophy_id = b.trophy_id AND a.trophy_edition IS NOT DISTINCT FROM b.trophy_edition))
      AND (a.flag_id IS NULL OR (a.flag_id = b.flag_id AND a.flag_edition IS NOT DISTINCT FROM b.flag_edition))
      AND CASE WHEN a.league_id IS NULL THEN true WHEN coalesce(p.name ILIKE '%PLAY%OFF%', false) THEN b.league_id IS NULL ELSE coalesce(a.league_id = b.league_id, false) END
    GROUP BY a.id""",
)
def _(t):
    return filters.analogous_race(_paired(t), t.trophy)


_SPEED_FILTER = """SELECT p.id AS participant_id FROM participant AS p JOIN race AS r ON r.id = p.race_id
  WHERE NOT r.cancelled AND r.day = 1 AND len(p.laps_ms) > 0 AND NOT p.retired AND NOT p.guest AND NOT p.absent AND p.laps_ms[-1] > 0
    AND p.id NOT IN (SELECT participant_id FROM penalty WHERE disqualification)
    AND p.gender = 'MALE' AND p.category = 'ABSOLUT' AND {race} AND {names}"""
_NO_B = "len(list_filter(p.club_names, lambda n: n LIKE '% B')) = 0"


@query("flt_13_speed_filter", _SPEED_FILTER.format(race="r.gender IN ('MALE', 'ALL') AND r.category IN ('ABSOLUT', 'ALL')", names=_NO_B))
def _(t):
    return speeds.speed_filter(t.participant, t.race, t.penalty).select(F.col("id").alias("participant_id"))


@query("flt_13_speed_filter_league", _SPEED_FILTER.format(race="r.gender = 'MALE' AND r.category = 'ABSOLUT' AND r.league_id = 1", names="true"))
def _(t):
    return speeds.speed_filter(t.participant, t.race, t.penalty, league=1).select(F.col("id").alias("participant_id"))


@query("flt_13_speed_filter_branches", _SPEED_FILTER.format(race="r.gender IN ('MALE', 'ALL') AND r.category IN ('ABSOLUT', 'ALL')", names=_NO_B.replace("= 0", "> 0")))
def _(t):
    return speeds.speed_filter(t.participant, t.race, t.penalty, branch_teams=True).select(F.col("id").alias("participant_id"))


@query(
    "flt_14_participant_by",
    """WITH w AS (SELECT p.id AS query_id, p.race_id, p.club_id, p.gender, p.category, CASE WHEN p.id % 3 = 0 THEN NULL ELSE p.branch END AS branch,
      CASE WHEN p.id % 2 = 0 THEN 'X B' WHEN p.id % 7 <> 0 THEN 'X' END AS raw_name, r.league_id IS NOT NULL AS has_league FROM participant AS p JOIN race AS r ON r.id = p.race_id),
    m AS (SELECT w.query_id, w.raw_name, w.has_league, p.id, p.branch, count(*) OVER (PARTITION BY w.query_id) AS n FROM w JOIN participant AS p
      ON p.race_id = w.race_id AND p.club_id = w.club_id AND p.gender = w.gender AND p.category = w.category AND p.branch IS NOT DISTINCT FROM w.branch),
    k AS (SELECT query_id, id FROM m WHERE n = 1 OR has_league OR raw_name IS NULL OR branch IS NOT DISTINCT FROM CASE WHEN raw_name = 'X B' THEN 'B' END)
    SELECT w.query_id, CASE WHEN count(k.id) = 1 THEN min(k.id) END AS participant_id,
      CASE count(k.id) WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM w LEFT JOIN k USING (query_id) GROUP BY w.query_id""",
)
def _(t):
    p = t.participant.join(t.race.select(F.col("id").alias("race_id"), "league_id"), "race_id")
    queries = p.select(
        F.col("id").alias("query_id"), "race_id", "club_id", "gender", "category", F.when(F.col("id") % 3 != 0, F.col("branch")).alias("branch"),
        F.when(F.col("id") % 2 == 0, "X B").when(F.col("id") % 7 != 0, "X").alias("raw_name"), F.col("league_id").isNotNull().alias("has_league"),
    )
    return filters.participant_by(t.participant, queries)


#: Of the flags, one in three has not raced in 1998.
@query(
    "flt_15_stale_flags",
    """SELECT f.id, m.ref_id FROM flag AS f JOIN flag_ref AS m ON m.flag_id = f.id
    WHERE (last_checked <= DATE '1998-03-01' OR last_checked IS NULL) AND f.id NOT IN (SELECT flag_id FROM race WHERE flag_id % 3 <> 0 AND yr = 1998)""",
)
def _(t):
    raced = t.race.filter("yr <> 1998 or flag_id % 3 <> 0")
    return filters.stale_flags(t.flag_with_metadata, raced, "traineras", "1998-04-01", only_new=True)


@query(
    "flt_16_races_missing_participant_metadata",
    """SELECT race_id, ref_id FROM race_ref WHERE datasource_name = 'act' AND race_id IN
    (SELECT race_id FROM participant WHERE lane IS NOT NULL AND lane < 3 AND NOT absent AND NOT retired)""",
)
def _(t):
    boats = t.participant.withColumn("has_metadata", F.coalesce(F.col("lane") >= 3, F.lit(True)))
    return filters.races_missing_participant_metadata(t.race, boats, t.race_ref, "act")


@query("flt_17_mixed_races_by_flag", "SELECT flag_id, r.id AS race_id, ref_id FROM race AS r JOIN race_ref AS f ON f.race_id = r.id WHERE gender = 'ALL' AND flag_id IS NOT NULL AND ref_id IN ('19', '39', '119', '4009', '1516')")
def _(t):
    return filters.mixed_races_by_flag(t.race, t.flag_with_metadata, t.race_ref, "traineras", ["19", "39", "119", "4009", "1516"])


@query("flt_18_unverified_flags", "SELECT f.id, ref_id FROM flag AS f JOIN flag_ref AS m ON m.flag_id = f.id WHERE NOT verified AND f.id > 0 AND ref_name IS NULL")
def _(t):
    return filters.unverified_flags_without_ref_name(t.flag_with_metadata)


@query("flt_19_repeated_clubs", "SELECT race_id, count(DISTINCT club_id) AS clubs, count(*) AS boats FROM participant GROUP BY race_id HAVING count(DISTINCT club_id) <> count(*)")
def _(t):
    return filters.races_with_repeated_clubs(t.participant)


@query("flt_20_not_playoff", "SELECT id FROM race WHERE id NOT IN (SELECT r.id FROM race AS r JOIN trophy ON trophy.id = r.trophy_id WHERE upper(name) LIKE '%PLAY%')")
def _(t):
    return filters.not_playoff(t.race, t.trophy).select("id")


@query("flt_20_not_playoff_date", "SELECT id FROM race WHERE date NOT IN (SELECT r.date FROM race AS r JOIN trophy ON trophy.id = r.trophy_id WHERE upper(name) LIKE '%PLAY%')")
def _(t):
    return filters.not_playoff(t.race, t.trophy, by_date=True).select("id")


@query(
    "srt_1_sort_races",
    """SELECT id, row_number() OVER (ORDER BY coalesce(trophy.name, flag.name) DESC NULLS FIRST, id) AS position FROM (SELECT id, trophy_id, flag_id FROM race) AS race
    LEFT JOIN (SELECT id AS tid, name FROM trophy) AS trophy ON tid = trophy_id LEFT JOIN (SELECT id AS fid, name FROM flag) AS flag ON fid = flag_id""",
)
def _(t):
    named = sorting.sort_races(t.race, "-name", t.trophy, t.flag)
    return sorting.numbered_whole(named.select("id", "sort_name"), sorting.race_order("-name")).select("id", "position")


@query("srt_2_default_order", "SELECT id, date, row_number() OVER (ORDER BY date NULLS LAST, id) AS position FROM race")
def _(t):
    return sorting.numbered_whole(t.race.select("id", "date"), [sorting.directed(F.col(c), False) for c in sorting.DEFAULT["race"]])


@query("srt_3_audit_order", "SELECT id, race_id, row_number() OVER (ORDER BY race_id DESC NULLS FIRST, id) AS position FROM participant")
def _(t):
    return sorting.numbered_whole(t.participant.select("id", "race_id"), [sorting.directed(F.col("race_id"), True), F.col("id")])


@query(
    "srt_4_top_speed",
    "SELECT race_id, id AS participant_id FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY distance / (laps_ms[-1] / 1000.0::DOUBLE) * 3.6::DOUBLE DESC NULLS LAST, id) AS k FROM participant) WHERE k = 1",
)
def _(t):
    return sorting.first_per_group(t.participant, ["race_id"], [speeds.speed_of().desc_nulls_last(), F.col("id")]).select("race_id", F.col("id").alias("participant_id"))
