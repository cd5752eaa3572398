"""Queries of the aggregations (AGG), windows (WIN) and set operations (SET)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rollups, speeds
from .registry import query

BOATS = """boats AS (SELECT p.id, p.race_id, r.date, r.yr AS year, p.distance / (p.laps_ms[-1] / 1000.0::DOUBLE) * 3.6::DOUBLE AS speed
  FROM participant AS p JOIN race AS r ON r.id = p.race_id
  WHERE NOT r.cancelled AND r.day = 1 AND len(p.laps_ms) > 0 AND NOT p.retired AND NOT p.guest AND NOT p.absent AND p.laps_ms[-1] > 0
    AND NOT EXISTS (SELECT 1 FROM penalty AS x WHERE x.disqualification AND x.participant_id = p.id)
    AND p.gender = 'MALE' AND p.category = 'ABSOLUT' AND r.gender IN ('MALE', 'ALL') AND r.category IN ('ABSOLUT', 'ALL')
    AND len(list_filter(p.club_names, lambda n: n LIKE '% B')) = 0)"""
BAND = """band AS (SELECT * FROM boats WHERE round(speed, 9) BETWEEN (SELECT round(avg(speed) - 2 * stddev_pop(speed), 9) FROM boats) AND (SELECT round(avg(speed) + 2 * stddev_pop(speed), 9) FROM boats))"""


def _boats(t):
    return speeds.speed_filter(t.participant, t.race, t.penalty)


def _flat(df):
    """Years with their speeds by position, as plain rows."""
    return df.select("year", F.posexplode("speeds").alias("position", "speed")).select("year", "position", F.round("speed", 6).alias("speed"))


_FLAT = "SELECT year, CAST(row_number() OVER (PARTITION BY year ORDER BY date, speed DESC NULLS FIRST) - 1 AS INT) AS position, round(speed, 6) AS speed FROM {}"


@query("agg_1_year_speeds", f"WITH {BOATS} {_FLAT.format('boats')}")
def _(t):
    return _flat(speeds.year_speeds(_boats(t)))


@query("agg_1_year_speeds_normalized", f"WITH {BOATS}, {BAND} {_FLAT.format('band')}")
def _(t):
    return _flat(speeds.year_speeds(_boats(t), normalize=True))


def _by_place(name: str, rows: str, **options) -> None:
    @query(name, f"WITH {BOATS}, {BAND} {_FLAT.format(rows)}")
    def _(t):
        return speeds.year_speeds_by_place(_boats(t), **options).withColumn("speed", F.round("speed", 6))


_by_place("agg_1_year_speeds_by_place", "boats")
_by_place("agg_1_year_speeds_by_place_normalized", "band", normalize=True)


_NTH = "SELECT race_id, round(speed, 6) AS speed FROM (SELECT race_id, speed, row_number() OVER (PARTITION BY race_id ORDER BY speed DESC NULLS FIRST) AS k FROM {}) WHERE k = 2"


@query("agg_2_nth_speed", f"WITH {BOATS} {_NTH.format('boats')}")
def _(t):
    return speeds.nth_speed(_boats(t), 2).select("race_id", F.round("speed", 6).alias("speed"))


@query("agg_2_nth_speed_normalized", f"WITH {BOATS}, {BAND} {_NTH.format('band')}")
def _(t):
    return speeds.nth_speed(_boats(t), 2, normalize=True).select("race_id", F.round("speed", 6).alias("speed"))


@query("agg_3_sigma_band", f"WITH {BOATS}, {BAND} SELECT id, race_id FROM band")
def _(t):
    return speeds.sigma_band(_boats(t).withColumn("speed", speeds.speed_of()), "speed").select("id", "race_id")


@query("agg_4_distinct_lanes", "SELECT race_id, count(DISTINCT lane) AS lanes FROM participant GROUP BY race_id")
def _(t):
    return rollups.distinct_lanes(t.participant)


@query("agg_5_largest_fields", "SELECT league_id, gender, yr AS year, max(n) AS largest FROM (SELECT race_id, count(*) AS n FROM participant WHERE NOT guest GROUP BY race_id) JOIN race ON id = race_id WHERE NOT cancelled GROUP BY ALL")
def _(t):
    return rollups.largest_fields(t.participant.filter("not guest"), t.race)


@query("agg_6_race_arrays", "SELECT race_id, list(club_id ORDER BY club_id, laps_ms[-1] NULLS FIRST)::VARCHAR AS clubs, array_to_string(list(coalesce(laps_ms[-1]::VARCHAR, '-') ORDER BY club_id, laps_ms[-1] NULLS FIRST), ',') AS times FROM participant GROUP BY race_id")
def _(t):
    text = F.array_join(F.transform("times", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")
    return rollups.race_arrays(t.participant).select("race_id", F.col("clubs").cast("string").alias("clubs"), text.alias("times"))


@query("agg_7_matching_ids", "SELECT date, array_to_string(list(id ORDER BY id), ',') AS ids FROM race GROUP BY date HAVING count(*) > 1")
def _(t):
    ids = F.sort_array(F.collect_list("id"))
    return t.race.groupBy("date").agg(ids.alias("i")).filter(F.size("i") > 1).select("date", F.array_join("i", ",").alias("ids"))


@query("agg_8_having_boats", f"WITH {BOATS} SELECT race_id, count(*) AS boats FROM boats GROUP BY race_id HAVING count(*) >= 3")
def _(t):
    return _boats(t).groupBy("race_id").agg(F.count("*").alias("boats")).filter("boats >= 3")


@query(
    "agg_9_unanimous",
    "SELECT flag_id, yr, CASE WHEN count(*) = 1 OR (count(DISTINCT flag_edition) = 1 AND count(flag_edition) = count(*)) THEN max(flag_edition) END AS edition FROM race WHERE flag_id IS NOT NULL GROUP BY flag_id, yr",
)
def _(t):
    return t.race.filter("flag_id is not null").groupBy("flag_id", "yr").agg(rollups.unanimous("flag_edition").alias("edition"))


@query("agg_10_single_distinct", "SELECT trophy_id, flag_id, league_id, CASE WHEN count(DISTINCT place_id) = 1 THEN max(place_id) END AS place_id FROM race GROUP BY trophy_id, flag_id, league_id")
def _(t):
    return t.race.groupBy("trophy_id", "flag_id", "league_id").agg(rollups.single_distinct("place_id").alias("place_id"))


_ROLLUP = """SELECT r.id, coalesce(l.{c}, CASE WHEN p.n IS NULL THEN {none} WHEN p.n = 1 OR p.k > 1 THEN 'ALL' ELSE p.v END) AS {c}
  FROM race AS r LEFT JOIN league AS l ON l.id = r.league_id
  LEFT JOIN (SELECT race_id, count(*) AS n, count(DISTINCT {c}) AS k, max({c}) AS v FROM participant GROUP BY race_id) AS p ON p.race_id = r.id"""


@query("agg_11_rollup_gender", _ROLLUP.format(c="gender", none="NULL"))
def _(t):
    return rollups.rollup_race_gender(t.race, t.participant, t.league)


@query("agg_12_rollup_category", _ROLLUP.format(c="category", none="'ALL'"))
def _(t):
    return rollups.rollup_race_category(t.race, t.participant, t.league)


@query("agg_13_union_names", "SELECT race_id, array_to_string(list(DISTINCT n ORDER BY n), ',') AS names FROM (SELECT race_id, unnest(club_names) AS n FROM participant) GROUP BY race_id")
def _(t):
    return rollups.union_names(t.participant, "race_id", "club_names").filter(F.size("names") > 0).select("race_id", F.array_join("names", ",").alias("names"))


@query("agg_14_participant_count_check", "SELECT r.id AS race_id, count(p.id) AS stored, r.id % 8 AS expected FROM race AS r LEFT JOIN participant AS p ON p.race_id = r.id GROUP BY r.id HAVING count(p.id) <> r.id % 8")
def _(t):
    return rollups.participant_count_check(t.participant, t.race.select(F.col("id").alias("race_id"), (F.col("id") % 8).alias("expected")))


@query("agg_15_flag_of_run", "SELECT date, max(flag_id) AS flag_id FROM race GROUP BY date HAVING count(DISTINCT flag_id) = 1")
def _(t):
    return rollups.flag_of_run(t.race, "date")


@query(
    "agg_15_attach_source",
    """WITH run AS (SELECT max(flag_id) AS flag_id, date::VARCHAR AS ref_id FROM race GROUP BY date HAVING count(DISTINCT flag_id) = 1), one AS (SELECT flag_id, min(ref_id) AS ref_id FROM run GROUP BY flag_id)
    SELECT f.id, (SELECT count(*) FROM flag_ref AS m WHERE m.flag_id = f.id) + CASE WHEN one.ref_id IS NULL THEN 0 ELSE 1 END AS refs, one.ref_id AS added FROM flag AS f LEFT JOIN one ON one.flag_id = f.id""",
)
def _(t):
    marked = rollups.attach_run_source(t.flag_with_metadata, t.race, "date", F.col("date").cast("string"), "run")
    added = F.element_at(F.filter("metadata", lambda m: m["datasource_name"] == "run"), 1)["ref_id"]
    return marked.select("id", F.size("metadata").cast("long").alias("refs"), F.when(F.exists("metadata", lambda m: m["datasource_name"] == "run"), added).alias("added"))


@query("win_1_group_rank", "SELECT race_id, club_id, n, row_number() OVER (PARTITION BY race_id ORDER BY n DESC, club_id) AS place FROM (SELECT race_id, club_id, count(*) AS n FROM participant GROUP BY race_id, club_id)")
def _(t):
    counts = t.participant.groupBy("race_id", "club_id").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("race_id").orderBy(F.col("n").desc(), "club_id")).cast("long"))


@query(
    "win_2_fold_consecutive",
    """WITH m AS (SELECT pos, datasource, date > DATE '1998-06-30' AS future, name || CAST(pos // 40 AS VARCHAR) AS name, ref_id, gender, laps AS boats FROM (SELECT * REPLACE (left(name, 8) AS name) FROM doc)),
    s AS (SELECT *, coalesce(lag(name) OVER w <> name OR lag(future) OVER w, true) AS starts FROM m WINDOW w AS (PARTITION BY datasource ORDER BY pos)),
    i AS (SELECT *, sum(starts::INT) OVER (PARTITION BY datasource ORDER BY pos) AS island FROM s)
    SELECT datasource, min(name) AS name, min(pos) AS first, array_to_string(list(ref_id ORDER BY pos), ',') AS ref_ids, CAST(sum(boats) AS BIGINT) AS boats,
      CASE WHEN count(DISTINCT gender) > 1 THEN 'ALL' ELSE max(gender) END AS gender
    FROM i WHERE NOT future GROUP BY datasource, island""",
)
def _(t):
    name = F.concat(F.substring("name", 1, 8), F.floor(F.col("pos") / 40).cast("string"))
    docs = t.doc.withColumn("name", name).withColumn("boats", F.col("laps"))
    return rollups.fold_consecutive(docs, "datasource", "pos", "1998-06-30").withColumn("ref_ids", F.array_join("ref_ids", ","))


@query("win_3_distinct_in_group", "SELECT a.id, (SELECT count(DISTINCT b.laps) FROM race AS b WHERE b.flag_id IS NOT DISTINCT FROM a.flag_id AND b.place_id IS NOT DISTINCT FROM a.place_id) AS kinds FROM race AS a")
def _(t):
    return rollups.distinct_in_group(t.race, "laps", ["flag_id", "place_id"], "kinds").select("id", F.col("kinds").cast("long").alias("kinds"))


@query("win_4_best_candidate", "SELECT DISTINCT ON (club_id) club_id, id, laps_ms[1] AS score FROM participant WHERE len(laps_ms) > 0 ORDER BY club_id, laps_ms[1] DESC, id")
def _(t):
    scored = t.participant.filter(F.size("laps_ms") > 0).withColumn("score", F.element_at("laps_ms", 1))
    return rollups.best_candidate(scored, "club_id", "score", "id").select("club_id", "id", "score")


@query(
    "win_5_before_first_known",
    "SELECT flag_id, id FROM race AS r WHERE flag_id IS NOT NULL AND id % 50 <> 0 AND id > coalesce((SELECT max(k.id) FROM race AS k WHERE k.flag_id = r.flag_id AND k.id % 50 = 0), -1)",
)
def _(t):
    marked = t.race.filter("flag_id is not null").withColumn("known", F.col("id") % 50 == 0)
    return rollups.before_first_known(marked, "flag_id", "id", "known").select("flag_id", "id")


_EDITIONS = "e AS (SELECT flag_id AS item_id, yr AS year, max(flag_edition) AS edition FROM race WHERE flag_id IS NOT NULL AND flag_id % 3 <> yr % 3 GROUP BY flag_id, yr)"


@query(
    "win_6_neighbouring_years",
    f"WITH {_EDITIONS} SELECT *, (SELECT edition FROM e AS b WHERE b.item_id = e.item_id AND b.year = e.year - 1) AS before, (SELECT edition FROM e AS b WHERE b.item_id = e.item_id AND b.year = e.year + 1) AS after FROM e",
)
def _(t):
    rows = t.race.filter("flag_id is not null and flag_id % 3 <> yr % 3").groupBy(F.col("flag_id").alias("item_id"), F.col("yr").alias("year")).agg(F.max("flag_edition").alias("edition"))
    return rollups.neighbouring_years(rows)


@query("set_1_scan_years", "SELECT id FROM race WHERE yr = 1993 UNION ALL SELECT id FROM race WHERE yr = 1995 UNION ALL SELECT id FROM race WHERE yr = 1993")
def _(t):
    return rollups.scan_years(t.race, [1993, 1995, 1993]).select("id")


@query(
    "set_2_any_alternative",
    """WITH items AS (SELECT id AS item_id, string_split(lower(name), ' ') AS tokens FROM entity),
    q AS (SELECT id AS query_id, string_split(lower(name), ' ')[1:1] AS a, string_split(lower(name), ' ')[2:2] AS b FROM entity)
    SELECT query_id, item_id FROM q JOIN items ON list_has_all(tokens, a) OR list_has_all(tokens, b)""",
)
def _(t):
    words = F.split(F.lower("name"), " ")
    alternatives = F.array(F.slice(words, 1, 1), F.slice(words, 2, 1))
    return rollups.any_alternative(t.entity.select(F.col("id").alias("query_id"), alternatives.alias("alternatives")), t.entity.select(F.col("id").alias("item_id"), words.alias("tokens")))


@query(
    "set_3_merge_tables",
    """SELECT race_id, array_to_string(list_concat(coalesce(a, []), coalesce(b, [])), ',') AS clubs FROM
    (SELECT race_id, list(club_id ORDER BY club_id) AS a FROM participant WHERE lane <= 2 GROUP BY race_id)
    FULL JOIN (SELECT race_id, list(club_id ORDER BY club_id) AS b FROM participant WHERE lane > 2 GROUP BY race_id) USING (race_id)""",
)
def _(t):
    part = lambda test: t.participant.filter(test).groupBy("race_id").agg(F.sort_array(F.collect_list("club_id")).alias("clubs"))
    return rollups.merge_tables(part("lane <= 2"), part("lane > 2"), "race_id", "clubs").withColumn("clubs", F.array_join("clubs", ","))
