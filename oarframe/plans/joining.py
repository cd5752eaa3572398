"""One query for each join shape (JOIN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.laps import clock, last_lap
from ..operators import joins
from .audits import PLAY
from .registry import query


@query("join_1_inner", "SELECT p.id, p.race_id, r.date FROM participant AS p JOIN race AS r ON r.id = p.race_id")
def _(t):
    return t.participant.select("id", "race_id").join(t.race.select(F.col("id").alias("race_id"), "date"), "race_id")


@query("join_2_anti", "SELECT id FROM participant AS p WHERE NOT EXISTS (SELECT 1 FROM penalty AS x WHERE x.participant_id = p.id AND x.disqualification)")
def _(t):
    return t.participant.select("id").join(t.penalty.filter("disqualification").select(F.col("participant_id").alias("id")), "id", "left_anti")


@query("join_3_not_in", f"SELECT id FROM race WHERE league_id NOT IN (1, 3) AND id NOT IN {PLAY.format('id')}")
def _(t):
    from ..operators.filters import not_playoff

    return not_playoff(t.race, t.trophy).filter(~F.col("league_id").isin(1, 3)).select("id")


@query("join_4_exists_same_clock", "SELECT id FROM participant AS p WHERE EXISTS (SELECT 1 FROM participant AS q WHERE q.race_id = p.race_id AND q.id <> p.id AND q.laps_ms[1] // 1000 = p.laps_ms[1] // 1000)")
def _(t):
    second = F.substring(clock(F.try_element_at("laps_ms", F.lit(1))), 1, 5)
    timed = t.participant.select("id", "race_id", second.alias("shown")).filter("shown is not null")
    other = timed.select(F.col("id").alias("other_id"), F.col("race_id").alias("other_race"), F.col("shown").alias("other_shown"))
    return timed.join(other, (F.col("race_id") == F.col("other_race")) & (F.col("shown") == F.col("other_shown")) & (F.col("id") != F.col("other_id")), "left_semi").select("id")


@query(
    "join_5_array_keys",
    """WITH a AS (SELECT race_id, count(*) AS n, list(club_id ORDER BY club_id) AS k, list(laps_ms[-1] ORDER BY laps_ms[-1] NULLS FIRST) AS times FROM participant GROUP BY race_id)
    SELECT a.race_id AS id, b.race_id AS other_id FROM a JOIN a AS b ON a.n = b.n AND a.k = b.k AND a.times = b.times AND a.race_id <> b.race_id""",
)
def _(t):
    # Absent times stand first in both lists, since collect_list leaves nulls out.
    time = F.coalesce(last_lap(F.col("laps_ms")), F.lit(-1).cast("long"))
    a = t.participant.groupBy("race_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("club_id")).alias("k"), F.sort_array(F.collect_list(time)).alias("times"))
    return a.join(a.withColumnRenamed("race_id", "other_id"), ["n", "k", "times"]).filter("race_id <> other_id").select(F.col("race_id").alias("id"), "other_id")


@query("join_6_left_then_not_null", "SELECT r.id, trophy.name FROM race AS r LEFT JOIN trophy ON trophy.id = r.trophy_id WHERE trophy.name IS NOT NULL")
def _(t):
    trophies = t.trophy.select(F.col("id").alias("trophy_id"), "name")
    return t.race.join(trophies, "trophy_id", "left").filter("name is not null").select("id", "name")


@query("join_7_scalar_subquery", "SELECT id, (SELECT count(*) FROM participant AS p WHERE p.race_id = r.id AND NOT p.guest) AS boats FROM race AS r")
def _(t):
    n = t.participant.filter("not guest").groupBy(F.col("race_id").alias("id")).agg(F.count("*").alias("n"))
    return t.race.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("boats"))


@query("join_8_null_safe_groups", "SELECT a.id, (SELECT count(*) FROM race AS b WHERE b.place_id IS NOT DISTINCT FROM a.place_id AND b.league_id IS NOT DISTINCT FROM a.league_id AND b.trophy_id IS NOT DISTINCT FROM a.trophy_id AND b.flag_id IS NOT DISTINCT FROM a.flag_id) AS n FROM race AS a")
def _(t):
    keys = ["place_id", "league_id", "trophy_id", "flag_id"]
    n = t.race.groupBy(*keys).agg(F.count("*").alias("n")).select(*[F.col(k).alias(f"g_{k}") for k in keys], "n")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"g_{k}"))
    return t.race.join(n, same).select("id", "n")


@query("join_9_not_exists_in_year", "SELECT id FROM flag WHERE NOT EXISTS (SELECT 1 FROM race WHERE race.flag_id = flag.id AND yr = 2001 AND cancelled)")
def _(t):
    return joins.races_in_year(t.flag, t.race.filter("cancelled"), 2001, raced=False).select("id")


@query("join_10_in_subquery", "SELECT id FROM flag WHERE id IN (SELECT flag_id FROM race WHERE yr = 1996)")
def _(t):
    return joins.races_in_year(t.flag, t.race, 1996, raced=True).select("id")


@query(
    "join_11_race_view",
    """SELECT r.id, tr.name AS trophy, fl.name AS flag, le.symbol AS league, pl.name AS place, tw.name AS town, tw.province FROM race AS r LEFT JOIN trophy AS tr ON tr.id = trophy_id LEFT JOIN flag AS fl ON fl.id = flag_id
    LEFT JOIN league AS le ON le.id = league_id LEFT JOIN place AS pl ON pl.id = place_id LEFT JOIN town AS tw ON tw.id = pl.town_id""",
)
def _(t):
    view = joins.race_view(t.race, t.trophy, t.flag, t.league, t.place, t.town)
    return view.select("id", F.col("trophy.name").alias("trophy"), F.col("flag.name").alias("flag"), F.col("league.symbol").alias("league"), F.col("place.name").alias("place"), F.col("place.town.name").alias("town"), F.col("place.town.province").alias("province"))


@query(
    "join_12_nest_children",
    """SELECT r.id, count(p.id) AS boats, count(x.n) AS fined, coalesce(sum(x.n), 0)::BIGINT AS penalties, coalesce(array_to_string(list(p.id ORDER BY p.id) FILTER (p.id IS NOT NULL), ','), '') AS ids
    FROM race AS r LEFT JOIN participant AS p ON p.race_id = r.id LEFT JOIN (SELECT participant_id, count(*) AS n FROM penalty GROUP BY ALL) AS x ON x.participant_id = p.id GROUP BY r.id""",
)
def _(t):
    nested = joins.nest_children(t.race, t.participant, t.penalty)
    sizes = F.transform("participants", lambda p: F.size(p["penalties"]))
    return nested.select(
        "id", F.size("participants").cast("long").alias("boats"), F.size(F.filter(sizes, lambda n: n > 0)).cast("long").alias("fined"),
        F.aggregate(sizes, F.lit(0), lambda a, b: a + b).cast("long").alias("penalties"), F.array_join(F.transform("participants", lambda p: p["id"]), ",").alias("ids"),
    )


@query(
    "join_13_link_days",
    """WITH p AS (SELECT a.id AS x, b.id AS y FROM race AS a JOIN race AS b ON a.day = 1 AND b.day = 2 AND a.yr = b.yr AND a.flag_id = b.flag_id AND a.flag_edition = b.flag_edition AND a.league_id = b.league_id
      AND (a.trophy_id IS NULL OR a.trophy_id = b.trophy_id) AND (a.trophy_edition IS NULL OR a.trophy_edition = b.trophy_edition))
    SELECT x AS id, y AS associated_id FROM p UNION ALL SELECT y, x FROM p""",
)
def _(t):
    return joins.link_days(t.race)


_TIMES = "d AS (SELECT id AS doc_id, race_id, laps_ms[-1] // 60000 AS time FROM participant WHERE len(laps_ms) > 0 AND id % 3 = 0), m AS (SELECT id, race_id, laps_ms[-1] // 60000 AS time, category FROM participant WHERE len(laps_ms) > 0)"


@query("join_14_match_by_time", f"WITH {_TIMES.replace(' AND id % 3 = 0', '')} SELECT DISTINCT ON (doc_id) doc_id, id AS participant_id FROM d JOIN m USING (race_id, time) ORDER BY doc_id, category <> 'SCHOOL', id")
def _(t):
    minute = F.floor(last_lap(F.col("laps_ms")) / 60000)
    timed = t.participant.filter(F.size("laps_ms") > 0)
    return joins.match_by_time(timed.select(F.col("id").alias("doc_id"), "race_id", minute.alias("time")), timed.withColumn("laps_ms", F.array(minute)))


@query(
    "join_15_pair_in_order",
    """WITH a AS (SELECT id, race_id, club_id % 5 AS c, branch, row_number() OVER (PARTITION BY race_id, club_id % 5, branch ORDER BY id) AS k FROM participant WHERE lane <= 3),
    b AS (SELECT id AS other_id, race_id, club_id % 5 AS c, branch, row_number() OVER (PARTITION BY race_id, club_id % 5, branch ORDER BY id) AS k FROM participant WHERE lane > 3)
    SELECT id, other_id FROM a JOIN b ON a.race_id = b.race_id AND a.c = b.c AND a.k = b.k AND a.branch IS NOT DISTINCT FROM b.branch""",
)
def _(t):
    p = t.participant.withColumn("c", F.col("club_id") % 5)
    return joins.pair_in_order(p.filter("lane <= 3"), p.filter("lane > 3").withColumnRenamed("id", "other_id"), ["race_id", "c", "branch"], "id", "other_id")


@query(
    "join_15_match_participants",
    """WITH RECURSIVE p AS (SELECT id, race_id, club_id % 5 AS c, lane, branch FROM participant),
    rows AS (SELECT race_id, c, list((id, branch) ORDER BY id) AS wanting FROM p WHERE lane <= 3 GROUP BY race_id, c),
    docs AS (SELECT race_id, c, list((id, branch) ORDER BY id DESC) AS offered FROM p WHERE lane > 3 GROUP BY race_id, c),
    step AS (
      SELECT race_id, c, wanting, offered, 0 AS i, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS doc_id FROM rows JOIN docs USING (race_id, c)
      UNION ALL
      SELECT race_id, c, wanting, list_filter(offered, lambda d: taken IS NULL OR d[1] <> taken), i + 1, wanting[i + 1][1], taken
      FROM (SELECT *, list_filter(offered, lambda d: wanting[i + 1][2] IS NULL OR coalesce(d[2] = wanting[i + 1][2], false))[1][1] AS taken FROM step WHERE i < len(wanting)))
    SELECT id, doc_id FROM step WHERE doc_id IS NOT NULL""",
)
def _(t):
    p = t.participant.select("id", "race_id", (F.col("club_id") % 5).alias("club_id"), F.lit("MALE").alias("gender"), F.lit("ABSOLUT").alias("category"), "branch", "lane")
    docs = p.filter("lane > 3").withColumnRenamed("branch", "letter").withColumn("doc_id", F.col("id")).withColumn("pos", -F.col("id"))
    return joins.match_participants(p.filter("lane <= 3"), docs)


@query("join_16_partnerships", "SELECT c.id, c.is_partnership OR EXISTS (SELECT 1 FROM club AS f WHERE f.fused_into = c.id) AS is_partnership, (SELECT count(*) FROM club AS f WHERE f.fused_into = c.id) AS parts FROM club AS c")
def _(t):
    parts = joins.partnership_edges(t.club).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"))
    return joins.mark_partnerships(t.club).join(parts, "id", "left").select("id", "is_partnership", F.coalesce("n", F.lit(0)).alias("parts"))


_PARTS = "SELECT q, w FROM (SELECT q, unnest(string_split(q, ' ')) AS w FROM query_name) WHERE w <> ''"


@query("join_17_substring_pairs", f"WITH x AS ({_PARTS}) SELECT DISTINCT q AS query_id, w AS part, e.id AS entity_id FROM x JOIN entity AS e ON contains(upper(e.name), w)")
def _(t):
    parts = t.query_name.select(F.col("q").alias("query_id"), F.explode(F.split("q", " ")).alias("part")).filter("part <> ''")
    return joins.substring_pairs(parts, t.entity.select(F.col("id").alias("entity_id"), F.upper("name").alias("text"))).select("query_id", "part", "entity_id")


@query("join_18_containing_tokens", "WITH x AS (SELECT id, string_split(lower(name), ' ') AS w FROM entity) SELECT a.id AS query_id, b.id AS item_id FROM x AS a JOIN x AS b ON list_has_all(b.w, a.w[1:1])")
def _(t):
    words = F.split(F.lower("name"), " ")
    return joins.containing_tokens(t.entity.select(F.col("id").alias("query_id"), F.slice(words, 1, 1).alias("tokens")), t.entity.select(F.col("id").alias("item_id"), words.alias("tokens")))
