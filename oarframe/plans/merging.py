"""Queries of the merge operators (MRG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata
from ..operators import joins, merge
from .filtering import _CLOSEST, _Q, _q
from .registry import query

_EXACT = """r.date = u.date AND r.day = u.day AND r.gender = u.gender AND r.category = u.category
    AND r.trophy_id IS NOT DISTINCT FROM u.trophy_id AND r.flag_id IS NOT DISTINCT FROM u.flag_id AND r.league_id IS NOT DISTINCT FROM u.league_id"""
_OTHER_DAY = """b.yr = year(u.date) AND b.day = CASE WHEN u.day = 2 THEN 1 ELSE 2 END
    AND (u.trophy_id IS NULL OR (u.trophy_id = b.trophy_id AND u.trophy_edition IS NOT DISTINCT FROM b.trophy_edition)) AND (u.flag_id IS NULL OR (u.flag_id = b.flag_id AND u.flag_edition IS NOT DISTINCT FROM b.flag_edition))
    AND CASE WHEN u.league_id IS NULL THEN true WHEN coalesce(p.name ILIKE '%PLAY%OFF%', false) THEN b.league_id IS NULL ELSE coalesce(u.league_id = b.league_id, false) END"""
#: Four races in five are stored, so some documents are new.
_STORED = _CLOSEST.replace("race AS r", "stored AS r")
_PLAN = f"""{_Q.replace('FROM doc', ", CASE WHEN pos % 10 <> 0 THEN trophy_edition END AS trophy_edition, CASE WHEN pos % 10 <> 0 THEN flag_edition END AS flag_edition, CASE WHEN pos % 6 = 0 THEN trophy_id END AS hint_trophy_id, CASE pos % 6 WHEN 0 THEN flag_id WHEN 1 THEN (flag_id + 1) % 40 END AS hint_flag_id FROM doc")}, stored AS (SELECT * FROM race WHERE id % 5 <> 1),
  u AS (SELECT * FROM q WHERE (trophy_id IS NOT NULL AND coalesce(trophy_edition, 0) <> 0) OR (flag_id IS NOT NULL AND coalesce(flag_edition, 0) <> 0)),
  h AS (SELECT * REPLACE (hint_trophy_id AS trophy_id, hint_flag_id AS flag_id) FROM u WHERE hint_trophy_id IS NOT NULL OR hint_flag_id IS NOT NULL),
  hu AS (SELECT * FROM ({_STORED.format(q='h')}) WHERE status = 'unique'), rest AS (SELECT * FROM u WHERE query_id NOT IN (SELECT query_id FROM hu)),
  one AS ({_STORED.format(q='rest')}),
  again AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS gender, CAST(NULL AS VARCHAR) AS category) FROM rest WHERE query_id IN (SELECT query_id FROM one WHERE status = 'none')), two AS ({_STORED.format(q='again')}),
  f AS (SELECT * FROM hu UNION ALL SELECT * FROM one WHERE status <> 'none' UNION ALL SELECT * FROM two),
  e AS (SELECT u.query_id, count(r.id) AS n, min(r.id) AS race_id FROM u JOIN f ON f.query_id = u.query_id AND f.status = 'none' LEFT JOIN stored AS r ON {_EXACT} GROUP BY u.query_id),
  a AS (SELECT u.query_id, count(*) AS n, min(b.id) AS other_id FROM u LEFT JOIN trophy AS p ON p.id = u.trophy_id JOIN stored AS b ON {_OTHER_DAY} GROUP BY u.query_id),
  m AS (SELECT q.query_id, u.query_id IS NULL AS ignored, CASE WHEN f.status = 'none' AND e.n = 1 THEN e.race_id ELSE f.race_id END AS race_id,
    f.status = 'ambiguous' OR coalesce(e.n, 0) > 1 OR coalesce(a.n, 0) > 1 AS several, CASE WHEN a.n = 1 THEN a.other_id END AS other_id
    FROM q LEFT JOIN u USING (query_id) LEFT JOIN f USING (query_id) LEFT JOIN e USING (query_id) LEFT JOIN a USING (query_id)),
  s AS (SELECT *, CASE WHEN ignored THEN 'IGNORED' WHEN several THEN 'REVIEW' WHEN race_id IS NULL THEN 'NEW' ELSE {{found}} END AS status FROM m)
  SELECT query_id, CASE WHEN status = 'MERGED' THEN race_id END AS race_id, CASE status WHEN 'NEW' THEN coalesce(other_id, race_id) WHEN 'MERGED' THEN other_id END AS associated_id, status FROM s"""


def _plan_docs(t):
    numbered = t.doc.withColumn("query_id", F.col("pos"))
    known = lambda c: F.when(F.col("pos") % 10 != 0, F.col(c)).alias(c)
    hint_flag = F.when(F.col("pos") % 6 == 0, F.col("flag_id")).when(F.col("pos") % 6 == 1, (F.col("flag_id") + 1) % 40).alias("hint_flag_id")
    extra = numbered.select("query_id", known("trophy_edition"), known("flag_edition"), F.when(F.col("pos") % 6 == 0, F.col("trophy_id")).alias("hint_trophy_id"), hint_flag)
    return _q(t).join(extra, "query_id")


def _plan(name: str, policy: str, found: str) -> None:
    @query(name, f"WITH {_PLAN.format(found=found)}")
    def _(t):
        return merge.plan_races(_plan_docs(t), t.race.filter("id % 5 <> 1"), t.trophy, policy)


_plan("mrg_1_plan_races", "always", "'MERGED'")
_plan("mrg_1_plan_races_never", "never", "'NEW'")


@query(
    "mrg_2_merge_race",
    """SELECT r.id, CASE WHEN d.gender = r.gender THEN r.gender ELSE 'ALL' END AS gender, CASE WHEN d.category = r.category THEN r.category ELSE 'ALL' END AS category,
      CASE WHEN r.laps = 4 AND d.laps = 2 THEN r.laps ELSE d.laps END AS laps, coalesce(d.lanes, r.lanes) AS lanes, coalesce(d.sponsor, r.sponsor) AS sponsor, r.place_id,
      CASE WHEN d.name = 'TROFEO ' || r.trophy_id THEN d.name ELSE array_to_string(list_sort([d.name, 'TROFEO ' || coalesce(r.trophy_id, 0)]), ',') END AS race_names,
      (SELECT count(*) FROM race_ref AS f WHERE f.race_id = r.id) + CASE WHEN d.pos % 4 = 0 THEN 0 ELSE 1 END AS refs
    FROM race AS r JOIN doc AS d ON d.pos = r.id""",
)
def _(t):
    stored = t.race_with_metadata.withColumn("race_names", F.array(F.concat(F.lit("TROFEO "), F.coalesce("trophy_id", F.lit(0)).cast("string"))))
    none = F.lit(None)
    new = t.doc.select(
        F.col("pos").alias("id"), F.struct(F.lit(0).alias("pos"), F.col("datasource").alias("datasource_name"), F.col("ref_id").alias("ref_id")).alias("new_metadata"), F.col("gender").alias("new_gender"), F.col("category").alias("new_category"),
        F.array("name").alias("new_race_names"), F.col("laps").alias("new_laps"), F.col("lanes").alias("new_lanes"), F.col("sponsor").alias("new_sponsor"), none.cast("long").alias("new_place_id"),
    )
    merged = merge.merge_race(stored.join(new, "id"))
    return merged.select("id", "gender", "category", "laps", "lanes", "sponsor", "place_id", F.array_join("race_names", ",").alias("race_names"), F.size("metadata").cast("long").alias("refs"))


#: One race in five is new.  They come by id, and a later one meets what an earlier one has stored.
_SAVED = """k AS (
      SELECT *, id % 5 = 2 AS fresh, league_id IS NOT NULL AS keyed,
        concat_ws('/', coalesce(trophy_id, -1), coalesce(flag_id, -1), coalesce(league_id, -1), coalesce(trophy_edition, -1), coalesce(flag_edition, -1), modality) AS comp
      FROM race),
    g AS (SELECT comp, bool_or(day = 1) AS s1, bool_or(day = 2) AS s2 FROM k WHERE NOT fresh GROUP BY comp),
    a AS (SELECT comp, min(id) AS leader FROM k WHERE fresh AND day = 1 GROUP BY comp),
    f AS (
      SELECT comp, yr, min(CASE WHEN NOT fresh THEN id END) AS stored_first, min(CASE WHEN fresh THEN id END) AS fresh_first
      FROM k WHERE day = 1 GROUP BY comp, yr),
    c AS (
      SELECT k.id, k.day, k.yr, k.keyed, k.comp, coalesce(g.s2, false) AS s2,
        k.day = 1 AND (NOT k.keyed OR (NOT coalesce(g.s1, false) AND k.id = a.leader)) AS leads,
        coalesce(f.stored_first, CASE WHEN f.fresh_first < k.id AND (NOT k.keyed OR (NOT coalesce(g.s1, false) AND f.fresh_first = a.leader)) THEN f.fresh_first END) AS first_id
      FROM k LEFT JOIN g USING (comp) LEFT JOIN a USING (comp) LEFT JOIN f ON f.comp = k.comp AND f.yr = k.yr WHERE k.fresh),
    d AS (
      SELECT *, NOT leads AND first_id IS NOT NULL AND (NOT keyed OR (NOT s2 AND id = min(CASE WHEN NOT leads AND first_id IS NOT NULL THEN id END) OVER (PARTITION BY comp))) AS second
      FROM c)
    SELECT id, CASE WHEN second THEN 2 ELSE day END AS day,
      CASE WHEN second AND day = 1 THEN 'SAVE_AS_DAY_2' WHEN NOT leads AND NOT second THEN 'REJECT' WHEN yr < 1996 THEN 'SAVE' ELSE 'REVIEW' END AS action,
      CASE WHEN second THEN first_id END AS associated_id FROM d"""


def _saved(t):
    return merge.save_races(t.race.filter("id % 5 = 2"), t.race.filter("id % 5 <> 2"), auto_before=1996)


@query("mrg_3_save_races", f"WITH {_SAVED}")
def _(t):
    return _saved(t)


_LINKED = f"SELECT id, associated_id FROM (WITH {_SAVED}) WHERE action <> 'REJECT' AND associated_id IS NOT NULL"


@query("mrg_3_day_links", f"{_LINKED} UNION ALL SELECT associated_id, id FROM ({_LINKED})")
def _(t):
    return merge.day_links(_saved(t))


_BOATS = """d AS (SELECT p.id AS doc_id, race_id, club_id, p.gender, p.category, CASE WHEN p.id % 3 <> 0 THEN branch END AS branch, CASE WHEN p.id % 2 = 0 THEN 'X B' WHEN p.id % 7 <> 0 THEN 'X' END AS raw_name, r.league_id IS NOT NULL AS has_league,
    CASE WHEN p.id % 2 = 0 THEN laps_ms ELSE list_concat(laps_ms, [1::BIGINT]) END AS laps_ms, CASE WHEN r.type = 'TIME_TRIAL' THEN 1 WHEN p.id % 5 <> 0 THEN lane END AS lane, p.id % 8 < 5 AS can_be, 'CLUB ' || club_id AS club_name, CASE WHEN p.id % 5 = 0 THEN '7' END AS ref_id
    FROM participant AS p JOIN race AS r ON r.id = race_id),
  s AS (SELECT *, id % 3 = 0 AS has_ref FROM participant WHERE id % 4 <> 0),
  m AS (SELECT d.doc_id, raw_name, has_league, s.id, s.branch, count(*) OVER (PARTITION BY doc_id) AS n FROM d JOIN s ON s.race_id = d.race_id AND s.club_id = d.club_id AND s.gender = d.gender AND s.category = d.category AND s.branch IS NOT DISTINCT FROM d.branch),
  l AS (SELECT doc_id, count(*) AS n, min(id) AS id FROM m WHERE n = 1 OR has_league OR raw_name IS NULL OR branch IS NOT DISTINCT FROM CASE WHEN raw_name = 'X B' THEN 'B' END GROUP BY doc_id),
  j AS (SELECT d.*, coalesce(l.n, 0) AS n, s.id AS participant_id, s.laps_ms AS s_laps, s.lane AS s_lane, s.club_names AS s_names, s.branch AS s_branch, s.has_ref, len(d.laps_ms) > len(s.laps_ms) AS longer,
    d.lane IS NOT NULL AND d.lane IS DISTINCT FROM s.lane AS other, NOT (s.has_ref AND d.ref_id IS NULL) AS new_source FROM d LEFT JOIN l USING (doc_id) LEFT JOIN s ON l.n = 1 AND s.id = l.id),
  t AS (SELECT *, CASE WHEN n > 1 THEN 'REVIEW' WHEN n = 0 THEN 'NEW' WHEN NOT (longer OR other) THEN 'EXISTING' ELSE {changed} END AS status FROM j)
  SELECT doc_id, CASE WHEN status <> 'NEW' THEN participant_id END AS participant_id, status, len(CASE WHEN status = 'NEW' OR (status = 'MERGED' AND {policy} AND longer) THEN laps_ms ELSE s_laps END) AS laps,
    CASE WHEN status = 'NEW' OR (status = 'MERGED' AND {policy} AND other) THEN lane ELSE s_lane END AS lane,
    CASE WHEN n = 0 THEN club_name ELSE array_to_string(CASE WHEN status = 'NEW' OR (status IN ('EXISTING', 'MERGED') AND new_source) THEN list_sort(list_distinct(list_append(s_names, club_name))) ELSE s_names END, ',') END AS names,
    CASE WHEN status = 'NEW' THEN CASE WHEN can_be THEN branch END ELSE s_branch END AS branch,
    CASE WHEN status = 'NEW' THEN 1 ELSE CASE WHEN has_ref THEN 1 WHEN NOT has_ref THEN 0 END + CASE WHEN status IN ('EXISTING', 'MERGED') AND new_source THEN 1 ELSE 0 END END AS refs FROM t"""
_NO_REF = "cast(array() as array<struct<datasource_name:string,ref_id:string>>)"


def _planned_boats(name: str, update: str, changed: str) -> None:
    @query(name, f"WITH {_BOATS.format(changed=changed, policy='true' if update == 'always' else 'false')}")
    def _(t):
        own, even = F.col("id"), F.col("id") % 2 == 0
        races = t.race.select(F.col("id").alias("race_id"), F.col("league_id").isNotNull().alias("has_league"), (F.col("type") == "TIME_TRIAL").alias("time_trial"))
        docs = t.participant.join(races, "race_id").select(
            own.alias("doc_id"), "race_id", "club_id", "gender", "category", F.when(own % 3 != 0, F.col("branch")).alias("branch"), F.when(even, "X B").when(own % 7 != 0, "X").alias("raw_name"), "has_league", "time_trial",
            F.when(even, F.col("laps_ms")).otherwise(F.concat("laps_ms", F.array(F.lit(1).cast("long")))).alias("laps_ms"), F.when(own % 5 != 0, F.col("lane")).alias("lane"), (own % 8 < 5).alias("can_be_branch"),
            F.concat(F.lit("CLUB "), F.col("club_id").cast("string")).alias("club_name"), F.lit("act").alias("datasource"), F.when(own % 5 == 0, "7").alias("ref_id"),
        )
        one = F.array(F.struct(F.lit("act").alias("datasource_name"), F.lit(None).cast("string").alias("ref_id")))
        stored = t.participant.filter("id % 4 <> 0").withColumn("metadata", F.when(own % 3 == 0, one).otherwise(F.expr(_NO_REF)))
        planned = merge.plan_participants(docs, stored, update)
        return planned.select("doc_id", "participant_id", "status", F.size("laps_ms").cast("long").alias("laps"), "lane", F.array_join("club_names", ",").alias("names"), "branch", F.size("refs").alias("refs"))


_planned_boats("mrg_4_plan_participants", "always", "'MERGED'")
_planned_boats("mrg_4_plan_participants_never", "never", "CASE WHEN has_ref THEN 'NEW' ELSE 'MERGED' END")


def _merged_boats(name: str, allowed: bool, sql: str) -> None:
    @query(name, sql)
    def _(t):
        ref = lambda name: F.struct(name.alias("datasource_name"), F.lit(None).cast("string").alias("ref_id"))
        longer = F.when(F.col("id") % 2 == 0, F.concat("laps_ms", F.array(F.lit(1).cast("long")))).otherwise(F.slice("laps_ms", 1, 1))
        pairs = t.participant.select(
            "id", "laps_ms", "lane", longer.alias("new_laps_ms"), F.when(F.col("id") % 3 == 0, 9).alias("new_lane"), "club_names", F.array(F.lit("NEW")).alias("new_club_names"),
            F.array(ref(F.lit("act"))).alias("metadata"), ref(F.when(F.col("id") % 7 == 0, "act").otherwise("arc")).alias("new_metadata"),
        )
        merged = merge.merge_participant(pairs, allowed)
        return merged.select("id", F.size("laps_ms").cast("long").alias("laps"), "lane", F.size("club_names").cast("long").alias("names"), F.size("metadata").alias("refs"))


_SOURCED = "len(club_names) + CASE WHEN id % 7 = 0 THEN 0 ELSE 1 END AS names, CASE WHEN id % 7 = 0 THEN 1 ELSE 2 END AS refs FROM participant"
_merged_boats("mrg_5_merge_participant", True, f"SELECT id, len(laps_ms) + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS laps, CASE WHEN id % 3 = 0 THEN 9 ELSE lane END AS lane, {_SOURCED}")
_merged_boats("mrg_5_merge_refused", False, f"SELECT id, len(laps_ms) AS laps, lane, {_SOURCED}")


@query("mrg_6_add_metadata", "SELECT r.race_id AS id, count(*) + CASE WHEN r.race_id % 3 = 0 THEN 0 ELSE 1 END AS refs FROM race_ref AS r GROUP BY r.race_id")
def _(t):
    new = F.struct(F.lit(5).alias("pos"), F.lit("act").alias("datasource_name"), (F.col("id") % 5000).cast("string").alias("ref_id"))
    return t.race_with_metadata.select("id", F.size(metadata.add_element(F.col("metadata"), new)).cast("long").alias("refs"))


_NEW = "n AS (SELECT participant_id, CASE WHEN participant_id % 2 = 0 THEN 'COLLISION' ELSE 'NO_LINE_START' END AS reason, true AS disqualification, CASE WHEN participant_id % 3 <> 0 THEN 'seen' END AS note FROM penalty WHERE participant_id % 4 < 2 UNION ALL SELECT id, 'OFF_THE_FIELD', false, CASE WHEN id % 100 = 0 THEN 'late,again' ELSE 'late' END FROM participant WHERE id % 50 = 0 AND id NOT IN (SELECT participant_id FROM penalty))"


_UPSERT = f"""{_NEW}, p AS (SELECT participant_id, reason, disqualification, notes FROM penalty UNION ALL SELECT participant_id, 'COLLISION', false, ['second'] FROM penalty WHERE participant_id % 8 = 0),
    c AS (SELECT *, count(*) OVER (PARTITION BY participant_id) AS n, count(*) OVER (PARTITION BY participant_id, reason) AS k FROM p),
    u AS (SELECT n.participant_id, coalesce(c.reason, n.reason) AS reason, c.disqualification, array_to_string(CASE WHEN n.note IS NULL OR list_contains(c.notes, n.note) THEN c.notes ELSE list_append(c.notes, n.note) END, ',') AS notes, 'UPDATED' AS status
      FROM n JOIN c ON c.participant_id = n.participant_id AND CASE WHEN c.n = 1 THEN c.reason IS NULL OR c.reason = n.reason ELSE c.k = 1 AND coalesce(c.reason = n.reason, false) END)
    SELECT * FROM u UNION ALL SELECT participant_id, reason, disqualification, coalesce(note, ''), 'CREATED' FROM n WHERE participant_id NOT IN (SELECT participant_id FROM u)"""


def _penalties(t):
    """Stored penalties, some boats with a second one; and those of documents."""
    second = t.penalty.filter("participant_id % 8 = 0").select("participant_id", F.lit(False).alias("disqualification"), F.lit("COLLISION").alias("reason"), F.array(F.lit("second")).alias("notes"))
    reason = F.when(F.col("participant_id") % 2 == 0, "COLLISION").otherwise("NO_LINE_START")
    new = t.penalty.filter("participant_id % 4 < 2").select("participant_id", reason.alias("reason"), F.lit(True).alias("disqualification"), F.when(F.col("participant_id") % 3 != 0, "seen").alias("note"))
    late = t.participant.filter("id % 50 = 0").select(F.col("id").alias("participant_id"), F.lit("OFF_THE_FIELD").alias("reason"), F.lit(False).alias("disqualification"), F.lit("late").alias("note"))
    late = late.join(t.penalty.select("participant_id"), "participant_id", "left_anti")
    # Other documents report some of these again: a penalty that the first one made takes the second one's note.
    again = late.filter("participant_id % 100 = 0").withColumn("disqualification", F.lit(True)).withColumn("note", F.lit("again"))
    reports = new.withColumn("pos", F.lit(1)).unionByName(late.withColumn("pos", F.lit(1)))
    reports = reports.unionByName(again.withColumn("pos", F.lit(2))).unionByName(new.filter("participant_id % 4 = 1").withColumn("pos", F.lit(2)))
    return t.penalty.unionByName(second), reports


@query("mrg_7_upsert_penalty", f"WITH {_UPSERT}")
def _(t):
    stored, new = _penalties(t)
    return merge.upsert_penalty(new, stored, order="pos").withColumn("notes", F.array_join("notes", ","))


@query("mrg_11_backfill_penalties", f"WITH {_UPSERT}")
def _(t):
    stored, new = _penalties(t)
    # Documents of races report the same penalties, and as many report none.
    reported = new.select("participant_id", F.col("reason").alias("penalty_reason"), F.col("disqualification").alias("penalty_out"), F.concat(F.coalesce("note", F.lit("")), F.lit(" ")).alias("race_notes"))
    silent = reported.withColumn("penalty_reason", F.lit(None).cast("string")).withColumn("penalty_out", F.lit(False))
    return merge.backfill_penalties(reported.unionByName(silent), stored).withColumn("notes", F.array_join("notes", ","))


@query("mrg_8_save_participants", "SELECT id AS doc_id, CASE WHEN id % 3 = 0 THEN 'KEEP' WHEN race_id % 2 = 0 THEN 'SAVE' ELSE 'REVIEW' END AS action FROM participant")
def _(t):
    plan = t.participant.select(F.col("id").alias("doc_id"), "race_id", F.when(F.col("id") % 3 == 0, "EXISTING").otherwise("NEW").alias("status"))
    return merge.save_participants(plan, t.race.filter("id % 2 = 0").select(F.col("id").alias("race_id")))


@query("mrg_9_mark_checked", "SELECT id, CASE WHEN id IN (SELECT flag_id FROM race WHERE yr = 1995) THEN DATE '1999-01-01' ELSE last_checked END AS last_checked FROM flag")
def _(t):
    return merge.mark_checked(t.flag, t.race.filter("yr = 1995 and flag_id is not null"), "1999-01-01").select("id", "last_checked")


@query(
    "mrg_10_mix_participants",
    """WITH d AS (SELECT id AS doc_id, race_id, laps_ms[-1] AS time FROM participant WHERE len(laps_ms) > 0 AND race_id IN (SELECT id FROM race WHERE gender = 'ALL')),
    m AS (SELECT DISTINCT ON (doc_id) doc_id, p.id FROM d JOIN participant AS p ON p.race_id = d.race_id AND p.laps_ms[-1] = d.time ORDER BY doc_id, p.category <> 'SCHOOL', p.id)
    SELECT id, CASE WHEN id IN (SELECT id FROM m) THEN 'MIX' ELSE gender END AS gender, CASE WHEN id IN (SELECT id FROM m) THEN 'ABSOLUT' ELSE category END AS category,
      (SELECT min('doc ' || doc_id) FROM m WHERE m.id = participant.id) AS data FROM participant""",
)
def _(t):
    timed = t.participant.filter(F.size("laps_ms") > 0)
    of_all = timed.join(t.race.filter("gender = 'ALL'").select(F.col("id").alias("race_id")), "race_id", "left_semi")
    docs = of_all.select(F.col("id").alias("doc_id"), "race_id", F.element_at("laps_ms", -1).alias("time"))
    matched = joins.match_by_time(docs, timed).withColumn("new_data", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    none = F.lit(None).cast("string")
    boats = t.participant.withColumn("metadata", F.array(F.struct(F.lit("act").alias("datasource_name"), none.alias("date"), none.alias("data"))))
    return merge.mix_participants(boats, matched, "2001-01-01").select("id", "gender", "category", F.col("metadata")[0]["data"].alias("data"))


@query(
    "mrg_11_backfill_participants",
    "SELECT id, coalesce(branch, CASE WHEN id % 6 = 0 THEN 'C' END) AS branch, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS refs FROM participant",
)
def _(t):
    pairs = t.participant.filter("id % 2 = 0").select(F.col("id").alias("participant_id"), F.when(F.col("id") % 6 == 0, "C").alias("new_branch"), F.struct(F.lit("act").alias("datasource_name"), F.lit(None).cast("string").alias("ref_id")).alias("new_metadata"))
    empty = F.expr("cast(array() as array<struct<datasource_name:string,ref_id:string>>)")
    return merge.backfill_participants(t.participant.withColumn("metadata", empty), pairs).select("id", "branch", F.size("metadata").alias("refs"))


@query("mrg_12_flag_ref_names", "SELECT f.flag_id AS id, coalesce(f.ref_name, (SELECT arg_min('R' || r.id, r.id) FROM race AS r WHERE r.flag_id = f.flag_id AND r.id % 3 = 0)) AS ref_name FROM flag_ref AS f")
def _(t):
    one = F.array(F.concat(F.lit("R"), F.col("id").cast("string")))
    names = t.race.filter("flag_id is not null").select("flag_id", F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, one).otherwise(F.concat(one, one)).alias("race_names"))
    return merge.flag_ref_names(t.flag_with_metadata, names, "traineras").select("id", F.col("metadata")[0]["ref_name"].alias("ref_name"))


@query("mrg_13_repeated_club_branches", "SELECT id, CASE WHEN len(club_names) > 0 AND club_names[1] LIKE '% B' THEN 'B' END AS branch FROM (SELECT *, count(*) OVER (PARTITION BY race_id, club_id, gender, category) AS n FROM participant) WHERE n > 1")
def _(t):
    return merge.repeated_club_branches(t.participant)


@query(
    "mrg_14_rewrite_metadata",
    """SELECT pos AS id, pos::VARCHAR AS ref_id, CASE WHEN pos % 11 = 0 AND datasource = 'arc' THEN 'ete' ELSE datasource END AS datasource, CASE WHEN pos % 2 = 0 THEN 'FEMALE' END AS gender, CASE WHEN pos % 5 = 0 THEN 0 ELSE 1 END AS kept,
      CASE WHEN pos % 16 = 0 THEN 1 ELSE 0 END AS names FROM doc""",
)
def _(t):
    page = F.when(F.col("pos") % 2 == 0, "http://x/Femenino").otherwise("http://x/y")
    values = F.when(F.col("pos") % 5 == 0, F.array(F.create_map(F.lit("gender"), F.lit("MALE")))).otherwise(F.array(F.create_map(F.lit("details_page"), page), F.create_map(F.lit("gender"), F.lit("MALE"))))
    page_only = F.array(F.create_map(F.lit("details_page"), page))
    old = lambda v: F.array(F.struct(F.col("pos").alias("id"), F.col("datasource").alias("datasource_name"), v.alias("values")))
    new = metadata.values_to_object(old(values))
    renamed = metadata.rename_source(new, F.col("pos") % 11, 0, "arc", "ete")
    return t.doc.select(
        F.col("pos").alias("id"), renamed[0]["ref_id"].alias("ref_id"), renamed[0]["datasource_name"].alias("datasource"), metadata.gender_from_url(metadata.values_to_object(old(page_only))).alias("gender"),
        F.size(metadata.drop_empty_elements(new)).alias("kept"), F.size(metadata.single_name_to_array(F.col("sponsor"))).alias("names"),
    )
