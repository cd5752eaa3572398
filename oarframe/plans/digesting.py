"""Queries of the ingest chain (MRG-1, MRG-4) and of the upsert sink (MRG-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import name_tokens
from ..operators import digest
from ..session import dealt, new_path
from ..sources.upsert import UpsertTable
from .registry import query

#: Documents of the table, four races in five stored.  Every tenth document has no edition, every tenth a name that
#: nothing is called by, so its competition is that of the first document of its race name.
_KIND = """SELECT q.*, (SELECT CASE WHEN count(*) = 1 OR (count(DISTINCT {k}_edition) = 1 AND count({k}_edition) = count(*)) THEN nullif(max({k}_edition), 0) END FROM stored AS r
    WHERE r.day = 1 AND r.gender = q.gender AND r.category = q.category AND r.yr = q.yr + q.shift AND (r.{k}_id = q.item OR r.{k}_id IS NULL)) AS found
  FROM (SELECT DISTINCT {k}0 AS item, gender, category, yr, shift FROM d, (VALUES (0), (-1), (1)) AS v(shift) WHERE given IS NULL AND {k}0 IS NOT NULL) AS q"""
_INFERRED = """SELECT item, gender, category, yr, coalesce(max(found) FILTER (shift = 0), max(found) FILTER (shift = -1) + 1, nullif(max(found) FILTER (shift = 1) - 1, 0)) AS edition FROM ({q}) GROUP BY ALL"""
_TRIES = """SELECT d.doc_id, count(*) FILTER (r.gender IN (d.gender, 'ALL') AND r.category IN (d.category, 'ALL')) AS n_full,
    min(r.id) FILTER (r.gender IN (d.gender, 'ALL') AND r.category IN (d.category, 'ALL')) AS full_race, count(*) AS n_all, min(r.id) AS all_race
  FROM d JOIN stored AS r ON r.date = d.date AND r.day = d.day AND (d.{t} IS NULL OR r.trophy_id = d.{t}) AND (d.{f} IS NULL OR r.flag_id = d.{f}) AND (d.lg IS NULL OR r.league_id = d.lg)
  WHERE d.{t} IS NOT NULL OR d.{f} IS NOT NULL GROUP BY d.doc_id"""
_COMPETITION = """SELECT m.*, r.id IS NOT NULL AS has_db, coalesce(r.trophy_id, CASE WHEN coalesce(m.given, it.edition) IS NOT NULL THEN m.{t} END) AS trophy_id,
    CASE WHEN r.trophy_id IS NOT NULL THEN r.trophy_edition WHEN m.{t} IS NOT NULL THEN coalesce(m.given, it.edition) END AS trophy_edition,
    coalesce(r.flag_id, CASE WHEN coalesce(m.given, il.edition) IS NOT NULL THEN m.{f} END) AS flag_id,
    CASE WHEN r.flag_id IS NOT NULL THEN r.flag_edition WHEN m.{f} IS NOT NULL THEN coalesce(m.given, il.edition) END AS flag_edition,
    CASE WHEN r.id IS NOT NULL THEN r.league_id ELSE m.lg END AS league_id
  FROM {m} AS m LEFT JOIN stored AS r ON r.id = m.db
  LEFT JOIN it ON it.item = m.{t} AND it.gender = m.gender AND it.category = m.category AND it.yr = m.yr AND m.given IS NULL
  LEFT JOIN il ON il.item = m.{f} AND il.gender = m.gender AND il.category = m.category AND il.yr = m.yr AND m.given IS NULL"""
_DIGEST = f"""stored AS (SELECT * FROM race WHERE id % 5 <> 1),
  d AS (SELECT pos AS doc_id, name, date, year(date) AS yr, day, gender, category, laps, lanes, sponsor, datasource, ref_id, trophy_id AS trophy0, flag_id AS flag0,
    CASE WHEN pos % 10 <> 3 THEN trophy_id END AS nt, CASE WHEN pos % 10 <> 3 THEN flag_id END AS nf,
    CASE WHEN pos % 10 <> 0 THEN nullif(coalesce(trophy_edition, flag_edition), 0) END AS given, CAST(substring(league, 6, 1) AS INT) AS lg FROM doc),
  it AS ({_INFERRED.format(q=_KIND.format(k='trophy'))}), il AS ({_INFERRED.format(q=_KIND.format(k='flag'))}),
  own AS ({_TRIES.format(t='nt', f='nf')}), told AS ({_TRIES.format(t='trophy0', f='flag0')}),
  m1 AS (SELECT d.*, CASE WHEN n_full = 1 THEN full_race WHEN n_full = 0 AND n_all = 1 THEN all_race END AS db, coalesce(n_full > 1 OR (n_full = 0 AND n_all > 1), false) AS several FROM d LEFT JOIN own USING (doc_id)),
  c1 AS ({_COMPETITION.format(m='m1', t='nt', f='nf')}),
  g1 AS (SELECT *, (trophy_id IS NOT NULL AND coalesce(trophy_edition, 0) <> 0) OR (flag_id IS NOT NULL AND coalesce(flag_edition, 0) <> 0) AS complete FROM c1),
  h AS (SELECT name, min(doc_id) AS since FROM g1 WHERE complete AND NOT several GROUP BY name),
  m2 AS (SELECT m1.* REPLACE (CASE WHEN t.n_full = 1 THEN t.full_race ELSE db END AS db, coalesce(t.n_full, 0) <> 1 AND several AS several)
    FROM m1 JOIN h ON h.name = m1.name AND h.since < m1.doc_id LEFT JOIN told AS t USING (doc_id)),
  c2 AS ({_COMPETITION.format(m='m2', t='trophy0', f='flag0')}),
  c AS (SELECT * FROM c1 WHERE doc_id NOT IN (SELECT doc_id FROM m2) UNION ALL SELECT * FROM c2),
  g AS (SELECT *, (trophy_id IS NOT NULL AND coalesce(trophy_edition, 0) <> 0) OR (flag_id IS NOT NULL AND coalesce(flag_edition, 0) <> 0) AS complete FROM c),
  e AS (SELECT u.doc_id, count(*) AS n, min(r.id) AS race FROM g AS u JOIN stored AS r ON r.date = u.date AND r.day = u.day AND r.gender = u.gender AND r.category = u.category
    AND r.trophy_id IS NOT DISTINCT FROM u.trophy_id AND r.flag_id IS NOT DISTINCT FROM u.flag_id AND r.league_id IS NOT DISTINCT FROM u.league_id
    WHERE u.complete AND u.db IS NULL AND NOT u.several GROUP BY u.doc_id),
  o AS (SELECT u.doc_id, count(*) AS n, min(b.id) AS race FROM g AS u JOIN stored AS b ON b.yr = u.yr AND b.day = CASE WHEN u.day = 2 THEN 1 ELSE 2 END
    AND (u.trophy_id IS NULL OR (u.trophy_id = b.trophy_id AND u.trophy_edition IS NOT DISTINCT FROM b.trophy_edition))
    AND (u.flag_id IS NULL OR (u.flag_id = b.flag_id AND u.flag_edition IS NOT DISTINCT FROM b.flag_edition)) AND (u.league_id IS NULL OR u.league_id = b.league_id)
    WHERE u.complete GROUP BY u.doc_id),
  u AS (SELECT trophy_id, flag_id, league_id, CASE WHEN count(DISTINCT place_id) = 1 THEN max(place_id) END AS p, CASE WHEN count(DISTINCT organizer_id) = 1 THEN max(organizer_id) END AS q FROM stored GROUP BY ALL),
  f AS (SELECT g.*, u.p, u.q, coalesce(g.db, CASE WHEN e.n = 1 THEN e.race END) AS found, CASE WHEN o.n = 1 THEN o.race END AS other,
    CASE WHEN g.several OR coalesce(e.n > 1, false) OR coalesce(o.n > 1, false) THEN 'REVIEW' WHEN NOT complete THEN 'IGNORED' WHEN coalesce(g.db, CASE WHEN e.n = 1 THEN e.race END) IS NULL THEN 'NEW' ELSE 'MERGED' END AS status
    FROM g LEFT JOIN e USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN u ON u.trophy_id IS NOT DISTINCT FROM g.trophy_id AND u.flag_id IS NOT DISTINCT FROM g.flag_id AND u.league_id IS NOT DISTINCT FROM g.league_id),
  plan AS (
    SELECT doc_id, status, NULL::BIGINT AS race_id, CASE WHEN status = 'NEW' THEN coalesce(other, found) END AS associated_id, CASE WHEN status <> 'IGNORED' THEN trophy_id END AS trophy_id,
      CASE WHEN status <> 'IGNORED' THEN trophy_edition END AS trophy_edition, CASE WHEN status <> 'IGNORED' THEN flag_id END AS flag_id, CASE WHEN status <> 'IGNORED' THEN flag_edition END AS flag_edition,
      CASE WHEN status <> 'IGNORED' THEN league_id END AS league_id, CASE WHEN status <> 'IGNORED' THEN gender END AS gender, CASE WHEN status <> 'IGNORED' THEN category END AS category,
      CASE WHEN status <> 'IGNORED' THEN laps END AS laps, CASE WHEN status <> 'IGNORED' THEN lanes END AS lanes, CASE WHEN status <> 'IGNORED' THEN sponsor END AS sponsor,
      CASE WHEN status <> 'IGNORED' THEN p END AS place_id, CASE WHEN status <> 'IGNORED' THEN q END AS organizer_id, CASE WHEN status <> 'IGNORED' THEN 1 END AS refs FROM f WHERE status <> 'MERGED'
    UNION ALL
    SELECT doc_id, status, r.id, other, r.trophy_id, r.trophy_edition, r.flag_id, r.flag_edition, r.league_id, CASE WHEN f.gender = r.gender THEN r.gender ELSE 'ALL' END, CASE WHEN f.category = r.category THEN r.category ELSE 'ALL' END,
      CASE WHEN r.laps = 4 AND f.laps = 2 THEN r.laps ELSE f.laps END, coalesce(f.lanes, r.lanes), coalesce(f.sponsor, r.sponsor), coalesce(f.p, r.place_id), r.organizer_id,
      (SELECT count(*) FROM race_ref AS x WHERE x.race_id = r.id) + CASE WHEN EXISTS (SELECT 1 FROM race_ref AS x WHERE x.race_id = r.id AND x.datasource_name = f.datasource AND x.ref_id = f.ref_id) THEN 0 ELSE 1 END
    FROM f JOIN stored AS r ON r.id = f.found WHERE status = 'MERGED')"""


def _documents(t):
    edition = F.when(F.col("pos") % 10 != 0, F.coalesce("trophy_edition", "flag_edition"))
    own = F.when(F.col("trophy_id").isNotNull(), F.concat(F.lit("COPA "), F.col("trophy_id").cast("string"))).otherwise(F.concat(F.lit("BANDERA "), F.col("flag_id").cast("string")))
    called = F.when(F.col("pos") % 10 != 3, own).otherwise(F.lit("UNHEARD OF"))
    none = F.lit(None).cast("string")
    docs = t.doc.select(
        "pos", "name", "date", F.col("day").cast("int").alias("day"), F.lit("TRAINERA").alias("modality"), F.lit("CONVENTIONAL").alias("type"), "league", none.alias("town"), none.alias("organizer"), "sponsor",
        F.array(F.struct(called.alias("name"), edition.cast("int").alias("edition"))).alias("names"), F.array("ref_id").alias("race_ids"), F.lit("page").alias("url"), "datasource", "gender", "category",
        F.col("laps").alias("race_laps"), F.col("lanes").alias("race_lanes"), F.lit(False).alias("cancelled"), none.alias("race_notes"),
    )
    boat = F.struct(
        F.concat(F.lit("C.R. "), F.col("club_id").cast("string")).alias("club_name"), F.concat(F.lit("CLUB "), F.col("club_id").cast("string")).alias("participant"), F.col("lane").cast("int").alias("lane"), "gender", "category",
        F.expr("transform(laps_ms, x -> format_string('%02d:%02d.%03d', x div 60000, x div 1000 % 60, x % 1000))").alias("laps"), F.lit(1).alias("series"), F.col("distance").cast("int").alias("distance"), none.alias("handicap"),
        "retired", "absent", "guest", F.lit(None).cast("struct<reason:string,disqualification:boolean>").alias("penalty"),
    )
    boats = t.participant.groupBy("race_id").agg(F.sort_array(F.collect_list(F.struct("id", boat.alias("p")))).alias("b")).select("race_id", F.transform("b", lambda x: x["p"]).alias("participants"))
    return digest.prepared(docs.join(dealt(boats), F.col("pos") == F.col("race_id"), "left").drop("race_id"), "pos")


def _stored(t):
    races = t.race_with_metadata.filter("id % 5 <> 1").withColumn("race_names", F.array(F.lit("OLD")))
    return races.withColumn("day", F.col("day").cast("int"))


def _decisions(t):
    items = lambda dim, word: dim.select(F.col("id").alias("item_id"), F.concat(F.lit(word), F.col("id").cast("string")).alias("name")).withColumn("tokens", name_tokens(F.col("name")))
    return digest.digest_races(_documents(t), _stored(t), items(t.trophy, "COPA "), items(t.flag, "BANDERA "), t.league, _clubs(t), t.place)


def _clubs(t):
    return t.club.select("id", "name", "normalized_name", "known_names", "is_active", F.lit("CLUB").alias("type"))


_SHOWN = ["trophy_id", "trophy_edition", "flag_id", "flag_edition", "league_id", "gender", "category", "laps", "lanes", "sponsor", "place_id", "organizer_id"]


@query("mrg_1_digest_races", f"WITH {_DIGEST} SELECT * FROM plan")
def _(t):
    return _decisions(t).select("doc_id", "status", "race_id", "associated_id", *_SHOWN, F.size("metadata").alias("refs"))


@query(
    "mrg_2_upsert_races",
    f"""WITH {_DIGEST}, merged AS (SELECT race_id, gender, category, laps, lanes, refs FROM plan WHERE status = 'MERGED' QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY doc_id) = 1)
    SELECT s.id, coalesce(m.gender, s.gender) AS gender, coalesce(m.category, s.category) AS category, coalesce(m.laps, s.laps) AS laps, coalesce(m.lanes, s.lanes) AS lanes,
      coalesce(m.refs, (SELECT count(*) FROM race_ref AS x WHERE x.race_id = s.id)) AS refs FROM stored AS s LEFT JOIN merged AS m ON m.race_id = s.id""",
)
def _(t):
    # The first document of each stored race is applied; the same run again finds its marker and changes nothing.
    stored = _stored(t)
    columns = ["id", "gender", "category", "laps", "lanes", "metadata"]
    first = _decisions(t).filter("status = 'MERGED'").groupBy("race_id").agg(F.min_by(F.struct("gender", "category", "laps", "lanes", "metadata"), "doc_id").alias("row"))
    table = UpsertTable(t.spark, new_path(t.spark), ["id"], buckets=16).create(stored.select(*columns))
    changes = first.select(F.col("race_id").alias("id"), "row.*").select(*columns)
    for _ in range(2):
        table.upsert(changes, "digest")
    return table.read().select("id", "gender", "category", "laps", "lanes", F.size("metadata").cast("long").alias("refs"))


@query(
    "mrg_4_digest_participants",
    f"""WITH {_DIGEST},
  p AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY id, laps_ms) - 1 AS boat FROM participant),
  b AS (SELECT p.*, plan.status AS race_status, plan.race_id AS to_race, CASE WHEN x.type = 'TIME_TRIAL' THEN 1 ELSE p.lane END AS new_lane, d.datasource
    FROM p JOIN plan ON plan.doc_id = p.race_id JOIN doc AS d ON d.pos = p.race_id LEFT JOIN race AS x ON x.id = plan.race_id WHERE plan.status <> 'IGNORED'),
  s AS (SELECT *, id % 3 = 0 AS has_ref FROM participant WHERE id % 4 <> 0),
  m AS (SELECT b.race_id AS doc_id, b.boat, count(s.id) AS n, min(s.id) AS sid FROM b LEFT JOIN s
    ON b.race_status = 'MERGED' AND s.race_id = b.to_race AND s.club_id = b.club_id AND s.gender = b.gender AND s.category = b.category AND s.branch IS NULL GROUP BY b.race_id, b.boat),
  j AS (SELECT b.*, m.n, s.id AS participant_id, s.laps_ms AS s_laps, s.lane AS s_lane, s.club_names AS s_names, s.has_ref, s.distance AS s_distance, s.retired AS s_retired,
      len(b.laps_ms) > len(s.laps_ms) AS longer, b.new_lane IS NOT NULL AND b.new_lane IS DISTINCT FROM s.lane AS other, NOT (s.has_ref AND b.datasource = 'act') AS new_source
    FROM b JOIN m ON m.doc_id = b.race_id AND m.boat = b.boat LEFT JOIN s ON m.n = 1 AND s.id = m.sid),
  t AS (SELECT *, CASE WHEN race_status = 'REVIEW' OR n > 1 THEN 'REVIEW' WHEN n = 0 THEN 'NEW' WHEN longer OR other THEN 'MERGED' ELSE 'EXISTING' END AS status, 'CR ' || club_id AS name FROM j)
  SELECT race_id AS doc_id, boat, to_race AS race_id, club_id, participant_id, status, CASE WHEN n = 0 THEN len(laps_ms) WHEN status = 'MERGED' AND longer THEN len(laps_ms) ELSE len(s_laps) END AS laps,
    CASE WHEN n = 0 THEN new_lane WHEN n = 1 AND status = 'MERGED' AND other THEN new_lane WHEN n = 1 THEN s_lane END AS lane,
    CASE WHEN n = 0 THEN name WHEN n = 1 THEN array_to_string(CASE WHEN new_source THEN list_sort(list_distinct(list_append(s_names, name))) ELSE s_names END, ',') END AS names,
    CASE WHEN n = 0 THEN 1 WHEN n = 1 THEN CASE WHEN has_ref THEN 1 ELSE 0 END + CASE WHEN new_source THEN 1 ELSE 0 END END AS refs,
    CASE WHEN n = 1 THEN s_distance ELSE distance END AS distance, CASE WHEN n = 1 THEN s_retired ELSE retired END AS retired FROM t""",
)
def _(t):
    one = F.array(F.struct(F.lit("act").alias("datasource_name"), F.lit(None).cast("string").alias("ref_id")))
    none = F.expr("cast(array() as array<struct<datasource_name:string,ref_id:string>>)")
    stored = t.participant.filter("id % 4 <> 0").withColumn("metadata", F.when(F.col("id") % 3 == 0, one).otherwise(none))
    boats = digest.digest_participants(_documents(t), _decisions(t), stored, _clubs(t).withColumn("is_active", F.lit(True)))
    return boats.select("doc_id", "boat", "race_id", "club_id", "participant_id", "status", F.size("laps_ms").alias("laps"), "lane", F.array_join("club_names", ",").alias("names"), F.size("refs").alias("refs"), "distance", "retired")
