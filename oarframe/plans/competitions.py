"""Queries of name resolution (RES)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import name_tokens, strip_branch
from ..operators import resolve
from .registry import query


def _entities(t):
    return t.entity.select("id", "name", "is_active", F.lit("CLUB").alias("type"), F.upper("name").alias("normalized_name"), F.expr("cast(array() as array<string>)").alias("known_names"))


def _resolved(test: str, queries: str = "query_name") -> str:
    return f"""n AS (SELECT id, upper(name) AS text FROM entity WHERE {test}),
  w AS (SELECT q, regexp_replace(upper(trim(q)), ' [BC]$', '') AS text FROM {queries}),
  e AS (SELECT q, min(id) AS id FROM w JOIN n USING (text) GROUP BY q HAVING count(*) = 1),
  c AS (SELECT DISTINCT q, w.text AS a, n.text AS b, n.id FROM (SELECT q, text, unnest(string_split(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), ' ')) AS part FROM w WHERE q NOT IN (SELECT q FROM e)) AS w
    JOIN n ON part NOT IN ('', 'DE', 'DEL', 'LA', 'LAS', 'EL', 'LOS', 'E', 'Y', 'DO', 'DA') AND contains(n.text, part)),
  s AS (SELECT *, 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE AS score, levenshtein(a, b) / ((length(a) + length(b)) / 2.0::DOUBLE) AS far FROM c),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, b, id) AS k FROM s WHERE score > 0.4) WHERE k = 1 AND (score = 1 OR far < 0.4)),
  found AS (SELECT q, id AS entity_id, 'unique' AS status FROM e UNION ALL SELECT q, CASE WHEN (SELECT count(*) FROM n WHERE n.text = b.b) = 1 THEN id END, CASE WHEN (SELECT count(*) FROM n WHERE n.text = b.b) = 1 THEN 'unique' ELSE 'ambiguous' END FROM b)"""


@query("res_1_resolve_entity", f"WITH {_resolved('true')} SELECT w.q, entity_id, coalesce(status, 'none') AS status FROM w LEFT JOIN found USING (q)")
def _(t):
    return resolve.resolve_entity(t.query_name, _entities(t))


_TWO = f"""one AS (WITH {_resolved('is_active')} SELECT * FROM found), rest AS (SELECT q FROM query_name WHERE q NOT IN (SELECT q FROM one)),
  two AS (WITH {_resolved('true', 'rest')} SELECT w.q, entity_id, coalesce(status, 'none') AS status FROM w LEFT JOIN found USING (q)), both_passes AS (SELECT * FROM one UNION ALL SELECT * FROM two)"""


@query("res_2_resolve_club", f"WITH {_TWO} SELECT q, entity_id, status FROM both_passes")
def _(t):
    return resolve.resolve_club(t.query_name, _entities(t))


@query("res_3_retrieve_entity", f"WITH {_TWO} SELECT q || ' C' AS q, entity_id FROM both_passes WHERE status = 'unique'")
def _(t):
    names = t.query_name.select(F.concat("q", F.lit(" C")).alias("q"))
    return resolve.retrieve_entity(names, _entities(t), strip_branch)[0]


def _items(t, kind):
    return getattr(t, kind).select(F.col("id").alias("item_id"), "name", name_tokens(F.col("name")).alias("tokens"))


@query(
    "res_4_resolve_competition",
    # A regatta's name fits the trophy and the flag of that number; it stands before the flag's own name.
    """SELECT pos AS doc_id, CASE WHEN n % 11 <> 3 THEN n % 11 END AS trophy_id, n % 11 AS flag_id FROM (SELECT pos, coalesce(flag_id, trophy_id) AS n FROM doc)""",
)
def _(t):
    number = F.coalesce("flag_id", "trophy_id")
    written = F.array(F.lit("MEMORIAL X"), F.concat(F.lit("Regata "), (number % 11).cast("string")), F.concat(F.lit("bandeira de la "), number.cast("string")))
    names = t.doc.select(F.col("pos").alias("doc_id"), F.posexplode(written).alias("pos", "q"))
    return resolve.resolve_competition(names, _items(t, "trophy"), _items(t, "flag"))


@query("res_5_resolve_by_tokens", "SELECT 'TROFEO ' || id || x AS q, id AS item_id FROM trophy, (VALUES (''), (' trainera')) AS v(x) WHERE name NOT LIKE 'Play%' UNION ALL SELECT 'Regata ' || id AS q, id FROM trophy WHERE name NOT LIKE 'Play%'")
def _(t):
    n = F.col("id").cast("string")
    names = t.trophy.filter("name not like 'Play%'").select(F.explode(F.array(F.concat(F.lit("TROFEO "), n), F.concat(F.lit("TROFEO "), n, F.lit(" trainera")), F.concat(F.lit("Regata "), n))).alias("q"))
    return resolve.resolve_by_tokens(names, _items(t, "trophy"))


_Q = "q AS (SELECT DISTINCT flag_id AS item_id, gender, category, yr AS year FROM race WHERE flag_id IS NOT NULL AND category <> 'ALL')"
_UNANIMOUS = """(SELECT CASE WHEN count(*) = 1 OR (count(DISTINCT flag_edition) = 1 AND count(flag_edition) = count(*)) THEN nullif(max(flag_edition), 0) END FROM race AS r
  WHERE r.day = 1 AND r.gender = q.gender AND r.category = q.category AND r.yr = q.year + {} AND (r.flag_id = q.item_id{}))"""


def _editions(null_item: str) -> str:
    parts = [_UNANIMOUS.format(by, null_item) for by in (0, -1, 1)]
    return f"WITH {_Q} SELECT q.*, coalesce({parts[0]}, {parts[1]} + 1, nullif({parts[2]} - 1, 0)) AS edition FROM q"


def _edition_queries(t):
    return t.race.filter("flag_id is not null and category <> 'ALL'").select(F.col("flag_id").alias("item_id"), "gender", "category", F.col("yr").alias("year")).distinct()


@query("res_6_infer_edition", _editions(""))
def _(t):
    return resolve.infer_edition(_edition_queries(t), t.race, "flag", include_null_item=False)


@query("res_6_infer_edition_faithful", _editions(" OR r.flag_id IS NULL"))
def _(t):
    return resolve.infer_edition(_edition_queries(t), t.race, "flag")


@query(
    "res_7_retrieve_competition",
    """SELECT pos, CASE WHEN pos % 3 = 0 THEN flag_id WHEN pos % 5 = 0 THEN 77 ELSE flag_id END AS item_id,
      CASE WHEN pos % 3 = 0 THEN laps WHEN pos % 5 = 0 THEN CASE WHEN pos % 4 = 0 THEN 9 END ELSE coalesce(nullif(laps - 2, 0), CASE WHEN pos % 4 = 0 THEN 9 END) END AS edition FROM doc WHERE flag_id IS NOT NULL""",
)
def _(t):
    when = lambda test, value: F.when(F.expr(test), value)
    docs = t.doc.filter("flag_id is not null").select(
        "pos", when("pos % 3 = 0", F.col("flag_id")).alias("db_item"), when("pos % 3 = 0", F.col("laps")).alias("db_edition"), when("pos % 5 = 0", F.lit(77)).alias("hint_item"),
        F.col("flag_id").alias("name_item"), (F.col("laps") - 2).alias("name_edition"), when("pos % 4 = 0", F.lit(9)).alias("inferred_edition"),
    )
    return resolve.retrieve_competition(docs).select("pos", "item_id", "edition")


@query("res_8_resolve_league", "SELECT pos AS doc_id, CASE WHEN pos % 6 = 0 THEN 4 WHEN pos % 8 <> 0 THEN CAST(substring(league, 6, 1) AS INT) END AS league_id FROM doc")
def _(t):
    name = F.when(F.col("pos") % 8 == 0, F.lit("Play-Off (1)")).otherwise(F.col("name"))
    docs = t.doc.select(F.col("pos").alias("doc_id"), name.alias("name"), F.concat(F.lower("league"), F.lit(" (A)")).alias("league"), F.when(F.col("pos") % 6 == 0, 4).alias("db_league_id"))
    return resolve.resolve_league(docs, t.league)


@query("res_9_resolve_place", "SELECT upper(substring(name, 2)) || 'S' AS q, CASE WHEN name LIKE 'PLACE%' THEN id END AS place_id FROM place WHERE name LIKE 'PLACE%'")
def _(t):
    names = t.place.filter("name like 'PLACE%'").select(F.concat(F.upper(F.substring("name", 2, 20)), F.lit("S")).alias("q"))
    return resolve.resolve_place(names, t.place).select("q", "place_id")


@query(
    "res_10_hints",
    """WITH d AS (SELECT pos, name, CASE WHEN pos % 3 = 0 THEN flag_id END AS item_id FROM doc WHERE flag_id IS NOT NULL), h AS (SELECT name, arg_min(item_id, pos) AS hint, min(pos) AS since FROM d WHERE item_id IS NOT NULL GROUP BY name)
    SELECT pos AS doc_id, coalesce(item_id, CASE WHEN since < pos THEN hint END) AS item_id FROM d LEFT JOIN h USING (name)""",
)
def _(t):
    docs = t.doc.filter("flag_id is not null").select(F.col("pos").alias("doc_id"), "pos", "name", F.when(F.col("pos") % 3 == 0, F.col("flag_id")).alias("item_id"))
    return resolve.with_hints(docs)


@query(
    "res_11_fill_place_and_organizer",
    """WITH u AS (SELECT trophy_id, flag_id, league_id, CASE WHEN count(DISTINCT place_id) = 1 THEN max(place_id) END AS p, CASE WHEN count(DISTINCT organizer_id) = 1 THEN max(organizer_id) END AS o FROM race GROUP BY ALL)
    SELECT r.id, coalesce(CASE WHEN r.id % 2 = 0 THEN r.place_id END, u.p) AS place_id, coalesce(r.organizer_id, u.o) AS organizer_id FROM race AS r LEFT JOIN u ON u.trophy_id IS NOT DISTINCT FROM r.trophy_id AND u.flag_id IS NOT DISTINCT FROM r.flag_id AND u.league_id IS NOT DISTINCT FROM r.league_id""",
)
def _(t):
    docs = t.race.withColumn("place_id", F.when(F.col("id") % 2 == 0, F.col("place_id")))
    return resolve.fill_place_and_organizer(docs, t.race).select("id", "place_id", "organizer_id")
