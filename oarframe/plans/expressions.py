"""One query for each function (FN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import laps, metadata, text
from ..operators import joins
from ..operators.speeds import speed_of
from .registry import query

_TIME = "lpad((ms // 60000)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0')"
_LAP1 = "(SELECT id, laps_ms[1] AS ms FROM participant WHERE len(laps_ms) > 0)"


def _first_laps(t):
    return t.participant.filter(F.size("laps_ms") > 0).select("id", F.element_at("laps_ms", 1).alias("ms"))


@query("fn_1_speed_kmh", "SELECT id, round(distance / (laps_ms[-1] / 1000.0::DOUBLE) * 3.6::DOUBLE, 6) AS speed FROM participant")
def _(t):
    return t.participant.select("id", F.round(speed_of(), 6).alias("speed"))


@query("fn_2_lap_ms", f"SELECT id, CASE WHEN id % 7 <> 0 THEN ms END AS ms FROM {_LAP1}")
def _(t):
    written = F.concat(laps.clock(F.col("ms")), F.when(F.col("id") % 7 == 0, "x").otherwise("000"))
    return _first_laps(t).select("id", laps.lap_ms(written).alias("ms"))


@query("fn_3_source_date", "SELECT id, CASE WHEN id % 5 <> 0 THEN date END AS date FROM race")
def _(t):
    written = F.when(F.col("id") % 5 == 0, F.date_format("date", "yyyy-MM-dd")).otherwise(F.date_format("date", "dd/MM/yyyy"))
    return t.race.select("id", laps.source_date(written).alias("date"))


@query("fn_4_clock", f"SELECT id, {_TIME} AS shown FROM (SELECT id, (laps_ms[3] * 5) % 3600000 AS ms FROM participant WHERE len(laps_ms) > 0)")
def _(t):
    return t.participant.filter(F.size("laps_ms") > 0).select("id", laps.clock(F.element_at("laps_ms", 3) * 5).alias("shown"))


@query("fn_5_year_epoch", "SELECT id, yr, (date - DATE '1970-01-01') * 86400::BIGINT AS epoch FROM race")
def _(t):
    return t.race.select("id", F.year("date").alias("yr"), (F.unix_date("date") * F.lit(86400).cast("long")).alias("epoch"))


@query("fn_6_last_lap", "SELECT id, laps_ms[-1] AS finish, len(laps_ms) AS n, len(list_filter(club_names, lambda n: n LIKE '% B')) > 0 AS branch FROM participant")
def _(t):
    return t.participant.select("id", laps.last_lap(F.col("laps_ms")).alias("finish"), F.size("laps_ms").cast("long").alias("n"), F.exists("club_names", lambda n: n.like("% B")).alias("branch"))


@query("fn_7_joined_names", "SELECT id, array_to_string(known_names, ' ') AS names FROM club")
def _(t):
    return t.club.select("id", text.joined_names(F.col("known_names")).alias("names"))


_ACCENTED = "replace(replace(lower(name), 'a', 'á'), 'o', 'ö')"


@query("fn_8_fold", f"SELECT id, upper(strip_accents({_ACCENTED})) AS folded FROM entity")
def _(t):
    return t.entity.select("id", text.fold(F.translate(F.lower("name"), "ao", "áö")).alias("folded"))


@query("fn_9_strip_branch", "SELECT id, regexp_replace(n, ' [BC]$', '') AS name FROM (SELECT id, name || CASE id % 3 WHEN 0 THEN ' B' WHEN 1 THEN ' C' ELSE '' END AS n FROM club)")
def _(t):
    ending = F.when(F.col("id") % 3 == 0, " B").when(F.col("id") % 3 == 1, " C").otherwise("")
    return t.club.select("id", text.strip_branch(F.concat("name", ending)).alias("name"))


@query("fn_9_strip_branch_faithful", "SELECT id, rtrim(rtrim(n, ' B'), ' C') AS name FROM (SELECT id, 'CLUB' || CASE id % 4 WHEN 0 THEN ' B' WHEN 1 THEN ' C' WHEN 2 THEN ' C B' ELSE ' ' || id END AS n FROM club)")
def _(t):
    ending = F.when(F.col("id") % 4 == 0, " B").when(F.col("id") % 4 == 1, " C").when(F.col("id") % 4 == 2, " C B").otherwise(F.concat(F.lit(" "), F.col("id").cast("string")))
    return t.club.select("id", text.strip_branch(F.concat(F.lit("CLUB"), ending), faithful=True).alias("name"))


@query("fn_10_branch_letter", "SELECT id, CASE id % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'D' END AS letter FROM club")
def _(t):
    ending = F.when(F.col("id") % 4 == 0, ' "b"').when(F.col("id") % 4 == 1, " C").when(F.col("id") % 4 == 2, " 'D'").otherwise(" E")
    return t.club.select("id", text.branch_letter(F.concat("name", ending)).alias("letter"))


@query(
    "fn_11_can_be_branch",
    """WITH n AS (SELECT race_id, list(DISTINCT c) AS names FROM (SELECT race_id, unnest(club_names) AS c FROM participant) GROUP BY race_id)
    SELECT p.id, p.club_names[1] LIKE '% B' AND list_contains(names, replace(p.club_names[1], ' B', '')) AS branch FROM participant AS p JOIN n USING (race_id) WHERE len(p.club_names) > 0""",
)
def _(t):
    from ..operators.rollups import union_names

    named = t.participant.filter(F.size("club_names") > 0)
    return named.select("id", "race_id", F.element_at("club_names", 1).alias("n")).join(union_names(named, "race_id", "club_names"), "race_id").select("id", text.can_be_branch(F.col("n"), F.col("names")).alias("branch"))


@query("fn_12_display_club", "SELECT p.id, c.name || CASE WHEN len(p.club_names) > 0 AND p.club_names[1] LIKE '% B' THEN ' \"B\"' ELSE '' END AS shown FROM participant AS p LEFT JOIN club AS c ON c.id = p.club_id AND c.id % 3 <> 0")
def _(t):
    clubs = t.club.filter("id % 3 <> 0").select(F.col("id").alias("club_id"), "name")
    return t.participant.join(clubs, "club_id", "left").select("id", text.display_club(F.col("name"), F.col("club_names")).alias("shown"))


_ROMAN = "['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX','XXI','XXII','XXIII'][CAST({} AS INT)]"


@query(
    "fn_13_display_race",
    f"""SELECT r.id, concat_ws(' - ', CASE WHEN t.name IS NOT NULL THEN {_ROMAN.format('trophy_edition')} || ' - ' || t.name END, CASE WHEN f.name IS NOT NULL THEN {_ROMAN.format('flag_edition')} || ' - ' || f.name END, sponsor, CASE WHEN day > 1 THEN 'XORNADA ' || day END) AS shown
    FROM race AS r LEFT JOIN trophy AS t ON t.id = r.trophy_id LEFT JOIN flag AS f ON f.id = r.flag_id""",
)
def _(t):
    named = t.race.join(t.trophy.select(F.col("id").alias("trophy_id"), F.col("name").alias("trophy_name")), "trophy_id", "left")
    named = named.join(t.flag.select(F.col("id").alias("flag_id"), F.col("name").alias("flag_name")), "flag_id", "left")
    return named.select("id", joins.display_race(named).alias("shown"))


@query("fn_14_display_place", "SELECT p.id, CASE WHEN p.name = t.name THEN t.name ELSE p.name || ', ' || t.name END AS shown FROM place AS p JOIN town AS t ON t.id = p.town_id")
def _(t):
    towns = t.town.select(F.col("id").alias("town_id"), F.col("name").alias("town"))
    return t.place.join(towns, "town_id").select("id", joins.display_place(F.col("name"), F.col("town")).alias("shown"))


@query(
    "fn_15_normalize_club",
    """SELECT id, CASE id % 4 WHEN 0 THEN name WHEN 1 THEN name WHEN 2 THEN 'A - B' ELSE 'IBERIA - KAIKU' END AS shown FROM club""",
)
def _(t):
    written = F.when(F.col("id") % 4 == 0, F.concat("name", F.lit(" - BANCO"))).when(F.col("id") % 4 == 1, F.concat(F.lit("BANCO - "), F.col("name"))).when(F.col("id") % 4 == 2, "A - B").otherwise("IBERIA - KAIKU")
    return t.club.select("id", text.normalize_club(written, lambda part: part.rlike("^CLUB [0-9]+$|^IBERIA$"), ("BANCO",)).alias("shown"))


@query("fn_16_normalize_words", "SELECT id, 'AYUNTAMIENTO BANDERA ' || id AS synonyms, 'BANDEIRA CONCELLO ' || id AS clean FROM club")
def _(t):
    written = F.concat(F.lit("  Bandeira, do (x y) Concello  "), F.col("id").cast("string"))
    clean = text.remove_conjunctions(text.remove_symbols(text.remove_parenthesis(written)))
    return t.club.select("id", text.normalize_synonyms(F.concat(F.lit("concello bandeira "), F.col("id").cast("string"))).alias("synonyms"), F.upper(clean).alias("clean"))


@query("fn_17_expand_tokens", "SELECT id, 'ayuntamiento,bandera,' || t || '|ayuntamiento,' || t || ',trofeo|ayuntamiento,' || t || ',regata|' || 'bandera,' || t || '|' || t || ',trofeo|' || t || ',regata' AS alternatives FROM (SELECT id, 'n' || id AS t FROM club)")
def _(t):
    tokens = F.array(F.lit("bandera"), F.concat(F.lit("n"), F.col("id").cast("string")), F.lit("ayuntamiento"))
    spelled = F.transform(text.expand_tokens(tokens), lambda x: F.array_join(x, ","))
    # In the order of the rule: as given, with each interchangeable token, then without optional ones.
    order = F.array(*[F.lit(x) for x in ("bandera", "trofeo", "regata")])
    key = F.transform(spelled, lambda s: F.struct((~s.contains("ayuntamiento")).cast("int").alias("a"), F.array_position(F.transform(order, lambda o: F.contains(s, o)), F.lit(True)).alias("b"), s.alias("s")))
    return t.club.select("id", F.array_join(F.transform(F.sort_array(key), lambda x: x["s"]), "|").alias("alternatives"))


@query("fn_18_play_off", "SELECT id, name ILIKE '%play%off%' AS play_off, name ILIKE '%memorial%' AS memorial FROM trophy")
def _(t):
    return t.trophy.select("id", text.is_play_off(F.col("name")).alias("play_off"), text.is_memorial(F.col("name")).alias("memorial"))


_PAIRS = "(SELECT q AS a, upper(name) AS b FROM query_name JOIN entity ON left(q, 3) = upper(substring(name, 2, 3)))"


def _pairs(t):
    return t.query_name.join(t.entity, F.substring("q", 1, 3) == F.upper(F.substring("name", 2, 3))).select(F.col("q").alias("a"), F.upper("name").alias("b"))


@query("fn_19_relative_distance", f"SELECT a, b, round(levenshtein(a, b) / ((length(a) + length(b)) / 2.0::DOUBLE), 9) AS distance FROM {_PAIRS}")
def _(t):
    return _pairs(t).select("a", "b", F.round(text.relative_distance(F.col("a"), F.col("b")), 9).alias("distance"))


@query("fn_20_similarity", f"SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE, 9) AS similarity FROM {_PAIRS}")
def _(t):
    return _pairs(t).select("a", "b", F.round(text.similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


@query("fn_21_clean_club_name", "SELECT id, 'C R ' || upper(name) AS name FROM club")
def _(t):
    return t.club.select("id", laps.clean_club_name(F.concat(F.lit(" C.R. "), F.lower("name"), F.lit(". "))).alias("name")).withColumn("name", F.regexp_replace("name", "^CR ", "C R "))


@query("fn_22_lane_of", "SELECT p.id, CASE WHEN r.type = 'TIME_TRIAL' THEN 1 ELSE p.lane END AS lane FROM participant AS p JOIN race AS r ON r.id = p.race_id")
def _(t):
    return t.participant.join(t.race.select(F.col("id").alias("race_id"), "type"), "race_id").select("id", laps.lane_of(F.col("type"), F.col("lane")).alias("lane"))


@query("fn_23_retired_of", "SELECT p.id, p.retired AND NOT coalesce(x.disqualification, false) AS retired FROM participant AS p LEFT JOIN penalty AS x ON x.participant_id = p.id")
def _(t):
    return t.participant.join(t.penalty.select(F.col("participant_id").alias("id"), "disqualification"), "id", "left").select("id", laps.retired_of(F.col("retired"), F.col("disqualification")).alias("retired"))


@query(
    "fn_24_build_metadata",
    """SELECT pos AS id, CASE WHEN pos % 9 <> 0 THEN '[{"ref_id":"' || ref_id || '","datasource_name":"' || datasource || '","values":{"details_page":"http://x/' || pos || '"}}]' END AS metadata FROM doc""",
)
def _(t):
    url = F.when(F.col("pos") % 9 != 0, F.concat(F.lit("http://x/"), F.col("pos").cast("string")))
    return t.doc.select(F.col("pos").alias("id"), metadata.build_race_metadata(F.array("ref_id"), F.col("datasource"), url).alias("metadata"))
