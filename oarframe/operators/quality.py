"""Data-quality rules as reports of violations: (rule, entry, row_key, detail) (DQ)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas


def report(rows: DataFrame, rule: str, table: str, key: Column, detail: Column | None = None) -> DataFrame:
    text = (F.lit(None) if detail is None else detail).cast("string")
    return rows.select(F.lit(rule).alias("rule"), F.lit(table).alias("entry"), key.cast("string").alias("row_key"), text.alias("detail"))


def repeated(df: DataFrame, keys: list[str], rule: str, table: str, nulls_count: bool = False) -> DataFrame:
    """Key values that occur more than once; rows with a null key are passed over unless they count."""
    rows = df if nulls_count else df.dropna(subset=keys)
    shown = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys])
    return report(rows.groupBy(*keys).count().filter("count > 1"), rule, table, shown, F.col("count"))


def unique_editions(races: DataFrame) -> DataFrame:
    rules = [repeated(races, [f"{k}_id", "league_id", f"{k}_edition", "modality", "day"], "unique_edition", k) for k in ("trophy", "flag")]
    return rules[0].unionByName(rules[1])


def one_race_per_league_day(races: DataFrame) -> DataFrame:
    return repeated(races.filter(F.col("same_as_id").isNull()), ["league_id", "date"], "league_day", "race")


def paired_editions(races: DataFrame) -> DataFrame:
    """A flag or trophy has an edition, and an edition its flag or trophy; 0 counts as none."""
    def broken(k: str) -> DataFrame:
        has = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
        rows = races.filter(F.col(f"{k}_id").isNotNull() != has(f"{k}_edition"))
        return report(rows, "paired_edition", k, F.col("id"))

    return broken("flag").unionByName(broken("trophy"))


def second_day_linked(races: DataFrame) -> DataFrame:
    return report(races.filter((F.col("day") == 2) & F.col("associated_id").isNull()), "second_day_linked", "race", F.col("id"))


def one_boat_per_club(participants: DataFrame, races: DataFrame) -> DataFrame:
    league = races.filter(F.col("league_id").isNotNull()).select(F.col("id").alias("race_id"))
    return repeated(participants.join(league, "race_id", "left_semi"), ["race_id", "club_id"], "one_boat", "participant")


REQUIRED = {"participant": ("datasource_name",), "race": ("ref_id", "datasource_name", "values"), "flag": ("ref_id", "datasource_name", "values"), "entity": ("ref_id", "datasource_name", "values")}
ALLOWED = {"participant": ("ref_id", "datasource_name", "values", "date", "data"), "race": ("ref_id", "datasource_name", "values", "date", "data"), "flag": ("ref_id", "ref_name", "datasource_name", "values", "date", "data"), "entity": ("ref_id", "datasource_name", "values", "date", "data")}


def metadata_shape(df: DataFrame, key: str, json: str, table: str) -> DataFrame:
    """Elements of a JSON array that lack a key, have one too many, or hold values that are not strings."""
    elements = F.from_json(F.col(json), "array<string>")
    keys = F.coalesce(F.json_object_keys("element"), F.expr("cast(array() as array<string>)"))
    constants = lambda names: F.array(*[F.lit(n) for n in names])
    values = F.from_json(F.get_json_object("element", "$.values"), "map<string,string>")
    raw = F.get_json_object("element", "$.values")
    # Every string value appears quoted in the raw text.
    unquoted = F.exists(F.map_entries(values), lambda e: ~F.contains(raw, F.concat(F.lit('":"'), F.regexp_replace(e["value"], r'(["\\])', r"\\$1"), F.lit('"'))))
    bad_values = F.array_contains(keys, "values") & (values.isNull() | F.coalesce(unquoted, F.lit(False)))
    problems = F.concat_ws(
        ";",
        F.when(F.size(F.array_except(constants(REQUIRED[table]), keys)) > 0, F.concat(F.lit("missing "), F.array_join(F.sort_array(F.array_except(constants(REQUIRED[table]), keys)), ","))),
        F.when(F.size(F.array_except(keys, constants(ALLOWED[table]))) > 0, F.concat(F.lit("extra "), F.array_join(F.sort_array(F.array_except(keys, constants(ALLOWED[table]))), ","))),
        F.when(bad_values, F.lit("values")),
    )
    rows = df.select(F.col(key).alias("k"), F.explode(elements).alias("element")).withColumn("problems", problems).filter("problems <> ''")
    return report(rows, "metadata_shape", table, F.col("k"), F.col("problems"))


def domains(races: DataFrame, participants: DataFrame, penalties: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Values outside their enumerated domain; null is inside.  Penalties are named by their boat."""
    rules = ((races, "race", "type", schemas.RACE_TYPES), (races, "race", "modality", schemas.MODALITIES), (races, "race", "gender", schemas.RACE_GENDERS), (races, "race", "category", schemas.RACE_CATEGORIES), (participants, "participant", "gender", schemas.PARTICIPANT_GENDERS), (participants, "participant", "category", schemas.PARTICIPANT_CATEGORIES))
    found = [report(df.filter(~F.col(c).isin(*values)), f"domain_{c}", table, F.col("id"), F.col(c)) for df, table, c, values in rules]
    if penalties is not None:
        found.append(report(penalties.filter(~F.col("reason").isin(*schemas.PENALTY_REASONS)), "domain_reason", "penalty", F.col("participant_id"), F.col("reason")))
    if entities is not None:
        found.append(report(entities.filter(~F.col("type").isin(*schemas.ENTITY_TYPES)), "domain_type", "entity", F.col("id"), F.col("type")))
    return reduce(DataFrame.unionByName, found)


def lost(df: DataFrame, table: str, column: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows whose column is set, but names no row of targets (id)."""
    known = targets.select(F.col("id").alias("known_id"))
    missing = df.filter(F.col(column).isNotNull()).join(known, F.col(column) == F.col("known_id"), "left_anti")
    return report(missing, f"{target}_exists", table, F.col("id"), F.col(column))


def references(participants: DataFrame, races: DataFrame, clubs: DataFrame, links: tuple = (), parts: DataFrame | None = None) -> DataFrame:
    """Boats without their race or club, or whose club is an entity of another type, and parts of partnerships that are partnerships themselves.

    links adds further references to test, as arguments of `lost`.  parts are the entities looked
    through for partnerships; without them, the clubs.
    """
    lost_race = participants.join(races.select(F.col("id").alias("race_id")), "race_id", "left_anti")
    lost_club = participants.join(clubs.select(F.col("id").alias("club_id")), "club_id", "left_anti")
    other_type = participants.join(clubs.filter(F.col("type") != "CLUB").select(F.col("id").alias("club_id"), "type"), "club_id")
    nested = (clubs if parts is None else parts).filter(F.col("fused_into").isNotNull() & F.col("is_partnership"))
    found = [report(lost_race, "race_exists", "participant", F.col("id"), F.col("race_id")), report(lost_club, "club_exists", "participant", F.col("id"), F.col("club_id")), report(nested, "part_is_no_partnership", "entity", F.col("id")), report(other_type, "club_is_a_club", "participant", F.col("id"), F.col("type"))]
    found += [lost(*link) for link in links]
    return reduce(DataFrame.unionByName, found)


def unique_names(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Repeated names, by table name: (frame, key columns)."""
    return reduce(DataFrame.unionByName, [repeated(df, keys, "unique_name", table) for table, (df, keys) in tables.items()])


def not_negative(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [report(df.filter(F.col(c) < 0), f"not_negative_{c}", table, F.col("id"), F.col(c)) for c in columns])
