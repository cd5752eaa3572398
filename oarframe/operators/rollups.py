"""Aggregations over races and their boats, and run folding (AGG-4 to AGG-15, WIN-1 to WIN-6, SET-1 to SET-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.laps import last_lap
from ..functions.metadata import add_element
from ..session import materialize
from ..sources.scans import in_years
from .joins import holding_all


def distinct_lanes(participants: DataFrame) -> DataFrame:
    """(race_id, lanes): how many lanes were used, unknown ones not counted."""
    return participants.groupBy("race_id").agg(F.count_distinct("lane").alias("lanes"))


def largest_fields(entries: DataFrame, races: DataFrame) -> DataFrame:
    """(league_id, gender, year, largest): the most boats of a race that was held, by league, race gender and year."""
    counts = entries.groupBy("race_id").agg(F.count("*").alias("boats"))
    dims = races.filter(~F.col("cancelled")).select(F.col("id").alias("race_id"), "league_id", "gender", F.year("date").alias("year"))
    return counts.join(dims, "race_id").groupBy("league_id", "gender", "year").agg(F.max("boats").alias("largest"))


def race_arrays(participants: DataFrame) -> DataFrame:
    """(race_id, clubs, times): club ids and finish times in one order, by club, then time."""
    pair = F.struct("club_id", last_lap(F.col("laps_ms")).alias("time"))
    pairs = F.sort_array(F.collect_list(pair))
    return participants.groupBy("race_id").agg(pairs.alias("p")).select("race_id", F.transform("p", lambda x: x["club_id"]).alias("clubs"), F.transform("p", lambda x: x["time"]).alias("times"))


def unanimous(column: str) -> Column:
    """An aggregate: the value if there is one row, or if all rows have it; else null."""
    c = F.col(column)
    return F.when((F.count(F.lit(1)) == 1) | ((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1)))), F.max(c))


def single_distinct(column: str) -> Column:
    """An aggregate: the value if exactly one distinct non-null value occurs; else null."""
    return F.when(F.min(column) == F.max(column), F.max(column))


def _rollup(races: DataFrame, participants: DataFrame, leagues: DataFrame, column: str, alone: bool, missing: str | None) -> DataFrame:
    seen = participants.groupBy("race_id").agg(F.count("*").alias("boats"), F.min(column).alias("low"), F.max(column).alias("high"))
    named = races.select("id", "league_id").join(leagues.select(F.col("id").alias("league_id"), F.col(column).alias("of_league")), "league_id", "left")
    joined = named.join(seen, F.col("id") == F.col("race_id"), "left")
    several = (F.col("low") != F.col("high")) | ((F.col("boats") == 1) if alone else F.lit(False))
    found = F.when(F.col("boats").isNull(), F.lit(missing)).when(several, "ALL").otherwise(F.col("high"))
    return joined.select("id", F.coalesce(F.when(F.col("of_league") != "", F.col("of_league")), found).alias(column))


def rollup_race_gender(races: DataFrame, participants: DataFrame, leagues: DataFrame) -> DataFrame:
    """(id, gender): the league's; else the boats' only one; ALL for several, or a single boat; null for none."""
    return _rollup(races, participants, leagues, "gender", True, None)


def rollup_race_category(races: DataFrame, participants: DataFrame, leagues: DataFrame) -> DataFrame:
    """(id, category): as for gender, but ALL without boats too."""
    return _rollup(races, participants, leagues, "category", True, "ALL")


def union_names(df: DataFrame, key: str, names: str) -> DataFrame:
    """(key, names): the sorted set of all names of a key."""
    return df.groupBy(key).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(names)))).alias("names"))


def participant_count_check(participants: DataFrame, documents: DataFrame) -> DataFrame:
    """(race_id, stored, expected) of races whose boats are not as many as their document's."""
    counts = participants.groupBy("race_id").agg(F.count("*").alias("n"))
    joined = documents.select("race_id", "expected").join(counts, "race_id", "left").withColumn("stored", F.coalesce("n", F.lit(0)))
    return joined.filter("stored <> expected").select("race_id", "stored", "expected")


def flag_of_run(races: DataFrame, run: str) -> DataFrame:
    """(run, flag_id) of runs that touched exactly one flag."""
    return races.groupBy(run).agg(single_distinct("flag_id").alias("flag_id")).filter("flag_id is not null")


def attach_run_source(flags: DataFrame, races: DataFrame, run: str, ref_id: Column, datasource: str) -> DataFrame:
    """flags, those that are the only one of a run with that run's reference in their metadata.

    ref_id is a column of the run; of several runs of one flag the least reference is attached.  A
    flag that has the reference already stays as it is.
    """
    only = flag_of_run(races, run).select(F.col("flag_id").alias("run_flag"), ref_id.alias("run_ref")).groupBy("run_flag").agg(F.min("run_ref").alias("run_ref"))
    kind = flags.schema["metadata"].dataType.elementType
    known = {"datasource_name": F.lit(datasource), "ref_id": F.col("run_ref")}
    new = F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
    joined = flags.join(only, F.col("id") == F.col("run_flag"), "left")
    added = F.when(F.col("run_ref").isNotNull(), add_element(F.col("metadata"), new)).otherwise(F.col("metadata"))
    return joined.withColumn("metadata", added).drop("run_flag", "run_ref")


# Windows


def distinct_in_group(df: DataFrame, column: str, keys: list[str], name: str) -> DataFrame:
    """df with the distinct non-null values of a column in each group; null keys form a group.

    The groups are counted by an aggregate, which begins before the shuffle, and joined back: a window
    would hold all rows of a group in one task.
    """
    counted = df.groupBy(*[F.col(k).alias(f"group_{k}") for k in keys]).agg(F.count_distinct(column).cast("int").alias(name))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"group_{k}"))
    return df.join(counted, same).select(*df.columns, name)


def best_candidate(df: DataFrame, query: str, score: str, *ties: str) -> DataFrame:
    """The row of the highest score of each query; ties go to the least in the given columns."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), *ties))
    return df.withColumn("candidate_place", place).filter("candidate_place = 1").drop("candidate_place")


def before_first_known(df: DataFrame, group: str, position: str, known: str) -> DataFrame:
    """Rows of each group, newest first, before the first known one; rows at the position of a known one are not before it."""
    newest = df.filter(F.col(known)).groupBy(F.col(group).alias("known_group")).agg(F.max(position).alias("known_at"))
    joined = df.join(newest, F.col(group).eqNullSafe(F.col("known_group")), "left")
    return joined.filter(F.col("known_at").isNull() | (F.col(position) > F.col("known_at"))).select(*df.columns)


def with_islands(docs: DataFrame, source: str, position: str, same: list[str], after: str | None = None) -> DataFrame:
    """docs with `island`: a number that grows, within a source, where a row differs from the one before it.

    Rows differ in any column of `same`, or if the one before has the flag `after`.  Equal positions
    are ordered by the columns of `same`; a null differs from everything.

    The rows are cut into ranges of (source, position), so one source may lie in many tasks.  Each
    range numbers its own islands; the last row and the island count of every range, one row for each
    range and source, tell the next range whether it goes on and where its numbers begin.
    """
    order = [source, position, *same]
    ended = F.coalesce(F.col(after), F.lit(False)) if after else F.lit(False)
    placed = docs.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).withColumn("ends_island", ended)
    placed = materialize(placed)  # the ranges are sampled, so they must not be cut twice
    local = Window.partitionBy("part", source).orderBy(*order)
    equal = F.lit(True)
    for c in same:
        equal = equal & F.coalesce(F.lag(c).over(local) == F.col(c), F.lit(False))
    starts = ~(equal & ~F.coalesce(F.lag("ends_island").over(local), F.lit(False)))
    numbered = placed.withColumn("starts", starts.cast("long")).withColumn("own_island", F.sum("starts").over(local.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")
    at = F.struct(position, *same)
    edge = F.struct(*same, "ends_island")
    parts = materialize(numbered.groupBy("part", source).agg(F.max("own_island").alias("islands"), F.min_by(edge, at).alias("head"), F.max_by(edge, at).alias("tail")))
    # One row for each range that a source touches: few, whatever the rows.
    ranges = Window.partitionBy(source).orderBy("part")
    goes_on = ~F.coalesce(F.lag("tail").over(ranges)["ends_island"], F.lit(True))
    for c in same:
        goes_on = goes_on & F.coalesce(F.lag("tail").over(ranges)[c] == F.col("head")[c], F.lit(False))
    joint = parts.withColumn("joined", goes_on.cast("long"))
    shift = F.sum(F.col("islands") - F.col("joined")).over(ranges.rowsBetween(Window.unboundedPreceding, 0)) - F.col("islands")
    shifted = joint.select(F.col("part").alias("of_part"), F.col(source).alias("of_source"), shift.alias("shift"))
    joined = numbered.join(shifted, (F.col("part") == F.col("of_part")) & F.col(source).eqNullSafe(F.col("of_source")))
    return joined.withColumn("island", F.col("own_island") + F.col("shift")).select(*docs.columns, "island")


def fold_consecutive(docs: DataFrame, source: str, position: str, as_of: str | None = None) -> DataFrame:
    """Runs of documents with the same name next to each other, as one race each.

    (source, name, first, ref_ids, boats, gender): ids in order, boats added up, gender ALL if it
    varies.  A document dated after as_of ends the run before it and is left out.
    """
    future = F.col("date") > F.to_date(F.lit(as_of)) if as_of else F.lit(False)
    islands = with_islands(docs.withColumn("future", F.coalesce(future, F.lit(False))), source, position, ["name"], "future").filter(~F.col("future"))
    refs = F.sort_array(F.collect_list(F.struct(F.col(position).alias("at"), F.col("ref_id"))))
    folded = islands.groupBy(source, "island").agg(
        F.min_by("name", position).alias("name"), F.min(position).alias("first"), refs.alias("refs"), F.sum("boats").alias("boats"),
        F.when(F.min("gender") != F.max("gender"), "ALL").otherwise(F.max("gender")).alias("gender"),
    )
    return folded.select(source, "name", "first", F.transform("refs", lambda r: r["ref_id"]).alias("ref_ids"), "boats", "gender")


def neighbouring_years(editions: DataFrame) -> DataFrame:
    """(item_id, year, edition, before, after): with the editions of the years next to it, where there are any."""
    shifted = lambda by, name: editions.select("item_id", (F.col("year") + by).alias("year"), F.col("edition").alias(name))
    return editions.join(shifted(1, "before"), ["item_id", "year"], "left").join(shifted(-1, "after"), ["item_id", "year"], "left")


# Sets


def scan_years(docs: DataFrame, years: list[int]) -> DataFrame:
    """The scans of several years, read in one scan of their dates; a year named twice comes twice."""
    found = docs.filter(in_years(F.col("date"), years))
    times = {y: years.count(y) for y in set(years)}
    if all(n == 1 for n in times.values()):
        return found
    copies = F.lit(1)
    for y, n in times.items():
        if n > 1:
            copies = F.when(in_years(F.col("date"), [y]), F.lit(n)).otherwise(copies)
    return found.withColumn("scanned_time", F.explode(F.sequence(F.lit(1), copies))).drop("scanned_time")


def any_alternative(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (query_id, item_id) where the item's tokens contain one of the query's alternatives.

    queries: (query_id, alternatives, an array of token arrays); items: (item_id, tokens).
    """
    each = queries.select("query_id", F.explode("alternatives").alias("tokens"))
    return holding_all(each, items, ["query_id"]).distinct()


def merge_tables(first: DataFrame, second: DataFrame, key: str, items: str) -> DataFrame:
    """(key, items): the items of two result tables of a race, those of the first before the others."""
    other = second.select(F.col(key).alias("other_key"), F.col(items).alias("other_items"))
    joined = first.select(key, items).join(other, F.col(key) == F.col("other_key"), "full")
    return joined.select(F.coalesce(key, "other_key").alias(key), F.concat(*[F.coalesce(c, F.expr("array()")) for c in (items, "other_items")]).alias(items))
