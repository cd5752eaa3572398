"""Sort orders (SRT) with the null order of the stored results: last ascending, first descending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

DEFAULT = {"race": ("date", "id"), "participant": ("race_id", "id"), "entity": ("name", "id")}


def directed(column: Column, descending: bool) -> Column:
    return column.desc_nulls_first() if descending else column.asc_nulls_last()


def race_order(by: str) -> list[Column]:
    """Order by type, date, name or league; a minus anywhere means descending, other words mean date."""
    key = by.replace("-", "")
    column = {"type": "type", "date": "date", "name": "sort_name", "league": "league_id"}.get(key, "date")
    return [directed(F.col(column), "-" in by), F.col("id")]


def sort_races(races: DataFrame, by: str, trophies: DataFrame, flags: DataFrame) -> DataFrame:
    """Races in the named order, with `sort_name`: the trophy's name, else the flag's."""
    t = trophies.select(F.col("id").alias("trophy_key"), F.col("name").alias("trophy_name"))
    f = flags.select(F.col("id").alias("flag_key"), F.col("name").alias("flag_name"))
    named = races.join(t, F.col("trophy_id") == F.col("trophy_key"), "left").join(f, F.col("flag_id") == F.col("flag_key"), "left")
    return named.withColumn("sort_name", F.coalesce("trophy_name", "flag_name")).orderBy(*race_order(by)).select(*races.columns, "sort_name")


def numbered_whole(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with `position` in the whole order: a range-partitioned sort and the row counts of the partitions before.

    The sorted rows are written once, since a second sort may cut its ranges elsewhere.
    """
    row, part, before = "sorted_row", "sorted_part", "rows_before"
    placed = df.orderBy(*order).withColumn(row, F.monotonically_increasing_id())
    placed = materialize(placed.withColumn(part, F.shiftright(row, 33)).withColumn(row, F.col(row).bitwiseAND((1 << 33) - 1)))
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    # One row for each partition of the sort, so this window is small.
    offsets = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))
    return placed.join(offsets, part).withColumn("position", F.col(before) + F.col(row) + 1).drop(row, part, before)


def default_order(df: DataFrame, table: str) -> DataFrame:
    return df.orderBy(*[directed(F.col(c), False) for c in DEFAULT[table]])


def audit_order(df: DataFrame, column: str) -> DataFrame:
    """Audit results: latest first, nulls before all."""
    return df.orderBy(directed(F.col(column), True), F.col("id"))


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The n-th row of each group in the given order; Spark limits the groups before it shuffles them."""
    return df.withColumn("group_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("group_place") == n).drop("group_place")
