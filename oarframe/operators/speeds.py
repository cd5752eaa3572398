"""Speed analytics: the boats that count, speeds by year, n-th speeds, the sigma band (AGG-1 to AGG-3, AGG-8, FLT-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.laps import last_lap, speed_kmh
from ..session import materialize
from .filters import ALL, all_of
from .sorting import numbered_whole


def speed_of() -> Column:
    return speed_kmh(F.col("distance"), F.col("laps_ms"))


def is_branch_boat() -> Column:
    return F.exists("club_names", lambda n: n.endswith(" B"))


def speed_filter(participants: DataFrame, races: DataFrame, penalties: DataFrame, club=None, league=None, flag=None, gender="MALE", category="ABSOLUT", day=1, branch_teams=False, only_league_races=False) -> DataFrame:
    """Boats that finished a valid race, with the race's date, flag, league and year.

    Gender and category hold for boat and race; the race may also be for all, unless a league is
    given or only league races count.  branch_teams keeps B boats alone; otherwise these are left out
    unless a league or flag is asked for.
    """
    wide = league is None and not only_league_races
    race_tests = [~F.col("cancelled"), F.col("day") == day, F.col("gender").isin(gender, *[ALL] * wide), F.col("category").isin(category, *[ALL] * wide)]
    race_tests += [F.col(c) == v for c, v in (("league_id", league), ("flag_id", flag)) if v is not None]
    if only_league_races:
        race_tests.append(F.col("league_id").isNotNull())
    held = races.filter(all_of(race_tests)).select(F.col("id").alias("race_id"), "date", F.col("flag_id").alias("race_flag_id"), F.col("league_id").alias("race_league_id"))
    tests = [F.size("laps_ms") > 0, ~F.col("retired"), ~F.col("guest"), ~F.col("absent"), last_lap(F.col("laps_ms")) > 0, F.col("gender") == gender, F.col("category") == category]
    if club is not None:
        tests.append(F.col("club_id") == club)
    if branch_teams:
        tests.append(is_branch_boat())
    elif league is None and flag is None:
        tests.append(~is_branch_boat())
    out = penalties.filter("disqualification").select(F.col("participant_id").alias("id"))
    return participants.filter(all_of(tests)).join(held, "race_id").join(out, "id", "left_anti").withColumn("year", F.year("date"))


def sigma_band(df: DataFrame, column: str, k: float = 2.0, digits: int = 9) -> DataFrame:
    """Rows within k population standard deviations of the mean of the whole frame, bounds included; nulls go.

    Value and bounds are rounded alike, so that the order of summation does not decide at the edge.
    """
    stats = df.agg(F.avg(column).alias("band_mean"), F.stddev_pop(column).alias("band_sd"))
    inside = F.round(column, digits).between(F.round(F.col("band_mean") - k * F.col("band_sd"), digits), F.round(F.col("band_mean") + k * F.col("band_sd"), digits))
    return df.join(F.broadcast(stats), inside).drop("band_mean", "band_sd")  # stats is one row


def _speed_rows(boats: DataFrame, keys: list[str], normalize: bool, keep_null_speeds: bool) -> DataFrame:
    """keys and speed of the boats that count; written before the band's statistics are taken, so that the boats are joined once."""
    rows = boats.select(*keys, speed_of().alias("speed"))
    if normalize:
        return sigma_band(materialize(rows), "speed")
    return rows if keep_null_speeds else rows.filter(F.col("speed").isNotNull())


def year_speeds(boats: DataFrame, normalize: bool = False, keep_null_speeds: bool = True) -> DataFrame:
    """(year, speeds): the speeds of each year by date, fastest first within a date.

    Nulls stay, unless a band is asked for, which drops them.  A year's speeds are one array, as they
    are drawn; year_speeds_by_place has them in rows.
    """
    # A null speed sorts before all others of its date, as in a descending order with nulls first.
    item = F.struct("date", F.coalesce(-F.col("speed"), F.lit(float("-inf"))).alias("rank"), "speed")
    rows = _speed_rows(boats, ["year", "date"], normalize, keep_null_speeds)
    return rows.groupBy("year").agg(F.sort_array(F.collect_list(item)).alias("items")).select("year", F.transform("items", lambda x: x["speed"]).alias("speeds"))


def year_speeds_by_place(boats: DataFrame, normalize: bool = False, keep_null_speeds: bool = True) -> DataFrame:
    """(year, position, speed): year_speeds in rows, positions from 0, for years of any size.

    All rows are sorted in ranges and numbered through; a year's first number is taken off.
    """
    rows = _speed_rows(boats, ["year", "date"], normalize, keep_null_speeds)
    placed = materialize(numbered_whole(rows, [F.col("year"), F.col("date"), F.col("speed").desc_nulls_first()]))
    firsts = placed.groupBy(F.col("year").alias("of_year")).agg(F.min("position").alias("first"))
    joined = placed.join(firsts, F.col("year").eqNullSafe(F.col("of_year")))
    return joined.select("year", (F.col("position") - F.col("first")).cast("int").alias("position"), "speed")


def nth_speed(boats: DataFrame, index: int, normalize: bool = False, keep_null_speeds: bool = True) -> DataFrame:
    """(race_id, speed): the index-th best speed of each race, from 1; races with fewer boats are left out."""
    rows = _speed_rows(boats, ["race_id", "id"], normalize, keep_null_speeds)
    place = F.row_number().over(Window.partitionBy("race_id").orderBy(F.col("speed").desc_nulls_first(), "id"))
    return rows.withColumn("place", place).filter(F.col("place") == index).select("race_id", "speed")
