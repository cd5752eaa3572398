"""Audits: rows that look wrong (AUD)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.laps import last_lap
from ..session import materialize
from ..sources.scans import in_years
from .filters import not_playoff
from .rollups import distinct_in_group, distinct_lanes, largest_fields, race_arrays
from .speeds import is_branch_boat, speed_of


def lanes_in_time_trials(races: DataFrame, participants: DataFrame, trophies: DataFrame) -> DataFrame:
    """(id, race_id): boats of time trials with more than one lane, play-offs aside."""
    trials = not_playoff(races, trophies).filter(F.col("type") == "TIME_TRIAL").select(F.col("id").alias("race_id"))
    several = distinct_lanes(participants).filter("lanes > 1").select("race_id")
    return participants.join(trials, "race_id", "left_semi").join(several, "race_id", "left_semi").select("id", "race_id")


def without_laps(races: DataFrame, participants: DataFrame, penalties: DataFrame) -> DataFrame:
    """(id, race_id, metadata): boats without times that took part in a held race and have no penalty."""
    held = races.filter(~F.col("cancelled")).select(F.col("id").alias("race_id"), "metadata")
    boats = participants.filter((F.size("laps_ms") == 0) & ~F.col("absent") & ~F.col("retired"))
    fined = penalties.select(F.col("participant_id").alias("id"))
    return boats.join(fined, "id", "left_anti").join(held, "race_id").select("id", "race_id", "metadata")


def varying(races: DataFrame, trophies: DataFrame, measure: str = "laps") -> DataFrame:
    """(id, measure): races, play-offs aside, whose competition was held with several values of the measure.

    Time trials neither count nor appear.  Play-offs count for the variation, so the groups are formed
    before they leave.
    """
    keys = ["gender", "type", *[k for k in ("place_id", "league_id", "trophy_id", "flag_id") if k != measure]]
    counted = distinct_in_group(races.filter(F.col("type") != "TIME_TRIAL"), measure, keys, "kinds")
    return not_playoff(counted, trophies).filter("kinds > 1").select("id", measure)


def lane_count_differs(races: DataFrame, participants: DataFrame, trophies: DataFrame) -> DataFrame:
    """(id, lanes, used): races, play-offs aside, that used another number of lanes than stored.

    At least two boats need a lane; races without a stored number are not reported.
    """
    used = participants.groupBy("race_id").agg(F.count_distinct("lane").alias("used"), F.count("lane").alias("laned")).filter("laned > 1")
    return not_playoff(races, trophies).join(used, F.col("id") == F.col("race_id")).filter("lanes <> used").select("id", "lanes", "used")


def field_size_differs(races: DataFrame, participants: DataFrame, trophies: DataFrame, excluded_leagues: tuple = (14, 15)) -> DataFrame:
    """(id, boats, largest): league races whose boats, guests aside, are not as many as in the largest race.

    Dates of play-offs are left out.  A race with guests alone has no boat; a league, gender and year
    without any boat has no largest race and is not reported.
    """
    entries = participants.filter(~F.col("guest"))
    counts = entries.groupBy(F.col("race_id").alias("counted_race")).agg(F.count("*").alias("n"))
    largest = largest_fields(entries, races)
    held = not_playoff(races, trophies, by_date=True).filter(~F.col("cancelled") & F.col("league_id").isNotNull() & ~F.col("league_id").isin(*excluded_leagues))
    joined = held.withColumn("year", F.year("date")).join(counts, F.col("id") == F.col("counted_race"), "left").withColumn("boats", F.coalesce("n", F.lit(0)))
    return joined.join(largest, ["league_id", "gender", "year"]).filter("boats <> largest").select("id", "boats", "largest")


def tied(participants: DataFrame, resolution_ms: int = 1) -> DataFrame:
    """(id, race_id): boats with a positive time whose clock time another boat of the race shows too."""
    clock = F.floor(F.pmod(last_lap(F.col("laps_ms")), F.lit(3600000)) / resolution_ms)
    timed = participants.filter(F.size("laps_ms") > 0).select("id", "race_id", last_lap(F.col("laps_ms")).alias("time"), clock.alias("clock"))
    shared = timed.groupBy("race_id", "clock").agg(F.count_distinct("id").alias("boats")).filter("boats > 1").select("race_id", "clock")
    return timed.filter("time > 0").join(shared, ["race_id", "clock"], "left_semi").select("id", "race_id")


def _result_arrays(participants: DataFrame, club: Column | None, time: Column | None) -> DataFrame:
    boats = participants
    if club is not None:
        boats = boats.withColumn("club_id", club)
    if time is not None:
        boats = boats.withColumn("laps_ms", F.array(time))
    return race_arrays(boats)


def identical_results(races: DataFrame, participants: DataFrame, club: Column | None = None, time: Column | None = None) -> DataFrame:
    """(id, other_id): races with the same clubs and times, where the other is not marked as the same.

    A boat without laps has a null time, which equals other null times.  A pair is left out only if
    the second race is marked as the same as the first.  A group of n equal races has n * (n - 1)
    pairs; identical_groups gives the groups.
    """
    marked = _result_arrays(participants, club, time).join(races.select(F.col("id").alias("race_id"), "same_as_id"), "race_id")
    other = marked.select(F.col("race_id").alias("other_id"), F.col("same_as_id").alias("other_same"), "clubs", "times")
    pairs = marked.join(other, ["clubs", "times"]).filter((F.col("race_id") != F.col("other_id")) & (F.col("other_same").isNull() | (F.col("other_same") != F.col("race_id"))))
    return pairs.select(F.col("race_id").alias("id"), "other_id")


def identical_groups(races: DataFrame, participants: DataFrame, club: Column | None = None, time: Column | None = None) -> DataFrame:
    """(id, group_id, races, pairs): each race whose clubs and times another race has too, with the least race of its group.

    races is the size of the group, pairs how many pairs identical_results gives for it.  One row a
    race, however large the groups are: these meet by a digest of the arrays and the arrays, in an
    aggregate that begins before the shuffle, and the races are joined back to their group.
    """
    arrays = _result_arrays(participants, club, time).join(races.select(F.col("id").alias("race_id"), "same_as_id"), "race_id")
    keyed = materialize(arrays.select("race_id", "same_as_id", F.xxhash64("clubs", "times").alias("digest"), "clubs", "times"))
    keys = ["digest", "clubs", "times"]
    groups = materialize(keyed.groupBy(*keys).agg(F.min("race_id").alias("group_id"), F.count("*").alias("races")).filter("races > 1"))
    of_group = materialize(keyed.join(groups, keys).select("race_id", "same_as_id", "group_id", "races"))
    # A mark leaves out one pair if it names another race of its own group.
    inside = of_group.select(F.col("race_id").alias("named"), F.col("group_id").alias("named_group"))
    marked = of_group.filter(F.col("same_as_id") != F.col("race_id")).join(inside, (F.col("same_as_id") == F.col("named")) & (F.col("group_id") == F.col("named_group")), "left_semi")
    marks = materialize(marked.groupBy("group_id").agg(F.count("*").alias("marks")))
    pairs = F.col("races") * (F.col("races") - 1) - F.coalesce("marks", F.lit(0))
    return of_group.join(marks, "group_id", "left").select(F.col("race_id").alias("id"), "group_id", "races", pairs.alias("pairs"))


def linked_groups(races: DataFrame, participants: DataFrame, club: Column | None = None, time: Column | None = None) -> DataFrame:
    """(id, group_id, races, links, pairs, same_id): each race whose clubs and times another race has too, with its links.

    links is in how many pairs of identical_results the race comes first, pairs the sum over its group,
    same_id the race of its group that it is marked as the same as (else null).  group_id and same_id say
    which pairs there are (pairs_of_groups).  races counts ids: an id that occurs twice is no twin of
    itself.  One row for each row of races, however large the groups are.
    """
    arrays = _result_arrays(participants, club, time).join(races.select(F.col("id").alias("race_id"), "same_as_id"), "race_id")
    keyed = materialize(arrays.select("race_id", "same_as_id", F.xxhash64("clubs", "times").alias("digest"), "clubs", "times"))
    keys = ["digest", "clubs", "times"]
    groups = keyed.groupBy(*keys).agg(F.min("race_id").alias("group_id"), F.count_distinct("race_id").alias("races"), F.count("*").alias("n")).filter("races > 1")
    of_group = materialize(keyed.join(groups, keys).select("race_id", "same_as_id", "group_id", "races", "n"))
    own = materialize(of_group.groupBy("group_id", "race_id").agg(F.count("*").alias("own")))
    naming = of_group.filter(F.col("same_as_id") != F.col("race_id"))
    marks = naming.groupBy("group_id", F.col("same_as_id").alias("race_id")).agg(F.count("*").alias("marks"))
    named = own.select("group_id", F.col("race_id").alias("same_id"))
    inside = (F.col("o.group_id") == F.col("named.group_id")) & (F.col("same_as_id") == F.col("same_id")) & (F.col("same_as_id") != F.col("race_id"))
    with_same = of_group.alias("o").join(named.alias("named"), inside, "left").select("o.*", "same_id")
    linked = with_same.join(own, ["group_id", "race_id"]).join(marks, ["group_id", "race_id"], "left")
    linked = materialize(linked.select(F.col("race_id").alias("id"), "group_id", "races", (F.col("n") - F.col("own") - F.coalesce("marks", F.lit(0))).alias("links"), "same_id"))
    return linked.join(linked.groupBy("group_id").agg(F.sum("links").alias("pairs")), "group_id").select("id", "group_id", "races", "links", "pairs", "same_id")


def pairs_of_groups(linked: DataFrame) -> DataFrame:
    """(id, other_id): the pairs of identical_results, from the rows of linked_groups; n * (n - 1) for a group of n."""
    other = linked.select("group_id", F.col("id").alias("other_id"), F.col("same_id").alias("other_same"))
    pairs = linked.select("group_id", "id").join(other, "group_id")
    return pairs.filter((F.col("id") != F.col("other_id")) & (F.col("other_same").isNull() | (F.col("other_same") != F.col("id")))).select("id", "other_id")


def league_speeds(races: DataFrame, participants: DataFrame, penalties: DataFrame, league_id: int, year: int) -> DataFrame:
    """(id, race_id, year, speed): all speeds of a league's year in held races, B boats and disqualified ones aside.

    Boats without a positive last time are left out.  Rows come by descending speed, boats of unknown
    speed first, then id.
    """
    of_year = (F.col("league_id") == league_id) & in_years(F.col("date"), [year]) & ~F.col("cancelled")
    held = races.filter(of_year).select(F.col("id").alias("race_id"), F.year("date").alias("year"))
    out = penalties.filter("disqualification").select(F.col("participant_id").alias("id"))
    boats = participants.filter((F.size("laps_ms") > 0) & (last_lap(F.col("laps_ms")) > 0) & ~is_branch_boat())
    speeds = boats.join(held, "race_id").join(out, "id", "left_anti").select("id", "race_id", "year", speed_of().alias("speed"))
    return speeds.orderBy(F.col("speed").desc_nulls_first(), "id")
