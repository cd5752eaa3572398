"""Race and participant filters, and lookups that are unique, ambiguous or empty (FLT)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metadata import metadata_contains
from ..functions.text import contains_folded, is_play_off, remove_conjunctions, remove_symbols
from ..session import dealt
from ..sources.scans import in_years

ALL = "ALL"


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def filter_races(races: DataFrame, participants: DataFrame | None = None, faithful: bool = False, **by) -> DataFrame:
    """Races that meet every given test: year, day, trophy, flag, league, metadata, participant.

    Tests that are None and unknown names are ignored.  `participant` keeps races in which the club
    has a boat; the faithful form gives a race once for each of these boats.
    """
    columns = {"day": "day", "trophy": "trophy_id", "flag": "flag_id", "league": "league_id"}
    tests = [F.col(c) == by[k] for k, c in columns.items() if by.get(k) is not None]
    if by.get("year") is not None:
        tests.append(in_years(F.col("date"), [by["year"]]))
    if by.get("metadata") is not None:
        tests.append(metadata_contains(F.col("metadata"), *by["metadata"]))
    found = races.filter(all_of(tests))
    if by.get("participant") is not None:
        boats = participants.filter(F.col("club_id") == by["participant"]).select(F.col("race_id").alias("boat_race_id"))
        found = found.join(boats, F.col("id") == F.col("boat_race_id"), "inner" if faithful else "left_semi").select(*races.columns)
    return found


def keyword_search(races: DataFrame, trophies: DataFrame, flags: DataFrame, leagues: DataFrame, places: DataFrame, text: str) -> DataFrame:
    """Races whose trophy, flag, league, sponsor or place name holds the cleaned text as one piece."""
    named = races
    for dim, key in ((trophies, "trophy"), (flags, "flag"), (leagues, "league"), (places, "place")):
        named = named.join(dim.select(F.col("id").alias(f"{key}_key"), F.col("name").alias(f"{key}_text")), F.col(f"{key}_id") == F.col(f"{key}_key"), "left")
    wanted = remove_conjunctions(remove_symbols(F.lit(text)))
    hit = reduce(lambda a, b: a | b, [F.coalesce(contains_folded(F.col(c), wanted), F.lit(False)) for c in ("trophy_text", "flag_text", "league_text", "place_text", "sponsor")])
    return named.filter(hit).select(*races.columns)


def with_status(matches: DataFrame, query_key: str, match_key: str, queries: DataFrame | None = None) -> DataFrame:
    """(query_key, match_key, status) of each query: unique with its match, ambiguous or none without one."""
    counted = matches.groupBy(query_key).agg(F.count("*").alias("n"), F.min(match_key).alias(match_key))
    if queries is not None:
        counted = queries.select(query_key).distinct().join(counted, query_key, "left")
    status = F.when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return counted.select(query_key, F.when(F.col("n") == 1, F.col(match_key)).alias(match_key), status.alias("status"))


def race_by_ref(refs: DataFrame, races: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (query_id, datasource_name, ref_id, day or null): the race that has it, with its status.

    The races of a reference are not paired with those who want it: its least and largest race, of
    each day, tell whether it has none, one or several.
    """
    key = ["datasource_name", "ref_id"]
    known = refs.join(dealt(races.select(F.col("id").alias("race_id"), F.col("day").alias("race_day"))), "race_id")
    by_day = known.groupBy(*key, "race_day").agg(F.min("race_id").alias("least"), F.max("race_id").alias("most"))
    held = by_day.groupBy(*key).agg(F.collect_list(F.struct("race_day", "least", "most")).alias("held"))
    asked = F.filter("held", lambda h: F.col("day").isNull() | (h["race_day"] == F.col("day")))
    found = wanted.join(dealt(held), key, "left").select("query_id", F.transform(asked, lambda h: h["least"]).alias("least"), F.transform(asked, lambda h: h["most"]).alias("most"))
    counted = found.groupBy("query_id").agg(F.min(F.array_min("least")).alias("least"), F.max(F.array_max("most")).alias("most"))
    one = F.col("least") == F.col("most")
    return counted.select("query_id", F.when(one, F.col("least")).alias("race_id"), F.when(one, "unique").when(F.col("least").isNull(), "none").otherwise("ambiguous").alias("status"))


def ref_exists(refs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted references that some race already has."""
    return wanted.join(refs.select("datasource_name", "ref_id"), ["datasource_name", "ref_id"], "left_semi")


def active(df: DataFrame, include_deleted: bool = False) -> DataFrame:
    return df if include_deleted else df.filter("is_active")


def active_first(active_hits: DataFrame, all_hits: DataFrame, key: str) -> DataFrame:
    """Hits among active rows; for keys without any, those among all rows."""
    return active_hits.unionByName(all_hits.join(active_hits.select(key).distinct(), key, "left_anti"))


COMPETITION = ("trophy_id", "flag_id", "league_id")


def races_by_competition(races: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, race_id) of races with the same trophy, flag and league, where an absent one means none."""
    wanted = queries.select("query_id", *[F.col(c).alias(f"q_{c}") for c in COMPETITION])
    same = all_of([F.col(c).eqNullSafe(F.col(f"q_{c}")) for c in COMPETITION])
    return races.join(wanted, same).select("query_id", F.col("id").alias("race_id"))


def competition_cells(races: DataFrame) -> DataFrame:
    """(date, day, trophy_id, flag_id, league_id, held): races counted by every choice of the competition that can be asked for.

    A null part of the competition is not asked for.  held has n and the least race_id of each gender and category.
    """
    plain = ["date", "day", *COMPETITION]
    count = lambda df, n: df.groupBy(*plain, "gender", "category").agg(n.alias("n"), F.min("id").alias("id"))
    cells = count(races.filter("date is not null and day is not null"), F.count("*"))
    for c in COMPETITION:
        asked = F.when(F.col(c).isNull(), F.array(F.col(c))).otherwise(F.array(F.col(c), F.lit(None)))
        cells = cells.withColumn(c, F.explode(asked))
    return count(cells, F.sum("n")).groupBy(*plain).agg(F.collect_list(F.struct("gender", "category", "n", F.col("id").alias("race_id"))).alias("held"))


def _closest(races: DataFrame, queries: DataFrame, again: Callable[[Column], Column] | None = None) -> DataFrame:
    """closest_match; queries without a match have a second try by `again`, a test of an entry of `held`."""
    q = queries.select("query_id", *[F.col(c).alias(f"q_{c}") for c in ("date", "day", "gender", "category", *COMPETITION)])
    same = all_of([F.col(c) == F.col(f"q_{c}") for c in ("date", "day")] + [F.col(c).eqNullSafe(F.col(f"q_{c}")) for c in COMPETITION])
    met = q.join(dealt(competition_cells(races)), same, "left")
    out = []
    for name, fits in (("first", _fits_query), ("again", again)):
        hits = F.filter("held", fits) if fits else F.lit(None).cast(met.schema["held"].dataType)
        n = F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["n"])
        out += [F.sum(n).alias(f"n_{name}"), F.min(F.array_min(F.transform(hits, lambda h: h["race_id"]))).alias(f"{name}_race")]
    none = F.coalesce("n_first", F.lit(0)) == 0
    counted = met.groupBy("query_id").agg(*out).select("query_id", F.when(none, F.col("n_again")).otherwise(F.col("n_first")).alias("n"), F.when(none, F.col("again_race")).otherwise(F.col("first_race")).alias("race_id"))
    status = F.when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return counted.select("query_id", F.when(F.col("n") == 1, F.col("race_id")).alias("race_id"), status.alias("status"))


def _fits(held: Column, c: str) -> Column:
    return F.coalesce(held[c] == F.col(f"q_{c}"), F.lit(False)) | F.coalesce(held[c] == ALL, F.lit(False))


def _fits_query(held: Column) -> Column:
    return F.col("q_gender").isNull() | (_fits(held, "gender") & _fits(held, "category"))


def closest_match(races: DataFrame, queries: DataFrame) -> DataFrame:
    """The race that best fits (query_id, date, day, gender, category, trophy_id, flag_id, league_id).

    Date and day are equal; gender and category equal, or ALL in the race.  Without a gender neither
    is tested; without a category only ALL fits.  Trophy, flag and league count only where given.

    Races are counted by every choice of the competition, so a query meets one row.
    """
    return _closest(races, queries)


def closest_match_by_name(races: DataFrame, queries: DataFrame, force_gender: bool = False, force_category: bool = False) -> DataFrame:
    """closest_match, and for queries without a match a second try without the tests that are not forced.

    queries hold the competition that their names were resolved to.
    """
    if force_gender and force_category:
        return _closest(races, queries)
    if force_gender:
        return _closest(races, queries, lambda h: F.col("q_gender").isNull() | (_fits(h, "gender") & F.coalesce(h["category"] == ALL, F.lit(False))))
    return _closest(races, queries, lambda h: F.lit(True))


def closest_tiers(races: DataFrame, queries: DataFrame, force_gender: bool = False, force_category: bool = False) -> DataFrame:
    """For each query, how many races each try finds and the least of them: (query_id, n_<try>, <try>_race).

    The tries are: hint (closest_match with hint_trophy_id and hint_flag_id), full (closest_match with
    the own trophy and flag), relaxed (the same without the tests that are not forced) and exact
    (matching_race).  A query meets the races of its date and day that have its trophy, or its flag if
    it has none, once for all tries, races with equal columns as one row; a competition without trophy
    and flag is not tried.
    """
    plain = ("date", "day", "gender", "category", "league_id")
    asked = lambda hint, trophy, flag: F.when(F.col(trophy).isNotNull() | F.col(flag).isNotNull(), F.struct(F.lit(hint).alias("hinted"), F.col(trophy).cast("long").alias("q_trophy_id"), F.col(flag).cast("long").alias("q_flag_id")))
    kinds = F.array_compact(F.array(asked(False, "trophy_id", "flag_id"), asked(True, "hint_trophy_id", "hint_flag_id")))
    q = queries.select("query_id", *[F.col(c).alias(f"q_{c}") for c in plain], F.explode(kinds).alias("kind")).select("query_id", *[f"q_{c}" for c in plain], "kind.*")
    q = q.withColumn("q_by_trophy", F.col("q_trophy_id").isNotNull()).withColumn("q_item", F.coalesce("q_trophy_id", "q_flag_id"))
    key = lambda by_trophy, item: F.when(F.col(item).isNotNull(), F.struct(F.lit(by_trophy).alias("by_trophy"), F.col(item).cast("long").alias("item")))
    counted = races.groupBy(*plain, "trophy_id", "flag_id").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    held = counted.select("id", "n", *plain, "trophy_id", "flag_id", F.explode(F.array_compact(F.array(key(True, "trophy_id"), key(False, "flag_id")))).alias("key"))
    held = held.select("id", "n", *plain, "trophy_id", "flag_id", "key.*")
    pairs = dealt(q).join(held, all_of([F.col(c) == F.col(f"q_{c}") for c in ("date", "day", "by_trophy", "item")]))
    equal = lambda c: F.coalesce(F.col(c) == F.col(f"q_{c}"), F.lit(False))
    fits = lambda c: equal(c) | (F.col(c) == ALL)
    given = all_of([F.col(f"q_{c}").isNull() | equal(c) for c in COMPETITION])
    full = given & (F.col("q_gender").isNull() | (fits("gender") & fits("category")))
    forced = F.lit(True)
    if force_gender:
        forced = F.col("q_gender").isNull() | (fits("gender") & (fits("category") if force_category else F.col("category") == ALL))
    own = ~F.col("hinted")
    tries = {
        "hint": F.col("hinted") & full,
        "full": own & full,
        "relaxed": own & given & forced & F.lit(not (force_gender and force_category)),
        "exact": own & equal("gender") & equal("category") & all_of([F.col(c).eqNullSafe(F.col(f"q_{c}")) for c in COMPETITION]),
    }
    counts = [x for name, hit in tries.items() for x in (F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(f"n_{name}"), F.min(F.when(hit, F.col("id"))).alias(f"{name}_race"))]
    return pairs.groupBy("query_id").agg(*counts)


def first_unique(tiers: DataFrame, exact: bool = False) -> DataFrame:
    """(query_id, race_id, status) of closest_tiers: the hint's race if it is the only one, else that of the first own try that finds any.

    The exact try comes last, and only if asked for.
    """
    race, status = F.when(F.col("n_hint") == 1, F.col("hint_race")), F.when(F.col("n_hint") == 1, "unique")
    for name in ("full", "relaxed", "exact")[: 3 if exact else 2]:
        one, several = F.col(f"n_{name}") == 1, F.col(f"n_{name}") > 1
        race = race.when(one, F.col(f"{name}_race")).when(several, None)
        status = status.when(one, "unique").when(several, "ambiguous")
    return tiers.select("query_id", race.alias("race_id"), status.otherwise("none").alias("status"))


def matching_race(races: DataFrame, queries: DataFrame) -> DataFrame:
    """The race with the same competition, date, day, gender and category."""
    equal = ("date", "day", "gender", "category")
    q = queries.select("query_id", *[F.col(c).alias(f"q_{c}") for c in (*equal, *COMPETITION)])
    same = all_of([F.col(c) == F.col(f"q_{c}") for c in equal] + [F.col(c).eqNullSafe(F.col(f"q_{c}")) for c in COMPETITION])
    return with_status(races.join(q, same).select("query_id", F.col("id").alias("race_id")), "query_id", "race_id", queries)


def analogous_race(races: DataFrame, trophies: DataFrame, queries: DataFrame | None = None, flags: DataFrame | None = None) -> DataFrame:
    """For each race, the one of the same year and competition on the other day (2 for day 1, else 1).

    A flag counts with its edition, a trophy with its own, a league alone, each only where the race
    has it; a missing edition meets a missing one.  Play-offs are held without a league, so for them
    the other race has none; a play-off is known by its trophy's or flag's name (if flags are given)
    or its sponsor, which make up a race's display name.  queries holds other races to look for (id,
    date, day and the keys, and the sponsor where it is known).

    Races are counted by every choice of the keys that can be asked for, so a race meets one row.
    """
    keys = ["trophy_id", "trophy_edition", "flag_id", "flag_edition", "league_id"]
    use = lambda c, chosen: F.when(chosen, F.col(c)).alias(c)
    a = races if queries is None else queries
    playoff = is_play_off(F.col("sponsor")) if "sponsor" in a.columns else F.lit(False)
    playoff = F.coalesce(playoff, F.lit(False))
    for dim, kind in ((trophies, "trophy"), (flags, "flag")):
        if dim is not None:
            named = dim.filter(is_play_off(F.col("name"))).select(F.col("id").alias(f"{kind}_playoff"))
            a, playoff = a.join(named, F.col(f"{kind}_id") == F.col(f"{kind}_playoff"), "left"), playoff | F.col(f"{kind}_playoff").isNotNull()
    has_trophy, has_flag, has_league = (F.col(c).isNotNull() for c in COMPETITION)
    kind = F.when(~has_league, "any").when(playoff, "none").otherwise("same")
    other_day = F.when(F.col("day") == 2, F.lit(1)).otherwise(F.lit(2))
    wanted = a.select(
        F.col("id").alias("query_id"), F.year("date").alias("year"), other_day.alias("day"), has_trophy.alias("by_trophy"), has_flag.alias("by_flag"), kind.alias("by_league"),
        *[F.col(c) for c in keys[:4]], use("league_id", kind == "same"),
    ).select("query_id", "year", "day", "by_trophy", "by_flag", "by_league", *[F.col(c).alias(f"a_{c}") for c in keys])
    yes_or_no = lambda known: F.when(known, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    leagues = F.array(F.lit("any"), F.when(has_league, "same").otherwise("none"))
    choices = races.withColumn("by_trophy", F.explode(yes_or_no(has_trophy))).withColumn("by_flag", F.explode(yes_or_no(has_flag))).withColumn("by_league", F.explode(leagues))
    trophy, flag = F.col("by_trophy"), F.col("by_flag")
    keyed = choices.select(
        "id", F.year("date").alias("year"), "day", "by_trophy", "by_flag", "by_league", use("trophy_id", trophy), use("trophy_edition", trophy),
        use("flag_id", flag), use("flag_edition", flag), use("league_id", F.col("by_league") == "same"),
    )
    counts = keyed.groupBy("year", "day", "by_trophy", "by_flag", "by_league", *keys).agg(F.count("*").alias("n"), F.min("id").alias("race_id"))
    plain = ["year", "day", "by_trophy", "by_flag", "by_league"]
    counts = counts.select(*[F.col(c).alias(f"c_{c}") for c in plain], *keys, "n", "race_id")
    same = all_of([F.col(c) == F.col(f"c_{c}") for c in plain] + [F.col(c).eqNullSafe(F.col(f"a_{c}")) for c in keys])
    found = dealt(wanted).join(counts, same)
    return found.select("query_id", F.when(F.col("n") == 1, F.col("race_id")).alias("race_id"), F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("status"))


def participant_by(participants: DataFrame, queries: DataFrame) -> DataFrame:
    """The boat of (query_id, race_id, club_id, gender, category, branch, raw_name, has_league).

    The branch is compared null-safely; where several boats fit and the race has no league, the
    letter at the end of the raw name must be the boat's branch (B or C; any other name asks for
    boats without one).  A missing raw name decides nothing.
    """
    keys = ("race_id", "club_id", "gender", "category")
    q = queries.select("query_id", *[F.col(c).alias(f"q_{c}") for c in keys], F.col("branch").alias("q_branch"), "raw_name", "has_league")
    same = all_of([F.col(c) == F.col(f"q_{c}") for c in keys] + [F.col("branch").eqNullSafe(F.col("q_branch"))])
    pairs = dealt(q).join(participants, same, "left")
    letter = F.regexp_extract("raw_name", " ([BC])$", 1)
    fits = F.col("raw_name").isNull() | F.col("branch").eqNullSafe(F.when(letter != "", letter))
    hit = F.col("id").isNotNull() & (F.col("has_league") | fits)
    counted = pairs.groupBy("query_id").agg(F.count("id").alias("all"), F.min("id").alias("any_id"), F.count_if(hit).alias("kept"), F.min(F.when(hit, F.col("id"))).alias("kept_id"))
    alone = F.col("all") == 1
    n = F.when(alone, F.lit(1)).otherwise(F.col("kept"))
    status = F.when(n == 1, "unique").when(n > 1, "ambiguous").otherwise("none")
    return counted.select("query_id", F.when(alone, F.col("any_id")).when(n == 1, F.col("kept_id")).alias("participant_id"), status.alias("status"))


def stale_flags(flags: DataFrame, races: DataFrame, datasource: str, as_of: str, only_new: bool = False) -> DataFrame:
    """(id, ref_id) of flags of a source not checked for a month; only_new leaves out those that raced this year."""
    day = F.to_date(F.lit(as_of))
    old = flags.filter((F.col("last_checked") <= F.add_months(day, -1)) | F.col("last_checked").isNull())
    old = old.filter(metadata_contains(F.col("metadata"), datasource))
    if only_new:
        raced = races.filter(F.year("date") == F.year(day)).select(F.col("flag_id").alias("raced_id"))
        old = old.join(raced, F.col("id") == F.col("raced_id"), "left_anti")
    return old.select("id", F.explode("metadata").alias("m")).filter(F.col("m.datasource_name") == datasource).select("id", F.col("m.ref_id").alias("ref_id"))


def races_missing_participant_metadata(races: DataFrame, participants: DataFrame, refs: DataFrame, datasource: str) -> DataFrame:
    """(race_id, ref_id) of races with a boat that took part but has no metadata."""
    incomplete = participants.filter(~F.col("has_metadata") & ~F.col("absent") & ~F.col("retired")).select("race_id")
    return refs.filter(F.col("datasource_name") == datasource).join(incomplete, "race_id", "left_semi").join(races.select(F.col("id").alias("race_id")), "race_id", "left_semi").select("race_id", "ref_id")


def mixed_races_by_flag(races: DataFrame, flags: DataFrame, refs: DataFrame, datasource: str, wanted_refs: list[str]) -> DataFrame:
    """(flag_id, race_id, ref_id) of races for all genders, of flags of the source, with a wanted reference."""
    mixed = races.filter(F.col("gender") == ALL).select(F.col("id").alias("race_id"), "flag_id")
    of_source = flags.filter(metadata_contains(F.col("metadata"), datasource)).select(F.col("id").alias("flag_id"))
    return mixed.join(of_source, "flag_id", "left_semi").join(refs.filter(F.col("ref_id").isin(*wanted_refs)), "race_id").select("flag_id", "race_id", "ref_id")


def unverified_flags_without_ref_name(flags: DataFrame) -> DataFrame:
    """(id, ref_id) of flags that are not verified and whose reference has no name."""
    return flags.filter(~F.col("verified") & (F.col("id") > 0)).select("id", F.explode("metadata").alias("m")).filter(F.col("m.ref_name").isNull()).select("id", F.col("m.ref_id").alias("ref_id"))


def races_with_repeated_clubs(participants: DataFrame) -> DataFrame:
    return participants.groupBy("race_id").agg(F.count_distinct("club_id").alias("clubs"), F.count("*").alias("boats")).filter("clubs <> boats")


def not_playoff(races: DataFrame, trophies: DataFrame, by_date: bool = False) -> DataFrame:
    """Races that are no play-off, or, by date, that share no date with one."""
    playoffs = trophies.filter(F.col("name").ilike("%PLAY%")).select(F.col("id").alias("playoff_id"))
    held = races.join(playoffs, F.col("trophy_id") == F.col("playoff_id"), "left_semi")
    key = "date" if by_date else "id"
    return races.join(held.select(F.col(key).alias("playoff_key")), F.col(key) == F.col("playoff_key"), "left_anti")
