"""Join shapes with a life of their own (JOIN-9 to JOIN-18) and display views of races (FN-13, FN-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.laps import last_lap
from ..session import materialize
from ..sources.scans import in_years

GRAM = 3


def races_in_year(flags: DataFrame, races: DataFrame, year: int, raced: bool) -> DataFrame:
    """Flags that raced in a year, or that did not."""
    held = races.filter(in_years(F.col("date"), [year])).select(F.col("flag_id").alias("held_flag"))
    return flags.join(held, F.col("id") == F.col("held_flag"), "left_semi" if raced else "left_anti")


def race_view(races: DataFrame, trophies: DataFrame, flags: DataFrame, leagues: DataFrame, places: DataFrame, towns: DataFrame) -> DataFrame:
    """Races with trophy, flag, league and place (and its town) as nested structs, null where there is none."""
    where = places.join(towns.select(F.col("id").alias("town_key"), F.struct("id", "name", "province").alias("town")), F.col("town_id") == F.col("town_key"), "left").select("id", "name", "town")
    out = races
    for dim, name in ((trophies.select("id", "name"), "trophy"), (flags.select("id", "name"), "flag"), (leagues.select("id", "name", "symbol"), "league"), (where, "place")):
        nested = dim.select(F.col("id").alias(f"{name}_key"), F.struct(*dim.columns).alias(name))
        out = out.join(nested, F.col(f"{name}_id") == F.col(f"{name}_key"), "left").drop(f"{name}_key")
    return out


def nest_children(races: DataFrame, participants: DataFrame, penalties: DataFrame) -> DataFrame:
    """(id, participants): each race's boats in order, each with its penalties; empty arrays where there are none."""
    fines = penalties.groupBy(F.col("participant_id").alias("fined")).agg(F.sort_array(F.collect_list(F.struct("disqualification", "reason"))).alias("penalties"))
    boats = participants.join(fines, F.col("id") == F.col("fined"), "left")
    items = F.struct(F.col("id"), F.col("club_id"), F.coalesce("penalties", F.expr("cast(array() as array<struct<disqualification:boolean,reason:string>>)")).alias("penalties"))
    grouped = boats.groupBy("race_id").agg(F.sort_array(F.collect_list(items)).alias("participants"))
    kind = grouped.schema["participants"].dataType.simpleString()
    return races.select("id").join(grouped, F.col("id") == F.col("race_id"), "left").select("id", F.coalesce("participants", F.expr(f"cast(array() as {kind})")).alias("participants"))


def link_days(races: DataFrame) -> DataFrame:
    """(id, associated_id): first and second days of one event, in both directions.

    Flag, its edition and the league are equal; the trophy and its edition too, unless the first day
    has none; a flag is needed, as a null equals nothing.
    """
    keys = ["yr", "flag_id", "flag_edition", "league_id"]
    first = races.filter("day = 1").select("id", F.year("date").alias("yr"), *keys[1:], "trophy_id", "trophy_edition")
    second = races.filter("day = 2").select(F.col("id").alias("second_id"), F.year("date").alias("yr"), *keys[1:], F.col("trophy_id").alias("t2"), F.col("trophy_edition").alias("e2"))
    fits = (F.col("trophy_id").isNull() | (F.col("trophy_id") == F.col("t2"))) & (F.col("trophy_edition").isNull() | (F.col("trophy_edition") == F.col("e2")))
    pairs = first.join(second, keys).filter(fits)
    return pairs.select("id", F.col("second_id").alias("associated_id")).unionByName(pairs.select(F.col("second_id").alias("id"), F.col("id").alias("associated_id")))


def match_by_time(documents: DataFrame, participants: DataFrame) -> DataFrame:
    """(doc_id, participant_id): the boat of (doc_id, race_id, time) with that finish time, school boats first, then the least id."""
    timed = participants.select(F.col("id").alias("participant_id"), "race_id", last_lap(F.col("laps_ms")).alias("time"), (F.col("category") != "SCHOOL").alias("later"))
    pairs = documents.join(timed, ["race_id", "time"])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("later", "participant_id"))
    return pairs.withColumn("place", place).filter("place = 1").select("doc_id", "participant_id")


def pair_in_order(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id): rows with equal keys (null-safe) paired by their order, each used once."""
    def numbered(df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("pair_place", F.row_number().over(Window.partitionBy(*keys).orderBy(key)))

    a = numbered(left.select(left_id, *keys), left_id)
    b = numbered(right.select(right_id, *keys), right_id).select(F.col(right_id), F.col("pair_place").alias("other_place"), *[F.col(k).alias(f"other_{k}") for k in keys])
    same = F.col("pair_place") == F.col("other_place")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"other_{k}"))
    return a.join(b, same).select(left_id, right_id)


def greedy_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right) of the pairs that a loop would choose: each left row in its order takes the first right row that is free.

    pairs: (left, left_order, right, right_order), one row for each two that fit; equal orders go by
    the rows' own values, and repeated pairs count once.

    Each round fixes all pairs whose two rows are each other's first choice among what is left: no
    earlier row can take either.  The others go on without the rows that are taken.  Rows of separate
    groups are fixed side by side, so the rounds are as many as the longest row of choices that wait
    for each other, which is at most the number of boats of a club in a race, not of all rows.
    """
    by_left, by_right = F.struct("right_order", right), F.struct("left_order", left)
    open_pairs = materialize(pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(left, "left_order", right, "right_order").distinct())
    fixed = open_pairs.select(left, right).limit(0)
    while not open_pairs.isEmpty():
        first_right = open_pairs.groupBy(left).agg(F.min_by(right, by_left).alias(right))
        first_left = open_pairs.groupBy(right).agg(F.min_by(left, by_right).alias(left))
        chosen = materialize(first_right.join(first_left, [left, right]).select(left, right))
        fixed = fixed.unionByName(chosen)
        open_pairs = materialize(open_pairs.join(chosen.select(left), left, "left_anti").join(chosen.select(right), right, "left_anti"))
    return fixed


def match_participants(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, doc_id): the document's boat that each stored boat gets, each used once.

    rows: id, race_id, club_id, gender, category, branch; documents: doc_id, pos and the same keys,
    with `letter` (B, C, D or null) of the boat's name.  Race, club, gender and category are equal; a
    stored boat with a branch needs its letter, one without takes any.  Stored boats choose by id, the
    document's boats are offered by pos.
    """
    keys = ["race_id", "club_id", "gender", "category"]
    offered = documents.select(*keys, "letter", "doc_id", F.col("pos").alias("right_order"))
    fits = F.col("branch").isNull() | F.coalesce(F.col("branch") == F.col("letter"), F.lit(False))
    met = rows.select("id", F.col("id").alias("left_order"), "branch", *keys).join(offered, keys).filter(fits)
    return greedy_pairs(met, "id", "doc_id")


def partnership_edges(clubs: DataFrame) -> DataFrame:
    """(target_id, part_id, is_active): clubs that were fused, as parts of what they became."""
    return clubs.filter(F.col("fused_into").isNotNull()).select(F.col("fused_into").alias("target_id"), F.col("id").alias("part_id"), "is_active")


def mark_partnerships(clubs: DataFrame) -> DataFrame:
    """Clubs, those marked as partnerships that others were fused into."""
    targets = partnership_edges(clubs).select(F.col("target_id").alias("fused_target")).distinct()
    return clubs.join(targets, F.col("id") == F.col("fused_target"), "left").withColumn("is_partnership", F.col("is_partnership") | F.col("fused_target").isNotNull()).drop("fused_target")


def grams(text: Column, n: int = GRAM) -> Column:
    """The distinct character n-grams of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))


def substring_pairs(parts: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (query_id, part, entity_id, text) where the part occurs in the text.

    parts: (query_id, part); names: (entity_id, text).  A part of three letters or more meets a text
    over its rarest three-letter sequence, counted in the texts, and is then looked for; shorter
    parts, which have no such sequence, are compared with the distinct texts.
    """
    texts = names.select("text").distinct()
    keyed = texts.filter(F.length("text") >= GRAM).select("text", F.explode(grams(F.col("text"))).alias("gram"))
    common = keyed.groupBy("gram").agg(F.count("*").alias("uses"))
    distinct = parts.select("part").distinct()
    each = distinct.filter(F.length("part") >= GRAM).select("part", F.explode(grams(F.col("part"))).alias("gram")).join(common, "gram", "left")
    rarest = each.groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("uses", F.lit(0)), "gram")).alias("gram"))
    long = rarest.join(keyed, "gram").filter(F.contains("text", F.col("part"))).select("part", "text")
    short = distinct.filter((F.length("part") < GRAM) & (F.length("part") > 0)).withColumn("gram", F.col("part"))
    pieces = [texts.select("text", F.explode(grams(F.col("text"), n)).alias("gram")).filter(F.length("text") >= n) for n in range(1, GRAM)]
    brief = short.join(pieces[0].unionByName(pieces[1]), "gram").select("part", "text").distinct()
    return parts.join(long.unionByName(brief), "part").join(names, "text").select("query_id", "part", "entity_id", "text").distinct()


def holding_all(wanted: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item_id) of wanted (keys, tokens) and items (item_id, tokens) that have all the wanted tokens.

    A wanted set meets the items over its rarest token alone, counted in the items, and the rest is
    tested on the arrays.  So a token that nearly all items have joins no rows, unless it is all that
    is wanted; then all of them are the result.  Sets without tokens, or with one that no item has,
    match nothing.
    """
    sets = wanted.select(*keys, F.array_distinct("tokens").alias("all_wanted")).filter(F.size("all_wanted") > 0)
    held = items.select("item_id", F.array_distinct("tokens").alias("own_tokens"))
    listed = held.select("item_id", "own_tokens", F.explode("own_tokens").alias("token"))
    uses = materialize(listed.groupBy("token").agg(F.count("*").alias("uses")))
    each = sets.select("all_wanted").distinct().select("all_wanted", F.explode("all_wanted").alias("token")).join(uses, "token")
    rarest = each.groupBy("all_wanted").agg(F.min_by("token", F.struct("uses", "token")).alias("token"), F.count("*").alias("known")).filter(F.col("known") == F.size("all_wanted"))
    found = rarest.join(listed, "token").filter(F.size(F.array_except("all_wanted", "own_tokens")) == 0).select("all_wanted", "item_id")
    return sets.join(materialize(found), "all_wanted").select(*keys, "item_id")


def containing_tokens(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, item_id): items that have all tokens of the query; queries without tokens match nothing."""
    return holding_all(queries.select("query_id", "tokens"), items, ["query_id"])


ROMAN = (("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1))


def roman(number: Column) -> Column:
    """Roman numerals of 1 to 3999; null outside."""
    text, left = F.lit(""), number
    for letter, value in ROMAN:
        text = F.concat(text, F.repeat(F.lit(letter), F.floor(left / value).cast("int")))
        left = left % value
    return F.when(number.between(1, 3999), text)


def display_race(view: DataFrame) -> Column:
    """`III - TROFEO - I - BANDERA - SPONSOR - XORNADA 2` of a race with trophy and flag names, parts that are missing left out."""
    named = lambda edition, name: F.when(F.col(name).isNotNull(), F.concat_ws(" - ", roman(F.col(edition)), F.col(name)))
    day = F.when(F.col("day") > 1, F.concat(F.lit("XORNADA "), F.col("day").cast("string")))
    text = F.concat_ws(" - ", named("trophy_edition", "trophy_name"), named("flag_edition", "flag_name"), F.col("sponsor"), day)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def display_place(place: Column, town: Column) -> Column:
    """`place, town`; the town alone where both are the same or the place is missing."""
    return F.when(place.isNull() | (place == town), town).when(town.isNull(), place).otherwise(F.concat(place, F.lit(", "), town))
