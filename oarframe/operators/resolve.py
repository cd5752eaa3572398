"""Resolution of names to entities, competitions, editions, leagues and places (RES).

Distinct names are resolved once; the cheap pass comes first and only what it leaves goes on.  Every
result has a status (unique, ambiguous or none) instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import expand_tokens, fold, is_memorial, is_play_off, name_tokens, normalize_synonyms, relative_distance, remove_conjunctions, remove_parenthesis, remove_symbols, similarity, strip_branch
from ..schemas import ENTITY_TYPES
from ..session import dealt, materialize
from .filters import active_first, closest_tiers, first_unique
from .joins import containing_tokens, substring_pairs
from .rollups import any_alternative, best_candidate, single_distinct

LEAST_SIMILARITY, MOST_DISTANCE, LEAST_COMPETITION_SIMILARITY = 0.4, 0.4, 0.85


def entity_names(entities: DataFrame, with_name: bool = True) -> DataFrame:
    """(entity_id, text): every folded name an entity goes by; its plain name only if with_name."""
    names = F.array_union(F.array("normalized_name"), F.coalesce("known_names", F.expr("cast(array() as array<string>)")))
    names = F.array_union(F.array("name"), names) if with_name else names
    return entities.select(F.col("id").alias("entity_id"), F.explode(F.array_distinct(names)).alias("n")).filter("n is not null").select("entity_id", fold(F.col("n")).alias("text")).distinct()


def search_words(text: Column) -> Column:
    """The distinct words of a name without symbols and conjunctions."""
    return F.array_distinct(F.filter(F.split(remove_conjunctions(remove_symbols(text)), " "), lambda w: w != ""))


def resolve_entity(queries: DataFrame, entities: DataFrame, faithful: bool = False, entity_type: str | None = None) -> DataFrame:
    """(q, entity_id, status) of the distinct names q, among entities of entity_type where it is given.

    A folded name that exactly one entity has is taken.  Otherwise entities are candidates if some
    word of the name, symbols and conjunctions aside, occurs in their normalized or a known name; the
    most similar of these names wins if its similarity is over 0.4 and it is equal or nearer than 0.4
    of the mean length; it is ambiguous if several entities have it.  A type that is not one of the
    entity types raises ValueError.
    """
    if entity_type is not None:
        if entity_type not in ENTITY_TYPES:
            raise ValueError(f"entity_type must be one of {ENTITY_TYPES}")
        entities = entities.filter(F.col("type") == entity_type)
    exact_names, names = entity_names(entities), entity_names(entities, with_name=False)
    wanted = queries.select("q").distinct().withColumn("text", fold(strip_branch(F.trim(F.upper("q")), faithful)))
    exact = materialize(wanted.join(exact_names, "text").groupBy("q").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id")).filter("n = 1").select("q", "entity_id"))
    left = wanted.join(exact, "q", "left_anti")
    parts = left.select(F.col("text").alias("query_id"), F.explode(search_words(F.col("text"))).alias("part")).distinct()
    found = materialize(substring_pairs(materialize(parts), names).select("query_id", "entity_id").distinct())
    # Nearer than 0.4 of the mean length is more alike than 0.6, so what is less alike can neither win nor keep another from
    # winning; lengths that differ by more than 0.4 of the longer one rule that out before the names are compared.
    a, b = F.length("query_id"), F.length("text")
    alike = 1 - MOST_DISTANCE - 1e-9
    compared = found.join(names, "entity_id").filter(F.least(a, b) >= F.greatest(a, b) * alike)
    scored = compared.withColumn("score", similarity(F.col("query_id"), F.col("text"))).filter(F.col("score") >= max(alike, LEAST_SIMILARITY))
    top = scored.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("less"), "text", "entity_id")).alias("top"))
    best = top.select("query_id", "top.text", "top.entity_id", (-F.col("top.less")).alias("score")).filter((F.col("score") == 1) | (relative_distance(F.col("query_id"), F.col("text")) < MOST_DISTANCE))
    holders = names.groupBy("text").agg(F.count("*").alias("holders"))
    near = left.join(best.select("query_id", F.col("text").alias("winner"), F.col("entity_id").alias("near_id")), F.col("text") == F.col("query_id")).select("q", "winner", "near_id").join(holders.withColumnRenamed("text", "winner"), "winner")
    near = near.select("q", F.when(F.col("holders") == 1, F.col("near_id")).alias("entity_id"), F.when(F.col("holders") == 1, "unique").otherwise("ambiguous").alias("status"))
    answered = exact.withColumn("status", F.lit("unique")).unionByName(near)
    return wanted.select("q").join(answered, "q", "left").select("q", "entity_id", F.coalesce("status", F.lit("none")).alias("status"))


def resolve_club(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """resolve_entity among active clubs; names without any there, among all clubs."""
    first = resolve_entity(queries, entities.filter("is_active"), entity_type="CLUB").filter("status <> 'none'")
    return active_first(first, resolve_entity(queries.join(first.select("q"), "q", "left_anti"), entities, entity_type="CLUB"), "q")


def retrieve_entity(queries: DataFrame, entities: DataFrame, normalized) -> tuple[DataFrame, DataFrame]:
    """Resolved (q, entity_id) and the names left for review; normalized is a function of the name column."""
    cleaned = queries.select("q").distinct().withColumn("clean", normalized(F.col("q")))
    found = resolve_club(cleaned.select(F.col("clean").alias("q")), entities).withColumnRenamed("q", "clean")
    joined = cleaned.join(found, "clean", "left")
    return joined.filter("status = 'unique'").select("q", "entity_id"), joined.filter("status <> 'unique'").select("q", "status")


def resolve_by_tokens(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(q, item_id) of competition names, by tokens, alternatives of tokens, and similarity.

    items: (item_id, name, tokens).  First, exactly one item has all tokens of the name.  Then, one
    has all tokens of an alternative, or, of several, one has the token ayuntamiento, or one has no
    token beyond an alternative.  Last, every word of the name occurs in the item's name and the
    names are alike to 0.85 with synonyms replaced.
    """
    wanted = queries.select("q").distinct().withColumn("tokens", name_tokens(F.col("q")))
    keyed = wanted.select(F.col("q").alias("query_id"), "tokens")
    one = lambda pairs: pairs.groupBy("query_id").agg(F.count("*").alias("n"), F.min("item_id").alias("item_id")).filter("n = 1").select("query_id", "item_id")
    first = materialize(one(containing_tokens(keyed, items)))
    left = materialize(keyed.join(first, "query_id", "left_anti").withColumn("alternatives", expand_tokens(F.col("tokens"))))
    wide = materialize(any_alternative(left, items))
    second = one(wide)
    several = wide.join(second.select("query_id"), "query_id", "left_anti").join(items.select("item_id", F.col("tokens").alias("own")), "item_id").join(left, "query_id")
    council = one(several.filter(F.array_contains("own", "ayuntamiento")))
    within = one(several.filter(F.exists("alternatives", lambda a: F.size(F.array_except("own", a)) == 0)).join(council.select("query_id"), "query_id", "left_anti"))
    done = materialize(first.unionByName(second).unionByName(council).unionByName(within))
    rest = materialize(keyed.join(done, "query_id", "left_anti"))
    if rest.isEmpty():
        return done.withColumnRenamed("query_id", "q")
    folded = rest.select("query_id", F.array_distinct(F.split(fold(F.col("query_id")), " ")).alias("words"))
    parts = folded.select("query_id", F.explode("words").alias("part")).filter("part <> ''")
    hits = materialize(substring_pairs(materialize(parts.distinct()), items.select(F.col("item_id").alias("entity_id"), fold(F.col("name")).alias("text"))))
    all_words = hits.groupBy("query_id", "entity_id", "text").agg(F.count_distinct("part").alias("n")).join(folded, "query_id").filter(F.col("n") == F.size(F.filter("words", lambda w: w != "")))
    scored = all_words.withColumn("score", similarity(normalize_synonyms(F.col("query_id")), normalize_synonyms(F.col("text")))).filter(F.col("score") >= LEAST_COMPETITION_SIMILARITY)
    last = best_candidate(scored, "query_id", "score", "text", "entity_id").select("query_id", F.col("entity_id").alias("item_id"))
    return done.unionByName(last).withColumnRenamed("query_id", "q")


def name_hits(names: DataFrame, trophies: DataFrame, flags: DataFrame) -> DataFrame:
    """names (doc_id, pos, q and others) with trophy_hit and flag_hit: what each name resolves to.

    Memorial names count only where a document has no other.
    """
    counts = names.groupBy("doc_id").agg(F.count("*").alias("names"))
    found = dealt(names).join(counts, "doc_id").filter((F.col("names") == 1) | ~is_memorial(F.col("q"))).drop("names")
    distinct = materialize(found.select("q").distinct())
    for items, kind in ((trophies, "trophy"), (flags, "flag")):
        found = found.join(materialize(resolve_by_tokens(distinct, items)).withColumnRenamed("item_id", f"{kind}_hit"), "q", "left")
    return found


def resolve_competition(names: DataFrame, trophies: DataFrame, flags: DataFrame) -> DataFrame:
    """(doc_id, trophy_id, flag_id) of documents' names (doc_id, pos, q): the first name that hits wins for each kind.

    Memorial names count only where a document has no other.
    """
    found = name_hits(names, trophies, flags)
    first = lambda kind: F.min_by(f"{kind}_hit", F.when(F.col(f"{kind}_hit").isNotNull(), F.col("pos"))).alias(f"{kind}_id")
    return names.select("doc_id").distinct().join(found.groupBy("doc_id").agg(first("trophy"), first("flag")), "doc_id", "left")


def named_competition(names: DataFrame, trophies: DataFrame, flags: DataFrame) -> DataFrame:
    """(doc_id, names_trophy, trophy_names_edition, names_flag, flag_names_edition, any_edition) of names (doc_id, pos, q, edition).

    For each kind the first name that hits, and the first edition given by that name or a later one;
    any_edition is the first given by any name.  An edition of 0 is none.  Memorial names count only
    where a document has no other.
    """
    row = F.struct("pos", F.nullif(F.col("edition"), F.lit(0)).alias("edition"), "trophy_hit", "flag_hit")
    listed = name_hits(names, trophies, flags).groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("n"))
    edition_from = lambda start: F.get(F.filter("n", lambda x: (x["pos"] >= start) & x["edition"].isNotNull()), F.lit(0))["edition"]
    out = [edition_from(F.lit(0)).alias("any_edition")]
    for kind in ("trophy", "flag"):
        hit = F.get(F.filter("n", lambda x: x[f"{kind}_hit"].isNotNull()), F.lit(0))  # noqa: B023
        out += [hit[f"{kind}_hit"].alias(f"names_{kind}"), edition_from(hit["pos"]).alias(f"{kind}_names_edition")]
    return listed.select("doc_id", *out)


def infer_edition(queries: DataFrame, races: DataFrame, item: str, include_null_item: bool = True) -> DataFrame:
    """(item_id, gender, category, year, edition) of queries (item_id, gender, category, year).

    The unanimous edition of that year's first-day races of the item (faithfully together with those
    of no item, whose missing edition usually prevents it), else the year before plus 1, else the
    year after minus 1.  An edition of 0 counts as missing.
    """
    held = races.filter("day = 1").select(F.col(f"{item}_id").alias("item_id"), F.col(f"{item}_edition").alias("edition"), "gender", "category", F.year("date").alias("year"))
    keys = ["gender", "category", "year"]
    items = queries.select("item_id", "gender", "category").distinct()
    own = held.filter("item_id is not null").join(items, ["item_id", "gender", "category"], "left_semi")
    stats = lambda df, by: df.groupBy(*by).agg(F.count("*").alias("n"), F.count("edition").alias("known"), F.min("edition").alias("low"), F.max("edition").alias("high"))
    of_item = stats(own, ["item_id", *keys])
    if include_null_item:
        blank = stats(held.filter("item_id is null"), keys).select(*keys, F.col("n").alias("n0"), F.col("known").alias("k0"), F.col("low").alias("l0"), F.col("high").alias("h0"))
        wanted = queries.select("item_id", *keys).unionByName(queries.select("item_id", "gender", "category", (F.col("year") - 1).alias("year"))).unionByName(queries.select("item_id", "gender", "category", (F.col("year") + 1).alias("year"))).distinct()
        both = wanted.join(of_item, ["item_id", *keys], "left").join(blank, keys, "left")
        of_item = both.select("item_id", *keys, (F.coalesce("n", F.lit(0)) + F.coalesce("n0", F.lit(0))).alias("n"), (F.coalesce("known", F.lit(0)) + F.coalesce("k0", F.lit(0))).alias("known"), F.least("low", "l0").alias("low"), F.greatest("high", "h0").alias("high"))
    agreed = F.when((F.col("n") == 1) | ((F.col("low") == F.col("high")) & (F.col("known") == F.col("n"))), F.nullif(F.col("high"), F.lit(0)))
    table = of_item.select("item_id", *keys, agreed.alias("edition")).filter("edition is not null")
    out = queries
    for shift, name in ((0, "same"), (-1, "before"), (1, "after")):
        out = out.join(table.select("item_id", "gender", "category", (F.col("year") - shift).alias("year"), F.col("edition").alias(name)), ["item_id", *keys], "left")
    return out.select(*queries.columns, F.coalesce("same", F.col("before") + 1, F.nullif(F.col("after") - 1, F.lit(0))).alias("edition"))


def retrieve_competition(docs: DataFrame) -> DataFrame:
    """docs with item_id, edition and status, from the matched race, else the hint, else the names.

    docs: db_item, db_edition (of the matched race), hint_item, name_item, name_edition, and
    inferred_edition.  Without an edition a document is unresolved; a hint brings none of its own.
    """
    item = F.coalesce("db_item", "hint_item", "name_item")
    edition = F.when(F.col("db_item").isNotNull(), F.col("db_edition")).when(F.col("hint_item").isNotNull(), F.lit(None)).otherwise(F.col("name_edition"))
    edition = F.coalesce(F.nullif(edition, F.lit(0)), "inferred_edition")
    return docs.withColumn("item_id", item).withColumn("edition", edition).withColumn("status", F.when(F.col("item_id").isNotNull() & F.col("edition").isNotNull(), "resolved").otherwise("unresolved"))


def resolve_league(docs: DataFrame, leagues: DataFrame) -> DataFrame:
    """(doc_id, league_id) of (doc_id, name, league, db_league_id): the matched race's league, else the one of that name unless the race is a play-off."""
    known = leagues.select(F.col("id").alias("found_id"), fold(F.col("name")).alias("folded"))
    wanted = docs.withColumn("wanted", F.when(~is_play_off(remove_parenthesis(F.col("name"))), fold(remove_parenthesis(F.col("league")))))
    return wanted.join(known, F.col("wanted") == F.col("folded"), "left").select("doc_id", F.coalesce("db_league_id", "found_id").alias("league_id"))


def resolve_place(queries: DataFrame, places: DataFrame) -> DataFrame:
    """(q, place_id, status): scored as entities are."""
    as_entities = places.select("id", "name", F.col("name").alias("normalized_name"), F.expr("cast(array() as array<string>)").alias("known_names"))
    return resolve_entity(queries, as_entities).withColumnRenamed("entity_id", "place_id")


def with_hints(resolved: DataFrame) -> DataFrame:
    """(doc_id, item_id): each document's own item, else the one that the first document of its name was given."""
    hints = resolved.filter("item_id is not null").groupBy("name").agg(F.min_by("item_id", "pos").alias("hint"), F.min("pos").alias("since"))
    joined = resolved.join(hints, "name", "left")
    return joined.select("doc_id", F.coalesce("item_id", F.when(F.col("since") < F.col("pos"), F.col("hint"))).alias("item_id"))


def retrieve_race(docs: DataFrame, races: DataFrame, force_gender: bool = False, force_category: bool = False) -> DataFrame:
    """(query_id, race_id, status) of the stored race that each document is about.

    docs: query_id, date, day, gender, category, trophy_id, flag_id and league_id as its names were
    resolved, hint_trophy_id and hint_flag_id as an earlier document of its name was.  A hint is tried
    first; where it finds no race, or several, the document's own competition is, first with all
    tests, then without those that are not forced.  A document without a competition finds none, and
    several races are ambiguous, to be reviewed.
    """
    found = first_unique(closest_tiers(races, docs, force_gender, force_category))
    return docs.select("query_id").join(found, "query_id", "left").select("query_id", "race_id", F.coalesce("status", F.lit("none")).alias("status"))


def fill_place_and_organizer(docs: DataFrame, races: DataFrame) -> DataFrame:
    """docs with place_id and organizer_id, where missing from the only ones of races of the same competition."""
    keys = ["trophy_id", "flag_id", "league_id"]
    usual = races.groupBy(*keys).agg(single_distinct("place_id").alias("usual_place"), single_distinct("organizer_id").alias("usual_organizer")).select(*[F.col(k).alias(f"u_{k}") for k in keys], "usual_place", "usual_organizer")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"u_{k}"))
    joined = docs.join(usual, same, "left").withColumn("place_id", F.coalesce("place_id", "usual_place")).withColumn("organizer_id", F.coalesce("organizer_id", "usual_organizer"))
    return joined.select(*docs.columns)
