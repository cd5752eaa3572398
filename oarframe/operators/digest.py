"""From landed race documents to decision frames: the whole ingest chain (MRG-1, MRG-4, with RES, FLT and FN in it).

digest_races takes whole documents and tells, for each, which stored race it is about and what the
race's row becomes; digest_participants does so for the boats, digest_penalties for their penalties.
Distinct names are resolved once and joined back; what several steps read is written in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import laps as laps_functions
from ..functions.text import branch_letter, can_be_branch
from ..session import dealt, materialize
from .filters import analogous_race, closest_tiers, first_unique, matching_race
from .merge import decided, merge_race, plan_participants
from .resolve import fill_place_and_organizer, infer_edition, named_competition, resolve_entity, resolve_league, resolve_place, retrieve_entity

KINDS = ("trophy", "flag")
#: The columns of a race's row that a document decides.
RACE_ROW = [
    "laps", "lanes", "type", "date", "day", "cancelled", "race_names", "trophy_id", "trophy_edition", "flag_id", "flag_edition",
    "league_id", "modality", "gender", "category", "organizer_id", "sponsor", "place_id", "metadata",
]


def prepared(docs: DataFrame, order: str) -> DataFrame:
    """Documents of read_race_documents with a parsed date and doc_id, taken from the column of the run's order, which must be unique."""
    parsed = laps_functions.source_date(F.col("date")) if dict(docs.dtypes)["date"] == "string" else F.col("date")
    return docs.withColumn("date", parsed).withColumn("doc_id", F.col(order).cast("long"))


def _matched(docs: DataFrame, races: DataFrame, force_gender: bool, force_category: bool) -> DataFrame:
    """docs with db_* columns of the race that hint or names find, and lookup: unique, ambiguous or none (RES-10)."""
    queries = docs.select(F.col("doc_id").alias("query_id"), "date", "day", "gender", "category", F.col("names_trophy").alias("trophy_id"), F.col("names_flag").alias("flag_id"), F.col("names_league").alias("league_id"), "hint_trophy_id", "hint_flag_id")
    found = first_unique(closest_tiers(races, queries, force_gender, force_category)).select(F.col("query_id").alias("doc_id"), F.col("race_id").alias("db_race"), F.col("status").alias("lookup"))
    stored = races.select(F.col("id").alias("db_race"), *[F.col(c).alias(f"db_{c}") for c in ("trophy_id", "trophy_edition", "flag_id", "flag_edition", "league_id")])
    joined = docs.join(found, "doc_id", "left").join(dealt(stored), "db_race", "left").withColumn("lookup", F.coalesce("lookup", F.lit("none")))
    return materialize(joined)  # several steps read it


def _with_competition(docs: DataFrame, races: DataFrame) -> DataFrame:
    """docs with trophy, flag, their editions and the league as the row will have them (RES-7, RES-8, RES-6).

    For each kind: the matched race's with its edition; else the hint's, with the first edition that
    any name gives; else the first name's that hits, with the first edition from there on; a missing
    edition is inferred, and without one the kind is left out.
    """
    out = docs.withColumn("year", F.year("date"))
    for kind in KINDS:
        stored, hint = F.col(f"db_{kind}_id"), F.col(f"hint_{kind}_id")
        item = F.coalesce(hint, F.col(f"names_{kind}"))
        edition = F.when(hint.isNotNull(), F.col("any_edition")).otherwise(F.col(f"{kind}_names_edition"))
        out = out.withColumn("item_id", F.when(stored.isNull(), item)).withColumn("given", F.when(stored.isNull(), edition))
        keys = ["item_id", "gender", "category", "year"]
        asked = materialize(out.filter("item_id is not null and given is null").select(*keys).distinct())
        if not asked.isEmpty():
            out = out.join(materialize(infer_edition(asked, races, kind)), keys, "left").withColumn("given", F.coalesce("given", "edition")).drop("edition")
        usable = F.coalesce(F.col("given") != 0, F.lit(False))
        out = out.withColumn(f"{kind}_id", F.when(stored.isNotNull(), stored).when(usable, F.col("item_id"))).withColumn(f"{kind}_edition", F.when(stored.isNotNull(), F.col(f"db_{kind}_edition")).when(usable, F.col("given")))
        out = out.drop("item_id", "given")
    return out.withColumn("league_id", F.when(F.col("db_race").isNotNull(), F.col("db_league_id")).otherwise(F.col("names_league"))).drop("year")


def _complete() -> Column:
    held = lambda kind: F.col(f"{kind}_id").isNotNull() & (F.coalesce(F.col(f"{kind}_edition"), F.lit(0)) != 0)
    return held("trophy") | held("flag")


def _placed(docs: DataFrame, races: DataFrame, places: DataFrame, entities: DataFrame) -> DataFrame:
    """docs with place_id and organizer_id: of the town and organizer named, else of the competition's other races (RES-9, RES-11)."""
    named = docs
    wanted = {"town": ("place_id", places, lambda q: resolve_place(q, places)), "organizer": ("organizer_id", entities, lambda q: resolve_entity(q, entities).withColumnRenamed("entity_id", "organizer_id"))}
    for column, (found, table, resolve) in wanted.items():
        queries = materialize(docs.filter(F.col(column).isNotNull()).select(F.col(column).alias("q")).distinct())
        if queries.isEmpty():
            named = named.withColumn(found, F.lit(None).cast(table.schema["id"].dataType))
        else:
            named = named.join(materialize(resolve(queries).filter("status = 'unique'").select(F.col("q").alias(column), found)), column, "left")
    return fill_place_and_organizer(named, races)


def _element(races: DataFrame, ref: Column, datasource: Column, url: Column) -> Column:
    """A reference of the races' own metadata type; fields that it does not have are left out, others are null."""
    known = {"ref_id": ref, "datasource_name": datasource, "values": F.create_map(F.lit("details_page"), url)}
    fields = races.schema["metadata"].dataType.elementType.fields
    return F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def digest_races(
    docs: DataFrame, races: DataFrame, trophies: DataFrame, flags: DataFrame, leagues: DataFrame, entities: DataFrame, places: DataFrame,
    merge: str = "always", force_gender: bool = False, force_category: bool = False,
) -> DataFrame:
    """(doc_id, status, race_id, associated_id and RACE_ROW): what becomes of each document.

    docs: prepared documents.  trophies and flags: item_id, name, tokens.  entities, places, leagues and
    races as stored, races with metadata.

    - A hint is the competition of the first document of the same name, in the order of doc_id, that has one.
    - The stored race is that of the hint, or of the names with all tests, then without those that are
      not forced, or the one equal to the new row in all; several are left for REVIEW.
    - Without a trophy or flag with its edition a document is IGNORED, and has no row.
    - NEW: the row is the document's, with place and organizer filled from the competition's other races.
    - MERGED: the row is the stored one with what the document changes (merge_race).
    - associated_id is the race of the competition's other day, or a match that the policy does not merge.

    Rows with equal doc_id must not occur.  Null dates match nothing, so such documents are NEW.
    """
    names = docs.select("doc_id", F.posexplode("names").alias("pos", "n")).select("doc_id", "pos", F.col("n.name").alias("q"), F.col("n.edition").alias("edition")).filter("q is not null")
    named = materialize(named_competition(names, trophies, flags))
    by_name = resolve_league(docs.select("doc_id", "name", "league", F.lit(None).cast("int").alias("db_league_id")), leagues).select("doc_id", F.col("league_id").alias("names_league"))
    base = materialize(docs.drop("participants").join(dealt(named), "doc_id", "left").join(by_name, "doc_id", "left"))
    no_hint = lambda df: df.withColumns({"hint_trophy_id": F.lit(None).cast("long"), "hint_flag_id": F.lit(None).cast("long")})
    alone = materialize(_with_competition(_matched(no_hint(base), races, force_gender, force_category), races))
    first = F.min_by(F.struct("trophy_id", "flag_id"), "doc_id")
    hints = materialize(alone.filter(_complete() & (F.col("lookup") != "ambiguous")).groupBy("name").agg(F.min("doc_id").alias("since"), first.alias("hint")))
    told = (F.col("doc_id") > F.col("since")) & F.col("hint").isNotNull()
    hinted = materialize(base.join(hints, "name", "left").withColumns({f"hint_{k}_id": F.when(told, F.col(f"hint.{k}_id")) for k in KINDS}).select(*base.columns, *[f"hint_{k}_id" for k in KINDS]))
    both = alone
    if not hinted.filter("hint_trophy_id is not null or hint_flag_id is not null").isEmpty():
        # Documents that no hint is for are matched again, to the same end.
        both = materialize(_with_competition(_matched(hinted, races, force_gender, force_category), races))
    settled = materialize(_placed(both, races, places, entities))

    usable = settled.filter(_complete())
    as_query = usable.withColumn("query_id", F.col("doc_id"))
    exact = matching_race(races, dealt(as_query.filter("db_race is null and lookup = 'none'"))).select(F.col("query_id").alias("doc_id"), F.col("race_id").alias("equal_race"), F.col("status").alias("equal_lookup"))
    other = analogous_race(races, trophies.select(F.col("item_id").alias("id"), "name"), usable.withColumn("id", F.col("doc_id")), flags.select(F.col("item_id").alias("id"), "name"))
    other = other.select(F.col("query_id").alias("doc_id"), F.col("race_id").alias("other_race"), F.col("status").alias("other_lookup"))
    joined = settled.join(dealt(exact), "doc_id", "left").join(dealt(other), "doc_id", "left").withColumn("found", F.coalesce("db_race", "equal_race"))
    several = F.lit(False)
    for lookup in ("lookup", "equal_lookup", "other_lookup"):
        several = several | F.coalesce(F.col(lookup) == "ambiguous", F.lit(False))
    policy = decided(merge)
    status = F.when(several, "REVIEW").when(~_complete(), "IGNORED").when(F.col("found").isNull(), "NEW").when(policy.isNull(), "REVIEW").when(policy, "MERGED").otherwise("NEW")
    ids = F.coalesce("race_ids", F.expr("cast(array() as array<string>)"))
    elements = F.transform(ids, lambda r: _element(races, r, F.col("datasource"), F.col("url")))
    kind = races.schema
    decision = materialize(
        joined.withColumn("status", status).withColumn("race_id", F.when(F.col("status") == "MERGED", F.col("found")))
        .withColumn("associated_id", F.when(F.col("status") == "NEW", F.coalesce("other_race", "found")).when(F.col("status") == "MERGED", F.col("other_race")))
        .withColumns({"laps": F.col("race_laps").cast(kind["laps"].dataType), "lanes": F.col("race_lanes").cast(kind["lanes"].dataType), "race_names": F.array("name"), "metadata": elements})
    )
    return _rows(decision, races)


def _rows(decision: DataFrame, races: DataFrame) -> DataFrame:
    """The decisions with the rows that they lead to: the document's, or the stored one merged with it."""
    changed = ("gender", "category", "race_names", "laps", "lanes", "sponsor", "place_id")
    new = decision.filter("status = 'MERGED'").select("doc_id", F.col("race_id").alias("id"), *[F.col(c).alias(f"new_{c}") for c in changed], F.get("metadata", F.lit(0)).alias("new_metadata"))
    stored = races.select("id", "metadata", *changed)
    merged = merge_race(new.join(dealt(stored), "id").withColumnRenamed("id", "stored_id").withColumn("id", F.col("doc_id")))
    kept = [c for c in RACE_ROW if c not in changed and c != "metadata"]
    of_stored = races.select(F.col("id").alias("race_id"), *[F.col(c) for c in kept])
    head = ["doc_id", "status", "race_id", "associated_id"]
    updates = decision.filter("status = 'MERGED'").select(*head).join(dealt(of_stored), "race_id").join(dealt(merged.withColumnRenamed("id", "doc_id")), "doc_id")
    kind = {f.name: f.dataType for f in races.schema}
    typed = lambda value, c: (value if isinstance(kind[c], T.ArrayType) else value.cast(kind[c])).alias(c)
    fresh = decision.filter("status <> 'MERGED'").select(*head, *[typed(F.when(F.col("status") != "IGNORED", F.col(c)), c) for c in RACE_ROW])
    return fresh.unionByName(updates.select(*head, *[typed(F.col(c), c) for c in RACE_ROW]))


def digest_participants(
    docs: DataFrame, decisions: DataFrame, participants: DataFrame, entities: DataFrame,
    update: str = "always", add_source: str = "always", normalized: Callable[[Column], Column] = F.trim,
) -> DataFrame:
    """(doc_id, boat, club_id, participant_id, status, race_id and the boat's row) of all boats of documents that were not ignored.

    decisions is the result of digest_races: boats of NEW races are NEW, those of MERGED ones are looked for among
    the race's; boats of races under REVIEW, and of clubs that no name or several fit, are left for REVIEW.
    normalized cleans a club's name before it is resolved.  The row of a NEW boat is the document's:
    names cleaned (FN-21), branch if the race has no league and the club is there under its plain name
    too (FN-10, FN-11), lap times and handicap in milliseconds (FN-2), lane 1 in time trials (FN-22), not
    retired if disqualified (FN-23).  Of a stored boat laps, lane, names and references may change.
    """
    race = decisions.filter("status <> 'IGNORED'").select("doc_id", F.col("status").alias("race_status"), "race_id", F.col("league_id").isNotNull().alias("has_league"), (F.col("type") == "TIME_TRIAL").alias("time_trial"))
    boats = docs.select("doc_id", "datasource", F.transform("participants", lambda p: p["participant"]).alias("all_names"), F.posexplode("participants").alias("boat", "p")).join(dealt(race), "doc_id")
    names = boats.select(F.col("p.participant").alias("q")).filter("q is not null").distinct()
    clubs = materialize(retrieve_entity(materialize(names), entities, normalized)[0].select(F.col("q").alias("participant"), F.col("entity_id").alias("club_id")))
    plain = boats.select(
        F.struct("doc_id", "boat").alias("key"), "race_status", "race_id", "has_league", "time_trial", "datasource", F.lit(None).cast("string").alias("ref_id"),
        F.col("p.participant").alias("participant"), F.col("p.club_name").alias("raw_name"), laps_functions.clean_club_name(F.col("p.club_name")).alias("club_name"), branch_letter(F.col("p.participant")).alias("branch"),
        (~F.col("has_league") & can_be_branch(F.col("p.participant"), F.col("all_names"))).alias("can_be_branch"), laps_functions.laps_ms(F.col("p.laps")).alias("laps_ms"), F.col("p.lane").alias("lane"),
        F.col("p.gender").alias("gender"), F.col("p.category").alias("category"), F.col("p.distance").alias("distance"), F.col("p.series").alias("series"), laps_functions.lap_ms(F.col("p.handicap")).alias("handicap_ms"),
        F.coalesce("p.absent", F.lit(False)).alias("absent"), laps_functions.retired_of(F.coalesce("p.retired", F.lit(False)), F.col("p.penalty.disqualification")).alias("retired"),
    )
    known = materialize(plain.join(clubs, "participant", "left"))
    planned = plan_participants(known.filter("race_status = 'MERGED' and club_id is not null").withColumnRenamed("key", "doc_id"), participants, update, add_source)
    planned = planned.select(F.col("doc_id").alias("key"), *[F.col(c).alias(f"planned_{c}") for c in ("participant_id", "status", "laps_ms", "lane", "club_names", "branch", "refs")])
    joined = known.join(dealt(planned), "key", "left")
    unknown = F.col("club_id").isNull() | (F.col("race_status") == "REVIEW")
    status = F.when(unknown, "REVIEW").otherwise(F.coalesce("planned_status", F.lit("NEW")))
    fresh = F.col("planned_status").isNull()
    own_names = F.when(F.col("club_name").isNotNull(), F.array("club_name")).otherwise(F.expr("cast(array() as array<string>)"))
    own_refs = F.array(F.struct(F.col("datasource").alias("datasource_name"), "ref_id"))
    held = participants.select(F.col("id").alias("planned_participant_id"), *[F.col(c).alias(f"held_{c}") for c in ("distance", "series", "handicap_ms", "absent", "retired") if c in participants.columns])
    kept = lambda c: F.when(F.col("planned_participant_id").isNull(), F.col(c)).otherwise(F.col(f"held_{c}")).alias(c) if f"held_{c}" in held.columns else F.when(F.col("planned_participant_id").isNull(), F.col(c)).alias(c)
    return joined.join(dealt(held), "planned_participant_id", "left").select(
        "key.doc_id", "key.boat", "race_id", "club_id", F.col("planned_participant_id").alias("participant_id"), status.alias("status"),
        F.when(fresh, own_names).otherwise(F.col("planned_club_names")).alias("club_names"), F.when(fresh, F.when(F.col("can_be_branch"), F.col("branch"))).otherwise(F.col("planned_branch")).alias("branch"),
        F.when(fresh, F.col("laps_ms")).otherwise(F.col("planned_laps_ms")).alias("laps_ms"), F.when(fresh, F.when(F.col("time_trial"), F.lit(1)).otherwise(F.col("lane"))).otherwise(F.col("planned_lane")).alias("lane"),
        F.when(fresh, own_refs).otherwise(F.col("planned_refs")).alias("refs"), "gender", "category", *[kept(c) for c in ("distance", "series", "handicap_ms", "absent", "retired")],
    )


def digest_penalties(docs: DataFrame, boats: DataFrame) -> DataFrame:
    """(participant_id, reason, disqualification, note, at) of the stored boats that documents fine, for upsert_penalty.

    boats is the result of digest_participants; the race's notes become the note, `at` is the documents' order.
    """
    fined = docs.select("doc_id", F.nullif(F.trim("race_notes"), F.lit("")).alias("note"), F.posexplode("participants").alias("boat", "p")).filter("p.penalty is not null")
    saved = boats.filter("participant_id is not null and status in ('EXISTING', 'MERGED')").select("doc_id", "boat", "participant_id")
    reason, out = F.col("p.penalty.reason").alias("reason"), F.coalesce("p.penalty.disqualification", F.lit(False)).alias("disqualification")
    return fined.join(saved, ["doc_id", "boat"]).select("participant_id", reason, out, "note", F.struct("doc_id", "boat").alias("at"))
