"""Merging documents into stored rows by policy, as decision frames (MRG).

Where a person would be asked, a policy answers: `always`, `never`, or `review`, which leaves the
decision open in a column.  Nothing is written here; a decision frame says what a write would do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metadata import add_element
from ..session import dealt, materialize
from .filters import ALL, COMPETITION, all_of, analogous_race, closest_tiers, first_unique, participant_by

POLICIES = ("always", "never", "review")


def decided(policy: str) -> Column:
    """True, false, or null for review."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    return F.lit({"always": True, "never": False, "review": None}[policy]).cast("boolean")


def plan_races(
    docs: DataFrame, races: DataFrame, trophies: DataFrame, merge: str = "always", force_gender: bool = False, force_category: bool = False, flags: DataFrame | None = None
) -> DataFrame:
    """(query_id, race_id, associated_id, status) for documents with resolved competition.

    docs: query_id, date, day, gender, category, trophy_id, trophy_edition, flag_id, flag_edition,
    league_id, hint_trophy_id and hint_flag_id.  The stored race is the one that the hint or the names
    find, else the one that matches in all; several are left for review.  A document without a
    trophy or flag with its edition is IGNORED.  associated_id is the race of the same competition on
    the other day, or else a match that the policy does not merge, of a then NEW race.
    """
    complete = (F.col("trophy_id").isNotNull() & (F.coalesce("trophy_edition", F.lit(0)) != 0)) | (F.col("flag_id").isNotNull() & (F.coalesce("flag_edition", F.lit(0)) != 0))
    usable = docs.filter(complete)
    found = first_unique(closest_tiers(races, usable, force_gender, force_category), exact=True)
    other = analogous_race(races, trophies, usable.withColumnRenamed("query_id", "id"), flags).select("query_id", F.col("race_id").alias("other_id"), F.col("status").alias("other_status"))
    joined = docs.select("query_id", complete.alias("complete")).join(found, "query_id", "left").join(other, "query_id", "left")
    merges = decided(merge)
    several = (F.col("status") == "ambiguous") | (F.coalesce("other_status", F.lit("none")) == "ambiguous")
    status = (
        F.when(~F.coalesce("complete", F.lit(False)), "IGNORED").when(several, "REVIEW").when(F.col("race_id").isNull(), "NEW")
        .when(merges.isNull(), "REVIEW").when(merges, "MERGED").otherwise("NEW")
    )
    merged = joined.withColumn("decision", status)
    associated = F.when(F.col("decision") == "NEW", F.coalesce("other_id", "race_id")).when(F.col("decision") == "MERGED", F.col("other_id"))
    return merged.select("query_id", F.when(F.col("decision") == "MERGED", F.col("race_id")).alias("race_id"), associated.alias("associated_id"), F.col("decision").alias("status"))


def _replaced(new: str, old: str) -> Column:
    return F.coalesce(F.col(new), F.col(old))


def merge_race(pairs: DataFrame) -> DataFrame:
    """The stored races with what their documents change.

    pairs: id, and each of metadata, gender, category, race_names, laps, lanes, sponsor, place_id as
    stored, with the document's under new_.  Different genders or categories become ALL; names are
    joined; lanes, sponsor and place follow the document where it has one; laps too, except that 2
    does not replace 4; an element of metadata is added if its source and reference are new.
    """
    widened = lambda c: F.when(F.col(f"new_{c}").isNull() | (F.col(f"new_{c}") == F.col(c)), F.col(c)).otherwise(F.lit(ALL)).alias(c)
    keep_laps = F.col("new_laps").isNull() | ((F.col("laps") == 4) & (F.col("new_laps") == 2))
    return pairs.select(
        "id", add_element(F.col("metadata"), F.col("new_metadata")).alias("metadata"), widened("gender"), widened("category"),
        F.sort_array(F.array_union("race_names", "new_race_names")).alias("race_names"),
        F.when(keep_laps, F.col("laps")).otherwise(F.col("new_laps")).alias("laps"),
        *[_replaced(f"new_{c}", c).alias(c) for c in ("lanes", "sponsor", "place_id")],
    )


#: The two keys that stored races may have once each; a key with a null part is no key.
UNIQUE_KEYS = {kind: (f"{kind}_id", "league_id", f"{kind}_edition", "modality") for kind in ("trophy", "flag")}
_COMPETITION_KEYS = [*COMPETITION, "trophy_edition", "flag_edition", "modality"]


def _unique_keys() -> Column:
    """A race's complete unique keys, as structs of one type."""
    key = lambda kind, cols: F.struct(F.lit(kind).alias("kind"), *[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(cols)])
    known = lambda cols: all_of([F.col(c).isNotNull() for c in cols])
    return F.array_compact(F.array(*[F.when(known(cols), key(kind, cols)) for kind, cols in UNIQUE_KEYS.items()]))


def save_races(new: DataFrame, races: DataFrame, auto_before: int = 2003, order: str = "id", max_rounds: int = 40) -> DataFrame:
    """(id, day, action, associated_id) of new races: saved, saved as day 2, rejected, or left for review.

    The races are taken in the order of the column `order` (ties: id), and each sees what the ones
    before it stored.  A race may not have a unique key (trophy or flag, league, edition, modality,
    day) of a stored one.  A day 2 needs a day-1 race of the same year and competition (null parts
    are equal here), the earliest of which becomes associated_id.  A race of day 1 whose key is taken
    is tried as day 2 in the same way; what fails is rejected.  Races before auto_before are saved
    without review; one left for review holds its keys like a saved one.

    Each round decides, in parallel, the races that no undecided earlier one can influence, and writes
    their claims to the shared folder.  Races of one key need at most four rounds, however many they
    are.  Longer chains, in which trophies and flags take turns, need a round for each link; what is
    undecided after max_rounds is left for REVIEW with its day unchanged.
    """
    competition = F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(_COMPETITION_KEYS)])
    shape = lambda df, at: df.select("id", at.alias("at"), F.col("day").cast("int").alias("day"), F.year("date").alias("year"), competition.alias("competition"), _unique_keys().alias("keys"))
    before_all = F.struct(F.lit(0).alias("late"), F.lit(None).cast(new.schema[order].dataType).alias("value"), F.col("id"))
    claims = shape(races, before_all)
    pending = materialize(shape(new, F.struct(F.lit(1).alias("late"), F.col(order).alias("value"), F.col("id"))))
    decided_races, rounds = None, 0
    while rounds < max_rounds and not pending.isEmpty():
        judged = materialize(_judge(pending, claims))
        done = judged.filter("action is not null")
        decided_races = done if decided_races is None else decided_races.unionByName(done)
        pending = materialize(judged.filter("action is null").select(*pending.columns))
        held = done.filter("action <> 'REJECT'").withColumn("day", F.when(F.col("action") == "SAVE_AS_DAY_2", F.lit(2)).otherwise(F.col("day")))
        claims = claims.unionByName(held.select(*claims.columns))
        rounds += 1
    if decided_races is None:
        decided_races = _judge(pending, claims)
    day = F.when(F.col("action") == "SAVE_AS_DAY_2", F.lit(2)).otherwise(F.col("day"))
    action = F.when((F.col("action") == "SAVE") & (F.col("year") >= auto_before), "REVIEW").otherwise(F.col("action"))
    associated = F.when((F.col("action") != "REJECT") & (day == 2), F.col("first.id"))
    out = decided_races.select("id", day.alias("day"), action.alias("action"), associated.alias("associated_id"))
    if rounds < max_rounds:
        return out
    return out.unionByName(pending.select("id", "day", F.lit("REVIEW").alias("action"), F.lit(None).cast("long").alias("associated_id")))


def _judge(pending: DataFrame, claims: DataFrame) -> DataFrame:
    """pending with first (the race to be associated with) and action, null where an earlier race is to be decided before.

    By key: the earliest claims of its days, and the earliest undecided race, of day 1 and of any day.
    By competition and year: the earliest day-1 race that is stored, and that is undecided.
    """
    first_day = F.col("day") == 1
    taken = claims.select("at", "day", F.explode("keys").alias("key")).groupBy("key").agg(F.min(F.when(first_day, F.col("at"))).alias("taken_1"), F.min(F.when(F.col("day") == 2, F.col("at"))).alias("taken_2"))
    asked = pending.select("id", "at", "day", F.explode("keys").alias("key"))
    waiting = materialize(asked.groupBy("key").agg(F.min(F.when(first_day, F.col("at"))).alias("waiting_1"), F.min("at").alias("waiting")).join(taken, "key", "left"))
    earlier = lambda c: F.coalesce(F.col(c) < F.col("at"), F.lit(False))
    by_key = asked.join(waiting, "key").groupBy("id").agg(*[F.max(earlier(c)).alias(c) for c in ("taken_1", "taken_2", "waiting_1", "waiting")])
    firsts = lambda df, name: df.filter(first_day).groupBy("competition", "year").agg(F.min("at").alias(name))
    wanted = pending.select("competition", "year").distinct()
    by_year = materialize(wanted.join(firsts(claims, "first"), ["competition", "year"], "left").join(firsts(pending, "coming"), ["competition", "year"], "left"))
    joined = pending.join(by_key, "id", "left").join(by_year, ["competition", "year"], "left")
    no = F.lit(False)
    for c in ("taken_1", "taken_2", "waiting_1", "waiting"):
        joined = joined.withColumn(c, F.coalesce(c, no))
    has_first, first_may_come = earlier("first"), earlier("coming")
    as_second = (
        F.when(F.col("taken_2") | (~has_first & ~first_may_come), "REJECT").when(F.col("waiting") | ~has_first, None)
        .otherwise(F.when(first_day, "SAVE_AS_DAY_2").otherwise("SAVE"))
    )
    action = F.when(first_day & ~F.col("taken_1"), F.when(~F.col("waiting_1"), "SAVE")).otherwise(as_second)
    return joined.select(*pending.columns, "first", action.alias("action"))


def day_links(saved: DataFrame) -> DataFrame:
    """(id, associated_id) of both days of each saved race (the result of save_races) that has another day."""
    pairs = saved.filter((F.col("action") != "REJECT") & F.col("associated_id").isNotNull()).select("id", "associated_id")
    return pairs.unionByName(pairs.select(F.col("associated_id").alias("id"), F.col("id").alias("associated_id")))


def plan_participants(docs: DataFrame, participants: DataFrame, update: str = "always", add_source: str = "always") -> DataFrame:
    """(doc_id, participant_id, status, laps_ms, lane, club_names, branch, refs) for documents' boats with resolved club.

    docs: doc_id, race_id, club_id, gender, category, branch, raw_name, has_league (of the race),
    time_trial, can_be_branch, laps_ms, lane, club_name, datasource, ref_id; participants also have
    metadata.  The stored boat is the only one that participant_by finds; several are left for REVIEW.
    A new boat has its branch only if it can be one, and lane 1 in time trials.

    Laps change for longer ones, the lane for another one, the metadata for an element it lacks.  No
    change, or new metadata alone, is EXISTING; new metadata is then taken over, with the name.  Other
    changes are MERGED if `update` says so, the name again with new metadata only; if refused, a
    stored boat without any element of the source takes it over if `add_source` says so (MERGED), and
    otherwise the document's boat stays NEW.  `guest` is not taken over.
    """
    key = ["race_id", "club_id", "gender", "category", "branch"]
    queries = docs.select(F.col("doc_id").alias("query_id"), *key, "raw_name", "has_league")
    found = participant_by(participants, queries).select(F.col("query_id").alias("doc_id"), "participant_id", F.col("status").alias("lookup"))
    old = participants.select(F.col("id").alias("participant_id"), F.col("laps_ms").alias("s_laps"), F.col("lane").alias("s_lane"), F.col("club_names").alias("s_names"), F.col("branch").alias("s_branch"), F.col("metadata").alias("s_refs"))
    # Only boats that are found meet the stored rows: those that are not would all be dealt to one task.
    stored = found.filter("participant_id is not null").select("doc_id", "participant_id").join(dealt(old), "participant_id").drop("participant_id")
    joined = docs.withColumn("lane", F.when(F.col("time_trial"), F.lit(1)).otherwise(F.col("lane"))).join(dealt(found), "doc_id").join(dealt(stored), "doc_id", "left")
    none = F.col("participant_id").isNull()
    element = F.struct(F.col("datasource").alias("datasource_name"), F.col("ref_id").alias("ref_id"))
    longer = F.size("laps_ms") > F.size("s_laps")
    other_lane = F.col("lane").isNotNull() & ~F.col("lane").eqNullSafe(F.col("s_lane"))
    new_source = ~F.exists("s_refs", lambda m: (m["datasource_name"] == F.col("datasource")) & m["ref_id"].eqNullSafe(F.col("ref_id")))
    unknown_source = ~F.exists("s_refs", lambda m: m["datasource_name"] == F.col("datasource"))
    policy, adding = decided(update), decided(add_source)
    refused = F.when(~unknown_source, "NEW").when(adding.isNull(), "REVIEW").when(adding, "MERGED").otherwise("NEW")
    status = (
        F.when(F.col("lookup") == "ambiguous", "REVIEW").when(none, "NEW").when(~(longer | other_lane), "EXISTING")
        .when(policy.isNull(), "REVIEW").when(policy, "MERGED").otherwise(refused)
    )
    taken = joined.withColumn("status", status)
    fresh = F.col("status") == "NEW"
    merged = (F.col("status") == "MERGED") & F.coalesce(policy, F.lit(False))
    sourced = F.col("status").isin("EXISTING", "MERGED") & new_source
    empty = F.expr("cast(array() as array<string>)")
    own_names = F.when(F.col("club_name").isNotNull(), F.array("club_name")).otherwise(empty)
    both_names = F.sort_array(F.array_union("s_names", own_names))
    return taken.select(
        "doc_id", F.when(~fresh, F.col("participant_id")).alias("participant_id"), "status",
        F.when(fresh | (merged & longer), F.col("laps_ms")).otherwise(F.col("s_laps")).alias("laps_ms"),
        F.when(fresh | (merged & other_lane), F.col("lane")).otherwise(F.col("s_lane")).alias("lane"),
        F.when(fresh & none, own_names).when(fresh | sourced, both_names).otherwise(F.col("s_names")).alias("club_names"),
        F.when(fresh, F.when(F.col("can_be_branch"), F.col("branch"))).otherwise(F.col("s_branch")).alias("branch"),
        F.when(fresh, F.array(element)).when(sourced, add_element(F.col("s_refs"), element)).otherwise(F.col("s_refs")).alias("refs"),
    )


def plan_participants_in_order(docs: DataFrame, participants: DataFrame, update: str = "always", add_source: str = "always", max_rounds: int = 16) -> DataFrame:
    """plan_participants for documents that are taken in the order of doc_id (a number from 0), each meeting what the ones before it left.

    A boat that a document of the batch makes is known to later ones by the id -1 - doc_id.  Documents
    about one club, gender and category of a race wait for each other, all others are planned side by
    side; so the rounds are as many as documents name one club in a race.  The state after each round
    is written to the shared folder.  Documents beyond max_rounds of their club are left for REVIEW.
    """
    key = ["race_id", "club_id", "gender", "category"]
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id"))
    queue = materialize(docs.withColumn("turn", turn))
    rounds = min(queue.agg(F.coalesce(F.max("turn"), F.lit(0))).first()[0], max_rounds)
    changed = ["laps_ms", "lane", "club_names", "branch", "metadata"]
    state = participants.select("id", *key, *changed)
    planned = None
    for r in range(1, rounds + 1):
        asked = queue.filter(F.col("turn") == r).drop("turn")
        # Boats of the round's clubs alone can be meant.
        near = state.join(asked.select(*key).distinct(), key, "left_semi") if r > 1 else state
        result = materialize(plan_participants(asked, near, update, add_source))
        planned = result if planned is None else planned.unionByName(result)
        if r == rounds:
            break
        after = result.filter("status <> 'REVIEW'").withColumn("id", F.coalesce("participant_id", -1 - F.col("doc_id"))).withColumnRenamed("refs", "metadata")
        written = after.join(asked.select("doc_id", *key), "doc_id").select("id", *key, *changed)
        state = materialize(state.join(written.select("id"), "id", "left_anti").select("id", *key, *changed).unionByName(written))
    none = lambda c: F.lit(None).cast(planned.schema[c].dataType).alias(c)
    if planned is None:
        return plan_participants(docs, participants, update, add_source)
    late = queue.filter(F.col("turn") > max_rounds)
    return planned.unionByName(late.select("doc_id", none("participant_id"), F.lit("REVIEW").alias("status"), *[none(c) for c in planned.columns[3:]]))


def merge_participant(pairs: DataFrame, allowed: bool = True) -> DataFrame:
    """Stored boats with the changes of their documents: longer laps, a lane, an element of metadata.

    pairs: id, laps_ms, lane, club_names, metadata, and the document's as new_laps_ms, new_lane,
    new_club_names and new_metadata.  The names are united where the element is new.  A refused merge
    takes over the element and the names only where no element of that source is stored.
    """
    use = F.lit(allowed)
    longer = use & (F.size("new_laps_ms") > F.size("laps_ms"))
    lane = F.when(use, F.coalesce("new_lane", "lane")).otherwise(F.col("lane"))
    known = F.exists("metadata", lambda m: m["datasource_name"] == F.col("new_metadata")["datasource_name"])
    present = F.exists("metadata", lambda m: (m["datasource_name"] == F.col("new_metadata")["datasource_name"]) & m["ref_id"].eqNullSafe(F.col("new_metadata")["ref_id"]))
    sourced = F.col("new_metadata").isNotNull() & F.when(use, ~present).otherwise(~known)
    return pairs.select(
        "id", F.when(longer, F.col("new_laps_ms")).otherwise(F.col("laps_ms")).alias("laps_ms"), lane.alias("lane"),
        F.when(sourced, F.sort_array(F.array_union("club_names", "new_club_names"))).otherwise(F.col("club_names")).alias("club_names"),
        F.when(sourced, F.concat("metadata", F.array("new_metadata"))).otherwise(F.col("metadata")).alias("metadata"),
    )


def upsert_penalty(new: DataFrame, penalties: DataFrame, order: str | None = None) -> DataFrame:
    """(participant_id, reason, disqualification, notes, status) of the penalties that the documents' ones change or create.

    new: participant_id, reason, disqualification, note.  A boat's only penalty takes a note that it
    lacks, and the reason if it had none, unless it has another reason; of several, the only one with
    that reason takes the note.  Else one is inserted.  The new penalties of a boat are taken one by
    one, in the order of the column `order` (without it, of reason, disqualification and note), and
    each meets what the ones before it made.  Penalties without a boat are left out.

    The boat's penalties, stored and new, come together in one row: a document names a boat once.
    """
    place = F.col(order) if order else F.lit(0)
    reported = new.filter("participant_id is not null").select("participant_id", F.struct(place.alias("at"), "reason", F.col("disqualification").alias("out"), F.nullif(F.col("note"), F.lit("")).alias("note")).alias("p"))
    steps = reported.groupBy("participant_id").agg(F.array_sort(F.collect_list("p")).alias("steps"))
    kind = "array<struct<reason:string,disqualification:boolean,notes:array<string>,status:string>>"
    held = F.struct(F.nullif(F.col("reason"), F.lit("")).alias("reason"), "disqualification", "notes", F.lit(None).cast("string").alias("status"))
    old = penalties.join(steps.select("participant_id"), "participant_id", "left_semi").groupBy("participant_id").agg(F.collect_list(held).alias("held"))

    def step(held: Column, p: Column) -> Column:
        meant = lambda x: (F.size(held) == 1) | F.coalesce(x["reason"] == p["reason"], F.lit(False))
        fits = F.exists(held, lambda x: meant(x) & (x["reason"].isNull() | F.coalesce(x["reason"] == p["reason"], F.lit(False))))
        noted = lambda x: F.when(p["note"].isNull() | F.array_contains(x["notes"], p["note"]), x["notes"]).otherwise(F.concat(x["notes"], F.array(p["note"])))
        shaped = lambda *parts: F.struct(*[part.alias(name) for part, name in zip(parts, ("reason", "disqualification", "notes", "status"))])
        changed = F.transform(held, lambda x: F.when(meant(x), shaped(F.coalesce(x["reason"], p["reason"]), x["disqualification"], noted(x), F.coalesce(x["status"], F.lit("UPDATED")))).otherwise(x))
        made = shaped(p["reason"], p["out"], F.array_compact(F.array(p["note"])), F.lit("CREATED"))
        return F.when((F.size(F.filter(held, meant)) == 1) & fits, changed).otherwise(F.concat(held, F.array(made))).cast(kind)

    start = F.coalesce(F.col("held"), F.expr("array()")).cast(kind)
    after = steps.join(old, "participant_id", "left").select("participant_id", F.inline(F.aggregate("steps", start, step)))
    return after.filter("status is not null")


def save_participants(plan: DataFrame, created_races: DataFrame, save: str = "review") -> DataFrame:
    """(doc_id, action): boats of races just created are saved; others as the policy says; EXISTING ones are kept as they are."""
    new_race = plan.join(created_races.select("race_id").withColumn("created", F.lit(True)), "race_id", "left")
    policy = decided(save)
    action = F.when(F.col("status") == "EXISTING", "KEEP").when(F.col("created"), "SAVE").when(policy.isNull(), "REVIEW").when(policy, "SAVE").otherwise("SKIP")
    return new_race.select("doc_id", action.alias("action"))


def mark_checked(flags: DataFrame, checked: DataFrame, date: str) -> DataFrame:
    """Flags, those of `checked` (flag_id) with the date of the check."""
    seen = checked.select(F.col("flag_id").alias("checked_flag")).distinct()
    return flags.join(seen, F.col("id") == F.col("checked_flag"), "left").withColumn("last_checked", F.when(F.col("checked_flag").isNotNull(), F.to_date(F.lit(date))).otherwise(F.col("last_checked"))).drop("checked_flag")


# Backfills


def mix_participants(participants: DataFrame, matched: DataFrame, run_date: str | None = None) -> DataFrame:
    """Boats, those matched (participant_id) as MIX and ABSOLUT.

    If matched has new_data and the boats have metadata, the elements of these boats take new_data as
    `data` and run_date as `date`; of several documents for a boat the least new_data is taken.
    """
    replaces = "new_data" in matched.columns
    hit = matched.groupBy(F.col("participant_id").alias("mixed_id")).agg(F.min("new_data" if replaces else "participant_id").alias("mixed_data"))
    joined = participants.join(hit, F.col("id") == F.col("mixed_id"), "left")
    mixed = F.col("mixed_id").isNotNull()
    out = joined.withColumn("gender", F.when(mixed, "MIX").otherwise(F.col("gender"))).withColumn("category", F.when(mixed, "ABSOLUT").otherwise(F.col("category")))
    if replaces:
        renewed = F.transform("metadata", lambda m: m.withField("data", F.col("mixed_data")).withField("date", F.lit(run_date)))
        out = out.withColumn("metadata", F.when(mixed, renewed).otherwise(F.col("metadata")))
    return out.drop("mixed_id", "mixed_data")


def backfill_participants(participants: DataFrame, pairs: DataFrame) -> DataFrame:
    """Boats with branch and metadata of their document (participant_id, new_branch, new_metadata); others as they are.

    Of several documents for one boat the least is taken.
    """
    found = pairs.groupBy(F.col("participant_id").alias("paired_id")).agg(F.min(F.struct("new_branch", "new_metadata")).alias("pair")).select("paired_id", "pair.*")
    joined = participants.join(found, F.col("id") == F.col("paired_id"), "left")
    return joined.withColumn("branch", F.coalesce("branch", "new_branch")).withColumn("metadata", add_element(F.col("metadata"), F.col("new_metadata"))).drop("paired_id", "new_branch", "new_metadata")


def backfill_penalties(pairs: DataFrame, penalties: DataFrame) -> DataFrame:
    """upsert_penalty for the documents (participant_id, penalty_reason, penalty_out, race_notes) that report a penalty.

    The race's notes become the penalty's note; empty ones are none.  A document without a reason and
    without a disqualification reports nothing.
    """
    reported = pairs.filter(F.col("penalty_reason").isNotNull() | F.coalesce("penalty_out", F.lit(False)))
    note = F.nullif(F.trim("race_notes"), F.lit(""))
    return upsert_penalty(reported.select("participant_id", F.col("penalty_reason").alias("reason"), F.coalesce("penalty_out", F.lit(False)).alias("disqualification"), note.alias("note")), penalties)


def flag_ref_names(flags: DataFrame, names: DataFrame, datasource: str) -> DataFrame:
    """Flags whose reference without a name takes the one of the first race that has exactly one.

    names: (flag_id, pos, race_names).
    """
    first = names.filter(F.size("race_names") == 1).groupBy("flag_id").agg(F.min_by(F.element_at("race_names", 1), "pos").alias("found_name"))
    joined = flags.join(first, F.col("id") == F.col("flag_id"), "left")
    named = F.transform("metadata", lambda m: m.withField("ref_name", F.when((m["datasource_name"] == datasource) & m["ref_name"].isNull(), F.col("found_name")).otherwise(m["ref_name"])))
    return joined.withColumn("metadata", named).drop("flag_id", "found_name")


def repeated_club_branches(participants: DataFrame) -> DataFrame:
    """(id, branch): the letter of boats whose club, gender and category occur more than once in a race."""
    groups = Window.partitionBy("race_id", "club_id", "gender", "category")
    letter = lambda x: F.exists("club_names", lambda n: n.endswith(f" {x}"))
    branch = F.when(letter("D"), "D").when(letter("C"), "C").when(letter("B"), "B")
    return participants.withColumn("n", F.count("*").over(groups)).filter("n > 1").select("id", branch.alias("branch"))

