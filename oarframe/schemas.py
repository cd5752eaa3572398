"""Schemas of the domain tables, of metadata and of race documents; enumerated domains."""

from __future__ import annotations

from pyspark.sql import types as T

METADATA_TYPE = "struct<datasource:array<struct<ref_id:string,ref_name:string,datasource_name:string,date:string,values:map<string,string>,data:string>>>"
RACE_DOCUMENT = (
    "name string, date string, day int, modality string, type string, league string, town string, organizer string, sponsor string, "
    "normalized_names array<array<string>>, race_ids array<string>, url string, datasource string, gender string, category string, "
    "race_notes string, race_laps int, race_lanes int, cancelled boolean, "
    "participants array<struct<gender:string,category:string,club_name:string,lane:int,series:int,laps:array<string>,distance:int,"
    "handicap:string,retired:boolean,absent:boolean,guest:boolean,participant:string,penalty:struct<reason:string,disqualification:boolean>>>"
)

TABLE_DDL = {
    "league": "id long, name string, symbol string, parent_id long, gender string, category string, from_date timestamp, to_date timestamp, is_active boolean",
    "entity": f"id long, name string, normalized_name string, known_names array<string>, type string, symbol string, is_partnership boolean, town_id long, parent_id long, metadata {METADATA_TYPE}, from_date timestamp, to_date timestamp, is_active boolean",
    "entity_partnership": "target_id long, part_id long, is_active boolean",
    "town": "id long, name string, province string, known_names array<string>",
    "place": "id long, name string, town_id long",
    "trophy": "id long, name string, tokens array<string>, verified boolean, qualifies_for_id long, creation_date timestamp",
    "flag": f"id long, name string, tokens array<string>, verified boolean, qualifies_for_id long, last_checked date, metadata {METADATA_TYPE}",
    "race": f"id long, laps short, lanes short, type string, date date, day short, cancelled boolean, cancellation_reasons array<string>, race_names array<string>, sponsor string, trophy_edition int, trophy_id long, flag_edition int, flag_id long, league_id long, gender string, category string, modality string, organizer_id long, place_id long, associated_id long, same_as_id long, has_weird_speeds boolean, metadata {METADATA_TYPE}",
    "participant": f"id long, club_names array<string>, branch string, club_id long, race_id long, distance int, laps_ms array<long>, lane short, series short, handicap_ms long, gender string, category string, guest boolean, absent boolean, retired boolean, metadata {METADATA_TYPE}",
    "penalty": "id long, penalty int, disqualification boolean, reason string, participant_id long, notes array<string>",
}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLE_DDL[table])


# The enumerated domains.
RACE_TYPES = ("CONVENTIONAL", "TIME_TRIAL")
MODALITIES = ("TRAINERA", "TRAINERILLA", "BATEL")
PARTICIPANT_CATEGORIES = ("ABSOLUT", "VETERAN", "SCHOOL")
RACE_CATEGORIES = ("ABSOLUT", "VETERAN", "SCHOOL", "ALL")
ENTITY_TYPES = ("CLUB", "LEAGUE", "FEDERATION", "PRIVATE")
PARTICIPANT_GENDERS = ("MALE", "FEMALE", "MIX")
RACE_GENDERS = ("MALE", "FEMALE", "ALL")
PENALTY_REASONS = (
    "BOAT_WEIGHT_LIMIT", "COLLISION", "COXWAIN_WEIGHT_LIMIT", "LACK_OF_COMPETITIVENESS", "NO_LINE_START", "NULL_START",
    "OFF_THE_FIELD", "SINKING", "STARBOARD_TACK", "WRONG_LINEUP", "WRONG_ROUTE",
)
