"""Speeds, lap times and dates (FN-1 to FN-6, FN-21 to FN-23)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_lap(laps_ms: Column) -> Column:
    """The finish time; null for no laps."""
    return F.try_element_at(laps_ms, F.lit(-1))


def speed_kmh(distance_m: Column, laps_ms: Column) -> Column:
    """Kilometres an hour over the whole distance, as a double; null without distance or laps."""
    return distance_m / (last_lap(laps_ms) / F.lit(1000.0)) * F.lit(3.6)


def lap_ms(text: Column) -> Column:
    """Milliseconds of `MM:SS.ffffff`, minutes and seconds below 60; null for anything else."""
    shaped = text.rlike(r"^[0-5]?[0-9]:[0-5]?[0-9]\.[0-9]{1,6}$")
    minutes, rest = F.split_part(text, F.lit(":"), F.lit(1)), F.split_part(text, F.lit(":"), F.lit(2))
    seconds, fraction = F.split_part(rest, F.lit("."), F.lit(1)), F.split_part(rest, F.lit("."), F.lit(2))
    value = minutes.cast("long") * 60000 + seconds.cast("long") * 1000 + F.substring(F.rpad(fraction, 6, "0"), 1, 3).cast("long")
    return F.when(shaped, value)


def laps_ms(texts: Column) -> Column:
    return F.transform(texts, lap_ms)


def source_date(text: Column) -> Column:
    """The date of `dd/MM/yyyy`; null for anything else."""
    return F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_timestamp(text, F.lit("dd/MM/yyyy")).cast("date"))


def clock(ms: Column) -> Column:
    """`MI:SS.MS` of a time, hours dropped."""
    within = F.pmod(ms, F.lit(3600000))
    part = lambda value, width: F.lpad(value.cast("string"), width, "0")
    return F.concat(part(F.floor(within / 60000), 2), F.lit(":"), part(F.floor(within / 1000) % 60, 2), F.lit("."), part(within % 1000, 3))


def clean_club_name(text: Column) -> Column:
    return F.trim(F.upper(F.replace(text, F.lit("."), F.lit(""))))


def lane_of(race_type: Column, lane: Column) -> Column:
    """Time trials have one lane."""
    return F.when(race_type == "TIME_TRIAL", F.lit(1)).otherwise(lane)


def retired_of(retired: Column, disqualified: Column) -> Column:
    return retired & ~F.coalesce(disqualified, F.lit(False))
