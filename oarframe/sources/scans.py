"""Scans over landed race documents (SRC-5 to SRC-11)."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1951, 2099


def in_years(date: Column, years: list[int]) -> Column:
    """Whether a date lies in one of the years: ranges of dates, which a scan can skip row groups by."""
    days, spans = F.lit(False), []
    for y in sorted(set(years)):
        if spans and spans[-1][1] == y:
            spans[-1][1] = y + 1
        else:
            spans.append([y, y + 1])
    for first, end in spans:
        days = days | ((date >= F.lit(datetime.date(first, 1, 1))) & (date < F.lit(datetime.date(end, 1, 1))))
    return days


def scan_by_year(docs: DataFrame, years: list[int] | str, current_year: int | None = None, first_year: int = FIRST_YEAR) -> DataFrame:
    """Documents of the years; 'all' runs from first_year to current_year.  Years outside 1951 to 2099 raise."""
    if years == "all":
        years = list(range(first_year, (current_year or LAST_YEAR) + 1))
    if any(not FIRST_YEAR <= y <= LAST_YEAR for y in years):
        raise ValueError(f"years lie between {FIRST_YEAR} and {LAST_YEAR}")
    return docs.filter(in_years(F.col("date"), years))


def scan_last_weekend(docs: DataFrame, as_of: str) -> DataFrame:
    """Documents of the most recent Saturday and Sunday at or before a day."""
    day = F.to_date(F.lit(as_of))
    sunday = F.date_sub(day, F.dayofweek(day) - 1)
    saturday = F.when(F.dayofweek(day) == 7, day).otherwise(F.date_sub(sunday, 1))
    return docs.filter(F.col("date").between(saturday, F.least(F.date_add(saturday, 1), day)))


def scan_by_ids(docs: DataFrame, ids: DataFrame, table: int | None = None) -> DataFrame:
    """Documents of the ids (datasource, ref_id); a table of a page can be asked for with one id."""
    found = docs.join(ids.select("datasource", "ref_id"), ["datasource", "ref_id"], "left_semi")
    return found if table is None else found.filter(F.col("table") == table)


def scan_by_club(docs: DataFrame, club_ref: str, year: int) -> DataFrame:
    return docs.filter(in_years(F.col("date"), [year]) & F.array_contains("club_refs", club_ref))


def scan_by_entity(docs: DataFrame, entity_refs: DataFrame, entity_id: int, year: int, datasource: str) -> DataFrame:
    """Documents of the club whose reference in this source comes first for the entity; none without one."""
    own = entity_refs.filter((F.col("entity_id") == entity_id) & (F.col("datasource_name") == datasource))
    first = own.groupBy("entity_id").agg(F.min_by("ref_id", "pos").alias("club_ref"))
    of_year = docs.filter(in_years(F.col("date"), [year]))
    return of_year.join(F.broadcast(first), F.expr("array_contains(club_refs, club_ref)"), "left_semi")  # first is one row at most


def scan_by_flag(docs: DataFrame, flag: str, position: str, include_existing: bool = False, only_new: bool = False) -> DataFrame:
    """All editions of a flag's pages (columns flag, known, `position`).

    Known ones are left out unless include_existing; only_new reads the newest first and stops at
    the first page that yields nothing.
    """
    pages = docs.filter(F.col("flag") == flag)
    if only_new:
        from ..operators.rollups import before_first_known

        return before_first_known(pages, "flag", position, "known")
    return pages if include_existing else pages.filter(~F.col("known"))


def drop_future(docs: DataFrame, as_of: str) -> DataFrame:
    return docs.filter(F.col("date") <= F.to_date(F.lit(as_of)))


def drop_known(docs: DataFrame, refs: DataFrame, ignored: DataFrame | None = None, include_existing: bool = False) -> DataFrame:
    """Documents that are not ignored and that no race refers to; include_existing lifts the second test alone."""
    keys = ["datasource", "ref_id"]
    left = docs if ignored is None else docs.join(ignored.select(*keys), keys, "left_anti")
    if include_existing:
        return left
    return left.join(refs.select(F.col("datasource_name").alias("datasource"), "ref_id"), keys, "left_anti")
