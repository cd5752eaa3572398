"""Metadata: arrays of source references (FN-24, FLT-4, MRG-6, MRG-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dealt


def element(ref_id: Column, datasource: Column, url: Column | None = None, ref_name: Column | None = None) -> Column:
    """One reference to a source; the url goes into the values."""
    none = F.lit(None).cast("string")
    values = F.create_map(F.lit("details_page"), url) if url is not None else F.expr("cast(map() as map<string,string>)")
    return F.struct((none if ref_id is None else ref_id).alias("ref_id"), (none if ref_name is None else ref_name).alias("ref_name"), datasource.alias("datasource_name"), values.alias("values"))


def build_race_metadata(race_ids: Column, datasource: Column, url: Column) -> Column:
    """An element for each id of a document, empty fields left out, as JSON; null without a url."""
    return F.when(url.isNotNull() & (url != ""), F.to_json(F.transform(race_ids, lambda r: element(r, datasource, url))))


def build_participant_metadata(datasource: Column) -> Column:
    """Participants have no reference of their own."""
    return F.to_json(F.array(F.struct(datasource.alias("datasource_name"))))


def collect_metadata(rows: DataFrame, refs: DataFrame, key: str, ref_key: str) -> DataFrame:
    """rows with `metadata`, the array of their references in order; an empty one if there is none."""
    fields = [c for c in ("pos", "datasource_name", "ref_id", "ref_name") if c in refs.columns]
    grouped = refs.groupBy(F.col(ref_key).alias("metadata_key")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("metadata"))
    joined = rows.join(dealt(grouped), F.col(key) == F.col("metadata_key"), "left").drop("metadata_key")
    return joined.withColumn("metadata", F.coalesce("metadata", F.expr(f"cast(array() as {grouped.schema['metadata'].dataType.simpleString()})")))


def metadata_contains(metadata: Column, datasource: str | Column, ref_id: str | Column | None = None) -> Column:
    """Whether some element has this source (and reference)."""
    name = datasource if isinstance(datasource, Column) else F.lit(datasource)
    ref = F.lit(ref_id) if isinstance(ref_id, str) else ref_id
    return F.exists(metadata, lambda d: (d["datasource_name"] == name) & (F.lit(True) if ref is None else d["ref_id"] == ref))


def add_element(metadata: Column, new: Column) -> Column:
    """The array with one element more, unless its source and reference are there already."""
    present = F.exists(metadata, lambda d: (d["datasource_name"] == new["datasource_name"]) & d["ref_id"].eqNullSafe(new["ref_id"]))
    return F.when(new.isNull() | F.coalesce(present, F.lit(False)), metadata).otherwise(F.concat(metadata, F.array(new)))


# Rewrites of older shapes (MRG-14).


def values_to_object(elements: Column) -> Column:
    """Ids become strings, a list of single-entry maps becomes one map; the first entry of a key wins."""
    def merged(d: Column) -> Column:
        entries = F.flatten(F.transform(d["values"], F.map_entries))
        keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        pick = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), 1)["value"]
        return F.map_from_arrays(keys, F.transform(keys, pick))

    return F.transform(elements, lambda d: F.struct(d["id"].cast("string").alias("ref_id"), d["datasource_name"].alias("datasource_name"), merged(d).alias("values")))


def gender_from_url(elements: Column) -> Column:
    """FEMALE if some page address speaks of women, else null."""
    return F.when(F.exists(elements, lambda d: F.coalesce(F.try_element_at(d["values"], F.lit("details_page")).rlike("(?i)femenin|neskak"), F.lit(False))), F.lit("FEMALE"))


def drop_empty_elements(elements: Column) -> Column:
    """Without the key gender, and without elements that then have no values."""
    lean = F.transform(elements, lambda d: d.withField("values", F.map_filter(d["values"], lambda k, _: k != "gender")))
    return F.filter(lean, lambda d: F.size(d["values"]) > 0)


def rename_source(elements: Column, league_id: Column, league: int, old: str, new: str) -> Column:
    """References of one league move from the old source name to the new one."""
    return F.when(league_id == league, F.transform(elements, lambda d: d.withField("datasource_name", F.when(d["datasource_name"] == old, F.lit(new)).otherwise(d["datasource_name"])))).otherwise(elements)


def single_name_to_array(name: Column) -> Column:
    """One name becomes an array of one; null or empty becomes an empty array."""
    return F.when(name.isNotNull() & (name != ""), F.array(name)).otherwise(F.expr("cast(array() as array<string>)"))
