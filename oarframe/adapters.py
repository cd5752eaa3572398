"""The regatta tables derived from the driver's order tables.

The same text defines each table in Spark and in the SQL that results are compared with; only the
array constructors differ.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

_SPARK = {"ARR": "array", "S[]": "array<string>", "L[]": "array<bigint>"}
_DUCKDB = {"ARR": "list_value", "S[]": "VARCHAR[]", "L[]": "BIGINT[]"}

#: name -> (source tables, definition)
ADAPTER = {
    "race": (
        ("orders",),
        """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INT) AS yr,
  CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS day,
  CASE WHEN o_orderstatus = 'P' THEN 'TIME_TRIAL' ELSE 'CONVENTIONAL' END AS type,
  o_orderkey % 29 = 0 AS cancelled,
  CASE WHEN substring(o_orderpriority,1,1) = '5' THEN NULL ELSE CAST(substring(o_orderpriority,1,1) AS INT) END AS league_id,
  CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 11 END AS trophy_id,
  CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 40 END AS flag_id,
  CASE WHEN o_custkey % 3 = 0 THEN CAST(year(o_orderdate) AS INT) - 1980 - CAST(o_custkey % 4 AS INT) END AS trophy_edition,
  CASE WHEN o_custkey % 3 <> 0 THEN CAST(year(o_orderdate) AS INT) - 1980 - CAST(o_custkey % 4 AS INT) END AS flag_edition,
  CASE WHEN o_orderkey % 10 < 6 THEN 'MALE' WHEN o_orderkey % 10 < 9 THEN 'FEMALE' ELSE 'ALL' END AS gender,
  CASE WHEN o_orderkey % 8 < 6 THEN 'ABSOLUT' WHEN o_orderkey % 8 = 6 THEN 'VETERAN' ELSE 'ALL' END AS category,
  CASE WHEN o_orderkey % 5 = 0 THEN 'TRAINERILLA' ELSE 'TRAINERA' END AS modality,
  CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE o_custkey % 5 END AS place_id,
  CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE o_custkey % 9 + 1 END AS organizer_id,
  CASE WHEN o_orderkey % 6 = 0 THEN 'SPONSOR ' || CAST(o_custkey % 12 AS VARCHAR(9)) END AS sponsor,
  CAST(2 + o_orderkey % 3 AS INT) AS laps,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(3 + o_orderkey % 3 AS INT) END AS lanes,
  CASE WHEN o_orderkey % 19 = 0 THEN o_orderkey - 1 END AS same_as_id
FROM {orders}""",
    ),
    "participant": (
        ("lineitem",),
        """SELECT l_orderkey*100000000 + l_partkey*10000 + l_suppkey*10 + l_linenumber AS id,
  l_orderkey AS race_id, l_suppkey AS club_id,
  CASE WHEN l_partkey % 15 = 0 THEN ARR('CLUB ' || CAST(l_suppkey AS VARCHAR(9)) || ' B')
       WHEN l_partkey % 4 = 0 THEN CAST(ARR() AS S[])
       ELSE ARR('CLUB ' || CAST(l_suppkey AS VARCHAR(9))) END AS club_names,
  CASE WHEN l_partkey % 15 = 0 THEN 'B' END AS branch,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS lane,
  CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE 5000 + CAST(l_quantity AS INT) * 20 END AS distance,
  CASE WHEN l_discount > 0.095 THEN CAST(ARR() AS L[])
       ELSE ARR(300000 + l_partkey, 600000 + l_partkey,
                CAST(round(l_extendedprice * 100) AS BIGINT) % 360000 + 1140000) END AS laps_ms,
  CASE WHEN l_partkey % 10 < 6 THEN 'MALE' WHEN l_partkey % 10 < 9 THEN 'FEMALE' ELSE 'MIX' END AS gender,
  CASE WHEN l_suppkey % 8 < 6 THEN 'ABSOLUT' WHEN l_suppkey % 8 = 6 THEN 'VETERAN' ELSE 'SCHOOL' END AS category,
  l_returnflag = 'R' AND l_linenumber = 6 AS guest,
  l_linestatus = 'O' AND l_partkey % 20 = 0 AS retired,
  l_returnflag = 'A' AND l_linenumber = 5 AS absent
FROM {lineitem}""",
    ),
    "penalty": (
        ("lineitem",),
        """SELECT l_orderkey*100000000 + l_partkey*10000 + l_suppkey*10 + l_linenumber AS participant_id,
  l_tax > 0.075 AS disqualification,
  CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 3 = 1 THEN 'NO_LINE_START' ELSE 'COLLISION' END AS reason,
  ARR('note ' || CAST(l_partkey % 5 AS VARCHAR(9))) AS notes
FROM {lineitem} WHERE l_tax > 0.065""",
    ),
    "trophy": (
        ("orders",),
        """SELECT DISTINCT o_custkey % 11 AS id, CASE WHEN o_custkey % 11 = 3
  THEN 'Play Off ' || CAST(o_custkey % 11 AS VARCHAR(9)) ELSE 'TROFEO ' || CAST(o_custkey % 11 AS VARCHAR(9)) END AS name
  FROM {orders} WHERE o_custkey % 3 = 0""",
    ),
    "flag": (
        ("orders",),
        """SELECT DISTINCT o_custkey % 40 AS id, 'BANDERA ' || CAST(o_custkey % 40 AS VARCHAR(9)) AS name, o_custkey % 40 % 4 = 0 AS verified,
  CASE WHEN o_custkey % 40 % 5 = 0 THEN NULL ELSE CAST('1998-01-01' AS DATE) + CAST(o_custkey % 40 * 5 AS INT) END AS last_checked
  FROM {orders} WHERE o_custkey % 3 <> 0""",
    ),
    "league": (
        ("orders",),
        """SELECT DISTINCT CAST(substring(o_orderpriority,1,1) AS INT) AS id, 'LIGA ' || substring(o_orderpriority,1,1) AS name, 'L' || substring(o_orderpriority,1,1) AS symbol,
  CASE substring(o_orderpriority,1,1) WHEN '1' THEN 'MALE' WHEN '2' THEN 'FEMALE' END AS gender,
  CASE substring(o_orderpriority,1,1) WHEN '3' THEN 'VETERAN' END AS category
  FROM {orders} WHERE substring(o_orderpriority,1,1) <> '5'""",
    ),
    "club": (
        ("supplier",),
        """SELECT s_suppkey AS id, 'CLUB ' || CAST(s_suppkey AS VARCHAR(9)) AS name, 'Club de Remo ' || CAST(s_suppkey AS VARCHAR(9)) AS normalized_name,
  ARR('CLUB ' || CAST(s_suppkey AS VARCHAR(9)), s_name) AS known_names, s_suppkey % 10 = 0 AS is_partnership, s_suppkey % 9 <> 0 AS is_active,
  CASE WHEN s_suppkey % 10 = 3 THEN s_suppkey - 3 END AS fused_into
  FROM {supplier}""",
    ),
    "place": (("orders",), "SELECT DISTINCT o_custkey % 5 AS id, CASE WHEN o_custkey % 5 = 2 THEN 'ASIA' ELSE 'PLACE ' || CAST(o_custkey % 5 AS VARCHAR(9)) END AS name, o_custkey % 5 AS town_id FROM {orders}"),
    "town": (("region",), "SELECT r_regionkey AS id, r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'NORTH' ELSE 'SOUTH' END AS province FROM {region}"),
    "entity": (
        ("part",),
        "SELECT p_name AS name, min(p_partkey) AS id, min(p_partkey) % 9 <> 0 AS is_active FROM {part} GROUP BY p_name",
    ),
    "query_name": (("part",), "SELECT DISTINCT upper(substring(p_name, 2, 40)) AS q FROM {part}"),
    #: Metadata elements of races, participants and flags, one row for each.
    "race_ref": (
        ("orders",),
        """SELECT o_orderkey AS race_id, 0 AS pos, CASE o_orderkey % 3 WHEN 0 THEN 'act' WHEN 1 THEN 'arc' ELSE 'ete' END AS datasource_name,
  CAST(o_orderkey % 5000 AS VARCHAR(9)) AS ref_id FROM {orders}
  UNION ALL SELECT o_orderkey, 1, 'traineras', CAST(o_orderkey + 7 AS VARCHAR(9)) FROM {orders} WHERE o_orderkey % 4 = 0""",
    ),
    "flag_ref": (("orders",), "SELECT DISTINCT o_custkey % 40 AS flag_id, 'traineras' AS datasource_name, CAST(o_custkey % 40 + 300 AS VARCHAR(9)) AS ref_id, CASE WHEN o_custkey % 40 % 3 = 0 THEN 'FLAG ' || CAST(o_custkey % 40 AS VARCHAR(9)) END AS ref_name FROM {orders} WHERE o_custkey % 3 <> 0"),
    #: Race documents as they land: one for each race; those whose number is a multiple of four are already stored.
    "doc": (
        ("orders",),
        """SELECT o_orderkey AS pos, CASE o_orderkey % 3 WHEN 0 THEN 'act' WHEN 1 THEN 'arc' ELSE 'ete' END AS datasource,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 5000 AS VARCHAR(9)) ELSE 'n' || CAST(o_orderkey AS VARCHAR(9)) END AS ref_id,
  CASE WHEN o_custkey % 3 = 0 THEN 'TROFEO ' || CAST(o_custkey % 11 AS VARCHAR(9)) ELSE 'BANDERA ' || CAST(o_custkey % 40 AS VARCHAR(9)) END AS name,
  CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS day,
  CASE WHEN o_orderkey % 12 = 0 THEN 'FEMALE' WHEN o_orderkey % 10 < 6 THEN 'MALE' WHEN o_orderkey % 10 < 9 THEN 'FEMALE' ELSE 'ALL' END AS gender,
  CASE WHEN o_orderkey % 8 < 6 THEN 'ABSOLUT' WHEN o_orderkey % 8 = 6 THEN 'VETERAN' ELSE 'ALL' END AS category,
  CASE WHEN substring(o_orderpriority,1,1) = '5' THEN NULL ELSE 'LIGA ' || substring(o_orderpriority,1,1) END AS league,
  CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 11 END AS trophy_id, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 40 END AS flag_id,
  CASE WHEN o_custkey % 3 = 0 THEN CAST(year(o_orderdate) AS INT) - 1980 - CAST(o_custkey % 4 AS INT) END AS trophy_edition,
  CASE WHEN o_custkey % 3 <> 0 THEN CAST(year(o_orderdate) AS INT) - 1980 - CAST(o_custkey % 4 AS INT) END AS flag_edition,
  CAST(2 + o_orderkey % 2 AS INT) AS laps, CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE CAST(3 + o_orderkey % 4 AS INT) END AS lanes,
  CASE WHEN o_orderkey % 16 = 0 THEN 'NEW SPONSOR' END AS sponsor
FROM {orders}""",
    ),
}


def _fill(text: str, words: dict[str, str], tables: dict[str, str]) -> str:
    for mark, value in words.items():
        text = text.replace(mark, value)
    for name, value in tables.items():
        text = text.replace("{" + name + "}", value)
    return text


def duckdb_ctes() -> str:
    """All tables as common table expressions for the comparison SQL."""
    return ",\n".join(f"{name} AS ({_fill(text, _DUCKDB, {s: s for s in sources})})" for name, (sources, text) in ADAPTER.items())


class Tables:
    """Driver tables as attributes (t.orders), and the domain tables derived from them (t.race)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in ADAPTER:
            sources, text = ADAPTER[name]
            made = self.spark.sql(_fill(text, _SPARK, {}), **{s: getattr(self, s) for s in sources})
        else:
            made = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        setattr(self, name, made)
        return made

    @cached_property
    def race_with_metadata(self) -> DataFrame:
        from .functions.metadata import collect_metadata

        return collect_metadata(self.race, self.race_ref, "id", "race_id")

    @cached_property
    def flag_with_metadata(self) -> DataFrame:
        from .functions.metadata import collect_metadata

        return collect_metadata(self.flag, self.flag_ref, "id", "flag_id")
