"""Applying decision frames to a stored table: an upsert by key that survives being killed (MRG-2, MRG-5, MRG-9 to MRG-14).

The table is a folder of Parquet files in buckets of its keys.  An upsert rewrites the buckets that it
touches and no others, in three steps, each of which can be repeated:

1. the touched buckets, with the new rows in place of the stored ones, are written aside;
2. they replace the table's buckets, by Spark's dynamic overwrite of partitions;
3. a marker with the run's name is written.

A run that ended in step 1 is begun anew; one that ended in step 2, with some buckets replaced and
some not, finds its whole result aside and replaces all of them again; one that has its marker does
nothing.  So a repeated run gives the same table whenever it was killed.  One run writes at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt, materialize

BUCKET = "bucket"


class UpsertTable:
    """A table at path with unique keys."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self._data = f"{self.path}/data"

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _done(self, folder: str) -> bool:
        """Whether a write to a folder of this table has ended."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _write(self, df: DataFrame, folder: str, replace: str) -> None:
        # A bucket is one file of one task: it holds a fixed share of the keys, so more keys want more buckets.
        dealt = df.repartition(BUCKET)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", replace).partitionBy(BUCKET).parquet(folder)

    def create(self, df: DataFrame) -> UpsertTable:
        """Writes df as the whole table."""
        self._write(self._bucketed(df), self._data, "static")
        return self

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self._data)

    def upsert(self, rows: DataFrame, run: str) -> bool:
        """Puts rows in the place of stored rows with equal keys (nulls equal nulls), or adds them; false if the run was done before.

        rows have the table's columns, and each key once.  The table's columns and their types stay.
        """
        aside, marker = f"{self.path}/aside/{run}", f"{self.path}/done/{run}"
        if self._done(marker):
            return False
        stored = self._stored()
        if not self._done(aside):
            new = materialize(self._bucketed(rows).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in stored.schema]))
            touched = new.select(BUCKET).distinct()
            same = F.lit(True)
            for k in [BUCKET, *self.keys]:
                same = same & F.col(f"stored.{k}").eqNullSafe(F.col(f"new.{k}"))
            kept = stored.join(touched, BUCKET, "left_semi").alias("stored").join(dealt(new).alias("new"), same, "left_anti")
            self._write(kept.unionByName(new), aside, "static")
        self._replace(self.spark.read.schema(stored.schema).parquet(aside))
        self.spark.range(0).write.mode("overwrite").parquet(marker)
        return True

    def _replace(self, result: DataFrame) -> None:
        self._write(result, self._data, "dynamic")


def with_new_ids(rows: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """rows with an id: those without one get the numbers after the largest stored id, in the order of a unique column."""
    from ..operators.sorting import numbered_whole

    fresh = numbered_whole(rows.filter("id is null"), [F.col(order)])
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top_id"))
    numbered = fresh.crossJoin(F.broadcast(top)).withColumn("id", F.col("top_id") + F.col("position"))  # top is one row
    return rows.filter("id is not null").unionByName(numbered.select(*rows.columns))
