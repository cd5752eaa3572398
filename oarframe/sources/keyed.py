"""Reference tables that are looked up again and again: bucketed and sorted by their keys (FLT-4 to FLT-6, SRC-7, SRC-11)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import new_path


def keyed(df: DataFrame, keys: list[str], buckets: int = 64) -> DataFrame:
    """df as a table in the shared folder, bucketed and sorted by keys.

    A join over all the keys reads it without shuffling it: only the other side is dealt to the
    buckets.  That pays where a table is joined more than once, as references are by every scan.  It
    is registered in the session's catalogue under a name of its own and stays until that is dropped.
    A bucket is read by one task, so a key that holds much of the table is better joined unbucketed.
    """
    name = f"oarframe_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", new_path(df.sparkSession)).saveAsTable(name)
    return df.sparkSession.table(name)
