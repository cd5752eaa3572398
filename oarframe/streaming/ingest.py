"""STR-1: landed race documents as a stream that loses none, merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import RACE_DOCUMENT
from ..session import dealt, materialize
from ..sources.scans import drop_known

ANY_AGE = "36500d"
KEYS = ["datasource", "ref_id"]
_LEDGER = "datasource string, ref_id string, batch long"


def document_stream(spark: SparkSession, landing: str, lines: bool = False) -> DataFrame:
    """Documents as they land, one in each file or line, with ref_id (the first race id), landed_at and landed_in (the file).

    Nothing is dropped here: a file is read however old it is beside the newest one (the source's own
    age limit is lifted), so the source remembers the names of all files that it has read.
    """
    raw = spark.readStream.schema(RACE_DOCUMENT).option("multiLine", not lines).option("maxFileAge", ANY_AGE).json(landing)
    return raw.select("*", F.try_element_at("race_ids", F.lit(1)).alias("ref_id"), F.col("_metadata.file_modification_time").alias("landed_at"), F.col("_metadata.file_path").alias("landed_in"))


_LANDED = ["landed_at", "landed_in", "content"]


def with_content(docs: DataFrame) -> DataFrame:
    """docs with `content`, a digest of all but time and file."""
    own = F.struct(*[c for c in docs.columns if c not in ("landed_at", "landed_in")])
    return docs.withColumn("content", F.sha2(F.to_json(own), 256))


def first_of_each(docs: DataFrame) -> DataFrame:
    """Of each key the time, file and content of the document that landed first; equal times go by file and content, so a repeated run chooses alike."""
    return docs.groupBy(*KEYS).agg(F.min(F.struct(*_LANDED)).alias("first")).select(*KEYS, "first.*")


class Ledger:
    """The keys that batches have handed on, a folder for each batch, in the shared folder.

    It takes the place of a stream's state: it is read by a join and not held in memory, and it knows
    a document however late it comes again.  A batch overwrites its own folder, so running it again
    changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.record(spark.createDataFrame([], "datasource string, ref_id string"), -1)

    def others(self, batch_id: int) -> DataFrame:
        """Keys of all batches before this one: what a repeated batch may not leave out is its own."""
        held = self.spark.read.schema(_LEDGER).parquet(self.path)
        return held.filter(F.col("batch") < batch_id).select("datasource", "ref_id")

    def record(self, docs: DataFrame, batch_id: int) -> None:
        docs.select(*KEYS).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


def ingest_stream(
    spark: SparkSession,
    landing: str,
    checkpoint: str,
    known: Callable[[], DataFrame],
    merge: Callable[[DataFrame, int], None],
    unidentified: Callable[[DataFrame, int], None] | None = None,
    ledger: str | None = None,
    lines: bool = False,
) -> StreamingQuery:
    """Starts the stream: each batch's unknown documents go to merge(batch, batch_id), each (datasource, ref_id) once.

    known() gives the references (datasource_name, ref_id) that stored races have; the ledger (a folder
    beside the checkpoint, if none is named) has those that earlier batches handed on, so a document
    that lands again is left out even if its race was not stored.  Documents without a source or a race
    id cannot be told apart: all of them go to unidentified(batch, batch_id), or to merge with the
    others if that is not given.  No document is dropped for being late.  merge's batch is read from
    the landed files each time that it is used.

    merge and unidentified must be idempotent by batch_id (overwrite a folder named by it, or upsert by
    key).  If a run ends between merge and the ledger, the batch comes again with the same number, finds
    its own keys in no earlier batch, and hands on the same documents.  An empty part is handed on too.
    """
    seen = Ledger(spark, ledger or f"{checkpoint.rstrip('/')}-ledger")

    def batch(docs: DataFrame, batch_id: int) -> None:
        named = F.col("datasource").isNotNull() & F.col("ref_id").isNotNull()
        nameless = docs.filter(~named)
        earlier = seen.others(batch_id).withColumnRenamed("datasource", "datasource_name")
        keyed = with_content(docs.filter(named))
        # Only keys and digests are written; documents are read again from where they landed, with the columns that merge uses.
        chosen = materialize(drop_known(drop_known(first_of_each(keyed), earlier), known()))
        fresh = keyed.join(dealt(chosen), [*KEYS, *_LANDED], "left_semi").dropDuplicates(KEYS).select(*docs.columns)
        if unidentified is None:
            merge(fresh.unionByName(nameless), batch_id)
        else:
            merge(fresh, batch_id)
            unidentified(nameless, batch_id)
        seen.record(chosen, batch_id)

    return document_stream(spark, landing, lines=lines).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
