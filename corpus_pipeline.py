"""From raw documents to token ids: language, near-duplicates, secrets, mixing, SentencePiece.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the
columns of documents.  ORACLE_SQL is None: the stages' hashes and models are beyond SQL, so the
pipeline is tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oarframe.llm import langid, minhash, mixing, secret_scan, sentencepiece_bpe
from oarframe.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SIMILARITY_PERCENT = 80
MAX_REPEATS = 1.5
ORACLE_SQL = None


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or far from every language that the labelled ones teach.

    A null or empty text has no letter and goes; if no row is labelled, every one goes.  Repeated rows
    and rows without id are judged by their text alone.
    """
    found = langid.identify(docs.select(*COLUMNS), langid.train(docs))
    return found.filter(~F.col("rejected")).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate class, in one row.

    Rows with equal ids are one document; if they differ, the least in the order of text, language,
    source and length stays.  Null, empty and blank texts are alike to nothing, and rows without id
    cannot be told apart, so these stay.
    """
    classes = materialize(minhash.near_duplicates(docs, percent=SIMILARITY_PERCENT, bands=30, rows=5).select("doc_id", "kept"))
    dropped = classes.filter(~F.col("kept")).select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti").select(*COLUMNS)
    repeated = materialize(classes.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    # An id may hold many rows, so the least is found by an aggregate that begins before the shuffle.
    rest = [c for c in COLUMNS if c != "doc_id"]
    ordered = F.struct("text", "lang", "source", "n_chars")
    least = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(ordered).alias("row"))
    return kept.join(repeated, "doc_id", "left_anti").unionByName(least.select("doc_id", *[F.col(f"row.{c}").alias(c) for c in rest])).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets, and the weak parts that complete them, by a mark; no row goes, null texts stay null."""
    clean = secret_scan.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Flattens the source shares as far as no source repeats more than MAX_REPEATS times.

    The budget is the least that uses every document once, so mixing repeats documents of small
    sources and loses none, but for sources without a single word: these have no share and go.  A null
    source is a source; rows with equal ids count as so many rows.
    """
    return mixing.mix_sources(docs.select(*COLUMNS), max_repeats=MAX_REPEATS, budget_share=None).select(*COLUMNS)


def encode_to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to its text (with ▁ read as a blank).

    A null or empty text has the end id alone.
    """
    coded = sentencepiece_bpe.encode_and_check(docs.select(*COLUMNS), sentencepiece_bpe.default_model(), add_eos=True)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("language ID", keep_known_language),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_to_weights),
    ("SentencePiece encoding and decoding", encode_to_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
