"""Stupid-backoff scores from n-gram count tables partitioned by hash.

1. Documents are taken in chunks of some megabytes; a chunk row holds its words as numbers into its
   own vocabulary of word hashes, frequent words first (one shuffle by chunk, read twice).
2. Each chunk counts its distinct n-grams of every order: the pre-aggregation.  They leave as arrays
   of hashes and counts, one for each range of the hash space (bucket), so that one shuffle by bucket
   moves little more than the hashes themselves.
3. There the arrays are exploded to rows (hash, chunk, place, count).  A sum over all rows of a hash is
   its entry in the count table, and joins the total to each row without another shuffle.
4. Totals that differ from the chunk's own count go back to the chunk, whose tokens look up their
   n-grams; the logarithms are summed by document.

A frequent n-gram has one row for each chunk, however often it occurs, and totals over such a row
group spill to disk, so no key is hot.  The number of buckets grows with the tokens, which bounds
what one task holds; arrays then get shorter, down to single rows, and never outnumber the n-grams.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix, pieces, text_buffers, word_hashes

CHUNK = 6 << 20
BUCKET_TOKENS = 1 << 18
SMALL = 1 << 15  # places and totals below it travel in two bytes
WORD = r"[^\x20\x09-\x0D]+"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def pack_numbers(values: np.ndarray) -> bytes:
    """Unsigned numbers in as many bytes each as the largest needs; that width comes first."""
    values = values.astype("<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_numbers(packed: bytes) -> np.ndarray:
    width = packed[0]
    out = np.zeros(((len(packed) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as packed steps."""
    return pack_numbers(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(packed), dtype=np.uint64)


def pack_ranks(ranks: np.ndarray) -> bytes:
    """Numbers of which small ones are frequent, byte place by byte place and compressed."""
    packed = pack_numbers(ranks)
    return packed[:1] + zlib.compress(np.frombuffer(packed, np.uint8, offset=1).reshape(-1, packed[0]).T.tobytes(), 1)


def unpack_ranks(packed: bytes) -> np.ndarray:
    places = np.frombuffer(zlib.decompress(packed[1:]), np.uint8).reshape(packed[0], -1)
    return unpack_numbers(packed[:1] + places.T.tobytes())


def _chunks(docs: DataFrame) -> DataFrame:
    """(chunk, n_tokens, ids, first, words, vocab) of (id, text); first, words and vocab are packed numbers."""

    def row(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        hashes, first = word_hashes(*text_buffers(table.column(1)))
        vocab, words, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        vocab, words = vocab[order], rank[words]
        chunk = (TaskContext.get().partitionId() << 32) + number
        packed = [pack_sorted(first), pack_ranks(words), pack_numbers(vocab)]
        ids = pa.array([table.column(0).to_pylist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([len(words)]), ids, *[pa.array([p], pa.binary()) for p in packed]], names=["chunk", "n_tokens", "ids", "first", "words", "vocab"])

    def run(batches):
        held, size, number = [], 0, 0
        for batch in batches:
            _, at = text_buffers(batch.column(1))
            for lo, hi in pieces(at, CHUNK // 4):
                held.append(batch.slice(lo, hi - lo))
                size += int(at[hi] - at[lo])
                if size >= CHUNK:
                    yield row(number, held)
                    held, size, number = [], 0, number + 1
        if held:
            yield row(number, held)

    return docs.mapInArrow(run, "chunk long, n_tokens long, ids array<long>, first binary, words binary, vocab binary")


class ChunkGrams:
    """A chunk's distinct n-grams of all orders, sorted by hash, and which of them ends at each token.

    at[n - 1] has the place of the n-gram that ends at each token, or -1.
    """

    def __init__(self, first: bytes, words: bytes, vocab: bytes, order: int):
        self.first = unpack_sorted(first).astype(np.int64)
        words = unpack_ranks(words).astype(np.int64)
        base = unpack_numbers(vocab)
        self.place = np.arange(len(words), dtype=np.int32) - np.repeat(self.first[:-1], np.diff(self.first)).astype(np.int32)
        hashes, counts, at = [base], [np.bincount(words, minlength=len(base))], [words]
        for n in range(2, order + 1):
            ends = np.flatnonzero(self.place >= n - 1)
            code = at[-1][ends - 1].astype(np.int64) * len(base) + words[ends]
            distinct, which, seen = np.unique(code, return_inverse=True, return_counts=True)
            left, right = np.divmod(distinct, max(1, len(base)))
            hashes.append(mix(mix(hashes[-1][left] * _STEP + np.uint64(n)) + base[right]))
            counts.append(seen)
            at.append(np.full(len(words), -1, np.int32))
            at[-1][ends] = which
        sizes = [len(h) for h in hashes]
        hashes = np.concatenate(hashes)
        by_hash = np.argsort(hashes, kind="stable")
        rank = np.empty(len(by_hash) + 1, np.int32)
        rank[by_hash], rank[-1] = np.arange(len(by_hash)), -1
        self.hashes, self.counts = hashes[by_hash], np.concatenate(counts)[by_hash]
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.at = [rank[np.where(x >= 0, x + begin, len(by_hash))] for x, begin in zip(at, begins)]


def _gram_arrays(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    """(bucket, chunk, start, hashes, counts): stretches of the chunks' n-grams by hash, start is the place of the first."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, first, words, vocab = (batch.column(k)[i].as_py() for k in (0, 3, 4, 5))
                grams = ChunkGrams(first, words, vocab, order)
                bucket = (grams.hashes >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)
                stretch = np.flatnonzero(np.diff(bucket, prepend=-1))
                inside = np.arange(len(bucket)) - np.repeat(stretch, np.diff(np.append(stretch, len(bucket))))
                start = np.flatnonzero(inside % SMALL == 0)  # no stretch is longer than SMALL
                edges = pa.array(np.append(start, len(bucket)), pa.int32())
                hashes = pa.ListArray.from_arrays(edges, pa.array(grams.hashes.view(np.int64)))
                counts = pa.ListArray.from_arrays(edges, pa.array(grams.counts.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[start]), pa.array(np.full(len(start), chunk)), pa.array(start.astype(np.int32)), hashes, counts], names=["bucket", "chunk", "start", "hashes", "counts"])

    # All columns go in, so that the shuffle of the chunks is the one that scoring reads.
    return chunks.mapInArrow(run, "bucket long, chunk long, start int, hashes array<long>, counts array<int>")


def _totals(arrays: DataFrame) -> DataFrame:
    """(chunk, start, places, totals, far_places, far_totals): the corpus counts of the n-grams that occur outside their chunk too.

    Places count from start; totals of SMALL and more stand in lists of their own.
    """
    grams = arrays.repartition("bucket").select("bucket", "chunk", "start", "counts", F.posexplode("hashes").alias("i", "hash"))
    rows = grams.select("bucket", "chunk", "start", F.col("i").cast("short").alias("i"), "hash", F.get("counts", F.col("i")).alias("n"))
    # The rows of a hash lie in one bucket, so the sums need no further shuffle.
    totalled = rows.withColumn("total", F.sum("n").over(Window.partitionBy("hash", "bucket")))
    told, small = totalled.filter(F.col("total") != F.col("n")), F.col("total") < SMALL
    listed = lambda test, value, name: F.collect_list(F.when(test, value)).alias(name)
    return told.groupBy("bucket", "chunk", "start").agg(
        listed(small, F.col("i"), "places"), listed(small, F.when(small, F.col("total")).cast("short"), "totals"),
        listed(~small, F.col("i"), "far_places"), listed(~small, F.col("total"), "far_totals"),
    ).drop("bucket")


def backoff_logs(grams: ChunkGrams, totals: np.ndarray, n_tokens: int, factor: float, min_count: int) -> np.ndarray:
    """The logarithm of every token's stupid-backoff score; totals are those of grams.hashes."""
    if not len(grams.place):
        return np.zeros(0)
    value = np.log(totals[grams.at[0]] / n_tokens)
    for n in range(2, len(grams.at) + 1):  # a longer n-gram that is known overrides what its shorter ones gave
        value = np.where(grams.place >= n - 1, value + np.log(factor), value)
        at = grams.at[n - 1]
        ends = np.flatnonzero(at >= 0)
        ends = ends[totals[at[ends]] >= min_count]
        value[ends] = np.log(totals[at[ends]] / totals[grams.at[n - 2][ends - 1]])
    return value


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, factor: float = 0.4, min_count: int = 2, from_files: bool = False) -> DataFrame:
    """(id_col, n_tokens, log_score, mean_log) of every row, under the n-gram counts of all rows.

    Words are runs of other characters than white space, A-Z lower-cased.  An n-gram of two or more
    words counts if it occurs min_count times in df; else the score is `factor` times that of the
    n-gram without its first word; single words score their share of all words.  The first words of a
    text have only the context there is.  A text without words (null, empty) has 0 tokens, a log_score
    of 0 and a null mean.  Repeated rows count and are scored each time; ids may be null.

    from_files says that df only reads files, so that a task that runs again sees the same rows in the
    same order; other frames are written to the shared folder first.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    docs = docs if from_files else materialize(docs)
    n_tokens = docs.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    bits = max(3, (max(1, n_tokens // BUCKET_TOKENS) - 1).bit_length())
    chunks = _chunks(docs).repartition("chunk")
    replies = _totals(_gram_arrays(chunks, order, bits))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i in range(left.num_rows):
            ids, first, words, vocab = (left.column(c)[i].as_py() for c in ("ids", "first", "words", "vocab"))
            grams = ChunkGrams(first, words, vocab, order)
            totals = grams.counts.astype(np.float64)
            starts = right.column("start").to_numpy()
            for places, found in (("places", "totals"), ("far_places", "far_totals")):
                lists, values = right.column(places).combine_chunks(), right.column(found).combine_chunks()
                at = np.repeat(starts, lists.value_lengths().to_numpy()) + lists.flatten().to_numpy()
                totals[at] = values.flatten().to_numpy()
            logs = backoff_logs(grams, totals, n_tokens, factor, min_count)
            owner = np.repeat(np.arange(len(ids)), np.diff(grams.first))
            sums = np.bincount(owner, weights=logs, minlength=len(ids)).astype(np.float64)
            out.append(pa.table({"id": pa.array(ids, pa.int64()), "n_tokens": np.diff(grams.first), "log_score": sums}))
        return pa.concat_tables(out)

    scored = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(score, "id long, n_tokens long, log_score double")
    return scored.select(F.col("id").alias(id_col), "n_tokens", "log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).alias("mean_log"))


def op10_backoff_scores(spark, sf_dir: str) -> DataFrame:
    """Bigram stupid-backoff scores of all documents under the counts of all documents."""
    scored = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), from_files=True)
    return scored.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log", 6).alias("mean_log"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
n AS (SELECT count(*)::DOUBLE AS n FROM w),
one AS (SELECT w, count(*) AS c FROM w GROUP BY w),
g AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w),
two AS (SELECT p, w, count(*) AS c FROM g WHERE p IS NOT NULL GROUP BY p, w),
s AS (
  SELECT g.doc_id, CASE WHEN g.p IS NULL THEN ln(one.c / n.n)
    WHEN two.c >= 2 THEN ln(two.c / before.c::DOUBLE) ELSE ln(one.c / n.n) + ln(0.4::DOUBLE) END AS v
  FROM g JOIN one USING (w) CROSS JOIN n LEFT JOIN two ON two.p = g.p AND two.w = g.w LEFT JOIN one AS before ON before.w = g.p)
SELECT d.doc_id, count(s.v) AS n_tokens, round(coalesce(sum(s.v), 0), 4) AS log_score,
  CASE WHEN count(s.v) > 0 THEN round(sum(s.v) / count(s.v), 6) END AS mean_log
FROM documents AS d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""
