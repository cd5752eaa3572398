"""Spelling variants: words one edit apart, by search schemes in shards of the vocabulary.

Of two words one edit apart, the one's left or right half stands unchanged at the same end of the
other.  So every word goes, as indexed word, to the shards of the halves that words of its own or a
neighbouring length could share with it (four at most), and as query to the shards of its own two
halves.  A task gathers shards into one bidirectional FM-index of their words and searches it for
their queries: the half exactly, the rest with one edit.  A shard with more words than LIMIT is cut
into blocks of words and blocks of queries, all of which meet.  Tasks send, for each query, the
number of near words and the best one, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .fmindex import BidirectionalIndex

PATTERN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIMIT = 8192
BATCH = 1 << 15  # rows, indexed words and queries, that share an index
QUERIES = 4096  # searched together
RATIO = 5  # a form is so many times as frequent
_LEFT, _RIGHT = 0, 1


def lettered_runs(docs: DataFrame) -> DataFrame:
    """(id, run) of (id, text): every maximal run of letters, A-Z lower-cased."""
    return docs.select("id", F.explode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))


def with_slips(runs: DataFrame, every: int = 199) -> DataFrame:
    """(word): the runs, but each whose checksum with its id is a multiple of `every` has lost a letter.  A null id counts as an empty one."""
    runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))))
    return runs.select(F.expr(f"if(h % {every} = 0, overlay(run placing '' from cast(h % char_length(run) as int) + 1 for 1), run)").alias("word"))


def vocabulary(words: DataFrame, min_length: int, min_count: int) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _shards(words: DataFrame, min_length: int) -> DataFrame:
    """(side, half, query, word, n): where each word is indexed and where it is looked for."""
    size = F.char_length("word")
    left, right = (lambda p: F.floor(p / 2).cast("int")), (lambda p: F.ceil(p / 2).cast("int"))
    lengths = F.filter(F.array(size - 1, size, size + 1), lambda p: p >= min_length)
    place = lambda side, query, cut: F.struct(F.lit(side).alias("side"), F.lit(query).alias("query"), cut.alias("cut"))
    places = F.concat(
        F.transform(F.array_distinct(F.transform(lengths, left)), lambda c: place(_LEFT, False, c)),
        F.transform(F.array_distinct(F.transform(lengths, right)), lambda c: place(_RIGHT, False, c)),
        F.array(place(_LEFT, True, left(size)), place(_RIGHT, True, right(size))),
    )
    half = F.when(F.col("side") == _LEFT, F.expr("left(word, cut)")).otherwise(F.expr("right(word, cut)"))
    return words.select("word", "n", F.inline(places)).select("side", half.alias("half"), "query", "word", "n")


def _in_blocks(shards: DataFrame, limit: int) -> DataFrame:
    """shards with a block: 0, or one of the blocks of words and queries that a crowded shard is cut into."""
    crowded = shards.filter(~F.col("query")).groupBy("side", "half").count().filter(F.col("count") > limit)
    crowded = materialize(crowded.select("side", "half", F.ceil(F.col("count") / limit).alias("cuts")))
    columns = ["side", "half", "query", "word", "n"]
    if crowded.isEmpty():
        return shards.select(*columns, F.lit(-1).cast("long").alias("block"))
    own = F.pmod(F.xxhash64("word"), F.col("cuts"))
    others = F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)
    met = F.when(F.col("query"), F.transform(others, lambda i: i * F.col("cuts") + own)).otherwise(F.transform(others, lambda j: own * F.col("cuts") + j))
    joined = shards.join(crowded, ["side", "half"], "left")
    return joined.select(*columns, F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(met)).alias("block"))


def _search(side: int, query: np.ndarray, words: np.ndarray, n: np.ndarray):
    """Yields (word, n_near, best_n, best) lists of the queries that have near words among the indexed ones."""
    held, first = np.unique(words[~query], return_index=True)
    if not len(held) or not query.any():
        return
    counts, index, asked = n[~query][first], BidirectionalIndex(held.tolist()), words[query].tolist()
    for lo in range(0, len(asked), QUERIES):
        part = asked[lo : lo + QUERIES]
        size = np.array([len(w) for w in part])
        q, w = index.one_error(part, size // 2 if side == _LEFT else size - size // 2, side == _RIGHT)
        if side == _RIGHT:  # words that begin with the query's left half too are found there
            new = np.array([not held[k].startswith(part[i][: len(part[i]) // 2]) for i, k in zip(q.tolist(), w.tolist())], bool)
            q, w = q[new], w[new]
        order = np.lexsort((w, -counts[w], q))  # held is in code-point order
        q, w = q[order], w[order]
        top = np.flatnonzero(np.diff(q, prepend=-1))
        yield [part[i] for i in q[top]], np.diff(np.append(top, len(q))), counts[w[top]], [held[k] for k in w[top]]


def _near(blocks: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best), summed over what each task holds, of (side, half, query, word, n, block)."""

    def solve(table: pa.RecordBatch):
        side, query, n, block = (table.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 4, 5))
        words = np.array(table.column(3).to_pylist(), object)
        half = np.array(table.column(1).to_pylist(), object)
        new = np.concatenate([[True], (side[1:] != side[:-1]) | (block[1:] != block[:-1]) | (half[1:] != half[:-1])])
        # Shards that were not cut share one index; a block of a cut one must meet its own words only.
        unit = np.where(block < 0, -1 - side, np.cumsum(new))
        for u in np.unique(unit):
            rows = np.flatnonzero(unit == u)
            for word, near, best_n, best in _search(int(side[rows[0]]), query[rows], words[rows], n[rows]):
                arrays = [pa.array(word, pa.string()), pa.array(near, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["word", "n_near", "best_n", "best"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < BATCH:
                continue
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = [np.array(table.column(i).to_pylist(), object) for i in (0, 1, 5)]
            other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from solve(table.slice(0, cut))
            held = [table.slice(cut)]  # the last shard may go on
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    dealt = blocks.repartition("side", "half", "block").sortWithinPartitions("side", "half", "block")
    return dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms, by doubling; chains grow in n, so none is a ring."""
    roots = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("at"), F.col("root").alias("further"))
        moved = materialize(roots.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return roots


def spelling_variants(words: DataFrame, min_length: int = 6, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n) of distinct words, each of min_length letters or more.

    n_near counts the words that differ by one inserted, deleted or replaced code point.  A word's form
    is the most frequent of them (ties: the least in code-point order) if it is at least `ratio` times
    as frequent, else null; ratio must exceed 1.  root is reached by following forms, and is the word
    itself if it has none.  An empty vocabulary gives no rows; rows with a null word or a shorter one are left out.
    """
    if ratio <= 1:
        raise ValueError("ratio must exceed 1, or forms could go in rings")
    words = materialize(words.select("word", "n").filter(F.char_length("word") >= min_length))
    near = _near(_in_blocks(_shards(words, min_length), limit))
    summed = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("top"))
    fits = -F.col("top.m") >= F.col("n") * ratio
    known = materialize(
        words.join(summed, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("top.best")).alias("form"), F.when(fits, -F.col("top.m")).alias("form_n")
        )
    )
    roots = _roots(known.filter("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, planted slips included; null texts have no words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return spelling_variants(vocabulary(with_slips(lettered_runs(docs)), 6, 5))
