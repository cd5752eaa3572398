"""Ranked lexical search: posting lists cut into blocks of similar documents, with exact skipping.

1. A pass over all texts keeps, for each document, its length and the counts of the terms that the
   query items have; the corpus counts N, L and df come from these rows.
2. A task takes documents in shards of bounded size.  In a shard each term's posting list is clustered
   by the similarity of whole documents into blocks of about BLOCK, and each block is summarised by
   the coordinatewise maximum of its documents' impacts.
3. A list's blocks are visited by all items that have its term.  A block is skipped only if its
   summary, multiplied with the item, stays below the item's k-th best score so far; the documents of
   all other blocks are scored in full.  So the ranking is exact.
4. Each task sends k documents an item at most, and a window ranks these.

The items are handled in blocks of ITEMS; only one block's terms are sent to the tasks at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, CHUNK_BYTES, materialize, pieces, text_buffers

ITEMS = 512  # items searched together
CELLS = 1 << 24  # documents times terms of a shard
BLOCK = 16  # documents of a block, on average
SKETCH = 16  # dimensions in which documents are clustered
SCALE = 1_000_000_000

_TERM = np.ones(256, bool)
_TERM[:0x80] = False
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _TERM[_first : _last + 1] = True


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of term bytes inside the texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[True], ~inside[:-1]]) | cut[:-1]
    after = np.concatenate([~inside[1:], [True]]) | cut[1:]
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def terms_of(text: str | None) -> list[bytes]:
    """The terms of one text, A-Z lower-cased, in order."""
    data = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(*(x.tolist() for x in term_spans(data, np.array([0, len(data)]))))]


class Vocabulary:
    """Numbers of a fixed set of terms, looked up for many spans at once."""

    def __init__(self, terms: list[bytes]):
        self.terms = sorted(terms)
        self.lengths = np.array([len(t) for t in self.terms], np.int64)
        self._by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(self.lengths).tolist():
            at = np.flatnonzero(self.lengths == n)
            self._by_length[n] = (np.array([self.terms[i] for i in at], f"S{n}").view(f"V{n}"), at)

    def numbers(self, lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span's term, -1 for others; equal bytes alone count."""
        out = np.full(len(starts), -1, np.int64)
        lengths = ends - starts
        for n, (known, at) in self._by_length.items():
            spans = np.flatnonzero(lengths == n)
            for lo in range(0, len(spans), 1 << 16):
                some = spans[lo : lo + (1 << 16)]
                rows = np.ascontiguousarray(lowered[starts[some][:, None] + np.arange(n)])
                distinct, which = np.unique(rows.view(f"V{n}").ravel(), return_inverse=True)
                place = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
                out[some] = np.where(known[place] == distinct, at[place], -1)[which]
        return out


def _vectors(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, counts) of (doc_id, text): length in terms, and the vocabulary's terms that it holds."""

    def run(batches):
        for batch in batches:
            _, at = text_buffers(batch.column(1))
            for lo, hi in pieces(at, CHUNK_BYTES):
                part = batch.slice(lo, hi - lo)
                data, offsets = text_buffers(part.column(1))
                starts, ends = term_spans(data, offsets)
                number = vocabulary.numbers(_LOWER[data], starts, ends)
                owner = np.searchsorted(offsets, starts, "right") - 1
                known = number >= 0
                pair, counts = np.unique(owner[known] * len(vocabulary.terms) + number[known], return_counts=True)
                bounds = np.searchsorted(pair, np.arange(hi - lo + 1) * len(vocabulary.terms)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, kind)) for x, kind in ((pair % max(1, len(vocabulary.terms)), pa.int32()), (counts, pa.int64()))]
                lengths = pa.array(np.bincount(owner, minlength=hi - lo), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), lengths, *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


class Ranking:
    """The k best (score, id) of every item so far; among equal scores the smallest ids."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * items
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * items
        self.least = np.ones(items, np.int64)  # scores below this one cannot enter

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least[item]
        scores, ids = np.concatenate([self.scores[item], scores[good]]), np.concatenate([self.ids[item], ids[good]])
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[best], ids[best]
        if len(best) == self.k:
            self.least[item] = max(1, scores[best[-1]])


class Searcher:
    """The items' terms and weights, and what a task has found so far."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, k: int):
        self.items, self.weights = items, weights
        self.best = Ranking(len(items), k)
        self.visited = self.skipped = 0  # blocks
        order = np.argsort([t for terms in items for t in terms], kind="stable")
        flat_terms = np.array([t for terms in items for t in terms], np.int64)[order]
        flat_items = np.array([q for q, terms in enumerate(items) for _ in terms], np.int64)[order]
        bounds = np.searchsorted(flat_terms, np.arange(len(weights) + 1))
        self.askers = [flat_items[a:b] for a, b in zip(bounds, bounds[1:])]
        #: The coordinates that an item with the term may ask a summary of that term's list for.
        self.partners = [np.unique(np.concatenate([items[q] for q in qs])) if len(qs) else np.zeros(0, np.int64) for qs in self.askers]
        self.axes = np.random.default_rng(5).standard_normal((len(weights), SKETCH)).astype(np.float32)

    def blocks(self, held: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A posting list in the order of its blocks, and each block's first place: documents go to the most similar of some of them."""
        centres = sketch[held[:: BLOCK]]
        nearest = (sketch[held] @ centres.T).argmax(axis=1)
        order = np.argsort(nearest, kind="stable")
        return held[order], np.flatnonzero(np.diff(nearest[order], prepend=-1))

    def search(self, ids: np.ndarray, impacts: np.ndarray) -> None:
        """Ranks a shard: impacts has a row for each document and a column for each term."""
        directions = (impacts * self.weights.astype(np.float32)) @ self.axes
        directions /= np.maximum(np.linalg.norm(directions, axis=1, keepdims=True), 1e-30)
        by_term, holder = np.nonzero(impacts.T)
        bounds = np.searchsorted(by_term, np.arange(len(self.weights) + 1))
        scored = np.zeros((len(self.items), len(ids)), bool)
        for t in np.argsort(-self.weights, kind="stable").tolist():  # rare terms raise the bar early
            held = holder[bounds[t] : bounds[t + 1]]
            if not len(held) or not len(self.askers[t]):
                continue
            held, first = self.blocks(held, directions)
            partners = self.partners[t]
            summary = np.maximum.reduceat(impacts[np.ix_(held, partners)], first, axis=0).astype(np.float64)
            asked = np.zeros((len(partners), len(self.askers[t])))
            for j, q in enumerate(self.askers[t].tolist()):
                asked[np.searchsorted(partners, self.items[q]), j] = self.weights[self.items[q]]
            # Whole numbers below 2**53, so exact; the factor covers items of a hundred thousand terms and more.
            ceiling = (summary @ asked) * (1 + 1e-9)
            ends = np.append(first[1:], len(held))
            for j, q in enumerate(self.askers[t].tolist()):
                self._visit(q, ceiling[:, j], first, ends, held, ids, impacts, scored[q])

    def _visit(self, q: int, ceiling: np.ndarray, first: np.ndarray, ends: np.ndarray, held: np.ndarray, ids: np.ndarray, impacts: np.ndarray, scored: np.ndarray) -> None:
        order = np.argsort(-ceiling)
        terms, at, step = self.items[q], 0, 4
        while at < len(order):
            some = order[at : at + step]
            some = some[ceiling[some] >= self.best.least[q]]
            if not len(some):
                break  # all later ones have lower bounds
            docs = np.concatenate([held[first[b] : ends[b]] for b in some.tolist()])
            docs = docs[~scored[docs]]
            scored[docs] = True
            if len(docs):
                self.best.offer(q, impacts[np.ix_(docs, terms)].astype(np.int64) @ self.weights[terms], ids[docs])
            self.visited += len(some)
            at, step = at + step, step * 2
        self.skipped += len(order) - min(at, len(order))


def _shards(batches, n_terms: int, N: int, L: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, impacts) of as many documents at a time as have CELLS cells together."""
    most = max(1, CELLS // max(1, n_terms))
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            part = batch.slice(lo, most)
            ids, n = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy()
            rows = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(2)).to_numpy())
            terms, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
            m = 10 + (90 * n * N) // L
            impacts = np.zeros((part.num_rows, n_terms), np.int32)
            impacts[rows, terms] = (SCALE * tf) // (1000 * tf + 8 * m[rows])  # at most a million
            yield ids, impacts


def _rank_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents an item of each task, for items (number, terms)."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(list({t for _, terms in items for t in terms}))
    vectors = materialize(_vectors(docs, vocabulary))
    number = {t: i for i, t in enumerate(vocabulary.terms)}
    asked = [np.array(sorted({number[t] for t in terms}), np.int64) for _, terms in items]
    N, L = (x or 0 for x in vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first())
    df = {r["term"]: r["count"] for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # at most one row for each of the items' terms
    weights = np.array([math.floor(1000 * math.log((2 * N + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(number))], np.int64)
    sent = spark.sparkContext.broadcast((asked, weights))
    names = [i for i, _ in items]

    def run(batches):
        found = Searcher(*sent.value, k)
        for ids, impacts in _shards(batches, len(weights), N, L):
            found.search(ids, impacts)
        for q, item in enumerate(names):
            size = len(found.best.ids[q])
            if size:
                yield pa.RecordBatch.from_arrays([pa.array([item] * size, pa.int64()), pa.array(found.best.ids[q]), pa.array(found.best.scores[q])], names=["item", "doc_id", "score"])

    return vectors.filter("doc_id is not null and size(terms) > 0").mapInArrow(run, "item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of all docs for every item, exactly.

    Terms are the runs of letters, digits and all characters outside ASCII, A-Z lower-cased.  A term's
    weight falls with the documents that hold it, its part of a score grows with its count and falls
    with the document's length; documents that score 0 are not reported, equal scores go by id.

    Null and empty texts hold nothing and are in no count, an item without a known term has no rows.
    Repeated rows are documents of their own and all ranked; rows without an id are found by nothing,
    but count.  Items with equal ids are one item with the terms of all; an item without id is left out.
    """
    source = docs.select(F.col(f"`{doc_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    wanted = items.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("item is not null")
    blocks = max(1, -(-wanted.count() // block))
    ranked = None
    for b in range(blocks):
        terms: dict[int, set[bytes]] = {}
        for r in wanted.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toLocalIterator():
            terms.setdefault(r["item"], set()).update(terms_of(r["text"]))
        found = _rank_block(source, sorted(terms.items()), k)
        ranked = found if ranked is None else ranked.unionByName(found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    best = ranked.filter("doc_id is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def op12_block_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every item of the benchmark table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ranked_search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts, corpus GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), corpus
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
