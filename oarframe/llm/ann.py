"""Nearest neighbours from randomly rotated one-bit codes in coarse cells.

Fitting takes a bounded sample (about `sample` rows, chosen by a hash of the id): the most frequent
dimension is the index's, and a few rounds of k-means give the centres of at most `MAX_CELLS` cells.
Every valid vector is then indexed: it belongs to the cell of its nearest centre, its direction from
there is rotated by a fixed random orthogonal matrix, and each coordinate keeps its sign.  Beside the
packed bits stand two correction scalars, the distance from the centre and the inner product of code
and direction.  A code estimates the inner product with any query, and an error bound of `epsilon`
standard deviations says which vectors could still be among the k nearest; only those are compared
on their original components.

Queries first visit the cells nearest to them.  The k-th distance found there is their reach, and
then they visit every other cell that the triangle inequality does not rule out at that reach (the
centre's distance less the cell's radius).  A cell is cut into chunks of rows and its queries into
blocks, so that each piece of work, a chunk against a block, is of bounded size; a hot cell has many.
Rows, queries and results travel as tables, and the plan does not grow with them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

ROWS_AT_ONCE = 1024
QUERIES_AT_ONCE = 512
CHUNK_NUMBERS = 1 << 20  # components of a chunk of rows, and of a block of queries
MAX_CELLS = 1024
FIRST_CELLS = 2  # cells visited for the reach, at least


@dataclass
class OneBitCoder:
    centers: np.ndarray
    rotation: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int = 1, rounds: int = 8, seed: int = 7) -> OneBitCoder:
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        q, r = np.linalg.qr(rng.normal(size=(d, d)))
        distinct = np.unique(sample, axis=0)
        centers = distinct[rng.permutation(len(distinct))[: max(1, cells)]]
        if len(centers) == 1:
            centers = sample.mean(axis=0, keepdims=True)
        for _ in range(rounds if len(centers) > 1 else 0):
            near = nearest_center(sample, centers)
            n = np.bincount(near, minlength=len(centers))
            sums = np.stack([np.bincount(near, weights=sample[:, j], minlength=len(centers)) for j in range(d)], axis=1)
            centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        return cls(centers, q * np.sign(np.diag(r)))

    def turned(self, vectors: np.ndarray, cell) -> tuple[np.ndarray, np.ndarray]:
        """Unit directions from the cell's centre after rotation, and the distances from it."""
        away = vectors.astype(np.float64) - self.centers[cell]
        norm = np.sqrt((away**2).sum(axis=1))
        return (away / np.where(norm == 0, 1, norm)[:, None]) @ self.rotation, norm

    def encode(self, vectors: np.ndarray, cell) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed sign bits, distances from the centre, inner products of code and direction."""
        turned, norm = self.turned(vectors, cell)
        return np.packbits(turned > 0, axis=1), norm, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all of b."""
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0)


def nearest_center(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    return np.concatenate([squares(x[lo : lo + ROWS_AT_ONCE], centers).argmin(axis=1) for lo in range(0, len(x), ROWS_AT_ONCE)] or [np.zeros(0, np.int64)])


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, in double precision, components added in order."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += (a[:, j].astype(np.float64) - b[:, j].astype(np.float64)) ** 2
    return np.sqrt(total)


class BlockSearch:
    """The k nearest rows of a cell seen so far, of each query in a block."""

    def __init__(self, coder: OneBitCoder, cell: int, ids: np.ndarray, vectors: np.ndarray, reach: np.ndarray, k: int, epsilon: float):
        self.ids, self.vectors, self.k, self.epsilon, self.reach = ids, vectors, k, epsilon, reach.copy()
        self.turned, self.norm = coder.turned(vectors, cell)
        self.turned = self.turned.astype(np.float32)
        self.best = np.zeros(0, [("q", np.int64), ("d", np.float64), ("v", np.int64)])

    def feed(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norm: np.ndarray, dot: np.ndarray) -> None:
        d = vectors.shape[1]
        signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
        inner = (self.turned @ signs.T) / np.float32(np.sqrt(d))
        dot = np.maximum(dot, 1e-6)
        product = self.norm[:, None] * norm
        middle = self.norm[:, None] ** 2 + norm**2 - 2 * product * (inner / dot)
        slack = 2 * product * (self.epsilon * np.sqrt(np.maximum(1 - dot**2, 0)) / dot / np.sqrt(max(1, d - 1))) + 1e-5 * (product + 1e-9)
        other = ids != self.ids[:, None]
        ceiling = self.reach**2
        # k rows lie within the k-th smallest upper bound, unless rows repeat an id.
        if len(ids) > self.k and len(np.unique(ids)) == len(ids):
            ceiling = np.minimum(ceiling, np.partition(np.where(other, middle + slack, np.inf), self.k - 1, axis=1)[:, self.k - 1])
        q, r = np.nonzero((middle - slack <= ceiling[:, None] * (1 + 1e-9)) & other)
        if not len(q):
            return
        new = np.zeros(len(q), self.best.dtype)
        new["q"], new["v"] = q, ids[r]
        for lo in range(0, len(q), 1 << 15):
            new["d"][lo : lo + (1 << 15)] = exact_distances(vectors[r[lo : lo + (1 << 15)]], self.vectors[q[lo : lo + (1 << 15)]])
        new = new[new["d"] <= self.reach[q]]
        both = np.concatenate([self.best, new])
        both = both[np.lexsort((both["d"], both["v"], both["q"]))]
        both = both[np.concatenate([[True], (both["q"][1:] != both["q"][:-1]) | (both["v"][1:] != both["v"][:-1])])] if len(both) else both
        both = both[np.lexsort((both["v"], both["d"], both["q"]))]
        first = np.searchsorted(both["q"], np.arange(len(self.ids)))
        self.best = both[np.arange(len(both)) - first[both["q"]] < self.k]
        full = np.bincount(self.best["q"], minlength=len(self.ids)) == self.k
        last = np.searchsorted(self.best["q"], np.arange(len(self.ids)), "right") - 1
        self.reach[full] = np.minimum(self.reach[full], self.best["d"][last[full]])


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of rows whose id is set and whose vector is not null, empty or zero and holds only finite numbers.

    Components stay 32-bit numbers where they are; all other kinds become doubles.
    """
    v = F.col(f"`{vector_col}`")
    kind = "float" if df.schema[vector_col].dataType.elementType == T.FloatType() else "double"
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast(f"array<{kind}>").alias("vector"))
    return rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))


def build_index(df: DataFrame, id_col: str, vector_col: str, sample: int = 8192) -> tuple[DataFrame, OneBitCoder, dict[int, tuple[int, float]]] | None:
    """The coded table (written to the shared folder), the coder, and each cell's row count and radius.

    None if no vector is valid.  Vectors of another dimension than the sample's most frequent one
    take no part.  The sample (at most 2 * `sample` rows) and the cells are all that the driver holds.
    """
    rows = valid_vectors(df, id_col, vector_col)
    n = rows.count()
    if not n:
        return None
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("ann"), "id"), 11) / float(1 << 53)
    got = rows.filter(chance < min(1.0, sample / n)).limit(2 * sample).collect() or rows.limit(sample).collect()
    sizes = [len(r["vector"]) for r in got]
    dim = max(sorted(set(sizes)), key=sizes.count)
    vectors = np.array([r["vector"] for r in got if len(r["vector"]) == dim], np.float64)
    coder = OneBitCoder.fit(vectors, min(MAX_CELLS, int(n**0.5 / 4), len(vectors) // 8))

    def code(batches):
        for batch in batches:
            v = _matrix(batch.column(1), dim)
            cell = nearest_center(v, coder.centers)
            codes, norm, dot = coder.encode(v, cell)
            arrays = [pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(dot)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=["id", "vector", "cell", "code", "norm", "dot"])

    vector = rows.schema["vector"].dataType.simpleString()
    coded = rows.filter(F.size("vector") == dim).mapInArrow(code, f"id long, vector {vector}, cell int, code binary, norm double, dot double")
    index = materialize(coded.withColumn("row", F.monotonically_increasing_id()))
    cells = {r["cell"]: (r["n"], r["radius"]) for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.max("norm").alias("radius")).collect()}
    return index, coder, cells


def _visits(queries: DataFrame, coder: OneBitCoder, cells: dict, k: int, later: bool) -> DataFrame:
    """(query_id, vector, reach, cell) of the cells that queries (query_id, vector, reach) visit.

    First, the nearest cells until FIRST_CELLS of them with more than k rows are reached; later, all others
    in which a row as near as the reach could lie.
    """
    order = sorted(cells)
    sizes, radius = (np.array([cells[c][i] for c in order], float) for i in (0, 1))
    centers, numbers = coder.centers[order], np.array(order, np.int32)
    dim = centers.shape[1]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, QUERIES_AT_ONCE):
                part = batch.slice(lo, QUERIES_AT_ONCE)
                away = np.sqrt(squares(_matrix(part.column(1), dim).astype(np.float64), centers))
                rank = away.argsort(axis=1, kind="stable")
                before = np.cumsum(sizes[rank], axis=1) - sizes[rank]
                early = np.zeros(away.shape, bool)
                np.put_along_axis(early, rank, (np.arange(len(order)) < FIRST_CELLS) | (before <= k), axis=1)
                reach = part.column(2).to_numpy()
                near = away - radius <= reach[:, None] * (1 + 1e-9) + 1e-6 * (1 + away)
                q, c = np.nonzero(near & ~early if later else early)
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(q)).columns, pa.array(numbers[c])], names=["query_id", "vector", "reach", "cell"])

    vector = queries.schema["vector"].dataType.simpleString()
    return queries.mapInArrow(run, f"query_id long, vector {vector}, reach double, cell int")


def _search(index: DataFrame, coder: OneBitCoder, cells: dict, visits: DataFrame, k: int, epsilon: float) -> DataFrame:
    """(query_id, vec_id, score): of each chunk of a visited cell, the k nearest rows within the reach."""
    dim = coder.centers.shape[1]
    at_once = max(64, CHUNK_NUMBERS // dim)
    asked = {r["cell"]: -(-r["count"] // at_once) for r in visits.groupBy("cell").count().collect()}  # at most MAX_CELLS rows
    schema = "query_id long, vec_id long, score double"
    if not asked:
        return index.sparkSession.createDataFrame([], schema)
    table = lambda of: F.create_map(*[F.lit(x) for c in asked for x in (c, of(c))])[F.col("cell")]
    blocks, chunks = table(lambda c: asked[c]), table(lambda c: -(-cells[c][0] // at_once))
    one_of = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    left = visits.withColumn("block", one_of("query_id", blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    right = index.filter(F.col("cell").isin(*asked)).withColumn("chunk", one_of("row", chunks)).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))

    def work(asking: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if asking.num_rows and rows.num_rows:
            cell = asking.column("cell")[0].as_py()
            for a in range(0, asking.num_rows, QUERIES_AT_ONCE):
                part = asking.slice(a, QUERIES_AT_ONCE)
                q_ids = part.column("query_id").to_numpy()
                search = BlockSearch(coder, cell, q_ids, _matrix(part.column("vector"), dim), part.column("reach").to_numpy(), k, epsilon)
                for lo in range(0, rows.num_rows, ROWS_AT_ONCE):
                    some = rows.slice(lo, ROWS_AT_ONCE)
                    codes = np.frombuffer(b"".join(some.column("code").to_pylist()), np.uint8).reshape(some.num_rows, -1)
                    search.feed(some.column("id").to_numpy(), _matrix(some.column("vector"), dim), codes, some.column("norm").to_numpy(), some.column("dot").to_numpy())
                out.append((q_ids[search.best["q"]], search.best["v"], search.best["d"]))
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    keys = ["cell", "chunk", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, epsilon: float = 3.5, sample: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other rows by Euclidean distance.

    is_query is a condition on the column `id`.  Ties go to the smaller id.  Rows without an id, and
    vectors that are null, empty, zero, or hold a null or non-finite component, take no part.  A row
    is no candidate for queries of its own id; an id that occurs several times appears once, with its
    nearest vector, and asks with its smallest vector.  No query or no other row gives no rows.
    """
    built = build_index(df, id_col, vector_col, sample)
    if built is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, coder, cells = built
    asking = materialize(index.filter(is_query).groupBy(F.col("id").alias("query_id")).agg(F.min("vector").alias("vector")))
    anywhere = asking.withColumn("reach", F.lit(float("inf")))
    first = materialize(_search(index, coder, cells, materialize(_visits(anywhere, coder, cells, k, later=False)), k, epsilon))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    distinct = lambda found: found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    reach = distinct(first).withColumn("place", place).filter(F.col("place") == k).select("query_id", F.col("score").alias("reach"))
    within = asking.join(reach, "query_id", "left").select("query_id", "vector", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    second = _search(index, coder, cells, materialize(_visits(within, coder, cells, k, later=True)), k, epsilon)
    ranked = distinct(first.unionByName(second)).withColumn("rank", place).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_one_bit_neighbours(spark, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("id") % 100 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(
      list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
