"""Language identification by nearest centroids.

A text becomes a normalised TF-IDF vector of hashed byte n-grams (1 to 3 bytes of its lower-cased
UTF-8, ASCII other than letters read as one space).  Each language has several centroids, found by
spherical k-means; a text gets the language of the centroid with the largest cosine.  A text whose
cosine stays under the floor for its size is rejected: its nearest language is still named, in a
column of its own stands that it is too far away.  Short texts are farther from every centroid than
long ones, so the floors are a curve over the number of n-grams, set from the distances of labelled
texts that the centroids have not seen, whole and in excerpts of many sizes.

Fitting uses at most about `max_train` labelled rows (a documented bound; rows are chosen by a hash
of their id, evenly over the languages), a fifth of them for the floors alone; predicting uses every
whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, pieces, text_buffers

DIMS = 4096
ROWS_AT_ONCE = 512

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[:128] = 32
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)


def ngram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of DIMS n-gram counts for each text of (data, offsets)."""
    rows = len(offsets) - 1
    owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    letters = _CLASS[data]
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32) | (owner[1:] != owner[:-1])
    letters, owner = letters[keep].astype(np.uint32), owner[keep]
    out = np.zeros(rows * DIMS, np.float32)
    for n in (1, 2, 3):
        if len(letters) < n:
            break
        code = np.full(len(letters) - n + 1, n, np.uint32)
        for k in range(n):
            code = (code ^ letters[k : len(letters) - n + 1 + k]) * np.uint32(0x01000193)
        whole = owner[: len(code)] == owner[n - 1 :]
        code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(20)
        out += np.bincount(owner[: len(code)][whole] * DIMS + code[whole], minlength=rows * DIMS)
    return out.reshape(rows, DIMS)


@dataclass
class CentroidModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # a row for each centroid
    owner: np.ndarray  # its language
    sizes: np.ndarray  # log2 of numbers of n-grams, ascending
    floor: np.ndarray  # the least cosine that is not rejected, at these sizes

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts) * self.idf
        norm = np.linalg.norm(weighted, axis=1, keepdims=True)
        return weighted / np.where(norm == 0, 1, norm)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine in [0, 1] and whether it is rejected, for each row of counts."""
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
        return self.owner[best], score, score < np.interp(log_size(counts), self.sizes, self.floor)


def log_size(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(counts.sum(axis=1), 1))


def fit_centroids(labels: list[str], counts: np.ndarray, k: int = 4, rounds: int = 12) -> CentroidModel:
    """k centroids for each label; nothing is rejected before `set_floors`."""
    languages = sorted(set(labels))
    number = np.array([languages.index(x) for x in labels])
    idf = (np.log((1 + len(labels)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    model = CentroidModel(languages, idf, np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(1), np.zeros(1))
    x = model.vectors(counts)
    found, owner = [], []
    for i in range(len(languages)):
        own = x[number == i]
        centers = own[:1]
        while len(centers) < min(k, len(own)):  # the text farthest from all centres becomes one
            centers = np.vstack([centers, own[(own @ centers.T).max(axis=1).argmin()][None]])
        for _ in range(rounds):
            near = (own @ centers.T).argmax(axis=1)
            sums = np.stack([own[near == j].sum(axis=0) if (near == j).any() else centers[j] for j in range(len(centers))])
            centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        found.append(centers)
        owner += [i] * len(centers)
    model.centroids, model.owner = np.vstack(found).astype(np.float32), np.array(owner)
    return model


def excerpts(text: str) -> list[str]:
    """The whole text, and stretches of 1, 2, 4, ... characters from its middle on."""
    middle = len(text) // 2
    return [text, *(text[middle : middle + (1 << i)] for i in range((len(text) - middle).bit_length()))]


def set_floors(model: CentroidModel, unseen: DataFrame, slack: float = 0.6, least: int = 30) -> CentroidModel:
    """The model with floors: `slack` times the fifth percentile of the cosines of (t) by size.

    Sizes are halved or doubled steps of the number of n-grams, and no floor is above that of a larger
    size; only a percentile for each reaches the driver.  Steps with fewer than `least` cosines say
    nothing; without any, nothing is rejected.
    """

    def measure(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                parts = [p for p in excerpts(text) if any(c.isalpha() for c in p)]
                for at in range(0, len(parts), ROWS_AT_ONCE):
                    raw = [p.encode("utf-8") for p in parts[at : at + ROWS_AT_ONCE]]
                    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
                    counts = ngram_counts(np.frombuffer(b"".join(raw), np.uint8), offsets)
                    _, score, _ = model.predict(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.rint(log_size(counts)).astype(np.int32)), pa.array(score)], names=["step", "score"])

    steps = unseen.select("t").mapInArrow(measure, "step int, score double").groupBy("step")
    got = sorted((r["step"], r["p"]) for r in steps.agg(F.percentile_approx("score", 0.05).alias("p"), F.count("*").alias("n")).filter(F.col("n") >= least).collect())
    if got:
        model.sizes = np.array([g[0] for g in got], float)
        model.floor = slack * np.minimum.accumulate([g[1] for g in got[::-1]])[::-1]
    return model


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    """One document in five, by checksum of its id; a null id is held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = 2000, k: int = 4, max_labels: int = 1000) -> CentroidModel | None:
    """Fits on labelled rows outside the held-out fold; None if there is none.

    Only row counts by label, at most about max_train count vectors and the floors' percentiles reach
    the driver.  More than max_labels labels raise ValueError.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l"))
    rows = rows.filter(F.col("l").isNotNull() & ~held_out(F.col("i")))
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().limit(max_labels + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > max_labels:
        raise ValueError(f"more than {max_labels} languages")
    quota = max(1, max_train // len(sizes))
    shares = F.create_map(*[F.lit(x) for label, n in sizes.items() for x in (label, min(1.0, quota / n))])
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), F.col("i").cast("string")), 11) / float(1 << 53)
    for_floors = F.pmod(F.xxhash64(F.lit("floors"), F.col("i").cast("string")), F.lit(5)) == 0
    sample = rows.filter((chance < shares[F.col("l")]) & has_letter(F.col("t"))).select(F.lower("t").alias("t"), "l", chance.alias("u"), for_floors.alias("f"))

    def count(batches):
        for batch in batches:
            for part, counts in _counted(batch):
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([r.tobytes() for r in counts], pa.binary())], names=["l", "u", "v"])

    got = sample.filter(~F.col("f")).mapInArrow(count, "l string, u double, v binary").collect()
    by_label: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["l"], r["u"])):
        by_label.setdefault(r["l"], []).append(np.frombuffer(r["v"], np.float32))
    chosen = [(label, v) for label, vs in by_label.items() for v in vs[:quota]]
    if not chosen:
        return None
    model = fit_centroids([c[0] for c in chosen], np.stack([c[1] for c in chosen]), k)
    return set_floors(model, sample.filter("f"))


def _counted(batch: pa.RecordBatch):
    """The batch in parts, each with its texts' n-gram counts; the text is the first column."""
    _, all_offsets = text_buffers(batch.column(0))
    for lo, hi in pieces(all_offsets):
        for a in range(lo, hi, ROWS_AT_ONCE):
            part = batch.slice(a, min(ROWS_AT_ONCE, hi - a))
            yield part, ngram_counts(*text_buffers(part.column(0)))


def identify(df: DataFrame, model: CentroidModel | None, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score and rejected.

    A null text, or one without a letter, is `und` with score 0 and rejected; so is every text if
    there is no model.  Rows stand for themselves: repeated rows are kept, nothing is shuffled.
    Columns that already bear one of the three names are replaced.
    """
    new = ("lang_pred", "score", "rejected")
    kept = [c for c in df.columns if c.lower() not in new]
    text, letter = fresh_name(kept, "text_in"), fresh_name(kept, "letter_in")
    source = df.select(F.lower(F.col(f"`{text_col}`").cast("string")).alias(text), has_letter(F.col(f"`{text_col}`").cast("string")).alias(letter), *[F.col(f"`{c}`") for c in kept])

    def run(batches):
        for batch in batches:
            for part, counts in _counted(batch):
                letters = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                if model is None:
                    names, score, far = np.full(len(letters), "und", object), np.zeros(len(letters)), ~letters | True
                else:
                    language, score, far = model.predict(counts)
                    names = np.where(letters, np.array(model.languages, object)[language], "und")
                    score, far = np.where(letters, score, 0.0), far | ~letters
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(far)], names=[*kept, *new])

    schema = T.StructType([df.schema[c] for c in kept]).add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("rejected", T.BooleanType())
    return source.mapInArrow(run, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learnt from the labelled ones outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs)
    found = identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
