"""SimHash near-duplicates: fingerprints, BK-trees of fingerprints that share bits, components.

1. Every whole text gives one 64-bit fingerprint of its three-word shingles, repeats included.  Equal
   fingerprints are one node, however many rows have them.
2. Two fingerprints that differ in r bits or fewer agree on one of r + 1 parts of the bits.  So each
   goes to r + 1 shards, one for each part's value.  A shard with more than LIMIT members is cut by
   the same rule over its other bits, again and again; after LEVELS cuts so few bits are left that no
   shard can hold more than twice LIMIT.  No pair is lost on the way.
3. Each shard's members form one BK-tree, in the task that holds the shard, and each member searches
   it.  A tree is bounded as said, so it is sent to that task alone rather than to all.
4. A shard reports no more links than tie its members together; large-star and small-star join them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bktree import Forest
from .common import _LOWER, _SEPARATOR, CHUNK_BYTES, materialize, pieces, text_buffers, word_spans
from .components import connected_components

SHINGLE = 3
SEED = 42
LIMIT = 4096
LEVELS = 4
BATCH = 1 << 15  # members whose trees grow together


def joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words of all texts joined by single blanks, start and end of each, first word of each text."""
    starts, ends = word_spans(data, offsets)
    lengths = ends - starts
    at = np.cumsum(lengths + 1) - lengths - 1
    shift = np.repeat(at - starts, lengths)
    source = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    out = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
    out[source + shift] = _LOWER[data[source]]
    return out.tobytes(), at, at + lengths, np.searchsorted(starts, offsets)


def bit_sums(data: np.ndarray, offsets: np.ndarray, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles of each text have each bit set (64 columns), and how many shingles it has.

    Of a text with fewer words the whole sequence is the one shingle, or none if not whole.
    """
    text, starts, ends, first = joined_words(data, offsets)
    words = np.diff(first)
    counts = np.maximum(words - (SHINGLE - 1), (words > 0) if whole else 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    sums = np.zeros((len(words), 64), np.int64)
    head = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], counts)
    tail = np.minimum(head + SHINGLE, np.repeat(first[1:], counts)) - 1
    owner = np.repeat(np.arange(len(words)), counts)
    view = memoryview(text)
    for lo in range(0, len(head), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        spans = zip(starts[head[part]].tolist(), ends[tail[part]].tolist())
        hashes = np.fromiter((xxhash.xxh64_intdigest(view[s:e], SEED) for s, e in spans), np.uint64, len(head[part]))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edges = np.flatnonzero(np.diff(owner[part], prepend=-1))
        sums[owner[part][edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
    return sums, counts


def windows(text: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Parts of one text that have all its shingles once, and whether a part is the whole text.

    A part ends at a separator about limit bytes on; the next begins SHINGLE - 1 words before that.
    """
    lo, size = 0, limit
    while True:
        hi = lo + size
        while hi < len(text) and not _SEPARATOR[text[hi]]:
            step = np.flatnonzero(_SEPARATOR[text[hi : hi + 4096]])
            hi += int(step[0]) if len(step) else 4096
        if hi >= len(text):
            yield text[lo:], lo == 0
            return
        starts, _ = word_spans(text[lo:hi], np.array([0, hi - lo]))
        if len(starts) < SHINGLE:
            size *= 2  # too few words to go on from
            continue
        yield text[lo:hi], False
        lo, size = lo + int(starts[1 - SHINGLE]), limit


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> np.ndarray:
    """The fingerprint of each text: the bits set in more than half of its shingles' hashes."""
    if len(offsets) == 2 and len(data) > 2 * limit:  # one long text: its parts' sums are added
        sums, counts = np.zeros((1, 64), np.int64), np.zeros(1, np.int64)
        for part, whole in windows(data, limit):
            more, n = bit_sums(part, np.array([0, len(part)]), whole)
            sums, counts = sums + more, counts + n
    else:
        sums, counts = bit_sums(data, offsets)
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, code) of every row of (id, text); code is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            _, at = text_buffers(batch.column(1))
            for lo, hi in pieces(at):
                part = batch.slice(lo, hi - lo)
                codes = fingerprints_of(*text_buffers(part.column(1))).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes)], names=["id", "code"])

    return docs.mapInArrow(run, "id long, code long")


def shard_masks(parts: int, levels: int) -> list[list[int]]:
    """The bits that the shards of each level agree on; children of mask i are parts*i to parts*i + parts - 1."""
    out, last = [], [0]
    for _ in range(levels):
        now = []
        for mask in last:
            free = [b for b in range(64) if not mask >> b & 1]
            cuts = [len(free) * j // parts for j in range(parts + 1)]
            now += [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]
        out.append(now)
        last = now
    return out


def _shards(members: DataFrame, masks: list[int], parts: int) -> DataFrame:
    """(mask, part, code) of (mask, code): each code in the shards below its own."""
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    spread = members.select("code", F.explode(F.sequence(F.col("mask") * parts, F.col("mask") * parts + (parts - 1))).alias("mask"))
    return spread.select("mask", F.col("code").bitwiseAND(F.element_at(signed, (F.col("mask") + 1).cast("int"))).alias("part"), "code")


def _shard_ties(shards: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that tie the members of each shard of (mask, part, code), by its BK-tree."""

    def solve(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        mask, part, code = (np.concatenate([t.column(i).to_numpy() for t in tables]) for i in range(3))
        new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])])
        shard = np.cumsum(new) - 1
        several = np.bincount(shard)[shard] > 1
        a, b = Forest(code[several].view(np.uint64), shard[several]).ties(radius)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < BATCH:
                continue
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            mask, part = table.column(0).to_numpy(), table.column(1).to_numpy()
            cut = int(np.flatnonzero((mask != mask[-1]) | (part != part[-1]))[-1]) + 1 if (mask[0], part[0]) != (mask[-1], part[-1]) else 0
            if cut:
                yield solve([table.slice(0, cut)])
            held = [table.slice(cut)]  # the last shard may go on
        if held:
            yield solve(held)

    return shards.repartition("mask", "part").sortWithinPartitions("mask", "part").mapInArrow(run, "a long, b long")


def near_codes(codes: DataFrame, radius: int = 2, limit: int = LIMIT, levels: int = LEVELS) -> DataFrame:
    """Links (a, b) that tie all distinct codes of (code) within radius of each other."""
    parts = radius + 1
    members = codes.select(F.lit(0).cast("long").alias("mask"), "code")
    links = None
    for level, masks in enumerate(shard_masks(parts, levels)):
        shards = _shards(members, masks, parts)
        crowded = None
        if level + 1 < levels:
            shards = materialize(shards)
            crowded = materialize(shards.groupBy("mask", "part").count().filter(F.col("count") > limit).select("mask", "part"))
            if crowded.isEmpty():
                crowded = None
        found = _shard_ties(shards.join(crowded, ["mask", "part"], "left_anti").select("mask", "part", "code") if crowded else shards, radius)
        links = found if links is None else links.unionByName(found)
        if not crowded:
            break
        members = shards.join(crowded, ["mask", "part"], "left_semi").select("mask", "code")
    return links.distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row of df; fingerprints link at radius or fewer differing bits.

    Words stand between white space, A-Z lower-cased; a text with fewer than three words is one
    shingle, a null, empty or blank one has fingerprint zero and links like any other.  component_id is
    the smallest id reachable over links, the row's own included.

    Rows without id take part and have their component's smallest id, null if no row has one.
    Repeated rows are all returned, with the same answer.  Rows with equal ids and different texts are
    judged each by its text; the id does not tie them.  Other columns of df play no part.
    """
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    prints = materialize(fingerprints(source))
    codes = materialize(prints.groupBy("code").agg(F.min("id").alias("rep")))
    tied = connected_components(near_codes(codes.select("code"), radius))
    members = materialize(codes.join(tied.withColumnRenamed("node", "code"), "code").select("code", "component", "rep"))
    least = materialize(members.groupBy("component").agg(F.min("rep").alias("component_id")))
    named = materialize(members.join(least, "component").select("code", "component_id"))
    answers = materialize(codes.join(named, "code", "left").select("code", F.coalesce("component_id", "rep").alias("component_id")))
    shown = F.lower(F.lpad(F.hex("code"), 16, "0"))
    return prints.join(answers, "code").select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")


def op11_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate classes of all documents at two differing bits."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
