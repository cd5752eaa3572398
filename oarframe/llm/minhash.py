"""Near-duplicate documents: MinHash banding, signature verification, exact check, components.

1. Every whole text gives its set of shingles (64-bit hashes), a digest of the set, `bands * rows`
   universal hash minima and a key for each band.  Texts with equal sets form one class, a node
   named by its smallest id, so copies never meet in pairs.
2. Classes that share a band key are a bucket.  In each bucket all members are paired with the
   smallest one only; sizes, then signatures, then the full sets confirm the link.
3. Buckets whose members are not yet in one component are completed: each member outside the
   bucket's largest component meets all members of other components in blocks of bounded size.  A
   pair is looked at in the first band it shares, by size and signature, then on full sets, and a
   block reports no more links than tie its components together.  Blocks meet by signatures first;
   full sets travel only for members that some signature of another component resembles.  A pair
   within one component needs no check, so dense groups cost a pass, not a square.
4. Components of all confirmed links come from alternating large-star and small-star.

The chance that a link is missed is that of no common band, (1 - t**rows)**bands at the threshold t
(4e-7 for 0.85 with 25 bands of 5), plus that of a signature estimate 0.15 too low (about 1e-6).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, materialize, mix, pieces, text_buffers, word_hashes
from .components import connected_components

MARGIN = 0.15
BLOCK = 512  # members of a bucket compared at once with as many others


def multipliers(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of n universal multiply-add hashes modulo 2**64."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = word_hashes(data, offsets)
    grams, bounds = gram_hashes(words, first, n)
    out = []
    for i in range(len(offsets) - 1):
        if bounds[i + 1] > bounds[i]:
            out.append(np.unique(grams[bounds[i] : bounds[i + 1]]))
        elif first[i + 1] > first[i]:  # fewer than n words: the whole sequence
            value = np.zeros(1, np.uint64)
            for w in words[first[i] : first[i + 1]]:
                value = mix(value * np.uint64(3) + w)
            out.append(value ^ np.uint64(first[i + 1] - first[i]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The high halves of the least hash value under each function."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 512):
        np.minimum(least, (factors[:, None] * shingles[lo : lo + 512] + offsets[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    value = np.arange(1, bands + 1, dtype=np.uint64)
    for part in sig.reshape(bands, -1).T:
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64))
    return value.view(np.int64)


def _profiles(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, key1, key2, sig, bands) of (id, text); keys and the rest are null for empty sets."""

    def run(batches):
        factors, offsets = multipliers(bands * rows)
        for batch in batches:
            _, at = text_buffers(batch.column(1))
            for lo, hi in pieces(at):
                part = batch.slice(lo, hi - lo)
                rows_out = []
                for s in shingle_sets(*text_buffers(part.column(1)), n):
                    if not len(s):
                        rows_out.append((0, None, None, None, None))
                        continue
                    sig = signature(s, factors, offsets)
                    rows_out.append((len(s), *_set_keys(s), sig.tobytes(), band_keys(sig, bands)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                arrays = [pa.array([r[i] for r in rows_out], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["id", "n_shingles", "key1", "key2", "sig", "bands"])

    return docs.mapInArrow(run, "id long, n_shingles long, key1 long, key2 long, sig binary, bands array<long>")


def _set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """The 128-bit digest of a set, in two halves."""
    halves = mix(shingles).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return tuple(np.array(halves).view(np.int64).tolist())


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(node, set) of (node, key1, key2, text) rows whose text has the set of these keys."""

    def run(batches):
        for batch in batches:
            _, at = text_buffers(batch.column(3))
            for lo, hi in pieces(at):
                part = batch.slice(lo, hi - lo)
                wanted = zip(part.column(1).to_pylist(), part.column(2).to_pylist())
                found = shingle_sets(*text_buffers(part.column(3)), n)
                good = [len(s) > 0 and _set_keys(s) == keys for s, keys in zip(found, wanted)]
                sets = [s.tobytes() for s, g in zip(found, good) if g]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good, pa.bool_())), pa.array(sets, pa.binary())], names=["id", "set"])

    return docs.select("node", "key1", "key2", "text").mapInArrow(run, "id long, set binary")


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _signatures_agree(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose signatures agree often enough."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(_sizes_allow(F.col("n_a"), F.col("n_b"), percent))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
            good = (x == y).mean(axis=1) >= percent / 100 - MARGIN
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


BITMAP_BITS = 26


def _only_hashed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs (id, text) whose id hashes to a place that some id of ids hashes to: all of these and a few more.

    The places are a bitmap of 2**26 bits, however many ids there are; it keeps most other texts out
    of the shuffle that follows.
    """
    place = lambda c: F.shiftrightunsigned(F.xxhash64(F.lit("place"), c), 64 - BITMAP_BITS)
    words = ids.select(place(F.col("id")).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for r in words.toLocalIterator():  # at most 2**20 rows
        bitmap[r["word"]] = r["bits"]
    packed = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def run(batches):
        bits = np.frombuffer(packed.value, np.int64)
        for batch in batches:
            at = batch.column(2).to_numpy()
            keep = (bits[at >> 6] >> (at & 63)) & 1
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep == 1)) for i in (0, 1)], names=["id", "text"])

    return docs.select("id", "text", place(F.col("id")).alias("p")).mapInArrow(run, "id long, text string")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets meet the threshold."""
    common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets meet the threshold."""

    def run(batches):
        for batch in batches:
            good = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    side = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long").distinct()


def _open_blocks(members: DataFrame, components: DataFrame) -> DataFrame:
    """(block, band, id, component, main) of buckets that hold several components.

    main marks the bucket's largest component.  The others are cut into blocks; each block meets
    itself, every later block, and every block of the main component.
    """
    named = members.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    by_component = named.groupBy("bucket", "component").count()
    buckets = by_component.groupBy("bucket").agg(F.count("*").alias("k"), F.max_by("component", F.struct("count", "component")).alias("largest"), F.max("count").alias("n_main"), (F.sum("count") - F.max("count")).alias("n_other"))
    rows = named.join(materialize(buckets.filter(F.col("k") > 1)), "bucket").withColumn("main", F.col("component") == F.col("largest"))
    main_blocks, other_blocks = F.ceil(F.col("n_main") / BLOCK), F.ceil(F.col("n_other") / BLOCK)
    own = F.pmod(F.xxhash64("id"), F.when(F.col("main"), main_blocks).otherwise(other_blocks))
    rows = rows.withColumn("own", own)
    with_others = F.transform(F.sequence(F.lit(0).cast("long"), other_blocks - 1), lambda j: F.struct(F.lit(False).alias("m"), F.least(j, F.col("own")).alias("x"), F.greatest(j, F.col("own")).alias("y")))
    with_main = F.transform(F.sequence(F.lit(0).cast("long"), main_blocks - 1), lambda j: F.struct(F.lit(True).alias("m"), F.col("own").alias("x"), j.alias("y")))
    as_main = F.transform(F.sequence(F.lit(0).cast("long"), other_blocks - 1), lambda i: F.struct(F.lit(True).alias("m"), i.alias("x"), F.col("own").alias("y")))
    meets = F.when(F.col("main"), as_main).otherwise(F.concat(with_others, with_main))
    return rows.select("bucket", "band", "id", "component", "main", F.explode(meets).alias("meet")).select(F.xxhash64("bucket", "meet").alias("block"), "band", "id", "component", "main")


def _alike(band: int, component, size, sig, percent: int, rows: int):
    """(i, j) arrays of a block's members of different components that sizes and signatures allow, first met in this band."""
    for s in range(1, len(component)):
        i = np.flatnonzero(component[:-s] != component[s:])
        i = i[np.minimum(size[i], size[i + s]) * 100 >= np.maximum(size[i], size[i + s]) * percent]
        for lo in range(0, len(i), 4096):
            x = i[lo : lo + 4096]
            same = sig[x] == sig[x + s]
            whole = same.reshape(len(x), -1, rows).all(axis=2)  # which bands agree; the first of them looks at the pair
            x = x[(same.mean(axis=1) >= percent / 100 - MARGIN) & (whole.argmax(axis=1) == band)]
            yield x, x + s


def _block_links(band: int, ids, component, size, sig, sets: list, percent: int, rows: int) -> list[tuple[int, int]]:
    """Links of one block between members of different components, no more than tie these together."""
    parent: dict[int, int] = {}

    def root(c):
        while parent.get(c, c) != c:
            parent[c] = parent.get(parent[c], parent[c])
            c = parent[c]
        return c

    found = []
    for x, y in _alike(band, component, size, sig, percent, rows):
        for k, m in zip(x.tolist(), y.tolist()):
            a, b = root(int(component[k])), root(int(component[m]))
            if a != b and linked(sets[k], sets[m], percent):
                parent[a] = b
                found.append((int(ids[k]), int(ids[m])))
    return found


def _by_block(df: DataFrame, work, schema: str) -> DataFrame:
    """work(table of one block) -> record batch, over all blocks of df; the block is the first column."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            block = batch.column(0).to_numpy()
            edges = np.append(np.flatnonzero(np.diff(block, prepend=~block[:1])), len(block))
            for lo, hi in zip(edges[:-1], edges[1:]):
                if held and block[lo] != last:
                    yield work(pa.Table.from_batches(held).combine_chunks())
                    held.clear()
                held.append(batch.slice(lo, hi - lo))
                last = block[lo]
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return df.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def _signatures_of(table: pa.Table, column: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), np.uint32).reshape(table.num_rows, -1)


def _compare_blocks(blocks: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """Links (a, b) that tie the components within each block."""
    columns = ["block", "band", "id", "component", "n_shingles", "sig"]

    def survivors(t: pa.Table) -> pa.RecordBatch:
        band, component, size = (t.column(i).to_numpy() for i in (1, 3, 4))
        stay = np.zeros(t.num_rows, bool)
        for x, y in _alike(int(band[0]), component, size, _signatures_of(t, 5), percent, rows):
            stay[x] = stay[y] = True
        return t.select(columns).filter(pa.array(stay)).combine_chunks().to_batches()[0] if stay.any() else pa.RecordBatch.from_pylist([], t.schema)

    def links(t: pa.Table) -> pa.RecordBatch:
        band, ids, component, size = (t.column(i).to_numpy() for i in (1, 2, 3, 4))
        full = [np.frombuffer(x, np.uint64) for x in t.column(6).to_pylist()]
        out = _block_links(int(band[0]), ids, component, size, _signatures_of(t, 5), full, percent, rows)
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    signed = blocks.join(classes.select("id", "n_shingles", "sig"), "id").select(*columns)
    alike = materialize(_by_block(signed, survivors, "block long, band int, id long, component long, n_shingles long, sig binary"))
    return _by_block(alike.join(sets, "id").select(*columns, "set"), links, "a long, b long").distinct()


def _named_classes(usable: DataFrame) -> DataFrame:
    """(key1, key2, rep, node) of every distinct set: its smallest id, and a number of its own.

    node is rep, but for sets that share their smallest id with another set: of these all but one get
    numbers above every id (ids that near the end of the 64-bit range by then raise an overflow).
    """
    smallest = materialize(usable.groupBy("key1", "key2").agg(F.min("id").alias("rep")))
    first = smallest.groupBy("rep").agg(F.min(F.struct("key1", "key2")).alias("first"), F.count("*").alias("n")).filter(F.col("n") > 1).drop("n")
    again = smallest.join(materialize(first), "rep").filter(F.struct("key1", "key2") != F.col("first"))
    extra = materialize(again.select("key1", "key2", F.monotonically_increasing_id().alias("extra")))
    if extra.isEmpty():
        return smallest.withColumn("node", F.col("rep"))
    top = usable.agg(F.max("id")).first()[0]
    return materialize(smallest.join(extra, ["key1", "key2"], "left").select("key1", "key2", "rep", F.coalesce(F.lit(top) + 1 + F.col("extra"), "rep").alias("node")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, n: int = 5, bands: int = 25, rows: int = 5) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row of df.

    Two texts are linked if 100 * intersection >= percent * union of their sets of n-word shingles
    (words between white space, A-Z lower-cased; a shorter text is one shingle as a whole).
    component_id is the smallest id reachable over links, kept says whether it is the row's own.

    A null, empty or blank text has an empty set and is linked with nothing, equal ones included.
    A row without id has the component of the texts with its set, if any has an id, and is kept.
    Repeated rows are all returned, with the same answer.  If an id occurs with several texts, all of
    them are compared, and the id ties them together.  Other columns of df play no part.
    """
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    profiles = materialize(_profiles(source, n, bands, rows))
    usable = profiles.filter(F.col("id").isNotNull() & F.col("key1").isNotNull())
    # Sides of joins are written where an aggregate made them, so that both shuffle afresh and a hot key can be split.
    named = _named_classes(usable)
    same_id = F.col("id") == F.col("rep")
    classes = materialize(usable.join(named, ["key1", "key2"]).filter(same_id).select(F.col("node").alias("id"), "rep", "key1", "key2", "n_shingles", "sig", "bands").dropDuplicates(["id"]))
    banded = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("members")).filter(F.col("members") > 1)
    members = materialize(banded.join(materialize(hubs.select("bucket", "hub")), "bucket"))
    met = materialize(members.select("id").distinct())
    wanted = materialize(classes.select(F.col("id").alias("node"), F.col("rep").alias("id"), "key1", "key2").join(met.withColumnRenamed("id", "node"), "node", "left_semi"))
    docs = _only_hashed(source.filter(F.col("id").isNotNull()), wanted.select("id"))
    sets = materialize(_sets(docs.join(wanted, "id"), n).dropDuplicates(["id"]))
    near = materialize(classes.select("id", "n_shingles", "sig").join(met, "id", "left_semi"))
    stars = members.filter(F.col("id") != F.col("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = materialize(_confirm(_signatures_agree(stars, near, percent), sets, percent))
    # An id with several texts ties their classes together.
    nodes = usable.select("id", "key1", "key2").join(named, ["key1", "key2"]).select("id", "node")
    several = materialize(nodes.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter(F.col("a") < F.col("z")).select("id", "a"))
    links = links.unionByName(nodes.join(several, "id").select("a", F.col("node").alias("b")))
    partial = materialize(connected_components(links))
    open_links = _compare_blocks(_open_blocks(members.select("bucket", "band", "id"), partial), near, sets, percent, rows)
    final = materialize(connected_components(links.unionByName(open_links)))
    some = profiles.filter(F.col("key1").isNotNull()).select("id", "n_shingles", "key1", "key2")
    labelled = some.join(named.withColumnRenamed("node", "own"), ["key1", "key2"], "left").join(final, F.col("own") == F.col("node"), "left")
    blank = profiles.filter(F.col("key1").isNull()).select("id", "n_shingles", F.col("id").alias("component_id"))
    both = labelled.select("id", "n_shingles", F.coalesce("component", "rep", "id").alias("component_id")).unionByName(blank)
    return both.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at a similarity of 0.85 on five-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
