"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has `cells` points; each shard owns `vnodes` of them.  A key hashes to a place on the
ring and belongs to the next virtual node clockwise.  Keys are taken in ring order; one whose
shard is full goes on clockwise to the next virtual node whose shard has room.  Capacities are
`load` times the mean (rounded up), or, with load None, n // shards plus one for the first
n % shards, so that every shard is filled exactly and row counts differ by one at most.

Only the row count of each cell (a fixed number of them) reaches the driver, which walks the ring
once and returns, for each cell, the ranks that go to each shard.  Rows meet that bounded table by
a broadcast join on (cell, rank in cell); ranks need one shuffle of the rows by cell.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name

_BITS = 62


def ring(n_shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in ring order; a taken cell passes its node on to the next."""
    if n_shards * vnodes > cells:
        raise ValueError("more virtual nodes than cells")
    taken: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.blake2b(f"{shard}:{v}".encode(), digest_size=8).digest()) % cells
            while cell in taken:
                cell = (cell + 1) % cells
            taken[cell] = shard
    return sorted(taken.items())


def capacities(n: int, n_shards: int, load: float | None) -> list[int]:
    if load is None:
        return [n // n_shards + (i < n % n_shards) for i in range(n_shards)]
    if load < 1:
        raise ValueError("load must be 1 or more")
    return [-int(-n * load // n_shards)] * n_shards


def allocate(counts: dict[int, int], n_shards: int, vnodes: int, cells: int, load: float | None) -> list[tuple]:
    """(cell, lo, hi, shard, first slot): ranks lo..hi-1 of the cell get consecutive slots of that shard."""
    nodes = ring(n_shards, vnodes, cells)
    room = capacities(sum(counts.values()), n_shards, load)
    used = [0] * n_shards
    out, owner = [], 0
    for cell in sorted(counts):
        while owner < len(nodes) and nodes[owner][0] < cell:
            owner += 1
        at, lo, left = owner % len(nodes), 0, counts[cell]
        while left:
            shard = nodes[at][1]
            take = min(room[shard], left)
            if take:
                out.append((cell, lo, lo + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
                lo += take
                left -= take
            at = (at + 1) % len(nodes)
    return out


def ring_position(key: Column, fallback: Column) -> Column:
    """A place on the ring in [0, 2**62): of the key, or of the fallback where the key is null."""
    text = key.cast("string")
    return F.shiftrightunsigned(F.when(text.isNull(), F.xxhash64(F.lit("row"), fallback)).otherwise(F.xxhash64(F.lit("key"), text)), 64 - _BITS)


def assign_shards(
    df: DataFrame,
    key: str,
    n_shards: int = 8,
    vnodes: int = 128,
    cells: int = 1 << 14,
    load: float | None = None,
    ties: tuple[str, ...] = (),
    shard_col: str = "shard",
    slot_col: str = "slot",
) -> DataFrame:
    """df with the shard of each row and its slot there, gapless from 0.

    Ties on the ring are ordered by key, then by `ties`; rows equal in all of these are
    interchangeable, so repeated rows are kept and get slots of their own.  A null key is placed by
    the hash of `ties`.  An empty frame gives an empty frame.  Columns of df that already bear an
    output name are replaced.
    """
    names = df.columns
    place, cell, rank = fresh_name(names, "ring_place"), fresh_name(names, "ring_cell"), fresh_name(names, "ring_rank")
    fallback = F.to_json(F.struct(*[F.col(f"`{c}`") for c in ties])) if ties else F.lit("")
    placed = df.withColumn(place, ring_position(F.col(f"`{key}`"), fallback))
    placed = placed.withColumn(cell, F.shiftright(place, _BITS - (cells - 1).bit_length()).cast("int"))
    counts = {r[0]: r[1] for r in placed.groupBy(cell).count().collect()}  # at most `cells` rows
    segments = df.sparkSession.createDataFrame(
        allocate(counts, n_shards, vnodes, cells, load),
        T.StructType([T.StructField(n, T.LongType() if n in ("seg_lo", "seg_hi", "seg_slot") else T.IntegerType()) for n in ("seg_cell", "seg_lo", "seg_hi", "seg_shard", "seg_slot")]),
    )
    order = Window.partitionBy(cell).orderBy(place, F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in ties])
    ranked = placed.withColumn(rank, F.row_number().over(order) - 1)
    joined = ranked.join(F.broadcast(segments), (ranked[cell] == segments.seg_cell) & (ranked[rank] >= segments.seg_lo) & (ranked[rank] < segments.seg_hi))
    kept = [F.col(f"`{c}`") for c in names if c.lower() not in (shard_col.lower(), slot_col.lower())]
    return joined.select(*kept, F.col("seg_shard").alias(shard_col), (F.col("seg_slot") + F.col(rank) - F.col("seg_lo")).alias(slot_col))


def op2_ring_shards(spark, sf_dir: str) -> DataFrame:
    """Documents on eight shards whose row counts differ by one at most."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return assign_shards(docs, "doc_id", ties=("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
