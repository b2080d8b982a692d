"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``virtual`` points of a 64-bit ring; a row's id hashes to a place and belongs to the
arc that ends at the next point clockwise.  A shard takes rows up to its capacity; rows that find it
full continue clockwise to the next point whose shard has room.  Capacities are
``ceil((1 + slack) * rows / shards)``; with ``slack`` 0 they add up to exactly the number of rows, so
any two shards differ by at most one row.

The rows of an arc are ranked, so what a shard takes from an arc is a range of ranks.  Only the
arcs' counts (``shards * virtual * PARTS`` numbers, whatever the input) reach the driver, which walks
the ring and returns ranges of ranks to the workers; no row passes through it.  An arc is ranked in
``PARTS`` parts chosen by the hash of the text, so an id that many rows share is still spread.

Moved rows: without ``slack`` a further shard changes every capacity; the ring keeps most rows where
they were, as the tests measure.

Defined cases: null ids share one place of the ring; null texts have size 1 and checksum 0; rows
equal in id, text hash and size are interchangeable, each gets a slot of its own; an empty table
gives no rows; other columns are ignored.  Equal texts are not kept together: a group may hold more
rows than a shard.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from cueloom.shared import pin, ship

VIRTUAL, PARTS = 128, 16


def ring(shards: int, virtual: int = VIRTUAL) -> tuple[np.ndarray, list[int]]:
    """Sorted points and the shard of each."""
    points = sorted(
        (xxhash.xxh64_intdigest(f"{s}/{v}") - (1 << 63), s) for s in range(shards) for v in range(virtual)
    )
    return np.array([p for p, _ in points], np.int64), [s for _, s in points]


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Room of each shard; with no slack the first ones take the remainder."""
    if slack > 0:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Ranges (arc, first rank, end rank, shard, first slot) by walking the ring.

    Every arc offers its rows to its own shard first; what does not fit goes on clockwise, one
    point a round, in ring order.
    """
    room, filled, taken = list(room), [0] * len(room), []
    waiting = [(arc, 0, n) for arc, n in enumerate(counts) if n]
    for step in range(len(counts)):
        left = []
        for arc, low, high in waiting:
            shard = owners[(arc + step) % len(owners)]
            fits = min(high - low, room[shard])
            if fits:
                taken.append((arc, low, low + fits, shard, filled[shard]))
                room[shard] -= fits
                filled[shard] += fits
            if low + fits < high:
                left.append((arc, low + fits, high))
        waiting = left
        if not waiting:
            break
    return taken


def assign_shards(
    docs: DataFrame, shards: int = 16, slack: float = 0.0, virtual: int = VIRTUAL,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, ``home`` (the shard of its own arc), shard, slot."""
    spark = docs.sparkSession
    ship(spark)
    points, owners = ring(shards, virtual)
    place = spark.sparkContext.broadcast(points)

    @F.pandas_udf("int")
    def arc_of(hashed: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(place.value, hashed.to_numpy(np.int64), "left") % len(place.value))

    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("at"),
    )
    kept = pin(rows.select("*", arc_of("at").alias("arc"), F.pmod("text_crc32", F.lit(PARTS)).cast("int").alias("part")), "ring")
    counted = {(r.arc, r.part): r.n for r in kept.groupBy("arc", "part").agg(F.count("*").alias("n")).collect()}
    counts, offsets = [0] * len(owners), []
    for (arc, part), n in sorted(counted.items()):
        offsets.append((arc, part, counts[arc]))
        counts[arc] += n
    ranges = walk(counts, owners, capacities(sum(counts), shards, slack))
    by_arc: dict[int, list[tuple[int, int, int, int]]] = {}
    for arc, low, high, shard, slot in ranges:
        by_arc.setdefault(arc, []).append((low, high, shard, slot))
    plan = [
        (arc, part, offset, owners[arc], [x for x in by_arc[arc] if x[1] > offset and x[0] < offset + counted[arc, part]])
        for arc, part, offset in offsets
    ]
    table = spark.createDataFrame(
        plan, "arc int, part int, offset long, home int, ranges array<struct<low:long,high:long,shard:int,slot:long>>"
    )
    order = Window.partitionBy("arc", "part").orderBy("at", "doc_id", "text_crc32", "size")
    ranked = kept.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(table), ["arc", "part"])
    placed = ranked.withColumn("rank", F.col("rank") + F.col("offset")).withColumn(
        "taken", F.element_at(F.filter("ranges", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"])), 1)
    )
    return placed.select(
        "doc_id", "size", "text_crc32", "home", "taken.shard",
        (F.col("taken.slot") + F.col("rank") - F.col("taken.low")).cast("long").alias("slot"),
    )
