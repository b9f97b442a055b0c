"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

A row's key is its text, so equal texts meet. The ring has a fixed number of
positions; each shard owns ``vnodes`` of them and takes the rows of the arcs
that end there, until it is full. What overflows continues clockwise to the
next shard with room. Only row counts per arc reach the driver (``shards *
vnodes`` rows); ranks within an arc come from counts per ring position and
salt, so a text that a third of the rows share is ranked by many tasks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

POSITIONS = 1 << 16
SALTS = 256


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, by position; a taken position
    passes the node on to the next free one."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big") % POSITIONS
            while at in taken:
                at = (at + 1) % POSITIONS
            taken[at] = shard
    return sorted(taken.items())


def overflow_plan(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, slot) ranges: the rows of an arc with ranks from
    ``from`` up to ``to`` go to a shard, at slots from ``slot`` on.

    Capacities are the row count divided by the shards, the first ones taking
    the remainder, so every shard fills up and loads differ by one at most.
    Each arc first uses its own shard, arcs in ring order; then the overflow
    continues clockwise, again in ring order.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, plan, left = [0] * shards, [], {}

    def take(arc: int, start: int, n: int, shard: int) -> int:
        n = min(n, room[shard] - used[shard])
        if n:
            plan.append((arc, start, start + n, shard, used[shard]))
            used[shard] += n
        return n

    for arc, (_, shard) in enumerate(nodes):
        left[arc] = take(arc, 0, counts.get(arc, 0), shard)
    for arc in range(len(nodes)):
        done, want, at = left[arc], counts.get(arc, 0), arc
        while done < want:
            at = (at + 1) % len(nodes)
            done += take(arc, done, want - done, nodes[at][1])
    return plan


def assign_shards(docs: DataFrame, shards: int = 24, vnodes: int = 32) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text) into a shard and a slot there.

    The law is ``rows``: shard row counts differ by one at most. Null texts
    count as empty, null or repeated doc_ids are rows like others (ties between
    rows with one doc_id and text are interchangeable), an empty table gives no
    rows, other columns are ignored.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot,
    grown_shard (null under this law).
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    nodes = ring(shards, vnodes)
    at = [p for p, _ in nodes]
    arcs = spark.createDataFrame(
        [(p, bisect_left(at, p) % len(nodes)) for p in range(POSITIONS)], "position int, arc int"
    )
    rows = checkpointed(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("hash"),
            # Rows without doc_id and with one text are interchangeable, so any number spreads them.
            F.pmod(F.xxhash64(F.lit(7), F.coalesce(F.col("doc_id").cast("string"), F.monotonically_increasing_id().cast("string"))), F.lit(SALTS)).cast("int").alias("salt"),
        ).withColumn("position", F.pmod("hash", F.lit(POSITIONS)).cast("int"))
    )
    before = Window.partitionBy("arc").orderBy("position", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = checkpointed(
        rows.groupBy("position", "salt")
        .agg(F.count("*").alias("n"))
        .join(F.broadcast(arcs), "position")  # a fixed number of rows
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )
    counts = {r.arc: r.n for r in cells.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(overflow_plan(counts, nodes, shards), "arc int, low long, high long, shard int, slot0 long")

    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("position", "salt").orderBy("hash", "doc_id")) - 1)
    ranked = ranked.join(cells.select("position", "salt", "arc", "start"), ["position", "salt"]).withColumn(
        "rank", F.col("start") + F.col("place")
    )
    p = F.broadcast(plan.withColumnRenamed("arc", "of_arc"))  # at most 2 * shards * vnodes + shards rows
    return ranked.join(p, (F.col("arc") == F.col("of_arc")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("slot0") + F.col("rank") - F.col("low")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
