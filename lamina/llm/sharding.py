"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

Every shard owns ``virtual`` points of a ring; a key belongs to the first point clockwise from its
own place, and the keys of one arc between points have the same order of shards to try. Shards
have room for so many rows that counts end at most one apart; keys that find a shard full go on
clockwise to the next shard on the ring. Since all keys of an arc try the same shards, the ring is
settled on one count per arc (shards x virtual of them, whatever the input); a key then needs only
its rank in its arc, which comes from a prefix sum over ring cells and a rank inside its cell.

Null texts have size 1 and the crc of the empty text. Rows equal in all output columns are
interchangeable: they are counted before they move and dealt out by their count.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from zlib import crc32

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import materialise

CELLS = 1 << 14


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """Sorted (cell, shard): at most one point in a cell."""
    points: dict[int, int] = {}
    for shard in range(shards):
        for v in range(virtual):
            points.setdefault(crc32(f"shard {shard}, point {v}".encode()) % CELLS, shard)
    return sorted(points.items())


def order_of_shards(points: list[tuple[int, int]], arc: int) -> list[int]:
    return list(dict.fromkeys(points[(arc + i) % len(points)][1] for i in range(len(points))))


def settle(points: list[tuple[int, int]], counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, last rank, shard, slot of the first): rounds in which what is left of each arc tries its next shard."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, done, out = [0] * shards, dict.fromkeys(counts, 0), []
    tries = {arc: order_of_shards(points, arc) for arc in counts}
    for turn in range(shards):
        for arc in sorted(counts):
            if turn < len(tries[arc]) and (left := counts[arc] - done[arc]):
                shard = tries[arc][turn]
                take = min(left, room[shard] - used[shard])
                if take:
                    out.append((arc, done[arc], done[arc] + take - 1, shard, used[shard]))
                    done[arc] += take
                    used[shard] += take
    return out


def arc_of(points: list[tuple[int, int]], cell: int) -> int:
    return bisect_left([p for p, _ in points], cell) % len(points)


def shard_documents(documents: DataFrame, shards: int = 8, virtual: int = 64) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null)."""
    spark, points = documents.sparkSession, ring(shards, virtual)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keys = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("times"))
    place = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32")
    keys = materialise(keys.withColumn("place", place).withColumn("cell", F.shiftrightunsigned("place", 64 - 14).cast("int")), "keys")

    at = F.array(*[F.lit(p) for p, _ in points])
    before = F.size(F.filter(at, lambda p: p < F.col("cell")))
    cells = keys.groupBy("cell").agg(F.sum("times").alias("n")).select("cell", "n", (before % len(points)).alias("arc"), (before < len(points)).alias("wrapped"))
    cells = materialise(cells, "cells")
    counts = {r["arc"]: r["n"] for r in cells.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    parts = json.dumps([dict(zip(("arc", "a", "z", "shard", "base"), x, strict=True)) for x in settle(points, counts, shards)])
    parts = spark.range(1).select(F.inline(F.from_json(F.lit(parts), "array<struct<arc int, a long, z long, shard int, base long>>")))

    past = Window.partitionBy("arc").orderBy("wrapped", "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("cell", "arc", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("off"))
    inside = Window.partitionBy("cell").orderBy("place", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    ranked = keys.withColumn("end", F.sum("times").over(inside)).join(F.broadcast(offsets), "cell")  # CELLS rows at most
    ranked = ranked.select("doc_id", "size", "text_crc32", "arc", F.explode(F.sequence(F.col("off") + F.col("end") - F.col("times"), F.col("off") + F.col("end") - 1)).alias("rank"))
    placed = ranked.join(F.broadcast(parts), (ranked["arc"] == parts["arc"]) & F.col("rank").between(F.col("a"), F.col("z")))  # shards ** 2 x virtual rows at most
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("a")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
