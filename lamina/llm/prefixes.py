"""Prefix trie of conversations, built on a splitter skeleton.

A conversation is the path of its turns' digests (128 bits of SHA-256 each), and conversations of
one beginning lie together in the order of paths. A bounded sample of paths gives splitters, which
cut that order into shards of about SHARD conversations (larger ones where that would be more than
MOST shards, which bounds the skeleton). A node whose path begins no splitter has
all its members in one shard; the others, the prefixes of splitters, are the skeleton: a trie of
(shards - 1) paths at most, which all tasks get. Each shard, sorted by path and conv_id, is read
once with a stack of open nodes: what leaves the stack outside the skeleton is finished there, and
skeleton nodes leave as partial aggregates (members, smallest member, children, leaves and saved
tokens below), which a grouped sum puts together; only those sums, one for each skeleton node, are
rolled up on the driver, which made the skeleton. A digest over the members that end at a node is
sequential: for skeleton nodes, which may have any number of such members, pieces of SEND ids are
sorted by id and streamed.

Order of turns: turn (null first), role, text; repeated rows are turns like any others. Null roles
and texts are empty. Rows without conv_id belong to no conversation and are left out. A conversation
is one row of 24 bytes a turn; its turns are sorted by a window, which spills. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import materialise

#: Conversations of a shard, and the most shards; sampled paths for each shard; member ids sent in one piece.
SHARD, MOST, SAMPLES, SEND = 10_000, 10_000, 20, 4_096
#: Bytes of a turn's digest.
WIDTH = 16
TURN = "struct<id: string, bytes: long>"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): for each conversation its turns' digests and text sizes, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    id_ = F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * WIDTH)
    rows = rows.select("conv_id", place.alias("at"), id_.alias("id"), F.octet_length("text").cast("long").alias("bytes"))
    own = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "id", "bytes"))).alias("t"))
    return own.select("conv_id", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(own: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, turns): every conversation c with the first h turns of conversation c - c % group in place of its own first h, h the CRC-32 of c in decimal modulo ``most``."""
    donors = own.select(F.col("conv_id").alias("donor"), F.slice("turns", 1, most - 1).alias("head"))
    rows = own.withColumn("donor", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(f"array<{TURN}>"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return rows.join(donors, "donor", "left").select("conv_id", F.concat(head, rest).alias("turns"))


class Skeleton:
    """The trie of all prefixes of the splitters' paths, numbered from the root, 0; parents come before their children."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = sorted(set(splitters))
        self.parent, self.depth, self.numbers = [-1], [0], {b"": 0}
        for path, _ in self.splitters:
            for end in range(WIDTH, len(path) + 1, WIDTH):
                if path[:end] not in self.numbers:
                    self.numbers[path[:end]] = len(self.parent)
                    self.parent.append(self.numbers[path[: end - WIDTH]])
                    self.depth.append(end // WIDTH)

    def shard(self, path: bytes, conv: int) -> int:
        return bisect_right(self.splitters, (path, conv))


class Open:
    """A node with members still to come."""

    __slots__ = ("bytes", "children", "convs", "ended", "ends", "leaves", "least", "number", "saved", "waiting")

    def __init__(self, number: int, size: int):
        self.number, self.bytes, self.least = number, size, None
        self.convs = self.children = self.leaves = self.saved = 0
        self.ends = hashlib.sha256() if number < 0 else []
        self.ended = False
        #: Finished rows of children, which only lack this node's smallest member.
        self.waiting: list[list] = []


def _nodes(rows: Iterator[tuple[bytes, list[int], int]], skeleton: dict[bytes, int]) -> Iterator[tuple[str, list]]:
    """Of rows (path, bytes, conv_id) sorted by path and conv_id, in one shard: ('node', row), ('held', row of a node whose parent is in the skeleton, that parent),
    ('part', [number, convs, least, children, leaves, saved, bytes]) and ('ends', [number, first id, ids])."""
    stack = [Open(0, 0)]
    last = b""

    def flush(node: Open) -> Iterator[tuple[str, list]]:
        if node.ends:
            yield "ends", [node.number, node.ends[0], ",".join(map(str, node.ends))]
            node.ends = []

    def close(depth: int) -> Iterator[tuple[str, list]]:
        node = stack.pop()
        up = stack[-1] if stack else None
        if up:
            up.convs += node.convs
            up.least = node.least if up.least is None else min(up.least, node.least)
        if node.number >= 0:
            yield from flush(node)
            if node.convs:
                yield "part", [node.number, node.convs, node.least, node.children, node.leaves, node.saved, node.bytes]
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.convs - 1) * node.bytes
        up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
        for row in node.waiting:
            row[2] = node.least
            yield "node", row
        row = [node.least, depth, None, node.convs, node.children, leaves, saved, node.ends.hexdigest()]
        if up.number >= 0:
            yield "held", [*row, up.number]
        else:
            up.waiting.append(row)

    for path, sizes, conv in rows:
        depth, common = len(path) // WIDTH, 0
        while common < min(depth, len(last) // WIDTH) and path[WIDTH * common : WIDTH * (common + 1)] == last[WIDTH * common : WIDTH * (common + 1)]:
            common += 1
        while len(stack) > common + 1:
            yield from close(len(stack) - 1)
        for d in range(common + 1, depth + 1):
            stack.append(Open(skeleton.get(path[: WIDTH * d], -1) if stack[-1].number >= 0 else -1, sizes[d - 1]))
        node, last = stack[-1], path
        node.convs += 1
        node.least = conv if node.least is None else min(node.least, conv)
        if node.number >= 0:
            node.ends.append(conv)
            if len(node.ends) >= SEND:
                yield from flush(node)
        else:
            node.ends.update(f"{',' * node.ended}{conv}".encode())
            node.ended = True
    while stack:
        yield from close(len(stack) - 1)


OUT = f"{NODE}, number long, part boolean, ids string"
_ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in OUT.split(", "))])


def _row(kind: str, x: list) -> tuple:
    """As a row of OUT: nodes with number null, or the number of their parent in the skeleton; parts with part set; ends with ids."""
    if kind == "node":
        return (*x, None, False, None)
    if kind == "held":
        return (*x[:8], x[8], False, None)
    if kind == "part":
        number, convs, least, children, leaves, saved, size = x
        return (least, size, None, convs, children, leaves, saved, None, number, True, None)
    return (x[1], None, None, None, None, None, None, None, x[0], True, x[2])


def _sorted_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, ends_sha256) of rows (number, first id, ids), sorted by both."""
    now, digest = None, None
    out: list[tuple[int, str]] = []
    for batch in batches:
        for number, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if number != now:
                if digest:
                    out.append((now, digest.hexdigest()))
                now, digest = number, hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
    if digest:
        out.append((now, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["number", "ends_sha256"])


def trie(paths: DataFrame, shard: int = SHARD, samples: int = SAMPLES) -> DataFrame:
    """One row per node of the trie of (conv_id, turns), as NODE says: conv_id and parent_conv_id are the smallest members of the node and its parent; n_leaves are childless
    nodes of its subtree; saved_tokens sums (n_convs - 1) * bytes over it; ends_sha256 is of the members that end there. No conversation, no node."""
    spark = paths.sparkSession
    rows = materialise(paths.select(F.expr("unhex(array_join(turns.id, ''))").alias("path"), F.col("turns.bytes").alias("bytes"), "conv_id"), "paths")
    count = rows.count()
    shards = min(-(-count // shard), MOST)
    splitters = []
    if shards > 1:
        some = rows.select("path", "conv_id").sample(min(1.0, samples * shards / count), seed=5).limit(2 * samples * shards).toArrow()
        ordered = sorted(zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True))
        splitters = ordered[samples::samples]
    skeleton = Skeleton(splitters)
    sent = spark.sparkContext.broadcast((skeleton.splitters, skeleton.numbers))

    @F.arrow_udf("int")
    def place(path: pa.Array, conv: pa.Array) -> pa.Array:
        cuts = sent.value[0]
        return pa.array([bisect_right(cuts, x) for x in zip(path.to_pylist(), conv.to_pylist(), strict=True)], pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value[1]
        stream = chain.from_iterable(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for b in batches)
        out: list[tuple] = []
        for kind, x in _nodes(stream, numbers):
            out.append(_row(kind, x))
            if len(out) >= 8192:
                yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in out], schema=_ARROW)
                out = []
        yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in out], schema=_ARROW)

    dealt = rows.withColumn("shard", place("path", "conv_id")).repartitionById(max(1, len(skeleton.splitters) + 1), F.col("shard"))
    found = materialise(dealt.sortWithinPartitions("path", "conv_id").select("path", "bytes", "conv_id").mapInArrow(run, OUT), "nodes")

    parts = found.where("part AND ids IS NULL").groupBy("number").agg(F.sum("n_convs").alias("n"), F.min("conv_id").alias("least"), F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("depth").alias("bytes"))
    parts = {r["number"]: r.asDict() for r in parts.toLocalIterator()}  # a row for each skeleton node
    for number in range(len(skeleton.parent) - 1, 0, -1):  # children before parents
        if own := parts.get(number):
            own["leaves"] = own["leaves"] if own["children"] else 1
            own["saved"] += (own["n"] - 1) * own["bytes"]
            up = parts[skeleton.parent[number]]
            up["children"], up["leaves"], up["saved"] = up["children"] + 1, up["leaves"] + own["leaves"], up["saved"] + own["saved"]
    for number, own in parts.items():
        if number == 0 and not own["children"]:
            own["leaves"] = 1
    top = [(number, x["least"], skeleton.depth[number], parts[skeleton.parent[number]]["least"] if number else None, x["n"], x["children"], x["leaves"], x["saved"]) for number, x in parts.items()]
    top = spark.createDataFrame(top, "number long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    ids = found.where("ids IS NOT NULL").select("number", "conv_id", "ids").repartition("number").sortWithinPartitions("number", "conv_id").mapInArrow(_sorted_ids, "number long, ends_sha256 string")
    top = top.join(ids, "number", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
    names = [c.split()[0] for c in NODE.split(", ")]
    local = found.where("NOT part").withColumnRenamed("parent_conv_id", "own")
    held = F.broadcast(top.select("number", F.col("conv_id").alias("up")))  # a row for each skeleton node
    local = local.join(held, "number", "left").withColumn("parent_conv_id", F.coalesce("own", "up"))
    return local.select(*names).unionByName(top.select(*names))


def conversation_trie(conversations: DataFrame, shard: int = SHARD, samples: int = SAMPLES) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(materialise(turns(conversations), "turns")), shard, samples)
