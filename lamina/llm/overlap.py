"""Exact candidates of a set similarity join, from few tokens of each set.

Tokens (digests of shingles) have a fixed order. Two sets of Jaccard similarity s or more share so
many tokens that the first n - ceil(s * n) + l tokens of each, n its size, share l at least. So only
these first tokens are compared, and a pair is a candidate if it shares l of them; l is LEAST and a
PART-th of the set more, or what a small set allows. As l grows with a set, passages that it has in
common with many others leave it other tokens to be told by, unless they are a good part of it.

A token that more than HOT sets have among their first ones is not expanded into pairs. A set with h
such tokens must share l - h of the others, which is tested in the same way. Only sets in which that
leaves nothing (h >= l) are compared again, with each other: there the order of tokens is that of
their frequency among these sets, rare ones first, l is 1, and sets of one group, which copies are
by then, need not meet. At the first token that two similar sets share, what follows it in both is
still as much as they have to share, so that sets with rare tokens of their own, as in a family of
sets that are alike but not similar enough, do not meet at the family's, or at few of its tokens.
Where they meet, their parities are compared, before a pair leaves the token: members of a family
just below the limit are compared there by numbers, a token's many members in blocks, each pair of
blocks a task's work, and only pairs that parity leaves open become rows. Nothing is dropped: a pair
is proposed unless it cannot be similar or is in one group already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import materialise, small

LEAST, PART, HOT = 12, 8, 64
#: (least tokens, longs): a set of at least so many tokens has a parity of so many longs.
PARITY = ((0, 16), (1_000, 128), (8_000, 1_024))
#: Longs of the parity that goes along with a token; sets of a block.
FOLD, BLOCK = 16, 1 << 14


def prefix_length(n: int, share: Fraction) -> int:
    need = -(-n * share.numerator // share.denominator)
    return n - need + min(LEAST + n // PART, need)


def parity(sets: list[np.ndarray]) -> pa.ListArray:
    """For each set bits, as longs, of which every token flips the one that its last bits name. Two sets' parities of one length differ in no more bits than the sets in tokens."""
    out = []
    for s in sets:
        bits = 64 * max(longs for least, longs in PARITY if len(s) >= least)
        odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
    ends = np.cumsum([0, *map(len, out)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*out, np.empty(0, dtype=np.int64)])))


def possible(pairs: DataFrame, sketches: DataFrame, share: Fraction) -> DataFrame:
    """The pairs (a, b) whose parities leave it open that they are as similar: sets of n1 and n2 tokens then differ in (1 - s) / (1 + s) * (n1 + n2) at most. Parities of two lengths leave all open."""
    side = lambda c: sketches.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
    pairs = materialise(pairs, "pairs")
    ends = small(materialise(pairs.select("b").distinct(), "ends"))  # so that only the parities that are looked at move
    both = small(pairs).join(side("a"), "a").join(side("b").join(ends, "b", "left_semi"), "b")
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    fits = apart * (share.denominator + share.numerator) <= (F.col("na") + F.col("nb")) * (share.denominator - share.numerator)
    return both.where((F.size("pa") != F.size("pb")) | fits).select("a", "b")


def _floor(n: Column, share: Fraction) -> Column:
    """Tokens that a set of n must share among the first ones with any similar set: that has share * n tokens at least, so its l is what such a set's is at least, and they share that share of them."""
    square = share * share
    least = F.ceil(n * share.numerator / F.lit(float(share.denominator)) - F.lit(1e-9))
    return F.least(F.lit(LEAST) + F.floor(least / PART), F.ceil(n * square.numerator / F.lit(float(square.denominator)) - F.lit(1e-9))).cast("int")


def _bucket_pairs(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, t) of sets of different groups and fitting sizes that have a token in common, once for each; rows (tok, id, n, grp, t) come sorted by tok, HOT of one at most."""
    kept: list[np.ndarray] | None = None

    def pairs(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tok, ids, n, group, t = c
        for d in range(1, HOT):
            i = np.flatnonzero(tok[d:] == tok[:-d])
            if not len(i):
                return
            j = i + d
            fit = (group[i] != group[j]) & (np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j]) - 1e-9)
            i, j = i[fit], j[fit]
            if len(i):
                a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.maximum(t[i], t[j]))], names=["a", "b", "t"])

    for batch in batches:
        c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if kept is not None:
            c = [np.concatenate(x) for x in zip(kept, c, strict=True)]
        if not len(c[0]):
            continue
        last = np.searchsorted(c[0], c[0][-1])  # that token may go on
        kept = [x[last:] for x in c]
        yield from pairs([x[:last] for x in c])
    if kept is not None:
        yield from pairs(kept)


def folded(parity_: Column) -> Column:
    """The parity of FOLD longs: longer ones folded, which keeps what parities are for, whatever lengths two sets have."""
    none = F.array_repeat(F.lit(0).cast("long"), FOLD)
    return F.aggregate(F.sequence(F.lit(1), F.size(parity_), F.lit(FOLD)), none, lambda done, i: F.zip_with(done, F.slice(parity_, i, F.lit(FOLD)), lambda x, y: x.bitwiseXOR(y)))


def _met(i: np.ndarray, j: np.ndarray, c: list[np.ndarray], folds: np.ndarray, share: Fraction) -> pa.RecordBatch | None:
    """Of rows i against rows j (ids, n, group, left): the pairs that may be similar."""
    ids, n, group, left = c
    up, both = share.denominator + share.numerator, n[i][:, None] + n[j][None, :]
    fit = (ids[i][:, None] != ids[j][None, :]) & (group[i][:, None] != group[j][None, :]) & (np.minimum(left[i][:, None], left[j][None, :]) * up >= both * share.numerator)
    x, y = np.nonzero(fit)
    kept = []
    for at in range(0, len(x), 1 << 16):
        p, q = i[x[at : at + (1 << 16)]], j[y[at : at + (1 << 16)]]
        apart = np.bitwise_count(folds[p] ^ folds[q]).sum(axis=1, dtype=np.int64)
        near = apart * up <= (n[p] + n[q]) * (share.denominator - share.numerator)
        kept.append((p[near], q[near]))
    p, q = (np.concatenate([k[d] for k in kept]) if kept else np.empty(0, dtype=int) for d in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[p], ids[q])), pa.array(np.maximum(ids[p], ids[q]))], names=["a", "b"]) if len(p) else None


def _meetings(batches: Iterator[pa.RecordBatch], share: Fraction) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that meet at a token and may be similar; rows (tok, one, two, own, id, n, grp, left, fold) come sorted by tok and the pair of blocks (one, two), ``own`` the row's block. A pair of blocks is held, and compared some rows at a time."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        c = [t.column(k).to_numpy().astype(np.int64) for k in (4, 5, 6, 7)]
        own, one, two = (t.column(k).to_numpy() for k in (3, 1, 2))
        folds = t.column(8).combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, FOLD)
        if one[0] != two[0]:
            first, second = np.flatnonzero(own == one[0]), np.flatnonzero(own == two[0])
            step = max(1, (1 << 20) // max(1, len(second)))
            todo = ((first[k : k + step], second) for k in range(0, len(first) if len(second) else 0, step))
        else:
            every = np.argsort(c[2], kind="stable")  # by group
            step = max(1, (1 << 20) // len(every))
            todo = ((every[k : k + step], every[k:]) for k in range(0, len(every), step))
        for i, j in todo:
            if c[2][i].min() == c[2][j].max() == c[2][j].min():
                continue  # one group
            if (found := _met(i, j, c, folds, share)) is not None:
                yield found

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(k).to_numpy() for k in range(3)]
        cuts = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
        if held and any(held[-1].column(k)[-1].as_py() != key[k][0] for k in range(3)):
            yield from pairs(pa.Table.from_batches(held))
            held = []
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            held.append(batch.slice(a, z - a))
            if z < batch.num_rows:
                yield from pairs(pa.Table.from_batches(held))
                held = []
    if held:
        yield from pairs(pa.Table.from_batches(held))


def candidates(sketches: DataFrame, groups: DataFrame, sets: Callable[[DataFrame], DataFrame], share: Fraction) -> DataFrame:
    """Pairs (a, b) of ids of different groups that may be similar.

    ``sketches``: (id, n, tokens), tokens the first prefix_length(n) digests in ascending order;
    ``groups``: (node, component) of what is linked already; ``sets``: (id, s), all digests of ids.
    """
    first = sketches.select("id", F.explode("tokens").alias("tok"))
    many = first.groupBy("tok").agg(F.count("*").alias("m")).where("m > 1")
    shared = materialise(first.join(many, "tok").select("tok", "id", "m"), "shared")
    hot = shared.where(F.col("m") > HOT)
    nodes = sketches.select("id", "n").join(groups.select(F.col("node").alias("id"), F.col("component").alias("grp")), "id", "left")
    nodes = nodes.join(hot.groupBy("id").agg(F.count("*").cast("int").alias("h")), "id", "left")
    need = _floor(F.col("n"), share)
    nodes = materialise(nodes.select("id", "n", F.coalesce("grp", "id").alias("grp"), (need - F.coalesce("h", F.lit(0))).alias("t")), "sizes")

    cold = shared.where(F.col("m") <= HOT).join(small(nodes), "id")
    cold = cold.select("tok", "id", "n", "grp", F.greatest("t", F.lit(1)).alias("t"))
    pairs = cold.repartition("tok").sortWithinPartitions("tok").mapInArrow(lambda b: _bucket_pairs(b, float(share)), "a long, b long, t int")
    found = pairs.groupBy("a", "b", "t").agg(F.count("*").alias("k")).where("k >= t").select("a", "b")

    heavy = materialise(nodes.where("t <= 0").select("id", "n", "grp"), "heavy")
    if heavy.isEmpty():
        return found
    whole = materialise(sets(heavy.select("id")).select("id", F.explode("s").alias("tok")), "whole")
    often = whole.groupBy("tok").agg(F.count("*").alias("m")).where("m > 1")
    # A set's tokens that no other one has are its first ones; they need not move to be counted.
    alone = F.col("n") - F.count("*").over(Window.partitionBy("id"))
    place = alone + F.row_number().over(Window.partitionBy("id").orderBy("m", "tok"))
    lost = F.floor(F.col("n") * (share.denominator - share.numerator) / F.lit(float(share.denominator)) + F.lit(1e-9)).cast("int")
    rows = whole.join(often, "tok").join(heavy, "id").withColumn("at", place).where(F.col("at") <= lost + 1)
    rows = materialise(rows.select("id", "tok", "n", "grp", (F.col("n") - F.col("at") + 1).alias("left")), "again")
    # A token is of use if sets of two groups have it, and to a set if what follows is enough with the smallest of them.
    busy = rows.groupBy("tok").agg(F.count("*").alias("m"), F.min("n").alias("least"), F.min("grp").alias("g1"), F.max("grp").alias("g2")).where("g1 <> g2")
    rows = rows.join(busy.select("tok", "m", "least"), "tok").where(F.col("left") * (share.denominator + share.numerator) >= (F.col("n") + F.col("least")) * share.numerator)
    folds = sketches.join(small(heavy.select("id")), "id", "left_semi").select("id", folded(F.col("parity")).alias("fold"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = rows.join(folds, "id").withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("tok", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "id", "n", "grp", "left", "fold")
    met = rows.repartition("tok", "one", "two").sortWithinPartitions("tok", "one", "two").mapInArrow(lambda b: _meetings(b, share), "a long, b long")
    return found.unionAll(met).distinct()
