"""Orders drawn again from their actions, on whole Arrow batches.

The bridges of many orders lie one order after another in flat arrays; ``size`` says how many each
order has, one at least. Every step is a few NumPy operations on all of them, and the work grows
with the number of bridges, however long an order is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Where an arc leads that has no other end at a bridge.
START, END, NOWHERE = -3, -2, -1
#: Lines, in whole orders, that are decoded together; more only if one order has more.
LINES = 1 << 16


def _starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def actions(perm: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(up, dn): for each bridge, from west to east, whether its arc above and its arc below open there."""
    first, n = np.repeat(_starts(size), size), np.repeat(size, size)
    place = np.arange(len(perm)) - first
    before, after = np.roll(perm, 1), np.roll(perm, -1)
    before, after = np.where(place == 0, n + 1, before), np.where(place == n - 1, n, after)
    even = place % 2 == 0
    up, dn = np.empty(len(perm), dtype=bool), np.empty(len(perm), dtype=bool)
    up[first + perm] = np.where(even, after, before) > perm
    dn[first + perm] = np.where(even, before, after) > perm
    return up, dn


def other_ends(opens: np.ndarray, size: np.ndarray, free: tuple[int, ...]) -> np.ndarray:
    """For each bridge the index of its arc's other end; arcs still open at an order's end lead to ``free``, the outermost to the first, and one that closes nothing leads nowhere.

    Brackets of one depth, in order, are mates two by two."""
    order, first = np.repeat(np.arange(len(size)), size), _starts(size)
    step = np.where(opens, 1, -1)
    total = np.cumsum(step)
    level = total - np.repeat(total[first] - step[first], size) - opens  # an arc's ends have one level
    by = np.lexsort((level, order))  # stable
    a, b = by[:-1], by[1:]
    pair = (order[a] == order[b]) & (level[a] == level[b]) & opens[a] & ~opens[b]
    out = np.full(len(opens), NOWHERE)
    out[a[pair]], out[b[pair]] = b[pair], a[pair]
    left = np.flatnonzero(opens & (out == NOWHERE))
    whose = order[left]
    rank = np.arange(len(left)) - np.searchsorted(whose, whose)
    for i, end in enumerate(free):
        out[left[rank == i]] = end
    return out


def decode(up: np.ndarray, dn: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The orders that have these actions: arcs are drawn on both sides and each curve is followed from its start; -1 from where it ends or leads nowhere."""
    first = _starts(size)
    above, below = other_ends(up, size, (END,)), other_ends(dn, size, (START, END))
    lost = len(up)  # a place after all bridges, which leads to itself
    sides = [np.append(np.where(side < 0, lost, side), lost) for side in (below, above)]
    begin = np.full(len(size), lost)
    at = np.flatnonzero(below == START)
    begin[np.searchsorted(first, at, side="right") - 1] = at
    longest = np.argsort(-size, kind="stable")
    reach = len(size) - np.cumsum(np.bincount(size))  # how many orders have more than k bridges
    out = np.empty(lost, dtype=np.int64)
    now, base = begin[longest], first[longest]
    for k in range(len(reach) - 1):
        now, base = now[: reach[k]], base[: reach[k]]
        now = sides[k % 2][now] if k else now
        out[base + k] = np.where(now < lost, now - base, -1)
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of whole orders, each of which begins with pos 0."""
    kept, rows = [], 0
    for batch in batches:
        begins = np.flatnonzero(batch.column("pos").to_numpy() == 0)
        if rows + batch.num_rows > LINES and len(begins):
            cut = int(begins[-1])
            if rows + cut:
                yield pa.concat_batches([*kept, batch.slice(0, cut)])
            batch, kept, rows = batch.slice(cut), [], 0
        kept.append(batch)
        rows += batch.num_rows
    if rows:
        yield pa.concat_batches(kept)


def decoded(lines: DataFrame, key: str) -> DataFrame:
    """(key, decoded, same) of orders whose lines (key, pos, bridge) lie in one partition one after another: each order's actions decoded, and whether that is the order."""
    own = lines.select(key, "pos", "bridge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches):
            perm = batch.column("bridge").to_numpy().astype(np.int64)
            first = np.flatnonzero(batch.column("pos").to_numpy() == 0)
            size = np.diff(np.append(first, len(perm)))
            back = decode(*actions(perm, size), size)
            same = np.logical_and.reduceat(back == perm, first)
            ends = np.append(0, np.cumsum(np.where(same, size, 0))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(back[np.repeat(same, size)]).cast(pa.string()))
            texts = pc.if_else(pa.array(same), pc.binary_join(lists, ","), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(first)), texts, pa.array(same)], names=[key, "decoded", "same"])

    return own.mapInArrow(run, f"{key} {own.schema[key].dataType.simpleString()}, decoded string, same boolean")
