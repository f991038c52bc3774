"""States as integers, and a bridge's steps forward and back on whole Arrow batches.

A state is three integer columns, so grouping, joins and shuffles compare machine words: h, the
place e of the letter E (-1: none), and bits, the brackets as binary digits (1 for ')') behind a
leading 1. One batch of states becomes a matrix of letters; every step is a few NumPy operations on
all its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, EAST, NONE = 1, -1, 2, 0
#: Brackets that fit into a long behind the leading 1.
MOST = 62


def narrow(word: Column) -> tuple[Column, Column]:
    """(e, bits) of a word; one that doesn't fit, or isn't balanced, is an error."""
    bare = F.replace(word, F.lit("E"), F.lit(""))
    digits = F.translate(bare, "()", "01")
    bits = F.conv(F.concat(F.lit("1"), digits), 2, 10).cast("long")
    sound = (F.length(bare) <= MOST) & (2 * F.length(F.replace(bare, F.lit(")"), F.lit(""))) == F.length(bare)) & (F.length(word) - F.length(bare) <= 1)
    return (F.instr(word, "E") - 1).alias("e"), F.when(sound, bits).otherwise(F.raise_error(F.concat(F.lit("a state that does not fit: "), word))).cast("long").alias("bits")


def brackets(bits: Column) -> Column:
    """How many brackets a state has."""
    return F.length(F.bin(bits)) - 1


def widen(e: Column, bits: Column) -> Column:
    """The word again."""
    bare = F.translate(F.substring(F.bin(bits), F.lit(2), F.lit(MOST + 1)), "01", "()")
    return F.when(e < 0, bare).otherwise(F.concat(F.substring(bare, F.lit(1), e), F.lit("E"), F.substring(bare, e + 1, F.lit(MOST + 1))))


def unpack(e: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters, length): a row per state, filled up with NONE."""
    n = np.zeros(len(bits), dtype=np.int64)
    rest = bits.copy()
    for s in (32, 16, 8, 4, 2, 1):
        big = rest >> s > 0
        n += big * s
        rest = np.where(big, rest >> s, rest)
    width = int(n.max(initial=0)) + 1
    at = np.arange(width)
    has = (e >= 0)[:, None]
    own = at - (has & (at > e[:, None]))  # which bracket stands there
    shift = n[:, None] - 1 - own
    letters = np.where((own >= 0) & (shift >= 0), np.where((bits[:, None] >> np.maximum(shift, 0)) & 1, CLOSE, OPEN), NONE)
    letters = np.where(has & (at == e[:, None]), EAST, letters)
    return letters.astype(np.int8), n + (e >= 0)


def pack(letters: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(e, bits) of rows of letters."""
    if len(length) and int(length.max()) > MOST + 1:
        raise OverflowError(f"states of more than {MOST} brackets do not fit")
    bits = np.ones(len(letters), dtype=np.int64)
    e = np.full(len(letters), -1, dtype=np.int32)
    for j in range(letters.shape[1]):
        c = letters[:, j]
        live = j < length
        bits = np.where(live & (c != EAST), (bits << 1) | (c == CLOSE), bits)
        e = np.where(live & (c == EAST), j, e)
    return e, bits


def mates(letters: np.ndarray) -> np.ndarray:
    """For each bracket the place of its mate; -1 for all else. Brackets of one depth, in order, are mates two by two."""
    step = np.where(np.abs(letters) == 1, letters, 0).astype(np.int64)
    after = step.cumsum(axis=1)
    far = letters.shape[1] + 1
    depth = np.where(letters == OPEN, after - 1, np.where(letters == CLOSE, after, far))
    if depth.shape[1] % 2:
        depth = np.pad(depth, ((0, 0), (0, 1)), constant_values=far)
    order = np.argsort(depth, axis=1, kind="stable")
    out = np.empty_like(order)
    np.put_along_axis(out, order[:, 0::2], order[:, 1::2], axis=1)
    np.put_along_axis(out, order[:, 1::2], order[:, 0::2], axis=1)
    return np.where(depth < far, out, -1)[:, : letters.shape[1]]


def splice(letters: np.ndarray, at: np.ndarray, drop: int, new: tuple[int, ...] = ()) -> np.ndarray:
    """Rows with ``new`` letters in the place of ``drop`` ones from ``at`` on."""
    wide = np.pad(letters, ((0, 0), (0, drop + len(new))))
    place = np.arange(letters.shape[1] + len(new))
    source = np.where(place < at[:, None], place, np.maximum(place - len(new) + drop, 0))
    out = np.take_along_axis(wide, source, axis=1)
    for j, c in enumerate(new):
        out[np.arange(len(at)), at + j] = c
    return out


Rows = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def forward(letters: np.ndarray, length: np.ndarray, h: np.ndarray) -> Rows:
    """(row, letters, length, h) after each kind of bridge."""
    yield np.arange(len(h)), splice(letters, h, 0, (OPEN, CLOSE)), length + 2, h + 1
    for r, by in ((np.flatnonzero(length > h), 1), (np.flatnonzero(h > 0), -1)):
        yield r, letters[r], length[r], h[r] + by
    r = np.flatnonzero((h > 0) & (length > h))
    mate, row = mates(letters[r]), np.arange(len(r))
    p, q = mate[row, h[r] - 1], mate[row, h[r]]
    r, p, q = (x[p != h[r]] for x in (r, p, q))  # else a loop would close
    w, row, lone = letters[r].copy(), np.arange(len(r)), (p < 0) | (q < 0)
    low, high = np.where(lone, np.maximum(p, q), np.minimum(p, q)), np.maximum(p, q)
    w[row, low] = np.where(lone, EAST, OPEN)
    w[row, high] = np.where(lone, EAST, CLOSE)
    yield r, splice(w, h[r] - 1, 2), length[r] - 2, h[r] - 1


def back(letters: np.ndarray, length: np.ndarray, h: np.ndarray) -> Rows:
    """(row, letters, length, h) of the states without E that a bridge leads from."""
    at, row = np.arange(letters.shape[1]), np.arange(len(h))
    fresh = np.flatnonzero((h > 0) & (h < length) & (letters[row, np.maximum(h - 1, 0)] == OPEN) & (letters[row, np.minimum(h, letters.shape[1] - 1)] == CLOSE))
    yield fresh, splice(letters[fresh], h[fresh] - 1, 2), length[fresh] - 2, h[fresh] - 1
    for r, by in ((np.flatnonzero(h > 0), -1), (np.flatnonzero(h < length), 1)):
        yield r, letters[r], length[r], h[r] + by
    # A piece can be cut open where it can be seen from the cut: on the cut's level, with nothing lower between.
    level = np.pad(letters.astype(np.int64).cumsum(axis=1), ((0, 0), (1, 0)))
    cut = level[row, h][:, None]
    places = np.arange(level.shape[1])
    east = np.minimum.accumulate(np.where(places >= h[:, None], level, 1 << 30), axis=1)[:, :-1]
    west = np.minimum.accumulate(np.where(places <= h[:, None], level, 1 << 30)[:, ::-1], axis=1)[:, ::-1][:, 1:]
    right = (at >= h[:, None]) & (letters == OPEN) & (level[:, :-1] == cut) & (east >= cut)
    left = (at < h[:, None]) & (letters == CLOSE) & (level[:, 1:] == cut) & (west >= cut)
    over = (at < h[:, None]) & (letters == OPEN) & (level[:, 1:] == cut) & (west >= cut)
    for seen, now, new in ((right, CLOSE, (OPEN, OPEN)), (left, OPEN, (CLOSE, CLOSE)), (over, None, (CLOSE, OPEN))):
        r, p = np.nonzero(seen)
        w = letters[r].copy()
        if now is not None:
            w[np.arange(len(r)), p] = now
        yield r, splice(w, h[r], 0, new), length[r] + 2, h[r] + 1


def depth(letters: np.ndarray, length: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Fewest bridges that build each state."""
    level = np.pad(np.where(np.abs(letters) == 1, letters, 0).astype(np.int64).cumsum(axis=1), ((0, 0), (1, 0)))
    return length - level[np.arange(len(h)), h]


def stepped(states: DataFrame, *keep: str, backwards: bool = False, window: tuple[int, int] | None = None) -> DataFrame:
    """(keep..., h, e, bits, depth, count) of the states a bridge on, or back, each with its source's count; no two equal ones are merged here.

    With a ``window`` (low, high), states of a depth outside (low, high] are dropped before they are packed."""
    rows = states.select(*keep, F.col("h").cast("int").alias("h"), F.col("e").cast("int").alias("e"), "bits", "count")
    own = [f for f in rows.schema if f.name in keep]
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in own), "h int, e int, bits long, depth int", f"count {rows.schema['count'].dataType.simpleString()}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, e, bits = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(keep), len(keep) + 3))
            letters, length = unpack(e, bits)
            for row, w, n, high in (back if backwards else forward)(letters, length, h.astype(np.int64)):
                deep = depth(w, n, high)
                if window:
                    own = (deep > window[0]) & (deep <= window[1])
                    row, w, n, high, deep = (x[own] for x in (row, w, n, high, deep))
                if not len(row):
                    continue
                new_e, new_bits = pack(w, n)
                kept = batch.take(pa.array(row))
                now = [pa.array(high.astype(np.int32)), pa.array(new_e), pa.array(new_bits), pa.array(deep.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*kept.columns[: len(keep)], *now, kept.columns[-1]], names=[*keep, "h", "e", "bits", "depth", "count"])

    return rows.mapInArrow(run, ddl)
