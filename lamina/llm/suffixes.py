"""Repeated passages with sparse suffix arrays.

Suffixes are kept only at positions that the content selects: of every WINDOW consecutive runs of
GRAM words the one with the least hash (its minimiser). GRAM + WINDOW - 1 = MIN_WORDS, so a passage
of MIN_WORDS words or more holds at least one selected run, and all its copies select the same ones.
Suffixes are sorted by run, text to the right and text to the left; sorted neighbours of different
texts are compared and the match is extended right and left. The next selected run is at most
WINDOW words away, so comparing WINDOW - 1 words to the left and MIN_WORDS to the right is enough:
matches of MIN_WORDS words or more are reported, and what is longer is reported by several runs and
merged. All words have A-Z lower-cased.

The order favours what goes on to the right, so of more than two suffixes neighbours may not be those
that match longest. The task that compares them therefore looks for the other windows of MIN_WORDS
words around the run, by hashes that choose whom to compare, and compares the words. Runs with more
than HOLD suffixes, or with suffixes in several tasks, are looked at in parts; then all their windows are
grouped on digests of 128 bits, which also tell equal texts here, and those that no match covers yet
are looked up. Nothing is left out.

Equal texts count once: they are one text in the search, and each of them is a passage as a whole.
Runs that only one text has never leave the first aggregation. Sorting is by ranges, so a passage
that very many documents share is spread over tasks; the rows where two ranges meet are compared
afterwards too.

A passage is a maximal range of words covered by such matches. Null texts are empty; texts of
fewer than MIN_WORDS words have no passages. Repeated rows of one doc_id and text are copies too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import ascii_lower, materialise, small

GRAM, MIN_WORDS = 16, 50
WINDOW = MIN_WORDS - GRAM + 1
HOLD = 1 << 14  # suffixes of one run that a task looks at together
_BITS = 22  # words of a block; longer texts are taken in overlapping blocks


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def minimisers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Selected positions and the hashes of the runs that begin there."""
    n = len(words)
    if n < MIN_WORDS:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    if n >= 1 << _BITS:
        step = (1 << _BITS) - MIN_WORDS - 1
        parts = [(p + at, h) for at in range(0, n, step) for p, h in [minimisers(words[at : at + step + MIN_WORDS])]]
        at, first = np.unique(np.concatenate([p for p, _ in parts]), return_index=True)
        return at, np.concatenate([h for _, h in parts])[first]
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
    m = n - GRAM + 1
    h = np.zeros(m, dtype=np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + m]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    low = np.uint64((1 << _BITS) - 1)
    least = (h & ~low) | np.arange(m, dtype=np.uint64)  # of equal hashes the leftmost
    reach = 1
    while reach < WINDOW:  # doubles the stretch that each minimum covers
        by = min(reach, WINDOW - reach)
        least = np.minimum(least[:-by], least[by:])
        reach += by
    at = np.unique((least & low).astype(np.int64))
    # In a stretch of equal runs (one word over and over) every position would be selected: each GRAM-th from either end of the
    # whole stretch will do, as a window that holds an end of it holds the same positions in every text.
    new = np.concatenate(([True], h[1:] != h[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], m) - 1
    stretch, own = np.cumsum(new) - 1, np.arange(m)
    hit = np.zeros(len(first), dtype=bool)
    hit[stretch[at]] = True
    at = np.flatnonzero(hit[stretch] & (((own - first[stretch]) % GRAM == 0) | ((last[stretch] - own) % GRAM == 0)))
    return at, h[at].view(np.int64)


def common(a: list[bytes], b: list[bytes]) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


class _Neighbours:
    """Compares each suffix with the nearest one of another text on either side, in sorted order."""

    def __init__(self):
        self.streak: list[tuple] = []  # suffixes since the text last changed
        self.before: tuple | None = None  # the one before the streak

    def add(self, row: tuple) -> Iterator[tuple]:
        """row: (run, text, position, left words reversed, right words). Yields (text, position, first word, end)."""
        if self.streak and row[0] != self.streak[-1][0]:
            self.streak, self.before = [], None
        if self.streak and self.streak[-1][1] != row[1]:
            for other in self.streak:
                yield from match(other, row)
            self.before, self.streak = self.streak[-1], [row]
        else:
            if self.before is not None:
                yield from match(self.before, row)
            self.streak.append(row)


def match(a: tuple, b: tuple) -> Iterator[tuple]:
    right, left = common(a[4], b[4]), common(a[3], b[3])
    if right >= GRAM and left + right >= MIN_WORDS:
        for x in (a, b):
            yield x[1], x[2], x[2] - left, x[2] + right


def other_windows(rows: list[tuple], known: dict[tuple, list[tuple]]) -> Iterator[tuple]:
    """Matches among the rows of one run (as in _Neighbours.add) in windows that the known ones do not cover.

    known: (text, position) to [(first word, end)].
    """
    n, before = len(rows), WINDOW - 1
    start = np.arange(WINDOW)  # of a window, counted from the furthest word to the left
    lefts = np.fromiter((len(r[3]) for r in rows), np.int64, n)[:, None]
    rights = np.fromiter((len(r[4]) for r in rows), np.int64, n)[:, None]
    valid = (start >= before - lefts) & (start + MIN_WORDS <= before + rights)
    open_ = valid.copy()
    for i, r in enumerate(rows):
        for s, e in known.get((r[1], r[2]), ()):
            at = start + (r[2] - before)
            open_[i] &= (at < s) | (at + MIN_WORDS > e)
    if not open_.any():
        return
    words = np.zeros((n, before + MIN_WORDS), dtype=np.int64)
    for i, r in enumerate(rows):
        around = r[3][::-1] + r[4]
        words[i, before - len(r[3]) : before + len(r[4])] = np.fromiter(map(hash, around), np.int64, len(around))
    base, whole = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, MIN_WORDS, 1 << 64))
    prefix = np.zeros((n, before + MIN_WORDS + 1), dtype=np.uint64)
    for j in range(before + MIN_WORDS):
        prefix[:, j + 1] = prefix[:, j] * base + words.view(np.uint64)[:, j]
    hashes = prefix[:, MIN_WORDS:] - prefix[:, :WINDOW] * whole + start.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    codes: dict[bytes, int] = {}
    text = np.fromiter((codes.setdefault(r[1], len(codes)) for r in rows), np.int64, n)
    row, col = np.nonzero(valid)
    key = hashes[row, col]
    order = np.lexsort((text[row], key))
    row, col, key = row[order], col[order], key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    own = np.cumsum(new) - 1
    low, high = row[first[own]], row[last[own]]  # rows of the class whose texts differ most
    partner = np.where(text[row] != text[low], low, high)
    pick = open_[row, col] & (text[row] != text[partner])
    for i, k in np.unique(np.stack([row[pick], partner[pick]], axis=1), axis=0).tolist():
        yield from match(rows[i], rows[k])


def repeated_passages(documents: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): passages of MIN_WORDS words or more that another document has too."""
    identity = F.substring(F.unhex(F.sha2(ascii_lower(F.col("text")), 256)), 1, 16).alias("t")
    rows = documents.select("doc_id", identity, "text")

    def select(batches):
        for b in batches:
            for t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words_of(text)
                if len(w) >= MIN_WORDS:
                    at, h = minimisers(w)
                    yield pa.RecordBatch.from_arrays([pa.array([None, *h.tolist()], pa.int64()), pa.array([t] * (len(at) + 1), pa.binary()), pa.array(np.append(len(w), at).astype(np.int64))], names=["h", "t", "p"])

    seeds = materialise(rows.select("t", "text").mapInArrow(select, "h long, t binary, p long").distinct(), "seeds")
    twice = materialise(seeds.where("h IS NOT NULL").groupBy("h").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).where("t0 <> t1").select("h"), "runs")
    wanted = seeds.join(twice, "h").groupBy("t").agg(F.collect_list("p").alias("p"))

    own = materialise(rows.select("doc_id", "t"), "texts")
    each = own.groupBy("t", "doc_id").agg(F.count("*").alias("k"))
    groups = materialise(each.groupBy("t").agg(F.min(F.struct("doc_id", "k")).alias("one"), F.sum("k").alias("n")).select("t", "one.*", "n"), "equal")
    wanted = materialise(wanted.join(groups.select("t", "doc_id", "k"), "t"), "wanted")
    sources = rows.join(wanted, [rows.t == wanted.t, rows.doc_id.eqNullSafe(wanted.doc_id)]).select(rows.t, "p", "text")
    if not wanted.where("k > 1").isEmpty():  # rows that repeat a doc_id and its text
        sources = sources.dropDuplicates(["t"])

    def contexts(batches):
        for b in batches:
            for t, p, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                w = words_of(text)
                at, h = minimisers(w)
                of = dict(zip(at.tolist(), h.tolist(), strict=True))
                p = sorted(set(p))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([of[x] for x in p], pa.int64()),
                        pa.array([t] * len(p), pa.binary()),
                        pa.array(p, pa.int64()),
                        pa.array([b" ".join(w[max(0, x - WINDOW + 1) : x][::-1]) for x in p], pa.binary()),
                        pa.array([b" ".join(w[x : x + MIN_WORDS]) for x in p], pa.binary()),
                    ],
                    names=["h", "t", "p", "l", "r"],
                )

    suffixes = materialise(sources.mapInArrow(contexts, "h long, t binary, p long, l binary, r binary"), "suffixes")
    order = ["h", "r", "l", "t", "p"]

    def compare(batches):
        out: list[tuple] = []
        for row in _compared(batches, TaskContext.get().partitionId(), HOLD):
            out.append(row)
            if len(out) == 1 << 14:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    schema = "part int, kind int, h long, t binary, p long, l binary, r binary, s long, e long"
    found = suffixes.select("h", "t", "p", "l", "r").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, schema)
    found = materialise(found, "matches")

    # Where one range ends and the next begins: two rows for each task of the comparison.
    w = Window.partitionBy(F.lit(0)).orderBy("part", "kind")
    edges = found.where("kind < 2").select("h", "t", "p", "l", "r", "kind", *[F.lag(c).over(w).alias(f"{c}0") for c in ("h", "t", "p", "l", "r")])
    edges = edges.where("kind = 0 AND h = h0 AND t <> t0")

    def meet(batches):
        for b in batches:
            out = []
            for h, t, p, left, right, t0, p0, l0, r0 in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                out += [_span(0, m) for m in match((h, t, p, left.split(), right.split()), (h, t0, p0, l0.split(), r0.split()))]
            if out:
                yield _rows(out)

    more = edges.select("h", "t", "p", "l", "r", "t0", "p0", "l0", "r0").mapInArrow(meet, schema)
    # Of runs that no task has seen as a whole every window is known here, but only those that no match covers yet are looked up.
    windows = found.where("kind = 3")
    shared = windows.groupBy("r").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("p").alias("open"))
    shared = materialise(shared.where("t0 <> t1 AND open = 1").select("r"), "shared")
    covered = windows.where("p = 1").join(small(shared), "r").select("t", "s", "e")
    spans = found.where("kind = 2").unionAll(more).select("t", "s", "e").unionAll(covered).distinct()
    # A text that several rows have is a passage as a whole.
    whole = groups.where("n > 1").select("t").join(seeds.where("h IS NULL"), "t").select("t", F.lit(0).cast("long").alias("s"), F.col("p").alias("e"))
    spans = spans.unionAll(whole)
    by_text = Window.partitionBy("t").orderBy("s", "e")
    reach = F.max("e").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    merged = spans.withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1)).withColumn("g", F.sum("new").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
    merged = materialise(merged.groupBy("t", "g").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word")), "passages")
    return own.join(merged, "t").select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def _compared(batches, part: int, hold: int) -> Iterator[tuple]:
    """Rows of the schema above for a task's suffixes. kind 0: the first suffix, 1: the last, 2: a match (t, s, e), 3: a window.

    Windows (r: digest, p: 1 if no match covers it) are those of runs that this task may not have as a whole.
    """
    here, last, whole = _Neighbours(), None, False
    run: list[tuple] = []
    known: dict[tuple, list[tuple]] = {}

    def finish():
        if len(run) > 2:
            for m in list(other_windows(run, known)):
                known.setdefault(m[:2], []).append(m[2:])
                yield _span(part, m)
        if not whole:
            for _, t, p, before, after in run:
                w, n = before[::-1] + after, len(before)
                for i in range(min(n, len(w) - MIN_WORDS) + 1):
                    s = p - n + i
                    covered = any(x <= s and s + MIN_WORDS <= y for x, y in known.get((t, p), ()))
                    yield part, 3, None, t, int(not covered), None, hashlib.blake2b(b" ".join(w[i : i + MIN_WORDS]), digest_size=16).digest(), s, s + MIN_WORDS

    for b in batches:
        for raw in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            h, t, p, left, right = raw
            if last is None:
                yield part, 0, *raw, None, None
            elif h != last[0] or len(run) == hold:
                whole = whole and len(run) < hold
                yield from finish()
                run, known, whole = [], {}, h != last[0]
            last = raw
            row = (h, t, p, left.split(), right.split())
            for m in here.add(row):
                known.setdefault(m[:2], []).append(m[2:])
                yield _span(part, m)
            run.append(row)
    if last is not None:
        whole = False
        yield from finish()
        yield part, 1, *last, None, None


def _span(part: int, found: tuple) -> tuple:
    text, at, start, end = found
    return part, 2, None, text, at, None, None, start, end


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["part", "kind", "h", "t", "p", "l", "r", "s", "e"])
