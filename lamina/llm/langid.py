"""Language identification by mixture inference.

Training counts letter trigrams (words padded by a blank, hashed into ``BUCKETS`` numbers) per
language over all learnt texts: tasks add up their own rows first, so that what moves and what the
driver gets is one row for each language and trigram of it, whatever the input.

A text is a mixture of languages. Expectation-maximisation estimates its proportions from the
trigrams' likelihoods: each trigram is shared out among the languages by proportion times
likelihood, and the shares make the next proportions, until these settle. It runs for all languages
first, and then for the one, two, ... of them with the largest proportions, as far as a language has
any; a set of languages is chosen by likelihood less a penalty for each language. The prediction is
the language with the largest proportion in the chosen set, the score that proportion.

There may be any number of languages. Where there are more than SLOTS, a text's mixture is found
among the SLOTS that alone explain it best, and then held against all: the likelihood is concave, so
a language left out can only have a share if its gradient is above one. Such languages join and the
mixture is found again, until there are none. A portion of texts is cut so that it takes about CELLS
numbers for its trigrams' languages; the model holds the trigrams that a language has, not all.

Null texts and texts without letters are ``und`` with score 0, as are all if nothing was learnt.
Null languages aren't learnt. Repeated rows get the same answer. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, ALPHA = 1 << 14, 0.05
#: Proportions have settled when none moves more, and a language has one if it is more.
SETTLED = 1e-3
#: Languages of a text's mixture before others are looked at; numbers that a portion of texts may take; how far a gradient is above one.
SLOTS, CELLS, ABOVE = 8, 1 << 22, 1e-2
#: Log-likelihood that a further language must bring, as a share of the trigrams and at least.
PENALTY_SHARE, PENALTY_LEAST = 0.02, 4.0

_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point of the first plane: its lower-case letter, or a blank."""
    global _LETTERS
    if _LETTERS is None:
        of = [chr(c) for c in range(1 << 16)]
        _LETTERS = np.array([ord(s.lower()[0]) if s.isalpha() else 32 for s in of], dtype=np.uint32)
    return _LETTERS


def trigrams(text: str | None) -> np.ndarray:
    """Bucket numbers of a text's letter trigrams, in order; none if it has no letters."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype=np.uint32)
    if not len(codes):
        return np.empty(0, dtype=np.int64)
    if (high := codes >= 1 << 16).any():
        codes = codes.copy()
        codes[high] = [c & 0xFFFF if chr(c).isalpha() else 32 for c in codes[high]]
        x = np.where(high, codes, _letters()[np.where(high, 0, codes)])
    else:
        x = _letters()[codes]
    if (x == 32).all():
        return np.empty(0, dtype=np.int64)
    x = np.concatenate(([32], x, [32])).astype(np.uint32)
    x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]
    h = (x[:-2] * np.uint32(2654435761)) ^ (x[1:-1] * np.uint32(2246822519)) ^ (x[2:] * np.uint32(3266489917))
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(668265263)) >> np.uint32(18)).astype(np.int64)


class Model:
    """Log-likelihoods of trigrams: ``base`` of each language for those that it lacks, and for each bucket the languages that have it, ascending, with what they have above their base."""

    def __init__(self, base: np.ndarray, bucket: np.ndarray, lang: np.ndarray, above: np.ndarray):
        order = np.lexsort((lang, bucket))
        self.base, self.lang, self.above = base, lang[order].astype(np.int32), above[order]
        self.start = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        self.keys = bucket[order].astype(np.int64) * len(base) + self.lang
        self.matrix = self._matrix() if len(base) * BUCKETS <= CELLS else None

    def _matrix(self) -> np.ndarray:
        out = np.repeat(self.base[:, None], BUCKETS, axis=1)
        out[self.lang, np.repeat(np.arange(BUCKETS), np.diff(self.start))] += self.above
        return out

    @staticmethod
    def dense(log_p: np.ndarray) -> Model:
        base = log_p.min(axis=1) if len(log_p) else np.empty(0)
        lang, bucket = np.nonzero(log_p > base[:, None])
        return Model(base, bucket, lang, (log_p - base[:, None])[lang, bucket])

    def logs(self, langs: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Of the languages ``langs`` (slot, trigram) for the trigrams' buckets."""
        if self.matrix is not None:
            return self.matrix[langs, buckets]
        key = buckets.astype(np.int64) * len(self.base) + langs
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return self.base[langs] + np.where(self.keys[at] == key, self.above[at], 0.0)

    def summed(self, buckets: np.ndarray, weights: np.ndarray, ratio: bool) -> np.ndarray:
        """For every language the sum over trigrams of weight times log-likelihood, or times likelihood."""
        sizes = self.start[buckets + 1] - self.start[buckets]
        at = np.repeat(self.start[buckets] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        more = np.expm1(self.above[at]) if ratio else self.above[at]
        extra = np.bincount(self.lang[at], np.repeat(weights, sizes) * more, len(self.base))
        return np.exp(self.base) * (weights.sum() + extra) if ratio else self.base * weights.sum() + extra


def train(documents: DataFrame) -> tuple[list[str], Model]:
    """Languages and their model, from the rows' text and non-null lang."""

    def count(batches):
        total: dict[str, np.ndarray] = {}

        def rows():
            for lang, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = trigrams(text)
                if len(t):
                    if lang not in total:
                        if len(total) * BUCKETS >= CELLS:
                            yield from rows()
                            total.clear()
                        total[lang] = np.zeros(BUCKETS, dtype=np.int64)
                    total[lang] += np.bincount(t, minlength=BUCKETS)
        yield from rows()

    counts = documents.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # a row for each language and trigram of it
    names = pa.array(sorted(table.column("lang").unique().to_pylist()), pa.string())
    lang = pc.index_in(table.column("lang").combine_chunks(), names).to_numpy(zero_copy_only=False)
    bucket, n = (table.column(c).to_numpy() for c in ("bucket", "n"))
    base = np.log(ALPHA / (np.bincount(lang, n, len(names)) + ALPHA * BUCKETS)) if len(names) else np.empty(0)
    return names.to_pylist(), Model(base, bucket, lang, np.log1p(n / ALPHA))


def mixture(texts: list[str | None], model: Model | np.ndarray) -> np.ndarray:
    """(text, language): the proportions of each text's chosen languages; all zero if it has none."""
    model = model if isinstance(model, Model) else Model.dense(model)
    share = np.zeros((len(texts), len(model.base)))
    for row, langs, q in mixtures(texts, model):
        share[row, langs] = q
    return share


def mixtures(texts: list[str | None], model: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text, languages, proportions) for each text that has letters, if there is a language at all."""
    rows, buckets, counts, cells = [], [], [], 0
    for i, text in enumerate(texts if len(model.base) else []):
        t = trigrams(text)
        if len(t):
            n = np.bincount(t, minlength=BUCKETS)
            at = np.flatnonzero(n)
            rows.append(i)
            buckets.append(at)
            counts.append(n[at])
            cells += len(at) * SLOTS + len(model.base)
            if cells > CELLS:
                yield from _portion(rows, buckets, counts, model)
                rows, buckets, counts, cells = [], [], [], 0
    if rows:
        yield from _portion(rows, buckets, counts, model)


def _portion(rows: list[int], buckets: list[np.ndarray], counts: list[np.ndarray], model: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    every = len(model.base)
    if every <= SLOTS:
        active = np.tile(np.arange(every), (len(rows), 1))
    else:
        active = np.stack([np.argpartition(-model.summed(b, c.astype(float), False), SLOTS - 1)[:SLOTS] for b, c in zip(buckets, counts, strict=True)])
        active.sort(axis=1)
    todo = np.arange(len(rows))
    while len(todo):
        own, sizes = [buckets[i] for i in todo], np.array([len(buckets[i]) for i in todo])
        flat, n = np.concatenate(own), np.concatenate([counts[i] for i in todo]).astype(float)
        logs = model.logs(np.repeat(active, sizes, axis=0).T, flat)
        top = logs.max(0)
        p = np.exp(logs - top)
        full = settle(np.full(active.shape, 1.0 / active.shape[1]), p, n, sizes) if active.shape[1] > 1 else np.ones(active.shape)
        more: dict[int, np.ndarray] = {}
        if active.shape[1] < every:
            mixed = np.log((np.repeat(full, sizes, axis=0).T * p).sum(0)) + top
            ends = np.cumsum(sizes)
            for i, (a, z) in enumerate(zip(ends - sizes, ends, strict=True)):
                least = mixed[a:z].min()  # keeps what follows within range
                g = model.summed(flat[a:z], n[a:z] * np.exp(least - mixed[a:z]), True) * np.exp(-least) / n[a:z].sum()
                g[active[i]] = 0
                found = np.flatnonzero(g > 1 + ABOVE)
                if len(found):
                    more[i] = found[np.argsort(-g[found], kind="stable")[:SLOTS]]
        done = np.array([i for i in range(len(todo)) if i not in more], dtype=int)
        if len(done):
            keep = np.isin(np.repeat(np.arange(len(todo)), sizes), done)
            for i, q in zip(done, _chosen(full[done], logs[:, keep], p[:, keep], top[keep], n[keep], sizes[done]), strict=True):
                yield rows[todo[i]], active[i], q
        if not more:
            return
        # All get as many new languages; those who need fewer get the next best, which do no harm.
        wide = min(every, active.shape[1] + max(map(len, more.values())))
        active = np.stack([np.sort(np.concatenate([active[i], new, np.setdiff1d(np.arange(min(every, 2 * wide)), [*active[i], *new])])[:wide]) for i, new in more.items()])
        todo = todo[list(more)]


def _chosen(full: np.ndarray, logs: np.ndarray, p: np.ndarray, top: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(text, slot): the proportions of each text's chosen set, ``full`` being those of all its languages, ``logs`` and ``p`` (slot, trigram) their likelihoods, p divided by exp(top)."""
    begin, slots = np.cumsum(sizes) - sizes, full.shape[1]
    total = np.add.reduceat(n, begin)
    alone = np.add.reduceat(logs * n, begin, axis=1).T
    best, chosen = alone.max(1), np.eye(slots)[alone.argmax(1)]
    base = np.add.reduceat(top * n, begin)
    rank = np.argsort(-full, axis=1, kind="stable")
    for size in range(2, slots + 1):
        on = np.flatnonzero(np.take_along_axis(full, rank[:, size - 1 : size], 1)[:, 0] > SETTLED)
        if not len(on):
            break
        start = np.zeros((len(on), slots))
        np.put_along_axis(start, rank[on, :size], np.take_along_axis(full[on], rank[on, :size], 1), 1)
        own = np.isin(np.repeat(np.arange(len(sizes)), sizes), on)
        q = settle(start / start.sum(1, keepdims=True), p[:, own], n[own], sizes[on])
        mixed = (np.repeat(q, sizes[on], axis=0).T * p[:, own]).sum(0)
        gain = base[on] + np.add.reduceat(np.log(np.maximum(mixed, 1e-300)) * n[own], np.cumsum(sizes[on]) - sizes[on])
        gain -= (size - 1) * np.maximum(PENALTY_SHARE * total[on], PENALTY_LEAST + 0.5 * np.log(total[on]))
        better = gain > best[on]
        best[on[better]], chosen[on[better]] = gain[better], q[better]
    return np.clip(chosen, 0.0, 1.0)


def settle(pi: np.ndarray, p: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Expectation-maximisation of each text's proportions until they move by SETTLED at most. ``p`` (language, trigram) and ``n`` are of the texts' trigrams, ``sizes`` of them for each text."""
    out, left = pi.copy(), np.arange(len(pi))
    while len(left):
        begin = np.cumsum(sizes) - sizes
        r = np.repeat(pi, sizes, axis=0).T * p
        r *= n / np.maximum(r.sum(0), 1e-300)
        now = np.add.reduceat(r, begin, axis=1).T / np.add.reduceat(n, begin)[:, None]
        moving = np.abs(now - pi).max(1) > SETTLED
        out[left] = pi = now
        if not moving.all():
            own = np.repeat(moving, sizes)
            left, pi, p, n, sizes = left[moving], pi[moving], p[:, own], n[own], sizes[moving]
    return out


def with_language(documents: DataFrame, langs: list[str], model: Model, column: str = "language") -> DataFrame:
    """All rows and columns and a struct (lang_pred, score, languages: those chosen with their proportions), from the text alone. An older column of that name is replaced."""
    names = np.array([*langs, "und"], dtype=object)
    broadcast = documents.sparkSession.sparkContext.broadcast(model)  # a row for each language and trigram of it
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.map_(pa.string(), pa.float64()))])

    @F.arrow_udf("struct<lang_pred: string, score: double, languages: map<string, double>>")
    def predict(text: pa.Array) -> pa.Array:
        parts = []
        for i in range(0, len(text), 256):
            part = text[i : i + 256].to_pylist()
            main, score, found = np.full(len(part), len(langs)), np.zeros(len(part)), [(np.empty(0, dtype=int), np.empty(0))] * len(part)
            for row, own, q in mixtures(part, broadcast.value):
                main[row], score[row], found[row] = own[q.argmax()], q.max(), (own[q > 0], q[q > 0])
            ends = np.cumsum([0, *(len(x[0]) for x in found)])
            maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names[np.concatenate([x[0] for x in found])], pa.string()), pa.array(np.concatenate([x[1] for x in found])))
            parts.append(pa.StructArray.from_arrays([pa.array(names[main], pa.string()), pa.array(score), maps], names=["lang_pred", "score", "languages"]))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return documents.withColumn(column, predict("text"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
