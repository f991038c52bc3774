"""Toxicity by noisy-channel deobfuscation.

A lexicon is learnt from labels: words and beginnings of words that stand in far more toxic than
clean documents. A character language model (trigrams of letters) is counted over all texts.

Scoring restores what writers disguise. A token that is not plain letters, or that repeats letters,
becomes a lattice: each character may be a letter, a letter it stands for (leetspeak), noise, or a
repetition of the one before. Viterbi decoding finds the likeliest word under the channel's costs
and the character model, which is the corpus model mixed with one of the lexicon's words. Letters
spaced out over a line are joined first. The lexicon then sees the restored words, and a logistic
function of the strongest hit and the number of hits gives the score. Only tokens whose skeleton
(look-alikes merged, noise dropped, repetitions collapsed) begins like a lexicon entry can restore
to one, so only they are decoded; look-alikes before a token may be noise, and what stands between
slashes, hyphens, brackets and the like is a token of its own as well.

The lexicon and the logistic function are fitted on at most ``sample`` labelled rows, those with
the smallest hashes of doc_id; these bound the lexicon, which keeps all entries of enough evidence.

Null and empty texts have no hits and score low. Labels other than 0 and 1 aren't learnt; without
both kinds the score is the smoothed share of label 1. Repeated rows get the same score. Other
columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import materialise

SAMPLE = 100_000
#: An entry's evidence (log-likelihood ratio against independence), log-odds and length.
EVIDENCE, ODDS, PREFIXES = 18.0, 1.5, range(4, 9)
#: What a character may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "£": "l", "¡": "i", "§": "s"}
_MERGED = {"l": "i"} | {k: ("i" if "i" in v or v == "l" else v) for k, v in LOOKS.items()}
#: Letters of a skeleton that are looked up before all of it.
HEAD = 5
_NONE: list[str] = []  # one for all tokens without hits
SUBSTITUTE, NOISE, NOISE_LOOK, REPEAT = -0.6, -0.3, -4.0, -0.7
LETTERS, EDGE, OTHER, SIZE = 26, 26, 27, 28

_WORDS = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[\W\d_]|(.)\1")
_REPEATED = re.compile(r"(.)\1+", re.DOTALL)
_CUTS = re.compile(r"[/\\()\[\]{}<>|+,;:\"'–—-]+")
_SPACED = re.compile(r"(?<!\w)(?:\S[\s._*-]{1,3}){3,}\S(?!\w)")


def symbol(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else OTHER if c.isalpha() else EDGE


_SYMBOLS: np.ndarray | None = None


def trigram_counts(text: str) -> np.ndarray:
    """Counts of letter trigrams; words have an edge before and after."""
    global _SYMBOLS
    if _SYMBOLS is None:
        _SYMBOLS = np.array([symbol(chr(c).lower()[0]) for c in range(1 << 16)], dtype=np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    x = _SYMBOLS[np.minimum(codes, 0xFFFF)]
    x = np.concatenate(([EDGE], x, [EDGE]))
    x = x[np.concatenate(([True], (x[1:] != EDGE) | (x[:-1] != EDGE)))]
    return np.bincount(x[:-2] * SIZE * SIZE + x[1:-1] * SIZE + x[2:], minlength=SIZE**3) if len(x) > 2 else np.zeros(SIZE**3, dtype=np.int64)


def char_counts(documents: DataFrame) -> np.ndarray:
    """The corpus' letter trigrams: tasks add up their rows, the driver gets 28 ** 3 counts."""

    def count(batches):
        total = np.zeros(SIZE**3, dtype=np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                total += trigram_counts(text)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["t", "n"])

    rows = documents.where("text IS NOT NULL").select("text").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SIZE**3)
    out[[r["t"] for r in rows]] = [r["n"] for r in rows]
    return out


def entries(word: str) -> list[str]:
    """Lexicon keys of a word: itself after '=', and its beginnings."""
    return [f"={word}", *(word[:n] for n in PREFIXES if n < len(word))]


class _Skeleton(dict):
    """For str.translate(): look-alikes merged, all but letters dropped. Filled as characters are met."""

    def __missing__(self, code: int) -> str | None:
        c = _MERGED.get(chr(code), chr(code))
        self[code] = c if c.isalpha() else None
        return self[code]


_SKELETON = _Skeleton()


def skeleton(token: str) -> str:
    return _REPEATED.sub(r"\1", token.translate(_SKELETON))


@dataclass
class Model:
    lexicon: dict[str, float]
    log_p: np.ndarray  # of a letter after two
    weights: np.ndarray  # bias, strongest hit, log number of hits, any hit
    skeletons: set[str] = field(init=False)
    lengths: list[int] = field(init=False)
    beginnings: list[int] = field(init=False)  # lengths of entries that are beginnings of words
    short: list[int] = field(init=False)  # lengths of skeletons below HEAD
    heads: set[str] = field(init=False)  # first letters of the other skeletons

    def __post_init__(self):
        self.skeletons = {skeleton(k.lstrip("=")) for k in self.lexicon}
        self.lengths = sorted({len(s) for s in self.skeletons})
        self.beginnings = sorted({len(k) for k in self.lexicon if k[0] != "="})
        self.short = [n for n in self.lengths if n < HEAD]
        self.heads = {s[:HEAD] for s in self.skeletons if len(s) >= HEAD}

    def hits(self, word: str) -> list[str]:
        found = [f"={word}"] if f"={word}" in self.lexicon else []
        for n in self.beginnings:
            if n < len(word) and word[:n] in self.lexicon:
                found.append(word[:n])
        return found

    def decode(self, token: str) -> str:
        """The likeliest word behind a token."""
        states = {(EDGE, EDGE): (0.0, "")}
        before = ""
        for c in token:
            options = [(c, 0.0)] if c.isalpha() else []
            options += [(x, SUBSTITUTE) for x in LOOKS.get(c, "")]
            drop = REPEAT if c == before else None if c.isalpha() else NOISE_LOOK if c in LOOKS else NOISE
            before, now = c, {}
            for (a, b), (p, word) in states.items():
                if drop is not None and p + drop > now.get((a, b), (-math.inf,))[0]:
                    now[a, b] = (p + drop, word)
                for x, cost in options:
                    s = symbol(x)
                    q = p + cost + self.log_p[a, b, s]
                    if q > now.get((b, s), (-math.inf,))[0]:
                        now[b, s] = (q, word + x)
            states = now
        return max((p + self.log_p[a, b, EDGE], word) for (a, b), (p, word) in states.items())[1]

    def token_hits(self, token: str) -> list[str]:
        words = (token,) if token.isalpha() else _WORDS.findall(token)
        found = [k for w in words for k in self.hits(w)]
        if found or not _ODD.search(token):
            return found
        parts = [token]
        if token[0] in LOOKS and not token[0].isdigit():
            parts.append(token.lstrip("".join(LOOKS)))
        if _CUTS.search(token):
            parts += _CUTS.split(token)
        for part in dict.fromkeys(parts):
            if len(part) > 2 and _ODD.search(part) and self._maybe(skeleton(part)) and (found := self.hits(self.decode(part))):
                return found
        return []

    def _maybe(self, s: str) -> bool:
        for n in self.short:
            if s[:n] in self.skeletons:
                return True
        return s[:HEAD] in self.heads and any(s[:n] in self.skeletons for n in self.lengths)

    def run_hits(self, run: str) -> list[str]:
        """Hits of whole words anywhere in letters that were spaced out."""
        letters = re.sub(r"[\s._*-]+", "", run)
        s = skeleton(letters)
        if not any(s[i : i + n] in self.skeletons for n in self.lengths for i in range(len(s) - n + 1)):
            return []
        restored = self.decode(letters)
        whole = [k for k in self.lexicon if k[0] == "=" and len(k) > 4 and k[1:] in restored]
        return whole or self.hits(restored)

    def measure(self, text: str | None, memo: dict[str, list[str]]) -> tuple[float, int]:
        """Weight of the strongest hit and number of different hits. memo: of tokens seen before."""
        text = (text or "").lower()
        found: set[str] = set()
        tokens = set(text.split())
        if len(memo) > 200_000:
            memo.clear()
        for token in tokens.difference(memo):
            memo[token] = self.token_hits(token) or _NONE
        for h in filter(None, map(memo.__getitem__, tokens)):
            found.update(h)
        for m in _SPACED.finditer(text):
            found.update(self.run_hits(m[0]))
        return max((self.lexicon[k] for k in found), default=0.0), len(found)

    def score(self, measured: list[tuple[float, int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(measured) @ self.weights, -30, 30)))


def _design(measured: list[tuple[float, int]]) -> np.ndarray:
    m = np.array(measured, dtype=float).reshape(-1, 2)
    return np.column_stack((np.ones(len(m)), m[:, 0], np.log1p(m[:, 1]), m[:, 1] > 0))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def char_model(counts: np.ndarray, words: list[str]) -> np.ndarray:
    """log p of a letter after two: the corpus' trigrams (backed off to bigrams and letters), half and half with those of the lexicon's words."""

    def smooth(n, alpha):
        n = n.reshape(SIZE, SIZE, SIZE)
        one = (n.sum((0, 1)) + 1) / (n.sum() + SIZE)
        two = (n.sum(0) + alpha * one) / (n.sum((0, 2))[:, None] + alpha)
        return (n + alpha * two) / (n.sum(2, keepdims=True) + alpha)

    own = sum(map(trigram_counts, words), np.zeros(SIZE**3)).astype(float)
    return np.log(0.5 * smooth(counts.astype(float), 5.0) + 0.5 * smooth(own, 0.5))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon and logistic function from the labelled rows not held out, the character model from all rows."""
    counts = char_counts(documents)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y")  # ``sample`` short rows are broadcast
    rows = materialise(rows, "labelled")  # read three times, ``sample`` texts

    def count(batches):
        n: tuple[Counter, Counter] = (Counter(), Counter())

        def counted():
            keys = list(n[0].keys() | n[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[1][k] for k in keys], pa.int64()), pa.array([n[0][k] for k in keys], pa.int64())], names=["k", "t", "c"])

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[y].update({k for w in set(_WORDS.findall((text or "").lower())) if 2 < len(w) < 32 for k in entries(w)})
            if len(n[0]) + len(n[1]) > 1 << 17:
                yield counted()
                n = (Counter(), Counter())
        yield counted()

    table = rows.mapInArrow(count, "k string, t long, c long").groupBy("k").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t >= 3")
    base = rows.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in base}
    T, C = n.get(1, 0), n.get(0, 0)
    share = (T + 1) / (T + C + 2)
    if not T or not C:
        return Model({}, char_model(counts, []), np.array([math.log(share / (1 - share)), 0.0, 0.0, 0.0]))
    t, c, p = F.col("t").cast("double"), F.col("c").cast("double"), F.lit(T / (T + C))
    odds = F.log((t + 0.5) / (T + 1.0)) - F.log((c + 0.5) / (C + 1.0))
    evidence = 2 * (t * F.log(t / ((t + c) * p)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - p)))).otherwise(0.0))
    strong = table.select("k", odds.alias("w"), evidence.alias("e")).where((F.col("w") > ODDS) & (F.col("e") > EVIDENCE))
    lexicon = {r["k"]: r["w"] for r in strong.collect()}  # entries that stand in three of ``sample`` texts at least
    model = Model(lexicon, char_model(counts, sorted({k.lstrip("=") for k in lexicon})), np.zeros(4))
    broadcast = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<strongest: double, hits: long>")
    def measured(text: pa.Array) -> pa.Array:
        memo: dict[str, list[str]] = {}
        m = [broadcast.value.measure(x, memo) for x in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in m], pa.float64()), pa.array([x[1] for x in m], pa.int64())], names=["strongest", "hits"])

    seen = rows.select(measured("text").alias("m"), "y").groupBy("m", "y").count().collect()  # few different pairs
    x, y, w = _design([(r["m"]["strongest"], r["m"]["hits"]) for r in seen]), np.array([r["y"] for r in seen]), np.array([r["count"] for r in seen])
    model.weights = _logistic(np.repeat(x, w, axis=0), np.repeat(y, w))
    return model


def with_toxicity(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All rows and columns and the score, from the text alone. An older column of that name is replaced."""
    broadcast = documents.sparkSession.sparkContext.broadcast(model)  # the lexicon and 28 ** 3 numbers

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo: dict[str, list[str]] = {}
        for text in batches:
            yield pa.array(broadcast.value.score([broadcast.value.measure(t, memo) for t in text.to_pylist()]))

    return documents.withColumn(column, score("text"))
