"""Phrase collocations by partitioned mining: shards propose, all documents are counted.

A phrase that occurs s times or more occurs ceil(s / SHARDS) times or more in one of SHARDS shards,
however uneven these are (else it would occur s - 1 times at most). So every shard is mined completely
at that lower support, phrases frequent in any shard are united, and all of these are counted exactly
over all documents.

There are SHARDS shards, however large the corpus is (with more than s of them the lower support
would be one, and shards would propose everything). A shard is a hash of texts, mined by many tasks:
they tokenise portions of documents, count a portion's phrases in NumPy and send digests, of which
lang, shard and size are part, with their counts. Levels follow each other: a phrase of k words is
looked at only if both its parts of k - 1 words were proposed. Proposals reach the tasks as a bitmap
of at most BITS bits, which is all that comes to the driver; a bit set by another phrase, or two
phrases of one digest, only propose more. The last pass counts the proposed phrases as strings, so
counts and results are exact whatever the bitmap let through.

Null texts are empty, a null lang is `und`. Repeated rows count as often as they occur. Documents of
any length are tokenised whole. No word at all gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import materialise

SHARDS = 4
#: Words that a task counts together; bits of a bitmap.
PORTION, BITS = 1 << 21, 1 << 27
#: Bytes of a text as a tokeniser sees them: A-Z in lower case, a tab as a blank, what ends a piece as a line feed.
SEEN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
WIDE = "decimal(38,0)"


def tokens(texts: list[bytes | None]) -> pa.Array:
    """The words of all texts, in order; a line feed stands where a piece ends."""
    joined = b"\n".join([*(t or b"" for t in texts), b""])
    return pa.array(joined.translate(SEEN).replace(b"\n", b" \n ").split(b" "), pa.binary())


class Portion:
    """The words of some documents of one lang and shard, numbered: codes (-1: a piece ends), words and their digests."""

    def __init__(self, lang: str, parts: list[pa.DictionaryArray]):
        one = pa.chunked_array(parts).unify_dictionaries().combine_chunks()
        one = one.combine_chunks() if isinstance(one, pa.ChunkedArray) else one
        names, codes = one.dictionary, one.indices.to_numpy(zero_copy_only=False)
        codes = codes[codes != pc.index(names, b"").as_py()]
        new = np.ones(len(codes), dtype=bool)
        ends = codes == pc.index(names, b"\n").as_py()
        new[1:] = ~(ends[1:] & ends[:-1])
        self.codes, self.names = np.where(ends, -1, codes)[new], names
        self.digests = pd.util.hash_array(np.array(names.to_pylist(), dtype=object), categorize=False)
        self.lang = pd.util.hash_array(np.array([lang], dtype=object), categorize=False)[0]

    def starts(self, size: int) -> np.ndarray:
        """Where phrases of ``size`` words begin."""
        n = len(self.codes) - size + 1
        fits = np.ones(max(n, 0), dtype=bool)
        for i in range(size if n > 0 else 0):
            fits &= self.codes[i : i + n] >= 0
        return np.flatnonzero(fits)

    def phrase_digests(self, at: np.ndarray, size: int) -> np.ndarray:
        h = np.full(len(at), self.lang + np.uint64(size), dtype=np.uint64)
        for i in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.digests[self.codes[at + i]]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def proposed(self, size: int, known: dict[int, np.ndarray]) -> np.ndarray:
        """Where phrases of this size begin whose shorter parts, and they themselves, are set in the bitmaps that there are."""
        at = self.starts(size)
        for k, offsets in ((size - 1, (0, 1)), (size, (0,))):
            for i in offsets if k in known else ():
                h = self.phrase_digests(at + i, k)
                words = known[k][(h >> np.uint64(22)).astype(np.int64) & (len(known[k]) - 1)]
                at = at[(words >> ((h >> np.uint64(16)) & np.uint64(63))) & np.uint64(1) == 1]
        return at

    def counted(self, at: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray]:
        """The different phrases at these places, as strings, and how often each occurs."""
        most, key, levels = max(len(self.names), 1), self.codes[at].astype(np.int64), []
        for i in range(1, size):  # phrases are numbered anew for each word, so that numbers stay below places * words
            seen, key = np.unique(key, return_inverse=True)
            levels.append(seen)
            key = key.astype(np.int64) * most + self.codes[at + i]
        key, n = np.unique(key, return_counts=True)
        words = []
        for seen in reversed(levels):
            words.append(key % most)
            key = seen[key // most]
        columns = [self.names.take(pa.array(w)) for w in (key, *reversed(words))]
        return (pc.binary_join_element_wise(*columns, b" ") if size > 1 else columns[0]).cast(pa.string()), n


def portions(batches: Iterator[pa.RecordBatch], portion: int) -> Iterator[tuple[str, int, Portion]]:
    """(lang, shard, portion) of rows (lang, shard, text)."""
    held: dict[tuple[str, int], list[pa.Array]] = {}
    size = 0
    for batch in batches:
        group = pa.table({"lang": batch.column(0), "shard": batch.column(1), "at": pa.array(np.arange(batch.num_rows))}).group_by(["lang", "shard"]).aggregate([("at", "list")])
        texts = batch.column(2).cast(pa.binary())
        for lang, shard, at in zip(*(group.column(c).to_pylist() for c in ("lang", "shard", "at_list")), strict=True):
            part = tokens(texts.take(pa.array(at)).to_pylist())
            held.setdefault((lang, shard), []).append(part.dictionary_encode())
            size += len(part)
        if size >= portion:
            for (lang, shard), parts in held.items():
                yield lang, shard, Portion(lang, parts)
            held, size = {}, 0
    for (lang, shard), parts in held.items():
        yield lang, shard, Portion(lang, parts)


def _texts(documents: DataFrame, shards: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.pmod(F.xxhash64(text), F.lit(shards)).cast("int").alias("shard"), text.alias("text"))


def mined(documents: DataFrame, sizes: tuple[int, ...], known: dict[int, np.ndarray], support: int, shards: int = SHARDS, portion: int = PORTION) -> DataFrame:
    """(size, h) of the phrases of these sizes that are frequent in some shard."""
    sent = documents.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shard, p in portions(batches, portion):
            for k in sizes:
                h, c = np.unique(p.phrase_digests(p.proposed(k, sent.value), k), return_counts=True)
                # The last bits of a digest give way to the shard's and the size's numbers.
                key = (h & ~np.uint64(0xFFFF)) | np.uint64(shard << 8 | k)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c.astype(np.int64))], names=["key", "c"])

    rows = _texts(documents, shards).select("lang", "shard", "text").mapInArrow(run, "key long, c long")
    frequent = rows.groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= -(-support // shards))
    return frequent.select(F.expr("CAST(key & 255 AS INT)").alias("size"), F.expr("key & ~65535L").alias("h")).distinct()


def bitmap(proposals: DataFrame, bits: int = BITS) -> np.ndarray:
    """Proposed digests (h) as a bitmap of at most ``bits`` bits, in longs; 32 bits or more for each digest unless that is too many."""
    many = proposals.count()
    longs = max(1, min(bits, 1 << (32 * many).bit_length()) // 64)
    rows = proposals.select(F.expr(f"shiftrightunsigned(h, 22) & {longs - 1}L").alias("i"), F.expr("shiftleft(1L, CAST(shiftrightunsigned(h, 16) & 63 AS INT))").alias("b"))
    found = rows.groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(longs, dtype=np.uint64)
    out[found.column("i").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return out


def phrase_counts(documents: DataFrame, support: int, longest: int, shards: int = SHARDS, portion: int = PORTION, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of 1 to ``longest`` words that occur ``support`` times or more, exactly; (lang, n), all words."""
    known: dict[int, np.ndarray] = {}
    for sizes in ((1, 2), *((k,) for k in range(3, longest + 1))):
        found = materialise(mined(documents, sizes, known, support, shards, portion), "proposals")
        known = known | {k: bitmap(found.where(F.col("size") == k).select("h"), bits) for k in sizes}
    sent = documents.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, p in portions(batches, portion):
            for k in (0, *sent.value):
                phrases, c = (pa.array([""]), np.array([(p.codes >= 0).sum()])) if k == 0 else p.counted(p.proposed(k, sent.value), k)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(c)), phrases, pa.repeat(pa.scalar(k, pa.int32()), len(c)), pa.array(c.astype(np.int64))], names=["lang", "phrase", "size", "c"])

    rows = _texts(documents, 1).select("lang", "shard", "text").mapInArrow(run, "lang string, phrase string, size int, c long")
    counts = rows.groupBy("lang", "phrase", "size").agg(F.sum("c").alias("f")).where((F.col("f") >= support) | (F.col("size") == 0))  # size 0: all words
    counts = materialise(counts, "phrases")
    return counts.where("size > 0"), counts.where("size = 0").select("lang", F.col("f").alias("n"))


def _part(phrase: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " ", -1), first, count), " ")


def collocations(documents: DataFrame, support: int = 10, longest: int = 3, top: int = 2_000, inside: int = 50, **sizes: int) -> DataFrame:
    """Each lang's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to ``longest`` words with a >= support occurrences scores
    floor(1000000 * a * a / (l * r)) at its lowest-scoring cut (of equal ones the first), l and r
    being the occurrences of the two parts. It is left out if a longer phrase that contains it has
    ``inside`` percent or more of its occurrences. Products are decimals of 38 digits. Order: score
    and a descending, then phrase in byte order.
    """
    counts, totals = phrase_counts(documents, support, longest, **sizes)
    many = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = many.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("left", _part(F.col("phrase"), F.lit(1), F.col("k"))).withColumn("right", _part(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k")))
    of = lambda part, f: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    wide = lambda c: f"CAST({c} AS {WIDE})"
    score = F.expr(f"CAST((CAST(1000000 * CAST({wide('a')} * {wide('a')} AS {WIDE}) AS {WIDE})) div CAST({wide('l')} * {wide('r')} AS {WIDE}) AS LONG)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    parts = F.transform(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1), lambda i: _part(F.col("phrase"), i, F.col("m")))
    inner = many.where("size > 2").select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", F.col("a").alias("longer"), F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    best = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer").cast(WIDE) * 100 < F.col("a").cast(WIDE) * inside))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")).cast("long")
    first = best.withColumn("rank", rank).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
