"""Benchmark decontamination by size-partitioned MinHash containment (DataFrame functions only).

A test item is found in a document if the document holds ``containment`` or more of the item's
distinct word shingles. Items are short and documents long, so the two are not alike as sets, and
comparing MinHash signatures of both misses items (an item of 33 shingles in a document of 2,000 has
a Jaccard similarity of 0.016). The search is therefore one-sided: items are partitioned by their
number n of shingles, each partition with its own signature length k, the least that cannot miss:
an item keeps its k = n - ceil(containment * n) + t smallest shingle digests (its bottom-k MinHash),
and as a document may lack n - ceil(containment * n) of them at most, at least t are in it. A
document is sketched once, by those of its digests that lie under the largest bound of a partition's
signatures. It is a candidate for an item if t digests of its sketch are in the item's signature; t
is HITS, or what the item has to have in all if that is less. Candidates are then verified by exact
containment: the shingles, as texts, that a candidate document has of any item are gathered by
document and intersected with each of its items'.

Words are what stands between blanks (0x20, 0x09-0x0D), A-Z lower-cased. An item of fewer words
than a shingle is one shingle of its own length, looked up among the documents' shingles of that
length. Items without words match nothing, null texts are empty. Repeated documents and items are
results like any other; several texts of one doc_id are searched each by itself; rows without doc_id
cannot be reported, and keep_clean() keeps them. Documents don't move: signatures, bounded or else
shuffled (see small()), go to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import ascii_lower, materialise, small, whole_row

WORDS, CONTAINMENT, HITS = 5, 0.8, 4


def word_array(text: Column) -> Column:
    """Words of a text; a leading or trailing blank makes no empty word."""
    return F.array_remove(F.split(F.translate(ascii_lower(text), "\t\n\x0b\x0c\r", "     "), " "), "")


def runs(rows: DataFrame, words: str, length: int, *keep: str) -> DataFrame:
    """A row for each place in the array ``words``: columns c0, c1, ... hold it and what follows it, null past the end."""
    zipped = F.arrays_zip(*[(F.col(words) if i == 0 else F.slice(F.col(words), F.lit(i + 1), F.greatest(F.size(words) - i, F.lit(0)))).alias(f"c{i}") for i in range(length)])
    return rows.select(*keep, F.inline(zipped).alias(*[f"c{i}" for i in range(length)]))


def digest(length: int) -> Column:
    """Of a shingle whose words' hashes are c0, c1, ..."""
    return F.xxhash64(*[f"c{i}" for i in range(length)])


def digests(rows: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """(keep..., digest): of the shingles of those lengths in the array w of word hashes, repeats included."""
    every = runs(rows, "w", max(lengths), *keep)
    of = lambda n: F.when(F.col(f"c{n - 1}").isNotNull(), digest(n))
    one = of(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*map(of, lengths)))
    return every.select(*keep, one.alias("digest")).where("digest IS NOT NULL")


def hashes(text: Column) -> Column:
    return F.transform(word_array(text), lambda w: F.xxhash64(w))


def item_shingles(benchmark: DataFrame, words: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, item, length, n, needed, t, k, rank, digest, shingle): rank <= k is the item's signature. item_id and text together make an item."""
    w = benchmark.select("item_id", word_array(F.col("text")).alias("w")).where("size(w) > 0").distinct()
    w = w.select("item_id", F.xxhash64("w").alias("item"), F.least(F.size("w"), F.lit(words)).cast("int").alias("length"), "w")
    run = F.array(*[f"c{i}" for i in range(words)])
    each = runs(w, "w", words, "item_id", "item", "length").withColumn("run", F.slice(run, F.lit(1), F.col("length")))
    each = each.where("NOT exists(run, x -> x IS NULL)").select("item_id", "item", "length", F.concat_ws(" ", "run").alias("shingle"), *[F.xxhash64(f"c{i}").alias(f"c{i}") for i in range(words)])
    of = digest(1)
    for n in range(2, words + 1):
        of = F.when(F.col("length") == n, digest(n)).otherwise(of)
    s = each.select("item_id", "item", "length", F.struct(of.alias("digest"), "shingle").alias("s")).groupBy("item_id", "item", "length").agg(F.array_sort(F.collect_set("s")).alias("s"))
    s = s.withColumn("n", F.size("s")).withColumn("needed", F.ceil(F.col("n") * F.lit(containment).cast("decimal(9,6)")).cast("int"))
    s = s.withColumn("t", F.least("needed", F.lit(HITS))).withColumn("k", F.col("n") - F.col("needed") + F.col("t"))
    s = s.select("item_id", "item", "length", "n", "needed", "t", "k", F.posexplode("s").alias("rank", "s"))
    return s.select("item_id", "item", "length", "n", "needed", "t", "k", (F.col("rank") + 1).alias("rank"), "s.digest", "s.shingle")


def contained(documents: DataFrame, benchmark: DataFrame, words: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, text_hash, item_id, item_shingles, shared), a row for each text and item that it holds."""
    items = materialise(item_shingles(benchmark, words, containment), "items")
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect()) or [words]  # ``words`` of them at most
    keys = ["doc_id", "text_hash", "item_id", "item"]
    texts = documents.select("doc_id", F.xxhash64(ascii_lower(F.col("text"))).alias("text_hash"), "text")

    # Documents' sketches under the largest bound of all partitions, against the signatures.
    signature = materialise(items.where("rank <= k").select("digest", "item_id", "item", "t"), "signatures")
    bound = signature.agg(F.max("digest")).first()[0]
    sketched = digests(texts.select("doc_id", "text_hash", hashes(F.col("text")).alias("w")), lengths, "doc_id", "text_hash").where(F.col("digest") <= F.lit(bound).cast("long"))
    hits = sketched.join(small(materialise(signature.select("digest").distinct(), "digests")), "digest", "left_semi").distinct()
    found = hits.join(small(signature), "digest").groupBy(*keys).agg(F.count("*").alias("hits"), F.first("t").alias("t"))
    found = materialise(found.where("hits >= t").select(*keys), "candidates")

    # What candidate documents have of any item's shingles, as texts; exact containment by document and item.
    suspects = materialise(found.select("doc_id", "text_hash").distinct(), "suspects")
    rows = texts.join(small(suspects), ["doc_id", "text_hash"], "left_semi").select("doc_id", "text_hash", word_array(F.col("text")).alias("w"))
    every = runs(rows, "w", max(lengths), "doc_id", "text_hash")
    run = lambda n: F.when(F.col(f"c{n - 1}").isNotNull(), F.struct(F.xxhash64(*[F.xxhash64(f"c{i}") for i in range(n)]).alias("digest"), *[F.when(F.lit(i < n), F.col(f"c{i}")).alias(f"c{i}") for i in range(max(lengths))]))
    each = every.select("doc_id", "text_hash", F.inline(F.array_compact(F.array(*map(run, lengths)))))
    known = small(materialise(items.select("digest").distinct(), "known"))
    held = each.join(known, "digest", "left_semi").select("doc_id", "text_hash", F.concat_ws(" ", *[f"c{i}" for i in range(max(lengths))]).alias("shingle"))
    held = held.groupBy("doc_id", "text_hash").agg(F.collect_set("shingle").alias("held"))  # a document's shingles at most
    whole = items.groupBy("item_id", "item").agg(F.collect_set("shingle").alias("s"), F.first("n").alias("n"), F.first("needed").alias("needed"))
    whole = materialise(whole, "whole")
    few = items.count() * 64 <= FEW_BYTES
    both = found.join(held, ["doc_id", "text_hash"]).join(F.broadcast(whole) if few else whole, ["item_id", "item"])
    both = both.withColumn("shared", F.size(F.array_intersect("held", "s")).cast("long")).where("shared >= needed")
    return both.select("doc_id", "text_hash", "item_id", F.col("n").cast("long").alias("item_shingles"), "shared")


#: Items' shingles, at 64 bytes each, that may be broadcast.
FEW_BYTES = 1 << 25


def contaminated(documents: DataFrame, benchmark: DataFrame, words: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared): documents that hold ``containment`` or more of an item's shingles."""
    good = contained(documents, benchmark, words, containment)
    return good.groupBy("doc_id", "item_id").agg(F.max_by("item_shingles", "shared").alias("item_shingles"), F.max("shared").alias("shared"))


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, with their columns."""
    gone = contained(documents, benchmark).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    gone = small(materialise(gone, "contaminated"))
    # Each document goes along as one value, so that its columns clash with none of these.
    own = documents.select(whole_row(documents), F.col("doc_id").alias("own_id"), F.xxhash64(ascii_lower(F.col("text"))).alias("own_hash"))
    return own.join(gone, (F.col("own_id") == F.col("gone_id")) & (F.col("own_hash") == F.col("gone_hash")), "left_anti").select("row.*")
