"""Exact deduplication with content-defined chunk recipes (DataFrame functions only).

A text is cut where its own content says so, after a sentence or line end that follows at least
``least`` characters, so that an edit moves only the cuts near it. Chunks get identifiers that are
checked against the chunks' bytes; a document is then the ordered list of its identifiers, its
recipe, and two texts are equal exactly if their recipes are. Long documents move once as chunks,
of which every task sends equal ones only once; all later steps move recipes.

Null texts count as empty; all empty texts form one group. Repeated rows (same doc_id and text)
are members of the group like any other and one of them stays. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import ascii_lower, materialise, small, whole_row

LEAST, MOST = 512, 8192


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """Array of the chunks of a text, which joined give the text again."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 2}}}?[.!?\n]\s|.{{1,{most}}}"), F.lit(0))


def _digest(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.shiftrightunsigned(h, 64 - bits)


def colliding(texts: DataFrame, bits: int = 64) -> DataFrame:
    """(h): digests that more than one chunk has. The chunks themselves are the grouping key, so this compares bytes.

    For n different chunks about n * n / 2**65 such digests are to be expected: none, or a handful.
    """
    rows = texts.select(F.explode(chunks(F.col("t"))).alias("chunk"))
    store = rows.select(_digest(F.col("chunk"), bits).alias("h"), "chunk").groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    return store.groupBy("h").count().where("count > 1").select("h")


def recipes(documents: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, recipe, text_sha256): recipes are equal exactly if the texts are.

    In a text with a chunk whose digest another chunk has, every identifier carries its chunk; such texts, however many, are found and marked by joins.
    """
    texts = documents.select("doc_id", ascii_lower(F.col("text")).alias("t"))
    twice = materialise(colliding(texts, bits), "colliding")
    named = texts.withColumn("text_sha256", F.sha2("t", 256))
    if twice.isEmpty():
        return named.select("doc_id", F.transform(chunks(F.col("t")), lambda c: _digest(c, bits)).alias("recipe"), "text_sha256")
    held = named.select("text_sha256", F.explode(F.array_distinct(F.transform(chunks(F.col("t")), lambda c: _digest(c, bits)))).alias("h"))
    marked = materialise(held.join(small(twice), "h", "left_semi").select("text_sha256").distinct(), "marked")
    named = named.join(small(marked.withColumn("whole", F.lit(True))), "text_sha256", "left")
    identifier = lambda c: F.struct(_digest(c, bits).alias("h"), F.when(F.col("whole"), c).alias("c"))
    return named.select("doc_id", F.transform(chunks(F.col("t")), identifier).alias("recipe"), "text_sha256")


def members(documents: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, text_sha256, times, keep_id, group_size), a row for each different doc_id of each text."""
    own = recipes(documents, bits).groupBy("recipe", "doc_id").agg(F.count("*").alias("times"), F.first("text_sha256").alias("text_sha256"))
    own = materialise(own, "recipes")
    groups = own.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("times").alias("group_size")).where("group_size > 1")
    groups = materialise(groups, "groups")
    alone = F.lit(1).cast("long")
    return own.join(groups, "recipe", "left").select("doc_id", "text_sha256", "times", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", alone).alias("group_size"))


def exact_duplicates(documents: DataFrame, bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; of equal texts the row with the
    largest doc_id stays (one of them, if rows repeat; a null doc_id is smaller than any). A group of
    any size is a count and a maximum that tasks pre-aggregate; the way back to its members is a
    join whose hot keys adaptive execution splits.
    """
    rows = members(documents, bits)
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    one = rows.where("times = 1").select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256")
    again = rows.where("times > 1").select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("i"))
    return one.unionAll(again.select("doc_id", "keep_id", "group_size", (stays & (F.col("i") == 1)).alias("kept"), "text_sha256"))


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents that stay, with their columns as they were; of repeated rows one stays."""
    keys = members(documents).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    keys = materialise(keys.select(F.col("doc_id").alias("key_id"), F.col("text_sha256").alias("key_sha"), "times"), "kept")
    # Each document goes along as one value, so that its columns clash with none of these.
    own = documents.select(whole_row(documents), F.col("doc_id").alias("own_id"), F.sha2(ascii_lower(F.col("text")), 256).alias("own_sha"))
    same = F.col("own_id").eqNullSafe(F.col("key_id")) & (F.col("own_sha") == F.col("key_sha"))
    once = own.join(keys.where("times = 1"), same, "left_semi")
    again = own.join(keys.where("times > 1"), same, "left_semi").dropDuplicates(["own_id", "own_sha"])
    return once.unionAll(again).select("row.*")
