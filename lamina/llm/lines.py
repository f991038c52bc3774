"""Line deduplication: lines that several documents share stay in one of them.

Texts are split at line feeds. A line's key is the line without blanks at both ends, A-Z in lower
case. Keys are hashed to 128 bits (two digests with different seeds, so that among 10 ** 12 lines
the chance of any two keys meeting is below 10 ** -14), each document's different keys are exploded
as digests, and the documents of each digest are counted: tasks pre-aggregate, so a line that a
third of all documents has is a row a task. Lines over the threshold go back, as digests, to the
documents that lose them, by a join whose hot keys adaptive execution splits; then every text is
filtered once, in order of its lines. Texts move once, for that.

Null and empty texts are one empty line. Rows with the same doc_id are one document when documents
are counted, and all of them lose the same lines. A null doc_id is one document more, larger than
any other. Repeated lines of one document all stay, or all go. Columns of any name may go along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import BLANKS, ascii_lower, materialise, small, whole_row

#: Shortest key, in code points, that is looked at; documents that must share it.
LEAST, DOCUMENTS = 10, 2
#: Begins the second digest.
SEED = 1


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def digest(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(SEED), key).alias("h2"))


def digests(text: Column, least: int = LEAST) -> Column:
    """For each line the digest of its key, null where the key is too short to count."""
    return F.transform(F.transform(split_lines(text), line_key), lambda key: F.when(F.char_length(key) >= least, digest(key)))


def shared_lines(keyed: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(h1, h2, keeper): digests that at least so many documents have, and the smallest of these. ``keyed``: (doc_id, h1, h2).

    Whether there are two is seen from the smallest and the largest; for more, equal rows are dropped first.
    """
    has_null = F.max(F.col("doc_id").isNull())
    if documents <= 2:
        found = keyed.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), has_null.alias("has_null"))
        several = (F.col("keeper") < F.col("last")) | (F.col("has_null") & F.col("keeper").isNotNull())
        return found.where(several if documents == 2 else F.lit(True)).select("h1", "h2", "keeper")
    found = keyed.distinct().groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n"))
    return found.where(F.col("n") >= documents).select("h1", "h2", "keeper")


def without_shared_lines(documents: DataFrame, least: int = LEAST, threshold: int = DOCUMENTS) -> DataFrame:
    """One row per document: row (all its columns as one value), kept (the text that stays), n_lines, n_dropped."""
    # A row is known by its doc_id and its text's hash: which lines go depends on the doc_id alone, and the hash keeps rows without doc_id apart.
    own = documents.select(F.col("doc_id").alias("own_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_hash"), F.array_compact(F.array_distinct(digests(F.col("text"), least))).alias("keys"))
    keyed = materialise(own.select("own_id", "own_hash", F.inline("keys")), "lines")
    shared = small(materialise(shared_lines(keyed.select(F.col("own_id").alias("doc_id"), "h1", "h2"), threshold), "shared-lines"))
    lost = keyed.join(shared, ["h1", "h2"]).where(~F.col("own_id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy("own_id", "own_hash").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))
    rows = documents.select(whole_row(documents), F.col("doc_id").alias("row_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"), F.col("text").alias("whole"))
    both = rows.join(materialise(lost, "lost-lines"), F.col("row_id").eqNullSafe(F.col("own_id")) & (F.col("row_hash") == F.col("own_hash")), "left")
    lines = split_lines(F.col("whole"))
    marked = F.filter(F.arrays_zip(lines.alias("line"), digests(F.col("whole"), least).alias("digest")), lambda x: x["digest"].isNull() | ~F.array_contains(F.col("lost"), x["digest"]))
    kept = F.when(F.col("lost").isNull(), lines).otherwise(marked["line"])
    out = both.select("row", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("row", F.array_join("kept", "\n").alias("kept"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"))


def dedup_lines(documents: DataFrame, least: int = LEAST, threshold: int = DOCUMENTS) -> DataFrame:
    """The documents with their columns, without the lines that ``threshold`` or more of them share, but for those of the smallest doc_id."""
    found = without_shared_lines(documents, least, threshold)
    name = lambda c: c.replace("`", "``")
    return found.select(*[F.col("kept").alias(c) if c == "text" else F.col(f"row.`{name(c)}`").alias(c) for c in documents.columns])
