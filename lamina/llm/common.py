"""Helpers shared by the text operators: normalisation, scratch tables, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.session import materialise
from lamina.session import read_table as read

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Separators of words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as the empty text.

    Texts of ASCII alone take Spark's own lower(), which is several times faster than translate().
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: Rows of a few numbers that may be broadcast: some tens of MB.
FEW = 1 << 20


def small(rows: DataFrame) -> DataFrame:
    """For the side of a join: broadcast if it is a table of FEW rows at most, which is counted; else Spark decides, and shuffles."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def whole_row(documents: DataFrame) -> Column:
    """All columns as one value named row, whatever their names."""
    quoted = (c.replace("`", "``") for c in documents.columns)
    return F.struct(*[F.col(f"`{c}`") for c in quoted]).alias("row")


def components(links: DataFrame, name: str = "links", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph of (a, b) long pairs; rows (node, component).

    Alternates the large-star and small-star contractions: each round hangs a node's larger
    neighbours under its smallest one, so that a chain of length n takes about log n rounds.
    Nothing but a count and a checksum a round comes to the driver. component is the smallest node
    reachable. Hot nodes: the minimum is pre-aggregated before it moves, and the join that brings
    it back stands between two plain exchanges.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(pairs, name)
    seen = None
    for _ in range(rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
        # Large star: a neighbour above u, v > u, goes under the least of u's neighbourhood.
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(large.distinct(), name)
        # Small star: of a node's smaller neighbours the least becomes the parent of the others and of the node.
        parent = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), f"{name}-parent")
        small = edges.join(parent, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialise(small.where("u <> v").distinct(), name)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(own)


__all__ = ["ascii_lower", "components", "materialise", "read", "small", "whole_row"]
