"""Completing prefixes of crossing orders: a search level by level, on all prefixes at once.

What a partial order allows from here on depends only on its remainder: the bridges not used yet,
the point where the curve stands, and which of these points, and of the end, lie in one region
above and in one region below. So partial orders of one prefix and one remainder are merged and
carry a count; a level is grown by every unused bridge that the curve reaches without crossing an
arc, and pruned by parity: every region under an arc must hold an even number of ends yet to come.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.chords import bound
from lamina.operators.layers import merge
from lamina.session import materialise

#: n bridges, ``at`` bridges used; free: unused bridges and the end n, ascending, without the head; above, below: for each of these the region that it lies in (0: under no arc); head_*: the head's, on the side of its next arc.
REMAINDER = ("n", "at", "head", "free", "above", "below", "head_above", "head_below")


def _cut(regions: Column, free: Column, mine: Column, low: Column, high: Column) -> Column:
    """Regions after an arc from low to high: of the region ``mine`` what lies between becomes one of its own, under a name that no region has."""
    return F.zip_with(free, regions, lambda x, r: F.when((r == mine) & (x > low) & (x < high), F.size(free) + 2).otherwise(r))


def _named(regions: Column, head: Column) -> tuple[Column, Column]:
    """Regions named by the first point in them (1, ...), so that equal remainders look equal; 0 stays. The head comes first."""
    every = F.concat(F.array(head), regions)
    name = lambda r: F.when(r == 0, 0).otherwise(F.array_position(every, r).cast("int"))
    return F.transform(regions, name), name(head)


def _even(free: Column, regions: Column, head: Column, head_here: Column, end_here: Column, n: Column) -> Column:
    """Whether every region under an arc can be left in pairs: an unused bridge has one end here, the head and the end n only if their arcs lie on this side."""
    own = F.zip_with(free, regions, lambda x, r: F.when((x < n) | end_here, r))
    ends = F.concat(own, F.array(F.when(head_here, head)))
    under = F.filter(F.array_distinct(ends), lambda r: r > 0)
    return F.forall(under, lambda r: F.size(F.filter(ends, lambda e: e == r)) % 2 == 0)


def _step(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Each remainder with a bridge more: those that the head's region holds on the side of the next arc, if parity leaves a way to finish."""
    up = F.col("at") % 2 == 1  # the side of the arc that leaves the head
    side = F.when(up, F.col("above")).otherwise(F.col("below"))
    mine = F.when(up, F.col("head_above")).otherwise(F.col("head_below"))
    open_ = F.filter(F.arrays_zip(F.col("free").alias("x"), side.alias("r")), lambda p: (p["x"] < F.col("n")) & (p["r"] == F.col("mine")))
    grown = rows.withColumn("mine", mine).select(*keys, *REMAINDER, "count", "mine", F.explode(F.transform(open_, lambda p: p["x"])).alias("to"))
    low, high = F.least("head", "to"), F.greatest("head", "to")
    place = F.array_position("free", F.col("to")).cast("int")
    cut = lambda side, when: F.when(when, _cut(F.col(side), F.col("free"), F.col("mine"), low, high)).otherwise(F.col(side))
    without = lambda xs: F.concat(F.slice(xs, F.lit(1), place - 1), F.slice(xs, place + 1, F.size(xs)))
    grown = grown.withColumn("new_above", cut("above", up)).withColumn("new_below", cut("below", ~up))
    grown = grown.select(*keys, "n", (F.col("at") + 1).alias("at"), F.col("to").alias("head"), without(F.col("free")).alias("free"), without(F.col("new_above")).alias("above"), without(F.col("new_below")).alias("below"),
                         F.when(~up, F.get("new_above", place - 1)).otherwise(0).alias("head_above"), F.when(up, F.get("new_below", place - 1)).otherwise(0).alias("head_below"), "count")
    return grown.where(_viable())


def _viable() -> Column:
    at, n = F.col("at"), F.col("n")
    sides = ((True, "above", "head_above"), (False, "below", "head_below"))
    even = [_even(F.col("free"), F.col(s), F.col(h), (at % 2 == 1) == F.lit(up), (n % 2 == 1) == F.lit(up), n) for up, s, h in sides]
    return even[0] & even[1]


def start(rows: DataFrame, *keys: str) -> DataFrame:
    """Remainders before the first bridge, of rows (keys..., n, count): the curve comes from the point n + 1, with its first arc below."""
    free = F.sequence(F.lit(0), F.col("n"))
    none = F.transform(free, lambda x: F.lit(0))
    return rows.select(*keys, "n", F.lit(0).alias("at"), (F.col("n") + 1).alias("head"), free.alias("free"), none.alias("above"), none.alias("below"), F.lit(0).alias("head_above"), F.lit(0).alias("head_below"), "count")


def _renamed(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    above, below = (F.struct(*(c.alias(a) for c, a in zip(_named(F.col(s), F.col(h)), ("r", "h"), strict=True))) for s, h in (("above", "head_above"), ("below", "head_below")))
    named = rows.withColumn("a", bound(above, lambda x: x)).withColumn("b", bound(below, lambda x: x))
    return named.select(*keys, "n", "at", "head", "free", F.col("a.r").alias("above"), F.col("b.r").alias("below"), F.col("a.h").alias("head_above"), F.col("b.h").alias("head_below"), "count")


def grow(rows: DataFrame, *keys: str, path: str | None = None) -> DataFrame:
    """The next level, equal remainders of equal keys merged. Bridges that ``path``, an array among the keys, names are taken as it says."""
    grown = _step(rows, keys)
    if path:
        grown = grown.where((F.size(path) < F.col("at")) | (F.get(F.col(path), F.col("at") - 1) == F.col("head")))
    return merge(_renamed(grown, keys), *keys, *REMAINDER)


def finished(rows: DataFrame) -> DataFrame:
    """Rows all of whose bridges are used and whose head lies in one region with the end n, on the side of the last arc."""
    side = lambda r, h: F.get(F.col(r), F.lit(0)) == F.col(h)
    return rows.where((F.col("at") == F.col("n")) & F.when(F.col("n") % 2 == 1, side("above", "head_above")).otherwise(side("below", "head_below")))


def search(rows: DataFrame, levels: int, *keys: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, done): (keys..., n, at, nodes), the partial orders visited at each level; (keys..., n, completions). Levels are written once each."""
    nodes, done = [], []
    layer = rows
    for level in range(levels + 1):
        layer = materialise(layer if level == 0 else grow(layer, *keys, path=path), "search")
        nodes.append(layer.groupBy(*keys, "n", "at").agg(F.sum("count").cast("decimal(38,0)").alias("nodes")))
        done.append(finished(layer).select(*keys, "n", "count"))
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, done).groupBy(*keys, "n").agg(F.sum("count").cast("decimal(38,0)").alias("completions"))
