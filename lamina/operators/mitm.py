"""Meet in the middle: counts as a join-aggregate of forward and backward layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import packed
from lamina.operators.layers import COUNT, merge, seeds
from lamina.session import materialise
from lamina.sources.values import verdict


def backward_layers(spark: SparkSession, most: int, bound: Column) -> DataFrame:
    """(p, r, h, e, bits, count): the states from which r bridges and the east end finish an order of parity p, in how many ways, for r up to ``most``.

    ``bound``, of columns p and r, is the largest depth of a state that a forward layer can have.
    Each layer is written once, for both parities.
    """
    keys = ("p", "h", "e", "bits")
    layer = seeds(spark)
    out = layer.withColumn("r", F.lit(0))
    for r in range(1, most + 1):
        grown = packed.stepped(layer, "p", backwards=True).withColumn("r", F.lit(r)).where(F.col("depth") <= bound)
        layer = materialise(merge(grown, *keys), f"backward-{r}")
        out = out.unionByName(layer.withColumn("r", F.lit(r)))
    return out


def dot(forward: DataFrame, backward: DataFrame, *by: str, on: tuple[str, ...] = ("word", "h")) -> DataFrame:
    """Sum over equal states of the product of counts."""
    f = forward.withColumnRenamed("count", "f")
    g = backward.withColumnRenamed("count", "g")
    both = f.join(g, [*by, *on])
    return both.groupBy(*by).agg(F.coalesce(F.sum(F.col("f") * F.col("g")), F.lit(0)).cast(COUNT).alias("count"))


def two_splits(first: DataFrame, second: DataFrame, backward: DataFrame, *by: str) -> DataFrame:
    """(by..., count, check, verdict): the same number from two splits, a forward layer and the one a bridge later.

    ``first`` and ``second`` have (by..., p, r, h, e, bits, count), r bridges still to come; ``backward`` is as backward_layers() gives
    it. Both layers meet it in one join, so each backward layer is read once. A split that meets nothing counts 0.
    """
    keys = ("p", "r", "h", "e", "bits")
    tagged = [rows.select(*by, *keys, F.col("count").cast(COUNT).alias("f"), F.lit(split).alias("split")) for split, rows in enumerate((first, second))]
    both = tagged[0].unionByName(tagged[1]).join(backward.select(*keys, F.col("count").cast(COUNT).alias("g")), [*keys], "left")
    product = (F.col("f") * F.coalesce("g", F.lit(0).cast(COUNT))).cast(COUNT)
    sums = [F.coalesce(F.sum(F.when(F.col("split") == i, product)), F.lit(0)).cast(COUNT) for i in (0, 1)]
    found = both.groupBy(*by).agg(sums[0].alias("count"), sums[1].alias("check"))
    return found.withColumn("verdict", verdict(F.col("count"), F.col("check")))
