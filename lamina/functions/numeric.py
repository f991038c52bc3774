"""Exact and modular arithmetic, and analytics over series of counts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"
#: The two moduli of a recombined sum.
M64, M61 = 1 << 64, (1 << 61) - 1
#: Published estimate of the growth rate of simple orders (a fixed value).
GROWTH = 12.262874


def big(x: int) -> Column:
    return F.lit(str(x)).cast(WIDE)


def mod_sum(x: Column, modulus: int) -> Column:
    """Sum modulo ``modulus``: each value is reduced first, so that 2 ** 60 of them fit."""
    return F.pmod(F.sum(F.pmod(x.cast(WIDE), big(modulus))).cast(WIDE), big(modulus)).cast(WIDE)


def crt(a: Column, b: Column) -> Column:
    """The number below M64 * M61 that is a mod M64 and b mod M61. The result must be below 10 ** 38.

    2 ** 64 is 8 modulo M61, whose inverse is 2 ** 58.
    """
    lack = F.pmod((b.cast(WIDE) - a.cast(WIDE)).cast(WIDE), big(M61)).cast(WIDE)
    t = F.pmod((lack * big(1 << 58)).cast(WIDE), big(M61)).cast(WIDE)
    return (a.cast(WIDE) + (t * big(M64)).cast(WIDE)).cast(WIDE)


def catalan(n: Column) -> Column:
    """Number of balanced words of n pairs, for n up to 60."""
    return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), big(1), lambda c, k: F.when(k < n, F.floor(c * (2 * (2 * k + 1)).cast(WIDE) / (k + 2).cast(WIDE)).cast(WIDE)).otherwise(c))


def growth(series: DataFrame, n: str = "n", count: str = "count", by: tuple[str, ...] = ()) -> DataFrame:
    """A series with ratio to two rows before, its square root, the exponent of count ~ GROWTH ** n * n ** -exponent, and that extrapolated in 1/n."""
    w = Window.partitionBy(*by).orderBy(n)
    c = F.col(count).cast("double")
    out = series.withColumn("ratio", c / F.lag(c, 2).over(w)).withColumn("rate", F.sqrt("ratio"))
    k = F.col(n).cast("double")
    out = out.withColumn("exponent", -F.log(F.lead(c, 1).over(w) / (GROWTH * c)) / F.log(1 + 1 / k))
    before = F.lag("exponent", 2).over(w)
    return out.withColumn("extrapolated", (k * F.col("exponent") - (k - 2) * before) / 2)
