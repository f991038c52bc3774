"""Layers whose counts are residues: exact totals of any size, put together once at the end.

A count is kept modulo several moduli, one column each, so that weighting and merging stay within
machine-sized numbers however many layers there are. A total below the product of the moduli (three
of them reach 10 ** 55) is then known by its residues: mixed radix digits first, and from these
its decimal digits in limbs of LIMB. A total that may be larger needs more moduli, which the caller
sees from bound().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.numeric import WIDE, big, mod_sum

#: Odd neighbours two apart share no factor but for one of their small distances, so three in a row share none.
MODULI = tuple((1 << 61) - 1 - 2 * i for i in range(3))
LIMB = 10**18
NAMES = tuple(f"r{i}" for i in range(len(MODULI)))


def bound() -> int:
    """Totals below this are exact."""
    return math.prod(MODULI)


def start(rows: DataFrame, count: Column, *keys: str) -> DataFrame:
    """(keys..., r0, r1, ...): counts (integers of 38 digits at most) as residues."""
    return rows.select(*keys, *[F.pmod(count.cast(WIDE), big(m)).cast("long").alias(r) for r, m in zip(NAMES, MODULI, strict=True)])


def weigh(layer: DataFrame, weight: Column) -> DataFrame:
    """Every count times a whole number of its row; columns that are no residues stay."""
    product = lambda r, m: F.pmod((F.col(r).cast(WIDE) * F.pmod(weight.cast(WIDE), big(m)).cast(WIDE)).cast(WIDE), big(m)).cast("long")
    return layer.select(*[c for c in layer.columns if c not in NAMES], *[product(r, m).alias(r) for r, m in zip(NAMES, MODULI, strict=True)])


def merge(layer: DataFrame, *keys: str) -> DataFrame:
    """Adds up the counts of equal states."""
    return layer.groupBy(*keys).agg(*[mod_sum(F.col(r), m).cast("long").alias(r) for r, m in zip(NAMES, MODULI, strict=True)])


def totals(layer: DataFrame, name: str = "total") -> DataFrame:
    """The counts as decimal text, in place of the residues."""
    digits: list[str] = []
    for i, m in enumerate(MODULI):
        rest = F.col(NAMES[i]).cast(WIDE)
        for d, before in zip(digits, MODULI, strict=False):  # take off the digit, divide by its modulus
            rest = F.pmod((F.pmod((rest - F.col(d)).cast(WIDE), big(m)).cast(WIDE) * big(pow(before, -1, m))).cast(WIDE), big(m)).cast(WIDE)
        digits.append(f"_digit{i}")
        layer = layer.withColumn(digits[-1], rest)
    places = [math.prod(MODULI[:i]) for i in range(len(MODULI))]
    limbs, carry = [], F.lit(0).cast(WIDE)
    for k in range(-(-len(str(bound())) // 18)):
        whole = carry
        for d, place in zip(digits, places, strict=True):
            whole = (whole + (F.col(d) * big(place // LIMB**k % LIMB)).cast(WIDE)).cast(WIDE)
        layer = layer.withColumn(f"_limb{k}", whole)
        limbs.append(F.lpad(F.pmod(F.col(f"_limb{k}"), big(LIMB)).cast("decimal(18,0)").cast("string"), 18, "0"))
        carry = F.expr(f"_limb{k} div CAST({LIMB} AS {WIDE})").cast(WIDE)
    text = F.regexp_replace(F.concat(*reversed(limbs)), "^0+(?=.)", "")
    return layer.withColumn(name, text).drop(*NAMES, *digits, *[f"_limb{k}" for k in range(len(limbs))])
