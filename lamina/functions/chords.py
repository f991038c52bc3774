"""Chords over a line: predicates on crossing orders, as column expressions.

A crossing order of n bridges is an array perm of 0..n-1. Its path is [n + 1, perm..., n]; arc k
joins the path's k-th and (k+1)-th points, below the line for even k and above for odd k. The closed
loop of an order of even length joins its last point to its first. An order is simple if no two arcs
of one side cross.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def interleave(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether exactly one of c and d lies strictly between a and b."""
    low, high = F.least(a, b), F.greatest(a, b)
    return ((c > low) & (c < high)) != ((d > low) & (d < high))


def path(perm: Column) -> Column:
    n = F.size(perm)
    return F.concat(F.array(n + 1), perm.cast("array<int>"), F.array(n))


def loop(perm: Column) -> Column:
    p = perm.cast("array<int>")
    return F.concat(p, F.slice(p, 1, 1))


def _upto(last: Column) -> Column:
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def arcs(points: Column) -> Column:
    """Array of (k, a, b): the k-th arc joins a and b."""
    return bound(points, lambda p: F.transform(_upto(F.size(p) - 2), lambda k: F.struct(k.alias("k"), F.get(p, k).alias("a"), F.get(p, k + 1).alias("b"))))


def _crossed(arc: Column, of: Column) -> Column:
    """How many earlier arcs of its side an arc crosses."""
    return F.size(F.filter(of, lambda y: (y["k"] < arc["k"]) & (y["k"] % 2 == arc["k"] % 2) & interleave(arc["a"], arc["b"], y["a"], y["b"])))


def crossings(points: Column) -> Column:
    """Number of pairs of arcs of one side that interleave."""
    total = lambda of: F.aggregate(F.transform(of, lambda x: _crossed(x, of)), F.lit(0), lambda s, n: s + n)
    return F.coalesce(bound(arcs(points), total), F.lit(0))


def is_simple(perm: Column) -> Column:
    return crossings(path(perm)) == 0


def is_closed_simple(perm: Column) -> Column:
    return (F.size(perm) > 0) & (F.get(perm, F.lit(0)) == 0) & (F.size(perm) % 2 == 0) & (crossings(loop(perm)) == 0)


def inside(arc: Column, x: Column) -> Column:
    return (x > F.least(arc["a"], arc["b"])) & (x < F.greatest(arc["a"], arc["b"]))


def step_ok(of: Column, t: Column) -> Column:
    """Whether arc t of an array of arcs crosses no earlier arc of its side."""
    return _crossed(F.get(of, t), of) == 0


def parity_ok(points: Column, of: Column, t: Column, n: Column) -> Column:
    """Whether the order can still be finished after arcs 0..t: under every arc the bridges not yet used, and
    the two ends of the curve's rest that lie on the arc's side, must pair off."""
    rest = F.concat(F.slice(points, t + 3, n), F.array().cast("array<int>"))  # the path's points after the head; the last is the end n
    head = F.get(points, t + 1)
    ends = lambda y: F.when(((t + 1) % 2 == y["k"] % 2) & inside(y, head), 1).otherwise(0) + F.when((n % 2 == y["k"] % 2) & inside(y, n), 1).otherwise(0)
    unused = lambda y: F.size(F.filter(rest, lambda x: (x < n) & inside(y, x)))
    return F.size(F.filter(of, lambda y: (y["k"] <= t) & ((unused(y) + ends(y)) % 2 == 1))) == 0


def search_depth(perm: Column) -> Column:
    """(clear, open): bridges before the first arc that crosses an earlier one, and before the first after which nothing can finish the order."""
    n = F.size(perm)
    steps = _upto(n - 1)

    def of(v: Column) -> Column:
        first = lambda bad: F.coalesce(F.array_min(F.filter(steps, bad)), n)
        clear = first(lambda t: ~step_ok(v["arcs"], t))
        return F.struct(clear.alias("clear"), first(lambda t: (t < n - 1) & ~parity_ok(v["points"], v["arcs"], t, n)).alias("open"))

    return bound(F.struct(path(perm).alias("points"), arcs(path(perm)).alias("arcs")), of)


def close_up(perm: Column) -> Column:
    """The closed order of an open one: 0, then n - t for each bridge t."""
    p = perm.cast("array<int>")
    return F.concat(F.array(F.lit(0)), F.transform(p, lambda t: F.size(perm) - t))


def actions(perm: Column) -> Column:
    """For each bridge, from west to east, whether its arc above and its arc below open there (their other ends lie east)."""

    def all_of(points: Column) -> Column:
        def of(x: Column) -> Column:
            p = (F.array_position(F.slice(points, F.lit(2), F.size(points) - 2), x)).cast("int")  # 1-based: its place in the path
            before, after = F.get(points, p - 1), F.get(points, p + 1)
            above, below = F.when(p % 2 == 1, after).otherwise(before), F.when(p % 2 == 1, before).otherwise(after)
            return F.struct((above > x).alias("up"), (below > x).alias("dn"))

        return F.transform(_upto(F.size(points) - 3), of)

    return bound(path(perm), all_of)


def _other_ends(opens: Column, free: Column) -> Column:
    """For each bridge the other end of its arc on one side, whose arcs open or close as ``opens`` says; those still open at the end lead to ``free``, the outermost to the first."""

    def at(done: Column, x: Column) -> Column:
        last = F.element_at(done["stack"], -1)
        pushed = F.struct(F.array_append(done["stack"], x).alias("stack"), done["pairs"].alias("pairs"))
        popped = F.struct(F.slice(done["stack"], F.lit(1), F.size(done["stack"]) - 1).alias("stack"), F.concat(done["pairs"], F.array(F.struct(last.alias("a"), x.alias("b")), F.struct(x.alias("a"), last.alias("b")))).alias("pairs"))
        return F.when(F.get(opens, x), pushed).when(F.size(done["stack"]) > 0, popped)

    empty = F.struct(F.array().cast("array<int>").alias("stack"), F.array().cast("array<struct<a: int, b: int>>").alias("pairs"))
    left = lambda r: F.concat(r["pairs"], F.transform(r["stack"], lambda x, i: F.struct(x.alias("a"), F.get(free, i).alias("b"))))
    return bound(F.aggregate(_upto(F.size(opens) - 1), empty, at), lambda r: F.array_sort(left(r))["b"])


def decode(acts: Column) -> Column:
    """The order whose actions these are: arcs are drawn on both sides and the curve is followed from its start. The inverse of actions() on simple orders."""
    n = F.size(acts)
    start, end = n + 1, n
    above = _other_ends(acts["up"], F.array(end))
    below = _other_ends(acts["dn"], F.array(start, end))

    def follow(v: Column) -> Column:
        first = (F.array_position(v["below"], start) - 1).cast("int")
        go = lambda done, k: F.array_append(done, F.get(F.when(k % 2 == 1, v["above"]).otherwise(v["below"]), F.element_at(done, -1)))
        return F.aggregate(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), F.array(first), go)

    return F.when(n == 0, F.array().cast("array<int>")).otherwise(bound(F.struct(above.alias("above"), below.alias("below")), follow))


def side_word(perm: Column, above: bool) -> Column:
    """The opening and closing word of one side: U where a bridge's arc opens, D where it closes; the arcs of the curve's two ends stay open."""
    return F.array_join(F.transform(actions(perm), lambda a: F.when(a["up" if above else "dn"], "U").otherwise("D")), "")
