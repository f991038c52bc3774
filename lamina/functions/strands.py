"""The scan with decorations: every open arc also carries the points of its piece, from its own end to the other.

A decorated state is the array of its open arcs' strands, from the outermost above the line to the
outermost below, and the number h of those above. A strand is an array of points; the two ends of a
piece have each other's strand reversed. Forgetting the points leaves the plain state.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.chords import bound

STRANDS = "struct<ends: array<array<int>>, h: int>"
_NONE = "array<int>"


def _state(ends: Column, h: Column) -> Column:
    return F.struct(ends.alias("ends"), h.cast("int").alias("h")).cast(STRANDS)


def start() -> Column:
    return _state(F.array(), F.lit(0))


def move(state: Column, x: Column, up: Column, dn: Column) -> Column:
    """The state after bridge x, which opens an arc on a side or closes the one at the cut there; null if it can't, or if a loop would close.

    The pieces whose ends are closed become one with x between them; what is left of their ends carries it from there, and so do the arcs that x opens.
    """

    def of(v: Column) -> Column:
        ends, h = v["ends"], v["h"]
        none = F.array().cast(_NONE)
        a = F.when(up, none).otherwise(F.get(ends, h - 1))
        b = F.when(dn, none).otherwise(F.get(ends, h))
        whole = F.concat(F.reverse(a), F.array(x), b)  # from the far end above to the far end below

        def kept(some: Column) -> Column:
            return F.transform(some, lambda s: F.when(~up & (s == F.reverse(a)), whole).when(~dn & (s == F.reverse(b)), F.reverse(whole)).otherwise(s))

        above = F.concat(kept(F.slice(ends, F.lit(1), F.when(up, h).otherwise(h - 1))), F.when(up, F.array(whole)).otherwise(F.array().cast("array<array<int>>")))
        below = F.concat(F.when(dn, F.array(F.reverse(whole))).otherwise(F.array().cast("array<array<int>>")), kept(F.slice(ends, F.when(dn, h + 1).otherwise(h + 2), F.size(ends))))
        can = (up | (h > 0)) & (dn | (F.size(ends) > h)) & (up | dn | (a != F.reverse(b)))
        return F.when(can, _state(F.concat(above, below), F.size(above)))

    return bound(state, of)


def forget(state: Column) -> Column:
    """The word of a decorated state: each arc's mate has its strand reversed, and the one without a mate leads east."""
    mates = lambda s, i, ends, after: F.exists(F.transform(ends, lambda t, j: (t == F.reverse(s)) & ((j > i) if after else (j < i))), lambda y: y)
    letters = lambda ends: F.transform(ends, lambda s, i: F.when(mates(s, i, ends, True), "(").when(mates(s, i, ends, False), ")").otherwise("E"))
    return F.array_join(bound(state["ends"], letters), "")


def east(state: Column, n: Column) -> Column:
    """The whole curve's points, if the east end closes it: one piece is left, and its end on the side of the last arc, above for odd n, is at the cut. Null otherwise."""
    only = F.get(state["ends"], F.lit(1)) # from the start's arc, the outermost below
    return F.when(n == 0, F.array().cast(_NONE)).when((F.size(state["ends"]) == 2) & (state["h"] == n % 2) & (F.get(state["ends"], F.lit(0)) == F.reverse(only)), only)


def shown(state: Column) -> Column:
    """The strands as text: points joined by commas, strands by bars."""
    return F.array_join(F.transform(state["ends"], lambda s: F.array_join(s.cast("array<string>"), ",")), "|")
