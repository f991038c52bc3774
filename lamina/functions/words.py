"""States of the line scan, as column expressions.

A state is a word over '(', ')' and at most one 'E', and the number h of its letters above the
line: the open arcs at a cut, from the outermost above to the outermost below. Matching brackets
are the two ends of one piece of the curve; 'E' marks the arc whose piece leads to the east end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATE = "struct<word string, h int>"


def _count(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def _balance(text: Column) -> Column:
    return _count(text, "(") - _count(text, ")")


def letter(word: Column, i: Column) -> Column:
    return F.substring(word, i + 1, F.lit(1))


def _range(a: Column, z: Column) -> Column:
    return F.when(z >= a, F.sequence(a, z)).otherwise(F.array().cast("array<int>"))


def splice(word: Column, at: Column, drop: int, text: str) -> Column:
    """The word with ``text`` in the place of ``drop`` letters from ``at`` on."""
    return F.concat(F.substring(word, F.lit(1), at), F.lit(text), F.substring(word, at + 1 + drop, F.length(word)))


def mate(word: Column, i: Column) -> Column:
    """Place of the other end of the piece that ends at place i; null if that is the east end."""
    right = F.array_min(F.filter(_range(i + 1, F.length(word) - 1), lambda j: _balance(F.substring(word, i + 1, j - i + 1)) == 0))
    left = F.array_max(F.filter(_range(F.lit(0), i - 1), lambda j: _balance(F.substring(word, j + 1, i - j + 1)) == 0))
    return F.when(letter(word, i) == "(", right).when(letter(word, i) == ")", left)


def unclosable(length: Column, h: Column, m: Column, k: Column) -> Column:
    """How many of a state's open arcs must stay open after k of m bridges. What is left, bridges and the east end, are m + 1 - k points with
    an arc on either side, but for the east end, which has it above if m is odd and else below; the arc of the curve's start, below, is not to be closed."""
    left, odd = m + 1 - k, m % 2
    over = lambda arcs, points: F.greatest(arcs - F.greatest(points, F.lit(0)), F.lit(0))
    return over(h, left - 1 + odd) + over(length - h - 1, left - odd)


def can_finish(length: Column, h: Column, m: Column, k: Column) -> Column:
    """Whether a state with so many letters after k points can still reach the end."""
    return unclosable(length, h, m, k) == 0


def _state(word: Column, h: Column) -> Column:
    return F.struct(word.alias("word"), h.cast("int").alias("h")).cast(STATE)


def _present(*states: Column) -> Column:
    return F.filter(F.array(*states), lambda s: s.isNotNull())


def move(word: Column, h: Column, up: Column, dn: Column) -> Column:
    """The state after a bridge that opens (or else closes) an arc above and one below; null if it can't."""
    above, below = h > 0, F.length(word) > h
    return (
        F.when(up & dn, _state(splice(word, h, 0, "()"), h + 1))  # a new piece
        .when(up & below, _state(word, h + 1))  # the piece at the top below goes on above
        .when(~up & dn & above, _state(word, h - 1))
        .when(~up & ~dn & above & below, joined(word, h))
    )


def joined(word: Column, h: Column) -> Column:
    """The two arcs at the cut become one piece, and the ends that survive are each other's mates; null if they are one piece already, which would close a loop.

    A piece to the east end has one end here: what it is joined with leads there then.
    """
    p, q = mate(word, h - 1), mate(word, h)
    one = splice(word, F.coalesce(p, q), 1, "E")
    two = splice(splice(word, F.least(p, q), 1, "("), F.greatest(p, q), 1, ")")
    both = F.when(p.isNull() | q.isNull(), one).otherwise(two)
    return F.when(p.isNull() | (p != h), _state(splice(both, h - 1, 2, ""), h - 1))


def bridge(word: Column, h: Column) -> Column:
    """Array of the states after a bridge, whatever follows."""
    yes, no = F.lit(True), F.lit(False)
    return _present(*[move(word, h, up, dn) for up in (yes, no) for dn in (yes, no)])


def east(word: Column, h: Column, m: Column) -> Column:
    """Array of the states after the east end, whose one arc, above if m is odd, begins there or is the one at the cut: then its piece's other end leads there."""
    up = (m % 2 == 1).cast("int")
    i = h - up
    begins = _state(splice(word, h, 0, "E"), h + up)
    ends = _state(splice(splice(word, mate(word, i), 1, "E"), i, 1, ""), h - up)
    return _present(begins, F.when((i >= 0) & (i < F.length(word)) & mate(word, i).isNotNull(), ends))


def successors(word: Column, h: Column, m: Column, x: Column) -> Column:
    """Array of the states that point x of m can lead to and that can still reach the end."""
    found = F.when(x < m, bridge(word, h)).otherwise(east(word, h, m))
    return F.filter(found, lambda s: can_finish(F.length(s["word"]), s["h"], m, x + 1))


def is_end(word: Column, h: Column) -> Column:
    """Whether the scan is through: nothing is open but the start's arc, whose piece leads to the east end."""
    return (word == "E") & (h == 0)


def could_end(word: Column, h: Column, k: Column) -> Column:
    """Whether the east end would finish an order of k bridges from here: one piece is left, from the start's arc below to the arc that the end closes, above if k is odd; with no bridge, nothing."""
    return F.when(k == 0, word == "").otherwise((word == "()") & (h == k % 2))


def depth(word: Column, h: Column) -> Column:
    """Fewest bridges that build a state without E: its length less the brackets that are open at the cut."""
    return F.length(word) - _balance(F.substring(word, F.lit(1), h))


def predecessors(word: Column, h: Column) -> Column:
    """Array of the states that a bridge leads from to this one, which has no E."""
    n = F.length(word)
    fresh = (h > 0) & (n > h) & (letter(word, h - 1) == "(") & (letter(word, h) == ")")
    plain = _present(F.when(fresh, _state(splice(word, h - 1, 2, ""), h - 1)), F.when(h > 0, _state(word, h - 1)), F.when(h < n, _state(word, h + 1)))
    between = lambda a, z: F.substring(word, a + 1, z - a)
    level = lambda a, z: (_balance(between(a, z)) == 0) & ~F.exists(_range(a, z - 1), lambda j: _balance(between(a, j + 1)) < 0)

    def undo(p: Column) -> Column:
        q = mate(word, p)
        return (
            F.when((p >= h) & level(h, p), _state(splice(splice(word, p, 1, ")"), h, 0, "(("), h + 1))
            .when((q < h) & level(q + 1, h), _state(splice(splice(word, q, 1, "("), h, 0, "))"), h + 1))
            .when((p < h) & (q >= h) & level(p + 1, h) & level(h, q), _state(splice(word, h, 0, ")("), h + 1))
        )

    opens = F.filter(_range(F.lit(0), n - 1), lambda p: letter(word, p) == "(")
    return F.concat(plain, F.filter(F.transform(opens, undo), lambda s: s.isNotNull()))


def codes(word: Column, h: Column) -> Column:
    """What each open arc leads to, as numbers: 0 for the east end, 2 i + 2 for the i-th arc above and 2 i + 1 for the i-th below, counted from the outermost; the arcs above come first, then those below, each from the outermost."""
    n = F.length(word)
    number = lambda j: F.when(j.isNull(), 0).when(j < h, 2 * j + 2).otherwise(2 * (n - 1 - j) + 1)
    places = F.concat(_range(F.lit(0), h - 1), F.reverse(_range(h, n - 1)))
    return F.transform(places, lambda i: number(mate(word, i)).cast("int"))
