"""The counting operators on the given tables, and the same results by other methods in SQL."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import chords, decoding, numeric, packed, strands, words
from lamina.operators import layers, mitm, residues, runs, search
from lamina.operators.ranks import ranked
from lamina.plans.tables import crossing_orders, listed_lines, ranked_lines, read, simple_orders, states_of, text
from lamina.session import materialise
from lamina.sources import segments, values
from lamina.sources.values import verdict


def order_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: its crossing order, crossing pairs of arcs of its path, and whether it is simple (array form)."""
    o = crossing_orders(spark, sf_dir).withColumn("crossings", chords.crossings(chords.path(F.col("perm"))).cast("long"))
    return o.select("l_orderkey", F.col("n").cast("long").alias("n"), text(F.col("perm")).alias("perm"), "crossings", (F.col("crossings") == 0).alias("is_simple"))


def order_arc_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossing pairs of arcs by side, as a theta join of arcs of the same order and side (long form)."""
    lines = ranked_lines(spark, sf_dir)
    w = Window.partitionBy("l_orderkey")
    n = F.count("*").over(w)
    point = lambda k, p: F.struct(k.cast("long").alias("k"), p.cast("long").alias("p"))
    own = point(F.col("pos") + 1, F.col("bridge"))
    # The first line brings the path's first point, the last line its last.
    points = F.when(F.col("pos") == 0, F.array(point(F.lit(0), F.col("n") + 1), own)).otherwise(F.array(own))
    points = F.when(F.col("pos") == F.col("n") - 1, F.concat(points, F.array(point(F.col("n") + 1, F.col("n"))))).otherwise(points)
    path = lines.withColumn("n", n).select("l_orderkey", F.inline(points))
    arcs = path.withColumn("q", F.lead("p").over(w.orderBy("k"))).where("q IS NOT NULL").withColumn("side", F.col("k") % 2)
    arcs = materialise(arcs, "arcs")  # both sides of the join read it
    a, b = arcs.alias("a"), arcs.alias("b")
    clash = chords.interleave(F.col("a.p"), F.col("a.q"), F.col("b.p"), F.col("b.q"))
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.side") == F.col("b.side")) & (F.col("a.k") < F.col("b.k")) & clash)
    return pairs.groupBy(F.col("a.l_orderkey").alias("l_orderkey"), F.col("a.side").alias("side")).agg(F.count("*").alias("crossings"))


def closed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of odd length closed up to loops: crossings of the loop; the loop is simple exactly if the order is."""
    o = crossing_orders(spark, sf_dir).where("n % 2 = 1").withColumn("loop", chords.close_up(F.col("perm")))
    return o.select("l_orderkey", text(F.col("loop")).alias("closed"), chords.crossings(chords.loop(F.col("loop"))).cast("long").alias("crossings"), chords.is_closed_simple(F.col("loop")).alias("is_closed"))


def order_search_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a pruned search follows each order: bridges whose arcs cross nothing, and those that leave a way to finish as well."""
    o = crossing_orders(spark, sf_dir).select("l_orderkey", F.col("n").cast("long").alias("n"), chords.search_depth(F.col("perm")).alias("d"))
    return o.select("l_orderkey", "n", F.col("d.clear").cast("long").alias("clear"), F.least("d.clear", "d.open").cast("long").alias("clear_and_open"))


def order_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening and closing words of the two sides of the orders that are simple, with how often each pair occurs."""
    m = simple_orders(spark, sf_dir)
    return m.groupBy(F.col("n").cast("long").alias("n"), chords.side_word(F.col("perm"), True).alias("above"), chords.side_word(F.col("perm"), False).alias("below")).agg(F.count("*").alias("orders"))


def order_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the orders that are simple, after each of their bridges: the scan run on their actions, equal states merged."""
    s = states_of(simple_orders(spark, sf_dir))
    return s.select(F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), "word", F.col("h").cast("long").alias("h"), F.col("count").cast("long").alias("orders"))


def _half_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states_of(simple_orders(spark, sf_dir)).where("k = n div 2")


def layer_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next layer of the states half-way: expanded, filtered by what can still finish, merged."""
    half = _half_states(spark, sf_dir)
    grown = half.select("n", "k", F.explode(words.successors(F.col("word"), F.col("h"), F.col("n"), F.col("k").cast("int"))).alias("s"), "count")
    out = layers.merge(grown.select("n", "k", "s.word", "s.h", "count"), "n", "k", "word", "h")
    return out.select(F.col("n").cast("long").alias("n"), (F.col("k") + 1).cast("long").alias("k"), "word", F.col("h").cast("long").alias("h"), F.col("count").cast("long").alias("orders"))


def layer_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that lead to those half-way in one bridge, of depth less than k: the inverse step with its depth bound."""
    half = _half_states(spark, sf_dir).where("k > 0")
    back = half.select("n", "k", F.explode(F.filter(words.predecessors(F.col("word"), F.col("h")), lambda s: words.depth(s["word"], s["h"]) <= F.col("k") - 1)).alias("s"), "count")
    out = layers.merge(back.select("n", "k", "s.word", "s.h", "count"), "n", "k", "word", "h")
    return out.select(F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), "word", F.col("h").cast("long").alias("h"), words.depth(F.col("word"), F.col("h")).cast("long").alias("depth"), F.col("count").cast("long").alias("orders"))


def _packed(rows: DataFrame) -> DataFrame:
    return rows.select("n", "k", "h", *packed.narrow(F.col("word")), "count")


def meet_in_the_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many ways the first halves of the orders that are simple can be finished: observed states joined with backward layers, products summed."""
    half = materialise(_packed(_half_states(spark, sf_dir)), "half")
    most, longest = half.agg(F.max(F.col("n") - F.col("k")), F.max("n")).first()
    back = mitm.backward_layers(spark, most or 0, F.lit(longest or 0) - F.col("r"))
    f = half.withColumn("p", F.col("n") % 2).withColumn("r", (F.col("n") - F.col("k")).cast("int")).withColumnRenamed("count", "f")
    both = f.join(back, ["p", "r", "h", "e", "bits"])
    return both.groupBy(F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k")).agg(F.sum("f").cast("long").alias("orders"), F.sum(F.col("f") * F.col("count")).cast("long").alias("ways"))


def packed_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next layer of the states half-way on packed states, whatever follows: a bridge, no target; ``open`` says which could still finish."""
    half = _packed(_half_states(spark, sf_dir))
    out = layers.merge(packed.stepped(half, "n", "k"), "n", "k", "h", "e", "bits")
    length = packed.brackets(F.col("bits")) + F.when(F.col("e") >= 0, 1).otherwise(0)
    opens = words.can_finish(length, F.col("h"), F.col("n"), F.col("k") + 1)
    return out.select(F.col("n").cast("long").alias("n"), (F.col("k") + 1).cast("long").alias("k"), F.col("h").cast("long").alias("h"), F.col("e").cast("long").alias("e"), "bits", packed.widen(F.col("e"), F.col("bits")).alias("word"), opens.alias("open"), F.col("count").cast("long").alias("orders"))


def packed_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states a bridge before those half-way, on packed states, in segments by depth: what a horizon of one bridge reaches, and what a further one newly admits. Segments are written and united."""
    half = _packed(_half_states(spark, sf_dir).where("k > 0"))
    back = layers.merge(packed.stepped(half, "n", "k", backwards=True), "n", "k", "h", "e", "bits", "depth")
    seg = F.when(F.col("depth") <= 1, 0).when(F.col("depth") <= 2, 1).otherwise(2)
    back = back.where(F.col("depth") < F.col("k")).withColumn(segments.SEGMENT, seg)
    path = values.fresh(spark, "segments")
    segments.write_segments(back, path, "h", "bits")
    return _segment_rows(segments.read_segments(back, path))


def _segment_rows(layer: DataFrame) -> DataFrame:
    return layer.select(F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), F.col("seg").cast("long").alias("seg"), F.col("h").cast("long").alias("h"), "bits", F.col("depth").cast("long").alias("depth"), F.col("count").cast("long").alias("orders"))


def extended_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same layer for a horizon of two bridges, extended to four and then to all: each step makes only the states of its own depths and appends them."""
    half = materialise(_packed(_half_states(spark, sf_dir).where("k > 0")), "half")
    path = values.fresh(spark, "extended")
    for seg, (low, high) in enumerate([(-1, 2), (2, 4), (4, packed.MOST)]):
        segments.extend(half, path, seg, low, high, "n", "k")
    return _segment_rows(segments.read_segments(half.withColumn("depth", F.lit(0)), path))


def finished_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The east end: states after all bridges, expanded once more; how many orders reach the accepting state, in how many different runs of actions."""
    o = simple_orders(spark, sf_dir).select("n", "perm", chords.actions(F.col("perm")).alias("acts"))
    last = states_of(o).where("k = n")
    ends = last.select("n", "count", F.explode(words.successors(F.col("word"), F.col("h"), F.col("n"), F.col("n"))).alias("s")).where(words.is_end(F.col("s.word"), F.col("s.h")))
    runs = o.select("n", F.to_json("acts").alias("acts")).groupBy("n").agg(F.countDistinct("acts").alias("runs"))
    states = last.groupBy("n").agg(F.count("*").alias("states"))
    done = ends.groupBy("n").agg(F.sum("count").cast("long").alias("accepted"))
    return done.join(runs, "n").join(states, "n").select(F.col("n").cast("long").alias("n"), "states", "runs", "accepted")


def decoded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders put together again from their actions alone: exactly the simple ones come back."""
    o = decoding.decoded(listed_lines(spark, sf_dir), "l_orderkey")
    same = F.col("same") & F.col("l_orderkey").isNotNull()  # the SQL's joins find no order without a key
    return o.select("l_orderkey", F.when(same, F.col("decoded")).alias("decoded"), same.alias("same"))


def closed_open_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different simple orders of 2 n - 1 bridges closed up, against the different closed simple orders of 2 n among all closed-up ones: both counts, and what only one of the sets has."""
    kinds = materialise(crossing_orders(spark, sf_dir).where("n % 2 = 1").select("n", "perm").distinct(), "kinds")
    image = kinds.where(chords.is_simple(F.col("perm"))).select(chords.close_up(F.col("perm")).alias("perm"))
    closed = kinds.select(chords.close_up(F.col("perm")).alias("perm")).where(chords.is_closed_simple(F.col("perm")))
    size = lambda df, name: df.groupBy((F.size("perm") / 2).cast("long").alias("n")).agg(F.count("*").alias(name))
    opens = kinds.where(chords.is_simple(F.col("perm"))).groupBy(((F.col("n") + 1) / 2).cast("long").alias("n")).agg(F.count("*").alias("open_kinds"))
    out = opens.join(size(closed, "closed_kinds"), "n", "full")
    for name, a, b in (("only_open", image, closed), ("only_closed", closed, image)):
        out = out.join(size(a.exceptAll(b), name), "n", "left")
    return out.fillna(0, ["open_kinds", "closed_kinds", "only_open", "only_closed"])


def inverse_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from observed states half-way to observed states one bridge later: found forward, found backward, and found in one direction only."""
    states = states_of(simple_orders(spark, sf_dir))
    early = states.where("k = n div 2").select("n", "k", "word", "h")
    late = states.where("k = n div 2 + 1 AND k <= n").select("n", (F.col("k") - 1).alias("k"), F.col("word").alias("word2"), F.col("h").alias("h2"))
    early, late = materialise(early.distinct(), "early"), materialise(late.distinct(), "late")
    forth = early.select("n", "k", "word", "h", F.explode(words.bridge(F.col("word"), F.col("h"))).alias("t")).select("n", "k", "word", "h", F.col("t.word").alias("word2"), F.col("t.h").alias("h2"))
    forth = forth.join(late, ["n", "k", "word2", "h2"], "left_semi")
    back = late.where("instr(word2, 'E') = 0").select("n", "k", "word2", "h2", F.explode(words.predecessors(F.col("word2"), F.col("h2"))).alias("t")).select("n", "k", F.col("t.word").alias("word"), F.col("t.h").alias("h"), "word2", "h2")
    back = back.join(early, ["n", "k", "word", "h"], "left_semi")
    keys = ["n", "k", "word", "h", "word2", "h2"]
    both = forth.select(*keys, F.lit(1).alias("f")).join(back.select(*keys, F.lit(1).alias("b")), keys, "full")
    count = lambda c: F.count(F.when(c, 1))
    f, b = F.col("f").isNotNull(), F.col("b").isNotNull()
    return both.groupBy(F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k")).agg(count(f).alias("forward"), count(b).alias("backward"), count(f & ~b).alias("only_forward"), count(b & ~f).alias("only_backward"))


def value_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of orders by length, written as a value file and as a result table, read again, and looked up for the counts of simple orders: what was read against what is counted."""
    o = crossing_orders(spark, sf_dir).groupBy("n").agg(F.count("*").cast(layers.COUNT).alias("count"), F.sum(chords.is_simple(F.col("perm")).cast("int")).cast(layers.COUNT).alias("check"))
    o = materialise(o, "lengths")
    root = values.fresh(spark, "values")
    values.write_values(o, f"{root}/values")
    values.write_results(o.select("n", F.col("check").alias("simple")), f"{root}/results")
    o.select(F.concat_ws(" ", "n", "count").alias("value")).write.text(f"{root}/b")
    read_ = values.read_values(spark, f"{root}/values").select("n", F.col("count").alias("stored"))
    table = values.read_results(spark, f"{root}/results").select(F.col("n").cast("int").alias("n"), F.col("simple").cast("long").alias("simple"))
    lines = values.read_b_file(spark, f"{root}/b").select("n", F.col("count").alias("listed"))
    found = o.select("n", "count").join(read_, "n").join(table, "n").join(lines, "n")
    return found.select(F.col("n").cast("long").alias("n"), F.col("listed").cast("long").alias("orders"), "simple", verdict(F.col("stored"), F.col("count")).alias("verdict"))


def part_layer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines merged by part and return flag, with the sizes of the merged layers."""
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", F.col("l_quantity").cast("decimal(38,0)").alias("count"))
    merged = layers.merge(rows, "l_returnflag", "l_partkey")
    return merged.groupBy("l_returnflag").agg(F.count("*").alias("states"), F.max("count").cast("long").alias("peak"), F.sum("count").cast("long").alias("total"))


def layer_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot product over parts of the quantities returned and not returned, per supplier nation."""
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("decimal(38,0)").alias("count"))
    nation = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = lines.join(nation, "l_suppkey").select("s_nationkey", F.col("l_partkey").cast("string").alias("word"), F.lit(0).alias("h"), "l_returnflag", "count")
    side = lambda c: layers.merge(rows.where(c), "s_nationkey", "word", "h")
    out = mitm.dot(side("l_returnflag = 'R'"), side("l_returnflag <> 'R'"), "s_nationkey")
    return out.select("s_nationkey", F.col("count").cast("long").alias("dot"))


def bucketed_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot products of every two return flags' layers of parts: each layer is written once, in buckets of parts, and no product shuffles it again."""
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", F.col("l_quantity").cast("decimal(38,0)").alias("count"))
    flags = ("A", "N", "R")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    layer = {f: segments.bucketed(spark, layers.merge(lines.where(F.col("l_returnflag") == f), "l_partkey"), f"layer_{f}", buckets, "l_partkey") for f in flags}
    dots = [mitm.dot(layer[a], layer[b].hint("merge"), on=("l_partkey",)).select(F.lit(a).alias("flag"), F.lit(b).alias("other"), F.col("count").cast("long").alias("dot")) for a, b in itertools.combinations(flags, 2)]
    return reduce(DataFrame.unionByName, dots)


def modular_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price products summed modulo 2 ** 64 and 2 ** 61 - 1 and put together again, per part."""
    cents = F.round(F.col("l_extendedprice") * 100).cast(numeric.WIDE)
    value = (cents * cents * F.col("l_quantity").cast("decimal(10,0)")).cast(numeric.WIDE)
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", value.alias("v"))
    sums = rows.groupBy("l_partkey").agg(numeric.mod_sum(F.col("v"), numeric.M64).alias("a"), numeric.mod_sum(F.col("v"), numeric.M61).alias("b"))
    return sums.select("l_partkey", F.col("b").cast("long").alias("mod_m61"), numeric.crt(F.col("a"), F.col("b")).cast("string").alias("total"))


def residue_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities weighted five times over by their lines' prices in cents, layer by layer, and added up by return flag: totals past 38 digits, carried as residues."""
    lines = read(spark, sf_dir, "lineitem").select("l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("quantity"))
    layer = residues.merge(residues.start(lines, F.col("quantity"), "l_returnflag", "cents"), "l_returnflag", "cents")
    for _ in range(5):
        layer = residues.weigh(layer, F.col("cents"))
    return residues.totals(residues.merge(layer, "l_returnflag"))


def growth_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts of orders by month, with their ratios, rates, exponents and extrapolations."""
    months = read(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.count("*").alias("c"))
    w = Window.orderBy("m")  # one row per month
    series = months.select(F.row_number().over(w).cast("long").alias("n"), F.sum("c").over(w).alias("count"))
    out = numeric.growth(series)
    return out.select("n", "count", *[F.round(c, 6).alias(c) for c in ("ratio", "rate", "exponent", "extrapolated")])


def value_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines counted per order against the largest line number, which is the number expected of orders that lack none."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("count"), F.max("l_linenumber").cast("long").alias("expected"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    both = orders.join(lines, "l_orderkey", "left").fillna(0, ["count", "expected"])
    return both.select("l_orderkey", "count", "expected", verdict(F.col("count"), F.col("expected")).alias("verdict"))


def two_split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order counted by two splits: as rows, by part, and as different line numbers, by supplier; they agree unless a line number repeats."""
    lines = read(spark, sf_dir, "lineitem")
    by_part = lines.groupBy("l_orderkey", "l_partkey").count().groupBy("l_orderkey").agg(F.sum("count").alias("count"))
    seen = lines.select("l_orderkey", "l_linenumber", "l_suppkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))
    by_supplier = seen.groupBy("l_orderkey", "l_suppkey").count().groupBy("l_orderkey").agg(F.sum("count").alias("check"))
    both = by_part.join(by_supplier, "l_orderkey")
    return both.select("l_orderkey", "count", "check", verdict(F.col("count"), F.col("check")).alias("verdict"))


def segment_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' event layers built in segments of depth (events so far) windows and united; equal to one scan of all."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = read(spark, sf_dir, "events").select("event_type", F.row_number().over(w).alias("depth"), F.lit(1).cast("decimal(38,0)").alias("count"))
    seg = F.when(F.col("depth") <= 10, 0).when(F.col("depth") <= 30, 1).otherwise(2)
    layer = layers.merge(events, "event_type", "depth").withColumn(segments.SEGMENT, seg)
    path = values.fresh(spark, "segments")
    segments.write_segments(layer, path, "event_type", "depth")
    out = segments.read_segments(layer, path)
    return out.select("event_type", F.col("depth").cast("long").alias("depth"), F.col("seg").cast("long").alias("seg"), F.col("count").cast("long").alias("events"))


def numbered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different crossing orders of each length in lexicographic order with their numbers and every tenth marked: counted before they are numbered, and numbered over ranges."""
    kinds = crossing_orders(spark, sf_dir).groupBy("n", "perm").agg(F.count("*").alias("orders"))
    number = F.col("number").cast("long")
    return ranked(kinds, ("n",), ("perm",)).select(F.col("n").cast("long").alias("n"), text(F.col("perm")).alias("perm"), "orders", number.alias("number"), (number % 10 == 1).alias("sampled"))


def numbered_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the simple orders after each bridge, numbered in the order of their keys: how many arcs are above, then what each arc leads to."""
    states = states_of(simple_orders(spark, sf_dir)).withColumn("code", words.codes(F.col("word"), F.col("h")))
    out = ranked(states, ("n", "k"), ("h", "code"))
    return out.select(F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), "word", F.col("h").cast("long").alias("h"), text(F.col("code")).alias("code"), F.col("number").cast("long").alias("number"), F.col("count").cast("long").alias("orders"))


def order_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per length: orders, different crossing orders, different simple ones, and the bounds these must keep: n! and, for odd n, a squared Catalan number."""
    kinds = crossing_orders(spark, sf_dir).groupBy("n", "perm").agg(F.count("*").alias("orders")).withColumn("m", chords.is_simple(F.col("perm")).cast("int"))
    out = kinds.groupBy("n").agg(F.sum("orders").alias("orders"), F.count("*").alias("kinds"), F.sum("m").alias("simple"))
    catalan = numeric.catalan(F.floor((F.col("n") - 1) / 2).cast("int") + 1).cast("long")
    keeps = (F.col("kinds") <= F.factorial("n")) & ((F.col("n") % 2 == 0) | (F.col("simple") <= catalan * catalan))
    return out.select(F.col("n").cast("long").alias("n"), "orders", "kinds", "simple", F.factorial("n").alias("most"), F.when(F.col("n") % 2 == 1, catalan * catalan).alias("most_simple"), keeps.alias("keeps"))


def event_interleavings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, pairs of consecutive events as arcs over the line of event values: pairs of arcs of one side that cross, all of them.

    Arcs (l, r) and (l2, r2) cross if l < l2 < r < r2. For an arc (l2, r2) these are the arcs with a
    smaller l and a smaller r, less those with r <= l2. The first count is one of rising pairs in
    the order of l, and is taken bit by bit of r's rank: among arcs whose ranks agree above a bit,
    those without it that come before one with it. So m arcs make m log m rows, and no pairs.
    """
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).alias("k"), F.col("value").alias("a"), F.lead("value").over(w).alias("b")).where("a <> b")
    e = e.select("user_id", (F.col("k") % 2).alias("side"), F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r"))
    own = Window.partitionBy("user_id", "side")
    e = e.withColumn("place", F.row_number().over(own.orderBy("l", F.desc("r")))).withColumn("rank", F.dense_rank().over(own.orderBy("r")))
    e = materialise(e, "arcs")
    bits = e.select("user_id", "side", "place", "rank", F.max("rank").over(own).alias("most"))
    bits = bits.select("user_id", "side", "place", "rank", F.explode(F.sequence(F.lit(0), F.length(F.bin("most")) - 1)).alias("bit"))
    bits = bits.select("user_id", "side", "bit", "place", F.expr("shiftright(rank, bit + 1)").alias("above"), F.expr("shiftright(rank, bit) & 1").alias("one"))
    before = Window.partitionBy("user_id", "side", "bit", "above").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rising = bits.withColumn("zeros", F.sum(1 - F.col("one")).over(before)).where("one = 1").groupBy("user_id").agg(F.sum("zeros").alias("rising"))
    # Ends at or before each beginning, by one pass over both in order.
    marks = e.select("user_id", "side", F.inline(F.array(F.struct(F.col("r").alias("x"), F.lit(0).alias("begins")), F.struct(F.col("l").alias("x"), F.lit(1).alias("begins")))))
    upto = Window.partitionBy("user_id", "side").orderBy("x", "begins").rowsBetween(Window.unboundedPreceding, 0)
    apart = marks.withColumn("ended", F.sum(1 - F.col("begins")).over(upto)).where("begins = 1").groupBy("user_id").agg(F.sum("ended").alias("apart"))
    both = apart.join(rising, "user_id", "left")
    return both.select("user_id", (F.coalesce("rising", F.lit(0)) - F.col("apart")).alias("interleavings")).where("interleavings > 0")


def _as_split(layer: DataFrame) -> DataFrame:
    return layer.select("n", F.col("n") % 2, (F.col("n") - F.col("k")).cast("int"), "h", "e", "bits", "count").toDF("n", "p", "r", "h", "e", "bits", "count")


def state_split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many ways the observed first halves of each length can be finished, from two splits: the states half-way, and the whole layer that one bridge more makes of them."""
    half = materialise(_packed(_half_states(spark, sf_dir)), "half")
    most, longest = half.agg(F.max(F.col("n") - F.col("k")), F.max("n")).first()
    next_ = layers.merge(packed.stepped(half, "n", "k").withColumn("k", F.col("k") + 1), "n", "k", "h", "e", "bits")
    back = mitm.backward_layers(spark, most or 0, F.lit(longest or 0) - F.col("r"))
    found = mitm.two_splits(_as_split(half), _as_split(next_), back, "n")
    return found.select(F.col("n").cast("long").alias("n"), F.col("count").cast("long").alias("count"), F.col("check").cast("long").alias("check"), "verdict")


def _run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = crossing_orders(spark, sf_dir).select("n", chords.actions(F.col("perm")).alias("acts"))
    return runs.sweep(acts.groupBy("n", "acts").agg(F.count("*").alias("count")))


def accepted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scan makes of the actions of all orders, simple or not: how many it accepts, and at which bridge it refuses the others."""
    found = _run_events(spark, sf_dir).where("event IN ('accepted', 'refused', 'unfinished')")
    return found.select(F.col("n").cast("long").alias("n"), "event", F.col("k").cast("long").alias("k"), F.col("count").cast("long").alias("orders"))


def finishing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each k, how many orders' runs pass k bridges and how many of them could end right there, from one sweep over all lengths."""
    found = _run_events(spark, sf_dir).where("event IN ('passed', 'could end')").groupBy("k", "event").agg(F.sum("count").alias("count"))
    by_event = lambda e: F.coalesce(F.sum(F.when(F.col("event") == e, F.col("count"))), F.lit(0)).cast("long")
    return found.groupBy(F.col("k").cast("long").alias("k")).agg(by_event("passed").alias("passed"), by_event("could end").alias("could_end"))


def _prefix_search(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    half = F.floor(F.col("n") / 2).cast("int")
    some = simple_orders(spark, sf_dir).select("n", F.slice("perm", F.lit(1), half).alias("prefix")).groupBy("n", "prefix").agg(F.count("*").alias("orders"))
    some = materialise(some, "prefixes")
    rows = search.start(some.select("n", "prefix", F.lit(1).cast(layers.COUNT).alias("count")), "prefix")
    longest = some.agg(F.max("n")).first()[0] or 0
    return some, *search.search(rows, longest, "prefix", path="prefix")


def prefix_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first halves of the simple orders, how many orders have them, and all simple orders that complete them."""
    some, _, done = _prefix_search(spark, sf_dir)
    out = some.join(done, ["n", "prefix"], "left").fillna(0, ["completions"])
    return out.select(F.col("n").cast("long").alias("n"), text(F.col("prefix")).alias("prefix"), "orders", F.col("completions").cast("long").alias("completions"))


def search_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial orders that the search for these completions visits, by length and bridges used, from the prefixes on."""
    _, nodes, _ = _prefix_search(spark, sf_dir)
    out = nodes.where(F.col("at") >= F.size("prefix")).groupBy("n", "at").agg(F.sum("nodes").alias("nodes"))
    return out.select(F.col("n").cast("long").alias("n"), F.col("at").cast("long").alias("used"), F.col("nodes").cast("long").alias("nodes"))


def decorated_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the simple orders with the points of their pieces; after the last bridge, the order that the one piece left spells."""
    o = simple_orders(spark, sf_dir).select("n", "perm", chords.actions(F.col("perm")).alias("acts"))
    run = lambda done, a, x: F.concat(done, F.array(strands.move(F.element_at(done, -1), x, a["up"], a["dn"])))
    indexed = F.transform("acts", lambda a, x: F.struct(a.alias("a"), x.alias("x")))
    all_ = F.aggregate(indexed, F.array(strands.start()), lambda done, i: run(done, i["a"], i["x"]))
    rows = o.select("n", F.posexplode(all_).alias("k", "s"))
    whole = F.when(F.col("k") == F.col("n"), text(strands.east(F.col("s"), F.col("n"))))
    rows = rows.select("n", "k", strands.forget(F.col("s")).alias("word"), F.col("s.h").alias("h"), strands.shown(F.col("s")).alias("pieces"), whole.alias("whole"))
    out = rows.groupBy(*[F.col(c).cast("long").alias(c) if c in ("n", "k", "h") else F.col(c) for c in rows.columns]).agg(F.count("*").alias("orders"))
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        order_crossings, order_arc_join, closed_orders, order_search_depth, order_sides, order_layers, layer_successors, layer_predecessors, meet_in_the_middle,
        part_layer_merge, layer_dot, modular_totals, growth_ratios, value_report, two_split_check, segment_union, numbered_orders, order_bounds, event_interleavings,
        packed_successors, packed_predecessors, finished_orders, decoded_orders, closed_open_sets, inverse_steps, value_files,
        state_split_check, accepted_runs, finishing_counts, prefix_completions, search_nodes, decorated_states, numbered_states, extended_predecessors, bucketed_dots, residue_layers,
    )
}
