"""Runs of actions through the line scan: all runs at once, equal beginnings stepped once.

A layer holds, for every state, the rest of the actions that runs in it have yet to take, and how
many runs these are: runs in one state with one rest have the same future and are one row. Each
layer's different (state, action) pairs are the automaton's edges; only they are stepped, and the
rows follow by a join. A run that an edge refuses leaves the layer there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import words
from lamina.operators.layers import COUNT, merge
from lamina.session import materialise


def sweep(runs: DataFrame) -> DataFrame:
    """(n, k, event, count) of runs (n, acts, count), n actions (up, dn) each, in one pass over their layers:

    - 'passed': runs that are in some state after k bridges;
    - 'could end': those among them in a state from which the east end would finish an order of k bridges;
    - 'refused': runs that bridge k (from 0) can't follow: nothing is there to be closed, or a loop would be;
    - 'accepted' and 'unfinished' (k = n): what the east end, after the last bridge, makes of the rest.
    """
    keys = ("n", "at", "rest")
    begin = F.struct(F.lit("").alias("word"), F.lit(0).alias("h")).cast(words.STATE)
    layer = materialise(merge(runs.select("n", begin.alias("at"), F.col("acts").alias("rest"), F.col("count").cast(COUNT).alias("count")), *keys), "runs")
    longest = layer.agg(F.max("n")).first()[0] or 0
    events = []
    for k in range(longest + 1):
        here = F.col("at").isNotNull()
        end = here & words.could_end(F.col("at.word"), F.col("at.h"), F.lit(k))
        last = F.col("n") == k
        kinds = {"passed": here, "could end": end, "accepted": end & last, "unfinished": here & ~end & last, "refused": ~here}
        events.append(layer.groupBy("n").agg(*[F.sum(F.when(c, F.col("count"))).cast(COUNT).alias(e) for e, c in kinds.items()]).withColumn("k", F.lit(k)))
        if k < longest:
            going = layer.where(here & ~last).select("n", "at", F.get("rest", F.lit(0)).alias("act"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest"), "count")
            edges = going.select("at", "act").distinct().withColumn("next", words.move(F.col("at.word"), F.col("at.h"), F.col("act.up"), F.col("act.dn")))
            moved = going.join(edges, ["at", "act"]).select("n", F.col("next").alias("at"), F.when(F.col("next").isNotNull(), F.col("rest")).alias("rest"), "count")
            layer = materialise(merge(moved, *keys), "runs")  # a row without state: the runs refused at this bridge
    out = reduce(DataFrame.unionByName, events)
    long = out.unpivot(["n", "k"], ["passed", "could end", "accepted", "unfinished", "refused"], "event", "count").where("count IS NOT NULL")
    return long.select("n", (F.col("k") - (F.col("event") == "refused").cast("int")).alias("k"), "event", "count")
