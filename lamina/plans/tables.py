"""Crossing orders, states and series that the given tables hold.

The lines of an order, ranked by price and listed by ship date, are a crossing order: a permutation
relating two orderings of the same things. Its actions, run through the line scan, give states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import chords, words
from lamina.session import read_table as read

#: Decides ties wherever lines are ranked.
LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def ranked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, pos, bridge): the line at place pos in shipping order has price rank bridge."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", *LINE)
    by_price = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", *LINE)
    by_date = Window.partitionBy("l_orderkey").orderBy("l_shipdate", *LINE)
    return lines.select("l_orderkey", (F.row_number().over(by_date) - 1).alias("pos"), (F.row_number().over(by_price) - 1).alias("bridge"))


def listed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, pos, bridge) without gathering: an order's lines are rows of one partition, one after another by pos. Nulls rank last, as they do in the queries' SQL."""
    by = lambda first: [F.asc_nulls_last(c) for c in (first, *LINE)]
    place = lambda first: F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*by(first))) - 1
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", *LINE)
    lines = lines.withColumn("bridge", place("l_extendedprice")).withColumn("pos", place("l_shipdate"))
    # The last window leaves its rows in this order already: the plan has no third sort.
    return lines.sortWithinPartitions("l_orderkey", *by("l_shipdate")).select("l_orderkey", "pos", "bridge")


def crossing_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, n, perm)."""
    rows = ranked_lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", "bridge"))).alias("r"))
    return rows.select("l_orderkey", F.size("r").alias("n"), F.col("r.bridge").alias("perm"))


def simple_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossing_orders(spark, sf_dir).where(chords.is_simple(F.col("perm")))


def text(perm: Column) -> Column:
    return F.array_join(perm.cast("array<string>"), ",")


def states_of(orders: DataFrame) -> DataFrame:
    """(n, k, word, h, count): how many orders of n bridges are in a state after k of them, the scan being run on each order's actions."""
    start = F.lit(("")).alias("word"), F.lit(0).alias("h")
    first = F.array(F.struct(*start).cast(words.STATE))
    run = lambda done, a: F.concat(done, F.array(words.move(F.element_at(done, -1)["word"], F.element_at(done, -1)["h"], a["up"], a["dn"])))
    all_ = F.aggregate(chords.actions(F.col("perm")), first, run)
    rows = orders.select("n", F.posexplode(all_).alias("k", "s")).select("n", "k", "s.word", "s.h")
    return rows.groupBy("n", "k", "word", "h").agg(F.count("*").cast("decimal(38,0)").alias("count"))
