"""Scratch tables: where they are, and that nothing stays."""

from pathlib import Path

from lamina import session
from lamina.plans.queries import QUERIES


def test_release_leaves_nothing_but_results(spark, small, tmp_path):
    """A query's scratch tables are there until they are released; what the query's result was written to stays."""
    session.release(spark)
    root = Path(session.scratch_root(spark).removeprefix("file:"))
    before = set(root.iterdir()) if root.exists() else set()
    for name in ("meet_in_the_middle", "value_files", "bucketed_dots"):
        QUERIES[name](spark, small).write.parquet(f"{tmp_path}/{name}")
    assert len(set(root.iterdir()) - before) > 3
    assert session.release(spark) > 3 and session.release(spark) == 0
    assert set(root.iterdir()) == before
    assert spark.read.parquet(f"{tmp_path}/meet_in_the_middle").count() > 0


def test_batch_size_that_was_set_stays(spark, small):
    spark.conf.set(session.BATCH, "77")
    session.read_table(spark, small, "region").count()
    assert spark.conf.get(session.BATCH) == "77"
    spark.conf.unset(session.BATCH)
    session.read_table(spark, small, "region").count()
    assert spark.conf.get(session.BATCH) == "256"
