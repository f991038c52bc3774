"""decoded_orders: the decoder of whole batches against the column expressions, long orders, nulls against the SQL."""

import datetime
import itertools
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lamina.functions import chords, decoding
from lamina.plans import oracle, queries

SCHEMA = pa.schema([("l_orderkey", pa.int64()), ("l_partkey", pa.int64()), ("l_suppkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_quantity", pa.float64()), ("l_extendedprice", pa.float64()), ("l_shipdate", pa.timestamp("us"))])


def lines(key, perm):
    """Lines whose crossing order is perm."""
    return [(key, 1, 1, i, 1.0, float(b), datetime.datetime(2020, 1, 1) + datetime.timedelta(i)) for i, b in enumerate(perm)]


def against_sql(spark, root, rows):
    """The query's rows on a table of these lines, which are those of its SQL."""
    pq.write_table(pa.Table.from_pylist([dict(zip(SCHEMA.names, r)) for r in rows], SCHEMA), f"{root}/lineitem.parquet")
    got = {r.l_orderkey: (r.decoded, r.same) for r in queries.decoded_orders(spark, str(root)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{root}/lineitem.parquet'")
    want = con.execute(f"SELECT l_orderkey, decoded, same FROM ({oracle.SQL['decoded_orders']})").fetchall()
    assert got == {k: (d, s) for k, d, s in want} and len(got) == len(want)
    return got


def test_batches_equal_column_expressions(spark):
    rng = random.Random(1)
    perms = [list(p) for n in range(1, 7) for p in itertools.permutations(range(n))]
    perms += [rng.sample(range(n), n) for n in range(7, 13) for _ in range(20)] + [list(range(12))]
    rng.shuffle(perms)
    size, flat = np.array([len(p) for p in perms]), np.array(sum(perms, []))
    ends = np.cumsum(size)[:-1]
    up, dn = decoding.actions(flat, size)
    got = zip(np.split(up, ends), np.split(dn, ends), np.split(decoding.decode(up, dn, size), ends))
    acts = chords.actions(F.col("perm"))
    want = spark.createDataFrame([(i, p) for i, p in enumerate(perms)], "i int, perm array<int>").select("i", acts.alias("acts"), chords.decode(acts).alias("back"))
    for (u, d, back), r in zip(got, want.orderBy("i").collect(), strict=True):
        assert list(zip(u, d)) == [(a.up, a.dn) for a in r.acts]
        # Where the curve ends early, the expressions name the end, then nothing.
        assert back.tolist() == [-1 if b is None or b >= len(back) else b for b in r.back]


def test_actions_of_no_order():
    """Arcs that close nothing lead nowhere; another order's arcs are never taken."""
    no, yes = [False] * 2, [True] * 2
    got = decoding.decode(np.array(no + [True, False] + yes), np.array(no + yes + [True, False]), np.array([2, 2, 2]))
    assert got.tolist() == [-1, -1, 0, 1, -1, -1]


def test_orders_of_sixty_lines_in_time(spark, tmp_path):
    rng = random.Random(2)
    perms = {}
    for key in range(0, 256, 4):
        swapped = list(range(60))
        swapped[key % 59], swapped[key % 59 + 1] = swapped[key % 59 + 1], swapped[key % 59]
        perms |= {key: list(range(60)), key + 1: list(range(58, -1, -1)), key + 2: rng.sample(range(60), 60), key + 3: swapped}
    began = time.time()
    got = against_sql(spark, tmp_path, [x for k, p in perms.items() for x in lines(k, p)])
    assert time.time() - began < 30
    assert all(got[k] == (",".join(map(str, perms[k])), True) for k in perms if k % 4 < 2)
    assert not any(got[k][1] for k in perms if k % 4 == 2)


def test_nulls_as_in_sql(spark, tmp_path):
    """Nulls rank last; an order without a key is never decoded."""
    rows = lines(None, [0, 1, 2]) + lines(1, [2, 0, 1]) + lines(2, [0, 1, 2, 3]) + lines(3, [0])
    for i in (3, 4):
        rows[i] = (*rows[i][:5], None, rows[i][6])
    for i in (6, 8):
        rows[i] = (*rows[i][:6], None)
    got = against_sql(spark, tmp_path, rows)
    assert got[None] == (None, False) and got[3] == ("0", True)
    assert len(got) == 4


def test_one_long_order(spark):
    """An order of more lines than are decoded together, among short ones; its cost grows with its length."""
    n = decoding.LINES + 5
    sizes = {1: 3, 2: n, 3: 2}
    rows = spark.createDataFrame([(k, i, i) for k, m in sizes.items() for i in range(m)], "l_orderkey long, pos int, bridge int").coalesce(1)
    got = {r.l_orderkey: (r.decoded, r.same) for r in decoding.decoded(rows, "l_orderkey").collect()}
    assert got == {k: (",".join(map(str, range(m))), True) for k, m in sizes.items()}


def test_batches_hold_whole_orders(monkeypatch):
    monkeypatch.setattr(decoding, "LINES", 6)
    sizes = [1, 4, 3, 17, 1, 1, 6, 2, 9]
    pos = [i for m in sizes for i in range(m)]
    for step in (1, 2, 5, 50):
        parts = [pa.RecordBatch.from_pydict({"pos": pa.array(pos[i : i + step], pa.int32())}) for i in range(0, len(pos), step)]
        whole = [b.column("pos").to_pylist() for b in decoding._whole(iter(parts))]
        assert sum(whole, []) == pos and all(b[0] == 0 for b in whole)
        assert max(map(len, whole)) <= 6 + 17 + step
    assert not list(decoding._whole(iter(())))
