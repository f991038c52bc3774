"""Near and exact duplicates, decontamination, sharding and components against brute force."""

import hashlib
import random
import re
from collections import Counter
from functools import partial
from zlib import crc32

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from lamina.llm import decontam, exact, overlap, sharding, simhash
from lamina.llm.common import components, read

DDL = "doc_id long, text string"
CLASH = "'x' AS fp, 1 AS t, 2 AS recipe, 3 AS n, 'y' AS digest, 4 AS _id, 'z' AS lang, 5 AS `a.b`, 6 AS `text_hash`, 7 AS id, 8 AS `row`, 9 AS `gone_id`"


def normal(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", normal(text))


def groups(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def texts(rng, n, size=60):
    return [" ".join(rng.choice("abcdefgh") + str(rng.randrange(200)) for _ in range(rng.randrange(1, size))) for _ in range(n)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, DDL).selectExpr("*", *CLASH.split(", ")).repartition(parts)


@pytest.fixture(scope="module")
def awkward():
    """Copies, case, blanks, nulls, empty and long texts, repeated rows."""
    rng = random.Random(1)
    t = texts(rng, 40)
    rows = list(enumerate(t)) + [(100 + i, t[i % 7].upper()) for i in range(30)] + [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "one two"), (205, "ONE"), (3, t[3]), (3, t[3]), (7, "other text of seven"), (206, "É é"), (207, "é é"), (208, "word " * 30000), (209, "word " * 30000)]
    return rows




def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(300)] + [(5, 5), (-9, 4000), (-9, 4000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == groups(links, linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text, k=3):
    w = words(text)
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_of_awkward_rows(spark, awkward):
    rows = [r for r in awkward if r[0] != 208 and r[0] != 209]
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    fps = [fingerprint(t) for _, t in rows]
    of = groups([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2], fps)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        least[of[f]] = min(i, least.get(of[f], i))
    assert got == Counter((i, f"{f:016x}", least[of[f]]) for (i, _), f in zip(rows, fps, strict=True))
    assert simhash.near_duplicates(spark.createDataFrame([], DDL)).count() == 0
    assert [r.component_id for r in simhash.near_duplicates(spark.createDataFrame([(None, "a b c d")], DDL)).collect()] == [None]


@pytest.mark.parametrize("share", [0.3, 1.0])
def test_links_span_all_pairs_within_two_bits(spark, share):
    """Dense clouds around few centres, and chains of single flips."""
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(int(600 * share))}
    for c in list(fps)[:6]:
        for _ in range(150):
            x = c
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    x = rng.getrandbits(64)
    for _ in range(60):
        x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(s, s, 0) for s in signed], "id long, fp long, more long")
    found = simhash.links(nodes, simhash.covering_masks(2, 6), partial(simhash._spanning, radius=2))
    got = {r.node: r.component for r in components(found).collect()}
    a = np.array(fps, dtype=np.uint64)
    pairs = [(signed[i], signed[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= 2)]
    assert got == groups(pairs, {x for p in pairs for x in p})


def similar(rows, k=5):
    """Brute force: links (a, b) of similarity 0.8 or more."""
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or {tuple(w)} for i, w in rows}
    ids = sorted(sets)
    return [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def linked(groups_):
    return {(r.doc_id): r.component_id for r in groups_.collect()}


def check_similar(spark, rows):
    """All groups and what stays against all pairs."""
    near = similar(rows)
    want = groups(near, {x for p in near for x in p})
    docs = frame(spark, [(i, " ".join(w)) for i, w in rows])
    assert linked(simhash.similar_groups(docs)) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if want.get(i, i) == i)
    return near


def edited(rng, words_, times):
    w = list(words_)
    for at in rng.sample(range(len(w)), times):
        w[at] = f"new{rng.randrange(10**9)}"
    return w


def test_similar_groups_of_all_sizes(spark):
    rng = random.Random(6)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(2000)) for _ in range(rng.choice((3, 5, 6, 9, 15, 40, 120, 300)))] for _ in range(120)]
    rows = list(enumerate(base))
    for i in range(120, 320):
        w = rng.choice(base)
        rows.append((i, edited(rng, w, min(len(w), rng.choice((0, 1, 1, 2, 4, 30))))))
    assert len(check_similar(spark, rows)) > 60


def test_similar_groups_of_templates(spark):
    """Forty templates of sixty pages each: nearly all pages are alike, few are similar enough."""
    rng = random.Random(30)
    rows = []
    for k in range(40):
        template = [f"t{k}-{i}" for i in range(200)]
        rows += [(60 * k + i, edited(rng, template, rng.randrange(3, 8))) for i in range(60)]
    sets = {}
    for i, w in rows:
        sets.setdefault(i // 60, []).append((i, w))
    near = [p for family in sets.values() for p in similar(family)]  # pages of two templates share nothing
    want = groups(near, {x for p in near for x in p})
    assert 50 < len(near) < 1000
    assert linked(simhash.similar_groups(frame(spark, [(i, " ".join(w)) for i, w in rows]))) == want


@pytest.mark.parametrize(("hot", "tables"), [(64, 48), (3, 48), (3, 1), (1, 1)])
def test_similar_groups_in_a_dense_family(spark, monkeypatch, hot, tables):
    """Pages of one template at 0.71 to 0.79 hide pairs of 0.81 from each other; hot tokens and an index that finds next to nothing change no result."""
    monkeypatch.setattr(overlap, "HOT", hot)
    rng = random.Random(16)
    template = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(150):
        w = list(template)
        for at in rng.sample(range(60), 5):
            w[5 * at] = f"own{i}-{at}"
        rows.append((i, w))
    for i in range(20):
        w = list(rows[i][1])
        for at in rng.sample(range(60), 6):
            w[5 * at + 1] = f"new{i}-{at}"
        rows.append((1000 + i, w))
    line = [f"common{i}" for i in range(40)]
    rows += [(2000 + i, [f"body{i // 2}-{j}" for j in range(30)] + line + [f"end{i}"]) for i in range(30)]
    near = similar(rows)
    assert {(i, 1000 + i) for i in range(20)} | {(2000 + 2 * i, 2001 + 2 * i) for i in range(15)} <= set(near)
    want = groups(near, {x for p in near for x in p})
    assert linked(simhash.similar_groups(frame(spark, [(i, " ".join(w)) for i, w in rows]), tables=tables)) == want


@pytest.mark.parametrize("block", [1 << 14, 16])
def test_a_family_below_the_limit_makes_few_candidates(spark, monkeypatch, block):
    """Pages of one template with seven words of their own, nearly all pairs between 0.6 and 0.8: the pairs that leave the search are far fewer than the pairs there are, also when a token's members are compared in blocks, and no link is lost."""
    monkeypatch.setattr(overlap, "BLOCK", block)
    seen = []
    whole = overlap.candidates
    monkeypatch.setattr(overlap, "candidates", lambda *a: seen.append(whole(*a)) or seen[-1])
    rng = random.Random(21)
    template = [f"w{i}" for i in range(400)]
    rows = [(i, edited(rng, template, 7)) for i in range(400)]
    rows += [(1000 + i, edited(rng, rows[i][1], rng.randrange(1, 5))) for i in range(25)]  # links, some at the limit
    near = similar(rows)
    assert len(near) >= 20
    want = groups(near, {x for p in near for x in p})
    assert linked(simhash.similar_groups(frame(spark, [(i, " ".join(w)) for i, w in rows]))) == want
    pairs = len(rows) * (len(rows) - 1) // 2
    assert seen[0].count() < pairs // 40


def test_similar_groups_of_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "ONE two"), (6, long), (7, f"{long} end"), (8, "a b c d e f g h i j"), (8, long), (8, long), (9, "a b c d e f g h i j k"), (None, long), (None, "")]
    docs = frame(spark, rows)
    got = Counter((r.doc_id, r.component_id) for r in simhash.similar_groups(docs).collect())
    assert got == Counter([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (8, 6), (8, 8), (9, 8)])
    kept = Counter((r.doc_id, len(r.text or "")) for r in simhash.keep_one(docs).collect())
    assert kept == Counter((i, len(t or "")) for i, t in [(1, None), (4, "one two"), (6, long), (8, "a b c d e f g h i j"), (None, long), (None, "")])
    assert simhash.similar_groups(docs.limit(0)).count() == 0


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(1)
    for n, d in ((10, 3), (300, 40), (5000, 900)):
        x = np.unique(rng.integers(0, 1 << 63, n + d).astype(np.uint64))
        a, b = x[:n], np.concatenate((x[d // 2 : n], x[n:]))
        p, q = (np.array(v, dtype=np.int64).view(np.uint64) for v in overlap.parity([a, b]).to_pylist())
        assert np.bitwise_count(p ^ q).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_similar_groups_of_repeated_lines(spark):
    rng = random.Random(17)
    rows = []
    for i in range(12):
        body, line = ([f"{c}{rng.randrange(10**6)}" for _ in range(n)] for c, n in (("b", 190), ("l", 10)))
        rows += [(i, body + line), (100 + i, body + line * (10 if i % 2 else 60))]
    near = similar(rows)
    assert sorted(near) == [(i, 100 + i) for i in range(12)]
    got = simhash.similar_groups(frame(spark, [(i, " ".join(w)) for i, w in rows]))
    assert {r.doc_id: r.component_id for r in got.collect()} == groups(near, {x for p in near for x in p})


def test_exact_duplicates_of_awkward_rows(spark, awkward):
    rows = [*awkward, (None, "lonely"), (None, awkward[0][1])]
    for bits in (64, 3):  # with three bits nearly all chunks collide
        got = exact.exact_duplicates(frame(spark, rows), bits).collect()
        by = {}
        for i, t in rows:
            by.setdefault(normal(t), []).append(i)
        key = lambda x: -1 if x is None else x
        want = Counter((i, max(by[normal(t)], key=key), len(by[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        kept = Counter((r.doc_id, r.text_sha256) for r in got if r.kept)
        assert kept == Counter({(max(v, key=key), hashlib.sha256(t.encode()).hexdigest()): 1 for t, v in by.items()})
    stays = exact.keep_one(frame(spark, rows))
    assert Counter((r.doc_id, normal(r.text)) for r in stays.collect()) == Counter((max(v, key=key), t) for t, v in by.items())
    assert exact.exact_duplicates(spark.createDataFrame([], DDL)).count() == 0


def test_chunks_join_to_the_text_and_follow_content(spark):
    rng = random.Random(8)
    a = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) + rng.choice(("", "", ".", "\n")) for _ in range(4000))
    long = [a, "x" * 20000, a[:9000] + "inserted words here. " + a[9000:], ""]
    got = [r.c for r in spark.createDataFrame([(t,) for t in long], "text string").select(exact.chunks(F.col("text")).alias("c")).collect()]
    assert ["".join(c) for c in got] == long
    assert len(set(got[0]) & set(got[2])) >= 0.7 * len(got[0])  # cuts fall into step again soon after the edit


def test_decontamination(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(500))
    items = [(i, [word() for _ in range(rng.choice((3, 5, 9, 20, 57)))]) for i in range(30)] + [(90, []), (91, ["short"]), (92, ["a"] * 30)]
    rows = []
    for i in range(150):
        w = [word() for _ in range(rng.randrange(0, 400))]
        if i % 3 == 0:
            part = list(rng.choice(items)[1])
            for _ in range(rng.choice((0, 0, 1, 2))):
                if part:
                    part[rng.randrange(len(part))] = "edited"
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        rows.append((i, " ".join(w).upper()))
    rows += [(200, None), (201, ""), (202, "short"), (203, "a " * 40), (5, rows[5][1])]
    sets = {}
    for i, w in items:
        n = min(5, len(w))
        if w:
            sets[i] = ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)}, n)
    want = {}
    for d, t in rows:
        w = words(t)
        for i, (s, n) in sets.items():
            shared = len(s & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
            if 5 * shared >= 4 * len(s):
                want[d, i] = (len(s), max(shared, want.get((d, i), (0, 0))[1]))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(93, None)], "item_id long, text string").selectExpr("*", "1 AS n", "2 AS digest")
    docs = frame(spark, rows)
    assert {(r.doc_id, r.item_id): (r.item_shingles, r.shared) for r in decontam.contaminated(docs, benchmark).collect()} == want
    clean = decontam.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in rows if d not in {x for x, _ in want})
    assert decontam.contaminated(docs.limit(0), benchmark).count() == 0
    assert decontam.keep_clean(docs, benchmark.limit(0)).count() == len(rows)


def test_sharding_of_awkward_rows(spark, awkward):
    rows = [*awkward, *[(7, "again")] * 50, (None, None), (None, "x")]
    got = sharding.shard_documents(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t in rows)
    counts = Counter(r.shard for r in got)
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(counts[s])) for s in counts)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert sharding.shard_documents(spark.createDataFrame([], DDL)).count() == 0


def test_shards_and_slots_equal_a_plain_ring_walk(spark, awkward):
    rows = [*awkward, *[(7, "again")] * 5, (None, None), *[(1000 + i, f"text {i}") for i in range(500)]]
    got = Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.shard_documents(frame(spark, rows)).collect())
    facts = [(i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t in rows]
    named = spark.createDataFrame(sorted(set(facts), key=str), "doc_id long, size long, text_crc32 long")
    place = {tuple(r)[:3]: r.place for r in named.withColumn("place", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32")).collect()}
    points = sharding.ring(8, 64)
    queues = {}
    for f in facts:
        cell = (place[f] % (1 << 64)) >> 50
        after = [k for k, (p, _) in enumerate(points) if p >= cell]
        arc = after[0] if after else 0
        queues.setdefault(arc, []).append((not after, cell, place[f], (f[0] is not None, f[0] or 0), f))
    room = [len(rows) // 8 + (s < len(rows) % 8) for s in range(8)]
    waiting = {arc: [x[-1] for x in sorted(q)] for arc, q in queues.items()}
    shards, out = [0] * 8, Counter()
    for turn in range(8):  # what is left of each arc walks on to the next shard clockwise
        for arc in sorted(waiting):
            seen = list(dict.fromkeys(points[(arc + i) % len(points)][1] for i in range(len(points))))
            shard = seen[turn]
            while waiting[arc] and shards[shard] < room[shard]:
                f = waiting[arc].pop(0)
                out[*f, shard, shards[shard]] += 1
                shards[shard] += 1
    assert sum(out.values()) == len(rows)
    assert got == out


def test_ring_keeps_most_keys_at_their_first_shard_and_overflow_goes_on_clockwise():
    points = sharding.ring(8, 64)
    rng = random.Random(1)
    counts = {a: rng.randrange(100) for a in range(len(points))}
    parts = sharding.settle(points, counts, 8)
    assert sum(z - a + 1 for _, a, z, _, _ in parts) == sum(counts.values())
    first = sum(z - a + 1 for arc, a, z, s, _ in parts if s == points[arc][1])
    assert first > 0.75 * sum(counts.values())
    for arc, a, _, s, _ in parts:
        tried = sharding.order_of_shards(points, arc)
        before = [x[3] for x in parts if x[0] == arc and x[1] < a]
        assert all(tried.index(b) < tried.index(s) for b in before)


def test_simhash_of_small_documents_in_any_order(spark, small):
    docs = read(spark, small, "documents")
    one = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    two = sorted(map(tuple, simhash.near_duplicates(docs.repartition(7)).collect()))
    assert one == two
