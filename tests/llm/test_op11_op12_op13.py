"""Collocations, prefix trie and line deduplication against plain versions, on awkward rows and with every part of their machinery at work."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lamina.llm import collocations, lines, prefixes

DOCUMENTS = "doc_id long, text string, lang string, own_id string, row int, keys string, `a``b` int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, "k", 2) for i, t, lang in rows], DOCUMENTS)


# -- op11 ---------------------------------------------------------------------------------------


def plain_collocations(rows, support, longest, top=2000, inside=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    frequent = {k: a for k, a in f.items() if a >= support}
    found = defaultdict(list)
    for (lang, *w), a in frequent.items():
        if len(w) < 2:
            continue
        cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        longer = [b for (other, *v), b in frequent.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if not any(100 * b >= inside * a for b in longer):
            found[lang].append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, x in found.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "ß", "été", "x y", "　", "red", "fox", "den"]

    def text():
        return "".join(rng.choice([*words, "red fox den", "New York"]) + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", "!? ", "\x0b"]) for _ in range(rng.randrange(30)))

    return [(text() if rng.random() > 0.05 else None, rng.choice(["en", "en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"portion": 40}, {"shards": 1, "portion": 200}, {"shards": 9, "bits": 64}])
def test_collocations(spark, sizes):
    """Small portions, one shard, more shards than the support allows to help, and a bitmap in which every bit is set."""
    rows = corpus(1, 150)
    frame = documents(spark, [(i, *r) for i, r in enumerate(rows)])
    for longest, top in ((3, 2000), (4, 7)) if not sizes else ((3, 2000),):
        got = collocations.collocations(frame.repartition(3), 4, longest, top, **sizes)
        assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 4, longest, top)


def test_support_is_kept_in_uneven_shards(spark):
    """A phrase that is spread as thinly over the shards as it can be is found, one occurrence less is not."""
    rows = [(f"so rare {i}." + " zz" * (i % 7), "en") for i in range(10)] + [(f"too rare {i}", "en") for i in range(9)] + [("filler " * 300, "en")]
    got = collocations.collocations(documents(spark, [(1, *r) for r in rows]))
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, 10, 3)
    assert "so rare" in {r.phrase for r in got.collect()} and "too rare" not in {r.phrase for r in got.collect()}


def test_collocations_on_awkward_tables(spark):
    assert collocations.collocations(documents(spark, [])).count() == 0
    assert collocations.collocations(documents(spark, [(None, None, None), (1, "", "en"), (1, " .\n,", "en")])).count() == 0
    rows = [("x y " * 50_000, None)] + [("p q", "und")] * 30  # a long text, one lang under two names
    assert sorted(map(tuple, collocations.collocations(documents(spark, [(None, *r) for r in rows])).collect())) == plain_collocations(rows, 10, 3)


def test_products_past_64_bits(spark, monkeypatch):
    """Counts of 10 ** 11, whose products need 80 bits, are given as if they had been counted."""
    big = 10**11
    counts = spark.createDataFrame([("en", "u", 1, 3 * big + 1), ("en", "v", 1, big + 7), ("en", "u v", 2, big + 1)], "lang string, phrase string, size int, f long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a, **b: (counts, spark.createDataFrame([("en", 9 * big)], "lang string, n long")))
    (r,) = collocations.collocations(None).collect()
    assert tuple(r) == ("en", 1, "u v", big + 1, 3 * big + 1, big + 7, 9 * big, 1000000 * (big + 1) ** 2 // ((3 * big + 1) * (big + 7)))


# -- op12 ---------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = own.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])[:h] + v[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, len(path)))
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(str(c) for c, n in sorted(members[p]) if n == len(p)).encode()).hexdigest()
    least = {p: min(m)[0] for p, m in members.items()}
    return sorted((least[p], len(p), least[p[:-1]] if p else -1, len(members[p]), kids[p], leaves[p], saved[p], sha(p)) for p in members)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, path int, number string, `tur.ns` int")


def found_trie(frame, *sizes):
    return sorted(tuple(-1 if x is None else x for x in r) for r in prefixes.conversation_trie(frame, *sizes).collect())


def talks(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(-6, n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 12])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "hi", "é", "", None, "ok"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [(), (7, 3), (1, 2), (25, 20)])
def test_trie(spark, sizes):
    """One shard, and skeletons from a few splitters to nearly all paths."""
    rows = talks(3, 90)
    assert found_trie(conversations(spark, rows).repartition(3), *sizes) == plain_trie(rows)


def test_trie_of_copies_and_long_conversations(spark, monkeypatch):
    """A group of copies that fills several shards, whose ids are sent in many pieces, beside a conversation of 600 turns and its copy."""
    monkeypatch.setattr(prefixes, "SEND", 7)
    rows = [(5 * c, t, "user", f"t{t}") for c in range(120) for t in range(2)] + [(5 * c, 0, "user", "alone") for c in range(200, 210)]
    rows += [(c, t, "user", str(t)) for c in (1000, 1005) for t in range(600)]
    assert found_trie(conversations(spark, rows), 10, 10) == plain_trie(rows)


def test_trie_of_awkward_tables(spark):
    assert found_trie(conversations(spark, [])) == []
    assert found_trie(conversations(spark, [(None, 0, "user", "x")])) == []
    nothing = [(4, 0, "user", "x")]  # its first turns come from a conversation that is not there
    assert zlib.crc32(b"4") % 9 >= 1 and found_trie(conversations(spark, nothing)) == plain_trie(nothing) == [(4, 0, -1, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())]
    rows = [(10, 1, "user", "x"), (10, 1, "user", "x"), (10, 1, "assistant", "a:b"), (11, None, None, None), (11, 2, "a", ":b"), (15, 0, "user", "y" * 300_000)]
    assert found_trie(conversations(spark, rows), 1, 3) == plain_trie(rows)


# -- op13 ---------------------------------------------------------------------------------------


def plain_lines(rows, least=10, threshold=2):
    """rows: (doc_id, text). A null doc_id is a document of its own, the largest."""
    rank = lambda i: (i is None, i or 0)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(rank(i))
    out = []
    for i, text in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if not (len(holders[key(x)]) >= threshold and min(holders[key(x)]) != rank(i))]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found_lines(frame, *sizes):
    return sorted((tuple(r) for r in lines.without_shared_lines(frame, *sizes).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)


LINES = ["A common line of text", "a COMMON line of text \t", "\x0b a common line of text\r", "short", "ninechars", "tenchars10", "é" * 10, "É" * 10, "", " ", " nbsp stays here", "nbsp stays here", "lone %d", "x" * 9 + " ", "\x1fcontrol stays", "control stays"]


@pytest.mark.parametrize("sizes", [(), (1, 2), (10, 3), (10, 1)])
def test_lines(spark, sizes):
    rng = random.Random(7)
    text = lambda: "\n".join(rng.choice(LINES).replace("%d", str(rng.random())) for _ in range(rng.randrange(9)))
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "\n\n", text(), text(), text()])) for _ in range(150)]
    rows += rows[:20]
    frame = documents(spark, [(*r, "en") for r in rows]).repartition(3)
    assert found_lines(frame, *sizes) == plain_lines(rows, *sizes)


def test_lines_of_copies_and_long_texts(spark):
    long = "\n".join(f"line number {i}" for i in range(20_000))
    rows = [(i, "the same line everywhere\nand this other one") for i in range(300)] + [(999, long), (1000, long + "\nand one more line")]
    assert found_lines(documents(spark, [(*r, None) for r in rows])) == plain_lines(rows)


def test_lines_on_awkward_tables(spark):
    assert found_lines(documents(spark, [])) == []
    frame = documents(spark, [(2, "This line is shared\nmine alone", "en"), (1, "this line is shared", None), (None, None, None)])
    kept = lines.dedup_lines(frame)
    assert kept.columns == frame.columns
    assert {(r.doc_id, r.text, r.lang, r.row, r["a`b"]) for r in kept.collect()} == {(2, "mine alone", "en", 1, 2), (1, "this line is shared", None, 1, 2), (None, "", None, 1, 2)}
