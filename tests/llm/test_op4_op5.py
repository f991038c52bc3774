"""Repeated passages against all 50-word windows; pieces against the sentencepiece library and exact round trips."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import pieces, suffixes
from lamina.llm.common import read
from lamina.llm.suffixes import MIN_WORDS, minimisers, repeated_passages, words_of

DDL = "doc_id long, text string"


def brute(rows):
    """Covered word positions: all windows of MIN_WORDS words that another row has too."""
    where = defaultdict(set)
    words = [words_of(t) for _, t in rows]
    for k, w in enumerate(words):
        for i in range(len(w) - MIN_WORDS + 1):
            where[tuple(w[i : i + MIN_WORDS])].add(k)
    out = set()
    for k, w in enumerate(words):
        for i in range(len(w) - MIN_WORDS + 1):
            if len(where[tuple(w[i : i + MIN_WORDS])]) > 1:
                out |= {(rows[k][0], j) for j in range(i, i + MIN_WORDS)}
    return out


def covered(df):
    rows = df.collect()
    assert all(r.n_words == r.end_word - r.start_word >= MIN_WORDS for r in rows)
    return {(r.doc_id, j) for r in rows for j in range(r.start_word, r.end_word)}


def test_passages_match_all_windows(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + str(rng.randrange(300))
    text = lambda n: [word() for _ in range(n)]
    p, q, r = text(50), text(73), text(400)
    rows = [text(30) + p + text(9), p, text(5) + q, q + text(80), text(49), text(60) + r[10:390] + text(3), r, r, text(40) + p[:49] + text(40), ["same"] * 120, text(8) + ["same"] * 70, q[20:] + q[:40]]
    rows += [text(rng.randrange(20)) + q + text(rng.randrange(30)) for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900, None), (901, ""), (902, "  \n"), (903, " ".join(rows[0]).upper())]
    frame = spark.createDataFrame(rows, DDL).selectExpr("*", "'x' AS h", "1 AS t", "2 AS p").repartition(3)
    assert covered(repeated_passages(frame)) == brute(rows)


def test_passages_that_end_in_a_frequent_line(spark):
    """Two texts share ten words before a line that many texts have, each going on in its own way."""
    rng = random.Random(11)
    text = lambda n: ["w" + str(rng.randrange(10**6)) for _ in range(n)]
    line = text(45)
    rows = [(i, " ".join(text(20) + line + text(20))) for i in range(60)]
    for i in range(10):
        before = text(10)
        rows += [(100 + 2 * i + k, " ".join(text(20) + before + line + text(20))) for k in (0, 1)]
    assert len({d for d, _ in brute(rows)}) == 20
    assert covered(repeated_passages(spark.createDataFrame(rows, DDL).repartition(3))) == brute(rows)


def test_passages_of_more_than_two_texts(spark, monkeypatch):
    """Between two texts that share 54 words may stand a third that shares 30: the pair must be found, by a task or by all."""
    rng = random.Random(3)
    text = lambda n: ["w" + str(rng.randrange(10**6)) for _ in range(n)]
    rows = []
    for _ in range(80):
        shared = text(54)
        a, c = text(20) + shared + text(20), text(20) + shared + text(20)
        rows += [a, text(30) + shared[12:42] + text(30), c, text(9) + shared[20:] + a[74:90]]
    rows += [text(5) + ["again"] * 90 + text(n) for n in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(3, " ".join(rows[3])), (None, " ".join(rows[0]))]
    expected = brute(rows)
    frame = spark.createDataFrame(rows, DDL).repartition(3)
    assert covered(repeated_passages(frame)) == expected
    monkeypatch.setattr(suffixes, "HOLD", 2)
    assert covered(repeated_passages(frame)) == expected


def test_passages_of_empty_table(spark):
    assert repeated_passages(spark.createDataFrame([], DDL)).count() == 0


def test_passages_of_small_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in read(spark, small, "documents").collect()]
    assert covered(repeated_passages(read(spark, small, "documents"))) == brute(rows)


def test_each_window_has_a_minimiser():
    rng = random.Random(1)
    for words in ([b"w%d" % rng.randrange(50) for _ in range(500)], [b"a"] * 300, [b"a", b"b"] * 100):
        at, _ = minimisers(words)
        for i in range(len(words) - MIN_WORDS + 1):
            assert any(i <= a <= i + MIN_WORDS - 16 for a in at)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


@pytest.fixture(scope="module")
def segmenter(vocabulary):
    return pieces.Segmenter(vocabulary)


@pytest.fixture(scope="module")
def library():
    sp = pytest.importorskip("sentencepiece")
    return sp.SentencePieceProcessor(model_file=pieces.MODEL)


def scan(v, text, size):
    t = pieces.normalise(text)
    spans, matrices = [], []
    for a in range(0, len(t), size):
        z, lo = min(len(t), a + size), max(0, a - v.longest)
        spans.append((t[lo : z + v.longest], a - lo, z - lo))
        matrices.append(pieces.chunk_matrix(v, *spans[-1], a == 0))
    states = pieces.cut_states(matrices, None, None)
    return [x for s, i, j in zip(spans, states, states[1:], strict=False) for x in pieces.chunk_ids(v, *s, i, j)]


TEXTS = st.lists(st.sampled_from(["a", "b", " ", "  ", "é", "\n", "the", "tion", "😀", "xxxxx", "1", "\t", "thinationer", "schbe", "\x00", "　", "é"]), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_same_pieces_as_the_library(vocabulary, library, text):
    assert vocabulary.encode(text) == library.encode(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.text(max_size=30), st.none(), st.sampled_from([" a", "a  b", "a ▁b", "a\x00b", "x" * 100, "\n", " ", "a\n b \nc", "€ uro ∆"])), max_size=8))
def test_batches_equal_texts_one_by_one(vocabulary, segmenter, library, texts):
    texts = [None if t is None else "".join(c for c in t if not 0xD800 <= ord(c) <= 0xDFFF) for t in texts]
    got = pieces.encode_batch(segmenter, pa.array([*texts, "begin"], pa.string()).slice(0, len(texts)))
    assert got.to_pylist() == [vocabulary.encode(t) for t in texts]
    assert [g for g, t in zip(got.to_pylist(), texts, strict=True) if "▁" not in (t or "")] == [library.encode(t or "") for t in texts if "▁" not in (t or "")]
    back = pieces.decode_batch(vocabulary, pa.array(vocabulary.raw, pa.large_binary()), got)
    assert back.to_pylist() == [t or "" for t in texts]


def test_words_that_are_forgotten_are_segmented_again(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    few = pieces.Segmenter(vocabulary)
    for k in range(6):
        texts = [f"word{i} tion{i * k} schbe" for i in range(k, k + 9)]
        assert pieces.encode_batch(few, pa.array(texts)).to_pylist() == [vocabulary.encode(t) for t in texts]


def test_decoding_of_lists_that_no_text_has(vocabulary):
    raw = pa.array(vocabulary.raw, pa.large_binary())
    ids = pa.array([[vocabulary.byte[200], vocabulary.byte[65]], None, [], vocabulary.encode("né")], pa.list_(pa.int32()))
    assert pieces.decode_batch(vocabulary, raw, ids).to_pylist() == ["A", None, "", "né"]
    assert pieces.decode_batch(vocabulary, raw, ids.slice(2)).to_pylist() == ["", "né"]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(vocabulary, text):
    if not any(0xD800 <= ord(c) <= 0xDFFF for c in text):
        assert vocabulary.decode(vocabulary.encode(text)) == text


@settings(max_examples=60, deadline=None)
@given(TEXTS.filter(bool), st.integers(1, 40))
def test_scan_equals_whole(vocabulary, text, size):
    assert scan(vocabulary, text, size) == vocabulary.encode(text)


def test_products_are_associative(vocabulary):
    text = "thinationerschbe" * 12
    t = pieces.normalise(text)
    m = []
    for a in range(0, len(t), 20):
        z, lo = min(len(t), a + 20), max(0, a - vocabulary.longest)
        m.append(pieces.chunk_matrix(vocabulary, t[lo : z + vocabulary.longest], a - lo, z - lo, a == 0))
    left, right = m[0], m[-1]
    for x in m[1:]:
        left = pieces.combine(left, x)
    for x in reversed(m[:-1]):
        right = pieces.combine(x, right)
    assert sorted(map(repr, left)) == sorted(map(repr, right))


def test_unigram_scores_against_all_segmentations():
    names = [f"<0x{i:02X}>" for i in range(256)]
    words = ["▁", "a", "b", "ab", "▁a", "ba", "bab", "▁ab"]
    score = [-3.0, -2.0, -2.5, -3.1, -3.6, -4.2, -5.0, -5.5]
    v = pieces.Vocabulary(names + words, [0.0] * 256 + score, "b" * 256 + "n" * len(words), bpe=False)

    def best(t):
        if not t:
            return 0.0
        return max((score[words.index(t[:n])] + best(t[n:]) for n in range(1, 4) if t[:n] in words), default=float("-inf"))

    rng = random.Random(2)
    for _ in range(100):
        text = "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 14)))
        for ids in (v.encode(text), scan(v, text, 4)):
            assert v.decode(ids) == text
            assert sum(v.scores[i] for i in ids) == pytest.approx(best(pieces.normalise(text)))


def test_encode_and_decode_tables(spark, library):
    rng = random.Random(3)
    long = " ".join("".join(rng.choice(["the", "tion", "sch", "é", "ou"]) for _ in range(4)) for _ in range(400))
    rows = [(1, "hello world"), (2, None), (3, ""), (4, long), (4, long), (None, "x ▁ y"), (5, "z" * 700), (6, long.replace(" ", ""))]
    frame = spark.createDataFrame(rows, DDL).selectExpr("*", "1 AS ids", "2 AS key")
    out = pieces.encode(frame, chunk=64)
    got = sorted((str(r.doc_id), r.ids) for r in out.collect())
    want = sorted((str(i), library.encode(t or "") if i else pieces.Vocabulary.load().encode(t)) for i, t in rows)
    assert got == want
    back = sorted((str(r.doc_id), r.text) for r in pieces.decode(out).collect())
    assert back == sorted((str(i), t or "") for i, t in rows)
    assert pieces.encode(spark.createDataFrame([], DDL)).count() == 0


def test_round_trip_is_decode_of_encode(spark):
    long = " ".join(["the", "tion"] * 40)
    rows = [(1, "hello world"), (2, None), (3, ""), (4, long), (4, long), (None, "x ▁ y"), (5, "z" * 70), (6, "  a\x00 b\nc ")]
    frame = spark.createDataFrame(rows, DDL)
    want = pieces.decode(pieces.encode(frame, chunk=64))
    got = pieces.round_trip(frame, chunk=64)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted((str(i), t or "") for i, t in rows)
    assert pieces.round_trip(spark.createDataFrame([], DDL)).count() == 0


def test_words_stay_known_from_task_to_task(spark):
    """One segmenter serves all tasks of a Python process."""
    v = pieces.Vocabulary.load()
    first = v.segmenter
    pieces.encode_batch(first, pa.array(["hello world"]))
    assert v.segmenter is first and "▁hello" in first.known
