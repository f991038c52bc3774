"""Chat formatting, quality, language and toxicity: round trips, held-out accuracy, awkward rows."""

import hashlib
import itertools
import math
import random
from bisect import bisect_right

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.llm import chat, langid, quality, queries, toxicity
from lamina.llm.common import read

PIECES = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", " [/INST]", "[/INST]", "<<SYS>>", "\n<</SYS>>\n", "<<ROLE>>", "<</ROLE>>", "<<END>>", "\\", "<", "[", "/", "s>", "INST]", " ", "\n", "a", "é"]), max_size=12).map("".join)
LABELS = "doc_id long, quality int, toxic int"
DDL = "doc_id long, text string, lang string"


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escapes_are_reversible_and_hide_control_strings(text):
    hidden = chat.escape(chat.INSTRUCT, text)
    assert chat.unescape(chat.INSTRUCT, hidden) == text
    assert not any(c in hidden for c in chat.INSTRUCT.controls)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "<<ROLE>>", ""]), PIECES), min_size=1, max_size=6))
def test_turns_are_read_back(turns):
    segments = list(chat.segments_of(chat.INSTRUCT, [(1, r, t) for r, t in turns]))
    seen = []
    reader = chat.Reader(chat.INSTRUCT, lambda r: seen.append([r, None]), lambda t: seen[-1].__setitem__(1, t))
    reader.feed("".join(s[5] for s in segments))  # as one string, marks only
    assert [tuple(x) for x in seen] == turns and not reader.buffer
    assert "".join(chat.unescape(chat.INSTRUCT, s[5]) for s in segments if s[6]) == "".join(t for r, t in turns if r == "assistant")


def test_order_of_roles():
    def problem(*roles):
        return list(chat.segments_of(chat.INSTRUCT, [(1, r, "x") for r in roles]))[-1][7]

    assert problem("user", "assistant") is problem("system", "user", "assistant", "user", "assistant") is None
    assert problem("assistant") == "turn 0: assistant may not stand here"
    assert problem("user", "user", "assistant") == "turn 1: user may not stand here"
    assert problem("user", "assistant", "user") == "it ends after user"
    assert problem("user", None) == "turn 1: None may not stand here"


def test_awkward_conversations(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (2, 0, None, "x"), (2, 0, None, "x"), (3, None, "user", "late"), (3, 5, "tool", "[INST]"), (None, 0, "user", "nobody"), (None, 1, "assistant", "z" * 200000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS kind", "2 AS segment", "3 AS _turn").repartition(3)
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(frame)).collect()}

    def sha(*turns):
        return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()

    assert got[1].turns_sha256 == sha(("user", "hi"), ("assistant", "")) and got[1].loss_chars == 0 and got[1].problem is None
    assert got[2].turns_sha256 == sha(("", "x"), ("", "x")) and got[2].n_turns == 2
    assert got[3].turns_sha256 == sha(("user", "late"), ("tool", "[INST]")) and got[3].loss_chars == 0
    assert got[None].loss_chars == 200000 and got[None].loss_sha256 == hashlib.sha256(b"z" * 200000).hexdigest()
    assert chat.digests(chat.format_chats(frame.limit(0))).count() == 0


def test_one_very_long_conversation(spark):
    rows = spark.range(4000).selectExpr("7L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "concat('</s>', id) AS text")
    (got,) = chat.digests(chat.format_chats(rows)).collect()
    assert got.n_turns == 4000 and got.problem is None
    assert got.loss_sha256 == hashlib.sha256("".join(f"</s>{i}" for i in range(1, 4000, 2)).encode()).hexdigest()


def test_additive_model_finds_effects_and_interactions():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, 4))
    y = (3.0 * (x[:, 0] > 0.3) + 4.0 * (x[:, 1] * x[:, 2] > 0) > 3.5).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    assert (2, 1) in m.pairs
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert quality.fit(x, np.zeros(4000)).score(x[:2]) == pytest.approx([1 / 4002] * 2)


def test_scores_equal_plain_sums_over_the_tables():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 5)).round(1)  # many values on the edges of bins
    m = quality.fit(x, ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.2)).astype(float))
    assert m.pairs
    for row, score in zip(x[:300], m.score(x[:300]), strict=True):
        z = m.bias
        for value, edges, table in zip(row, m.edges, m.tables, strict=True):
            z += table[bisect_right(edges.tolist(), value)]
        for (a, b), table in zip(m.pairs, m.pair_tables, strict=True):
            z += table[bisect_right(m.coarse[a].tolist(), row[a])][bisect_right(m.coarse[b].tolist(), row[b])]
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


def test_query_scores_equal_plain_scores(spark, small):
    docs, labels = read(spark, small, "documents").select("doc_id", "text"), read(spark, small, "labels")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in queries.op3_quality_classifier(spark, small).collect()}
    for r in docs.collect():
        (want,) = model.score(np.array([quality.features(r.text)]))
        assert got[r.doc_id].score == pytest.approx(want) and got[r.doc_id].predicted == (want >= 0.7)
    tox = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, small).collect()}
    for r in docs.collect():
        (want,) = tox.score([tox.measure(r.text, {})])
        assert got[r.doc_id].score == pytest.approx(want) and got[r.doc_id].predicted == (want >= 0.5)


def accuracy(spark, small, out, column, value):
    rows = out.join(read(spark, small, "labels"), "doc_id").where(f"held_out AND {column} IS NOT NULL")
    return rows.agg(F.avg((F.col(value) == F.col(column)).cast("int"))).first()[0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    assert accuracy(spark, sf, queries.op3_quality_classifier(spark, sf), "quality", "predicted") > 0.95
    assert accuracy(spark, sf, queries.op10_toxicity(spark, sf), "toxic", "predicted") > 0.93
    found = queries.op6_language_id(spark, sf).join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


AWKWARD = [(1, None, "en"), (2, "", None), (3, "  \n", "en"), (4, "12 !?", "en"), (5, "the words and the rest of it " * 4000, "en"), (5, "the words", "en"), (5, "the words", "en"), (None, "le mot et la phrase", "fr"), (6, "𝒜 ß é", None), (7, "la phrase et le mot que dans", "fr")]


@pytest.mark.parametrize("labels", [[], [(5, None, None)], [(5, 1, 0), (5, 1, 0), (None, 0, 1), (7, 1, 0)], [(5, 1, 0), (7, 0, 1), (1, 0, 1), (99, 0, 0)]])
def test_awkward_documents(spark, labels):
    docs = spark.createDataFrame(AWKWARD, DDL).selectExpr("*", "1 AS y", "2 AS x", "3 AS k", "'q' AS m")
    known = spark.createDataFrame(labels, LABELS)
    for module, scored in ((quality, quality.with_quality), (toxicity, toxicity.with_toxicity)):
        out = scored(docs, module.train(docs, known)).collect()
        assert len(out) == len(AWKWARD) and all(0 <= r.score <= 1 for r in out)
        assert scored(docs.limit(0), module.train(docs.limit(0), known)).count() == 0


def test_language_of_awkward_documents(spark):
    docs = spark.createDataFrame(AWKWARD, DDL).selectExpr("*", "1 AS bucket", "2 AS n")
    langs, log_p = langid.train(docs)
    assert langs == ["en", "fr"]
    got = {(r.doc_id, r.text): r.language for r in langid.with_language(docs, langs, log_p).collect()}
    assert {got[k].lang_pred for k in ((1, None), (2, ""), (3, "  \n"), (4, "12 !?"))} == {"und"}
    assert got[None, "le mot et la phrase"].lang_pred == "fr" and got[5, "the words"].lang_pred == "en"
    assert all(0 <= v.score <= 1 for v in got.values())
    none = langid.train(docs.where("lang IS NULL"))
    assert {r.language.lang_pred for r in langid.with_language(docs, *none).collect()} == {"und"}


def test_mixtures_are_told_apart():
    rng = random.Random(1)
    kinds = {"a": ["the", "and", "thing", "with"], "b": ["der", "und", "schon", "nicht"], "c": ["le", "que", "pour", "dans"]}
    text = lambda k, n: " ".join(rng.choice(kinds[k]) for _ in range(n))
    counts = np.stack([np.bincount(langid.trigrams(text(k, 5000)), minlength=langid.BUCKETS) for k in kinds]) + langid.ALPHA
    log_p = np.log(counts / counts.sum(1, keepdims=True))
    share = langid.mixture([text("a", 300), text("b", 200) + " " + text("c", 100), "", None, text("a", 90) + " " + text("b", 60) + " " + text("c", 150)], log_p)
    assert share[0, 0] > 0.98 and share[1].argmax() == 1 and 0.5 < share[1, 1] < 0.85 and share[1, 0] == 0
    assert not share[2:4].any() and (share[4] > 0.1).all() and share[4].argmax() == 2


def test_mixtures_equal_plain_expectation_maximisation_over_all_sets():
    rng = random.Random(5)
    kinds = [["the", "and", "thing", "with"], ["der", "und", "schon", "nicht"], ["le", "que", "pour", "dans"], ["el", "los", "pero", "donde"], ["och", "inte", "att", "som"]]
    words = lambda k, n: " ".join(rng.choice(kinds[k]) for _ in range(n))
    counts = np.stack([np.bincount(langid.trigrams(words(k, 4000)), minlength=langid.BUCKETS) for k in range(5)]) + langid.ALPHA
    log_p = np.log(counts / counts.sum(1, keepdims=True))
    texts = [words(0, 50), words(1, 200), *(" ".join(words(k, rng.choice((40, 90))) for k in rng.sample(range(5), size)) for size in (2, 2, 3, 4, 5)), words(3, 1)]
    got = langid.mixture(texts, log_p)
    for text, found in zip(texts, got, strict=True):
        t = langid.trigrams(text)
        best = (-np.inf, None)
        for size in range(1, 6):
            for langs in itertools.combinations(range(5), size):
                pi = dict.fromkeys(langs, 1 / size)
                for _ in range(300):
                    parts = dict.fromkeys(langs, 0.0)
                    for x in t.tolist():
                        weight = {k: pi[k] * np.exp(log_p[k, x]) for k in langs}
                        whole = sum(weight.values())
                        for k in langs:
                            parts[k] += weight[k] / whole / len(t)
                    moved = max(abs(parts[k] - pi[k]) for k in langs)
                    pi = parts
                    if moved < 1e-3:
                        break
                value = sum(np.log(sum(pi[k] * np.exp(log_p[k, x]) for k in langs)) for x in t.tolist())
                value -= (size - 1) * max(langid.PENALTY_SHARE * len(t), langid.PENALTY_LEAST + 0.5 * np.log(len(t)))
                best = max(best, (value, pi), key=lambda b: b[0])
        assert set(np.flatnonzero(found).tolist()) == set(best[1])
        assert all(abs(found[k] - v) < 0.02 for k, v in best[1].items())


def test_disguised_words_are_restored():
    lexicon = {k: 5.0 for w in ("idiot", "moron", "pathetic", "stupid") for k in toxicity.entries(w)}
    m = toxicity.Model(lexicon, toxicity.char_model(toxicity.trigram_counts("the thing and there is nothing in it " * 50).astype(float), ["idiot", "moron", "pathetic", "stupid"]), np.zeros(4))
    for text in ("1d10t", "!d!0t", "i.d.i.o.t", "what an i d i o t!", "(i d i o t)", "idiooot", "m0r0n", "p@th3tic", "$tuppid", "s-t-u-p-i-d", "M O R O N", "(1d10t)", "<stup1d>", "!m0r0n", "you/1d10t", "so-stup1d", "[p@th3tic],"):
        assert m.measure(text, {})[1] > 0, text
    for text in ("the thing", "1 2 3 4 5", "a a a a a", "", None, "there!! is!! nothing!!", "x" * 5000):
        assert m.measure(text, {}) == (0.0, 0), text


def test_decoding_equals_the_best_of_all_lattice_paths():
    m = toxicity.Model({}, toxicity.char_model(toxicity.trigram_counts("idiots will sit on still toast " * 30).astype(float), ["idiot"]), np.zeros(4))

    def paths(token, before=""):
        if not token:
            yield 0.0, ""
            return
        c, rest = token[0], token[1:]
        options = [(c, 0.0)] if c.isalpha() else []
        options += [(x, toxicity.SUBSTITUTE) for x in toxicity.LOOKS.get(c, "")]
        if c == before:
            options.append(("", toxicity.REPEAT))
        elif not c.isalpha():
            options.append(("", toxicity.NOISE_LOOK if c in toxicity.LOOKS else toxicity.NOISE))
        for x, cost in options:
            for p, word in paths(rest, c):
                yield p + cost, x + word

    def spelled(word):
        s = [toxicity.EDGE, toxicity.EDGE, *map(toxicity.symbol, word), toxicity.EDGE]
        return sum(m.log_p[a, b, c] for a, b, c in zip(s, s[1:], s[2:], strict=False))

    rng = random.Random(4)
    for _ in range(300):
        token = "".join(rng.choice("idots1!0.-$77l|aa") for _ in range(rng.randrange(1, 8)))
        best = max(p + spelled(word) for p, word in paths(token))
        word = m.decode(token)
        assert max(p for p, w in paths(token) if w == word) + spelled(word) == pytest.approx(best), token


def test_many_languages_equal_the_search_over_all(monkeypatch):
    """Sixty languages: mixtures found among the likeliest and held against all others are those found among all at once, also of more languages than are looked at first, and without the table of all likelihoods."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = [["".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(6)] for _ in range(60)]
    text = lambda k, n: " ".join(rng.choice(kinds[k]) for _ in range(n))
    counts = np.stack([np.bincount(langid.trigrams(text(k, 2000)), minlength=langid.BUCKETS) for k in range(60)]) + langid.ALPHA
    log_p = np.log(counts / counts.sum(1, keepdims=True))
    texts = [" ".join(text(k, 60) for k in rng.sample(range(60), size)) for size in (1, 1, 2, 3, 5, 9, 12)] + [None, "12", text(3, 1)]
    got = langid.mixture(texts, log_p)
    monkeypatch.setattr(langid, "CELLS", 50_000)
    small = langid.mixture(texts, log_p)
    monkeypatch.setattr(langid, "SLOTS", 100)
    want = langid.mixture(texts, log_p)
    assert np.allclose(got, small, atol=1e-9) and not got[7:9].any()
    assert ((got > 0) == (want > 0)).all() and np.abs(got - want).max() < 0.02
    assert [(row > 0.03).sum() for row in got[:7]] == [1, 1, 2, 3, 5, 9, 12]


def test_counts_of_training_equal_plain_ones(spark):
    docs = spark.createDataFrame([(1, "The cat, the CAT", "en"), (2, "le chat", "fr"), (3, None, "fr"), (4, "x", None), (5, "les chats", "fr"), (6, "1 2", "de")], DDL)
    langs, model = langid.train(docs)
    plain = {}
    for t, lang in (("The cat, the CAT", "en"), ("le chat", "fr"), ("les chats", "fr")):
        for b in langid.trigrams(t).tolist():
            plain.setdefault(lang, {}).setdefault(b, 0)
            plain[lang][b] += 1
    assert langs == sorted(plain)
    every = np.arange(langid.BUCKETS)
    for i, lang in enumerate(langs):
        total = sum(plain[lang].values())
        want = np.array([np.log((plain[lang].get(b, 0) + langid.ALPHA) / (total + langid.ALPHA * langid.BUCKETS)) for b in every.tolist()])
        assert np.allclose(model.logs(np.full((1, len(every)), i), every)[0], want)


def test_thousands_of_languages_and_none(spark):
    """More lang values than any list of languages has give a result; an empty table gives none."""
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} same text", f"l{i}") for i in range(2001)]
    docs = spark.createDataFrame(rows, DDL).repartition(4)
    langs, model = langid.train(docs)
    assert len(langs) == 2001 and model.matrix is None
    some = docs.where("doc_id % 100 = 7")
    found = langid.with_language(some, langs, model).select("lang", "language.lang_pred", "language.score").collect()
    assert len(found) == 20 and all(0 < r.score <= 1 for r in found) and all(r.lang_pred in langs for r in found)
    assert langid.with_language(docs.limit(0), langs, model).count() == 0
    assert langid.with_language(docs.limit(0), *langid.train(docs.limit(0))).count() == 0


def test_features_equal_plain_ones():
    for text in ("Hello WORLD!! 12 $$ a a\nsame line\nsame line\n\nété — ok.", "x", " \t\n", "... !!! ###", "A b. C d! e# 9 9 9"):
        data = text.encode()
        upper, lower, digit = (sum(chr(b) in s for b in data if b < 128) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"))
        shout, other = sum(b in b"!?" for b in data), sum(b >= 128 for b in data)
        marks, feeds = sum(b in b".,;:'\"-" for b in data), data.count(b"\n")
        blanks = sum(b < 128 and chr(b).isspace() for b in data)
        words = text.split()
        n, nb = len(words), len(data)
        if n:
            lines = [x for x in text.split("\n") if x]
            want = [math.log(1 + len(text)), upper / max(upper + lower + other, 1), shout / nb, (nb - upper - lower - digit - shout - other - marks - blanks) / nb, digit / nb, blanks / nb, feeds / nb]
            want += [sum(map(len, words)) / n, len(set(words)) / n, len({(words[i], words[i + 1]) for i in range(n - 1)}) / max(n - 1, 1), max(map(words.count, words)) / n]
            want += [sum(words[i] == words[i + 1] for i in range(n - 1)) / n, sum(w[-1] in "!#$%&*|@^~+=<>" for w in words) / n, sum(not any(c.isalpha() for c in w) for w in words) / n, 1 - len(set(lines)) / max(len(lines), 1)]
            want += [-sum(data.count(b) / nb * math.log2(data.count(b) / nb) for b in set(data)), max(map(len, words)), sum(len(w) <= 3 for w in words) / n, other / nb, marks / n]
        else:
            want = [math.log(1 + len(text))] + [0.0] * (len(quality.NAMES) - 1)
        assert quality.features(text) == pytest.approx(want)


def test_fit_equals_plain_boosting(monkeypatch):
    """Quantile bins, cyclic trees of three leaves and four-leaf pair trees, by loops over rows and cuts."""
    for name, value in {"BINS": 6, "PAIR_BINS": 4, "ROUNDS": 4, "PAIR_ROUNDS": 3, "PAIRS": 2}.items():
        monkeypatch.setattr(quality, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    m = quality.fit(x, y)
    bias = math.log((y.sum() + 1) / (len(y) + 1 - y.sum()))
    z = [bias] * len(y)

    def slopes():
        p = [1 / (1 + math.exp(-v)) for v in z]
        return [t - q for t, q in zip(y, p, strict=True)], [q * (1 - q) for q in p]

    worth = lambda rows, g, h: sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + quality.RIDGE)
    value = lambda rows, g, h: sum(g[i] for i in rows) / (sum(h[i] for i in rows) + quality.RIDGE)
    bin_of = lambda bins, j: [sum(v >= e for e in np.quantile(x[:, j], [k / bins for k in range(1, bins)])) for v in x[:, j]]
    tables = [[0.0] * 6 for _ in range(3)]
    fine, coarse = [bin_of(6, j) for j in range(3)], [bin_of(4, j) for j in range(3)]
    for _ in range(4):
        for j in range(3):
            g, h = slopes()
            leaves = [list(range(6))]
            for _ in range(2):
                rows = lambda some: [i for i in range(len(y)) if fine[j][i] in some]  # noqa: B023, E731
                splits = [(worth(rows(leaf[:c]), g, h) + worth(rows(leaf[c:]), g, h) - worth(rows(leaf), g, h), k, c) for k, leaf in enumerate(leaves) for c in range(1, len(leaf))]
                gain, k, c = max(splits)
                if gain > 1e-9:
                    leaves[k : k + 1] = [leaves[k][:c], leaves[k][c:]]
            for leaf in leaves:
                own = [i for i in range(len(y)) if fine[j][i] in leaf]
                step = quality.RATE * value(own, g, h)
                for b in leaf:
                    tables[j][b] += step
                for i in own:
                    z[i] += step

    def best_pair(a, b, g, h):
        found = []
        for s in range(1, 4):
            for t in range(1, 4):
                parts = [[i for i in range(len(y)) if (coarse[a][i] < s) == u and (coarse[b][i] < t) == v] for u in (True, False) for v in (True, False)]
                found.append((sum(worth(p, g, h) for p in parts) - worth(range(len(y)), g, h), parts))
        return max(found, key=lambda f: f[0])

    g, h = slopes()
    pairs = sorted(((best_pair(a, b, g, h)[0], a, b) for a in range(3) for b in range(a)), reverse=True)[:2]
    for _ in range(3):
        for _, a, b in pairs:
            g, h = slopes()
            for part in best_pair(a, b, g, h)[1]:
                step = quality.RATE * value(part, g, h)
                for i in part:
                    z[i] += step
    assert m.bias == pytest.approx(bias) and m.pairs == [(a, b) for _, a, b in pairs]
    for table, want in zip(m.tables, tables, strict=True):
        assert table.tolist() == pytest.approx(want)
    assert m.score(x).tolist() == pytest.approx([1 / (1 + math.exp(-v)) for v in z])


def test_lexicon_and_counts_equal_plain_ones(spark):
    """Evidence and odds of words and beginnings over labelled texts that are not held out; letter trigrams over all texts."""
    rng = random.Random(9)
    bad, good = ["idiotic", "moron"], ["garden", "window", "paper", "river", "ideal"]
    rows = []
    for i in range(400):
        toxic = i % 3 == 0
        rows.append((i, " ".join([*rng.choices(good, k=6), *(rng.choices(bad, k=1) if toxic else [])]) + rng.choice(["!", "", " Ünd"]), "en"))
    rows += [(None, "moron", "en"), (500, None, "en")]
    docs = spark.createDataFrame(rows, DDL)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(350)], LABELS)
    m = toxicity.train(docs, labels)
    held = {r.doc_id for r in docs.where(toxicity.held_out(F.col("doc_id"))).collect()}
    sets = {0: [], 1: []}
    for i, text, _ in rows:
        if i is not None and i < 350 and i not in held:
            words = {w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split() if 2 < len(w) < 32}
            sets[int(i % 3 == 0)].append({k for w in words for k in ["=" + w, *(w[:n] for n in range(4, 9) if n < len(w))]})
    T, C = len(sets[1]), len(sets[0])
    want = {}
    for k in set().union(*sets[0], *sets[1]):
        t, c = sum(k in s for s in sets[1]), sum(k in s for s in sets[0])
        if t < 3:
            continue
        odds = math.log((t + 0.5) / (T + 1)) - math.log((c + 0.5) / (C + 1))
        p = T / (T + C)
        evidence = 2 * (t * math.log(t / ((t + c) * p)) + (c * math.log(c / ((t + c) * (1 - p))) if c else 0))
        if odds > toxicity.ODDS and evidence > toxicity.EVIDENCE:
            want[k] = odds
    assert set(want) >= {"=moron", "=idiotic", "idio"} and m.lexicon == pytest.approx(want)
    plain = {}
    for _, text, _ in rows:
        signs = [26 if not c.isalpha() else ord(c) - 97 if "a" <= c <= "z" else 27 for c in (text or "").lower()] if text is not None else None
        if signs is not None:
            signs = [26, *signs, 26]
            signs = [s for i, s in enumerate(signs) if i == 0 or s != 26 or signs[i - 1] != 26]
            for t in zip(signs, signs[1:], signs[2:], strict=False):
                plain[t] = plain.get(t, 0) + 1
    counts = toxicity.char_counts(docs).reshape(28, 28, 28)
    assert {t: int(counts[t]) for t in zip(*(v.tolist() for v in np.nonzero(counts)), strict=True)} == plain


def test_tied_turns_do_not_depend_on_partitions(spark):
    rows = [(1, 0, "user", t) for t in ("b", "a", "c", "a")] + [(1, 1, "assistant", "x"), (1, 1, "assistant", "w"), (2, None, "user", "q"), (2, None, "assistant", "r")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [sorted(map(tuple, chat.digests(chat.format_chats(frame.repartition(n))).select("conv_id", "n_turns", "turns_sha256", "loss_sha256").collect())) for n in (1, 3)]
    want = hashlib.sha256(b"".join(f"{r}\n{t}\n".encode() for r, t in [("user", "a"), ("user", "a"), ("user", "b"), ("user", "c"), ("assistant", "w"), ("assistant", "x")])).hexdigest()
    assert got[0] == got[1] and got[0][0][1:3] == (6, want)
