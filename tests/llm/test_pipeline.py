"""Each stage of the pipeline against a brute-force version of it, on all that the stage before kept."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import pieces, quality
from lamina.llm.common import materialise, read

sp = pytest.importorskip("sentencepiece")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def planted(spark, small, tmp_path_factory):
    """The smallest tables with copies, near copies and test items planted in documents of their own."""
    rng = random.Random(3)
    docs = [tuple(r) for r in read(spark, small, "documents").collect()]
    good = [d for d in docs if len(words(d[1])) > 150][:20]
    items = [r.text for r in read(spark, small, "benchmark").collect()]
    new = [(10_000 + i, d[1].upper() if i % 2 else d[1], d[2], d[3], d[4]) for i, d in enumerate(good[:6])]
    for i, d in enumerate(good[6:14]):
        w = d[1].split(" ")
        w[rng.randrange(len(w))] = "edited"
        new.append((20_000 + i, " ".join(w), d[2], d[3], d[4]))
    new += [(30_000 + i, f"{d[1]} {items[i]}", d[2], d[3], d[4]) for i, d in enumerate(good[14:])]
    new += [(40_000, None, None, None, None), (40_001, "", "en", "x", 0), new[0]]
    root = tmp_path_factory.mktemp("planted")
    schema = read(spark, small, "documents").schema
    spark.createDataFrame(docs + new, schema).repartition(4).write.parquet(f"{root}/documents.parquet")
    for t in ("labels", "benchmark"):
        read(spark, small, t).write.parquet(f"{root}/{t}.parquet")
    return str(root)


def test_stages(spark, planted, tmp_path):
    docs = read(spark, planted, "documents")
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], planted).write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
        if i < 4:
            assert tables[-1].columns == docs.columns
    rows = [[tuple(r) for r in t.collect()] for t in tables]

    model = quality.train(docs, read(spark, planted, "labels"))
    score = model.score(np.array([quality.features(r[1]) for r in rows[0]]))
    assert sorted(map(str, rows[1])) == sorted(str(r) for r, s in zip(rows[0], score, strict=True) if s >= 0.7)

    by = {}
    for r in rows[1]:
        by[lower(r[1])] = max(by.get(lower(r[1]), -1), r[0])
    assert sorted((r[0], lower(r[1])) for r in rows[2]) == sorted((i, t) for t, i in by.items())

    sets = {r[0]: shingles(r[1]) for r in rows[2]}
    parent = {i: i for i in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(r[0] for r in rows[3]) == sorted(i for i in sets if find(i) == i)

    items = [shingles(r.text) for r in read(spark, planted, "benchmark").collect()]
    clean = [r[0] for r in rows[3] if not any(5 * len(i & sets[r[0]]) >= 4 * len(i) for i in items)]
    assert sorted(r[0] for r in rows[4]) == sorted(clean)
    assert not any(i // 10_000 == 3 for i in clean)

    library = sp.SentencePieceProcessor(model_file=pieces.MODEL)
    text = {r[0]: r[1] or "" for r in rows[4]}
    assert sorted((i, ids, n, sha) for i, ids, n, sha in rows[5]) == sorted((i, library.encode(t), len(library.encode(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in text.items())


def test_run_equals_stages(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"] and 0 < out.count() <= read(spark, small, "documents").count()


def test_empty_documents(spark, small):
    docs = read(spark, small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0


def test_any_column_names(spark, small):
    """Names with a backtick or a dot, the longest one too, and names that the operators use themselves."""
    extra = {"a`b": 1, "x.y": 2, "`the longest.name of all`": 3, "row": 4, "own_id": 5, "key_sha": 6, "gone_id": 7, "text_hash": 8, "score": 9, "lost": 10}
    docs = read(spark, small, "documents")
    for name, value in extra.items():
        docs = docs.withColumn(name, F.lit(value))
    plain = read(spark, small, "documents")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs, plain = stage(spark, docs, small), stage(spark, plain, small)
        if i < 4:
            docs, plain = materialise(docs, "named"), materialise(plain, "plain")
            assert sorted(docs.columns) == sorted([*plain.columns, *extra])
            assert {tuple(r[c] for c in extra) for r in docs.collect()} == {tuple(extra.values())}
        assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(r.doc_id for r in plain.select("doc_id").collect())


def most_python_nodes(node):
    """Of Python operators that a task has at once: those on one path without an exchange between."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return most_python_nodes(node.initialPlan())
    children = node.children()
    below = [most_python_nodes(children.apply(i)) for i in range(children.size())]
    here = max((n for n, _ in below), default=0) + any(x in name for x in ("Python", "Pandas", "Arrow"))
    return (0 if "Exchange" in name else here), max([here, *(m for _, m in below)])


@pytest.mark.parametrize("rows", [1, 1000])
def test_one_python_process_a_task_for_tokens(spark, small, rows):
    """Ids that were encoded in one process and decoded in another took two vocabularies for each task."""
    docs = read(spark, small, "documents").limit(rows)
    out = corpus_pipeline.tokens(spark, docs, small)
    assert most_python_nodes(out._jdf.queryExecution().executedPlan())[1] == 1
