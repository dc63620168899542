"""The classifier chain's held-out accuracy, and the pipeline stage by stage."""

import collections
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from loomdoc.llm import toxicity
from loomdoc.llm.common import materialize
from loomdoc.llm.queries import ORACLE, QUERIES

from . import cases

SF = "/root/testdata/sf0.01"
INSULTS = "vile rotten hateful".split()


def corpus(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words, toxic, low = cases.prose(rng, 60).split(), rng.random() < 0.2, rng.random() < 0.3
        if toxic:
            for w in rng.choices(INSULTS, k=3):
                words.insert(rng.randrange(60), w + rng.choice(["", ",", "."]))
        if low:
            words += ["zzz"] * 2
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(not low), int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(900, 1)
    table = spark.createDataFrame([x for x in labels if x[0] % 3] + [(1, None, 1), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(cases.frame(spark, clashes=True, rows=docs), table).collect()}
    wrong = [i for i, _, t in labels if i % 3 == 0 and got[i].toxic != bool(t)]
    assert len(wrong) <= 2
    assert sum((got[i].p_low_quality > 0.5) != (not q) for i, q, _ in labels if i % 3 == 0) <= 6
    assert all(r.kept != r.toxic for r in got.values())


def test_odd_tables(spark):
    docs, labels = corpus(60, 2)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_class = spark.createDataFrame([(i, q, 0) for i, q, _ in labels], "doc_id long, quality int, toxic int")
    odd = cases.frame(spark, clashes=True)
    for table in (none, one_class):
        chain = toxicity.train(cases.frame(spark, rows=docs), table)
        assert toxicity.score(odd, chain).where("toxic").count() == 0
        left = toxicity.drop_toxic(odd, chain)
        assert left.columns == odd.columns and left.count() == odd.count()
        assert toxicity.score(cases.empty(spark), chain).count() == 0


def test_the_later_model_uses_the_earlier_one():
    texts = [{b"x"} if i % 2 else {b"y"} for i in range(200)]
    import numpy as np

    labels = np.array([[i % 2, i % 2] for i in range(200)])
    chain = toxicity.fit_chain(texts, labels, np.arange(200) % 5, ["first", "second"], 10)
    assert chain.models[1].earlier[0] > 0 and chain.odds("x")[1] > chain.threshold > chain.odds("y")[1]


def test_chain_against_brute_force(spark):
    """Out-of-fold probabilities fold by fold, then every document's probabilities by their formulas."""
    import math

    import numpy as np

    docs, labels = corpus(300, 7)
    texts = [toxicity.words_of(t) for _, t, *_ in docs]
    y = np.array([[1 - q, t] for _, q, t in labels])
    folds = np.arange(300) % 3
    chain = toxicity.fit_chain(texts, y, folds, ["low_quality", "toxic"], 50)
    bags, none = toxicity.Bags(texts), np.zeros((300, 0), np.float32)

    def p_of(model, words, earlier):
        z = model.bias + sum(w for word, w in model.words.items() if word in words) + sum(a * b for a, b in zip(model.earlier, earlier))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    first = [0.0] * 300
    for k in range(3):
        model = toxicity.fit_linear(bags, folds != k, none, y[:, 0].astype(np.float32), 50)
        for i in np.flatnonzero(folds == k):
            first[i] = p_of(model, texts[i], [])
    want = toxicity.fit_linear(bags, np.ones(300, bool), np.array(first, np.float32)[:, None], y[:, 1].astype(np.float32), 50)
    got = chain.models[1]
    assert got.words.keys() == want.words.keys() and got.bias == pytest.approx(want.bias, abs=1e-3) and got.earlier == pytest.approx(want.earlier, abs=1e-3)
    assert all(got.words[w] == pytest.approx(want.words[w], abs=1e-3) for w in want.words)
    odd = [r for r in cases.documents() if r[0] is not None and r[0] not in (11, 12)]
    for i, text, *_ in docs[:80] + odd:
        words = toxicity.words_of(text)
        p1 = p_of(chain.models[0], words, [])
        p2 = p_of(chain.models[1], words, [p1])
        assert toxicity.sigmoid(np.array(chain.odds(text))) == pytest.approx([p1, p2])
    scored = {r.doc_id: r for r in toxicity.score(cases.frame(spark, rows=docs), chain).collect()}
    for i, text, *_ in docs:
        odds = chain.odds(text)
        assert (scored[i].toxic, scored[i].kept) == (odds[1] > chain.threshold, odds[1] <= chain.threshold)
        assert (scored[i].p_low_quality, scored[i].p_toxic) == pytest.approx(tuple(toxicity.sigmoid(np.array(odds))))


def test_repeated_and_large_rows_are_dropped_before_they_are_sent(spark):
    docs, labels = corpus(120, 4)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once, often = cases.frame(spark, rows=docs), cases.frame(spark, rows=docs + docs[:1] * 500)
    assert toxicity.train(once, table) == toxicity.train(often, table)
    none = toxicity.train(once, table, max_train_bytes=10)
    assert none.threshold == float("inf")


def test_threshold():
    import numpy as np

    assert toxicity.best_threshold(np.array([3.0, 2.0, 1.0, 0.0]), np.array([1.0, 1.0, 0.0, 0.0])) == 1.5
    assert toxicity.best_threshold(np.array([1.0, 1.0]), np.array([0.0, 0.0])) == float("inf")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_native_memory_that_is_free_leaves_the_driver(spark):
    def held():
        pid = spark._jvm.java.lang.ProcessHandle.current().pid()
        with open(f"/proc/{pid}/status") as f:
            return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) / 1024

    materialize(spark.range(10), "before")
    buffers = [spark._jvm.java.util.zip.Deflater() for _ in range(2000)]  # some 100 KB each, not on the heap
    for b in buffers[:-1]:
        b.end()
    most = held()
    materialize(spark.range(10), "after")
    assert held() < most - 80


def test_pipeline(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs.toPandas()]
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns
        seen.append(docs.toPandas())
    start, clean, exact, near, mixed = seen
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    toxic = set(labels.doc_id[labels.toxic == 1])
    gone = set(start.doc_id) - set(clean.doc_id)
    assert len(toxic - gone) <= 0.15 * len(toxic) and len(gone & set(labels.doc_id[labels.toxic == 0])) <= 8
    first = {}
    for i, t in sorted(zip(clean.doc_id, clean.text)):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t), i)
    assert sorted(exact.doc_id) == sorted(first.values())
    assert set(near.doc_id) <= set(exact.doc_id)
    sets = {i: {" ".join(t.lower().split()[k : k + 5]) for k in range(max(len(t.split()) - 4, 1))} for i, t in zip(exact.doc_id, exact.text)}
    index = collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            index[x].add(i)
    for i in set(exact.doc_id) - set(near.doc_id):
        others = {j for x in sets[i] for j in index[x]} - {i}
        assert any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in others)
    assert max(collections.Counter(mixed.doc_id).values()) <= 2 and set(mixed.doc_id) <= set(near.doc_id)
    packed = cp.STAGES[-1][1](spark, docs, SF).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert packed.where("n > 1024").count() == 0
    assert cp.ORACLE_SQL is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(map(tuple, got[order].to_numpy().tolist()), key=repr) == sorted(map(tuple, want[order].to_numpy().tolist()), key=repr)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
