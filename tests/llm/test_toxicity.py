import numpy as np
import pytest

from poolwatch.llm import toxicity


def test_held_out_rows(spark):
    """Learned on three quarters of the labels, held against the rest."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    apart = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(4)) == 0
    chain = toxicity.learn(docs, labels.filter(~apart))
    held = docs.join(labels.filter(apart), "doc_id")
    truth = {r.doc_id: r for r in held.collect()}
    rows = toxicity.predict(held, chain).collect()
    toxic = [r.toxic for r in rows if truth[r.doc_id].toxic]
    clean = [r.toxic for r in rows if not truth[r.doc_id].toxic]
    assert np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.02
    assert np.mean([r.low_quality == (truth[r.doc_id].quality == 0) for r in rows]) >= 0.85


def test_logistic_against_plain_gradients():
    seed = np.random.default_rng(1)
    dense = seed.random((60, 5)) < 0.4
    y = (dense[:, 0] | (seed.random(60) < 0.2)).astype(float)
    more = seed.random((60, 1))
    got = toxicity.logistic([np.nonzero(r)[0] for r in dense], more, y, 5, penalty=1.0)
    x = np.hstack([dense, more, np.ones((60, 1))])
    even = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, keep = np.zeros(7), np.array([1.0] * 6 + [1e-3])
    for _ in range(200_000):
        w += 0.01 * (x.T @ (even * (y - 1 / (1 + np.exp(-x @ w)))) - keep * w)
    assert got == pytest.approx(w, abs=1e-2)


def test_chain_feeds_earlier_probabilities():
    sets = [{"bad", f"w{i % 7}"} if i % 2 else {"good", f"w{i % 7}"} for i in range(200)]
    low = np.array([i % 2 for i in range(200)], float)
    chain = toxicity.fit(sets, np.column_stack([low, low]), np.arange(200) % 5)
    assert chain.weights[1].size == chain.weights[0].size + 1 and chain.weights[1][-2] > 0
    p = chain.probabilities([{"bad"}, {"good"}, set()])
    assert p[0, 1] > 0.9 and p[1, 1] < 0.1


def test_edges(docs, spark):
    rows = [(i, "nasty words here" if i % 2 else "kind words here") for i in range(40)]
    odd = [(100, None), (101, ""), (102, "...!!!"), (None, "nasty words"), (103, "nasty " * 50_000), (103, "nasty " * 50_000)]
    df = docs(*rows, *odd)
    labels = spark.createDataFrame(
        [(i, 1 - i % 2, i % 2) for i in range(40)] + [(0, 1, 0), (None, 0, 1), (41, None, 1), (42, 1, None), (99, 0, 1)],
        "doc_id long, quality long, toxic long",
    )
    got = toxicity.predict(df, toxicity.learn(df, labels)).collect()
    assert len(got) == 46
    by = {r.doc_id: r for r in got}
    assert by[103].toxic and by[None].toxic and not by[0].toxic
    assert by[100].toxic_score == by[101].toxic_score == by[102].toxic_score
    none = toxicity.predict(df, toxicity.learn(df, labels.filter("false"))).collect()
    assert {r.toxic_score for r in none} == {0.0}
    assert toxicity.predict(df.filter("false"), None).count() == 0
