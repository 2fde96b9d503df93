import random
import tracemalloc
import zlib

import numpy as np
import pytest

from poolwatch.llm import language


def test_sample_table(spark):
    rows = language.op5_language(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.99 * len(held)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


@pytest.fixture(scope="module")
def model():
    made = language.fit({"xx": ["aba abba baab abab " * 20, "bab aab abba"], "yy": ["cdc dcd ccd dcdc " * 20]})
    language.calibrate(made, {"xx": ["abba aba baab"] * 3, "yy": ["cdc dcdc ccd"] * 3})
    return made


def slow_entropy(model, text, lang):
    """Bits per character by the recursion, one character and n-gram at a time."""
    import numpy as np

    order, i = len(model.keys), model.langs.index(lang)
    points = language.letters(text, order)

    def log2(k, end):
        if k < 0:
            return model.floor
        find = lambda j, a, b: np.nonzero(model.keys[j] == language.grams(points[a:b], b - a)[0])[0]
        at = find(k, end - k, end + 1)
        if at.size:
            return model.logp[k][at[0], i]
        context = find(k - 1, end - k, end) if k else np.empty(0)
        weight = model.back[k][context[0], i] if context.size else 0 if k else model.back[0][0, i]
        return log2(k - 1, end) + weight

    return -sum(log2(order - 1, e) for e in range(order - 1, points.size)) / (points.size - order + 1)


def test_scores_equal_the_recursion(model):
    texts = ["abba cdc", "zebra abab", "Q", "c" * 40, "ab" * 200_000]
    got, size = model.cross_entropies(texts)
    for k in range(4):
        for i, lang in enumerate(model.langs):
            assert got[k, i] == pytest.approx(slow_entropy(model, texts[k], lang), rel=1e-4)
    assert size.tolist() == [9, 11, 2, 41, 400_001]


def test_probabilities_sum_to_one(model):
    import numpy as np

    # After any seen context, the characters seen in either language and one unknown share the whole.
    for context in ["ab", "ba", "cd", "zz"]:
        points = language.letters(context, 4)[:-1]
        known = [32] + [ord(c) for c in "abcd"]
        for i in range(2):
            p = [2.0 ** model.log2(np.append(points, c).astype(np.uint64), 3, np.array([points.size]))[0, i]
                 for c in known + [0x3042]]
            assert sum(p) == pytest.approx(1, abs=0.02)


def test_edges(docs):
    train = [(i, ("aba abba baab " if i % 2 else "cdc dcdc ccd ") * (3 + i % 5), "xx" if i % 2 else "yy", "s") for i in range(80)]
    odd = [(100, None, "xx", "s"), (101, "", "xx", "s"), (102, "12 34 !", None, "s"), (103, "abba", None, None),
           (None, "cdc ccd", "yy", "s"), (104, "qwz hjk vvv " * 30, None, None), (104, "abba " * 50_000, "xx", "s")]
    df = docs(*train, *odd)
    model = language.learn(df)
    rows = language.predict(df, model).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == len(train) + len(odd)
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 and by[i][0].rejected for i in (100, 101, 102))
    assert by[103][0].lang_pred == "xx" and by[None][0].lang_pred == "yy" and not by[None][0].held_out
    assert sorted(r.rejected for r in by[104]) == [False, True]
    kept = language.keep_known(df, model)
    assert kept.columns == df.columns
    assert {100, 101, 102}.isdisjoint(r.doc_id for r in kept.collect())


def test_nothing_to_learn(docs):
    empty = docs((1, "a b c", "en", "s")).filter("false")
    assert language.predict(empty, language.learn(empty)).count() == 0
    unlabelled = docs((1, "a b c", None, "s"))
    assert language.predict(unlabelled, language.learn(unlabelled)).first().lang_pred == "und"


def test_ngrams_of_texts_in_a_row():
    texts = [language.letters(t, 4) for t in ("abcab", "a", "Bca bcA", "cabx")]
    points, ends = np.concatenate(texts), np.cumsum([t.size for t in texts])
    for k in range(1, 5):
        want = {}
        for t in texts:
            for i in range(t.size - k + 1):
                gram = tuple(t[i : i + k].tolist())
                want[gram] = want.get(gram, 0) + 1
        one = lambda gram: int(language.grams(np.array(gram, np.uint64), len(gram))[0]) if gram else 0
        got = list(zip(*(x.tolist() for x in language.ngrams(points.astype(np.uint32), ends, k))))
        assert got == sorted((one(g), n, one(g[:-1]), one(g[1:])) for g, n in want.items())


def test_fitting_holds_ngrams_of_one_language_at_a_time():
    seed = random.Random(1)
    texts = {f"l{i}": ["".join(seed.choices("abcdefgh ", k=20_000)) for _ in range(10)] for i in range(8)}
    language.letters("a", 4)
    tracemalloc.start()
    try:
        language.fit(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    print("bytes a letter", peak / 1_600_000)
    assert peak < 30 * 8 * 10 * 20_000
