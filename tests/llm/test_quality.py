import math
import random
import re

import pytest
import regex
import xxhash

from poolwatch.llm import quality


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def word_hash(w, seed=42):
    return signed(xxhash.xxh64_intdigest(w.encode(), seed=seed))


def hashed_pair(a, b):
    first = xxhash.xxh64_intdigest((a % (1 << 64)).to_bytes(8, "little"), seed=42)
    return signed(xxhash.xxh64_intdigest((b % (1 << 64)).to_bytes(8, "little"), seed=first))


def buckets(text, n):
    h = [word_hash(w) for w in regex.findall(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+", (text or "").lower())]
    return [x % n for x in h] + [hashed_pair(a, b) % n for a, b in zip(h, h[1:])]


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
    if seen is None:
        from collections import Counter

        count = Counter(windows)
        seen = {w for w in count if count[w] > 1}
    covered = {j for i, w in enumerate(windows) if w in seen for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def brute(rows, trusted, n, threshold):
    raw, target = [quality.PRIOR] * n, [quality.PRIOR] * n
    any_trusted = False
    for i, text in rows:
        for b in buckets(text, n):
            raw[b] += 1
            if i is not None and i in trusted:
                target[b] += 1
                any_trusted = True
    ratio = [math.log(t / sum(target)) - math.log(r / sum(raw)) if any_trusted else 0 for t, r in zip(target, raw)]
    out = []
    for i, text in rows:
        m, b = measures(text), buckets(text, n)
        mean = sum(ratio[x] for x in b) / len(b) if b else 0.0
        failed = m[0] < 10 or 100 * m[4] > 20 * m[0]
        out.append((i, *m, failed, mean))
    return sorted(out, key=str)


def answer(df, trusted, n):
    rows = quality.quality(df, trusted, n_buckets=n).collect()
    return sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.ratio, r.kept)
                   for r in rows], key=str)


def same(df, rows, trusted_df, trusted, n):
    got, want = answer(df, trusted_df, n), brute(rows, trusted, n, quality.THRESHOLD)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:7] == w[:7], (g, w)
        assert g[7] == pytest.approx(w[7], abs=2e-5)
        if abs(w[7] - quality.THRESHOLD) > 1e-4:
            assert g[8] == (not w[6] and w[7] >= quality.THRESHOLD)


def test_sample_table(spark, small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").filter("quality = 1 and toxic = 0")
    same(small, rows, labels, {r.doc_id for r in labels.collect()}, 997)


def test_edges(docs, spark):
    seed = random.Random(5)
    phrase = "one two three four five six"
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "a b c d e"), (5, "a b c d e a b c d e"), (6, "x x x x x x x x x x x x"),
        (7, f"{phrase}. {phrase}. other words here {phrase}."), (8, "# $ %\n# $ %\n\n \n# $ %"), (9, "l\r\nl\nl\r\n"),
        (10, " ".join(seed.choice("abc") for _ in range(500))), (11, ("w" * 50 + " ") * 8000),
        (None, "no id but some words in a row to be counted here"), (12, "repeat me"), (12, "repeat me"), (13, "ünï 日本 🙂🙂 x\x0by\x0cz"),
        (14, " ".join(str(i) for i in range(20_000))),
    ]
    trusted = spark.createDataFrame([(14,), (14,), (13,), (None,), (99,)], "doc_id long")
    same(docs(*rows), rows, trusted, {13, 14}, 101)


def test_nothing_trusted(docs, spark):
    none = spark.createDataFrame([], "doc_id long")
    rows = [(1, "words " * 3), (2, "these are ten words that stand in one row here")]
    same(docs(*rows), rows, none, set(), 11)
    assert quality.quality(docs(*rows).filter("false"), none).count() == 0
