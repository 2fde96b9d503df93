import hashlib
import random

import pytest
from pyspark.sql import functions as F

from poolwatch.llm import mixing


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == pytest.approx({"a": 187.5, "b": 75, "c": 37.5})
    # a stops at 30; the rest is shared 2 : 1 : 5.
    assert mixing.targets({"a": 10, "b": 400, "c": 390, None: 0}) == pytest.approx({"a": 30, "b": 770 * 2 / 3, "c": 770 / 3, None: 0})
    assert mixing.targets({}) == {}


def test_flow_prefers_fewer_repeats():
    sizes = {("a",): 10, ("b",): 10, ("a", "b"): 10}
    assert mixing.min_cost_flow(sizes, {"a": 15, "b": 15}) == {("a",): 10, ("b",): 10, ("a", "b"): 10}
    assert mixing.min_cost_flow(sizes, {"a": 40, "b": 0})[("b",)] == 0
    assert sum(mixing.min_cost_flow(sizes, {"a": 100, "b": 100}).values()) == 90


def close(rows):
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    for (size, target), held in by.items():
        smallest = min(r.size for r in held)
        assert abs(sum(r.taken for r in held) - target) <= max(1, smallest)


def test_sample_table(spark):
    rows = mixing.op10_mixing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert {r.doc_id: r.size for r in rows} == {d.doc_id: len(d.text.split()) for d in docs}
    sizes = {}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + len(d.text.split())
    want = mixing.targets(sizes)
    source = {d.doc_id: d.source for d in docs}
    got = {}
    for r in rows:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        got[source[r.doc_id]] = got.get(source[r.doc_id], 0) + r.taken
    for s, t in want.items():
        assert abs(got[s] - t) <= max(r.size for r in rows if source[r.doc_id] == s) / 2 + 1
    assert sorted(rows) == sorted(mixing.op10_mixing(spark, "/root/testdata/sf0.001").collect())


def test_overlapping_sources(docs):
    seed = random.Random(2)
    rows = [(i, "w " * seed.randint(1, 30), "en", seed.choice(["a", "b", "a b"])) for i in range(400)]
    mixed = mixing.mix(docs(*rows), F.split("source", " ")).collect()
    taken = {}
    for r in mixed:
        assert r.copies <= 3
        taken[tuple(r.members)] = taken.get(tuple(r.members), 0) + r.size * r.copies
    total = sum(r.size for r in mixed)
    assert abs(sum(taken.values()) - total) <= 6


def test_edges(docs):
    df = docs((1, None, "en", "a"), (2, "", "en", None), (3, "x y", "en", None), (None, "z", "en", "b"), (4, "q r s", "en", "b"),
              (4, "q r s", "en", "b"), (5, "long " * 50_000, "en", "a"))
    rows = mixing.mix(df, F.array("source")).collect()
    assert len(rows) == 7 and {r.size for r in rows if r.doc_id in (1, 2)} == {0}
    assert all(r.copies <= 3 for r in rows)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} >= {1, 2}


def test_empty_table(docs):
    assert mixing.mix(docs((1, "a")).filter("false"), F.array("source")).count() == 0


def taken_of(df, **how):
    rows = mixing.mix(df, F.array("source"), **how).collect()
    taken = {}
    for r in rows:
        taken[r.members[0]] = taken.get(r.members[0], 0) + r.size * r.copies
    return taken, {r.members[0]: r.targets[0] for r in rows}


def test_long_document_early_in_the_order(docs):
    """The first document in the seeded order is longer than the rest, and short ones can fill it."""
    ids = sorted(range(400), key=lambda i: hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest())
    rows = [(i, "w " * (10_000 if i == ids[0] else 5000 if i == ids[1] else 1 + i % 20), "en", "a") for i in ids]
    rows.append((1000, "w " * 22_000, "en", "b"))
    taken, wanted = taken_of(docs(*rows), weights=(1, 4))
    assert 8000 < wanted["a"] < 10_000 and abs(taken["a"] - wanted["a"]) <= 1


def test_more_sources_than_patterns_on_the_driver(docs, monkeypatch):
    """Sources alone in their patterns never go through the flow, and their targets are as on the driver."""
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 1)
    seed = random.Random(5)
    rows = [(i, "w " * seed.choice([1, 3, 40, 900]), "en", seed.choice([f"s{k}" for k in range(60)] + [None])) for i in range(300)]
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    _, wanted = taken_of(docs(*rows))
    assert wanted == mixing.targets(sizes)
    with pytest.raises(ValueError):
        mixing.mix(docs((1, "x", "en", "a b"), (2, "y", "en", "b c")), F.split("source", " "))
