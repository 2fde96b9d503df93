"""Each stage of the pipeline against a brute-force version, on what the stage before kept."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import test_lines
import test_near_copies
import test_packing
from poolwatch.llm import language, lines, mixing, packing

SF_DIR = "/root/testdata/sf0.001"
NAMES = [name for name, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output rows of every stage; a few documents no language explains are added."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    junk = spark.createDataFrame([(900_001, "xqz kjw vvq " * 40, None, "s", 1), (900_002, "123 !!", None, None, 1), (900_003, None, None, "s", 0)], docs.schema)
    docs = docs.union(junk).cache()
    out, columns = [docs.collect()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
        if name != NAMES[-1]:
            assert docs.columns == columns and [t for _, t in docs.dtypes]
        out.append(docs.collect())
    return dict(zip(NAMES, zip(out, out[1:])))


def test_language_stage(spark, steps):
    before, after = steps["language ID"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {900_001, 900_002, 900_003}
    assert set(after) <= set(before)


def test_line_stage(steps):
    before, after = steps["line dedup"]
    want = {r[0]: r for r in test_lines.brute([(r.doc_id, r.text, r.lang, r.source) for r in before], lines.MIN_SITES)}
    assert len(after) == len(before)
    old = {r.doc_id: r for r in before}
    for r in after:
        assert r.text == want[r.doc_id][3]
        assert r.n_chars == (len(r.text) if want[r.doc_id][2] else old[r.doc_id].n_chars)
        assert (r.lang, r.source) == (old[r.doc_id].lang, old[r.doc_id].source)


def test_near_copy_stage(steps):
    before, after = steps["n-gram Jaccard join"]
    groups = test_near_copies.brute([(r.doc_id, r.text) for r in before])
    assert Counter(after) == Counter(r for r in before if groups[r.doc_id][1] == r.doc_id)


def test_mixing_stage(steps):
    before, after = steps["mixing sources to target weights"]
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r.source] += len(r.text.split())
    for r in after:
        taken[r.source] += len(r.text.split())
    assert set(after) <= set(before) and max(Counter(after).values()) <= mixing.REPEATS
    largest = {s: max(len(r.text.split()) for r in before if r.source == s) for s in sizes}
    for source, target in mixing.targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1


def test_packing_stage(spark, steps):
    before, after = steps["packing"]
    total = sum(len(test_packing.direct(r.text)) for r in before)
    assert sum(r.length for r in after) == total
    full = Counter()
    for r in after:
        full[r.sequence_id] += r.length
    assert all(n == packing.WINDOW for s, n in full.items() if s < max(full)) and sorted(full) == list(range(len(full)))
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_run_is_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 0
    assert language.UNKNOWN == "und" and rows.filter(F.col("length") > packing.WINDOW).isEmpty()
