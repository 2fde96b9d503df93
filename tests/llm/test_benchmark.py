"""Benchmark decontamination against a plain search."""

import hashlib
import random
import re

import pytest

from poolwatch.llm import benchmark

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id long, items string, words string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for item, its in items:
            p = words(its)
            k = min(window, len(p))
            for a in range(len(p) - k + 1) if k else ():
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == p[a : a + k]:
                        hit.update(range(b, b + k))
                        names.add("null" if item is None else str(item))
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=repr)


def answer(docs, items, **how):
    rows = benchmark.hits(docs, items, **how).collect()
    for r in rows:
        assert sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_hit
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in rows), key=repr)


def tables(seed):
    pick = random.Random(seed)
    text = lambda n: "".join(pick.choice(["a", "B", "é", "İ", "x9", "ein"]) + pick.choice([" ", ", ", "\n", "—-", "'"]) for _ in range(n))
    items = [(k, text(pick.randrange(0, 9))) for k in range(12)] + [(3, text(6)), (None, text(4)), (20, None), (21, ""), (22, "..")]
    docs = [(k, text(pick.randrange(0, 60))) for k in range(60)] + [(70, None), (71, ""), (None, text(30)), (5, "a a a a"), (5, "a a a a")]
    return docs, items


@pytest.mark.parametrize("window, block_bytes", [(4, 1 << 24), (3, 1 << 24), (4, 20), (2, 7)])
def test_against_plain_search(docs, rows, window, block_bytes):
    texts, items = tables(window)
    given = rows(ITEMS, *[(i, t, 1, "x", "y") for i, t in items])
    assert answer(docs(*texts), given, window=window, block_bytes=block_bytes) == brute(texts, items, window)


def test_long_items_in_pieces(docs, rows):
    long = " ".join(f"w{i % 97} v{i % 89}" for i in range(3000))
    items = rows(ITEMS, (1, long, 1, "", ""), (1, long, 1, "", ""))
    pieces = benchmark.item_pieces(items, 10, 500).collect()
    assert len(pieces) == 12 and max(len(p["words"].split()) for p in pieces) == 509
    inside = " ".join(long.split()[495:515])
    texts = [(1, f"no {inside} no"), (2, long), (3, " ".join(long.split()[100:109]))]
    assert answer(docs(*texts), items) == [(1, 22, 20, ["1"]), (2, 6000, 6000, ["1"]), (3, 9, 0, [])]


def test_spans_and_documents_go(docs, rows):
    items = rows(ITEMS, (1, "one TWO three", 0, "", ""), (2, "four", 0, "", ""))
    texts = [(1, "Keep — one, two\nthree, é four! end"), (2, "one two"), (3, None), (4, "four"), (None, "FOUR. Go on")]
    df = docs(*texts)
    for block_bytes in (1 << 24, 5):
        got = benchmark.decontaminate(df, items, block_bytes=block_bytes)
        assert got.schema == df.schema
        clean = {r.doc_id: r.text for r in got.collect()}
        assert clean == {1: "Keep — , é ! end", 2: "one two", 3: None, 4: "", None: ". Go on"}
        left = benchmark.decontaminate(df, items, "documents", block_bytes=block_bytes).collect()
        assert {r.doc_id for r in left} == {2, 3}
    with pytest.raises(ValueError):
        benchmark.decontaminate(df, items, "lines")


def test_empty_tables_and_long_texts(docs, rows):
    none = rows(ITEMS)
    assert answer(docs((1, "a b"), (2, None)), none) == [(1, 2, 0, []), (2, 0, 0, [])]
    some = rows(ITEMS, (1, "x " * 12, 0, "", ""))
    assert answer(docs((1, "a")).filter("false"), some) == []
    assert answer(docs((1, "x " * 200_000 + "y " * 50_000)), some) == [(1, 250_000, 200_000, ["1"])]


def test_windows_of_one_hash_stay_apart(monkeypatch):
    """The set takes another hash where two windows share one."""
    plain = benchmark.Windows._hash_rows

    def poor(self, some):
        got = plain(self, some)
        return got if self.seed > 2 else got & benchmark.np.uint64(1)

    monkeypatch.setattr(benchmark.Windows, "_hash_rows", poor)
    block = benchmark.Block([("1", "a b c d e")], 2)
    assert block.kinds[0].seed == 3
    assert block.search([[b"a", b"b"], [b"b", b"a"], [b"x", b"d", b"e"]]) == [([(0, 1)], {0}), ([], set()), ([(1, 2)], {0})]


def test_query_names_items_by_digest(spark):
    rows = benchmark.op11_decontamination(spark, "/root/testdata/sf0.001").collect()
    assert {r.items_sha256 for r in rows if not r.n_items} == {hashlib.sha256(b"").hexdigest()}
    assert all(r.contaminated == (r.n_hit > 0) == (r.n_items > 0) for r in rows)
