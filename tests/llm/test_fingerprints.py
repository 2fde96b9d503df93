import hashlib
import math
import re

import pytest
import xxhash

from poolwatch.llm import fingerprints as fp


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def h_text(t, seed=42):
    return signed(xxhash.xxh64_intdigest(t.encode(), seed=seed))


def h_longs(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), seed=seed)
    return signed(seed)


def terms(text):
    return {w for w in re.split(fp.TERM, text.lower()) if w}


def seeded(t, d):
    """Spark hashes a long and then the int beside it."""
    first = xxhash.xxh64_intdigest((h_text(t) % (1 << 64)).to_bytes(8, "little"), seed=42)
    return signed(xxhash.xxh64_intdigest(d.to_bytes(4, "little"), seed=first))


def mark(text, lexicon):
    kept, out = terms(text) & lexicon, []
    if not kept:
        every = sorted(h_text(t) for t in terms(text))
        return ":".join([f"{(h_longs(every) if every else h_text(text)) % (1 << 64):016x}"] * (fp.DRAWS * fp.HALVINGS))
    for d in range(fp.DRAWS):
        ordered = sorted(seeded(t, d) for t in kept)
        for bits in range(1, fp.HALVINGS + 1):
            mask = ((1 << bits) - 1) << bits * (bits - 1) // 2
            held = [x for x in ordered if x & mask == 0]
            out.append(f"{h_longs(held) % (1 << 64):016x}" if held else "-")
    return ":".join(out)


def like(a, b):
    pairs = [(x, y) for x, y in zip(a.split(":"), b.split(":")) if (x, y) != ("-", "-")]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0


def brute(rows, idf):
    rows = [(i, t or "") for i, t in rows]
    df = {}
    for _, t in rows:
        for w in terms(t):
            df[w] = df.get(w, 0) + 1
    lexicon = {w for w, n in df.items() if idf[0] <= math.log(len(rows) / n) <= idf[1]}
    ids = sorted({i for i, _ in rows if i is not None})
    text = {i: min(t for j, t in rows if j == i) for i in ids}
    out = []
    for i, t in rows:
        follow = text[ids[(ids.index(i) + 1) % len(ids)] if i is not None else ids[0]] if ids else None
        half = len(t) // 2
        new = t[: len(t) - half] + (follow or "")[:half]
        a, b = mark(t, lexicon), mark(new, lexicon)
        near_next = like(a, mark(follow, lexicon)) if follow is not None else 0.0
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, like(a, b), near_next))
    return sorted(out, key=str)


def same(df, rows, idf=fp.IDF):
    got = sorted((tuple(r)[:7] for r in fp.imatch(df, idf).collect()), key=str)
    want = brute(rows, idf)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:])


def test_sample_table(small):
    same(small, [(r.doc_id, r.text) for r in small.collect()])


def test_edges(docs):
    rows = [
        (5, "alpha beta gamma"), (9, None), (7, ""), (12, "x"), (30, "é日🙂 ünï " * 3), (31, "Alpha BETA delta 42"),
        (40, "long words here " * 20_000), (40, "a second text of this id"), (12, "x"), (None, "no id"), (50, "alpha beta gamma"),
    ]
    same(docs(*rows), rows, (0.5, 3.0))


@pytest.mark.parametrize("size", [20, 1000])
def test_texts_without_lexicon_terms_are_like_equal_ones_alone(docs, size):
    """With the production band: in a small table no term is rare enough, in a large one these are too rare."""
    rows = [(i, f"w{i // 2}a w{i // 2}b own{i // 2}") for i in range(size - 2)] + [(size, ""), (size + 1, "...")]
    got = {r.doc_id: r for r in fp.imatch(docs(*rows)).collect()}
    assert len({r.fingerprint for r in got.values()}) == (size - 2) // 2 + 2
    assert all(got[i].near_next == (1.0 if i % 2 == 0 else 0.0) for i in range(size - 2))
    assert got[size].near_next == 0.0 and all("-" not in r.fingerprint for r in got.values())
    if size == 20:
        same(docs(*rows), rows)


def test_equal_texts_have_equal_fingerprints(docs):
    rows = [(i, f"shared words and number {i % 3}") for i in range(12)]
    got = fp.imatch(docs(*rows), (0.1, 9.0)).collect()
    by = {}
    for r in got:
        by.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by.values()) and len(set().union(*by.values())) == 3


def test_one_row_and_empty_table(docs):
    same(docs((3, "only one")), [(3, "only one")], (0.0, 1.0))
    same(docs((None, "only one")), [(None, "only one")], (0.0, 1.0))
    assert fp.imatch(docs((1, "a")).filter("false")).count() == 0
