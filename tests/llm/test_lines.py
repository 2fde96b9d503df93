import random

from poolwatch.llm import lines


def brute(rows, min_sites):
    bare = lambda x: x.strip(" \t\x0b\x0c\r")
    sites = {}
    for _, text, _, source in rows:
        for line in (text or "").split("\n"):
            sites.setdefault(bare(line), set()).add(source)
    bad = {x for x, s in sites.items() if x and len(s) >= min_sites}
    out = []
    for i, text, _, _ in rows:
        all_lines = [] if text is None else text.split("\n")
        kept = [x for x in all_lines if bare(x) not in bad]
        if not any(bare(x) for x in kept):
            kept = all_lines
        out.append((i, len(all_lines), len(all_lines) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=repr)


def answer(df, **how):
    rows = lines.dedup_lines(df, **how).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in rows), key=repr)


def test_against_exact_counts(docs):
    seed = random.Random(3)
    usual = [f"line {i}" for i in range(40)]
    rows = []
    for i in range(300):
        site = seed.choice([f"s{k}" for k in range(14)] + [None])
        picked = [seed.choice([usual[seed.randrange(1 + i % 40)], f"own {seed.random()}", "", "  "]) for _ in range(6)]
        rows.append((i, "\n".join(seed.choice(["", " ", "\t"]) + x for x in picked), "en", site))
    for least in (2, 5, 10, 14):
        assert answer(docs(*rows), min_sites=least) == brute(rows, least)


def test_many_sites_by_sketch(docs):
    rows = [(i, "everywhere\nnear\nseldom" if i < 140 else "everywhere\nnear" if i < 205 else "everywhere", "en", f"site{i}")
            for i in range(1500)]
    for least in (200, 206, 1000):
        assert answer(docs(*rows), min_sites=least) == brute(rows, least)


def test_copies_over_many_sites_stay(docs):
    """Twelve copies over twelve sites are none of this operator's business; their lines in other texts are."""
    rows = [(i, "one line\n\nanother line", "en", f"s{i}") for i in range(12)] + [(20, "one line\nown text", "en", "s0")]
    got = answer(docs(*rows))
    assert got == brute(rows, 10)
    assert {r[3] for r in got} == {"one line\n\nanother line", "own text"}


def test_extra_columns_of_the_same_names(docs):
    df = docs((1, "a\nb", "en", "s")).selectExpr("*", "'given' as n_lines", "'given' as n_removed")
    (row,) = lines.dedup_lines(df).collect()
    assert (row.n_lines, row.n_removed, row.n_chars) == (2, 0, 3)
    (row,) = lines.dedup_lines(df, counts=("x", "y")).collect()
    assert (row.n_lines, row.n_removed, row.x, row.y) == ("given", "given", 2, 0)


def test_edges(docs):
    rows = [
        (1, None, None, "a"), (2, "", None, "b"), (3, "x\n\n x ", "en", None), (4, "x", "en", "a"), (None, "x\ny", "en", "b"),
        (5, "x\r\nz", "en", "a"), (5, "x\r\nz", "en", "a"), (6, "z" * 100_000 + "\n" + "x\n" * 20_000, "en", "c"),
    ]
    assert answer(docs(*rows), min_sites=3) == brute(rows, 3)
    df = docs(*rows)
    assert set(lines.dedup_lines(df).columns) == {*df.columns, "n_lines", "n_removed"}


def test_empty_table(docs):
    assert lines.dedup_lines(docs((1, "a")).filter("false")).count() == 0
