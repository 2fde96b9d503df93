"""Phrases against a plain count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from poolwatch.llm import collocations

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(docs, least, top, longest=4):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        held = {p: n for p, n in f.items() if n >= least}
        best = []
        for p, a in held.items():
            if len(p) == 1 or any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in held.items()
            ):
                continue
            score, _, l, r = min((2_000_000 * a // (held[p[:k]] + held[p[k:]]), k, held[p[:k]], held[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def answer(df, least, top, **how):
    return sorted(tuple(r) for r in collocations.collocations(df, least, top, **how).collect())


def table(seed, words=30, size=60):
    pick = random.Random(seed)
    names = ["e", "É", "A b", "c\td", "x ", "the", "\x0b", "\x1c", "y-z", *(f"w{k}" for k in range(words))]
    text = lambda: "".join(names[int(len(names) * pick.random() ** 2)] + pick.choice([" "] * 6 + [", ", ".", "\n", "  ", "\r", " "]) for _ in range(size))
    rows = [(i, text(), pick.choice(["en", "en", "de", None])) for i in range(80)]
    return [*rows, rows[0], (0, None, "en"), (1, "", "de"), (None, "a a a a a a, a", "only"), (2, "und und", "und")]


@pytest.mark.parametrize("how", [{}, {"ranked": 4, "bits": 24}, {"ranked": 9, "bits": 3}, {"ranked": 0, "bits": 10}])
def test_against_plain_count(docs, how):
    """Also with most words, pairs and triples beyond the ranked ones, and a filter that lets all pass."""
    rows = table(1)
    want = brute(rows, 3, 25)
    assert len(want) > 50
    assert answer(docs(*[(*r, "s") for r in rows]), 3, 25, **how) == want


def test_longest(docs):
    rows = table(2, words=3)
    for longest in (2, 3):
        assert answer(docs(*[(*r, "s") for r in rows]), 5, 1000, longest=longest) == brute(rows, 5, 1000, longest)


def test_edges(docs):
    df = docs((1, "a b a b", "en", "s"), (2, None, None, None))
    assert answer(df, 3, 10) == []
    assert answer(df.filter("false"), 1, 10) == []
    word = "q" * 100_000
    rows = [(1, f"{word} z {word} z {word} z", None), (2, "é" * 40 + " z", None)]
    for ranked in (1, 100):
        assert answer(docs(*[(*r, "s") for r in rows]), 2, 10, ranked=ranked) == brute(rows, 2, 10)
    long = [(1, "a b " * 300_000, "en")]
    assert answer(docs((*long[0], "s")), 30, 10) == brute(long, 30, 10)


def test_cells_by_tile_and_by_list():
    seed = np.random.default_rng(5)
    counts, want = collocations.Counts(), Counter()
    for _ in range(4):
        left, right = (seed.choice([-7, 0, 1, 255, 256, 257, 2047, 2048, 2049, 1 << 40], 3000) for _ in range(2))
        counts.add(left, right)
        want.update((int(a), int(b)) for a, b in zip(left, right) if a and b)
    got = Counter()
    for batch in counts.cells():
        got.update({(a, b): n for a, b, n in zip(*(batch.column(i).to_pylist() for i in range(3)))})
    side, blocks = collocations.SIDE, collocations.BLOCKS
    assert all(max(c) > side * blocks or min(c) < 0 for c in got)
    for batch in counts.tiles(0):
        tile = batch.column("tile")[0].as_py()
        part = np.frombuffer(collocations.zlib.decompress(batch.column("counts")[0].as_py()), np.int64)
        for cell in np.nonzero(part)[0].tolist():
            got[tile // blocks * side + cell // side + 1, tile % blocks * side + cell % side + 1] += int(part[cell])
    assert got == want


def test_cells_are_passed_on_when_there_are_many(monkeypatch):
    monkeypatch.setattr(collocations, "KEPT_CELLS", 100)
    counts, got = collocations.Counts(), Counter()
    for k in range(50):
        counts.add(np.arange(3000, 3040) + k, np.full(40, 5000))
        if counts.full():
            for batch in counts.cells():
                got.update(dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())))
    for batch in counts.cells():
        got.update(dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())))
    assert got == Counter(3000 + k + j for k in range(50) for j in range(40))
