"""The trie of rebuilt conversations against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from poolwatch.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth long, p1 string, start string"


def brute(rows):
    given = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            given[c].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in given.items()}
    members, full = defaultdict(list), {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        full[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    out = []
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        ended = sorted(c for c in ids if len(full[c]) == len(node))
        out.append((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids),
            sum(len(m) == len(node) + 1 for m in below), len(leaves),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
            hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest(),
        ))
    return sorted(out)


def answer(df, **how):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in prefix_trie.prefix_trie(df, **how).select(names).collect())


def made(seed, convs=40, most=12, texts=("hi", "é", "", None, "hi there")):
    pick = random.Random(seed)
    rows = []
    for c in [*range(-6, convs), 10**12]:
        for turn in range(pick.randrange(1, most)):
            if pick.random() < 0.9:
                rows.append((c, pick.choice([turn, turn, turn, turn // 2, None]), pick.choice(["user", None, "a"]), pick.choice(texts)))
    return rows


@pytest.fixture
def table(rows):
    return lambda given: rows(TURNS, *[(*r, 5, "x", "y") for r in given])


@pytest.mark.parametrize("few", [10_000, 3])
def test_against_plain_trie(table, few):
    rows = made(few)
    rows += [rows[0]] * 5 + [(None, 1, "user", "x")]
    assert answer(table(rows), few=few) == brute(rows)


def test_long_runs_are_cut(table, monkeypatch):
    for name, value in (("CHUNK", 4), ("RUN", 3), ("PARTS", 7)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = made(8, 12, 6, ("x",)) + [(7, k, "u", "y" * (k % 3)) for k in range(60)] + [(8, k, "u", "y" * (k % 3)) for k in range(50)]
    rows += [(9, 3, "u", "same")] * 30
    assert answer(table(rows), few=4) == brute(rows)


def test_one_common_conversation(table):
    rows = [(c, k, "u", f"t{k}") for c in range(0, 300) for k in range(3)] + [(c, 0, "u", f"own{c}") for c in range(300, 400)]
    assert answer(table(rows), few=20) == brute(rows)


def test_edges(table):
    assert answer(table([])) == []
    assert answer(table([(None, 1, "user", "x")])) == []
    lone = [(4, None, None, None)]
    assert answer(table(lone)) == brute(lone)
    rows = [(1, 1, "u", "long " * 200_000), (2, 1, "u", "long " * 200_000)]
    assert answer(table(rows)) == brute(rows)


def test_ranks_of_any_list(spark):
    pick = random.Random(3)
    ids = [(pick.randrange(5), k) for k in range(500)]
    pick.shuffle(ids)
    weight = {i: pick.randrange(4) for i in ids}
    rows = [(*i, *(n or (None, None)), weight[i]) for i, n in zip(ids, [*ids[1:], None])]
    df = spark.createDataFrame(rows, "a long, b long, na long, nb long, w long")
    got = {(r.a, r.b): r.start for r in prefix_trie.list_ranks(df, 10).collect()}
    upto = 0
    for i in ids:
        assert got[i] == upto
        upto += weight[i]
    ring = df.withColumn("na", F.coalesce("na", F.lit(ids[0][0]))).withColumn("nb", F.coalesce("nb", F.lit(ids[0][1])))
    with pytest.raises(RuntimeError):
        prefix_trie.list_ranks(ring, 10)
