"""Operator 11, benchmark decontamination by a broadcast hash set of normalised n-grams.

The windows of all benchmark items, WINDOW words in a row, are hashed into one sorted set, which goes
to every task with the items' word numbers. A task turns a text into word numbers (0: a word no item
has), looks up the hash of every window, and verifies each hit word by word, so no two windows are
taken for each other. Words inside verified windows are hit; `decontaminate` removes the hit spans,
or the documents that have any.

What is sent at once is bounded: items are dealt into blocks of about BLOCK_BYTES of text by a hash, long
items in overlapping pieces. Documents are scanned once a block, and the answers of several blocks
are merged by document. A benchmark of usual size is one block.

Defined results: words are lower-cased in A-Z alone; an item shorter than a window is one window; an
item or document without words, null or empty, has none; rows of one item_id are one item; a row
without item_id marks words and counts as the item `null`; a null doc_id and repeated rows are
answered like any other; without items nothing is hit; an empty table gives no rows; extra columns
are not read, and `decontaminate` keeps them.
"""

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poolwatch.llm.common import documents, stored

WINDOW = 10
# Text of one block, in expectation: some 3 million windows, 40 bytes each beside their words.
BLOCK_BYTES = 16 << 20
# Words of a piece of a long item.
PIECE_WORDS = 1 << 14
_FILTER_BITS = 22
_ROWS = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
# Upper-case letters become lower-case, and what no word has becomes a blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WORD = re.compile(rb"[^\x20]+")
FOUND = "doc_id long, key long, n_words long, n_hit long, spans array<struct<first:long,last:long>>, items array<string>"


def normalised(text: str | None) -> bytes:
    """The text as bytes, as many as in UTF-8, of which blanks are all that is not in a word."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN)


def words_of(text: str | None) -> list[bytes]:
    return normalised(text).split()


def _hashes(ids: np.ndarray, width: int, seed: int) -> np.ndarray:
    m = max(ids.size - width + 1, 0)
    out = np.full(m, np.uint64(seed), np.uint64)
    for j in range(width):
        out = (out ^ ids[j : j + m]) * _STEP
        out ^= out >> np.uint64(29)
    return out * _MIX


class Windows:
    """Distinct windows of one width: sorted hashes, a place of each in the words of the block, and
    the items that hold it."""

    def __init__(self, width: int, places: np.ndarray, owners: np.ndarray, flat: np.ndarray):
        self.width = width
        rows = np.lib.stride_tricks.sliding_window_view(flat, width)[places]
        _, first, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        self.seed = 1
        while np.unique(hashes := self._hash_rows(rows[first])).size < first.size:
            self.seed += 1  # two windows of one hash: take another hash
        order = np.argsort(hashes)
        self.hashes, self.starts = hashes[order], places[first][order]
        self.quick = np.zeros(1 << _FILTER_BITS, bool)
        self.quick[self._low(self.hashes)] = True
        new = np.empty_like(order)
        new[order] = np.arange(order.size)
        held = np.unique(np.stack([new[which.ravel()], owners], 1), axis=0)
        self.items, self.bounds = held[:, 1], np.searchsorted(held[:, 0], np.arange(first.size + 1))

    def _hash_rows(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), np.uint64(self.seed), np.uint64)
        for j in range(self.width):
            out = (out ^ rows[:, j]) * _STEP
            out ^= out >> np.uint64(29)
        return out * _MIX

    @staticmethod
    def _low(hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - _FILTER_BITS)

    def find(self, ids: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of verified windows among `ids`, and the number of each window."""
        got = _hashes(ids, self.width, self.seed)
        at = np.nonzero(self.quick[self._low(got)])[0]
        number = np.minimum(np.searchsorted(self.hashes, got[at]), self.hashes.size - 1)
        keep = self.hashes[number] == got[at]
        at, number = at[keep], number[keep]
        for j in range(self.width):
            keep = flat[self.starts[number] + j] == ids[at + j]
            at, number = at[keep], number[keep]
        return at, number


class Block:
    """The windows of some benchmark items: rows (item, words)."""

    def __init__(self, rows: list[tuple[str, str]], window: int = WINDOW):
        self.names = sorted({item for item, _ in rows})
        number = {item: i for i, item in enumerate(self.names)}
        self.words: dict[bytes, int] = {}
        flat, places, base = [], {}, 0
        for item, text in rows:
            found = words_of(text)
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in found]
            width = min(window, len(ids))
            if width:
                at = base + np.arange(len(ids) - width + 1)
                places.setdefault(width, []).append((at, np.full(at.size, number[item])))
            flat.append(np.array(ids, np.uint64))
            base += len(ids)
        self.flat = np.concatenate([*flat, np.empty(0, np.uint64)])
        self.kinds = [
            Windows(width, *(np.concatenate(x) for x in zip(*parts)), self.flat) for width, parts in sorted(places.items())
        ]

    def search(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[int]]]:
        """For each text its maximal hit spans (first and last word) and the numbers of its items."""
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        # A 0 behind every text: no window reaches across.
        every = itertools.chain.from_iterable((*t, b" ") for t in texts)
        ids = np.fromiter(map(self.words.get, every, itertools.repeat(0)), np.uint64, int(ends[-1]) if len(texts) else 0)
        steps, items = np.zeros(ids.size + 1, np.int64), [set() for _ in texts]
        for kind in self.kinds:
            at, number = kind.find(ids, self.flat)
            np.add.at(steps, at, 1)
            np.add.at(steps, at + kind.width, -1)
            for doc, n in set(zip(np.searchsorted(ends, at, "right").tolist(), number.tolist())):
                items[doc].update(kind.items[kind.bounds[n] : kind.bounds[n + 1]].tolist())
        covered = np.concatenate([[0], np.cumsum(steps[:-1]) > 0, [0]]).astype(np.int8)
        turns = np.diff(covered)
        spans = [[] for _ in texts]
        for first, after in zip(np.nonzero(turns > 0)[0].tolist(), np.nonzero(turns < 0)[0].tolist()):
            doc = int(np.searchsorted(ends, first, "right"))
            begin = int(ends[doc] - sizes[doc])
            spans[doc].append((first - begin, after - 1 - begin))
        return list(zip(spans, items))


def item_pieces(benchmark: DataFrame, window: int = WINDOW, piece_words: int = PIECE_WORDS) -> DataFrame:
    """(item, words, size): the distinct items' normalised words, long ones in overlapping pieces."""
    plain = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), plain.alias("w"))
    begins = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)), F.lit(piece_words))
    cut = items.filter(F.size("w") > 0).select("item", "w", F.explode(begins).alias("at"))
    return cut.select("item", F.array_join(F.slice("w", F.col("at"), F.lit(piece_words + window - 1)), " ").alias("words")).distinct() \
        .withColumn("size", F.octet_length("words") + F.octet_length("item"))


def blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
    """The blocks in turn; one is on the driver at a time."""
    pieces = stored(item_pieces(benchmark, window), "benchmark")
    total = pieces.agg(F.sum("size")).first()[0] or 0
    n = -(-total // block_bytes) or 1
    mine = F.pmod(F.xxhash64("item", "words"), F.lit(n))
    for b in range(n):
        yield Block([tuple(r) for r in pieces.filter(mine == b).select("item", "words").collect()], window)


def scan(docs: DataFrame, block: Block) -> DataFrame:
    """FOUND for every row; `key` is a hash of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_BYTES

    def run(batches):
        own = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                rows = batch.slice(at, _ROWS)
                texts = [words_of(t) for t in rows.column(2).to_pylist()]
                found = own.search(texts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(map(len, texts), pa.int64()),
                     pa.array([sum(b - a + 1 for a, b in s) for s, _ in found], pa.int64()),
                     pa.array([[{"first": a, "last": b} for a, b in s] for s, _ in found], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                     pa.array([[own.names[i] for i in sorted(x)] for _, x in found], pa.list_(pa.string()))],
                    names=["doc_id", "key", "n_words", "n_hit", "spans", "items"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(run, FOUND)


def _merged(spans: list) -> list[tuple[int, int]]:
    out = []
    for first, last in sorted((s["first"], s["last"]) for s in spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out


def _of_blocks(found: list[DataFrame]) -> DataFrame:
    """Answers of several blocks as one. Rows of equal id and text are equal in each block, so a group
    holds an answer a block, whatever the number of its rows."""
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    same = every.groupBy("doc_id", "key", "n_words").agg(
        (F.count("*") / len(found)).cast("int").alias("copies"),
        F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )

    def run(batches):
        for batch in batches:
            spans = [_merged(s) for s in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), batch.column("n_words"),
                 pa.array([sum(b - a + 1 for a, b in s) for s in spans], pa.int64()),
                 pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                 batch.column("items"), batch.column("copies")],
                names=["doc_id", "key", "n_words", "n_hit", "spans", "items", "copies"])

    merged = same.mapInArrow(run, FOUND + ", copies int")
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, key, n_words, n_hit, spans, items) of every row: the words inside benchmark windows, as
    maximal spans, and the items whose windows occur."""
    found = [scan(docs, block) for block in blocks(benchmark, window, block_bytes)]
    return found[0] if len(found) == 1 else _of_blocks(found)


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the given words and what stands between them."""
    if not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(normalised(text))]
    out, done = [], 0
    for first, last in spans:
        out.append(raw[done : at[first][0]])
        done = at[last][1]
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without hit spans (`remove="spans"`), or without documents that have a hit
    (`remove="documents"`), with all their columns. Blocks are taken out one after the other; a hit
    is what the given text holds, so texts joined by a removal are not searched again."""
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove spans or documents, not {remove!r}")
    at, names = docs.columns.index("text"), docs.columns
    parts = list(blocks(benchmark, window, block_bytes))
    sent = [docs.sparkSession.sparkContext.broadcast(b) for b in parts]  # each bounded by BLOCK_BYTES

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, _ROWS):
                rows = batch.slice(begin, _ROWS)
                texts = rows.column(at).to_pylist()
                words = [words_of(t) for t in texts]
                spans = [[] for _ in texts]
                for block in sent:
                    for own, (new, _) in zip(spans, block.value.search(words)):
                        own.extend({"first": a, "last": b} for a, b in new)
                if remove == "documents":
                    yield rows.filter(pa.array([not s for s in spans], pa.bool_()))
                else:
                    clean = pa.array([without_spans(t, _merged(s)) for t, s in zip(texts, spans)], rows.column(at).type)
                    yield pa.RecordBatch.from_arrays([clean if i == at else rows.column(i) for i in range(len(names))], schema=rows.schema)

    return docs.mapInArrow(run, docs.schema)


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


def op11_decontamination(spark, sf_dir: str) -> DataFrame:
    found = hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
with worded as (
  select 'd' as kind, doc_id as id, row_number() over () as r, text from documents
  union all select 'b', item_id, row_number() over (), text from benchmark
), split as (
  select kind, id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from worded
), items as (
  select id as item, least(len(w), 10) as width, array_to_string(w[i : i + 9], ' ') as s
  from (select id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from split where kind = 'b' and len(w) > 0)
), widths as (select distinct width from items),
places as (
  select id, r, width, i, array_to_string(w[i : i + width - 1], ' ') as s
  from (select id, r, w, width, unnest(range(1, len(w) - width + 2)) as i from split, widths where kind = 'd' and len(w) >= width)
), met as (select distinct r, p.width, i, item from places p join items q on p.s = q.s and p.width = q.width),
words as (select r, count(distinct place) as n from (select r, unnest(range(i, i + width)) as place from met) group by r),
named as (
  select r, count(*) as n, string_agg(item, ',' order by item) as items
  from (select distinct r, coalesce(cast(item as varchar), 'null') as item from met) group by r
)
select id as doc_id, len(w) as n_words, coalesce(words.n, 0) as n_hit, coalesce(named.n, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated
from split left join words using (r) left join named using (r) where kind = 'd'
"""
