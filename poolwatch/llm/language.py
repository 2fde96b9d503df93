"""Operator 5, language ID by interpolated Kneser-Ney character models.

Each language has a character model of order ORDER with one absolute discount per order and
continuation counts below the top. The n-grams of an order lie in one sorted hash array for all
languages, with a row of log probabilities beside it, so a whole text is scored by binary searches
over its characters. The language of lowest cross-entropy per character wins.

Rejection is calibrated on rows kept apart from the counts: the spread of the winner's cross-entropy
there, for the length of the text, sets how far above the usual one a text may lie.

The models are fitted on a bounded sample: rows whose hash lies below a per-language share that
expects SAMPLE documents of each language, never more than 2 * SAMPLE. Every document is predicted
from its whole text.

Defined results: a null text, or one without letters, is `und`, score 0, rejected; with no labelled
rows every text is `und`; a null doc_id is never learned from; repeated rows get equal answers;
extra columns are not read by the query.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poolwatch.llm.common import documents, in_small_batches

ORDER = 4
SAMPLE = 400
HELD_OUT = 2
FOLDS = 4
UNKNOWN = "und"
# Standard deviations above the usual cross-entropy at which a text is rejected.
REJECT = 8.0
# Bits per character more than usual that are always let pass.
SLACK = 1.0
# Characters scored at a time.
PIECE = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)
# Top bits of a hash that point into a sorted array.
_BITS = 18
_PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def letters(text: str, order: int) -> np.ndarray:
    """Code points in lower case, each run of anything but letters as one blank, order - 1 blanks
    before the text and one after it; nothing if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = _letter_table()[points]
    if not plain.any():
        return np.empty(0, np.uint64)
    keep = plain.copy()
    keep[1:] |= plain[:-1]
    inner = np.where(plain, points, np.uint32(32))[keep].astype(np.uint64)
    return np.concatenate([np.full(order - 1, 32), inner, [32] * bool(plain[-1])]).astype(np.uint64)


_table: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _table:
        _table.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _table[0]


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """Hash of each run of `order` characters."""
    m = points.size - order + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    return hashed([points[j : j + m] for j in range(order)])


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    h = columns[0] + np.uint64(len(columns))
    for column in columns[1:]:
        h *= _STEP
        h += column
    h *= _MIX
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h


@dataclass
class Model:
    """`keys[k]`: sorted hashes of the (k+1)-grams of all languages; `logp[k]`: their interpolated
    log2 probability in each language; `back[k]`: log2 of the weight that a context of k characters
    gives to shorter ones; `floor`: log2 probability of a character no language has."""

    langs: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    back: list[np.ndarray]
    floor: float
    usual: np.ndarray = None
    spread: np.ndarray = None
    first: list[np.ndarray] = None
    longest: list[int] = None
    by_lang: list[np.ndarray] = None

    def index(self) -> None:
        """Where the hashes with each value of the top bits begin, and the longest run of them."""
        shift, tops = np.uint64(64 - _BITS), np.arange(1 << _BITS, dtype=np.uint64)
        self.first = [np.searchsorted(k >> shift, tops).astype(np.int32) for k in self.keys]
        self.longest = [int(np.bincount((k >> shift).astype(np.int64)).max()) for k in self.keys]
        self.by_lang = [np.ascontiguousarray(p.T) for p in self.logp]

    def find(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash in the sorted array, and whether it is there."""
        keys, last = self.keys[k], self.keys[k].size - 1
        at = self.first[k][hashes >> np.uint64(64 - _BITS)]
        np.minimum(at, last, out=at)
        seen = keys[at] == hashes
        for _ in range(self.longest[k] - 1):
            open_ = np.nonzero(~seen)[0]
            if not open_.size:
                break
            at[open_] = np.minimum(at[open_] + 1, last)
            seen[open_] = keys[at[open_]] == hashes[open_]
        return at, seen

    def log2(self, points: np.ndarray, k: int, ends: np.ndarray) -> np.ndarray:
        """log2 probability, by language, of the characters at `ends` after the k before them."""
        if k < 0:
            return np.full((ends.size, len(self.langs)), self.floor, np.float32)
        at, seen = self.find(k, hashed([points[ends - k + j] for j in range(k + 1)]))
        out = self.logp[k][at]
        if not seen.all():
            new = ends[~seen]
            lower = self.log2(points, k - 1, new)
            if k:
                found, known = self.find(k - 1, hashed([points[new - k + j] for j in range(k)]))
                lower = lower + np.where(known[:, None], self.back[k][found], 0)
            else:
                lower = lower + self.back[0]
            out[~seen] = lower
        return out

    def bits(self, points: np.ndarray) -> np.ndarray:
        """Bits of every character after the first order - 1, a row per language."""
        order = len(self.keys)
        at, seen = self.find(order - 1, grams(points, order))
        out = np.stack([row.take(at) for row in self.by_lang[-1]])
        new = np.nonzero(~seen)[0]
        if new.size:
            out[:, new] = self.log2(points, order - 1, new + order - 1).T
        return -out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text in each language, and the characters; 0 without letters."""
        order = len(self.keys)
        total, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        pieces, owners, held = [], [], 0

        def flush():
            run = np.concatenate(pieces)
            ends = np.cumsum([p.size for p in pieces])
            begins = np.concatenate([[0], ends[:-1]])
            bits = np.append(self.bits(run), np.zeros((len(self.langs), order)), axis=1)
            cuts = np.stack([begins, ends - order + 1], 1).ravel()
            np.add.at(total, owners, np.add.reduceat(bits, cuts, axis=1, dtype=np.float64)[:, ::2].T)
            pieces.clear()
            owners.clear()

        for i, text in enumerate(texts):
            points = letters(text, order)
            size[i] = max(0, points.size - order + 1)
            for begin in range(0, size[i], PIECE):
                pieces.append(points[begin : begin + PIECE + order - 1])
                owners.append(i)
                held += pieces[-1].size
                if held >= PIECE:
                    flush()
                    held = 0
        if pieces:
            flush()
        return total / np.maximum(size, 1)[:, None], size


def ngrams(points: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct k-grams of texts that stand one after another, up to `ends`; how often each is there,
    and the hashes of its first and its last k - 1 characters."""
    points, inside = points.astype(np.uint64), np.ones(points.size, bool)
    for j in range(1, k):
        inside[ends - j] = False
    begins = np.nonzero(inside)[0]
    found, first, counts = np.unique(grams(points, k)[begins], return_index=True, return_counts=True)
    if k == 1:
        return found, counts, np.zeros_like(found), np.zeros_like(found)
    at = begins[first]
    head, tail = (hashed([points[at + j] for j in range(b, b + k - 1)]) for b in (0, 1))
    return found, counts, head, tail


def fit(texts: dict[str, list[str]], order: int = ORDER) -> Model:
    langs = sorted(texts)
    # The n-grams of one language at a time, for the driver's memory.
    runs = {}
    for x in langs:
        each = [p.astype(np.uint32) for t in texts[x] if (p := letters(t, order)).size]
        runs[x] = np.concatenate([np.empty(0, np.uint32), *each]), np.cumsum([p.size for p in each], dtype=np.int64)
    keys, counts, parts = [], [], []
    for k in range(1, order + 1):
        found = {x: ngrams(*runs[x], k) for x in langs}
        keys.append(np.unique(np.concatenate([found[x][0] for x in langs])))
        counts.append(np.zeros((keys[-1].size, len(langs))))
        head, tail = np.zeros(keys[-1].size, np.uint64), np.zeros(keys[-1].size, np.uint64)
        for i, x in enumerate(langs):
            at = np.searchsorted(keys[-1], found[x][0])
            counts[-1][at, i] = found[x][1]
            head[at], tail[at] = found[x][2:]
        parts.append((head, tail))
    # Below the top order, a count is the number of different characters seen before the n-gram.
    for k in range(order - 1):
        tails, more = parts[k + 1][1], np.zeros_like(counts[k])
        np.add.at(more, np.searchsorted(keys[k], tails), counts[k + 1] > 0)
        counts[k] = np.where(more > 0, more, np.minimum(counts[k], 1))
    floor = -np.log2(max(2.0, keys[0].size + 1.0))
    logp, back, below = [], [], np.full((1, len(langs)), 2.0**floor)
    for k in range(order):
        c = counts[k]
        one, two = (c == 1).sum(0), (c == 2).sum(0)
        discount = np.clip(one / np.maximum(one + 2 * two, 1), 0.1, 0.9)
        head, tail = parts[k]
        if k == 0:
            group, size = np.zeros(len(c), np.int64), 1
            lower = np.repeat(below, len(c), 0)
        else:
            group, size = np.searchsorted(keys[k - 1], head), keys[k - 1].size
            lower = below[np.searchsorted(keys[k - 1], tail)]
        total, kinds = np.zeros((size, len(langs))), np.zeros((size, len(langs)))
        np.add.at(total, group, c)
        np.add.at(kinds, group, c > 0)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        p = np.maximum(c - discount, 0) / np.maximum(total[group], 1) + weight[group] * lower
        logp.append(np.log2(np.maximum(p, 1e-30)).astype(np.float32))
        back.append(np.log2(weight).astype(np.float32))
        below = p
    model = Model(langs, keys, logp, back, float(floor))
    model.index()
    return model


def calibrate(model: Model, texts: dict[str, list[str]]) -> None:
    """Usual cross-entropy of each language and, per root of a character, its spread."""
    usual, spread = [], []
    for i, x in enumerate(model.langs):
        h, n = model.cross_entropies(texts.get(x, []))
        h, n = (h[n > 0, i], n[n > 0]) if (n > 0).any() else (np.zeros(1), np.ones(1))
        usual.append(np.median(h))
        # The middle of the deviations, so mislabelled and junk rows do not widen it.
        spread.append(max(1.4826 * np.median(np.abs(h - usual[-1]) * np.sqrt(n)), 0.5))
    model.usual, model.spread = np.array(usual), np.array(spread)


def sampled(docs: DataFrame, sample: int = SAMPLE) -> list:
    """Rows (lang, part, text) to learn from, about `sample` of each language."""
    rows = docs.filter(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()
        & (fold(F.col("doc_id")) != HELD_OUT)
    )
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30))
    held = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not held:
        return []
    limits = [(F.col("lang") == x) & (place < int((1 << 30) * min(1.0, sample / n))) for x, n in held.items()]
    chosen = limits[0]
    for more in limits[1:]:
        chosen = chosen | more
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(4)) == 0
    return rows.filter(chosen).select("lang", part.alias("part"), "text").limit(2 * sample * len(held)).collect()


def learn(docs: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> Model | None:
    rows = sampled(docs, sample)
    texts, apart = {}, {}
    for lang, part, text in rows:
        (apart if part else texts).setdefault(lang, []).append(text)
    if not any(letters(t, order).size for v in texts.values() for t in v):
        return None
    model = fit(texts, order)
    calibrate(model, {x: apart.get(x) or texts[x] for x in model.langs})
    return model


def judge(model: Model | None, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
    """Language, score, bits per character, and whether a text is unlike all languages learned."""
    if model is None:
        return [(UNKNOWN, 0.0, 0.0, True)] * len(texts)
    h, size = model.cross_entropies([t or "" for t in texts])
    best = h.argmin(1)
    low = h[np.arange(len(texts)), best]
    odds = np.exp2(-np.minimum((h - low[:, None]) * size[:, None], 1000.0)).sum(1)
    limit = model.usual[best] + SLACK + REJECT * model.spread[best] / np.sqrt(np.maximum(size, 1))
    return [
        (model.langs[b], 1 / o, x, x > most) if n else (UNKNOWN, 0.0, 0.0, True)
        for b, o, x, most, n in zip(best.tolist(), odds.tolist(), low.tolist(), limit.tolist(), size.tolist())
    ]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        own = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                found = judge(own, rows.column(2).to_pylist())
                columns = [pa.array(list(c), k) for c, k in zip(
                    zip(*found), (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), *columns], names=[x.split()[0] for x in _PREDICTED.split(", ")]
                )

    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string"))
    return texts.mapInArrow(run, _PREDICTED)


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents, all columns as they are, without those the model rejects."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        own = sent.value
        for batch in batches:
            kept = [not x[3] for x in judge(own, batch.column(at).to_pylist())]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return in_small_batches(docs).mapInArrow(run, docs.schema)


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, learn(docs))
