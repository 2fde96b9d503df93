"""Operator 13, phrase collocation mining by direct-address tiling.

Frequent words get ids by frequency, and a pair of words is a cell (left id, right id). Cells of the
most frequent ids lie in square tiles, which a task counts with dense bincounts at the cell's own
address; all other cells are counted as sorted coordinate lists (COO). Frequent pairs are ranked again
and paired with the word that follows, which gives three words, and so once more for four. A phrase
is only counted where both parts that are one word shorter are frequent, as those of every frequent
phrase are.

What is sent to all tasks is bounded: ids of the RANKED most frequent grams of a length (words of
LONGEST_WORD bytes at most), and for frequent grams beyond them a filter of fixed size. Grams beyond
the ranked ones have a 62-bit hash as id and go through the same counts; the filter lets some
infrequent ones pass, whose counts then fall below the least.

A phrase's words, its parts' counts and the longer phrases around it are joined at the end, on the
frequent phrases alone. Scores are whole-number arithmetic with 38 digits.

Defined results: A-Z alone become lower-case; a null text is empty; a null lang is `und`, and one
with the text `und`; pieces never share a phrase; repeated rows count as often as they are there;
ties are in the order of the phrase's bytes; a language without candidates, or an empty table, gives
no rows; doc_id and extra columns are not read.
"""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from poolwatch.llm.common import SALTS, documents, in_small_batches, stored
from poolwatch.llm.filters import Filter, id_filter

LEAST = 30
LONGEST = 4
# A longer phrase with this percentage of a phrase's occurrences replaces it.
INSIDE_PERCENT = 80
SCALE = 2_000_000
TOP = 2_000
# Grams of one length with ids of their own: at most 64 bytes each in every task.
RANKED = 250_000
LONGEST_WORD = 64
# Tiles: BLOCKS x BLOCKS of SIDE x SIDE cells, 32 MB a task.
SIDE, BLOCKS = 256, 8
# Bits of the filter for grams beyond the ranked ones; to grow with the corpus.
FILTER_BITS = 24
# Entries held in a task before they are passed on, and tokens worked on at once.
KEPT_WORDS = 300_000
KEPT_CELLS = 2_000_000
TOKENS = 1_000_000

_DENSE = SIDE * BLOCKS
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLAIN = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
CELLS = "left long, right long, n long, tile int, salt int, counts binary"


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, with a full stop, which no word is, where a piece ends."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).replace(b"\n", b" . ").split()


def _mixed(left: np.ndarray, right: np.ndarray, seed: int = 0) -> np.ndarray:
    out = (left.astype(np.uint64) + np.uint64(seed)) * _STEP
    out ^= out >> np.uint64(31)
    out = (out + right.astype(np.uint64)) * _MIX
    return out ^ (out >> np.uint64(29))


def _tail(hashes: np.ndarray) -> np.ndarray:
    """Ids of grams beyond the ranked ones: negative."""
    return -1 - (hashes >> np.uint64(2)).astype(np.int64)


def _word_tail(lang: str, word: bytes) -> int:
    return -1 - (xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word) >> 2)


class Words:
    """Ids of words: those ranked by frequency, from 1, and hashes of the others."""

    def __init__(self, ranked: list[tuple[str, bytes]], rest: Filter | None):
        self.by_lang, self.rest = defaultdict(dict), rest
        for i, (lang, word) in enumerate(ranked, 1):
            self.by_lang[lang][word] = i

    def ids(self, lang: str, found: list[bytes]) -> np.ndarray:
        """0 where a piece ends or a word is not frequent."""
        known = self.by_lang.get(lang, {})
        if self.rest is None:
            return np.fromiter(map(known.get, found, itertools.repeat(0)), np.int64, len(found))
        more = {w: t for w in set(found).difference(known, [b"."]) if (t := _word_tail(lang, w)) in self.rest}
        return np.fromiter((known.get(w) or more.get(w, 0) for w in found), np.int64, len(found))


class Grams:
    """Ids of frequent (left id, right id) cells: ranked by frequency, and hashes of the others."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rest: Filter | None):
        self.seed, self.rest = 0, rest
        while np.unique(keys := _mixed(left, right, self.seed)).size < left.size:
            self.seed += 1
        order = np.argsort(keys)
        self.keys, self.left, self.right, self.number = keys[order], left[order], right[order], order.astype(np.int32) + 1

    def ids(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.zeros(left.size, np.int64)
        at = np.nonzero((left != 0) & (right != 0))[0]
        l, r = left[at], right[at]
        seen = np.zeros(at.size, bool)
        if self.keys.size:
            place = np.minimum(np.searchsorted(self.keys, _mixed(l, r, self.seed)), self.keys.size - 1)
            seen = (self.left[place] == l) & (self.right[place] == r)
            out[at[seen]] = self.number[place[seen]]
        if self.rest is not None:
            out[at[~seen]] = self.rest.keep(_tail(_mixed(l[~seen], r[~seen])))
        return out


def _listed(left: np.ndarray, right: np.ndarray, n: np.ndarray | None = None):
    """Sorted coordinate list: each cell once with the sum of its counts."""
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    new = np.ones(left.size, bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    first = np.nonzero(new)[0]
    sums = np.diff(np.append(first, left.size)) if n is None else np.add.reduceat(n[order], first) if first.size else n
    return left[first], right[first], sums.astype(np.int64)


class Counts:
    """Occurrences of cells in one task: dense tiles and a sorted coordinate list."""

    def __init__(self):
        self.dense, self.lists, self.held = None, [], 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        inside = (left > 0) & (left <= _DENSE) & (right > 0) & (right <= _DENSE)
        if inside.any():
            l, r = left[inside] - 1, right[inside] - 1
            address = ((l // SIDE * BLOCKS + r // SIDE) * SIDE + l % SIDE) * SIDE + r % SIDE
            counted = np.bincount(address, minlength=_DENSE * _DENSE)
            self.dense = counted if self.dense is None else np.add(self.dense, counted, out=self.dense)
        out = ~inside & (left != 0) & (right != 0)
        if out.any():
            self.lists.append(_listed(left[out], right[out]))
            self.held += self.lists[-1][0].size

    def full(self) -> bool:
        if self.held <= KEPT_CELLS:
            return False
        self.lists = [_listed(*map(np.concatenate, zip(*self.lists)))]
        self.held = self.lists[0][0].size
        return self.held > KEPT_CELLS // 2

    def cells(self):
        """The coordinate list so far, which is empty after that."""
        if self.lists:
            left, right, n = _listed(*map(np.concatenate, zip(*self.lists)))
            none = pa.nulls(left.size, pa.int32())
            yield _batch(pa.array(left), pa.array(right), pa.array(n), none, none, pa.nulls(left.size, pa.binary()))
        self.lists, self.held = [], 0

    def tiles(self, salt: int):
        for tile, part in enumerate(() if self.dense is None else self.dense.reshape(BLOCKS * BLOCKS, SIDE * SIDE)):
            if part.any():
                none = pa.nulls(1, pa.int64())
                yield _batch(none, none, none, pa.array([tile], pa.int32()), pa.array([salt], pa.int32()), pa.array([_packed(part)], pa.binary()))


def _batch(*columns):
    return pa.RecordBatch.from_arrays(list(columns), names=[x.split()[0] for x in CELLS.split(", ")])


def _packed(part: np.ndarray) -> bytes:
    return zlib.compress(part.tobytes(), 1)


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, word, n) of the words of at least `least` occurrences; word null: all words of the language."""

    def run(batches):
        held, all_words = defaultdict(Counter), Counter()

        def rows():
            for lang, counted in held.items():
                all_words[lang] += counted.total() - counted.pop(b".", 0)
                words = list(counted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(counted.values(), pa.int64())],
                    names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for lang, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    held[lang].update(tokens(text))
                if sum(map(len, held.values())) > KEPT_WORDS:
                    yield from rows()
        yield from rows()
        # A full stop is taken out of the total together with its counter above.
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(all_words), pa.string()), pa.nulls(len(all_words), pa.binary()), pa.array(all_words.values(), pa.int64())],
            names=["lang", "word", "n"])

    counted = docs.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return counted.filter((F.col("n") >= least) | F.col("word").isNull())


def ranked_words(words: DataFrame, ranked: int, bits: int) -> Words:
    """`words`: (lang, word, n) of frequent words."""
    short = words.filter(F.octet_length("word") <= LONGEST_WORD)
    first = short.orderBy(F.desc("n"), "lang", "word").limit(ranked).select("lang", "word").toArrow()
    top = list(zip(*(first.column(i).to_pylist() for i in range(2))))
    if words.count() == len(top):
        return Words(top, None)
    known = words.sparkSession.sparkContext.broadcast(Words(top, None))  # bounded by `ranked`

    def rest(batches):
        own = known.value.by_lang
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([_word_tail(lang, w) for lang, w in rows if w not in own.get(lang, ())], pa.int64())], names=["tail"])

    return Words(top, id_filter(words.select("lang", "word").mapInArrow(rest, "tail long"), bits))


def ranked_grams(cells: DataFrame, ranked: int, bits: int) -> Grams:
    """`cells`: (left, right, n) of frequent grams."""
    first = cells.orderBy(F.desc("n"), "left", "right").limit(ranked).select("left", "right").toArrow()
    left, right = (first.column(i).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
    if cells.count() == left.size:
        return Grams(left, right, None)
    known = cells.sparkSession.sparkContext.broadcast(Grams(left, right, None))  # bounded by `ranked`

    def rest(batches):
        for batch in batches:
            l, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = known.value.ids(l, r) == 0
            yield pa.RecordBatch.from_arrays([pa.array(_tail(_mixed(l[new], r[new])))], names=["tail"])

    return Grams(left, right, id_filter(cells.select("left", "right").mapInArrow(rest, "tail long"), bits))


def _cells_of(words: np.ndarray, grams: list[Grams]) -> tuple[np.ndarray, np.ndarray]:
    """Left and right ids of all grams of len(grams) + 2 words; 0 where a part is not frequent."""
    left = words
    for k, known in enumerate(grams, 1):
        found = known.ids(left[: max(words.size - k, 0)], words[k:])
        # Frequent only if its last words, one fewer, are frequent too.
        left = np.where(found[1:] != 0, found[:-1], 0)
    right = words[len(grams) + 1 :]
    return left[: right.size], right


def cell_counts(docs: DataFrame, words, grams: list, least: int) -> DataFrame:
    """(left, right, n) of the frequent grams one word longer than the last of `grams`."""

    def count(batches):
        ids, tables = words.value, [g.value for g in grams]
        counts, parts, size = Counts(), [], 0

        def work():
            counts.add(*_cells_of(np.concatenate(parts), tables))
            parts.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for lang, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    parts += [ids.ids(lang, tokens(text)), np.zeros(1, np.int64)]
                    size += parts[-2].size
                    if size > TOKENS:
                        work()
                        size = 0
                        if counts.full():
                            yield from counts.cells()
        if parts:
            work()
        yield from counts.cells()
        yield from counts.tiles(TaskContext.get().partitionId() % SALTS)

    def added(batches):
        held = {}
        for batch in batches:
            for tile, counts in zip(*(batch.column(c).to_pylist() for c in ("tile", "counts"))):
                part = np.frombuffer(zlib.decompress(counts), np.int64)
                held[tile] = held[tile] + part if tile in held else part
        return held

    def salted(batches):
        for tile, part in added(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), pa.array([_packed(part)], pa.binary())], names=["tile", "counts"])

    def summed(batches):
        for tile, part in added(batches).items():
            at = np.nonzero(part >= least)[0]
            left, right = tile // BLOCKS * SIDE + at // SIDE + 1, tile % BLOCKS * SIDE + at % SIDE + 1
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(part[at])], names=["left", "right", "n"])

    parts = stored(docs.mapInArrow(count, CELLS), "cells")
    tiles = parts.filter("tile is not null").select("tile", "salt", "counts").repartition("tile", "salt")
    dense = tiles.mapInArrow(salted, "tile int, counts binary").repartition("tile").mapInArrow(summed, "left long, right long, n long")
    listed = parts.filter("tile is null").groupBy("left", "right").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return stored(dense.union(listed), "frequent")


def _coded_words(words: DataFrame, ids) -> DataFrame:
    def run(batches):
        for batch in batches:
            lang, word, n = batch.columns
            code = [int(ids.value.ids(a, [b])[0]) for a, b in zip(lang.to_pylist(), word.to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), lang, word, n], names=["code", "lang", "phrase", "n"])

    coded = words.select("lang", "word", "n").mapInArrow(run, "code long, lang string, phrase binary, n long")
    return coded.withColumn("phrase", F.col("phrase").cast("string"))


def _coded(cells: DataFrame, ids) -> DataFrame:
    def run(batches):
        for batch in batches:
            left, right, n = batch.columns
            code = ids.value.ids(left.to_numpy(), right.to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(code), left, right, n], names=["code", "left", "right", "n"])

    return cells.mapInArrow(run, "code long, left long, right long, n long")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, ranked: int = RANKED, bits: int = FILTER_BITS):
    """(lang, phrase, words, n) of all frequent phrases, single words included; and (lang, n), the words of each language."""
    sent = docs.sparkSession.sparkContext.broadcast
    rows = in_small_batches(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    counted = stored(word_counts(rows, least), "words")
    words = counted.filter("word is not null")
    ids, grams = sent(ranked_words(words, ranked, bits)), []
    single = stored(_coded_words(words, ids), "level")
    levels = [single]
    ends = single.select(F.col("code").alias("right"), F.col("phrase").alias("last"))
    for _ in range(longest - 1):
        cells = cell_counts(rows, ids, grams, least)
        grams.append(sent(ranked_grams(cells, ranked, bits)))
        begins = levels[-1].select(F.col("code").alias("left"), "lang", F.col("phrase").alias("first"))
        named = _coded(cells, grams[-1]).join(begins, "left").join(ends, "right")
        levels.append(stored(named.select("code", "lang", F.concat_ws(" ", "first", "last").alias("phrase"), "n"), "level"))
    of_length = [x.select("lang", "phrase", F.lit(k).alias("words"), "n") for k, x in enumerate(levels, 1)]
    found = of_length[0]
    for more in of_length[1:]:
        found = found.union(more)
    return found, counted.filter("word is null").select("lang", "n")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST, ranked: int = RANKED,
                 bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases."""
    found, totals = phrases(docs, least, longest, ranked, bits)
    several = found.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    part = lambda begin, size: F.array_join(F.slice(F.split("phrase", " "), begin, size), " ")
    # A phrase inside a longer one is inside one that is one word longer and no rarer.
    around = (
        several.filter("words > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    kept = several.join(around, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * INSIDE_PERCENT)
    )
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words")).alias("rest")
    )
    first = found.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rest = found.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    score = F.expr(f"({SCALE} * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    cut = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).withColumn("score", score)
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    best_first = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # In shares of a language first, so that the last window has few rows of each.
    share = Window.partitionBy("lang", "share").orderBy(*best_first)
    few = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("at", F.row_number().over(share)).filter(F.col("at") <= top)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best_first))).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLE = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), split as (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces
), totals as (select lang, sum(len(w))::bigint as n from split group by lang),
grams as (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from split, range(1, 5) as t(k) where len(w) >= k)
), found as (select lang, k, phrase, count(*) as a from grams group by all having count(*) >= 30),
several as (select *, string_split(phrase, ' ') as w from found where k > 1),
around as (
  select lang, phrase, max(a) as longer from (
    select lang, unnest([array_to_string(w[1 : k - 1], ' '), array_to_string(w[2 : k], ' ')]) as phrase, a from several where k > 2
  ) group by all
), kept as (
  select s.* from several s left join around using (lang, phrase) where longer is null or 100 * longer < 80 * a
), cuts as (
  select lang, phrase, a, c, array_to_string(w[1 : c], ' ') as f, array_to_string(w[c + 1 : k], ' ') as g
  from (select *, unnest(range(1, k)) as c from kept)
), scored as (
  select cuts.lang, cuts.phrase, cuts.a, c, x.a as l, y.a as r, (2000000::hugeint * cuts.a) // (x.a + y.a) as score
  from cuts join found x on x.lang = cuts.lang and x.phrase = f join found y on y.lang = cuts.lang and y.phrase = g
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1
), ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join totals using (lang) where rank <= 2000
"""
