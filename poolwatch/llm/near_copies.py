"""Operator 2, n-gram Jaccard join by vertical partitioning.

The n-grams (shingles of `words` words) of all documents have one global order: by how often their
hash bucket occurs in the corpus, then by hash. Counts are of all documents; a bucket only stands
for several n-grams, which leaves the order exact as an order.

1. Documents of equal sets are one class.
2. Prefixes: two sets of the wanted similarity share an n-gram among the first of either; the
   shorter one needs even fewer. Only prefixes are shuffled, by n-gram; n-grams of one class drop out.
3. Each class is paired with the one in which an n-gram stands earliest, for each n-gram, so that a large group of near copies
   becomes one component by as many pairs as it has members; and once more, where components still share an
   n-gram, with the class of it in the largest of them. Then classes of different components
   are paired wherever the lengths and places of a shared n-gram still allow the similarity.
4. Each class has marks, about a bit an n-gram. Where those of a pair differ in more places than similar sets may have
   n-grams apart, the pair has met by chance and goes before its n-grams are moved.
5. The global order is cut into fragments. The segments of a pair are intersected fragment by
   fragment, and the partial overlaps are summed per pair, which decides it exactly.

Hashes have 64 bits; two different n-grams of one pair of documents take the same hash with a chance
below 1e-12.

Defined results: null, empty and blank texts have 0 shingles and are linked with nothing; fewer
words than a shingle are one shingle; repeated rows and rows of one doc_id are one vertex; a row
without doc_id has the component of documents with its set, or none; an empty table gives no rows; extra columns are not read.
"""

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from poolwatch.llm.common import documents, in_small_batches, stored
from poolwatch.llm.components import components
from poolwatch.llm.filters import id_filter

WORDS = 5
# Similarity as a fraction of whole numbers.
SIMILAR = (75, 100)
# Counters of the global order: 4 bytes each, the only table sent to all tasks.
BUCKETS = 1 << 22
_CHUNK = 1 << 16
# Bits of the filter over ids of documents to be cut, sent to all tasks like the counters; to grow with the corpus.
FILTER_BITS = 24
FRAGMENTS = 8
# Words of at most LONGEST_WORD bytes whose hashes a task keeps, until it ends.
KEPT_WORDS = 250_000
LONGEST_WORD = 64

_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Hashes(dict):
    """Hashes of words, worked out when they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST_WORD:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = got
        return got


def shingles(text: str | None, words: int = WORDS, known: Hashes | None = None) -> np.ndarray:
    """Sorted hashes of the distinct shingles, as unsigned 64-bit numbers."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone become lower case
    if not found:
        return np.empty(0, np.uint64)
    known = Hashes() if known is None else known
    hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    width = min(words, len(found))
    m = len(found) - width + 1
    out = np.full(m, np.uint64(width), np.uint64)
    for j in range(width):
        out = (out ^ hashes[j : j + m]) * _STEPS[j % 4]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def set_name(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes(), seed=grams.size) - (1 << 63)


def marks(grams: np.ndarray) -> np.ndarray:
    """For each of at least as many cells as there are grams, a power of two, whether it holds an odd number of them; 64
    cells in a number. A gram that only one of two sets has changes one cell."""
    cells = 1 << max(6, (grams.size - 1).bit_length())
    odd = np.bincount((grams & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (grams & np.uint64(buckets - 1)).astype(np.int64)


def bucket_counts(docs: DataFrame, words: int, buckets: int) -> list[tuple[int, bytes]]:
    """N-grams of all documents in each hash bucket, as numbered chunks of compressed 64-bit counts."""
    chunk = min(_CHUNK, buckets)

    def count(batches):
        held, known = np.zeros(buckets, np.uint32), Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingles(t, words, known) for t in batch.column(0).slice(at, 256).to_pylist()]
                np.add.at(held, _bucket(np.concatenate(sets), buckets), 1)
        for begin in range(0, buckets, chunk):
            part = held[begin : begin + chunk]
            if part.any():
                # Mostly small numbers: a few bits per bucket after compression.
                yield pa.RecordBatch.from_arrays(
                    [pa.array([begin // chunk], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())],
                    names=["chunk", "n"])

    def add(batches):
        held = {}
        for batch in batches:
            for c, n in zip(*(batch.column(i).to_pylist() for i in range(2))):
                if c not in held:
                    held[c] = np.zeros(chunk, np.int64)
                held[c] += np.frombuffer(zlib.decompress(n), np.uint32)
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())],
                names=["chunk", "n"])

    parts = docs.select(F.col("text").cast("string")).mapInArrow(count, "chunk int, n binary")
    summed = parts.repartition("chunk").mapInArrow(add, "chunk int, n binary")
    # One number per bucket comes to the driver, whatever the input.
    return [(c, bytes(n)) for c, n in summed.collect()]


class Order:
    """The global order: rank of a bucket's count in steps of a quarter octave, then the hash."""

    def __init__(self, counts: list[tuple[int, bytes]], buckets: int, fragments: int = FRAGMENTS):
        self.rank, mass = np.zeros(buckets, np.uint8), np.zeros(256)
        # A chunk at a time, for the driver's memory.
        for c, packed in counts:
            n = np.frombuffer(zlib.decompress(packed), np.int64)
            rank = np.ceil(4 * np.log2(np.maximum(n, 1))).astype(np.uint8)
            self.rank[c * n.size : (c + 1) * n.size] = rank
            mass += np.bincount(rank, n, 256)
        self.share = mass / max(mass.sum(), 1)
        self.before = np.cumsum(self.share) - self.share
        self.fragments = fragments

    def sort(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted grams in global order, and their ranks."""
        rank = self.rank[_bucket(grams, self.rank.size)]
        order = np.argsort(rank, kind="stable")
        return grams[order], rank[order]

    def fragment(self, grams: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Fragment of each gram: cuts of the order into parts of even mass."""
        place = self.before[rank] + self.share[rank] * (grams / 2.0**64)
        return np.minimum((place * self.fragments).astype(np.int64), self.fragments - 1)


def prefixes(docs: DataFrame, order, words: int, similar: tuple[int, int]) -> DataFrame:
    """(doc_id, n, set, prefix, marks): size of the set, its hash, its first n-grams in global order, and its marks."""
    a, b = similar

    def run(batches):
        ranks, known = order.value, Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                sets = [shingles(t, words, known) for t in rows.column(1).to_pylist()]
                firsts = [ranks.sort(s)[0][: s.size - -(-a * s.size // b) + 1].view(np.int64) if s.size else None
                          for s in sets]
                names = [set_name(s) for s in sets]
                marked = [marks(s) if s.size else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([s.size for s in sets], pa.int64()), pa.array(names, pa.int64()),
                     pa.array(firsts, pa.list_(pa.int64())), pa.array(marked, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "set", "prefix", "marks"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, n long, set long, prefix array<long>, marks array<long>")


def still_open(posts: DataFrame, joined: DataFrame) -> DataFrame:
    """The posts with their `component` and its `size`, of those n-grams that several components share. Tables of ids grow
    with the documents and are merged, never sent through the driver by force."""
    sizes = joined.groupBy("component").agg(F.count("*").alias("size"))
    told = joined.join(sizes.hint("merge"), "component").select(F.col("id").alias("set"), "component", "size")
    placed = stored(
        posts.join(told.hint("merge"), "set", "left").withColumns({"component": F.coalesce("component", "set"), "size": F.coalesce("size", F.lit(1))}),
        "placed",
    )
    several = placed.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    return stored(placed.join(several.select("gram").hint("merge"), "gram", "left_semi"), "open")


def needed(n: Column, m: Column, similar: tuple[int, int]) -> Column:
    """Least overlap of two sets of these sizes that are similar."""
    a, b = similar
    return F.ceil(a * (n + m) / F.lit(a + b))


def apart(x: Column, y: Column) -> Column:
    """Cells in which the marks of two sets differ; the sets have no fewer n-grams that the other lacks. The marks of more
    cells are folded to as many as the others have."""
    width = F.least(F.size(x), F.size(y))

    def folded(marks: Column, i: Column) -> Column:
        places = F.sequence(i, F.size(marks) - 1, width)
        return F.aggregate(places, F.lit(0).cast("long"), lambda odd, j: odd.bitwiseXOR(marks[j]))

    return F.aggregate(
        F.sequence(F.lit(0), width - 1), F.lit(0), lambda n, i: n + F.bit_count(folded(x, i).bitwiseXOR(folded(y, i)))
    )


def likely(pairs: DataFrame, classes: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs of classes (a, na, b, nb) without those that their marks rule out, and the ids (ia, ib) of both."""
    x, y = similar
    marked = classes.select("set", "id", "marks")
    met = (
        pairs.alias("p").join(marked.hint("merge").alias("l"), F.expr("p.a = l.set"))
        .join(marked.hint("merge").alias("r"), F.expr("p.b = r.set"))
    )
    both = F.col("na") + F.col("nb")
    # What the sets share is at most half of what the marks leave of both.
    fits = (both - apart(F.col("l.marks"), F.col("r.marks"))) * (x + y) >= both * (2 * x)
    return met.filter(fits).select("p.a", "p.na", "p.b", "p.nb", F.col("l.id").alias("ia"), F.col("r.id").alias("ib"))


def segments(docs: DataFrame, order, wanted, words: int) -> DataFrame:
    """(set, fragment, grams): the set of each document whose id may be wanted, cut by the fragments of the global
    order. Texts stay where they are; a filter of fixed size is sent to them."""

    def run(batches):
        ranks, ids, known = order.value, wanted.value, Hashes()
        for batch in batches:
            batch = batch.filter(pa.array(ids.has(batch.column(0).to_numpy())))
            for at in range(0, batch.num_rows, 64):
                out = [], [], []
                for text in batch.column(1).slice(at, 64).to_pylist():
                    grams = shingles(text, words, known)
                    name = set_name(grams)
                    grams, rank = ranks.sort(grams)
                    part = ranks.fragment(grams, rank)
                    for f in np.unique(part):
                        for column, value in zip(out, (name, int(f), grams[part == f].view(np.int64))):
                            column.append(value)
                kinds = pa.int64(), pa.int32(), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds)], names=["set", "fragment", "grams"])

    named = docs.filter("doc_id is not null").select(F.xxhash64(F.col("doc_id").cast("long")).alias("id"), F.col("text").cast("string"))
    return named.mapInArrow(run, "set long, fragment int, grams array<long>")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, order, words: int, similar) -> DataFrame:
    """Of the pairs of classes (a, na, b, nb), those whose overlap, summed over fragments, suffices."""
    pairs = stored(likely(pairs, classes, similar), "pairs")
    named = pairs.select(F.explode(F.array("ia", "ib")).alias("id")).select(F.xxhash64("id").alias("id"))
    wanted = docs.sparkSession.sparkContext.broadcast(id_filter(named, FILTER_BITS))
    # Dealt out once for both sides of a pair, and the same way whatever its size.
    cut = segments(docs, order, wanted, words).repartition("set", "fragment")
    wanted = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)))).alias("p")
    met = (
        wanted.join(cut.hint("merge").alias("l"), F.expr("p.a = l.set and p.fragment = l.fragment"))
        .join(cut.hint("merge").alias("r"), F.expr("p.b = r.set and p.fragment = r.fragment"))
    )
    shared = F.size(F.array_intersect("l.grams", "r.grams")).cast("long")
    # Documents of one set, of which the filter may let several pass, have equal segments.
    partial = met.groupBy("p.a", "p.na", "p.b", "p.nb", "p.fragment").agg(F.max(shared).alias("shared"))
    total = partial.groupBy("a", "na", "b", "nb").agg(F.sum("shared").alias("shared"))
    x, y = similar
    return total.filter(F.col("shared") * y >= (F.col("na") + F.col("nb") - F.col("shared")) * x).select("a", "b")


def near_copies(
    docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR, buckets: int = BUCKETS
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark = in_small_batches(docs).sparkSession
    order = spark.sparkContext.broadcast(Order(bucket_counts(docs, words, buckets), buckets))
    sets = stored(prefixes(docs, order, words, similar), "sets")
    full = sets.filter("n > 0")
    classes = stored(full.groupBy("set").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.first("marks").alias("marks")), "classes")

    # Size and place travel as one number: three words a row is all that is shuffled of a prefix.
    packed = (F.shiftleft("n", 31) + F.col("place")).alias("packed")
    dealt = full.select("set", "n", F.posexplode("prefix").alias("place", "gram")).select("gram", "set", packed)
    dealt = dealt.repartition("gram")
    # All columns are read here too: else the rows would be dealt out once more, without the third.
    ends = F.min("set").alias("lo"), F.max("set").alias("hi"), F.min("packed").alias("least")
    shared = dealt.groupBy("gram").agg(*ends).filter("lo <> hi and least >= 0")
    posts = dealt.join(shared.select("gram").hint("shuffle_hash"), "gram").distinct().select(
        "gram", "set", F.shiftright("packed", 31).alias("n"), (F.col("packed") % (1 << 31)).alias("place")
    )
    posts = stored(posts, "posts")

    def possible(n, place, m, other):
        fits = F.least(F.col(n) - F.col(place), F.col(m) - F.col(other)) >= needed(F.col(n), F.col(m), similar)
        return fits & (F.col(n) * similar[1] >= F.col(m) * similar[0]) & (F.col(m) * similar[1] >= F.col(n) * similar[0])

    # The class in which an n-gram stands earliest has the fewest rare n-grams of its own: of a group
    # of edited copies, the text they were made from.
    centre = posts.groupBy("gram").agg(F.min(F.struct("place", "set", "n")).alias("c")).select(
        "gram", F.col("c.set").alias("a"), F.col("c.n").alias("na"), F.col("c.place").alias("pa")
    )
    around = posts.select("gram", F.col("set").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    met = around.join(centre.hint("merge"), "gram").filter("a <> b").filter(possible("na", "pa", "nb", "pb"))
    stars = met.select("a", "na", "b", "nb").distinct()
    first = stored(verified(stars, classes, docs, order, words, similar), "star-links")
    joined = stored(components(first), "star-components")

    # Of n-grams that several components share, each class is paired with the one in the largest component, as far as
    # it is in another: what the first centres missed of a large group joins the rest of it.
    open_ = still_open(posts, joined)
    large = open_.groupBy("gram").agg(F.max(F.struct("size", (-F.col("place")).alias("early"), "set", "n", "component")).alias("c")).select(
        "gram", F.col("c.set").alias("a"), F.col("c.n").alias("na"), (-F.col("c.early")).alias("pa"), F.col("c.component").alias("ca"))
    around = open_.select("gram", F.col("set").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("component").alias("cb"))
    met = around.join(large.hint("merge"), "gram").filter("ca <> cb").filter(possible("na", "pa", "nb", "pb"))
    more = verified(met.select("a", "na", "b", "nb").distinct(), classes, docs, order, words, similar)
    first = first.unionByName(stored(more, "more-links"))
    joined = stored(components(first), "components")

    # Pairs across components: the shorter set, by its shorter prefix, against the longer one's.
    open_ = still_open(open_.drop("component", "size"), joined)
    short = open_.filter(F.col("n") - F.col("place") >= needed(F.col("n"), F.col("n"), similar)).select(
        "gram", F.col("set").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"),
        F.col("component").alias("ca"),
    )
    long_ = open_.select(
        "gram", F.col("set").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"),
        F.col("component").alias("cb"),
    )
    later = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    across = (
        short.join(long_, "gram").filter((F.col("ca") != F.col("cb")) & later & possible("na", "pa", "nb", "pb"))
        .select("a", "na", "b", "nb").distinct()
    )
    links = first.union(verified(across, classes, docs, order, words, similar))

    ids = classes.select("set", "id")
    links = (
        links.join(ids.toDF("a", "ia").hint("merge"), "a").join(ids.toDF("b", "ib").hint("merge"), "b")
        .select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    )
    found = components(links)
    of_set = classes.join(found.hint("merge"), "id", "left").select("set", F.coalesce("component", "id").alias("component_id"))
    return sets.select("doc_id", "n", "set").join(of_set, "set", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, the one of least doc_id; all columns as they are. Documents
    without words stay, and so do rows without doc_id. Repeated rows are one document."""
    gone = near_copies(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(docs.columns)


def op2_near_copies(spark, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir))


# All pairs that share a shingle, and everything reachable from each document.
ORACLE = r"""
with recursive worded as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), shingles as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from worded where len(w) > 0)
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select a, b from (
    select x.doc_id as a, y.doc_id as b, count(*) as shared
    from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2
  ) join sizes p on p.doc_id = a join sizes q on q.doc_id = b
  where 100 * shared >= 75 * (p.n + q.n - shared)
), reach(id, root) as (
  select distinct a, a from links union select b, root from reach join links on a = id
)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id
from documents d left join sizes z on z.doc_id = d.doc_id
left join (select id, min(root) as component_id from reach group by id) c on c.id = d.doc_id
"""
