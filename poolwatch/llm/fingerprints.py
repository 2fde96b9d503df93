"""Operator 9, I-Match document fingerprints, in DataFrame functions alone.

The lexicon holds the terms whose inverse document frequency lies in a band: neither the words of
every text nor the rare ones that any edit brings or takes. A document keeps its distinct lexicon
terms, sorted; random parts of the lexicon each select some of them, and each selection is hashed.
The likeness of two fingerprints is the share of equal hashes among the subsets that select anything
in either. Subsets differ in size: large ones tell copies from edits, small ones tell edits
from other texts.

Terms stand for their 64-bit hashes, and subset membership is read off the bits of a seeded one, so
no random numbers are stored.

A text without lexicon terms, as all are in a small table, has the hash of all its terms, or of itself
if it has none, in every place, so it is like equal ones alone.

Defined results: a null text is empty; the next document of the last is the first; of rows with one doc_id the
least text is the next document; a null doc_id comes after the last; without any doc_id there is no
next document and near_next is 0; repeated rows are all returned; an empty table gives no rows; extra
columns are not read.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from poolwatch.llm.common import documents, let, stored

# Natural logarithm of documents over documents with the term: terms of 0.5 % to 3 % of them.
IDF = (3.5, 5.3)
# Draws of subsets; each draw has one of 1/2, 1/4, ... of the lexicon for every halving.
DRAWS, HALVINGS = 3, 8
# A doc_id: its number, and whether it is null.
ID = ["id", "none"]
TERM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def term_hashes(text: Column) -> Column:
    """Distinct hashed terms: lower-cased runs of letters, digits and anything beyond ASCII."""
    words = F.array_distinct(F.split(F.lower(text), TERM))
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, idf: tuple[float, float] = IDF) -> DataFrame:
    """Hashes of the terms inside the band, over all documents."""
    total = docs.count()
    counted = docs.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").count()
    rarity = F.log(F.lit(float(max(total, 1))) / F.col("count"))
    return stored(counted.filter(rarity.between(*idf)).select("term"), "lexicon")


def signature(terms: Column, draws: int = DRAWS, halvings: int = HALVINGS) -> Column:
    """Hash of each subset's share of the sorted terms; null where it has none."""

    def of_draw(ordered):
        def subset(bits):
            # The subsets of a draw read disjoint bits of a term's hash, 1 + 2 + ... + 8 of them.
            mask = F.lit(((1 << bits) - 1) << bits * (bits - 1) // 2).cast("long")
            return let(
                F.filter(ordered, lambda t: t.bitwiseAND(mask) == 0),
                lambda x: F.when(F.size(x) > 0, F.xxhash64(x)),
            )

        return F.array(*[subset(b) for b in range(1, halvings + 1)])

    hashed = [F.sort_array(F.transform(terms, lambda t: F.xxhash64(t, F.lit(d)))) for d in range(draws)]
    return F.flatten(F.transform(F.array(*hashed), of_draw))


def written(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x), 16, "0")), F.lit("-"))), ":")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among those that are not both empty; 1 if all are, as their texts are equal."""
    kind = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), 2).when(x.eqNullSafe(y), 1).otherwise(0))

    def share(k):
        used = F.size(F.filter(k, lambda x: x < 2))
        return F.when(used > 0, F.size(F.filter(k, lambda x: x == 1)) / used).otherwise(1.0)

    return let(kind, share)


def marked(rows: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` has the keys and text; in place of it comes its signature. Rows stay in the task they
    are in if that holds all rows of their first keys: the lexicon is sent to them. It is bounded, as each of its
    terms is in 0.5 % of all documents or more: by 200 times the terms of a usual document."""
    # Term 0 is in every text, so that none is lost; it is taken out again below.
    known = F.broadcast(terms.union(terms.sparkSession.createDataFrame([(0,)], "term long")))
    found = let(term_hashes(F.col("text")), lambda t: F.struct(
        F.when(F.size(t) > 0, F.xxhash64(F.sort_array(t))).otherwise(F.xxhash64("text")).alias("whole"),
        F.concat(F.array(F.lit(0).cast("long")), t).alias("every"),
    ))
    sets = (
        rows.select(*keys, F.explode(F.array(found)).alias("x")).select(*keys, "x.whole", F.explode("x.every").alias("term")).join(known, "term")
        .groupBy(*keys).agg(F.collect_set("term").alias("terms"), F.first("whole").alias("whole"))
    )
    alone = F.array_repeat(F.col("whole"), DRAWS * HALVINGS)
    marks = let(F.array_remove("terms", 0), lambda t: F.when(F.size(t) > 0, signature(t)).otherwise(alone))
    return sets.select(*keys, marks.alias("signature"))


def followers(docs: DataFrame) -> DataFrame:
    """(of, of_none, need, id, none): for each doc_id the next one, and how much of its text an edit
    needs."""
    ids = docs.select(*ID, F.length("text").alias("n")).groupBy(*ID).agg(F.max("n").alias("n"))
    dealt = stored(ids.repartitionByRange(*ID).withColumn("part", F.spark_partition_id()), "ids")
    named = dealt.filter("not none")
    # A row per partition.
    firsts = named.groupBy("part").agg(F.min("id").alias("first")).orderBy("part").collect()
    after = [(a["part"], b["first"]) for a, b in zip(firsts, firsts[1:] + firsts[:1])]
    edge = docs.sparkSession.createDataFrame(after, "part int, edge long")
    first = firsts[0]["first"] if firsts else None
    step = Window.partitionBy("part").orderBy("id")
    half = F.expr("n div 2").alias("need")
    inner = named.withColumn("next", F.lead("id").over(step)).join(F.broadcast(edge), "part").select(
        F.col("id").alias("of"), F.lit(False).alias("of_none"), half, F.coalesce("next", "edge").alias("id"),
        F.lit(False).alias("none"),
    )
    none = dealt.filter("none").select(
        F.col("id").alias("of"), F.lit(True).alias("of_none"), half, F.lit(first).cast("long").alias("id"),
        F.lit(False).alias("none"),
    )
    return stored(inner.union(none.filter("id is not null")), "followers")


def edited(docs: DataFrame) -> DataFrame:
    """Distinct rows of docs and their number (copies), each with its edited text and the hash and
    length of the next document's text. Texts are dealt out once, by their id, and only as much of
    a text as an edit needs goes on to the document before it."""
    dealt = docs.repartition(*ID)
    rows = dealt.groupBy(*ID, "text").agg(F.count("*").alias("copies"))
    heads = (
        dealt.groupBy(*ID).agg(F.min("text").alias("text")).join(followers(docs), ID)
        .select(F.col("of").alias("id"), F.col("of_none").alias("none"), F.left("text", F.col("need").cast("int")).alias("head"),
                F.xxhash64("text").alias("next_h"), F.length("text").alias("next_n"))
    )
    n, half = F.length("text"), F.expr("cast(length(text) div 2 as int)")
    changed = F.concat(F.left("text", n - half), F.left(F.coalesce("head", F.lit("")), half))
    return rows.join(heads, ID, "left").select(*ID, "copies", "text", changed.alias("edited"), "next_h", "next_n")


def imatch(docs: DataFrame, idf: tuple[float, float] = IDF) -> DataFrame:
    given = F.col("doc_id").cast("long")
    docs = docs.select(
        F.coalesce(given, F.lit(0)).alias("id"), given.isNull().alias("none"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    terms = lexicon(docs, idf)
    facts = [*ID, "copies", "h", "n", "edited_sha256", "next_h", "next_n"]
    both = edited(docs).withColumns(
        {"h": F.xxhash64("text"), "n": F.length("text"), "edited_sha256": F.sha2("edited", 256)}
    ).select(*facts, F.posexplode(F.array("text", "edited")).alias("changed", "text"))
    marks = stored(marked(both, terms, [*facts, "changed"]), "marks")
    own = marks.filter("changed = 0").select(*facts, F.col("signature").alias("own"))
    other = marks.filter("changed = 1").select(*ID, "h", "n", F.col("signature").alias("other"))
    following = own.select(F.col("h").alias("next_h"), F.col("n").alias("next_n"), F.col("own").alias("following"))
    found = own.join(other, [*ID, "h", "n"]).join(following.dropDuplicates(["next_h", "next_n"]), ["next_h", "next_n"], "left")
    return found.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256",
        written(F.col("own")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        F.when(F.col("following").isNull(), 0.0).otherwise(likeness(F.col("own"), F.col("following"))).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return imatch(documents(spark, sf_dir)).drop("copy")
