"""Operator 8, quality rules by importance of hashed n-grams, in DataFrame functions alone.

The words and word pairs of a text (runs of letters and digits, runs of other signs) are hashed into
BUCKETS buckets. Two multinomials over the buckets are counted: that of trusted target documents,
and that of the raw corpus, all documents. The mean over a document's n-grams of the log-likelihood
ratio of target and raw says how much more it reads like the target; documents at or above a fixed
threshold are kept, unless a base rule fails.

Defined results: a null text has no words and fails; a text without n-grams has ratio 0; without
trusted documents both multinomials are equal and every ratio is 0; a null doc_id is never trusted;
repeated rows get equal answers; an empty table gives no rows; extra columns are not read.
"""

from pyspark.sql import Column, DataFrame, functions as F

from poolwatch.llm.common import documents, let, stored

# One number per bucket comes to the driver and goes into the plan, whatever the input.
BUCKETS = 10_000
# A count added to every bucket of either multinomial, so that no ratio is infinite.
PRIOR = 1.0
# Nats per n-gram. A text of the target mixed evenly with signs and numbers lies far below.
THRESHOLD = -0.5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WIDTH = 5
_SPACE = r"[\x20\x09-\x0D]+"
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def buckets(text: Column, n_buckets: int = BUCKETS) -> Column:
    """Bucket of every token and of every two tokens in a row."""
    hashes = F.transform(F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0)), lambda w: F.xxhash64(w))

    def both(h):
        pairs = F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.size(h)),
                           lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(n_buckets)).cast("int"))
        return F.concat(F.transform(h, lambda a: F.pmod(a, F.lit(n_buckets)).cast("int")), pairs)

    return let(hashes, both)


def log_ratios(docs: DataFrame, trusted: DataFrame, n_buckets: int = BUCKETS) -> list[float]:
    """log(target / raw) of each bucket. `trusted` names target documents by distinct doc_id.

    Documents meet the ids by a shuffle at every size, as ids grow with the corpus. Rows without
    doc_id are never trusted; they stay where they are.
    """
    ids = trusted.withColumn("target", F.lit(1))
    named = docs.filter("doc_id is not null").join(ids.hint("shuffle_hash"), "doc_id", "left")
    marked = named.unionByName(docs.filter("doc_id is null"), allowMissingColumns=True)
    grams = marked.select(F.coalesce("target", F.lit(0)).cast("long").alias("target"), F.explode(buckets(F.col("text"), n_buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = [PRIOR] * n_buckets, [PRIOR] * n_buckets
    for b, r, t in counts:
        raw[b] += r
        target[b] += t
    if not any(t for _, _, t in counts):
        return [0.0] * n_buckets
    from math import log

    all_raw, all_target = sum(raw), sum(target)
    return [log(t / all_target) - log(r / all_raw) for t, r in zip(target, raw)]


def mean_ratio(text: Column, ratios: list[float]) -> Column:
    table = F.expr(f"cast(split('{','.join(f'{x:.6f}' for x in ratios)}', ',') as array<double>)")
    total = lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(table, x))
    return let(buckets(text, len(ratios)), lambda b: F.when(F.size(b) > 0, total(b) / F.size(b)).otherwise(0.0))


def repeated_words(words: Column) -> Column:
    """Words inside windows of WIDTH words that occur twice or more."""

    def of_windows(h):
        def covered(found):
            # Places of windows whose neighbour in hash order is equal, in text order.
            at = F.filter(
                F.transform(found, lambda x, i: F.when(
                    (x["h"] == F.get(found, i - 1)["h"]) | (x["h"] == F.get(found, i + 1)["h"]), x["i"])),
                lambda i: i.isNotNull(),
            )
            return let(F.array_sort(at), lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(WIDTH), F.coalesce(F.get(p, i + 1) - x, F.lit(WIDTH)))),
                F.lit(0), lambda a, x: a + x))

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ordered, covered))

    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WIDTH - 1)),
        lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(WIDTH)]),
    )
    return F.when(F.size(words) < WIDTH + 1, 0).otherwise(let(windows, of_windows))


def measures(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text that is not null."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.transform(
        F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), lambda x: F.xxhash64(x)
    )
    return let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(w).cast("long").alias("n_repeat_words"),
    ))


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, n_buckets: int = BUCKETS) -> DataFrame:
    """Base measures, the mean log ratio, and the verdict on every row. `trusted` has column doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ratios = log_ratios(rows, stored(trusted.select("doc_id").distinct(), "trusted"), n_buckets)
    # The array keeps each row's measures and ratio from being worked out again for every use.
    scored = rows.select("doc_id", measures(F.col("text")).alias("m"), mean_ratio(F.col("text"), ratios).alias("ratio"))
    scored = scored.select("doc_id", F.explode(F.array(F.struct("m.*", "ratio"))).alias("x")).select("doc_id", "x.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and toxic = 0")
    return quality(documents(spark, sf_dir), trusted)
