"""Operator 1, line dedup: removing lines that many sites share.

The spread of a line is the number of distinct sites that hold it. Lines seen often enough are
hashed to HyperLogLog sketches, which merge by aggregation, in parts per salt first, so a line on a
third of all pages is not one task's work. A line whose estimate lies clearly above the threshold
goes; one near it is counted exactly.

A document all of whose lines are such lines is a copy as a whole, and stays as it is: whether one of its
copies is enough is for the near-copy operator to say, which keeps one.

Defined results: lines are compared without surrounding white space; blank lines always stay; a
null text stays null, without lines; a null source is one site of its own; a null doc_id and
repeated rows are cleaned like any other; an empty table gives no rows; extra columns are kept, but
for those of the names in `counts`, in whose place the counts come.
"""

from pyspark.sql import Column, DataFrame, functions as F

from poolwatch.llm.common import documents, let, salt, salted_semi, stored

MIN_SITES = 10
# 4096 registers: a standard error of 1.6 %. The band around the threshold is over six of them.
LOG_REGISTERS = 12
NEAR = 0.10
_BLANK = " \t\x0b\x0c\r"


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(_BLANK)))


def site_spread(docs: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """Hashes (line) of the lines that at least `min_sites` distinct sites hold."""
    lines = (
        docs.select(
            "doc_id", F.coalesce(F.xxhash64(F.col("source").cast("string")), F.lit(0)).alias("site"),
            F.col("source").isNull().alias("no_site"), F.explode(F.split("text", "\n")).alias("line"),
        )
        .filter(F.trim("line", F.lit(_BLANK)) != "")
        .select(line_hash(F.col("line")).alias("line"), F.expr("if(no_site, null, site)").alias("site"),
                salt("doc_id", "site").alias("salt"))
    )
    # A line cannot be on more sites than it has rows.
    often = stored(lines.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites), "often")
    site = F.coalesce(F.col("site"), F.lit(0))
    sketches = (
        salted_semi(lines, often, "line")
        .groupBy("line", "salt").agg(F.hll_sketch_agg(site, F.lit(LOG_REGISTERS)).alias("sketch"))
        .groupBy("line").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sites"))
    )
    spread = stored(sketches.filter(F.col("sites") >= (1 - near) * min_sites), "spread")
    sure = F.col("sites") > (1 + near) * min_sites
    exact = (
        salted_semi(lines, spread.filter(~sure), "line")
        .select("line", site.alias("site")).distinct()
        .groupBy("line").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    )
    return stored(spread.filter(sure).select("line").union(exact.select("line")), "boilerplate")


def dedup_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR, counts: tuple[str, str] = ("n_lines", "n_removed")
) -> DataFrame:
    """The documents with `text` cleaned, and before it the numbers of its lines and of those removed; all other
    columns stay."""
    bad = site_spread(docs, min_sites, near)
    held = (
        docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
        .select("doc_id", line_hash(F.col("line")).alias("line")).withColumn("salt", salt("doc_id"))
    )
    # Distinct boilerplate lines of one document: no longer than its text.
    of_doc = salted_semi(held, bad, "line").groupBy(F.col("doc_id").alias("of")).agg(
        F.collect_set("line").alias("bad")
    )
    rest = [c for c in docs.columns if c not in ("doc_id", "text", *counts)]
    kept = docs.alias("d").join(of_doc.alias("b"), F.expr("d.doc_id <=> b.of"), "left")
    lines = F.split("d.text", "\n")
    blank = lambda x: F.trim(x, F.lit(_BLANK)) == ""
    good = let(lines, lambda all_lines: F.filter(
        all_lines, lambda x: blank(x) | ~F.array_contains(F.col("b.bad"), line_hash(x))
    ))
    result = lambda text, n, left: F.struct(text.alias("text"), n.cast("long").alias("n"), (n - left).cast("long").alias("gone"))
    whole = result(F.col("d.text"), F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size(lines), F.lit(0)))
    cleaned = let(good, lambda g: F.when(F.forall(g, blank), whole).otherwise(result(F.array_join(g, "\n"), F.size(lines), F.size(g))))
    same = F.col("b.bad").isNull() | F.col("d.text").isNull()
    taken = kept.select(
        "d.doc_id", F.when(same, whole).otherwise(cleaned).alias("_lines"), *[F.col(f"d.`{c}`") for c in rest],
    )
    n, gone = (F.when(F.col("_lines.text").isNull(), F.lit(0).cast("long")).otherwise(F.col(f"_lines.{c}")) for c in ("n", "gone"))
    return taken.select(
        "doc_id", n.alias(counts[0]), gone.alias(counts[1]), F.col("_lines.text").alias("text"), *[F.col(f"`{c}`") for c in rest]
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = f"""
with lines as (
  select doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as bare
  from (select doc_id, source, unnest(string_split(text, chr(10))) as line,
               unnest(range(len(string_split(text, chr(10))))) as pos
        from documents where text is not null)
), bad as (
  select bare from lines where bare <> '' group by bare
  having count(distinct source) + max(case when source is null then 1 else 0 end) >= {MIN_SITES}
), judged as (
  select l.doc_id, l.pos, l.line, b.bare is not null and bool_or(b.bare is null and l.bare <> '') over (partition by l.doc_id) as goes
  from lines l left join bad b on l.bare = b.bare
), kept as (
  select doc_id, count(*) as n_lines, sum(case when goes then 1 else 0 end) as n_removed,
         coalesce(string_agg(line, chr(10) order by pos) filter (where not goes), '') as text
  from judged group by doc_id
)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, cast(coalesce(k.n_removed, 0) as bigint) as n_removed, k.text
from documents d left join kept k on d.doc_id = k.doc_id
"""
