"""Operator 10, mixing sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). The capacity of
a pattern, its words once, twice, up to `repeats` times, costs more with each repetition; sources
take up to their targets. The flow says how often each pattern is read: whole passes over all its
documents, and a rest that a seeded order fills, with the documents that close its gap best.

The running sum along the seeded order has two levels, buckets of the key and rows inside a bucket,
so a pattern with a third of all rows is spread over all tasks.

Defined results: null text has size 0; a document without words is read once; null source is a source of its own, sorted last; a null
doc_id takes one place in the seeded order; equal rows tie and take any of the tied places; an
empty table gives no rows; extra columns are not read.
"""

from collections import defaultdict, deque
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from poolwatch.llm.common import WORD, documents, stored

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = "mix"
BUCKET_DIGITS = 3
# Patterns of several sources the flow may hold on the driver; more are refused, not dropped.
MAX_PATTERNS = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights=WEIGHTS, repeats: int = REPEATS) -> dict:
    """Words wanted of each source: all words shared by weight, none above `repeats` times its own."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, free = {}, float(sum(sizes.values())), list(names)
    while free:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / whole > repeats * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / whole for s in free}
        for s in over:
            out[s] = float(repeats * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def min_cost_flow(sizes: dict[tuple, int], quotas: dict, repeats: int = REPEATS) -> dict[tuple, int]:
    """Words each pattern gives. `sizes`: words by pattern (a tuple of sources).

    Successive shortest paths. The r-th reading of a pattern costs r - 1, so the costs are convex
    and the readings fill in order.
    """
    start, end = "start", "end"
    room, cost, near = defaultdict(int), {}, defaultdict(list)

    def arc(a, b, capacity, price):
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            if (x, y) not in cost:
                near[x].append(y)
            room[x, y] += c
            cost[x, y] = p

    for pattern, size in sizes.items():
        for r in range(repeats):
            arc(start, ("pass", pattern, r), size, r)
            arc(("pass", pattern, r), ("pattern", pattern), size, 0)
        for source in pattern:
            arc(("pattern", pattern), ("source", source), repeats * size, 0)
    for source, quota in quotas.items():
        arc(("source", source), end, quota, 0)
    while True:
        best, back, queue, queued = {start: 0}, {}, deque([start]), {start}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for b in near[a]:
                if room[a, b] > 0 and best[a] + cost[a, b] < best.get(b, float("inf")):
                    best[b], back[b] = best[a] + cost[a, b], a
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if end not in back:
            return {p: sum(room[("pattern", p), ("pass", p, r)] for r in range(repeats)) for p in sizes}
        path, b = [], end
        while b != start:
            path.append((back[b], b))
            b = back[b]
        push = min(room[x] for x in path)
        for a, b in path:
            room[a, b] -= push
            room[b, a] += push


def source_targets(own: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """targets() of a table (source, own): adds target. The sources stay in their tasks; a row per
    partition and a row per round come to the driver."""
    dealt = stored(own.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()), "mix-own")
    counts, before = dict(dealt.groupBy("part").count().collect()), 0
    starts = []
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    starts = dealt.sparkSession.createDataFrame(starts, "part int, start long")
    inside = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    place = F.col("start") + F.row_number().over(inside) - 1
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (place % len(weights)).cast("int"))
    rows = stored(dealt.join(F.broadcast(starts), "part").select("source", "own", weight.alias("weight")), "mix-weights")
    total, every = rows.agg(F.coalesce(F.sum("own"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, whole, settled = total, every, 0
    while True:
        share = F.lit(float(left)) * F.col("weight") / F.lit(float(max(whole, 1)))
        most = repeats * F.col("own")
        n, held, gone = rows.filter(share > most).agg(F.count("*"), F.sum(most), F.sum("weight")).first()
        # Sources that reached their most stay there, as the share of the others only grows.
        if n <= settled:
            return rows.select("source", "own", F.when(share > most, most).otherwise(share).alias("target"))
        left, whole, settled = total - held, every - gone, n


def _planned(rows: DataFrame, weights, repeats: int) -> DataFrame:
    """passes, rest, targets and source_sizes of each pattern. A source that no pattern of several
    sources names is a flow of its own, the least of its target and its capacity; the others and
    their patterns go through the flow on the driver."""
    sized = stored(rows.groupBy("members").agg(F.sum("size").alias("size")), "mix-patterns")
    parts = sized.select(F.explode("members").alias("source"), (F.col("size") / F.size("members")).alias("own"))
    # A word that several sources hold counts for each of them in part.
    wanted = stored(source_targets(parts.groupBy("source").agg(F.sum("own").alias("own")), weights, repeats), "mix-targets")
    several = sized.filter(F.size("members") != 1).limit(MAX_PATTERNS + 1).collect()
    if len(several) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns of several sources")
    spark = rows.sparkSession
    linked = spark.createDataFrame([(s,) for s in {s for r in several for s in r["members"]}], "source string")
    one = sized.filter(F.size("members") == 1).withColumn("of", F.col("members")[0])
    one = one.join(wanted, F.col("of").eqNullSafe(F.col("source"))).drop("of")

    def named(x, how):
        return x.alias("x").join(linked.alias("l"), F.expr("x.source <=> l.source"), how)

    alone = named(one, "left_anti")
    most = F.least(F.rint("target").cast("long"), repeats * F.col("size"))
    alone = alone.withColumn("flow", most).select(
        "members", F.when(F.col("size") > 0, F.expr("flow div size")).otherwise(0).alias("passes"),
        F.when(F.col("size") > 0, F.col("flow") % F.col("size")).otherwise(0).alias("rest"),
        F.array("target").alias("targets"), F.array("own").alias("source_sizes"),
    )
    if several:
        sizes = {tuple(r["members"]): r["size"] for r in several + named(one, "left_semi").select("members", "size").collect()}
        of = {r["source"]: (r["target"], r["own"]) for r in named(wanted, "left_semi").collect()}
        flow = min_cost_flow(sizes, {s: round(t) for s, (t, _) in of.items()}, repeats)
        shared = [
            (list(p), *(divmod(flow[p], n) if n else (0, 0)), [of[s][0] for s in p], [of[s][1] for s in p])
            for p, n in sizes.items()
        ]
        alone = alone.union(spark.createDataFrame(
            shared, "members array<string>, passes long, rest long, targets array<double>, source_sizes array<double>"
        ))
    return stored(alone, "mix-plan")


def _along(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds `name`, the running sum of size along the key in each pattern. `rows` has the key's bucket."""
    before = Window.partitionBy("members").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        rows.groupBy("members", "bucket").agg(F.sum("size").alias("held"))
        .select("members", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("members", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.join(buckets, ["members", "bucket"]).withColumn(name, F.col("before") + F.sum("size").over(inside))
    return summed.drop("before")


def _filled(chosen: DataFrame) -> DataFrame:
    """Adds fills, 1 for the documents beside the seeded order that bring a pattern to its rest: the
    one that ends nearest, or the longest that fits, twice, and then the nearest, as is better. Where
    more than one document still fits the gap after those three, the seeded order goes on over all that
    do, first those of at most half the gap, so that two rounds halve the gap, until none fits."""
    place = ["members", "key", "upto"]
    free = chosen.filter("extra = 0 and size > 0")

    def beside(gaps, gone):
        rows = free.join(gaps.filter("gap > 0"), "members")
        for x in gone:
            rows = rows.join(x, place, "left_anti")
        return rows

    def less(gaps, taken):
        held = taken.groupBy("members").agg(F.sum("size").alias("held"))
        gap = (F.col("gap") - F.coalesce("held", F.lit(0))).alias("gap")
        return stored(gaps.join(held, "members", "left").select("members", gap), "mix-gaps")

    def picks(gaps, gone, steps):
        picked = []
        for nearest in steps:
            off = F.abs(F.col("size") - F.col("gap"))
            fits = off < F.col("gap") if nearest else F.col("size") <= F.col("gap")
            best = F.min(F.struct(off.alias("off"), "key", "upto", "size")).alias("x")
            found = beside(gaps, gone + picked).filter(fits).groupBy("members").agg(best)
            picked.append(stored(found.select("members", "x.key", "x.upto", "x.size"), "mix-picks"))
            gaps = less(gaps, picked[-1])
        return gaps, picked

    given = chosen.groupBy("members").agg(F.max("rest").alias("rest"), F.sum(F.col("size") * F.col("extra")).alias("n"))
    gaps = stored(given.select("members", (F.col("rest") - F.col("n")).alias("gap")), "mix-gaps")
    (one_gap, one), (more_gap, more) = picks(gaps, [], [True]), picks(gaps, [], [False, False, True])
    fits = beside(more_gap, more).filter("size <= gap").groupBy("members").agg(F.count("*").alias("n"))
    on = stored(fits.filter("n > 1").select("members"), "mix-on")
    while not on.isEmpty():
        small = F.max(F.col("size") * 2 <= F.col("gap"))
        left = beside(more_gap.join(on, "members", "left_semi"), more).filter("size <= gap")
        still = stored(left.groupBy("members").agg(F.max("gap").alias("gap"), small.alias("small")), "mix-still")
        if still.isEmpty():
            last_gap, last = picks(more_gap.join(on, "members", "left_semi"), more, [True])
            more_gap, more = last_gap.union(more_gap.join(on, "members", "left_anti")), more + last
            break
        rows = beside(still, more).filter("size <= if(small, gap div 2, gap)")
        taken = _along(rows, ["key", "upto"], "now").filter("now <= gap").select(*place, "size")
        more.append(stored(taken, "mix-picks"))
        more_gap = less(more_gap, more[-1])
    better = one_gap.withColumnRenamed("gap", "one").join(more_gap.withColumnRenamed("gap", "more"), "members")
    is_one = stored(better.select("members", (F.abs("one") <= F.abs("more")).alias("is_one")), "mix-better")
    fills = [x.join(is_one.filter("is_one"), "members", "left_semi") for x in one]
    fills += [x.join(is_one.filter("not is_one"), "members", "left_semi") for x in more]
    every = reduce(DataFrame.union, fills).select(*place, F.lit(1).alias("fills"))
    return chosen.join(every, place, "left")


def mix(docs: DataFrame, members: Column, seed: str = SEED, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, members and copies, how often the mix reads each document.

    `members` is an array of the sources that hold a document, null among them for no source.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("size"),
            F.array_sort(F.array_distinct(members)).alias("members"), key.alias("key"),
        ),
        "mix",
    )
    plan = _planned(rows, weights, repeats)
    rows = rows.join(plan, "members").withColumn("bucket", F.left("key", F.lit(BUCKET_DIGITS)))
    extra = (F.col("upto") <= F.col("rest")).cast("long")
    chosen = stored(_along(rows, ["key", "size"], "upto").withColumn("extra", extra), "mix-chosen")
    out = _filled(chosen)
    copies = F.col("passes") + F.col("extra") + F.coalesce(F.col("fills"), F.lit(0))
    return out.select(
        "doc_id", "size", "members", "targets", "source_sizes",
        F.when(F.col("size") > 0, copies).otherwise(1).alias("copies"),
    )


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir), F.array(F.col("source").cast("string")))
    return mixed.select(
        "doc_id", "size",
        F.col("source_sizes")[0].cast("long").alias("source_size"),
        F.col("targets")[0].alias("target"),
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents, all columns as they are, each as often as the mix reads it."""
    mixed = mix(docs, F.array(F.col("source").cast("string"))).select(F.col("doc_id").alias("of"), "copies")
    # Rows of one doc_id share its place in the seeded order but for their sizes: they go by the most of them.
    times = mixed.groupBy("of").agg(F.max("copies").alias("copies"))
    rows = docs.alias("d").join(times.alias("t"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("t.of")))
    every = F.array_repeat(F.lit(0), F.col("t.copies").cast("int"))
    return rows.select(F.explode(every).alias("copy"), *[F.col(f"d.`{c}`").alias(f"d_{c}") for c in docs.columns]).drop(
        "copy"
    ).toDF(*docs.columns)


def _pick(name: str, gaps: str, gone: list[str], nearest: bool) -> str:
    """SQL of the document per source that comes closest to its gap, and of the gap it leaves."""
    fits = "abs(c.size - g.gap) < g.gap" if nearest else "c.size <= g.gap"
    skip = "".join(f" and not exists (select 1 from {x} x where x.key = c.key and x.upto = c.upto)" for x in gone)
    return f"""
{name} as (
  select s, key, upto, size from (
    select c.*, row_number() over (partition by c.s order by abs(c.size - g.gap), c.key, c.upto) as place
    from chosen c join {gaps} g on g.s = c.s where g.gap > 0 and extra = 0 and c.size > 0 and {fits}{skip}
  ) where place = 1
), {name}_gap as (select g.s, g.gap - coalesce(p.size, 0) as gap from {gaps} g left join {name} p on p.s = g.s)"""


# A null source is called by a character that sorts after all others.
ORACLE = f"""
with recursive sized as (
  select row_number() over () as r, doc_id, coalesce(source, chr(1114111)) as s,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size,
    md5(concat('{SEED}:', coalesce(cast(doc_id as varchar), 'null'))) as key
  from documents
), sources as (
  select s, cast(sum(size) as bigint) as total, [{', '.join(map(str, WEIGHTS))}][(row_number() over (order by s) - 1) % {len(WEIGHTS)} + 1] as w
  from sized group by s
), filling(round, s, total, w, remaining, share, settled) as (
  select 0, s, total, w, cast(sum(total) over () as double), cast(0 as double), false from sources
  union all
  select round + 1, s, total, w, remaining - sum(case when over then {REPEATS} * total else 0 end) over (),
    case when over then {REPEATS} * total else share end, over or not any_over
  from (
    select *, bool_or(over) over () as any_over from (
      select round, s, total, w, remaining, remaining * w / sum(w) over () as share,
        remaining * w / sum(w) over () > {REPEATS} * total as over
      from filling where not settled
    )
  )
), targets as (select s, total, share as target from filling where settled),
plan as (
  select s, total, target, least(cast(round_even(target, 0) as bigint), {REPEATS} * total) as flow,
    case when total > 0 then flow // total else 0 end as passes, case when total > 0 then flow % total else 0 end as rest
  from targets
), ordered as (
  select d.*, p.rest, sum(size) over (partition by s order by key, size rows unbounded preceding) as upto
  from sized d join plan p using (s)
), chosen as (select *, case when upto <= rest then 1 else 0 end as extra from ordered),
gaps as (select s, max(rest) - sum(size * extra) as gap from chosen group by s),
{_pick('one', 'gaps', [], True)},
{_pick('two', 'gaps', [], False)},
{_pick('three', 'two_gap', ['two'], False)},
{_pick('four', 'three_gap', ['two', 'three'], True)},
fills as (
  select one.key, one.upto from one join one_gap a on a.s = one.s join four_gap b on b.s = one.s where abs(a.gap) <= abs(b.gap)
  union all
  select f.key, f.upto from (select * from two union all select * from three union all select * from four) f
  join one_gap a on a.s = f.s join four_gap b on b.s = f.s where abs(a.gap) > abs(b.gap)
)
select c.doc_id, c.size, p.total as source_size, p.target,
  cast(c.size * (p.passes + c.extra + (f.key is not null)::int) as bigint) as taken
from chosen c join plan p using (s) left join fills f on f.key = c.key and f.upto = c.upto
"""
