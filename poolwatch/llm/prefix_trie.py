"""Operator 12, conversation prefix trie by the Euler-tour technique.

A node is a sequence of turns with which some conversations start; it is told by the exclusive or of
two 64-bit hashes of (depth, turn), which adds up in any grouping, so a conversation of any length is
worked on in chunks. Each node has an arc into it and one out of it. The next arc on the tour is that
into the first child, into the next sibling, or out of the parent; children stand in the order of
their smallest member.

The tour is list-ranked as a table: arcs that follow each other along one smallest member are one
segment; then rounds of random mates take a quarter of the segments out of the list each, until few
are left, and put them back in reverse. Ranks are the arcs' positions; leaves and savings are put on
the arcs into nodes and summed along the positions in buckets, and a subtree's sum is that at its arc
out less that before its arc in.

Defined results: rows without conv_id are no conversation; a null turn comes first; turns of one
number stand in the order of the MD5 of their role and text, and repeated rows follow each other; a
null role or text is empty; a conversation left without turns is a member of the root alone; an empty
table gives no rows; extra columns are not read. 128 bits of hash stand for a sequence of turns.
"""

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from poolwatch.llm.common import stored

FAMILY = 5
HEADS = 9
# Turns of a conversation that are one group, and nodes of one smallest member that are one.
CHUNK = 4096
RUN = 1024
# Segments ranked on the driver; more are made fewer first.
FEW = 10_000
# Buckets of the tour, a row each on the driver.
PARTS = 4096
ROUNDS = 200
NO_IDS = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """(part, conv_id, digest, size, copies, start): equal turns of a conversation that follow each other, and
    the turns before them. Rows are dealt by ranges, so a long conversation is spread."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.col("turn").cast("long")
    same = (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.isNotNull().alias("has"), F.coalesce(turn, F.lit(0)).alias("turn"),
                             digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
        .filter("conv_id is not null").groupBy("conv_id", "has", "turn", "digest").agg(F.count("*").alias("copies"), F.max("size").alias("size"))
    )
    order = ["has", "turn", "digest"]
    dealt = same.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)

    def count(batches):
        part, last, upto = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            starts = []
            for conv, copies in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                upto = upto if conv == last else 0
                starts.append(upto)
                last, upto = conv, upto + copies
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * batch.num_rows, pa.int32()), *batch.columns, pa.array(starts, pa.int64())],
                names=["part", "conv_id", "digest", "size", "copies", "start"])

    # Turns before a row inside its part; those of earlier parts are added where it is read.
    rows = dealt.select("conv_id", "digest", "size", "copies")
    return stored(rows.mapInArrow(count, "part int, conv_id long, digest binary, size long, copies long, start long"), "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every rebuilt conversation, and (conv_id, chunk, first, last, digest, size, length): the
    depths from first to last that hold an equal turn."""
    parts = turns.groupBy("conv_id", "part").agg(F.sum("copies").alias("n"))
    along = Window.partitionBy("conv_id").orderBy("part")
    before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    given = parts.groupBy("conv_id").agg(F.sum("n").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = F.when(base == F.col("conv_id"), 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    family = given.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = given.withColumns({"base": base, "heads": heads}).join(family, "base", "left").select(
        "conv_id", "base", "heads", "n", F.least("heads", F.coalesce("n_base", F.lit(0))).alias("filled"),
    )
    convs = stored(convs.withColumn("length", F.col("filled") + F.greatest(F.col("n") - F.col("heads"), F.lit(0))), "conversations")
    moved = parts.select("conv_id", "part", before.alias("before")).join(convs.select("conv_id", "heads", "filled", "length"), "conv_id")
    # A conversation has a row in a part for each part only, so no part joins a hot key.
    placed = turns.join(moved, ["conv_id", "part"]).withColumn("start", F.col("start") + F.col("before"))
    own = placed.select(
        "conv_id", "digest", "size", "length",
        (F.greatest(F.col("start"), F.col("heads")) + 1 - F.col("heads") + F.col("filled")).alias("d1"),
        (F.col("start") + F.col("copies") - F.col("heads") + F.col("filled")).alias("d2"),
    )
    first_turns = placed.filter(F.col("start") < HEADS - 1).select(F.col("conv_id").alias("base"), "digest", "size", "start", "copies")
    lent = first_turns.join(convs.filter("heads > 0").select("base", "conv_id", "heads", "length"), "base").select(
        "conv_id", "digest", "size", "length", (F.col("start") + 1).alias("d1"), F.least(F.col("start") + F.col("copies"), F.col("heads")).alias("d2"),
    )
    chunks = own.union(lent).filter("d1 <= d2").withColumn("chunk", F.explode(F.expr(f"sequence(d1 div {CHUNK}, d2 div {CHUNK})")))
    cut = chunks.select(
        "conv_id", "chunk", F.greatest("d1", F.col("chunk") * CHUNK).alias("first"),
        F.least("d2", F.col("chunk") * CHUNK + (CHUNK - 1)).alias("last"), "digest", "size", "length",
    )
    return convs.select("conv_id", "length"), cut


def prefixes(cut: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, size, ended): names of each prefix and of the one before it."""
    rows = cut.repartition("conv_id", "chunk").select(
        "conv_id", "chunk", F.explode(F.sequence("first", "last")).alias("depth"), "digest", "size", (F.col("depth") == F.col("length")).alias("ended"),
        "length",
    ).select("conv_id", "chunk", "depth", "size", "ended", "length", F.xxhash64("depth", "digest").alias("k1"), F.xxhash64("digest", F.lit(7), "depth").alias("k2"))
    along = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.filter(F.col("length") >= CHUNK).groupBy("conv_id", "chunk").agg(F.expr("bit_xor(k1)").alias("k1"), F.expr("bit_xor(k2)").alias("k2"))
    opening = sums.select("conv_id", "chunk", F.lit(-1).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("ended"),
                          F.expr("bit_xor(k1)").over(along).alias("k1"), F.expr("bit_xor(k2)").over(along).alias("k2")).filter("k1 is not null")
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    named = rows.drop("length").unionByName(opening).withColumns(
        {"p1": F.expr("bit_xor(k1)").over(inside), "p2": F.expr("bit_xor(k2)").over(inside)}
    ).filter("depth > 0")
    return stored(named.select("conv_id", F.col("depth").cast("int").alias("depth"), "p1", "p2", F.col("p1").bitwiseXOR(F.col("k1")).alias("q1"),
                               F.col("p2").bitwiseXOR(F.col("k2")).alias("q2"), "size", "ended"), "prefixes")


def ends(prefix: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of the prefixes at which conversations end. Their ids are joined in
    blocks, in parallel; a hash then reads the blocks of a node in order and keeps no more than one."""
    block = F.floor(F.col("conv_id") / F.lit(CHUNK)).alias("block")
    zero = F.lit(0).cast("long")
    ended = prefix.filter("ended").select("depth", "p1", "p2", "conv_id").union(
        convs.filter("length = 0").select(F.lit(0), zero, zero, "conv_id")
    )
    listed = ended.groupBy("depth", "p1", "p2", block).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    key = ["depth", "p1", "p2"]
    dealt = listed.repartition(*key).sortWithinPartitions(*key, "block").select(*key, "ids")

    def digest(batches):
        last, held, done = None, None, []
        def out():
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.string()))],
                                              names=[*key, "ends_sha256"])
        for batch in batches:
            for depth, p1, p2, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, p1, p2) == last:
                    held.update(b",")
                else:
                    if last:
                        done.append((*last, held.hexdigest()))
                    last, held = (depth, p1, p2), hashlib.sha256()
                held.update(ids.encode())
            yield out()
            done = []
        if last:
            done.append((*last, held.hexdigest()))
        yield out()

    return dealt.mapInArrow(digest, "depth int, p1 long, p2 long, ends_sha256 string")


def nodes(prefix: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, n_convs, size, ends_sha256) of each node, the root included."""
    long = lambda x: F.lit(x).cast("long")
    of_turns = prefix.groupBy("depth", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.count("*").alias("n_convs"), F.min("size").alias("size"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        F.lit(0).alias("depth"), long(0).alias("p1"), long(0).alias("p2"), "conv_id", F.lit(None).cast("long").alias("q1"),
        F.lit(None).cast("long").alias("q2"), "n_convs", long(0).alias("size"))
    told = of_turns.unionByName(root).join(ends(prefix, convs), ["depth", "p1", "p2"], "left")
    return stored(told.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS))), "nodes")


def with_siblings(found: DataFrame) -> DataFrame:
    """The nodes with `parent`, their parent's conv_id, and `sibling`, the conv_id of the next child of that
    parent. Children are dealt by ranges of parent and conv_id, so those of one parent may be in many tasks."""
    up = found.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))
    child = found.select("depth", "q1", "q2", "conv_id", "n_convs", "size").join(up, ["depth", "q1", "q2"], "left")
    order = ["depth", "parent", "conv_id"]
    dealt = child.select(*order, "n_convs", "size").repartitionByRange(*order).sortWithinPartitions(*order)
    made = "depth int, parent long, conv_id long, n_convs long, size long, part int, sibling long, opens boolean, closes boolean"
    names = [x.split()[0] for x in made.split(", ")]

    def ahead(batches):
        part, held, opens = TaskContext.get().partitionId(), None, True

        def out(rows, after):
            columns = [rows.column(i) for i in range(5)]
            depth, parent, conv = (c.to_pylist() for c in columns[:3])
            follow = [*zip(depth, parent, conv), after]
            sibling = [n[2] if n is not None and n[:2] == own[:2] else None for own, n in zip(follow, follow[1:])]
            size = rows.num_rows
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([part] * size, pa.int32()), pa.array(sibling, pa.int64()), pa.array([opens, *[False] * (size - 1)]),
                 pa.array([*[False] * (size - 1), after is None])], names=names)

        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield out(held, tuple(batch.column(i)[0].as_py() for i in range(3)))
                    opens = False
                held = batch
        if held is not None:
            yield out(held, None)

    listed = stored(dealt.mapInArrow(ahead, made), "siblings")
    # A row per partition.
    edges = listed.filter("opens").select("part", "depth", "parent", "conv_id").orderBy("part").collect()
    after = [(a["part"], b["depth"], b["parent"], b["conv_id"]) for a, b in zip(edges, edges[1:])]
    edge = found.sparkSession.createDataFrame(after, "part int, next_depth int, next_parent long, next_conv long")
    over = F.col("closes") & (F.col("next_depth") == F.col("depth")) & F.col("next_parent").eqNullSafe(F.col("parent"))
    return listed.join(F.broadcast(edge), "part", "left").select(
        "conv_id", "depth", "parent", "n_convs", "size", F.when(over, F.col("next_conv")).otherwise(F.col("sibling")).alias("sibling")
    )


def arcs_of(listed: DataFrame) -> DataFrame:
    """The nodes with n_children, first_child, and the heads of the segments that hold their two arcs: depths at
    which the run of arcs into, and out of, nodes of one smallest member begins."""
    kids = listed.filter("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).cast("int").alias("depth")).agg(
        F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    stacked = listed.unionByName(kids, allowMissingColumns=True).withColumn("run", F.expr(f"depth div {RUN}")).repartition("conv_id", "run")
    one = Window.partitionBy("conv_id", "run", "depth")
    met = stacked.withColumns({c: F.max(c).over(one) for c in ("n_children", "first_child")}).filter("n_convs is not null")
    whole = Window.partitionBy("conv_id", "run")
    deeper = whole.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    # A run of arcs out of nodes ends where a sibling comes next.
    broken = met.withColumn("breaks", F.coalesce(F.sum(F.col("sibling").isNotNull().cast("int")).over(deeper), F.lit(0)))
    return stored(broken.withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)), "into_head": F.min("depth").over(whole),
        "out_head": F.max("depth").over(Window.partitionBy("conv_id", "run", "breaks")),
    }).drop("run", "breaks"), "arcs")


def arc(depth: Column, out: int) -> Column:
    return depth.cast("long") * 2 + out


def segments(arcs: DataFrame) -> DataFrame:
    """(a, b, na, nb, w): each segment (conv_id and arc of its head), the one after it, and its number of arcs."""
    child, leaf = arc(F.col("depth") + 1, 0), F.col("n_children") == 0
    last = F.struct("depth", F.when(leaf, F.col("conv_id")).otherwise(F.col("first_child")).alias("na"),
                    F.when(leaf, arc(F.col("depth"), 1)).otherwise(child).alias("nb"))
    into = arcs.groupBy("conv_id", F.col("into_head").alias("head")).agg(F.max(last).alias("x"), F.count("*").alias("w")).select(
        F.col("conv_id").alias("a"), arc(F.col("head"), 0).alias("b"), "x.na", "x.nb", "w")
    beside = F.col("sibling").isNotNull()
    top = F.struct("depth", F.when(beside, F.col("sibling")).otherwise(F.col("parent")).alias("na"),
                   F.when(beside, arc(F.col("depth"), 0)).when(F.col("depth") > 0, arc(F.col("depth") - 1, 1)).alias("nb"))
    out = arcs.groupBy("conv_id", F.col("out_head").alias("head")).agg(F.min(top).alias("x"), F.count("*").alias("w")).select(
        F.col("conv_id").alias("a"), arc(F.col("head"), 1).alias("b"), "x.na", "x.nb", "w")
    return into.union(out)


def list_ranks(items: DataFrame, few: int = FEW) -> DataFrame:
    """(a, b, start): the weight before each item of one linked list (a, b, na, nb, w), whose last has no next.

    In a round each item draws a coin by hash; an item of tails behind one of heads is merged into it.
    """
    spark = items.sparkSession
    now, steps = stored(items, "list"), []
    while now.count() > few:
        if len(steps) == ROUNDS:
            raise RuntimeError(f"not a list: more than {few} items after {ROUNDS} rounds")
        coin = lambda *c: F.xxhash64(*c, F.lit(len(steps))).bitwiseAND(1) == 1
        takes = ~coin("a", "b") & F.col("nb").isNotNull() & coin("na", "nb")
        mates = now.filter(takes).select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("na").alias("a"), F.col("nb").alias("b"), F.col("w").alias("pw"))
        tails = now.filter(coin("a", "b")).join(mates, ["a", "b"], "left")
        gone = F.col("pb").isNotNull()
        merged = tails.select(
            F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"), "na", "nb", (F.col("w") + F.coalesce("pw", F.lit(0))).alias("w"),
            F.when(gone, F.col("a")).alias("ra"), F.when(gone, F.col("b")).alias("rb"), "pw",
        )
        idle = now.filter(~coin("a", "b") & ~takes).select("a", "b", "na", "nb", "w")
        step = stored(merged.unionByName(idle, allowMissingColumns=True), "list")
        steps.append(step.filter("rb is not null").select("a", "b", F.col("ra"), F.col("rb"), F.col("pw")))
        now = step.select("a", "b", "na", "nb", "w")
    rest = {(r["a"], r["b"]): r for r in now.collect()}  # at most `few`
    reached = {(r["na"], r["nb"]) for r in rest.values()}
    at, before, ranks = next((k for k in rest if k not in reached), None), 0, []
    while at in rest:
        ranks.append((*at, before))
        before, at = before + rest[at]["w"], (rest[at]["na"], rest[at]["nb"])
    if len(ranks) < len(rest):
        raise RuntimeError("not a list: some items are not reached")
    known = spark.createDataFrame(ranks, "a long, b long, start long")
    for step in reversed(steps):
        back = step.join(known, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"), (F.col("start") + F.col("pw")).alias("start"))
        known = known.union(stored(back, "ranks"))
    return known


def tour_sums(arcs: DataFrame, starts: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of each subtree, by prefix sums along the tour."""
    both = arcs.select(
        "conv_id", "depth", F.explode(F.array(
            F.struct(F.lit(0).alias("out"), arc(F.col("into_head"), 0).alias("b"), (F.col("depth") - F.col("into_head")).alias("after"),
                     (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved")),
            F.struct(F.lit(1).alias("out"), arc(F.col("out_head"), 1).alias("b"), (F.col("out_head") - F.col("depth")).alias("after"),
                     F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")),
        )).alias("x"),
    ).select(F.col("conv_id").alias("a"), "depth", "x.*")
    placed = stored(both.join(starts, ["a", "b"]).select("a", "depth", "out", (F.col("start") + F.col("after")).alias("at"), "leaves", "saved"), "tour")
    width = max(CHUNK, -(-placed.count() // PARTS))
    placed = placed.withColumn("bucket", F.expr(f"at div {width}"))
    # At most PARTS rows.
    totals = sorted(tuple(r) for r in placed.groupBy("bucket").agg(F.sum("leaves"), F.sum("saved")).collect())
    carried, leaves, saved = [], 0, 0
    for bucket, x, y in totals:
        carried.append((bucket, leaves, saved))
        leaves, saved = leaves + x, saved + y
    carry = placed.sparkSession.createDataFrame(carried, "bucket long, leaves0 long, saved0 long")
    upto = Window.partitionBy("bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("a", "depth", "out", "bucket", "leaves", "saved", F.sum("leaves").over(upto).alias("l"), F.sum("saved").over(upto).alias("s"))
    summed = summed.join(F.broadcast(carry), "bucket")
    # What came before the arc in is taken from what came up to the arc out.
    sign = F.when(F.col("out") == 1, 1).otherwise(-1)
    before = lambda up, own, carry0: sign * (F.col(up) + F.col(carry0) - F.col(own))
    return summed.select(F.col("a").alias("conv_id"), "depth", before("l", "leaves", "leaves0").alias("leaves"), before("s", "saved", "saved0").alias("saved"))


def prefix_trie(conversations: DataFrame, few: int = FEW) -> DataFrame:
    convs, cut = rebuilt(numbered(conversations))
    prefix = prefixes(cut)
    found = nodes(prefix, convs)
    arcs = arcs_of(with_siblings(found))
    sums = tour_sums(arcs, list_ranks(segments(arcs), few))
    own = arcs.select("conv_id", "depth", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), "parent", "n_convs", "n_children")
    digests = found.select("conv_id", "depth", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), "ends_sha256")
    every = sums.unionByName(own, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
    return every.groupBy("conv_id", "depth").agg(
        F.max("parent").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.max("n_children").alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"),
    ).withColumn("depth", F.col("depth").cast("long"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# DuckDB has no CRC-32: worked out bit by bit over the decimal digits.
ORACLE = r"""
with recursive turns as (
  select conv_id, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first,
      md5(octet_length(encode(coalesce(role, '')))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as pos,
    md5(octet_length(encode(coalesce(role, '')))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as m
  from conversations where conv_id is not null
), ids as (select conv_id, conv_id - conv_id % 5 as base, count(*) as n from turns group by 1, 2),
crc(conv_id, s, k, x) as (
  select conv_id, conv_id::varchar, 0, 4294967295::bigint from ids
  union all
  select conv_id, s, k + 1,
    case when k % 9 = 0 then xor(x, ascii(substr(s, k // 9 + 1, 1))::bigint)
         when x % 2 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end
  from crc where k < 9 * length(s)
), heads as (
  select conv_id, xor(x, 4294967295::bigint) % 9 as h from crc where k = 9 * length(s)
), convs as (
  select i.conv_id, i.base, h, coalesce(least(h, b.n), 0) as filled
  from ids i join heads using (conv_id) left join ids b on b.conv_id = i.base
), rebuilt as (
  select c.conv_id, t.pos as depth, m, text from convs c join turns t on t.conv_id = c.base and t.pos <= h
  union all
  select c.conv_id, t.pos - h + filled, m, text from convs c join turns t on t.conv_id = c.conv_id and t.pos > h
), named as (
  select conv_id, depth, octet_length(encode(text)) as size, string_agg(m, '') over (partition by conv_id order by depth) as p
  from rebuilt
), prefix as (
  select conv_id, depth, size, md5(p) as p from named union all select conv_id, 0, 0, '' from convs
), lengths as (select conv_id, max(depth) as len from prefix group by 1),
node as (select depth, p, min(conv_id) as conv_id, count(*) as n, min(size) as size from prefix group by 1, 2),
linked as (
  select x.depth, x.p, x.conv_id, x.n, x.size, y.p as up, z.conv_id as parent
  from node x left join prefix y on y.conv_id = x.conv_id and y.depth = x.depth - 1
  left join node z on z.depth = y.depth and z.p = y.p
), kids as (select depth - 1 as depth, up as p, count(*) as n_children from linked where depth > 0 group by 1, 2),
sums as (
  select a.depth, a.p, sum(case when k.n_children is null then 1 else 0 end)::bigint as n_leaves, sum((v.n - 1) * v.size)::bigint as saved
  from node v join prefix a on a.conv_id = v.conv_id and a.depth <= v.depth left join kids k on k.depth = v.depth and k.p = v.p
  group by 1, 2
), ended as (
  select p.depth, p.p, string_agg(p.conv_id::varchar, ',' order by p.conv_id) as ids
  from prefix p join lengths l on l.conv_id = p.conv_id and l.len = p.depth group by 1, 2
)
select l.conv_id, l.depth::bigint as depth, l.parent as parent_conv_id, l.n as n_convs, coalesce(n_children, 0) as n_children,
  n_leaves, saved as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from linked l left join kids using (depth, p) join sums using (depth, p) left join ended using (depth, p)
"""
