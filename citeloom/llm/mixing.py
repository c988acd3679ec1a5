"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

All in DataFrame and SQL functions. Documents of a source are dealt to about the square root of their
number of blocks, by a hash of the id. A source's target is met by whole passes over its blocks and, for
what is left, by blocks in a permuted order until the target falls within one, of which documents are
taken in a hashed order. The block quotas of all sources are then split among output shards down a binary
tree: a node's blocks go half to either side, and how many of each source go left is drawn from the
multivariate hypergeometric distribution, source by source. Each shard takes the next blocks of each
source's permutation, so shards are disjoint, and orders its rows by a hash of its own.

No task holds more than the blocks of a source, or the documents of a block: the square root of either.
Orders come from md5, so that reruns agree, and any engine can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import settle

#: Fixed values of the mix: weights of the sources in turn, share of all words, most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
LEVELS = 4  # 16 shards
WORDS = r"[^\x20\x09-\x0D]+"


def _order(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def targets(sized: DataFrame) -> DataFrame:
    """sid, source, source_size, documents, target of each source.

    The targets are the water level at which capped and uncapped sources add up: sources in order of
    cap / weight are capped as long as the level that the others would reach lies above theirs.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    every = Window.partitionBy()
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") - 1) % len(WEIGHTS) + 1))
    s = s.withColumn("cap", F.col("source_size") * MOST).withColumn("turn", F.col("cap") / F.col("weight"))
    up = Window.orderBy("turn", "sid")
    before = F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap")
    left = F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(every) * F.lit(SHARE) - before) / left)
    s = s.withColumn("capped", F.col("turn") <= F.col("level"))
    s = s.withColumn("at", F.min(F.when(~F.col("capped"), F.struct("turn", "sid", "level"))).over(every)["level"])
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("at") * F.col("weight"))
    return s.select("sid", "source", "source_size", "documents", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) that the parts fix."""
    return (F.conv(F.substring(_order("draw", *parts), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def _hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of the drawn are good. The law is summed from its mode upwards, then downwards, in
    weights relative to the mode's, over 14 standard deviations on either side; u picks the value."""
    low, high = F.greatest(F.lit(0), drawn - (total - good)), F.least(drawn, good)
    mode = F.floor((drawn + 1) * (good + 1) / (total + 2))
    mode = F.least(F.greatest(mode, low), high).cast("long")
    p = good / total
    reach = (F.lit(14.0) * F.sqrt(drawn * p * (F.lit(1.0) - p)) + 20).cast("long")

    def ratio(k: Column) -> Column:  # weight of k + 1 over that of k
        return (good - k) * (drawn - k) / ((k + 1) * (total - good - drawn + k + 1).cast("double"))

    ups = F.transform(F.sequence(F.lit(0).cast("long"), F.least(reach, high - mode)), lambda i: mode + i)
    downs = F.slice(F.transform(F.sequence(F.lit(0).cast("long"), F.least(reach, mode - low)), lambda i: mode - i), 2, 1_000_000)
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    rise = lambda acc, k: F.struct((acc["w"] * F.when(k > mode, ratio(k - 1)).otherwise(1.0)).alias("w"), (acc["sum"] + acc["w"] * F.when(k > mode, ratio(k - 1)).otherwise(1.0)).alias("sum"))
    fall = lambda acc, k: F.struct((acc["w"] / ratio(k)).alias("w"), (acc["sum"] + acc["w"] / ratio(k)).alias("sum"))
    goal = u * (F.aggregate(ups, start, rise)["sum"] + F.aggregate(downs, start, fall)["sum"])

    def pick(step):
        def f(acc: Column, k: Column) -> Column:
            s = step(acc, k)
            return F.struct(s["w"].alias("w"), s["sum"].alias("sum"), F.when((acc["x"] < 0) & (s["sum"] >= goal), k).otherwise(acc["x"]).alias("x"))

        return f

    begin = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("x"))
    up = F.aggregate(ups, begin, pick(rise))
    down = F.aggregate(downs, F.struct(F.lit(1.0).alias("w"), up["sum"].alias("sum"), up["x"].alias("x")), pick(fall))
    return F.when((total <= 0) | (high <= low), high).otherwise(F.when(down["x"] < 0, mode).otherwise(down["x"]))


def split(quotas: DataFrame, levels: int = LEVELS) -> DataFrame:
    """sid, ends: for each shard, up to which of the source's blocks, in permuted order, it and those before it go.

    quotas: sid, blocks. A row of the tree is a node with its quotas by source; sources are few.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("sid", F.col("blocks").cast("long").alias("n")))).alias("q")).withColumn("node", F.lit(1))
    for _ in range(levels):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
        nodes = nodes.withColumn("total", total)
        begin = F.struct(F.col("total").alias("total"), F.floor(F.col("total") / 2).cast("long").alias("drawn"), F.slice("q", 1, 0).alias("left"))

        def draw(acc: Column, x: Column) -> Column:
            n = _hypergeometric(acc["total"], x["n"], acc["drawn"], _uniform(F.col("node"), x["sid"]))
            taken = F.transform(F.array(n), lambda v: F.struct(x["sid"].alias("sid"), v.cast("long").alias("n")))
            # one draw serves the rest of the node and the list
            return F.element_at(F.transform(taken, lambda t: F.struct((acc["total"] - x["n"]).alias("total"), (acc["drawn"] - t["n"]).alias("drawn"), F.concat(acc["left"], F.array(t)).alias("left"))), 1)

        nodes = nodes.withColumn("left", F.aggregate("q", begin, draw)["left"])
        right = F.transform("q", lambda x, i: F.struct(x["sid"].alias("sid"), (x["n"] - F.get("left", i)["n"]).alias("n")))
        nodes = settle(nodes.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q")))).alias("x")).select("x.node", "x.q"), "nodes")
    each = nodes.select("node", F.explode("q").alias("x")).select("node", "x.sid", "x.n")
    each = each.withColumn("end", F.sum("n").over(Window.partitionBy("sid").orderBy("node")))
    return each.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "end"))), lambda x: x["end"]).alias("ends"))


def mix(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of docs; copies lists one
    (copy, shard, position) for each time the mix takes the document, none to MOST times.

    Null texts have size 0; a null source is a source of its own and comes last. Documents without words
    take part but add nothing. Rows that repeat a doc_id are documents of their own, except that equal
    rows are told apart by nothing. Columns other than doc_id, text and source are ignored.
    """
    sized = settle(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size")), "sized")
    sources = settle(targets(sized), "sources")
    known = sources.select(F.col("source").alias("its"), "sid", "source_size", "target", F.ceil(F.sqrt("documents")).cast("long").alias("blocks"))
    here = sized.join(known, F.col("source").eqNullSafe(F.col("its"))).drop("its")
    number = F.conv(F.substring(_order("block", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 12), 16, 10).cast("long")
    here = settle(here.withColumn("block", number % F.col("blocks")), "here")
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("int")
    b = here.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    b = b.withColumn("whole", whole).withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size"))
    before = F.sum("words").over(Window.partitionBy("sid").orderBy(_order("pass", F.col("sid"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    b = b.withColumn("rest", F.col("quota") - before)
    units = b.select("sid", "block", F.explode(F.filter(F.array(
        F.struct(F.lit(0).alias("copy"), (F.col("whole") > 0).alias("taken"), F.lit(None).cast("double").alias("rest")),
        F.struct(F.lit(1).alias("copy"), (F.col("whole") > 1).alias("taken"), F.lit(None).cast("double").alias("rest")),
        F.struct(F.col("whole").alias("copy"), (F.col("rest") > 0).alias("taken"), F.when(F.col("words") > F.col("rest"), F.col("rest")).alias("rest")),
    ), lambda x: x["taken"])).alias("unit")).select("sid", "block", "unit.copy", "unit.rest")
    units = settle(units.withColumn("rank", F.row_number().over(Window.partitionBy("sid").orderBy(_order("shard", F.col("sid"), F.col("copy"), F.col("block")), "copy", "block"))), "units")
    ends = split(units.groupBy("sid").agg(F.count("*").alias("blocks")), levels)
    units = units.join(ends, "sid").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))
    plan = settle(units.groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard", "rest"))).alias("units")), "plan")
    dealt = here.join(plan, ["sid", "block"], "left").withColumn("units", F.coalesce("units", F.array().cast("array<struct<copy:int,shard:int,rest:double>>")))
    cut = F.exists("units", lambda x: x["rest"].isNotNull())
    within = Window.partitionBy("sid", "block").orderBy(_order("row", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), "doc_id", "size")
    # in the block where the target falls: rows in order as long as they fit, then the one that fits the gap best
    block = Window.partitionBy("sid", "block")
    some = dealt.where(cut).withColumn("cut", F.element_at(F.filter("units", lambda x: x["rest"].isNotNull()), 1)["rest"])
    some = some.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    some = some.withColumn("fits", F.col("upto") <= F.col("cut"))
    some = some.withColumn("gap", F.col("cut") - F.coalesce(F.max(F.when(F.col("fits"), F.col("upto"))).over(block), F.lit(0)))
    some = some.withColumn("off", F.abs(F.col("size") - F.col("gap")))
    some = some.withColumn("best", F.row_number().over(block.orderBy("fits", "off", _order("row", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), "doc_id", "size")))
    some = some.withColumn("in", F.col("fits") | ((F.col("best") == 1) & (F.col("off") < F.col("gap"))))
    both = dealt.where(~cut).withColumn("in", F.lit(True)).unionByName(some.drop("cut", "upto", "fits", "gap", "off", "best"))
    kept = F.filter("units", lambda x: x["rest"].isNull() | F.col("in"))
    copies = F.transform(kept, lambda x: F.struct(x["copy"].alias("copy"), x["shard"].alias("shard"), _order("place", x["shard"], x["copy"], F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("position")))
    return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mixture_report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The rows of docs as often as the mix takes them, with copy, shard and position (the order within the shard).

    Rows that share a doc_id are taken by their common id: of such rows each gets the most copies of any.
    """
    drawn = mix(docs, levels).where(F.size("copies") > 0).groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies"))
    out = docs.join(drawn, F.col("doc_id").eqNullSafe(F.col("__id"))).select(*docs.columns, F.explode("__copies").alias("__copy"))
    return out.select(*docs.columns, F.col("__copy.copy").alias("mix_copy"), F.col("__copy.shard").alias("mix_shard"), F.col("__copy.position").alias("mix_position"))


#: The same mix for the checking engine; which shard a copy goes to is not part of the report.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS documents FROM sized GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM s),
t AS (SELECT *, [3, 1, 2][((sid - 1) % 3 + 1)::INT] AS weight, source_size * 2 AS cap FROM w),
u AS (SELECT *, cap::DOUBLE / weight AS turn FROM t),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - (sum(cap) OVER (ORDER BY turn, sid ROWS UNBOUNDED PRECEDING) - cap)::DOUBLE)
   / (sum(weight) OVER (ORDER BY turn, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM u),
c AS (SELECT *, min(CASE WHEN turn > level THEN {'turn': turn, 'sid': sid, 'level': level} END) OVER () AS lev FROM l),
g AS (SELECT sid, source, source_size, ceil(sqrt(documents))::BIGINT AS blocks,
   CASE WHEN turn <= level THEN cap::DOUBLE ELSE lev.level * weight END AS target FROM c),
here AS (SELECT d.doc_id, d.size, g.sid, g.source_size, g.target,
   ('0x' || substr(md5('block:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT % g.blocks AS block
   FROM sized d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
b AS (SELECT sid, block, sum(size)::BIGINT AS words, first(source_size) AS source_size, first(target) AS target,
   coalesce(floor(first(target) / nullif(first(source_size), 0)), 0)::INT AS whole FROM here GROUP BY sid, block),
q AS (SELECT *, target - whole * source_size - (sum(words) OVER (PARTITION BY sid ORDER BY md5('pass:' || sid || ':' || block), block ROWS UNBOUNDED PRECEDING) - words)::DOUBLE AS rest FROM b),
r AS (SELECT h.*, q.whole, q.words, q.rest,
   sum(h.size) OVER (PARTITION BY h.sid, h.block ORDER BY md5('row:' || coalesce(doc_id::VARCHAR, 'null')), doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
   FROM here h JOIN q USING (sid, block)),
f AS (SELECT *, upto <= rest AS fits FROM r),
e AS (SELECT *, rest - coalesce(max(CASE WHEN fits THEN upto END) OVER (PARTITION BY sid, block), 0)::DOUBLE AS gap FROM f),
o AS (SELECT *, abs(size::DOUBLE - gap) AS off, row_number() OVER (PARTITION BY sid, block
   ORDER BY fits, abs(size::DOUBLE - gap), md5('row:' || coalesce(doc_id::VARCHAR, 'null')), doc_id, size) AS best FROM e)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN rest > 0 AND (words <= rest OR fits OR (best = 1 AND off < gap)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""
