"""Shards of equal bytes from a k-d tree over document metadata.

Equal texts are one point of the tree, with the size of one of them and the hashes of their least source and language
as coordinates and all their bytes as weight; only a crowd that is heavier than a small share of a shard is dealt to
several points, which stand next to each other. A node that owes m shards is cut along its widest dimension, widths
being shares of the whole table's, at the weighted quantile m // 2 of m, until every leaf owes one shard.

Quantiles are found by histograms: each pass sums the weights of at most BINS bins a node, in partial aggregates, and
goes on inside the bin where the quantile lies, first by coordinate, then by a hash of the text, down to one point.
All nodes of a level share a pass, and the driver sees one row a node. Points are not shuffled for the tree: the cuts
of a level are literals, and points are written with their node once a level. Slots are numbered by counts of hash buckets, bucket by bucket.
Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import only, settle
from citeloom.llm.resampling import CRC_TABLE, crc_sql

SHARDS, OVERHEAD = 24, 8  # fixed values: shards, bytes that a document counts besides its text
SHARE = 256  # a crowd of more than 1 / SHARE of a shard is several points
BINS, BUCKETS = 4096, 4096
DIMENSIONS = ("size", "source_hash", "lang_hash")


def points(docs: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Documents without texts (doc_id, size, text_crc32, point) and points (point, weight, DIMENSIONS)."""
    text, crc = F.coalesce("text", F.lit("")), lambda c: F.crc32(F.encode(F.coalesce(F.col(c).cast("string"), F.lit("")), "UTF-8"))
    d = only(docs, "doc_id", "text", "source", "lang").select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), crc("text").alias("text_crc32"), F.shiftright(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), 2).alias("text_hash"),
        crc("source").alias("source_hash"), crc("lang").alias("lang_hash"), crc("doc_id").alias("id_hash"),
    )
    d = settle(d, "sized")
    total = d.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).head()
    most_bytes, most_rows = (max(1, -(-x // (shards * SHARE))) for x in total)
    own = d.groupBy("text_hash").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("source_hash").alias("one_source"), F.min("lang_hash").alias("one_lang"))
    parts = F.greatest(F.ceil(F.col("b") / most_bytes), F.ceil(F.col("n") / most_rows)).cast("long")
    # no more than 2 * shards * SHARE crowds are heavier than their share of the bytes or of the rows
    crowds = own.where((F.col("b") > most_bytes) | (F.col("n") > most_rows)).select("text_hash", parts.alias("parts"), "one_source", "one_lang")
    d = d.join(F.broadcast(crowds), "text_hash", "left")
    d = d.withColumn("point", F.col("text_hash") * 16384 + F.coalesce(F.col("id_hash") % F.col("parts"), F.lit(0)))
    found = d.groupBy("point").agg(
        F.sum("size").alias("weight"), F.min("size").alias("size"),
        F.coalesce(F.min("one_source"), F.min("source_hash")).alias("source_hash"), F.coalesce(F.min("one_lang"), F.min("lang_hash")).alias("lang_hash"),
    )
    return d.select("doc_id", "size", "text_crc32", "id_hash", "point"), settle(found, "points")


def _known(at: DataFrame, names: str, rows: dict[int, tuple]) -> DataFrame:
    """at with the numbers of each row's node, null for other nodes. There are no more nodes than shards, so they may
    be sent to all tasks."""
    values = ", ".join("(" + ", ".join("null" if v is None else f"{v}L" for v in (k, *r)) + ")" for k, r in rows.items())
    known = at.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(node, {names})")
    return at.join(F.broadcast(known.select("node", *(F.col(n).cast("long").alias(n) for n in names.split(", ")))), "node", "left")


def _stats(at: DataFrame) -> dict[int, dict]:
    ends = [f(x).alias(f"{name}_{x}") for x in DIMENSIONS for f, name in ((F.min, "lo"), (F.max, "hi"))]
    return {r["node"]: r.asDict() for r in at.groupBy("node").agg(F.sum("weight").alias("weight"), *ends).collect()}


def _coordinate() -> Column:
    return F.element_at(F.array(*DIMENSIONS), F.col("along").cast("int") + 1)


def _quantiles(at: DataFrame, goals: dict[int, tuple[int, int, int]], stats: dict[int, dict], along: dict[int, int]) -> dict[int, tuple[int, int, int]]:
    """For each node the coordinate and point at which its weight reaches the left side's share, with whether the
    point goes left: it does if that leaves the smaller error. goals: weight, leaves, leaves of the left side."""
    search = {k: {"lo": stats[k][f"lo_{DIMENSIONS[along[k]]}"], "hi": stats[k][f"hi_{DIMENSIONS[along[k]]}"], "before": 0, "value": None} for k in goals}
    done: dict[int, tuple[int, int, int]] = {}
    while search:
        now = {k: (along[k], s["value"], s["lo"], s["hi"], (s["hi"] - s["lo"]) // BINS + 1, s["before"], goals[k][1], goals[k][0] * goals[k][2]) for k, s in search.items()}
        rows = _known(at, "along, value, low, high, width, before, leaves, goal", now).withColumn("v", _coordinate())
        rows = rows.withColumn("x", F.when(F.col("value").isNull(), F.col("v")).otherwise(F.col("point")))
        rows = rows.where(F.col("x").between(F.col("low"), F.col("high")) & (F.col("value").isNull() | (F.col("value") == F.col("v"))))
        bins = rows.groupBy("node", "before", "leaves", "goal", F.expr("(x - low) div width").alias("bin")).agg(
            F.sum("weight").alias("weight"), F.min("v").alias("v_lo"), F.max("v").alias("v_hi"), F.min("point").alias("p_lo"), F.max("point").alias("p_hi")
        )
        upto = F.sum("weight").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        bins = bins.withColumn("upto", F.col("before") + upto)
        reached = bins.where(F.col("upto") * F.col("leaves") >= F.col("goal"))
        for r in reached.groupBy("node").agg(F.min_by(F.struct("weight", "v_lo", "v_hi", "p_lo", "p_hi", "upto"), "bin").alias("b")).select("node", "b.*").collect():
            k, s = r["node"], search[r["node"]]
            s["before"] = r["upto"] - r["weight"]
            if r["v_lo"] < r["v_hi"]:
                s["lo"], s["hi"] = r["v_lo"], r["v_hi"]
            elif r["p_lo"] < r["p_hi"]:
                s["value"], s["lo"], s["hi"] = r["v_lo"], r["p_lo"], r["p_hi"]
            else:
                weight, leaves, left = goals[k]
                done[k] = (r["v_lo"], r["p_lo"], int((2 * s["before"] + r["weight"]) * leaves <= 2 * weight * left))
                del search[k]
    return done


def grow(at: DataFrame, shards: int = SHARDS) -> DataFrame:
    """points with their shard. A node is named by its first shard; down a level, points go left or right of its cut."""
    at, level, whole = at.withColumn("node", F.lit(0).cast("long")), {0: shards}, None
    while level := {k: n for k, n in level.items() if n > 1}:
        inner = at.where(F.col("node").isin(list(level)))
        stats = _stats(inner)
        whole = whole or stats.get(0)
        if not stats:  # no points
            break
        extent = lambda s, x: s[f"hi_{x}"] - s[f"lo_{x}"]
        share = lambda s, x: extent(s, x) / extent(whole, x) if extent(whole, x) else 0.0
        along = {k: max(range(len(DIMENSIONS)), key=lambda i, s=s: (share(s, DIMENSIONS[i]), -i)) for k, s in stats.items()}
        goals = {k: (s["weight"], level[k], level[k] // 2) for k, s in stats.items()}
        cuts = _quantiles(inner, goals, stats, along)
        placed = _known(at, "along, cut_v, cut_point, keeps, halfway", {k: (along[k], *cuts[k], level[k] // 2) for k in cuts}).withColumn("v", _coordinate())
        on_cut = (F.col("v") == F.col("cut_v")) & ((F.col("point") < F.col("cut_point")) | ((F.col("point") == F.col("cut_point")) & (F.col("keeps") == 1)))
        right = F.col("cut_v").isNotNull() & ~((F.col("v") < F.col("cut_v")) | on_cut)
        # written, as expressions over all levels would grow with the number of cuts, and every pass reads them
        at = settle(placed.withColumn("node", F.col("node") + F.when(right, F.col("halfway")).otherwise(0)).select(*at.columns), "level")
        level = {x: m for k, n in level.items() for x, m in ((k, n // 2), (k + n // 2, n - n // 2))}
    return at.select("point", F.col("node").cast("int").alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of docs.

    A null text counts as empty, a null source or language as an empty one. Equal texts stay together unless they
    weigh more than 1 / SHARE of a shard or a cut falls between the parts of such a crowd; documents of one id and text
    are told apart by nothing and share a part. Texts of any length are whole; a shard with fewer bytes than one
    document may stay empty. Columns other than doc_id, text, source and lang are ignored; no rows give none.
    """
    d, at = points(docs, shards)
    d = settle(d.join(grow(at, shards), "point").withColumn("bucket", F.col("id_hash") % BUCKETS).select("doc_id", "size", "text_crc32", "shard", "bucket", "point"), "homes")
    counts = d.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.select("shard", "bucket", (upto - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32", "point")) - 1
    numbered = d.withColumn("place", place).join(counts, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("place")).cast("long").alias("slot"))


def shard_report(docs: DataFrame) -> DataFrame:
    """shard() with its law; growth by a shard moves any document, so grown_shard is null."""
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _sql() -> str:
    """The same tree by sorting: each level's cut falls where the running weight comes nearest to its share."""
    crc = lambda c: crc_sql(f"encode(coalesce({c}::VARCHAR, ''))")
    share = lambda x: f"CASE WHEN max(g_hi_{x}) > min(g_lo_{x}) THEN (max({x}) - min({x}))::DOUBLE / (max(g_hi_{x}) - min(g_lo_{x}))::DOUBLE ELSE 0 END"
    steps = ["l0 AS (SELECT point, weight, size, source_hash, lang_hash, 0 AS first, %d AS leaves, %s FROM points)" % (SHARDS, ", ".join(f"min({x}) OVER () AS g_lo_{x}, max({x}) OVER () AS g_hi_{x}" for x in DIMENSIONS))]
    level, widest = 0, SHARDS
    while widest > 1:
        a, b, c = DIMENSIONS
        steps.append(f"w{level} AS (SELECT first, sum(weight) AS total, {share(a)} AS a, {share(b)} AS b, {share(c)} AS c FROM l{level} GROUP BY first)")
        steps.append(f"v{level} AS (SELECT l.*, total, CASE WHEN w.a >= w.b AND w.a >= w.c THEN {a} WHEN w.b >= w.c THEN {b} ELSE {c} END AS v FROM l{level} l JOIN w{level} w USING (first))")
        steps.append(f"c{level} AS (SELECT *, 2 * sum(weight) OVER (PARTITION BY first ORDER BY v, point ROWS UNBOUNDED PRECEDING) - weight AS middle FROM v{level})")
        keep = ", ".join(["point", "weight", *DIMENSIONS, *(f"g_{e}_{x}" for x in DIMENSIONS for e in ("lo", "hi"))])
        left = "middle * leaves <= 2 * total * (leaves // 2)"
        steps.append(f"l{level + 1} AS (SELECT {keep}, CASE WHEN leaves = 1 OR {left} THEN first ELSE first + leaves // 2 END AS first, CASE WHEN leaves = 1 THEN 1 WHEN {left} THEN leaves // 2 ELSE leaves - leaves // 2 END AS leaves FROM c{level})")
        level, widest = level + 1, widest - widest // 2
    return rf"""
WITH {CRC_TABLE},
texts AS (SELECT text, {crc("text")} AS text_crc32, ('0x' || substr(md5(coalesce(text, '')), 1, 12))::BIGINT >> 2 AS text_hash FROM (SELECT DISTINCT text FROM documents), crc),
d AS (SELECT doc_id, octet_length(encode(coalesce(x.text, ''))) + {OVERHEAD} AS size, text_crc32, text_hash, {crc("source")} AS source_hash, {crc("lang")} AS lang_hash, {crc("doc_id")} AS id_hash
   FROM documents x JOIN texts y ON x.text IS NOT DISTINCT FROM y.text, crc),
limits AS (SELECT greatest(1, ceil(sum(size)::DOUBLE / {SHARDS * SHARE})::BIGINT) AS most_bytes, greatest(1, ceil(count(*)::DOUBLE / {SHARDS * SHARE})::BIGINT) AS most_rows FROM d),
crowds AS (SELECT text_hash, CASE WHEN sum(size) > any_value(most_bytes) OR count(*) > any_value(most_rows)
   THEN greatest(ceil(sum(size)::DOUBLE / any_value(most_bytes)), ceil(count(*)::DOUBLE / any_value(most_rows)))::BIGINT ELSE 1 END AS parts, min(source_hash) AS one_source, min(lang_hash) AS one_lang FROM d, limits GROUP BY text_hash),
e AS (SELECT d.*, text_hash * 16384 + id_hash % parts AS point, one_source, one_lang FROM d JOIN crowds USING (text_hash)),
points AS (SELECT point, sum(size) AS weight, min(size) AS size, min(one_source) AS source_hash, min(one_lang) AS lang_hash FROM e GROUP BY point),
{", ".join(steps)}
SELECT doc_id, e.size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, l{level}.first::INT AS shard,
  (row_number() OVER (PARTITION BY l{level}.first ORDER BY id_hash % {BUCKETS}, doc_id NULLS FIRST, e.size, text_crc32, point) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM e JOIN l{level} USING (point)
"""


SHARD_SQL = _sql()
