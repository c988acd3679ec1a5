"""Queries of judgements in rounds, of costs and shares, and of a whole summary in long form."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import aggregate as A
from citeloom.operators import rounds as N
from citeloom.plans import scores, texts
from citeloom.sources import store
from citeloom.tables import load


def two_round_identification(spark, sf_dir):
    """Customers as spans, suppliers of their region as editions, those of another nation foreign; the best is found once a nation."""
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = load(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", F.col("n_regionkey").alias("region"), F.col("s_acctbal").alias("score"))
    at = n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    found = at.join(s, F.col("n_regionkey") == F.col("region")).withColumn("foreign", F.col("c_nationkey") != F.col("s_nationkey"))
    best = N.two_rounds(found, "c_nationkey", "foreign", "score", "s_suppkey", 6000, 9000)
    return c.join(best, "c_nationkey").select("c_custkey", "s_suppkey", "score", "round")


def citation_reality(spark, sf_dir):
    """Returned lines cite (part, supplier): whether any other line has the pair."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    out = N.cited_exists(li.where("l_returnflag = 'R'"), li.where("l_returnflag <> 'R'"), ["l_partkey", "l_suppkey"])
    return out.groupBy("l_suppkey").agg(F.count_if("cited_exists").alias("real"), F.count_if(~F.col("cited_exists")).alias("unreal"))


def citation_aliases(spark, sf_dir):
    """Parts whose name and type nearly equal those of another part of their brand and size."""
    p = load(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("block"), "p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("text"))
    return N.aliases(p, p, "block", "p_partkey", "text", X.quote_likeness(F.col("text"), F.col("other_text")), 0.6)


def best_edition_at_reference(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_discount") * 10).alias("score"))
    return N.best_edition(li, "l_partkey", "score", "l_suppkey", 0.6).withColumn("score", F.round("score", 4))


def cost_estimate(spark, sf_dir):
    calls = load(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("tokens"))
    prices = spark.createDataFrame([("R", 0.5), ("A", 0.25)], "l_returnflag string, price double")
    return N.cost(calls, prices, "l_returnflag")


def ascii_shares(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    share = N.ascii_share(F.col("text"))
    return d.select("doc_id", F.round(share, 6).alias("share"), (share > 0.5).alias("mostly_ascii"))


def grade_explanations(spark, sf_dir):
    g = texts.grade_ladder(spark, sf_dir)
    return g.select("grade", N.explain(F.col("grade")).alias("meaning"), "n")


def run_summary(spark, sf_dir):
    """A whole summary in long form (dim, key, value): headline, breakdowns, rates and losses of the scored items."""
    f = scores.facts(spark, sf_dir)
    head = A.macro_mean(f, "lang", "score").select(F.lit("headline").alias("dim"), F.lit("all").alias("key"), F.col("macro_mean").alias("value"))
    parts = A.breakdown(f, ["lang", "tier"], "score").select("dim", "key", F.col("mean").alias("value"))
    lost = A.losses(f, "lang", "cause", "score").select(F.lit("loss").alias("dim"), F.col("cause").alias("key"), F.col("loss").alias("value"))
    return head.unionByName(parts).unionByName(lost)


def tumbling_counts(spark, sf_dir):
    """Extension: events by day and kind, the batch form of the windowed stream."""
    e = load(spark, sf_dir, "events")
    w = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def spec_shapes(spark, sf_dir):
    """Languages as translations of a specification: whether all have the same editions."""
    d = load(spark, sf_dir, "documents")
    return store.same_shape(d, "lang", ["source"])


QUERIES = {f.__name__: f for f in (two_round_identification, citation_reality, citation_aliases, best_edition_at_reference, cost_estimate, ascii_shares, grade_explanations, run_summary, tumbling_counts, spec_shapes)}

SQL = {
    "two_round_identification": """WITH f AS (SELECT c_custkey, s_suppkey, s_acctbal AS score, c_nationkey <> s_nationkey AS foreign_ FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN supplier ON true JOIN nation b ON s_nationkey = b.n_nationkey
WHERE a.n_regionkey = b.n_regionkey),
h AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey) AS r FROM f WHERE NOT foreign_ AND score >= 6000),
o AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey) AS r FROM f WHERE foreign_ AND score >= 9000 AND c_custkey NOT IN (SELECT c_custkey FROM h))
SELECT c_custkey, s_suppkey, score, 1::INT AS round FROM h WHERE r = 1 UNION ALL SELECT c_custkey, s_suppkey, score, 2::INT FROM o WHERE r = 1""",
    "citation_reality": """WITH k AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R')
SELECT l.l_suppkey, count(k.l_partkey) AS real, count(*) - count(k.l_partkey) AS unreal FROM lineitem l LEFT JOIN k USING (l_partkey, l_suppkey) WHERE l_returnflag = 'R' GROUP BY l.l_suppkey""",
    "citation_aliases": """WITH p AS (SELECT p_brand || '/' || p_size AS block, p_partkey, lower(p_name || ' ' || p_type) AS t FROM part)
SELECT a.p_partkey, min(b.p_partkey) AS alias FROM p a JOIN p b ON a.block = b.block AND a.p_partkey <> b.p_partkey AND (contains(a.t, b.t) OR contains(b.t, a.t) OR 1 - levenshtein(a.t, b.t)::DOUBLE / greatest(length(a.t), length(b.t)) >= 0.6) GROUP BY ALL""",
    "best_edition_at_reference": """SELECT l_partkey, l_suppkey, round(score, 4) AS score FROM (SELECT l_partkey, l_suppkey, l_discount * 10 AS score, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount * 10 DESC, l_suppkey) AS r FROM lineitem WHERE l_discount * 10 >= 0.6) WHERE r = 1""",
    "cost_estimate": "SELECT l_returnflag, sum(trunc(l_quantity)::BIGINT)::BIGINT AS tokens, round(sum(trunc(l_quantity)::BIGINT) * CASE l_returnflag WHEN 'R' THEN 0.5::DOUBLE WHEN 'A' THEN 0.25::DOUBLE END, 2) AS cost FROM lineitem GROUP BY l_returnflag",
    "ascii_shares": r"SELECT doc_id, round(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))::DOUBLE / nullif(length(text), 0), 6) AS share, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))::DOUBLE / nullif(length(text), 0) > 0.5 AS mostly_ascii FROM documents",
    "grade_explanations": texts.SQL["grade_ladder"].replace("SELECT grade, count(*) AS n, round(", "SELECT grade, CASE grade WHEN 'perfect' THEN 'Word for word.' WHEN 'near_perfect' THEN 'All but a sign or two.' WHEN 'minor' THEN 'Small slips.' WHEN 'major' THEN 'Clear departures from the text.' WHEN 'severe' THEN 'Barely recognisable.' WHEN 'wrong_version' THEN 'Another edition of the language.' WHEN 'other_language' THEN 'The passage in another language.' WHEN 'wrong_verse' THEN 'A neighbouring passage.' WHEN 'fabricated' THEN 'Matches no passage.' ELSE 'No attempt.' END AS meaning, count(*) AS n FROM g GROUP BY grade --"),
    "run_summary": f"""WITH {scores._FACTS}, g AS (SELECT lang, avg(score) AS m, count(*) AS items FROM facts GROUP BY lang),
l AS (SELECT f.cause, sum((1 - f.score) / (g.items * (SELECT count(*) FROM g))) AS loss FROM facts f JOIN g USING (lang) GROUP BY f.cause)
SELECT 'headline' AS dim, 'all' AS key, (SELECT round(avg(m), 4) FROM g) AS value
UNION ALL SELECT 'lang', lang, round(avg(score), 4) FROM facts GROUP BY lang UNION ALL SELECT 'tier', tier, round(avg(score), 4) FROM facts GROUP BY tier
UNION ALL SELECT 'all', 'all', round(avg(score), 4) FROM facts UNION ALL SELECT 'loss', cause, round(loss, 6) FROM l WHERE loss > 0""",
    "tumbling_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "spec_shapes": """WITH s AS (SELECT lang, sha256(string_agg(source, chr(10) ORDER BY source)) AS shape FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang)
SELECT lang, shape, (SELECT count(DISTINCT shape) FROM s) = 1 AS same FROM s""",
}
