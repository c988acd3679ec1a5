"""Queries of joins, set operations and windows over the star schema and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.operators import attribute as R
from citeloom.operators import reference as Q
from citeloom.sources import store
from citeloom.tables import load


def neighbours_same_group(spark, sf_dir):
    """Each line of an order with its neighbours in the order: their number, and the largest."""
    a = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return R.others_of_group(a, "l_orderkey", "l_linenumber", "l_quantity").withColumnsRenamed({"n": "neighbours"})


def cross_group_candidates(spark, sf_dir):
    """Customers met by suppliers of the same region but another nation."""
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    c = load(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "c_nationkey").agg(F.count("*").alias("customers"))
    s = load(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "s_nationkey").agg(F.count("*").alias("suppliers"))
    return c.join(s, "n_regionkey").where("c_nationkey <> s_nationkey").select("n_regionkey", "c_nationkey", "s_nationkey", (F.col("customers") * F.col("suppliers")).alias("pairs"))


def sibling_extra_members(spark, sf_dir):
    """Suppliers as editions of their nation, parts as books: the sibling with most parts one lacks, and its two dearest."""
    li = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("weight"))
    m = li.join(p, "l_partkey").join(s, "l_suppkey")
    return Q.absent_members(m, "l_suppkey", "l_partkey", "s_nationkey")


def _marked(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("at"))
    return e.withColumn("start", F.floor(F.col("at") / 1000000)).drop("at")


def nearest_within_band(spark, sf_dir):
    """Each purchase and the nearest click of its user: the first within 6 hours after it, else the last within 3 before."""
    e = _marked(spark, sf_dir).withColumn("end", F.col("start"))
    quotes = e.where("event_type = 'purchase'").withColumnRenamed("event_id", "quote")
    refs = e.where("event_type <> 'purchase'").withColumnRenamed("event_id", "ref")
    return R.nearest_reference(quotes, refs, "user_id", "quote", after=21600, before=10800)


def _intervals(spark, sf_dir):
    e = _marked(spark, sf_dir)
    return e.withColumn("end", F.col("start") + 3600)


def overlap_semi(spark, sf_dir):
    e = _intervals(spark, sf_dir)
    return R.overlapping(e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'"), "user_id", keep=True).select("event_id", "user_id")


def overlap_anti(spark, sf_dir):
    e = _intervals(spark, sf_dir)
    return R.overlapping(e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'"), "user_id", keep=False).select("event_id", "user_id")


def references_in_reach(spark, sf_dir):
    e = _intervals(spark, sf_dir)
    quotes = e.where("event_type = 'purchase'").select("event_id", "user_id", "start", "end")
    refs = e.where("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("ref"), "start", "end")
    return R.in_reach(quotes, refs, "user_id", 7200).groupBy("event_id").agg(F.count("*").alias("in_reach"))


def cumulative_window_stop_at_gap(spark, sf_dir):
    """Texts of one to four turns from each turn of a conversation, ended by a missing turn."""
    c = load(spark, sf_dir, "conversations").where("turn % 5 <> 3")
    out = R.runs_from(c, "conv_id", "turn", "text")
    return out.select("conv_id", "turn", "length", F.length("window").alias("n_chars"), F.sha2("window", 256).alias("digest"))


def set_difference_todo(spark, sf_dir):
    """Orders none of whose lines was returned: what is still to do."""
    done = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return load(spark, sf_dir, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


def union_of_tiers(spark, sf_dir):
    """Tiers of parts united, each part in the first tier that has it."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    large, dear = p.where("p_size > 45").select("p_partkey"), p.where("p_retailprice > 1500").select("p_partkey")
    rest = p.where("p_size < 5").select("p_partkey")
    dear = dear.join(large, "p_partkey", "left_anti")
    taken = large.union(dear)
    rest = rest.join(taken, "p_partkey", "left_anti")
    return large.withColumn("tier", F.lit("large")).unionByName(dear.withColumn("tier", F.lit("dear"))).unionByName(rest.withColumn("tier", F.lit("small")))


def priority_argmax(spark, sf_dir):
    """The dearest line of each order, ties to the least line number."""
    li = load(spark, sf_dir, "lineitem")
    best = li.groupBy("l_orderkey").agg(F.max(F.struct("l_extendedprice", (-F.col("l_linenumber")).alias("least"), "l_partkey")).alias("b"))
    return best.select("l_orderkey", F.col("b.l_extendedprice").alias("price"), (-F.col("b.least")).alias("line"), "b.l_partkey")


def references_times_editions(spark, sf_dir):
    """References of each edition, those it lacks dropped: brands by segments that bought them, from the purchases alone."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    had = li.join(o, "l_orderkey").join(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return had.groupBy("p_brand", "c_mktsegment").agg(F.count("*").alias("n"))


def pair_files_full_outer(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    a = c.where("turn = 1").select(F.col("conv_id").alias("position"), "text")
    b = c.where("turn = 2").select(F.col("conv_id").alias("position"), "text").join(a.select("position"), "position", "left_semi")
    a = a.join(b.select("position"), "position", "left_semi")
    out = store.pair_files(a, b, "position")
    return out.select("position", F.length("left_text").alias("left_chars"), F.length("right_text").alias("right_chars"))


def best_first_non_overlap(spark, sf_dir):
    """Of each user's events as spans, those taken largest value first that overlap none taken before."""
    e = _marked(spark, sf_dir).join(load(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    e = e.withColumn("end", F.col("start") + 86400).withColumn("down", -F.col("value"))
    return R.greedy(e, "user_id", ["down", "event_id"]).select("user_id", "event_id", "start")


def range_expand_clamp(spark, sf_dir):
    """Verse by verse mapping of schemes made of orders: ranges of unequal length are clamped."""
    return Q.expand(_maps(spark, sf_dir))


def _maps(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("scheme"))
    key = lambda x: F.concat(F.lit("PSA "), (F.col(x) % 40 + 1).cast("string"), F.lit(":"))
    first, second = F.col("o_orderkey") % 5, F.col("o_custkey") % 7
    return o.select(F.substring("scheme", 1, 1).alias("scheme"), F.concat(key("o_custkey"), first.cast("string"), F.lit("-"), (first + 3).cast("string")).alias("source"), F.concat(key("o_custkey"), second.cast("string"), F.lit("-"), (second + 1).cast("string")).alias("target"))


_MAPS = """maps AS (SELECT DISTINCT substr(o_orderpriority, 1, 1) AS scheme, o_custkey % 40 + 1 AS ch, o_orderkey % 5 AS a, o_custkey % 7 AS b FROM orders),
m AS (SELECT DISTINCT scheme, 'PSA.' || ch || '.' || (a + i) AS ref, 'PSA.' || ch || '.' || (b + least(i, 1)) AS org FROM maps, (SELECT unnest(range(0, 4)) AS i)),
mapping AS (SELECT * FROM m WHERE ref <> org)"""


def first_wins_inverse(spark, sf_dir):
    return Q.inverse(Q.expand(_maps(spark, sf_dir)))


def pivot_translate(spark, sf_dir):
    m = Q.expand(_maps(spark, sf_dir))
    refs = m.select("ref").distinct()
    return Q.translate(refs, m, "1", "2")


def reference_parsing(spark, sf_dir):
    """Part keys as references: syntax, canon, spoken form."""
    books = F.element_at(F.array(*map(F.lit, ["gen", "JHN", "tob", "3MA", "JUD", "XYZ", "PSALM", "2CO"])), (F.col("p_partkey") % 8 + 1).cast("int"))
    p = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), books, F.lit("."), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("."), (F.col("p_partkey") % 1200).cast("string")))).alias("ref"))
    r = Q.parse(F.col("ref"))
    out = p.select("p_partkey", Q.is_verse(F.col("ref")).alias("verse_ok"), Q.is_chapter(F.col("ref")).alias("chapter_ok"), r.alias("r"))
    book = F.col("r.book")
    return out.select("p_partkey", "verse_ok", "chapter_ok", F.when(book.isNotNull(), Q.canon(book)).alias("canon"), Q.spoken(book, book, F.col("r.chapter").cast("string"), F.col("r.verse").cast("string")).alias("spoken"))


def phantom_references(spark, sf_dir):
    """Chapters beyond the end of books made of brands, and next numbers of series."""
    b = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.max("p_size").alias("chapters"))
    b = b.withColumn("pos", F.row_number().over(Window.orderBy("p_brand")) - 1).withColumnRenamed("p_brand", "book")  # a few dozen brands
    out = Q.phantom_chapters(b)
    last = F.regexp_extract("book", r"(\d)", 1).cast("int")
    return out.withColumn("next_in_series", Q.bumped(F.col("book"), last))


def bounds_check(spark, sf_dir):
    """Lines as references (supplier, number): whether a scheme built from one half of the orders has them."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book"), (F.col("l_partkey") % 30).alias("chapter"), F.col("l_linenumber").alias("verse"), "l_orderkey")
    bounds = li.where("l_orderkey % 2 = 0").groupBy("book", "chapter").agg(F.max("verse").alias("max_verse"))
    out = Q.within(li, bounds)
    return out.groupBy("book").agg(F.count_if("exists").alias("found"), F.count_if(~F.col("exists")).alias("absent"))


QUERIES = {
    f.__name__: f
    for f in (
        neighbours_same_group, cross_group_candidates, sibling_extra_members, nearest_within_band, overlap_semi, overlap_anti, references_in_reach, cumulative_window_stop_at_gap, set_difference_todo, union_of_tiers,
        priority_argmax, references_times_editions, pair_files_full_outer, best_first_non_overlap, range_expand_clamp, first_wins_inverse, pivot_translate, reference_parsing, phantom_references, bounds_check,
    )
}

_E = "e AS (SELECT event_id, user_id, event_type, value, floor(epoch_us(ts) / 1000000)::BIGINT AS s FROM events)"
SQL = {
    "neighbours_same_group": "SELECT a.l_orderkey, a.l_linenumber, count(*) AS neighbours, max(b.l_quantity) AS largest FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber GROUP BY ALL",
    "cross_group_candidates": """WITH c AS (SELECT n_regionkey, c_nationkey, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
s AS (SELECT n_regionkey, s_nationkey, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT n_regionkey, c_nationkey, s_nationkey, customers * suppliers AS pairs FROM c JOIN s USING (n_regionkey) WHERE c_nationkey <> s_nationkey""",
    "sibling_extra_members": """WITH m AS (SELECT DISTINCT s_nationkey, l_suppkey, l_partkey, p_size AS weight FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
k AS (SELECT s_nationkey, l_suppkey, count(*) AS size FROM m GROUP BY ALL),
c AS (SELECT a.l_suppkey, b.l_suppkey AS sibling, count(*) AS shared FROM m a JOIN m b ON a.s_nationkey = b.s_nationkey AND a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey GROUP BY ALL),
n AS (SELECT a.l_suppkey, b.l_suppkey AS sibling, b.size - coalesce(c.shared, 0) AS extra FROM k a JOIN k b ON a.s_nationkey = b.s_nationkey AND a.l_suppkey <> b.l_suppkey LEFT JOIN c ON c.l_suppkey = a.l_suppkey AND c.sibling = b.l_suppkey),
b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY extra DESC, sibling) AS r FROM n WHERE extra > 0),
t AS (SELECT b.l_suppkey, b.sibling, b.extra, m.l_partkey, row_number() OVER (PARTITION BY b.l_suppkey ORDER BY weight DESC, m.l_partkey)::INT AS place FROM b JOIN m ON m.l_suppkey = b.sibling
  WHERE b.r = 1 AND NOT EXISTS (SELECT 1 FROM m o WHERE o.l_suppkey = b.l_suppkey AND o.l_partkey = m.l_partkey))
SELECT * FROM t WHERE place <= 2""",
    "nearest_within_band": f"""WITH {_E}, p AS (SELECT q.user_id, q.event_id AS quote, r.event_id AS ref, CASE WHEN r.s >= q.s AND r.s - q.s <= 21600 THEN 0 ELSE 1 END AS side,
  CASE WHEN r.s >= q.s AND r.s - q.s <= 21600 THEN r.s - q.s ELSE q.s - r.s END AS gap
  FROM e q JOIN e r ON q.user_id = r.user_id AND q.event_type = 'purchase' AND r.event_type <> 'purchase' AND (r.s - q.s BETWEEN 0 AND 21600 OR q.s - r.s BETWEEN 0 AND 10800)),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, quote ORDER BY side, gap, ref) AS k FROM p) SELECT user_id, quote, ref, side, gap FROM o WHERE k = 1""",
    "overlap_semi": f"WITH {_E} SELECT q.event_id, q.user_id FROM e q WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM e r WHERE r.user_id = q.user_id AND r.event_type <> 'purchase' AND q.s < r.s + 3600 AND r.s < q.s + 3600)",
    "overlap_anti": f"WITH {_E} SELECT q.event_id, q.user_id FROM e q WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM e r WHERE r.user_id = q.user_id AND r.event_type <> 'purchase' AND q.s < r.s + 3600 AND r.s < q.s + 3600)",
    "references_in_reach": f"WITH {_E} SELECT q.event_id, count(*) AS in_reach FROM e q JOIN e r ON q.user_id = r.user_id AND q.event_type = 'purchase' AND r.event_type <> 'purchase' AND r.s <= q.s + 3600 + 7200 AND r.s + 3600 >= q.s - 7200 GROUP BY ALL",
    "cumulative_window_stop_at_gap": """WITH RECURSIVE c AS (SELECT * FROM conversations WHERE turn % 5 <> 3),
r AS (SELECT conv_id, turn, 1 AS length, text AS w FROM c UNION ALL SELECT r.conv_id, r.turn, r.length + 1, r.w || ' ' || c.text FROM r JOIN c ON c.conv_id = r.conv_id AND c.turn = r.turn + r.length WHERE r.length < 4)
SELECT conv_id, turn, length, length(w)::INT AS n_chars, sha256(w) AS digest FROM r""",
    "set_difference_todo": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "union_of_tiers": "SELECT p_partkey, CASE WHEN p_size > 45 THEN 'large' WHEN p_retailprice > 1500 THEN 'dear' ELSE 'small' END AS tier FROM part WHERE p_size > 45 OR p_retailprice > 1500 OR p_size < 5",
    "priority_argmax": "SELECT l_orderkey, l_extendedprice AS price, l_linenumber AS line, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey DESC) AS k FROM lineitem) WHERE k = 1",
    "references_times_editions": "SELECT p_brand, c_mktsegment, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey GROUP BY ALL",
    "pair_files_full_outer": "SELECT a.conv_id AS position, length(a.text)::INT AS left_chars, length(b.text)::INT AS right_chars FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 1 AND b.turn = 2",
    "range_expand_clamp": f"WITH {_MAPS} SELECT * FROM mapping",
    "first_wins_inverse": f"WITH {_MAPS} SELECT scheme, org, min(ref) AS ref FROM mapping GROUP BY ALL",
    "pivot_translate": f"""WITH {_MAPS}, refs AS (SELECT DISTINCT ref FROM mapping), t AS (SELECT ref, min(org) AS org FROM mapping WHERE scheme = '1' GROUP BY ref),
b AS (SELECT org, min(ref) AS translated FROM mapping WHERE scheme = '2' GROUP BY org), p AS (SELECT ref, coalesce(t.org, ref) AS org FROM refs LEFT JOIN t USING (ref))
SELECT ref, org, coalesce(translated, org) AS translated FROM p LEFT JOIN b USING (org)""",
    "reference_parsing": r"""WITH p AS (SELECT p_partkey, upper(trim(' ' || ['gen', 'JHN', 'tob', '3MA', 'JUD', 'XYZ', 'PSALM', '2CO'][(p_partkey % 8 + 1)::INT] || '.' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '.' || (p_partkey % 1200) END)) AS ref FROM part),
v AS (SELECT *, regexp_matches(ref, '^[0-9A-Z]{3}\.\d{1,3}\.\d{1,3}$') AS ok, string_split(ref, '.') AS s FROM p)
SELECT p_partkey, ok AS verse_ok, regexp_matches(ref, '^[0-9A-Z]{3}\.\d{1,3}$') AS chapter_ok,
CASE WHEN ok THEN CASE s[1] WHEN 'GEN' THEN 'protestant' WHEN 'JHN' THEN 'protestant' WHEN 'JUD' THEN 'protestant' WHEN '2CO' THEN 'protestant' WHEN 'TOB' THEN 'catholic' WHEN '3MA' THEN 'orthodox' ELSE 'other' END END AS canon,
CASE WHEN ok THEN CASE WHEN s[1] = 'JUD' THEN s[1] || ' ' || s[3]::INT ELSE s[1] || ' ' || s[2]::INT || ':' || s[3]::INT END END AS spoken FROM v""",
    "phantom_references": """WITH b AS (SELECT p_brand, max(p_size) AS chapters, row_number() OVER (ORDER BY p_brand) - 1 AS pos FROM part GROUP BY p_brand)
SELECT p_brand AS book, (chapters + CASE WHEN pos % 2 = 0 THEN 3 ELSE 29 END)::INT AS chapter, 1::INT AS verse, regexp_replace(p_brand, '^([^0-9]*)[0-9]', '\\1' || (regexp_extract(p_brand, '([0-9])', 1)::INT + 1)) AS next_in_series FROM b""",
    "bounds_check": """WITH li AS (SELECT l_suppkey AS book, l_partkey % 30 AS chapter, l_linenumber AS verse, l_orderkey FROM lineitem), b AS (SELECT book, chapter, max(verse) AS mv FROM li WHERE l_orderkey % 2 = 0 GROUP BY ALL)
SELECT li.book, count(*) FILTER (verse BETWEEN 1 AND coalesce(mv, 0)) AS found, count(*) FILTER (NOT verse BETWEEN 1 AND coalesce(mv, 0)) AS absent FROM li LEFT JOIN b USING (book, chapter) GROUP BY ALL""",
}
