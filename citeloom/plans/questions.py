"""Queries that draw question sets: parts as chapters, brands as books, sizes as editions."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import questions as N
from citeloom.tables import load


def _first_digit(c):
    return F.regexp_extract(c, r"(\d)", 1).cast("int")


def impossible_items(spark, sf_dir):
    """What each edition can be asked that does not exist: chapters, verses and books, and books its next sibling has."""
    p = load(spark, sf_dir, "part")
    bounds = p.groupBy(F.col("p_brand").alias("book"), F.col("p_size").alias("chapter")).agg(F.max((F.col("p_partkey") % 176 + 1).cast("int")).alias("max_verse"))
    names = p.select(F.col("p_size").alias("edition"), F.col("p_brand").alias("book"), F.col("p_brand").alias("name")).distinct()
    series = names.select("book", _first_digit(F.col("name")).alias("last")).distinct()
    absent = names.select((F.col("edition") - 1).alias("edition"), "book", "name").join(names.select("edition", "book"), ["edition", "book"], "left_anti")
    return N.impossible_items(N.beyond(bounds), series, names, absent.where("edition > 0"))


def _spec(spark, sf_dir):
    p = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("clause"), F.col("p_size").alias("probe")).agg(F.min("p_name").alias("claim"))
    return p.select("clause", "probe", F.explode(F.array(F.lit("eng"), F.lit("fra"))).alias("language"), "claim").select("language", "clause", "probe", F.concat("language", F.lit(" yes "), "claim").alias("affirm"), F.concat("language", F.lit(" no "), "claim").alias("contradict"))


def probes_in_both_directions(spark, sf_dir):
    return N.probes(_spec(spark, sf_dir), "eng", 4, "s")


def human_references(spark, sf_dir):
    """Parts as verses under the name of their type, in capitals as it is, in small letters, or with none."""
    p = load(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    book = F.element_at(F.array(*map(F.lit, ["GEN", "JUD", "JHN"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    ref = F.concat_ws(".", book, F.col("p_size").cast("string"), (F.col("p_partkey") % 90 + 1).cast("string"))
    name = F.when(k == 0, F.upper("p_type")).when(k == 1, F.lower("p_type")).when(k == 2, F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))))
    return p.select("p_partkey", N.human_reference(ref, name, F.lit("Book")).alias("display"))


def editions_in_order(spark, sf_dir):
    """Editions (suppliers) over all parts of the question set, each once, by language (nation), then name."""
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("edition"), "s_nationkey", "s_name")
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    li = load(spark, sf_dir, "lineitem")
    both = li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("edition")).union(li.where("l_linestatus = 'O'").select("l_suppkey")).distinct()
    e = both.join(s, "edition").join(n, "s_nationkey")
    place = F.row_number().over(N.Window.partitionBy("n_name").orderBy("s_name", "edition"))
    return e.select("edition", "n_name", "s_name", place.alias("place"))


QUERIES = {f.__name__: f for f in (impossible_items, probes_in_both_directions, human_references, editions_in_order)}
SQL = {
    "impossible_items": r"""WITH g AS (SELECT p_brand AS book, p_size AS chapter, max((p_partkey % 176 + 1)::INT) AS max_verse FROM part GROUP BY ALL),
n AS (SELECT DISTINCT p_size AS edition, p_brand AS book FROM part),
l AS (SELECT book, max(chapter) AS last, max(max_verse) AS verses, (row_number() OVER (ORDER BY book) - 1) % 2 AS odd FROM g GROUP BY book),
m AS (SELECT l.book, last, verses, CASE WHEN odd = 0 THEN 3 ELSE 29 END AS off, (SELECT min(chapter) FROM g WHERE g.book = l.book AND g.max_verse = l.verses) AS longest FROM l),
f AS (SELECT edition, regexp_replace(book, '^(\D*)\d', '\1' || (regexp_extract(book, '\d')::INT + 1)) AS fake FROM n WHERE regexp_extract(book, '\d') <> '9')
SELECT edition, 'out_of_range_chapter' AS kind, book || ' ' || (last + off) || ':1' AS display FROM m JOIN n USING (book)
UNION SELECT edition, 'out_of_range_verse', book || ' ' || longest || ':' || (verses + off) FROM m JOIN n USING (book)
UNION SELECT edition, 'fake_book', fake || ' 1:1' FROM f WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.edition = f.edition AND lower(n.book) = lower(fake))
UNION SELECT edition - 1, 'absent_from_version', book || ' 1:1' FROM n WHERE edition > 1 AND NOT EXISTS (SELECT 1 FROM n o WHERE o.edition = n.edition - 1 AND o.book = n.book)""",
    "probes_in_both_directions": """WITH p AS (SELECT p_brand AS clause, p_size AS probe, min(p_name) AS claim FROM part GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY clause ORDER BY sha256('s:' || clause || ':' || probe), clause || ':' || probe) AS r FROM p)
SELECT language, clause, probe, direction, language || CASE direction WHEN 'affirm' THEN ' yes ' ELSE ' no ' END || claim AS claim FROM d, (VALUES ('eng'), ('fra')) AS l(language), (VALUES ('affirm'), ('contradict')) AS x(direction) WHERE r <= 4""",
    "human_references": r"""WITH p AS (SELECT p_partkey, ['GEN', 'JUD', 'JHN'][(p_partkey % 3 + 1)::INT] AS book, p_size AS c, p_partkey % 90 + 1 AS v,
coalesce(CASE p_partkey % 4 WHEN 0 THEN upper(p_type) WHEN 1 THEN lower(p_type) WHEN 2 THEN upper(replace(p_name, ' ', '-')) END, 'Book') AS own FROM part),
w AS (SELECT *, CASE WHEN upper(own) = own AND lower(own) <> own THEN list_aggregate(list_transform(regexp_extract_all(own, '\p{L}+|[^\p{L}]+'), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '') ELSE own END AS name FROM p)
SELECT p_partkey, name || ' ' || CASE WHEN book = 'JUD' THEN '' ELSE c || ':' END || v AS display FROM w""",
    "editions_in_order": """SELECT s_suppkey AS edition, n_name, s_name, row_number() OVER (PARTITION BY n_name ORDER BY s_name, s_suppkey)::INT AS place FROM supplier JOIN nation ON n_nationkey = s_nationkey
WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'O')""",
}
