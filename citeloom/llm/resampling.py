"""Importance resampling of documents towards a target, scored without exploding them.

A document becomes an array of hashed features (runs of words), built by array functions and written once. Its
counts and the target's, one row a bucket and task, are all that is shuffled for the weights. A bucket's gain is
the logarithm of its share in the target over its share in the documents; the gains of all buckets are one literal
array, and a document's weight is the mean of element_at of that array over its own, again without a row a feature.

Documents are then drawn without replacement by the largest weights plus Gumbel noise that a hash of the id fixes.
Their order over the whole table comes from counts by score, of which there are as many as the score's range has
integers, whatever the number of documents; only those drawn are then sorted, score by score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import only, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed values of the draw: buckets, longest run of words, fewest words, percent drawn, seed of the noise.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
BAND = 256


def features(text: Column, longest: int = LONGEST) -> Column:
    """All runs of 1 to longest consecutive words, repeats included; none for null."""
    words = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))

    def runs(w: Column, n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, every).otherwise(F.array().cast("array<string>"))

    if longest == 1:
        return words
    # as a variable of a lambda the words are split once, not once a run
    return F.get(F.transform(F.array(words), lambda w: F.concat(w, *(runs(w, n) for n in range(2, longest + 1)))), F.lit(0))


def _hashed(text: Column, buckets: int, longest: int) -> Column:
    return F.transform(features(text, longest), lambda w: (F.crc32(F.encode(w, "UTF-8")) % buckets).cast("int"))


def _counts(hashed: DataFrame, name: str) -> DataFrame:
    return hashed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket; own and target have an array column buckets. The driver sees `buckets` numbers."""
    both = own.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(_counts(own, "s"), "bucket", "left").join(_counts(target, "t"), "bucket", "left")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    share = (F.col("t") + 1.0) * (F.col("all_s") + float(buckets)) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    rows = both.join(F.broadcast(totals)).select("bucket", F.floor(1000.0 * F.log(share)).cast("long").alias("gain")).collect()
    return [g for _, g in sorted((r["bucket"], r["gain"]) for r in rows)]


def noise(key: Column, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u from a hash of the seed and the key; a null key counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighted(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of docs."""
    text = only(docs, "doc_id", "text")
    words = F.size(features(F.col("text"))).cast("long")
    own = text.select("doc_id", _hashed(F.col("text"), buckets, longest).alias("buckets"), *([words.alias("n_words")] if longest > 1 else []))
    own = settle(own if longest > 1 else own.withColumn("n_words", F.size("buckets").cast("long")), "buckets")
    known = gains(own, only(target, "text").select(_hashed(F.col("text"), buckets, longest).alias("buckets")), buckets)
    gain = F.expr("array(" + ",".join(f"{g}L" for g in known) + ")")
    n = F.size("buckets").cast("long")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(gain, b + 1))
    scored = own.select("doc_id", "n_words", n.alias("n_features"), F.when(n > 0, F.floor(total / n)).otherwise(F.lit(0)).cast("long").alias("weight"))
    return scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def resample(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (1, 2, ... of those drawn, else null) for every row of docs.

    Drawn are the highest scores of the documents of least_words words or more, as many as percent of their number,
    rounded down; ties go to the smaller doc_id, a null one last. Null and empty texts have no features and weight 0,
    however long texts are they are taken whole. Rows that repeat a doc_id are documents of their own with equal noise.
    Only doc_id and text of docs and text of target are read; either may be without rows.
    """
    scored = settle(weighted(docs, target, buckets, longest, seed), "scored")
    fit = F.col("n_words") >= least_words
    by = scored.where(fit).groupBy(F.floor(F.col("score") / BAND).alias("band"), "score").agg(F.count("*").alias("n"))
    by = settle(by, "by-score")  # a row for each integer of the score's range at most
    bands = by.groupBy("band").agg(F.sum("n").alias("in_band"))
    down = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bands = bands.select("band", (F.sum("in_band").over(down) - F.col("in_band")).alias("before"))
    inside = Window.partitionBy("band").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = by.join(bands, "band").select("score", (F.col("before") + F.sum("n").over(inside) - F.col("n")).alias("above"))
    drawn = (by.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0] * percent) // 100
    tops = above.where(F.col("above") < drawn)
    least = tops.agg(F.min("score")).head()[0]
    out = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    high = fit & (F.col("score") >= least)
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    near = scored.where(high).withColumn("place", F.row_number().over(order)).join(F.broadcast(tops), "score")
    place = F.col("above") + F.col("place")
    near = near.select(*out, F.when(place <= drawn, place).cast("long").alias("rank"))
    return scored.where(~high).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(near)


#: CRC-32 of a list of bytes written in hexadecimal, in the checking engine, with the table `crc.t` of 256 entries.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS t)"


def crc_sql(blob: str) -> str:
    return (
        f"xor(list_reduce(list_transform(regexp_extract_all(hex({blob}), '..'), lambda x: ('0x' || x)::BIGINT), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"
    )


RESAMPLE_SQL = rf"""
WITH {CRC_TABLE},
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS words FROM documents),
items AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS words FROM benchmark),
own AS (SELECT r, unnest(words) AS w FROM docs), aim AS (SELECT unnest(words) AS w FROM items),
vocabulary AS (SELECT w, {crc_sql("encode(w)")} % {BUCKETS} AS bucket FROM (SELECT w FROM own UNION SELECT w FROM aim), crc),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM own JOIN vocabulary USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM aim JOIN vocabulary USING (w) GROUP BY bucket),
g AS (SELECT range AS bucket, floor(1000.0 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS}::DOUBLE)
   / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS}::DOUBLE))))::BIGINT AS gain
   FROM range({BUCKETS}) LEFT JOIN s ON s.bucket = range LEFT JOIN t ON t.bucket = range),
m AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM own JOIN vocabulary USING (w) JOIN g USING (bucket) GROUP BY r),
z AS (SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
   coalesce(weight, 0) + floor(-1000.0 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
   FROM docs LEFT JOIN m USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST) AS place, count(*) OVER () AS n FROM z WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * {PERCENT} // 100 THEN place END AS rank FROM z LEFT JOIN o USING (r)
"""
