"""Run stores: JSON lines, documents, tables by key, on any file system Spark reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import loose_udf
from citeloom.session import ship


def read_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object a line; only a newline ends a line, so other separators of Unicode stay in the text."""
    reader = spark.read.option("lineSep", "\n")
    return (reader.schema(schema) if schema else reader).json(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("lineSep", "\n").json(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("lineSep", "\n").json(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as JSON documents."""
    return spark.read.option("multiLine", True).json(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    """A Parquet table; by edition, so that a scan of one edition reads its folder only."""
    w = df.write.mode(mode)
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new lacks."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def pair_files(left: DataFrame, right: DataFrame, position: str) -> DataFrame:
    """Two files line by line; a line without partner fails the job rather than be dropped."""
    l, r = left.withColumnRenamed("text", "left_text"), right.withColumnRenamed("text", "right_text")  # noqa: E741
    both = l.join(r, position, "full_outer")
    whole = F.col("left_text").isNotNull() & F.col("right_text").isNotNull()
    return both.withColumn("left_text", F.when(whole, F.col("left_text")).otherwise(F.raise_error(F.concat(F.lit("no partner at "), F.col(position).cast("string")))))


def same_shape(spec: DataFrame, language: str, parts: list[str]) -> DataFrame:
    """One row a language with the fingerprint of its set of parts; `same` tells whether all are equal."""
    per = spec.groupBy(language).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws("|", *parts))), "\n"), 256).alias("shape"))
    kinds = per.agg(F.countDistinct("shape").alias("kinds"))
    return per.crossJoin(F.broadcast(kinds)).select(language, "shape", (F.col("kinds") == 1).alias("same"))  # one row


def checked_shape(spec: DataFrame, language: str, parts: list[str]) -> DataFrame:
    """same_shape; languages of different shapes fail the job."""
    differ = F.raise_error(F.concat(F.lit("parts differ between languages: "), F.col(language))).cast("boolean")
    return same_shape(spec, language, parts).withColumn("same", F.when(F.col("same"), True).otherwise(differ))


def pinned(df: DataFrame, key: str, text: str, loose: bool = False) -> DataFrame:
    """Digest of each text, or of its loose form, which no change of presentation alters, to be pinned and compared later."""
    if loose:
        ship(df.sparkSession)
    return df.select(key, F.sha2(loose_udf(text) if loose else F.col(text), 256).alias("digest"))


def drift(now: DataFrame, then: DataFrame, key: str) -> DataFrame:
    """Keys whose digest has changed or that are gone."""
    t = then.select(key, F.col("digest").alias("then"))
    return t.join(now.select(key, "digest"), key, "left").where(~F.col("digest").eqNullSafe(F.col("then"))).select(key, F.col("digest").isNull().alias("gone"))


def equal_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Keys whose whole text another key has: key, least key of the group, size of the group. Digests are what is
    shuffled; groups are counted before they are joined back."""
    d = df.select(key, F.sha2(text, 256).alias("digest"))
    groups = d.groupBy("digest").agg(F.min(key).alias("least"), F.count("*").alias("members")).where("members > 1")
    return d.join(groups, "digest").select(key, "least", "members")
