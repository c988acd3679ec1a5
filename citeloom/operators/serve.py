"""What a board or an API asks for: ranks, filtered pages with totals, failures, latest versions by key."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def passed(track: Column, score: Column, conceded: Column, error: Column) -> Column:
    """Per-track rule: errors fail; in the affirming direction conceding passes, in the contradicting one holding does."""
    return (
        F.when(error.isNotNull(), False)
        .when(track == "affirm", F.coalesce(conceded, F.lit(False)))
        .when(track == "contradict", ~F.coalesce(conceded, F.lit(False)))
        .otherwise(F.coalesce(score, F.lit(0.0)) >= 1.0)
    )


def leaderboard(board: DataFrame, score: str, tie: str) -> DataFrame:
    """Rank by score, missing last; the board has a row a run, so one ordered window serves."""
    return board.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc_nulls_last(), F.col(tie))))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page in a total order; limit is kept within 1 to 100. Only offset + limit rows of each task are sorted on."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit)))


def outcome_counts(df: DataFrame, ok: str) -> DataFrame:
    return df.agg(F.count_if(F.col(ok)).alias("passed"), F.count_if(~F.col(ok)).alias("failed"), F.count("*").alias("total"))


def overlay(*layers: DataFrame, key: str) -> DataFrame:
    """Rows by key, later layers over earlier ones: an upsert by partial aggregation, whole rows at a time."""
    tagged = [d.withColumn("__layer", F.lit(i)) for i, d in enumerate(layers)]
    both = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in both.columns if c not in (key, "__layer")]
    best = both.groupBy(key).agg(F.max_by(F.struct(*rest), "__layer").alias("row"))
    return best.select(key, *[F.col(f"row.{c}").alias(c) for c in rest])


def version_order(version: Column) -> Column:
    """v0.5 -> 5, v1.2 -> 1002; a suffix comes just below its version."""
    major = F.regexp_extract(version, r"v?(\d+)\.(\d+)", 1).cast("int")
    minor = F.regexp_extract(version, r"v?(\d+)\.(\d+)", 2).cast("int")
    return major * 1000 + minor - F.when(version.rlike(r"\d-"), 0.5).otherwise(0.0)


def slug(text: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", ""), 1, most)


def distinct_labels(df: DataFrame, key: str, label: str) -> DataFrame:
    """Labels that several keys share get their key appended."""
    shared = df.groupBy(label).agg(F.count("*").alias("__n"))
    return df.join(shared, label).withColumn(label, F.when(F.col("__n") > 1, F.concat_ws(" #", label, F.col(key).cast("string"))).otherwise(F.col(label))).drop("__n")


#: Columns of a manifest that its readers do without.
HEAVY = ("items", "hallucination_items", "theology")


def light(manifests: DataFrame) -> DataFrame:
    """Manifests without their lists of items, which are then not read."""
    return manifests.drop(*HEAVY)
