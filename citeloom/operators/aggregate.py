"""Reports over scored items: macro averages, breakdowns, exact loss attribution, ledgers and slices.

Facts come as one row an item; every function is one or two partial aggregations on low-cardinality
keys, so what is shuffled is a few rows a task. Group sizes come from an aggregate and a join, not from a
window, which would bring all items of a group into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(condition: Column) -> Column:
    """Share of rows for which the condition holds; null counts as no, no rows give 0."""
    return F.coalesce(F.avg(F.when(condition, 1.0).otherwise(0.0)), F.lit(0.0))


def mean_or_zero(value: str) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def group_means(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def macro_mean(df: DataFrame, group: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean of group means: a group of two weighs as much as one of a hundred. With `by`, for each of its
    values over the groups that have it; a group without it is missing, not zero."""
    by = by or []
    inner = df.groupBy(*by, group).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return inner.groupBy(*by).agg(F.round(F.coalesce(F.avg("mean"), F.lit(0.0)), 4).alias("macro_mean"), F.count("*").alias("groups"), F.sum("n").alias("items"))


def breakdown(df: DataFrame, dims: list[str], value: str) -> DataFrame:
    """Long form (dim, key, n, mean) of each dimension and of the whole, in one pass over grouping sets."""
    rows = df.select(*dims, value).groupingSets([[F.col(d)] for d in dims] + [[]], *[F.col(d) for d in dims])
    out = rows.agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    dim = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.lit(d)) for d in dims], F.lit("all"))
    key = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.col(d).cast("string")) for d in dims], F.lit("all"))
    return out.select(dim.alias("dim"), key.alias("key"), "n", "mean")


def losses(df: DataFrame, group: str, cause: str, value: str) -> DataFrame:
    """What each cause takes from the macro mean: sum of (1 - value) / (items of the group * groups). The
    losses of all causes add up to 1 - macro mean."""
    per = df.groupBy(group, cause).agg(F.sum(1 - F.col(value)).alias("loss"), F.count("*").alias("n"))
    size = df.groupBy(group).agg(F.count("*").alias("items"))
    groups = size.agg(F.count("*").alias("groups"))
    joined = per.join(size, group).crossJoin(F.broadcast(groups))  # one row
    out = joined.groupBy(cause).agg(F.sum(F.col("loss") / (F.col("items") * F.col("groups"))).alias("loss"), F.sum("n").alias("n"))
    return out.where(F.col("loss") > 0).select(cause, F.round("loss", 6).alias("loss"), "n")


def points(score: Column, direction: Column) -> Column:
    """Ledger points of a track: credit 100 * score, debit -100 * (1 - score)."""
    return F.when(direction == "credit", score * 100).otherwise((1 - score) * -100)


def composite(tracks: DataFrame) -> DataFrame:
    """tracks: track, direction, score (null if not run). One row: points of the present tracks, and whether some lack."""
    return tracks.agg(
        F.round(F.sum(points(F.col("score"), F.col("direction"))), 2).alias("points"),
        F.count("score").alias("tracks"),
        (F.count("*") > F.count("score")).alias("partial"),
    )


def slices(df: DataFrame, edition: str, language: str, value: str) -> DataFrame:
    """Each edition as a slice: its own items where it has any, else (tracks without editions) its language's.

    df: edition (null for tracks without one), language, track, value. The slice dimension is the distinct
    editions with their languages, a table as small as the catalogue.
    """
    dim = df.where(F.col(edition).isNotNull()).select(F.col(edition).alias("slice"), F.col(language).alias("slice_language")).distinct()
    own = df.where(F.col(edition).isNotNull()).groupBy(F.col(edition).alias("slice"), F.col(language).alias("slice_language"), "track").agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    shared = df.where(F.col(edition).isNull()).groupBy(F.col(language).alias("slice_language"), "track").agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    both = own.unionByName(dim.join(shared, "slice_language").select("slice", "slice_language", "track", "total", "n"))
    return both.select("slice", "slice_language", "track", "n", F.round(F.col("total") / F.col("n"), 4).alias("mean"))


def usage(*runs: DataFrame) -> DataFrame:
    """Calls and tokens over runs; a missing count is 0."""
    both = runs[0]
    for r in runs[1:]:
        both = both.unionByName(r, allowMissingColumns=True)
    return both.agg(F.count("*").alias("calls"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))


# -- encounters: conversations that concede at some turn, or never ------------------------------------


def reached_by(turn: int) -> Column:
    """Share conceded at `turn` or before, among encounters without error; null if there are none."""
    usable = F.col("error").isNull()
    return F.avg(F.when(usable, F.when(F.col("turn_reached") <= turn, 1.0).otherwise(0.0)))


def encounter_sides(encounters: DataFrame, turn: int, group: str, complement: bool) -> DataFrame:
    """Rate by group, rounded before it is averaged over groups; complement turns a rate into what was held."""
    rate = F.round(reached_by(turn), 4)
    per = encounters.groupBy(group).agg((1 - rate if complement else rate).alias("rate"), F.count_if(F.col("error").isNull()).alias("n"))
    return per.select(group, F.round("rate", 4).alias("rate"), "n")


def turn_curve(encounters: DataFrame, by: list[str]) -> DataFrame:
    """Share conceded by each turn, up to the longest encounter of the group; errors are left out."""
    usable = encounters.where(F.col("error").isNull())
    at = usable.groupBy(*by).agg(F.max("turns").alias("depth"), F.count("*").alias("n"))
    hits = usable.where(F.col("turn_reached").isNotNull()).groupBy(*by, F.col("turn_reached").alias("at")).agg(F.count("*").alias("hits"))
    grid = at.select(*by, "n", F.explode(F.sequence(F.lit(1), F.col("depth").cast("int"))).alias("turn"))
    joined = grid.join(hits, by, "left").groupBy(*by, "turn").agg(F.max("n").alias("n"), F.sum(F.when(F.col("at") <= F.col("turn"), F.col("hits")).otherwise(0)).alias("conceded"))
    return joined.select(*by, "turn", F.round(F.col("conceded") / F.col("n"), 4).alias("share"))


def healthy(rows: DataFrame, error: str, max_share: float = 0.2, at_least: int = 40) -> DataFrame:
    """One row: errors, total and whether the run may go on; judged only once enough rows have been seen."""
    return rows.agg(F.count_if(F.col(error)).alias("errors"), F.count("*").alias("total")).withColumn("ok", (F.col("total") < at_least) | (F.col("errors") <= max_share * F.col("total")))
