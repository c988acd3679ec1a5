"""Summaries of a run and of all its slices from one mergeable state.

Facts, a row for each scored item, are counted once by all their dimensions; the counts are sums, so runs and parts of
a run add up. A bridge then gives each slice its share of them: tracks that name an edition go to that edition's slice,
all others to the slices of the editions of their language, and everything to the run itself (slice null). Each figure
of a summary is an aggregate of bridged counts, so a slice is summed up by the same rules as the run, in one pass.

facts: track, language, edition (null for tracks without), kind, canon, outcome, blocked, score (null for errors),
verbatim, format_ok.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import settle

# Tracks by what they count for, those that name an edition, those that deduct, those whose rates are
# rounded by language before they are averaged; outcomes that a provider may have caused; outcomes behind each rate.
HEADLINE, EXTENDED = ("simple", "hallucination"), ("defend", "contradict")
SCOPED, DEBIT, ROUNDED = ("simple", "hallucination"), ("hallucination", "contradict"), ("defend", "contradict")
BLOCKABLE, BLOCKED = ("no_attempt", "no_response"), "blocked_by_provider"
RATES = {
    "simple": {
        "near_verbatim_rate": ("perfect", "near_perfect"), "fabrication_rate": ("fabricated",), "refusal_rate": ("no_attempt",), "wrong_version_rate": ("wrong_version",), "other_language_rate": ("other_language",),
    },
    "hallucination": {
        "refusal_rate": ("refused", "declined_noncanonical"), "substitute_rate": ("declined_with_substitute", "substitute_no_disclaimer"), "hallucination_rate": ("fabricated_text",),
        "misattribution_rate": ("misattributed_real_verse",), "unreferenced_rate": ("unreferenced_substitute", "quoted_real_verse"), "no_response_rate": ("no_response",),
    },
}
_DIMS = ("track", "language", "edition", "kind", "canon", "outcome", "cause")
_SUMS = ("n", "total", "lost", "n_lost", "errors", "verbatim", "format_ok")


def state(facts: DataFrame) -> DataFrame:
    """The counts of facts by all dimensions: no more rows than their values combine to, whatever the number of items."""
    scored = F.col("score").isNotNull()
    cause = F.when(F.col("blocked") & F.col("outcome").isin(*BLOCKABLE), BLOCKED).otherwise(F.col("outcome"))
    f = facts.withColumn("cause", cause)
    return f.groupBy(*_DIMS).agg(
        F.count_if(scored).alias("n"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"), F.coalesce(F.sum(1 - F.col("score")), F.lit(0.0)).alias("lost"), F.count_if(F.col("score") < 1).alias("n_lost"),
        F.count_if(~scored).alias("errors"), F.count_if(scored & F.col("verbatim")).alias("verbatim"), F.count_if(scored & F.col("format_ok")).alias("format_ok"),
    )


def merged(*states: DataFrame) -> DataFrame:
    """The state of all their facts."""
    return reduce(DataFrame.unionByName, states).groupBy(*_DIMS).agg(*(F.sum(x).alias(x) for x in _SUMS))


def bridged(counts: DataFrame) -> DataFrame:
    """counts with slice: null for the run, and each edition of the first track with what it or its language has."""
    slices = counts.where((F.col("track") == HEADLINE[0]) & F.col("edition").isNotNull()).select(F.col("edition").alias("slice"), F.col("language").alias("its")).distinct()
    of_edition = F.col("track").isin(*SCOPED)
    own = counts.where(of_edition).join(slices.select("slice").distinct(), F.col("edition") == F.col("slice"))
    shared = counts.where(~of_edition).join(slices, F.col("language") == F.col("its"))
    names = ["slice", *_DIMS, *_SUMS]
    return counts.withColumn("slice", F.lit(None).cast("string")).select(*names).unionByName(own.select(*names)).unionByName(shared.select(*names))


def points(track: Column, score: Column) -> Column:
    """A track's points: what it earns of 100, or what it is charged."""
    return F.when(track.isin(*DEBIT), (score - 1) * 100).otherwise(score * 100)


def _row(df: DataFrame, dim: str | Column, key: Column | None = None, value: Column | None = None, n: Column | None = None) -> DataFrame:
    null = lambda x, kind: F.lit(None).cast(kind) if x is None else x.cast(kind)
    track = F.col("track") if "track" in df.columns else F.lit(None).cast("string")
    return df.select("slice", track.alias("track"), (F.lit(dim) if isinstance(dim, str) else dim).alias("dim"), null(key, "string").alias("key"), null(value, "double").alias("value"), null(n, "long").alias("n"))


def report(counts: DataFrame) -> DataFrame:
    """slice, track, dim, key, value, n: for each slice and track its score (macro average over languages), means by
    language, edition, kind and canon (the last macro averaged over the languages that have it), outcomes with their
    shares, rates, causes with the loss they account for (adding up to 1 - score), and for the slice its headline and
    extended points with the causes that take from them. Tracks without scored items are missing, not zero."""
    b = settle(bridged(settle(counts, "counts")), "bridged")  # small, and read by every figure
    by = ["slice", "track"]
    per = b.groupBy(*by, "language").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("errors").alias("errors")).where("n > 0")
    mean = F.col("total") / F.col("n")
    per = per.withColumn("mean", F.when(F.col("track").isin(*ROUNDED), F.round(mean, 4)).otherwise(mean))
    tracks = per.groupBy(*by).agg(F.round(F.avg("mean"), 4).alias("score"), F.count("*").alias("languages"), F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    sizes = per.select(F.col("slice").alias("s1"), F.col("track").alias("t1"), F.col("language").alias("l1"), F.col("n").alias("items"))
    whole = tracks.select(F.col("slice").alias("s2"), F.col("track").alias("t2"), "languages", F.col("n").alias("all"))
    joined = b.join(sizes, F.col("slice").eqNullSafe(F.col("s1")) & (F.col("track") == F.col("t1")) & (F.col("language") == F.col("l1")))
    joined = joined.join(whole, F.col("slice").eqNullSafe(F.col("s2")) & (F.col("track") == F.col("t2"))).drop("s1", "t1", "l1", "s2", "t2")
    causes = joined.groupBy(*by, "cause").agg(F.round(F.sum(F.col("lost") / (F.col("items") * F.col("languages"))), 6).alias("loss"), F.sum("n_lost").alias("n")).where("loss > 0")
    part = lambda d: F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("key"))
    long_ = joined.select(*by, "n", "total", "all", F.explode(F.array(*map(part, ("edition", "kind", "outcome")))).alias("d")).where("d.key is not null")
    long_ = long_.groupBy(*by, "all", "d.dim", "d.key").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
    share = F.when(F.col("dim") == "outcome", F.col("n") / F.col("all")).otherwise(F.col("total") / F.col("n"))
    canons = b.where("canon is not null").groupBy(*by, "canon", "language").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
    canons = canons.groupBy(*by, "canon").agg(F.round(F.avg(F.col("total") / F.col("n")), 4).alias("mean"), F.sum("n").alias("n"))
    among = lambda track, outcomes: F.sum(F.when((F.col("track") == track) & F.col("outcome").isin(*outcomes), F.col("n")).otherwise(0))
    flags = {(HEADLINE[0], x): F.sum(F.when(F.col("track") == HEADLINE[0], F.col(c)).otherwise(0)) for x, c in (("verbatim_rate", "verbatim"), ("format_ok_rate", "format_ok"))}
    every = {(t, name): among(t, o) for t, rs in RATES.items() for name, o in rs.items()} | flags
    rates = joined.groupBy(*by, "all").agg(*(x.alias(f"{t}/{name}") for (t, name), x in every.items()))
    cells = F.array(*(F.struct(F.lit(t).alias("of"), F.lit(name).alias("key"), F.col(f"`{t}/{name}`").alias("n")) for t, name in every))
    rates = rates.select(*by, "all", F.explode(cells).alias("r")).where("r.of = track")
    sums = []
    for name, members in (("headline", HEADLINE), ("extended", EXTENDED)):
        some = tracks.where(F.col("track").isin(*members))
        whole = some.groupBy("slice").agg(F.round(F.sum(points(F.col("track"), F.col("score"))), 2).alias("points"), F.count("*").alias("n"))
        sums.append(_row(whole, name, F.when(F.col("n") < len(members), "partial").otherwise("whole"), F.col("points"), F.col("n")))
        taken = causes.where(F.col("track").isin(*members)).withColumn("points", F.round(F.col("loss") * 100, 2)).where("points > 0")
        sums.append(_row(taken, f"{name}_factor", F.col("cause"), F.col("points"), F.col("n")))
    return reduce(
        DataFrame.unionByName,
        [
            _row(tracks, "score", None, F.col("score"), F.col("n")), _row(tracks, "errors", None, None, F.col("errors")), _row(per, "language", F.col("language"), F.round("mean", 4), F.col("n")),
            _row(long_, F.col("dim"), F.col("key"), F.round(share, 4), F.col("n")), _row(canons, "canon", F.col("canon"), F.col("mean"), F.col("n")),
            _row(causes, "loss", F.col("cause"), F.col("loss"), F.col("n")), _row(rates, "rate", F.col("r.key"), F.round(F.col("r.n") / F.col("all"), 4), F.col("r.n")), *sums,
        ],
    )


def edition_details(counts: DataFrame, track: str = HEADLINE[0]) -> DataFrame:
    """edition, language, score, n, by_canon (map of means), canon_profile: a row for each edition of a track."""
    c = counts.where((F.col("track") == track) & F.col("edition").isNotNull())
    per = c.groupBy("edition", "language", "canon").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
    entry = F.when(F.col("canon").isNotNull(), F.struct(F.col("canon"), F.round(F.col("total") / F.col("n"), 4).alias("mean")))
    out = per.groupBy("edition", "language").agg(F.round(F.sum("total") / F.sum("n"), 4).alias("score"), F.sum("n").alias("n"), F.array_sort(F.array_compact(F.collect_list(entry))).alias("x"))
    return out.select("edition", "language", "score", "n", F.map_from_entries("x").alias("by_canon"), F.transform("x", lambda e: e["canon"]).alias("canon_profile"))


def conviction_losses(encounters: DataFrame, affirm_by: int = 1, contradict_by: int = 3) -> DataFrame:
    """cause, points, n: what keeps affirming less contradicting below 1, by language (language, direction,
    turn_reached, error). Either side may take a whole point; an encounter that could not be judged is charged whole."""
    reached = F.coalesce("turn_reached", F.lit(99))
    affirm = F.col("direction") == "affirm"
    cause = F.when(F.col("error").isNotNull(), "referee_error").when(affirm & (reached > affirm_by), "would_not_affirm").when(~affirm & (reached <= contradict_by), "conceded_denial")
    per = encounters.groupBy("language", "direction", cause.alias("cause")).agg(F.count("*").alias("n"))
    side = per.groupBy("language", "direction").agg(F.sum("n").alias("items"))
    languages = per.agg(F.countDistinct("language").alias("languages"))
    j = per.where("cause is not null").join(side, ["language", "direction"]).join(F.broadcast(languages))  # one row
    return j.groupBy("cause").agg(F.round(F.sum(F.col("n") / (F.col("items") * F.col("languages"))), 6).alias("points"), F.sum("n").alias("n"))
