"""Judgements that take several rounds: identify at home before abroad, check what is cited, name the best edition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import dealt


def two_rounds(found: DataFrame, span: str, foreign: str, score: str, tie: str, floor: float, foreign_floor: float) -> DataFrame:
    """Best match of each span among its own language's; spans without one are then matched abroad, with a higher floor."""
    best = lambda df: df.groupBy(span).agg(F.min_by(tie, F.struct(-F.col(score), F.col(tie))).alias(tie), F.max(score).alias(score))
    home = best(found.where(~F.col(foreign) & (F.col(score) >= floor))).withColumn("round", F.lit(1))
    rest = found.where(F.col(foreign) & (F.col(score) >= foreign_floor)).join(home.select(span), span, "left_anti")
    return home.unionByName(best(rest).withColumn("round", F.lit(2)))


def cited_exists(verdicts: DataFrame, catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """verdicts with whether what they cite exists in any edition; the catalogue is made distinct first."""
    known = catalogue.select(*keys).distinct().withColumn("cited_exists", F.lit(True))
    return verdicts.join(known, keys, "left").withColumn("cited_exists", F.coalesce("cited_exists", F.lit(False)))


def aliases(quotes: DataFrame, cited: DataFrame, block: str, key: str, text: str, similar: Column, at_least: float) -> DataFrame:
    """For each quote the first cited text of its block that is as good as equal: an alias under another number.
    `similar` compares the columns text and other_text."""
    # equal texts of a block are compared once, for all their keys: two keys of each text tell the least that is another
    keys = cited.select(block, F.col(text).alias("other_text"), F.col(key).alias("other")).where(F.col("other").isNotNull()).distinct()
    nth = F.row_number().over(Window.partitionBy(block, "other_text").orderBy("other"))
    least = keys.withColumn("nth", nth).where("nth <= 2").groupBy(block, "other_text").agg(F.min("other").alias("first"), F.max(F.when(F.col("nth") == 2, F.col("other"))).alias("second"))
    pairs = dealt(quotes.select(block, text), block, text).distinct().join(least, block).where(similar >= at_least)
    pairs = pairs.withColumn("__least", F.min("first").over(Window.partitionBy(block, text)))
    found = pairs.groupBy(block, text).agg(F.min("first").alias("first"), F.min(F.when(F.col("first") == F.col("__least"), F.col("second")).otherwise(F.col("first"))).alias("second"))
    named = quotes.where(F.col(key).isNotNull()).join(found, [block, text]).withColumn("alias", F.when(F.col("first") != F.col(key), F.col("first")).otherwise(F.col("second")))
    return named.where("alias is not null").groupBy(key).agg(F.min("alias").alias("alias"))


def best_edition(df: DataFrame, key: str, score: str, edition: str, floor: float) -> DataFrame:
    """The edition that scores best at a known reference, ties to the least, if it reaches the floor."""
    return df.where(F.col(score) >= floor).groupBy(key).agg(F.min_by(edition, F.struct(-F.col(score), F.col(edition))).alias(edition), F.max(score).alias(score))


def cost(calls: DataFrame, prices: DataFrame, key: str) -> DataFrame:
    """Cost by key from a price table; without a price it is null, not zero."""
    n = calls.groupBy(key).agg(F.sum("tokens").alias("tokens"))
    return n.join(prices, key, "left").select(key, "tokens", F.round(F.col("tokens") * F.col("price"), 2).alias("cost"))


def ascii_share(text: Column) -> Column:
    """Share of ASCII characters; null for an empty text."""
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / F.length(text))


def verdict(answer: Column) -> Column:
    """conceded and reasoning from a referee's answer: a JSON object, else the word by its pattern; what cannot be read
    fails the job, as no default would be fair to either side."""
    said, pattern = F.coalesce(F.trim(answer), F.lit("")), r"(?i)\"?conceded\"?\s*[:=]\s*(true|false)"
    json = F.get_json_object(said, "$.conceded")
    word = F.when(json.isin("true", "false"), json).otherwise(F.lower(F.nullif(F.regexp_extract(said, pattern, 1), F.lit(""))))
    read = F.when(word.isNotNull(), word == "true").otherwise(F.raise_error(F.concat(F.lit("unreadable verdict: "), F.substring(said, 1, 200))).cast("boolean"))
    reason = F.when(json.isNotNull(), F.coalesce(F.get_json_object(said, "$.reasoning"), F.lit(""))).otherwise(said)
    return F.struct(read.alias("conceded"), F.substring(reason, 1, 400).alias("reasoning"))


def explain(grade: Column) -> Column:
    """What a grade means, in a sentence."""
    said = {
        "perfect": "Word for word.",
        "near_perfect": "All but a sign or two.",
        "minor": "Small slips.",
        "major": "Clear departures from the text.",
        "severe": "Barely recognisable.",
        "wrong_version": "Another edition of the language.",
        "other_language": "The passage in another language.",
        "wrong_verse": "A neighbouring passage.",
        "fabricated": "Matches no passage.",
    }
    out = F.when(F.lit(False), "")
    for name, text in said.items():
        out = out.when(grade == name, text)
    return out.otherwise("No attempt.")
