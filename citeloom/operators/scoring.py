"""Grading of answers that were asked for one passage, in two passes.

The first compares an answer with the passage asked for, with the same passage in all other editions of its language
and with the other passages of its chapter. Only answers that this leaves unexplained are then compared with the
passage in the tested editions of other languages, found through the numbering schemes, and replaced.

items: item, language, edition, ref, source_ref (in the scheme SOURCE), digest (of the loose passage, or null).
answers: item, response. passages: edition, language, ref, text. editions: edition, language, scheme, tested.
mapping: scheme, ref, org.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import similarity as S
from citeloom.functions import text as X
from citeloom.functions import windows as W
from citeloom.operators import grade as G
from citeloom.operators import reference as Q
from citeloom.session import settle, ship, spread

SOURCE = "eng"  # fixed value: the scheme in which question sets are drawn
UNEXPLAINED = ("fabricated", "no_attempt")
KINDS = ("edition", "neighbour", "foreign")

_BEST = T.StructType().add("key", "string").add("similarity", "double")
_MEASURES = (
    T.StructType().add("exact", "boolean").add("verbatim_loose", "boolean").add("target", "double").add("qer", "double").add("wer", "double").add("tried", "boolean").add("refused", "boolean")
    .add("overquote", "boolean").add("method", "string").add("edit_ops", T.MapType(T.StringType(), T.IntegerType())).add("digest", "string")
)
for _kind in KINDS:
    _MEASURES = _MEASURES.add(_kind, _BEST)


@lru_cache(4096)
def _loose(passage: str) -> str:
    return X.loose(passage)


def closest(bare: str, whole: str, rivals: list, infix: Callable = S.infix) -> tuple[str, float] | None:
    """The rival passage that an answer, unwrapped or anywhere in it, is most like; ties to the least key."""
    best = None
    for r in sorted(rivals, key=lambda r: r["key"]):
        words, s = _loose(r["text"]), 0.0
        if words:
            s = infix(words, whole)[0]
            if bare and 1 - abs(len(bare) - len(words)) / len(words) > s:  # an edit for each sign that one has more
                s = max(s, S.likeness(bare, words))
        if best is None or s > best[1]:
            best = (r["key"], s)
    return best


def measured(response: str, truth: str, rivals: dict[str, list], infix: Callable = S.infix) -> dict:
    """What the rules need to know of an answer, and what a report shows of it."""
    attempt, method, exact, target, _, over, wer = G.measure(response, truth, [], infix)
    want, bare, whole = _loose(truth), X.loose(G.trivial(response)), X.loose(response)
    refused = X.is_refusal(response)
    enough = X.nonspace_length(bare) >= max(10, 0.4 * X.nonspace_length(want))
    found = {k: closest(bare, whole, rivals.get(k) or [], infix) for k in KINDS}
    edits = S.edit_counts(attempt, want)
    return {
        "exact": exact, "verbatim_loose": attempt == want, "target": target, "qer": sum(edits.values()) / len(want) if attempt and want else 1.0, "wer": wer,
        "tried": not refused and (enough or G.quoted_span(response)), "refused": refused, "overquote": over, "method": method, "edit_ops": edits, "digest": X.digest(want),
        **{k: None if f is None else dict(zip(("key", "similarity"), f, strict=True)) for k, f in found.items()},
    }


def _listed(x) -> list:
    return [] if x is None else list(x)


@F.pandas_udf(_MEASURES)
def _measured(responses: pd.Series, truths: pd.Series, editions: pd.Series, neighbours: pd.Series) -> pd.DataFrame:
    rows = [(r or "", t, dict(zip(KINDS, map(_listed, some), strict=False))) for r, t, *some in zip(responses, truths, editions, neighbours, strict=True)]
    pairs = []
    for r, t, some in rows:
        pairs += G.alignments_of(r, t) + [(_loose(x["text"]), X.loose(r)) for rivals in some.values() for x in rivals]
    infix = W.aligner(pairs)
    return pd.DataFrame([measured(*row, infix) for row in rows], columns=_MEASURES.names)


@F.pandas_udf(_BEST)
def _closest(responses: pd.Series, rivals: pd.Series) -> pd.DataFrame:
    rows = [(X.loose(G.trivial(r or "")), X.loose(r or ""), _listed(some)) for r, some in zip(responses, rivals, strict=True)]
    infix = W.aligner([(_loose(x["text"]), whole) for _, whole, some in rows for x in some])
    return pd.DataFrame([closest(*row, infix) or (None, None) for row in rows], columns=_BEST.names)


def _rivals(pairs: DataFrame, name: str) -> DataFrame:
    """item and its rivals (key, text): no more than a chapter has verses, or a language editions."""
    return pairs.where(F.length(F.trim("text")) > 0).groupBy("item").agg(F.collect_list(F.struct(F.col("key").cast("string").alias("key"), "text")).alias(name))


def _graded(m: DataFrame) -> DataFrame:
    like = lambda k: F.col(f"{k}.similarity")
    name = G.grade(F.col("exact"), F.col("target"), like("edition"), like("foreign"), like("neighbour"), F.col("tried"), F.col("refused"))
    best = [F.when(F.col(f"{k}.key").isNotNull(), F.struct(F.col(f"{k}.key").alias("key"), F.round(like(k), 4).alias("similarity"))).alias(f"best_{k}") for k in KINDS]
    return m.select(
        "item", "language", name.alias("grade"), F.round(G.grade_score(name, F.col("target")), 4).alias("score"), F.round("qer", 4).alias("qer"), F.round("wer", 4).alias("wer"),
        F.col("exact").alias("verbatim_strict"), "verbatim_loose", "overquote", "method", "edit_ops", *best, (F.col("then").isNotNull() & (F.col("then") != F.col("digest"))).alias("drift"),
    )


def score_answers(items: DataFrame, answers: DataFrame, passages: DataFrame, editions: DataFrame, mapping: DataFrame, schemes: list[str]) -> DataFrame:
    """A row for each answer to a known item whose passage has a text: grade, score, what they rest on, and whether
    the passage has changed since its digest was taken. Answers without item, and blank passages, are dropped."""
    ship(items.sparkSession)
    p = passages.select(F.col("edition").alias("e"), F.col("language").alias("g"), F.col("ref").alias("r"), "text")
    asked = items.join(answers.select("item", "response"), "item")
    own = asked.join(p.drop("g"), (F.col("edition") == F.col("e")) & (F.col("ref") == F.col("r"))).where(F.length(F.trim("text")) > 0)
    own = own.select(*asked.columns, F.col("text").alias("truth"))
    key = own.select("item", "language", "edition", "ref")
    others = key.join(p, (F.col("language") == F.col("g")) & (F.col("ref") == F.col("r"))).where("edition <> e").select("item", F.col("e").alias("key"), "text")
    place = lambda c: F.substring_index(c, ".", 2)
    near = key.join(p, (F.col("edition") == F.col("e")) & (place("ref") == place("r"))).where("ref <> r").select("item", F.col("r").alias("key"), "text")
    rows = own.join(_rivals(others, "edition_"), "item", "left").join(_rivals(near, "neighbour"), "item", "left")
    none = F.array().cast("array<struct<key:string,text:string>>")
    rows = rows.select("item", "language", "digest", "source_ref", "response", "truth", F.coalesce("edition_", none).alias("edition"), F.coalesce("neighbour", none).alias("neighbour"))
    rows = spread(settle(rows, "asked")).withColumn("m", _measured("response", "truth", "edition", "neighbour"))
    home = settle(rows.select("item", "language", "source_ref", "response", F.col("digest").alias("then"), "m.*"), "home")
    first = _graded(home)
    # what the first pass has measured stays; only the passages abroad are new to the second
    open_ = home.join(first.where(F.col("grade").isin(*UNEXPLAINED)).select("item"), "item", "left_semi")
    known = editions.where("tested").where(F.lower("scheme").isin(*schemes, "org")).select(F.col("edition").alias("e"), F.col("language").alias("g"), "scheme")
    # a reference is translated once a scheme, and joined with the passages of the editions that use it
    refs = open_.select("source_ref").distinct().select("source_ref", F.lit(SOURCE).alias("source"), F.explode(F.array(*map(F.lit, [*schemes, "org"]))).alias("scheme"))
    refs = Q.translated(refs, mapping, "source_ref", "source", "scheme", schemes).select("source_ref", "scheme", F.col("translated").alias("r"))
    texts = p.select("e", "r", "text").join(known.withColumn("scheme", F.lower("scheme")), "e")
    abroad = refs.join(texts, ["scheme", "r"])
    found = open_.select("item", "language", "source_ref").join(abroad, "source_ref").where("language <> g").select("item", F.concat_ws(":", "g", F.col("e").cast("string")).alias("key"), "text")
    asked = settle(open_.join(_rivals(found, "rivals"), "item", "left").withColumn("rivals", F.coalesce("rivals", none)), "asked-abroad")
    again = _graded(spread(asked).withColumn("foreign", _closest("response", "rivals")))
    return first.join(again.select("item"), "item", "left_anti").unionByName(again)
