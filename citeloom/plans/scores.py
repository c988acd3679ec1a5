"""Report queries. Documents with labels are the scored items: language, edition (source), tier by length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import aggregate as A
from citeloom.operators import serve as V
from citeloom.tables import load

_SCORE = "CASE WHEN quality = 1 AND toxic = 0 THEN 1.0D WHEN quality = 1 THEN 0.5D ELSE 0.0D END"
_CAUSE = "CASE WHEN quality = 1 AND toxic = 0 THEN 'good' WHEN quality = 1 THEN 'toxic' WHEN toxic = 1 THEN 'poor_toxic' ELSE 'poor' END"
_TIER = "CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END"
_FACTS = f"""facts AS (SELECT d.doc_id, d.lang, d.source, {_TIER} AS tier, l.quality, l.toxic,
  {_SCORE.replace("0D", "0").replace("5D", "5")}::DOUBLE AS score, {_CAUSE} AS cause FROM documents d JOIN labels l USING (doc_id))"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.expr(_TIER).alias("tier"))
    return d.join(load(spark, sf_dir, "labels"), "doc_id").withColumns({"score": F.expr(_SCORE), "cause": F.expr(_CAUSE)})


def macro_avg_by_lang(spark, sf_dir):
    return A.macro_mean(facts(spark, sf_dir), "lang", "score")


def breakdown_grouping_sets(spark, sf_dir):
    return A.breakdown(facts(spark, sf_dir), ["lang", "tier", "source", "cause"], "score")


def canon_macro_missing_not_zero(spark, sf_dir):
    f = facts(spark, sf_dir).where("not (lang = 'fr' and source = 'src0')")  # a language that lacks an edition
    out = A.macro_mean(f, "lang", "score", by=["source"])
    langs = f.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))
    return out.join(langs, "source")


def conditional_rates(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("lang").agg(
        F.count("*").alias("n"),
        F.round(A.share(F.col("cause") == "good"), 4).alias("good_rate"),
        F.round(A.share(F.col("cause").isin("toxic", "poor_toxic")), 4).alias("toxic_rate"),
        F.round(A.share(F.col("quality") == 0), 4).alias("poor_rate"),
        F.count_if(F.col("score") > 0).alias("scored"),
    )


def loss_decomposition(spark, sf_dir):
    return A.losses(facts(spark, sf_dir), "lang", "cause", "score")


def ledger_composite(spark, sf_dir):
    f = facts(spark, sf_dir)
    per = f.groupBy("lang", "tier").agg(F.avg("score").alias("m")).groupBy(F.col("tier").alias("track")).agg(F.avg("m").alias("score"))
    tracks = per.withColumn("direction", F.when(F.col("track") == "short", "debit").otherwise("credit"))
    return A.composite(tracks)


def slices_by_edition_or_language(spark, sf_dir):
    f = facts(spark, sf_dir)
    rows = f.select(F.when(F.col("tier") != "long", F.col("source")).alias("edition"), "lang", F.col("tier").alias("track"), "score")
    return A.slices(rows, "edition", "lang", "score")


def leaderboard(spark, sf_dir):
    f = facts(spark, sf_dir)
    per = f.groupBy("source", "lang").agg(F.avg("score").alias("m")).groupBy("source").agg(F.round(F.avg("m"), 4).alias("headline"))
    published = load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"))
    return V.leaderboard(published.join(per, "source", "left"), "headline", "source")


def _evaluated(spark, sf_dir):
    f = facts(spark, sf_dir)
    track = F.when(F.col("tier") == "long", "affirm").when(F.col("tier") == "medium", "contradict").otherwise("simple")
    error = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), F.lit("blocked"))
    return f.withColumn("track", track).withColumn("ok", V.passed(track, F.col("score"), F.col("toxic") == 1, error))


_EVALUATED = f"""{_FACTS}, evaluated AS (SELECT *, CASE tier WHEN 'long' THEN 'affirm' WHEN 'medium' THEN 'contradict' ELSE 'simple' END AS track,
  CASE WHEN quality = 0 AND toxic = 1 THEN false WHEN tier = 'long' THEN toxic = 1 WHEN tier = 'medium' THEN NOT toxic = 1 ELSE score >= 1.0 END AS ok FROM facts)"""


def failures_page(spark, sf_dir):
    f = _evaluated(spark, sf_dir).where(~F.col("ok"))
    return V.page(f.select("doc_id", "lang", "track", "score"), [F.coalesce("score", F.lit(0.0)), F.col("doc_id")], 20, 50)


def evaluations_page(spark, sf_dir):
    texts = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    f = _evaluated(spark, sf_dir).where("lang = 'en'").join(texts, "doc_id", "left")
    return V.page(f.select("doc_id", "track", "ok", "score", "n_chars"), [F.col("ok"), F.col("score"), F.col("doc_id")], 0, 100)


def evaluation_counts(spark, sf_dir):
    return V.outcome_counts(_evaluated(spark, sf_dir).where("lang = 'en'"), "ok")


def upsert_overlay(spark, sf_dir):
    old = facts(spark, sf_dir).select("doc_id", "lang", "cause")
    new = old.where("cause = 'toxic'").withColumn("cause", F.lit("patched"))
    return V.overlay(old, new, key="doc_id")


def labels_and_versions(spark, sf_dir):
    editions = load(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    rows = editions.select(F.concat_ws("-", "source", "lang").alias("id"), F.concat(F.lit("v0."), F.regexp_extract("source", r"(\d+)", 1), F.when(F.col("lang") == "fr", "-fast").otherwise("")).alias("version"), F.concat_ws(" / ", F.upper("lang"), F.col("source")).alias("title"), F.col("lang").alias("label"))
    out = V.distinct_labels(rows, "id", "label")
    return out.select("id", "version", V.version_order(F.col("version")).cast("double").alias("number"), V.slug(F.col("title")).alias("slug"), "label")


def health_gate(spark, sf_dir):
    return A.healthy(load(spark, sf_dir, "events").withColumn("failed", F.col("value") < 20), "failed")


def usage_totals(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return A.usage(e.where("event_type = 'click'").select(F.col("value").cast("long").alias("tokens")), e.where("event_type <> 'click'").select("event_id"))


QUERIES = {
    f.__name__: f
    for f in (macro_avg_by_lang, breakdown_grouping_sets, canon_macro_missing_not_zero, conditional_rates, loss_decomposition, ledger_composite, slices_by_edition_or_language, leaderboard, failures_page, evaluations_page, evaluation_counts, upsert_overlay, labels_and_versions, health_gate, usage_totals)
}

SQL = {
    "macro_avg_by_lang": f"""WITH {_FACTS}, g AS (SELECT lang, avg(score) AS m, count(*) AS n FROM facts GROUP BY lang)
SELECT round(coalesce(avg(m), 0), 4) AS macro_mean, count(*) AS groups, sum(n)::BIGINT AS items FROM g""",
    "breakdown_grouping_sets": f"""WITH {_FACTS}
SELECT 'lang' AS dim, lang AS key, count(*) AS n, round(avg(score), 4) AS mean FROM facts GROUP BY lang
UNION ALL SELECT 'tier', tier, count(*), round(avg(score), 4) FROM facts GROUP BY tier
UNION ALL SELECT 'source', source, count(*), round(avg(score), 4) FROM facts GROUP BY source
UNION ALL SELECT 'cause', cause, count(*), round(avg(score), 4) FROM facts GROUP BY cause
UNION ALL SELECT 'all', 'all', count(*), round(avg(score), 4) FROM facts""",
    "canon_macro_missing_not_zero": f"""WITH {_FACTS}, f AS (SELECT * FROM facts WHERE NOT (lang = 'fr' AND source = 'src0')),
g AS (SELECT source, lang, avg(score) AS m, count(*) AS n FROM f GROUP BY source, lang)
SELECT source, round(coalesce(avg(m), 0), 4) AS macro_mean, count(*) AS groups, sum(n)::BIGINT AS items, string_agg(lang, ',' ORDER BY lang) AS languages FROM g GROUP BY source""",
    "conditional_rates": f"""WITH {_FACTS} SELECT lang, count(*) AS n, round(avg((cause = 'good')::INT), 4) AS good_rate,
round(avg((cause IN ('toxic', 'poor_toxic'))::INT), 4) AS toxic_rate, round(avg((quality = 0)::INT), 4) AS poor_rate, count(*) FILTER (score > 0) AS scored FROM facts GROUP BY lang""",
    "loss_decomposition": f"""WITH {_FACTS}, s AS (SELECT lang, count(*) AS items FROM facts GROUP BY lang),
l AS (SELECT f.cause, sum((1 - f.score) / (s.items * (SELECT count(*) FROM s))) AS loss, count(*) AS n FROM facts f JOIN s USING (lang) GROUP BY f.cause)
SELECT cause, round(loss, 6) AS loss, n FROM l WHERE loss > 0""",
    "ledger_composite": f"""WITH {_FACTS}, g AS (SELECT lang, tier, avg(score) AS m FROM facts GROUP BY lang, tier), t AS (SELECT tier, avg(m) AS score FROM g GROUP BY tier)
SELECT round(sum(CASE WHEN tier = 'short' THEN -100 * (1 - score) ELSE 100 * score END), 2) AS points, count(score) AS tracks, count(*) > count(score) AS partial FROM t""",
    "slices_by_edition_or_language": f"""WITH {_FACTS}, r AS (SELECT CASE WHEN tier <> 'long' THEN source END AS edition, lang, tier AS track, score FROM facts),
dim AS (SELECT DISTINCT edition AS slice, lang FROM r WHERE edition IS NOT NULL)
SELECT edition AS slice, lang AS slice_language, track, count(*) AS n, round(avg(score), 4) AS mean FROM r WHERE edition IS NOT NULL GROUP BY ALL
UNION ALL SELECT d.slice, d.lang, r.track, count(*), round(avg(r.score), 4) FROM dim d JOIN r ON r.lang = d.lang AND r.edition IS NULL GROUP BY ALL""",
    "leaderboard": f"""WITH {_FACTS}, p AS (SELECT source, lang, avg(score) AS m FROM facts GROUP BY source, lang), h AS (SELECT source, round(avg(m), 4) AS headline FROM p GROUP BY source),
b AS (SELECT source, count(*) AS documents FROM documents GROUP BY source)
SELECT b.source, b.documents, h.headline, row_number() OVER (ORDER BY h.headline DESC NULLS LAST, b.source)::INT AS rank FROM b LEFT JOIN h USING (source)""",
    "failures_page": f"WITH {_EVALUATED} SELECT doc_id, lang, track, score FROM evaluated WHERE NOT ok ORDER BY coalesce(score, 0), doc_id LIMIT 50 OFFSET 20",
    "evaluations_page": f"WITH {_EVALUATED} SELECT e.doc_id, track, ok, score, d.n_chars FROM evaluated e LEFT JOIN documents d USING (doc_id) WHERE e.lang = 'en' ORDER BY ok, score, e.doc_id LIMIT 100",
    "evaluation_counts": f"WITH {_EVALUATED} SELECT count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) AS total FROM evaluated WHERE lang = 'en'",
    "upsert_overlay": f"WITH {_FACTS} SELECT doc_id, lang, CASE WHEN cause = 'toxic' THEN 'patched' ELSE cause END AS cause FROM facts",
    "labels_and_versions": """WITH e AS (SELECT source, lang FROM documents GROUP BY source, lang),
r AS (SELECT source || '-' || lang AS id, 'v0.' || regexp_extract(source, '([0-9]+)', 1) || CASE WHEN lang = 'fr' THEN '-fast' ELSE '' END AS version, lang, source FROM e)
SELECT id, version, (regexp_extract(source, '([0-9]+)', 1)::INT - CASE WHEN lang = 'fr' THEN 0.5 ELSE 0 END)::DOUBLE AS number, lang || '-' || source AS slug,
CASE WHEN count(*) OVER (PARTITION BY lang) > 1 THEN lang || ' #' || id ELSE lang END AS label FROM r""",
    "health_gate": "SELECT count(*) FILTER (value < 20) AS errors, count(*) AS total, count(*) < 40 OR count(*) FILTER (value < 20) <= 0.2 * count(*) AS ok FROM events",
    "usage_totals": "SELECT count(*) AS calls, sum(CASE WHEN event_type = 'click' THEN trunc(value)::BIGINT ELSE 0 END)::BIGINT AS tokens FROM events",
}
