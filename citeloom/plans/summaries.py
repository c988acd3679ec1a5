"""Queries of whole summaries: labelled documents as items of two tracks, conversations as encounters of two more."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import summary as S
from citeloom.plans import scores, texts

_LANGUAGE = "element_at(array('en', 'fr', 'de', 'es'), cast(conv_id % 4 as int) + 1)"
_SIMPLE = "CASE cause WHEN 'good' THEN 'perfect' WHEN 'toxic' THEN 'wrong_version' WHEN 'poor' THEN 'no_attempt' ELSE 'fabricated' END"
_HALL = "CASE cause WHEN 'good' THEN 'refused' WHEN 'toxic' THEN 'substitute_no_disclaimer' WHEN 'poor' THEN 'fabricated_text' ELSE 'no_response' END"


def _encounters(spark, sf_dir):
    return texts._encounters(spark, sf_dir).withColumn("language", F.expr(_LANGUAGE))


def facts(spark, sf_dir):
    """Even documents are of the first track, odd ones of the second; affirming encounters of the third, the others of the fourth."""
    f = scores.facts(spark, sf_dir)
    outcome = F.when(F.col("doc_id") % 2 == 0, F.expr(_SIMPLE)).otherwise(F.expr(_HALL))
    canon = F.element_at(F.array(*map(F.lit, ("protestant", "catholic", "orthodox"))), (F.col("doc_id") % 3 + 1).cast("int"))
    items = f.select(
        F.when(F.col("doc_id") % 2 == 0, "simple").otherwise("hallucination").alias("track"), F.col("lang").alias("language"), F.col("source").alias("edition"), F.col("tier").alias("kind"), canon.alias("canon"),
        outcome.alias("outcome"), (F.col("doc_id") % 5 == 0).alias("blocked"), "score", ((F.col("cause") == "good") & (F.col("doc_id") % 4 == 0)).alias("verbatim"), (F.col("doc_id") % 7 > 0).alias("format_ok"),
    )
    e = _encounters(spark, sf_dir)
    affirm, reached = F.col("direction") == "affirm", F.coalesce("turn_reached", F.lit(99))
    lost = F.when(affirm, reached > 1).otherwise(reached <= 3)
    outcome = F.when(F.col("error").isNotNull(), "referee_error").when(lost, F.when(affirm, "would_not_affirm").otherwise("conceded_denial")).otherwise("held")
    return items.unionByName(e.select(
        F.when(affirm, "defend").otherwise("contradict").alias("track"), "language", F.lit(None).cast("string").alias("edition"), F.col("clause").cast("string").alias("kind"), F.lit(None).cast("string").alias("canon"),
        outcome.alias("outcome"), F.lit(False).alias("blocked"), F.when(F.col("error").isNull(), F.when(lost, 0.0).otherwise(1.0)).alias("score"), F.lit(False).alias("verbatim"), F.lit(False).alias("format_ok"),
    ))


def run_report(spark, sf_dir):
    """Summary of the run and of the slice of each edition."""
    return S.report(S.state(facts(spark, sf_dir)))


def edition_rows(spark, sf_dir):
    """Editions with score, number of items, means by canon as text."""
    d = S.edition_details(S.state(facts(spark, sf_dir)))
    canons = F.array_join(F.transform("canon_profile", lambda c: F.concat(c, F.lit("="), F.format_string("%.4f", F.element_at("by_canon", c)))), ",")
    return d.select("edition", "language", "score", "n", canons.alias("canons"))


def conviction_losses(spark, sf_dir):
    return S.conviction_losses(_encounters(spark, sf_dir))


_ENC = texts._ENCOUNTERS.replace(" FROM conversations", ", ['en', 'fr', 'de', 'es'][(conv_id % 4 + 1)::INT] AS language FROM conversations")
_FACTS = f"""{scores._FACTS}, {_ENC},
x AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'simple' ELSE 'hallucination' END AS track, lang AS language, source AS edition, tier AS kind, ['protestant', 'catholic', 'orthodox'][(doc_id % 3 + 1)::INT] AS canon,
  CASE WHEN doc_id % 2 = 0 THEN {_SIMPLE} ELSE {_HALL} END AS outcome, doc_id % 5 = 0 AS blocked, score, cause = 'good' AND doc_id % 4 = 0 AS verbatim, doc_id % 7 > 0 AS format_ok FROM facts
  UNION ALL SELECT CASE direction WHEN 'affirm' THEN 'defend' ELSE 'contradict' END, language, NULL, clause::VARCHAR, NULL,
  CASE WHEN error IS NOT NULL THEN 'referee_error' WHEN lost THEN CASE direction WHEN 'affirm' THEN 'would_not_affirm' ELSE 'conceded_denial' END ELSE 'held' END, false,
  CASE WHEN error IS NULL THEN CASE WHEN lost THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END, false, false
  FROM (SELECT *, CASE direction WHEN 'affirm' THEN coalesce(turn_reached, 99) > 1 ELSE coalesce(turn_reached, 99) <= 3 END AS lost FROM e)),
y AS (SELECT *, CASE WHEN blocked AND outcome IN ('no_attempt', 'no_response') THEN 'blocked_by_provider' ELSE outcome END AS cause FROM x),
d AS (SELECT DISTINCT edition AS slice, language AS its FROM x WHERE track = 'simple' AND edition IS NOT NULL),
b AS (SELECT NULL::VARCHAR AS slice, * FROM y UNION ALL SELECT edition AS slice, * FROM y WHERE track IN ('simple', 'hallucination') AND edition IN (SELECT slice FROM d)
  UNION ALL SELECT slice, y.* FROM y JOIN d ON language = its WHERE track NOT IN ('simple', 'hallucination')),
u AS (SELECT * FROM b WHERE score IS NOT NULL)"""
_RATES = ", ".join(f"('{t}', '{n}', {list(o)!r}, '')" for t, rs in S.RATES.items() for n, o in rs.items())
SQL = {
    "run_report": f"""WITH {_FACTS},
per AS (SELECT slice, track, language, count(*) AS n, CASE WHEN track IN ('defend', 'contradict') THEN round(avg(score), 4) ELSE avg(score) END AS mean FROM u GROUP BY slice, track, language),
t AS (SELECT slice, track, round(avg(mean), 4) AS score, count(*) AS languages, sum(n)::BIGINT AS n FROM per GROUP BY ALL),
j AS (SELECT u.*, per.n AS items, t.languages, t.n AS everything FROM u JOIN per ON u.slice IS NOT DISTINCT FROM per.slice AND u.track = per.track AND u.language = per.language JOIN t ON u.slice IS NOT DISTINCT FROM t.slice AND u.track = t.track),
c AS (SELECT slice, track, cause, round(sum((1 - score) / (items * languages)), 6) AS loss, count(*) FILTER (score < 1) AS n FROM j GROUP BY slice, track, cause HAVING round(sum((1 - score) / (items * languages)), 6) > 0),
m AS (SELECT slice, track, canon, language, avg(score) AS mean, count(*) AS n FROM u WHERE canon IS NOT NULL GROUP BY ALL),
r AS (SELECT * FROM (VALUES {_RATES}, ('simple', 'verbatim_rate', [], 'v'), ('simple', 'format_ok_rate', [], 'f')) AS r(of_track, name, outcomes, flag)),
g AS (SELECT * FROM (VALUES ('headline', ['simple', 'hallucination']), ('extended', ['defend', 'contradict'])) AS g(name, members))
SELECT slice, track, 'score' AS dim, NULL AS key, score AS value, n FROM t
UNION ALL SELECT b.slice, b.track, 'errors', NULL, NULL, count(*) FILTER (b.score IS NULL) FROM b JOIN per ON b.slice IS NOT DISTINCT FROM per.slice AND b.track = per.track AND b.language = per.language GROUP BY b.slice, b.track
UNION ALL SELECT slice, track, 'language', language, round(mean, 4), n FROM per
UNION ALL SELECT slice, track, 'edition', edition, round(avg(score), 4), count(*) FROM u WHERE edition IS NOT NULL GROUP BY ALL
UNION ALL SELECT slice, track, 'kind', kind, round(avg(score), 4), count(*) FROM u GROUP BY ALL
UNION ALL SELECT slice, track, 'outcome', outcome, round(count(*)::DOUBLE / any_value(everything), 4), count(*) FROM j GROUP BY slice, track, outcome
UNION ALL SELECT slice, track, 'canon', canon, round(avg(mean), 4), sum(n)::BIGINT FROM m GROUP BY slice, track, canon
UNION ALL SELECT slice, track, 'loss', cause, loss, n FROM c
UNION ALL SELECT slice, track, 'rate', name, round(hits::DOUBLE / everything, 4), hits FROM (SELECT slice, track, name, any_value(everything) AS everything,
  count(*) FILTER (list_contains(outcomes, outcome) OR (flag = 'v' AND verbatim) OR (flag = 'f' AND format_ok)) AS hits FROM j JOIN r ON track = of_track GROUP BY slice, track, name)
UNION ALL SELECT slice, NULL, name, CASE WHEN count(*) < 2 THEN 'partial' ELSE 'whole' END, round(sum(CASE WHEN track IN ('hallucination', 'contradict') THEN (score - 1) * 100 ELSE score * 100 END), 2), count(*) FROM t JOIN g ON list_contains(members, track) GROUP BY slice, name
UNION ALL SELECT slice, track, name || '_factor', cause, round(loss * 100, 2), n FROM c JOIN g ON list_contains(members, track) WHERE round(loss * 100, 2) > 0""",
    "edition_rows": f"""WITH {_FACTS}, p AS (SELECT edition, language, canon, avg(score) AS m, sum(score) AS s, count(*) AS n FROM y WHERE track = 'simple' AND score IS NOT NULL GROUP BY ALL)
SELECT edition, language, round(sum(s) / sum(n), 4) AS score, sum(n)::BIGINT AS n, string_agg(canon || '=' || printf('%.4f', round(m, 4)), ',' ORDER BY canon) AS canons FROM p GROUP BY edition, language""",
    "conviction_losses": f"""WITH {_ENC}, k AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'referee_error' WHEN direction = 'affirm' AND coalesce(turn_reached, 99) > 1 THEN 'would_not_affirm'
  WHEN direction = 'contradict' AND coalesce(turn_reached, 99) <= 3 THEN 'conceded_denial' END AS cause, count(*) OVER (PARTITION BY language, direction) AS items, (SELECT count(DISTINCT language) FROM e) AS languages FROM e)
SELECT cause, round(sum(1.0::DOUBLE / (items * languages)), 6) AS points, count(*) AS n FROM k WHERE cause IS NOT NULL GROUP BY cause""",
}
QUERIES = {f.__name__: f for f in (run_report, edition_rows, conviction_losses)}
