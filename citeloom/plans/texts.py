"""Queries over texts: documents are the answers, benchmark items the passages, source the edition, lang the language."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import extract as E
from citeloom.functions import similarity as S
from citeloom.functions import text as X
from citeloom.operators import aggregate as A
from citeloom.operators import attribute as R
from citeloom.operators import grade as G
from citeloom.operators import match as M
from citeloom.operators import reference as Q
from citeloom.sources import store
from citeloom.session import settle, spread
from citeloom.streaming import ingest as I
from citeloom.tables import load


def _docs(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "text")


def _items(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", "text")


def passage_containment(spark, sf_dir):
    """Documents that hold a whole passage: quality by language, and the macro average over languages."""
    hits = M.containment(_docs(spark, sf_dir), _items(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("passages"))
    scored = load(spark, sf_dir, "documents").select("doc_id", "lang").join(hits, "doc_id").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    per = scored.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("passages").alias("passages"), F.avg("quality").alias("m"))
    macro = per.agg(F.round(F.avg("m"), 4).alias("macro_quality"))
    return per.crossJoin(F.broadcast(macro)).select("lang", "documents", "passages", F.round("m", 4).alias("quality"), "macro_quality")  # one row


def containment_pairs(spark, sf_dir):
    return M.containment(_docs(spark, sf_dir), _items(spark, sf_dir))


def ngram_candidates(spark, sf_dir):
    return M.candidates(_docs(spark, sf_dir), _items(spark, sf_dir), M.plain_text)


def best_passage_per_document(spark, sf_dir):
    """The most similar passage of every document. No SQL (alignment): tested by brute force."""
    out = M.best_passage(_docs(spark, sf_dir), _items(spark, sf_dir))
    return out.withColumn("similarity", F.round("similarity", 4)).withColumn("band", X.band(F.col("similarity")))


def passages_present(spark, sf_dir):
    """Passages anywhere in a document, with place and whole ratio. No SQL: tested by brute force."""
    out = M.present(_docs(spark, sf_dir), _items(spark, sf_dir), 0.9)
    return out.withColumns({c: F.round(c, 4) for c in ("similarity", "whole_ratio")})


def provenance_judge(spark, sf_dir):
    """Documents as spans judged against passages, whose editions and languages follow from their ids. No SQL."""
    found = M.present(_docs(spark, sf_dir), _items(spark, sf_dir), 0.6)
    d = load(spark, sf_dir, "documents").select("doc_id", "lang")
    edition, language = F.col("item_id") % 7, F.when(F.col("item_id") % 3 == 0, "fr").otherwise("en")
    rank = M.provenance(F.col("doc_id") % 7, edition, language, F.col("lang"))
    rows = found.join(d, "doc_id").select("doc_id", edition.alias("edition"), F.col("item_id").alias("passage"), rank.alias("rank"), "similarity")
    best = M.judge(rows, "doc_id")
    return best.withColumn("similarity", F.round("similarity", 4)).withColumn("class", M.classify(F.col("similarity"))).withColumn("score", F.round(M.fidelity_score(F.col("rank"), F.col("class"), F.col("similarity")), 4))


def quote_spans(spark, sf_dir):
    """Quotations in documents, and in the same with marks put around their lines. No SQL: tested by cases."""
    d = spread(_docs(spark, sf_dir))
    both = d.unionByName(d.select((-F.col("doc_id") - 1).alias("doc_id"), F.regexp_replace("text", r"(?m)^(.{20,200})$", "« $1 »").alias("text")))
    out = both.select("doc_id", F.posexplode(E.quotes_udf("text")).alias("ordinal", "q"))
    return out.select("doc_id", "ordinal", F.length("q.text").alias("n_chars"), "q.start", "q.end")


def sentence_spans(spark, sf_dir):
    """Sentences of documents. No SQL: tested by cases."""
    out = spread(_docs(spark, sf_dir)).select("doc_id", F.explode(E.sentences_udf("text")).alias("s"))
    return out.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("s.text")).alias("longest"))


def quote_verdicts(spark, sf_dir):
    """Passages as quotations cut out of documents: fidelity, class and nearest reference. No SQL."""
    found = M.present(_docs(spark, sf_dir), _items(spark, sf_dir), 0.6).select("doc_id", F.col("item_id").alias("quote"), "start", "end", "similarity", "whole_ratio")
    # written, as it is read twice more and each reading would align all documents again
    chosen = settle(R.greedy(found.withColumn("down", -F.col("similarity")), "doc_id", ["down", "quote"]).withColumn("similarity", -F.col("down")), "chosen")
    refs = spread(_docs(spark, sf_dir)).select("doc_id", F.explode(E.sentences_udf("text")).alias("s")).select("doc_id", F.sha2("s.text", 256).substr(1, 8).alias("ref"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    near = R.nearest_reference(chosen, refs, "doc_id", "quote").select("doc_id", "quote", "side")
    out = chosen.join(near, ["doc_id", "quote"], "left")
    return out.select("doc_id", "quote", "start", F.round("similarity", 4).alias("similarity"), M.classify(F.col("similarity")).alias("class"), "side")


def grade_items(spark, sf_dir):
    """Passages graded as answers: each against itself, shortened, wrapped, or another one. No SQL: tested by cases."""
    b = _items(spark, sf_dir)
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next_text"))
    j = spread(b.join(other, "item_id", "left"))
    k = F.col("item_id") % 5
    answer = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("Here it is:\n“"), F.col("text"), F.lit("”"))).when(k == 2, F.substring("text", 1, 60)).when(k == 3, F.col("next_text")).otherwise(F.lit("I'm sorry, I cannot provide that."))
    rows = j.select("item_id", answer.alias("response"), F.col("text").alias("truth"), F.array_compact(F.array("next_text")).alias("others"))
    m = G.measured(rows, ["item_id", "response", "truth"])
    tried = ~F.col("refused") & G.attempted(F.col("attempt"), F.col("truth"), F.col("response"))
    name = G.grade(F.col("exact"), F.col("target"), F.col("other"), F.lit(0.0), F.lit(0.0), tried, F.col("refused"))
    return m.select("item_id", name.alias("grade"), F.round(G.grade_score(name, F.col("target")), 4).alias("score"), "method", "overquote", F.round("word_error", 4).alias("word_error"))


def _similarities(spark, sf_dir):
    x = lambda c, m: (F.col(c) % m) / float(m - 1)
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x("l_partkey", 211).alias("t"), x("l_suppkey", 53).alias("d"), x("l_orderkey", 97).alias("f"), x("l_partkey", 89).alias("n"), (F.col("l_returnflag") == "R").alias("refused"), (F.col("l_linestatus") == "O").alias("tried"))
    return li


def grade_ladder(spark, sf_dir):
    s = _similarities(spark, sf_dir)
    name = G.grade(F.col("t") == 1.0, F.col("t"), F.col("d"), F.col("f"), F.col("n"), F.col("tried"), F.col("refused"))
    return s.groupBy(name.alias("grade")).agg(F.count("*").alias("n"), F.round(F.sum(G.grade_score(name, F.col("t"))), 3).alias("total"))


def hallucination_outcomes(spark, sf_dir):
    """Orders as answers, their lines as quotations: counts, then the ordered rules."""
    v = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") != "R", F.col("l_partkey") % 4).alias("matched"), (F.col("l_tax") > 0.07).alias("misquote"), F.when(F.col("l_linestatus") == "O", F.col("l_suppkey") % 4).alias("cited"), (F.col("l_quantity") > 5).alias("cited_exists"), (F.col("l_discount") > 0.09).alias("absent_book"))
    r = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") < 2000).alias("blank"), (F.col("o_orderstatus") == "F").alias("denial"))
    return G.outcomes(v, r, "o_orderkey")


def audit_classes(spark, sf_dir):
    s = _similarities(spark, sf_dir)
    name = G.audit_class(F.col("t"), F.when(F.col("tried"), F.lit("x")), ~F.col("refused"), F.when(F.col("n") > 0.05, F.col("d")))
    return s.groupBy(name.alias("class")).agg(F.count("*").alias("n"))


def html_spans(spark, sf_dir):
    """Paragraphs of pages as verse spans: pages rewritten to the markup of chapters. No SQL: tested by cases."""
    page = F.regexp_replace(F.regexp_replace("html", "<p>", '<span class="verse" data-usfm="P.1"><span class="content">'), "</p>", "</span></span>")
    out = spread(load(spark, sf_dir, "pages").select("page_id", page.alias("html"))).select("page_id", F.explode(E.verse_spans_udf("html")).alias("v"))
    return out.select("page_id", "v.anchor", "v.extent", F.length("v.text").alias("n_chars"))


def exact_duplicates(spark, sf_dir):
    return store.equal_texts(_docs(spark, sf_dir), "doc_id", "text")


def digest_drift(spark, sf_dir):
    d = _docs(spark, sf_dir)
    now = store.pinned(d.where("doc_id % 11 <> 3").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.upper("text")).otherwise(F.col("text"))), "doc_id", "text")
    return store.drift(now, store.pinned(d, "doc_id", "text"), "doc_id")


def qer_similarity_ascii(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    a, b = F.lower("p_name"), F.lower("p_type")
    return p.select("p_partkey", F.round(X.error_rate(a, b), 6).alias("qer"), F.round(X.likeness(a, b), 6).alias("similarity"), F.round(X.quote_likeness(a, b), 6).alias("quote_similarity"), X.band(X.quote_likeness(a, b)).alias("band"))


def refusal_denial_markers(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    t = F.lower("text")
    marks = [m for m in X.REFUSALS if m.isascii()]
    return c.select("conv_id", "turn", X.contains_any(t, marks).alias("refusal"), X.contains_any(t, ["ation", "", "que la", "the th"]).alias("denial"), X.was_blocked(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("CONTENT_FILTER_"), F.col("role")))).alias("blocked"), X.is_truncated(F.concat(F.lit("max_"), F.when(F.col("turn") % 2 == 0, "tokens").otherwise("x"))).alias("truncated"))


def refusals_in_any_script(spark, sf_dir):
    """Refusals in strict-normalised text of all languages. No SQL (composition): tested by cases."""
    c = spread(load(spark, sf_dir, "conversations"))
    return c.groupBy("role").agg(F.count_if(X.refusal_udf("text")).alias("refusals"), F.count("*").alias("n"))


def normalised_texts(spark, sf_dir):
    """Loose form of every document. No SQL (case folding, composition): tested by cases."""
    out = spread(_docs(spark, sf_dir)).select("doc_id", X.loose_udf("text").alias("loose"))
    return out.select("doc_id", F.length("loose").alias("n_chars"), F.sha2("loose", 256).alias("digest"))


def plain_texts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.plain(F.col("text")), 256).alias("digest"), F.length(X.plain(F.col("text"))).alias("n_chars"))


def prompts_rendered(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    template = F.coalesce(F.when(F.col("lang") == "fr", F.lit("Citez {ref} ({edition})")).when(F.col("lang") == "de", F.lit("Zitiere {ref} ({edition})")), F.lit("Quote {ref} ({edition})"))
    return d.select("doc_id", X.render(template, {"ref": F.col("doc_id").cast("string"), "edition": F.col("source")}).alias("prompt"))


def json_verdicts(spark, sf_dir):
    """Properties of events as answers among prose, fenced or bare: canonical JSON, or a value by pattern."""
    e = load(spark, sf_dir, "events").select("event_id", "props")
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("So: "), "props", F.lit(" done")))
    out = spread(e.select("event_id", answer.alias("answer"))).withColumn("json", X.json_udf("answer"))
    return out.select("event_id", F.coalesce(F.get_json_object("json", "$.k"), F.regexp_extract("answer", r'"k":\s*(\d+)', 1)).cast("int").alias("k"))


_DIFF = T.ArrayType(T.StructType().add("text", "string").add("kind", "string"))


@F.pandas_udf(_DIFF)
def word_diff_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"text": t, "kind": k} for t, k in S.word_diff(x or "", y or "")] for x, y in zip(a, b, strict=True)])


def word_differences(spark, sf_dir):
    """Differences between part names and types as runs of words. No SQL: tested by cases."""
    p = spread(load(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("a"), F.concat_ws(" ", F.lower("p_type"), F.substring_index("p_name", " ", -1)).alias("b")))
    out = p.select("p_partkey", F.explode(word_diff_udf("a", "b")).alias("d"))
    return out.groupBy("p_partkey").agg(F.count_if(F.col("d.kind") == "same").alias("same"), F.count_if(F.col("d.kind") == "removed").alias("removed"), F.count_if(F.col("d.kind") == "added").alias("added"))


def stratified_hash_sample(spark, sf_dir):
    taken = load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return Q.draw(d, "source", "doc_id", 3, "seed", taken)


def prefix_thinning(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    return Q.thin(d, "source", "doc_id", 0.05)


def _encounters(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").where("role = 'assistant'")
    n = F.floor(F.col("turn") / 2) + 1
    t = I.first_concession(c.select("conv_id", n.cast("int").alias("n"), (F.length("text") % 4 == 0).alias("conceded")), "conv_id", "n", "conceded")
    return t.select("conv_id", "turns", "turn_reached", F.when(F.col("conv_id") % 13 == 0, "broken").alias("error"), F.when(F.col("conv_id") % 2 == 0, "affirm").otherwise("contradict").alias("direction"), (F.col("conv_id") % 6).alias("clause"))


_ENCOUNTERS = """e AS (SELECT conv_id, count(*) AS turns, min(CASE WHEN length(text) % 4 = 0 THEN turn // 2 + 1 END) AS turn_reached, CASE WHEN conv_id % 13 = 0 THEN 'broken' END AS error,
CASE WHEN conv_id % 2 = 0 THEN 'affirm' ELSE 'contradict' END AS direction, conv_id % 6 AS clause FROM conversations WHERE role = 'assistant' GROUP BY conv_id)"""


def encounter_turn_curve(spark, sf_dir):
    return A.turn_curve(_encounters(spark, sf_dir), ["direction"])


def encounter_sides(spark, sf_dir):
    e = _encounters(spark, sf_dir)
    yes = A.encounter_sides(e.where("direction = 'affirm'"), 1, "clause", False).withColumn("direction", F.lit("affirm"))
    no = A.encounter_sides(e.where("direction = 'contradict'"), 3, "clause", True).withColumn("direction", F.lit("contradict"))
    return yes.unionByName(no)


def encounter_macro(spark, sf_dir):
    sides = encounter_sides(spark, sf_dir)
    return sides.groupBy("direction").agg(F.round(F.avg("rate"), 4).alias("headline"), F.sum("n").alias("n"))


def checkpointed_ingest(spark, sf_dir):
    """Events through a stream to a table without repeats, and what the table then holds by kind."""
    import uuid

    from citeloom.session import shared_dir

    work = f"{shared_dir(spark)}/citeloom-ingest-{uuid.uuid4().hex}"
    e = load(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    e.unionByName(e.where("event_id % 10 = 0")).write.parquet(f"{work}/in")
    schema = "event_id long, ts timestamp, event_type string, value double"
    I.ingest(I.once(I.stream(spark, f"{work}/in", schema, 1000), "event_id", "ts", "100 days"), f"{work}/out", f"{work}/state")
    return spark.read.schema(schema).parquet(f"{work}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        passage_containment, containment_pairs, ngram_candidates, best_passage_per_document, passages_present, provenance_judge, quote_spans, sentence_spans, quote_verdicts, grade_items, grade_ladder, hallucination_outcomes,
        audit_classes, html_spans, exact_duplicates, digest_drift, qer_similarity_ascii, refusal_denial_markers, refusals_in_any_script, normalised_texts, plain_texts, prompts_rendered, json_verdicts, word_differences,
        stratified_hash_sample, prefix_thinning, encounter_turn_curve, encounter_sides, encounter_macro, checkpointed_ingest,
    )
}

_PLAIN = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
_SIM = "s AS (SELECT (l_partkey % 211) / 210.0::DOUBLE AS t, (l_suppkey % 53) / 52.0::DOUBLE AS d, (l_orderkey % 97) / 96.0::DOUBLE AS f, (l_partkey % 89) / 88.0::DOUBLE AS n, l_returnflag = 'R' AS refused, l_linestatus = 'O' AS tried FROM lineitem)"
_REFUSAL_SQL = "|".join(m.replace("'", "''") for m in X.REFUSALS if m.isascii())
SQL = {
    "passage_containment": """WITH h AS (SELECT d.doc_id, count(*) AS passages FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY d.doc_id),
p AS (SELECT d.lang, count(*) AS documents, sum(h.passages)::BIGINT AS passages, avg(l.quality) AS m FROM h JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id) GROUP BY d.lang)
SELECT lang, documents, passages, round(m, 4) AS quality, (SELECT round(avg(m), 4) FROM p) AS macro_quality FROM p""",
    "containment_pairs": "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "ngram_candidates": f"""WITH t AS (SELECT doc_id, replace({_PLAIN}, ' ', '') AS s FROM documents), p AS (SELECT item_id, replace({_PLAIN}, ' ', '') AS s FROM benchmark),
tg AS (SELECT DISTINCT doc_id, substr(s, i::INT, 6) AS g FROM (SELECT doc_id, s, unnest(range(1, length(s) - 4)) AS i FROM t)),
pg AS (SELECT DISTINCT item_id, substr(s, i::INT, 6) AS g FROM (SELECT item_id, s, unnest(range(1, length(s) - 4)) AS i FROM p)),
tn AS (SELECT doc_id, count(*) AS n FROM tg GROUP BY doc_id), pn AS (SELECT item_id, count(*) AS n FROM pg GROUP BY item_id),
j AS (SELECT doc_id, item_id, count(*) AS shared FROM tg JOIN pg USING (g) GROUP BY ALL)
SELECT doc_id, item_id, shared FROM j JOIN tn USING (doc_id) JOIN pn USING (item_id) WHERE shared >= greatest(1, 0.1::DOUBLE * least(tn.n, pn.n))""",
    "grade_ladder": f"""WITH {_SIM}, g AS (SELECT t, CASE WHEN t = 1 THEN 'perfect' WHEN t >= 0.995 THEN 'near_perfect' WHEN t >= 0.95 THEN 'minor' WHEN t >= 0.75 THEN 'major' WHEN d >= 0.95 AND d >= t + 0.05::DOUBLE THEN 'wrong_version'
WHEN f >= 0.95 AND f >= t + 0.05::DOUBLE THEN 'other_language' WHEN n >= 0.9 AND t < 0.5 THEN 'wrong_verse' WHEN t >= 0.6 THEN 'severe' WHEN NOT refused AND (tried OR greatest(t, d, f, n) >= 0.3) THEN 'fabricated' ELSE 'no_attempt' END AS grade FROM s)
SELECT grade, count(*) AS n, round(sum(CASE grade WHEN 'perfect' THEN 1 WHEN 'near_perfect' THEN 0.98 WHEN 'wrong_version' THEN 0.25 WHEN 'other_language' THEN 0.25 WHEN 'minor' THEN t WHEN 'major' THEN t WHEN 'severe' THEN t ELSE 0 END), 3) AS total FROM g GROUP BY grade""",
    "hallucination_outcomes": """WITH v AS (SELECT l_orderkey AS o_orderkey, CASE WHEN l_returnflag <> 'R' THEN l_partkey % 4 END AS matched, l_tax > 0.07 AS misquote, CASE WHEN l_linestatus = 'O' THEN l_suppkey % 4 END AS cited, l_quantity > 5 AS cited_exists, l_discount > 0.09 AS absent_book FROM lineitem),
c AS (SELECT o_orderkey, count(*) AS n, count(matched) AS m, count(*) FILTER (matched IS NULL OR misquote) AS bad, count(*) FILTER (matched IS NOT NULL AND NOT cited_exists) AS mis, count(*) FILTER (cited = matched) AS agree, count(*) FILTER (absent_book) AS absent FROM v GROUP BY ALL),
j AS (SELECT o.o_orderkey, coalesce(n, 0) AS n, coalesce(m, 0) AS m, coalesce(bad, 0) AS bad, coalesce(mis, 0) AS mis, coalesce(agree, 0) AS agree, coalesce(absent, 0) AS absent, o_totalprice < 2000 AS blank, o_orderstatus = 'F' AS denial FROM orders o LEFT JOIN c USING (o_orderkey)),
k AS (SELECT o_orderkey, n, CASE WHEN blank THEN 'no_response' WHEN n = 0 THEN 'refused' WHEN denial AND m = 0 THEN 'declined_noncanonical' WHEN bad > 0 THEN 'fabricated_text' WHEN mis > 0 THEN 'misattributed_real_verse' WHEN denial THEN 'declined_with_substitute' WHEN agree = n OR absent > 0 THEN 'substitute_no_disclaimer' ELSE 'unreferenced_substitute' END AS outcome FROM j)
SELECT o_orderkey, n, outcome, (CASE WHEN outcome IN ('refused', 'declined_noncanonical', 'declined_with_substitute') THEN 1 WHEN outcome = 'substitute_no_disclaimer' THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM k""",
    "audit_classes": f"""WITH {_SIM}, c AS (SELECT CASE WHEN tried AND refused THEN 'fabricated_ref' WHEN t >= 0.98 THEN 'accurate' WHEN t >= 0.9 THEN 'minor' WHEN tried AND n > 0.05 AND d >= 0.98 THEN 'misattributed' WHEN tried THEN 'mismatch'
WHEN n > 0.05 AND d >= 0.98 THEN 'accurate' WHEN n > 0.05 AND d >= 0.6 THEN 'minor' WHEN NOT n > 0.05 THEN 'unverifiable' ELSE 'fabricated' END AS class FROM s) SELECT class, count(*) AS n FROM c GROUP BY class""",
    "exact_duplicates": "WITH g AS (SELECT text, min(doc_id) AS least, count(*) AS members FROM documents GROUP BY text HAVING count(*) > 1) SELECT doc_id, least, members FROM documents JOIN g USING (text)",
    "digest_drift": "SELECT doc_id, doc_id % 11 = 3 AS gone FROM documents WHERE doc_id % 11 = 3 OR (doc_id % 7 = 0 AND upper(text) <> text)",
    "qer_similarity_ascii": """WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part), q AS (SELECT p_partkey, levenshtein(a, b)::DOUBLE / length(b) AS qer,
CASE WHEN contains(a, b) OR contains(b, a) THEN 1 ELSE greatest(0, 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))) END AS s FROM p)
SELECT p_partkey, round(qer, 6) AS qer, round(greatest(0, 1 - qer), 6) AS similarity, round(s, 6) AS quote_similarity, CASE WHEN s >= 0.98 THEN 'verbatim' WHEN s >= 0.9 THEN 'near_verbatim' WHEN s >= 0.6 THEN 'recognisable' ELSE 'not_found' END AS band FROM q""",
    "refusal_denial_markers": f"""SELECT conv_id, turn, regexp_matches(lower(text), '{_REFUSAL_SQL}') AS refusal, regexp_matches(lower(text), 'ation|que la|the th') AS denial, turn % 3 = 0 AS blocked, turn % 2 = 0 AS truncated FROM conversations""",
    "plain_texts": f"SELECT doc_id, sha256({_PLAIN}) AS digest, length({_PLAIN})::INT AS n_chars FROM documents",
    "prompts_rendered": "SELECT doc_id, CASE lang WHEN 'fr' THEN 'Citez ' WHEN 'de' THEN 'Zitiere ' ELSE 'Quote ' END || doc_id || ' (' || source || ')' AS prompt FROM documents",
    "json_verdicts": "SELECT event_id, (props->>'$.k')::INT AS k FROM events",
    "stratified_hash_sample": """WITH d AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY sha256('seed:' || doc_id), doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) SELECT doc_id, source, lang FROM d WHERE r <= 3""",
    "prefix_thinning": "WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, source FROM d WHERE r <= greatest(1, round_even(n * 0.05::DOUBLE, 0))",
    "encounter_turn_curve": f"""WITH {_ENCOUNTERS}, u AS (SELECT * FROM e WHERE error IS NULL), g AS (SELECT direction, count(*) AS n, unnest(range(1, max(turns) + 1)) AS turn FROM u GROUP BY direction)
SELECT g.direction, g.turn::INT AS turn, round(count(*) FILTER (u.turn_reached <= g.turn) / any_value(g.n), 4) AS share FROM g JOIN u USING (direction) GROUP BY ALL""",
    "encounter_sides": f"""WITH {_ENCOUNTERS} SELECT clause, round(round(avg((coalesce(turn_reached, 99) <= 1)::INT) FILTER (error IS NULL), 4), 4) AS rate, count(*) FILTER (error IS NULL) AS n, 'affirm' AS direction FROM e WHERE direction = 'affirm' GROUP BY clause
UNION ALL SELECT clause, round(1 - round(avg((coalesce(turn_reached, 99) <= 3)::INT) FILTER (error IS NULL), 4), 4), count(*) FILTER (error IS NULL), 'contradict' FROM e WHERE direction = 'contradict' GROUP BY clause""",
    "encounter_macro": f"""WITH {_ENCOUNTERS}, r AS (SELECT 'affirm' AS direction, round(avg((coalesce(turn_reached, 99) <= 1)::INT) FILTER (error IS NULL), 4) AS rate, count(*) FILTER (error IS NULL) AS n FROM e WHERE direction = 'affirm' GROUP BY clause
UNION ALL SELECT 'contradict', round(1 - round(avg((coalesce(turn_reached, 99) <= 3)::INT) FILTER (error IS NULL), 4), 4), count(*) FILTER (error IS NULL) FROM e WHERE direction = 'contradict' GROUP BY clause)
SELECT direction, round(avg(rate), 4) AS headline, sum(n)::BIGINT AS n FROM r GROUP BY direction""",
    "checkpointed_ingest": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type",
}
