import random

import pytest
from pyspark.sql import functions as F

from citeloom.functions import similarity as S
from citeloom.operators import aggregate as A
from citeloom.operators import attribute as R
from citeloom.operators import grade as G
from citeloom.operators import match as M
from citeloom.operators import reference as Q
from citeloom.operators import serve as V
from citeloom.sources import store
from citeloom.streaming import ingest as I


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_losses_add_up_to_the_shortfall(spark):
    data = [("a", "x", 1.0), ("a", "y", 0.25), ("b", "y", 0.5), ("b", "z", 0.0), ("b", "x", 1.0), ("c", "z", 0.1)]
    df = spark.createDataFrame(data, "lang string, cause string, score double")
    macro = A.macro_mean(df, "lang", "score").head()["macro_mean"]
    lost = sum(r["loss"] for r in A.losses(df, "lang", "cause", "score").collect())
    assert macro + lost == pytest.approx(1.0, abs=2e-4)


def test_a_small_group_weighs_as_much_as_a_large_one(spark):
    df = spark.createDataFrame([("a", 1.0)] * 2 + [("b", 0.0)] * 100, "lang string, score double")
    assert A.macro_mean(df, "lang", "score").head()["macro_mean"] == 0.5
    assert A.macro_mean(df.where("false"), "lang", "score").head()["macro_mean"] == 0.0


def test_a_missing_group_is_not_zero(spark):
    df = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 0.0), ("q", "a", 1.0)], "canon string, lang string, score double")
    got = {r["canon"]: r["macro_mean"] for r in A.macro_mean(df, "lang", "score", by=["canon"]).collect()}
    assert got == {"p": 0.5, "q": 1.0}


def test_ledger_and_composite(spark):
    t = spark.createDataFrame([("a", "credit", 0.5), ("b", "debit", 0.75), ("c", "credit", None)], "track string, direction string, score double")
    r = A.composite(t).head()
    assert (r["points"], r["tracks"], r["partial"]) == (25.0, 2, True)


def test_encounters_without_usable_rows_have_no_rate(spark):
    e = spark.createDataFrame([(1, None, "x", 2), (2, 1, None, 3), (3, None, None, 3)], "id int, turn_reached int, error string, turns int")
    assert e.where("id = 1").agg(A.reached_by(1)).head()[0] is None
    assert e.agg(A.reached_by(1)).head()[0] == 0.5
    assert rows(A.turn_curve(e.withColumn("g", F.lit("g")), ["g"])) == [("g", 1, 0.5), ("g", 2, 0.5), ("g", 3, 0.5)]


def test_health_is_judged_after_enough_rows(spark):
    few = spark.range(10).withColumn("bad", F.lit(True))
    assert A.healthy(few, "bad").head()["ok"]
    assert not A.healthy(spark.range(50).withColumn("bad", F.col("id") < 11), "bad").head()["ok"]


def test_grades_are_ordered(spark):
    cases = [
        ((True, 1.0, 0, 0, 0, True, False), "perfect"), ((False, 0.996, 0, 0, 0, True, False), "near_perfect"), ((False, 0.95, 1, 0, 0, True, False), "minor"), ((False, 0.75, 1, 1, 1, True, False), "major"),
        ((False, 0.7, 0.96, 1, 0, True, False), "wrong_version"), ((False, 0.7, 0.5, 0.97, 0, True, False), "other_language"), ((False, 0.4, 0, 0, 0.9, True, False), "wrong_verse"), ((False, 0.6, 0, 0, 0.9, True, False), "severe"),
        ((False, 0.2, 0, 0, 0, True, False), "fabricated"), ((False, 0.35, 0, 0, 0, False, False), "fabricated"), ((False, 0.35, 0, 0, 0, False, True), "no_attempt"), ((False, 0.1, None, None, None, False, False), "no_attempt"),
    ]
    df = spark.createDataFrame([(i, *[float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in c]) for i, (c, _) in enumerate(cases)], "i int, e boolean, t double, d double, f double, n double, a boolean, r boolean")
    got = df.select("i", G.grade(*[F.col(c) for c in "etdfnar"]).alias("g")).orderBy("i").collect()
    assert [r["g"] for r in got] == [g for _, g in cases]


def test_scores_are_continuous_over_grades(spark):
    df = spark.range(60, 96).select((F.col("id") / 100).alias("t"))
    g = G.grade(F.lit(False), F.col("t"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(True), F.lit(False))
    got = [r[0] for r in df.select(G.grade_score(g, F.col("t")).alias("s")).orderBy("t").collect()]
    assert got == sorted(got) and max(b - a for a, b in zip(got, got[1:], strict=False)) < 0.02


def test_wrapped_answers_are_unwrapped():
    truth = "In the beginning was the word and all was well."
    assert G.trivial(f"John 1:1 (NIV):\n“{truth}”") == truth
    assert G.trivial(f"> {truth}") == truth
    assert G.trivial(f"1. {truth} (John 1:1)") == truth
    assert G.trivial(f"{truth} — John 1:1") == truth
    attempt, method, exact, target, *_ = G.measure(f"“{truth}”", truth, [])
    assert (method, exact, target) == ("trivial", True, 1.0)
    attempt, method, exact, target, *_ = G.measure("Long talk before it. " * 5 + truth + " and after " * 9, truth, [])
    assert method == "window" and not exact and target > 0.95


def test_outcomes(spark):
    v = spark.createDataFrame([(1, None, False, None, None, False), (2, "a", False, "a", True, False), (3, "a", False, "b", False, False), (4, "a", False, None, None, False), (5, None, False, None, None, False)], "id int, matched string, misquote boolean, cited string, cited_exists boolean, absent_book boolean")
    r = spark.createDataFrame([(1, False, False), (2, False, False), (3, False, False), (4, False, False), (5, False, True), (6, False, False), (7, True, False)], "id int, blank boolean, denial boolean")
    got = {x["id"]: x["outcome"] for x in G.outcomes(v, r, "id").collect()}
    assert got == {1: "fabricated_text", 2: "substitute_no_disclaimer", 3: "misattributed_real_verse", 4: "unreferenced_substitute", 5: "declined_noncanonical", 6: "refused", 7: "no_response"}


PASSAGES = [(1, "In the beginning the world was made of water and of light"), (2, "Thou shalt not kill"), (3, "A long and quite different passage about ships that pass in the night")]


def test_candidates_by_index_and_by_join_agree(spark):
    p = spark.createDataFrame(PASSAGES, "pid long, text string")
    t = spark.createDataFrame([(10, "He wrote: in the beginning the world was made of water, and of light!"), (11, "nothing of the kind"), (12, None), (13, "")], "tid long, text string")
    a, b = M.candidates(t, p), M.candidates_by_join(t, p)
    assert rows(a.select("tid", "pid", "shared")) == rows(b.select("tid", "pid", "shared"))
    assert (10, 1) in {(r["tid"], r["pid"]) for r in a.collect()}


def test_best_and_present(spark):
    p = spark.createDataFrame(PASSAGES, "pid long, text string")
    t = spark.createDataFrame([(10, "Intro. In the beginning the world was made of water and of lights. Thou shalt not kill, he said."), (11, "thou shalt not")], "tid long, text string")
    best = {r["tid"]: (r["pid"], round(r["similarity"], 3)) for r in M.best_passage(t, p).collect()}
    assert best[11] == (2, 1.0)
    found = {(r["tid"], r["pid"]) for r in M.present(t, p).collect()}
    assert (10, 1) in found and (10, 2) in found and (11, 2) not in found  # a short passage must be there nearly whole


def test_best_equals_brute_force(spark):
    p = spark.createDataFrame(PASSAGES, "pid long, text string")
    texts = [(i, t[k : k + 30 + i]) for i, (k, t) in enumerate((k, t) for _, t in PASSAGES for k in (0, 5))]
    got = {r["tid"]: round(r["similarity"], 9) for r in M.best_passage(spark.createDataFrame(texts, "tid long, text string"), p, normalise=M.plain_text).collect()}
    want = {i: round(max(S.similarity(M.plain_text(t), M.plain_text(q)) for _, q in PASSAGES), 9) for i, t in texts if t}
    assert got == {k: v for k, v in want.items() if k in got} and len(got) == len(want)


def test_judge_prefers_provenance(spark):
    f = spark.createDataFrame([(1, 5, 1, 0, 0.7), (1, 6, 1, 1, 0.99), (2, 5, 1, 2, 0.8), (3, 5, 1, 1, 0.7), (3, 4, 2, 1, 0.7)], "span int, edition int, passage int, rank int, similarity double")
    got = {r["span"]: (r["edition"], r["rank"]) for r in M.judge(f, "span").collect()}
    assert got == {1: (5, 0), 3: (4, 1)}


def test_containment_overlapping_patterns(spark):
    p = spark.createDataFrame([(1, "abc"), (2, "bcd"), (3, "abc"), (4, ""), (5, None)], "pid long, text string")
    t = spark.createDataFrame([(1, "xabcdx"), (2, "ab"), (3, None)], "tid long, text string")
    assert rows(M.containment(t, p)) == [(1, 1), (1, 2), (1, 3)]


def test_spans(spark):
    s = spark.createDataFrame([(1, 0, 10, 1), (1, 5, 15, 2), (1, 12, 20, 3), (2, 0, 5, 4)], "key int, start int, end int, id int")
    assert rows(R.greedy(s, "key", ["start", "id"]).select("id")) == [(1,), (3,), (4,)]
    o = spark.createDataFrame([(1, 14, 16)], "key int, start int, end int")
    assert rows(R.overlapping(s, o, "key", True).select("id")) == [(2,), (3,)]
    assert rows(R.overlapping(s, o, "key", False).select("id")) == [(1,), (4,)]
    q = s.withColumnRenamed("id", "quote")
    refs = spark.createDataFrame([(1, "far", 130, 135), (1, "near", 25, 30), (2, "before", -20, -10)], "key int, ref string, start int, end int")
    got = {r["quote"]: r["ref"] for r in R.nearest_reference(q, refs, "key", "quote").collect()}
    assert got == {1: "near", 2: "near", 3: "near", 4: "before"}


def test_runs_stop_at_gaps(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 4, "d")], "g int, at int, text string")
    assert rows(R.runs_from(df, "g", "at", "text").select("at", "window")) == [(1, "a"), (1, "a b"), (2, "b"), (4, "d")]


def test_schemes_round_trip(spark):
    m = spark.createDataFrame([("a", "PSA 3:0-2", "PSA 3:1-3"), ("b", "PSA 9:1", "PSA 3:1"), ("a", "bad", "PSA 1:1"), ("a", "PSA 5:1-3", "PSA 5:1-2")], "scheme string, source string, target string")
    e = Q.expand(m)
    assert rows(e) == [("a", "PSA.3.0", "PSA.3.1"), ("a", "PSA.3.1", "PSA.3.2"), ("a", "PSA.3.2", "PSA.3.3"), ("a", "PSA.5.3", "PSA.5.2"), ("b", "PSA.9.1", "PSA.3.1")]
    refs = spark.createDataFrame([("PSA.3.0",), ("GEN.1.1",)], "ref string")
    assert rows(Q.translate(refs, e, "a", "b").select("ref", "translated")) == [("GEN.1.1", "GEN.1.1"), ("PSA.3.0", "PSA.9.1")]


def test_references(spark):
    df = spark.createDataFrame([(" jhn.3.16",), ("PSA.106_1.1",), ("3MA.1.1",), (None,)], "r string")
    got = df.select(Q.parse(F.col("r")).alias("p"), Q.canon(F.substring("r", 1, 3)).alias("c")).collect()
    assert got[0]["p"]["verse"] == 16 and got[1]["p"] is None and got[2]["c"] == "orthodox" and got[3]["p"] is None
    b = spark.createDataFrame([("2 Corinthians", 2), ("2Coríntios", 2), ("Corinthians", 2), ("3 John", 2)], "n string, k int")
    assert [r[0] for r in b.select(Q.bumped(F.col("n"), F.col("k"))).collect()] == ["3 Corinthians", "3Coríntios", "", ""]


def test_drawing_is_nested_and_repeatable(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 5).alias("g"))
    five = {r["id"] for r in Q.draw(df, "g", "id", 5, "s").collect()}
    two = {r["id"] for r in Q.draw(df, "g", "id", 2, "s").collect()}
    assert two < five and len(five) == 25 and five == {r["id"] for r in Q.draw(df.repartition(7), "g", "id", 5, "s").collect()}
    assert {r["id"] for r in Q.draw(df, "g", "id", 5, "s", df.where("id in (1, 2)")).collect()}.isdisjoint({1, 2})
    thinned = {r["g"]: r["count"] for r in Q.thin(df.where("id < 26"), "g", "id", 0.5).groupBy("g").count().collect()}
    assert thinned == {0: 3, 1: 2, 2: 2, 3: 2, 4: 2}  # 6 and 5 rows: 2.5 rounds to the even side


def test_serving(spark):
    b = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0)], "n string, s double")
    assert [r["n"] for r in V.leaderboard(b, "s", "n").orderBy("rank").collect()] == ["c", "a", "b"]
    assert V.page(b, [F.col("n")], 1, 0).collect()[0]["n"] == "b"
    old, new = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert rows(V.overlay(old, new, key="k")) == [(1, "x"), (2, "z"), (3, "w")]
    v = spark.createDataFrame([("v0.5",), ("v0.5-fast",), ("v1.2",)], "v string")
    assert [r[0] for r in v.select(V.version_order(F.col("v"))).collect()] == [5.0, 4.5, 1002.0]


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "c\u0085d\ne")], "id int, text string")
    store.write_lines(df, f"{tmp_path}/l")
    store.append_lines(df, f"{tmp_path}/l")
    assert rows(store.read_lines(spark, f"{tmp_path}/l", "id int, text string")) == sorted([(1, "a b"), (2, "c\u0085d\ne")] * 2)
    assert rows(store.upsert(df, spark.createDataFrame([(2, "n")], "id int, text string"), "id")) == [(1, "a b"), (2, "n")]
    with pytest.raises(Exception, match="no partner"):
        store.pair_files(df.withColumnRenamed("id", "p"), df.where("id = 1").withColumnRenamed("id", "p"), "p").collect()
    spec = spark.createDataFrame([("en", "c1", "x"), ("de", "c1", "x"), ("fr", "c2", "x")], "l string, c string, p string")
    assert not store.same_shape(spec, "l", ["c", "p"]).head()["same"]
    then = store.pinned(df, "id", "text")
    assert rows(store.drift(then.where("id = 1"), then, "id")) == [(2, True)]


def test_stream_ingest_resumes_without_repeats(spark, tmp_path):
    df = spark.range(60).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), (F.col("id") < 30).alias("bad"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: I.ingest(I.once(I.stream(spark, f"{tmp_path}/in", "id long, ts timestamp, bad boolean"), "id", "ts", "30 days"), f"{tmp_path}/out", f"{tmp_path}/state")
    run()
    df.unionByName(df.withColumn("id", F.col("id") + 60)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 120 and out.select("id").distinct().count() == 120
    with pytest.raises(Exception):
        I.gate(I.stream(spark, f"{tmp_path}/in", "id long, ts timestamp, bad boolean", 100), "bad", f"{tmp_path}/gate")


def test_queries_have_matching_registrations():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def stored(spark, at, **tables):
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_sibling_extra_members_over_parts_of_all_sizes(spark, tmp_path):
    from citeloom.plans.joins import sibling_extra_members

    r = random.Random(4)
    nation, weight = {s: s % 3 for s in range(1, 12)}, {p: r.randint(1, 50) for p in range(1, 40)}
    has = {s: set(r.sample(sorted(weight), r.randint(3, 15))) for s in nation}
    lines = [(s, p) for s in has for p in has[s]] * 2
    at = stored(spark, tmp_path, lineitem=(lines, "l_suppkey long, l_partkey long"), supplier=([*nation.items()], "s_suppkey long, s_nationkey int"), part=([*weight.items()], "p_partkey long, p_size int"))
    want = []
    for s in has:
        extra = {o: has[o] - has[s] for o in has if o != s and nation[o] == nation[s] and has[o] - has[s]}
        if extra:
            o = min(extra, key=lambda x: (-len(extra[x]), x))
            want += [(s, o, len(extra[o]), p, k) for k, p in enumerate(sorted(extra[o], key=lambda p: (-weight[p], p))[:2], 1)]
    out = sibling_extra_members(spark, at)
    assert rows(out.select("l_suppkey", "sibling", "extra", "l_partkey", "place")) == sorted(want) and any(weight[x[3]] > 3 for x in want)


def test_two_round_identification_takes_every_customer(spark, tmp_path):
    from citeloom.plans.rounds import two_round_identification

    r = random.Random(6)
    nations = [(i, i // 4) for i in range(12)]
    suppliers = [(k, r.randrange(12), float(r.randrange(4000, 10000, 500))) for k in range(1, 25)]
    customers = [(k, r.randrange(12), r.uniform(-900, 9900)) for k in range(1, 80)]
    at = stored(spark, tmp_path, nation=(nations, "n_nationkey int, n_regionkey int"), supplier=(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double"), customer=(customers, "c_custkey long, c_nationkey int, c_acctbal double"))
    want = []
    for c, n, _ in customers:
        home = [(-x, s) for s, m, x in suppliers if m == n and x >= 6000]
        away = [(-x, s) for s, m, x in suppliers if m != n and m // 4 == n // 4 and x >= 9000]
        if home or away:
            x, s = min(home or away)
            want.append((c, s, -x, 1 if home else 2))
    assert rows(two_round_identification(spark, at)) == sorted(want) and {x[3] for x in want} == {1, 2}


def test_wrappers_around_an_answer():
    assert G.trivial("```text\nSome words here.\n```") == "Some words here."
    assert G.trivial("> One line\n>\n> and more") == "One line\nand more"
    assert G.trivial("12 )stays") == ")stays" and G.trivial("12 ) goes") == "goes" and G.trivial("1234 stays") == "1234 stays" and G.trivial("7. goes") == "goes"
    assert G.trivial("Words of it.\nJohn 3:16 (NIV)") == "Words of it." and G.trivial("3:16") == "3:16"
    assert G.trivial("Words (a [b] c)") == "Words (a [b] c)" and G.trivial("") == ""
