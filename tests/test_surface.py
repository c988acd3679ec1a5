"""SQL functions, the passage store, and streams that go on after a restart."""

import pytest
from pyspark.sql import functions as F

from citeloom.functions import extract as E
from citeloom.functions import similarity as S
from citeloom.functions import text as X
from citeloom.functions.register import register
from citeloom.sources.passages import PassageStore, own_editions, repeated_editions
from citeloom.streaming import ingest as I

SF = "/root/testdata/sf0.001"


def test_functions_from_sql(spark):
    assert len(register(spark)) == 14
    spark.read.parquet(f"{SF}/documents.parquet").createOrReplaceTempView("docs")
    spark.read.parquet(f"{SF}/benchmark.parquet").createOrReplaceTempView("items")
    texts = {r["doc_id"]: r["text"] for r in spark.table("docs").collect()}
    got = spark.sql("SELECT doc_id, text_loose(text) AS a, text_strict(text) AS b, size(char_grams(text)) AS g FROM docs").collect()
    assert all((r["a"], r["b"], r["g"]) == (X.loose(t := texts[r["doc_id"]]), X.strict(t), len(S.grams(t))) for r in got)
    rows = spark.sql("SELECT doc_id, s.* FROM docs, LATERAL sentence_spans(text) AS s").collect()
    assert sorted((r["doc_id"], r["text"], r["start"], r["end"]) for r in rows) == sorted((i, *x) for i, t in texts.items() for x in E.sentences(t))
    q = spark.sql("""SELECT q.text, q.start, q.end FROM (SELECT 'He said “one two three four” and "five six seven eight".' AS t), LATERAL quote_spans(t) AS q""").collect()
    assert [tuple(r) for r in q] == E.quotes('He said “one two three four” and "five six seven eight".')
    v = spark.sql("""SELECT v.* FROM (SELECT '<span class="verse" data-usfm="A.1.1+A.1.2"><span class="content">Hi</span></span>' AS t), LATERAL verse_spans(t) AS v""").collect()
    assert [tuple(r) for r in v] == [("A.1.1", 2, "Hi", "A.1.1+A.1.2")]
    r = spark.sql("SELECT references_of('See Alpha 3:4 and Beta १:२', map('Alpha', 'ALP', 'Beta', 'BET')) AS r, best_infix('abcd', 'xxabxdxx') AS i, span_similarity('abc', 'xabcx') AS s, best_attempt('“It is so.”', 'It is so.') AS a").head()
    assert [x["text"] for x in r["r"]] == ["ALP.3.4", "BET.1.2"] and tuple(r["i"]) == S.infix("abcd", "xxabxdxx") and r["s"] == 1.0 and tuple(r["a"]) == ("it is so", "trivial", 1.0)
    assert spark.sql("SELECT text_loose(NULL) AS a, quotes_of(NULL) AS q").head() == (None, [])


def page(*verses):
    return "".join(f'<span class="verse" data-usfm="{u}"><span class="content">{t}</span></span>' for u, t in verses)


def test_store_tells_absent_uncached_and_merged_apart(spark, tmp_path):
    store = PassageStore(spark, f"file://{tmp_path}/store")
    store.catalogue(spark.createDataFrame([(e, c, True) for e in (1, 2) for c in ("GEN.1", "GEN.2", "GEN.3")] + [(1, "GEN.INTRO", True), (1, "XXA.1", False)], "edition int, chapter string, canonical boolean"))
    pages = [(1, "gen.1", page(("GEN.1.1", "One"), ("GEN.1.2+GEN.1.3", "Two three"), ("GEN.1_1.4", "odd"))), (1, "GEN.3", ""), (2, "GEN.1", page(("GEN.1.1", "Uno")))]
    done = store.fetch(spark.createDataFrame(pages, "edition int, chapter string, html string"))
    assert sorted(map(tuple, done.collect())) == [(1, 2, 3), (2, 1, 1)]
    again = store.fetch(spark.createDataFrame([*pages, (2, "GEN.2", page(("GEN.2.1", "Dos")))], "edition int, chapter string, html string"))
    assert [tuple(x) for x in again.collect()] == [(2, 1, 1)]
    asked = [(1, "GEN.1.1"), (1, "gen.1.1 "), (1, "GEN.1.2"), (1, "GEN.1.9"), (1, "GEN.2.1"), (1, "GEN.3.1"), (1, "PSA.1.1"), (2, "GEN.1.1"), (1, "Genesis 1"), (1, None), (9, "GEN.1.1")]
    got = store.lookup(spark.createDataFrame(asked, "edition int, ref string")).collect()
    assert {(r["edition"], r["ref"]): (r["text"], r["state"]) for r in got} == {
        (1, "GEN.1.1"): ("One", "found"), (1, "gen.1.1 "): ("One", "found"), (1, "GEN.1.2"): (None, "merged"), (1, "GEN.1.9"): (None, "missing"), (1, "GEN.2.1"): (None, "uncached"), (1, "GEN.3.1"): (None, "missing"),
        (1, "PSA.1.1"): (None, "absent"), (2, "GEN.1.1"): ("Uno", "found"), (1, "Genesis 1"): (None, "malformed"), (1, None): (None, "malformed"), (9, "GEN.1.1"): (None, "absent"),
    }
    assert [tuple(r) for r in store.chapter_verses(1, "gen.1").collect()] == [("GEN.1.1", "One")] and store.chapter_verses(1, "PSA.1").count() == 0 and store.chapter_verses(1, "GEN.3").count() == 0
    with pytest.raises(LookupError):
        store.chapter_verses(1, "GEN.2")
    plan = store.edition(2)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert sorted(r["ref"] for r in store.edition(2).collect()) == ["GEN.1.1", "GEN.2.1"] and "PartitionFilters: [isnotnull(edition" in plan and "(edition" in plan


def test_repeated_editions_go(spark):
    rows = [(e, f"GEN.1.{n}", f"text {n}{'x' if e == 2 and n == 3 else ''}") for e in (1, 2, 5, 4) for n in range(9)]
    v = spark.createDataFrame(rows, "edition int, ref string, text string").repartition(5)
    again = repeated_editions(v)
    assert sorted(map(tuple, again.collect())) == [(4, 1), (5, 1)]
    e = spark.createDataFrame([("en", 1), ("en", 2), ("fr", 4), ("en", 5), ("en", 1)], "language string, edition int")
    assert sorted(x["edition"] for x in own_editions(e, again, "en").collect()) == [1, 2] and own_editions(e, again, include_duplicates=True).count() == 4


def test_gate_and_keys_survive_a_restart(spark, tmp_path):
    folder, mark = f"{tmp_path}/in", f"{tmp_path}/mark"
    write = lambda a, b, bad: spark.range(a, b).select("id", F.lit(bad).alias("bad")).coalesce(1).write.mode("append").parquet(folder)
    write(0, 100, False)
    read = lambda: I.stream(spark, folder, "id long, bad boolean", 1)
    assert I.gate(read(), "bad", mark) == [True]
    write(100, 120, True)
    assert I.gate(read(), "bad", mark) == [True]  # 20 of 120, counted with those before the restart
    write(120, 140, True)
    with pytest.raises(Exception, match="40 of 140 failed"):
        I.gate(read(), "bad", mark)
    out, done = f"{tmp_path}/out", f"{tmp_path}/done"
    I.ingest(I.once(read(), "id"), out, done)
    write(50, 150, False)
    I.ingest(I.once(read(), "id"), out, done)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(150))


def test_encounters_stop_at_the_first_concession_across_restarts(spark, tmp_path):
    folder = f"{tmp_path}/turns"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", I.ROCKS)
    try:
        def run(rows, k):
            spark.createDataFrame(rows, "conv long, turn long, gave boolean").coalesce(1).write.mode("append").parquet(folder)
            q = I.encounters(I.stream(spark, folder, "conv long, turn long, gave boolean", 1), "conv", "turn", "gave").writeStream.outputMode("update")
            q = q.foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{tmp_path}/said{k}")).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
            q.awaitTermination()
            return sorted(map(tuple, spark.read.schema("conv long, turns long, turn_reached long").parquet(f"{tmp_path}/said{k}").collect()))

        assert run([(1, 0, False), (1, 1, False), (2, 0, True), (2, 1, False)], 0) == [(1, 2, None), (2, 1, 0)]
        assert run([(1, 2, True), (1, 3, True), (2, 2, True), (3, 0, False)], 1) == [(1, 3, 2), (3, 1, None)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_verdicts_are_read_or_fail(spark):
    from citeloom.operators.rounds import verdict

    rows = ['{"conceded": true, "reasoning": "it did"}', ' {"reasoning": "held", "conceded": false} ', 'Well, conceded: TRUE as far as I see', '"conceded" = false']
    got = [tuple(r["v"]) for r in spark.createDataFrame([(x,) for x in rows], "a string").select(verdict(F.col("a")).alias("v")).collect()]
    assert got == [(True, "it did"), (False, "held"), (True, rows[2]), (False, rows[3])]
    for bad in (None, "", "it held firm", '{"conceded": "maybe"}'):
        with pytest.raises(Exception, match="unreadable verdict"):
            spark.createDataFrame([(bad,)], "a string").select(verdict(F.col("a")).alias("v")).collect()


def test_ties_of_any_type_and_shapes(spark):
    from citeloom.operators import match as M
    from citeloom.operators import rounds as N
    from citeloom.sources import store

    found = spark.createDataFrame([("s", 1, 0.9, "kjv", "b"), ("s", 1, 0.9, "asv", "z"), ("s", 1, 0.9, "asv", "c"), ("s", 2, 0.7, "x", "y")], "span string, rank int, similarity double, edition string, passage string")
    assert sorted(map(tuple, M.best_by_class(found, "span").collect())) == [("s", 1, 0.9, "asv", "c"), ("s", 2, 0.7, "x", "y")]
    assert [tuple(r) for r in N.best_edition(found, "span", "similarity", "edition", 0.8).collect()] == [("s", "asv", 0.9)]
    best = M.best_passage(spark.createDataFrame([("d", "one two three four five")], "doc string, text string"), spark.createDataFrame([("p2", "one two three four five"), ("p1", "one two three four five")], "pid string, text string"))
    assert [tuple(r) for r in best.collect()] == [("d", "p1", 1.0)]
    a, b = (store.pinned(spark.createDataFrame([(1, t)], "id int, text string"), "id", "text", loose=True).head()["digest"] for t in ("“It  IS so.”", "it is so"))
    assert a == b
    spec = spark.createDataFrame([("en", "a"), ("fr", "a"), ("fr", "b")], "language string, part string")
    with pytest.raises(Exception, match="parts differ"):
        store.checked_shape(spec, "language", ["part"]).collect()
    assert store.checked_shape(spec.where("part = 'a'"), "language", ["part"]).count() == 2
