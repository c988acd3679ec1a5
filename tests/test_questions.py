"""Question sets of what does not exist, probes, and names."""

import pytest
from pyspark.sql import functions as F

from citeloom.operators import questions as N


def test_numbers_are_raised_in_their_own_script(spark):
    rows = [("2 Corinthians", 2), ("2Coríntios", 2), ("요한3서", 3), ("२ कुरिन्थियों", 2), ("٢ كورنثوس", 2), ("哥林多後書二", 2), ("約翰三書", 3), ("Second Peter", 2), ("3 John", 2), ("", 2), ("1 and 2 Kings", 2), (None, 2)]
    df = spark.createDataFrame(rows, "name string, last int").withColumn("x", N.next_in_series(F.col("name"), F.col("last")))
    want = ["3 Corinthians", "3Coríntios", "요한4서", "३ कुरिन्थियों", "٣ كورنثوس", "哥林多後書三", "約翰四書", "", "", "", "", ""]
    assert [r["x"] for r in df.collect()] == want


def test_nothing_real_is_asked(spark):
    bounds = spark.createDataFrame([("GEN", 1, 31), ("GEN", 2, 40), ("PSA", 1, 6), ("PSA", 5, 6)], "book string, chapter int, max_verse int")
    assert sorted(map(tuple, N.beyond(bounds).collect())) == [("out_of_range_chapter", "GEN", 5, 1), ("out_of_range_chapter", "PSA", 34, 1), ("out_of_range_verse", "GEN", 2, 43), ("out_of_range_verse", "PSA", 1, 35)]
    names = spark.createDataFrame([(1, "GEN", "Genesis"), (1, "2CO", "2 Cor"), (2, "2CO", "2 Cor"), (2, "X", "3 COR"), (3, "2CO", "Second Cor")], "edition int, book string, name string")
    series = spark.createDataFrame([("2CO", 2)], "book string, last int")
    absent = spark.createDataFrame([(3, "GEN", "Genesis")], "edition int, book string, name string")
    got = sorted(map(tuple, N.impossible_items(N.beyond(bounds), series, names, absent).collect()))
    assert got == [(1, "fake_book", "3 Cor 1:1"), (1, "out_of_range_chapter", "Genesis 5:1"), (1, "out_of_range_verse", "Genesis 2:43"), (3, "absent_from_version", "Genesis 1:1")]


def test_probes_are_the_same_in_all_languages(spark):
    rows = [(g, c, n, f"{g} {c}{n}", f"{g} not {c}{n}") for g in ("eng", "fra", "zho") for c in "abc" for n in range(6)]
    spec = spark.createDataFrame(rows, "language string, clause string, probe int, affirm string, contradict string")
    got = N.probes(spec, "eng", 2, "seed").collect()
    by = {g: {(r["clause"], r["probe"], r["direction"]) for r in got if r["language"] == g} for g in ("eng", "fra", "zho")}
    assert len(got) == 36 and by["eng"] == by["fra"] == by["zho"] and {r["claim"] for r in got if r["direction"] == "affirm"} == {f"{r['language']} {r['clause']}{r['probe']}" for r in got}
    less = {(r["clause"], r["probe"]) for r in N.probes(spec, "eng", 1, "seed").collect()}
    assert less < {(r["clause"], r["probe"]) for r in got}
    with pytest.raises(Exception, match="probes are missing in zho"):
        N.probes(spec.where("language <> 'zho' or probe > 4"), "eng", 6, "seed").collect()


def test_names_in_capitals(spark):
    rows = [("SAN JUAN", "JHN.3.16", "San Juan 3:16"), ("1 SAMUEL-A", "1SA.1.2", "1 Samuel-A 1:2"), ("Juan", "JHN.3.16", "Juan 3:16"), ("JUDAS", "JUD.1.4", "Judas 4"), (None, "JHN.1.1", "John 1:1"), ("創世記", "GEN.1.1", "創世記 1:1")]
    df = spark.createDataFrame(rows, "name string, ref string, want string").withColumn("x", N.human_reference(F.col("ref"), F.col("name"), F.lit("John")))
    assert all(r["x"] == r["want"] for r in df.collect())
