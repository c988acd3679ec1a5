"""Queries whose work must not grow with the pairs of a group: against plain versions, with what they do bounded."""

import itertools
import random

from pyspark.sql import functions as F

from citeloom.operators import attribute as R
from citeloom.operators import reference as Q
from citeloom.operators import rounds as N


def test_others_of_group_makes_no_pairs(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 2, 3, 4, None]), r.choice([1, 2, 3, None]), r.choice([1.0, 2.0, 5.0, None])) for _ in range(60)] + [(9, 1, 2.0), (9, 1, 3.0)]
    out = R.others_of_group(spark.createDataFrame(rows, "g int, m int, v double"), "g", "m", "v")
    want = {}
    for a, b in itertools.product(rows, rows):
        if a[0] is not None and a[0] == b[0] and None not in (a[1], b[1]) and a[1] != b[1]:
            n, most = want.get(a[:2], (0, None))
            want[a[:2]] = (n + 1, b[2] if most is None or (b[2] is not None and b[2] > most) else most)
    assert {(x[0], x[1]): (x[2], x[3]) for x in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_absent_members_equal_all_pairs(spark):
    r = random.Random(2)
    rows = sorted({(g % 3, g, i, i * 7 % 5) for g in range(14) for i in range(12) if r.random() < r.choice([0.1, 0.5, 0.9])} | {(7, 99, 1, 1)})
    has = {}
    for f, g, i, w in rows:
        has.setdefault((f, g), {})[i] = w
    want = set()
    for (f, g), own in has.items():
        best = max(((len(set(o)) - len(set(o) & set(own)), -s) for (h, s), o in has.items() if h == f and s != g), default=(0, 0))
        if best[0] > 0:
            lacking = sorted((-w, i) for i, w in has[f, -best[1]].items() if i not in own)
            want |= {(g, -best[1], best[0], i, k) for k, (_, i) in enumerate(lacking[:2], 1)}
    got = Q.absent_members(spark.createDataFrame(rows, "f int, g int, i int, weight int"), "g", "i", "f").collect()
    assert {tuple(x) for x in got} == want


def test_aliases_compare_equal_texts_once(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), k, r.choice(["one", "one two", "three", "one one", ""])) for k in range(40)] + [("a", 3, "three"), ("b", 3, "one")]
    df = spark.createDataFrame(rows, "block string, key int, text string")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def like(a, b):
        calls.add(1)
        return a[:3] == b[:3]

    got = {x["key"]: x["alias"] for x in N.aliases(df, df, "block", "key", "text", like("text", "other_text").cast("int"), 1).collect()}
    want = {}
    for (b, k, t), (c, o, u) in itertools.product(rows, rows):
        if b == c and k != o and t[:3] == u[:3]:
            want[k] = min(o, want.get(k, o))
    assert got == want
    assert calls.value <= 2 * 5 * 5
