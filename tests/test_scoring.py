"""Two-pass scoring against a plain version over all pairs, translation of references, and the kernels beneath."""

import math
import random
import re
from functools import lru_cache

import pandas as pd
import pytest

from citeloom.functions import similarity as S
from citeloom.functions import text as X
from citeloom.operators import grade as G
from citeloom.operators import reference as Q
from citeloom.operators import scoring as C
from citeloom.plans import audit as plans

SF = "/root/testdata/sf0.001"


def test_edit_counts_are_those_of_a_shortest_edit():
    r = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        c = S.edit_counts(a, b)
        assert sum(c.values()) == S.distance(a, b) and c["insert"] - c["delete"] == len(b) - len(a)
    assert S.edit_counts("x" * 3000, "y" * 2000) == {"insert": 0, "delete": 1000, "replace": 2000}


def test_word_diff_keeps_a_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(300):
        a, b = (" ".join(r.choice("abcd") for _ in range(r.randint(0, 9))) for _ in range(2))
        x, y = (["".join(t for t, k in S.word_diff(a, b) if k in kinds) for kinds in (("same", "removed"), ("same", "added"))])
        assert (x, y) == (a, b)
        u, v = (re.findall(r"\s+|\S+", t) for t in (a, b))

        @lru_cache(None)
        def dp(i, j, u=u, v=v):
            return 0 if i == len(u) or j == len(v) else dp(i + 1, j + 1) + 1 if u[i] == v[j] else max(dp(i + 1, j), dp(i, j + 1))

        i = j = 0
        want = []
        while i < len(u) or j < len(v):
            if i < len(u) and j < len(v) and u[i] == v[j]:
                want.append((u[i], "same"))
                i, j = i + 1, j + 1
            elif j == len(v) or (i < len(u) and dp(i + 1, j) >= dp(i, j + 1)):
                want.append((u[i], "removed"))
                i += 1
            else:
                want.append((v[j], "added"))
                j += 1
        flat = [(w, k) for t, k in S.word_diff(a, b) for w in re.findall(r"\s+|\S+", t)]
        assert flat == want


def test_floors_only_leave_out_what_lies_below():
    r = random.Random(3)
    for _ in range(500):
        a, b = ("".join(r.choice("abcd ") for _ in range(r.randint(0, 40))) for _ in range(2))
        whole = S.similarity(a, b)
        for floor in (0.5, 0.8):
            got = S.similarity(a, b, floor)
            assert got == whole if whole >= floor else got < floor


MAPS = [("lxx", "PSA 3:0-2", "PSA 3:1-3"), ("LXX", "PSA 9:1", "PSA 10:5"), ("vul", "PSA 9:1", "PSA 9:2"), ("lxx", "PSA 8:1", "PSA 9:2")]


def test_translation_pivots_and_unknown_schemes_fail(spark):
    mapping = Q.expand(spark.createDataFrame(MAPS, "scheme string, source string, target string"))
    rows = spark.createDataFrame([(1, "PSA.3.0", "lxx", "org"), (2, "PSA.8.1", "lxx", "VUL"), (3, "PSA.9.2", "vul", "vul"), (4, "GEN.1.1", "vul", "lxx"), (5, "PSA.10.5", "org", "lxx")], "id int, ref string, a string, b string")
    got = {x["id"]: x["translated"] for x in Q.translated(rows, mapping, "ref", "a", "b", ["lxx", "vul"]).collect()}
    assert got == {1: "PSA.3.1", 2: "PSA.9.1", 3: "PSA.9.2", 4: "GEN.1.1", 5: "PSA.9.1"}
    for bad in ("nope", None):
        with pytest.raises(Exception, match="unknown numbering scheme"):
            Q.translated(spark.createDataFrame([(1, "PSA.3.0", bad, "lxx")], "id int, ref string, a string, b string"), mapping, "ref", "a", "b", ["lxx", "vul"]).collect()


def half_up(x):
    return math.floor(x * 10_000 + 0.5) / 10_000


def plain(items, answers, passages, editions, mapping, schemes):
    """Every answer against every passage, with the ladder spelled out."""
    said = dict(answers)
    to = {}
    for s, ref, org in sorted(mapping):
        to.setdefault((s, ref), org)
    back = {}
    for s, ref, org in sorted(mapping):
        back.setdefault((s, org), ref)

    def like(text, bare, whole):
        w = X.loose(text)
        return max(S.likeness(bare, w) if bare else 0.0, S.infix(w, whole)[0]) if w else 0.0

    def best(some, bare, whole):
        found = [(-like(t, bare, whole), k) for k, t in some if t.strip()]
        return (min(found)[1], -min(found)[0]) if found else None

    out = {}
    for item, language, edition, ref, source_ref, digest in items:
        truth = next((t for e, _, r, t in passages if (e, r) == (edition, ref)), None)
        if item not in said or truth is None or not truth.strip():
            continue
        text = said[item] or ""
        bare, whole, want = X.loose(G.trivial(text)), X.loose(text), X.loose(truth)
        attempt, _, exact, target, _, _, _ = G.measure(text, truth, [])
        d = best([(str(e), t) for e, g, r, t in passages if g == language and r == ref and e != edition], bare, whole)
        n = best([(r, t) for e, _, r, t in passages if e == edition and r != ref and r.rsplit(".", 1)[0] == ref.rsplit(".", 1)[0]], bare, whole)
        refused = X.is_refusal(text)
        tried = not refused and (X.nonspace_length(bare) >= max(10, 0.4 * X.nonspace_length(want)) or G.quoted_span(text))

        def grade(f, d=d, n=n, exact=exact, target=target, refused=refused, tried=tried):
            s = [x[1] if x else 0.0 for x in (d, f, n)]
            if exact:
                return "perfect"
            for bound, name in ((0.995, "near_perfect"), (0.95, "minor"), (0.75, "major")):
                if target >= bound:
                    return name
            if s[0] >= 0.95 and s[0] >= target + 0.05:
                return "wrong_version"
            if s[1] >= 0.95 and s[1] >= target + 0.05:
                return "other_language"
            if s[2] >= 0.9 and target < 0.5:
                return "wrong_verse"
            if target >= 0.6:
                return "severe"
            return "fabricated" if not refused and (tried or max(target, *s) >= 0.3) else "no_attempt"

        name, f = grade(None), None
        if name in C.UNEXPLAINED:
            some = []
            for e, g, scheme, tested in editions:
                scheme = scheme.lower()
                if tested and g != language and scheme in (*schemes, "org"):
                    org = to.get((C.SOURCE, source_ref), source_ref)
                    there = source_ref if scheme == C.SOURCE else org if scheme == "org" else back.get((scheme, org), org)
                    some += [(f"{g}:{e}", t) for e2, _, r, t in passages if (e2, r) == (e, there)]
            f = best(some, bare, whole)
            name = grade(f)
        score = {"perfect": 1.0, "near_perfect": 0.98, "wrong_version": 0.25, "other_language": 0.25}.get(name, target if name in ("minor", "major", "severe") else 0.0)
        out[item] = (name, half_up(score), *(None if x is None else (x[0], half_up(x[1])) for x in (d, n, f)), digest is not None and digest != X.digest(want))
    return out


def test_two_passes_equal_the_plain_version(spark):
    schemes = ["eng", "lxx"]
    tables = plans.scored_tables(spark, SF)
    data = [[tuple(r) for r in t.collect()] for t in tables]
    data[0].append((10**9, "en", 1, "ALP.99.1", "ALP.99.1", None))  # an item without passage
    data[1] += [(10**9, "words"), (10**9 + 1, "no item")]
    data[2].append((2, "en", "ALP.1.9", " "))  # a blank passage
    data[0].append((10**9 + 2, "en", 2, "ALP.1.9", "ALP.1.9", None))
    data[1].append((10**9 + 2, None))
    data[0][0] = (*data[0][0][:5], "00")  # a passage that has changed
    made = [spark.createDataFrame(rows, t.schema) for rows, t in zip(data, tables, strict=True)]
    got = C.score_answers(*made, schemes).collect()
    pair = lambda x: None if x is None else (x["key"], x["similarity"])
    have = {r["item"]: (r["grade"], r["score"], pair(r["best_edition"]), pair(r["best_neighbour"]), pair(r["best_foreign"]), r["drift"]) for r in got}
    assert len(have) == len(got) and have == plain(*data, schemes)
    assert {"perfect", "other_language", "wrong_version", "wrong_verse", "no_attempt", "fabricated"} <= {x[0] for x in have.values()} and any(x[5] for x in have.values())
    assert all(sum(r["edit_ops"].values()) >= 0 and (r["edit_ops"] == {"insert": 0, "delete": 0, "replace": 0}) == r["verbatim_loose"] for r in got)


def test_a_batch_of_answers_is_aligned_together(monkeypatch):
    """None of the alignments that grades rest on is done by itself, and the rows are those of single answers."""
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "in", "the"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(say(r.randint(1, 30)), say(r.randint(1, 12)), {"edition": [{"key": "2", "text": say(8)}], "neighbour": [{"key": str(k), "text": say(5)} for k in range(3)]}) for _ in range(40)]
    want = [C.measured(*x) for x in rows]
    single = []
    plain = S.align
    monkeypatch.setattr(S, "align", lambda *x: single.append(x) or plain(*x))
    got = C._measured.func(*([x[k] for x in rows] for k in (0, 1)), *([x[2][k] for x in rows] for k in ("edition", "neighbour")))
    pd.testing.assert_frame_equal(got, pd.DataFrame(want, columns=got.columns))
    assert not single
