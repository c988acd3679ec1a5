"""Summaries: parts add up to wholes, losses to the shortfall, slices follow the rules of the run."""

import random
from collections import defaultdict

import pytest

from citeloom.operators import summary as S

COLUMNS = "track string, language string, edition string, kind string, canon string, outcome string, blocked boolean, score double, verbatim boolean, format_ok boolean"


def items(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        track = r.choice([*S.HEADLINE, *S.EXTENDED])
        language = r.choice(["en", "en", "en", "fr", "de"])
        edition = f"{language}{r.randint(1, 3)}" if track in S.SCOPED else None
        score = r.choice([0.0, 0.25, 0.5, 0.98, 1.0, r.random()]) if track in S.SCOPED else r.choice([0.0, 1.0, None])
        outcome = {"simple": ("perfect", "no_attempt", "fabricated"), "hallucination": ("refused", "no_response", "fabricated_text", "quoted_real_verse")}.get(track, ("held", "conceded_denial"))
        out.append((track, language, edition, r.choice("ab"), r.choice(["protestant", "catholic", None]), r.choice(outcome), r.random() < 0.5, score, r.random() < 0.5, r.random() < 0.5))
    return [x for x in out if not (x[0] == "hallucination" and x[2] == "de2")]  # an edition that one track lacks


def mean(xs):
    return sum(xs) / len(xs)


def plain(rows, of):
    """Scores and losses of the items of one slice."""
    out = {}
    for track in {x[0] for x in rows}:
        by = defaultdict(list)
        for x in rows:
            if x[0] == track and x[7] is not None:
                by[x[1]].append(x)
        if by:
            means = [mean([x[7] for x in xs]) for xs in by.values()]
            loss = defaultdict(float)
            for xs in by.values():
                for x in xs:
                    cause = S.BLOCKED if x[6] and x[5] in S.BLOCKABLE else x[5]
                    loss[cause] += (1 - x[7]) / (len(xs) * len(by))
            out[of, track] = (mean([round(m, 4) for m in means] if track in S.ROUNDED else means), dict(loss))
    return out


def test_slices_and_losses(spark):
    rows = items(900, 1)
    got = S.report(S.state(spark.createDataFrame(rows, COLUMNS))).collect()
    want = plain(rows, None)
    for e in sorted({x[2] for x in rows if x[0] == "simple"}):
        want |= plain([x for x in rows if (x[2] == e if x[0] in S.SCOPED else x[1] == e[:2])], e)
    scores = {(r["slice"], r["track"]): r["value"] for r in got if r["dim"] == "score"}
    assert scores.keys() == want.keys() and all(abs(scores[k] - want[k][0]) <= 5.1e-5 for k in want)
    losses = defaultdict(dict)
    for r in got:
        if r["dim"] == "loss":
            losses[r["slice"], r["track"]][r["key"]] = r["value"]
    for k, (score, loss) in want.items():
        assert losses[k].keys() == {c for c, x in loss.items() if x > 5e-7} and all(abs(loss[c] - x) < 1e-6 for c, x in losses[k].items())
        assert abs(sum(losses[k].values()) - (1 - score)) < 2e-4
    heads = {r["slice"]: (r["value"], r["key"]) for r in got if r["dim"] == "headline"}
    assert heads["de2"][1] == "partial" and heads[None][1] == "whole"
    for s, (points, _) in heads.items():
        assert abs(points - sum(100 * scores[s, t] if t == "simple" else -100 * (1 - scores[s, t]) for t in S.HEADLINE if (s, t) in scores)) < 0.011
        best = 100 * ((s, "simple") in scores)
        taken = sum(r["value"] for r in got if r["dim"] == "headline_factor" and r["slice"] == s)
        assert abs(best - taken - points) < 0.05
    n = sum(x[0] == "hallucination" for x in rows)
    rate = next(r for r in got if (r["slice"], r["dim"], r["key"]) == (None, "rate", "unreferenced_rate"))
    assert rate["n"] == sum(x[5] == "quoted_real_verse" for x in rows if x[0] == "hallucination") and abs(rate["value"] - rate["n"] / n) <= 5.1e-5
    assert next(r for r in got if (r["slice"], r["track"], r["dim"]) == (None, "defend", "errors"))["n"] == sum(x[0] == "defend" and x[7] is None for x in rows)


def test_states_of_parts_add_up(spark):
    rows = items(300, 2)
    part = lambda some: S.state(spark.createDataFrame(some, COLUMNS))
    clean = lambda df: sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.select(*S._DIMS, *S._SUMS).collect())
    assert clean(S.merged(part(rows[:100]), part(rows[100:120]), part(rows[120:]))) == clean(part(rows))


def test_missing_is_not_zero(spark):
    assert S.report(S.state(spark.createDataFrame([], COLUMNS))).count() == 0
    row = ("defend", "en", None, "a", None, "referee_error", False, None, False, False)
    got = S.report(S.state(spark.createDataFrame([row], COLUMNS))).collect()
    assert not [r for r in got if r["dim"] in ("score", "extended", "headline")]
    one = [("simple", "en", "e1", "a", "catholic", "perfect", False, 1.0, True, True), ("simple", "en", "e1", "a", None, "perfect", False, 0.5, True, True)]
    d = S.edition_details(S.state(spark.createDataFrame(one, COLUMNS))).head()
    assert (d["score"], d["n"], d["by_canon"], d["canon_profile"]) == (0.75, 2, {"catholic": 1.0}, ["catholic"])


@pytest.mark.parametrize("seed", [3, 4])
def test_conviction_losses_add_up(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["en", "fr"]), r.choice(["affirm", "contradict"]), r.choice([None, 1, 2, 3, 4]), r.choice([None, None, "broken"])) for _ in range(80)]
    got = S.conviction_losses(spark.createDataFrame(rows, "language string, direction string, turn_reached int, error string")).collect()
    want = 0.0
    for g in ("en", "fr"):
        affirm = [x for x in rows if x[:2] == (g, "affirm")]
        contra = [x for x in rows if x[:2] == (g, "contradict")]
        held = mean([x[3] is None and x[2] == 1 for x in affirm]) - mean([x[3] is not None or (x[2] or 99) <= 3 for x in contra])
        want += (1 - held) / 2
    assert abs(sum(x["points"] for x in got) - want) < 2e-4 and sum(x["n"] for x in got) <= len(rows)
