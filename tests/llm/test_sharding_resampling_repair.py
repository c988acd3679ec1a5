"""Sharding, importance resampling and conversation repair against plain versions, and on odd rows."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import pytest

from citeloom.llm import conversations as C
from citeloom.llm import resampling as R
from citeloom.llm import sharding as S

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, lang string, score double, `rank` int, point string, bucket int"
LONG = "word " * 60_000 + "x" * 100_000


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " \n\t ", LONG, "a b c", "a b c", "The quick brown fox jumps over the lazy dog\nand so on and on and we go and go and go", "é" * 50, "\x00\x01 odd   signs 😀"]
    rows = [(i, t, None if i % 3 == 0 else f"s{i % 2}", "en", 0.5, 1, "k", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, "a b c", "s1", None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- sharding -----------------------------------------------------------------------------------------


def plain_shards(rows, shards):
    """The tree by sorting: rows of (doc_id, text, source, lang); returns the shard of each row."""
    crc = lambda x: zlib.crc32("" if x is None else str(x).encode())
    size = [len((t or "").encode()) + 8 for _, t, _, _ in rows]
    hashed = [int(hashlib.md5((t or "").encode()).hexdigest()[:12], 16) >> 2 for _, t, _, _ in rows]
    most_bytes, most_rows = (max(1, -(-x // (shards * S.SHARE))) for x in (sum(size), len(rows)))
    own = collections.defaultdict(list)
    for i, h in enumerate(hashed):
        own[h].append(i)
    at, points = [0] * len(rows), {}
    for h, ids in own.items():
        parts = max(-(-sum(size[i] for i in ids) // most_bytes), -(-len(ids) // most_rows))
        one = (size[ids[0]], min(crc(rows[i][2]) for i in ids), min(crc(rows[i][3]) for i in ids))
        for i in ids:
            at[i] = h * 16384 + (crc(rows[i][0]) % parts if parts > 1 else 0)
            points.setdefault(at[i], [0, one])[0] += size[i]
    box = [max(x[k] for _, x in points.values()) - min(x[k] for _, x in points.values()) for k in range(3)]
    home = {}

    def cut(some, first, leaves):
        if leaves == 1:
            home.update(dict.fromkeys(some, first))
            return
        width = [(max(points[p][1][k] for p in some) - min(points[p][1][k] for p in some)) / box[k] if some and box[k] else 0.0 for k in range(3)]
        k = width.index(max(width))
        total, before, left = sum(points[p][0] for p in some), 0, set()
        for p in sorted(some, key=lambda p: (points[p][1][k], p)):
            w = points[p][0]
            if (2 * before + w) * leaves <= 2 * total * (leaves // 2):
                left.add(p)
            before += w
        cut([p for p in some if p in left], first, leaves // 2)
        cut([p for p in some if p not in left], first + leaves // 2, leaves - leaves // 2)

    cut(list(points), 0, shards)
    return [home[p] for p in at], size


@pytest.mark.parametrize("shards", [5, 24])
def test_shards_equal_the_sorted_tree(docs, shards):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source", "lang").collect()]
    want, size = plain_shards(rows, shards)
    got = {r["doc_id"]: r for r in S.shard(docs, shards).collect()}
    assert [got[r[0]]["shard"] for r in rows] == want
    assert all(got[r[0]]["size"] == n and got[r[0]]["text_crc32"] == zlib.crc32(r[1].encode()) for r, n in zip(rows, size, strict=True))
    slots = collections.defaultdict(list)
    for r in got.values():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_are_even_and_keep_copies_together(spark):
    r = random.Random(3)
    texts = ["copy of a text " * 4] * 3000 + [f"own {i} " * r.randint(1, 9) for i in range(4000)] + [f"few {i % 500}" for i in range(2000)]
    df = spark.createDataFrame([(i, t, "hot" if i < 3000 else f"s{r.randrange(9)}", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    got = S.shard(df).collect()
    weight, homes = collections.Counter(), collections.defaultdict(set)
    for x in got:
        weight[x["shard"]] += x["size"]
        homes[x["text_crc32"]].add(x["shard"])
    assert len(weight) == 24 and max(weight.values()) < 1.03 * min(weight.values())
    assert sum(len(x) > 1 for x in homes.values()) == 1  # the crowd only, which holds more than a shard


def test_shards_of_odd_rows(odd):
    got = S.shard_report(odd).collect()
    assert len(got) == odd.count() and {x["law"] for x in got} == {"bytes"} and {x["grown_shard"] for x in got} == {None}
    assert sum(x["size"] for x in got) == sum(len((x["text"] or "").encode()) + 8 for x in odd.collect())
    assert S.shard(odd.where("false")).count() == 0
    alone = S.shard(odd.where("doc_id = 3")).collect()
    assert len(alone) == 1 and alone[0]["slot"] == 0
    assert "PythonUDF" not in (plan := S.shard(odd)._jdf.queryExecution().toString()) and "MapIn" not in plan


# -- resampling ---------------------------------------------------------------------------------------


def plain_resample(rows, items, buckets=R.BUCKETS, longest=1, least=20, percent=10):
    def runs(text):
        w = re.findall(R.WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)

    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(map(bucket, runs(text)[0]))
    for text in items:
        t.update(map(bucket, runs(text)[0]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        f, n = runs(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    place = {id(x): k for k, x in enumerate(fit[: len(fit) * percent // 100], 1)}
    return [(*x[:4], place.get(id(x))) for x in out]


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (3, 97, 40)])
def test_resampling_equals_the_plain_version(spark, docs, odd, longest, buckets, percent):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [r["text"] for r in target.collect()]
    for df in (docs, odd):
        got = R.resample(df, target, buckets=buckets, longest=longest, percent=percent).collect()
        want = plain_resample([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], items, buckets, longest, percent=percent)
        assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_resampling_with_ties_and_without_rows(spark, odd):
    target = spark.createDataFrame([(None,), ("",)], "text string")
    same = spark.createDataFrame([(7, "one two " * 12)] * 30 + [(8, "one two " * 12)] * 10, "doc_id long, text string")
    got = R.resample(same, target).collect()
    assert collections.Counter(r["rank"] for r in got) == {None: 36, 1: 1, 2: 1, 3: 1, 4: 1} and len({r["doc_id"] for r in got if r["rank"]}) == 1
    assert R.resample(odd.where("false"), target).count() == 0
    assert {r["rank"] for r in R.resample(odd, target).collect()} == {None}


# -- repair of conversations --------------------------------------------------------------------------


def plain_repair(rows):
    """rows: conv_id, turn, role, text. A shortest way over (row, state) with the least audit."""
    moves = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    spaced = lambda v: " " if v is None else str(v)
    convs = {}
    for c, t, r, x in rows:
        kept, k = convs.setdefault(c, []), zlib.crc32(f"{spaced(c)}:{spaced(t)}".encode()) % 20
        r, x = spaced(r), spaced(x)
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        if k:
            kept += [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    out = {}
    for c, kept in convs.items():
        conv = "null" if c is None else f"={c}"
        kept.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), hashlib.md5(f"{conv}\0{len(z[1])}:{z[1]}{z[2]}".encode()).digest()))
        turns = [z[0] for z in kept if z[0] is not None]
        seen, faults = set(), []
        for _, r, x in kept:
            body = re.sub("[\x20\x09-\x0d]", "", x)
            faults.append("b" if not body else "d" if (r, x) in seen else "t" if body[-1] not in ".!?" else "")
            seen.add((r, x))
        signs = [z[1][:1] for z in kept]
        heap, done = [(0, "", 0, 0, ())], set()
        while True:
            cost, audit, i, q, lines = heapq.heappop(heap)
            if i == len(kept) and q in (0, 3):
                break
            if (i, q) in done:
                continue
            done.add((i, q))
            for s, role in (("u", "user:"), ("a", "assistant:")):
                if q in moves[s]:
                    heapq.heappush(heap, (cost + 3, audit + "I", i, moves[s][q], (*lines, role)))
            if i == len(kept):
                continue
            _, r, x = kept[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, lines))
            if faults[i] not in ("b", "d"):
                own = cost + 3 * (faults[i] == "t")
                if q in moves.get(r[:1], ()):
                    heapq.heappush(heap, (own, audit + "K", i + 1, moves[r[:1]][q], (*lines, f"{r}:{x}")))
                for s, role in (("u", "user:"), ("a", "assistant:")):
                    if q in moves[s]:
                        heapq.heappush(heap, (own + 3, audit + "R", i + 1, moves[s][q], (*lines, role + x)))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(signs, signs[1:], strict=False))
        out[c] = (gaps, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check_repair(df):
    got = {r[0]: tuple(r)[1:] for r in C.structure_report(df).collect()}
    assert got == plain_repair([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_conversations_equal_the_plain_version(spark):
    check_repair(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))


def test_odd_and_long_conversations(spark):
    r, rows = random.Random(1), []
    for c in [None, *range(60)]:
        for t in range(1500 if c == 7 else r.choice([0, 1, 2, 5, 9, 30])):
            for _ in range(r.choice([1, 1, 1, 2])):
                said = r.choice(["a.", "b", "", None, " ", "Hi there!\n", "x? ", "é　", "long." + "z" * 50 + "."])
                rows.append((c, r.choice([t, t, t, None, r.randrange(12)]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "superuser"]), said, "x", 1))
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", LONG + f" {t}.", "x", 1) for t in range(3)]
    rows += [(98, 4, "user", "the same.", "x", 1)] * 400
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string, seg int").repartition(5)
    check_repair(df)
    assert C.structure_report(df.where("false")).count() == 0


def test_conversations_that_lose_all_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 1, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in C.structure_report(df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_segments_compose_to_the_whole():
    """Cut anywhere, the folded costs and traces of a conversation's segments are those of one segment."""
    r = random.Random(5)
    for _ in range(300):
        codes = bytes(r.choice([0, 1, 2, 3, 4, 5, 6, 7, 9, 13]) for _ in range(r.randint(1, 25)))
        (whole, state, cost), *_ = C.audits(codes, C.CLOSED, [0])
        cuts = sorted({0, len(codes), *(r.randrange(len(codes)) for _ in range(3))})
        parts = [codes[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        remain = [C.CLOSED]
        for p in reversed(parts[1:]):
            remain.append(C.before(C.relation(p), remain[-1]))
        at, letters, spent = 0, "", 0
        for p, costs in zip(parts, reversed(remain), strict=True):
            audit, at, more = C.audits(p, costs, [at])[0]
            letters, spent = letters + audit, spent + more
        assert (letters, at, spent) == (whole, state, cost)
        assert C.before(C.relation(codes), C.CLOSED)[0] == cost + C.CLOSED[state]
