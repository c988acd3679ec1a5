"""Every corpus operator against a plain version, and on nulls, empty and very long texts, ties, repeats, no rows, clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from citeloom.llm import components as C
from citeloom.llm import contamination as D
from citeloom.llm import fingerprint as P
from citeloom.llm import html as H
from citeloom.llm import langmodel as LM
from citeloom.llm import lines as L
from citeloom.llm import mixing as X
from citeloom.llm import near as N
from citeloom.llm import quality as Q
from citeloom.llm import tokens as T
from citeloom.llm import warc as W

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, items string, spans int, score double, `key` string, bucket int"
LONG = "word " * 60_000 + "x" * 100_000


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long, repeated and tied rows, and columns named like ours."""
    texts = [None, "", " \n\t ", LONG, "a b c", "a b c", "The quick brown fox jumps over the lazy dog\nand so on and on we go", "é" * 50, "\x00\x01 odd   signs 😀"]
    rows = [(i, t, None if i % 3 == 0 else f"s{i % 2}", "i", 1, 0.5, "k", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, "a b c", "s1", None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


VOCAB = public_tokenizers.path("piece_bpe_32k.model")


def test_tokens_equal_the_library(spark, docs, odd, none, texts):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=VOCAB)
    got = {r["doc_id"]: r for r in T.count_tokens(docs, VOCAB).collect()}
    assert all(got[i]["n_tokens"] == len(m.encode(t)) and got[i]["n_bytes"] == len(t.encode()) for i, t in texts.items())
    for r in T.count_tokens(odd, VOCAB, limit=2).collect():
        t = {x["doc_id"]: x["text"] for x in odd.collect()}[r["doc_id"]] or ""
        assert r["n_tokens"] == len(m.encode(t)) and r["over_limit"] == (r["n_tokens"] > 2)
    assert T.count_tokens(none, VOCAB).count() == 0


def test_chunks_compose():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=VOCAB)
    t, r = T.transducer(VOCAB), random.Random(2)
    for _ in range(800):
        s = "".join(r.choice("   ▁abteh.\n\tñé😀\x00<s>0xA") for _ in range(r.randint(0, 40)))
        assert {t.count(s), t.count(s, chunk=3), t.count(s, chunk=7)} == {len(m.encode(s))}


def test_fingerprints(spark, docs, odd, none, texts):
    got = {r["doc_id"]: r for r in P.fingerprints(docs).collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        t, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        n = len(t) // 3
        new = t[: len(t) - n] + following[:n]
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["near_next"] == P.likeness(got[i]["fingerprint"], got[ids[(k + 1) % len(ids)]]["fingerprint"])
    by = collections.defaultdict(set)
    for i, t in texts.items():
        by[t].add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in by.values())
    near, nxt = [r["near_edited"] for r in got.values()], [r["near_next"] for r in got.values()]
    assert np.mean(near) > 0.25 > 0.05 > np.mean(nxt)
    assert P.fingerprints(odd).count() == odd.count() and P.fingerprints(none).count() == 0
    one = P.fingerprints(odd.where("doc_id = 6")).head()
    assert one["near_next"] == 1.0
    assert {r["doc_id"]: r["n_chars"] for r in P.fingerprints(odd).collect()}[0] == 0


def test_fingerprint_lexicon_is_the_band(spark, docs, texts):
    df = collections.Counter(w for t in texts.values() for w in set(t.encode().lower().split()))
    n = len(texts)
    assert P.lexicon(docs, 0.02, 0.1) == sorted(w for w, c in df.items() if 0.02 * n <= c <= 0.1 * n)


def test_fingerprints_equal_a_plain_version(spark, docs, texts):
    """Each subset by itself, term by term, from the lexicon counted in memory."""
    df = collections.Counter(w for t in texts.values() for w in terms_set(t))
    words = sorted(w for w, c in df.items() if P.LOW * len(texts) <= c <= P.HIGH * len(texts))
    f = P.Fingerprinter(words)
    got = {r["doc_id"]: r["fingerprint"] for r in P.fingerprints(docs).collect()}

    def part(terms):
        import xxhash

        hashes = [xxhash.xxh3_64_intdigest(w) for w in terms]
        deep = f._depth(np.array(hashes, np.uint64))
        first, full = max(0, min(P.MAX_LEVEL, len(hashes).bit_length()) - 1), (1 << 64) - 1
        out = [f"{first:02d}"]
        for level in range(first, first + 3):
            row = ""
            for k in range(P.SUBSETS):
                total, rank = 0, 0
                for h, d in zip(hashes, deep[:, k], strict=True):
                    if d >= level:
                        rank += 1
                        place = (rank * 0x9E3779B97F4A7C15 & full ^ rank << 17) | 1
                        total += ((h ^ h >> 29) * 0xD6E8FEB86659FD93 & full) * place
                total &= full
                row += f"{((total ^ total >> 32) * 0x9E3779B97F4A7C15 & full) >> 32:08x}" if rank else P.EMPTY
            out.append(row)
        return out

    for i in list(texts)[:60]:
        terms = sorted(terms_set(texts[i]))
        known = [w for w in terms if w in f.words]
        want = part(known) if known else ["00"]
        if len(known) < P.FEW:
            want += ["+", *part(terms or [b"\x00" + texts[i].encode()])]
        assert got[i] == ":".join(want)


def terms_set(text):
    return set(text.encode().lower().split())


def test_lexicon_by_join_and_by_broadcast_agree(docs, monkeypatch):
    want = P.lexicon(docs)
    monkeypatch.setattr(P, "SENT_TERMS", 0)
    monkeypatch.setattr(P, "PART_ROWS", 9)
    assert P.lexicon(docs.repartition(5)) == want


def test_buckets_do_not_change_neighbours(spark, docs, monkeypatch):
    want = {r["doc_id"]: r["edited_sha256"] for r in P.fingerprints(docs).collect()}
    monkeypatch.setattr(P, "BUCKET_ROWS", 7)
    assert want == {r["doc_id"]: r["edited_sha256"] for r in P.fingerprints(docs).collect()}


def test_mix_equals_sql(spark, docs, odd, none):
    for df in (docs, odd, none):
        documents = df.select("doc_id", "source", "text").toPandas().astype({"source": "object", "text": "object"})  # noqa: F841
        if len(documents):
            con = duckdb.connect()
            con.register("d0", documents)
            con.sql("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, source::VARCHAR AS source, text::VARCHAR AS text FROM d0")
            want = sorted(map(str, con.sql(X.MIX_SQL).fetchall()))
        else:
            want = []
        got = sorted(str(tuple(r)) for r in X.mixture_report(df).collect())
        assert got == want


def test_mix_meets_targets_and_shards_are_disjoint(spark, docs):
    m = X.mix(docs).cache()
    per = m.groupBy("source").agg(F.first("target").alias("t"), F.first("source_size").alias("s"), F.sum(F.col("size") * F.size("copies")).alias("k"), F.max("size").alias("big")).collect()
    assert all(abs(r["t"] - r["k"]) <= r["big"] / 2 and r["t"] <= 2 * r["s"] for r in per)
    assert sum(r["t"] for r in per) == pytest.approx(1.5 * sum(r["s"] for r in per))
    copies = m.select("doc_id", F.explode("copies").alias("c")).select("doc_id", "c.*")
    assert copies.count() == copies.select("doc_id", "copy").distinct().count()
    assert copies.groupBy("shard").count().count() == 16
    assert {tuple(r) for r in m.select("doc_id", F.size("copies")).collect()} == {tuple(r) for r in X.mix(docs.repartition(5)).select("doc_id", F.size("copies")).collect()}


def test_hypergeometric_draws(spark):
    df = spark.range(4000).select(X._hypergeometric(F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long"), X._uniform(F.col("id"), F.lit(1))).alias("x"))
    x = np.array([r[0] for r in df.collect()])
    assert x.min() >= 0 and x.max() <= 10 and abs(x.mean() - 4) < 0.1 and abs(x.var() - 10 * 0.4 * 0.6 * 40 / 49) < 0.15
    q = spark.createDataFrame([(1, 100), (2, 7), (3, 0)], "sid int, blocks long")
    ends = {r["sid"]: r["ends"] for r in X.split(q, 3).collect()}
    assert {k: v[-1] for k, v in ends.items()} == {1: 100, 2: 7, 3: 0} and all(v == sorted(v) and len(v) == 8 for v in ends.values())
    total = np.diff(np.array([[0, *v] for v in ends.values()]).sum(axis=0))
    assert set(total) <= {13, 14}


def test_lines_within_bounds():
    """Many pairs at once against the plain edit distance: few and many different signs, bounds from none to loose."""
    from citeloom.llm import lines as L

    rng = random.Random(5)
    for signs in ("ab", "abcdefgh \u00e9", "".join(chr(0x4E00 + i) for i in range(400)), "".join(chr(0x10000 + i) for i in range(70_000))):
        pairs = []
        while len(pairs) < 300:
            a = rng.choices(signs, k=rng.randint(1, 60))
            b = list(a)
            for _ in range(rng.randint(0, 14)):
                i = rng.randrange(len(b) + 1)
                b[i : i + rng.randint(0, 1)] = rng.choices(signs, k=rng.randint(0, 1))
            a, b = sorted(("".join(a), "".join(b)), key=len)
            most = rng.randint(0, 20)
            if a and most < len(b) <= len(a) + most:
                pairs.append((a, b, most))
        a, b, most = zip(*pairs)
        assert L._within(list(a), list(b), np.array(most)).tolist() == [L.distance(*x[:2]) <= x[2] for x in pairs]


def test_lines_distance():
    r = random.Random(5)
    for _ in range(300):
        a, b = ("".join(r.choice("ab ") for _ in range(r.randint(0, 30))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert L.distance(a, b) == row[-1]


def test_repeated_lines_stay_once(spark, docs, odd, none, texts):
    got = {r["doc_id"]: r for r in L.line_report(docs).collect()}
    left = collections.Counter()
    kept_lines, dropped_lines = set(), set()
    for i, t in texts.items():
        lines = t.split("\n")
        gone = set(got[i]["dropped"])
        assert got[i]["text"] == "\n".join(x for k, x in enumerate(lines) if k not in gone) and got[i]["n_lines"] == len(lines)
        for k, words in enumerate(L.normalised(t)):
            if len(words) >= L.MIN_WORDS:
                (dropped_lines if k in gone else kept_lines).add(b" ".join(words))
                left[b" ".join(words)] += k not in gone
            else:
                assert k not in gone
    assert max(left.values()) == 1  # equal lines stay once
    kept = [x.decode() for x in kept_lines]
    for line in dropped_lines - kept_lines:  # a fuzzy one has a like line, or a chain of them, that stays
        assert any(L.similar(line.decode(), x, 0.7) for x in kept)
    assert L.line_report(odd).count() == odd.count() and L.line_report(none).count() == 0
    back = {r["doc_id"]: r["text"] for r in L.line_report(odd).collect()}
    assert back[0] is None and back[1] == "" and back[6].startswith("The quick")


def test_fuzzy_lines_are_found_and_the_first_stays(spark):
    r = random.Random(11)
    words = [f"w{r.randrange(10**6)}" for _ in range(80)]
    rows = [(3, "short\n" + " ".join(words).upper() + "!"), (5, " ".join(words)), (7, "a line of its own that nothing else is like")]
    for i in range(20):
        changed = list(words)
        changed[r.randrange(80)] = "other"
        rows.append((10 + i, " ".join(changed)))
    got = {x["doc_id"]: x["dropped"] for x in L.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3] == [] and got[5] == [0] and got[7] == []
    assert sum(got[10 + i] == [0] for i in range(20)) >= 12  # of one word in eighty changed, most share a block


def test_lines_with_one_word_changed_are_found_at_every_length(spark):
    r = random.Random(5)
    known = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 10))) for _ in range(3000)]
    rows, of = [], {}
    for low_, high in ((5, 9), (10, 19), (20, 39), (40, 79), (80, 160)):
        n = 0
        while n < 40:
            words = [r.choice(known) for _ in range(r.randint(low_, high))]
            other = list(words)
            other[r.randrange(len(words))] = r.choice(known)
            if other != words and L.similar(" ".join(words), " ".join(other)):  # by the whole edit distance
                rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
                of[len(rows) - 1] = low_
                n += 1
    got = {x["doc_id"]: x["dropped"] for x in L.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = collections.Counter(low_ for i, low_ in of.items() if got[i] == [0])
    assert all(found[low_] >= 39 for low_ in (5, 10, 20, 40, 80)), found
    assert not any(got[i - 1] for i in of)


def test_lines_with_some_words_changed_are_found(spark):
    """Against all pairs: of lines of 5 to 100 words with up to 15 in 100 words changed, 9 in 10 are found."""
    r = random.Random(6)
    known = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 10))) for _ in range(3000)]
    rows, of = [], {}
    for size in (8, 15, 30, 60, 100):
        for share in (0.05, 0.1, 0.15):
            n = 0
            while n < 30:
                words = [r.choice(known) for _ in range(size)]
                other = list(words)
                for i in r.sample(range(size), max(1, int(share * size))):
                    other[i] = r.choice(known)
                if other != words and L.similar(" ".join(words), " ".join(other)):
                    rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
                    of[len(rows) - 1] = size, share
                    n += 1
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if L.similar(rows[a][1], rows[b][1])]
    assert {a for a, _ in pairs} == set(of)
    got = {x["doc_id"]: x["dropped"] for x in L.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = collections.Counter(x for i, x in of.items() if got[i] == [0])
    print(sorted(found.items()))
    assert all(found[x] >= 27 for x in set(of.values())), found
    assert {i for i, x in got.items() if x} <= {a for a, _ in pairs}


def test_short_lines_and_lines_without_spaces_stay_once(spark):
    rows = [(1, "Read more\n\na\n" + "\u6f22\u5b57\u4eee\u540d" * 12), (2, "read more!\n\nA\nb"), (3, "\u6f22\u5b57\u4eee\u540d" * 12 + "\nunlike\nread no more")]
    got = {x["doc_id"]: x["dropped"] for x in L.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0, 2], 3: [0]}


def test_lines_do_not_depend_on_tasks_bitmaps_and_hot_keys(spark, docs, monkeypatch):
    want = {r["doc_id"]: r["dropped"] for r in L.line_report(docs).collect()}
    docs = docs.repartition(7)
    monkeypatch.setattr(L, "WANTED_BITS", 1 << 15)
    monkeypatch.setattr(L, "HOT", 1.0)
    monkeypatch.setattr(L, "REMEMBERED", 3)
    monkeypatch.setattr(C, "ONE_TASK", 0)
    assert want == {r["doc_id"]: r["dropped"] for r in L.line_report(docs).collect()}


def test_components_in_rounds_and_in_one_task(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {tuple(x) for x in C.components(df).collect()}
    many = {tuple(x) for x in C.components(df, one_task=0).collect()}
    assert {x for x in one if x != (5, 5)} | {x for x in many if x[0] == 5} >= many and all(c == 400 for i, c in many if 400 <= i <= 460)
    assert C.components(df.where("false")).count() == 0


def brute_near(texts):
    sets = {}
    for i, t in texts.items():
        w = space_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = root(ids[x]), root(ids[y])
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark, docs, odd, none, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs).collect()}
    assert got == brute_near(texts)
    assert N.near_duplicates(none).count() == 0
    o = [tuple(r) for r in N.near_duplicates(odd).collect()]
    assert len(o) == odd.count() and (0, 0, 0, True) in o and (5, 1, 4, False) in o and (None, 1, None, True) in o and o.count((4, 1, 4, True)) == 2


def test_a_chain_of_near_copies_is_one_group(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows, text = [], words[:200]
    for i in range(60):  # each differs from the one before by a word, the ends have nothing in common
        rows.append((i, " ".join(text)))
        text = text[3:] + words[200 + 3 * i : 203 + 3 * i]
    rows += [(100 + i, " ".join(r.choice(words) for _ in range(50))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in N.near_duplicates(df).collect()}
    assert got == brute_near(dict(rows))


def brute_windows(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    out = {}
    for i, t in texts.items():
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= x
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def test_decontamination_equals_brute_force(spark, docs, odd, none, texts, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = [tuple(r) for r in items.collect()]
    got = {r["doc_id"]: tuple(r)[1:5] for r in D.report(docs, items).collect()}
    assert got == brute_windows(texts, plain) and any(v[1] for v in got.values())
    r = random.Random(3)
    small = {i: " ".join(r.choice("abc") for _ in range(r.randint(0, 40))) for i in range(60)}
    short = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 14)))) for i in range(12)] + [(3, "a b"), (77, None)]
    df = spark.createDataFrame(list(small.items()), "doc_id long, text string")
    bench = spark.createDataFrame(short, "item_id long, text string")
    want = brute_windows(small, short)
    assert {x["doc_id"]: tuple(x)[1:5] for x in D.report(df, bench).collect()} == want
    parts = D.match(df, bench, part_words=20).collect()  # several automata, in one pass and in several
    assert {x["doc_id"]: len(x["__items"]) for x in parts} == {k: v[2] for k, v in want.items()}
    monkeypatch.setattr(D, "PASS_PARTS", 2)
    passes = D.match(df, bench, part_words=20).collect()
    assert {x["doc_id"]: (x["__spans"], x["__items"]) for x in passes} == {x["doc_id"]: (x["__spans"], x["__items"]) for x in parts}
    assert D.report(odd, items).count() == odd.count() and D.report(none, items).count() == 0
    assert D.report(docs, items.where("false")).where("contaminated").count() == 0
    clean = D.decontaminate(docs, items)
    assert clean.columns == docs.columns and D.report(clean, items).where("contaminated").count() == 0
    same = {x["doc_id"]: x["text"] for x in D.decontaminate(odd, items).collect()}
    assert same[0] is None and same[3] == LONG and len(D.decontaminate(odd, items).columns) == len(odd.columns)


def test_language_model_counts_and_gains(spark, docs, odd, none, texts):
    got = {r["doc_id"]: r for r in LM.score(docs).collect()}
    train = collections.Counter()
    tokens = lambda t: [*space_words(t), "</end>"]
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    for i, t in texts.items():
        w = tokens(t)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(train[x] > 0 for x in w), n)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["spelled_score"] < r["score"] for r in got.values() if r["n_known"] < r["n_tokens"])
    o = {r["doc_id"]: r for r in LM.score(odd).collect()}
    assert all(math.isfinite(r["spelled_score"]) for r in o.values())
    assert o[0]["n_tokens"] == 1 and all(math.isfinite(r["score"]) for r in o.values()) and LM.score(odd).count() == odd.count()
    assert LM.score(none).count() == 0


def test_seating_predicts_a_distribution():
    r = np.random.default_rng(0)
    c = r.poisson(0.7, (6, 40)) * r.integers(0, 60, (6, 40))
    c[5] = 0
    s = LM.Seating(c)
    for _ in range(4):
        s.sweep()
        assert (s.t <= s.n).all() and (s.t >= 1).all() and (s.top <= np.maximum(s.below, 0)).all()
        assert s.predict().sum(axis=1) == pytest.approx(np.ones(6)) and (s.predict() > 0).all()


def test_seating_follows_its_law():
    s = LM.Seating(np.array([[1, 0], [0, 0]]))
    three = np.bincount(s._tables(np.full(50_000, 3), np.full(50_000, 0.1), 0.5).astype(int)) / 50_000
    assert three[1:] == pytest.approx(np.array([0.075, 0.015, 0.001]) / 0.091, abs=0.01)  # S(3, t) w ** t by hand
    for n, w, d in ((30, 0.5, 0.8), (64, 3.0, 0.6)):
        t = np.arange(1, n + 1)
        law = LM.log_stirling(n, d)[n, 1:] + t * np.log(w)
        law = np.exp(law - law.max())
        assert s._tables(np.full(20_000, n), np.full(20_000, w), d).mean() == pytest.approx((law * t).sum() / law.sum(), rel=0.03)
    for n, w, d in ((100, 0.5, 0.8), (400, 2.0, 0.5), (1000, 30.0, 0.7), (1500, 300.0, 0.5)):  # in blocks: near it
        t = np.arange(1, n + 1)
        law = LM.log_stirling(n, d)[n, 1:] + t * np.log(w)
        law = np.exp(law - law.max())
        assert s._crowds(np.full(2000, n), np.full(2000, w), d).mean() == pytest.approx((law * t).sum() / law.sum(), rel=0.25)


def test_spelling_is_a_distribution_over_words():
    words = [b"abc", b"abd", b"x", b"bca", "café".encode()] * 20
    at = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(int)
    pairs = np.bincount(at[:-1] * 256 + at[1:], minlength=65_536).reshape(256, 256).astype(float)
    model = LM.Spelling(pairs)
    mass = model.classes()
    assert mass.sum() == pytest.approx(1)
    assert model.others([b"abc", LM.END]).sum() == pytest.approx(1 - 10 ** model.logs([b"abc"])[0])
    # words drawn from the chain fall into the classes as often as their mass says
    rng, seen = np.random.default_rng(0), collections.Counter()
    for _ in range(20_000):
        word, x = bytearray(), LM.GAP
        while (x := int(rng.choice(256, p=model.chain[x]))) != LM.GAP:
            word.append(x)
        seen[LM.spelling_class(bytes(word))] += 1
    top = np.argsort(-mass)[:20]
    assert np.array([seen[c] for c in top]) / 20_000 == pytest.approx(mass[top], abs=0.015)


def test_all_words_of_a_class_add_up_to_one(spark, docs, texts):
    """Seen words by the model's own formula, and unseen ones by what the spelling model leaves."""
    model, counts = LM.train(docs)
    seen = {bytes(r["word"]): r["n"] for r in counts.collect()}
    by = collections.defaultdict(list)
    for w in seen.keys() - set(model.lexicon.dishes):
        by[LM.spelling_class(w)].append(w)
    free = model.spelling.others(model.lexicon.dishes)
    for c, words in list(by.items())[:50]:
        f = 10 ** model.fresh(words, np.full(len(words), c))
        n = np.array([seen[w] for w in words])
        unseen = 10 ** model.room[c] * (1 - (10 ** model.spelling.logs(words)).sum() / free[c])
        assert ((n - model.discount).sum() + 10 ** model.room[c]) / 10 ** model.norm[c] == pytest.approx(1)
        assert ((n - model.discount + f).sum() + unseen) / 10 ** model.norm[c] == pytest.approx(1)


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, None, "same"), (2, "http://a/2", None), (4, "u\r\nx", ""), (7, "http://a/7", "é" * 400_000), (8, "h", "one"), (8, "h", "two"), (9, "h", "two")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("to", F.lit(2))
    folder = f"file://{tmp_path}/warc"
    index = W.write_archives(pages, folder, frame_bytes=1000)
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], bytes(r["payload"])) for r in W.read_records(index, folder).collect())
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        to = max(x for x, _, g in rows if (g or "") == (h or ""))
        want.append((i, "response" if to == i else "revisit", None if to == i else to, len(p), W.digest_of(p), p if to == i else b""))
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2] or 0, x[3], x[4]))
    assert {r["record_type"] for r in W.read_records(W.write_archives(pages, folder + "2", min_bytes=10), folder + "2").collect()} == {"response"}
    assert W.archive_report(pages.where("false")).count() == 0
    import zstandard

    data = next((tmp_path / "warc").glob("*.zst")).read_bytes()
    assert b"WARC/1.1" in zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()


PAGE = (
    "<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header>Site</header><nav><a href=/>Home</a></nav>"
    "<div class='cookie-notice'>We use cookies</div><article><h1>Head {i}</h1><p>First &amp; only {i}<br>line {i}<p>Second <b>bo</b>ld {i}</p><p>Share this</p></article>"
    "<aside>Side</aside><div id=comments><p>Nice {i}</p></div><form>Name<input></form><footer>&copy; 2024</footer></body></html>"
)


def test_main_text(spark, none):
    rows = [(i, f"http://Host.example/{i}", PAGE.format(i=i)) for i in range(8)] + [(50, "http://other/x", PAGE.format(i=50)), (51, None, None), (52, "http://other/y", "<p>plain <a href=x>link</a> text here</p><ul><li><a href=x>Menu one</a></li></ul>")]
    got = {r["page_id"]: r for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "Head 3 First & only 3 line 3 Second bold 3"  # what all pages share is template
    assert got[50]["text"] == "Head 50 First & only 50 line 50 Second bold 50 Share this"  # one page alone shows none
    assert got[51]["text"] == "" and got[51]["n_chars"] == 0 and got[52]["text"] == "plain link text here"
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _texts(spark, pages):
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_equal_pages_and_repeated_rows_are_no_template(spark):
    one = "<html><body><nav>Menu</nav><article><h1>A title</h1><p>The only text of it.</p></article></body></html>"
    assert set(_texts(spark, [one] * 6).values()) == {"A title The only text of it."}
    bare = "<html><body><div>Top line</div><p>Own words {i}</p><div>Last line</div></body></html>"
    twice = [bare.format(i=i) for i in (0, 0, 1, 1, 2, 2)]  # three contents are too few, however often they come
    assert _texts(spark, twice)[4] == "Top line Own words 2 Last line"


def test_near_copies_keep_their_article(spark):
    page = "<html><body><nav>Menu</nav><article><p>A standing first paragraph of the series.</p><p>Day {i}</p></article><footer>End</footer></body></html>"
    got = _texts(spark, [page.format(i=i) for i in range(9)])
    assert got == {i: f"A standing first paragraph of the series. Day {i}" for i in range(9)}


def test_template_decides_without_an_article(spark):
    page = "<html><body><div>The daily example</div><div><h1>Head {i}</h1><p>Text of page {i}.</p></div><p>All rights reserved</p></body></html>"
    pages = [page.format(i=i) for i in range(8)]
    assert _texts(spark, pages)[5] == "Head 5 Text of page 5." != H.main_text(pages[5])


def test_markup_that_swallows_nothing():
    assert H.main_text("<p title=it's>Hello world</p><p>I don't know</p><p>End</p>") == "Hello world I don't know End"
    assert H.main_text("<p title='a > b' data-x=1'2>One</p><p lang = \"en\">Two</p>") == "One Two"
    kept = "<article><p class='related'>A</p><div class='header-image'>B</div><div class=search-result>C</div>"
    assert H.main_text(kept + "<div class='related'>D</div><p class=ad>E</p><div id=comments>F</div><div class='site-footer'>G</div></article>") == "A B C"
    assert H.main_text("<div>" * 20_000 + "deep" + "</b>" * 20_000) == "deep"


def test_main_text_of_all_pages(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert got[r["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", article)).split())


def test_quality_by_held_out_accuracy(spark, odd, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = Q.quality_report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    noted = labels.unionByName(spark.createDataFrame([(None, 1, 0), (0, None, 0), (10**9, 1, 1)], labels.schema))
    assert Q.quality_report(odd, noted).count() == odd.count() and Q.quality_report(none, labels).count() == 0
    assert {r["score"] for r in Q.quality_report(odd, labels.where("false")).collect()} == {0.5}
    assert Q.good_documents(odd, labels.where("false")).columns == odd.columns


def test_factorisation_identity():
    m = Q.FactorisationMachine()
    m.v = np.random.default_rng(1).normal(0, 1, m.v.shape)
    at, x = np.array([1, 5, 9, 65000]), np.array([0.5, 1.0, -2.0, 0.3])
    pairs = sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    one = m.bias + m.w[at] @ x + pairs
    assert m.raw(np.tile(at, 2), np.tile(x, 2), np.array([0, 4])) == pytest.approx([one, one])


def test_similar_equals_the_plain_rule():
    r = random.Random(9)
    for _ in range(2000):
        a = "".join(r.choice("ab ") for _ in range(r.randint(0, 24)))
        b = list(a)
        for _ in range(r.randint(0, 6)):
            b[r.randrange(len(b) + 1) : r.randrange(len(b) + 1)] = r.choice("ab ")
        b = "".join(b)
        assert L.similar(a, b, 0.75) == (a == b or L.distance(a, b) <= int(0.25 * max(len(a), len(b))))


def test_states_stay_while_a_long_text_is_counted():
    r = random.Random(2)
    vocabulary = T.Vocabulary(VOCAB)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(900)]
    text = " ".join(words)
    want = T.Transducer(vocabulary).count(text)
    assert T.Transducer(vocabulary, max_states=50, max_units=10).count(text, chunk=200) == want


def test_captions_in_the_article_stay():
    page = "<html><body><nav>Menu here</nav><article><p>The text of the article.</p><figure><img src='x'><figcaption>What the picture shows.</figcaption></figure></article></body></html>"
    assert "What the picture shows." in H.main_text(page) and "Menu" not in H.main_text(page)


def test_automaton_takes_long_runs_of_one_word():
    words = [b"a"] * 30_000
    a = D.SuffixAutomaton([("1", words[:2000]), ("2", [b"a", b"b"]), ("3", [b"a"])], 10)
    spans, found = a.scan([*words, b"b"])
    assert spans == [(0, 30_001)] and found == {"1", "2", "3"}
