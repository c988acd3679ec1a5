"""Document fingerprints after I-Match: terms of a middle band of inverse document frequency, sorted,
hashed under many random subsets of the lexicon.

The lexicon holds the terms whose share of all documents lies in [LOW, HIGH], that is whose inverse
document frequency lies in [ln 1/HIGH, ln 1/LOW]. At most (mean distinct terms of a document) / LOW
terms can be so frequent, whatever the size of the corpus; that bounds what is broadcast.

Terms are counted in two passes: a term of the band has the share LOW of at least one part of the corpus, so
the first pass names, part by part, the terms that may be in it, and the second counts just these. So rare
terms, which are most, are never shuffled. The second pass knows its terms by a broadcast whose size is
checked; where it would be too large they meet the counts in a join.

A single hash of all terms changes with any of them. Each of SUBSETS random subsets keeps a term with
probability 2^-level, and its sorted distinct terms are hashed in their order: an edit leaves the hashes of
those subsets that hold none of the terms it touches. The level follows the number of terms, so that a subset
meets about half a term; hashes of the levels on either side are kept too, as that of an edited text may differ.

A text with fewer than FEW lexicon terms has a second part, the same of all its terms (of the text itself, if it
has none). Two texts are compared by their second parts if both have one, else by their lexicon terms: by one
basis for any two texts.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import arrow_map, binary_of, settle, spread

LOW, HIGH = 1 / 2000, 1 / 20
SUBSETS = 32
MAX_LEVEL = 20
#: Texts with fewer lexicon terms are fingerprinted by all their terms as well.
FEW = 8
DIGITS = 8
EMPTY = "." * DIGITS
#: Terms that may be of the band are sent to all tasks up to this number.
SENT_TERMS = 2_000_000


def terms_of(text: str) -> set[bytes]:
    return set(text.encode().lower().split())


#: Documents of a part of the corpus in which terms are counted, at least; the last part of a task may be smaller.
PART_ROWS = 20_000


def _possible(low: float):
    """Terms that have at least the share `low` of some part of a task's rows."""

    def run(batches):
        held: Counter = Counter()
        rows = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w for w, n in held.items() if n >= low * rows], pa.binary())], names=["term"])

        for b in batches:
            for text in binary_of(b["text"]):
                held.update(set(text.lower().split()))
                rows += 1
            if rows >= PART_ROWS or len(held) > 600_000:
                yield out()
                held.clear()
                rows = 0
        yield out()

    return run


def _counts(known):
    """Documents that hold each term, of the known terms if there are any given."""

    def run(batches):
        only = None if known is None else known.value
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

        for b in batches:
            for text in binary_of(b["text"]):
                terms = set(text.lower().split())
                held.update(terms if only is None else terms & only)
                if len(held) > 400_000:
                    yield out()
                    held.clear()
        yield out()

    return run


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> list[bytes]:
    """The terms of the band, sorted; document frequencies cover all rows of docs."""
    n = docs.count()
    texts = spread(docs.select("text"))
    possible = settle(arrow_map(texts, _possible(low), "term binary").distinct(), "possible")
    few = possible.limit(SENT_TERMS + 1).count() <= SENT_TERMS
    sent = docs.sparkSession.sparkContext.broadcast({bytes(r[0]) for r in possible.toLocalIterator()}) if few else None
    counts = arrow_map(texts, _counts(sent), "term binary, n long")
    if not few:
        counts = counts.join(possible, "term", "left_semi")
    counts = counts.groupBy("term").agg(F.sum("n").alias("n"))
    return sorted(bytes(r[0]) for r in counts.where((F.col("n") >= low * n) & (F.col("n") <= high * n)).select("term").toLocalIterator())


class Fingerprinter:
    """Fingerprints against a lexicon; the subsets are fixed by the seed."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        self._at: dict[bytes, int] | None = None

    def _depth(self, hashes: np.ndarray) -> np.ndarray:
        """For each term and subset the highest level at which the subset still keeps the term."""
        mult = np.random.default_rng(77).integers(0, 1 << 63, SUBSETS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        with np.errstate(over="ignore"):
            x = hashes[:, None] * mult[None, :]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9E3779B97F4A7C15)
        x >>= np.uint64(64 - MAX_LEVEL)
        bits = np.frexp(x.astype(np.float64))[1]  # of the top MAX_LEVEL bits, how many are in use
        return (MAX_LEVEL - bits).astype(np.uint8)

    def _open(self) -> None:
        import xxhash

        self._at = {w: i for i, w in enumerate(self.words)}
        self._hash = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], np.uint64)
        self._deep = self._depth(self._hash)

    def _part(self, hashes: np.ndarray, deep: np.ndarray) -> list[str]:
        """The first level, then three levels of SUBSETS hashes, of DIGITS hex digits or EMPTY where no term was kept.

        hashes are of distinct terms in sorted order. A subset's hash is a polynomial over those it keeps, in that
        order: each is multiplied by a number of its place among them.
        """
        first = max(0, min(MAX_LEVEL, len(hashes).bit_length()) - 1)
        out = [f"{first:02d}"]
        with np.errstate(over="ignore"):
            mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
            for at in range(first, first + 3):
                kept = deep >= at
                rank = np.cumsum(kept, axis=0, dtype=np.uint64)
                place = (rank * np.uint64(0x9E3779B97F4A7C15) ^ (rank << np.uint64(17))) | np.uint64(1)
                total = np.where(kept, mixed[:, None] * place, np.uint64(0)).sum(axis=0, dtype=np.uint64)
                short = ((total ^ (total >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 4 * DIGITS)).tolist()
                out.append("".join([f"{x:0{DIGITS}x}" if k else EMPTY for x, k in zip(short, kept.any(axis=0).tolist(), strict=True)]))
        return out

    def fingerprint(self, text: str) -> str:
        """The part of the lexicon terms and, if these are fewer than FEW, that of all terms; equal texts, equal parts."""
        import xxhash

        if self._at is None:
            self._open()
        terms = terms_of(text)
        known = sorted(i for i in map(self._at.get, terms) if i is not None)
        out = self._part(self._hash[known], self._deep[known]) if known else ["00"]
        if len(known) < FEW:
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in sorted(terms) or [b"\x00" + text.encode()]], np.uint64)
            out += ["+", *self._part(hashes, self._depth(hashes))]
        return ":".join(out)


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among the subsets that hold a term of either text, at the levels both have."""
    if a == b:
        return 1.0
    x, _, all_x = a.partition(":+:")
    y, _, all_y = b.partition(":+:")
    if all_x and all_y:
        x, y = all_x, all_y
    x, y = x.split(":"), y.split(":")
    p = {int(x[0]) + i: h for i, h in enumerate(x[1:])}
    q = {int(y[0]) + i: h for i, h in enumerate(y[1:])}
    same = both = 0
    for level in p.keys() & q.keys():
        u, v = p[level], q[level]
        for i in range(0, DIGITS * SUBSETS, DIGITS):
            s, t = u[i : i + DIGITS], v[i : i + DIGITS]
            if s != EMPTY or t != EMPTY:
                both += 1
                same += s == t
    return same / both if both else 0.0


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


#: Rows of a bucket of neighbouring ids in which documents meet the next one, and most buckets: their bounds are
#: held on the driver. A bucket is read in a stream, so one of more rows takes longer but no more memory.
BUCKET_ROWS, MAX_BUCKETS = 250, 200_000
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _bucket_of(cuts: np.ndarray, ids: list) -> list[int]:
    """Buckets rise with the id; null ids are below all."""
    known = np.array([float(x) for x in ids if x is not None])
    at = iter((np.searchsorted(cuts, known, side="right") + 1).tolist())
    return [0 if x is None else next(at) for x in ids]


def _row(f: Fingerprinter, doc_id, text: str, mark: str, following: str, next_mark: str) -> tuple:
    new = edited(text, following)
    new_mark = mark if new == text else f.fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), mark, new_mark, likeness(mark, new_mark), likeness(mark, next_mark)


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness, and that to the next document.

    The next document is the one of the next smaller doc_id, after the last the first; rows that share a
    doc_id follow each other by text, and null ids come last. A single row is its own next. Null texts are
    empty. Other columns are ignored; an empty table gives an empty one.

    Ids are cut into buckets at quantiles; each bucket is sorted in one task, and the first row of a bucket
    is a guest of the bucket above it, whose last row it follows. Only bucket bounds come to the driver.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    docs = spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    sent = spark.sparkContext.broadcast(Fingerprinter(lexicon(docs, low, high)))
    buckets = min(MAX_BUCKETS, max(1, -(-docs.count() // BUCKET_ROWS)))
    found = docs.select(F.col("doc_id").cast("double").alias("x")).where("x is not null").approxQuantile("x", [i / buckets for i in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    cuts = np.array(sorted(set(found)))

    def number(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(_bucket_of(cuts, b["doc_id"].to_pylist()), pa.int32())], names=["doc_id", "bucket"])

    heads = {r[0]: r[1] for r in arrow_map(docs.select("doc_id"), number, f"doc_id {kind}, bucket int").groupBy("bucket").agg(F.max("doc_id")).toLocalIterator()}
    first_null = docs.where("doc_id is null").agg(F.min("text")).head()[0]
    order = sorted(heads, reverse=True)
    above = {b: order[i - 1] for i, b in enumerate(order)}

    def deal(batches):
        for b in batches:
            ids, texts = b["doc_id"].to_pylist(), b["text"]
            at = _bucket_of(cuts, ids)
            guests = [i for i, (x, k) in enumerate(zip(ids, at, strict=True)) if heads[k] == x and (x is not None or texts[i].as_py() == first_null)]
            take = pa.array([*range(b.num_rows), *guests], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].take(take), texts.take(take), pa.array(at + [above[at[i]] for i in guests], pa.int32()), pa.array([False] * b.num_rows + [True] * len(guests), pa.bool_())],
                names=["doc_id", "text", "bucket", "guest"],
            )

    dealt = arrow_map(docs, deal, f"doc_id {kind}, text string, bucket int, guest boolean").repartition("bucket")
    dealt = dealt.sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "text")

    def run(batches):
        f = sent.value
        held = None  # the row that waits for its next one
        for b in batches:
            rows = []
            for d, t, k, guest in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["bucket"].to_pylist(), b["guest"].to_pylist(), strict=True):
                if guest and (held is None or held[0] != k):
                    continue  # a repeated row of the guest's id
                mark = f.fingerprint(t)
                if held is not None and held[0] == k:
                    rows.append(_row(f, *held[1:], t, mark))
                held = None if guest else (k, d, t, mark)
            columns = [*zip(*rows, strict=True)] or [[]] * len(_NAMES)
            kinds = [b.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=_NAMES)

    return arrow_map(dealt, run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
