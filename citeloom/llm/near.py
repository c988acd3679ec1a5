"""Near-duplicate documents: min-max signatures in bands find candidates, full shingle sets confirm them.

Each permutation of the shingle hashes yields two signature values, its minimum and its maximum,
so 64 permutations make 128 values: 32 bands of 4. A pair at similarity 0.75 shares a band with
probability 1 - (1 - 0.75^4)^32 = 0.999995, and more above it.

Exact copies collapse first, by a partial aggregation on a key of the word sequence. Of the
remaining texts, buckets of bands are joined up as stars (see stars.py): no link between different
texts that could join two groups is left out, and a group of thousands of near copies costs thousands
of checks and not their square. What is left to be checked pair by pair is sifted by longer sketches, of
one bit of each of 1024 signature values: an unbiased estimate of similarity with a deviation of 0.02, so
that a pair at 0.75 stands above the bound of 0.68 by more than three deviations.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import CACHES, arrow_map, binary_of, settle, spread
from citeloom.llm.stars import linked, stars

SHINGLE = 5
PERMUTATIONS = 64
BANDS = 32
PERCENT = 75
LONG_PERMUTATIONS, LEAST_ALIKE = 512, 0.68
_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20240607)
_MULT = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LONG = _rng.integers(0, 1 << 63, LONG_PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, (BANDS, 2 * PERMUTATIONS // BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    """64-bit hash of a word; words recur, so hashes are kept in bounded number."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 200_000:
            self.clear()
        self[word] = h
        return h


_hashes = _Hashes()
CACHES.append(_hashes)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; fewer words make one; none make none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    k = min(n, SHINGLE)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h += _mix(w[i : n - k + 1 + i]) * _PLACE[i]
        return np.unique(_mix(h))


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys, one row of BANDS for each set; sets are not empty."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    flat = np.concatenate(sets)
    sig = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(PERMUTATIONS):
            x = flat * _MULT[k]
            sig[:, 2 * k] = np.minimum.reduceat(x, starts)
            sig[:, 2 * k + 1] = np.maximum.reduceat(x, starts)
        r = 2 * PERMUTATIONS // BANDS
        keys = np.empty((len(sets), BANDS), np.uint64)
        for j in range(BANDS):
            keys[:, j] = _mix((_mix(sig[:, j * r : (j + 1) * r]) * _BAND[j]).sum(axis=1, dtype=np.uint64) + np.uint64(j))
    return keys.view(np.int64)


def _signatures(batches):
    for b in batches:
        sizes, keys, todo, where = [], [], [], []
        out: list[list[int]] = [[]] * b.num_rows
        held = 0

        def flush():
            nonlocal held
            if todo:
                for i, row in zip(where, bands_of(todo).tolist(), strict=True):
                    out[i] = row
                todo.clear()
                where.clear()
                held = 0

        for i, text in enumerate(binary_of(b["text"])):
            words = text.lower().split()
            s = shingles(words)
            sizes.append(len(s))
            keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if len(s) else None)
            if len(s):
                todo.append(s)
                where.append(i)
                held += len(s)
                if held > 500_000:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "n", "key", "bands"])


def _sets(batches):
    """Full sets as 6 bytes a shingle."""
    for b in batches:
        blobs = [shingles(t.lower().split()).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for t in binary_of(b["text"])]
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(blobs, pa.binary())], names=["id", "words"])


def _open(blob: bytes) -> np.ndarray:
    x = np.zeros((len(blob) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return x.view(np.uint64).ravel()


def _confirm(batches):
    for b in batches:
        linked = []
        for x, y in zip(b["words_a"].to_pylist(), b["words_b"].to_pylist(), strict=True):
            p, q = _open(x), _open(y)
            common = len(np.intersect1d(p, q, assume_unique=True))
            linked.append(100 * common >= PERCENT * (len(p) + len(q) - common))
        keep = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([b["a"].filter(keep), b["b"].filter(keep)], names=["a", "b"])


def _links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b), of ids of different texts, that the full sets confirm."""
    wanted = settle(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "wanted")
    sets = settle(arrow_map(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), _sets, f"id {dict(docs.dtypes)['doc_id']}, words binary"), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("words").alias("words_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("words").alias("words_b")), "b")
    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(both, _confirm, f"a {kind}, b {kind}")


def _close_in_size(x: str, y: str):
    """A link needs 100 * smaller >= 75 * larger."""
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def sketch_of(words: np.ndarray) -> np.ndarray:
    """One bit of the minimum and maximum of each long permutation, packed."""
    with np.errstate(over="ignore"):
        bits = np.empty(2 * LONG_PERMUTATIONS, np.uint8)
        for k in range(0, LONG_PERMUTATIONS, 64):
            x = words[None, :] * _LONG[k : k + 64, None]
            bits[2 * k : 2 * k + 128] = _mix(np.concatenate([x.min(axis=1), x.max(axis=1)])) & np.uint64(1)
    return np.packbits(bits).view(np.int64)


def _long_sketches(batches):
    for b in batches:
        found = [sketch_of(shingles(t.lower().split())).tolist() for t in binary_of(b["text"])]
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found, pa.list_(pa.int64()))], names=["id", "sketch"])


def _alike(x: str, y: str):
    """Whether few enough bits of two sketches differ: half of the share of signature values that do."""
    unequal = F.lit(0)
    for i in range(2 * LONG_PERMUTATIONS // 64):
        unequal = unequal + F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i))))
    return unequal <= int((1 - LEAST_ALIKE) * LONG_PERMUTATIONS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Null, empty and blank texts have no shingles and are linked with nothing. A null doc_id is linked
    with nothing, has a null component and is kept. Rows that repeat a doc_id are one document.
    Columns other than doc_id and text are ignored.
    """
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    sig = settle(arrow_map(spread(docs), _signatures, f"doc_id {kind}, n long, key binary, bands array<long>"), "signatures")
    texts = settle(
        sig.where("key is not null and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "n", "bands")).alias("first"), F.count("*").alias("copies")).select("key", F.col("first.doc_id").alias("id"), "first.n", "first.bands", "copies"),
        "texts",
    )
    members = stars(texts.select(F.explode("bands").alias("bucket"), "id", "n"))

    def sketches(ids: DataFrame) -> DataFrame:
        made = arrow_map(docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), _long_sketches, f"id {kind}, sketch array<long>")
        return made.join(texts.select("id", "bands"), "id")

    label = linked(members, lambda pairs: _links(docs, pairs), _close_in_size, sketches, _alike)
    moved = texts.join(label, "id", "left").select("key", F.coalesce("component", "id").alias("component"), "id", "copies").where("copies > 1 or component <> id").select("key", "component")
    done = sig.select("doc_id", "n", "key").join(settle(moved, "moved"), "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return done.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
