"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairs are summed in linear time as
half of (sum v_i x_i)^2 - sum (v_i x_i)^2 in each factor.

The machine is fitted on the driver on at most about TRAIN_ROWS labelled documents, drawn by a hash of
their ids: a bounded sample, whose features alone come to the driver. All documents are scored where
they lie, in one pass; the model has a fixed size.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import CACHES, arrow_column, arrow_map, binary_of, spread

TRAIN_ROWS = 12_000
FOLDS = 5
WORD_SLOTS = 1 << 16
CLASS_SLOTS = 64
FACTORS = 8
THRESHOLD = 0.3

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_ALNUM = _DIGIT + _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_SPACE = b" \t\n\r\x0b\x0c"
_PLAIN = b".,;:'\"()-?"
STATS = 16


class _Slots(dict):
    """The slot of a hashed word; kept in bounded number."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        slot = xxhash.xxh3_64_intdigest(word) % WORD_SLOTS
        if len(self) >= 200_000:
            self.clear()
        self[word] = slot
        return slot


_slots = _Slots()
CACHES.append(_slots)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the distinct words and of the length classes; STATS structure statistics."""
    low = text.lower()
    words = low.split()
    n, m = len(text), len(words)
    times = Counter(words)
    slots = np.unique(np.fromiter(map(_slots.__getitem__, times), np.int64, len(times)))
    lines = text.split(b"\n")
    several = Counter(x for x in lines if x)
    without = lambda drop: n - len(text.translate(None, drop))  # noqa: E731  bytes of those kinds
    share = lambda a, b: a / b if b else 0.0
    letters = without(_ALNUM)
    upper = without(_UPPER)
    marks = n - letters - without(_SPACE)
    odd = marks - without(_PLAIN)
    pairs = Counter(zip(words, words[1:], strict=False))
    stats = np.array([
        np.log1p(n), share(letters, m), share(upper, letters), share(without(_DIGIT), n), share(marks, n), share(odd, n),
        share(without(b"!"), n), share(without(b"|"), n), share(len(lines), m), np.log1p(len(lines)), share(len(times), m),
        share(max(times.values(), default=0), m), share(sum(several.values()) - len(several), max(1, len(lines))),
        share(len(pairs), max(1, m - 1)), share(max(pairs.values(), default=0), max(1, m - 1)), float(m < 5),
    ])
    # metadata as classes: size, lines and the round size of a line
    classes = [WORD_SLOTS + n.bit_length() % 24, WORD_SLOTS + 24 + min(len(lines), 1 << 15).bit_length(), WORD_SLOTS + 40 + (n // max(1, len(lines))).bit_length() % 24]
    return np.concatenate([slots, np.array(classes, np.int64)]), stats


class FactorisationMachine:
    """Slots 0.. are words and classes, the last STATS are the statistics, scaled as in training."""

    def __init__(self, seed: int = 5) -> None:
        size = WORD_SLOTS + CLASS_SLOTS + STATS
        self.bias, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (size, FACTORS))
        self.mean, self.scale = np.zeros(STATS), np.ones(STATS)

    def row(self, slots: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        at = np.concatenate([slots, np.arange(STATS) + WORD_SLOTS + CLASS_SLOTS])
        return at, np.concatenate([np.full(len(slots), 1 / np.sqrt(len(slots))), x / 4])

    def raw(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Values before the logistic function of the rows that begin at `starts` of the slots and their values."""
        u = self.v[at] * x[:, None]
        s = np.add.reduceat(u, starts, axis=0)
        return self.bias + np.add.reduceat(self.w[at] * x, starts) + 0.5 * (np.square(s).sum(axis=1) - np.add.reduceat(np.square(u).sum(axis=1), starts))

    def scores(self, texts: list[bytes], most: int = 100_000) -> np.ndarray:
        """Scores of the texts, put together to groups of about `most` slots."""
        found, rows, size = [np.empty(0)], [], 0
        for k, text in enumerate(texts):
            rows.append(self.row(*features(text)))
            size += len(rows[-1][0])
            if size > most or k == len(texts) - 1:
                sizes = np.array([len(r[0]) for r in rows])
                z = self.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum(sizes) - sizes)
                found.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                rows, size = [], 0
        return np.concatenate(found)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.08, decay: float = 1e-5) -> FactorisationMachine:
        """Minibatches with per-weight step sizes; rows in a fixed shuffled order."""
        if not len(rows):  # nothing to learn from: all scores are 0.5
            self.v[:] = 0
            return self
        stats = np.array([s for _, s in rows])
        self.mean, self.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        data = [self.row(*r) for r in rows]
        p = np.clip(labels.mean(), 0.01, 0.99)
        self.bias = float(np.log(p / (1 - p)))
        gw, gv, gb = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        rng = np.random.default_rng(11)
        for _ in range(epochs):
            order = rng.permutation(len(data))
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                at = np.concatenate([data[i][0] for i in part])
                x = np.concatenate([data[i][1] for i in part])
                sizes = np.array([len(data[i][0]) for i in part])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                u = self.v[at] * x[:, None]
                s = np.add.reduceat(u, starts, axis=0)
                z = self.bias + np.add.reduceat(self.w[at] * x, starts) + 0.5 * (np.square(s).sum(axis=1) - np.add.reduceat(np.square(u).sum(axis=1), starts))
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
                e = np.repeat(error, sizes)
                slots, inverse = np.unique(at, return_inverse=True)
                by = np.argsort(inverse, kind="stable")
                first = np.searchsorted(inverse[by], np.arange(len(slots)))
                dw = np.add.reduceat((e * x)[by], first) + decay * self.w[slots]
                dv = np.add.reduceat(((e * x)[:, None] * (np.repeat(s, sizes, axis=0) - u))[by], first, axis=0) + decay * self.v[slots]
                gw[slots] += dw * dw
                gv[slots] += dv * dv
                gb += error.sum() ** 2
                self.w[slots] -= rate * dw / np.sqrt(gw[slots])
                self.v[slots] -= rate * 0.5 * dv / np.sqrt(gv[slots])
                self.bias -= rate * error.sum() / np.sqrt(gb)
        self.w, self.v = self.w.astype(np.float32), self.v.astype(np.float32)
        return self


def fold(column: str = "doc_id", folds: int = FOLDS):
    return F.crc32(F.col(column).cast("string")) % folds


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """Fit on labelled documents outside the held-out fold: about `rows` of them at most, chosen by hash."""
    known = labels.where("quality is not null and doc_id is not null").where(fold() != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    if not n:
        return FactorisationMachine().fit([], np.empty(0))
    limit = min(1.0, rows / n) * 2.0**53  # a share of all hashes, however small
    drawn = known.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 11) < F.lit(limit))
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "quality")  # bounded by `rows`

    def extract(batches):
        for b in batches:
            out = [features(t) for t in binary_of(b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.string()), b["quality"].cast(pa.int32()), pa.array([s.astype(np.int32).tobytes() for s, _ in out], pa.binary()), pa.array([x.tobytes() for _, x in out], pa.binary())], names=["id", "quality", "slots", "stats"])

    got = arrow_map(spread(texts), extract, "id string, quality int, slots binary, stats binary").toPandas().sort_values(["id", "slots"], ignore_index=True)
    found = [(np.frombuffer(s, np.int32).astype(np.int64), np.frombuffer(x, np.float64)) for s, x in zip(got["slots"], got["stats"], strict=True)]
    return FactorisationMachine().fit(found, (got["quality"].to_numpy() > 0).astype(float))


#: Name of the score beside the columns of documents, which may have a score of their own.
SCORE = "__quality_score"


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """docs with the column SCORE. Null and empty texts have a score too, from their statistics; very long texts
    are read whole; rows that repeat an id are scored one by one. Only texts go to Python, so columns of any other
    names and kinds pass by untouched; one named SCORE is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(SCORE, arrow_column(docs, lambda text: pa.array(sent.value.scores(binary_of(text)), pa.float64()), "double", F.col("text")))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. Labels of other folds only are learnt; without
    any the score is 0.5. Null ids are not held out. Other columns, lang and source among them, are ignored."""
    out = score(spread(docs.select("doc_id", "text")), train(docs, labels))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold or more, with their columns."""
    return score(spread(docs), train(docs, labels)).where(F.col(SCORE) >= threshold).drop(SCORE)
