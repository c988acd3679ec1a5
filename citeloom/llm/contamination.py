"""Benchmark decontamination with a generalised suffix automaton over words.

The test items, normalised to words, are the strings of one automaton; training texts stream
through it word by word while the length of the longest match that ends at each word is tracked.
A match of `window` words or more covers an occurrence of a window; an item shorter than that
is one window of its own. No join is made and no candidate is dropped, so a very common passage
costs no more than any other.

Memory: an automaton has at most 2 states a word, kept in flat arrays; a state with more than one
transition, of which there are few, has a table besides. Items are put into parts of at most
`part_words` words, each a broadcast of bounded size; a pass takes at most PASS_PARTS of them, and
what it found is written before the next one begins.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import arrow_column, binary_of, settle, spread

WINDOW = 10
PART_WORDS = 200_000
PASS_PARTS = 10
#: Over lower-cased UTF-8 bytes this is the word class of the contract: digits, a-z, all beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items behind each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for key, words in items:
            if words:
                coded.append((key, [self.vocab.setdefault(w, len(self.vocab)) for w in words]))
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self._annotate(coded)
        self._flatten()
        self.shortest = min((min(len(ids), window) for _, ids in coded), default=0)

    def _new(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q that holds only the strings one longer than those of p."""
        clone = self._new(dict(self.step[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:  # another item has this prefix already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur = self._new({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur

    def _annotate(self, coded: list[tuple[str, list[int]]]) -> None:
        """reduced: for states of `window` words or more, the state of their last `window` words; which: the items
        behind such a state; short: the nearest state on the way of suffix links, the state itself included,
        that ends a whole item of fewer words, which `whole` lists."""
        window, link, length = self.window, self.link, self.length
        by_length = sorted(range(len(length)), key=length.__getitem__)
        self.reduced = array("i", bytes(4 * len(length)))
        for v in by_length:
            if length[v] >= window:
                self.reduced[v] = v if length[link[v]] < window else self.reduced[link[v]]
        self.which: dict[int, str | set[str]] = {}
        self.whole: dict[int, dict[int, set[str]]] = {}
        for key, ids in coded:
            v = 0
            for c in ids:
                v = self.step[v][c]
                if length[v] >= window:
                    seen = self.which.setdefault(self.reduced[v], key)
                    if seen != key:  # a set only where items share a window
                        self.which[self.reduced[v]] = (seen if isinstance(seen, set) else {seen}) | {key}
            if len(ids) < window:
                while length[link[v]] >= len(ids):
                    v = link[v]
                self.whole.setdefault(v, {}).setdefault(len(ids), set()).add(key)
        self.short = array("i", bytes(4 * len(length)))
        for v in by_length[1:]:
            self.short[v] = v if v in self.whole else self.short[link[v]]

    def _flatten(self) -> None:
        """Transitions as arrays: the only one of a state, and tables for states that have several."""
        n = len(self.step)
        self.only, self.to = array("i", [-1]) * n, array("i", [-1]) * n
        self.more: dict[int, dict[int, int]] = {}
        for v, step in enumerate(self.step):
            if len(step) == 1:
                ((self.only[v], self.to[v]),) = step.items()
            elif step:
                self.more[v] = step
        del self.step
        self.link, self.length = array("i", self.link), array("i", self.length)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) word spans that windows cover, and the items they come from."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if not self.shortest or len(words) < self.shortest:
            return spans, found
        ids = list(map(self.vocab.get, words))
        ids.append(None)
        start, at = 0, -1
        while True:  # runs of words that items hold; all matches lie within one
            try:
                at = ids.index(None, start)
            except ValueError:
                break
            if at - start >= self.shortest:
                self._run(ids, start, at, spans, found)
            start = at + 1
        return spans, found

    def _run(self, ids: list, start: int, end: int, spans: list, found: set) -> None:
        only, to, more, link, length, window, whole = self.only, self.to, self.more, self.link, self.length, self.window, self.whole
        v = n = last = 0
        for i in range(start, end):
            c = ids[i]
            while True:
                q = to[v] if only[v] == c else more[v].get(c, -1) if v in more else -1
                if q >= 0 or not v:
                    break
                v = link[v]
                n = length[v]
            if q < 0:
                continue
            v, n = q, n + 1
            hit = 0
            if n >= window:
                hit = window
                w = self.reduced[v]
                if w != last:
                    items, last = self.which[w], w
                    found.update(items if isinstance(items, set) else (items,))
            u = self.short[v] if whole else 0
            while u:  # at most one state for each length below the window
                for m, keys in whole[u].items():
                    if m <= n:
                        hit = max(hit, m)
                        found |= keys
                u = self.short[link[u]]
            if hit:
                s = i + 1 - hit
                while spans and spans[-1][1] >= s:
                    s = min(s, spans.pop()[0])
                spans.append((s, i + 1))


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def _parts(items: DataFrame, window: int, part_words: int) -> Iterator[SuffixAutomaton]:
    """Automata of the items, each of a bounded number of words; the driver holds one at a time."""
    part, size = [], 0
    for row in items.select(F.col("item_id").cast("string"), F.col("text")).toLocalIterator():
        words = words_of((row[1] or "").encode())
        if part and size + len(words) > part_words:
            yield SuffixAutomaton(part, window)
            part, size = [], 0
        if words:
            part.append((row[0] or "", words))
            size += len(words)
    yield SuffixAutomaton(part, window)


#: Columns that match() adds; their names leave those of the documents free.
FOUND = ("__n_words", "__spans", "__items", "__left")
_FOUND = pa.struct([("n", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("left", pa.string())])


def match(docs: DataFrame, items: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS, min_words: int | None = None) -> DataFrame:
    """docs with the columns FOUND: number of words, spans (flat [start, end) word offsets), items found and, with
    min_words, what cut() leaves of a text with spans, else null.

    Null and empty texts have no words and no hits; very long ones are read whole. An item without words is
    never found; items that share an id count as one; a null id is shown as "". Repeated documents each get a
    row. Other columns of docs pass by, whatever their names and kinds, but for those named in FOUND.
    """
    spark, df, parts = docs.sparkSession, spread(docs), []

    def through(df: DataFrame, parts: list, first: bool, last: bool) -> DataFrame:
        def scan(texts, *before):
            n, spans, found, left = [], [], [], []
            for k, text in enumerate(binary_of(texts)):
                words = words_of(text)
                at, names = ([], set()) if first else (before[0][k].as_py(), set(before[1][k].as_py()))
                at = [*zip(at[::2], at[1::2], strict=True)]
                for part in parts:
                    s, f = part.value.scan(words)
                    at += s
                    names |= f
                n.append(len(words))
                spans.append([x for p in merged(at) for x in p])
                found.append(sorted(names))
                left.append(cut(text, spans[-1], min_words).decode("utf-8", "replace") if last and min_words is not None and at else None)
            return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string())), pa.array(left, pa.string())], fields=list(_FOUND))

        had = [] if first else [F.col(FOUND[1]), F.col(FOUND[2])]
        out = df.withColumn("__found", arrow_column(df, scan, "struct<n: long, spans: array<int>, items: array<string>, left: string>", F.col("text"), *had))
        return out.withColumns({name: F.col(f"__found.{part}") for name, part in zip(FOUND, ("n", "spans", "items", "left"), strict=True)}).drop("__found")

    first = True
    for automaton in _parts(items, window, part_words):
        if len(parts) == PASS_PARTS:
            df, parts, first = settle(through(df, parts, first, False), "matched"), [], False
        parts.append(spark.sparkContext.broadcast(automaton))
    return through(df, parts, first, True)


def _hit_words():
    """Words within the spans."""
    starts = F.filter(FOUND[1], lambda x, i: i % 2 == 0)
    ends = F.filter(FOUND[1], lambda x, i: i % 2 == 1)
    return F.aggregate(F.zip_with(starts, ends, lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + x)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut(text: bytes, spans: list[int], min_words: int) -> bytes:
    """text without the words of spans of at least min_words words, and what stands between those words."""
    at = [m.span() for m in _WORD.finditer(text.lower())]
    out, last = [], 0
    for s, e in zip(spans[::2], spans[1::2], strict=True):
        if e - s >= min_words:
            out.append(text[last : at[s][0]])
            last = at[e - 1][1]
    return b"".join(out) + text[last:]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_words: int = 1, max_coverage: float = 0.5) -> DataFrame:
    """docs without benchmark passages: spans of at least min_words hit words are cut out of the text;
    a document of which more than max_coverage of the words are hit goes as a whole.

    Documents without hits come back as they are, null and empty ones too. A match is a window of `window`
    words, or a whole item if it has fewer, so the length limit is `window` unless min_words is larger.
    """
    df = match(docs, items, window, min_words=min_words).where(_hit_words() <= F.col(FOUND[0]) * F.lit(max_coverage))
    return df.withColumn("text", F.coalesce(FOUND[3], "text")).select(*docs.columns)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: words, hit words and the items found, as a digest."""
    found = match(docs.select("doc_id", "text"), items).select(
        "doc_id",
        F.col(FOUND[0]).alias("n_words"),
        _hit_words().alias("n_hit"),
        F.size(FOUND[2]).cast("long").alias("n_items"),
        F.sha2(F.array_join(FOUND[2], ","), 256).alias("items_sha256"),
    )
    return found.withColumn("contaminated", F.col("n_hit") > 0)
