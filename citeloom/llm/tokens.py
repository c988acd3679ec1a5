"""Token counts by a finite-state tokenizer compiled from a byte-pair vocabulary.

Byte-pair merging has a finite-state form: the encoding of a prefix extended by one character
ends in the one token t for which t may follow the last token of the prefix before t. What is
needed of the past is therefore, for each place from which a token could still grow, the trie
node grown so far, the last token before that place and how many tokens fewer were emitted
there. That tuple is the state; a transition on a character carries the change of the number of
emitted tokens. States and transitions are compiled when first met and kept.

Characters that no token holds, and the place before a word mark that follows another character,
are reset points: no token crosses them, so every state goes to the start state there. A chunk of
text thus maps an entering state to (leaving state, emitted tokens) by its few characters before
the first reset point, and a constant after it. Chunk maps compose associatively; texts of many
chunks are put together by a prefix scan over the maps.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from citeloom.llm.common import arrow_map, spread, texts_of

LIMIT = 4096
CHUNK = 65_536
MARK = "▁"  # fixed value: the vocabulary's sign for a space


class Vocabulary:
    """Pieces, scores and merging of a byte-pair model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        self.score = {m.id_to_piece(i): m.get_score(i) for i in ids}
        chars = {c for p in self.score for c in p}
        if any(MARK in p.lstrip(MARK) for p in self.score) or not chars <= self.score.keys():
            raise ValueError("the vocabulary has pieces that cross words, or characters that are no pieces")
        self.chars = chars

    def merge(self, text: str) -> list[str]:
        """Plain merging: best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Transducer:
    """The deterministic transducer of a vocabulary, compiled as far as texts have needed it."""

    START = 0

    def __init__(self, vocabulary: Vocabulary, max_states: int = 250_000, max_units: int = 1_000_000) -> None:
        self.v, self.max_states = vocabulary, max_states
        self.next: list[dict[str, int]] = [{}]  # the trie of pieces
        self.piece: list[str | None] = [None]
        for p in vocabulary.score:
            node = 0
            for c in p:
                node = self.next[node].setdefault(c, len(self.next))
                if node == len(self.next):
                    self.next.append({})
                    self.piece.append(None)
            self.piece[node] = p
        self.fits_: dict[tuple[str, str], bool] = {}
        self._reset()
        split = f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+" if "\n" not in vocabulary.chars else f"{MARK}+[^{MARK}]*|[^{MARK}]+"
        self.units = re.compile(split)
        self.counts = _Counts(self, max_units)

    def _reset(self) -> None:
        self.states: list[tuple] = [((0, "", 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def fits(self, a: str, b: str) -> bool:
        """Whether token b may follow token a ("": nothing before)."""
        known = self.fits_.get((a, b))
        if known is None:
            known = self.fits_[a, b] = self.v.merge(a + b) == ([a, b] if a else [b])
        return known

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        if c not in self.v.chars:  # its bytes, and a reset point
            move = (self.START, len(c.encode("utf-8", "surrogatepass")))
        else:
            grown = [(n, last, rel) for node, last, rel in self.states[state] if (n := self.next[node].get(c)) is not None]
            token, delta = next((p, rel + 1) for n, last, rel in grown if (p := self.piece[n]) is not None and self.fits(last, p))
            key = tuple((n, last, rel - delta) for n, last, rel in grown if self.next[n]) + ((0, token, 0),)
            to = self.number.get(key)
            if to is None:
                to = self.number[key] = len(self.states)
                self.states.append(key)
                self.moves.append({})
            move = (to, delta)
        self.moves[state][c] = move
        return move

    def run(self, state: int, text: str) -> tuple[int, int]:
        """From a state over text: the state reached and the tokens emitted."""
        n, moves = 0, self.moves
        for c in text:
            move = moves[state].get(c)
            if move is None:
                move = self._compile(state, c)
            state = move[0]
            n += move[1]
        return state, n

    def unit(self, text: str) -> int:
        return self.run(self.START, text)[1]

    def chunk_map(self, chunk: str) -> ChunkMap:
        """chunk (with word marks) as a map of states."""
        units = self.units.findall(chunk)
        if not units:
            return ChunkMap("", None, 0)
        first = 0 if chunk[0] == "\n" else 1  # a newline is a reset point itself
        if first and chunk[0] == MARK:
            # the marks at the front may prolong marks before them: they and their word stay open
            first = 1
        if len(units) == first:
            return ChunkMap(chunk, None, 0)
        inner = units[first:-1]
        state, n = self.run(self.START, units[-1])
        return ChunkMap("".join(units[:first]), state, n + sum(map(self.counts.__getitem__, inner)))

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First a, then b."""
        if a.state is None:
            return ChunkMap(a.head + b.head, b.state, b.count)
        state, n = self.run(a.state, b.head)
        return ChunkMap(a.head, state if b.state is None else b.state, a.count + n + b.count)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Inclusive prefix scan by doubling: entry i maps the start of the text to the end of chunk i."""
        step = 1
        while step < len(maps):
            maps = [self.compose(maps[i - step], m) if i >= step else m for i, m in enumerate(maps)]
            step *= 2
        return maps

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of text, without begin and end."""
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if len(self.states) > self.max_states:  # compile anew, but never within a text, whose chunk maps hold states
            self._reset()
        if len(text) <= chunk:
            return sum(map(self.counts.__getitem__, self.units.findall(text)))
        whole = self.scan([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)])[-1]
        return whole.count + self.run(self.START, whole.head)[1]


class ChunkMap:
    """A chunk as a map of entering states: head is read from the entering state; state is None if no
    reset point lies in the chunk, else the leaving state, with count tokens after the head."""

    __slots__ = ("count", "head", "state")

    def __init__(self, head: str, state: int | None, count: int) -> None:
        self.head, self.state, self.count = head, state, count


class _Counts(dict):
    """Tokens of a whole unit from the start state; units recur, so their runs are kept."""

    def __init__(self, transducer: Transducer, most: int) -> None:
        super().__init__()
        self.t, self.most = transducer, most

    def __missing__(self, unit: str) -> int:
        n = self.t.unit(unit)
        if len(unit) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[unit] = n
        return n


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One transducer a worker process and vocabulary."""
    if path not in _compiled:
        _compiled[path] = Transducer(Vocabulary(path))
    return _compiled[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    A null or empty text has 0 bytes and tokens. Rows are counted one by one, repeated ids included;
    other columns are ignored. path names the vocabulary's file, which each executor must have.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def count(batches):
        t = transducer(path)
        for b in batches:
            texts = texts_of(b["text"])
            n = [t.count(x) for x in texts]
            size = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(spread(docs.select("doc_id", "text")), count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
