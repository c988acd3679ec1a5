"""Loose normalisation that keeps places: which part of the raw text each of its signs comes from."""

from __future__ import annotations

import unicodedata
from array import array
from bisect import bisect_left, bisect_right

import regex

from citeloom.functions import text as X

# plain signs that no mark follows stand for themselves; else a sign and what is composed with it go together
_CLUSTERS = regex.compile(r"[\x00-\x7F]+(?![^\x00-\x7F])|\X")
_TOKENS = regex.compile(r"\S+")


class Places:
    """A string with the raw beginning and end of each of its signs."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str = "", starts: array | None = None, ends: array | None = None) -> None:
        self.text, self.starts, self.ends = text, starts if starts is not None else array("I"), ends if ends is not None else array("I")

    def rewritten(self, pattern: regex.Pattern, new) -> Places:
        """With each match replaced by new(match text). A replacement of equal length keeps its signs' places, in any
        other all its signs have the place of the whole match."""
        parts, starts, ends, at = [], array("I"), array("I"), 0
        for m in pattern.finditer(self.text):
            lo, hi = m.span()
            text = new(m[0])
            parts += [self.text[at:lo], text]
            starts += self.starts[at:lo]
            ends += self.ends[at:lo]
            if len(text) == hi - lo:
                starts += self.starts[lo:hi]
                ends += self.ends[lo:hi]
            else:
                starts.extend([self.starts[lo]] * len(text))
                ends.extend([self.ends[hi - 1]] * len(text))
            at = hi
        if not at:
            return self
        return Places("".join([*parts, self.text[at:]]), starts + self.starts[at:], ends + self.ends[at:])

    def raw(self, start: int, end: int) -> tuple[int, int]:
        """The raw span that a span of the string covers."""
        return (self.starts[start], self.ends[end - 1]) if start < end else (0, 0)

    def within(self, start: int, end: int) -> tuple[int, int]:
        """The span of the string whose signs come from a raw span, wholly or in part; empty where all of it was dropped."""
        lo = bisect_right(self.ends, start)
        return lo, max(lo, bisect_left(self.starts, end))


def composed(text: str) -> Places:
    parts, starts, ends = [], array("I"), array("I")
    for m in _CLUSTERS.finditer(text):
        lo, hi = m.span()
        if m[0].isascii():
            parts.append(m[0])
            starts.extend(range(lo, hi))
            ends.extend(range(lo + 1, hi + 1))
        else:
            one = unicodedata.normalize("NFC", m[0])
            parts.append(one)
            starts.extend([lo] * len(one))
            ends.extend([hi] * len(one))
    return Places("".join(parts), starts, ends)


_FOLDED = regex.compile("[" + "".join(regex.escape(chr(c)) for c in X._FOLD) + "]")
_CASED = regex.compile(r"\p{Changes_When_Casefolded}")


def loose(text: str) -> Places:
    """What text.loose gives, with places. The space between two words stands for all that was between them."""
    p = composed(text).rewritten(X._GONE, lambda _: "").rewritten(_FOLDED, lambda c: X._FOLD[ord(c)]).rewritten(X._CAPITALS, str.capitalize)
    p = p.rewritten(X._LOOSE_GONE, lambda _: "")
    low = p.text.casefold()  # folding never shortens, so equal lengths mean sign for sign
    p = Places(low, p.starts, p.ends) if len(low) == len(p.text) else p.rewritten(_CASED, str.casefold)
    p = p.rewritten(X._MARKS, lambda _: " ")
    words, starts, ends = [], array("I"), array("I")
    for m in _TOKENS.finditer(p.text):
        if words:
            starts.append(ends[-1])
            ends.append(p.starts[m.start()])
        words.append(m[0])
        starts += p.starts[m.start() : m.end()]
        ends += p.ends[m.start() : m.end()]
    return Places(" ".join(words), starts, ends)
