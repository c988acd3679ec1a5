"""Normalisation of multi-script text, and the scalar text rules built on it.

Plain Python for what Spark has no built-in for (canonical composition, case folding, script classes),
wrapped as Arrow-batched UDFs; what built-ins can say is a Column expression.
"""

from __future__ import annotations

import ast
import hashlib
import json
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Glyphs that count as an apostrophe, a double quote, a hyphen.
APOSTROPHES = "‘’‚‛′ʼ`´‹›＇"
DOUBLE_QUOTES = "“”„‟″«»「」『』〝〞＂"
HYPHENS = "‐‑‒–—―−"
# Code points that renderers insert and that mean nothing; joiners; Arabic vowel and reading marks.
INVISIBLE = "​‎‏‪-‮⁠-⁤⁦-⁩﻿"
JOINERS = "‌‍"
ARABIC_MARKS = "ً-ٰٟۖ-ۭـ"
# Scripts written without spaces.
UNSPACED_SCRIPTS = ("Han", "Hiragana", "Katakana", "Thai", "Khmer", "Lao", "Myanmar")
# Phrases of refusal in the languages of the corpus, as lower-case text.
REFUSALS = (
    "i cannot", "i can't", "i can not", "i'm unable", "i am unable", "i'm not able", "i am not able", "i'm sorry", "i am sorry", "i apologize",
    "cannot provide", "can't provide", "unable to provide", "as an ai", "i don't have", "no puedo", "lo siento", "je ne peux", "désolé", "ich kann nicht",
    "не могу", "извините", "죄송", "제공할 수 없", "申し訳", "できません", "抱歉", "无法", "無法", "ขออภัย", "ไม่สามารถ", "لا أستطيع", "عذرا", "عذراً", "नहीं कर सकता", "क्षमा",
)
# Words in a finish reason that tell of a provider's block, or of a cut-off answer.
BLOCKED, TRUNCATED = ("content_filter", "recitation"), ("length", "max_token", "max_output")

_FOLD = {ord(c): "'" for c in APOSTROPHES} | {ord(c): '"' for c in DOUBLE_QUOTES} | {ord(c): "-" for c in HYPHENS} | {ord("…"): "..."}
_GONE = regex.compile(f"[{INVISIBLE}]")
_LOOSE_GONE = regex.compile(f"[{JOINERS}{ARABIC_MARKS}]")
_CAPITALS = regex.compile(r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})")
_MARKS = regex.compile(r"[\p{P}\p{S}]")
_UNSPACED = regex.compile("[" + "".join(rf"\p{{{s}}}" for s in UNSPACED_SCRIPTS) + "]")


def strict(text: str) -> str:
    """Presentation folded away: composition, invisibles, quote and dash glyphs, words in capitals, white space."""
    text = _GONE.sub("", unicodedata.normalize("NFC", text)).translate(_FOLD)
    return " ".join(_CAPITALS.sub(lambda m: m[0].capitalize(), text).split())


def loose(text: str) -> str:
    """strict, and no case, no marks, no joiners, no Arabic pointing."""
    return " ".join(_MARKS.sub(" ", _LOOSE_GONE.sub("", strict(text)).casefold()).split())


def is_unspaced(text: str) -> bool:
    head = text[:200]
    return bool(head) and len(_UNSPACED.findall(head)) > 0.3 * len(head)


def is_refusal(text: str) -> bool:
    low = strict(text).lower()
    return any(x in low for x in REFUSALS)


def has_denial(text: str, markers: list[str]) -> bool:
    flat = " ".join(text.casefold().split())
    return any(m and " ".join(m.casefold().split()) in flat for m in markers)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def nonspace_length(text: str) -> int:
    return sum(not c.isspace() for c in text)


def json_in(text: str) -> str | None:
    """The first JSON object in an answer, fenced or among prose, as canonical JSON; Python literals pass too."""
    fenced = regex.search(r"```(?:json)?\s*(\{.*?\})\s*```", text, regex.S)
    first, last = text.find("{"), text.rfind("}")
    for part in filter(None, (fenced and fenced[1], text[first : last + 1] if 0 <= first < last else None)):
        for read in (json.loads, ast.literal_eval):
            try:
                found = read(part)
            except (ValueError, SyntaxError):
                continue
            if isinstance(found, dict):
                return json.dumps(found, sort_keys=True, ensure_ascii=False)
    return None


def _udf(f, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else f(t))

    return run


strict_udf, loose_udf = _udf(strict, T.StringType()), _udf(loose, T.StringType())
refusal_udf, json_udf = _udf(is_refusal, T.BooleanType()), _udf(json_in, T.StringType())


# -- Column expressions -------------------------------------------------------------------------------


def plain(text: Column) -> Column:
    """The part of loose that built-ins share with other engines: lower case, ASCII letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Whether the text has one of the phrases, as one alternation; empty phrases never match."""
    some = [regex.escape(p, literal_spaces=True) for p in phrases if p]
    return text.rlike("|".join(some)) if some else F.lit(False)


def was_blocked(reason: Column) -> Column:
    return F.lower(F.coalesce(reason, F.lit(""))).rlike("|".join(BLOCKED))


def is_truncated(reason: Column) -> Column:
    return F.lower(F.coalesce(reason, F.lit(""))).rlike("|".join(TRUNCATED))


def error_rate(attempt: Column, truth: Column) -> Column:
    """Edit distance over the truth's length; may exceed 1, null for an empty truth."""
    return F.when(F.length(truth) > 0, F.levenshtein(attempt, truth) / F.length(truth))


def likeness(attempt: Column, truth: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - error_rate(attempt, truth))


def quote_likeness(a: Column, b: Column) -> Column:
    """1 if either holds the other, else 1 - distance / longer; 0 if one is empty."""
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(empty, 0.0).when(a.contains(b) | b.contains(a), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))))


def band(similarity: Column) -> Column:
    return F.when(similarity >= 0.98, "verbatim").when(similarity >= 0.90, "near_verbatim").when(similarity >= 0.60, "recognisable").otherwise("not_found")


def render(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template
