"""The text functions under SQL names: scalar functions, and table functions for LATERAL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import extract as E
from citeloom.functions import similarity as S
from citeloom.functions import text as X
from citeloom.operators import grade as G
from citeloom.session import ship

_SPAN = T.StructType().add("text", "string").add("start", "integer").add("end", "integer")
_INFIX = T.StructType().add("similarity", "double").add("start", "integer").add("end", "integer")
_ATTEMPT = T.StructType().add("attempt", "string").add("method", "string").add("similarity", "double")


@F.pandas_udf(_INFIX)
def _infix(needles: pd.Series, texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([S.infix(a or "", b or "") for a, b in zip(needles, texts, strict=True)], columns=_INFIX.names)


@F.pandas_udf(_ATTEMPT)
def _attempt(responses: pd.Series, truths: pd.Series) -> pd.DataFrame:
    rows = (G.measure(a or "", b or "", []) for a, b in zip(responses, truths, strict=True))
    return pd.DataFrame([(m[0], m[1], m[3]) for m in rows], columns=_ATTEMPT.names)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _grams(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else sorted(S.grams(t)))


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([S.similarity(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.ArrayType(_SPAN))
def _references(texts: pd.Series, names: pd.Series) -> pd.Series:
    """names: map from a book's name to its code; of a row each."""
    known: dict[tuple, E.References] = {}
    out = []
    for text, codes in zip(texts, names, strict=True):
        key = tuple(sorted(dict(codes or {}).items()))
        if key not in known:
            known[key] = E.References(dict(key))
        out.append([dict(zip(_SPAN.names, x, strict=True)) for x in known[key].find(text or "")])
    return pd.Series(out)


class _Spans:
    find = staticmethod(E.quotes)

    def eval(self, text: str):
        yield from self.find(text or "")


class _Quotes(_Spans):
    pass


class _Sentences(_Spans):
    find = staticmethod(E.sentences)


class _Verses(_Spans):
    find = staticmethod(E.verse_spans)


_VERSE = T.StructType().add("anchor", "string").add("extent", "integer").add("text", "string").add("raw", "string")

#: SQL names: scalar functions, table functions.
SCALAR = {
    "text_strict": X.strict_udf, "text_loose": X.loose_udf, "is_refusal": X.refusal_udf, "json_in": X.json_udf, "best_infix": _infix, "best_attempt": _attempt, "char_grams": _grams,
    "span_similarity": _similarity, "quotes_of": E.quotes_udf, "sentences_of": E.sentences_udf, "references_of": _references,
}
TABLE = {"quote_spans": (_Quotes, _SPAN), "sentence_spans": (_Sentences, _SPAN), "verse_spans": (_Verses, _VERSE)}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions with the session; returns their names."""
    ship(spark)
    for name, f in SCALAR.items():
        spark.udf.register(name, f)
    for name, (kind, schema) in TABLE.items():
        spark.udtf.register(name, F.udtf(kind, returnType=schema, useArrow=True))
    return [*SCALAR, *TABLE]
