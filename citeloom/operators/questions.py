"""Question sets of what does not exist: chapters and verses beyond the end, books that no edition has.

Draws are from the complement of what editions hold, and are the same for all of them; what an edition can be asked is
then a join with its own names, and a name that collides with one of its books is never asked for.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators import reference as Q

# Numerals of Chinese, Japanese and Korean script for the numbers that end a series.
NUMERALS = {2: "二", 3: "三", 4: "四"}
DIRECTIONS = ("affirm", "contradict")
KINDS = ("out_of_range_chapter", "out_of_range_verse", "fake_book", "absent_from_version")


def next_in_series(name: Column, last: Column) -> Column:
    """A numbered name with its number one higher: its first digit, of any script, if its value is `last`, else the
    numeral of it; empty if it has neither, or the digit is a nine. The digit stays in its script, as the next one follows it there."""
    digit = F.regexp_extract(name, r"(?U)(\d)", 1)
    place = F.instr(F.lit(_DIGITS), digit)
    value, raised = (place - 1) % 10, F.substr(F.lit(_DIGITS), place + 1, F.lit(1))
    at = F.instr(name, digit)
    bumped = F.concat(F.substr(name, F.lit(1), at - 1), raised, F.substr(name, at + 1))
    out = F.when((digit != "") & (value == last) & (value < 9), bumped)
    for n, sign in NUMERALS.items():
        if n + 1 in NUMERALS:
            found = F.instr(name, F.lit(sign))
            out = out.when((last == n) & (found > 0), F.concat(F.substr(name, F.lit(1), found - 1), F.lit(NUMERALS[n + 1]), F.substr(name, found + 1)))
    return F.coalesce(out, F.lit(""))


def _digits() -> str:
    """All decimal digits of the basic plane, script by script, from 0 to 9 each."""
    return "".join(chr(c) for c in range(0x30, 0x10000) if unicodedata.category(chr(c)) == "Nd")


_DIGITS = _digits()


def beyond(bounds: DataFrame, far: tuple[int, int] = Q.CHAPTER_OFFSETS) -> DataFrame:
    """kind, book, chapter, verse from the complement of bounds (book, chapter, max_verse): of each book a chapter just
    beyond its last or far beyond it, in turn, and in its longest chapter the verse as far beyond the end again."""
    chapters = bounds.groupBy("book").agg(F.max("chapter").alias("last"), F.max(F.struct("max_verse", (-F.col("chapter")).alias("c"))).alias("m"))
    pos = F.row_number().over(Window.orderBy("book")) - 1  # books are a few dozen
    c = chapters.withColumn("off", F.when(pos % 2 == 0, far[0]).otherwise(far[1]))
    a = c.select(F.lit(KINDS[0]).alias("kind"), "book", (F.col("last") + F.col("off")).alias("chapter"), F.lit(1).alias("verse"))
    b = c.select(F.lit(KINDS[1]).alias("kind"), "book", (-F.col("m.c")).alias("chapter"), (F.col("m.max_verse") + F.col("off")).alias("verse"))
    return a.unionByName(b)


def impossible_items(drawn: DataFrame, series: DataFrame, names: DataFrame, absent: DataFrame) -> DataFrame:
    """edition, kind, display of everything an edition is asked, distinct.

    drawn: kind, book, chapter, verse. series: book, last (its number). names: edition, book, name. absent: edition,
    book, name (a book that siblings have and it lacks). A fake book whose name, in any case, is one of the edition's
    own is left out, as is a name without a number; books that an edition does not name are not asked of it.
    """
    shown = lambda name, c, v: F.concat(name, F.lit(" "), c.cast("string"), F.lit(":"), v.cast("string"))
    real = drawn.join(names, "book").select("edition", "kind", shown(F.col("name"), F.col("chapter"), F.col("verse")).alias("display"))
    fake = series.join(names, "book").withColumn("fake", next_in_series(F.col("name"), F.col("last"))).where("fake <> ''")
    own = names.select("edition", F.lower("name").alias("own")).distinct()
    fake = fake.withColumn("own", F.lower("fake")).join(own, ["edition", "own"], "left_anti")
    fake = fake.select("edition", F.lit(KINDS[2]).alias("kind"), shown(F.col("fake"), F.lit(1), F.lit(1)).alias("display"))
    other = absent.select("edition", F.lit(KINDS[3]).alias("kind"), shown(F.col("name"), F.lit(1), F.lit(1)).alias("display"))
    return real.unionByName(fake).unionByName(other).distinct()


def probes(spec: DataFrame, base: str, n: int, seed: str) -> DataFrame:
    """language, clause, probe, direction, claim: n probes a clause, drawn once from the base language and the same in
    all languages and both directions. spec: language, clause, probe, affirm, contradict. A language that lacks a
    drawn probe fails the job, as its scores would not compare."""
    drawn = Q.draw(spec.where(F.col("language") == base).select("clause", "probe", F.concat_ws(":", "clause", F.col("probe").cast("string")).alias("key")), "clause", "key", n, seed).select("clause", "probe")
    rows, whole = spec.join(drawn, ["clause", "probe"]), drawn.count()
    has = rows.groupBy("language").agg(F.count("*").alias("has"))
    has = spec.select("language").distinct().join(has, "language", "left").select("language", F.coalesce("has", F.lit(0)).alias("has"))
    lacks = F.raise_error(F.concat(F.lit("probes are missing in "), F.col("language"))).cast("string")
    rows = has.join(rows, "language", "left")
    claim = lambda d: F.when((F.col("has") == whole) & F.col(d).isNotNull(), F.col(d)).otherwise(lacks)
    both = F.explode(F.array(*(F.struct(F.lit(d).alias("direction"), claim(d).alias("claim")) for d in DIRECTIONS)))
    return rows.select("language", "clause", "probe", both.alias("x")).select("language", "clause", "probe", "x.direction", "x.claim")


def human_reference(ref: Column, name: Column, english: Column) -> Column:
    """A reference under the edition's own name of the book, or the English one if it has none. A name all in capitals
    is written with a capital at each word's beginning only; words are runs of letters."""
    r = Q.parse(ref)
    own = F.coalesce(F.nullif(name, F.lit("")), english)
    loud = (F.upper(own) == own) & (F.lower(own) != own)
    words = F.transform(F.regexp_extract_all(own, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1000))))
    return Q.spoken(F.when(loud, F.array_join(words, "")).otherwise(own), r["book"], r["chapter"].cast("string"), r["verse"].cast("string"))
