"""A passage store: verses by edition on any file system, beside a catalogue of the chapters each edition has.

The table is partitioned by edition, so what asks for one edition reads its folder only. The catalogue tells apart
what an edition lacks from what was not fetched yet: the first is empty, the second an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import extract as E
from citeloom.operators import reference as Q
from citeloom.session import settle, ship, spread

VERSES = "edition int, chapter string, ref string, extent int, text string, raw string"


def chapter_of(ref: Column) -> Column:
    return F.substring_index(Q.clean(ref), ".", 2)


class PassageStore:
    """verses: edition, chapter, ref, extent, text, raw. chapters: edition, chapter, canonical."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def verses(self) -> DataFrame:
        return self.spark.read.schema(VERSES).option("basePath", f"{self.path}/verses").parquet(f"{self.path}/verses")

    @property
    def chapters(self) -> DataFrame:
        """Chapters that are known: of the canon, and no introductions."""
        c = self.spark.read.parquet(f"{self.path}/chapters")
        return c.where("canonical and chapter like '%.%' and chapter not like '%INTRO%'").select("edition", F.upper("chapter").alias("chapter")).distinct()

    def catalogue(self, chapters: DataFrame) -> None:
        chapters.select("edition", "chapter", F.coalesce("canonical", F.lit(True)).alias("canonical")).write.mode("overwrite").parquet(f"{self.path}/chapters")

    def fetch(self, pages: DataFrame) -> DataFrame:
        """pages: edition, chapter, html. Parses chapters into verses and adds those that the store lacks; returns
        edition, chapters and verses of what was added. A chapter without verses is kept as one row without reference,
        so that it counts as fetched."""
        ship(self.spark)
        have = self.fetched() if self._exists() else None
        new = pages.select("edition", F.upper("chapter").alias("chapter"), "html").dropDuplicates(["edition", "chapter"])
        new = new.join(have, ["edition", "chapter"], "left_anti") if have is not None else new
        rows = spread(new).withColumn("v", E.verse_spans_udf("html")).select("edition", "chapter", F.explode_outer("v").alias("v"))
        rows = rows.select("edition", "chapter", F.upper("v.anchor").alias("ref"), "v.extent", "v.text", "v.raw")
        rows = settle(rows, "fetched")  # the store is read to find what it lacks, so counts and rows are fixed before it is added to
        rows.repartition("edition", "chapter").write.mode("append").partitionBy("edition").parquet(f"{self.path}/verses")
        return rows.groupBy("edition").agg(F.countDistinct("chapter").alias("chapters"), F.count("ref").alias("verses"))

    def _exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/verses")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def fetched(self) -> DataFrame:
        return self.verses.select("edition", "chapter").distinct()

    def edition(self, edition: int) -> DataFrame:
        """All verses of an edition that stand alone: ref, text; merged ones and anchors of another form go."""
        v = self.verses.where(F.col("edition") == edition)
        return v.where("extent = 1").where(Q.is_verse(F.col("ref"))).select("ref", "text")

    def chapter_verses(self, edition: int, chapter: str) -> DataFrame:
        """ref, text of the verses of a chapter that stand alone; empty for a chapter that the edition lacks, an error
        for one that was not fetched."""
        name = chapter.upper()
        asked = self.spark.sql(f"SELECT {int(edition)} AS edition").withColumn("chapter", F.lit(name))
        state = self.states(asked).head()["state"]
        if state == "uncached":
            raise LookupError(f"{name} of edition {edition} was not fetched")
        v = self.verses.where((F.col("edition") == edition) & (F.col("chapter") == name))
        return v.where("extent = 1").where(Q.is_verse(F.col("ref"))).select("ref", "text")

    def states(self, asked: DataFrame) -> DataFrame:
        """asked (edition, chapter) with state: present, uncached (known but not fetched) or absent (not in the edition)."""
        known, have = self.chapters.withColumn("known", F.lit(True)), self.fetched().withColumn("have", F.lit(True))
        a = asked.join(known, ["edition", "chapter"], "left").join(have, ["edition", "chapter"], "left")
        return a.withColumn("state", F.when(F.col("have"), "present").when(F.col("known"), "uncached").otherwise("absent")).drop("known", "have")

    def lookup(self, asked: DataFrame) -> DataFrame:
        """asked (edition, ref) with text and state: found; merged (it stands in a span of several verses); missing
        (its chapter has no such verse); absent; uncached; malformed (no verse reference). Only found has a text."""
        ref = Q.clean(F.col("ref"))
        a = asked.withColumn("__ref", ref).withColumn("chapter", chapter_of(F.col("ref")))
        v = self.verses.where("ref is not null").select("edition", F.col("ref").alias("__ref"), "extent", F.col("text").alias("__text")).groupBy("edition", "__ref").agg(F.max("extent").alias("extent"), F.min("__text").alias("__text"))
        a = self.states(a).join(v, ["edition", "__ref"], "left")
        state = F.when(~Q.is_verse(F.col("ref")) | F.col("ref").isNull(), "malformed").when(F.col("state") != "present", F.col("state")).when(F.col("extent").isNull(), "missing").when(F.col("extent") > 1, "merged").otherwise("found")
        a = a.withColumn("state", state).withColumn("text", F.when(F.col("state") == "found", F.col("__text")))
        return a.select(*asked.columns, "text", "state")


def own_editions(editions: DataFrame, duplicates: DataFrame, language: str | None = None, include_duplicates: bool = False) -> DataFrame:
    """Editions (language, edition) of a language or of all, without those that repeat another's text."""
    e = editions.where(F.col("language") == language) if language else editions
    e = e.select("language", "edition").distinct()
    return e if include_duplicates else e.join(duplicates.select("edition").distinct(), "edition", "left_anti").select("language", "edition")


def repeated_editions(verses: DataFrame) -> DataFrame:
    """edition, of: editions whose whole text an edition of a lower number has, too. A text is a sum over digests of its
    verses, so that no edition is gathered in one place."""
    word = lambda k: F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"d{k}")
    h = verses.where("ref is not null").select("edition", F.sha2(F.concat_ws("\t", "ref", "text"), 256).alias("h"))
    whole = h.groupBy("edition").agg(F.count("*").alias("n"), *map(word, range(4)))
    least = whole.groupBy("n", "d0", "d1", "d2", "d3").agg(F.min("edition").alias("of"))
    return whole.join(least, ["n", "d0", "d1", "d2", "d3"]).where("edition <> of").select("edition", "of")
