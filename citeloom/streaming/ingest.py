"""Stream-shaped behaviour: resumable ingest without repeats, a running health gate, first concessions.

Windows over event time are an extension; the rest has a batch equivalent with equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State stores that keep what transformWithState needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as they come; zone-less times become instants, which watermarks need."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    naive = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(naive) if naive else df


def once(df: DataFrame, key: str, at: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen before. With a time column, keys are forgotten beyond the delay; without one they
    are kept in the query's state store for good, so that what was done before a restart stays done."""
    return df.withWatermark(at, delay).dropDuplicatesWithinWatermark([key]) if at else df.dropDuplicates([key])


def ingest(df: DataFrame, path: str, checkpoint: str):
    """Append to a table, to the end of what is there; after a stop it goes on where the checkpoint says."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def gate(df: DataFrame, failed: str, checkpoint: str, max_share: float = 0.2, at_least: int = 40) -> list[bool]:
    """Health after each micro-batch over all rows so far; stops the stream at the first failure. The totals are a
    streaming aggregate: they live in the state store under the checkpoint and go on after a restart."""
    said: list[bool] = []
    totals = df.groupBy().agg(F.count_if(F.col(failed)).alias("errors"), F.count("*").alias("total"))

    def look(batch: DataFrame, _: int) -> None:
        errors, total = batch.head() or (0, 0)
        said.append(total < at_least or errors <= max_share * total)
        if not said[-1]:
            raise RuntimeError(f"{errors} of {total} failed")

    q = totals.writeStream.outputMode("complete").foreachBatch(look).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return said


class _Encounter(StatefulProcessor):
    """Turns of one encounter as they come: state is how many counted, and at which it conceded; later ones are ignored."""

    def __init__(self, key: str, kind: str, turn: str, conceded: str) -> None:
        self.key, self.kind, self.turn, self.conceded = key, kind, turn, conceded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("encounter", "turns long, reached long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turns, reached = self.state.get() if self.state.exists() else (0, None)
        said = sorted((int(t), bool(c)) for frame in rows for t, c in zip(frame[self.turn], frame[self.conceded], strict=True))
        if reached is None:
            for turn, conceded in said:
                turns += 1
                if conceded:
                    reached = turn
                    break
            self.state.update((turns, reached))
            yield pd.DataFrame({self.key: [key[0]], "turns": [turns], "turn_reached": pd.array([reached], dtype="Int64")})

    def close(self) -> None:
        pass


def encounters(turns: DataFrame, key: str, turn: str, conceded: str) -> DataFrame:
    """A row for each encounter and micro-batch that adds to it: turns until the first concession, and that turn. After
    it nothing counts, also across restarts. Turns of an encounter come in order. Needs the RocksDB state store."""
    kind = dict(turns.dtypes)[key]
    made = turns.select(key, turn, conceded).groupBy(key)
    return made.transformWithStateInPandas(_Encounter(key, kind, turn, conceded), f"{key} {kind}, turns long, turn_reached long", "Update", "None")


def first_concession(turns: DataFrame, key: str, turn: str, conceded: str) -> DataFrame:
    """For each encounter its turns, and the first at which it conceded (null: never)."""
    return turns.groupBy(key).agg(F.count("*").alias("turns"), F.min(F.when(F.col(conceded), F.col(turn))).alias("turn_reached"))


def tumbling(df: DataFrame, at: str, width: str, by: str) -> DataFrame:
    """Extension: counts by window of event time and kind, late rows up to the width."""
    return df.withWatermark(at, width).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
