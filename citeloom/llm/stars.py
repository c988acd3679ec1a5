"""Components of a similarity graph from buckets of candidates, without all pairs of a bucket.

Each bucket is a star: members are checked against one centre. What is connected by then needs no
further check. Buckets whose members are still in several components get other centres for some rounds;
what is left then is checked pair by pair, between components only and where a sketch allows a link. So no
link is lost that could join two components, and a bucket of thousands of similar members costs thousands
of checks, not their square.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import arrow_map, settle
from citeloom.llm.components import components

#: Rounds with other centres before what is left is checked pair by pair.
MAX_ROUNDS = 2


def _around_centres(batches):
    """Of rows sorted by bucket and id: those of buckets of two ids or more, once each, with the first one as centre."""
    last, centre, waiting = None, None, None  # bucket and first row of the group at hand; that row, while it is alone
    before = None  # bucket and id of the last row
    for b in batches:
        if not b.num_rows:
            continue
        ids, buckets = b["id"], b["bucket"]
        again = pc.and_(pc.equal(ids[1:], ids[:-1]), pc.equal(buckets[1:], buckets[:-1]))
        first = pa.array([(buckets[0].as_py(), ids[0].as_py()) != before])
        before = buckets[-1].as_py(), ids[-1].as_py()
        b = b.filter(pa.concat_arrays([first, pc.invert(again)]))
        n = b.num_rows
        if not n:
            continue
        bucket = b["bucket"].to_numpy(zero_copy_only=False)
        new = np.concatenate([[last is None or bucket[0] != last], bucket[1:] != bucket[:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: the group began before
        joined = int((begin < 0).sum())
        if joined and waiting is not None:
            yield pa.RecordBatch.from_arrays([*waiting.columns, waiting["id"], waiting["n"]], names=_STAR)
        size = np.bincount(begin[joined:], minlength=n)
        keep = np.concatenate([np.arange(joined), np.nonzero(size[begin[joined:]] > 1)[0] + joined])
        old = [centre] * joined if joined else []
        ids = pa.concat_arrays([pa.array([x[0] for x in old], b.schema.field("id").type), b["id"].take(pa.array(begin[joined:]))])
        sizes = pa.concat_arrays([pa.array([x[1] for x in old], b.schema.field("n").type), b["n"].take(pa.array(begin[joined:]))])
        take = pa.array(keep)
        if len(keep):
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns), ids.take(take), sizes.take(take)], names=_STAR)
        last = bucket[-1]
        if begin[-1] >= 0:
            first = int(begin[-1])
            centre = b["id"][first].as_py(), b["n"][first].as_py()
            waiting = b.slice(first, 1) if first == n - 1 else None
        else:
            waiting = None


_STAR = ["bucket", "id", "n", "centre", "centre_n"]


def stars(rows: DataFrame) -> DataFrame:
    """bucket, id, n, centre, centre_n of the rows (bucket long, id, n) whose bucket has other ids, repeated rows
    once; one shuffle, sorted, and constant memory however large a bucket is."""
    kinds = dict(rows.dtypes)
    dealt = rows.select("bucket", "id", "n").repartition("bucket").sortWithinPartitions("bucket", "id")
    return settle(arrow_map(dealt, _around_centres, f"bucket long, id {kinds['id']}, n {kinds['n']}, centre {kinds['id']}, centre_n {kinds['n']}"), "stars")


def linked(members: DataFrame, confirm: Callable[[DataFrame], DataFrame], close: Callable[[str, str], Column], sketches: Callable[[DataFrame], DataFrame] | None = None, alike: Callable[[str, str], Column] | None = None) -> DataFrame:
    """(id, component) of all ids with a link; component is the least id reachable.

    members: what stars() gives. confirm(pairs (a, b), a > b) keeps the linked pairs. close(n, n) tells
    whether two sizes allow a link at all, alike(sketch, sketch) whether the sketches do. sketches(ids)
    gives id, sketch, bands (all buckets of the id, so that a pair is met in the first bucket it shares only);
    they are made for ids that are left to be checked pair by pair, of which there are few.
    """
    tested = settle(members.where("id <> centre").where(close("n", "centre_n")).select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")
    links = settle(confirm(tested), "links")
    for k in range(MAX_ROUNDS + 1):
        label = components(links)
        open_ = members.select("bucket", "id", "n").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
        spread_ = open_.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("bucket")
        rest = settle(open_.join(spread_, "bucket"), "rest")
        parts = rest.groupBy("bucket", "component").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("within"))
        pairs, rows = parts.agg(F.sum((F.col("all") * F.col("all") - F.col("within")) / 2), F.sum("all")).head()
        if not pairs:
            break
        if sketches is not None:
            rest = rest.join(settle(sketches(settle(rest.select("id").distinct(), "left")), "sketches"), "id")
        kept = ["bucket", "id", "n", "component"] + (["sketch", "bands"] if sketches is not None else [])
        last = k == MAX_ROUNDS or pairs <= 200 * rows
        if last:
            other = rest
        else:
            turn = rest.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), *kept)).alias("c"))
            other = settle(turn.select("bucket", *[f"c.{x}" for x in kept[1:]]), "turn")
        other = other.select(*[F.col(x).alias(f"{x}_2") for x in kept])
        fits = close("n", "n_2") & (F.col("component") < F.col("component_2") if last else F.col("component") != F.col("component_2"))
        if alike is not None:
            fits = fits & alike("sketch", "sketch_2")
            if last:
                fits = fits & (F.element_at(F.array_intersect("bands", "bands_2"), 1) == F.col("bucket"))
        more = rest.join(other, (F.col("bucket") == F.col("bucket_2")) & fits)
        more = settle(more.select(F.greatest("id", "id_2").alias("a"), F.least("id", "id_2").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "more")
        links = links.unionByName(settle(confirm(more), "links"))
        tested = tested.unionByName(more)
        if last:
            return components(links)
    return label
