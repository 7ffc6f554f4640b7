"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, stored

_EDGE = "a long, b long"
#: Edges that one task takes: some 3 MB, ten times that while it works.
ONE_TASK = 200_000


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars that a part of the edges already forms: at most an edge a node goes on."""
    for b in batches:
        a, c = (b.column(k).to_numpy() for k in (0, 1))
        nodes, at = np.unique(np.concatenate([a, c]), return_inverse=True)
        u, v = at[: len(a)], at[len(a) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            np.minimum.at(new, label[u], low)
            np.minimum.at(new, label[v], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        other = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], ["a", "b"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_local`` for all batches of a task together."""
    got = [b for b in batches if b.num_rows]
    if got:
        yield from _local(iter([pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(k) for b in got]) for k in (0, 1)], ["a", "b"])]))


def components(edges: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK, reduced: bool = False) -> DataFrame:
    """node, component (its smallest node) for the nodes of the edges (columns a, b).

    Up to ``one_task`` edges, 16 bytes each, are one task's work; more go through rounds of stars, in which
    the aggregates are written before they are joined, so that Spark can split a large star. ``reduced``:
    the tasks that gave the edges have seen to it that they are few.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    e = stored((e if reduced else e.mapInArrow(_local, _EDGE)).distinct(), "edges")
    if e.count() <= one_task:
        done = stored(e.coalesce(1).mapInArrow(_whole, _EDGE), "edges")
        discard(e)
        return _labels(done)
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "stars")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        down = stored(down, "down")
        low2 = stored(down.groupBy("a").agg(F.min("b").alias("m")), "stars")
        small = down.join(low2, "a")
        small = small.select("b", "m").filter("b <> m").unionByName(low2.select(F.col("a").alias("b"), "m"))
        new = stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        for x in (e, low, down, low2):
            discard(x)
        e = new
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return _labels(e)


def _labels(e: DataFrame) -> DataFrame:
    """All nodes of edges that lead to their components' smallest nodes."""
    top = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(top.select("node", F.col("node").alias("component")))
