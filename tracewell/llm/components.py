"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.store import HOT_PART, discard, shuffles_for, spread_join, written


#: Edges that a task contracts at a time.
CHUNK = 1 << 19


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable by the edges (a, b)) of every node but those least ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        # roots take the least root at the other end of an edge, then paths are halved until they are stars
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low < high
        x, y = x[open_], y[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def stars() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        found = least_reachable(*(table.column(c).to_numpy() for c in ("a", "b")))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield stars()
            held = []
    if held:
        yield stars()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for every node that has an edge (a, b) to another; root is the least node reachable. rows: how many edges there are, if known.

    Each round links every node to the least of its neighbours, by an aggregate with map-side combine and a join that deals the edges of
    hot nodes over many tasks, so a star of any size is no group in one task. Rounds grow with the logarithm of the longest path;
    a graph that is all stars around their least nodes takes none. Before each round tasks contract what edges they read, in chunks, to stars;
    that keeps the components and saves rounds. Once all edges fit into one chunk (CHUNK, 8 MB) the task that contracts it ends the work. Partitions follow the number of edges. Ends are longs.
    Edges are written to the shared folder between rounds. Null ends and loops are dropped; repeated edges count once.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    edges = edges.mapInArrow(_contracted, "a long, b long")
    with shuffles_for(spark, rows) if rows is not None else nullcontext():
        edges = written(edges if rows is not None and rows <= CHUNK else edges.distinct(), "edges")
    while total := 2 * edges.count():
        if total <= 2 * CHUNK:
            older, edges = edges, written(edges.coalesce(1).mapInArrow(_contracted, "a long, b long"), "edges")
            discard(older)
            break
        with shuffles_for(spark, total):
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
            # stars are left when no node with a smaller neighbour has another one; hot nodes are fewer than HOT_PART
            hot = F.collect_list(F.when(F.col("n") * HOT_PART > total, F.col("a")))
            unfinished, hot = least.agg(F.count_if((F.col("m") < F.col("a")) & (F.col("n") > 1)), hot).first()
            if not unfinished:
                break
            least = least.select("a", F.least("a", "m").alias("m"))
            large = spread_join(both, least, "a", hot, "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            # a node has here as many edges as it has smaller neighbours' least ones
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = spread_join(large, least, "a", hot, "b")
            small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            older, edges = edges, written(small.select("e.a", "e.b").where("a <> b").mapInArrow(_contracted, "a long, b long").distinct(), "edges")
            discard(older)
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._tracewell_path = edges._tracewell_path
    return out
