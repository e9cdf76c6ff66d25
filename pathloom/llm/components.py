"""Connected components by contraction inside tasks and large-star and small-star steps over an edge table.

In each round tasks of at most ``LOCAL_EDGES`` edges replace theirs by stars around the least node of each component
that they can see; if more than one task was needed, a large-star and a small-star step (aggregations and joins) carry
the least nodes on between them. Nothing is collected but a convergence digest. Nodes with so many edges that they
would weigh on one task are joined by broadcast: there are at most ``HOT_NODES`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.workspace import discard, fresh_path, saved

LOCAL_EDGES = 100_000  #: edges that a task holds at once
HOT_NODES, HOT_EDGES = 50_000, 1_000  #: a node is hot from HOT_EDGES and from its 2/HOT_NODES of all edges on


def _least_beside(edges: DataFrame, rows: int) -> DataFrame:
    """(a, b, m): every edge with the least node beside its ``a`` (or ``a`` itself); ``rows`` bounds the edges' number."""
    found = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
    most = max(HOT_EDGES, -(-rows // HOT_NODES))
    hot = found.where(F.col("n") > most).select("a", "m")  # fewer than rows / most, which is at most HOT_NODES
    cold = found.where(F.col("n") <= most).select("a", "m")
    return edges.join(F.broadcast(hot), "a").union(edges.join(F.broadcast(hot.select("a")), "a", "left_anti").join(cold, "a")).select("a", "b", "m")


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of each one's component, by hooking roots to smaller ones and halving paths."""
    nodes, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        hooked = label.copy()
        np.minimum.at(hooked, label[x], least)
        np.minimum.at(hooked, label[y], least)
        while (hooked[hooked] != hooked).any():
            hooked = hooked[hooked]
        if (hooked == label).all():
            return nodes, nodes[label]
        label = hooked


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends, held = ([], []), 0

    def star() -> pa.RecordBatch:
        node, root = contracted(*(np.concatenate(x) for x in ends))
        return pa.RecordBatch.from_arrays([pa.array(node[node != root]), pa.array(root[node != root])], names=["a", "b"])

    for batch in batches:
        for k in (0, 1):
            ends[k].append(batch.column(k).to_numpy())
        held += batch.num_rows
        if held >= 2 * LOCAL_EDGES:
            yield star()
            ends, held = ([], []), 0
    if held:
        yield star()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    ``edges`` has two bigint columns; direction, repeats and self-loops don't matter, and rows with a null end
    are ignored. An empty table gives an empty result. Nodes without a proper edge don't appear.
    """
    a, b = edges.columns[:2]
    spark = edges.sparkSession
    current = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    paths = [fresh_path(spark, "components")]
    current, digest = saved(current, "components", paths[0]), None
    rows = current.count()

    def step(df: DataFrame) -> DataFrame:
        paths.append(fresh_path(spark, "components"))
        out = saved(df, "components", paths[-1])
        discard(spark, paths.pop(-2))
        return out

    for _ in range(max_rounds if rows else 0):
        tasks = -(-rows // LOCAL_EDGES)
        current = step(current.repartition(tasks).mapInArrow(_stars, "a long, b long"))
        if tasks == 1:
            break
        both = current.union(current.select("b", "a"))
        large = _least_beside(both, 2 * rows).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # a node's edges all lead to smaller ones now
        small = _least_beside(large, 2 * rows).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        current = step(small.select("e.a", "e.b").where("a <> b").distinct())
        row = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == digest:
            break
        digest, rows = (row["n"], row["h"]), row["n"]
    else:
        if rows:
            raise RuntimeError("connected components did not converge")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
