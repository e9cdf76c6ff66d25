"""Ordered-sequence helpers of guidance: runs of equal values and maneuver kinds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.paths import pack, unpack

RUNS = "trip_id long, island long, street string, metres double, edges long"


class Streets:
    """Street and length of each edge as tasks hold them."""

    def __init__(self, edge: np.ndarray, street: pa.Array, length: np.ndarray):
        order = np.argsort(edge, kind="stable")
        coded = street.dictionary_encode()
        self.names, codes = coded.dictionary, coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.edge, self.code, self.length = edge[order], codes.astype(np.int32)[order], length[order]

    @classmethod
    def of(cls, edges: DataFrame, most: int):
        """Broadcast (edge_id, street, length), or None beyond ``most`` edges."""
        if edges.count() > most:
            return None
        held = edges.toArrow().combine_chunks()
        columns = [held.column(k).combine_chunks() for k in range(3)]
        return edges.sparkSession.sparkContext.broadcast(cls(columns[0].to_numpy(), columns[1], columns[2].to_numpy(zero_copy_only=False)))

    def __getstate__(self) -> dict:
        return {"names": self.names, **{k: pack(self.__dict__[k]) for k in ("edge", "code", "length")}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = {"names": state["names"], **{k: unpack(state[k]) for k in ("edge", "code", "length")}}

    def runs(self, trip: int, arcs: np.ndarray) -> pa.RecordBatch:
        """Runs of equal streets along a path; a null street begins a run of its own, as in ``runs``."""
        at = np.searchsorted(self.edge, arcs)
        code = self.code[at]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (code[1:] < 0)]))
        street = self.names.take(pa.array(code[first], mask=code[first] < 0)).cast(pa.string())
        metres, n = np.add.reduceat(self.length[at], first), np.diff(np.append(first, len(code)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), trip), pa.int64()), pa.array(np.arange(1, len(first) + 1), pa.int64()), street, pa.array(metres), pa.array(n, pa.int64())], names=["trip_id", "island", "street", "metres", "edges"])


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``df`` with ``island``: the number, from 1, of the run of equal values that a row is in."""
    w = Window.partitionBy(key).orderBy(*order)
    change = F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn("island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


#: What a maneuver is called by its turn type.
NAMES = {0: "continue", 1: "slight right", 2: "right", 3: "sharp right", 4: "u-turn", 5: "sharp left", 6: "left", 7: "slight left"}


def instruction(kind: str, street: str) -> str:
    """English instruction text as an expression."""
    cases = " ".join(f"WHEN {k} THEN '{'Continue on ' if k == 0 else 'Make a ' + v + ' onto ' if k == 4 else 'Turn ' + v + ' onto '}'" for k, v in NAMES.items())
    return f"((CASE {kind} {cases} END) || {street} || '.')"


def collapse(maneuvers: DataFrame, shortest: float) -> DataFrame:
    """(trip_id, island, street, metres, parts): maneuvers (trip_id, island, street, metres) with short ones joined on.

    One shorter than ``shortest`` metres goes to the nearest longer one before it, or to the first longer one of the
    trip; a trip of short ones stays as it is. The street is that of the maneuver that stays.
    """
    w = Window.partitionBy("trip_id").orderBy("island")
    long = F.when(F.col("metres") >= shortest, F.col("island"))
    whole = Window.partitionBy("trip_id")
    held = maneuvers.withColumn("_to", F.coalesce(F.last(long, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.min(long).over(whole), F.col("island")))
    street = F.max(F.when(F.col("island") == F.col("_to"), F.col("street"))).alias("street")
    return held.groupBy("trip_id", F.col("_to").alias("island")).agg(street, F.sum("metres").alias("metres"), F.count("*").alias("parts"))


def roundabout_exits(path: DataFrame, edges: DataFrame) -> DataFrame:
    """(trip_id, first, exit): for each run of roundabout edges of a path, the number of the exit that it takes.

    ``path`` has (trip_id, seq, edge_id, roundabout); every drivable edge out of the run's nodes that is no roundabout
    counts as an exit, in the order in which the run passes their nodes, the last one being taken.
    """
    held = runs(path, "trip_id", ["seq"], "roundabout").where("roundabout")
    ends = held.join(edges.select("edge_id", "dst"), "edge_id")
    outs = edges.where("NOT roundabout").groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("n"))
    met = ends.join(outs, "dst", "left").groupBy("trip_id", "island").agg(F.min("seq").alias("first"), F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.max_by("n", "seq"), F.lit(0)).alias("last"))
    return met.select("trip_id", "first", (F.col("all") - F.col("last") + F.least("last", F.lit(1))).alias("exit"))
