"""Exact top-k inner-product search over norm-bucketed vectors.

Vectors are ranked by length, longest first, and cut into buckets of ``BUCKET_ROWS`` by their global rank (prefix sums
of range totals), whatever the number of partitions. A block of queries first meets the bucket of the longest vectors,
which gives each query a threshold (its k-th best score so far). Buckets are then visited in order of length as long
as |q| * (longest vector of the bucket) reaches the threshold of a query in the block. Inside a bucket the local
cosine threshold t = threshold / (|q| * longest) picks the pruning: a low one takes the prefix of vectors long
enough (length pruning); a high one bounds the product by the query's largest coordinates and the Cauchy-Schwarz
rest (coordinate pruning). Every survivor's product is computed exactly.

A task takes one bucket and up to ``CHUNK`` query blocks, so a bucket that all queries visit is met by many tasks and
crosses the network once for ``CHUNK * QUERY_ROWS`` queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.workspace import saved, shared_dir

BUCKET_ROWS, QUERY_ROWS = 4096, 1024
CHUNK = 8  #: query blocks that meet a bucket in one task
BOUNDS = 4096  #: bucket lengths of a dimension that queries are compared with; between them more buckets are visited
FOCUS = 8  #: coordinates of the partial product
COSINE = 0.75  #: local threshold from which coordinates are pruned
GREATEST = 1e150  #: components are held to this, so that no length overflows
_EXACT = 2.0**52
_BLOCK = "dim int, block long, longest double, ids binary, matrix binary"
_LONG = 2**63 - 1


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block, its vectors longest first; rows (dim, block, vec_id, v) come sorted by dim and block."""
    ids: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    now: tuple[int, int] | None = None

    def block() -> pa.RecordBatch:
        key, matrix = np.concatenate(ids), np.concatenate(rows)
        length = _lengths(matrix)
        order = np.lexsort((key, -length))
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([float(length.max())]), pa.array([key[order].astype("<i8").tobytes()], pa.binary()), pa.array([matrix[order].astype("<f8").tobytes()], pa.binary())],
            names=["dim", "block", "longest", "ids", "matrix"],
        )

    for batch in batches:
        dim, number, key = (batch.column(k).to_numpy() for k in range(3))
        flat = batch.column(3).flatten().to_numpy()
        starts = np.concatenate(([0], np.cumsum(dim)))
        heads = np.flatnonzero(np.concatenate(([True], (dim[1:] != dim[:-1]) | (number[1:] != number[:-1])))[: len(dim)])
        for a, b in zip(heads, np.append(heads[1:], len(dim)), strict=True):
            if now != (int(dim[a]), int(number[a])):
                if ids:
                    yield block()
                ids, rows, now = [], [], (int(dim[a]), int(number[a]))
            ids.append(key[a:b])
            rows.append(flat[starts[a] : starts[b]].reshape(b - a, dim[a]))
    if ids:
        yield block()


def _lengths(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix * matrix).sum(axis=1))


def _products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products; beyond 2**52 by Python integers, held to the range of a long."""
    bound = _lengths(query).max() * _lengths(vectors).max() if len(vectors) else 0
    if bound < _EXACT:
        return (query @ vectors.T).astype(np.int64)
    big = [[max(-_LONG - 1, min(_LONG, sum(int(a) * int(b) for a, b in zip(q, v, strict=True)))) for v in vectors.tolist()] for q in query.tolist()]
    return np.array(big, np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= least)
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))][:k]


def _searched(q_ids, queries, v_ids, vectors, theta, k):
    """(query position, ids, scores) of each query's k best in a bucket that reach its threshold."""
    v_length, q_length = _lengths(vectors), _lengths(queries)
    reach = q_length * v_length[0]
    slack = 1e-9 * reach + 1e-6
    open_ = np.flatnonzero(reach + slack >= theta)
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(reach > 0, theta / reach, -1.0)
    sharp = open_[cosine[open_] >= COSINE]
    plain = open_[cosine[open_] < COSINE]
    if len(plain):
        need = np.where(q_length[plain] > 0, (theta[plain] - slack[plain]) / np.maximum(q_length[plain], 1e-300), -np.inf)
        long_enough = np.searchsorted(-v_length, -need, "right")
        most = int(long_enough.max())
        product = _products(queries[plain], vectors[:most])
        for row, q in enumerate(plain):
            scores, ids = product[row, : long_enough[row]], v_ids[: long_enough[row]]
            fit = (ids != q_ids[q]) & (scores >= theta[q])
            yield q, *_cut(scores[fit], ids[fit], k)
    for q in sharp:
        focus = np.argsort(-np.abs(queries[q]))[:FOCUS]
        near = vectors[:, focus]
        rest_q = np.sqrt(max(0.0, q_length[q] ** 2 - (queries[q, focus] ** 2).sum()))
        rest_v = np.sqrt(np.maximum(0.0, v_length**2 - (near * near).sum(axis=1)))
        fit = np.flatnonzero((near @ queries[q, focus] + rest_q * rest_v + slack[q] >= theta[q]) & (v_ids != q_ids[q]))
        scores = _products(queries[q : q + 1], vectors[fit])[0] if len(fit) else np.zeros(0, np.int64)
        high = scores >= theta[q]
        yield q, *_cut(scores[high], v_ids[fit][high], k)


def _cut(scores, ids, k):
    among = _best(scores, ids, k)
    return ids[among], scores[among]


def _blocks(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, dict]]:
    for row in table.to_pylist():
        yield row["block"], np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["matrix"], "<f8").reshape(-1, row["dim"]), row


def _first_met(k: int, bounds: dict[int, tuple[np.ndarray, np.ndarray, int]]):
    """Thresholds from the bucket of the longest vectors, and how many buckets a query block must still visit."""

    def run(asked: pa.Table, bucket: pa.Table) -> pa.Table:
        out = []
        for _, v_ids, vectors, _ in _blocks(bucket):
            for block, q_ids, queries, row in _blocks(asked):
                theta = np.full(len(q_ids), -np.inf)
                for q, _, scores in _searched(q_ids, queries, v_ids, vectors, theta.copy(), k):
                    if len(scores) == k:
                        theta[q] = scores[-1]
                length = _lengths(queries)
                need = np.where(length > 0, theta / np.where(length > 0, length, 1), -np.inf).min()
                at, longest, every = bounds[row["dim"]]
                short = np.flatnonzero(longest * (1 + 1e-9) + 1e-6 < need)
                out.append({"dim": row["dim"], "block": block, "ids": row["ids"], "matrix": row["matrix"], "theta": theta.astype("<f8").tobytes(), "visit": int(at[short[0]]) if len(short) else every})
        return pa.Table.from_pylist(out, schema=pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("matrix", pa.binary()), ("theta", pa.binary()), ("visit", pa.int64())]))

    return run


def _visited(k: int):
    def run(asked: pa.Table, bucket: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 3]
        for _, v_ids, vectors, _ in _blocks(bucket):
            for _, q_ids, queries, row in _blocks(asked):
                theta = np.frombuffer(row["theta"], "<f8")
                found += [(np.full(len(ids), q_ids[q]), ids, scores) for q, ids, scores in _searched(q_ids, queries, v_ids, vectors, theta, k)]
        return pa.table({name: pa.array(np.concatenate([f[n] for f in found]), pa.int64()) for n, name in enumerate(("query_id", "vec_id", "score"))})

    return run


def _met(asked: DataFrame, buckets: DataFrame, run, schema: str) -> DataFrame:
    """``run`` of every bucket and the query blocks, up to CHUNK at a time, that visit it (the first ``visit`` ones)."""
    chunk = F.floor(F.col("block") / CHUNK)
    here = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("bucket")
    queries = asked.withColumn("chunk", chunk).where("visit > 0").select("*", here(F.col("visit")))
    wanted = asked.groupBy("dim", chunk.alias("chunk")).agg(F.max("visit").alias("n")).where("n > 0").select("dim", "chunk", here(F.col("n")))
    vectors = buckets.withColumnRenamed("block", "bucket").join(wanted, ["dim", "bucket"]).select("dim", F.col("bucket").alias("block"), "ids", "matrix", "chunk", "bucket")
    keys = ["dim", "bucket", "chunk"]
    return queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(run, schema)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller id.

    Components become floor(factor * x) in double, held to GREATEST. Vectors that are null or empty, hold a null or a non-finite
    component, or have a null id take no part; a query meets vectors of its own dimension only, and no row of its
    own id. With fewer candidates all are returned; a query without candidates has no rows. A query id that comes with
    several vectors asks with the least of them (by the first component that differs); every row of an id is a
    candidate. Scores beyond a long are held to its range. Empty tables give an empty result; other columns are not
    read.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared_dir(spark)

    def usable(df: DataFrame) -> DataFrame:
        held = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")

        def whole(x):  # no fraction is left beyond 2**52, where floor() leaves the range of a long
            y = F.greatest(F.lit(-GREATEST), F.least(F.lit(GREATEST), x * factor))
            return F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y)

        return held.select("vec_id", F.transform("v", whole).alias("v"))

    def blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
        sized = df.select("vec_id", "v", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("norm"))
        order = [F.col("dim"), F.col("norm").desc(), F.col("vec_id"), F.col("v")]
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        ranged = sized.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("dim", "vec_id", "v", F.spark_partition_id().alias("part"), place.alias("place")).checkpoint()
        # a row for each range, and one more for each further dimension
        totals = ranged.groupBy("dim", "part").agg(F.min("place").alias("first"), F.count("*").alias("n")).orderBy("dim", "part").collect()
        before, offsets = {}, []
        for r in totals:
            offsets.append((r["dim"], r["part"], before.get(r["dim"], 0) - r["first"]))
            before[r["dim"]] = before.get(r["dim"], 0) + r["n"]
        start = F.broadcast(spark.createDataFrame(offsets, "dim int, part int, start long"))
        number = F.floor((F.col("place") + F.col("start")) / rows)
        dealt = ranged.join(start, ["dim", "part"]).select("dim", number.alias("block"), "vec_id", "v").repartition(parts, "dim", "block").sortWithinPartitions("dim", "block")
        return saved(dealt.mapInArrow(_packed, _BLOCK), name)

    buckets = blocks(usable(vectors), BUCKET_ROWS, "buckets")
    asked = blocks(usable(queries).groupBy("vec_id").agg(F.min("v").alias("v")), QUERY_ROWS, "queries")
    bounds = {}
    for r in buckets.groupBy("dim").agg((F.max("block") + 1).alias("n")).collect():  # one row a dimension
        step = -(-r["n"] // BOUNDS)
        some = buckets.where((F.col("dim") == r["dim"]) & (F.col("block") % step == 0)).select("block", "longest").orderBy("block").collect()  # at most BOUNDS
        bounds[r["dim"]] = (np.array([x["block"] for x in some]), np.array([x["longest"] for x in some]), r["n"])
    first = asked.select("dim", "block", "ids", "matrix", F.lit(1).cast("long").alias("visit"))
    seeded = saved(_met(first, buckets, _first_met(k, bounds), "dim int, block long, ids binary, matrix binary, theta binary, visit long"), "seeded")
    found = _met(seeded, buckets, _visited(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
