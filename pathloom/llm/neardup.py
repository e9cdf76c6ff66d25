"""MinHash near-duplicate detection with tensored banding.

Documents with the same shingle set form one class. A class gets m small hash collections of ``WIDTH`` minhashes
each; a table key is a pair of collections, so m*(m-1)/2 tables cost only m*WIDTH minhashes. A pair of similarity s
shares a key unless fewer than two collections agree; m is the least number that makes this rarer than ``MISS`` at
the threshold: 12 collections at 0.85 (7e-6), 15 at 0.80 (6e-6).

Within a bucket, classes whose 64-value sketches agree in at least ``sketch_least`` places (five standard
deviations under the mean at the threshold: 40 at 0.85, 35 at 0.80) are joined breadth-first, which emits a spanning
forest instead of pairs. The connected clusters of that graph hold all links. Full shingle sets confirm them in blocks
of bounded size (an incidence product a block):

* clusters that fit into a block are compared whole, many small ones together;
* in a larger cluster the forests' edges are confirmed in runs; if it is then in one piece it is done. Of any other,
  all classes outside its largest part are compared with all of the cluster, block by block.

Texts of classes in clusters are taken out of the corpus once: a bitmap of ``MARKS`` words, which is broadcast, lets
few others through to the join that finds them.

The confirmed links are closed by connected components. Shingle keys are 64-bit hashes of five lower-cased words with
non-linear steps, so two different shingles are taken for one with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import textkit
from pathloom.llm.components import connected_components
from pathloom.llm.workspace import Scratch, saved

WIDTH, MISS, LEAST_COLLECTIONS = 2, 1e-5, 12
SKETCH, MOST_PLACES = 64, 40
BUCKET_ROWS = 20_000  #: a larger bucket is dealt out as pairs of blocks
BLOCK_ROWS, BLOCK_SHINGLES = 400, 4_000_000  #: classes and shingles of one block when full sets are compared
COLUMNS = 4096  #: shingles of one incidence product
PART = 4096  #: shingles that are hashed together
MARKS = 1 << 18  #: words of 64 bits that mark the ids whose texts are compared

_FLIP = np.random.RandomState(11).randint(0, 2**32, SKETCH, dtype=np.uint64).astype(np.uint32)
_SCALE = np.random.RandomState(12).randint(0, 2**31, SKETCH, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_SKETCHED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("collections", pa.list_(pa.int64())), ("sketch", pa.binary())])


def collections(percent: int) -> int:
    """The least number of collections that misses a pair at the threshold with a probability of at most MISS, LEAST_COLLECTIONS or more."""
    agree = (percent / 100) ** WIDTH
    for m in range(LEAST_COLLECTIONS, SKETCH // WIDTH + 1):
        if (1 - agree) ** m + m * agree * (1 - agree) ** (m - 1) <= MISS:
            return m
    raise ValueError(f"{SKETCH} minhashes are too few for the miss probability at {percent} percent")


def sketch_least(percent: int) -> int:
    """Places of the sketches in which a pair at the threshold agrees, less five standard deviations, at most MOST_PLACES."""
    s = percent / 100
    return min(MOST_PLACES, math.floor(SKETCH * s - 5 * math.sqrt(SKETCH * s * (1 - s))))


def _minhashes(shingles: np.ndarray) -> np.ndarray:
    """The least of each of SKETCH functions over a set, a part of the set at a time."""
    least = np.full(SKETCH, 2**32 - 1, np.uint32)
    for at in range(0, len(shingles), PART):
        part = (shingles[at : at + PART] >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, ((part[:, None] ^ _FLIP) * _SCALE).min(axis=0), out=least)
    return least


def _signatures(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            data, offs = textkit.utf8(batch.column(1))
            for row, end, part, part_offs in textkit.pieces(data, offs):
                keys, _, _, word_offs = textkit.words(part, part_offs)
                sets = textkit.shingles(keys, word_offs)
                digests, groups, sketches = [], np.zeros((len(sets), m), np.int64), []
                for k, s in enumerate(sets):
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    if len(s):
                        least = _minhashes(s)
                        groups[k] = least[: m * WIDTH].view(np.int64)
                        sketches.append((least >> np.uint32(24)).astype(np.uint8).tobytes())
                    else:
                        sketches.append(b"")
                lists = pa.ListArray.from_arrays(np.arange(0, groups.size + 1, m, dtype=np.int32), pa.array(groups.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists, pa.array(sketches, pa.binary())], schema=_SKETCHED)

    return run


def _spanned(sizes: np.ndarray, sketches: np.ndarray, threshold: float, least: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Spanning edges of the graph of rows that agree in ``least`` places and whose sizes allow the threshold."""
    left, right, waiting = [], [], np.arange(len(sizes))
    frontier: list[int] = []
    while len(waiting):
        if not frontier:
            frontier, waiting = [int(waiting[0])], waiting[1:]
            continue
        at = frontier.pop()
        near = (sketches[waiting] == sketches[at]).sum(axis=1) >= least
        near &= np.minimum(sizes[waiting], sizes[at]) >= threshold * np.maximum(sizes[waiting], sizes[at]) - 1e-9
        found = waiting[near]
        if len(found):
            left.append(np.full(len(found), at))
            right.append(found)
            frontier.extend(found.tolist())
            waiting = waiting[~near]
    return left, right


def _bucket_links(threshold: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket may go on in the next batch."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None else table
            key = rest.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            yield from linked(rest.slice(0, last))
            rest = rest.slice(last)
        if rest is not None:
            yield from linked(rest)

    def linked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        key, ids, sizes = (table.column(k).to_numpy() for k in range(3))
        sketches = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint8).reshape(-1, SKETCH)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        end = np.append(first[1:], len(key))
        # pairs in buckets of two at once, larger buckets one by one
        two = first[end - first == 2]
        near = (sketches[two] == sketches[two + 1]).sum(axis=1) >= least
        near &= np.minimum(sizes[two], sizes[two + 1]) >= threshold * np.maximum(sizes[two], sizes[two + 1]) - 1e-9
        left, right = [two[near]], [two[near] + 1]
        for a, b in zip(first, end, strict=True):
            if b - a > 2:
                found = _spanned(sizes[a:b], sketches[a:b], threshold, least)
                left += [a + x for x in found[0]]
                right += [a + x for x in found[1]]
        x, y = np.concatenate(left), np.concatenate(right)
        x, y = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
        if len(x):
            rows = np.unique(np.stack([ids[x], ids[y], sizes[x], sizes[y]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(4)], names=["a", "b", "na", "nb"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, node): the nodes of runs of edges that come sorted, a block for each run of bounded size."""
    from pyspark import TaskContext

    block, nodes, weight = TaskContext.get().partitionId() << 36, {}, 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block] * len(nodes), pa.int64()), pa.array(list(nodes), pa.int64())], names=["block", "node"])

    for batch in batches:
        for a, b, na, nb in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            more = {node: n for node, n in ((a, na), (b, nb)) if node not in nodes}
            if nodes and more and (len(nodes) + len(more) > BLOCK_ROWS or weight + sum(more.values()) > BLOCK_SHINGLES):
                yield done()
                block, nodes, weight = block + 1, {}, 0
                more = {a: na, b: nb}
            nodes |= more
            weight += sum(more.values())
    if nodes:
        yield done()


def _confirmed(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        data, offs = textkit.utf8(table.column("text").combine_chunks())
        sets: list[np.ndarray] = []
        for _, _, part, part_offs in textkit.pieces(data, offs):
            keys, _, _, word_offs = textkit.words(part, part_offs)
            sets += textkit.shingles(keys, word_offs)
        sizes = np.array([len(s) for s in sets], np.int64)
        shared, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(counts > 1) - 1
        row = np.repeat(np.arange(len(sets)), sizes)
        keep = counts[inverse] > 1
        row, column = row[keep], place[inverse[keep]]
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, (at, at + COLUMNS))
            incidence = np.zeros((len(sets), COLUMNS), np.float32)
            incidence[row[a:b], column[a:b] - at] = 1
            common += incidence @ incidence.T
        inter = common.astype(np.int64)
        near = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
        left, right, waiting = [], [], np.ones(len(ids), bool)
        for start in range(len(ids)):
            frontier = [start] if waiting[start] else []
            waiting[start] = False
            while frontier:
                at = frontier.pop()
                found = np.flatnonzero(near[at] & waiting)
                waiting[found] = False
                left += [ids[at]] * len(found)
                right += ids[found].tolist()
                frontier += found.tolist()
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def _texts_of(source: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of these ids, once each; an id may have several texts."""
    word = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
    bit = lambda c: F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(3, {c}), 64) AS INT))")
    marks = nodes.groupBy(word("node").alias("word")).agg(F.bit_or(bit("node")).alias("bits"))  # at most MARKS rows
    marked = source.join(F.broadcast(marks), word("doc_id") == F.col("word")).where(F.col("bits").bitwiseAND(bit("doc_id")) != 0)
    return marked.select(F.col("doc_id").alias("node"), "text").join(nodes.select("node"), "node", "left_semi").distinct()


def _verified(texts: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b): spanning edges of the true links within each block of ``members`` (block, node)."""
    return members.join(texts, "node").groupBy("block").applyInArrow(_confirmed(percent), "a long, b long")


def _links(source: DataFrame, rough: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): true links that join all classes which true links of any kind join within the clusters of ``rough``."""
    width = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rough.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("na").alias("n")), F.struct(F.col("b").alias("node"), F.col("nb").alias("n")))).alias("e")).groupBy("e.node").agg(F.max("e.n").alias("n"))
    clusters = scratch.saved(connected_components(rough.select("a", "b")).join(sizes, "node"), "clusters")
    texts = scratch.saved(_texts_of(source, clusters), "texts")
    weighed = clusters.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    fits = (F.col("rows") <= BLOCK_ROWS) & (F.col("n") <= BLOCK_SHINGLES)
    small = weighed.where(fits)
    total = small.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    bins = 1 + max(2 * total["rows"] // BLOCK_ROWS, 2 * total["n"] // BLOCK_SHINGLES)
    together = clusters.join(small.select("component"), "component", "left_semi").select(F.pmod(F.xxhash64("component"), F.lit(bins)).alias("block"), "node")
    links = scratch.saved(_verified(texts, together, percent), "links")
    large = weighed.where(~fits)
    if large.isEmpty():
        return links
    of = clusters.join(large.select("component"), "component", "left_semi")
    edges = rough.join(of.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b", "na", "nb")
    runs = edges.repartitionByRange(width, "a", "b").sortWithinPartitions("a", "b").mapInArrow(_runs, "block long, node long")
    found = scratch.saved(_verified(texts, scratch.saved(runs, "runs"), percent), "links")
    part = F.coalesce("part", "node").alias("part")
    parts = of.select("node", "n", F.col("component").alias("cluster")).join(connected_components(found).withColumnRenamed("component", "part"), "node", "left")
    parts = scratch.saved(parts.select("cluster", "node", "n", part), "parts")
    counts = parts.groupBy("cluster", "part").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    main = counts.groupBy("cluster").agg(F.max(F.struct("rows", "part")).getField("part").alias("main"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda inside: F.ceil(F.greatest(F.sum(F.when(inside, F.col("rows")).otherwise(0)) / BLOCK_ROWS, F.sum(F.when(inside, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("long")
    is_main = F.col("part") == F.col("main")
    dealt = counts.join(main, "cluster").groupBy("cluster", "main").agg(blocks(is_main).alias("m"), blocks(~is_main).alias("r"))
    placed = parts.join(dealt, "cluster").select("node", "cluster", "m", "r", is_main.alias("inner"), F.xxhash64("node").alias("h"))
    own = F.pmod(F.col("h"), F.col("r"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # blocks of the rest are 0 to r - 1, those of the main part follow; a pair of blocks has one of the rest
    inner = F.transform(upto(F.col("r")), lambda i: F.struct(i.alias("i"), (F.col("r") + F.pmod(F.col("h"), F.col("m"))).alias("j")))
    outer = F.transform(upto(F.col("r") + F.col("m")), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")))
    pairs = placed.select("node", "cluster", F.explode(F.when(F.col("inner"), inner).otherwise(outer)).alias("p"))
    members = pairs.select(F.struct("cluster", "p.i", "p.j").alias("block"), "node")
    return links.union(found).union(scratch.saved(_verified(texts, members, percent), "links"))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked when 100 * |A and B| >= percent * |A or B| over their distinct five-word shingles
    (fewer words: the whole sequence as one shingle); component_id is the smallest id reachable. A null or
    wordless text has no shingles, links with nothing and is its own component. Rows repeated with the same id
    are returned as often as they come and share a component, whatever their texts; a null id takes no part in
    links and gets a null component and kept = true. An empty table gives an empty result. Other columns of
    ``docs`` are not read. A linked pair shares no table with a
    probability of at most MISS; percent is 61 or more, a smaller one is an error.
    """
    threshold, m = percent / 100, collections(percent)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = saved(source.mapInArrow(_signatures(m), "doc_id long, n_shingles long, digest binary, collections array<long>, sketch binary"), "sketches")
    held = sketched.where("doc_id is not null")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = held.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "collections", "sketch")).alias("c"))
    classes = least.select("digest", F.col("c.doc_id").alias("rep"), F.col("c.n_shingles").alias("n"), F.col("c.collections").alias("g"), F.col("c.sketch").alias("sketch"))
    classes = saved(classes, "classes")
    tables = [F.xxhash64(F.lit(i * m + j), F.col("g")[i], F.col("g")[j]) for i in range(m) for j in range(i + 1, m)]
    # a class makes m * (m - 1) / 2 rows: dealt to as many tasks as the session has, each counts a small part of them
    keyed = classes.select("rep", "g").repartition(width, "rep").select("rep", F.explode(F.array(*tables)).alias("key"))
    scratch = Scratch(docs.sparkSession)
    sizes = scratch.saved(keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "buckets")
    shared = keyed.join(sizes, "key").select("rep", F.col("key"), F.ceil(F.col("rows") / BUCKET_ROWS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = shared.select("rep", F.explode(F.when(F.col("blocks") <= 1, F.array("key")).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.xxhash64("key", F.least(own, x), F.greatest(own, x))))).alias("key"))
    rows = dealt.join(classes.select("rep", "n", "sketch"), "rep").select("key", "rep", "n", "sketch")
    linked = rows.repartition(width, "key").sortWithinPartitions("key", "rep").mapInArrow(_bucket_links(threshold, sketch_least(percent)), "a long, b long, na long, nb long")
    rough = scratch.saved(linked.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb")), "rough")
    joined = connected_components(_links(source, rough, percent, scratch).union(_repeated(held)))
    scratch.clear()
    named = classes.select("digest", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    full = sketched.join(named, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return full.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", (F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id"))).alias("kept"))


def _repeated(held: DataFrame) -> DataFrame:
    """Ids that come with several shingle sets tie the classes of those sets together."""
    digests = held.where("n_shingles > 0").groupBy("doc_id", "digest").count()
    least = held.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    several = digests.groupBy("doc_id").count().where("count > 1").select("doc_id")
    return digests.join(several, "doc_id", "left_semi").join(least, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
