"""Content-addressed token store.

Every document's id stream (with an end id) is cut where a rolling hash over a window of ids ends in zero bits, so
equal passages give equal chunks wherever they stand. A chunk is stored once under the hash of its bytes
(``chunks``: chunk_id, width in bytes of an id, data); a document is a recipe of chunk ids with its place in the global
stream, in ascending id order, and the Merkle root over them (``recipes``). ``manifest`` holds a Merkle root over each
file range's documents and, as part -1, one over all ranges. Reading re-hashes every chunk, follows the recipes and
checks every root.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.bpe import Encoder, text_groups, vocabulary
from pathloom.llm.workspace import discard, fresh_path, shared_dir

WINDOW, MEAN_BITS = 16, 8  #: ids under the rolling hash; a cut every 2**8 ids on average
LEAST, MOST = 64, 1024  #: ids of a chunk; LEAST is over WINDOW, so that a cut never looks into the document before
END = 0
SEEN = 400_000  #: chunk ids that a task remembers, so as not to write a chunk again; beyond them it starts anew
LIBRARY_WORDS = 1000  #: pre-tokens that the library takes at once
PLACES, HELD_IDS = 1 << 21, 8_000_000  #: what a worker remembers of them
_ID = 16  #: bytes of a chunk id

_BASE = 0xA0761D6478BD642F
_ID_KEY = np.random.RandomState(5).randint(1, 2**62, 1 << 16).astype(np.uint64)
_tables: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    if len(_tables.get(name, ())) < n:
        step = np.full(n + 65536, base, np.uint64)
        step[0] = 1
        _tables[name] = np.cumprod(step, dtype=np.uint64)
    return _tables[name][:n]


def _rolling(ids: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW ids that end at each place (fewer at the start)."""
    n = len(ids)
    keys = _ID_KEY[ids & 0xFFFF] ^ (ids.astype(np.uint64) >> np.uint64(16))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(keys * _power(pow(_BASE, -1, 2**64), n, "down"), out=total[1:])
    window = total[1:].copy()
    window[WINDOW:] -= total[1 : n + 1 - WINDOW]
    return window * _power(_BASE, n, "up")


def cuts(ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, document) of each chunk of documents that lie end to end with these offsets, in order."""
    marks = np.append(np.flatnonzero(_rolling(ids) >> np.uint64(64 - MEAN_BITS) == 0) + 1, len(ids))
    documents = np.flatnonzero(np.diff(offs))
    at, last = offs[documents], offs[documents + 1]
    begins, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at):  # the next chunk of every document that goes on
        begins.append(at)
        owners.append(documents)
        at = np.minimum(np.minimum(marks[np.minimum(np.searchsorted(marks, at + LEAST), len(marks) - 1)], at + MOST), last)
        going = at < last
        at, last, documents = at[going], last[going], documents[going]
    begin, owner = np.concatenate(begins), np.concatenate(owners)
    order = np.argsort(begin)
    return begin[order], owner[order]


def _hash(data: bytes) -> bytes:
    return blake2b(data, digest_size=_ID).digest()


class MerkleTree:
    """Root of a binary hash tree over leaves that come one by one; an odd node moves up alone.

    Holds one node a level. Without leaves the root is the hash of nothing.
    """

    def __init__(self) -> None:
        self.level: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        node = _hash(b"\0" + leaf)
        for k, held in enumerate(self.level):
            if held is None:
                self.level[k] = node
                return
            self.level[k], node = None, _hash(b"\1" + held + node)
        self.level.append(node)

    def root(self) -> bytes:
        node = None
        for held in self.level:
            if held is not None:
                node = held if node is None else _hash(b"\1" + held + node)
        return node or _hash(b"")


def merkle(leaves: list[bytes]) -> bytes:
    if len(leaves) == 1:
        return _hash(b"\0" + leaves[0])
    tree = MerkleTree()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def _library_words(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    sizes = vocabulary(path).token_size

    def encode(words: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # a blank and a sign that is no space begin a pre-token wherever they stand: such words need no list of their own
        second = words[np.minimum(offs[:-1] + 1, len(words) - 1)]
        plain = (np.diff(offs) > 1) & (words[offs[:-1]] == 32) & (second > 32) & (second < 127)
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        size = np.diff(offs)[order]
        ends = np.cumsum(size)
        joined = words[np.repeat(offs[order] - ends + size, size) + np.arange(ends[-1])]
        edges = np.append(np.arange(0, int(plain.sum()), LIBRARY_WORDS), plain.sum())
        places = np.concatenate(([0], ends))
        texts = [joined[places[a] : places[b]].tobytes().decode() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        begin = int(plain.sum())
        others = pa.StringArray.from_buffers(len(order) - begin, pa.py_buffer((places[begin:] - places[begin]).astype(np.int32)), pa.py_buffer(joined[places[begin] :])).to_pylist()
        lists = [others[k : k + LIBRARY_WORDS] for k in range(0, len(others), LIBRARY_WORDS)]
        found = [*tokenizer.encode_batch_fast(texts, add_special_tokens=False), *tokenizer.encode_batch_fast(lists, is_pretokenized=True, add_special_tokens=False)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in found])
        spelled = np.cumsum(sizes[ids])  # a word ends where its bytes do
        at = np.searchsorted(spelled, ends) + 1
        if (spelled[at - 1] != ends).any():
            raise ValueError("the library's ids do not spell the text")
        counts = np.diff(at, prepend=0)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        mine = counts[place]
        total = np.cumsum(mine)
        return ids[np.repeat((at - counts)[place] - total + mine, mine) + np.arange(total[-1])], np.concatenate(([0], total))

    special = {t.content: k for k, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    return Encoder(encode, special, PLACES, HELD_IDS)


_encoders: dict[str, Encoder] = {}


def library_encoder(path: str) -> Encoder:
    """The tokenizers library behind a table of what it gave: it encodes each distinct pre-token once."""
    if path not in _encoders:
        _encoders[path] = _library_words(path)
    return _encoders[path]


def _binary(data: bytes | memoryview, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data)])


_ENCODED = "doc_id long, n_tokens long, recipe binary, root binary, new_ids array<binary>, new_chunks array<binary>"


def _chunked(path: str, width: int):
    """A row for each document; its chunks that this task hasn't met come with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_encoder(path)
        seen: set[bytes] = set()
        for batch in batches:
            for row, end, data, offs in text_groups(batch, 1):
                ids, at = coder.encode_bytes(data, offs)
                counts = np.diff(at)
                stream = np.full(len(ids) + len(counts), END, f"<u{width}")
                stream[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                begin, owner = cuts(stream, at + np.arange(len(at)))
                edges = np.append(begin, len(stream)) * width
                view = memoryview(stream).cast("B")
                bounds = edges.tolist()
                names = [blake2b(view[a:b], digest_size=_ID).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                first = np.searchsorted(owner, np.arange(len(counts) + 1))
                places = first.tolist()
                roots = [merkle(names[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]
                if len(seen) > SEEN:
                    seen.clear()
                new = []
                for k, name in enumerate(names):
                    if name not in seen:
                        seen.add(name)
                        new.append(k)
                picked = np.array(new, np.int64)
                sizes = np.diff(edges)[picked]
                ends = np.concatenate(([0], np.cumsum(sizes)))
                flat = np.frombuffer(view, np.uint8)
                if len(new) < len(names):
                    flat = flat[np.repeat(edges[picked] - ends[:-1], sizes) + np.arange(ends[-1])]
                lists = np.searchsorted(owner[picked], np.arange(len(counts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, end - row),
                        pa.array(counts + 1),
                        _binary(b"".join(names), first * _ID),
                        pa.array(roots, pa.binary()),
                        pa.ListArray.from_arrays(lists, _binary(b"".join([names[k] for k in new]), np.arange(len(new) + 1) * _ID)),
                        pa.ListArray.from_arrays(lists, _binary(flat, ends)),
                    ],
                    names=["doc_id", "n_tokens", "recipe", "root", "new_ids", "new_chunks"],
                )

    return run


def _started(before: dict[int, int]):
    """Each row's first id in the global stream: those of the ranges before, and of the rows before in its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        for batch in batches:
            part, n = batch.column(4).to_numpy(), batch.column(1).to_numpy()
            start = np.zeros(len(n), np.int64)
            for p in np.unique(part).tolist():
                own = part == p
                ends = at.get(p, before[p]) + np.cumsum(n[own])
                start[own], at[p] = ends - n[own], int(ends[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(start), *(batch.column(k) for k in range(1, 5))], names=["doc_id", "start", "n_tokens", "recipe", "root", "part"])

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row's whole text, append END and write chunks, recipes and manifest under ``path``.

    A null text counts as empty (one chunk with the end id). Rows are ordered by id, null ids first, equal ids by
    their length and chunks; repeated rows get a recipe each and share chunks. Other columns are not read. An empty
    table writes empty tables.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    staging = fresh_path(spark, "encoded")
    width = 2 if len(vocabulary(tokenizer).token_bytes) <= 1 << 16 else 4
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    source.mapInArrow(_chunked(tokenizer, width), _ENCODED).write.option("compression", "zstd").parquet(staging)
    encoded = spark.read.parquet(staging)
    met = encoded.select(F.explode(F.arrays_zip("new_ids", "new_chunks")).alias("c")).select(F.col("c.new_ids").alias("chunk_id"), F.col("c.new_chunks").alias("data"))
    # dealt and sorted once; each task has met its own chunks once already, so there's nothing to merge before
    once = met.repartition(parts, "chunk_id").sortWithinPartitions("chunk_id").dropDuplicates(["chunk_id"])
    once.select("chunk_id", F.lit(width).cast("tinyint").alias("width"), "data").write.option("compression", "zstd").parquet(f"{path}/chunks")
    order = ["doc_id", "n_tokens", "recipe"]
    ranged = encoded.select("doc_id", "n_tokens", "recipe", "root").repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).checkpoint()
    before, total = {}, 0
    for row in ranged.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # one row a range
        before[row["part"]], total = total, total + row["n"]
    recipes = ranged.mapInArrow(_started(before), "doc_id long, start long, n_tokens long, recipe binary, root binary, part int")
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    discard(spark, staging)
    ranges = _ranges(spark.read.parquet(f"{path}/recipes")).orderBy("start").collect()  # one row a range
    whole = (-1, 0, sum(r["n_tokens"] for r in ranges), sum(r["documents"] for r in ranges), _whole(ranges))
    spark.createDataFrame([tuple(r) for r in ranges] + [whole], _RANGE).coalesce(1).write.parquet(f"{path}/manifest")


_RANGE = "part int, start long, n_tokens long, documents long, root binary"


def _leaf(*numbers: int) -> bytes:
    return b"".join(x.to_bytes(8, "little", signed=True) for x in numbers)


def _whole(ranges: list) -> bytes:
    return merkle([_leaf(r["part"], r["start"], r["n_tokens"], r["documents"]) + bytes(r["root"]) for r in ranges])


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A Merkle root over the documents of each range; rows come sorted by range and start."""
    now, tree, start, end, documents = None, MerkleTree(), 0, 0, 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([x], pa.int64()) for x in (start, end - start, documents)), pa.array([tree.root()], pa.binary())], names=["part", "start", "n_tokens", "documents", "root"])

    for batch in batches:
        columns = (batch.column(k).to_pylist() for k in range(5))
        for part, at, n, doc, root in zip(*columns, strict=True):
            if part != now:
                if now is not None:
                    yield done()
                now, tree, start, end, documents = part, MerkleTree(), at, at, 0
            if at != end:
                raise ValueError(f"the recipes of range {part} have a gap at {end}")
            tree.add(_leaf(at, n, -(2**63) if doc is None else doc) + root)
            end, documents = at + n, documents + 1
    if now is not None:
        yield done()


def _ranges(recipes: DataFrame) -> DataFrame:
    """One row a file range, with the Merkle root over its documents; only roots and places are shuffled."""
    parts = int(recipes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = recipes.select("part", "start", "n_tokens", "doc_id", "root")
    return leaves.repartition(parts, "part").sortWithinPartitions("part", "start").mapInArrow(_rooted, _RANGE)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """crc32 and number of each chunk's ids as little-endian 32-bit integers, once its hash is found right."""
    for batch in batches:
        names = batch.column(0).to_pylist()
        data = batch.column(2).cast(pa.large_binary())
        offs = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        view = memoryview(data.buffers()[2]).cast("B") if len(data) and data.buffers()[2] is not None else memoryview(b"")
        sums, counts = [], []
        for name, width, a, b in zip(names, batch.column(1).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            own = view[a:b]
            if blake2b(own, digest_size=_ID).digest() != name:
                raise ValueError(f"chunk {name.hex()} does not match its content")
            counts.append((b - a) // width)
            sums.append(zlib.crc32(own if width == 4 else np.frombuffer(own, f"<u{width}").astype("<u4")))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64()), pa.array(counts, pa.int64())], names=["chunk_id", "crc", "n"])


def _shift_table() -> np.ndarray:
    """[n, bit]: what ``bit`` of a crc32 becomes when n little-endian 32-bit ids follow."""
    if "shift" not in _tables:
        polynomial = 0xEDB88320
        word = np.zeros(32, np.uint64)
        for bit in range(32):
            x = 1 << bit
            for _ in range(32):
                x = (x >> 1) ^ (polynomial if x & 1 else 0)
            word[bit] = x
        rows = [np.uint64(1) << np.arange(32, dtype=np.uint64)]
        for _ in range(MOST):
            rows.append(_shift(rows[-1], word))
        _tables["shift"] = np.array(rows)
    return _tables["shift"]


def _shift(crc: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for bit in range(32):
        out ^= np.where((crc >> np.uint64(bit)) & np.uint64(1), columns[..., bit], np.uint64(0))
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents from their chunks' sums, which come in order: crc32 of a concatenation from the parts' sums."""
    table = _shift_table()
    for batch in batches:
        lists = batch.column(4)
        own = lists.flatten()
        names, sums, counts = own.field("chunk_id").to_pylist(), own.field("crc"), own.field("n")
        if sums.null_count or None in names:
            raise ValueError("a chunk of a recipe is missing")
        sums, counts = sums.to_numpy().astype(np.uint64), counts.to_numpy()
        offs = lists.offsets.to_numpy().astype(np.int64)
        offs = offs - offs[0]
        chunks = np.diff(offs)
        crc = np.zeros(len(chunks), np.uint64)
        rows = np.arange(len(chunks))
        for k in range(int(chunks.max(initial=0))):
            rows = rows[chunks[rows] > k]
            at = offs[rows] + k
            crc[rows] = _shift(crc[rows], table[counts[at]]) ^ sums[at]
        total = np.add.reduceat(counts, offs[:-1]) if len(chunks) else counts
        wrong = np.flatnonzero(total != batch.column(2).to_numpy())
        places = offs.tolist()
        if len(wrong) or [merkle(names[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)] != batch.column(3).to_pylist():
            raise ValueError("a document does not match its recipe")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc.astype(np.int64)), pa.array(chunks)], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks"])


def _verified_recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes, once every range's root and the root of the whole are found right."""
    recipes = spark.read.parquet(f"{path}/recipes")
    held = {r["part"]: r for r in spark.read.parquet(f"{path}/manifest").collect()}  # one row a range
    found = _ranges(recipes).orderBy("start").collect()
    if -1 not in held or _whole(found) != bytes(held[-1]["root"]) or [tuple(r) for r in found] != [tuple(held.get(r["part"], ())) for r in found]:
        raise ValueError("recipes do not match the manifest")
    return recipes


def _references(recipes: DataFrame) -> DataFrame:
    chunk = F.transform(F.sequence(F.lit(0), (F.octet_length("recipe") / _ID).cast("int") - 1), lambda k: F.substring(F.col("recipe"), k * _ID + 1, F.lit(_ID)))
    return recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode(chunk).alias("seq", "chunk_id"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_chunks) of every document, from the stored chunks.

    Chunks are re-hashed where they lie; only their sums travel to the recipes. A root that differs raises an error
    at once; a chunk or document that is missing or doesn't match its hash fails the job.
    """
    recipes = _verified_recipes(spark, path)
    sums = spark.read.parquet(f"{path}/chunks").select("chunk_id", "width", "data").mapInArrow(_checked, "chunk_id binary, crc long, n long")
    met = _references(recipes).join(sums, "chunk_id", "left").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("seq", "chunk_id", "crc", "n"))).alias("own"))
    return met.select("doc_id", "start", "n_tokens", "root", "own").mapInArrow(_joined, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks long")


def read_ids(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, ids array<int>) of every document, or of those whose doc_id is in ``only``.

    Verified like ``read_digests``: roots at once, chunks and documents as they are read.
    """
    recipes = _verified_recipes(spark, path)
    if only is not None:
        recipes = recipes.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
    chunks = spark.read.parquet(f"{path}/chunks")
    met = _references(recipes).join(chunks, "chunk_id", "left").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("seq", "chunk_id", "width", "data"))).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for root, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if any(c["data"] is None or _hash(c["data"]) != c["chunk_id"] for c in own) or merkle([c["chunk_id"] for c in own]) != root:
                    raise ValueError("a document does not match its recipe")
                ids.append(np.concatenate([np.frombuffer(c["data"], f"<u{c['width']}").astype(np.int32) for c in own]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return met.select("doc_id", "start", "root", "own").mapInArrow(run, "doc_id long, start long, ids array<int>")


def store_path(spark: SparkSession) -> str:
    return fresh_path(spark, "tokens")
