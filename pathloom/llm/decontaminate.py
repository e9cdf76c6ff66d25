"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

Items are partitioned by size (distinct five-word shingles, classes of powers of two). A class decides how many values
of a bottom-k MinHash sketch its items keep (``sketch_width``: whole small items, then more values for larger ones) and
how many of them a document must hold (``needed``), so that a truly contained item is missed with probability under
1e-7 (never, where the sketch is whole). Since the sketch samples the short item and not the long document, the share
of its values that a document holds estimates containment whatever the document's length. Items of one shingle set are
searched once. Candidates are verified on the exact shingle strings of both sides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.workspace import Scratch, saved

WIDTH = 5
WHOLE = 32  #: items of up to this many shingles are searched by all of them
BROADCAST_BYTES = 64_000_000  #: sketches or shingles; a larger table is joined by shuffle
CLASSES = 40  #: size classes; items of more than 2**CLASSES shingles don't exist
_MISS = 1e-7


def _words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")


def _shingled(words: Column, whole) -> Column:
    """``whole`` of each run of WIDTH words; of all words, if they are fewer; none of no words."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: whole([F.get(words, i + k) for k in range(WIDTH)]))
    return F.when(n >= WIDTH, runs).when(n > 0, F.array(whole([F.array_join(words, " ")]))).otherwise(F.array())


def _key(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def _key_of(shingle: Column) -> Column:
    """``_key`` of the words of a shingle's text."""
    parts = F.split(shingle, " ")
    return F.when(F.size(parts) == WIDTH, _key([parts[k] for k in range(WIDTH)])).otherwise(_key([shingle]))


def _text(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def sketch_width(size_class: int) -> int:
    """Sketch values of items of 2**(size_class - 1) + 1 to 2**size_class shingles."""
    return min(2**size_class, max(WHOLE, 4 * (size_class + 1)))


def needed(width: int, threshold: float) -> int:
    """Values of a sketch of ``width`` that a document must hold: the binomial tail below stays under the miss bound.

    Values are drawn without replacement, whose tail so far under the mean is smaller than the binomial one.
    """
    tail, count = 0.0, 0
    while True:
        tail += math.comb(width, count) * threshold**count * (1 - threshold) ** (width - count)
        if tail > _MISS:
            return max(count, 1)
        count += 1


def _maybe_broadcast(df: DataFrame, text: str | None = None) -> DataFrame:
    held = df.agg(F.count("*") * 64 + (F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if text else 0)).first()[0]
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def _contained(docs: DataFrame, items: DataFrame, threshold: float, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(k1, k2, item_id, shared, n_item): item contained in the texts with this 128-bit key."""
    scratch = Scratch(docs.sparkSession)
    held = items.select(F.col(item_col).cast("long").alias("item_id"), _words(F.col(item_text_col)).alias("w")).where("item_id is not null")
    sets = held.select("item_id", F.explode(_shingled(F.col("w"), _text)).alias("shingle")).groupBy("item_id").agg(F.array_sort(F.collect_set("shingle")).alias("set"))
    # items of one shingle set go by the least id among them
    named = scratch.saved(sets.groupBy("set").agg(F.min("item_id").alias("of"), F.collect_list("item_id").alias("ids")), "item-sets")
    exact = scratch.saved(named.select("of", F.explode("set").alias("shingle")), "item-shingles")
    size_class = F.ceil(F.log2(F.size("set"))).cast("int")
    widths = [sketch_width(c) for c in range(CLASSES + 1)]
    by_class = named.select("of", F.size("set").alias("n"), size_class.alias("size_class"), F.array_sort(F.transform("set", _key_of)).alias("hashes"))
    sketched = by_class.withColumn("width", F.element_at(F.array(*map(F.lit, widths)), F.col("size_class") + 1))
    partial = F.element_at(F.array(*(F.lit(needed(w, threshold)) for w in widths)), F.col("size_class") + 1)
    need = F.when(F.col("n") <= F.col("width"), F.ceil(F.col("n") * threshold - 1e-9)).otherwise(partial)
    sketches = scratch.saved(sketched.select("of", need.cast("int").alias("need"), F.explode(F.slice("hashes", 1, F.col("width"))).alias("h")), "item-sketches")
    keys = [F.xxhash64(text_col).alias("k1"), F.xxhash64(F.lit(7), text_col).alias("k2")]
    texts = docs.where(F.col(text_col).isNotNull()).select(*keys, F.col(text_col).alias("text"))
    # words are a column of their own, or the split would run again for every shingle
    rows = texts.select("k1", "k2", _words(F.col("text")).alias("w")).select("k1", "k2", F.explode(_shingled(F.col("w"), _key)).alias("h"))
    hits = rows.join(_maybe_broadcast(sketches), "h")
    found = hits.groupBy("k1", "k2", "of", "need").agg(F.count_distinct("h").alias("held"))
    candidates = scratch.saved(found.where("held >= need").select("k1", "k2", "of"), "candidates")
    suspects = texts.join(candidates.select("k1", "k2").distinct(), ["k1", "k2"])
    strings = suspects.select("k1", "k2", _words(F.col("text")).alias("w")).select("k1", "k2", F.explode(_shingled(F.col("w"), _text)).alias("shingle"))
    shared = strings.join(_maybe_broadcast(exact, "shingle"), "shingle").groupBy("k1", "k2", "of").agg(F.count_distinct("shingle").alias("shared"))
    sizes = named.select("of", F.size("set").cast("long").alias("n_item"), "ids")
    verified = shared.join(candidates, ["k1", "k2", "of"]).join(sizes, "of").where(F.col("shared") >= F.col("n_item") * threshold - 1e-9)
    done = saved(verified.select("k1", "k2", F.explode("ids").alias("item_id"), "shared", "n_item"), "contained")
    scratch.clear()
    return done


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, shared, n_item): one row per document row and item it contains.

    An item is contained when at least ``threshold`` of its distinct five-word shingles occur in the document
    (words: lower-cased runs of letters, marks and digits; fewer than five words make one shingle, which only an
    equally short document can hold). Null, empty or wordless texts and items match nothing, as do items with a
    null id; a document with a null id is reported under null. Items that repeat an id are taken together. Empty
    tables give an empty result; other columns are not read.
    """
    found = _contained(docs, items, threshold, text_col, item_col, item_text_col)
    keyed = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("k1"), F.xxhash64(F.lit(7), text_col).alias("k2"))
    return keyed.join(found, ["k1", "k2"]).select(F.col("doc").alias(id_col), "item_id", "shared", "n_item")


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose text contains no item; null texts stay."""
    found = _contained(docs, items, threshold, text_col, item_col, item_text_col).select("k1", "k2").distinct()
    keyed = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)), F.xxhash64(text_col).alias("k1"), F.xxhash64(F.lit(7), text_col).alias("k2"))
    return keyed.join(found, ["k1", "k2"], "left_anti").select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))
