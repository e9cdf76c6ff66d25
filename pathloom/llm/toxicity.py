"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, strips accents and zero-width marks, maps look-alike letters to Latin and digits or signs that
stand for letters to those letters; everything else but letters becomes a space. The lexicon has a fixed seed and the
words and word beginnings whose document counts set toxic labels apart, learned from a bounded sample of labels.
A text's weight is the sum over matches outside exception phrases, divided by a slow function of its length, and
passes a logistic curve whose middle is calibrated on the same sample.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SAMPLE_TOXIC, SAMPLE_CLEAN = 6_000, 12_000  #: the bound on labelled rows that are learned from
FOLD_BYTES = 1_000_000  #: texts folded together
BEGINNINGS = range(4, 9)  #: lengths of word beginnings that may become entries
PURITY, EVIDENCE = 3.5, 25.0  #: least log-odds and log-likelihood ratio of a learned entry
SHARPNESS = 4.0  #: of the logistic curve

#: Fixed seed entries (whole words) and their weight.
SEED = ["asshole", "bastard", "bitch", "clown", "cretin", "disgusting", "dumbass", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless"]
SEED_WEIGHT = 4.0
#: Fixed exception phrases: entries inside them don't count.
EXCEPTIONS = ["class clown", "clown fish", "not stupid", "not worthless", "trash bag", "trash bin", "trash can"]
#: Fixed look-alikes: Cyrillic and Greek letters, digits and signs, and the Latin letters they stand for.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "и": "u", "й": "u", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ь": "b", "ү": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ł": "l", "ø": "o", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "!": "i", "€": "e",
}

_STOP = "\ue000"  #: a private-use mark between texts
_fold: dict[str, np.ndarray] = {}


def _table() -> np.ndarray:
    """Code point to folded code point; 0 deletes."""
    if "table" not in _fold:
        table = np.arange(0x110000, dtype=np.uint32)
        for code in [*range(0x3000), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800)]:
            char = chr(code)
            kind = unicodedata.category(char)
            base = unicodedata.normalize("NFKD", char)[0].lower()[:1]
            base = LOOKALIKES.get(char.lower()[:1], LOOKALIKES.get(base, base))
            if kind in ("Mn", "Me", "Cf"):
                table[code] = 0
            elif base and unicodedata.category(base)[0] == "L":
                table[code] = ord(base)
            else:
                table[code] = 32
        table[0xD800:0xE000] = 32
        table[ord(_STOP)] = ord(_STOP)
        _fold["table"] = table
    return _fold["table"]


def fold(texts: list[str]) -> list[str]:
    """Folded texts, each between two spaces."""
    joined = "".join(f" {t.replace(_STOP, ' ') if _STOP in t else t} {_STOP}" for t in texts)
    codes = _table()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    return codes[codes > 0].tobytes().decode("utf-32-le").split(_STOP)[:-1]


def _groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about FOLD_BYTES; null texts are empty."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + FOLD_BYTES, "right")))
        yield at, [t or "" for t in column.slice(at, end - at).to_pylist()]
        at = end


@dataclass(frozen=True)
class Model:
    entries: dict[str, float]  #: ' beginning' or ' whole word ' to weight
    exceptions: tuple[str, ...]
    middle: float

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            machine.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        machine.make_automaton()
        return machine


def density(machine, folded: str) -> float:
    """Weight of the matches outside exceptions over 1 + log2(1 + words / 100); one match per word start."""
    excused: list[tuple[int, int]] = []
    at: dict[int, float] = {}
    for end, (length, weight) in machine.iter(folded):
        start = end - length + 1
        if weight is None:
            excused.append((start, end))
        else:
            at[start] = max(weight, at.get(start, 0.0))
    if not at:
        return 0.0
    total, reach, spans = 0.0, -1, sorted(excused)
    k = 0
    for start in sorted(at):
        while k < len(spans) and spans[k][0] <= start:
            reach = max(reach, spans[k][1])
            k += 1
        if start >= reach:
            total += at[start]
    return total / (1 + math.log2(1 + folded.count(" ") / 100))


def _held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in _groups(batch.column(1)):
            labels = batch.column(0).slice(at, len(texts)).to_pylist()
            counts = (Counter(), Counter())
            for label, folded in zip(labels, fold(texts), strict=True):
                words = set(folded.split())
                counts[label].update({f" {w} " for w in words if 3 <= len(w) <= 40} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n})
            seen = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([counts[1][e] for e in seen], pa.int64()), pa.array([counts[0][e] for e in seen], pa.int64())], names=["entry", "toxic", "clean"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None) -> Model:
    """Lexicon and calibration from at most SAMPLE_TOXIC + SAMPLE_CLEAN labelled ids, chosen by a hash of the id.

    An id labelled twice counts as toxic if one label says so; null labels and ids are left out. Of an id with several
    texts the least one is read. Every entry that passes PURITY and EVIDENCE is learned. Without labels of both kinds
    the seed lexicon stands alone.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    marks = marks.where(usable if usable is not None else ~_held_out("id")).withColumn("h", F.xxhash64(F.lit(5), "id"))
    chosen = [r for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)) for r in marks.where(F.col("label") == label).orderBy("h", "id").limit(most).select("id", "label").collect()]
    spark = docs.sparkSession
    entries, middle = {f" {w} ": SEED_WEIGHT for w in SEED}, 1.0
    toxic = sum(r["label"] for r in chosen)
    clean = len(chosen) - toxic
    if not (toxic and clean):
        return Model(entries, tuple(EXCEPTIONS), middle)
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids
    ids = F.broadcast(spark.createDataFrame([(r["id"], r["label"]) for r in chosen], "id long, label int"))
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ids, "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text")
    counted = sample.mapInArrow(_count_entries, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
    rate = (F.col("a") + F.col("b")) / float(toxic + clean)
    evidence = 2 * (F.col("a") * F.log(F.col("a") / (rate * toxic)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (rate * clean))).otherwise(0.0))
    learned = counted.where("a > 0").select("entry", odds.alias("odds"), evidence.alias("evidence")).where((F.col("odds") >= PURITY) & (F.col("evidence") >= EVIDENCE)).collect()  # a few words of a bounded sample
    for r in sorted(learned, key=lambda r: (len(r["entry"]), r["entry"])):
        if not any(r["entry"][:n] in entries for n in range(2, len(r["entry"]))):
            entries[r["entry"]] = float(r["odds"])
    model = Model(entries, tuple(EXCEPTIONS), middle)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.automaton()
        for batch in batches:
            for at, texts in _groups(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([density(machine, f) for f in fold(texts)], pa.float64())], names=["label", "density"])

    weighed = sample.mapInArrow(weigh, "label int, density double").collect()
    return Model(entries, tuple(EXCEPTIONS), _middle([(r["density"], r["label"]) for r in weighed]))


def _middle(points: list[tuple[float, int]]) -> float:
    """The cut with the fewest errors, in the middle of the gap it falls in; above 0 so that no match is clean."""
    points = sorted(points)
    right = sum(1 for _, y in points if y == 0)  # all clean: cut above everything
    best, cut, below, seen = None, 1.0, 0, 0
    clean = right
    for k, (x, y) in enumerate(points):
        below += y == 0
        seen += 1
        following = points[k + 1][0] if k + 1 < len(points) else x + 2
        if following > x:
            errors = (clean - below) + (seen - below)
            if best is None or errors < best:
                best, cut = errors, (x + following) / 2
    return max(cut, 0.05)


def _scored(docs: DataFrame, model: Model, text_col: str, columns: list[str]) -> DataFrame:
    """These columns under the names c0, c1, ... and the score of the text; only texts and scores cross to Python."""

    @F.arrow_udf(DoubleType())
    def score_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = model.automaton()
        for column in columns:
            x = np.concatenate([np.zeros(0), *(np.array([density(machine, f) for f in fold(texts)]) for _, texts in _groups(column))])
            yield pa.array(1 / (1 + np.exp(-np.clip(SHARPNESS * (x - model.middle) / model.middle, -30, 30))))

    return docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(columns)), score_of(F.col(text_col)).alias("score"))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row.

    score is between 0 and 1, predicted is 1 from 0.5 on. A null or empty text scores as one without matches. A null
    id counts as held out. Repeated rows score alike; an empty table gives an empty result; other columns are not
    read.
    """
    scored = _scored(docs, model, text_col, [id_col]).withColumnRenamed("c0", id_col)
    return scored.select(id_col, _held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score under 0.5."""
    kept = _scored(docs, model, text_col, docs.columns).where("score < 0.5")
    return kept.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))
