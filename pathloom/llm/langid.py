"""Language identification by error-correcting output codes.

Each language has a codeword of bits (all columns for up to five languages, seeded random ones beyond). One linear
classifier a bit, a ridge fit over hashed byte n-grams of a bounded sample, predicts the bit with a margin; decoding
picks the language whose codeword has the least exponential loss over the margins, and a small lead over the
second flags the text as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from pathloom.llm import textkit

SAMPLE = 2_400  #: the bound on rows that are learned from, shared evenly by the languages
LANGUAGES = 300  #: the bound on languages that are learned: the most frequent ones
FEATURES = 1 << 12
GRAMS = (1, 2, 3, 4)
PIECE_BYTES, ROWS = 1_000_000, 500  #: texts whose features are made together
RIDGE = 0.05
LOSS = 3.0  #: scale of the margins in the exponential loss
LEAD = 0.15  #: a smaller relative lead in loss is ambiguous
LEAST_SHARE = 1.2  #: an ambiguous text stays from so many times 1/languages on

_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def _counts(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """Each row's counts of hashed n-grams; bytes of ASCII digits, signs and space count as one."""
    fold = np.arange(256, dtype=np.uint32)
    fold[:128] = 32
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    text = fold[data]
    shift = np.uint32(32 - int(math.log2(FEATURES)))
    slots = []
    run = np.zeros(len(text), np.uint32)
    for n in GRAMS:
        # run[i]: hash of the n bytes from i on
        run = text.copy() if n == 1 else run[: len(text) - n + 1] * np.uint32(16777619) ^ text[n - 1 :]
        slots.append((((run + np.uint32(n)) * _MIX[n - 1]) >> shift).astype(np.uint16))
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        own = np.concatenate([s[a : max(a, b - n + 1)] for n, s in zip(GRAMS, slots, strict=True)])
        yield np.bincount(own, minlength=FEATURES)


def _features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Square roots of hashed n-gram counts, to unit length."""
    out = np.zeros((len(offs) - 1, FEATURES), np.float32)
    for row, counts in enumerate(_counts(data, offs)):
        if counts.any():
            out[row] = np.sqrt(counts) / np.sqrt(counts.sum())
    return out


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language: every split of the languages for up to five, else random splits."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 5:
        columns = [[1 if (k >> row) & 1 else -1 for row in range(languages)] for k in range(1, 2 ** (languages - 1))]
        return np.array(columns).T
    rng = np.random.RandomState(3)
    bits = 4 * math.ceil(math.log2(languages)) + 7
    best = max((rng.choice([-1, 1], (languages, bits)) for _ in range(50)), key=lambda m: _distance(m))
    return best


def _distance(code: np.ndarray) -> int:
    apart = (code.shape[1] - code @ code.T) // 2
    return int((apart + np.eye(len(code), dtype=int) * code.shape[1]).min())


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray  #: (FEATURES + 1) x bits, the last row the intercept

    def decode(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, ambiguous) of each row."""
        margins = features @ self.weights[:-1] + self.weights[-1]
        loss = np.exp(-LOSS * np.clip(margins, -1.5, 1.5)[:, None, :] * self.code[None]).mean(axis=2)
        order = np.argsort(loss, axis=1, kind="stable")
        rows = np.arange(len(loss))
        least = loss[rows, order[:, 0]]
        chance = np.exp(-(loss - least[:, None]))
        score = 1 / chance.sum(axis=1)
        second = loss[rows, order[:, 1]] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return order[:, 0], score, (second - least) < LEAD * second


def _usable(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) != 1


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = textkit.utf8(batch.column(1))
        for row, end, part, part_offs in textkit.pieces(data, offs):
            slots, counts = [], []
            for own in _counts(part, part_offs):
                held = np.flatnonzero(own)
                slots.append(held.astype("<u2").tobytes())
                counts.append(own[held].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(slots, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "slots", "counts"])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: Column | None = None) -> Model | None:
    """A model from at most SAMPLE rows with text, letters and a language; None without any.

    Ids are chosen by their hash within each language; of an id that comes several times the least text is read. Of
    more than LANGUAGES languages the rarest ones (ties by name) aren't learned.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    source = source.where("doc_id is not null and lang is not null").where(usable if usable is not None else _usable())
    source = source.where("text rlike '\\\\p{L}'")  # before choosing: a text without letters takes no place
    counts = source.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    each = SAMPLE // len(counts)
    # the least hashes of a language lie under a limit that leaves about twice as many as are wanted
    limits = [(r["lang"], min(2**31, math.ceil(2**31 * (2 * each + 50) / r["count"]))) for r in counts]
    small = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, most long"))  # at most LANGUAGES rows
    place = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(2**31))
    near = source.join(small, "lang").where(place < F.col("most")).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    sample = near.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "text")
    rows = sample.mapInArrow(_feature_rows, "lang string, slots binary, counts binary").orderBy("lang", "slots", "counts").toArrow()
    if not rows.num_rows:
        return None
    named = rows.column("lang").to_pylist()
    languages = sorted(set(named))
    x = np.zeros((rows.num_rows, FEATURES), np.float32)
    for k, (slots, counts) in enumerate(zip(rows.column("slots"), rows.column("counts"), strict=True)):
        own = np.frombuffer(counts.as_buffer(), "<u4")
        x[k, np.frombuffer(slots.as_buffer(), "<u2")] = np.sqrt(own / own.sum())
    del rows
    at = np.array([languages.index(name) for name in named])
    code = codewords(len(languages))
    target = code[at].astype(float)
    share = np.bincount(at, minlength=len(languages)).astype(float)
    weight = np.sqrt(len(at) / (len(languages) * share[at]))[:, None]  # languages weigh alike
    x *= weight.astype(np.float32)
    gram = (x @ x.T).astype(np.float64)
    gram += weight * weight.T  # the intercept's
    gram[np.diag_indices(len(gram))] += RIDGE
    dual = np.linalg.solve(gram, target * weight)
    return Model(tuple(languages), code, np.vstack([x.T @ dual.astype(np.float32), (weight.T @ dual).astype(np.float32)]))


_JUDGED = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])


def _identified(docs: DataFrame, model: Model | None, text_col: str, columns: list[str]) -> DataFrame:
    """These columns under the names c0, c1, ... and ``j``, the judgement; only texts cross to Python."""

    @F.arrow_udf(_JUDGED)
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            best, score, ambiguous = [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0, bool)]
            data, offs = textkit.utf8(column)
            for row, end, part, part_offs in textkit.pieces(data, offs, PIECE_BYTES):
                for a in range(row, end, ROWS):
                    own = part_offs[a - row : min(end, a + ROWS) - row + 1]
                    found = model.decode(_features(part[own[0] : own[-1]], own - own[0]))
                    for kept, values in zip((best, score, ambiguous), found, strict=True):
                        kept.append(values)
            names = [model.languages[k] for k in np.concatenate(best)]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(score).astype(np.float64)), pa.array(np.concatenate(ambiguous))], names=["lang_pred", "score", "ambiguous"])

    und = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    kept = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(columns)), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered"), und.alias("und") if model is None else judge(F.col(text_col)).alias("judged"))
    found = F.col("und") if model is None else F.when(F.col("lettered"), F.col("judged")).otherwise(und)
    return kept.withColumn("j", found)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, ambiguous) for every row.

    lang_pred is a learned language, or 'und' with score 0 where the text is null or has no letter (and everywhere,
    if there was nothing to learn from). score is the decoded language's share among exp(-loss), from 1/languages
    to 1. A null id isn't held out. Repeated rows are judged alike; an empty table gives an empty result; other
    columns are not read.
    """
    judged = _identified(docs, model, text_col, [id_col]).select(F.col("c0").alias(id_col), "j.*")
    return judged.select(id_col, (~_usable(id_col)).alias("held_out"), "lang_pred", "score", "ambiguous")


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in a language: not 'und', and not ambiguous with a score under LEAST_SHARE / languages.

    Null texts and texts without a letter go. Without a model nothing is known against a text with letters, and those
    stay.
    """
    if model is None:
        return docs.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    least = LEAST_SHARE / len(model.languages)
    kept = _identified(docs, model, text_col, docs.columns).where(f"j.lang_pred <> 'und' and (not j.ambiguous or j.score >= {least!r})")
    return kept.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))
