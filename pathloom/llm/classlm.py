"""Brown class-based n-gram scoring.

The exchange algorithm assigns words to ``CLASSES`` classes, maximising the class bigram likelihood of the training
text. The ``SEEDS`` most frequent words are exchanged one after another on the driver and fix what the classes stand
for; then every further word that occurs ``LEAST_PLACED`` times or more goes to the class of the greatest gain by its
own counts of classes before and after it, summed over the whole text (``PLACE_ROUNDS`` rounds, all words of a round
at once). Rarer and unknown words share a symbol for each bucket of their last two bytes, placed in the same way. A
text's log10 probability is the sum over its words and one end of

    P(class | two classes before) * P(word | class),

class trigrams interpolated with bigrams and unigrams by Witten-Bell weights, words by their counts with Good-Turing
mass for unknown ones. All words of the corpus are counted, and all frequent enough are placed, however many there are:
a task holds count and class of the ``LEXICON`` most frequent words only, those of all others lie in tables that are
joined (words beyond the lexicon count as their bucket while classes are sought, and are placed in the last round).

Texts are read twice, to count words and to write them as symbols; every later pass reads the symbols. Words are told
apart by a 64-bit hash with non-linear steps (two given words share one with a probability of about 2**-64).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm import textkit
from pathloom.llm.workspace import discard, fresh_path, saved

SEEDS, CLASSES, BUCKETS, ROUNDS = 1000, 48, 512, 8
LEAST_PLACED, PLACE_ROUNDS = 5, 2
LEXICON = 400_000  #: words whose counts and classes each task holds
DENSE = 8192  #: most frequent words whose neighbours are counted in an array
HELD_CODES = 1 << 19  #: (word, class beside it) counts that a task holds before it hands them on
PLACED_WORDS = 4096  #: words whose gains are taken together
SYMBOL_BYTES = 1 << 21  #: symbols worked on together; one longer text is worked on at once
ADD = 0.1  #: of the base model
END_KEY = 0x5EED5EED5EED5EED
_UNKNOWN = 0x80  #: flag beside a token's class


def training_rows(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(10)) != 0


def _bucket(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bucket of each word by its last two bytes."""
    last = textkit._LOWER[data[end - 1]].astype(np.uint32)
    other = np.where(end - first > 1, textkit._LOWER[data[np.maximum(end - 2, 0)]], 0).astype(np.uint32)
    return (((last << np.uint32(8) | other) * np.uint32(0x9E3779B1)) >> np.uint32(23)).astype(np.int64) % BUCKETS


def _parts(batch: pa.RecordBatch, column: int):
    data, offs = textkit.utf8(batch.column(column))
    for row, end, part, part_offs in textkit.pieces(data, offs):
        keys, first, stop, word_offs = textkit.words(part, part_offs)
        yield row, end, keys, _bucket(part, first, stop) if len(keys) else np.zeros(0, np.int64), word_offs


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _, _, keys, bucket, _ in _parts(batch, 0):
            own, where, n = np.unique(keys, return_index=True, return_counts=True)
            kept.append((own, bucket[where], n))
        keys = np.concatenate([k[0] for k in kept] or [np.zeros(0, np.uint64)])
        own, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        n = np.bincount(inverse, np.concatenate([k[2] for k in kept] or [np.zeros(0)]), len(own)).astype(np.int64)
        bucket = np.concatenate([k[1] for k in kept] or [np.zeros(0, np.int64)])[where]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own.view(np.int64), END_KEY)), pa.array(np.append(bucket, -1), pa.int32()), pa.array(np.append(n, batch.num_rows), pa.int64())], names=["h", "bucket", "c"])


class Lexicon:
    """The most frequent words, numbered by frequency, with their counts; the totals of all words."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, ends: int, tokens: int, types: int, least: int, path: str):
        """``keys`` come by frequency; ``least`` is the least count that all words of the lexicon have."""
        self.counts, self.ends, self.tokens, self.types, self.least, self.path = counts, ends, tokens, types, least, path
        order = np.argsort(keys)
        self.keys, self.number = np.append(keys[order], np.uint64(2**64 - 1)), np.append(order, -1)
        self.end = len(keys)  #: the number of the end; buckets follow it
        bits = max(8, 2 * len(keys)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys[order], np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each word, -1 of those that aren't held."""
        at = self.first[keys >> self.shift]
        behind = np.flatnonzero(self.keys[at] < keys)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < keys[behind]]
        return np.where(self.keys[at] == keys, self.number[at], -1)

    @property
    def denominator(self) -> float:
        return float(np.log10(self.tokens + ADD * (self.types + 1)))


def _least_count(words: DataFrame) -> int:
    """The least count of a lexicon word: at most LEXICON words have it or a greater one."""
    held = 0
    frequent = words.groupBy("c").count().orderBy(F.desc("c")).toArrow()  # one row per distinct count
    for c, n in zip(frequent.column("c").to_pylist(), frequent.column("count").to_pylist(), strict=True):
        if held + n > LEXICON:
            return c + 1
        held += n
    return 1


def count_words(texts: DataFrame) -> Lexicon:
    """Counts of all words of a table's column ``text``; a null text is an end alone."""
    path = fresh_path(texts.sparkSession, "words")
    words = saved(texts.select("text").mapInArrow(_counted, "h long, bucket int, c long").groupBy("h").agg(F.min("bucket").alias("bucket"), F.sum("c").alias("c")), "words", path)
    row = words.agg(F.sum("c").alias("tokens"), F.count("*").alias("types"), F.sum(F.when(F.col("h") == END_KEY, F.col("c"))).alias("ends")).first()
    least = _least_count(words)
    top = words.where(F.col("c") >= least).where(F.col("h") != END_KEY).select("h", "c").toArrow()  # at most LEXICON
    keys, c = (top.column(k).to_numpy().astype(np.int64) for k in (0, 1))
    order = np.lexsort((keys, -c))
    return Lexicon(keys[order].view(np.uint64), c[order], *(int(row[k] or 0) for k in ("ends", "tokens", "types")), least, path)


# --- texts as symbols ---------------------------------------------------------------------------------------

_STREAMS = "row long, doc_id {kind}, used boolean, stream binary, keys binary, buckets binary"


def _symbolised(lexicon: Lexicon):
    """A row for each document: its words' numbers and an end; words not held are numbered behind the end.

    Number end + 1 + k stands for the document's k-th word that isn't held, whose key and bucket come along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for row, stop, keys, bucket, word_offs in _parts(batch, 2):
                rows = stop - row
                found = lexicon.find(keys)
                owner = np.repeat(np.arange(rows), np.diff(word_offs))
                late = np.flatnonzero(found < 0)
                order = np.lexsort((keys[late], owner[late]))
                late = late[order]
                new = np.ones(len(late), bool)
                new[1:] = (keys[late][1:] != keys[late][:-1]) | (owner[late][1:] != owner[late][:-1])
                heads = late[new]
                late_offs = np.searchsorted(owner[heads], np.arange(rows + 1))
                found[late] = lexicon.end + np.cumsum(new) - late_offs[owner[late]]
                stream = np.full(len(keys) + rows, lexicon.end, "<i4")
                stream[np.arange(len(keys)) + owner] = found
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number + np.arange(rows)),
                        batch.column(0).slice(row, rows),
                        batch.column(1).slice(row, rows),
                        textkit.packed(stream, word_offs + np.arange(rows + 1)),
                        textkit.packed(keys[heads].view(np.int64), late_offs),
                        textkit.packed(bucket[heads].astype("<i2"), late_offs),
                    ],
                    names=["row", "doc_id", "used", "stream", "keys", "buckets"],
                )
                number += rows

    return run


def symbolise(docs: DataFrame, lexicon: Lexicon, usable: Column, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    path = fresh_path(docs.sparkSession, "symbols")
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(usable, F.lit(False)).alias("used"), F.col(text_col).alias("text"))
    kind = source.schema[0].dataType.simpleString()
    return saved(source.mapInArrow(_symbolised(lexicon), _STREAMS.format(kind=kind)), "symbols", path), path


def _pieces(batch: pa.RecordBatch, stream: int, buckets: int, end: int, standing: np.ndarray | None = None):
    """(first row, end row, symbols, row offsets, places of words not held, their places in the batch's lists).

    Symbols: words by number, the end, then buckets; ``standing`` puts others in their place.
    """
    flat, offs = textkit.binary(batch.column(stream), "u1")
    bucket, late_offs = textkit.binary(batch.column(buckets), "<i2")
    bucket = bucket.astype(np.int64)
    for row, stop, part, part_offs in textkit.pieces(flat, offs, SYMBOL_BYTES):
        symbols = part.view("<i4").astype(np.int64)
        places = part_offs // 4
        late = np.flatnonzero(symbols > end)
        listed = late_offs[row + np.searchsorted(places, late, "right") - 1] + symbols[late] - end - 1
        symbols[late] = end + 1 + bucket[listed]
        yield row, stop, symbols if standing is None else standing[symbols], places, late, listed


def _gram_counts(order: int, base: int, symbol_of: np.ndarray | None, end: int):
    """Counts of runs of ``order`` symbols, or of what ``symbol_of`` makes of them; a row's first follow the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(base**order, np.int64)
        last = end if symbol_of is None else int(symbol_of[end])
        for batch in batches:
            if symbol_of is None:
                streams = (part & np.uint8(0x7F) for _, _, part, _ in textkit.pieces(*textkit.binary(batch.column(0), "u1"), SYMBOL_BYTES))
            else:
                streams = (symbol_of[symbols] for _, _, symbols, *_ in _pieces(batch, 0, 1, end))
            for stream in streams:
                code = np.zeros(len(stream), np.int64)
                for before in _histories(stream.astype(np.int64), last, order):
                    code = code * base + before
                total += np.bincount(code, minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "n"])

    return run


def _grams(rows: DataFrame, order: int, base: int, symbol_of: np.ndarray | None, end: int) -> np.ndarray:
    """Summed counts as an array of ``order`` dimensions of ``base``, which bounds what is collected."""
    counted = rows.mapInArrow(_gram_counts(order, base, symbol_of, end), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(base**order)
    out[counted.column("code").to_numpy().astype(np.int64)] = counted.column("n").to_numpy()
    return out.reshape((base,) * order)


def _histories(stream: np.ndarray, end: int, order: int) -> list[np.ndarray]:
    """The stream itself and what stands up to order - 1 places before, earliest first; nothing before an end."""
    out = [stream]
    for _ in range(order - 1):
        nearer = out[0]
        shifted = np.concatenate(([end], nearer[:-1]))
        if len(out) > 1:  # two before a row's first word is an end as well
            shifted[out[-2] == end] = end
        out.insert(0, shifted)
    return out


# --- classes ------------------------------------------------------------------------------------------------


def exchange(counts: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each symbol from symbol bigram counts; the last symbol (the end) keeps a class of its own, the last."""
    n = len(counts) - 1
    weight = counts.sum(axis=0) + counts.sum(axis=1)
    order = np.argsort(-weight[:n], kind="stable")
    classes = max(1, min(classes, n))
    of = np.zeros(n + 1, np.int64)
    of[order] = np.arange(n) % classes
    of[n] = classes
    size = classes + 1
    member = np.zeros((n + 1, size))
    member[np.arange(n + 1), of] = 1
    grams = member.T @ counts @ member

    def plogp(x):
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(rounds):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            right = counts[w] @ member  # classes after w
            left = counts[:, w] @ member  # classes before w
            own, twice = of[w], counts[w, w]
            right[own] -= twice
            left[own] -= twice
            grams[own] -= right
            grams[:, own] -= left
            grams[own, own] -= twice
            # gain of adding w to each class
            rows, columns = grams.sum(axis=1), grams.sum(axis=0)
            added_rows = plogp(grams + right[None, :]) - plogp(grams)
            added_columns = plogp(grams + left[:, None]) - plogp(grams)
            diagonal = np.diag(grams)
            gain = added_rows.sum(axis=1) + added_columns.sum(axis=0) - np.diag(added_rows) - np.diag(added_columns) + plogp(diagonal + right + left + twice) - plogp(diagonal)
            out, into = right.sum() + twice, left.sum() + twice
            gain -= plogp(rows + out) - plogp(rows) + plogp(columns + into) - plogp(columns)
            best = int(np.argmax(gain[:classes]))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            grams[best] += right
            grams[:, best] += left
            grams[best, best] += twice
            if best != own:
                member[w, own], member[w, best], of[w] = 0, 1, best
                moved += 1
        if not moved:
            break
    return of


_COUNTS = "late boolean, s long, bucket int, vector binary"


def _vectors(late: bool, code: np.ndarray, n: np.ndarray, slots: int, names: np.ndarray | None = None, buckets: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each word with its slots and counts, three bytes each, from sorted codes (word * slots + slot)."""
    times = -(-n // 0xFFFF)  # greater counts take several entries
    last = np.cumsum(times) - 1
    n_of = np.full(int(times.sum()), 0xFFFF, np.int64)
    n_of[last] = n - (times - 1) * 0xFFFF
    word = np.repeat(code // slots, times)
    entries = np.stack([np.repeat(code % slots, times), n_of & 0xFF, n_of >> 8], axis=1).astype(np.uint8)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    own = word[heads]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(heads), late)),
            pa.array(own if names is None else names[own].view(np.int64)),
            pa.array(np.full(len(heads), -1, np.int32) if buckets is None else buckets[own].astype(np.int32)),
            textkit.packed(entries.ravel(), 3 * np.append(heads, len(word))),
        ],
        names=["late", "s", "bucket", "vector"],
    )


def _neighbours(classes: np.ndarray, end: int, first: int, standing: np.ndarray, with_late: bool):
    """Counts of classes before (slot = class) and after (slot = width + class) each word from ``first`` on.

    Slot 2 * width counts a word that follows itself, which is in neither of the other two. Rare words and those that
    aren't held count in their bucket, the latter ``with_late`` also by themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = int(classes.max()) + 1
        slots = 2 * width + 1
        dense = np.zeros((DENSE + BUCKETS) * slots, np.int64)
        codes, counts, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def coded(own: np.ndarray, at: np.ndarray, symbols: np.ndarray, of: np.ndarray, same: np.ndarray) -> np.ndarray:
            """``same``: a word's name at each place."""
            before, after = same[at - 1] == same[at], same[at + 1] == same[at]  # the last symbol is an end
            code = own * slots
            return np.concatenate([(code + of[at - 1])[~before], (code + width + of[at + 1])[~after], (code + 2 * width)[after]])

        for batch in batches:
            for _, _, symbols, _, late, listed in _pieces(batch, 0, 1, end, standing):
                of = classes[symbols]
                at = np.flatnonzero((symbols >= first) & (symbols != end))
                own = symbols[at]
                often = (own < DENSE) | (own > end)
                some = own[often]
                dense += np.bincount(coded(np.where(some > end, some - end - 1 + DENSE, some), at[often], symbols, of, symbols), minlength=len(dense))
                code, n = np.unique(coded(own[~often], at[~often], symbols, of, symbols), return_counts=True)
                codes.append(code)
                counts.append(n)
                size += len(code)
                if size > HELD_CODES:
                    yield _vectors(False, *_merged(codes, counts), slots)
                    codes, counts, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
                if with_late and len(late):
                    keys, _ = textkit.binary(batch.column(2), "<i8")
                    bucket, _ = textkit.binary(batch.column(1), "<i2")
                    names, where, number = np.unique(keys[listed], return_index=True, return_inverse=True)
                    same = symbols.copy()
                    same[late] = -1 - number
                    code, n = np.unique(coded(number, late, symbols, of, same), return_counts=True)
                    yield _vectors(True, code, n, slots, names, bucket[listed[where]])
        code, n = _merged(codes, counts)
        if len(code):
            yield _vectors(False, code, n, slots)
        code = np.flatnonzero(dense)
        word = code // slots
        n = dense[code]
        code = np.where(word >= DENSE, word - DENSE + end + 1, word) * slots + code % slots
        order = np.argsort(code)
        yield _vectors(False, code[order], n[order], slots)

    return run


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return own, np.bincount(inverse, np.concatenate(counts), len(own)).astype(np.int64)


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(own: np.ndarray, left: np.ndarray, right: np.ndarray, twice: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The class of the greatest gain for each word, all others standing still.

    ``own`` is the class that ``grams`` counts a word in, ``left`` and ``right`` its counts of classes before and after
    (words x classes, the word itself not counted), ``twice`` how often it follows itself. The last class is the end's.
    A class without words is no choice.
    """
    size = len(grams)
    words, k = np.arange(len(own)), size - 1
    gain = np.zeros((len(own), size))
    base = _plogp(grams)
    # neighbours in other classes than the word's own and the candidate
    for counts, cells, cell_base in ((right, grams, base), (left, grams.T, base.T)):
        counts = counts.copy()
        counts[words, own] = 0
        word, c = np.nonzero(counts)
        n = counts[word, c]
        more = _plogp(cells.T[c] + n[:, None]) - cell_base.T[c]
        more[np.arange(len(word)), c] = 0
        if len(word):
            heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            gain[word[heads]] += np.add.reduceat(more, heads, axis=0)
    # neighbours in the own class, whose cells the word has left
    to_own, from_own = grams[:, own].T - left, grams[own] - right
    gain += _plogp(to_own + right[words, own][:, None]) - _plogp(to_own) + _plogp(from_own + left[words, own][:, None]) - _plogp(from_own)
    diagonal = np.diag(grams)[None, :]
    gain += _plogp(diagonal + right + left + twice[:, None]) - _plogp(diagonal)
    out, into = (x.sum(axis=1) + twice for x in (right, left))
    # totals of other classes don't depend on where the word goes
    rows, columns = grams.sum(axis=1)[None, :], grams.sum(axis=0)[None, :]
    gain -= _plogp(rows + out[:, None]) - _plogp(rows) + _plogp(columns + into[:, None]) - _plogp(columns)
    # staying: what is lost by leaving
    stay_right, stay_left = _plogp(grams[own]) - _plogp(grams[own] - right), _plogp(grams[:, own].T) - _plogp(grams[:, own].T - left)
    stay_right[words, own] = stay_left[words, own] = 0
    row, column, cell = grams.sum(axis=1)[own], grams.sum(axis=0)[own], grams[own, own]
    rest = left[words, own] + right[words, own] + twice
    stay = stay_right.sum(axis=1) + stay_left.sum(axis=1) + _plogp(cell) - _plogp(cell - rest)
    stay -= _plogp(row) - _plogp(row - out) + _plogp(column) - _plogp(column - into)
    gain[words, own] = stay
    gain[:, (grams.sum(axis=0) == 0) & (grams.sum(axis=1) == 0)] = -np.inf  # else all words would go to an empty class at once
    best = np.argmax(gain[:, :k], axis=1)
    return np.where(gain[words, best] > stay + 1e-9, best, own)


def _placed(classes: np.ndarray, end: int, grams: np.ndarray):
    """The best class of each word; rows come sorted by word, and a word may go on in the next batch.

    A word that isn't held is placed if it occurs LEAST_PLACED times or more, and stands in its bucket's class.
    """
    width = len(grams)
    slots = 2 * width + 1

    def best(table: pa.Table) -> pa.RecordBatch:
        late, s, bucket = (table.column(k).to_numpy() for k in range(3))
        entries, offs = textkit.binary(table.column(3).combine_chunks(), "u1")
        entries = entries.reshape(-1, 3).astype(np.int64)
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (late[1:] != late[:-1])))
        heads = np.flatnonzero(new)
        word = np.repeat(np.cumsum(new) - 1, np.diff(offs) // 3)
        counts = np.bincount(word * slots + entries[:, 0], entries[:, 1] + (entries[:, 2] << 8), len(heads) * slots).reshape(len(heads), slots)
        late, s, bucket = late[heads], s[heads], bucket[heads]
        own = classes[np.where(late, end + 1 + bucket, s * ~late)]
        found = best_classes(own, counts[:, :width], counts[:, width : 2 * width], counts[:, 2 * width], grams)
        keep = ~late | (counts[:, :width].sum(axis=1) + counts[:, 2 * width] >= LEAST_PLACED)
        return pa.RecordBatch.from_arrays([pa.array(late[keep]), pa.array(s[keep]), pa.array(found[keep].astype(np.int32))], names=["late", "s", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, PLACED_WORDS):
                rest.append(batch.slice(at, PLACED_WORDS))
                held += rest[-1].num_rows
                if held >= PLACED_WORDS:
                    table = pa.Table.from_batches(rest).combine_chunks()
                    late, s = table.column(0).to_numpy(), table.column(1).to_numpy()
                    other = np.flatnonzero((s != s[-1]) | (late != late[-1]))
                    last = int(other[-1]) + 1 if len(other) else 0
                    if last:
                        yield best(table.slice(0, last))
                    rest = table.slice(last).to_batches()
                    held = table.num_rows - last
        table = pa.Table.from_batches(rest) if rest else None
        if table is not None and table.num_rows:
            yield best(table)

    return run


def place(streams: DataFrame, lexicon: Lexicon, classes: np.ndarray, first: int, standing: np.ndarray) -> tuple[np.ndarray, str | None]:
    """Classes after PLACE_ROUNDS rounds of exchange over all words from number ``first`` on and the buckets.

    ``standing`` names the symbol that each one counts as: a bucket for rare words, else itself. Also the table (s, class) of the words placed that aren't held; None if none of them is frequent enough.
    """
    spark = streams.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, width, path = streams.select("stream", "buckets", "keys"), int(classes.max()) + 1, None
    for turn in range(PLACE_ROUNDS):
        grams = _grams(rows, 2, width, classes, lexicon.end)
        late = turn == PLACE_ROUNDS - 1 and lexicon.least > LEAST_PLACED
        counts = rows.mapInArrow(_neighbours(classes, lexicon.end, first, standing, late), _COUNTS).repartition(parts, "late", "s").sortWithinPartitions("late", "s")
        path = fresh_path(spark, "placed")
        placed = saved(counts.mapInArrow(_placed(classes, lexicon.end, grams), "late boolean, s long, class int"), "placed", path)
        found = placed.where("not late").select("s", "class").toArrow()  # at most LEXICON + BUCKETS
        classes = classes.copy()
        classes[found.column("s").to_numpy()] = found.column("class").to_numpy()
        classes = classes[standing]
        if not late:
            discard(spark, path)
            path = None
    return classes, path


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    classes: np.ndarray  #: of each word held, the end and each bucket
    placed: str | None  #: the table (late, s, class) of further words with a class of their own
    log_next: np.ndarray  #: log10 P(class | two classes before), [before last, last, class]
    log_known: np.ndarray  #: by class: log10((1 - unknown share) / tokens), to which log10 c is added
    log_unknown: np.ndarray  #: by bucket: log10 of an unknown word's share of its class


def _share(counts: np.ndarray) -> np.ndarray:
    """Witten-Bell trigram probabilities [a, b, c] from counts, over bigrams, unigrams and the uniform."""
    size = counts.shape[0]

    def mixed(level: np.ndarray, lower: np.ndarray) -> np.ndarray:
        total = level.sum(axis=-1, keepdims=True)
        kinds = (level > 0).sum(axis=-1, keepdims=True)
        return np.where(total > 0, (level + kinds * lower) / np.maximum(total + kinds, 1), lower)

    one = counts.sum(axis=(0, 1))
    unigram = mixed(one, np.full(size, 1 / size))
    bigram = mixed(counts.sum(axis=0), unigram[None, :])
    return mixed(counts, bigram[None, :, :])


# --- learning and scoring -----------------------------------------------------------------------------------

_RESOLVED = "doc_id {kind}, used boolean, classes binary, unknown binary, n_tokens long, n_known long, base double, logs double"


def _late_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, offs = textkit.binary(batch.column(1), "<i8")
        n = np.diff(offs)
        k = np.arange(len(keys)) - np.repeat(offs[:-1], n)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(k.astype(np.int32)), pa.array(keys)], names=["row", "k", "h"])


def _resolved(lexicon: Lexicon, classes: np.ndarray):
    """Class of every token (an unknown word's with a flag), and the sums that need counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = lexicon.end
        counts = np.concatenate((lexicon.counts, [lexicon.ends], np.zeros(BUCKETS, np.int64)))
        for batch in batches:
            found = batch.column(4)
            flat = found.flatten()
            bucket, late_offs = textkit.binary(batch.column(3), "<i2")
            late_count, late_class = np.zeros(len(bucket), np.int64), classes[end + 1 + bucket.astype(np.int64)]
            if len(flat):
                sizes = np.diff(late_offs)
                at = np.repeat(late_offs[:-1], sizes)  # each row's words come with their places, in any order
                at = at + flat.field("k").to_numpy()
                late_count[at] = flat.field("c").fill_null(0).to_numpy()
                own = flat.field("class").fill_null(-1).to_numpy()
                late_class[at] = np.where(own >= 0, own, late_class[at])
            for row, stop, symbols, offs, late, listed in _pieces(batch, 2, 3, end):
                of, c = classes[symbols], counts[symbols]
                of[late], c[late] = late_class[listed], late_count[listed]
                known = c > 0
                words = known & (symbols != end)
                at = offs[:-1]
                lost = np.flatnonzero(~known & (symbols != end))
                logs = np.where(words, np.log10(np.maximum(c, 1)), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, stop - row),
                        batch.column(1).slice(row, stop - row),
                        textkit.packed((of + np.where(known | (symbols == end), 0, _UNKNOWN)).astype(np.uint8), offs),
                        textkit.packed((symbols[lost] - end - 1).astype("<i2"), np.searchsorted(lost, offs)),
                        pa.array(np.diff(offs)),
                        pa.array(np.add.reduceat(known.astype(np.int64), at)),
                        pa.array(np.add.reduceat(np.log10(c + ADD), at) - np.diff(offs) * lexicon.denominator),
                        pa.array(np.add.reduceat(logs, at)),
                    ],
                    names=["doc_id", "used", "classes", "unknown", "n_tokens", "n_known", "base", "logs"],
                )

    return run


def resolve(streams: DataFrame, lexicon: Lexicon, classes: np.ndarray, placed: str | None) -> tuple[DataFrame, str]:
    """Symbols with the counts and classes of all words: those that tasks don't hold are joined, once a document."""
    spark = streams.sparkSession
    path = fresh_path(spark, "classes")
    words = spark.read.schema("h long, bucket int, c long").parquet(lexicon.path).where(F.col("c") < lexicon.least).select("h", "c")
    late = streams.select("row", "keys").mapInArrow(_late_words, "row long, k int, h long").join(words, "h", "left")
    if placed:
        own = spark.read.schema("late boolean, s long, class int").parquet(placed).where("late").select(F.col("s").alias("h"), "class")
        late = late.join(own, "h", "left")
    else:
        late = late.withColumn("class", F.lit(None).cast("int"))
    found = late.groupBy("row").agg(F.collect_list(F.struct("k", "c", "class")).alias("found"))
    joined = streams.select("row", "doc_id", "used", "stream", "buckets").join(found, "row", "left").select("doc_id", "used", "stream", "buckets", "found")
    kind = streams.schema["doc_id"].dataType.simpleString()
    return saved(joined.mapInArrow(_resolved(lexicon, classes), _RESOLVED.format(kind=kind)), "classes", path), path


def _learned(streams: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, str | None]:
    """Classes of the words held, the end and the buckets, and the table of further words placed."""
    used = streams.where("used")
    held, seeds = lexicon.end, min(SEEDS, lexicon.end)
    words = streams.sparkSession.read.schema("h long, bucket int, c long").parquet(lexicon.path)
    top = words.where(F.col("c") >= lexicon.least).where("bucket >= 0").select("h", "bucket").toArrow()  # at most LEXICON
    bucket = np.zeros(held, np.int64)
    bucket[lexicon.find(top.column("h").to_numpy().view(np.uint64))] = top.column("bucket").to_numpy()
    number = np.arange(held)
    # while seeds are exchanged all other words stand in their buckets
    as_seed = np.concatenate((np.where(number < seeds, number, seeds + bucket), [seeds + BUCKETS], seeds + np.arange(BUCKETS)))
    seeded = exchange(_grams(used.select("stream", "buckets"), 2, seeds + BUCKETS + 1, as_seed, held))
    rare = (lexicon.counts < LEAST_PLACED) & (number >= seeds)
    standing = np.concatenate((np.where(rare, held + 1 + bucket, number), np.arange(held, held + 1 + BUCKETS)))
    return place(used, lexicon, seeded[as_seed], seeds, standing)


def _smoothed(rows: DataFrame, lexicon: Lexicon, classes: np.ndarray, placed: str | None) -> Model:
    """Class n-grams from the training rows' classes, and the shares of known and unknown words."""
    width = int(classes.max()) + 1
    of_bucket = classes[lexicon.end + 1 :]
    cube = _grams(rows.where("used").select("classes"), 3, width, None, int(classes[lexicon.end]))
    held = cube.sum(axis=(0, 1))
    once = np.zeros(BUCKETS)  # words that occur once, by bucket
    for r in rows.sparkSession.read.schema("h long, bucket int, c long").parquet(lexicon.path).where("c = 1").groupBy("bucket").count().collect():
        if r["bucket"] >= 0:
            once[r["bucket"]] = r["count"]
    by_class = np.zeros(width)
    np.add.at(by_class, of_bucket, once + ADD)
    share = np.clip(by_class / np.maximum(held, 1), 1e-6, 0.5)
    has_bucket = np.zeros(width, bool)
    has_bucket[of_bucket] = True
    share = np.where(has_bucket, share, 0.0)
    log_unknown = np.log10(share[of_bucket] * (once + ADD) / by_class[of_bucket])
    return Model(lexicon, classes, placed, np.log10(_share(cube)), np.log10((1 - share) / np.maximum(held, 1)), log_unknown)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(model.classes[model.lexicon.end])
        for batch in batches:
            flat, offs = textkit.binary(batch.column(1), "u1")
            unknown, unknown_offs = textkit.binary(batch.column(2), "<i2")
            lost = np.concatenate(([0.0], np.cumsum(model.log_unknown[unknown])))
            logs, score = batch.column(6).to_numpy(), np.zeros(batch.num_rows)
            for row, stop, part, part_offs in textkit.pieces(flat, offs, SYMBOL_BYTES // 4):
                of = (part & np.uint8(0x7F)).astype(np.int64)
                a, b, _ = _histories(of, end, 3)
                known = np.where((part < _UNKNOWN) & (of != end), model.log_known[of], 0.0)
                score[row:stop] = np.add.reduceat(model.log_next[a, b, of] + known, part_offs[:-1])
            score += logs + lost[unknown_offs[1:]] - lost[unknown_offs[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(k) for k in (3, 4, 5)), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def _scores(rows: DataFrame, model: Model, id_col: str) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.select("doc_id", "classes", "unknown", "n_tokens", "n_known", "base", "logs").mapInArrow(_scored(model), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    tokens = F.lit(model.lexicon.tokens).cast("long").alias("train_tokens")
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    return scored.select(F.col("doc_id").alias(id_col), (~training_rows("doc_id")).alias("held_out"), "n_tokens", "n_known", tokens, "base_score", "score", perplexity)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", usable: Column | None = None) -> Model:
    """Counts of all words of the usable rows' whole texts, classes and class n-grams; null texts are empty.

    Without usable rows every token is unknown and the base model is uniform over one type.
    """
    used = docs.where(usable if usable is not None else training_rows(id_col))
    lexicon = count_words(used.select(F.col(text_col).alias("text")))
    streams, path = symbolise(used, lexicon, F.lit(True), id_col, text_col)
    classes, placed = _learned(streams, lexicon)
    rows, other = resolve(streams, lexicon, classes, placed)
    model = _smoothed(rows, lexicon, classes, placed)
    for x in (path, other):
        discard(docs.sparkSession, x)
    return model


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row.

    Scores are log10 probabilities of the whole text and one end, perplexity is 10 ** (-score / n_tokens). A null text
    is empty: one token, the end. A null id counts like the empty text. Repeated rows score alike; an empty table
    gives an empty result; other columns are not read.
    """
    streams, path = symbolise(docs, model.lexicon, F.lit(False), id_col, text_col)
    rows, _ = resolve(streams, model.lexicon, model.classes, model.placed)
    discard(docs.sparkSession, path)
    return _scores(rows, model, id_col)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", usable: Column | None = None) -> DataFrame:
    """``score_texts`` of all rows by what ``train`` learns from the usable ones; texts become symbols only once."""
    usable = usable if usable is not None else training_rows(id_col)
    lexicon = count_words(docs.where(usable).select(F.col(text_col).alias("text")))
    streams, path = symbolise(docs, lexicon, usable, id_col, text_col)
    classes, placed = _learned(streams, lexicon)
    rows, _ = resolve(streams, lexicon, classes, placed)
    model = _smoothed(rows, lexicon, classes, placed)
    discard(docs.sparkSession, path)
    forget(docs, model)
    return _scores(rows, model, id_col)


def forget(docs: DataFrame, model: Model) -> None:
    """Delete the model's tables of words and classes."""
    for path in (model.lexicon.path, model.placed):
        if path:
            discard(docs.sparkSession, path)
