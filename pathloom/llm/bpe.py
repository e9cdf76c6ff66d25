"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into pre-tokens by run arithmetic on character classes, straight on their UTF-8 bytes. The distinct
pre-tokens of a group of a partition's texts that the worker doesn't remember lie end to end in one symbol array; an
index maps each adjacent pair to all its positions there. Active ranks are applied in ascending order, each to all its
positions at once, and only the pairs beside a merge are entered anew.

Encoded pre-tokens are remembered in a table of fixed size under their whole bytes: up to 15 bytes and their length
make two 64-bit numbers that are compared in full, longer ones are keys of a dictionary. Hashes choose places only.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.textkit import _MASK, lanes, mix64, pieces, utf8

GROUP_BYTES = 4_000_000  #: texts encoded together; one longer text is a group of its own
PIECE_BYTES = 4_000_000  #: bytes worked on together; a longer text is cut at blanks between letters
PLACES = 1 << 19  #: pre-tokens of up to 15 bytes that a worker remembers at most (a power of two); a newer one takes an older one's place
HELD_IDS = 2_000_000  #: ids of remembered pre-tokens; beyond them a worker starts anew
DIGEST_IDS = 1 << 18  #: ids written out as text together

SPACE, LETTER, NUMBER, OTHER = range(4)
#: The white space of Unicode.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Suffixes that the pre-tokenizer cuts off behind an apostrophe.
SUFFIXES = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        if 0x323B0 <= code < 0xE0000 or code >= 0xE01F0:
            continue
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            table[code] = LETTER if kind == "L" else NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def _kinds(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    kind = _classes()[:256][data]
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        first = data[wide].astype(np.uint32)
        size = 2 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        code = first & (np.uint32(0xFF) >> (size + 1).astype(np.uint32))
        padded = np.concatenate((data, np.zeros(4, np.uint8)))
        for k in (1, 2, 3):
            code = np.where(size > k, code << np.uint32(6) | (padded[wide + k] & np.uint32(0x3F)), code)
        own = _classes()[np.minimum(code, 0x10FFFF)]
        for k in range(4):
            of = (size > k) & (wide + k < len(data))
            kind[wide[of] + k] = own[of]
    return kind


def pretokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of each pre-token of texts that lie end to end with these offsets."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _kinds(data)
    head = np.zeros(n + 1, bool)  # first byte of a text
    head[offs] = True
    change = head[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    runs = np.flatnonzero(change)
    ends = np.append(runs[1:], n)
    # a run that isn't space takes one blank before it along
    blank = (runs > 0) & (kind[runs] != SPACE) & ~head[runs] & (data[runs - 1] == 32)
    start[runs[blank]] = False
    start[runs[blank] - 1] = True
    # a run of space before more text gives up its last mark
    last = ends[(kind[runs] == SPACE) & ~head[ends]] - 1
    for _ in range(3):
        last = last - ((data[last] & 0xC0) == 0x80)
    start[last] = True
    # suffixes behind an apostrophe that stands alone and has no blank before it
    lone = runs[(ends - runs == 1) & (data[runs] == 39) & ~blank & ~head[ends]]
    lone = lone[kind[lone + 1] == LETTER]
    if len(lone):
        padded = np.append(data, np.zeros(3, np.uint8))
        stop = np.append(head, [True, True])
        cut = np.zeros(len(lone), np.int64)
        for suffix in reversed(SUFFIXES):
            fits = np.ones(len(lone), bool)
            for k, char in enumerate(suffix, 1):
                fits &= (padded[lone + k] == ord(char)) & ~stop[lone + k]
            cut[fits] = len(suffix)
        lone, cut = lone[cut > 0], cut[cut > 0]
        start[lone + 1] = False
        after = lone + 1 + cut
        start[after[after < n]] = True
    first = np.flatnonzero(start)
    return first, np.append(first[1:], n)


class Vocabulary:
    """Merges and tokens of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        char = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        byte = {c: b for b, c in char.items()}
        self.byte_id = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t.get("special")}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, k in vocab.items():
            self.token_bytes[k] = bytes(byte[c] for c in token)
        for token, k in self.special.items():
            self.token_bytes[k] = token.encode()
        self.token_size = np.array([len(t) for t in self.token_bytes], np.int64)
        self.decimal = [str(k) for k in range(size)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.pair = left << 32 | right
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.order = np.argsort(self.pair, kind="stable")
        self.sorted = self.pair[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 of none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)
        return np.where(self.sorted[at] == key, self.order[at], -1)

    def encode_words(self, words: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, whose bytes lie end to end, and each word's offset."""
        sizes = np.diff(offs)
        symbol = self.byte_id[words]
        n = len(symbol)
        if not n:
            return np.zeros(0, np.int32), offs
        following = np.arange(1, n + 2)
        before = np.arange(-1, n)
        following[offs[1:][sizes > 0] - 1] = n  # n stands for none
        before[offs[:-1][sizes > 0]] = -1
        symbol = np.append(symbol, -1)
        alive = np.ones(n + 1, bool)
        inner = np.flatnonzero(following[:n] < n)
        rank = self.ranks(symbol[inner], symbol[inner + 1])
        inner, rank = inner[rank >= 0], rank[rank >= 0]
        by_rank = np.argsort(rank, kind="stable")
        inner, rank = inner[by_rank], rank[by_rank]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        occurs: dict[int, list[np.ndarray]] = {int(r[0]): [p] for r, p in zip(np.split(rank, cuts), np.split(inner, cuts), strict=True) if len(r)}
        active = list(occurs)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            lists = occurs.pop(r, None)
            if lists is None:
                continue
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.pair[r] >> 32, self.pair[r] & 0xFFFFFFFF
            at = at[alive[at] & (symbol[at] == a)]
            at = at[symbol[following[at]] == b]
            if a == b and len(at) > 1:
                at = _apart(at, following)
            if not len(at):
                continue
            gone = following[at]
            after = following[gone]
            symbol[at] = self.made[r]
            alive[gone] = False
            following[at] = after
            inside = after < n
            before[after[inside]] = at[inside]
            left = before[at]
            left = left[left >= 0]
            beside = np.concatenate((left, at[inside]))
            ranks = self.ranks(symbol[beside], symbol[following[beside]])
            beside, ranks = beside[ranks >= 0], ranks[ranks >= 0]
            if len(ranks):
                order = np.argsort(ranks, kind="stable")
                beside, ranks = beside[order], ranks[order]
                edges = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(ranks)]
                for x, y in zip(edges[:-1], edges[1:], strict=True):
                    key = int(ranks[x])
                    if key in occurs:
                        occurs[key].append(beside[x:y])
                    else:
                        occurs[key] = [beside[x:y]]
                        heapq.heappush(active, key)
        kept = np.flatnonzero(alive[:n])
        return symbol[kept], np.searchsorted(kept, offs)


def _apart(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of positions whose pairs may overlap (x x x), every other one of each chain, from its left."""
    chained = np.concatenate(([False], following[at[:-1]] == at[1:]))
    place = np.arange(len(at))
    begin = np.maximum.accumulate(np.where(chained, 0, place))
    return at[(place - begin) % 2 == 0]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _grown(array: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(array):
        return array
    return np.concatenate((array[:used], np.zeros(max(len(array), used + 2 * more) - used + more, array.dtype)))


class Encoder:
    """Encodes texts by pre-tokens; ``encode_words`` gives ids of UTF-8 pre-tokens that lie end to end."""

    def __init__(self, encode_words: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], special: dict[str, int], places: int = PLACES, held_ids: int = HELD_IDS):
        self.encode_words, self.places, self.held_ids = encode_words, places, held_ids
        self.special = {token.encode(): k for token, k in special.items() if token}
        longest_first = sorted(self.special, key=lambda t: (-len(t), t))
        self.pattern = re.compile(b"|".join(map(re.escape, longest_first))) if longest_first else None
        self._forget()

    def _forget(self) -> None:
        self.low, self.high, self.word = np.zeros(self.places, np.uint64), np.zeros(self.places, np.uint64), np.zeros(self.places, np.int32)
        self.long: dict[bytes, int] = {}
        self.ids, self.offs, self.words = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0
        self.special_word = {token: self._learn_ids(np.array([k], np.int32), np.array([0, 1])) for token, k in self.special.items()}

    def _learn_ids(self, ids: np.ndarray, offs: np.ndarray) -> int:
        """Hold the ids of new words; the first one's number."""
        first, at, n = self.words, int(self.offs[self.words]), len(offs) - 1
        self.ids, self.offs = _grown(self.ids, at, len(ids)), _grown(self.offs, first + 1, n)
        self.ids[at : at + len(ids)] = ids
        self.offs[first + 1 : first + 1 + n] = at + offs[1:]
        self.words += n
        return first

    def _numbers(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each word, whose ids are then held."""
        size = end - first
        eight = lanes(data)
        low = eight[first] & _MASK[np.minimum(size, 8)]
        high = (eight[first + 8] & _MASK[np.clip(size - 8, 0, 7)]) | (np.minimum(size, 16).astype(np.uint64) << np.uint64(56))
        key = mix64(low ^ mix64(high))
        place = (key >> np.uint64(65 - self.places.bit_length())).astype(np.int64)
        out = self.word[place]
        short = size <= 15
        new = np.flatnonzero(short & ((self.low[place] != low) | (self.high[place] != high)))
        _, where, inverse = np.unique(key[new], return_index=True, return_inverse=True)
        head = new[where]
        same = (low[head][inverse] == low[new]) & (high[head][inverse] == high[new])
        # words of more bytes, and those (hardly ever any) whose key is another new word's
        apart = np.concatenate((np.flatnonzero(~short), new[~same]))
        others: dict[bytes, int] = {}
        named = [(k, data[first[k] : end[k]].tobytes()) for k in apart.tolist()]
        for k, word in named:
            if word not in self.long and word not in others:
                others[word] = k
        learned = np.concatenate((head, np.fromiter(others.values(), np.int64, len(others))))
        if len(learned):
            offs = np.concatenate(([0], np.cumsum(size[learned])))
            joined = data[np.repeat(first[learned] - offs[:-1], size[learned]) + np.arange(offs[-1])]
            number = self._learn_ids(*self.encode_words(joined, offs))
            out[new[same]] = number + inverse[same]
            self.low[place[head]], self.high[place[head]] = low[head], high[head]
            self.word[place[head]] = number + np.arange(len(head))
            for at, word in enumerate(others, number + len(head)):
                self.long[word] = at
        for k, word in named:
            out[k] = self.long[word]
        return out

    def _cut(self, data: np.ndarray, heads: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of about PIECE_BYTES that end with a text, or else before a blank between two letters."""
        at, n, size = 0, len(data), PIECE_BYTES
        while at < n:
            stop = at + size
            k = int(np.searchsorted(heads, stop, "right")) - 1
            if stop >= n or heads[k] > at:
                stop = min(n, int(heads[k]) if stop < n else n)
            else:
                part = data[at:stop]
                letter = (part | 0x20) - np.uint8(97) < 26
                between = np.flatnonzero((part[1:-1] == 32) & letter[:-2] & letter[2:])
                if not len(between):
                    size *= 2
                    continue
                stop = at + 1 + int(between[-1])
            yield at, stop
            at, size = stop, PIECE_BYTES

    def _specials(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(first byte, end) and token of each special token inside a text, from the left."""
        first, end, tokens = [], [], []
        if self.pattern:
            joined = data.tobytes()
            m = self.pattern.search(joined)
            while m:
                inside = m.end() <= offs[int(np.searchsorted(offs, m.start(), "right"))]
                if inside:
                    first.append(m.start())
                    end.append(m.end())
                    tokens.append(m[0])
                m = self.pattern.search(joined, m.end() if inside else m.start() + 1)
        return np.array(first, np.int64), np.array(end, np.int64), tokens

    def encode_bytes(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose UTF-8 bytes lie end to end, and each text's offset in them."""
        special, special_end, tokens = self._specials(data, offs)
        heads = np.unique(np.concatenate((offs, special, special_end)))
        parts, at, counts, ids_before = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for a, b in self._cut(data, heads):
            if self.offs[self.words] > self.held_ids or len(self.long) > self.places:
                self._forget()
            part = data[a:b]
            first, _ = pretokens(part, heads[np.searchsorted(heads, a) : np.searchsorted(heads, b, "right")] - a)
            own = slice(np.searchsorted(special, a), np.searchsorted(special, b))
            if own.start < own.stop:  # what stands inside a special token is no word
                step = np.zeros(len(first) + 1, np.int64)
                step[np.searchsorted(first, special[own] - a, "right")] += 1
                np.subtract.at(step, np.searchsorted(first, special_end[own] - a), 1)
                first = first[np.cumsum(step)[:-1] <= 0]
            numbers = self._numbers(part, first, np.append(first[1:], len(part)))
            numbers[np.searchsorted(first, special[own] - a)] = [self.special_word[token] for token in tokens[own]]
            begin = self.offs[numbers]
            length = self.offs[numbers + 1] - begin
            total = np.cumsum(length)
            parts.append(self.ids[np.repeat(begin - total + length, length) + np.arange(total[-1])])
            at.append(first + a)
            counts.append(ids_before + total - length)
            ids_before += int(total[-1])
        before = np.append(np.concatenate(counts), ids_before)
        return np.concatenate(parts), before[np.searchsorted(np.concatenate(at), offs)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, at = self.encode_bytes(*utf8(pa.array(texts, pa.string())))
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        vocab = vocabulary(path)
        _encoders[path] = Encoder(vocab.encode_words, vocab.special)
    return _encoders[path]


def text_groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about GROUP_BYTES; null texts are empty."""
    return pieces(*utf8(batch.column(column)), GROUP_BYTES)


def _digests(vocab: Vocabulary, ids: np.ndarray) -> tuple[str, str]:
    decimals, decoded, decoder = sha256(), sha256(), codecs.getincrementaldecoder("utf-8")("replace")
    for at in range(0, len(ids), DIGEST_IDS):
        own = ids[at : at + DIGEST_IDS].tolist()
        decimals.update((("," if at else "") + ",".join(map(vocab.decimal.__getitem__, own))).encode())
        decoded.update(decoder.decode(b"".join(map(vocab.token_bytes.__getitem__, own))).encode())
    decoded.update(decoder.decode(b"", True).encode())
    return decimals.hexdigest(), decoded.hexdigest()


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row: whole text encoded, then decoded.

    Special tokens of the file in a text become their ids. A null text counts as empty: no ids, and the hashes of
    the empty string. Ids are decoded byte for byte, invalid UTF-8 replaced. A null id is kept, repeated rows are
    encoded alike, an empty table gives an empty result; other columns are not read.
    """
    source = docs.select(F.col(id_col), F.col(text_col))
    kind = source.schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, coder = vocabulary(path), encoder(path)
        for batch in batches:
            for row, end, data, offs in text_groups(batch, 1):
                ids, at = coder.encode_bytes(data, offs)
                digests = [_digests(vocab, ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                columns = [batch.column(0).slice(row, end - row), pa.array(np.diff(at), pa.int64()), *(pa.array([d[k] for d in digests], pa.string()) for k in (0, 1))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, pa.ListArray.from_arrays(at.astype(np.int32), ids)], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
