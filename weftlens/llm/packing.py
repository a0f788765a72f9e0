"""Packing of tokenised documents into sequences by exact-complement hashing.

Tokens are made once and kept as a table of pieces (length and checksum, not the ids). Only the histogram of piece lengths,
at most one number for each length up to the sequence size, comes to the driver. There the longest length left is taken as
often as it goes together with a single length, a pair or a triple whose sum is exactly its gap, under the counts available;
what stays is packed best-fit, longest first. Every step uses up a length, so the plan has a few thousand patterns whatever
the input. A piece's place follows from its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE, Scratch, distinct_words, documents, map_arrow, slices, utf8, words

SEQUENCE, END_ID = 2048, 0
#: Pieces of words whose ids a worker remembers.
CACHE_PIECES = 200_000
#: Bytes of text whose pieces are looked up together.
TOKEN_CHUNK = 1 << 20
#: Rows that share a rank counter; a length's pieces are dealt to this many rows a counter.
RANK_ROWS, LEAST_COUNTERS = 100_000, 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


#: Code points below 0x180 that a word to be split here is made of; a word with any other goes through the whole tokenizer.
PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u017f]")
#: Kinds of them in lower case: runs of letters, single digits, runs of all others.
LETTER = re.compile("[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f]")
DIGIT = re.compile("[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]")
LETTERS, DIGITS, OTHERS, WHOLE, GAP = range(5)
#: Endings that are pieces of their own after a quote that begins a run.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each code point below 0x180 and the UTF-8 of its lower case (two bytes from 0x80 on)."""
    kinds, lower = np.full(0x180, WHOLE, np.uint8), np.zeros((0x180, 2), np.uint8)
    for code in range(0x180):
        low = chr(code).lower()
        if PLAIN.fullmatch(chr(code)):
            kinds[code] = LETTERS if LETTER.fullmatch(low) else DIGITS if DIGIT.fullmatch(low) else OTHERS
        if code >= 0x80 and len(low.encode()) == 2:
            lower[code] = list(low.encode())
    kinds[:128][SPACE[:128]] = GAP
    return kinds, lower


_KIND, _LOWER = _kinds()
_BYTE_KIND = np.append(_KIND[:128], np.full(128, WHOLE, np.uint8))


def split(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of all words of rows (utf8()): bytes in lower case, starts, ends, which are whole words left as they were, and how many precede each row."""
    starts, ends, _ = words(raw, off)
    n = len(raw)
    low, kind, begins = LOWER[raw], _BYTE_KIND[raw], np.ones(n, bool)
    lead = np.flatnonzero((raw[:-1] >= 0xC2) & (raw[:-1] <= 0xC5) & (raw[1:] & 0xC0 == 0x80))
    if len(lead):
        code = ((raw[lead] & 0x1F).astype(np.int64) << 6) | (raw[lead + 1] & 0x3F)
        kind[lead] = kind[lead + 1] = _KIND[code]
        low[lead], low[lead + 1] = _LOWER[code, 0], _LOWER[code, 1]
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGITS)
    begins[lead + 1] = False
    begins[starts] = True
    begins &= kind != GAP
    quote = np.flatnonzero(begins & (low == ord("'")))
    if len(quote):
        end = ends[np.searchsorted(starts, quote, "right") - 1]
        after = [np.where(quote + k < end, low[np.minimum(quote + k, n - 1)], 0) for k in (1, 2)]
        size = np.zeros(len(quote), np.int64)
        for ending in ENDINGS:
            size[np.logical_and.reduce([after[k] == ord(c) for k, c in enumerate(ending)])] = 1 + len(ending)
        quote, end, size = quote[size > 0], end[size > 0], size[size > 0]
        begins[quote + 1] = False
        begins[(quote + size)[quote + size < end]] = True
    odd = kind == WHOLE
    odd[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
    whole = np.zeros(n, bool)
    at = np.flatnonzero(odd)
    if len(at):
        words_of = np.unique(np.searchsorted(starts, at, "right") - 1)
        turns = np.zeros(n + 1, np.int8)
        turns[starts[words_of]] += 1
        turns[ends[words_of]] -= 1
        whole = np.cumsum(turns[:-1], dtype=np.int8).view(bool)
        low[whole] = raw[whole]
        begins &= ~whole
        begins[starts[words_of]] = True
    first = np.flatnonzero(begins)
    last = np.append(first[1:], n)
    last[np.append(np.searchsorted(first, starts)[1:], len(first)) - 1] = ends
    return low, first, last, whole[first], np.searchsorted(first, off)


def _byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level vocabularies for the bytes 0 to 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordIds:
    """Token ids by pieces of words: this tokenizer drops white space and never joins across pieces.

    Pieces are remembered up to CACHE_PIECES; which of them are remembered changes no result.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self._forget()
        probe = "It's 12 isn't naïve, Ünited_42 a-b"
        raw = np.frombuffer(probe.encode(), np.uint8)
        if self.tokens(raw, np.array([0, len(raw)]))[0][:-1].tolist() != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            raise ValueError("words are split as for one kind of vocabulary, and this one differs")
        self._forget()

    def _forget(self) -> None:
        """Only the end id is left, as number 0."""
        self.known: dict[bytes, int] = {}
        self.ids, self.at = array("I", [END_ID]), array("q", [0, 1])

    def _learn(self, raw: bytes, whole: bool) -> int:
        """The number of a new piece, whose ids go to the end of the pool."""
        if whole:
            ids = self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids
        elif raw.isascii():
            ids = [t.id for t in self.tokenize(raw.decode())]
        else:
            ids = [t.id for t in self.tokenize(raw.decode("latin-1").translate(self.letters))]
        self.ids.extend(ids)
        self.at.append(len(self.ids))
        self.known[raw] = n = len(self.at) - 2
        return n

    def tokens(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows (utf8()), each row ended by END_ID, and the rows' bounds."""
        if len(self.known) > CACHE_PIECES:
            self._forget()
        rows = len(off) - 1
        if not len(raw):
            return np.full(rows, END_ID, np.uint32), np.arange(rows + 1)
        low, starts, ends, whole, bounds = split(raw, off)
        first, which = distinct_words(low, starts, ends)
        data, known = low.tobytes(), self.known
        found = []
        for a, b, alone in zip(starts[first].tolist(), ends[first].tolist(), whole[first].tolist(), strict=True):
            piece = data[a:b]
            n = known.get(piece)
            found.append(self._learn(piece, alone) if n is None else n)
        numbers = np.array(found, np.int64)
        pool, at = np.array(self.ids, np.uint32), np.array(self.at)
        number = np.insert(numbers[which], bounds[1:], 0)
        base = at[number]
        size = at[number + 1] - base
        total = np.append(0, np.cumsum(size))
        out = pool[np.arange(total[-1]) + np.repeat(base - total[:-1], size)]
        return out, total[bounds + np.arange(rows + 1)]


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE) -> DataFrame:
    """Each document's ids and an end id, cut into pieces of size tokens if longer; a null text is an end id alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordIds(tokenizer_path)
        for batch in batches:
            for a, b in slices(batch.column(1), TOKEN_CHUNK):
                ids, bounds = tokenizer.tokens(*utf8(batch.column(1).slice(a, b - a)))
                n = -(-np.diff(bounds) // size)
                row = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * size
                end = np.minimum(start + size, np.diff(bounds)[row])
                data = memoryview(ids.astype("<u4")).cast("B")
                base = bounds[row]
                sums = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip((base + start).tolist(), (base + end).tolist(), strict=True)]
                yield pa.record_batch([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(end - start), pa.array(sums, pa.int64())], schema=schema)

    return map_arrow(docs.select("doc_id", "text"), run, PIECES)


def plan(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how many sequences, [(length, how many in each)]) that hold all pieces."""
    have = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    done: list[tuple[int, list[int]]] = []

    def take(lengths: list[int]) -> None:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        n = min(int(have[x]) // k for x, k in need.items())
        if n:
            for x, k in need.items():
                have[x] -= n * k
            done.append((n, lengths))

    def pairs_of(total: int, most: int) -> np.ndarray:
        """Larger halves of the available pairs with that sum."""
        a = np.arange((total + 1) // 2, min(total, most + 1))
        return a[(have[a] > 0) & (have[total - a] > (a == total - a))]

    for length in range(size, 0, -1):
        gap = size - length
        if have[length] and not gap:
            take([length])
        if have[length] and 0 < gap <= size and have[gap]:
            take([length, gap])
        while have[length] and gap > 1 and len(a := pairs_of(gap, length)):
            before = have[length]
            for x in a[::-1]:
                take([length, int(x), gap - int(x)])
            if have[length] == before:
                break
        if have[length] and gap > 2:
            for first in np.flatnonzero(have[: min(gap - 1, length + 1)])[::-1]:
                if not have[length]:
                    break
                first = int(first)
                for x in pairs_of(gap - first, first)[::-1]:
                    take([length, first, int(x), gap - first - int(x)])
                    if not have[length] or not have[first]:
                        break
    # best fit of the rest: bins of a kind are held together by their gap
    bins: dict[int, list[list]] = {}
    gaps: list[int] = []

    def put(gap: int, n: int, inside: list[tuple[int, int]]) -> None:
        if n:
            if gap not in bins:
                bins[gap] = []
                insort(gaps, gap)
            bins[gap].append([n, inside])

    for length in range(size, 0, -1):
        while have[length]:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = size // length
                n = max(1, int(have[length]) // each)
                each = min(each, int(have[length]))
                have[length] -= n * each
                put(size - each * length, n, [(length, each)])
                continue
            gap = gaps[at]
            kind = bins[gap][-1]
            each = min(gap // length, int(have[length]))
            n = min(kind[0], int(have[length]) // each)
            have[length] -= n * each
            kind[0] -= n
            inside = kind[1]
            if not kind[0]:
                bins[gap].pop()
                if not bins[gap]:
                    del bins[gap]
                    gaps.pop(at)
            put(gap - each * length, n, [*inside, (length, each)])
    out = [(n, [(x, 1) for x in lengths]) for n, lengths in done]
    return out + [(n, inside) for kinds in bins.values() for n, inside in kinds]


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Runs of ranks of a length: (length, first rank, how many in a sequence, first sequence, first offset), ordered."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, inside in patterns:
        offset = 0
        for length, each in inside:
            rows.append((length, used.get(length, 0), each, sequence, offset))
            used[length] = used.get(length, 0) + n * each
            offset += each * length
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {k: table[:, j] for j, k in enumerate(("length", "rank", "each", "sequence", "offset"))}


def pack(docs: DataFrame, tokenizer_path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Places of all pieces of docs (doc_id, text); see op5's columns.

    Repeated rows are packed as often as they stand there, null and empty texts as one token, an empty table gives an empty
    one; other columns are ignored.
    """
    spark = docs.sparkSession
    kept = Scratch(spark, "packing").table(pieces(docs, tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), size), "pieces")
    counts = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(plan(counts, size))
    counters = max(LEAST_COUNTERS, -(-sum(counts.values()) // RANK_ROWS))
    dealt = kept.withColumn("_counter", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(counters)))
    by_length = Window.partitionBy("length").orderBy("_counter").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "_counter").agg(F.count("*").alias("_n")).select("length", "_counter", F.coalesce(F.sum("_n").over(by_length), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_counter").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_row", F.row_number().over(within) - 1).join(before, ["length", "_counter"]).select(*PIECES_COLUMNS, (F.col("_row") + F.col("_before")).alias("_rank"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset"))])
    key = table["length"] * (1 << 44) + table["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length * (1 << 44) + rank, "right") - 1
            nth, each = rank - table["rank"][at], table["each"][at]
            yield pa.record_batch([*batch.columns[:5], pa.array(table["sequence"][at] + nth // each), pa.array(table["offset"][at] + nth % each * length)], schema=schema)

    return map_arrow(ranked, run, PLACED)


PIECES_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")


def op5_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


QUERIES = {"op5_bestfit_packing": op5_bestfit_packing}
ORACLE: dict[str, str] = {}
