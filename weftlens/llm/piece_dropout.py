"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merges follow the piece model: of all neighbouring symbols whose join is a piece, the best-scored one, leftmost among equals,
is merged, until none is left. A candidate is skipped if a hash of the seed, the document and the candidate's first and last
character falls under the dropout rate, so each occurrence of a word has its own segmentation, and the same one in every run.
No piece reaches over the start of a word, so the agendas of all words of a chunk are worked off together: a round takes the
best candidate of each word's agenda. Very long unbroken runs are first cut where no piece of the model stands across, so no
merge can; what is still long has an agenda of its own, a heap. Characters that no piece holds, and the space mark itself, become bytes, so decoding
gives back the text exactly.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_arrow, mix, slices, utf8

SEED, RATE = 7, 0.1
#: Characters of an unbroken run from which it is cut where no piece stands across, and from which it gets a heap.
LONG, HEAP = 64, 256
SPACE = "▁"
_NONE = np.int64(1) << np.int64(62)
_FIRST, _LAST = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_STEP = 0x9E3779B97F4A7C15
_BOTH = np.uint64((int(_FIRST) + int(_LAST)) % (1 << 64))


class Pieces:
    """Tables of a piece model: characters, merges by pair, ranks by score, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(k) for k in range(n)]
        plain = {p: k for k, p in enumerate(pieces) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))}
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("a piece of this model reaches over the start of a word")
        order = sorted(plain.values(), key=lambda k: (-model.get_score(k), k))
        self.rank = np.zeros(n, np.int64)
        self.rank[order] = np.arange(len(order))
        self.character = np.full(0x110000, -1, np.int32)
        for p, k in plain.items():
            if len(p) == 1:
                self.character[ord(p)] = k
        self.character[0x20] = self.character[ord(SPACE)]
        self.character[ord(SPACE)] = -1  # in a text it isn't a space
        pairs = {plain[p[:j]] << 32 | plain[p[j:]]: k for p, k in plain.items() for j in range(1, len(p)) if p[:j] in plain and p[j:] in plain}
        self.pairs, self._ranks = pairs, None
        self.plain, self.whole, self.begun = plain, None, None
        self.bits = np.uint64(64 - max(10, (8 * len(pairs)).bit_length()))
        size = 1 << (64 - int(self.bits))
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        for key, value in pairs.items():
            at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> int(self.bits)
            while self.keys[at] >= 0:
                at = (at + 1) & (size - 1)
            self.keys[at], self.values[at] = key, value
        self.bytes_id = np.zeros(256, np.int64)
        said = []
        for k, p in enumerate(pieces):
            if model.is_byte(k):
                self.bytes_id[int(p[3:5], 16)] = k
                said.append(bytes([int(p[3:5], 16)]))
            else:
                said.append(p.replace(SPACE, " ").encode() if p in plain else b"")
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_at = np.append(0, np.cumsum([len(x) for x in said]))

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the pieces a + b, -1 where there is none."""
        out = np.full(len(a), -1, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[todo].astype(np.int64) << np.int64(32) | b[todo]
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)
        while len(todo):
            found = self.keys[at]
            hit = found == key
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found >= 0)
            todo, key, at = todo[on], key[on], (at[on] + 1) & (len(self.keys) - 1)
        return out

    def _hash_pieces(self) -> None:
        """Hashes of the pieces of each length and of their beginnings, with a space for the mark; only long runs ask for them."""
        longest = max((len(p) for p in self.plain), default=1)
        whole: list[set] = [set() for _ in range(longest + 1)]
        begun: list[set] = [set() for _ in range(longest + 1)]
        for p in self.plain:
            h = 0
            for j, c in enumerate(p.replace(SPACE, " "), 1):
                h = (h * _STEP + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                if j > 1:
                    (whole if j == len(p) else begun)[j].add(h)
        self.whole, self.begun = ([np.array(sorted(x), np.uint64) for x in some] for some in (whole, begun))

    def crossed(self, point: np.ndarray) -> np.ndarray:
        """Which characters have a piece of the model across their left edge."""
        if self.whole is None:
            self._hash_pieces()
        n = len(point)
        turn = np.zeros(n + 1, np.int64)
        p = point.astype(np.uint64) + np.uint64(1)
        at, h = np.arange(n), p.copy()
        for length in range(2, len(self.whole)):
            on = at + length <= n
            at, h = at[on], h[on]
            h = h * np.uint64(_STEP) + p[at + length - 1]
            hit = at[among(h, self.whole[length])]
            np.add.at(turn, hit + 1, 1)
            np.add.at(turn, hit + length, -1)
            on = among(h, self.begun[length])
            at, h = at[on], h[on]
            if not len(at):
                break
        return np.cumsum(turn[:-1]) > 0

    def one_agenda(self, symbol: list[int], value: list[int], join: list[int], salt: int, start: int, limit: int) -> tuple[list[int], list[int]]:
        """Symbols and first characters of one long run after all merges; value and join: its first candidates."""
        n, none, mask = len(symbol), int(_NONE), (1 << 64) - 1
        first_by, last_by = int(_FIRST), int(_LAST)
        rank, pairs = self.rank_list(), self.pairs
        after, before, last = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(n))
        heap = [v << 32 | k for k, v in enumerate(value) if v != none]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            k = top & 0xFFFFFFFF
            if value[k] != top >> 32:
                continue
            other = after[k]
            symbol[k], last[k], after[k] = join[k], last[other], after[other]
            value[other], symbol[other] = none, -1
            if after[k] < n:
                before[after[k]] = k
            for a in (k, before[k]):
                if a < 0:
                    continue
                b = after[a]
                value[a] = none
                joined = pairs.get(symbol[a] << 32 | symbol[b]) if b < n else None
                if joined is None:
                    continue
                if limit:
                    x = (salt + (start + a) * first_by + (start + last[b]) * last_by) & mask
                    x ^= x >> 30
                    x = x * 0xBF58476D1CE4E5B9 & mask
                    x ^= x >> 27
                    x = x * 0x94D049BB133111EB & mask
                    if (x ^ x >> 31) >> 32 < limit:
                        continue
                value[a], join[a] = rank[joined], joined
                heapq.heappush(heap, rank[joined] << 32 | a)
        left = [k for k in range(n) if symbol[k] >= 0]
        return [symbol[k] for k in left], left

    def rank_list(self) -> list[int]:
        if self._ranks is None:
            self._ranks = self.rank.tolist()
        return self._ranks

    def encode(self, raw: np.ndarray, off: np.ndarray, keys: np.ndarray, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of utf8() and their bounds; keys: one number a row, which with rate decides what is skipped."""
        rows = len(off) - 1
        n_bytes = np.diff(off)
        full = np.flatnonzero(n_bytes)
        lead = (raw & 0xC0) != 0x80
        n = np.zeros(rows, np.int64)
        if len(full):
            n[full] = np.add.reduceat(lead, off[:-1][full], dtype=np.int64) + 1  # and the space put before
        bounds = np.append(0, np.cumsum(n))
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        point = np.full(bounds[-1], 0x20, np.uint32)
        inner = np.ones(len(point), bool)
        inner[bounds[:-1][full]] = False
        point[inner] = points
        symbol = self.character[point]
        space = point == 0x20
        fresh = np.ones(len(point), bool)
        fresh[1:] = space[1:] & ~space[:-1] | (symbol[1:] < 0) | (symbol[:-1] < 0)
        fresh[bounds[:-1][full]] = True
        edges = np.append(np.flatnonzero(fresh), len(point))
        for a in np.flatnonzero(np.diff(edges) > LONG):
            fresh[edges[a] : edges[a + 1]] |= ~self.crossed(point[edges[a] : edges[a + 1]])
        first = np.arange(len(point))
        doc = np.repeat(np.arange(rows), n)
        salt = keys[doc] - bounds[doc].astype(np.uint64) * _BOTH  # makes the hash one of places in the row
        limit = np.uint64(int(rate * 2**32))
        last, unit = first.copy(), np.cumsum(fresh) - 1
        done_symbol, done_first = [], []

        def score(at: np.ndarray) -> None:
            """Sets the candidates of the symbols at with those that follow."""
            ok = at[(at + 1 < len(symbol))]
            ok = ok[unit[ok] == unit[np.minimum(ok + 1, len(symbol) - 1)]]
            value[at] = _NONE
            merged = self.joined(symbol[ok], symbol[ok + 1])
            ok, merged = ok[merged >= 0], merged[merged >= 0]
            if limit:
                h = mix(salt[ok] + first[ok].astype(np.uint64) * _FIRST + last[ok + 1].astype(np.uint64) * _LAST) >> np.uint64(32)
                ok, merged = ok[h >= limit], merged[h >= limit]
            join[ok] = merged
            value[ok] = self.rank[merged]

        value, join = np.full(len(symbol), _NONE), np.zeros(len(symbol), np.int32)
        score(np.arange(len(symbol)))
        edges = np.append(np.flatnonzero(fresh), len(point))
        heaped = np.flatnonzero(np.diff(edges) > HEAP)
        if len(heaped):
            short = np.ones(len(point), bool)
            for a, b in zip(edges[heaped].tolist(), edges[heaped + 1].tolist(), strict=True):
                found, at = self.one_agenda(symbol[a:b].tolist(), value[a:b].tolist(), join[a:b].tolist(), int(salt[a]), a, int(limit))
                done_symbol.append(np.array(found, np.int32))
                done_first.append(np.array(at, np.int64) + a)
                short[a:b] = False
            symbol, first, last, unit, salt, value, join = (x[short] for x in (symbol, first, last, unit, salt, value, join))
        while len(symbol):
            starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            best = np.minimum.reduceat(np.where(value < _NONE, value << np.int64(32) | np.arange(len(value)), _NONE), starts)
            live = best < _NONE
            if live.mean() < 0.7:
                keep = np.repeat(live, np.diff(np.append(starts, len(symbol))))
                done_symbol.append(symbol[~keep])
                done_first.append(first[~keep])
                symbol, first, last, unit, salt, value, join = (x[keep] for x in (symbol, first, last, unit, salt, value, join))
                if not len(symbol):
                    break
                starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
                best = np.minimum.reduceat(np.where(value < _NONE, value << np.int64(32) | np.arange(len(value)), _NONE), starts)
                live = best < _NONE
            at = best[live] & np.int64(0xFFFFFFFF)
            symbol[at] = join[at]
            last[at] = last[at + 1]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, first, last, unit, salt, value, join = (x[keep] for x in (symbol, first, last, unit, salt, value, join))
            at = at - np.arange(len(at))  # one symbol less for each merge before
            before = at[at > 0] - 1
            score(np.concatenate([at, before]))
        symbol, first = np.concatenate([*done_symbol, symbol]), np.concatenate([*done_first, first])
        by = np.argsort(first)
        symbol, first = symbol[by].astype(np.int64), first[by]
        odd = np.flatnonzero(symbol < 0)
        if len(odd):  # characters without a piece: their bytes
            said = [chr(c).encode() for c in point[first[odd]].tolist()]
            size = np.ones(len(symbol), np.int64)
            size[odd] = [len(x) for x in said]
            where = np.cumsum(size) - size
            out = np.repeat(symbol, size)
            spread = np.repeat(where[odd], size[odd]) + np.concatenate([np.arange(len(x)) for x in said])
            out[spread] = self.bytes_id[np.frombuffer(b"".join(said), np.uint8)]
            return out, np.append(where, len(out))[np.searchsorted(first, bounds)]
        return symbol, np.searchsorted(first, bounds)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows, without the space put before each that has ids, and their bounds."""
        size = np.diff(self.said_at)[ids]
        total = np.append(0, np.cumsum(size))
        out = self.said[np.repeat(self.said_at[ids] - total[:-1], size) + np.arange(total[-1])]
        ends = total[bounds]
        full = np.flatnonzero(np.diff(bounds))
        keep = np.ones(len(out), bool)
        keep[ends[:-1][full]] = False
        return out[keep], ends - np.searchsorted(full, np.arange(len(bounds)))


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values stand in an ascending array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def encoded(docs: DataFrame, model_path: str | None = None, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """doc_id and ids of each row of docs (doc_id, text); rate 0 gives the model's own segmentation.

    A null text has null ids, an empty one none. Rows with the same doc_id share their skips, so equal rows stay equal; a
    null doc_id counts as 0. A long text without spaces takes time in proportion to its length, but for a logarithm. Other columns are ignored; an empty table gives an empty one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                text = batch.column(1).slice(a, b - a)
                ids, bounds = pieces.encode(*utf8(text), row_keys(batch.column(0).slice(a, b - a), seed), rate)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)), mask=text.is_null())
                yield pa.record_batch([batch.column(0).slice(a, b - a), lists], schema=schema)

    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def row_keys(doc_id: pa.Array, seed: int) -> np.ndarray:
    return mix(doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(seed * int(_FIRST) % (1 << 64)))


def decoded(encoded_: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids): the inverse of encoded()."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            lists = batch.column(1)
            bounds = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
            raw, ends = pieces.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bounds)
            data = raw.tobytes()
            texts = [None if null else data[a:b].decode() for a, b, null in zip(ends[:-1].tolist(), ends[1:].tolist(), lists.is_null().to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    return map_arrow(encoded_.select("doc_id", "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str | None = None, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit) and whether decoding gives the text back."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_())])
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                raw, off = utf8(batch.column(1).slice(a, b - a))
                ids, bounds = pieces.encode(raw, off, row_keys(batch.column(0).slice(a, b - a), seed), rate)
                back, ends = pieces.decode(ids, bounds)
                data = memoryview(ids.astype("<u4")).cast("B")
                sums = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                same = [np.array_equal(raw[w:x], back[y:z]) for w, x, y, z in zip(off[:-1], off[1:], ends[:-1], ends[1:], strict=True)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(sums, pa.int64()), pa.array(same)], schema=schema)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_ids long, ids_crc32 long, lossless boolean")


def op7_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


QUERIES = {"op7_piece_dropout": op7_piece_dropout}
ORACLE: dict[str, str] = {}
