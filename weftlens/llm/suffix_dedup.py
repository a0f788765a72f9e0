"""Removal of byte strings of a fixed length that stand anywhere else: suffix sorting by difference covers, in blocks.

Every window of LENGTH bytes belongs to one anchor: of the grams in it, the leftmost one with the least hash. Equal windows
so have equal anchors at equal offsets. Anchors that stand once, the most by far, end there. All windows of one anchor place
are a context. Contexts that are equal are settled by counting; only anchors with different contexts (where a repeat starts
or ends) need bytes, one copy of each context. An anchor with many contexts is split by content: windows at like offsets share
a longer core, whose hash is the new key, and most of those stand once. What is left is dealt by key, and each pool of it is
suffix-sorted: ranks of a difference-cover sample first, then one bucket of suffixes at a time, by its
leading bytes and, where those tie, by the ranks of the sample suffixes that the cover puts at one distance behind both.
Should a core still have very many contexts, it is dealt to several keys, and windows that are alone under theirs are counted
once more by their own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Spans, documents, map_arrow, mix, slices, utf8

LENGTH = 200
#: Bytes of an anchor.
GRAM = 48
#: Contexts of one anchor that go to one key, and bytes of contexts that are sorted together.
CONTEXTS, POOL = 256, 1 << 20
#: Windows that share a core when an anchor has more contexts than that.
CORE = 16
#: A difference cover modulo PERIOD: each difference is that of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Suffixes of a bucket that is sorted at a time; a leading byte with more is a bucket of its own.
BUCKET = 1 << 17


#: 128 bits that tell rows of documents apart.
KEY = "struct<a: long, b: long>"
KEY_TYPE = pa.struct([("a", pa.int64()), ("b", pa.int64())])


def _key() -> Column:
    """KEY of a row (rows equal in doc_id and text are one)."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", F.lit("row"), "doc_id").alias("b"))


def contexts_of(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, first window, windows, anchor hash, context hash and the anchor's distance from the first window of every anchor place."""
    n = len(raw)
    wide = length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none, none
    spans = Spans(raw)
    grams = n - gram + 1
    at = np.arange(grams)
    value = mix((spans.sums[gram:] - spans.sums[:grams]) * spans.back[:grams])
    bits = np.uint64(max(1, int(grams).bit_length()))
    key = (value >> bits << bits) | at.astype(np.uint64)
    width = 1
    while 2 * width <= wide:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    if width < wide:
        key = np.minimum(key[: len(key) - (wide - width)], key[wide - width :])
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # of window i: its anchor's position
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(place)]
    valid = np.arange(len(place)) + length <= off[row + 1]
    start = valid.copy()
    start[1:] &= (place[1:] != place[:-1]) | ~valid[:-1] | (row[1:] != row[:-1])
    first = np.flatnonzero(start)
    # a run of windows ends where the next starts or where windows stop being valid
    stop = np.flatnonzero(valid & ~np.append(valid[1:], False) | valid & np.append(start[1:], True))
    many = stop - first + 1
    anchor = place[first]
    whole = mix(spans.hash(first, first + many - 1 + length) + (anchor - first).astype(np.uint64))
    return row[first], first - off[row[first]], many, value[anchor].view(np.int64), whole.view(np.int64), anchor - first


def anchors(docs: DataFrame) -> DataFrame:
    """anchor, context, k (row), s (first window), n (windows) and o (the anchor's distance from s) of every anchor place of docs (k, text)."""
    schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("k", KEY_TYPE), ("s", pa.int64()), ("n", pa.int16()), ("o", pa.int16())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                row, s, n, anchor, context, o = contexts_of(*utf8(batch.column(1).slice(a, b - a)))
                yield pa.record_batch([pa.array(anchor), pa.array(context), batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(s), pa.array(n, pa.int16()), pa.array(o, pa.int16())], schema=schema)

    return map_arrow(docs, run, f"anchor long, context long, k {KEY}, s long, n short, o short")


def _distances() -> np.ndarray:
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            out[a, b] = next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
    return out


DISTANCE = _distances()


def sample_ranks(words8: np.ndarray, n: int, length: int) -> np.ndarray:
    """Ranks of the cover's positions below n by at least length bytes, by doubling; other positions hold 0."""
    at = np.arange(n)
    sample = at[np.isin(at % PERIOD, COVER)]
    rank = np.zeros(n + 2 * length + PERIOD, np.int64)

    def name(keys: tuple[np.ndarray, ...]) -> None:
        by = np.lexsort(keys[::-1])
        new = np.ones(len(by), bool)
        new[1:] = False
        for key in keys:
            new[1:] |= key[by][1:] != key[by][:-1]
        rank[sample[by]] = np.cumsum(new)

    name((words8[sample], words8[sample + 8] >> np.uint64(8 * (16 - PERIOD))))
    depth = PERIOD
    while depth < length:
        name((rank[sample] << np.int64(32) | rank[sample + depth],))
        depth *= 2
    return rank


def window_classes(text: np.ndarray, starts: np.ndarray, length: int = LENGTH, bucket: int = BUCKET) -> np.ndarray:
    """Numbers that are equal for those starts whose next length bytes of text are equal."""
    n = len(text)
    padded = np.zeros(n + 2 * length + 32, np.uint8)
    padded[:n] = text
    words8 = padded.astype(np.uint64)
    for k in (1, 2, 4):
        words8[: len(words8) - k] = words8[: len(words8) - k] << np.uint64(8 * k) | words8[k:]
        words8[len(words8) - k :] <<= np.uint64(8 * k)
    rank = sample_ranks(words8, n, length)
    out = np.zeros(len(starts), np.int64)
    lead = padded[starts]
    edges = np.append(0, np.cumsum(np.bincount(lead, minlength=256)))
    by_lead = np.argsort(lead, kind="stable")
    number, byte = 0, 0
    while byte < 256:
        to = byte + 1
        while to < 256 and edges[to + 1] - edges[byte] <= bucket:
            to += 1
        some = by_lead[edges[byte] : edges[to]]
        byte = to
        if not len(some):
            continue
        p = starts[some]
        order = _sorted_bucket(words8, rank, p)
        some, p = some[order], p[order]
        same = np.ones(len(p) - 1, bool)
        for k in range(0, length - 7, 8):
            left = np.flatnonzero(same)
            if not len(left):
                break
            same[left] = words8[p[left] + k] == words8[p[left + 1] + k]
        left = np.flatnonzero(same)
        same[left] = words8[p[left] + length - 8] == words8[p[left + 1] + length - 8]
        ids = number + np.append(0, np.cumsum(~same))
        out[some] = ids
        number = int(ids[-1]) + 1
    return out


def _sorted_bucket(words8: np.ndarray, rank: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The order of suffixes p: PERIOD bytes, then the cover's ranks where those tie."""
    high, rest = words8[p], words8[p + 8] >> np.uint64(8 * (16 - PERIOD))
    by = np.lexsort((rest, high))
    new = np.ones(len(p), bool)
    new[1:] = (high[by][1:] != high[by][:-1]) | (rest[by][1:] != rest[by][:-1])
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    tied = np.flatnonzero(size[group] > 1)
    if not len(tied):
        return by
    q, g = p[by[tied]], group[tied].astype(np.int64) << np.int64(32)
    residue = q % PERIOD
    classes = [np.flatnonzero(residue == r) for r in range(PERIOD)]
    before = np.zeros(len(tied), np.int64)
    for b, ys in enumerate(classes):
        if not len(ys):
            continue
        sorted_by: dict[int, np.ndarray] = {}
        for a, xs in enumerate(classes):
            if len(xs):
                d = int(DISTANCE[a, b])
                if d not in sorted_by:
                    sorted_by[d] = np.sort(g[ys] | rank[q[ys] + d])
                keys = sorted_by[d]
                before[xs] += np.searchsorted(keys, g[xs] | rank[q[xs] + d]) - np.searchsorted(keys, g[xs])
    by[tied] = by[tied][np.lexsort((before, g))]
    return by


def sort_pools(needed: DataFrame, length: int = LENGTH) -> DataFrame:
    """From (anchor, salt, salts, many, k, s, n, bytes), ordered by (anchor, salt) within partitions, runs of windows.

    rows (k, s, n, h, g): repeated windows if h is null, else one window (n = 1, or n = 2 if its class is settled) to be
    counted by its hash.
    """
    schema = pa.schema([("k", KEY_TYPE), ("s", pa.int64()), ("n", pa.int32()), ("h", pa.int64()), ("g", pa.int64())])

    def settle(held: list[tuple]) -> pa.RecordBatch:
        group, salts, many, k, s, n, data = zip(*held, strict=True)
        n_, group_ = np.array(n, np.int64), np.array(group, np.int64)
        base = np.append(0, np.cumsum([len(x) for x in data]))[:-1]
        text = np.frombuffer(b"".join(data), np.uint8)
        row = np.repeat(np.arange(len(n_)), n_)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n_) - n_, n_)
        starts = base[row] + within
        found = window_classes(text, starts, length)
        # equal windows have equal anchors, so classes never cross groups but for chance
        _, found = np.unique(found * (group_.max() + 1) + group_[row], return_inverse=True)
        times = np.bincount(found)
        known = np.zeros(len(times), bool)
        known[found[np.array(many, bool)[row]]] = True
        hit = (times[found] > 1) | known[found]
        hit &= ~np.array(many, bool)[row]  # those were settled by counting
        turn = hit.copy()
        turn[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
        first = np.flatnonzero(turn)
        last = np.flatnonzero(hit & np.append(~hit[1:] | (row[1:] != row[:-1]), True))
        k_, s_ = pa.array(k, KEY_TYPE), np.array(s, np.int64)
        out_s, out_n = s_[row[first]] + within[first], last - first + 1
        again = np.flatnonzero(np.array(salts, np.int64)[row] > 1)
        if len(again):
            _, one = np.unique(found[again], return_index=True)
            again = again[one]
        spans = Spans(text)
        h = spans.hash(starts[again], starts[again] + length)
        g = spans_alt(text, starts[again], length)
        size = np.where((times[found[again]] > 1) | known[found[again]], 2, 1)
        none = pa.nulls(len(out_s), pa.int64())
        return pa.record_batch([k_.take(pa.array(np.append(row[first], row[again]))), pa.array(np.append(out_s, s_[row[again]] + within[again])), pa.array(np.append(out_n, size), pa.int32()), pa.concat_arrays([none, pa.array(h.view(np.int64))]), pa.concat_arrays([none, pa.array(g.view(np.int64))])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, now, number = 0, None, 0
        for batch in batches:
            for anchor, salt, *rest in zip(*[batch.column(c).to_pylist() for c in range(8)], strict=True):
                if (anchor, salt) != now:
                    if size > POOL:
                        yield settle(held)
                        held, size, number = [], 0, 0
                    now, number = (anchor, salt), number + 1
                held.append((number, *rest))
                size += len(rest[-1])
        if held:
            yield settle(held)

    return map_arrow(needed, run, f"k {KEY}, s long, n int, h long, g long")


def spans_alt(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A second hash of windows, of their bytes in another coding."""
    return Spans(((text.astype(np.uint16) * 167 + 89) % 256).astype(np.uint8)).hash(starts, starts + length)


def repeated_windows(docs: DataFrame, placed: DataFrame, scratch: Scratch, count_first: bool = True) -> DataFrame:
    """k and the runs [(s, n)] of windows of docs (k, text) that also stand elsewhere; placed: their anchors(), kept.

    Without count_first equal contexts are not settled by counting: the suffix sort decides on each place of an anchor that
    stands more than once. The result is the same; whole copies then cost as many bytes to sort as they have.
    Counts are written before they are joined back, so that the joins read two plain exchanges and Spark can split hot keys.
    """
    twice = scratch.table(placed.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor"), "twice")
    seen = scratch.table(placed.join(twice, "anchor"), "seen")
    place = F.struct("k", "s", "n", "o")
    every = seen.select("anchor", "context", F.lit(1).alias("m"), place.alias("r"))
    one = scratch.table(seen.groupBy("anchor", "context").agg(F.count("*").alias("m"), F.min(place).alias("r")) if count_first else every, "contexts")
    counted = seen.join(one.where("m > 1").select("anchor", "context"), ["anchor", "context"]).select("k", "s", F.col("n").cast("int").alias("n"))
    kinds = scratch.table(one.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1"), "kinds")
    wanted = one.join(kinds, "anchor").select("anchor", (F.col("contexts") > CONTEXTS).alias("split"), (F.col("m") > 1).alias("many"), "r.k", "r.s", "r.n", "r.o")
    by_row = wanted.groupBy("k").agg(F.collect_list(F.struct("anchor", "split", "many", "s", "n", "o")).alias("w"))
    bytes_ = scratch.table(_cut(docs.join(by_row, "k").select("k", "text", "w")), "bytes")
    plain = bytes_.where("not split").select("anchor", F.lit(0).alias("salt"), F.lit(1).alias("salts"), "many", "k", "s", "n", "bytes")
    cores = bytes_.where("split")
    piece = F.struct("k", "s", "n", "bytes")
    every = cores.select("anchor", "context", F.lit(1).alias("m"), "many", piece.alias("r"))
    core = scratch.table(cores.groupBy("anchor", "context").agg(F.count("*").alias("m"), F.max("many").alias("many"), F.min(piece).alias("r")) if count_first else every, "cores")
    settled = cores.where("not many").join(core.where("m > 1 or many").select("anchor", "context"), ["anchor", "context"]).select("k", "s", "n")
    core_kinds = scratch.table(core.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1").select("anchor", F.ceil(F.col("contexts") / CONTEXTS).cast("int").alias("salts")), "core-kinds")
    rest = core.join(core_kinds, "anchor").select("anchor", F.pmod("context", "salts").cast("int").alias("salt"), "salts", (F.col("many") | (F.col("m") > 1)).alias("many"), "r.k", "r.s", "r.n", "r.bytes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = plain.union(rest)
    sorted_ = scratch.table(sort_pools(needed.repartition(parts, "anchor", "salt").sortWithinPartitions("anchor", "salt")), "sorted")
    local = sorted_.where("h is null").select("k", "s", "n")
    again = sorted_.where("h is not null")
    elsewhere = scratch.table(again.groupBy("h", "g").agg(F.count("*").alias("m")).where("m > 1").select("h", "g"), "elsewhere")
    far = again.where("n = 1").join(elsewhere, ["h", "g"]).select("k", "s", "n")
    runs = reduce(DataFrame.union, [counted, settled, local, far])
    return runs.groupBy("k").agg(F.collect_list(F.struct("s", "n")).alias("runs"))


def split_by_core(data: bytes, anchor: int, s: int, n: int, o: int) -> list[tuple[int, int, int, int, bytes]]:
    """New key, context, first window, windows and bytes of the parts of one context whose windows share a core.

    A window's offset is the anchor's distance from its start; those with the same offset // CORE share a core, which lies in
    every window of that range of offsets, whether it is in this context or not.
    """
    out = []
    at, end = s, s + n
    while at < end:
        offset = o - (at - s)
        group = offset // CORE
        to = min(end, at + offset - group * CORE + 1)
        begin = s + o - group * CORE
        core = data[begin : begin - CORE + 1 + LENGTH]
        part = data[at : to - 1 + LENGTH]
        key = hashlib.blake2b(core, digest_size=8, key=(anchor & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"), person=group.to_bytes(2, "little"))
        whole = hashlib.blake2b(part, digest_size=8, key=offset.to_bytes(8, "little"))
        out.append((int.from_bytes(key.digest(), "little", signed=True), int.from_bytes(whole.digest(), "little", signed=True), at, to - at, part))
        at = to
    return out


def _cut(rows: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts of (k, text, w); those of anchors to be split as their parts, under new keys."""
    schema = pa.schema([("split", pa.bool_()), ("many", pa.bool_()), ("k", KEY_TYPE), ("anchor", pa.int64()), ("context", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                data = text.as_py()
                for w in wanted:
                    if w["split"]:
                        out += [(True, w["many"], k, *part) for part in split_by_core(data, w["anchor"], w["s"], w["n"], w["o"])]
                    else:
                        out.append((False, w["many"], k, w["anchor"], 0, w["s"], w["n"], data[w["s"] : w["s"] + w["n"] - 1 + LENGTH]))
            yield pa.record_batch([pa.array([r[c] for r in out], f.type) for c, f in enumerate(schema)], schema=schema)

    return map_arrow(rows, run, f"split boolean, many boolean, k {KEY}, anchor long, context long, s long, n int, bytes binary")


def cover(runs: list[dict] | None, n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the windows of the runs, ascending."""
    if not runs:
        return []
    s = np.array([r["s"] for r in runs], np.int64)
    e = s + np.array([r["n"] for r in runs], np.int64) - 1 + length
    by = np.argsort(s, kind="stable")
    s, e = s[by], np.maximum.accumulate(e[by])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return list(zip(s[first].tolist(), e[np.append(first[1:], len(s)) - 1].tolist(), strict=True))


def repeats_removed(docs: DataFrame, count_first: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs (doc_id, text).

    Null texts are empty; texts under LENGTH bytes have no window and stay whole. Every copy of a repeat goes, its first one
    too, and a string that stands twice in one document counts. Rows that repeat another, doc_id and all, are places of their
    own, so they lose their windows. A very long text is hashed as one chunk, and its runs are cut from it row by row. Other
    columns are ignored; an empty table gives an empty one. count_first: see repeated_windows().
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    keyed = docs.select("doc_id", "text", _key().alias("k"))
    long_ = keyed.where(F.octet_length("text") >= LENGTH).select("k", "text")
    placed = scratch.table(anchors(long_), "anchors")
    found = repeated_windows(long_, placed, scratch, count_first)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                data = text.as_py() or b""
                gone = cover(runs, len(data))
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                rows.append((len(data), sum(b - a for a, b in gone), len(gone), kept.hexdigest()))
            yield pa.record_batch([batch.column(0), *[pa.array([r[c] for r in rows], schema.field(c + 1).type) for c in range(4)]], schema=schema)

    return map_arrow(keyed.join(found, "k", "left").select("doc_id", "text", "runs"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(documents(spark, sf_dir))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
ORACLE: dict[str, str] = {}
