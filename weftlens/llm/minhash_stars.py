"""Near-duplicate documents: minima of many universal hashes, bands, verification on signatures and full sets, stars.

Documents with equal shingle sets are one class, made by an aggregation that combines before the shuffle; only classes go on.
Classes that share a band value meet the value's pivot, its member that shares values with the most others, never each other:
rows stay linear in the size of a bucket. All buckets with one pivot form a group. A group of one pair is first verified on the signatures. Then
each member is compared with its pivot on full sets; what goes on is the member's difference from the pivot, which gives
exact intersections of members with one another (members far from the pivot go on with their sets). Members not linked to
the pivot are compared with each other and with the linked ones; a large group is cut into blocks of like members, and how many
elements of a difference stand in no other one rules out, exactly, most pairs of blocks. A pair of blocks gives a spanning
forest of its links. So no link between different texts is lost that shares a band, and none is listed twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, documents, map_arrow, mix, row_sums, slices, utf8, word_hashes, words
from .stars import components

WORDS = 5


@dataclass(frozen=True)
class MinHashParams:
    #: Links: 100 * intersection >= percent * union.
    percent: int = 85
    #: bands x rows minima. A pair at 0.85 misses all bands with probability (1 - 0.85 ** 4) ** 25 < 1e-8; at 0.80 that takes 35.
    bands: int = 25
    rows: int = 4
    #: A lone pair whose signatures agree less than this much below the threshold isn't compared on full sets. At 0.85 and 100
    #: minima that loses a pair at the threshold with probability below 1e-9 (binomial), less than the bands do.
    slack: float = 0.28
    #: Members from near_from on go on with their difference from the pivot, those under far_below with their sets.
    far_below: float = 0.60
    #: Members of a block: a sixteenth of the group between these bounds; and shingles of a block, which bound its memory
    #: (a single member may have more).
    block: tuple[int, int] = (128, 512)
    elements: int = 1 << 20

    @property
    def near_from(self) -> float:
        """Jaccard distance is a metric, so two linked members' similarities to the pivot differ by at most 1 - percent / 100:
        either both are under far_below or both from here on."""
        return self.far_below - (100 - self.percent) / 100 - 1e-9


#: A class of equal sets: its smallest doc_id and the set's hash, so rows that share a doc_id but not a text stay apart.
NODE = "struct<id: long, set: long>"
NODE_TYPE = pa.struct([("id", pa.int64()), ("set", pa.int64())])
#: The hash that names a set in NODE, and a second one that classes are told apart by as well.
SALTS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
#: Shared elements that are counted at once between the members of a block.
COLUMNS, SLICE = 2048, 1 << 19

_RNG = np.random.default_rng(8)
_STEPS = [np.uint64(x * 2 + 1) for x in _RNG.integers(1, 1 << 62, WORDS, dtype=np.uint64)]
_A = _RNG.integers(1, 1 << 62, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(1, 1 << 62, 512, dtype=np.uint64)


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, ascending within each row, and the rows' bounds."""
    raw, off = utf8(text)
    raw = LOWER[raw]
    starts, ends, at = words(raw, off)
    word = word_hashes(raw, starts, ends)
    n = np.diff(at)
    rows = len(n)
    row = np.repeat(np.arange(rows), n)
    left = np.repeat(at[1:], n) - np.arange(len(word))  # words from here to the row's end
    whole = np.zeros(len(word), np.uint64)
    for j, step in enumerate(_STEPS):
        ok = left > j
        part = np.zeros(len(word), np.uint64)
        part[ok] = word[np.flatnonzero(ok) + j] * step
        whole += part
    first = np.zeros(len(word), bool)
    first[at[:-1][n > 0]] = True
    keep = (left >= WORDS) | first  # a short row's only shingle starts at its first word
    value = mix(whole + np.minimum(left, WORDS).astype(np.uint64))[keep]
    row = row[keep]
    by = np.lexsort((value, row))
    value, row = value[by], row[by]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.searchsorted(row[new], np.arange(rows + 1))


def set_hash(value: np.ndarray, at: np.ndarray, salt: np.uint64) -> np.ndarray:
    return row_sums(mix(value ^ salt).view(np.int64), at)


def text_hash() -> list[Column]:
    """128 bits, t1 and t2, that with the doc_id tell rows apart."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit("text")).alias("t2")]


def sketch(docs: DataFrame, params: MinHashParams) -> DataFrame:
    """doc_id, n (shingles), 128-bit hashes of the text and of the set, the bands' hashes and 8 bits of each minimum."""
    schema = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("low", pa.binary())])
    count = params.bands * params.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                value, at = shingles(batch.column(1).slice(a, b - a))
                n = np.diff(at)
                sums = [set_hash(value, at, s) for s in SALTS]
                full = np.flatnonzero(n)
                least = np.zeros((count, b - a), np.uint32)
                for k in range(count if len(full) else 0):
                    least[k, full] = np.minimum.reduceat(((value * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), at[:-1][full])
                bands = np.zeros((b - a, params.bands), np.uint64)
                for k in range(params.bands):
                    h = np.full(b - a, k + 1, np.uint64)
                    for r in range(params.rows):
                        h = mix(h + least[k * params.rows + r])
                    bands[:, k] = h
                low = np.ascontiguousarray((least & 255).astype(np.uint8).T)
                size = np.where(n > 0, params.bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(bands[full].ravel().view(np.int64)))
                yield pa.record_batch([*[batch.column(c).slice(a, b - a) for c in (0, 2, 3)], pa.array(n), pa.array(sums[0]), pa.array(sums[1]), lists, pa.array([x.tobytes() for x in low], pa.binary())], schema=schema)

    return map_arrow(docs.select("doc_id", "text", *text_hash()), run, "doc_id long, t1 long, t2 long, n long, s1 long, s2 long, bands array<long>, low binary")


def full_sets(docs: DataFrame) -> DataFrame:
    """node (NODE) and the shingle hashes of each row of docs (doc_id, text) as bytes."""
    schema = pa.schema([("node", NODE_TYPE), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                value, at = shingles(batch.column(1).slice(a, b - a))
                node = pa.StructArray.from_arrays([batch.column(0).slice(a, b - a), pa.array(set_hash(value, at, SALTS[0]))], ["id", "set"])
                yield pa.record_batch([node, pa.array([value[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], schema=schema)

    return map_arrow(docs.select("doc_id", "text"), run, f"node {NODE}, set binary")


def against_pivot(pairs: DataFrame, params: MinHashParams) -> DataFrame:
    """From (p, x, covered, p_set, x_set): p, x, covered, linked, far, n (of x) and what x goes on with."""
    schema = pa.schema([("p", NODE_TYPE), ("x", NODE_TYPE), ("covered", pa.bool_()), ("linked", pa.bool_()), ("far", pa.bool_()), ("n", pa.int64()), ("load", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, rest = [], []
            for k, (a, b) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                differ = np.setxor1d(a, b, assume_unique=True)
                both = (len(a) + len(b) - len(differ)) // 2
                union = len(a) + len(b) - both
                linked = 100 * both >= params.percent * union
                if both >= params.near_from * union:
                    row.append(k)
                    rest.append((linked, False, len(b), differ.view(np.int64)))
                if both < params.far_below * union:
                    row.append(k)
                    rest.append((False, True, len(b), b.view(np.int64)))
            same = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:3]]
            yield pa.record_batch([*same, *[pa.array([r[k] for r in rest], schema.field(k + 3).type) for k in range(4)]], schema=schema)

    return map_arrow(pairs.select("p", "x", "covered", "p_set", "x_set"), run, f"p {NODE}, x {NODE}, covered boolean, linked boolean, far boolean, n long, load array<long>")


def lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Each row's numbers, read without a copy."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return (values[a:b].copy() for a, b in zip(at[:-1], at[1:], strict=True))


def common_elements(loads: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the loads (ascending numbers) share; a range of the numbers at a time, to bound memory."""
    m, total = len(loads), sum(len(x) for x in loads)
    both = np.zeros((m, m), np.float32)
    slices_ = max(1, -(-total // SLICE))
    edges = np.array([k * (1 << 64) // slices_ for k in range(1, slices_)], np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in loads]
    matrix = np.empty((m, COLUMNS), np.float32)
    for k in range(slices_):
        part = [x[c[k] : c[k + 1]] for x, c in zip(loads, cuts, strict=True)]
        who = np.repeat(np.arange(m), [len(x) for x in part])
        _, which, times = np.unique(np.concatenate(part), return_inverse=True, return_counts=True)
        shared = times > 1
        column = np.cumsum(shared) - 1
        keep = shared[which]
        who, which = who[keep], column[which[keep]]
        for at in range(0, int(shared.sum()), COLUMNS):
            some = (which >= at) & (which < at + COLUMNS)
            matrix[:] = 0
            matrix[who[some], which[some] - at] = 1
            both += matrix @ matrix.T
    return both


def forest(n: np.ndarray, loads: list[np.ndarray], linked: np.ndarray, covered: np.ndarray, far: bool, percent: int) -> list[tuple[int, int]]:
    """A spanning forest (index pairs) of the links among members, but for those whose both ends are linked to the pivot or
    are compared in another group."""
    m = len(n)
    if not m:
        return []
    size = np.array([len(x) for x in loads])
    both = common_elements(loads)
    link = np.empty((m, m), bool)
    for a in range(0, m, 128):  # rows at a time, to bound memory
        b = min(a + 128, m)
        shared = both[a:b].astype(np.int64)
        common = shared if far else (n[a:b, None] + n[None, :] - (size[a:b, None] + size[None, :] - 2 * shared)) // 2
        link[a:b] = 100 * common >= percent * (n[a:b, None] + n[None, :] - common)
        link[a:b] &= ~(linked[a:b, None] & linked[None, :]) & ~(covered[a:b, None] & covered[None, :])
    open_, edges = np.ones(m, bool), []
    for root in range(m):
        if not open_[root]:
            continue
        open_[root] = False
        todo = [root]
        while todo:
            u = todo.pop()
            new = np.flatnonzero(link[u] & open_)
            open_[new] = False
            edges += [(u, int(v)) for v in new]
            todo += new.tolist()
    return edges


def alone_elements(large: DataFrame, params: MinHashParams) -> DataFrame:
    """(p, far, x, u): how many elements of a member's load no other member of its group has, by range of the elements' hashes.

    A member is one row a range, and a group has one range for each params.elements of its e elements, so rows are in proportion
    to members and a task holds one range of one group.
    """
    ranges = F.ceil(F.col("e") / params.elements).cast("int")
    cut = large.select("p", "far", "x", "load", F.explode(F.sequence(F.lit(0), ranges - 1)).alias("_k"), ranges.alias("_n"))
    part = F.when(F.col("_n") == 1, F.col("load")).otherwise(F.filter("load", lambda e: F.pmod(F.xxhash64(e), F.col("_n")) == F.col("_k")))
    dealt = cut.select("p", "far", "_k", "x", part.alias("load")).where(F.size("load") > 0)
    key = ["p", "far", "_k"]
    sorted_ = dealt.repartition(int(large.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key)
    schema = pa.schema([("p", NODE_TYPE), ("far", pa.bool_()), ("x", NODE_TYPE), ("u", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[dict, np.ndarray]] = []
        now = None

        def close() -> pa.RecordBatch:
            loads = [r[1] for r in held]
            _, first, times = np.unique(np.concatenate(loads), return_index=True, return_counts=True)
            owner = np.repeat(np.arange(len(loads)), [len(x) for x in loads])[first[times == 1]]
            u = np.bincount(owner, minlength=len(loads))
            out = pa.record_batch([pa.array([now[0]] * len(held), NODE_TYPE), pa.array([now[1]] * len(held)), pa.array([r[0] for r in held], NODE_TYPE), pa.array(u, pa.int64())], schema=schema)
            held.clear()
            return out

        for batch in batches:
            c = [batch.column(k).to_pylist() for k in range(4)]
            for p, far, k, x, load in zip(*c, lists(batch.column(4)), strict=True):
                if (p, far, k) != now and held:
                    yield close()
                now = (p, far, k)
                held.append((x, load))
        if held:
            yield close()

    return map_arrow(sorted_, run, f"p {NODE}, far boolean, x {NODE}, u long")


def blocked(members: DataFrame, sizes: DataFrame, params: MinHashParams, scratch: Scratch) -> DataFrame:
    """Members of large groups (sizes: p, far, m, e) with the pairs of blocks (_i, _j) that may hold a link.

    x and z can only be linked if their differences from the pivot differ in at most d = (100 - percent) / percent * n elements.
    With t elements in a difference, u of them in no other one and w = t - u, that asks for t_x - d <= w_z - u_z and the same
    the other way round. Blocks hold members of like t - d and w - u, so their bounds decide.
    """
    low, high = params.block
    large = scratch.table(members.join(sizes, ["p", "far"]), "large")
    alone = alone_elements(large, params).groupBy("p", "far", "x").agg(F.sum("u").alias("u"))
    t, u, d = F.size("load"), F.coalesce("u", F.lit(0)), F.col("n") * (100 - params.percent) / params.percent
    known = large.drop("e").join(alone, ["p", "far", "x"], "left").withColumns({"_r": F.when(F.col("far"), 0.0).otherwise(t - d - 1e-6), "_v": F.when(F.col("far"), 0.0).otherwise((t - 2 * u).cast("double"))})
    known = known.where(F.when(F.col("far"), 100 * (t - u) >= params.percent * F.col("n")).otherwise(u <= d + 1e-6))

    def step(c: str) -> Column:
        return F.greatest(F.lit(-4), F.least(F.lit(4), F.floor(4 * F.col(c) / d).cast("int")))

    kinds = ["p", "far", "linked", "covered", "_rs", "_vs"]
    known = scratch.table(known.withColumns({"_rs": step("_r"), "_vs": step("_v")}).drop("u"), "known")
    size = F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.max("m") / 16)))
    many = F.greatest(F.ceil(F.count("*") / size), F.ceil(F.sum(F.size("load")) / params.elements))
    parts = scratch.table(known.groupBy(*kinds).agg(many.cast("int").alias("_parts")), "parts")
    own = known.join(parts, kinds).withColumn("_block", F.concat_ws(":", F.col("linked").cast("string"), F.col("covered").cast("string"), "_rs", "_vs", F.pmod(F.xxhash64("x", F.lit("block")), "_parts").cast("string")))
    bounds = scratch.table(own.groupBy("p", "far", "_block", "linked", "covered").agg(F.min("_r").alias("r"), F.max("_v").alias("v")), "bounds")
    a, b = (bounds.select("p", "far", *[F.col(c).alias(f"{side}{c}") for c in ("_block", "linked", "covered", "r", "v")]) for side in "ab")
    pairs = a.join(b, ["p", "far"]).where("a_block <= b_block and not (alinked and blinked) and not (acovered and bcovered) and ar <= bv and br <= av")
    sides = F.explode(F.when(F.col("a_block") == F.col("b_block"), F.array("a_block")).otherwise(F.array("a_block", "b_block")))
    met = scratch.table(pairs.select("p", "far", F.col("a_block").alias("_i"), F.col("b_block").alias("_j"), sides.alias("_block")), "block-pairs")
    return own.join(met, ["p", "far", "_block"]).select("p", "far", "_i", "_j", "x", "linked", "covered", "n", "load")


def between_members(members: DataFrame, params: MinHashParams, scratch: Scratch) -> DataFrame:
    """Edges (u, v) among the members of each group, from blocks of at most a bounded number of members."""
    spark = members.sparkSession
    low, high = params.block
    load, open_ = F.size("load"), ~F.col("covered")
    counts = [F.count("*").alias("m"), F.count_if(~F.col("linked")).alias("f"), F.count_if(open_).alias("o"), F.sum(load).alias("e"), F.sum(F.when(open_, load).otherwise(0)).alias("eo")]
    sizes = scratch.table(members.groupBy("p", "far").agg(*counts).where("f > 0 and o > 0 and m > 1").drop("f"), "sizes")
    columns = ["x", "linked", "covered", "n", "load"]
    small = (F.col("m") <= low) & (F.col("e") <= params.elements)
    few_open = (F.col("o") <= low) & (F.col("eo") <= params.elements)
    few = members.join(sizes.where(small), ["p", "far"]).select("p", "far", F.lit("").alias("_i"), F.lit("").alias("_j"), *columns)
    # few members that no other group covers: each block of the covered ones meets them all
    blocks = F.greatest(F.lit(1), F.ceil((F.col("m") - F.col("o")) / high), F.ceil((F.col("e") - F.col("eo")) / params.elements))
    some = members.join(sizes.where(~small & few_open).withColumn("_n", blocks.cast("int")), ["p", "far"])
    where = F.when(F.col("covered"), F.array(F.pmod(F.xxhash64("x", F.lit("block")), "_n").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("_n") - 1))
    some = some.withColumn("_b", F.explode(where)).select("p", "far", F.col("_b").cast("string").alias("_i"), F.lit("").alias("_j"), *columns)
    dealt = few.union(some).union(blocked(members, sizes.where(~small & ~few_open).select("p", "far", "m", "e"), params, scratch))
    key = ["p", "far", "_i", "_j"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(parts, *key).sortWithinPartitions(*key)
    schema = pa.schema([("u", NODE_TYPE), ("v", NODE_TYPE)])
    percent = params.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        edges: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                x = [r[0] for r in held]
                found = forest(np.array([r[3] for r in held], np.int64), [r[4] for r in held], np.array([r[1] for r in held], bool), np.array([r[2] for r in held], bool), now[1], percent)
                edges.extend((x[a], x[b]) for a, b in found)
            held.clear()

        for batch in batches:
            c = [batch.column(k).to_pylist() for k in range(8)]
            for p, far, i, j, x, linked, covered, n, load in zip(*c, lists(batch.column(8)), strict=True):
                if (p, far, i, j) != now:
                    close()
                    now = (p, far, i, j)
                held.append((x, linked, covered, n, load))
            if edges:
                yield pa.record_batch([pa.array([e[k] for e in edges], NODE_TYPE) for k in range(2)], schema=schema)
                edges.clear()
        close()
        if edges:
            yield pa.record_batch([pa.array([e[k] for e in edges], NODE_TYPE) for k in range(2)], schema=schema)

    return map_arrow(sorted_, run, f"u {NODE}, v {NODE}")


def near_duplicates(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text).

    Null texts and texts without words have no shingles and are their own component; texts of one to four words are one
    shingle, so equal ones are linked. Each row is a document: rows that share a doc_id are linked only through their own
    texts, and equal rows, which are in one component, have equal results. Rows without a doc_id are linked with nothing and
    kept. Ties don't arise: a component is named by its smallest doc_id. Very long texts are held whole by the tasks that
    compare them, one block at a time. Other columns are ignored; an empty table gives an empty one. A pair at the threshold is
    lost if it shares no band or, alone in its group, if its signatures differ by chance: together with probability below 1e-8.
    """
    return _near(docs, params)[0].select("doc_id", "n_shingles", "component_id", "kept")


def _near(docs: DataFrame, params: MinHashParams) -> tuple[DataFrame, Scratch]:
    """The result of near_duplicates() with the text's hashes t1, t2 of each row, and its scratch tables."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select("doc_id", "text")
    every = scratch.table(sketch(docs, params), "sketches")
    # equal sets are one class; low and bands are functions of the set
    classes = every.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    classes = scratch.table(classes.withColumn("rep", F.struct("id", F.col("s1").alias("set"))).drop("id"), "classes")
    rows = classes.select("rep", F.explode("bands").alias("key"))
    sizes = scratch.table(rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "sizes-of-buckets")
    shared = scratch.table(rows.join(sizes, "key"), "shared")
    # the member that meets the most others, as a rule the one that the others were copied from, is the pivot of all its buckets
    liked = scratch.table(shared.groupBy("rep").agg(F.sum("m").alias("meets")), "liked")
    ranked = scratch.table(shared.join(liked, "rep").select("key", "rep", "meets"), "ranked")
    scratch.drop("shared")
    pivots = scratch.table(ranked.groupBy("key").agg(F.max(F.struct("meets", F.xxhash64("rep", F.lit("priority")).alias("h"), "rep")).alias("pivot")).select("key", F.col("pivot.rep").alias("p")), "pivots")
    met = scratch.table(ranked.join(pivots, "key").where("rep <> p").select("p", F.col("rep").alias("x")).distinct(), "met")
    scratch.drop("ranked")
    # a pair alone in its group is verified on the signatures first
    few = scratch.table(met.groupBy("p").agg(F.count("*").alias("m"), F.min("x").alias("x")), "few")
    one = classes.select("rep", "n", "low")
    lone = few.where("m = 1").select("p", "x").join(one.toDF("p", "p_n", "p_low"), "p").join(one.toDF("x", "x_n", "x_low"), "x")
    lone = signatures_agree(lone, params)
    # a member is covered if it also is in the group of its pivot's own favourite pivot: two such meet there
    best = F.max(F.struct("meets", F.xxhash64("p", F.lit("priority")).alias("h"), "p"))
    parents = scratch.table(met.join(liked.toDF("p", "meets"), "p").groupBy(F.col("x").alias("child")).agg(best.alias("b")).select(F.col("child").alias("p"), F.col("b.p").alias("parent")), "parents")
    under = met.join(few.where("m > 1").select("p"), "p").join(parents, "p", "left")
    again = met.select(F.col("p").alias("parent"), "x", F.lit(True).alias("_there"))
    covered = F.coalesce(F.col("_there") | (F.col("x") == F.col("parent")), F.col("x") == F.col("parent"), F.lit(False))
    held = under.join(again, ["parent", "x"], "left").select("p", "x", covered.alias("covered"))
    pairs = scratch.table(held.union(lone.select("p", "x", F.lit(False).alias("covered"))), "pairs")
    wanted = scratch.table(pairs.select(F.explode(F.array("p.id", "x.id")).alias("doc_id")).distinct(), "wanted")
    sets = scratch.table(full_sets(docs.join(wanted, "doc_id")).dropDuplicates(["node"]), "sets")
    with_x = pairs.join(sets.toDF("x", "x_set"), "x")
    members = scratch.table(against_pivot(with_x.join(sets.toDF("p", "p_set"), "p"), params), "members")
    scratch.drop("sets")
    edges = members.where("linked").select(F.col("p").alias("u"), F.col("x").alias("v")).union(between_members(members, params, scratch))
    roots = components(edges, scratch)
    named = classes.select("s1", "s2", "n", "rep").join(roots.toDF("rep", "root"), "rep", "left").select("s1", "s2", "n", F.coalesce("root", "rep")["id"].alias("component"))
    named = scratch.table(named, "named")
    out = every.select("doc_id", "t1", "t2", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "t1", "t2"), scratch


def without_near_duplicates(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """The rows of docs (doc_id, text, any others) that near_duplicates() keeps; of rows equal in doc_id and text one stays.

    Rows go by doc_id and text, so a row with the doc_id of another one isn't removed on that one's account; two texts of one
    component that share its smallest doc_id both stay. Rows without a doc_id, and those without words, stay.
    """
    found, scratch = _near(docs, params)
    key = ["doc_id", "t1", "t2"]
    rows = found.where("doc_id is not null").groupBy(*key).agg(F.bool_and("kept").alias("kept"), F.count("*").alias("m")).where("not kept or m > 1")
    rows = scratch.table(rows, "rows-that-go-or-repeat")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_rest")  # so no name can clash
    hashed = docs.select("doc_id", rest, *[h.alias(f"_{h_}") for h, h_ in zip(text_hash(), ("t1", "t2"), strict=True)])
    rows = rows.toDF("_doc_id", "_t1", "_t2", "_kept", "_m")
    same = (F.col("doc_id") == F.col("_doc_id")) & (hashed["_t1"] == rows["_t1"]) & (hashed["_t2"] == rows["_t2"])
    out = hashed.join(rows, same, "left_anti").select("_rest")
    repeated = rows.where("_kept")
    if not repeated.isEmpty():
        out = out.union(hashed.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_t1", "_t2"]).select("_rest"))
    return out.select(*[F.col("_rest").getField(c).alias(c) for c in docs.columns])


def signatures_agree(pairs: DataFrame, params: MinHashParams) -> DataFrame:
    """The pairs (p, x) of those with p_n, x_n, p_low, x_low that may reach the threshold."""
    schema = pa.schema([("p", NODE_TYPE), ("x", NODE_TYPE)])
    least = params.percent / 100 - params.slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            ok = 100 * np.minimum(n, m) >= params.percent * np.maximum(n, m)
            for k in np.flatnonzero(ok):
                a, b = (np.frombuffer(batch.column(c)[int(k)].as_buffer(), np.uint8) for c in (4, 5))
                ok[k] = (a == b).mean() >= least
            yield pa.record_batch([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(ok))

    return map_arrow(pairs.select("p", "x", "p_n", "x_n", "p_low", "x_low"), run, f"p {NODE}, x {NODE}")


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op8_minhash_neardup": op8_minhash_neardup}
ORACLE: dict[str, str] = {}
