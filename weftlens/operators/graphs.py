"""Graphs kept as edge tables (key, src, dst, length): components, paths between key points, longest shortest routes.

A step groups by key and node, never by key alone, so a graph of any size is dealt over tasks. Each round is written to the
shared folder, and what two joins read is written first, so that they read plain exchanges that Spark can split where a node is hot.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from . import chunks


def components(edges: DataFrame, key: str, most_rounds: int = 64, most: int = chunks.MOST) -> DataFrame:
    """(key, node, root) of the undirected edges (key, src, dst): root is the component's least node.

    Keys of at most so many edges are settled within tasks, many at a time. The others go by alternating large-star and small-star
    steps, whose rounds grow with the logarithm of a component's size. A node that only has a loop is its own root.
    """
    kind = dict(edges.dtypes)["src"]
    shelf = Scratch(edges.sparkSession, "components")
    if kind not in ("bigint", "int"):
        return _stars(edges, key, kind, most_rounds, shelf)
    whole = shelf.table(edges.select(key, F.coalesce("src", "dst").cast(kind).alias("src"), F.coalesce("dst", "src").cast(kind).alias("dst")).dropna(), "edges")
    small, large = chunks.halves(whole, [key], shelf, "edges", most)
    found = chunks.by_key(small, [key], [], chunks.components, f"node {kind}, root {kind}", most)
    return found if large is None else found.union(_stars(large, key, kind, most_rounds, shelf))


def _stars(edges: DataFrame, key: str, kind: str, most_rounds: int, shelf: Scratch) -> DataFrame:
    ends = edges.select(key, F.greatest("src", "dst").cast(kind).alias("u"), F.least("src", "dst").cast(kind).alias("v"))
    first = shelf.table(ends.distinct(), "first")
    now, before = first.where("u <> v"), None
    for k in range(most_rounds):
        both = now.union(now.select(key, F.col("v").alias("u"), F.col("u").alias("v")))
        least = shelf.table(both.groupBy(key, "u").agg(F.min("v").alias("m")).select(key, "u", F.least("u", "m").alias("m")), f"least-{k}")
        large = shelf.table(both.join(least, [key, "u"]).where("v > u").select(key, F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"large-{k}")
        low = shelf.table(large.groupBy(key, "u").agg(F.min("v").alias("m")), f"low-{k}")
        stars = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        now = shelf.table(large.join(low, [key, "u"]).select(key, stars).select(key, "e.u", "e.v").where("u <> v").distinct(), f"stars-{k}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64(key, "u", "v").cast("decimal(38,0)"))).first()
        shelf.drop(f"least-{k}", f"large-{k}", f"low-{k}", *([f"stars-{k - 1}"] if k else []))
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components have not settled")
    nodes = first.select(key, F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(now.toDF(key, "node", "root"), [key, "node"], "left").select(key, "node", F.coalesce("root", "node").alias("root"))


def _arcs(edges: DataFrame, key: str) -> DataFrame:
    """Both directions (key, u, v, length) of distinct edges, the shortest of parallel ones; loops are left out."""
    one = edges.where("src <> dst").groupBy(key, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min("length").alias("length"))
    return one.union(one.select(key, F.col("v").alias("u"), F.col("u").alias("v"), "length"))


def _kind(tips):
    return F.when(tips == 3, "ring").when(tips == 2, "end-to-end").when(tips == 1, "end-to-brh").otherwise("brh-to-brh")


def paths(edges: DataFrame, key: str, most: int = chunks.MOST) -> DataFrame:
    """The graph with its chains of nodes of degree 2 made single paths: (key, src, dst, length, hops, kind).

    Keys of at most so many edges are settled within tasks, many at a time; the others go by rounds of tables, in the same way.

    Each direction of an edge points to the one after it where its head has degree 2. Pointers double: a round joins each open one with
    what it points to, so chains end after the logarithm of their length. What is still open then, with its least node unchanged
    all over, lies on closed rings; those get one row, from their least node to itself. Kinds are end-to-end, end-to-brh, brh-to-brh and ring.
    """
    shelf, node = Scratch(edges.sparkSession, "paths"), dict(edges.dtypes)["src"]
    if node not in ("bigint", "int"):
        return _paths_by_rounds(edges, key, shelf)
    whole = shelf.table(edges.where("src <> dst").select(key, "src", F.col("dst").cast(node).alias("dst"), F.col("length").cast("double").alias("length")), "edges")
    small, large = chunks.halves(whole, [key], shelf, "edges", most)
    found = chunks.by_key(small, [key], [], chunks.paths, f"src {node}, dst {node}, length double, hops long, tips int", most)
    found = found.select(key, "src", "dst", "length", "hops", _kind(F.col("tips")).alias("kind"))
    return found if large is None else found.union(_paths_by_rounds(large, key, shelf))


def _paths_by_rounds(edges: DataFrame, key: str, shelf: Scratch) -> DataFrame:
    arcs = shelf.table(_arcs(edges, key), "arcs")
    degree = shelf.table(arcs.groupBy(key, "u").agg(F.count("*").alias("d")), "degree")
    through = degree.where("d = 2").select(key, F.col("u").alias("v"))
    after = arcs.join(through.withColumnRenamed("v", "u"), [key, "u"]).select(key, F.col("u").alias("v"), F.col("v").alias("w"))
    start = arcs.join(after, [key, "v"], "left").where("w is null or w <> u")
    arc = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
    begun = start.select(key, arc("u", "v").alias("arc"), F.when(F.col("w").isNotNull(), arc("v", "w")).alias("next"), arc("u", "v").alias("last"), "length", F.lit(1).cast("long").alias("hops"), F.col("v").alias("low"), F.col("length").alias("own"))
    state, before, k = shelf.table(begun, "state-0"), None, 0
    while True:
        open_ = state.where("next is not null")
        seen = open_.agg(F.count("*"), F.sum(F.xxhash64(key, "arc", "low").cast("decimal(38,0)"))).first()
        if not seen[0] or seen == before:
            break
        before, k = seen, k + 1
        ahead = state.select(key, F.col("arc").alias("next"), F.col("next").alias("_next"), F.col("last").alias("_last"), F.col("length").alias("_length"), F.col("hops").alias("_hops"), F.col("low").alias("_low"))
        moved = open_.join(ahead, [key, "next"]).select(key, "arc", F.col("_next").alias("next"), F.col("_last").alias("last"), (F.col("length") + F.col("_length")).alias("length"), (F.col("hops") + F.col("_hops")).alias("hops"), F.least("low", "_low").alias("low"), "own")
        state = shelf.table(state.where("next is null").unionByName(moved), f"state-{k}")
        shelf.drop(f"state-{k - 1}")
    ends = degree.where("d <> 2")
    found = state.where("next is null").select(key, F.col("arc.u").alias("src"), F.col("arc.v").alias("_a"), F.col("last.v").alias("dst"), F.col("last.u").alias("_b"), "length", "hops")
    found = found.where(F.struct("src", "_a") <= F.struct("dst", "_b")).join(ends.toDF(key, "src", "_ds"), [key, "src"]).join(ends.toDF(key, "dst", "_dd"), [key, "dst"])
    tips = F.when(F.col("_ds") == 1, 1).otherwise(0) + F.when(F.col("_dd") == 1, 1).otherwise(0)
    kind = _kind(tips)
    rings = state.where("next is not null").groupBy(key, "low").agg((F.sum("own") / 2).alias("length"), (F.count("*") / 2).cast("long").alias("hops"))
    return found.select(key, "src", "dst", "length", "hops", kind.alias("kind")).union(rings.select(key, F.col("low").alias("src"), F.col("low").alias("dst"), "length", "hops", F.lit("ring").alias("kind")))


#: Nodes of a component whose pairs a task holds at a time.
NODES = 1 << 10


def longest_routes(edges: DataFrame, key: str, most: int = chunks.MOST, nodes: int = NODES) -> DataFrame:
    """The longest shortest path of each component, (key, root, src, dst, length), of equal ones the least pair of ends.

    All nodes are sources at a time. Components of at most so many nodes, of keys of at most so many edges, are settled within tasks, and only what
    they give is written. For the others only pairs whose distance fell in the last round are extended along the edges, and the candidates combine
    before the shuffle. The pairs of a component are what the result is a maximum of; they are kept as a table, never in one task.
    """
    shelf, node = Scratch(edges.sparkSession, "routes"), dict(edges.dtypes)["src"]
    if node not in ("bigint", "int"):
        return _routes_by_rounds(edges, key, shelf)
    whole = shelf.table(edges.where("src <> dst").select(key, "src", F.col("dst").cast(node).alias("dst"), F.col("length").cast("double").alias("length")), "edges")
    small, large = chunks.halves(whole, [key], shelf, "edges", most)
    settled = chunks.by_key(small, [key], [], partial(chunks.routes, most=nodes), f"root {node}, src {node}, dst {node}, length double, left boolean", most)
    found = shelf.table(settled, "settled")
    left = found.where("left").select(key, "src", "dst", "length")
    rest = large if left.isEmpty() else left if large is None else large.select(*left.columns).union(left)
    done = found.where("not left").select(key, "root", "src", "dst", "length")
    return done if rest is None else done.union(_routes_by_rounds(rest, key, shelf))


def _routes_by_rounds(edges: DataFrame, key: str, shelf: Scratch) -> DataFrame:
    arcs = shelf.table(_arcs(edges, key), "arcs")
    root = shelf.table(components(arcs.select(key, F.col("u").alias("src"), F.col("v").alias("dst")), key), "roots")
    known = shelf.table(root.select(key, F.col("node").alias("s"), F.col("node").alias("n"), F.lit(0.0).alias("d"), F.lit(True).alias("new")), "known-0")
    k = 0
    while not known.where("new").isEmpty():
        k += 1
        reached = known.where("new").join(arcs.withColumnRenamed("u", "n"), [key, "n"]).groupBy(key, "s", F.col("v").alias("n")).agg(F.min(F.col("d") + F.col("length")).alias("_d"))
        both = known.drop("new").join(reached, [key, "s", "n"], "full")
        better = F.col("d").isNull() | (F.col("_d") < F.col("d"))
        known = shelf.table(both.select(key, "s", "n", F.when(better, F.col("_d")).otherwise(F.col("d")).alias("d"), F.coalesce(better, F.lit(False)).alias("new")), f"known-{k}")
        shelf.drop(f"known-{k - 1}")
    far = known.where("s < n").join(root.withColumnRenamed("node", "s"), [key, "s"])
    best = F.min(F.struct((-F.col("d")).alias("d"), "s", "n")).alias("b")
    return far.groupBy(key, "root").agg(best).select(key, "root", F.col("b.s").alias("src"), F.col("b.n").alias("dst"), (-F.col("b.d")).alias("length"))
