"""Every query with SQL gives DuckDB's rows; the others give rows."""

import duckdb
import pytest

from weftlens.plans import imaging, spatial  # noqa: F401
from weftlens.plans.catalog import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def said(rows):
    def one(v):
        if v is None or v != v:
            return "~"
        if isinstance(v, bool):
            return str(int(v))
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_duckdb(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    expected = con.sql(f"SELECT {', '.join(f'"{c}"' for c in df.columns)} FROM ({ORACLE[name]})")
    assert said([tuple(r) for r in df.collect()]) == said(expected.fetchall())


@pytest.mark.parametrize("name", ["curvature_path", "reflected_curvature"])
def test_curvature_where_points_stand_still(spark, small, tmp_path, name):
    """Points that stay in place have chords without length, whose angle hangs on the signs of zeros."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT event_id + 97000 * c AS event_id, ts, user_id, value FROM '{small}/events.parquet', range(7) t(c)) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    expected = con.sql(f"SELECT user_id, event_id, angle FROM ({ORACLE[name]})").fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert said(got) == said(expected) and sum(r[2] == 180 for r in got) > 100


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 10 and "z_alignment" in df.columns


def least_by_hand(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, a, b in edges:
        low, high = sorted((find((k, a)), find((k, b))))
        root[high] = low
    return {x: find(x)[1] for x in root}


def test_components_against_brute_force(spark, small):
    import random

    from weftlens.operators import graphs
    from weftlens.plans.catalog import all_edges

    rng = random.Random(2)
    chain = [(1, i, i + 1) for i in range(300)]
    odd = [(2, 5, 5), (2, 7, 8), (2, 8, 7), (3, -4, 9), *[(4, rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)]]
    rows = [(k, a, b) for k, a, b in [*chain, *chain, *odd]]
    rng.shuffle(rows)
    got = graphs.components(spark.createDataFrame(rows, "k long, src long, dst long"), "k").collect()
    assert {(r["k"], r["node"]): r["root"] for r in got} == least_by_hand(rows) and len(got) == len(least_by_hand(rows))
    every = QUERIES["graph_components_all"](spark, small).collect()
    rows = [tuple(r) for r in all_edges(spark, small).collect()]
    assert len(rows) == spark.read.parquet(f"{small}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_orderkey").distinct().count()
    assert {(r["k"], r["node"]): r["root"] for r in every} == least_by_hand(rows) and len(every) == len({x for k, a, b in rows for x in ((k, a), (k, b))})


def test_components_never_group_by_key_alone(spark):
    from weftlens.operators import graphs

    e = spark.createDataFrame([(1, 2, 3)], "k long, src long, dst long")
    assert "FlatMapGroups" not in graphs.components(e, "k")._jdf.queryExecution().optimizedPlan().toString()


def test_overlapping_circles_of_many_sizes_against_all_pairs(spark):
    import math
    import random

    from weftlens.operators import tabular as T

    rng = random.Random(5)
    rows = [(k, i, rng.uniform(-300, 300), rng.uniform(-300, 300), rng.choice([0.0, 0.25, 2.0, 9.0, 2.0 ** rng.uniform(-3, 4)])) for k in (1, 2) for i in range(250)]
    rows += [(1, 900, 10.0, 10.0, 400.0), (2, 901, 0.0, 0.0, 1e-14), (2, 902, 0.0, 0.0, 5.0), (3, 1, 0.0, 0.0, 0.0), (3, 2, 0.0, 0.0, 0.0), (4, 1, 0.0, 0.0, 1.0), (4, 2, 2.0, 0.0, 1.0), (4, 3, 0.0, 0.0, 1.0), (4, 4, 1.5, 0.5, 1.0)]
    got = [tuple(r) for r in T.overlapping_circles(spark.createDataFrame(rows, "k long, id long, y double, x double, r double"), "k").collect()]
    expected = {(k, i, j) for k, i, y, x, r in rows for l, j, v, u, s in rows if k == l and i < j and math.hypot(y - v, x - u) < r + s}
    assert set(got) == expected and len(got) == len(expected)


@pytest.mark.parametrize("most", [1 << 12, 100, 0])
def test_overlapping_circles_within_tasks_and_by_grids(spark, most):
    import math
    import random

    from weftlens.operators import tabular as T

    rng = random.Random(6)
    rows = [(k, i * 3, float(rng.randint(0, 60)), float(rng.randint(0, 60)), rng.choice([0.0, -1.0, 0.25, 2.5, 7.0, 30.0])) for k in range(40) for i in range(rng.choice([1, 2, 30, 130]))]
    rows += [(50, 1, 0.0, 0.0, 2.5), (50, 2, 3.0, 4.0, 2.5), (50, 3, 3.0, 4.0, 2.5), (50, 3, 3.0, 4.0, 1.0)]
    expected = sorted((k, i, j) for k, i, y, x, r in rows for l, j, v, u, s in rows if k == l and i < j and math.hypot(y - v, x - u) < r + s)
    rows += [(None, 1, 0.0, 0.0, 9.0), (None, 2, 0.0, 0.0, 9.0), (0, None, 0.0, 0.0, 9.0), (0, 1, None, 0.0, 9.0), (0, 1, 0.0, 0.0, None)]
    got = T.overlapping_circles(spark.createDataFrame(rows, "k long, id long, y double, x double, r double").repartition(3), "k", most)
    assert sorted(map(tuple, got.collect())) == expected


def test_overlapping_circles_of_small_keys_are_shuffled_once(spark, small):
    plan = QUERIES["circle_overlap_pairs"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_pairs_of_a_chunk_come_in_parts():
    import numpy as np

    from weftlens.operators import chunks

    g, n = np.repeat([0, 1, 2], 50), 150
    c = {"id": np.arange(n)[::-1].copy(), "y": np.zeros(n), "x": np.zeros(n), "r": np.where(np.arange(n) % 3, 1.0, 2.0)}
    parts = list(chunks.overlapping_circles(g, c, 100))
    assert len(parts) > 30 and max(len(k) for k, _ in parts) <= 150
    pairs = {(int(k), int(a), int(b)) for of, made in parts for k, a, b in zip(of, made["a"], made["b"], strict=True)}
    assert len(pairs) == sum(len(k) for k, _ in parts) == 3 * 50 * 49 // 2 and all(a < b for _, a, b in pairs)


def test_gap_summaries_without_a_region(spark):
    from weftlens.operators import tabular as T

    left, whole = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 3.0), ("b", 4.0)], "k string, m double")
    region = spark.createDataFrame([("a", None)], "k string, m double")
    assert sorted(map(tuple, T.gap_summaries(left, whole, region, "k", ["m"]).collect())) == [("a", 3.0, 0.0), ("b", 0.0, 0.0)]
    assert sorted(map(tuple, T.gap_summaries(left, whole, None, "k", ["m"]).collect())) == [("a", 0.0, 0.0), ("b", 0.0, 0.0)]
