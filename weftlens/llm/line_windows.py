"""Line deduplication by overlapping windows of three lines.

Each run of three consecutive lines is hashed (128 bits). A window's first place in the corpus, by doc_id and line, is found
with a minimum that combines before the shuffle; at every other place of a repeated window its three lines are covered, and
the covered lines of a document, merged, go. Only hashes and places are shuffled until the removal, which joins them to the
texts by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, map_arrow

#: Lines of a window.
WINDOW = 3


def _row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that tell rows apart; rows that are equal in both are one."""
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(text, F.lit("row"), doc_id).alias("b"))


def windows(docs: DataFrame) -> DataFrame:
    """_row, doc_id, _at (first line) and the hash (_h, _g) of every window of docs that holds a word."""
    lines = F.split("text", "\n", -1)
    split = docs.select("doc_id", _row_key(F.col("doc_id"), F.col("text")).alias("_row"), lines.alias("_l")).where(F.size("_l") >= WINDOW)
    at = F.transform(F.sequence(F.lit(0), F.size("_l") - WINDOW), lambda i: F.concat_ws("\n", F.slice("_l", i + 1, WINDOW)))
    one = split.select("doc_id", "_row", F.posexplode(at).alias("_at", "_w")).where(F.col("_w").rlike(r"[^\x20\x09-\x0D]"))
    return one.select("doc_id", "_row", "_at", F.xxhash64("_w").alias("_h"), F.xxhash64(F.lit("window"), "_w").alias("_g"))


def later_windows(docs: DataFrame) -> DataFrame:
    """_row and _lines, the first lines of its windows that stood earlier in the corpus.

    First places are written before they are joined back, so that the join reads two plain exchanges and Spark can split a
    window that very many places share.
    """
    scratch = Scratch(docs.sparkSession, "windows")
    every = windows(docs).withColumn("_place", F.struct("doc_id", "_row", "_at"))
    first = scratch.table(every.groupBy("_h", "_g").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "first")
    later = every.join(first, ["_h", "_g"]).where("_place > _first")
    return later.groupBy("_row").agg(F.collect_set("_at").alias("_lines"))


def without_repeats(docs: DataFrame, counted: bool = True) -> DataFrame:
    """docs (doc_id, text, any others) with repeated lines removed and, if counted, n_lines, n_removed at the end.

    A null text stays null with 0 lines, an empty one is one line; texts of fewer than three lines have no window and stay;
    windows of blank lines never count. Rows equal in doc_id and text are one place, so they keep the same lines. Equal windows
    in one document count as anywhere else: the later goes. Rows with one doc_id and different texts come in the order of their
    hashes, rows without a doc_id first. A very long text is one row of as many windows as it has lines. n_chars, where there is
    such a column, is counted anew; an empty table gives an empty one.
    """
    names = docs.columns
    rest = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("_rest")
    both = docs.select("text", rest, _row_key(F.col("doc_id"), F.col("text")).alias("_row")).join(later_windows(docs), "_row", "left").select("text", "_rest", "_lines")
    out_type = both.select("text", "_rest", F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_removed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, removed = batch.column(0).to_pylist(), [], []
            for k, at in enumerate(batch.column(2).to_pylist()):
                text = texts[k]
                n.append(text.count("\n") + 1 if text is not None else 0)
                removed.append(0)
                if at:
                    gone = np.zeros(n[-1], bool)
                    for j in range(WINDOW):
                        gone[np.asarray(at) + j] = True
                    texts[k] = "\n".join([x for x, g in zip(text.split("\n"), gone.tolist(), strict=True) if not g])
                    removed[-1] = int(gone.sum())
            yield pa.record_batch([pa.array(texts, pa.string()), batch.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=["text", "_rest", "_n", "_removed"])

    out = map_arrow(both, run, out_type)
    cols = []
    for c in names:
        if c == "text":
            cols.append(F.col("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col("_removed") > 0, F.char_length("text").cast(docs.schema[c].dataType)).otherwise(F.col("_rest.n_chars")).alias(c))
        else:
            cols.append(F.col("_rest").getField(c).alias(c))
    return out.select(*cols, *([F.col("_n").alias("n_lines"), F.col("_removed").alias("n_removed")] if counted else []))


def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op4_line_windows": op4_line_windows}
ORACLE = {
    "op4_line_windows": r"""
WITH l AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM (SELECT DISTINCT doc_id, text FROM documents)),
w AS (SELECT r, i, array_to_string(lines[i + 1 : i + 3], chr(10)) AS w FROM (SELECT r, lines, unnest(range(0, len(lines) - 2)) AS i FROM l WHERE len(lines) >= 3)),
ok AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY r, i) AS nth FROM w WHERE regexp_matches(w, '[^\x20\x09-\x0D]')),
gone AS (SELECT DISTINCT r, i + j AS at FROM ok, (SELECT unnest(range(3)) AS j) WHERE nth > 1),
every AS (SELECT r, unnest(lines) AS line, unnest(range(0, len(lines))) AS at FROM l),
kept AS (SELECT e.r, string_agg(e.line, chr(10) ORDER BY e.at) FILTER (WHERE g.at IS NULL) AS t, count(*) AS n, count(g.at) AS gone FROM every e LEFT JOIN gone g ON e.r = g.r AND e.at = g.at GROUP BY e.r)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d JOIN l ON l.doc_id IS NOT DISTINCT FROM d.doc_id AND l.text IS NOT DISTINCT FROM d.text LEFT JOIN kept USING (r)
"""
}
