"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of (language, bucket) are summed on the executors; only the matrix, buckets x languages, comes to the driver, and its
logarithms go out again with the scoring tasks. A document's score adds the rows of the matrix at its n-grams' buckets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, documents, map_arrow, slices

#: A letter, or a character that looks like one to the pattern and isn't (superscripts, Roman numerals).
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


@dataclass(frozen=True)
class LanguageParams:
    #: Buckets of the hashed n-grams, a power of two, and the n-grams' lengths.
    buckets: int = 1 << 15
    orders: tuple[int, ...] = (1, 2, 3)
    #: Labelled documents to learn from: all if there are no more, else a sample by hash of about so many.
    train_documents: int = 20_000
    smoothing: float = 0.5
    #: n-grams that count as one independent piece of evidence when log odds become a score between 0 and 1.
    evidence: float = 8.0


def _letters() -> np.ndarray:
    """Code points below 128 as they count: letters in lower case, all others a space."""
    table = np.full(128, 32, np.uint32)
    table[97:123] = table[65:91] = np.arange(97, 123)
    return table


ASCII = _letters()


def grams(texts: list[str], params: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and the bounds of each text's (rows + 1).

    A text counts with a space on either side; an n-gram belongs to the text in which it starts and never leaves it.
    """
    lengths = np.array([len(t) + 2 for t in texts], np.int64)
    points = np.frombuffer((" " + "  ".join(texts) + " ").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.append(0, np.cumsum(lengths))
    if len(points) != bounds[-1]:  # a letter whose lower case is longer than one
        lowered = [t.lower() for t in texts]
        lengths = np.array([len(t) + 2 for t in lowered], np.int64)
        bounds = np.append(0, np.cumsum(lengths))
        points = np.frombuffer((" " + "  ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 128, ASCII[np.minimum(points, 127)], points)
    n = len(points)
    shift = np.uint32(32 - params.buckets.bit_length() + 1)
    found, hashed = [], np.zeros(n, np.uint32)
    inside = np.repeat(bounds[1:], lengths)
    at = np.arange(n)
    for order in range(1, max(params.orders) + 1):
        # the hash of the n-gram that starts here, from that of one less
        following = np.zeros(n, np.uint32)
        following[: n - order + 1] = points[order - 1 :]
        hashed = (hashed + following + np.uint32(1)) * np.uint32(0x9E3779B1)
        hashed ^= hashed >> np.uint32(15)
        if order in params.orders:
            bucket = ((hashed * np.uint32(0x85EBCA77)) >> shift).astype(np.int32)
            bucket[at + order > inside] = -1
            found.append(bucket)
    return np.stack(found), bounds


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def learn(docs: DataFrame, params: LanguageParams = LanguageParams()) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities (buckets + 1 rows: the last one is the prior) from docs (doc_id, text, lang).

    Rows with a null text or lang teach nothing; empty texts teach the prior alone; rows that repeat count each time. Other
    columns are ignored; an empty table gives no language.
    """
    labelled = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    n = labelled.count()
    if n > params.train_documents:
        labelled = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < int((1 << 30) * params.train_documents / n))
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, b in slices(batch.column(0)):
                langs = np.array(batch.column(1).slice(a, b - a).to_pylist(), object)
                found, bounds = grams(_texts(batch.column(0).slice(a, b - a)), params)
                for lang in set(langs):
                    counts = total.setdefault(lang, np.zeros(params.buckets + 1, np.int64))
                    mine = np.repeat(langs == lang, np.diff(bounds))
                    for row in found:
                        mine_row = row[mine]
                        counts[:-1] += np.bincount(mine_row[mine_row >= 0], minlength=params.buckets)
                    counts[-1] += int((langs == lang).sum())
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])], schema=schema)

    summed = map_arrow(labelled.select("text", "lang"), run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(summed["lang"].to_pylist()))
    counts = np.zeros((params.buckets + 1, len(langs)))
    where = {x: k for k, x in enumerate(langs)}
    counts[summed["bucket"].to_numpy(), [where[x] for x in summed["lang"].to_pylist()]] = summed["n"].to_numpy()
    table = np.empty_like(counts)
    body = counts[:-1] + params.smoothing
    table[:-1] = np.log(body / body.sum(0))
    table[-1] = np.log(counts[-1] / max(1.0, counts[-1].sum())) if len(langs) else 0
    return langs, table


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, params: LanguageParams = LanguageParams()) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs (doc_id, text).

    Without a letter, with a null or an empty text or with nothing learned the language is ``und`` and the score 0. Ties go to
    the language that comes first by name. Rows that repeat stay apart; a very long text is scored whole, as a chunk of its own.
    Other columns are ignored; an empty table gives an empty one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    rows = table.astype(np.float32)
    rows[:-1] -= rows[:-1].mean(1, keepdims=True) if len(langs) else 0  # a bucket without evidence adds nothing
    padded = np.vstack([rows[:-1], np.zeros((1, rows.shape[1]), np.float32)])  # -1: no n-gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                texts = _texts(batch.column(1).slice(a, b - a))
                some = np.array([bool(langs) and has_letter(t) for t in texts])
                names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                if some.any():
                    found, bounds = grams([t for t, s in zip(texts, some, strict=True) if s], params)
                    total = np.zeros((len(bounds) - 1, len(langs)))
                    for row in found:
                        for k in range(len(langs)):
                            total[:, k] += np.add.reduceat(padded[:, k][row], bounds[:-1], dtype=np.float64)
                    total += rows[-1]
                    best = total.argmax(1)
                    odds = (total - total.max(1, keepdims=True)) / np.maximum(1.0, np.diff(bounds)[:, None] * len(params.orders) / params.evidence)
                    names[some] = np.array(langs, object)[best]
                    scores[some] = 1 / np.exp(odds).sum(1)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(scores)], schema=schema)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    langs, table = learn(docs.where(crc32_mod(docs["doc_id"], 4) != 2))
    return predict(docs, langs, table).select("doc_id", (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLE: dict[str, str] = {}
