"""Quality rules by suffix arrays of the words of each document.

A chunk of documents shares one suffix array over word numbers; the document is the highest part of the first key, so no
suffix runs into the next document. Ranks come from prefix doubling that only goes on with suffixes that still tie, and
longest common prefixes of neighbours are read off the ranks of each round, longest first. A suffix's longest repeat is the
larger of its two neighbours' values; starts whose predecessor has a repeat one word longer are inside that maximal repeat
and add nothing, the other spans are united.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, distinct_words, documents, map_arrow, row_sums, slices, utf8, words

#: The longest repeat that a document may hold, as a share of its words, and the words below which no repeat counts.
LONGEST_SHARE, LONGEST_WORDS = 0.25, 40
#: The largest share of a document's words that maximal repeats of at least REPEAT_WORDS words may cover.
COVERED_SHARE, REPEAT_WORDS = 0.35, 6

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
FIELDS = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("covered_words", pa.int64()), ("longest_repeat", pa.int64())]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


@dataclass(frozen=True)
class RepeatRules:
    covered_share: float = COVERED_SHARE
    repeat_words: int = REPEAT_WORDS
    longest_share: float = LONGEST_SHARE
    longest_words: int = LONGEST_WORDS


def longest_repeats(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position the longest word sequence from it that also starts elsewhere in its document.

    ids: numbers of the words; doc: their documents, ascending.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    last = np.searchsorted(doc, doc, "right")  # end of the position's document
    key = doc.astype(np.int64) * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = key[order][1:] != key[order][:-1]
    first = np.flatnonzero(new)
    group = np.repeat(first, np.diff(np.append(first, n)))
    rank = np.empty(n, np.int64)
    rank[order] = group
    levels, k = [rank.copy()], 1
    open_ = order[np.repeat(np.diff(np.append(first, n)) > 1, np.diff(np.append(first, n)))]
    while len(open_):
        nxt = open_ + k
        inside = nxt < last[open_]
        second = np.zeros(len(open_), np.int64)
        second[inside] = rank[nxt[inside]] + 1
        both = rank[open_] * (n + 1) + second
        by = np.argsort(both, kind="stable")
        open_, both = open_[by], both[by]
        old = rank[open_]
        at = np.arange(len(open_))
        starts_old = np.empty(len(at), bool)
        starts_old[0] = True
        starts_old[1:] = old[1:] != old[:-1]
        starts_new = starts_old.copy()
        starts_new[1:] |= both[1:] != both[:-1]
        g_old = np.maximum.accumulate(np.where(starts_old, at, 0))
        g_new = np.maximum.accumulate(np.where(starts_new, at, 0))
        rank = rank.copy()
        rank[open_] = old + g_new - g_old
        k *= 2
        levels.append(rank)
        edges = np.append(np.flatnonzero(starts_new), len(at))
        size = np.diff(edges)
        open_ = open_[np.repeat(size > 1, size)]
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    one = levels[0]
    pair = np.flatnonzero(one[sa[1:]] == one[sa[:-1]])
    a, b = sa[pair], sa[pair + 1]
    common = np.zeros(len(pair), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        ok = (x < last[a]) & (y < last[b])
        same = np.zeros(len(pair), bool)
        same[ok] = levels[j][x[ok]] == levels[j][y[ok]]
        common[same] += 1 << j
    best = np.zeros(n, np.int64)
    np.maximum.at(best, a, common) if len(a) < 64 else _raise(best, a, common)
    np.maximum.at(best, b, common) if len(b) < 64 else _raise(best, b, common)
    return best


def _raise(best: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    best[at] = np.maximum(best[at], value)  # the positions are distinct


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a maximal repeat of at least so many words."""
    n = len(best)
    start = best >= least
    start[1:] &= best[:-1] != best[1:] + 1  # else the span is inside its predecessor's maximal repeat
    at = np.flatnonzero(start)
    turn = np.zeros(n + 1, np.int64)
    turn[at] += 1
    np.subtract.at(turn, at + best[at], 1)
    return np.cumsum(turn[:-1]) > 0


def measure(text: pa.Array, rules: RepeatRules) -> dict[str, np.ndarray]:
    """The columns of FIELDS but doc_id for one chunk of rows."""
    raw, off = utf8(text)
    rows = len(text)
    starts, ends, at = words(raw, off)
    n_words = np.diff(at)
    doc = np.repeat(np.arange(rows), n_words)
    _, ids = distinct_words(raw, starts, ends)
    best = longest_repeats(ids, doc)
    n_repeat = row_sums(covered(best, 8), at)
    n_covered = row_sums(covered(best, rules.repeat_words), at)
    longest = np.zeros(rows, np.int64)
    full = np.flatnonzero(n_words)
    if len(full):
        longest[full] = np.maximum.reduceat(best, at[:-1][full])
    lead = ((raw & 0xC0) != 0x80) & ~SPACE[raw]
    breaks = np.flatnonzero(raw == 10)
    l_start = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    l_doc = np.searchsorted(off[1:], l_start, "right")
    # a line that starts at its row's end is empty and may be taken for the next row's: it holds no word either way
    l_end = np.minimum(np.append(l_start[1:], len(raw)), off[1:][np.minimum(l_doc, rows - 1)])
    with_word = np.searchsorted(starts, l_end, "left") > np.searchsorted(starts, l_start, "left")
    l_start, l_end, l_doc = l_start[with_word], l_end[with_word], l_doc[with_word]
    l_end = l_end - ((raw[l_end - 1] == 10) if len(l_end) else 0)
    _, l_hash = distinct_words(raw, l_start, l_end)
    by = np.lexsort((l_hash, l_doc))
    again = np.zeros(len(by), bool)
    again[1:] = (l_hash[by][1:] == l_hash[by][:-1]) & (l_doc[by][1:] == l_doc[by][:-1])
    dup = np.bincount(l_doc[by][again], minlength=rows).astype(np.int64)[:rows]
    failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    too_long = longest > np.maximum(rules.longest_words, rules.longest_share * n_words)
    good = ~failed & ~too_long & (n_covered <= rules.covered_share * n_words)
    return {"n_words": n_words.astype(np.int64), "word_chars": row_sums(lead, off), "n_symbols": row_sums(SYMBOL[raw], off), "n_dup_lines": dup, "n_repeat_words": n_repeat, "base_failed": failed, "kept": good, "covered_words": n_covered, "longest_repeat": longest}


def quality(docs: DataFrame, rules: RepeatRules = RepeatRules()) -> DataFrame:
    """One row of measures and the verdict for each row of docs (doc_id, text); repeated rows stay apart.

    A null or empty text has no words and fails; a text of one very long word has n_words 1 and fails; other columns of docs
    are ignored. An empty table gives an empty table.
    """
    schema = pa.schema(FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                found = measure(batch.column(1).slice(a, b - a), rules)
                yield pa.record_batch([batch.column(0).slice(a, b - a), *[pa.array(found[f.name], f.type) for f in list(schema)[1:]]], schema=schema)

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)


def good_documents(docs: DataFrame, rules: RepeatRules = RepeatRules()) -> DataFrame:
    """The rows of docs, with all their columns, that quality() keeps."""
    names = docs.columns
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("_rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(measure(part.column(0), rules)["kept"]))

    return map_arrow(packed, run, packed.schema).select(*[F.col("text") if c == "text" else F.col("_rest").getField(c).alias(c) for c in names])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLE: dict[str, str] = {}
