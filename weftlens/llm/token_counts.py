"""Token counts: batch encoding in Arrow functions that return lengths only.

A chunk of texts, bounded in bytes, is split at boundaries across which this kind of tokenizer never joins, so the parts' counts
add up to the text's. Each distinct part of a chunk goes to the tokenizer once, in batches balanced by bytes, and only the
lengths come back: no ids are kept, nothing is shuffled, and a worker's memory hangs on the chunk and not on the text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import distinct_words, documents, map_arrow, slices, utf8

#: Bytes of text that are split together, and bytes of parts that the tokenizer gets at once.
CHUNK_BYTES, ENCODE_BYTES = 1 << 20, 1 << 18
#: A part longer than this is split again, where letters meet digits or punctuation.
LONG_PART = 1 << 16
#: Parts that a worker remembers the count of, and the bytes of a part that may be remembered.
REMEMBERED, SHORT_PART = 200_000, 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SIGN = np.zeros(256, bool)
_SIGN[0x21:0x7F] = True
#: Letters and digits on whose class all versions of Unicode agree, and signs that may follow them.
_LETTER, _MARK = "A-Za-z\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3", "!-/:-@\\[-`{-~\\u3001\\u3002\\uff01\\uff0c\\uff1a\\uff1b\\uff1f"
_SEAM = re.compile(f"(?<=[{_LETTER}0-9])(?=[{_MARK}])|(?<=[{_LETTER}])(?=[0-9])|(?<=[0-9])(?=[{_LETTER}])")


def boundaries(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places where a part starts: the rows' starts, white space after a sign, and a single space before a sign.

    The pattern of byte-level tokenizers takes white space up to its last one before a word, which goes with the word. So it always
    has a boundary where white space follows something else, and one before the last space, whatever precedes that.
    """
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        white, sign = _SPACE[raw], _SIGN[raw]
        cut[1:n] = white[1:] & sign[:-1]
        cut[1 : n - 1] |= (raw[1 : n - 1] == 0x20) & sign[2:]
    cut[off] = True
    return np.flatnonzero(cut[:n])


class Counter:
    """Numbers of tokens by a byte-level BPE tokenizer of the library ``tokenizers``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        rule = self.tokenizer.pre_tokenizer
        if type(rule).__name__ != "ByteLevel" or rule.add_prefix_space or not rule.use_regex or self.tokenizer.normalizer is not None:
            raise ValueError("the boundaries hold for byte-level tokenizers without a normalizer and a prefix space")
        if any(re.search(r"\s", t) for t in self.added):
            raise ValueError("an added token holds white space")
        self.known: dict[bytes, int] = {}

    def encoded(self, parts: list[str]) -> list[int]:
        """Each part's number of tokens; the tokenizer gets ENCODE_BYTES or one part at a time."""
        out: list[int] = []
        at = 0
        ends = np.cumsum([len(p) for p in parts])
        while at < len(parts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ENCODE_BYTES, "right")))
            out += [len(e) for e in self.tokenizer.encode_batch_fast(parts[at:to], add_special_tokens=False)]
            at = to
        return out

    def long(self, text: str) -> int:
        """The number of a long part, split where letters or digits end, but for places inside added tokens."""
        held = [(m.start(), m.end()) for t in self.added for m in re.finditer(re.escape(t), text)]
        inside = np.zeros(len(text) + 1, bool)
        for a, b in held:
            inside[a + 1 : b] = True
        pieces, at = [], 0
        for m in _SEAM.finditer(text):
            if m.start() - at >= LONG_PART and not inside[m.start()]:
                pieces.append(text[at : m.start()])
                at = m.start()
        return sum(self.encoded([*pieces, text[at:]]))

    def counts(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The number of tokens of each row of utf8()."""
        rows = len(off) - 1
        if not len(raw):
            return np.zeros(rows, np.int64)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        starts = boundaries(raw, off)
        ends = np.append(starts[1:], len(raw))
        first, which = distinct_words(raw, starts, ends)
        data, known = raw.tobytes(), self.known
        size = np.zeros(len(first), np.int64)
        new, at = [], []
        for k, (a, b) in enumerate(zip(starts[first].tolist(), ends[first].tolist(), strict=True)):
            part = data[a:b]
            n = known.get(part)
            if n is not None:
                size[k] = n
            elif b - a > LONG_PART:
                size[k] = self.long(part.decode("utf-8", "replace"))
            else:
                new.append(part)
                at.append(k)
        for k, part, n in zip(at, new, self.encoded([p.decode("utf-8", "replace") for p in new]), strict=True):
            size[k] = n
            if len(part) <= SHORT_PART:
                known[part] = n
        total = np.append(0, np.cumsum(size[which]))
        return np.diff(total[np.searchsorted(starts, off)])


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    """The counter of a worker, kept from task to task with what it remembers."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of docs (doc_id, text).

    Null and empty texts have 0 bytes and 0 tokens; strings of special tokens in a text are those tokens, as is the library's default.
    Rows that repeat are counted each, null doc_ids stay; no ties arise. A very long text is a chunk of its own that is split as any other;
    only a run without any boundary (letters of one kind alone) goes to the tokenizer whole. Other columns are ignored,
    whatever their names; an empty table gives an empty one.
    """
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for a, b in slices(batch.column(1), CHUNK_BYTES):
                raw, off = utf8(batch.column(1).slice(a, b - a))
                n = counter.counts(raw, off)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], schema=schema)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


QUERIES = {"op11_token_counts": op11_token_counts}
ORACLE: dict[str, str] = {}
