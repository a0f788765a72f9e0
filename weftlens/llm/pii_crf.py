"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field then labels the tokens that show evidence (a digit, ``@``, ``=`` or ``+``, or letters in
both cases with digits); tokens without evidence are observed as outside, so the chain runs over the others. Tokens of a
document that repeat, or that have the same digits or the same letters and digits, share a skip potential with the first and
the last one like them, however far away; loopy sum-product passing over chain and skip edges then makes their labels agree.
The weights are trained here: counts of feature sets, of neighbouring labels and of labels across skip edges, taken from all
documents with the patterns as labels, fit a softmax for the tokens and smoothed log ratios for the edges. A token that no
pattern labels but that is like one with a label is left out of the counts: its label isn't known, the skip edge is to decide
it. Spans that the field finds beside the base ones are of the kinds ``crf-email … crf-secret``; a secret's is its value alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field; 0 is outside.
LABELS = ("outside", "email", "ip", "card", "phone", "secret")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a number is only tried from its start, else a long run of digits would take quadratic time
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EVIDENCE = re.compile(r"[0-9@=+]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: Pairs of agreeing labels across skip edges that count as seen before any document.
SKIP_PRIOR = 10.0
#: Weak labels of secrets for training: access keys, and values given to a name like password.
SECRET = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|(?i:password|passwd|secret|token|api[_-]?key)[\x20\x09]*[=:][\x20\x09]*[\"']?([^\x20\x09-\x0D\"',;]{8,})")
#: What stands before the value in a token that names a secret, and quotes and brackets after it.
BEFORE_VALUE = re.compile(r"(?:[^=:]*(?i:password|passwd|secret|token|api[_-]?key)[^=:]*[=:]+)?[\"'({\[<=:]*")
AFTER_VALUE = "\"')}]>#;,."


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain. The domain is matched first: its first character is rare."""
    found, end = [], 0
    for m in DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            found.append((start, m.end()))
            end = m.end()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of KINDS in that order; matches that fail their check are dropped and not tried again."""
    out = [emails(text) if "@" in text else [], [], [], []]
    if not EVIDENCE.search(text):
        return out
    out[1] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out[2].append(m.span())
    if "+" in text:
        out[3] = [m.span() for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


@dataclass
class Tokens:
    """The tokens with evidence of one document."""

    spans: list[tuple[int, int]]
    features: np.ndarray  # (tokens, FEATURES), 0 or 1
    gaps: np.ndarray  # to the token before: 0 beside it, 1 in the same region, 2 farther or none
    skips: np.ndarray  # (edges, 2): each token with the first and the last one like it, if they aren't close by


FEATURES = ("bias", "at", "equals", "plus", "bracket", "dots3", "dots", "dash", "digits1_3", "digits4_7", "digits8_15", "digits16_19", "digits20", "all_digits", "upper_digits", "lower_digits", "long_mixed", "keyed", "after_key", "after_plus")
KEYED = re.compile(r"(?i)password|passwd|secret|token|api[_-]?key|AKIA|ASIA")


def tokens(text: str) -> Tokens:
    """Tokens with evidence; each distinct one is looked at once."""
    spans, rows, gaps, keys = [], [], [], []
    before_end, before = -9, ""
    for hit in EVIDENCE.finditer(text):
        at = hit.start()
        if spans and at < spans[-1][1]:
            continue
        a = at
        while a and text[a - 1] not in " \t\n\x0b\x0c\r":
            a -= 1
        word = TOKEN.match(text, a)[0]
        b = a + len(word)
        core = word.strip(".,;:!?\"'")
        lead = text[max(0, a - 24) : a]
        digits = "".join(c for c in core if "0" <= c <= "9")
        n, letters = len(digits), "".join(c for c in core if c.isalpha())
        beside = a - before_end <= 1
        rows.append((
            1, "@" in core, "=" in core, core[:1] == "+", "(" in core or ")" in core, core.count(".") == 3, core.count(".") in (1, 2), "-" in core,
            0 < n < 4, 3 < n < 8, 7 < n < 16, 15 < n < 20, n > 19, n > 0 and n == len(core), bool(letters) and n > 0 and letters.isupper(), bool(letters) and n > 0 and letters.islower(),
            len(core) >= 16 and n > 0 and bool(letters), KEYED.search(core) is not None, KEYED.search(lead) is not None, beside and before[:1] == "+",
        ))
        gaps.append(0 if beside else 1 if a - before_end < 200 else 2)
        spans.append((a + word.index(core) if core else a, a + word.index(core) + len(core) if core else b))
        # tokens are alike if they are the same, or if their last seven digits (six at least) or their letters and digits are
        keys.append((core, digits[-7:] if n >= 6 else "", (letters + digits).lower() if n >= 2 and letters else ""))
        before_end, before = b, core
    first: dict[tuple[int, str], int] = {}
    last: dict[tuple[int, str], int] = {}
    skips = set()
    for k, key in enumerate(keys):
        for kind, value in enumerate(key):
            if value:
                for j in {first.setdefault((kind, value), k), last.get((kind, value), k)}:
                    if j < k and (j < k - 1 or gaps[k] == 2):
                        skips.add((j, k))
                last[kind, value] = k
    return Tokens(spans, np.array(rows, np.float64).reshape(-1, len(FEATURES)), np.array(gaps, np.int64), np.array(sorted(skips), np.int64).reshape(-1, 2))


def weak_labels(text: str, base: list[list[tuple[int, int]]], spans: list[tuple[int, int]]) -> np.ndarray:
    """Labels of the tokens from the patterns' spans, earlier kinds first; secrets last."""
    marked = [(a, b, k + 1) for k, some in enumerate(base) for a, b in some] + [(*m.span(1 if m[1] else 0), 5) for m in SECRET.finditer(text)]
    out = np.zeros(len(spans), np.int64)
    starts = np.array([a for a, _ in spans])
    ends = np.array([b for _, b in spans])
    for a, b, k in reversed(marked):
        out[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = k
    return out


def unsure(y: np.ndarray, skips: np.ndarray) -> np.ndarray:
    """Which tokens have no label though one like them has one."""
    out = np.zeros(len(y), bool)
    for i, j in ((skips[:, 0], skips[:, 1]), (skips[:, 1], skips[:, 0])):
        out[i[(y[i] == 0) & (y[j] > 0)]] = True
    return out


@dataclass(frozen=True)
class Field:
    """Weights: features x labels, and log potentials of label pairs beside each other by gap and across skip edges."""

    unary: np.ndarray
    chain: np.ndarray  # (3, labels, labels)
    skip: np.ndarray  # (labels, labels)
    #: Rounds after which messages that still move are taken as they are; spans_of() says so in its column settled.
    rounds: int = 50


def train(docs: DataFrame) -> Field:
    """Counts from all documents, bounded by the number of feature sets and labels, then a softmax fit on the driver."""
    schema = pa.schema([("what", pa.string()), ("key", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text or not EVIDENCE.search(text):
                    continue
                t = tokens(text)
                y = weak_labels(text, base_spans(text), t.spans)
                hidden = unsure(y, t.skips)
                for row, label in zip(t.features.astype(np.uint8)[~hidden], y[~hidden], strict=True):
                    key = ("f", f"{row.tobytes().hex()}:{label}")
                    counts[key] = counts.get(key, 0) + 1
                sure = ~(hidden[:-1] | hidden[1:])
                for gap, a, b in zip(t.gaps[1:][sure], y[:-1][sure], y[1:][sure], strict=True):
                    key = ("c", f"{gap}:{a}:{b}")
                    counts[key] = counts.get(key, 0) + 1
                for i, j in t.skips[~(hidden[t.skips].any(1))]:
                    key = ("s", f"{y[i]}:{y[j]}")
                    counts[key] = counts.get(key, 0) + 1
        if counts:
            yield pa.record_batch([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts]), pa.array(list(counts.values()), pa.int64())], schema=schema)

    found = map_arrow(docs.select("text"), run, "what string, key string, n long").groupBy("what", "key").agg(F.sum("n").alias("n")).orderBy("what", "key").collect()
    labels = len(LABELS)
    x, y, n = [], [], []
    chain, skip = np.full((3, labels, labels), 0.5), 0.5 + SKIP_PRIOR * np.eye(labels)
    for r in found:
        if r["what"] == "f":
            row, label = r["key"].split(":")
            x.append(np.frombuffer(bytes.fromhex(row), np.uint8).astype(float))
            y.append(int(label))
            n.append(float(r["n"]))
        elif r["what"] == "c":
            g, a, b = map(int, r["key"].split(":"))
            chain[g, a, b] += r["n"]
        else:
            a, b = map(int, r["key"].split(":"))
            skip[a, b] += r["n"]
            skip[b, a] += r["n"]

    def log_ratio(c: np.ndarray) -> np.ndarray:
        p = c / c.sum()
        return np.clip(np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))), -2.5, 2.5)

    unary = np.zeros((len(FEATURES), labels))
    if x:
        fx, fy, fn = np.array(x), np.array(y), np.sqrt(np.array(n))  # roots: frequent forms don't drown rare ones
        target = np.eye(labels)[fy]
        step = fn.sum() / 4
        momentum = np.zeros_like(unary)
        for _ in range(600):
            z = fx @ unary
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            momentum = 0.9 * momentum + fx.T @ ((target - p) * fn[:, None]) - 1e-3 * step * unary
            unary = unary + momentum / step
    else:
        unary[0, 0] = 4.0
    return Field(unary, np.stack([log_ratio(c) for c in chain]), log_ratio(skip))


def marginals(t: Tokens, field: Field) -> np.ndarray:
    return inferred(t, field)[0]


def inferred(t: Tokens, field: Field) -> tuple[np.ndarray, bool]:
    """Marginals by loopy sum-product over chain and skip edges, and whether the messages have settled within the field's rounds.

    All messages of a round are updated together.
    """
    n, labels = len(t.spans), len(LABELS)
    own = t.features @ field.unary
    own -= own.max(1, keepdims=True)
    i = np.concatenate([np.arange(n - 1), t.skips[:, 0]])
    j = np.concatenate([np.arange(1, n), t.skips[:, 1]])
    if not len(i):
        p = np.exp(own)
        return p / p.sum(1, keepdims=True), True
    # an edge's potential is one of few, so messages of like edges are one product
    pair = np.exp(np.concatenate([field.chain, field.skip[None]]))
    kind = np.concatenate([t.gaps[1:], np.full(len(t.skips), len(field.chain))])
    alike = [np.flatnonzero(kind == k) for k in range(len(pair))]
    there, back = np.zeros((len(i), labels)), np.zeros((len(i), labels))  # log messages i -> j and j -> i
    settled = False
    for _ in range(field.rounds):
        total = own.copy()
        np.add.at(total, j, there)
        np.add.at(total, i, back)
        to_j = np.exp(np.clip(total[i] - back, -60, 60))
        to_i = np.exp(np.clip(total[j] - there, -60, 60))
        there_new, back_new = np.empty_like(there), np.empty_like(back)
        for k, some in enumerate(alike):
            there_new[some] = np.log(to_j[some] @ pair[k] + 1e-30)
            back_new[some] = np.log(to_i[some] @ pair[k].T + 1e-30)
        there_new -= there_new.max(1, keepdims=True)
        back_new -= back_new.max(1, keepdims=True)
        moved = max(np.abs(there_new - there).max(), np.abs(back_new - back).max())
        there, back = 0.5 * (there + there_new), 0.5 * (back + back_new)
        if moved < 1e-3:
            settled = True
            break
    total = own.copy()
    np.add.at(total, j, there)
    np.add.at(total, i, back)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True), settled


def find(text: str, field: Field, least: float = 0.6) -> list[tuple[str, int, int]]:
    return found_in(text, field, least)[0]


def found_in(text: str, field: Field, least: float = 0.6) -> tuple[list[tuple[str, int, int]], bool]:
    """All spans of one text, (kind, start, end) in code points, base ones by kind, then the field's by kind, and whether messages settled."""
    base = base_spans(text)
    out = [(kind, a, b) for kind, some in zip(KINDS, base, strict=True) for a, b in some]
    if not EVIDENCE.search(text):
        return out, True
    t = tokens(text)
    if not t.spans:
        return out, True
    p, settled = inferred(t, field)
    label = p.argmax(1)
    sure = (label > 0) & (p[np.arange(len(label)), label] >= least)
    taken = sorted((a, b) for _, a, b in out)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
    added: list[list] = []
    for k in np.flatnonzero(sure):
        a, b = t.spans[k]
        if LABELS[label[k]] == "secret":
            value = text[a:b].rstrip(AFTER_VALUE)
            a, b = a + BEFORE_VALUE.match(value).end(), a + len(value)
            if a >= b:
                continue
        at = int(np.searchsorted(starts, b, "left")) if starts else 0
        if at and reach[at - 1] > a:
            continue
        if added and added[-1][0] == label[k] and LABELS[label[k]] != "secret" and t.gaps[k] == 0 and added[-1][3] == k - 1:
            added[-1][2:] = [b, k]
        else:
            added.append([label[k], a, b, k])
    return out + [(f"crf-{LABELS[k]}", a, b) for k, a, b, _ in sorted(added, key=lambda x: (x[0], x[1]))], settled


def spans_of(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of the base kinds, the base spans' digest, all spans and settled, for each row of docs (doc_id, text).

    settled is false where the field's messages still moved after its rounds; the spans are then those of the last round.

    Null and empty texts have none; overlapping base spans of different kinds all stand; repeated rows stay apart; a very long
    text takes time and memory in proportion to its length; columns other than doc_id and text are ignored; an empty table gives
    an empty one.
    """
    import hashlib

    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("settled", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                if not text or not EVIDENCE.search(text):
                    rows.append((0, 0, 0, 0, none, "", True))
                    continue
                found, settled = found_in(text, field)
                said = [f"{k}:{a}:{b}" for k, a, b in found]
                counts = [sum(k == kind for k, _, _ in found) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(",".join(said[: sum(counts)]).encode()).hexdigest(), ",".join(said), settled))
            yield pa.record_batch([batch.column(0), *[pa.array([r[k] for r in rows], schema.field(k + 1).type) for k in range(7)]], schema=schema)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, settled boolean")


def redact(text: str, field: Field) -> str:
    """The text with each span, overlapping ones together, replaced by its first kind in capitals."""
    found = sorted(find(text, field), key=lambda x: (x[1], -x[2]))
    out, end = [], 0
    for kind, a, b in found:
        if a >= end:
            out += [text[end:a], f"[{kind.removeprefix('crf-').upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """docs with text redacted and, where there is such a column, n_chars counted anew; null texts stay null."""
    names = docs.columns
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("_rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t, field) if t and EVIDENCE.search(t) else t for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(texts, pa.string()), batch.column(1)], names=["text", "_rest"])

    out = map_arrow(packed, run, packed.schema)
    cols = []
    for c in names:
        if c == "text":
            cols.append(F.col("text"))
        elif c == "n_chars":
            cols.append(F.coalesce(F.char_length("text").cast(docs.schema[c].dataType), F.col("_rest.n_chars")).alias("n_chars"))
        else:
            cols.append(F.col("_rest").getField(c).alias(c))
    return out.select(*cols)


def op1_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return spans_of(docs, train(docs))


QUERIES = {"op1_pii_skip_chain": op1_pii_skip_chain}
ORACLE: dict[str, str] = {}
