"""Scores of whole documents by a gated recurrent language model with a class-factored softmax, trained here in numpy.

Counts of all training tokens are summed over the whole corpus by 64-bit hashes of the words. The most frequent words are
the model's own; the others fall in bins by rank, within which they have their smoothed share of the bin's counts, and all
words past the broadcast table, seen or not, are the last bin. A word's probability is that of its class given the state,
times its own within the class. Documents become numbers once, in a table that both training and scoring read. Training starts
on the driver on a bounded sample, then goes on from there with all training documents by truncated backpropagation, in shards
that documents belong to by hash, so the weights don't hang on the partitioning. Each document also belongs to a round: after each
round the shards' weights and Adam's moments are averaged, and all shards go on from the mean. Scoring runs documents of like length in step and carries their state from window to window to the end. Words past the table meet their
counts in a join.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, crc32_mod, documents, map_arrow, slices, utf8, word_hashes, words

#: Stands for the end of a document among the words' hashes.
END = np.uint64(0x5EED0FE0D0C0FFEE)


@dataclass(frozen=True)
class LmParams:
    #: Words in the table that goes to all tasks (16 bytes each), the model's own words, and words of a class.
    table: int = 1 << 18
    own: int = 2048
    per_class: int = 64
    bins: int = 16
    hidden: int = 32
    #: Steps of a training window, and documents side by side.
    window: int = 16
    streams: int = 256
    #: Documents of the driver's start sample (about so many, by hash, of those with at most start_tokens), and its passes.
    start_documents: int = 400
    start_tokens: int = 1 << 14
    start_passes: int = 3
    rate: float = 8e-3
    #: Training tokens of a shard, about, those that it learns from before the shards' weights are averaged, and those learned from at once.
    shard: int = 1 << 22
    round: int = 1 << 20
    learned: int = 1 << 21
    #: Tokens held to be scored together, and documents that run in step.
    together: int = 1 << 22
    in_step: int = 1024
    smoothing: float = 0.1


def hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each row, each row ended by END, and the rows' bounds."""
    raw, off = utf8(text)
    raw = LOWER[raw]
    starts, ends, at = words(raw, off)
    rows = len(text)
    bounds = at + np.arange(rows + 1)
    out = np.full(bounds[-1], END, np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(rows), np.diff(at))] = word_hashes(raw, starts, ends)
    return out, bounds


def token_counts(docs: DataFrame) -> DataFrame:
    """hash and n of every token of docs (text); each partition sends a token once."""
    schema = pa.schema([("hash", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> None:
            key, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            parts[:] = [(key, np.bincount(which, np.concatenate([p[1] for p in parts])).astype(np.int64))]

        size = 0
        for batch in batches:
            for a, b in slices(batch.column(0), 4 << 20):
                parts.append(np.unique(hashes(batch.column(0).slice(a, b - a))[0], return_counts=True))
                size += len(parts[-1][0])
                if size > 1 << 20:
                    merge()
                    if len(parts[0][0]) > 1 << 20:  # a long partition sends what it has
                        yield pa.record_batch([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], schema=schema)
                        parts.clear()
                    size = 0
        if parts:
            merge()
            yield pa.record_batch([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], schema=schema)

    return map_arrow(docs, run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The table of frequent tokens: where each belongs, and the log10 share of those in bins."""

    def __init__(self, hashed: np.ndarray, n: np.ndarray, total: int, distinct: int, params: LmParams):
        """hashed, n: tokens by descending count; total, distinct: of all training tokens."""
        self.params = params
        end = hashed == END
        hashed, n, n_end = hashed[~end], n[~end], int(n[end].sum())
        own = min(params.own, len(hashed))
        self.total, self.distinct, self.n_end = total, distinct, n_end
        #: Outputs: classes of own words, bins, the end. Inputs: own words, bins, the end.
        self.word_classes = -(-params.own // params.per_class)
        self.outputs = self.word_classes + params.bins + 1
        self.inputs = params.own + params.bins + 1
        self.end = params.own + params.bins
        self.rare = params.own + params.bins - 1
        rank = np.arange(len(hashed))
        bins = params.bins - 1
        edges = np.geomspace(params.own, max(params.table, params.own + 1), bins + 1)
        where = np.where(rank < own, rank, params.own + np.clip(np.searchsorted(edges, rank, "right") - 1, 0, bins - 1))
        smoothed = n + params.smoothing
        mass = np.bincount(where, smoothed, minlength=self.inputs)
        share = np.where(rank < own, 0.0, np.log10(smoothed / mass[where]))
        self.log_rare = float(np.log10(max(total - n_end - n.sum(), 0) + params.smoothing * (max(distinct - len(hashed) - (n_end > 0), 0) + 1)))
        self.log_all = float(np.log10(total + params.smoothing * (distinct + 1)))
        by = np.argsort(hashed)
        self.keys, self.where, self.share = hashed[by], where[by].astype(np.int32), share[by]
        self.log_count = np.log10(smoothed)[by]
        self.log_end = float(np.log10(n_end + params.smoothing))

    @property
    def number_type(self) -> str:
        """Numbers of input tokens in the table of documents."""
        return "<u2" if self.inputs <= 1 << 16 else "<u4"

    def bare(self) -> Vocabulary:
        """The sizes without the table, for tasks that need no more."""
        out = copy.copy(self)
        out.keys = out.where = out.share = out.log_count = None
        return out

    def look_up(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input numbers of tokens and their rows in the table (-1: none)."""
        key, which = np.unique(tokens, return_inverse=True)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = (self.keys[at] == key) if len(self.keys) else np.zeros(len(key), bool)
        row = np.where(hit, at, -1)
        number = np.where(hit, self.where[at] if len(self.keys) else 0, self.rare)
        number = np.where(key == END, self.end, number)
        return number[which].astype(np.int32), row[which]


NAMES = ("x", "u", "b", "c", "cb", "o", "ob")


def start(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    p = vocabulary.params
    rng = np.random.default_rng(61)

    def normal(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * 0.1).astype(np.float32)

    return {"x": normal(vocabulary.inputs, 3 * p.hidden), "u": normal(p.hidden, 3 * p.hidden), "b": np.zeros(3 * p.hidden, np.float32), "c": normal(p.hidden, vocabulary.outputs), "cb": np.zeros(vocabulary.outputs, np.float32), "o": normal(vocabulary.word_classes * p.per_class, p.hidden), "ob": np.zeros(vocabulary.word_classes * p.per_class, np.float32)}


def shapes(vocabulary: Vocabulary) -> dict[str, tuple[int, ...]]:
    return {k: v.shape for k, v in start(vocabulary).items()}


def _safe(logits: np.ndarray, most: float) -> np.ndarray:
    """logits for exp(), less each row's largest where they may be too large for it: none of them is beyond most."""
    if not most < 60:
        logits -= logits.max(1, keepdims=True)
    return logits


def _sums(rows: np.ndarray, which: np.ndarray, often: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of which and the sums of their rows (parts, rows, columns); those that occur often are products with ones, the others go by their k-th rows."""
    by = np.argsort(which, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(which[by]) != 0))
    many = np.diff(np.append(first, len(by)))
    order = np.argsort(-many, kind="stable")
    first, many = first[order], many[order]
    out = np.take(rows, by[first], axis=1)
    n = int(np.searchsorted(-many, -often, "left"))  # rows of more than that
    ones = np.ones(int(many[0]), rows.dtype)
    for i in range(n):
        out[:, i] = ones[: many[i]] @ np.take(rows, by[first[i] : first[i] + many[i]], axis=1)
    for k in range(1, often):
        to = int(np.searchsorted(-many, -k, "left"))
        if to <= n:
            break
        out[:, n:to] += np.take(rows, by[first[n:to] + k], axis=1)
    return which[by[first]], out


def ready(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x with the bias, and u, for advance(): z, r and new one after the other, such that exp() of the sums gives each.

    exp() takes half of the time of tanh(), and parts that lie together half of that of parts of rows.
    """
    k = w["u"].shape[0]
    scale = np.array([-1, -1, -2], w["u"].dtype)[:, None, None]
    x, u = (a.reshape(-1, 3, k).transpose(1, 0, 2) * scale for a in (w["x"] + w["b"], w["u"]))
    return np.ascontiguousarray(x), np.ascontiguousarray(u)


def advance(xs: np.ndarray, u: np.ndarray, h: np.ndarray, gates: np.ndarray, reset: np.ndarray, new: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The next state, to out, given rows of ready(); what backpropagation needs goes to gates (z and r), reset (-2 times r times h's part) and new."""
    hs = np.matmul(h, u)
    np.add(hs[:2], xs[:2], out=gates)
    np.exp(gates, out=gates)  # may be inf, as 1 / inf is 0
    gates += 1
    np.divide(1, gates, out=gates)
    np.multiply(gates[1], hs[2], out=reset)
    np.add(reset, xs[2], out=new)
    np.exp(new, out=new)
    new += 1
    np.divide(2, new, out=new)
    new -= 1
    np.subtract(h, new, out=out)
    out *= gates[0]
    out += new
    return out


def step(w: dict[str, np.ndarray], inputs: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next state, and what backpropagation needs."""
    x, u = ready(w)
    gates, reset, new, out = np.empty((2, *h.shape), h.dtype), *(np.empty_like(h) for _ in range(3))
    with np.errstate(over="ignore"):
        return advance(x[:, inputs], u, h, gates, reset, new, out), gates, reset, new


def outputs(w: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray, vocabulary: Vocabulary, gradient: bool = False):
    """Natural log probabilities of targets (input numbers) given states h; with their gradients if asked for."""
    p = vocabulary.params
    klass = np.where(target < p.own, target // p.per_class, target - p.own + vocabulary.word_classes).astype(np.uint16 if vocabulary.outputs <= 1 << 16 else np.int64)
    # rows by class, so those of a class's own words are a slice; a last column of ones takes the biases
    by = np.argsort(klass, kind="stable")
    klass, target = klass[by], target[by]
    edges = np.searchsorted(klass, np.arange(vocabulary.word_classes + 1))
    k = h.shape[1]
    far = max(float(h.max(initial=1)), -float(h.min(initial=-1)))
    h1 = np.empty((len(h), k + 1), h.dtype)
    h1[:, :k] = np.take(h, by, axis=0)
    h1[:, k] = 1
    c, o = np.concatenate([w["c"], w["cb"][None]]), np.concatenate([w["o"], w["ob"][:, None]], axis=1)
    ones = np.ones(max(k + 1, c.shape[1], p.per_class), h.dtype)
    logits = _safe(h1 @ c, far * float((ones[: k + 1] @ np.abs(c)).max()))
    at = np.arange(len(h)) * logits.shape[1] + klass
    hit = logits.reshape(-1)[at]
    e = np.exp(logits, out=logits)
    total = e @ ones[: e.shape[1]]
    found = hit - np.log(total)
    if gradient:
        e *= (1 / total)[:, None]
        e.reshape(-1)[at] -= 1
        g_c, g_o = h1.T @ e, np.zeros_like(o)
        dh = e @ w["c"].T
    met = np.flatnonzero(np.diff(edges)).tolist()
    if met:
        own, edges = int(edges[-1]), edges.tolist()
        pairs = [(slice(i * p.per_class, (i + 1) * p.per_class), slice(edges[i], edges[i + 1])) for i in met]
        inner = np.empty((own, p.per_class), h.dtype)
        for i, j in pairs:
            np.matmul(h1[j], o[i].T, out=inner[j])
        inner = _safe(inner, far * float((np.abs(o) @ ones[: k + 1]).max()))
        at = np.arange(own) * p.per_class + target[:own] % p.per_class
        hit = inner.reshape(-1)[at]
        e = np.exp(inner, out=inner)
        total = e @ ones[: p.per_class]
        found[:own] += hit - np.log(total)
        if gradient:
            e *= (1 / total)[:, None]
            e.reshape(-1)[at] -= 1
            for i, j in pairs:
                np.matmul(e[j].T, h1[j], out=g_o[i])
                dh[j] += e[j] @ w["o"][i]
    out = np.empty_like(found)
    out[by] = found
    if not gradient:
        return out
    change = np.empty_like(dh)
    change[by] = dh
    return out, change, {"c": g_c[:k], "cb": g_c[k], "o": np.ascontiguousarray(g_o[:, :k]), "ob": np.ascontiguousarray(g_o[:, k])}


class Moments:
    """Adam's moments and number of steps, which go on from one call of train_on() to the next."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.m, self.v, self.n = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0.0

    def copy(self) -> Moments:
        return copy.deepcopy(self)


def train_on(w: dict[str, np.ndarray], ids: np.ndarray, vocabulary: Vocabulary, passes: int = 1, moments: Moments | None = None) -> dict[str, np.ndarray]:
    """Adam over windows of parallel streams of ids; a stream's state is kept between windows and cleared after an end.

    Each id is a target once a pass, the first of a stream too; the last streams are filled up with ends that are no targets.
    moments are gone on from and brought up to date.
    """
    p = vocabulary.params
    if not len(ids):
        return w
    streams = max(1, min(p.streams, len(ids) // p.window, max(8, len(ids) // (64 * p.window))))  # few ids still are many steps
    length = -(-len(ids) // streams)
    filled = np.full(streams * length + 1, vocabulary.end, np.int32)
    filled[1 : len(ids) + 1] = ids
    before_, target_ = filled[:-1].reshape(streams, length).T, filled[1:].reshape(streams, length).T
    is_target = (np.arange(streams * length) < len(ids)).reshape(streams, length).T
    w = {k: v.copy() for k, v in w.items()}
    moments = moments or Moments(w)
    m, v = moments.m, moments.v
    room = {k: np.empty_like(x) for k, x in w.items()}
    small = vocabulary.number_type  # numbers of two bytes are sorted by radix
    held = [np.empty((p.window, *n, streams, p.hidden), np.float32) for n in ((2,), (), (), (), ())]
    for _ in range(passes):
        k, h = p.hidden, np.zeros((streams, p.hidden), np.float32)
        for at in range(0, length, p.window):
            inputs, target, some = before_[at : at + p.window], target_[at : at + p.window], is_target[at : at + p.window]
            t_all = len(inputs)
            gates, reset, new, before, states = (a[:t_all] for a in held)
            ended = inputs == vocabulary.end
            ends = ended.any(1).tolist()
            x, u = ready(w)
            with np.errstate(over="ignore"):
                for t in range(t_all):
                    before[t] = h
                    if ends[t]:
                        before[t][ended[t]] = 0
                    h = advance(np.take(x, inputs[t], axis=1), u, before[t], gates[t], reset[t], new[t], states[t])
            whole = bool(some.all())
            _, d, g = outputs(w, states.reshape(-1, k) if whole else states[some], target.reshape(-1) if whole else target[some], vocabulary, gradient=True)
            if whole:
                dh_out = d.reshape(states.shape)
            else:
                dh_out = np.zeros_like(states)
                dh_out[some] = d
            # what a state's derivative is multiplied by, for all steps at a time
            z, r = gates[:, 0], gates[:, 1]
            to_new = 1 - z
            to_z = before - new
            to_z *= z
            to_z *= to_new
            to_new *= 1 - new * new
            to_r = 1 - r
            to_r *= reset
            to_r *= np.float32(-0.5)
            # derivatives of new, z and r, as the inputs have them, and of z, r and new, as the state has them
            ds = np.empty((4, t_all, streams, k), np.float32)
            dh = np.zeros_like(h)
            back = np.ascontiguousarray(w["u"].reshape(k, 3, k).transpose(1, 2, 0))
            for t in range(t_all - 1, -1, -1):
                dh += dh_out[t]
                d_new = np.multiply(dh, to_new[t], out=ds[0, t])
                np.multiply(dh, to_z[t], out=ds[1, t])
                np.multiply(d_new, to_r[t], out=ds[2, t])
                np.multiply(d_new, r[t], out=ds[3, t])
                dh *= z[t]
                for part in np.matmul(ds[1:, t], back):
                    dh += part
                if ends[t]:
                    dh[ended[t]] = 0
            ds = ds.reshape(4, -1, k)
            g["u"] = np.matmul(before.reshape(-1, k).T, ds[1:]).transpose(1, 0, 2).reshape(k, -1)
            rows, sums = _sums(ds[:3], inputs.reshape(-1).astype(small))  # of the rows that occur
            g["x"] = sums[[1, 2, 0]].transpose(1, 0, 2).reshape(len(rows), -1)
            g["b"] = g["x"].sum(0)
            moments.n += 1
            scale = 1 / int(some.sum())
            norm = float(np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))) * scale
            scale *= min(1.0, 1.0 / max(norm, 1e-9))
            pace = np.float32(p.rate * np.sqrt(1 - 0.99**moments.n) / (1 - 0.9**moments.n))
            for key, x in g.items():
                x = x * np.float32(scale)
                here = rows if key == "x" else slice(None)
                m[key] *= np.float32(0.9)
                m[key][here] += np.float32(0.1) * x
                v[key] *= np.float32(0.99)
                v[key][here] += np.float32(0.01) * (x * x)
                change = np.sqrt(v[key], out=room[key])
                change += np.float32(1e-7)
                np.divide(m[key], change, out=change)
                change *= pace
                w[key] -= change
    return w


def document_scores(w: dict[str, np.ndarray], ids: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """log10 probabilities of the rows' classes and own words; the state starts at zero and goes on through the whole row."""
    p = vocabulary.params
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    out = np.zeros(len(size))
    x, u = ready(w)
    for at in range(0, len(order), p.in_step):
        some = order[at : at + p.in_step]
        n = size[some]
        h, t0, held = np.zeros((len(some), p.hidden), np.float32), 0, None
        while t0 < n[0]:
            # documents are by descending length, so those that go on are the first ones
            active = int((n > t0).sum())
            t1 = min(t0 + max(32, min(1024, (1 << 13) // active)), int(n[0]))
            go = np.searchsorted(-n[:active], -np.arange(t0, t1), "left")
            on = np.arange(active) < go[:, None]
            now = (bounds[some[:active]] + np.arange(t0, t1)[:, None])[on]
            before = ids[now - 1]
            if not t0:
                before[: go[0]] = vocabulary.end
            states, a = np.empty((len(now), p.hidden), np.float32), 0
            with np.errstate(over="ignore"):
                for m in go.tolist():
                    if held is None or m != held[1].shape[0]:
                        held = np.empty((2, m, p.hidden), np.float32), *np.empty((2, m, p.hidden), np.float32)
                    h = advance(np.take(x, before[a : a + m], axis=1), u, h[:m], *held, states[a : a + m])
                    a += m
            found = outputs(w, states, ids[now], vocabulary)
            out += np.bincount(np.broadcast_to(some[:active], on.shape)[on], found, minlength=len(out))
            t0 = t1
    return out / np.log(10)


def flatten(w: dict[str, np.ndarray], moments: Moments) -> np.ndarray:
    return np.concatenate([*[part[k].ravel() for part in (w, moments.m, moments.v) for k in NAMES], [moments.n]]).astype(np.float64)


def unflatten(flat: np.ndarray, sizes: dict[str, tuple[int, ...]]) -> tuple[dict[str, np.ndarray], Moments]:
    parts, at = [], 0
    for _ in range(3):
        out = {}
        for k in NAMES:
            n = int(np.prod(sizes[k]))
            out[k] = flat[at : at + n].reshape(sizes[k]).astype(np.float32)
            at += n
        parts.append(out)
    moments = Moments(parts[0])
    moments.m, moments.v, moments.n = parts[1], parts[2], float(flat[at])
    return parts[0], moments


def numbered(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs (doc_id, text, held_out) as numbers: ids (bytes), what the table gives to the scores, and tokens past it with times."""
    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("key", pa.int64()), ("n_tokens", pa.int64()), ("n_in_table", pa.int64()), ("base", pa.float64()), ("share", pa.float64()), ("ids", pa.binary()), ("tail", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
    schema = pa.schema(fields)

    def look(text: pa.Array, same: list[pa.Array]) -> pa.RecordBatch:
        rows = len(text)
        tokens, at = hashes(text)
        number, row = vocabulary.look_up(tokens)
        doc = np.repeat(np.arange(rows), np.diff(at))
        end, some = number == vocabulary.end, row >= 0
        rare = ~some & ~end
        value, part = np.zeros(len(row)), np.zeros(len(row))
        value[some], part[some] = vocabulary.log_count[row[some]], vocabulary.share[row[some]]
        value[end], part[rare] = vocabulary.log_end, -vocabulary.log_rare
        base = np.bincount(doc, value, minlength=rows) - np.diff(at) * vocabulary.log_all
        known = np.bincount(doc, some | end & (vocabulary.n_end > 0), minlength=rows).astype(np.int64)
        by = np.lexsort((tokens[rare], doc[rare]))
        t, d = tokens[rare][by], doc[rare][by]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        tail_at = pa.array(np.searchsorted(d[first], np.arange(rows + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(tail_at, pa.array(t[first].view(np.int64))), pa.ListArray.from_arrays(tail_at, pa.array(np.diff(np.append(first, len(t))), pa.int32()))]
        data = number.astype(vocabulary.number_type)
        ids = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((at * data.itemsize).astype(np.int32)), pa.py_buffer(data)])
        return pa.record_batch([*same, pa.array(np.diff(at)), pa.array(known), pa.array(base), pa.array(np.bincount(doc, part, minlength=rows)), ids, *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 4 << 20):
                yield look(batch.column(1).slice(a, b - a), [batch.column(c).slice(a, b - a) for c in (0, 2, 3)])

    keyed = docs.select("doc_id", "text", "held_out", F.xxhash64("doc_id", "text").alias("key"))
    return map_arrow(keyed, run, "doc_id long, held_out boolean, key long, n_tokens long, n_in_table long, base double, share double, ids binary, tail array<long>, times array<int>")


def fit(training: DataFrame, vocabulary: Vocabulary, numbers: DataFrame | None = None) -> dict[str, np.ndarray]:
    """Weights from training (doc_id, text), or numbers, its numbered() rows: a start on the driver, then rounds of shards."""
    p = vocabulary.params
    if numbers is None:
        numbers = numbered(training.select("doc_id", "text", F.lit(False).alias("held_out")), vocabulary)
    numbers = numbers.where("not held_out").select("doc_id", "key", "n_tokens", "ids")
    n, tokens = numbers.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    pick = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.lit(1 << 30))
    few = numbers.where((pick < int((1 << 30) * min(1.0, p.start_documents / max(n, 1)))) & (F.col("n_tokens") <= p.start_tokens)).orderBy("doc_id", "key").select("ids")
    kind, bare = vocabulary.number_type, vocabulary.bare()
    ids = np.frombuffer(b"".join(few.toArrow()["ids"].to_pylist()), kind).astype(np.int32)
    w = start(bare)
    moments = Moments(w)
    w = train_on(w, ids, bare, p.start_passes, moments)
    shards = max(1, -(-int(tokens) // p.shard))
    rounds = max(1, -(-min(int(tokens), p.shard) // p.round))
    dealt = numbers.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("key"), F.lit(rounds)).alias("round"), "doc_id", "key", "ids")
    for k in range(rounds):
        w, moments = next_round(dealt.where(F.col("round") == k).drop("round"), w, moments, bare, shards)
    return w


def next_round(dealt: DataFrame, w: dict[str, np.ndarray], moments: Moments, bare: Vocabulary, shards: int) -> tuple[dict[str, np.ndarray], Moments]:
    """The mean, by tokens, of what each shard of dealt (shard, doc_id, key, ids) makes of w and its moments; these if dealt is empty."""
    p, kind = bare.params, bare.number_type

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, all_ = None, 0
        mine, its, many, now = w, None, 0, None
        held: list[np.ndarray] = []
        size = 0

        def learn() -> None:
            nonlocal mine, its, many, size
            if held:
                ids = np.concatenate(held).astype(np.int32)
                its = its or moments.copy()
                mine, many, size = train_on(mine, ids, bare, moments=its), many + len(ids), 0
                held.clear()

        def close() -> None:
            nonlocal total, all_, mine, its, many
            learn()
            if many:
                part = flatten(mine, its) * many
                total, all_ = part if total is None else total + part, all_ + many
            mine, its, many = w, None, 0

        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                if shard != now:
                    close()
                    now = shard
                held.append(np.frombuffer(raw.as_buffer(), kind).copy())
                size += len(held[-1])
                if size > p.learned:
                    learn()
        close()
        if all_:
            yield sent(total, all_)

    def sent(total: np.ndarray, many: int) -> pa.RecordBatch:
        return pa.record_batch([pa.array([many]), pa.array([(total / many).astype(np.float32).tobytes()], pa.binary())], names=["n", "w"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many = None, 0
        for batch in batches:
            for n, flat in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(flat.as_buffer(), np.float32).astype(np.float64) * n
                total, many = part if total is None else total + part, many + n
        if many:
            yield sent(total, many)

    parts = min(shards, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_shard = dealt.repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard", "doc_id", "key")
    learned = map_arrow(by_shard, go_on, "n long, w binary")
    found = map_arrow(learned.repartition(8, "n"), mean, "n long, w binary").collect()
    if not found:
        return w, moments
    many = sum(r["n"] for r in found)
    return unflatten(sum(np.frombuffer(r["w"], np.float32).astype(np.float64) * (r["n"] / many) for r in found), shapes(bare))


def score(docs: DataFrame, held_out: str = "crc32(cast(doc_id as string)) % 10 = 0", params: LmParams = LmParams()) -> DataFrame:
    """op6's columns for each row of docs (doc_id, text); rows where held_out is true are not learned from.

    Null and empty texts are an end alone. A null doc_id is not held out. With nothing to learn from, counts are 0 and the
    weights those of the start. Rows that repeat are scored and learned from each time; a very long text is scored to its end
    beside shorter ones; other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "gru")
    docs = docs.select("doc_id", "text", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"))
    counts = scratch.table(token_counts(docs.where(~F.col("held_out")).select("text")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "hash").limit(params.table).toArrow()
    vocabulary = Vocabulary(top["hash"].to_numpy().view(np.uint64), top["n"].to_numpy(), int(total), int(distinct), params)
    numbers = scratch.table(numbered(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()), "numbers")
    weights = fit(docs, vocabulary, numbers)
    kind, bare = vocabulary.number_type, vocabulary.bare()
    kept = ["row", "doc_id", "held_out", "n_tokens", "n_in_table", "base", "share"]

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.concatenate([b.column(3).to_numpy(zero_copy_only=False) for b in held])
        ids = np.concatenate([np.frombuffer(b"".join(b.column(7).to_pylist()), kind) for b in held]).astype(np.int32)
        found = document_scores(weights, ids, np.append(0, np.cumsum(sizes)), bare)
        at = 0
        for b in held:
            yield pa.record_batch([*b.columns[:7], pa.array(found[at : at + b.num_rows])], names=[*kept, "model"])
            at += b.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(7).nbytes // np.dtype(kind).itemsize
            if size > params.together:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    made = map_arrow(numbers.select(*kept, "ids"), run, "row long, doc_id long, held_out boolean, n_tokens long, n_in_table long, base double, share double, model double")
    tails = numbers.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("hash"), F.col("t.times").alias("times"))
    met = tails.join(counts.withColumnRenamed("n", "c"), "hash", "left")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + F.lit(float(params.smoothing)))
    summed = met.groupBy("row").agg(F.sum(F.col("times") * log_c).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("seen"))
    out = made.join(scratch.table(summed, "tails"), "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_in_table") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("model") + F.col("share") + logs).alias("score"))


def op6_gru_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


QUERIES = {"op6_gru_lm_score": op6_gru_lm_score}
ORACLE: dict[str, str] = {}
