"""Token counts, whitening and vector codes against the library, plain numpy and a plain loop."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from weftlens.llm import common, token_counts, vector_codes, whitening

ODD = [None, "", " ", "\n\n", "a", "A  b", "<|endoftext|>", "x <|endoftext|>y", "é è\n中文，。", "don't 12ab", " 　 a", "  b", "a\x00 b", "y" * 70000, "ab1," * 40000, "中文，" * 30000, "<|endoftext|>a1" * 20000]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_counts_of_odd_texts_equal_the_library(spark):
    rows = [(None if k == 3 else k, t, "x", 1.5) for k, t in enumerate(ODD)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, `a.b` double").repartition(3)
    got = sorted([tuple(r) for r in token_counts.token_counts(docs).collect()], key=str)
    expected = [(i, len((t or "").encode()), n, n > 512) for (i, t, *_), n in zip(rows, library([r[1] for r in rows]), strict=True)]
    assert got == sorted(expected, key=str)
    assert token_counts.token_counts(docs.where("false")).collect() == []


def test_parts_never_change_a_count():
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\t", " ", "　", "\x1c", "\x0b", "a", "b", "'s", "'", "don't", "9", "12", "<|endoftext|>", "<|", "|>", "é", "中文", "，", "!", "\x00", "🙂", "​", "'ll", "Ⅷ", "²"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(20000)]
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    expected = library(texts)
    assert counter.counts(*common.utf8(pa.array(texts))).tolist() == expected
    old, token_counts.LONG_PART = token_counts.LONG_PART, 4
    try:
        assert [counter.long(t) for t in texts] == expected
    finally:
        token_counts.LONG_PART = old


def test_counts_of_whole_table(spark, small):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.op11_token_counts(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert got == {d["doc_id"]: (len((d["text"] or "").encode()), n, n > 512) for d, n in zip(docs, library([d["text"] for d in docs]), strict=True)}


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_words_that_collide_in_sums_of_powers_stay_apart():
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = bytes(97 + b for b in bits), bytes(98 - b for b in bits)
    short = [b"a", b"a\0", b"", b"abcdefgh", b"abcdefgi", b"abcdefghx", b"abcdefgh"]
    parts = [one, two, one, *short]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    first, which = common.distinct_words(raw, starts, ends)
    assert [parts[first[w]] for w in which] == parts and len(first) == len(set(parts))
    assert len(set(common.word_hashes(raw, starts, ends).tolist())) == len(set(parts))


def test_colliding_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(common, "word_hashes", lambda raw, a, b: np.zeros(len(a), np.uint64))
    raw = np.frombuffer(b"ab" b"cd" b"ab" b"abc", np.uint8)
    first, which = common.distinct_words(raw, np.array([0, 2, 4, 6]), np.array([2, 4, 6, 9]))
    assert which.tolist() == [0, 1, 0, 2] and first.tolist() == [0, 1, 3]


def vectors(spark, rows, kind="float", parts=4):
    return spark.createDataFrame([(i, v, l, 7) for i, v, l in rows], f"vec_id long, embedding array<{kind}>, label int, n int").repartition(parts)


def some(n, d, seed):
    rng = random.Random(seed)
    return [[rng.gauss(0, 1 + j) for j in range(d)] for _ in range(n)]


NAN = float("nan")


def odd_rows(d):
    return [(None, [0.5] * d, 1), (900, None, 1), (901, [NAN] * d, 1), (902, [None] * d, None), (903, [math.inf] * d, 1), (904, [], 1), (905, [1.0], 1)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_whitening_equals_plain_numpy(spark, kind):
    d = 20
    good = [(i, [float(np.float32(c)) for c in v], 1) for i, v in enumerate(some(300, d, 5))]
    good += [(500 + i, good[i][1], 2) for i in range(40)] + [(0, good[7][1], 3)]
    got = whitening.whitened(vectors(spark, good + odd_rows(d), kind, 9)).collect()
    good.append((None, [0.5] * d, 1))
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v, _ in good])
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    centred = (n * u - s) / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    w = ((n * x - s) / n) @ axes[:, :16] / np.sqrt(e[:16])
    dev = ((n * x - s) ** 2).sum(1)
    key = lambda v: (v is None, v or 0)
    by = sorted(range(len(good)), key=lambda k: (key(good[k][0]), int(dev[k])))
    rows = sorted(got, key=lambda r: (key(r["vec_id"]), r["deviation"], r["component"]))
    assert len(rows) == 16 * len(good) and [r["vec_id"] for r in rows[::16]] == [good[k][0] for k in by]
    assert [r["deviation"] for r in rows[::16]] == [int(dev[k]) for k in by] and {r["n"] for r in rows} == {n}
    found = np.array([r["whitened"] for r in rows]).reshape(-1, 16)
    sign = np.sign((found * w[by]).sum(0))
    assert np.abs(found - w[by] * sign).max() < 1e-9
    assert np.allclose([r["explained"] for r in rows[:16]], e[:16] / e.sum(), rtol=1e-10)
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-10


def test_merged_states_lose_nothing():
    rng = np.random.default_rng(4)
    x = rng.integers(-500, 500, (700, 12)) * np.arange(1, 13) + 10**6
    x[:300] += 400
    state = None
    for part in np.array_split(x, 9):
        new = whitening.state_of(part)
        state = new if state is None else whitening.merged(state, new)
    n, sums, values, axes = state
    assert n == 700 and sums == x.sum(0).tolist() and axes.shape == (12, 12)
    c = x - x.mean(0)
    assert np.allclose(axes.T @ np.diag(values**2) @ axes, c.T @ c, rtol=1e-11, atol=1e-5)


def test_numerators_beyond_a_long():
    x = np.array([[10**12, -5]], np.int64)
    assert whitening.numerators(x, 10**9, [3, 4]).tolist() == [[10**21 - 3, -5 * 10**9 - 4]]


def test_whitening_of_few_and_none(spark):
    assert whitening.whitened(vectors(spark, odd_rows(3)[1:6])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).collect() == []
    two = whitening.whitened(vectors(spark, [(1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1)])).collect()
    assert len(two) == 2 and all(abs(abs(r["whitened"]) - 1) < 1e-12 and r["explained"] == 1.0 for r in two)


def plain_codes(rows, d, parts=16, entries=64):
    """The contract of the codes by loops over Python's numbers."""
    kept = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-d // parts)
    q = [[math.floor(256 * c) if abs(c) < 1e300 else 0 for c in r[1]] + [0] * (width * parts - d) for r in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in q]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(book, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(2):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(nearest(books[p], v[p])[1], []).append(v[p])
            for k, vs in groups.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out, by = [], {}
    for r, v in zip(kept, cut, strict=True):
        found = [nearest(books[p], v[p]) for p in range(parts)]
        error = sum(f for f, _ in found)
        by[r[2]] = by.get(r[2], 0) + error
        out.append((r[0], "".join(f"{k:02x}" for _, k in found), error, r[2]))
    digest = hashlib.sha256(",".join(str(c) for b in books for v in b for c in v).encode()).hexdigest()
    short = lambda v: v if v < 1 << 63 else None
    return [(i, code, short(error), short(by[l]), digest) for i, code, error, l in out]


@pytest.mark.parametrize(("n", "d", "scale"), [(200, 32, 1.0), (30, 16, 0.01), (150, 18, 1.0), (90, 16, 1e5), (70, 16, 1e7)])
def test_codes_equal_a_plain_loop(spark, n, d, scale):
    rng = random.Random(n)
    good = [(i, [float(np.float32(c * scale)) for c in v], rng.choice([1, 1, 2, None])) for i, v in enumerate(some(n, d, n))]
    good += [(i + 1000, good[i][1], 5) for i in range(20)] + [(3, good[9][1], 2)]
    odd = [r for r in odd_rows(d) if r[1] and len(r[1]) == d and r[0] not in (901, 902, 903)]
    got = vector_codes.vector_codes(vectors(spark, good + odd_rows(d))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_codes(good + odd, d), key=str)


def test_codes_of_huge_doubles_and_none(spark):
    rows = [(i, [(-1.0) ** i * 1e200 * (i + 1)] * 16, 1) for i in range(70)]
    got = vector_codes.vector_codes(vectors(spark, rows, "double")).collect()
    assert sorted(map(tuple, got)) == sorted(plain_codes(rows, 16))
    assert vector_codes.vector_codes(vectors(spark, odd_rows(3)[1:6])).collect() == []


def test_codes_against_their_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    df = vector_codes.op13_vector_codes(spark, small)
    expected = con.sql(f"SELECT {', '.join(df.columns)} FROM ({vector_codes.ORACLE['op13_vector_codes']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(expected)
