"""The ten operators against brute force, round trips and held-out accuracy, with nulls, empties, ties and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftlens.llm import ego_join, gru_lm, language_nb, line_windows, minhash_stars, packing, pii_crf, piece_dropout, quality_repeats, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "A  b", "x" * 3000, "ab" * 300, "é è\n中 文", "one two three four five six"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def frame(spark, rows, parts=3):
    """Documents with clashing extra columns."""
    full = [(i, t, "kept", 1.0) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, kept string, n double").repartition(parts)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)

    def words(n):
        return " ".join(rng.choice("abcdefghijklmnopqé") + str(rng.randint(0, 9)) for _ in range(n))

    base, line = words(300), words(70)
    rows = list(enumerate(ODD)) + [(90, "y" * 199), (91, "y" * 199)]
    for i in range(250):
        w = base.split()
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(300)] = f"Q{rng.randint(0, 9)}"
        rows.append((100 + i, rng.choice([" ".join(w), words(60) + line + words(rng.randint(1, 90)), words(100), line[: rng.randint(150, 230)] + words(2), " ".join(w[:280])])))
    return rows


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, kept string")


# ---- 1


def test_email_spans_equal_the_pattern():
    rng, pattern = random.Random(2), re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(20000):
        s = "".join(rng.choice("a1.@-+ (%b") for _ in range(rng.randint(0, 14)))
        assert pii_crf.emails(s) == [m.span() for m in pattern.finditer(s)]


def test_base_spans_and_digest(spark):
    text = "é a.b@c.de 10.0.0.256 10.0.0.25 x 4111 1111 1111 1111 x 4111111111111112 x +1 (527) 555-9774 password=abcdef123456"
    docs = frame(spark, [(1, text), *[(k + 10, t) for k, t in enumerate(ODD)]])
    out = {r["doc_id"]: r for r in pii_crf.spans_of(docs, pii_crf.train(docs)).collect()}
    r = out[1]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    base = [("email", "a.b@c.de"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (527) 555-9774")]
    said = ",".join(f"{k}:{(a := text.index(s + (' ' if k == 'ip' else '')))}:{a + len(s)}" for k, s in base)
    assert r["spans"].startswith(said) and r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert all(not out[k + 10]["spans"] for k in range(len(ODD)))
    assert pii_crf.spans_of(empty(spark), pii_crf.train(empty(spark))).count() == 0


def test_skip_edges_carry_labels(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    field = pii_crf.train(docs)
    text = "call +1 (555) 234-5678 " + "word " * 80 + "or 15552345678 now"
    alone = "or 15552345678 now"
    t, u = pii_crf.tokens(text), pii_crf.tokens(alone)
    assert len(t.skips)
    assert pii_crf.marginals(t, field)[-1, 4] >= pii_crf.marginals(u, field)[-1, 4]
    assert "[PHONE]" in pii_crf.redact(text, field)
    out = pii_crf.redacted(docs.withColumn("_x", F.lit(1)), field)
    assert out.columns == [*docs.columns, "_x"]
    assert out.where("text rlike '@mail[0-9]'").count() == 0 and out.where("n_chars <> char_length(text)").count() == 0


def test_marginals_are_exact_on_a_chain():
    rng = np.random.default_rng(0)
    n, k = 4, len(pii_crf.LABELS)
    field = pii_crf.Field(rng.normal(size=(len(pii_crf.FEATURES), k)), rng.normal(size=(3, k, k)), np.zeros((k, k)), rounds=60)
    t = pii_crf.Tokens([(i, i + 1) for i in range(n)], rng.integers(0, 2, (n, len(pii_crf.FEATURES))).astype(float), np.array([2, 0, 1, 2]), np.zeros((0, 2), int))
    own, total = t.features @ field.unary, np.zeros((n, k))
    for y in np.ndindex(*[k] * n):
        p = math.exp(sum(own[i, y[i]] for i in range(n)) + sum(field.chain[t.gaps[i], y[i - 1], y[i]] for i in range(1, n)))
        for i in range(n):
            total[i, y[i]] += p
    assert np.allclose(pii_crf.marginals(t, field), total / total.sum(1, keepdims=True), atol=1e-3)


@pytest.mark.parametrize("kind,pattern", [("IP", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("CARD", r"[0-9]([\x20-]?[0-9])+"), ("PHONE", r"\+[0-9][\x20().0-9-]+[0-9]")])
def test_other_base_spans_equal_their_patterns(kind, pattern):
    rng, plain, made = random.Random(20), re.compile(pattern), getattr(pii_crf, kind)
    for _ in range(20000):
        t = "".join(rng.choice("12..-+ (x") for _ in range(rng.randint(0, 24)))
        assert [m.span() for m in made.finditer(t)] == [m.span() for m in plain.finditer(t)]


def exact_marginals(t, field):
    n, k = len(t.spans), len(pii_crf.LABELS)
    own, total = t.features @ field.unary, np.zeros((n, k))
    for y in np.ndindex(*[k] * n):
        e = sum(own[i, y[i]] for i in range(n)) + sum(field.chain[t.gaps[i], y[i - 1], y[i]] for i in range(1, n)) + sum(field.skip[y[i], y[j]] for i, j in t.skips)
        p = math.exp(e)
        for i in range(n):
            total[i, y[i]] += p
    return total / total.sum(1, keepdims=True)


def test_skip_edges_against_enumeration():
    """A loop of chain and skip edges: loopy passing is near the exact marginals and has their labels."""
    rng = np.random.default_rng(3)
    k = len(pii_crf.LABELS)
    for seed in range(5):
        field = pii_crf.Field(rng.normal(size=(len(pii_crf.FEATURES), k)), 0.3 * rng.normal(size=(3, k, k)), 1.2 * np.eye(k))
        t = pii_crf.Tokens([(i, i + 1) for i in range(5)], rng.integers(0, 2, (5, len(pii_crf.FEATURES))).astype(float), np.array([2, 0, 1, 2, 1]), np.array([[0, 3], [0, 4], [3, 4]]))
        want, got = exact_marginals(t, field), pii_crf.marginals(t, field)
        assert np.abs(want - got).max() < 0.12
        sure = want.max(1) > 0.6
        assert (want.argmax(1) == got.argmax(1))[sure].all()


def test_a_secret_is_its_value(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    field = pii_crf.train(docs)
    # the corpus has secrets of this form alone, so the field knows no other
    for text in ('x token = "11acdfb36bb72224148e6160f674b4be45601bff"### y', 'token = "f0ddae3b09ae356cbefecdd3232fa5489bb400d6", z'):
        found = [text[a:b] for kind, a, b in pii_crf.find(text, field) if kind == "crf-secret"]
        assert found == re.findall("[0-9a-f]{40}", text), text


def test_skip_potentials_change_labels(spark, small):
    """A repeat without evidence of its own takes the label of one that has it, and only by way of the skip edge."""
    from dataclasses import replace

    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    field = pii_crf.train(docs)
    without = replace(field, skip=np.zeros_like(field.skip))
    text = "call +1-555-234-5678 soon. " + "word " * 80 + "or 5552345678, " + "word " * 80 + "or 555-234-5678 now"
    t = pii_crf.tokens(text)
    assert len(t.skips) >= 2
    more = pii_crf.marginals(t, field)[1:, 4] - pii_crf.marginals(t, without)[1:, 4]
    assert more[0] > 0.1, more


def test_odd_rows_of_personal_data(spark):
    text = "mail a.b@c.de now"
    rows = [(1, text), (1, text), (None, text), (2, None), (3, "")]
    docs = frame(spark, rows)
    field = pii_crf.train(docs)
    got = sorted(((r["doc_id"] or 0), r["n_email"]) for r in pii_crf.spans_of(docs, field).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 0)]
    out = pii_crf.redacted(docs, field)
    assert out.columns == docs.columns and sorted(r["text"] or "" for r in out.collect()) == ["", "", *["mail [EMAIL] now"] * 3]
    assert pii_crf.redacted(empty(spark), field).count() == 0


# ---- 2


def test_language_held_out(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    held = {r["doc_id"] for r in docs.select("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    langs, table = language_nb.learn(docs.where(~F.col("doc_id").isin(*held)))
    got = language_nb.predict(docs, langs, table).join(docs.select("doc_id", "lang"), "doc_id").where(F.col("doc_id").isin(*held)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in language_nb.predict(frame(spark, [*enumerate(ODD), (99, "12 34 !?")]), langs, table).collect()}
    assert {odd[k]["lang_pred"] for k in (0, 1, 2, 3, 99)} == {"und"} and odd[8]["lang_pred"] in langs
    none = language_nb.learn(empty(spark))
    assert none[0] == [] and language_nb.predict(frame(spark, [(1, "abc")]), *none).first()["lang_pred"] == "und"


def test_grams_stay_in_their_text():
    p = language_nb.LanguageParams()
    both, bounds = language_nb.grams(["abc", "İx"], p)
    for k, t in enumerate(["abc", "İx"]):
        assert (both[:, bounds[k] : bounds[k + 1]] == language_nb.grams([t], p)[0]).all()


def test_language_against_a_plain_bayes():
    """Counts in dictionaries, one n-gram at a time."""
    p = language_nb.LanguageParams()

    def bucket(g):
        h = 0
        for c in g:
            h = (h + ord(c) + 1) * 0x9E3779B1 & 0xFFFFFFFF
            h ^= h >> 15
        return (h * 0x85EBCA77 & 0xFFFFFFFF) >> (32 - p.buckets.bit_length() + 1)

    def grams_of(t):
        t = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in f" {t} ".lower())
        return [bucket(t[i : i + n]) for n in p.orders for i in range(len(t) - n + 1)]

    rng = random.Random(22)
    texts_ = ["".join(rng.choice(c) for _ in range(rng.randint(1, 80))) for c in ("abcd éx", "cdef ß1", "efgh ø.") for _ in range(30)]
    for t in texts_:
        found, _ = language_nb.grams([t], p)
        assert sorted(x for row in found.tolist() for x in row if x >= 0) == sorted(grams_of(t))


def test_language_predictions_against_a_plain_bayes(spark):
    p = language_nb.LanguageParams()
    rng = random.Random(23)
    rows = [(k, "".join(rng.choice(c) for _ in range(rng.randint(5, 60))), lang) for k, (c, lang) in enumerate([("abcd é", "a"), ("cdef ß", "b"), ("efgh ø", "c")] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table = language_nb.learn(docs, p)
    counts = {x: collections.Counter() for x in langs}
    for _, t, lang in rows:
        counts[lang].update(x for row in language_nb.grams([t], p)[0].tolist() for x in row if x >= 0)
    got = {r["doc_id"]: r["lang_pred"] for r in language_nb.predict(docs, langs, table, p).collect()}
    for k, t, _ in rows:
        mine = [x for row in language_nb.grams([t], p)[0].tolist() for x in row if x >= 0]
        score = {x: math.log(sum(r[2] == x for r in rows) / len(rows)) + sum(math.log((counts[x][g] + p.smoothing) / (sum(counts[x].values()) + p.smoothing * p.buckets)) for g in mine) for x in langs}
        best = max(score.values())
        assert score[got[k]] > best - 1e-3
    odd = language_nb.predict(spark.createDataFrame([(1, "² ½ ①"), (1, "Ⅷ"), (None, "dcba")], "doc_id long, text string"), langs, table).collect()
    assert sorted(r["lang_pred"] for r in odd) == ["a", "und", "und"]


# ---- 3


def quality_by_hand(t):
    t = t or ""
    w = WORD.findall(t)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cov = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    longest = next((n for n in range(len(w), 0, -1) if len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) < len(w) - n + 1), 0)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(ch in "#*$%&|<>" for ch in t), "n_dup_lines": dup, "n_repeat_words": len(cov), "longest_repeat": longest, "base_failed": len(w) < 20 or 100 * len(cov) > 30 * len(w)}


def test_quality_against_brute_force(spark):
    rng = random.Random(3)
    rows = list(enumerate(ODD)) + [(50, "a\na\na"), (51, "\n\na b\n\na b\n")]
    for k in range(300):
        rows.append((100 + k, "".join(rng.choice(["a", "b", "é", "cc", "#", "dd", "中"] + [str(i) for i in range(rng.choice([2, 8, 30]))]) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randint(0, 90)))))
    docs = frame(spark, rows)
    got = {r["doc_id"]: r.asDict() for r in quality_repeats.quality(docs).collect()}
    for i, t in rows:
        want = quality_by_hand(t)
        assert {k: got[i][k] for k in want} == want, t
        assert not (got[i]["kept"] and want["base_failed"])
    kept = quality_repeats.good_documents(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["kept"]}
    assert quality_repeats.quality(empty(spark)).count() == 0


# ---- 4


def test_line_windows_against_duckdb(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got = sorted(tuple(r) for r in line_windows.op4_line_windows(spark, small).collect())
    assert got == sorted(con.sql(f"SELECT doc_id, n_lines, n_removed, kept_sha256 FROM ({line_windows.ORACLE['op4_line_windows']})").fetchall())
    assert line_windows.without_repeats(docs).columns == [*docs.columns, "n_lines", "n_removed"]


def test_line_windows_by_hand(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, None), (4, ""), (5, "a\nb"), (6, "\n\n\n\n"), (7, "\n\n\n\n"), (8, "p\nq\nr\np\nq\nr"), (9, "k\nl\nm"), (9, "k\nl\nm")]
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in line_windows.without_repeats(frame(spark, rows)).collect() if r["doc_id"] != 3)
    assert got == [(1, "a\nb\nc\nd", 0), (2, "x\ny", 4), (4, "", 0), (5, "a\nb", 0), (6, "\n\n\n\n", 0), (7, "\n\n\n\n", 0), (8, "p\nq\nr", 3), (9, "k\nl\nm", 0), (9, "k\nl\nm", 0)]


# ---- 5


def test_packing(spark, texts):
    rows = [*texts, (7777, "Hello there " * 1500)]
    got = packing.pack(frame(spark, rows), size=256).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 256)):
            part = ids[s : s + 256]
            want[i, k] = (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    assert len(by) <= -(-sum(r["length"] for r in got) // 256) * 1.1
    assert packing.pack(empty(spark)).count() == 0


def test_plan_uses_every_piece_and_fills_exact_complements():
    rng = random.Random(5)
    for size in (16, 64):
        for _ in range(50):
            counts = collections.Counter(rng.randint(1, size) for _ in range(rng.randint(0, 200)))
            used = collections.Counter()
            for n, inside in packing.plan(dict(counts), size):
                assert sum(a * b for a, b in inside) <= size
                for a, b in inside:
                    used[a] += n * b
            assert +used == +counts
    assert packing.plan({10: 5, 6: 5}, 16) == [(5, [(10, 1), (6, 1)])]
    assert packing.plan({9: 2, 4: 2, 3: 2}, 16) == [(2, [(9, 1), (4, 1), (3, 1)])]


# ---- 6


def test_gradients_and_normalisation():
    rng = np.random.default_rng(0)
    p = gru_lm.LmParams(own=8, per_class=4, bins=3, hidden=5)
    h = rng.integers(1, 1 << 60, 40).astype(np.uint64)
    n = np.sort(rng.integers(1, 100, 40))[::-1].copy()
    v = gru_lm.Vocabulary(np.append(h, gru_lm.END), np.append(n, 10), int(n.sum()) + 60, 60, p)
    w = {k: x.astype(float) for k, x in gru_lm.start(v).items()}
    states, target = rng.standard_normal((20, 5)), rng.integers(0, v.inputs, 20)
    _, dh, g = gru_lm.outputs(w, states, target, v, True)
    for k in ("c", "cb", "o", "ob"):
        i = tuple(rng.integers(0, s) for s in w[k].shape)
        a = w[k][i]
        w[k][i] = a + 1e-5
        up = -gru_lm.outputs(w, states, target, v).sum()
        w[k][i] = a - 1e-5
        down = -gru_lm.outputs(w, states, target, v).sum()
        w[k][i] = a
        assert (up - down) / 2e-5 == pytest.approx(g[k][i], abs=1e-5)
    assert np.allclose(sum(np.exp(gru_lm.outputs(w, states, np.full(20, t), v)) for t in range(v.inputs)), 1)


def test_lm_sums_rows_by_number():
    rng = np.random.default_rng(5)
    which = np.concatenate([np.full(40, 3), rng.integers(0, 30, 90), [31]]).astype("<u2")
    rng.shuffle(which)
    rows = rng.standard_normal((3, len(which), 4))
    want = np.zeros((3, 32, 4))
    np.add.at(want, (slice(None), which), rows)
    number, got = gru_lm._sums(rows, which)
    assert sorted(number) == sorted(set(which.tolist())) and np.allclose(got, want[:, number])


def test_lm_takes_large_logits():
    p = gru_lm.LmParams(own=8, per_class=4, bins=3, hidden=5)
    v = gru_lm.Vocabulary(np.arange(1, 41).astype(np.uint64), np.arange(40, 0, -1), 900, 41, p)
    w = {k: x * 3000 for k, x in gru_lm.start(v).items()}
    h, target = np.tanh(np.random.default_rng(2).standard_normal((60, 5))).astype(np.float32), np.arange(60) % v.inputs
    exact = {k: x.astype(float) for k, x in w.items()}
    got, want = gru_lm.outputs(w, h, target, v), gru_lm.outputs(exact, h.astype(float), target, v)
    assert np.isfinite(got).all() and want.min() < -500 and np.allclose(got, want, rtol=1e-4, atol=1e-2)


def test_lm_long_documents_take_few_calls(monkeypatch):
    p = gru_lm.LmParams(own=8, per_class=4, bins=3, hidden=5)
    v = gru_lm.Vocabulary(np.arange(1, 41).astype(np.uint64), np.arange(40, 0, -1), 900, 41, p)
    w, calls, outputs = gru_lm.start(v), [], gru_lm.outputs
    ids = np.random.default_rng(3).integers(0, v.inputs, 3000).astype(np.int32)
    ids[-1] = v.end
    h, before, want = np.zeros((1, 5), np.float32), v.end, 0.0
    for t in ids:
        h = gru_lm.step(w, np.array([before]), h)[0]
        want, before = want + outputs(w, h, np.array([t]), v)[0] / math.log(10), t
    monkeypatch.setattr(gru_lm, "outputs", lambda *a: calls.append(1) or outputs(*a))
    assert np.isclose(gru_lm.document_scores(w, ids, np.array([0, 3000]), v)[0], want, rtol=1e-5) and len(calls) < 10  # 94 by 32 steps each


def test_scores_go_on_from_window_to_window():
    p = gru_lm.LmParams(own=8, per_class=4, bins=3, hidden=5, in_step=3)
    v = gru_lm.Vocabulary(np.arange(1, 41).astype(np.uint64), np.arange(40, 0, -1), 900, 41, p)
    w = gru_lm.start(v)
    rng = np.random.default_rng(1)
    sizes = [1, 100, 7, 33, 64, 2]
    ids = rng.integers(0, v.inputs, sum(sizes)).astype(np.int32)
    bounds = np.append(0, np.cumsum(sizes))
    got = gru_lm.document_scores(w, ids, bounds, v)
    for k in range(len(sizes)):
        h, total = np.zeros((1, 5), np.float32), 0.0
        before = v.end
        for t in ids[bounds[k] : bounds[k + 1]]:
            h = gru_lm.step(w, np.array([before]), h)[0]
            total += gru_lm.outputs(w, h, np.array([t]), v)[0] / math.log(10)
            before = t
        assert got[k] == pytest.approx(total, rel=1e-4)


def test_base_scores_and_gain(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(90000, None), (90001, ""), (90002, "zz zz q")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in gru_lm.score(docs, params=gru_lm.LmParams(table=400, own=128)).collect()}
    rows = [(r[0], r[1]) for r in docs.collect()]
    tok = {i: [*WORD.findall(lower(t or "")), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = collections.Counter(x for i, _ in rows if not held[i] for x in tok[i])
    n, v = sum(c.values()), len(c)
    for i, _ in rows:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tok[i]), sum(c[x] > 0 for x in tok[i]), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tok[i]), rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    by_model, by_counts, n_held = (sum(f(got[i]) for i, _ in rows if held[i]) for f in (lambda r: r["score"], lambda r: r["base_score"], lambda r: r["n_tokens"]))
    assert by_model / n_held > by_counts / n_held + 0.1  # held-out gain over the counts, in log10 a token
    assert gru_lm.score(empty(spark)).count() == 0


def test_every_training_token_is_a_target_once_a_pass(monkeypatch):
    p = gru_lm.LmParams(own=8, per_class=4, bins=3, hidden=5)
    v = gru_lm.Vocabulary(np.arange(1, 41).astype(np.uint64), np.arange(40, 0, -1), 900, 41, p)
    seen, outputs = np.zeros(v.inputs, int), gru_lm.outputs

    def counted(w, h, target, *more, **named):
        np.add.at(seen, target, 1)
        return outputs(w, h, target, *more, **named)

    monkeypatch.setattr(gru_lm, "outputs", counted)
    for n in (1, 15, 17, 64 * 16 - 1, 64 * 16 + 63, 5000):
        ids = np.random.default_rng(n).integers(0, v.inputs, n).astype(np.int32)
        seen[:] = 0
        gru_lm.train_on(gru_lm.start(v), ids, v, 2)
        assert (seen == 2 * np.bincount(ids, minlength=v.inputs)).all()


def test_weights_are_learned_from_all_documents(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    p = gru_lm.LmParams(own=8, per_class=4, bins=3, hidden=5, start_documents=0)
    tokens = gru_lm.hashes(pa.array([t for _, t in rows]))[0]
    hashed, n = np.unique(tokens, return_counts=True)
    by = np.argsort(-n, kind="stable")
    v = gru_lm.Vocabulary(hashed[by], n[by], int(n.sum()), len(n), p)
    want = gru_lm.train_on(gru_lm.start(v), v.look_up(tokens)[0], v)
    got = gru_lm.fit(docs, v)
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in gru_lm.NAMES)


def test_weights_do_not_hang_on_the_partitioning(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60)))) for i in range(200)] + [(None, "a b a b"), (5, "h g"), (5, "h g"), (6, None), (7, "")]
    p = gru_lm.LmParams(own=8, per_class=4, bins=3, hidden=5, shard=1500, learned=700)
    tokens = gru_lm.hashes(pa.array([t for _, t in rows]))[0]
    hashed, n = np.unique(tokens, return_counts=True)
    by = np.argsort(-n, kind="stable")
    v = gru_lm.Vocabulary(hashed[by], n[by], int(n.sum()), len(n), p)
    one, other = (gru_lm.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(k), v) for k in (1, 5))
    assert all(np.allclose(one[k], other[k], atol=1e-5) for k in gru_lm.NAMES)


def test_rounds_average_shards_and_keep_moments(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60)))) for i in range(120)]
    p = gru_lm.LmParams(own=8, per_class=4, bins=3, hidden=5, start_documents=0, shard=2000, round=1000)
    tokens, at = gru_lm.hashes(pa.array([t for _, t in rows]))
    hashed, n = np.unique(tokens, return_counts=True)
    by = np.argsort(-n, kind="stable")
    v = gru_lm.Vocabulary(hashed[by], n[by], int(n.sum()), len(n), p)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    numbers = gru_lm.numbered(docs.selectExpr("doc_id", "text", "false AS held_out"), v)
    shards = -(-len(tokens) // p.shard)
    place = {r[0]: r[1:] for r in numbers.selectExpr("doc_id", f"pmod(key, {shards})", "pmod(xxhash64(key), 2)").collect()}
    number = v.look_up(tokens)[0]
    w = gru_lm.start(v)
    moments = gru_lm.Moments(w)
    for k in range(2):
        made = []
        for shard in range(shards):
            ids = np.concatenate([number[at[i] : at[i + 1]] for i in range(120) if place[i] == (shard, k)])
            its = moments.copy()
            made.append((len(ids), gru_lm.flatten(gru_lm.train_on(w, ids, v, moments=its), its)))
        w, moments = gru_lm.unflatten(sum(m * f for m, f in made) / sum(m for m, _ in made), gru_lm.shapes(v))
    got = gru_lm.fit(docs, v)
    assert shards > 1 and moments.n > 2
    assert all(np.allclose(got[k], w[k], atol=1e-5) for k in gru_lm.NAMES)


def test_scores_of_odd_rows_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b"), (4, "z" * 50000), (5, "word " * 20000)]
    got = gru_lm.score(frame(spark, rows), params=gru_lm.LmParams(table=64, own=16, per_class=4)).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 2, 3, 4, 4, 20001] and all(math.isfinite(r["score"]) for r in got)
    same = [r["score"] for r in got if r["doc_id"] == 3]
    assert same[0] == pytest.approx(same[1])


def test_gradients_through_time():
    """Of the recurrent weights, by finite differences of a window's loss."""
    p = gru_lm.LmParams(own=8, per_class=4, bins=3, hidden=4, streams=2, window=6)
    v = gru_lm.Vocabulary(np.arange(1, 41).astype(np.uint64), np.arange(40, 0, -1), 900, 41, p)
    ids = np.array([0, 3, v.end, 5, 2, 1, 7, 9, v.end, 4, 4, 6], np.int32)
    start = {k: x.astype(np.float64) * 3 for k, x in gru_lm.start(v).items()}
    filled = np.append(v.end, ids)
    before, target = filled[:-1].reshape(2, 6).T, filled[1:].reshape(2, 6).T

    def loss(w):
        h, total = np.zeros((2, 4)), 0.0
        for t in range(6):
            h = np.where((before[t] == v.end)[:, None], 0.0, h)
            h = gru_lm.step(w, before[t], h)[0]
            total -= gru_lm.outputs(w, h, target[t], v).sum()
        return total / 12

    # the first Adam step moves each weight by the rate against the sign of its gradient
    after = gru_lm.train_on({k: x.astype(np.float32) for k, x in start.items()}, ids, v)
    for key in ("x", "u", "b"):
        moved = after[key] - start[key].astype(np.float32)
        for at in np.ndindex(*start[key].shape):
            w = {k: x.copy() for k, x in start.items()}
            w[key][at] += 1e-5
            up = loss(w)
            w[key][at] -= 2e-5
            slope = (up - loss(w)) / 2e-5
            if abs(slope) > 1e-4:
                assert moved[at] * slope < 0, (key, at)


# ---- 7


def agenda(pieces, text, key, rate):
    """The rule one candidate at a time."""
    points = [0x20, *map(ord, text)]
    symbols = [(int(pieces.character[p]), k, k) for k, p in enumerate(points)]
    fresh = [k for k in range(len(points)) if k == 0 or (points[k] == 0x20 and points[k - 1] != 0x20) or pieces.character[points[k]] < 0 or pieces.character[points[k - 1]] < 0]
    mask = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    while True:
        best = None
        for k in range(len(symbols) - 1):
            (a, first, _), (b, second, last) = symbols[k], symbols[k + 1]
            if a < 0 or b < 0 or second in fresh:
                continue
            joined = int(pieces.joined(np.array([a], np.int32), np.array([b], np.int32))[0])
            h = mixed((key + first * int(piece_dropout._FIRST) + last * int(piece_dropout._LAST)) & mask) >> 32
            if joined >= 0 and h >= int(rate * 2**32) and (best is None or pieces.rank[joined] < best[0]):
                best = (pieces.rank[joined], k, joined)
        if best is None:
            break
        _, k, joined = best
        symbols[k : k + 2] = [(joined, symbols[k][1], symbols[k + 1][2])]
    out = []
    for s, first, _ in symbols:
        out += [s] if s >= 0 else [int(pieces.bytes_id[b]) for b in chr(points[first]).encode()]
    return out


def test_pieces_round_trip_and_agenda(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, pieces = sentencepiece.SentencePieceProcessor(model_file=path), piece_dropout.Pieces(path)
    rng = random.Random(6)
    rows = [*ODD[1:], "a▁b", "▁", " lead", "tail ", "aaaa " * 9, "é̀ 𝔸 \x00", "Hello world, this is varied segmentation"] + ["".join(rng.choice("abt ion\né日▁") for _ in range(rng.randint(0, 25))) for _ in range(150)]
    keys = piece_dropout.row_keys(pa.array(range(len(rows))), 7)
    raw, off = piece_dropout.utf8(pa.array(rows))
    seen = []
    for rate in (0.0, 0.1, 0.5, 1.0):
        ids, at = pieces.encode(raw, off, keys, rate)
        back, ends = pieces.decode(ids, at)
        assert [back[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:])] == rows
        seen.append(len(ids))
        for k, t in enumerate(rows):
            own = ids[at[k] : at[k + 1]].tolist()
            if rate == 0 and "▁" not in t:
                assert own == model.encode(t)
            if rate in (0.1, 0.5) and t and len(t) < 60:
                assert own == agenda(pieces, t, int(keys[k]), rate)
    assert seen[0] < seen[2] < seen[3]
    docs = frame(spark, [(k, t) for k, t in enumerate([None, *rows])])
    coded = piece_dropout.encoded(docs)
    assert {r["doc_id"]: r["text"] for r in piece_dropout.decoded(coded).collect()} == dict(enumerate([None, *rows]))
    assert piece_dropout.digests(docs).where("not lossless").count() == 0
    assert piece_dropout.digests(empty(spark)).count() == 0


@pytest.mark.parametrize("rate", [0.0, 0.3])
def test_long_runs_have_the_same_pieces(rate, monkeypatch):
    """Cut and heaped runs against the rule and against runs that are neither."""
    pieces = piece_dropout.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(70)
    rows = ["".join(rng.choice(c) for _ in range(n)) for c, n in (("ab", 70), ("etaoin", 90), ("aB3+/", 90), ("a", 80), ("the ", 60), ("é日x", 75))]
    keys = piece_dropout.row_keys(pa.array(range(len(rows))), 7)
    raw, off = piece_dropout.utf8(pa.array(rows))
    plain = pieces.encode(raw, off, keys, rate)
    monkeypatch.setattr(piece_dropout, "LONG", 8)
    monkeypatch.setattr(piece_dropout, "HEAP", 8)
    ids, at = pieces.encode(raw, off, keys, rate)
    assert ids.tolist() == plain[0].tolist() and at.tolist() == plain[1].tolist()
    for k, t in enumerate(rows):
        assert ids[at[k] : at[k + 1]].tolist() == agenda(pieces, t, int(keys[k]), rate)


def long_texts():
    rng = random.Random(71)
    return ["".join(rng.choice("etaoinshr") for _ in range(1 << 20)), "1" * (1 << 20), "ab12 cd " * (1 << 17), "x\n" * (1 << 19)]


@pytest.mark.parametrize("k", range(4))
def test_a_megabyte_of_one_text(k):
    """Each operator's kernel on one very long text, in time and memory in proportion to its length."""
    import time

    text = long_texts()[k]
    column = pa.array([text, None, ""])
    took = {}

    def timed(name, fn):
        began = time.time()
        out = fn()
        took[name] = time.time() - began
        return out

    assert timed("pii", lambda: pii_crf.base_spans(text)) == [[], [], [], []]
    timed("tokens", lambda: pii_crf.tokens(text))
    assert timed("quality", lambda: quality_repeats.measure(column, quality_repeats.RepeatRules()))["n_words"].tolist() == [len(text.split()), 0, 0]
    pieces = piece_dropout.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    raw, off = piece_dropout.utf8(column)
    ids, at = timed("dropout", lambda: pieces.encode(raw, off, piece_dropout.row_keys(pa.array([1, 2, 3]), 7)))
    back, ends = pieces.decode(ids, at)
    assert back[ends[0] : ends[1]].tobytes().decode() == text
    assert len(timed("grams", lambda: language_nb.grams([text], language_nb.LanguageParams()))[0]) == 3
    assert timed("shingles", lambda: minhash_stars.shingles(column))[1][-1] >= 1
    assert timed("contexts", lambda: suffix_dedup.contexts_of(raw, off))[2].sum() == len(raw) - 199
    assert timed("lm", lambda: gru_lm.hashes(column))[1].tolist() == [0, len(text.split()) + 1, len(text.split()) + 2, len(text.split()) + 3]
    assert max(took.values()) < 60, took


def test_a_megabyte_row_through_spark(spark):
    rows = [(1, "word " * 200000), (2, "z" * (1 << 20)), (3, "a b c"), (None, None)]
    docs = frame(spark, rows)
    assert line_windows.without_repeats(docs).count() == 4
    assert packing.pack(docs, size=2048).groupBy("doc_id").sum("length").where("doc_id = 1").first()[1] > 200000
    got = {r["doc_id"]: r for r in minhash_stars.near_duplicates(docs).collect()}
    assert got[1]["n_shingles"] == 1 and got[2]["kept"]
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeats_removed(docs).collect()} == {1: 1000000, 2: 1 << 20, 3: 0, None: 0}


# ---- 8


def near_by_hand(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids = [i for i in sorted(sets) if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [(128, 1024), (8, 32), (40, 64)])
def test_near_duplicates_against_brute_force(spark, texts, block):
    rows = [*texts, (500, "A b"), (501, "a  B")]
    got = minhash_stars.near_duplicates(frame(spark, rows), minhash_stars.MinHashParams(block=block)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_by_hand(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_without_ids(spark):
    same = "one two three four five six"
    got = minhash_stars.near_duplicates(frame(spark, [(None, same), (None, same), (4, same), (3, same)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (0, 0, True), (3, 3, True), (4, 3, False)]


def test_near_duplicates_of_repeated_ids(spark):
    """Rows that share a doc_id are linked through their own texts only."""
    one, two, three = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(7, one), (8, one + " z"), (8, two), (9, two + " y"), (3, three), (3, three)]
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash_stars.near_duplicates(frame(spark, rows)).collect())
    assert got == [(3, 3), (3, 3), (7, 7), (8, 7), (8, 8), (9, 8)]
    kept = minhash_stars.without_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, three), (7, one), (8, two)]


@pytest.mark.parametrize("elements", [1 << 20, 400, 4000])
def test_near_duplicates_in_blocks_of_few_shingles(spark, elements):
    rows = near_copies(81)
    got = minhash_stars.near_duplicates(frame(spark, rows), minhash_stars.MinHashParams(block=(4, 8), elements=elements)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_by_hand(rows)


def test_common_elements_in_slices(monkeypatch):
    rng = np.random.default_rng(8)
    loads = [np.unique(rng.choice(pool, n)) for n in (0, 1, 50, 200, 200, 77) for pool in [rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)]]
    loads += [np.unique(np.concatenate([loads[3][::2], loads[4][::3]]))]
    for size in (1 << 19, 37):
        monkeypatch.setattr(minhash_stars, "SLICE", size)
        monkeypatch.setattr(minhash_stars, "COLUMNS", 16)
        both = minhash_stars.common_elements(loads)
        assert all(both[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(loads) for j, b in enumerate(loads) if i != j)


@pytest.mark.parametrize("size", [200, 201, 267, 399, 400, 401])
def test_common_elements_in_one_to_three_slices(monkeypatch, size):
    rng = np.random.default_rng(9)
    pool = np.unique(rng.integers(0, 1 << 64, 300, dtype=np.uint64))
    loads = [np.sort(rng.choice(pool, 200, replace=False)) for _ in range(2)]
    monkeypatch.setattr(minhash_stars, "SLICE", size)
    assert minhash_stars.common_elements(loads)[0, 1] == len(np.intersect1d(*loads))


def test_near_duplicates_of_nothing(spark):
    assert minhash_stars.near_duplicates(empty(spark)).count() == 0


def near_at(rows, percent):
    """Least id of each row's group under links of at least percent, and the similarities of all pairs."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root, alike, ids = {i: i for i in sets}, [], sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            union = len(sets[a]) + len(sets[b]) - both
            if union and both:
                alike.append(both / union)
            if union and 100 * both >= percent * union:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root, alike


def near_copies(seed):
    """Groups of copies at all distances from one text each."""
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        base = [f"{g}-{rng.randint(0, 99999)}" for _ in range(150)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(150)] = f"q{rng.randint(0, 99999)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_pipeline_takes_near_copies_at_80(spark, small):
    import corpus_pipeline

    rows = near_copies(80)
    want, alike = near_at(rows, 80)
    assert sum(0.8 <= x < 0.85 for x in alike) > 50
    kept = {i for i, r in want.items() if i == r}
    assert kept != {i for i, r in near_at(rows, 85)[0].items() if i == r}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), small).collect()} == kept


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
def test_members_linked_to_each_other_meet_near_or_far(percent):
    p = minhash_stars.MinHashParams(percent=percent)
    # the pivot shares 600 of 1000 with x; z lacks just so many of x's that x and z are at the threshold
    x, z = np.arange(1000, dtype=np.uint64), np.arange(1000 - 10 * percent, 1000, dtype=np.uint64)
    for pivot in (np.arange(600, dtype=np.uint64), np.arange(599, dtype=np.uint64)):
        near = [len(np.intersect1d(pivot, y)) / len(np.union1d(pivot, y)) for y in (x, z)]
        assert 100 * len(z) >= percent * len(x)
        assert all(s >= p.near_from for s in near) or all(s < p.far_below for s in near)


# ---- 9


def removed_by_hand(rows):
    seen = collections.Counter(b[i : i + 200] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - 199))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        m = np.cumsum(gone)[:-1] > 0
        runs = int((m[1:] & ~m[:-1]).sum() + (m[0] if len(m) else 0))
        out.append((d, len(b), int(m.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("contexts", [256, 5])
def test_suffix_dedup_against_brute_force(spark, texts, contexts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", contexts)
    rows = [*texts, (600, "z" * 200), (600, "z" * 200)]
    got = sorted(tuple(r) for r in suffix_dedup.repeats_removed(frame(spark, rows)).collect())
    assert got == removed_by_hand(rows)


def test_suffix_dedup_decides_the_same_without_counting(spark, texts):
    rows = [*texts[:120], (600, "z" * 200), (601, "z" * 200), (None, "z" * 201), (700, texts[20][1]), (700, texts[21][1])]
    got = [sorted(map(str, suffix_dedup.repeats_removed(frame(spark, rows), count).collect())) for count in (True, False)]
    assert got[0] == got[1]


def test_suffix_classes():
    rng = np.random.default_rng(1)
    for length in (20, 40, 200):
        for k in range(8):
            text = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(length, 2000)).astype(np.uint8)
            if k % 2:
                text = np.concatenate([text, text[: max(length, len(text) // 3)], text[::-1]])
            starts = np.arange(len(text) - length + 1)
            found = suffix_dedup.window_classes(text, starts, length, bucket=64)
            by: dict = {}
            assert all(by.setdefault(text[i : i + length].tobytes(), c) == c for i, c in zip(starts, found)) and len(set(by.values())) == len(by)


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.repeats_removed(empty(spark)).count() == 0


# ---- 10


def links_by_hand(rows):
    unit = {}
    for k, (_, e, label) in enumerate(rows):
        if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e) and any(e):
            v = np.array(e, float)
            unit[k] = v / np.linalg.norm(v)
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in unit:
        for b in unit:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                n[a] += 1
                n[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least: dict = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), 1 << 60), rows[k][0])
    return sorted((rows[k][0], n[k], least[find(k)], rows[k][0] == least[find(k)]) for k in range(len(rows)))


@pytest.mark.parametrize("block,least", [(1024, 128), (16, 4)])
def test_grid_join_against_brute_force(spark, block, least):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(12, 16))
    rows = []
    for k in range(260):
        v = centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0, 0.15, 0.3, 0.5])
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(rng.integers(3))))
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [1.0, None], 1), (303, [float("nan"), 1.0], 1), (304, [1.0, 2.0], None), (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (307, [1.0, 2.0], 1), (308, [], 1), (309, [float("inf"), 1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("m", F.lit("x")).repartition(3)
    got = sorted(tuple(r) for r in ego_join.near_vectors(df, ego_join.GridParams(block=block, least=least)).collect())
    assert got == links_by_hand(rows)
    assert sum(r[1] for r in got) > 100


def test_grid_join_without_ids_and_with_repeated_ones(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(5, 8))
    rows = [(None, [1.0, 2.0], 1), (None, [1.0, 2.01], 1), (5, [1.0, 2.02], 1), (None, [-3.0, 1.0], 1), (None, None, 1)]
    for k in range(150):
        v = centres[rng.integers(5)] + rng.normal(size=8) * 0.2
        rows.append((None if rng.random() < 0.2 else int(rng.integers(40)), [float(x) for x in v.astype(np.float32)], int(rng.integers(2))))
    big = 1 << 60
    want = links_by_hand([(big if i is None else i, e, label) for i, e, label in rows])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    for p in (ego_join.GridParams(), ego_join.GridParams(block=8, least=4, tile=2)):
        got = ego_join.near_vectors(df, p).collect()
        assert sorted((big if r["vec_id"] is None else r["vec_id"], r["n_links"], big if r["component_id"] is None else r["component_id"], r["kept"]) for r in got) == want


def test_grid_join_skips_tiles(spark):
    """Well separated groups: far fewer pairs of tiles than there are."""
    rng = np.random.default_rng(12)
    rows = [(k, [float(x) for x in np.eye(16)[k % 8] + rng.normal(size=16) * 0.02], 1) for k in range(640)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    p = ego_join.GridParams(block=16, least=8, tile=1)
    seen, near = [], ego_join.near_tiles

    def counted(blocks, params):
        out = near(blocks, params)
        seen.append((out.count(), blocks.select("tile").distinct().count()))
        return out

    ego_join.near_tiles = counted
    try:
        got = ego_join.near_vectors(df, p).collect()
    finally:
        ego_join.near_tiles = near
    assert {r["n_links"] for r in got} == {79}
    [(pairs, tiles)] = seen
    assert pairs < 0.35 * tiles * (tiles + 1) / 2


def test_grid_join_of_nothing(spark):
    assert ego_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---- pipeline


def test_pipeline_stages(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stage(spark, now, small)
        if name != "packing":
            assert now.columns == docs.columns
            now = spark.createDataFrame(now.collect(), docs.schema)
        if name == "near dedup":
            want = near_by_hand([(r["doc_id"], r["text"]) for r in before.collect()], 80)
            assert {r["doc_id"] for r in now.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert now.select("doc_id").distinct().count() == before.count()
    assert corpus_pipeline.run(spark, small).count() == now.count()
