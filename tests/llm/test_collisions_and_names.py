"""Words that collide in sums of powers, and pipeline stages over odd rows and columns of any name."""

import random
import re

import public_tokenizers
import pytest

import corpus_pipeline
from weftlens.llm import gru_lm, minhash_stars, packing, pii_crf, quality_repeats

BITS = [bin(i).count("1") & 1 for i in range(1024)]
ONE, TWO = "".join("ab"[b] for b in BITS), "".join("ba"[b] for b in BITS)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)


def test_lines_of_colliding_words_differ(spark):
    got = {r["doc_id"]: r for r in quality_repeats.quality(frame(spark, [f"{ONE}\n{TWO}", f"{ONE}\n{ONE}", " ".join([ONE, TWO] * 4), " ".join([ONE] * 9)])).collect()}
    assert [got[k]["n_dup_lines"] for k in range(4)] == [0, 1, 0, 0]
    assert got[3]["n_repeat_words"] == 9 and got[2]["n_repeat_words"] == 0


def test_colliding_words_have_their_own_ids(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.pack(frame(spark, [ONE, TWO, f"{TWO} {ONE}"])).collect()}
    for k, text in enumerate([ONE, TWO, f"{TWO} {ONE}"]):
        assert got[k] == zlib.crc32(np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes())


@pytest.mark.parametrize("kept", [packing.CACHE_PIECES, 40])
def test_pieces_are_the_tokenizers(monkeypatch, kept):
    """Quotes and their endings, digits, Latin letters in both cases, other scripts, special strings, with and without forgetting."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from weftlens.llm.common import utf8

    monkeypatch.setattr(packing, "CACHE_PIECES", kept)
    path = public_tokenizers.path("word_bpe_49k.json")
    t, ours = Tokenizer.from_file(path), packing.WordIds(path)
    letters = [*"abcstremvdl''''  \n\t\x0b019AZ_-.<|>", *map(chr, range(0x80, 0x190)), *"\u4e2d\u0301\u200b\x00\x1f\x7f\u03a3\u2028"]
    strings = ["'s", "'re", "'LL", "'Ve", "'r", "<|endoftext|>", "<", "|", "it's"]
    rng = random.Random(5)
    for _ in range(60):
        some = rng.sample(letters, 9) + rng.sample(strings, 3)
        rows = ["".join(rng.choices(some if rng.random() < 0.7 else letters + strings, k=rng.choice([0, 1, 4, 50]))) for _ in range(30)]
        rows[rng.randrange(30)] = None
        ids, bounds = ours.tokens(*utf8(pa.array(rows, pa.string())))
        for k, e in enumerate(t.encode_batch([r or "" for r in rows], add_special_tokens=False)):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == [*e.ids, 0], rows[k]


def test_other_vocabularies_are_refused_by_packing():
    with pytest.raises(ValueError):
        packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


def test_colliding_words_are_counted_apart():
    import pyarrow as pa

    ids, _ = gru_lm.hashes(pa.array([ONE, TWO]))
    assert len(set(ids.tolist())) == 3  # two words and the end


def test_colliding_shingles_link_nothing(spark):
    got = minhash_stars.near_duplicates(frame(spark, [ONE, TWO, ONE, "a " + ONE, "a " + TWO])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}


@pytest.mark.parametrize("elements", [1 << 20, 700])
def test_lone_elements_by_range_equal_a_count(spark, elements):
    rng = random.Random(elements)
    rows = [((p, 1), far, (p, i), [rng.randrange(90) for _ in range(rng.randint(0, 25))]) for p in (1, 2) for far in (False, True) for i in range(60)]
    rows = [(p, f, x, sorted(set(e))) for p, f, x, e in rows]
    df = spark.createDataFrame([(*r, sum(len(s[3]) for s in rows if s[:2] == r[:2])) for r in rows], f"p {minhash_stars.NODE}, far boolean, x {minhash_stars.NODE}, load array<long>, e long")
    found = minhash_stars.alone_elements(df, minhash_stars.MinHashParams(elements=elements)).groupBy("p", "far", "x").sum("u").collect()
    got = {(r["p"], r["far"], r["x"]): r[3] for r in found}
    for p, far, x, load in rows:
        others = {e for q, f, z, s in rows if (q, f) == (p, far) and z != x for e in s}
        assert got.get((p, far, x), 0) == len(set(load) - others)


NAMES = ["n_lines", "n_removed", "_t1", "_doc_id", "a.b", "kept", "t1", "_rest", "_row", "n_chars", "_m"]


def odd_documents(spark, parts=3):
    rng = random.Random(9)

    def words(n):
        return " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 999)}" for _ in range(n))

    base, block = words(80), "\n".join(words(9) for _ in range(4))
    near = base.split()
    near[3] = "zz"
    rows = [(1, base), (2, " ".join(near)), (3, base), (3, base), (4, None), (4, ""), (None, words(40)), (None, base), (5, f"{words(30)}\n{block}"), (6, f"{words(30)}\n{block}\n{words(5)}"), (7, "mail ann.lee@example.com and 10.0.0.1 " + words(30)), (8, words(3)), (8, words(60)), (9, words(4000))]
    full = [(i, t, *[f"{n}{k}" for n in NAMES[:9]], len(t or ""), k) for k, (i, t) in enumerate(rows)]
    kinds = ", ".join([*(f"`{n}` string" for n in NAMES[:9]), "n_chars long", "_m int"])
    return spark.createDataFrame(full, f"doc_id long, text string, {kinds}").repartition(parts), rows


def rest(rows):
    return sorted((r["_m"], *[r[n] for n in NAMES[:9]]) for r in rows)


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES[:4]])
def test_stages_with_any_columns(spark, small, stage):
    fn = dict(corpus_pipeline.STAGES)[stage]
    docs, rows = odd_documents(spark)
    out = fn(spark, docs, small)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    got = out.collect()
    assert all(r["_m"] in range(len(rows)) and r["a.b"] == f"a.b{r['_m']}" and r["_t1"] == f"_t1{r['_m']}" for r in got)
    text = {r["_m"]: r["text"] for r in got}
    if stage == "quality rules":
        expected = {k for k, (_, t) in enumerate(rows) if t and len(t.split()) >= 20}
        assert set(text) == expected and len(got) == len(expected)
    elif stage == "line dedup":
        assert len(got) == len(rows) and text[8] == rows[8][1] and len(text[9].split("\n")) == 2 and text[4] is None
        assert all(text[k] == t for k, (_, t) in enumerate(rows) if k != 9)
        assert next(r["n_chars"] for r in got if r["_m"] == 9) == len(text[9])
    elif stage == "near dedup":
        # of 1, 2, 3, 3 only document 1 stays; rows without an id or words stay
        assert set(text) == {0, 4, 5, *range(6, len(rows))} and len(got) == len(text)
    else:
        assert len(got) == len(rows) and all((a is None) == (rows[k][1] is None) for k, a in text.items())
        assert not re.search(r"ann\.lee@|10\.0\.0\.1", text[10])
    empty = fn(spark, docs.where("false"), small)
    assert empty.columns == docs.columns and empty.collect() == []


def test_packing_of_repeated_rows_without_an_id(spark, small):
    docs = spark.createDataFrame([(None, "a b c", 1)] * 5 + [(1, None, 2), (1, None, 2), (2, "x", 3)], "doc_id long, text string, `a.b` int")
    placed = corpus_pipeline.packing(spark, docs, small).collect()
    assert len(placed) == 8 and sorted(r["length"] for r in placed) == [1, 1, 2, 4, 4, 4, 4, 4]
    by = {}
    for r in sorted(placed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert len(by) == 1


def test_near_dedup_brute_force(spark, small):
    """Kept rows equal those by shingle sets over all pairs."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    word, sets = re.compile(r"[^\x20\x09-\x0D]+"), {}
    for r in docs.collect():
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, small).collect()} == {i for i in ids if find(i) == i}


def test_messages_that_still_move_are_reported(spark, small):
    import dataclasses

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    field = pii_crf.train(docs)
    got = {r["doc_id"]: r for r in pii_crf.spans_of(docs, field).collect()}
    assert all(r["settled"] for r in got.values())
    short = pii_crf.spans_of(docs, dataclasses.replace(field, rounds=1)).collect()
    assert not all(r["settled"] for r in short)
    assert {r["doc_id"]: r["base_sha256"] for r in short} == {k: r["base_sha256"] for k, r in got.items()}
