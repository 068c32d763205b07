"""Fill-in-middle, vector codes and exact dedup against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm import exact_dedup, fill_middle, vector_codes

DOCS = "doc_id long, text string"
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
CLASH = ("id", "t", "h", "salt", "ids", "n", "form", "output", "block", "row", "place", "deal", "sha", "name", "level", "size", "x", "codes", "error", "keep_id", "kept", "text_sha256", "_text_sha256")


def clashing(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="module")
def corpus():
    """Texts of one to four bytes a code point, of many blocks, with sentinels, copies in other case, nulls and repeated rows."""
    r = random.Random(11)
    letters = "abcXYZ é߀世界🙂\n"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(1, 400))) for _ in range(60)]
    long = "".join(r.choice(letters) for _ in range(20_000))
    texts += [None, "", "A", "a", "É", "é", "hold <P> here", "<S>", "<M", "<P", long, long, long.upper(), long.lower(), long[:-1], long + "x", "z" * 5000, "Z" * 5000, "z" * 4096, "z" * 4097, "🙂" * 3000]
    texts += texts[:20] + [texts[0]] * 40
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return rows + [(None, "a"), (None, None), (None, "alone"), (3, texts[3]), (3, texts[3]), (3, "another text under id 3")]


# --- op11


def test_boundaries_select_every_value():
    r = np.random.default_rng(3)
    for most in (1, 2, 7, 300, 5000, 10**7):
        for count in (1, 2, 255, 256, 257, 700):
            values = np.sort(r.integers(0, most + 1, count))
            for cut in (count, 1, 7):
                held = fill_middle.Boundaries([values[k : k + cut] for k in range(0, count, cut)], count, most)
                assert [held[i] for i in range(count)] == values.tolist()
    text = ("a" * 1000 + "🙂" * 1000).encode()
    held = fill_middle.boundaries(text)
    assert held[1000] == 1000 and held[1500] == 3000 and held[2000] == 5000 and held.nbytes() < len(text) / 2


def test_boundaries_are_made_in_pieces(monkeypatch):
    text = "".join(random.Random(1).choice("aé世🙂") for _ in range(3000)).encode()
    whole = fill_middle.boundaries(text)
    monkeypatch.setattr(fill_middle, "PIECE", 37)
    held = fill_middle.boundaries(text)
    assert [held[i] for i in range(3001)] == [whole[i] for i in range(3001)] and (held.upper == whole.upper).all() and (held.directory == whole.directory).all()
    assert len(fill_middle.boundaries(b"")) == 1 and fill_middle.boundaries(b"")[0] == 0


def test_fill_middle_equals_brute_force(spark, corpus):
    docs = clashing(spark.createDataFrame(corpus, DOCS).repartition(7))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in fill_middle.digest(docs).collect()), key=repr)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(k, n, form, p, m, sha(out), sha(t or "")) for k, t in corpus for n, form, p, m, out in [fill_middle.brute(k, t)]]
    assert got == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_middle_real_texts_and_hot_groups(spark, monkeypatch):
    """A text in most rows is dealt over several groups; every row of it still comes out, cut by its own seed."""
    monkeypatch.setattr(fill_middle, "LEAST_HOT", 8)
    rows = [(k, "the text of most rows") for k in range(300)] + [(1000 + k, f"text {k}") for k in range(50)]
    docs = spark.createDataFrame(rows, DOCS).repartition(20)
    hashes, spread = fill_middle._hot(docs, "text")
    assert len(hashes) == 1 and spread[0] == 38
    out = fill_middle.transform(docs, seed=7)
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()}
    assert got == {k: fill_middle.brute(k, t, 7) for k, t in rows}
    back = out.select(fill_middle.restored(F.col("output"), F.col("form")).alias("t")).distinct().count()
    assert back == 51 and len({r[2] for r in got.values() if r[1] == "psm"}) > 5


def test_fill_middle_empty_table(spark):
    assert fill_middle.digest(spark.createDataFrame([], DOCS)).count() == 0


# --- op12


def _vectors(n=300, width=16):
    r = np.random.default_rng(5)
    centres = r.normal(0, 0.3, (9, width))
    x = (centres[r.integers(0, 9, n)] + r.normal(0, 0.05, (n, width))).astype(np.float32)
    rows = [(int(k), x[k].tolist(), int(k) % 5 if k % 7 else None) for k in range(n)]
    return rows + [(5, x[5].tolist(), 1), (5, x[6].tolist(), 2), (None, x[7].tolist(), 1), (900, None, 1), (901, [None, *x[0].tolist()[1:]], 1), (902, [float("nan")] * width, 1), (903, [float("inf"), *x[0].tolist()[1:]], None), (904, [], 1), (905, x[0].tolist()[:8], 1), (906, [0.0] * width, 3), (907, [-0.0] * width, 3)]


def test_vector_codes_equal_brute_force(spark):
    rows = _vectors()
    got = vector_codes.digest(clashing(spark.createDataFrame(rows, VECTORS).repartition(6))).collect()
    want, sha = vector_codes.brute(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == want and {r.codebooks_sha256 for r in got} == {sha}


def test_vector_codes_few_ties_and_none(spark):
    """Fewer vectors than entries; equal vectors, of which the first entry is taken and the others stay unused; none at all."""
    few = [(3, [0.25] * 8, None), (1, [0.25] * 8, None), (2, [-1.0] * 8, 4)]
    got = vector_codes.digest(spark.createDataFrame(few, VECTORS)).collect()
    want, sha = vector_codes.brute(few)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == want and got[0].codebooks_sha256 == sha
    assert {r.vec_id: r.code for r in got} == {1: "00" * 8, 3: "00" * 8, 2: "01" * 8}
    for rows in ([], [(1, None, 1)], [(1, [1.0] * 9, 1)]):
        out = vector_codes.digest(spark.createDataFrame(rows, VECTORS))
        assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(Exception, match="beyond exact codes"):
        vector_codes.fit(spark.createDataFrame([(1, [40000.0] * 8, 1)], VECTORS))


def test_vector_codes_decode(spark):
    rows = [r for r in _vectors() if r[1] and len(r[1]) == 16 and all(c is not None and np.isfinite(c) for c in r[1])]
    vectors = spark.createDataFrame(rows, VECTORS)
    book = vector_codes.fit(vectors, parts=4, entries=8, rounds=3)
    assert book.shape == (4, 8, 4)
    out = vector_codes.decode(vector_codes.encode(vectors, book), book)
    for r in out.limit(20).collect():
        assert r.decoded == [int(c) / 4096 for p, e in enumerate(r.codes) for c in book[p][e]]


def test_distances_are_exact_at_the_bound():
    top = vector_codes.MOST - 1
    x, book = np.full((1, 1, 8), top, np.int64), np.full((1, 2, 8), -top, np.int64)
    book[0, 1, 0] += 1
    at, error = vector_codes.assign(x, book)
    assert at[0, 0] == 1 and int(error[0, 0]) == 7 * (2 * top) ** 2 + (2 * top - 1) ** 2


# --- op13


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_exact_groups_equal_brute_force(spark, corpus, block):
    rows = corpus if block > 1 else [(k, t[:40] if t else t) for k, t in corpus]
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(9))
    got = exact_dedup.groups(docs, block=block).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == exact_dedup.brute(rows)
    kept = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in kept}) == len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_keeps_columns(spark, corpus):
    docs = clashing(spark.createDataFrame(corpus, DOCS))
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(((r.doc_id, (r.text or "").lower() if (r.text or "").isascii() else None) for r in rows), key=repr) == sorted(((k, (t or "").lower() if (t or "").isascii() else None) for k, t in {(k2, s): (k2, t2) for k2, t2 in corpus for s in [hashlib.sha256((t2 or "").encode().translate(bytes(exact_dedup._LOWER))).hexdigest()] if any(b[0] == k2 == b[1] and b[3] == s for b in exact_dedup.brute(corpus))}.values()), key=repr)
    assert all(r[c] == f"own {c}" for r in rows for c in CLASH)


def test_exact_dedup_empty_table_and_one_large_group(spark):
    assert exact_dedup.groups(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(k, "same text " * 900) for k in range(400)] + [(1000, "other")]
    got = {r.doc_id: r for r in exact_dedup.groups(spark.createDataFrame(rows, DOCS).repartition(8)).collect()}
    assert all(got[k].keep_id == 399 and got[k].group_size == 400 and got[k].kept == (k == 399) for k in range(400)) and got[1000].kept
