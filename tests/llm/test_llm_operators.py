"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, hnsw, langid, line_dedup, ngram_join, pieces, shingles, suffix_dedup, token_shards, toxicity, url_filter

DOCS = "doc_id long, text string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def words(r, n, vocabulary=40):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def near(r, text, p=0.05):
    return " ".join(f"x{r.randrange(99)}" if r.random() < p else w for w in text.split())


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    base = [words(r, r.randrange(30, 200), 500) for _ in range(12)]
    texts = [*base, *(near(r, t) for t in base for _ in range(4)), *base[:3], None, "", "   ", "one", "one two three", "one two three", "Éé ß", base[0] * 60, "a" * 3000, "ab" * 900]
    texts += ["\n".join([words(r, 12), base[1], words(r, 12)]) for _ in range(5)]
    return list(enumerate(texts))


def clashing(df):
    """Columns that the operators use inside."""
    return df.withColumns({"id": F.lit("x"), "n": F.lit(1), "class": F.lit("y"), "kid": F.lit(0), "t": F.lit("t"), "spans": F.lit(2)})


# --- op1


def test_decontaminate_equals_brute_force(spark, corpus):
    r = random.Random(1)
    items = [(k, t) for k, t in enumerate([" ".join(corpus[0][1].split()[5:30]), "One, TWO three!", "one", "", None, "zzz " * 11, words(r, 9), " ".join(corpus[3][1].split()[:10])])]
    items += [(0, "again, under one id"), (None, "without an id here")]
    docs = [*corpus, (900, "say ONE two;three again"), (901, "again under one id"), (902, "without an id here yes"), (903, "zzz " * 40)]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate.digest(clashing(spark.createDataFrame(docs, DOCS)), b).collect()}
    named = [("null" if k is None else str(k), t) for k, t in items]
    for k, t in docs:
        n, hit, found = decontaminate.brute(t, named)
        assert (got[k].n_words, got[k].n_hit, got[k].n_items, got[k].items_sha256, got[k].contaminated) == (n, hit, len(found), decontaminate.sha(found), hit > 0), (k, t)


def test_automaton_equals_brute_force_on_small_alphabets():
    r = random.Random(2)
    for _ in range(200):
        items = [(str(k), " ".join(r.choice("ab") for _ in range(r.randrange(0, 9)))) for k in range(4)]
        text = " ".join(r.choice("abc") for _ in range(25))
        spans, found = decontaminate.Automaton([(k, decontaminate.words(t.encode())) for k, t in items], 4).stream(decontaminate.words(text.encode()))
        n, hit, names = decontaminate.brute(text, items, 4)
        assert sum(b - a for a, b, _ in spans) == hit and sorted(found) == names


def test_blocks_of_items_find_the_same(spark, corpus):
    items = spark.createDataFrame([(k, " ".join(corpus[k][1].split()[2:20])) for k in range(8)], "item_id long, text string")
    docs = spark.createDataFrame(corpus, DOCS)
    whole, parts = decontaminate.automata(items, 10), decontaminate.automata(items, 10, block_chars=200)
    assert len(whole) == 1 and len(parts) > 2
    for row in docs.collect():
        t = row.text.encode() if row.text is not None else None
        assert decontaminate.hits(t, [x.value for x in whole])[1:] == decontaminate.hits(t, [x.value for x in parts])[1:]


def test_a_benchmark_of_any_size_in_rounds(spark, corpus, tmp_path):
    """Blocks of 80 characters, two at a time: the same hits, items and texts as in one pass, for every row."""
    items = [(k, " ".join(corpus[k][1].split()[2:20])) for k in range(8)] + [(90, "one two"), (91, None)]
    b = spark.createDataFrame(items, "item_id long, text string")
    docs = clashing(spark.createDataFrame([*corpus, (None, "one two"), (7, corpus[7][1])], DOCS)).withColumn("items", F.lit("own"))
    assert decontaminate.block_count(b, "text", 80) > 4
    whole = sorted(repr(r) for r in decontaminate.match(docs, b).collect())
    rounds = decontaminate._match_in_rounds(docs, b, 10, "doc_id", "text", "item_id", most_blocks=2, block_chars=80)
    assert sorted(repr(r) for r in rounds.collect()) == whole
    left = decontaminate._remove_in_rounds(docs, b, 10, 10, 0.5, "text", "item_id", most_blocks=2, block_chars=80)
    assert left.columns == docs.columns and sorted(map(repr, left.collect())) == sorted(map(repr, decontaminate.remove(docs, b).collect()))


def test_removal_keeps_clean_rows_and_cuts_spans(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long = "before it there are many other words that nobody tests, then " + item.upper() + "; and after it quite a few more words stand here"
    rows = [(1, "clean, and as it is!  ", 5), (2, long, 6), (3, item, 7), (4, None, 8), (5, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in decontaminate.remove(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(out) == {1, 2, 4, 5} and out[1].text == rows[0][1] and out[4].text is None
    assert "ALPHA" not in out[2].text and out[2].text.startswith("before it") and out[2].text.endswith("stand here")
    assert decontaminate.remove(docs, spark.createDataFrame([], "item_id long, text string")).count() == 5


@pytest.mark.parametrize("least,cut", [(5, {1, 2, 3}), (10, {1, 2, 3}), (11, {2, 3}), (20, {3})])
def test_removal_heeds_its_length_limit(spark, least, cut):
    """Spans of 10 and 15 words, and a whole item of three words, which goes at any limit."""
    w = [f"q{i}" for i in range(15)]
    around = " ".join(f"z{i}" for i in range(40))
    rows = [(1, f"{around} {' '.join(w[:10])} {around}"), (2, f"{around} {' '.join(w)} {around}"), (3, f"{around} one two three {around}")]
    items = spark.createDataFrame([(1, " ".join(w)), (2, "one two three")], "item_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate.remove(spark.createDataFrame(rows, DOCS), items, min_span=least).collect()}
    assert {k for k, t in rows if out[k] != t} == cut and "two" not in out[3]


# --- op2


def test_rareness_in_two_levels_is_the_same(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(corpus, DOCS).select("text").repartition(7)
    whole = ngram_join.rareness(docs, 4, 1 << 14)
    monkeypatch.setattr(ngram_join, "SUMMED_TOGETHER", 2)
    assert (ngram_join.rareness(docs, 4, 1 << 14) == whole).all() and whole.max() > 8


def test_lists_hold_a_class_once(spark, corpus, tmp_path):
    """However many tasks have a class, it stands once in each of its lists."""
    docs = spark.createDataFrame([(k, t) for k, t in corpus] * 4, DOCS).repartition(9)
    lists = ngram_join._prepared(docs, 4, 85, "doc_id", "text", str(tmp_path))[3]
    assert lists.count() == lists.select("token", "class").distinct().count() > 50


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 50)])
def test_ngram_components_equal_brute_force(spark, corpus, n, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.cluster(clashing(spark.createDataFrame(corpus, DOCS)), n, percent).collect()}
    assert got == ngram_join.brute(corpus, n, percent)


def test_ngram_chain_links_through(spark):
    """A is near B and B near C, but A not near C: one component."""
    base = [f"w{i}" for i in range(100)]
    rows = [(3, " ".join(base)), (2, " ".join(base[4:])), (1, " ".join(base[9:])), (7, "other words in here now")]
    got = {r.doc_id: r.component_id for r in ngram_join.cluster(spark.createDataFrame(rows, DOCS), 4, 94).collect()}
    assert got == {3: 1, 2: 1, 1: 1, 7: 7}


def test_ngram_repeats_and_empty(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (2, "A b C d e"), (9, None)]
    got = sorted((r.doc_id, r.component_id, r.n_shingles) for r in ngram_join.digest(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(2, 2, 2), (5, 2, 2), (5, 2, 2), (9, 9, 0)]
    assert ngram_join.digest(spark.createDataFrame([], DOCS)).count() == 0


def test_ngram_null_ids_clashing_names_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(None, "a b c d e"), (4, "a b c d e"), (None, "x y z u v"), (7, long), (6, long + " end"), (8, "w1 w2 w3 w4")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("own") for c in ("class", "size", "key", "prefix", "part", "component_id", "n_shingles", "least")})
    got = sorted(((r.doc_id or 0, r.component_id, r.n_shingles) for r in ngram_join.digest(docs).collect()), key=str)
    assert got == [(0, 4, 2), (0, None, 2), (4, 4, 2), (6, 6, 149_998), (7, 6, 149_997), (8, 8, 1)]


def test_ngram_links_are_all_of_them(spark, corpus):
    links, members = ngram_join.links(clashing(spark.createDataFrame(corpus, DOCS)), 4, 60)
    class_of = {r.doc_id: r["class"] for r in members.collect()}
    got = {tuple(sorted((r.a, r.b))) for r in links.collect()}
    sets = {k: {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} for k, t in corpus if (w := (t or "").lower().split())}
    want = {tuple(sorted((class_of[i], class_of[j]))) for i in sets for j in sets if i < j and sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])}
    assert got == want and len(want) > 20 and all(class_of[k] is None for k, _ in corpus if k not in sets)


def test_shingles_equal_plain_sets(monkeypatch):
    r = random.Random(1)
    texts = [None, "", "  ", "one", "One two", "a b c d", "a b c d e a b c d", "É é É é"] + ["".join(r.choice("aBb \n\x0bé\u00a0") for _ in range(r.randrange(60))) for _ in range(300)] + ["x" * 3000 + " y " + "z" * 70 + " w" * 2000 + " q", "y" * 6000]
    for piece in (shingles.PIECE, 64):
        monkeypatch.setattr(shingles, "PIECE", piece)
        values, at = shingles.Shingler(4)(pa.array(texts))
        sets = []
        for t in texts:
            w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
        own = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        assert [len(x) for x in own] == [len(x) for x in sets]
        for _ in range(3000):
            i, j = r.randrange(len(texts)), r.randrange(len(texts))
            assert len(np.intersect1d(own[i], own[j])) == len(sets[i] & sets[j])


# --- op3


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation_is_a_bijection(n):
    p = token_shards.Permutation(n, b"k")
    x = np.arange(n)
    slots = p.slots(x)
    assert sorted(slots.tolist()) == list(range(n)) and (p.numbers(slots) == x).all()
    if n > 60:
        assert (token_shards.Permutation(n, b"other").slots(x) != slots).any()


def test_shards_round_trip(spark, corpus, tmp_path):
    docs = [*corpus, corpus[0], (None, "no id here")]
    out = token_shards.materialise(clashing(spark.createDataFrame(docs, DOCS)), MODEL, length=16, shard_slots=8)
    path = str(tmp_path / "shards")
    token_shards.write_shards(out, path)
    rows = out.orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows))) and {len(r.record) for r in rows} == {32} and all(r.shard == r.slot // 8 for r in rows)
    whole = list(token_shards.read_shards(spark, path))
    assert whole == [bytes(r.record) for r in rows]
    sizes = {f.stat().st_size % 33 for f in (tmp_path / "shards" / "records").glob("part-*")}
    assert sizes == {0} and sum(f.stat().st_size for f in (tmp_path / "shards" / "records").glob("part-*")) == 33 * len(rows)
    for slot, most in ((0, 1), (5, 3), (8, 20), (len(rows) - 1, 9), (len(rows), 4)):
        assert list(token_shards.read_shards(spark, path, slot, most)) == whole[slot : slot + most]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {}
    for r in sorted(rows, key=lambda r: r.number):
        texts.setdefault(r.doc_id, []).extend(np.frombuffer(r.record[: 2 * r.n_tokens], "<u2").tolist())
    for k, t in [*corpus[1:], docs[-1]]:
        assert texts.get(k, []) == ([*library.encode(t), 2] if t else []), k
    assert texts[0] == [*library.encode(corpus[0][1]), 2] * 2
    assert token_shards.materialise(spark.createDataFrame([], DOCS), MODEL).count() == 0
    again = token_shards.materialise(spark.createDataFrame(docs[::-1], DOCS).repartition(7), MODEL, length=16, shard_slots=8)
    assert [(r.slot, r.doc_id, bytes(r.record)) for r in again.orderBy("slot").collect()] == [(r.slot, r.doc_id, bytes(r.record)) for r in rows]


# --- op4


def test_hnsw_recall_ties_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.2, 3, (1500, 1))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    rows += [(5000 + i, rows[40][1]) for i in range(60)]  # copies
    bad = [(7000, None), (7020, []), (7040, [0.0] * 16), (7060, [float("nan")] * 16), (7080, [None] + [1.0] * 15), (7100, [float("inf")] * 16)]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2))
    got = {}
    for r in hnsw.search(df, F.col("vec_id") % 20 == 0, 20, shard_rows=400).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    hit = 0
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        s = m @ m[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]].tolist()
        listed = [found[k] for k in range(1, 21)]
        hit += len({v for v, _ in listed} & set(best))
        assert all(abs(score - s[ids == v][0]) < 1e-9 for v, score in listed) and listed == sorted(listed, key=lambda t: (-t[1], t[0]))
    assert hit / (20 * len(got)) >= 0.95
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")
    assert few.count() - 1 == hnsw.digest(few).count() and hnsw.digest(few.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["gaussian", "clustered"])
def test_hnsw_recall_over_full_shards(spark, kind):
    """Three shards of about 2,000 vectors in 64 dimensions, without and with structure."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 64))
    if kind == "clustered":
        x = rng.normal(size=(80, 64))[rng.integers(0, 80, 6000)] + 0.3 * x
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in hnsw.search(df, F.col("vec_id") % 20 == 0, 20, shard_rows=2500).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    scores = x[::20].astype(float) @ x.T.astype(float)
    scores[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(found[20 * k] & set(row.tolist())) / 20 for k, row in enumerate(best)]) >= (0.97 if kind == "gaussian" else 0.99)


def test_hnsw_gives_as_many_as_asked(spark):
    """More neighbours than the search is wide by default."""
    r = np.random.default_rng(3)
    rows = [(k, r.normal(size=8).astype(np.float32).tolist()) for k in range(600)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert hnsw.search(v, F.col("vec_id") == 0, 300).count() == 300


# --- op5


def test_langid_learns_and_rejects(spark):
    r = random.Random(6)
    syllables = {"aa": ["ka", "ki", "ku"], "bb": ["sto", "ster", "né"], "cc": ["müh", "ghe", "lo"]}
    rows = [(i, " ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(r.randrange(3, 60))), lang) for i in range(200) for lang in [["aa", "bb", "cc"][i % 3]]]
    rows += [(500, None, "aa"), (501, "", "aa"), (502, "12 34 !!", "bb"), (503, "kakiku", None), (504, "x", "aa"), (505, rows[1][1] * 400, "bb"), (None, "kakuka kikaku", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.digest(clashing(df)).collect()}
    assert {k: got[k].lang_pred for k in (500, 501, 502, 503)} == {500: "und", 501: "und", 502: "und", 503: "aa"} and got[505].lang_pred == "bb"
    held = [(got[i].lang_pred, lang) for i, _, lang in rows[:200] if got[i].held_out]
    assert len(held) > 20 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {r.lang_pred for r in langid.digest(df.where("doc_id = 503")).collect()} == {"und"}
    assert langid.digest(df.limit(0)).count() == 0


def test_langid_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Some words, and ÉÈ more 漢字 😀 " * 30
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert all((x == y).all() for x, y in zip(langid.counts(text), whole, strict=True))


def test_langid_equals_bind_bundle_and_cosine(spark):
    """Each trigram bound one by one, each text and language bundled by plain sums; letters of all scripts differ, ties go to the first."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("abc abd", "l"), ("νερό και φως", "g"), ("漢字 仮名", "c"), ("ßéß ж", "m"), ("ABC abd", "l"), ("abc abd", "a"), ("ab cd", None), ("ж", None), ("λ", None)])]

    def bound(text):
        letters = [0] + [ord(c.lower()[0]) if c.isalpha() else 0 for c in text] + [0]
        letters = [c for k, c in enumerate(letters) if c or not k or letters[k - 1]]
        total = np.zeros(langid.DIMENSIONS, int)
        for x, y, z in zip(letters, letters[1:], letters[2:], strict=False):
            if y:
                total += np.roll(langid.letter_vector(x).astype(int), 2) * np.roll(langid.letter_vector(y).astype(int), 1) * langid.letter_vector(z)
        return total

    profiles = {lang: sum(bound(t) for _, t, x in rows if x == lang) for lang in "acglm"}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model[0] == list("acglm")
    for r in langid.predict(df.withColumn("SCORE", F.lit("old")), model).collect():
        own = bound(r.text)
        cosine = {k: own @ p / np.linalg.norm(own) / np.linalg.norm(p) for k, p in profiles.items()}
        best = min(cosine, key=lambda k: (-round(cosine[k], 5), k))
        assert r.lang_pred == best and r.score == pytest.approx(max(0, cosine[best]), abs=1e-4)
    assert len({langid.letter_vector(ord(c)).tobytes() for c in "éßжλ漢e"}) == 6


# --- op6


def test_toxicity_finds_insults_also_bent(spark):
    r = random.Random(8)
    plain = [f"{a}{b}{c}" for a in ("ba", "to", "li", "mer", "son") for b in ("na", "ri", "len", "do") for c in ("t", "ka", "sel")]
    bad = ["zwirkel", "gomfratz", "plunkert"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = [r.choice(plain) for _ in range(r.randrange(10, 60))]
        if toxic:
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(900, "banat g-o-m-f-r-a-t-z toril"), (901, "banat gomxfratz tonaka"), (902, "z w i r k e l banat"), (903, None), (904, ""), (905, "banat tonaka " * 20000)]
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, labels[0], (None, 1), (77777, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.digest(clashing(docs), known).collect()}
    held = [(got[i].predicted, t) for i, t in labels if got[i].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert [got[k].predicted for k in (900, 901, 902, 903, 904, 905)] == [1, 1, 1, 0, 0, 0] and all(0 <= x.score <= 1 for x in got.values())
    assert {r.predicted for r in toxicity.digest(docs.limit(5), known.limit(0)).collect()} == {0}


def _kernel_brute(x, y):
    """The sum over common subsequences of three symbols, each pair of occurrences weighted by what it skips, over the norms."""

    def embed(w):
        c, out = ["$", *w, "$"], {}
        for i, j, k in itertools.combinations(range(len(c)), 3):
            if k - i <= toxicity.SPAN:
                sub = (c[i], c[j], c[k])
                out[sub] = out.get(sub, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    a, b = embed(x), embed(y)
    dot = lambda p, q: sum(v * q.get(s, 0) for s, v in p.items())
    return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5


def test_kernel_equals_brute_force():
    r = random.Random(4)
    some = ["idiot", "idxiot", "a", "ab", "abcabc", *("".join(r.choice("abcd") for _ in range(r.randrange(1, 9))) for _ in range(20))]
    word, sub, weight = toxicity.features(some)
    dense = np.zeros((32**3, len(some)))
    dense[sub, word] = weight
    got = toxicity.kernel(some, dense)
    assert got == pytest.approx(np.array([[_kernel_brute(x, y) for y in some] for x in some]), abs=1e-9)


def test_folded_weights_equal_the_machine_in_nystroem_space():
    """Scoring by one weight a subsequence is kernel against landmarks, whitened, times the machine's weights."""
    marks, words_ = ["idiot", "lovely", "house", "stupid"], ["idxiot", "houses", "stupidly", "sun"]
    word, sub, weight = toxicity.features(marks)
    dense = np.zeros((32**3, len(marks)))
    dense[sub, word] = weight
    gram = np.array([[_kernel_brute(x, y) for y in marks] for x in marks])
    values, vectors = np.linalg.eigh(gram)
    root = vectors / np.sqrt(values)
    w = toxicity.machine(gram @ root, np.array([1.0, -1, -1, 1]), np.ones(4), 4.0)
    plain = np.array([[_kernel_brute(x, y) for y in marks] for x in words_]) @ root @ w[:-1] + w[-1]
    assert toxicity.judged(words_, dense @ (root @ w[:-1]), float(w[-1])) == pytest.approx(plain, abs=1e-9)


def test_toxicity_learns_behind_the_first_letters_and_bounds_its_sample(spark, monkeypatch):
    r = random.Random(3)
    clean = [f"{a}{b}{c}" for a in ("ba", "to", "li") for b in ("na", "ri", "len") for c in ("t", "ka", "sel")]
    glued = "www.banat.example.tonaka.lirit.baletsel/zwirkel"
    rows = [(i, " ".join(r.choice(clean) for _ in range(20)) + (f" {glued}" if i % 4 == 0 else f" {glued[:-8]}")) for i in range(400)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert (np.array(model.score([t for _, t in rows])) >= 0.3).tolist() == [i % 4 == 0 for i, _ in rows]
    assert toxicity.train(docs, labels, sample_bytes=0).score(["x"]) == pytest.approx([0], abs=1e-6)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append(texts))
    known = [t for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    for sample, size in ((6000, 10**9), (50, 10**9), (6000, 40_000)):
        toxicity.train(docs, labels, sample, size)
        got = seen.pop()
        assert set(got) <= set(known) and len(got) == (len(known) if (sample, size) == (6000, 10**9) else len(got)) and len(got) <= sample and 0.5 * min(size, 50 * 150) < sum(map(len, got)) <= size
    out = toxicity.score(docs.withColumn("Score", F.lit("old")), model)
    assert out.columns == ["doc_id", "text", "score", "predicted"] and out.where("predicted = 1").count() == 100


def test_toxicity_passes_over_what_does_not_fit(spark):
    """One labelled text as large as all the room, wherever its hash puts it, does not end the sample; repeated rows count once."""
    rows = [(k, f"fine words {k} about the weather" if k % 2 else f"you stupid zorgle {k}") for k in range(40)]
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(200)], "doc_id long, toxic int")
    small = toxicity.train(spark.createDataFrame(rows, DOCS), labels)
    more = rows + rows[:6] + [(100 + k, "x" * 5000) for k in range(20)]
    model = toxicity.train(spark.createDataFrame(more, DOCS), labels, sample_bytes=4999)
    texts = ["zorgle", "weather"]
    assert model.score(texts) == pytest.approx(small.score(texts))


def test_toxicity_learns_insults_not_the_words_around_them_in_copies():
    """Near copies of a toxic text share words that no clean text has; only the insult counts in new texts."""
    r = random.Random(0)
    word = lambda: "".join(r.choices(["an", "er", "th", "in", "on", "re", "nd", "es", "ti", "ou", "st", "le"], k=r.randrange(2, 6)))
    bad = ["loser", "moron", "clown", "trash"]
    rows = [(" ".join(word() for _ in range(60)), 0) for _ in range(300)]
    for g in range(40):
        first = [word() for _ in range(60)]
        for _ in range(6):
            copy = [*first]
            copy[r.randrange(60)] = word()
            rows.append((" ".join([*copy, bad[g % 4]] if g < 16 else copy), int(g < 16)))
    model = toxicity.fit([t for t, _ in rows], [k for _, k in rows])
    new = [" ".join(word() for _ in range(60)) for _ in range(40)]
    assert (model.score(new) < 0.3).mean() >= 0.95 and (model.score([f"{t} {bad[k % 4]}" for k, t in enumerate(new)]) >= 0.3).mean() >= 0.95


def test_toxicity_curve_is_the_best_one_where_both_kinds_score_alike():
    r = np.random.default_rng(1)
    y = (r.random(500) < 0.1).astype(float)
    x = r.normal(5, 0.3, 500) + 0.2 * y
    slope, shift = toxicity._curve(x, y)
    loss = lambda a, b: np.logaddexp(0, a * x + b).sum() - y @ (a * x + b) + 5e-4 * (a * a + b * b)
    assert all(loss(slope, shift) <= loss(slope + da, shift + db) for da in (-0.01, 0, 0.01) for db in (-0.05, 0, 0.05))
    assert (1 / (1 + np.exp(-slope * x - shift))).mean() == pytest.approx(y.mean(), abs=1e-3)


# --- op7


def test_suffix_array_and_prefixes_equal_brute_force():
    r = random.Random(3)
    for _ in range(300):
        t = bytes(r.choice(b"ab\0") for _ in range(r.randrange(1, 60)))
        x = np.frombuffer(t, np.uint8)
        order = suffix_dedup.suffix_array(x)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        cuts = sorted({0, *(r.randrange(len(t)) for _ in range(3))})
        got = suffix_dedup.common_prefixes(x, order, np.array(cuts), np.diff([*cuts, len(t)]), 10)
        want = [next((k for k in range(10) if order[i] + k >= len(t) or order[i - 1] + k >= len(t) or t[order[i] + k] != t[order[i - 1] + k]), 10) for i in range(1, len(t))]
        assert got.tolist() == want


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    r = random.Random(12)
    for text in (bytes(r.choice(b"abc ") for _ in range(5000)), b"ab" * 1500, b"x" * 99, b"y" * 100):
        whole = suffix_dedup.anchors(text)
        for piece in (100, 333, 1024):
            monkeypatch.setattr(suffix_dedup, "PIECE", piece)
            assert all((x == y).all() and len(x) == len(y) for x, y in zip(suffix_dedup.anchors(text), whole, strict=True))
        monkeypatch.undo()


def test_suffixes_within_pieces_are_sorted_to_a_depth():
    r = random.Random(4)
    for _ in range(300):
        letters, depth = r.choice([b"a", b"ab", b"abc\0", bytes(range(256))]), r.choice([1, 3, 9, 20])
        base = bytes(r.choice(letters) for _ in range(60))
        pieces = [base[x : x + r.randrange(1, 40)] for x in (r.randrange(40) for _ in range(6))]
        t, sizes = b"".join(pieces), np.array(list(map(len, pieces)))
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(t))
        x = np.frombuffer(t, np.uint8)
        order = suffix_dedup.suffix_array(x, left, depth)
        assert order.tolist() == sorted((i for i in range(len(t)) if left[i] >= depth), key=lambda i: (t[i : i + depth], i))
        got = suffix_dedup.common_prefixes(x, order, ends - sizes, np.maximum(sizes - depth + 1, 0), depth)
        assert got.tolist() == [next((k for k in range(depth) if t[i + k] != t[j + k]), depth) for i, j in zip(order[1:].tolist(), order[:-1].tolist(), strict=True)]


def test_snippets_hold_each_string_once_for_each_of_its_anchors():
    r = random.Random(6)
    length, grams = suffix_dedup.LENGTH, suffix_dedup.LENGTH - suffix_dedup.GRAM
    for text in (bytes(r.choice(b"abc ") for _ in range(900)), b"ab" * 150, b"x" * 99, b"y" * 100):
        at, h, a, b = (z.tolist() for z in suffix_dedup.anchors(text))
        for s in range(len(text) - length + 1):
            inside = [k for k, q in enumerate(at) if s <= q <= s + grams]
            least = min(h[k] for k in inside)
            assert [k for k in range(len(at)) if a[k] <= s and s + length <= b[k]] == [k for k in inside if h[k] == least]


def _suffix_corpus(corpus):
    r = random.Random(9)
    return [*corpus, (800, "é" * 200), (801, "x" + "é" * 200), (802, corpus[2][1][37:300] + words(r, 20) + corpus[4][1][11:260])]


@pytest.mark.parametrize("snippets", [8192, 4])
def test_suffix_dedup_equals_brute_force(spark, corpus, monkeypatch, snippets):
    """Also with anchors dealt over many shards, whose sorted runs are then merged."""
    monkeypatch.setattr(suffix_dedup, "SHARD_SNIPPETS", snippets)
    rows = _suffix_corpus(corpus)
    r = random.Random(5)
    r.shuffle(shuffled := list(rows))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.digest(clashing(spark.createDataFrame(shuffled, DOCS).repartition(5))).collect()}
    assert got == suffix_dedup.brute(rows)


def test_suffix_dedup_repeats_and_empty(spark, corpus):
    rows = [corpus[0], corpus[0], (None, corpus[0][1]), (3, None)]
    got = sorted(((x.doc_id is not None, x.doc_id or 0, x.n_removed) for x in suffix_dedup.digest(spark.createDataFrame(rows, DOCS)).collect()))
    n = len(corpus[0][1].encode())
    assert got == [(False, 0, 0), (True, 0, n), (True, 0, n), (True, 3, 0)]
    assert suffix_dedup.digest(spark.createDataFrame([], DOCS)).count() == 0


def test_suffix_dedup_repeats_that_come_first(spark, corpus):
    """A repeated row in other partitions and further than a portion of rows away is no copy of itself."""
    first, inner = corpus[0], corpus[1][1] + " " + corpus[2][1]
    rows = [first, (5, inner), (9, first[1]), (12, inner[40:])]
    many = spark.createDataFrame([first, *((100 + k, "short") for k in range(1100)), first], DOCS)
    docs = many.coalesce(1).union(spark.createDataFrame(rows, DOCS).coalesce(1)).union(spark.createDataFrame(rows, DOCS).coalesce(1))
    found = suffix_dedup.digest(docs).where("doc_id < 100").collect()
    assert len(found) == 10
    want = suffix_dedup.brute(rows)
    assert want[first[0]][1] == want[5][1] == 0 < want[12][1] < len(inner) - 40 + 1 and want[9][1] == len(first[1].encode())
    for x in found:
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want[x.doc_id]


# --- op8


def test_pieces_equal_the_library(spark, corpus):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(1)
    alphabet = [*"abeé  ▁\n\t漢😀\x00.,", "<s>", "</s>", "<unk>", "<0x0A>", "the", "   ", "▁▁", "\r\n", "�", "​"]
    rows = [*corpus, *((1000 + k, "".join(r.choice(alphabet) for _ in range(r.randrange(15)))) for k in range(2000)), corpus[0]]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = dict(rows)
    for x in pieces.digest(clashing(spark.createDataFrame(rows, DOCS)), MODEL).collect():
        ids = library.encode(texts[x.doc_id] or "")
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")), texts[x.doc_id]
    for x in pieces.encoded(spark.createDataFrame(rows[:200], DOCS), MODEL).collect():
        assert x.token_ids == library.encode(texts[x.doc_id] or "") and x.n_tokens == len(x.token_ids) and x.round_trip
    assert pieces.digest(spark.createDataFrame([], DOCS), MODEL).count() == 0


def test_the_table_may_be_emptied_at_any_time():
    c = pieces.Codec(MODEL, table_chars=50)
    for t in ("one two three four", "five six  seven", "one two", ""):
        ids = c.library.encode(t)
        (chunks,) = c.split([t])
        assert c.decimal(chunks) == ",".join(map(str, ids)) and c.decoded(chunks) == c.library.decode(ids)


# --- op9


def _glob(pattern, text):
    return re.fullmatch("".join({"*": ".*", "~": "[^/]*"}.get(c) or re.escape(c) for c in pattern), text, re.S) is not None


def test_globs_equal_regular_expressions():
    r = random.Random(7)
    patterns = ["".join(r.choice("ab/.~*") for _ in range(r.randrange(1, 9))) for _ in range(60)] + ["a" * 90, "~" + "ab" * 40 + "*", ""]
    urls = ["".join(r.choice("ab/.") for _ in range(r.randrange(0, 12))) for _ in range(400)] + ["a" * 90, "xx" + "ab" * 40 + "/", ""]
    got = url_filter.Globs(patterns).match([u.encode() for u in urls])
    for i, u in enumerate(urls):
        for j, p in enumerate(patterns):
            assert got[i, j] == _glob(p, u), (u, p)


@pytest.mark.parametrize(
    "url,expected",
    [
        ("https://A.Example.ORG/en/12?x#y", ("a.example.org", "/en/12", "example.org/en/1", "block")),
        ("https://example.org/es/", ("example.org", "/es/", "example.org/es/", "block")),
        ("https://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow")),
        ("https://x.com/fr/a", ("x.com", "/fr/a", "com/fr/", "allow")),
        ("https://x.com/FR/a", ("x.com", "/FR/a", None, "allow")),
        ("https://free-bets.com/en/", ("free-bets.com", "/en/", None, "block")),
        ("https://x.com/a.org/b", ("x.com", "/a.org/b", None, "allow")),
        ("https://example.org?q=/es/", ("example.org", "", None, "allow")),
        ("https://example.org#://b.com/de/", ("example.org", "", None, "allow")),
        ("example.org/es/", ("", "", None, "allow")),
        ("", ("", "", None, "allow")),
        (None, ("", "", None, "allow")),
        ("://com/de/" + "x" * 5000, ("com", "/de/" + "x" * 5000, "com/de/", "block")),
    ],
)
def test_url_rules(spark, url, expected):
    df = spark.createDataFrame([(1, url, "h"), (1, url, "h")], "page_id long, url string, host string")
    for r in url_filter.judge(df).collect():
        assert (r.host, r.path, r.rule, r.verdict) == expected


def test_no_pages(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# --- op10


def _lines_brute(rows):
    windows, later = {}, {}
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = t.split("\n") if t is not None else []
        for p in range(len(lines) - 2):
            w = "\n".join(lines[p : p + 3])
            if w.strip(" \t\r\n"):
                if windows.setdefault(w, (k, p)) != (k, p):
                    later.setdefault(k, set()).update((p, p + 1, p + 2))
    return {k: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in later.get(k, ())) for k, t in rows}


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(k, "\n".join(r.choice(["a", "b", "", " ", "long line"]) for _ in range(r.randrange(0, 9)))) for k in range(120)] + [(500, None), (501, ""), (502, "a\n" * 400), (503, "x\ny"), (None, "a\nb\na\nb\nlast")]
    got = {x.doc_id: x for x in line_dedup.digest(clashing(spark.createDataFrame(rows, DOCS).repartition(3))).collect()}
    want = _lines_brute(rows)
    for k, t in rows:
        assert got[k].text == want[k], (k, t)
        assert got[k].n_lines == (len(t.split("\n")) if t is not None else 0)
    assert line_dedup.digest(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_keeps_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "s"), (1, "a\nb\nc", "s"), (2, "a\nb\nc\nd", "s")], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.text, r.source, r.n_removed) for r in line_dedup.dedup(df).collect())
    assert got == [(1, "a\nb\nc", "s", 0), (1, "a\nb\nc", "s", 0), (2, "d", "s", 3)]


def test_line_dedup_output_names_give_way(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 9, "k", 7), (2, "a\nb\nc\nd", 9, "k", 7)], "doc_id long, text string, N_lines long, _lines string, _kid long")
    out = line_dedup.dedup(df)
    assert out.columns == ["doc_id", "text", "_lines", "_kid", "n_lines", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(1, "a\nb\nc", "k", 7, 3, 0), (2, "d", "k", 7, 4, 3)]
