"""Title search over blocks: the same answer however titles are dealt, and nothing for each pair leaves a block."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import neighbours as N
from newsloom.operators import retrieval as R


def test_codes_are_the_trigrams(spark):
    titles = ["", "a", "ab", "abc", "Ab  cd ab cd", "خبر تازه از بازار", "𝒳yz 𝒳yz w", "!!", None, "aaaa"]
    for r in spark.createDataFrame([(t,) for t in titles], "title string").select(T.trigrams(F.col("title")).alias("g"), F.replace(T.title_key(F.col("title")), F.lit(" "), F.lit("")).alias("key")).collect():
        want = sorted(sum(ord(x) << s for x, s in zip(g, (42, 21, 0), strict=False)) for g in r.g)
        assert (R._codes(r.key).tolist() if r.key else []) == want


@pytest.mark.parametrize("labelled", [False, True])
def test_blocks_equal_all_pairs(spark, monkeypatch, labelled):
    monkeypatch.setattr(R, "TITLES", 7)
    monkeypatch.setattr(R, "QUERY_TITLES", 3)
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(["ban", "gold", "rate", "oil", "up"]) for _ in range(r.randrange(5))), r.randrange(9), r.randrange(4)) for k in range(80)]
    df = spark.createDataFrame(rows, "id long, title string, at long, label int").repartition(3)
    sets = {x.id: set(x.g) for x in df.select("id", T.trigrams(F.col("title")).alias("g")).collect()}
    fits = lambda q, c: not labelled or (c[2] < q[2] and (q[3] == N.NONE or c[3] in (N.ANY, q[3])))
    want = set()
    for q in rows[::3]:
        near = [(-len(a & b) / len(a | b), c[0]) for c in rows if c[0] != q[0] and (a := sets[q[0]]) & (b := sets[c[0]]) and fits(q, c)]
        want |= {(q[0], k, -s) for s, k in sorted(near)[:4]}
    assert {tuple(x) for x in R.similar_titles(df.where("id % 3 = 0"), df, 4, labelled).collect()} == want
