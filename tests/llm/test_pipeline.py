"""The pipeline over the smallest tables, against a plain version of every stage."""

import re

import duckdb
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import decontaminate, ngram_join
from newsloom.llm.registry import MODEL, QUERIES, SQL
from test_llm_operators import _lines_brute

SF = "/root/testdata/sf0.001"


def test_run_equals_plain_stages(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = [(str(k), t) for k, t in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()]
    docs = [(k, t) for k, t in docs if t and any(c.isalpha() for c in t)]
    left = _lines_brute(docs)
    docs = [(k, left[k]) for k, t in docs if t == left[k] or left[k] != ""]
    group = ngram_join.brute(docs, 5, 80)
    docs = [(k, t) for k, t in docs if group[k][1] == k]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    clean = 0
    for k, t in docs:
        n, hit, _ = decontaminate.brute(t, items)
        if hit > 0.5 * n:
            assert k not in got
        elif hit == 0:
            clean += 1
            assert got.pop(k).token_ids == library.encode(t)
        else:
            row = got.pop(k)
            assert decontaminate.brute(library.decode(row.token_ids), items)[1] == 0 and row.n_tokens < len(library.encode(t))
    assert not got and clean > 100


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "a b\nc d\ne f", "en", "s", 11), (3, "a b\nc d\ne f", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_encoding_of_nulls_repeats_and_none(spark):
    rows = [(1, None), (None, "a b"), (2, ""), (3, "a b"), (3, "a b"), (4, "long " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("id", "t", "n_tokens", "token_ids", "round_trip")})
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(((r.doc_id or 0, r.n_tokens, r.token_ids) for r in corpus_pipeline.encoding(spark, docs, SF).collect()), key=repr)
    assert got == sorted(((k or 0, len(ids), ids) for k, t in rows for ids in [library.encode(t or "")]), key=repr)
    assert corpus_pipeline.encoding(spark, docs.limit(0), SF).count() == 0


def test_stages_heed_rows_not_names(spark):
    """Columns called like what the stages compute come back as they were; a text is kept although its doc_id has a copy."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "en"), (2, base + " end", "en"), (2, "another text altogether of other words", "en"), (None, "a text without any number to it", "en"), (4, "long " + " ".join(f"x{i}" for i in range(200_000)), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(f"own {c}") for c in ("score", "lang_pred", "n_removed", "n_lines", "_lines", "_kid", "component_id", "row_key", "id", "gone", "of", "n", "stays")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = out.collect()
        assert all(r[c] == f"own {c}" for r in got for c in docs.columns[3:])
        assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((k or 0, t) for k, t, _ in rows if name != "near_copies" or t != base + " end")


def test_near_copies_keeps_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(60))
    for rows, stay in (
        ([(1, base), (1, base), (None, base), (3, base)], [(1, base)]),
        ([(None, base), (None, base), (None, base + " end")], [(None, base)]),
        ([(7, base), (5, base + " end"), (None, base), (5, "other words here")], [(5, base + " end"), (5, "other words here")]),
        ([(1, None), (1, None), (2, None), (None, None), (3, ""), (4, "")], [(1, None), (2, None), (None, None), (3, ""), (4, "")]),
    ):
        out = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF).collect()
        assert sorted(map(tuple, out), key=repr) == sorted(stay, key=repr) or len(stay) == len(out) == 1 and out[0].text.startswith(base), (rows, out)


def test_each_operator_has_one_query():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
