"""Queries over texts that are missing, empty or begin with an empty line, against their SQL in DuckDB."""

import duckdb
import pytest

from newsloom.registry import registered

#: By id: no text, an empty one, an empty first line, one of white space, a plain one.
TEXTS = (None, "", "\nbehind an empty line", "  ", "a title\nand a body")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Every kind of text under every remainder that the queries look at."""
    where = tmp_path_factory.mktemp("odd")
    rows = [(k, TEXTS[k // 420], "en", f"src{k % 12}", len(TEXTS[k // 420] or "")) for k in range(420 * len(TEXTS))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{where}/documents.parquet")
    return str(where)


@pytest.mark.parametrize("name", ["s04_merge", "c35_invalidated"])
def test_odd_texts_as_the_sql_says(spark, odd, name):
    q = registered()[name]
    df = q.run(spark, odd)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    rel = duck.sql(q.sql)
    got = sorted(repr([r[c] for c in rel.columns]) for r in df.collect())
    assert got == sorted(repr(list(r)) for r in rel.fetchall())
    assert len(got) >= 420
