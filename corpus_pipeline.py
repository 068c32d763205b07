"""From raw documents to token ids: language, repeated lines, near copies, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents; where a stage changes
the text, n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import decontaminate, langid, line_dedup, ngram_join, pieces
from newsloom.llm.names import free
from newsloom.llm.registry import MODEL
from newsloom.plans.durable import written
from newsloom.tables import read


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that state a language; what has none that it can tell (no text, no letter) goes."""
    model = langid.train(docs.where(~langid.held_out()))
    lang, score = free("lang_pred", docs.columns), free("lang_score", docs.columns)
    return langid.predict(docs, model, lang_name=lang, score_name=score).where(F.col(lang) != "und").select(*docs.columns)


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; so does a document of which every line went."""
    lines, removed = free("n_lines", docs.columns), free("n_removed", docs.columns)
    out = line_dedup.dedup(docs, lines_name=lines, removed_name=removed).where((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    return _measured(out.select(*docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group at a similarity of 0.8 or more on five-word shingles, the smallest doc_id stays; a row without doc_id stays
    only where no identified one of its group does. Rows are told apart by doc_id and text: another text under a copy's doc_id
    stays, and of rows alike in both one stays."""
    key, gone, of = (free(name, docs.columns) for name in ("row_key", "gone", "judged"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text").isNull().alias("empty"), F.xxhash64("text").alias("h"))
    keyed = docs.withColumn(key, row)
    groups = ngram_join.cluster(keyed.select(key, "text"), 5, 80, id_col=key)
    seen = groups.groupBy(F.col(key).alias(of)).agg(F.first("component_id").alias("stays"), F.count("*").alias("n"))
    judged = seen.where((F.col("n") > 1) | (F.col("stays") != F.col(of))).select(of, (F.col("stays") != F.col(of)).alias(gone))
    joined = keyed.join(judged, F.col(key) == F.col(of), "left")
    repeated = joined.where(~F.col(gone)).dropDuplicates([key])
    return joined.where(F.col(gone).isNull()).select(*docs.columns).unionByName(repeated.select(*docs.columns))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark windows are cut out; a document that is mostly benchmark goes."""
    return _measured(decontaminate.remove(docs, read(spark, sf_dir, "benchmark")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, token_ids, and whether decoding gives the text back."""
    return pieces.encoded(docs, MODEL)


STAGES = [
    ("language_id", language_id),
    ("line_windows", line_windows),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("encoding", encoding),
]

#: Sentence pieces and language profiles are beyond SQL; tests hold run() against brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
