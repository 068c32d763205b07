"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers

from newsloom.llm import decontaminate, exact_dedup, fill_middle, hnsw, langid, line_dedup, ngram_join, pieces, suffix_dedup, token_shards, toxicity, url_filter, vector_codes
from newsloom.tables import read

#: The SentencePiece model; a parameter of the operators.
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_decontaminate(spark, sf_dir):
    return decontaminate.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_ngram_join(spark, sf_dir):
    return ngram_join.digest(read(spark, sf_dir, "documents"))


def op3_token_shards(spark, sf_dir):
    return token_shards.materialise(read(spark, sf_dir, "documents"), MODEL)


def op4_hnsw(spark, sf_dir):
    return hnsw.digest(read(spark, sf_dir, "embeddings"))


def op5_langid(spark, sf_dir):
    return langid.digest(read(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(read(spark, sf_dir, "documents"))


def op8_pieces(spark, sf_dir):
    return pieces.digest(read(spark, sf_dir, "documents"), MODEL)


def op9_url_filter(spark, sf_dir):
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op10_line_dedup(spark, sf_dir):
    return line_dedup.digest(read(spark, sf_dir, "documents"))


def op11_fill_middle(spark, sf_dir):
    return fill_middle.digest(read(spark, sf_dir, "documents"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.digest(read(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark, sf_dir):
    return exact_dedup.digest(read(spark, sf_dir, "documents"))


_ALL = (
    op1_decontaminate, op2_ngram_join, op3_token_shards, op4_hnsw, op5_langid, op6_toxicity, op7_suffix_dedup, op8_pieces,
    op9_url_filter, op10_line_dedup, op11_fill_middle, op12_vector_codes, op13_exact_dedup,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {
    "op9_url_filter": url_filter.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_fill_middle": fill_middle.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_exact_dedup": exact_dedup.SQL,
}
