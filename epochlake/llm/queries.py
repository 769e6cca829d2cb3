"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, mixing, near_dup, pieces, pii, quality_model, quality_rules, sql, suffix_family, token_counts, topk, url_filter, vector_codes, warc
from .common import table


def op1_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    import public_tokenizers as tokenizers

    paths = [tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("tiktoken", "json")]
    return token_counts.token_counts(table(spark, sf_dir, "documents"), *paths, tokenizers.PATTERN)


def op4_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def tokenizer_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_pieces(spark, sf_dir):
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer_model())


def op10_quality_model(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality_model.classify(table(spark, sf_dir, "documents"), labels)


def op6_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op7_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_near_duplicates(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_alignment(spark, sf_dir):
    import public_tokenizers as tokenizers

    ranks, full = (tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("tiktoken", "json"))
    return alignment.align(table(spark, sf_dir, "documents"), ranks, full, tokenizers.PATTERN, tokenizer_model())


def op12_vector_codes(spark, sf_dir):
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark, sf_dir):
    return suffix_family.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_token_counts": op2_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op8_pieces": op8_pieces,
    "op10_quality_model": op10_quality_model,
    "op11_alignment": op11_alignment,
    "op12_vector_codes": op12_vector_codes,
    "op13_suffix_dedup": op13_suffix_dedup,
    "op6_pii": op6_pii,
    "op7_url_filter": op7_url_filter,
    "op3_warc": op3_warc,
    "op5_top_k": op5_top_k,
    "op9_near_duplicates": op9_near_duplicates,
}

ORACLE_SQL = {
    "op1_source_mix": sql.MIX,
    "op4_quality_rules": sql.quality(quality_rules.COMMON_WORDS, 0.16, 0.3, 200, 100),
    "op5_top_k": sql.TOP_K,
    "op3_warc": sql.WARC,
    "op12_vector_codes": sql.vector_codes(),
    "op13_suffix_dedup": sql.SUFFIX_DEDUP,
    "op9_near_duplicates": sql.NEAR_DUPLICATES,
}
