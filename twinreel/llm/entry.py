"""Queries of this folder and their SQL. Each runs over its whole table."""

from __future__ import annotations

from . import exact_dedup, html_extract, lexical, line_dedup, merkle, mixing, ngram_join, piece_codec, quality, secrets, token_counts, topk, toxicity
from .common import read


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"), piece_model())


def op2_mix_sources(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


def op3_piece_codec(spark, sf_dir):
    return piece_codec.encode_decode(read(spark, sf_dir, "documents"), piece_model())


def op4_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(read(spark, sf_dir, "documents"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op6_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"))


def op7_html_extraction(spark, sf_dir):
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op8_quality(spark, sf_dir):
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_exact_top_k(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op11_lexical_search(spark, sf_dir):
    return lexical.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle.tamper_check(read(spark, sf_dir, "documents"))


def op13_secret_scan(spark, sf_dir):
    return secrets.secrets(read(spark, sf_dir, "documents"))


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return found


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix_sources": mixing.SQL,
        "op4_line_dedup": line_dedup.SQL,
        "op5_exact_dedup": exact_dedup.SQL,
        "op6_ngram_join": ngram_join.SQL,
        "op10_exact_top_k": topk.SQL,
        "op11_lexical_search": lexical.SQL,
        "op12_merkle_manifest": merkle.SQL,
    }
