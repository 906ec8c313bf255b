"""The registered queries of the text operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table
from .exact_dedup import exact_dedup
from .hard_negatives import mine
from .html_text import extract_text
from .language import identify_language
from .language import train as train_language
from .mixing import mix
from .near_dup import near_duplicates
from .order_minhash import fingerprint_edits
from .packing import pack
from .pii import find_pii, span_digest
from .quality import quality
from .tokens import count_tokens
from .toxicity import score_toxicity
from .toxicity import train as train_toxicity
from .whitening import whitened_rows

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are equal but for white space, and which one of each group stays."""
    return exact_dedup(_documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and spans of the base kinds, further kinds and scores."""
    return span_digest(find_pii(_documents(spark, sf_dir)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows that are not held out."""
    docs = _documents(spark, sf_dir)
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and where 2048 of them end."""
    return count_tokens(_documents(spark, sf_dir), "word_bpe_49k.json", limit=2048)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = _documents(spark, sf_dir)
    return identify_language(docs, train_language(docs))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose five-word shingles agree by 0.8 or more."""
    return near_duplicates(_documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts, score and verdict of every document."""
    return quality(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(spread(table(spark, sf_dir, "pages")))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return pack(_documents(spark, sf_dir), "byte_bpe_50k", capacity=2048)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first 32 whitened components."""
    return whitened_rows(spread(table(spark, sf_dir, "embeddings")), components=32)


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how like it is to that and to the next document's."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))  # dealt out by ranges of ids anyway


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector: by id, labels of every seventh moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spread(table(spark, sf_dir, "embeddings")).withColumn("label", moved), F.col("vec_id") % 100 == 0)


def base_pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op2 the counts of the base kinds, which SQL can express."""
    return op2_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def base_token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op4 the bytes of every text."""
    return op4_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


def base_shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op6 the size of every document's set."""
    return op6_near_duplicates(spark, sf_dir).select("doc_id", "n_shingles")


def base_mix_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op7 the words of every document and of its source."""
    return op7_mixing(spark, sf_dir).select("doc_id", "size", "source_size")


def base_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op8 the counts and the verdict of the fixed rules."""
    return op8_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_language": op5_language,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_html_text": op9_html_text,
    "op10_harmonic_packing": op10_harmonic_packing,
    "op11_whitening": op11_whitening,
    "op12_order_minhash": op12_order_minhash,
    "op13_hard_negatives": op13_hard_negatives,
    "base_pii_counts": base_pii_counts,
    "base_token_bytes": base_token_bytes,
    "base_shingle_counts": base_shingle_counts,
    "base_mix_sizes": base_mix_sizes,
    "base_quality_rules": base_quality_rules,
}
