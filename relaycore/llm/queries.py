"""The contract queries of the training-data operators: op<N>_<name>."""

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html_text, license_scan, line_quality, ngram_join, oracles, packing, suffix_dedup, suffix_tree_lm, toxicity, url_filter
from .tables import read, vocabulary


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted.  Null and empty texts score as texts without evidence; an empty table gives no rows."""
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed, kept, n_removed.  Null and empty texts fail the base rules; a null source is a host; repeated rows are each judged."""
    return line_quality.judge(read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated.  Null texts and items have no words; equal items are each reported."""
    return decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """The pieces of all documents, each in one place of one sequence.  Null texts hold the end id alone."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer or vocabulary("byte_bpe_50k.json"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id.  Documents without words are alone; rows of one doc_id are one document."""
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256.  Null texts have no bytes; the earliest place is that of the least doc_id."""
    return suffix_dedup.report(read(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict.  Null URLs have an empty host and path; of rules that fit the longest wins."""
    return url_filter.report(read(spark, sf_dir, "pages"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars.  Null and empty pages have an empty text."""
    return html_text.report(read(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, phrase places, labels, score.  Null and empty texts have none and score 0."""
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op6_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, token counts, base_score, score.  Null texts hold their end alone; repeated rows are each scored."""
    return suffix_tree_lm.report(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_quality": op2_line_quality,
    "op4_url_filter": op4_url_filter,
    "op5_packing": op5_packing,
    "op6_suffix_tree_lm": op6_suffix_tree_lm,
    "op7_license_scan": op7_license_scan,
    "op8_ngram_join": op8_ngram_join,
    "op9_html_text": op9_html_text,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op3_decontamination": op3_decontamination,
}
ORACLE_SQL = {"op2_line_quality": oracles.LINE_QUALITY, "op3_decontamination": oracles.DECONTAMINATION, "op7_license_scan": oracles.LICENSE_SCAN, "op8_ngram_join": oracles.NGRAM_JOIN}
