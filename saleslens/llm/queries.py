"""Registered queries of the training-data operators: each runs over its whole table."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from saleslens.llm import (
    decontamination,
    html_text,
    lm_scoring,
    phrases,
    pieces,
    quality,
    simhash,
    spelling,
    substrings,
    toxicity,
    url_filter,
    versions,
    warc,
)
from saleslens.llm.common import read_table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_pages(read_table(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the four rules for every page."""
    rules = spark.createDataFrame(list(url_filter.RULES), "action string, rule string")
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), rules)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; $SALESLENS_TOKENIZERS names another folder."""
    folder = os.environ.get("SALESLENS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join("/opt/tokenizers", name)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    model = pieces.read_model(tokenizer_path("piece_bpe_32k.model"))
    return pieces.encoding_digests(read_table(spark, sf_dir, "documents"), model)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of the benchmark in every document."""
    return decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document and whether it is kept."""
    return quality.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and its edited text, and their likeness."""
    return versions.fingerprint_versions(read_table(spark, sf_dir, "documents"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat a smaller document."""
    return substrings.removal_digests(read_table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every document under the attention model and the word baseline."""
    model = pieces.read_model(tokenizer_path("piece_bpe_32k.model"))
    return lm_scoring.score_documents(read_table(spark, sf_dir, "documents"), model)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of every page, read back from the archive that it was written to."""
    return warc.archive_pages(read_table(spark, sf_dir, "pages"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every frequent word of the documents."""
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_html_text,
        op2_url_filter,
        op3_sentencepiece,
        op4_decontamination,
        op5_quality,
        op6_toxicity,
        op7_simhash,
        op8_fingerprints,
        op9_suffix_array,
        op10_lm_scoring,
        op11_warc,
        op12_phrases,
        op13_spelling,
    )
    return {q.__name__: q for q in found}
