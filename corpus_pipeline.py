"""Training-corpus pipeline: five stages over the table ``documents``.

Each stage works on all that its predecessor kept, written as Parquet and read
again; its decisions take effect. All but the last return the columns of
documents. Part of the training-data operators (``saleslens.llm``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from saleslens.llm import decontamination, pieces, quality, simhash, substrings
from saleslens.llm.common import delete_folders, read_table, stored_folders, through_storage
from saleslens.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the quality classifier rejects go."""
    return quality.keep_resampled(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each near-duplicate component stays, that of the smallest id."""
    return simhash.keep_one(docs, shingle=3, distance=3)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: passages of 50 bytes or more that a smaller document has are cut out."""
    return substrings.remove_repeats(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the benchmark's passages are cut out."""
    return decontamination.remove_contamination(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: ids of every text, as digests, and the decoded text's."""
    return pieces.encoding_digests(docs, pieces.read_model(tokenizer_path("piece_bpe_32k.model")))


STAGES = [
    ("quality", keep_good),
    ("simhash", drop_near_copies),
    ("suffix_array", cut_repeats),
    ("decontamination", cut_benchmark),
    ("sentencepiece", encode),
]

#: The stages' samples, fingerprints and ids have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows.

    Once a stage's result is stored, what it was made from goes: its own
    intermediate folders and its predecessor's result.
    """
    docs, held = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with stored_folders() as folders:
            docs = through_storage(stage(spark, docs, sf_dir), name)
        delete_folders(spark, [*held, *folders[:-1]])
        held = folders[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
