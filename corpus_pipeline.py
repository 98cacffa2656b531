"""The corpus pipeline: each stage reads all that its predecessor kept, and its decisions take effect.

1. toxicity: documents that score 0.5 or more go.
2. line dedup: lines that repeat an earlier line go; documents stay, n_chars follows.
3. near duplicates: of each group of near duplicates (the operator's two-word shingles, similarity 0.8) one stays.
4. decontamination: documents with a passage of the benchmark go.
5. packing: what is left, as pieces in sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import decontaminate, lines, minhash, packing, toxicity
from spindrift.llm._base import staged, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The model learns from the corpus's own labels and documents, whatever earlier stages left of them.
    model = toxicity.train(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id")))
    return toxicity.harmless(docs, model)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.fewer_lines(spark, docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(spark, docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES = [
    ("toxicity", _toxicity),
    ("line_dedup", _line_dedup),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("packing", _packing),
]

# A factorization machine and column generation have no SQL.  The operators are tested by themselves in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
