"""A training-data pipeline: each stage reads what its predecessor kept and returns documents; the last one tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import bpe, lines, mixing, nearcopies, toxicity
from lexmill.llm.common import stash, table
from lexmill.llm.queries import ranks_and_pattern


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Null and empty texts are neutral and stay; without labels of both
    classes nothing goes; repeated rows are judged alike. All columns pass, whatever their names; empty tables stay empty."""
    return toxicity.drop_toxic(docs, toxicity.train(toxicity.training_rows(docs, table(spark, sf_dir, "labels"))))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites go, but for their first occurrence; each document stays. Null texts stay null, a null
    source is one site, repeated rows keep the same lines. All columns pass; empty tables stay empty."""
    return lines.dedup_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word shingles of Jaccard similarity from 0.8 on, stays: SimHash with
    vantage-point trees, and MinHash for what differs in more bits than trees can prune; each link is confirmed. Null, empty
    and wordless texts are copies of one another; rows that repeat a doc_id stay or go together, rows with a null doc_id
    stay. All columns pass; empty tables stay empty."""
    return nearcopies.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target takes them, three times at most. Null texts have size 0, a null source
    is a source, repeated rows come equally often. All columns pass; empty tables stay empty."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, a row for each row of docs. Null and empty texts have no ids; long texts are encoded in chunks by
    several tasks. Other columns go, as this is the last stage; empty tables stay empty."""
    ranks, pattern = ranks_and_pattern()
    return bpe.encode_documents(docs, ranks, pattern)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]
#: Toxicity is a model and near copies are found by hashes of shingles: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
