"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing. Each stage reads what the one before wrote.

Defined results: null and empty texts fail the quality rules' base rule and go; null languages and sources are groups of their own; repeated rows
are judged alike and one of them stays; an empty table gives an empty result; further columns are carried to the packing stage unchanged.
A stage begins by deleting the tables that the one before it made on its way, once nothing reads them any more.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from veldspar.llm import jaccard, linedup, mixing, packing, quality
from veldspar.llm.queries import tokenizer_path
from veldspar.tables import drop_tables, materialise, recorded, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_spent: dict[int, list[str]] = {}


def _stage(at: int) -> Callable[[Stage], Stage]:
    """Notes the tables that stage number `at` makes, and drops those of the stage before unless its docs still read them."""

    def decorate(stage: Stage) -> Stage:
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            before = _spent.pop(at - 1, [])
            if before and not any(path.rsplit("/", 1)[-1] in file for file in docs.inputFiles() for path in before):
                drop_tables(spark, before)
            with recorded() as made:
                out = stage(spark, docs, sf_dir)
            _spent[at] = made
            return out

        return run_stage

    return decorate


@_stage(0)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage(1)
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linedup.without_boilerplate(docs)


@_stage(2)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, width=5, percent=80)


@_stage(3)
def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


@_stage(4)
def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing_sources", mixing_sources),
    ("packing", packing_sequences),
]

#: Certified cutoffs, components and the packing plan are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
