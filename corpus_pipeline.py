"""Corpus pipeline: toxicity, near duplicates, repeated passages, packing.

Each stage reads what the one before it wrote and works on all of it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common, packing, pieces, simhash, substring, toxicity
from corpusloom.llm.queries import PIECE_MODEL
from corpusloom.session import ensure_importable, table

_scratch: list[str] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage first deletes what the stage before kept for itself, whose result is written by now."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_importable(spark)
        common.drop_scratch(_scratch)
        before = common.scratch_paths()
        out = f(spark, docs, sf_dir)
        _scratch[:] = [p for p in common.scratch_paths() if p not in before]
        return out

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on this input's labelled rows, doesn't reject; all where labels teach nothing.

    Texts count whole, however long; null and empty ones stay, as do rows without an id; repeated rows are judged
    alike. An empty table gives none.
    """
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.scorer(model, "text") < 0.5)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every near-duplicate component; rows without an id all stay.

    Rows repeated under one id stay together, as they are one document, which goes only if each of them is a copy.
    """
    classes = simhash.near_duplicates(docs).groupBy(F.col("doc_id").alias("_gone")).agg(F.bool_and(F.col("component_id") != F.col("doc_id")).alias("copy"))
    classes = classes.filter("copy")
    return docs.join(classes, docs["doc_id"] == classes["_gone"], "left_anti")


@_stage
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; of equals the least id keeps its own.

    Null and empty texts and rows without an id stay as they are; a text of which all was said before stays as an
    empty one; an id whose rows differ keeps its texts whole. An empty table gives none.
    """
    return substring.without_spans(docs, substring.repeated_passages(docs))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a training sequence for every document.

    Null and empty texts take the place of their end token; a text longer than the longest sequence is cut into
    pieces; ties go by id. An empty table gives no rows.
    """
    lengths = packing.measured(docs, pieces.token_counter(docs, PIECE_MODEL)("text") + 1)
    return packing.best_fit_packing(lengths, lengths["n_tokens"])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("packing", pack),
]

#: No stage but the filter by a trained model could be SQL, so none is given; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next; what a stage wrote goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = common.scratch_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        if before:
            common.drop_scratch([before])
        before = path
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
