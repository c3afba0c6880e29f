"""The corpus pipeline: documents in, a deduplicated, cleaned and mixed corpus out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes what a stage returns to
the shared folder and hands the written table to the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.text import columns_of
from rillflow.llm.columns import unused
from rillflow.llm.decontaminate import benchmark_matches
from rillflow.llm.line_dedup import remove_repeated_lines
from rillflow.llm.mixing import poisson_mix, target_rates
from rillflow.llm.near_dedup import near_duplicates
from rillflow.llm.toxicity import drop_toxic, fit_toxicity
from rillflow.plans.workspace import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the classifier does not call toxic.

    Null and empty texts stay, as they hold nothing toxic; rows that repeat a text go or stay together, whatever their id,
    null ids too. Without labels nothing goes. An empty table gives an empty one; all columns pass as they are.
    """
    return drop_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines that occur earlier; ``n_chars`` follows the text.

    A text may end up empty, its row stays. Rows with a null id are unchanged and no source of others; rows that repeat id
    and text stay alike. Null, empty and blank texts have no lines. An empty table gives an empty one; other columns, of
    any name, pass as they are.
    """
    count = unused("n_removed_lines", docs)
    return remove_repeated_lines(docs, count=count).drop(count)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Rows without an id all stay, as do documents without words, each for itself. Rows that repeat an id are versions of
    one document: all of them stay, or all go when any is linked to a document with a smaller id. An empty table gives an
    empty one; all columns pass as they are.
    """
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return _without(docs, materialize(gone, "near-duplicates"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows without an id all stay; rows that repeat an id go together when any of them holds an item. Null and empty texts
    hold none, and null or empty items are held by none. An empty table gives an empty one; all columns pass as they are.
    """
    found = benchmark_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return _without(docs, materialize(found, "contaminated"))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not among ``ids``."""
    return docs.join(ids, "doc_id", "left_anti").select(columns_of(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources reach their target shares, in shuffled order.

    Adds ``copy`` and ``shuffle_key`` in place of columns of these names; all others pass as they are. A null source is
    one like others, a null id draws like the text ``null``, repeated ids draw alike. An empty table gives an empty one.
    """
    return poisson_mix(docs, target_rates(docs))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: A trained classifier is no SQL; tests/llm compares run() with a brute-force version of the other stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
