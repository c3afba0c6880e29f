"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own content says so, so equal texts are cut alike. Every distinct chunk gets a verified
identifier: its fingerprint, and a rank among the distinct chunks that share the fingerprint. A text is then its recipe,
the ordered list of identifiers, and equal recipes are equal texts. Chunks meet once, reduced to distinct ones before
they move; what is grouped and joined afterwards are recipes, about a hundredth of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rillflow.llm.columns import lower_ascii
from rillflow.plans.workspace import discard, materialize

#: A chunk ends after 1024 characters at the next white space that follows one of these letters, at 8192 at the latest.
CHUNK = r"(?s).{1024,8192}?(?<=[aeinst]\s)|.{1,8192}"


def chunks(text: Column) -> Column:
    """The text's chunks in order, together the whole text; an empty text has none."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_duplicates(docs: DataFrame, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its class of equal texts and which member stays.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts are equal to each
    other. The largest ``doc_id`` of a class stays; a null id is smaller than any other, and a class of null ids keeps
    none. Rows that repeat id and text are each counted and share the flag. Other columns, whatever their names, are not
    read. ``fingerprint`` may be any hash: chunks that share a value are told apart by their content.
    """
    texts = docs.select("doc_id", lower_ascii(F.col("text")).alias("text"))
    pieces = texts.select(F.explode(chunks(F.col("text"))).alias("chunk"))
    distinct = pieces.select(fingerprint(F.col("chunk")).alias("print"), "chunk").distinct()
    shared = materialize(distinct.groupBy("print").count().where("count > 1").select("print"), "shared-fingerprints")
    if shared.isEmpty():
        recipe = F.transform(chunks(F.col("text")), lambda c: F.struct(fingerprint(c).alias("print"), F.lit(1).alias("rank")))
        recipes = texts.select("doc_id", recipe.alias("recipe"), F.sha2("text", 256).alias("text_sha256"))
    else:
        recipes = _ranked_recipes(texts, distinct.join(shared, "print"), fingerprint)
    recipes = materialize(recipes, "recipes")
    discard(shared)
    groups = recipes.groupBy("recipe").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    groups = materialize(groups.where("group_size > 1"), "equal-recipes")
    joined = recipes.join(groups, "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"),
        "text_sha256",
    )


def _ranked_recipes(texts: DataFrame, collided: DataFrame, fingerprint: Callable[[Column], Column]) -> DataFrame:
    """Recipes whose identifiers tell chunks with a shared fingerprint apart; joins on the chunks themselves."""
    rank = F.row_number().over(Window.partitionBy("print").orderBy("chunk"))
    ranks = collided.select("print", "chunk", rank.alias("rank"))
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = materialize(rows, "numbered-texts")
    pieces = rows.select("row", F.posexplode(chunks(F.col("text"))).alias("at", "chunk"))
    pieces = pieces.withColumn("print", fingerprint(F.col("chunk"))).join(ranks, ["print", "chunk"], "left")
    piece = F.struct("at", "print", F.coalesce("rank", F.lit(1)).alias("rank"))
    lists = pieces.groupBy("row").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    lists = lists.select("row", F.transform("pieces", lambda p: F.struct(p["print"].alias("print"), p["rank"].alias("rank"))).alias("recipe"))
    empty = F.array().cast("array<struct<print:bigint,rank:int>>")
    return rows.join(lists, "row", "left").select("doc_id", F.coalesce("recipe", empty).alias("recipe"), F.sha2("text", 256).alias("text_sha256"))
