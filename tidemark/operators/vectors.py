"""Embeddings, and what becomes of them when the model changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import search
from tidemark.operators.search import tokens
from tidemark.operators.vector_index import VectorIndex


def embedded(texts: DataFrame, width: int = 64) -> DataFrame:
    """texts (id, text) as (id, vector): a stand-in for a model: words hashed to signed places, the sum of
    length 1. Equal texts have equal vectors; a text without words has the zero vector; texts of one id are one. A
    text's words are summed by place where they are, so at most `width` rows of it are shuffled."""
    words = texts.select("id", F.explode_outer(tokens(F.col("text"))).alias("word")).withColumn("code", F.xxhash64("word"))
    sign = F.when(F.col("word").isNull(), 0.0).when(F.shiftright("code", 62).bitwiseAND(1) == 0, 1.0).otherwise(-1.0)
    sums = words.groupBy("id", F.pmod("code", F.lit(width)).alias("place")).agg(F.sum(sign).alias("x"))
    each = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("at"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    value = lambda k: F.when(F.col("norm") > 0, F.coalesce(F.try_element_at("at", k), F.lit(0.0)) / F.col("norm")).otherwise(0.0).cast("float")
    return each.select("id", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), value).alias("vector"))


def inserted(vectors: DataFrame, path: str, width: int) -> None:
    """Adds vectors (id, family, vector) to the store at a path, a folder for each family; one of another width is an error."""
    search.of_width(vectors, width).write.mode("append").partitionBy("family").parquet(path)


def fragments(store: DataFrame) -> DataFrame:
    """(family, fragments, n): data files and rows of each family of a store as it was read."""
    return store.select("family", F.input_file_name().alias("file")).groupBy("family").agg(F.countDistinct("file").alias("fragments"), F.count(F.lit(1)).alias("n"))


def reembedded(index: VectorIndex, texts: DataFrame, model_id: str, embed: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Embeds the texts (id, family, text) of the families that another model embedded, and puts each family's new vectors and
    the model's id in the place of the old ones in one step. Other families and those never indexed are not read. Returns the
    families done; a family has its old vectors until its new ones are all there, so a pass that was broken off is run again."""
    done = []
    for row in stale(index.families(), index.families(), model_id).orderBy("family").collect():  # families are a fixed handful
        index.replace(row.family, embed(texts.where(F.col("family") == row.family).select("id", "text")), model_id)
        done.append(row.family)
    return done


def stale(families: DataFrame, meta: DataFrame, model_id: str) -> DataFrame:
    """Families (family) that were indexed with another model; those never indexed are left alone."""
    return families.join(meta.where(F.col("model_id") != model_id).select("family"), "family", "left_semi")
