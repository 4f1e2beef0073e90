"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Blocks of `block` words are dealt to sources by highest quotients target / (2k + 1), then within a
source to its shards in the same way, which gives every shard an integer quota. A shard (a hash
range of ids, about `shard_words` words) puts its documents into a seeded order, reads them as a
circular stream of words and takes the first quota blocks of it: whole passes, then part of one.
plan() moves sizes, never texts; a hot source, or a doc_id that repeats, is spread over the shards.

A null text has size 0; a null source is a source of its own, the last one. Repeated rows count
each. An empty table gives no rows. Extra columns are kept by mix() and ignored by plan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): the total of all sizes shared by weight, no source above MOST
    times its size. With sources in the order of cap / weight, the capped ones are those before the
    first whose share of what is left stays within its cap."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*map(F.lit, weights))
    ranked = total.withColumn("at", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.select("source", "source_size", F.element_at(cycle, (F.col("at") % len(weights) + 1).cast("int")).alias("weight"), "at")
    ranked = ranked.withColumn("cap", MOST * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "at")
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) - (F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
    share = left / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    level = F.min(F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.struct("place", "share"))).over(everything)
    placed = ranked.withColumn("place", F.row_number().over(order)).withColumn("share", share).withColumn("level", level)
    target = F.when(F.col("place") < F.col("level.place"), F.col("cap").cast("double")).otherwise(F.col("level.share") * F.col("weight"))
    return placed.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def apportion(parties: DataFrame, within: list[str], key: list[str], votes: str, seats: str) -> DataFrame:
    """Adds `quota`: the seats of each group `within` dealt to its parties by highest quotients
    votes / (2k + 1). A party's share of the seats is off by at most share * parties / (2 * seats)
    seats and a rounding, so only the quotients that near decide; all before them win."""
    group = W.partitionBy(*within)
    exact = F.try_divide(F.col(votes) * F.col(seats), F.sum(votes).over(group))  # a group may have no votes at all
    near = F.ceil(F.col("exact") * F.count(F.lit(1)).over(group) / (2 * F.greatest(F.col(seats), F.lit(1)))) + 2
    known = parties.withColumn("exact", F.coalesce(exact, F.lit(0.0))).withColumn("near", near)
    known = known.withColumn("sure", F.greatest(F.floor("exact") - F.col("near"), F.lit(0)))
    known = known.withColumn("open", F.col(seats) - F.sum("sure").over(group))
    tried = known.select("*", F.explode(F.sequence(F.col("sure"), F.floor("exact") + F.col("near"))).alias("k"))
    best = W.partitionBy(*within).orderBy((F.col(votes) / (2 * F.col("k") + 1)).desc(), *key, "k")
    tried = tried.withColumn("wins", ((F.row_number().over(best) <= F.col("open")) & (F.col(votes) > 0)).cast("long"))
    return tried.groupBy(*parties.columns).agg((F.first("sure") + F.sum("wins")).alias("quota"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = 64, shard_words: int = 500_000, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): words of each document that the mix
    takes, repeats counted; at most MOST times its size. Equal on every run with one seed."""
    sizes = stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("print")))
    goals = targets(sizes, weights)
    goals = goals.withColumn("all", F.floor(F.sum("source_size").over(W.partitionBy()) / block)).withColumn("one", F.lit(0))
    goals = apportion(goals, ["one"], ["source"], "target", "all").drop("all", "one").withColumnRenamed("quota", "source_quota")
    goals = goals.withColumn("shards", F.ceil(F.col("source_size") / shard_words) + 1)
    code = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("print").cast("string")))
    rows = sizes.withColumn("code", code).alias("d").join(goals.alias("g"), F.expr("d.source <=> g.source")).select("d.*", "source_size", "target", "source_quota", "shards")
    rows = rows.withColumn("shard", F.conv(F.substring("code", 1, 8), 16, 10).cast("long") % F.col("shards"))
    shards = rows.groupBy("source", "source_quota", "shard").agg(F.sum("size").alias("shard_size"))
    shards = apportion(shards, ["source"], ["shard"], "shard_size", "source_quota").select("source", "shard", "shard_size", "quota")
    rows = rows.alias("d").join(shards.alias("s"), F.expr("d.source <=> s.source AND d.shard = s.shard")).select("d.*", "shard_size", "quota")
    words = F.least(F.col("quota") * block, MOST * F.col("shard_size"))
    stream = W.partitionBy("source", "shard").orderBy("code", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("words", words).withColumn("passes", F.when(F.col("shard_size") > 0, F.expr("words div shard_size")).otherwise(F.lit(0)))
    rows = rows.withColumn("rest", F.col("words") - F.col("passes") * F.col("shard_size")).withColumn("before", F.sum("size").over(stream) - F.col("size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs that the mix takes, with `mix_words` (words taken, repeats counted), which replaces a column of
    that name. Rows with one id and size are taken alike: each gets their mean. The plan moves no texts; joining it back
    moves the rows of docs once."""
    taken = plan(docs, **options).groupBy("doc_id", "size").agg(F.avg("taken").alias("taken"))
    rows = docs.select(F.struct("*").alias("row"), n_words(F.col("text")).alias("words"))
    joined = rows.join(taken, F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("doc_id")) & (F.col("words") == F.col("size"))).where("taken > 0")
    rest = [F.col("row")[c].alias(c) for c in docs.columns if c != "mix_words"]
    return joined.select(*rest, F.round("taken").cast("long").alias("mix_words"))
