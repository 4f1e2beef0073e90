"""The event gate: pauses and exclusions, and what it reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.prefix import following, running

FOREVER = (1 << 63) - 1


def pauses(controls: DataFrame) -> DataFrame:
    """(from_ns, until_ns) of controls (seq, t_ns, action, for_ns): a pause lasts for_ns, or for ever if
    that is 0, but not beyond the next control."""
    upto = F.when(F.col("for_ns") == 0, F.lit(FOREVER)).otherwise(F.when(F.col("t_ns") > F.lit(FOREVER) - F.col("for_ns"), F.lit(FOREVER)).otherwise(F.col("t_ns") + F.col("for_ns")))
    rows = following(controls, ["t_ns", "seq"], "t_ns", "_next").withColumn("until_ns", F.least(upto, F.coalesce("_next", F.lit(FOREVER))))
    return rows.where("action = 'pause'").select(F.col("t_ns").alias("from_ns"), "until_ns")


def excluded_apps(defaults: DataFrame, configured: DataFrame, use_defaults: bool = True) -> DataFrame:
    """(app_id,) of both lists, each once."""
    return (configured.unionAll(defaults) if use_defaults else configured).distinct()


def allowed(events: DataFrame, excluded: DataFrame, paused: DataFrame) -> DataFrame:
    """events (app_id, t_ns, ...) outside all pauses and of no excluded application; an unknown one passes. Events and pauses lie in
    one order of time, and an event is paused if the latest end of the pauses begun so far is still to come: there may be as many
    pauses as events. An event without time is never paused."""
    free = events.join(excluded, "app_id", "left_anti").select(*events.columns)
    rows = free.select(F.struct("*").alias("event"), F.col("t_ns").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_until"))
    begun = paused.select(F.lit(None).cast(rows.schema["event"].dataType).alias("event"), F.col("from_ns").alias("_t"), F.lit(0).alias("_kind"), F.col("until_ns").alias("_until"))
    known = running(rows.unionAll(begun), [], ["_t", "_kind"], {"_open": ("max", F.col("_until"))})
    return known.where("_kind = 1 AND (_t IS NULL OR _open IS NULL OR _open <= _t)").select("event.*")


def status(excluded: DataFrame, paused: DataFrame, now_ns: int, drops: DataFrame) -> DataFrame:
    """One row: paused or not, until when (0 if not), sorted exclusions, subscribers and drops."""
    now = paused.where((F.col("from_ns") <= now_ns) & (F.col("until_ns") > now_ns)).agg(F.max("until_ns").alias("u"))
    apps = excluded.agg(F.sort_array(F.collect_set("app_id")).alias("excluded"))
    lost = drops.agg(F.count(F.lit(1)).alias("subscribers"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"))
    return now.crossJoin(apps).crossJoin(lost).select(F.col("u").isNotNull().alias("paused"), F.coalesce("u", F.lit(0)).alias("until_ns"), "excluded", "subscribers", "dropped")
