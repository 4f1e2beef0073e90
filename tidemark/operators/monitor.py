"""Monitoring: latency histograms, percentiles, component status, drift and grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper bounds in ns, inclusive; the last bucket takes the rest.
BOUNDS = (
    1_000, 5_000, 10_000, 50_000, 100_000, 500_000, 1_000_000, 5_000_000, 10_000_000, 50_000_000, 100_000_000, 500_000_000, 1_000_000_000, 10_000_000_000, (1 << 63) - 1,
)
RSS_GROWTH, P99_GROWTH = 5.0, 10.0


def bound(ns: Column) -> Column:
    """Upper bound of the bucket of a duration; negative ones count as 0."""
    ns = F.greatest(ns, F.lit(0))
    out = F.lit(BOUNDS[-1])
    for b in reversed(BOUNDS[:-1]):
        out = F.when(ns <= b, b).otherwise(out)
    return out


def histogram(samples: DataFrame, by: list[str]) -> DataFrame:
    """(by..., upper_ns, count) of samples (by..., ns)."""
    return samples.groupBy(*by, bound(F.col("ns")).alias("upper_ns")).agg(F.count(F.lit(1)).alias("count"))


def percentile(hist: DataFrame, by: list[str], p: float) -> DataFrame:
    """(by..., p_ns): bound of the first bucket at which the running count reaches ceil(n * p), 1 at least."""
    order = W.partitionBy(*by).orderBy("upper_ns").rowsBetween(W.unboundedPreceding, 0)
    run = hist.withColumn("run", F.sum("count").over(order)).withColumn("n", F.sum("count").over(W.partitionBy(*by)))
    goal = F.greatest(F.ceil(F.col("n") * p), F.lit(1))
    return run.groupBy(*by).agg(F.min(F.when(F.col("run") >= goal, F.col("upper_ns"))).alias("p_ns")) if 0 <= p <= 1 else hist.select(*by).distinct().withColumn("p_ns", F.lit(None).cast("long"))


def scrape_status(failure: Column) -> Column:
    """OK without failure, DOWN if there is nothing to reach, UNKNOWN if the answer failed or was late."""
    return F.when(failure.isNull(), "OK").when(failure.isin("refused", "missing"), "DOWN").otherwise("UNKNOWN")


def remembered(scrapes: DataFrame) -> DataFrame:
    """scrapes (component, seq, status): UNKNOWN of a component that answered before is DOWN. A component's first answer decides for
    all of its scrapes, so they need no order among themselves."""
    first = scrapes.where("status = 'OK'").groupBy("component").agg(F.min("seq").alias("_first"))
    lost = (F.col("status") == "UNKNOWN") & (F.col("_first") < F.col("seq"))
    return scrapes.join(first, "component", "left").withColumn("status", F.when(lost, "DOWN").otherwise(F.col("status"))).drop("_first")


def over_budget(status: Column, budget: Column, rss: Column) -> Column:
    return F.when((status == "OK") & (budget > 0) & (rss * 10 >= budget * 9), "DEGRADED").otherwise(status)


def latest(scrapes: DataFrame) -> DataFrame:
    rest = [c for c in scrapes.columns if c != "component"]
    return scrapes.groupBy("component").agg(F.max_by(F.struct(*rest), "seq").alias("s")).select("component", "s.*")


def growth(now: Column, base: Column) -> Column:
    return F.when(base > 0, (now - base) / base * 100)


def breaches(scrapes: DataFrame) -> DataFrame:
    """scrapes (component, seq, rss, p99_ns, reachable) against the first reachable one: each growth over its
    limit, as (component, seq, metric, percent). A zero baseline never breaches."""
    first = scrapes.where("reachable").groupBy("component").agg(F.min_by(F.struct("seq", "rss", "p99_ns"), "seq").alias("base"))
    later = scrapes.where("reachable").join(first, "component").where("seq > base.seq")
    one = lambda name, value, limit: F.struct(F.lit(name).alias("metric"), value.alias("percent"), F.lit(limit).alias("limit"))
    rows = later.select("component", "seq", F.explode(F.array(one("rss_growth", growth(F.col("rss"), F.col("base.rss")), RSS_GROWTH), one("p99_drift", growth(F.col("p99_ns"), F.col("base.p99_ns")), P99_GROWTH))).alias("b"))
    return rows.where("b.percent > b.limit").select("component", "seq", "b.metric", F.round("b.percent", 6).alias("percent"))


def breach_summary(found: DataFrame) -> DataFrame:
    line = F.concat("metric", F.lit("="), F.round("percent", 1).cast("decimal(38,1)").cast("string"), F.lit("%"))
    order = F.when(F.col("metric") == "rss_growth", 0).otherwise(1)
    return found.groupBy("component", "seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("s")))), lambda x: x["s"]), ";").alias("summary"))


def append_csv(rows: DataFrame, path: str) -> None:
    """Adds rows to the CSV files under a path; every file begins with the header."""
    rows.write.mode("append").option("header", True).csv(path)


def sensor_state(reports: DataFrame) -> DataFrame:
    """(component, degraded, errors) of reports (component, sensor, seq, down): a component is degraded while the
    latest report of any of its sensors is down; every such report counts as an error."""
    each = reports.groupBy("component", "sensor").agg(F.max_by("down", "seq").alias("down"), F.sum(F.col("down").cast("long")).alias("errors"))
    return each.groupBy("component").agg(F.bool_or("down").alias("degraded"), F.sum("errors").alias("errors"))


def backoff_reset(runs: DataFrame, stable_ns: int = 30_000_000_000) -> DataFrame:
    """(sensor, seq, attempt): failures in a row, started anew after a run of stable_ns or more."""
    order = W.partitionBy("sensor").orderBy("seq")
    r = runs.withColumn("group", F.sum((F.col("ran_ns") >= stable_ns).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return r.select("sensor", "seq", (F.row_number().over(W.partitionBy("sensor", "group").orderBy("seq"))).alias("attempt"))


def graded(answers: DataFrame) -> DataFrame:
    """answers (q_id, control, declined, answer, expected): a control must be declined, another must not and must hold
    one of the alternatives that | separates."""
    some = F.exists(F.split("expected", r"\|"), lambda x: (x != "") & F.contains(F.lower("answer"), F.lower(x)))
    return answers.withColumn("correct", F.when(F.col("control"), F.col("declined")).otherwise(~F.col("declined") & some))


def promotions(queries: DataFrame, slow_ns: int = 100_000_000, samples: int = 20, limit_ns: int = 5_000_000) -> DataFrame:
    """(family, seq): the first query of each family (family, seq, ns) after which it should get an index: it was slow or
    enough were seen, and the bucketed p99 so far is over the limit. That p99 is within the limit as long as at least
    ceil(0.99 n) of n samples are."""
    order = W.partitionBy("family").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    q = queries.withColumn("n", F.count(F.lit(1)).over(order)).withColumn("fast", F.sum((bound(F.col("ns")) <= limit_ns).cast("long")).over(order))
    due = ((F.col("ns") > slow_ns) | (F.col("n") >= samples)) & (F.col("fast") < F.greatest(F.ceil(F.col("n") * 0.99), F.lit(1)))
    return q.where(due).groupBy("family").agg(F.min("seq").alias("seq"))


def quiet_ends(inserts: DataFrame, gap_ns: int = 500_000_000) -> DataFrame:
    """Inserts (family, seq, t_ns) after which a family rests for more than gap_ns, or for good."""
    following = F.lead("t_ns").over(W.partitionBy("family").orderBy("t_ns", "seq"))
    return inserts.withColumn("next", following).where(F.col("next").isNull() | (F.col("next") - F.col("t_ns") > gap_ns)).drop("next")


def compactions(inserts: DataFrame, every: int = 256) -> DataFrame:
    return inserts.withColumn("k", F.row_number().over(W.partitionBy("family").orderBy("seq"))).where(F.col("k") % every == 0)


def drained(offers: DataFrame, capacity: int, newest: bool) -> DataFrame:
    """(batch, kept, dropped, edge) of offers (batch, seq) to a buffer of that capacity which is emptied after each batch. A
    lagging subscriber's buffer keeps the newest and drops what is older than `edge`; a full queue keeps the oldest and
    refuses what is later than `edge`."""
    n = offers.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    order = F.desc("seq") if newest else F.asc("seq")
    kept = offers.withColumn("k", F.row_number().over(W.partitionBy("batch").orderBy(order))).where(F.col("k") <= capacity)  # limited before the shuffle
    edge = kept.groupBy("batch").agg((F.min if newest else F.max)("seq").alias("edge"))
    return n.join(edge, "batch").select("batch", F.least("n", F.lit(capacity)).alias("kept"), F.greatest(F.col("n") - capacity, F.lit(0)).alias("dropped"), "edge")


def generation_rates(tokens: DataFrame) -> DataFrame:
    """(generation, prefill_ms, decode_ms) of tokens (generation, seq, t_ns, start_ns, prompt_tokens): the time to the first token for each
    token of the prompt, 0 without one, and the mean gap between tokens, 0 if there is but one."""
    g = tokens.groupBy("generation").agg(F.min_by("t_ns", "seq").alias("first"), F.max_by("t_ns", "seq").alias("last"), F.count(F.lit(1)).alias("n"), F.min("start_ns").alias("start"), F.max("prompt_tokens").alias("prompt"))
    prefill = F.when(F.col("prompt") > 0, (F.col("first") - F.col("start")) / 1e6 / F.col("prompt")).otherwise(0.0)
    return g.select("generation", prefill.alias("prefill_ms"), F.when(F.col("n") > 1, (F.col("last") - F.col("first")) / 1e6 / (F.col("n") - 1)).otherwise(0.0).alias("decode_ms"))


def reassembled(slots: DataFrame, generation: int | None, cancelled: DataFrame) -> DataFrame:
    """(generation, text) of token slots (generation, seq, piece binary, eos): pieces in order up to the end mark, decoded
    once; cancelled generations are skipped."""
    s = slots.join(cancelled, "generation", "left_anti")
    s = s.where(F.col("generation") == generation) if generation is not None else s
    end = s.where("eos").groupBy("generation").agg(F.min("seq").alias("end"))
    kept = s.join(end, "generation", "left").where(F.col("end").isNull() | (F.col("seq") < F.col("end")))
    parts = F.sort_array(F.collect_list(F.struct("seq", F.hex("piece").alias("h"))))
    return kept.groupBy("generation").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")).cast("string").alias("text"))


def common_prefix(tokens: DataFrame, run: int = 1 << 16) -> DataFrame:
    """(seq, shared) of prompts (seq, tokens): leading tokens that are those of the previous prompt. Prompts fall into runs of
    `run` numbers; a run's first prompt gets the last one of the run before, so one window over all rows sees only a
    number for each run."""
    t = tokens.withColumn("run", F.floor(F.col("seq") / run))
    ends = t.groupBy("run").agg(F.min("seq").alias("seq"), F.max("seq").alias("last"))
    before = ends.select("seq", F.lag("last").over(W.orderBy("run")).alias("last")).where("last IS NOT NULL")
    given = before.join(tokens.select(F.col("seq").alias("last"), F.col("tokens").alias("given")), "last").select("seq", "given")
    pairs = F.zip_with(F.col("tokens"), F.col("prev"), lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    broken = F.array_position(pairs, False)
    shared = F.when(F.col("prev").isNull(), 0).otherwise(F.when(broken == 0, F.size(pairs)).otherwise(broken - 1))
    near = t.withColumn("near", F.lag("tokens").over(W.partitionBy("run").orderBy("seq")))
    return near.join(given, "seq", "left").withColumn("prev", F.coalesce("near", "given")).select("seq", shared.cast("long").alias("shared"))
