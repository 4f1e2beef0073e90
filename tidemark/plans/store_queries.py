"""Queries that write, read back and keep what is stored: recordings, the spool, batches, backups, migrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import monitor as mon
from tidemark.plans.monitor_queries import BREACH, breaches
from tidemark.plans.registry import query
from tidemark.sources import recordings, spool
from tidemark.sources.storage import Tables, entries, scratch
from tidemark.sources.tables import table
from tidemark.streaming import sessions

FRAME = "event_id || ' ' || event_type || ' ' || props"


@query("snk01_recordings", f"SELECT event_id AS seq, {FRAME} AS frame, true AS anonymised FROM events")
def _(spark, sf_dir):
    """Events written as recordings; src02 reads such files."""
    e = table(spark, sf_dir, "events")
    at = scratch(spark)
    recordings.write(e.select(F.col("event_id").alias("seq"), F.encode(F.concat_ws(" ", "event_id", "event_type", "props"), "UTF-8").alias("frame")), at, 42, True)
    text = F.decode("frame", "UTF-8")
    return recordings.read(spark, at).select(F.substring_index(text, " ", 1).cast("long").alias("seq"), text.alias("frame"), "anonymised")


@query("src02_recorded_frames", "SELECT count(*) AS n, count(*) - 1 AS last, sum(strlen(text)) AS bytes, 7 AS created_ns FROM benchmark")
def _(spark, sf_dir):
    """Frames of one recording are numbered from 0 in the order in which they were written."""
    at = scratch(spark)
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq"), F.encode("text", "UTF-8").alias("frame"))
    recordings.write(b.coalesce(1), at, 7, False)
    return recordings.read(spark, at).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"), F.sum(F.length("frame")).alias("bytes"), F.max("created_ns").alias("created_ns"))


SPOOLED = "CASE WHEN item_id % 5 = 0 THEN '  ' ELSE text END"
KIND = "CASE WHEN item_id % 7 = 3 THEN 'image/png' ELSE 'text/plain' END"


def spooled(spark, sf_dir) -> str:
    """The benchmark's items as files, one each; some are blank or no text."""
    at = scratch(spark)
    b = table(spark, sf_dir, "benchmark").selectExpr("cast(item_id as string) as doc_id", "'u' as url", f"{SPOOLED} as text", f"{KIND} as content_type")
    b.write.option("maxRecordsPerFile", 1).json(at)
    return at


@query("src03_spooled_documents", f"SELECT item_id::VARCHAR AS doc_id, CASE WHEN item_id % 5 = 0 THEN 'no text' WHEN item_id % 7 = 3 THEN 'not text' END AS reason FROM benchmark")
def _(spark, sf_dir):
    return spool.read(spark, spooled(spark, sf_dir)).select("doc_id", "reason")


@query("src04_spool_watch", "SELECT item_id::VARCHAR AS doc_id, CASE WHEN item_id % 5 = 0 OR item_id % 7 = 3 THEN 'left' ELSE 'taken' END AS place FROM benchmark")
def _(spark, sf_dir):
    """Accepted files are in the table and gone from the folder; refused ones are still there."""
    at, to = spooled(spark, sf_dir), scratch(spark)
    spool.ingest(spark, at, to, scratch(spark), files=100, once=True).awaitTermination()
    taken = spark.read.parquet(to).select("doc_id", F.lit("taken").alias("place"))
    return taken.unionAll(spool.read(spark, at).select("doc_id", F.lit("left").alias("place")))


@query("snk02_whole_batches", "SELECT event_type, count(*) AS n, sum((event_id % 2)::BIGINT)::BIGINT AS odd FROM events WHERE event_id % 4 <> 3 GROUP BY event_type")
def _(spark, sf_dir):
    """Two tables in four batches: one is run twice, one has no mark and does not show."""
    e, root = table(spark, sf_dir, "events"), scratch(spark)
    make = {"all": lambda b: b.select("event_id", "event_type"), "odd": lambda b: b.where("event_id % 2 = 1").select("event_id")}
    for k in (0, 1, 1, 2):
        sessions.written_once(e.where(F.col("event_id") % 4 == k), k, root, make)
    make["all"](e.where("event_id % 4 = 3")).write.parquet(f"{root}/all/batch=3")
    odd = sessions.whole_batches(spark, root, "odd").withColumn("odd", F.lit(1))
    both = sessions.whole_batches(spark, root, "all").join(odd, "event_id", "left")
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("odd"), F.lit(0)).alias("odd"))


@query("snk05_soak_rows", f"WITH {BREACH} SELECT component, seq, metric, round(percent, 6) AS percent FROM br WHERE percent > lim")
def _(spark, sf_dir):
    """Soak rows appended twice, each file with its header."""
    at = scratch(spark)
    found = breaches(spark, sf_dir)
    for metric in ("rss_growth", "p99_drift"):
        mon.append_csv(found.where(F.col("metric") == metric), at)
    return spark.read.schema(found.schema).option("header", True).csv(at)


@query("snk06_backup_retention", "SELECT strftime(o_orderdate, '%Y-%m') AS label, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 3")
def _(spark, sf_dir):
    """Backups of the table of orders in its last five states, a month each; the newest three are kept."""
    o = table(spark, sf_dir, "orders").withColumn("label", F.date_format("o_orderdate", "yyyy-MM"))
    months = [r.label for r in o.select("label").distinct().orderBy(F.desc("label")).limit(5).collect()]
    tables, to = Tables(spark, scratch(spark)), scratch(spark)
    for month in sorted(months):
        tables.write("orders", o.where(F.col("label") == month).drop("label"))
        tables.backup(to, month, keep=3)
    label = F.element_at(F.split("_metadata.file_path", "/"), -3).alias("label")
    kept = [spark.read.parquet(f"{to}/{x}/orders").select(label) for x in entries(spark, to)]
    out = kept[0]
    for more in kept[1:]:
        out = out.unionAll(more)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("rel23_migrations", "SELECT n_nationkey, n_name, n_regionkey * 10 AS n_regionkey, 2 AS version FROM nation WHERE n_regionkey <> 4")
def _(spark, sf_dir):
    """Two steps, each run once though all are asked for twice."""
    tables = Tables(spark, scratch(spark))
    tables.write("nation", table(spark, sf_dir, "nation"))
    steps = {1: lambda t: t.write("nation", t.read("nation").where("n_regionkey <> 4")), 2: lambda t: t.write("nation", t.read("nation").withColumn("n_regionkey", F.col("n_regionkey") * 10))}
    tables.migrate({1: steps[1]})
    for _ in range(2):
        tables.migrate(steps)
    version = tables.read("migrations").agg(F.max("version").alias("version"))
    return tables.read("nation").crossJoin(version).select("n_nationkey", "n_name", "n_regionkey", "version")
