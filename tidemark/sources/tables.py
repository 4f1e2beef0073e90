"""The given tables seen as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NS = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window events (seq, t_ns, toplevel_id, kind, app_id, title, pid, active, value). app_id and
    pid are known on Opened, title on Opened and TitleChanged, active on StateChanged."""
    e = table(spark, sf_dir, "events")
    kind = (
        F.when(F.col("event_type") == "signup", "Opened").when(F.col("event_type") == "click", "TitleChanged")
        .when(F.col("event_type") == "error", "Closed").otherwise("StateChanged")
    )
    title = F.concat(F.when(F.col("event_id") % 3 == 0, "* ").otherwise(""), F.lit("page "), F.get_json_object("props", "$.k"))
    return e.select(
        F.col("event_id").alias("seq"), (micros(F.col("ts")) * 1000).alias("t_ns"), F.col("user_id").alias("toplevel_id"), kind.alias("kind"),
        F.when(kind == "Opened", F.concat(F.lit("app-"), F.col("user_id") % 10)).alias("app_id"),
        F.when(kind.isin("Opened", "TitleChanged"), title).alias("title"),
        F.when((kind == "Opened") & (F.col("user_id") % 4 != 0), F.col("user_id") + 1000).alias("pid"),
        F.when(kind == "StateChanged", F.col("event_type") == "view").alias("active"),
        "value", "event_type",
    )


TELEMETRY_SQL = """tel AS (
  SELECT event_id AS seq, epoch_us(ts) * 1000 AS t_ns, user_id AS toplevel_id,
    CASE event_type WHEN 'signup' THEN 'Opened' WHEN 'click' THEN 'TitleChanged' WHEN 'error' THEN 'Closed' ELSE 'StateChanged' END AS kind,
    CASE WHEN event_type = 'signup' THEN 'app-' || (user_id % 10) END AS app_id,
    CASE WHEN event_type IN ('signup', 'click') THEN (CASE WHEN event_id % 3 = 0 THEN '* ' ELSE '' END) || 'page ' || json_extract_string(props, '$.k') END AS title,
    CASE WHEN event_type = 'signup' AND user_id % 4 <> 0 THEN user_id + 1000 END AS pid,
    CASE WHEN event_type IN ('view', 'purchase') THEN event_type = 'view' END AS active,
    value, event_type
  FROM events)"""


def process_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process snapshots (seq, t_ns, root_pid, root_known, processes): an order is a snapshot of its
    customer's tree, its lines the processes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    comm = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("shell-"), F.col("o_custkey") % 7)).when(F.col("l_returnflag") == "R", "make").otherwise(F.concat(F.lit("tool-"), F.col("l_suppkey") % 5))
    pid = F.when(F.col("l_linenumber") == 1, F.col("o_custkey")).otherwise(F.lit(1_000_000) + F.col("l_suppkey"))
    rows = line.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("o_orderkey", "o_custkey", "o_orderdate", F.struct(pid.cast("long").alias("pid"), F.when(F.col("l_linenumber") == 1, F.lit(1).cast("long")).otherwise(F.col("o_custkey")).alias("ppid"), comm.alias("comm")).alias("p"))
    snaps = rows.groupBy("o_orderkey", "o_custkey", "o_orderdate").agg(F.array_sort(F.collect_set("p")).alias("processes"))
    return snaps.select(
        F.col("o_orderkey").alias("seq"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("t_ns"),
        F.col("o_custkey").alias("root_pid"), (F.col("o_custkey") % 11 != 0).alias("root_known"), "processes",
    )


PROCESS_SQL = """proc AS (
  SELECT DISTINCT o_orderkey AS seq, epoch_us(o_orderdate) * 1000 AS t_ns, o_custkey AS root_pid, o_custkey % 11 <> 0 AS root_known,
    CASE WHEN l_linenumber = 1 THEN o_custkey ELSE 1000000 + l_suppkey END AS pid,
    CASE WHEN l_linenumber = 1 THEN 1 ELSE o_custkey END AS ppid,
    CASE WHEN l_linenumber = 1 THEN 'shell-' || (o_custkey % 7) WHEN l_returnflag = 'R' THEN 'make' ELSE 'tool-' || (l_suppkey % 5) END AS comm
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File activity (seq, t_ns, path, watch_label): a page's path, with files that tools write."""
    p = table(spark, sf_dir, "pages")
    label = F.element_at(F.array(*map(F.lit, ("git", "notes", "calendar", "other"))), (F.col("page_id") % 4 + 1).cast("int"))
    tail = F.element_at(F.array(*map(F.lit, ("", "/.git/index", "/.git/COMMIT_EDITMSG", "/target/a.o", "/draft.swp", "/note.md~", "/src/main.rs"))), (F.col("page_id") % 7 + 1).cast("int"))
    path = F.concat(F.regexp_replace("url", "^[a-z]+:/", ""), tail)
    return p.select(F.col("page_id").alias("seq"), (F.col("page_id") % 50 * 90 * NS).alias("t_ns"), path.alias("path"), label.alias("watch_label"))


FILE_SQL = """files AS (
  SELECT page_id AS seq, page_id % 50 * 90 * 1000000000::BIGINT AS t_ns,
    regexp_replace(url, '^[a-z]+:/', '') || (['', '/.git/index', '/.git/COMMIT_EDITMSG', '/target/a.o', '/draft.swp', '/note.md~', '/src/main.rs'])[page_id % 7 + 1] AS path,
    (['git', 'notes', 'calendar', 'other'])[page_id % 4 + 1] AS watch_label
  FROM pages)"""


def media_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media snapshots (seq, t_ns, player, status, title, artist) from conversation turns."""
    c = table(spark, sf_dir, "conversations")
    pick = lambda *v, by: F.element_at(F.array(*map(F.lit, v)), (by + 1).cast("int"))
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), ((F.col("conv_id") * 1000 + F.col("turn")) * 60 * NS).alias("t_ns"),
        pick("org.mpris.MediaPlayer2.brave.instance1", "org.mpris.MediaPlayer2.vlc", "spotify", by=F.col("conv_id") % 3).alias("player"),
        F.when(F.col("role") == "user", "Playing").otherwise("Paused").alias("status"),
        F.when(F.col("turn") % 5 == 4, "").otherwise(F.col("text")).alias("title"),
        pick("", "Some Band", "A Channel", by=(F.col("conv_id") + F.col("turn")) % 3).alias("artist"),
    )


MEDIA_SQL = """media AS (
  SELECT conv_id * 1000 + turn AS seq, (conv_id * 1000 + turn) * 60 * 1000000000::BIGINT AS t_ns,
    (['org.mpris.MediaPlayer2.brave.instance1', 'org.mpris.MediaPlayer2.vlc', 'spotify'])[conv_id % 3 + 1] AS player,
    CASE WHEN role = 'user' THEN 'Playing' ELSE 'Paused' END AS status,
    CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS title,
    (['', 'Some Band', 'A Channel'])[(conv_id + turn) % 3 + 1] AS artist
  FROM conversations)"""


def resource_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, t_ns, cpu, mem_used, mem_total): event values as load; some are unknown."""
    e = table(spark, sf_dir, "events")
    cpu = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.least(F.col("value") / 5, F.lit(100.0)))
    return e.select(F.col("event_id").alias("seq"), (micros(F.col("ts")) * 1000).alias("t_ns"), cpu.alias("cpu"), (F.col("event_id") % 17).alias("mem_used"), F.when(F.col("event_id") % 89 == 0, 0).otherwise(16).cast("long").alias("mem_total"))


RESOURCE_SQL = """res AS (
  SELECT event_id AS seq, epoch_us(ts) * 1000 AS t_ns, CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE ELSE least(value / 5, 100.0) END AS cpu,
    event_id % 17 AS mem_used, CASE WHEN event_id % 89 = 0 THEN 0 ELSE 16 END AS mem_total
  FROM events)"""

DOMAINS = ("window_focus", "notes", "git_activity", "media_playback", "external_documents")


def domain(doc_id: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (doc_id % 5 + 1).cast("int"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text chunks (chunk_id, entity_id, text, domain, taint, t_ns) from documents and labels."""
    d, known = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    of = domain(F.col("doc_id"))
    taint = F.coalesce(F.col("toxic"), F.lit(0)) + F.when(F.col("quality") == 0, 4).otherwise(0)
    t_ns = (F.col("doc_id") * 37 % 5000) * 60 * NS
    return d.join(known, "doc_id", "left").select(
        F.concat_ws("-", of, (F.col("doc_id") % 200).cast("string"), t_ns.cast("string")).alias("chunk_id"), "doc_id", (F.col("doc_id") % 200).alias("entity_id"),
        F.coalesce("text", F.lit("")).alias("text"), of.alias("domain"), taint.cast("long").alias("taint"), t_ns.alias("t_ns"),
    )


CHUNK_SQL = """chunks AS (
  SELECT domain || '-' || entity_id || '-' || t_ns AS chunk_id, * FROM (
    SELECT doc_id, doc_id % 200 AS entity_id, coalesce(text, '') AS text,
      (['window_focus', 'notes', 'git_activity', 'media_playback', 'external_documents'])[doc_id % 5 + 1] AS domain,
      (coalesce(toxic, 0) + CASE WHEN quality = 0 THEN 4 ELSE 0 END)::BIGINT AS taint, (doc_id * 37 % 5000) * 60 * 1000000000::BIGINT AS t_ns
    FROM documents LEFT JOIN labels USING (doc_id)))"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, domain, kind, label, taint, created_ns, last_seen_ns, permanent): a customer who ordered is
    an entity of their segment, seen from the first to the last order."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    seen = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    ns = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 1000
    return seen.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("id"), domain(F.col("c_custkey")).alias("domain"), F.lower("c_mktsegment").alias("kind"),
        F.concat_ws(" ", F.lit("label"), (F.floor(F.col("c_custkey") / 2)).cast("string")).alias("label"), (F.col("c_custkey") % 4).alias("taint"),
        ns("a").alias("created_ns"), ns("b").alias("last_seen_ns"), (F.col("c_custkey") % 6 == 0).alias("permanent"),
    )


ENTITY_SQL = """ent AS (
  SELECT c_custkey AS id, (['window_focus', 'notes', 'git_activity', 'media_playback', 'external_documents'])[c_custkey % 5 + 1] AS domain, lower(c_mktsegment) AS kind,
    'label ' || (c_custkey // 2) AS label, c_custkey % 4 AS taint, epoch_us(a) * 1000 AS created_ns, epoch_us(b) * 1000 AS last_seen_ns, c_custkey % 6 = 0 AS permanent
  FROM (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY o_custkey) JOIN customer ON o_custkey = c_custkey)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind, weight, reinforced_ns, hypothesis): an order ties its customer to the next one."""
    o = table(spark, sf_dir, "orders")
    n = table(spark, sf_dir, "customer").agg(F.max("c_custkey").alias("n"))
    e = o.crossJoin(F.broadcast(n)).select(
        F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 7919 % F.col("n") + 1).alias("dst"), F.when(F.col("o_orderkey") % 3 == 0, "mentions").otherwise("co_occurs").alias("kind"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("reinforced_ns"), (F.col("o_orderkey") % 2 == 0).alias("hypothesis"), (F.col("o_orderkey") % 10).alias("w"),
    )
    return e.groupBy("src", "dst", "kind").agg((F.sum("w") / 8).alias("weight"), F.max("reinforced_ns").alias("reinforced_ns"), F.bool_and("hypothesis").alias("hypothesis"))


EDGE_SQL = """edge AS (
  SELECT src, dst, kind, sum(w) / 8 AS weight, max(reinforced_ns) AS reinforced_ns, bool_and(hypothesis) AS hypothesis FROM (
    SELECT o_custkey AS src, o_orderkey * 7919 % (SELECT max(c_custkey) FROM customer) + 1 AS dst, CASE WHEN o_orderkey % 3 = 0 THEN 'mentions' ELSE 'co_occurs' END AS kind,
      epoch_us(o_orderdate) * 1000 AS reinforced_ns, o_orderkey % 2 = 0 AS hypothesis, o_orderkey % 10 AS w FROM orders)
  GROUP BY src, dst, kind)"""
