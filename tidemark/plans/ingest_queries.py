"""Queries of the ingest filter and the adapters over the given tables.

Dwell in these tables runs to hours, so the gate and the cool-down take scaled thresholds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import normal_title
from tidemark.operators import adapters, ingest
from tidemark.plans.registry import query
from tidemark.sources.tables import CHUNK_SQL, FILE_SQL, MEDIA_SQL, PROCESS_SQL, RESOURCE_SQL, TELEMETRY_SQL, chunks, file_events, media_events, process_trees, resource_samples, telemetry

HOUR_NS = 3_600_000_000_000
GATE_NS = 24 * HOUR_NS
OWN = ("app-9",)
NORMAL = r"""regexp_replace(regexp_replace({0}, '^[^\p{{L}}\p{{N}}~/.(\["''#@]+', ''), '\s+$', '')"""

KNOWN_SQL = f"""{TELEMETRY_SQL}, spans AS (
  SELECT *, coalesce(sum(CASE WHEN kind = 'Closed' THEN 1 ELSE 0 END) OVER (PARTITION BY toplevel_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span
  FROM tel WHERE NOT (kind = 'Opened' AND app_id = 'app-9')), known AS (
  SELECT seq, t_ns, toplevel_id, span, kind, active,
    last_value(app_id IGNORE NULLS) OVER upto AS app_id, last_value(title IGNORE NULLS) OVER upto AS title,
    last_value(title IGNORE NULLS) OVER (PARTITION BY toplevel_id, span ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_title,
    last_value(pid IGNORE NULLS) OVER upto AS pid
  FROM (SELECT *, sum(CASE WHEN kind = 'Opened' THEN 1 ELSE 0 END) OVER (PARTITION BY toplevel_id, span ORDER BY seq ROWS UNBOUNDED PRECEDING) AS opened FROM spans) WHERE opened > 0
  WINDOW upto AS (PARTITION BY toplevel_id, span ORDER BY seq ROWS UNBOUNDED PRECEDING))"""

TOUCH_SQL = f"""{KNOWN_SQL}, marks AS (
  SELECT *, CASE WHEN kind = 'StateChanged' THEN CASE WHEN active THEN 'A' ELSE 'D' END WHEN kind = 'Closed' THEN 'D'
    WHEN kind = 'TitleChanged' AND coalesce({NORMAL.format('title')}, '') <> coalesce({NORMAL.format('old_title')}, '') THEN 'T' END AS mark FROM known), foci AS (
  SELECT *, last_value(CASE WHEN mark <> 'T' THEN mark END IGNORE NULLS) OVER (PARTITION BY toplevel_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS focus
  FROM marks WHERE mark IS NOT NULL), touch AS (
  SELECT seq, t_ns, toplevel_id, app_id, pid, mark = 'A' AS occurrence, CASE WHEN ended THEN since END AS t_start_ns, CASE WHEN ended THEN t_ns END AS t_end_ns,
    CASE WHEN ended THEN coalesce({NORMAL.format('old_title')}, '') END AS title
  FROM (SELECT *, lag(t_ns) OVER (PARTITION BY toplevel_id ORDER BY seq) AS since, mark <> 'A' AND coalesce(focus = 'A', false) AS ended FROM foci WHERE mark <> 'T' OR focus = 'A')
  WHERE mark = 'A' OR ended), gate AS (
  SELECT *, sum(occurrence::INT) OVER w >= 3 OR sum(greatest(coalesce(t_end_ns - t_start_ns, 0), 0)) OVER w > {GATE_NS}::BIGINT AS promoted FROM touch
  WINDOW w AS (PARTITION BY app_id ORDER BY seq ROWS UNBOUNDED PRECEDING))"""

ROOTS_SQL = f"""{PROCESS_SQL}, latest AS (SELECT root_pid, max(seq) AS seq FROM proc GROUP BY root_pid),
  roots AS (SELECT pid, arg_max(root_pid, seq) AS root_pid FROM proc SEMI JOIN latest USING (root_pid, seq) GROUP BY pid)"""

FOCUS_SQL = f"""{TOUCH_SQL}, {ROOTS_SQL}, focus AS (
  SELECT seq AS id, app_id, title, coalesce(g.pid, 0) AS pid, CASE WHEN g.pid IS NULL THEN 0 ELSE coalesce(r.root_pid, g.pid) END AS root_pid, t_start_ns, t_end_ns, greatest(t_end_ns - t_start_ns, 0) // 1000000 AS dwell_ms
  FROM gate g LEFT JOIN roots r ON r.pid = g.pid WHERE promoted AND t_end_ns IS NOT NULL)"""


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.segments(ingest.attributed(telemetry(spark, sf_dir), OWN))


def focus_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.focus_rows(ingest.gated(touches(spark, sf_dir), "app_id", dwell_ns=GATE_NS), ingest.pid_roots(process_trees(spark, sf_dir)))


@query("ing01_pid_collapse", f"WITH {ROOTS_SQL} SELECT s_suppkey + 1000000 AS pid, coalesce(r.root_pid, s_suppkey + 1000000) AS root_pid FROM supplier LEFT JOIN roots r ON r.pid = s_suppkey + 1000000 UNION ALL SELECT c_custkey, coalesce(r.root_pid, c_custkey) FROM customer LEFT JOIN roots r ON r.pid = c_custkey")
def _(spark, sf_dir):
    s, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "customer"))
    pids = s.select((F.col("s_suppkey") + 1_000_000).alias("pid")).unionAll(c.select(F.col("c_custkey").alias("pid")))
    return ingest.collapse(pids, ingest.pid_roots(process_trees(spark, sf_dir)))


@query("ing02_self_observation", f"WITH {PROCESS_SQL} SELECT seq, coalesce(max(CASE WHEN pid = root_pid THEN comm END), '') AS root_comm FROM proc GROUP BY seq HAVING NOT starts_with(root_comm, 'shell-3')")
def _(spark, sf_dir):
    t = process_trees(spark, sf_dir).withColumn("root_comm", ingest.root_comm(F.col("processes"), F.col("root_pid")))
    return t.where(~ingest.self_observed(F.col("root_comm"), (), "shell-3")).select("seq", "root_comm")


@query("ing03_window_attribution", f"WITH {KNOWN_SQL} SELECT seq, toplevel_id, kind, app_id, title, old_title, pid FROM known")
def _(spark, sf_dir):
    return ingest.attributed(telemetry(spark, sf_dir), OWN).select("seq", "toplevel_id", "kind", "app_id", "title", "old_title", "pid")


@query("ing04_dwell_segments", f"WITH {TOUCH_SQL} SELECT seq, toplevel_id, app_id, t_start_ns, t_end_ns, t_end_ns - t_start_ns AS dwell_ns FROM touch WHERE t_end_ns IS NOT NULL")
def _(spark, sf_dir):
    t = touches(spark, sf_dir).where("t_end_ns IS NOT NULL")
    return t.select("seq", "toplevel_id", "app_id", "t_start_ns", "t_end_ns", (F.col("t_end_ns") - F.col("t_start_ns")).alias("dwell_ns"))


@query("ing05_segment_titles", f"WITH {TOUCH_SQL} SELECT title, count(*) AS n, sum(t_end_ns - t_start_ns)::BIGINT AS dwell_ns FROM touch WHERE t_end_ns IS NOT NULL GROUP BY title")
def _(spark, sf_dir):
    t = touches(spark, sf_dir).where("t_end_ns IS NOT NULL")
    return t.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("t_end_ns") - F.col("t_start_ns")).alias("dwell_ns"))


@query("ing06_promotion_gate", f"WITH {TOUCH_SQL} SELECT seq, app_id, promoted FROM gate")
def _(spark, sf_dir):
    return ingest.gated(touches(spark, sf_dir), "app_id", dwell_ns=GATE_NS).select("seq", "app_id", "promoted")


@query("ing07_gate_keys", f"WITH {PROCESS_SQL}, {FILE_SQL} SELECT key, count(*) AS n FROM (SELECT DISTINCT seq, CASE WHEN root_known THEN 'proc:' || root_pid END AS key FROM proc UNION ALL SELECT seq, 'file:' || watch_label FROM files) GROUP BY key")
def _(spark, sf_dir):
    none, root = F.lit(None).cast("string"), F.col("root_pid")
    a = process_trees(spark, sf_dir).select(ingest.gate_key(F.lit("proc_tree"), none, root, F.col("root_known"), none).alias("key"))
    b = file_events(spark, sf_dir).select(ingest.gate_key(F.lit("file"), none, none, F.lit(False), F.col("watch_label")).alias("key"))
    return a.unionAll(b).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


EVICT_NOW, EVICT_TTL = 1_800_000_000_000_000_000, 0


@query("ing08_state_bound", "WITH c AS (SELECT o_custkey AS key, max(o_orderkey) AS last_ns, count(*) >= 12 AS promoted FROM orders GROUP BY 1), m AS (SELECT count(*) AS n, max(last_ns) - 5000 AS now FROM c), fresh AS (SELECT key, last_ns, promoted FROM c, m WHERE promoted OR last_ns >= (SELECT max(o_orderkey) // 2 FROM orders) OR n <= 64) SELECT * FROM fresh QUALIFY row_number() OVER (ORDER BY promoted DESC, last_ns DESC, key) <= 48 OR count(*) OVER () <= 64")
def _(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c = o.groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("last_ns"), (F.count(F.lit(1)) >= 12).alias("promoted"))
    now = o.agg(F.max("o_orderkey")).first()[0] or 0
    return ingest.evicted(c, now, most=64, ttl_ns=now - now // 2)


@query("ing09_chunk_cooldown", f"""WITH RECURSIVE {FILE_SQL}, ev AS (SELECT watch_label AS text, t_ns FROM files), kept AS (
  SELECT text, min(t_ns) AS t_ns FROM ev GROUP BY text UNION ALL SELECT k.text, (SELECT min(e.t_ns) FROM ev e WHERE e.text = k.text AND e.t_ns - k.t_ns > 600000000000) FROM kept k WHERE k.t_ns IS NOT NULL)
  SELECT text, t_ns FROM kept WHERE t_ns IS NOT NULL""")
def _(spark, sf_dir):
    return ingest.cooled(file_events(spark, sf_dir).select(F.col("watch_label").alias("text"), "t_ns"), "text", "t_ns")


@query("ing10_normal_titles", f"WITH {TELEMETRY_SQL} SELECT title, {NORMAL.format('title')} AS normal, count(*) AS n FROM tel WHERE title IS NOT NULL GROUP BY ALL")
def _(spark, sf_dir):
    t = telemetry(spark, sf_dir).where("title IS NOT NULL")
    return t.groupBy("title", normal_title(F.col("title")).alias("normal")).agg(F.count(F.lit(1)).alias("n"))


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all payloads in one table; what a payload has not is null."""
    t = telemetry(spark, sf_dir).withColumn("payload", F.lit("window"))
    p = process_trees(spark, sf_dir).select(F.lit("proc_tree").alias("payload"), "seq", "t_ns", F.when(F.col("root_known"), F.col("root_pid").cast("string")).alias("key"), ingest.root_comm(F.col("processes"), F.col("root_pid")).alias("comm"))
    f = file_events(spark, sf_dir).withColumn("payload", F.lit("file")).withColumn("key", F.col("watch_label"))
    m = media_events(spark, sf_dir).withColumn("payload", F.lit("media"))
    i = telemetry(spark, sf_dir).where("kind = 'StateChanged'").select(F.lit("idle").alias("payload"), "seq", "t_ns", "active")
    r = resource_samples(spark, sf_dir).withColumn("payload", F.lit("resource"))
    out = t
    for more in (p, f, m, i, r):
        out = out.unionByName(more, allowMissingColumns=True)
    return out


KEYED_SQL = """keyed AS (SELECT payload, seq, count(*) OVER (PARTITION BY payload, key ORDER BY seq) >= 3 AS promoted FROM (SELECT 'file' AS payload, seq, watch_label AS key FROM files
  UNION ALL SELECT 'proc_tree', seq, root_pid::VARCHAR FROM trees WHERE root_known AND comm <> 'app-9' AND NOT starts_with(comm, 'shell-3')))"""
TREES_SQL = "trees AS (SELECT seq, root_pid, root_known, coalesce(max(CASE WHEN pid = root_pid THEN comm END), '') AS comm FROM proc GROUP BY seq, root_pid, root_known)"


@query("ing11_outcomes", f"""WITH {TOUCH_SQL}, {PROCESS_SQL}, {TREES_SQL}, {FILE_SQL}, {MEDIA_SQL}, {KEYED_SQL}, tagged AS (
  SELECT 'window' AS payload, t.seq, CASE WHEN t.kind = 'Opened' AND t.app_id = 'app-9' THEN 'Excluded' WHEN g.promoted THEN 'Promoted' WHEN NOT g.promoted THEN 'NotYetPromoted' ELSE 'NotApplicable' END AS outcome FROM tel t LEFT JOIN gate g USING (seq)
  UNION ALL SELECT 'proc_tree', t.seq, CASE WHEN t.comm = 'app-9' OR starts_with(t.comm, 'shell-3') THEN 'Excluded' WHEN k.promoted THEN 'Promoted' WHEN NOT k.promoted THEN 'NotYetPromoted' ELSE 'NotApplicable' END FROM trees t LEFT JOIN keyed k ON k.payload = 'proc_tree' AND k.seq = t.seq
  UNION ALL SELECT 'file', f.seq, CASE WHEN k.promoted THEN 'Promoted' ELSE 'NotYetPromoted' END FROM files f JOIN keyed k ON k.payload = 'file' AND k.seq = f.seq
  UNION ALL SELECT 'media', seq, 'Demoted' FROM media UNION ALL SELECT 'idle', seq, 'NotApplicable' FROM tel WHERE kind = 'StateChanged' UNION ALL SELECT 'resource', event_id, 'NotApplicable' FROM events)
  SELECT payload, seq, outcome FROM tagged""")
def _(spark, sf_dir):
    return ingest.outcomes(all_events(spark, sf_dir), OWN, "shell-3", GATE_NS)


COUNTER_SQL = "count(*) AS count, arg_min(t_ns, seq) AS first_ns, arg_max(t_ns, seq) AS last_ns"
BANDS = """unnest(['sample', 'cpu:' || CASE WHEN isnan(cpu) THEN 'unknown' WHEN cpu < 10 THEN 'idle' WHEN cpu < 40 THEN 'light' WHEN cpu < 80 THEN 'busy' ELSE 'saturated' END,
  'mem:' || CASE WHEN mem_total = 0 THEN 'unknown' WHEN mem_used / mem_total * 100 < 50 THEN 'low' WHEN mem_used / mem_total * 100 < 85 THEN 'high' ELSE 'pressure' END])"""
CHURN_SQL = r"""CASE WHEN regexp_matches(parse_filename(path), '(~|\.swp|\.swx|\.tmp|\.lock)$|^\.#|^\..*\.kate-swp$') THEN true WHEN parse_filename(path) IN ('COMMIT_EDITMSG', 'MERGE_MSG', 'TAG_EDITMSG', 'SQUASH_MSG') THEN false
  ELSE len(list_intersect(string_split(path, '/'), ['.git', 'target', 'node_modules', '__pycache__', '.cache', '.venv', '.mypy_cache', '.pytest_cache'])) > 0 END"""
LABEL_SQL = "CASE watch_label WHEN 'git' THEN 'git_activity' WHEN 'notes' THEN 'notes' WHEN 'calendar' THEN 'calendar' END"


@query("adp01_dispatch", f"""WITH {TELEMETRY_SQL}, {FILE_SQL}, {MEDIA_SQL}, {RESOURCE_SQL}, k AS (SELECT 'app_lifecycle' AS domain, app_id AS key, seq, t_ns FROM tel WHERE kind = 'Opened'
  UNION ALL SELECT 'idle_presence', CASE WHEN active THEN 'active' ELSE 'idle' END, seq, t_ns FROM tel WHERE kind = 'StateChanged' UNION ALL SELECT 'system_resource', {BANDS}, seq, t_ns FROM res
  UNION ALL SELECT 'media_playback', title, seq, t_ns FROM media WHERE title <> '' UNION ALL SELECT {LABEL_SQL}, path, seq, t_ns FROM files WHERE {LABEL_SQL} IS NOT NULL AND NOT {CHURN_SQL})
  SELECT domain, key, {COUNTER_SQL} FROM k GROUP BY domain, key""")
def _(spark, sf_dir):
    return adapters.dispatched(all_events(spark, sf_dir))


@query("adp02_app_lifecycle", f"WITH {TELEMETRY_SQL} SELECT 'app_lifecycle' AS domain, app_id AS key, {COUNTER_SQL} FROM tel WHERE kind = 'Opened' GROUP BY app_id")
def _(spark, sf_dir):
    return adapters.counters(telemetry(spark, sf_dir).where("kind = 'Opened'"), F.col("app_id"), "app_lifecycle")


@query("adp03_focus_history", f"WITH {FOCUS_SQL} SELECT * FROM focus")
def _(spark, sf_dir):
    return focus_history(spark, sf_dir)


@query("adp03_focus_chunks", f"WITH {FOCUS_SQL} SELECT app_id || ': ' || title AS text, t_end_ns AS t_ns, 'window_focus' AS domain FROM focus WHERE title <> ''")
def _(spark, sf_dir):
    return adapters.focus_chunks(focus_history(spark, sf_dir))


BUILD_SQL = f"""{PROCESS_SQL}, jobs AS (SELECT seq, t_ns, coalesce(max(CASE WHEN pid = root_pid THEN comm END), '') AS root_comm FROM proc GROUP BY seq, t_ns HAVING bool_or(comm = 'make'))"""


@query("adp04_build_jobs", f"WITH {BUILD_SQL} SELECT 'build_job' AS domain, root_comm AS key, {COUNTER_SQL} FROM jobs GROUP BY root_comm")
def _(spark, sf_dir):
    return adapters.counters(adapters.build_jobs(process_trees(spark, sf_dir)), F.col("root_comm"), "build_job")


@query("adp04_build_chunks", f"""WITH RECURSIVE {BUILD_SQL}, ev AS (SELECT DISTINCT 'build job under ' || root_comm AS text, t_ns FROM jobs), kept AS (
  SELECT text, min(t_ns) AS t_ns FROM ev GROUP BY text UNION ALL SELECT k.text, (SELECT min(e.t_ns) FROM ev e WHERE e.text = k.text AND e.t_ns - k.t_ns > 2592000000000000) FROM kept k WHERE k.t_ns IS NOT NULL)
  SELECT text, t_ns FROM kept WHERE t_ns IS NOT NULL""")
def _(spark, sf_dir):
    return adapters.build_chunks(adapters.build_jobs(process_trees(spark, sf_dir)), 30 * 24 * HOUR_NS)


@query("adp04_process_entities", f"WITH {PROCESS_SQL}, t AS (SELECT DISTINCT seq, t_ns, root_pid FROM proc WHERE root_known) SELECT 'process_activity' AS domain, 'proc:' || root_pid AS key, {COUNTER_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY root_pid ORDER BY seq) AS k FROM t) WHERE k >= 3 GROUP BY root_pid")
def _(spark, sf_dir):
    t = process_trees(spark, sf_dir).where("root_known").withColumn("occurrence", F.lit(True)).withColumn("t_start_ns", F.lit(None).cast("long")).withColumn("t_end_ns", F.lit(None).cast("long"))
    return adapters.counters(ingest.gated(t, "root_pid").where("promoted"), F.concat(F.lit("proc:"), "root_pid"), "process_activity")


@query("adp05_churn_paths", f"WITH {FILE_SQL} SELECT path, {CHURN_SQL} AS churn FROM files")
def _(spark, sf_dir):
    return file_events(spark, sf_dir).select("path", adapters.churn(F.col("path")).alias("churn"))


@query("adp06_file_activity", f"WITH {FILE_SQL} SELECT domain, path AS key, count(*) AS count, arg_min(t_ns, seq) AS first_ns, arg_max(t_ns, seq) AS last_ns FROM (SELECT *, {LABEL_SQL} AS domain, row_number() OVER (PARTITION BY watch_label ORDER BY seq) AS k FROM files) WHERE k >= 3 AND domain IS NOT NULL AND NOT {CHURN_SQL} GROUP BY domain, path")
def _(spark, sf_dir):
    f = file_events(spark, sf_dir).withColumn("occurrence", F.lit(True)).withColumn("t_start_ns", F.lit(None).cast("long")).withColumn("t_end_ns", F.lit(None).cast("long"))
    rows = adapters.file_activity(ingest.gated(f, "watch_label").where("promoted"))
    return rows.groupBy("domain", F.col("path").alias("key")).agg(F.count(F.lit(1)).alias("count"), F.min_by("t_ns", "seq").alias("first_ns"), F.max_by("t_ns", "seq").alias("last_ns"))


@query("adp07_resource_bands", f"""WITH {RESOURCE_SQL}, k AS (SELECT seq, t_ns, {BANDS} AS key FROM res)
  SELECT 'system_resource' AS domain, key, {COUNTER_SQL} FROM k GROUP BY key""")
def _(spark, sf_dir):
    return adapters.resource_counts(resource_samples(spark, sf_dir))


@query("adp08_media_chunks", rf"""WITH {MEDIA_SQL}, f AS (SELECT title, arg_min(player, seq) AS player, arg_min(artist, seq) AS artist, arg_min(t_ns, seq) AS t_ns, arg_max(t_ns, seq) AS last_seen_ns FROM media WHERE status = 'Playing' AND title <> '' GROUP BY title),
  g AS (SELECT *, string_split(regexp_replace(player, '^(org\.mpris\.MediaPlayer2\.)+', ''), '.')[1] AS name FROM f)
  SELECT title, name || ' played "' || title || '"' || CASE WHEN artist = '' THEN '' WHEN name IN ('brave', 'firefox', 'chrome') THEN ' (channel: ' || artist || ')' ELSE ' by ' || artist END AS text, t_ns, last_seen_ns FROM g""")
def _(spark, sf_dir):
    return adapters.media_chunks(media_events(spark, sf_dir))


@query("adp09_idle_counter", f"WITH {TELEMETRY_SQL} SELECT 'idle_presence' AS domain, CASE WHEN active THEN 'active' ELSE 'idle' END AS key, {COUNTER_SQL} FROM tel WHERE kind = 'StateChanged' GROUP BY 2")
def _(spark, sf_dir):
    t = telemetry(spark, sf_dir).where("kind = 'StateChanged'")
    return adapters.counters(t, F.when(F.col("active"), "active").otherwise("idle"), "idle_presence")


@query("adp10_families", f"WITH {CHUNK_SQL} SELECT CASE WHEN domain = 'window_focus' THEN 'attention' WHEN domain = 'git_activity' THEN 'work' WHEN domain = 'notes' THEN 'knowledge' WHEN domain = 'media_playback' THEN 'system' ELSE 'external' END AS family, count(*) AS n FROM chunks GROUP BY 1")
def _(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy(adapters.family(F.col("domain")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("adp11_external_documents", "WITH d AS (SELECT page_id // 3 AS doc_id, CASE WHEN page_id % 4 = 0 THEN '' ELSE url END AS url, html AS text, page_id AS t_ns FROM pages) SELECT doc_id, CASE WHEN url = '' THEN text ELSE url || chr(10) || text END AS text, 1::BIGINT AS taint, t_ns FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY t_ns DESC) = 1")
def _(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    d = p.select(F.floor(F.col("page_id") / 3).alias("doc_id"), F.when(F.col("page_id") % 4 == 0, "").otherwise(F.col("url")).alias("url"), F.col("html").alias("text"), F.col("page_id").alias("t_ns"))
    return adapters.latest_documents(d)
