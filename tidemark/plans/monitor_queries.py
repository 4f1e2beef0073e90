"""Queries of monitoring, privacy, sensors and streams' data parts over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import privacy as priv
from tidemark.operators import monitor as mon
from tidemark.operators import privacy, sensors
from tidemark.plans.registry import query
from tidemark.sources.tables import CHUNK_SQL, MEDIA_SQL, TELEMETRY_SQL, chunks, media_events, micros, table, telemetry

BOUND = "CASE " + " ".join(f"WHEN ns <= {b}::BIGINT THEN {b}::BIGINT" for b in mon.BOUNDS[:-1]) + f" ELSE {mon.BOUNDS[-1]}::BIGINT END"
LAT = "lat AS (SELECT event_type AS component, event_id AS seq, user_id, greatest((value * 1000000)::BIGINT - 1000000, 0) AS ns FROM events)"
HIST = f"{LAT}, hist AS (SELECT component, {BOUND} AS upper_ns, count(*) AS count FROM lat GROUP BY 1, 2)"
RUN = f"{HIST}, run AS (SELECT *, sum(count) OVER (PARTITION BY component ORDER BY upper_ns ROWS UNBOUNDED PRECEDING) AS run, sum(count) OVER (PARTITION BY component) AS n FROM hist)"


def latencies(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ns = F.greatest(F.round(F.col("value") * 1_000_000).cast("long") - 1_000_000, F.lit(0))
    return e.select(F.col("event_type").alias("component"), F.col("event_id").alias("seq"), "user_id", ns.alias("ns"))


def p_sql(p):
    return f"WITH {RUN} SELECT component, min(upper_ns) FILTER (run >= greatest(ceil(n * {p}::DOUBLE)::BIGINT, 1)) AS p_ns FROM run GROUP BY component"


@query("mon01_histograms", f"WITH {HIST} SELECT * FROM hist")
def _(spark, sf_dir):
    return mon.histogram(latencies(spark, sf_dir), ["component"])


@query("mon02_p50", p_sql(0.5))
def _(spark, sf_dir):
    return mon.percentile(mon.histogram(latencies(spark, sf_dir), ["component"]), ["component"], 0.5)


@query("mon02_p99", p_sql(0.99))
def _(spark, sf_dir):
    return mon.percentile(mon.histogram(latencies(spark, sf_dir), ["component"]), ["component"], 0.99)


SCRAPE = """scrape AS (SELECT (user_id % 12)::VARCHAR AS component, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'refused' WHEN 1 THEN 'timeout' WHEN 2 THEN 'garbled' END AS failure, event_id * 7919 % 1000 + user_id % 12 * 50 AS rss, user_id % 3 * 800 AS budget, greatest((value * 1000)::BIGINT, 1) AS p99_ns FROM events),
  st AS (SELECT *, CASE WHEN failure IS NULL THEN 'OK' WHEN failure = 'refused' THEN 'DOWN' ELSE 'UNKNOWN' END AS status FROM scrape)"""
REMEMBER = f"{SCRAPE}, rem AS (SELECT * REPLACE (CASE WHEN status = 'UNKNOWN' AND max((status = 'OK')::INT) OVER (PARTITION BY component ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 'DOWN' ELSE status END AS status) FROM st)"


def scrapes(spark, sf_dir):
    e, c, i = table(spark, sf_dir, "events"), F.col("user_id") % 12, F.col("event_id")
    failure = F.when(i % 5 == 0, "refused").when(i % 5 == 1, "timeout").when(i % 5 == 2, "garbled")
    s = e.select(c.cast("string").alias("component"), i.alias("seq"), failure.alias("failure"), (i * 7919 % 1000 + c * 50).alias("rss"), (F.col("user_id") % 3 * 800).alias("budget"), F.greatest(F.round(F.col("value") * 1000).cast("long"), F.lit(1)).alias("p99_ns"))
    return s.withColumn("status", mon.scrape_status(F.col("failure")))


@query("mon03_scrape_status", f"WITH {SCRAPE} SELECT component, status, count(*) AS n FROM st GROUP BY component, status")
def _(spark, sf_dir):
    return scrapes(spark, sf_dir).groupBy("component", "status").agg(F.count(F.lit(1)).alias("n"))


@query("mon04_status_history", f"WITH {REMEMBER} SELECT component, seq, status FROM rem")
def _(spark, sf_dir):
    return mon.remembered(scrapes(spark, sf_dir)).select("component", "seq", "status")


@query("mon05_budget_alert", f"WITH {SCRAPE} SELECT component, seq, CASE WHEN status = 'OK' AND budget > 0 AND rss * 10 >= budget * 9 THEN 'DEGRADED' ELSE status END AS status FROM st")
def _(spark, sf_dir):
    return scrapes(spark, sf_dir).select("component", "seq", mon.over_budget(F.col("status"), F.col("budget"), F.col("rss")).alias("status"))


@query("mon06_latest_snapshot", f"WITH {REMEMBER} SELECT component, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(rss, seq) AS rss FROM rem GROUP BY component")
def _(spark, sf_dir):
    return mon.latest(mon.remembered(scrapes(spark, sf_dir))).select("component", "seq", "status", "rss").orderBy("component")


@query("mon07_external_memory", f"WITH {SCRAPE} SELECT component, seq, coalesce(CASE WHEN s_nationkey % 2 = 0 THEN s_suppkey * 100 END, rss) AS rss FROM st LEFT JOIN supplier ON s_suppkey::VARCHAR = component")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("component"), (F.col("s_suppkey") * 100).alias("own"))
    return scrapes(spark, sf_dir).join(own, "component", "left").select("component", "seq", F.coalesce("own", "rss").alias("rss"))


@query("mon08_soak_p99", f"""WITH {LAT}, h AS (SELECT component, user_id % 4 AS label, {BOUND} AS upper_ns, count(*) AS count FROM lat GROUP BY ALL), r AS (SELECT *, sum(count) OVER (PARTITION BY component, label ORDER BY upper_ns ROWS UNBOUNDED PRECEDING) AS run, sum(count) OVER (PARTITION BY component, label) AS n FROM h),
  p AS (SELECT component, label, min(upper_ns) FILTER (run >= greatest(ceil(n * 0.99::DOUBLE)::BIGINT, 1)) AS p FROM r GROUP BY ALL) SELECT component, coalesce(max(p), 0) AS p99_ns FROM p GROUP BY component""")
def _(spark, sf_dir):
    s = latencies(spark, sf_dir).withColumn("label", F.col("user_id") % 4)
    p = mon.percentile(mon.histogram(s, ["component", "label"]), ["component", "label"], 0.99)
    return p.groupBy("component").agg(F.coalesce(F.max("p_ns"), F.lit(0)).alias("p99_ns"))


BREACH = f"""{SCRAPE}, b AS (SELECT component, min(seq) AS s0, arg_min(rss, seq) AS r0, arg_min(p99_ns, seq) AS p0 FROM st WHERE status = 'OK' GROUP BY component),
  br AS (SELECT component, seq, 'rss_growth' AS metric, (rss - r0) / r0 * 100 AS percent, 5.0 AS lim FROM st JOIN b USING (component) WHERE status = 'OK' AND seq > s0 AND r0 > 0
    UNION ALL SELECT component, seq, 'p99_drift', (p99_ns - p0) / p0 * 100, 10.0 FROM st JOIN b USING (component) WHERE status = 'OK' AND seq > s0 AND p0 > 0)"""


def breaches(spark, sf_dir):
    return mon.breaches(scrapes(spark, sf_dir).withColumn("reachable", F.col("status") == "OK"))


@query("mon09_baselines", f"WITH {BREACH} SELECT component, s0 AS seq, r0 AS rss, p0 AS p99_ns FROM b")
def _(spark, sf_dir):
    s = scrapes(spark, sf_dir).where("status = 'OK'")
    return s.groupBy("component").agg(F.min_by(F.struct("seq", "rss", "p99_ns"), "seq").alias("s")).select("component", "s.*")


@query("mon10_breaches", f"WITH {BREACH} SELECT component, seq, metric, round(percent, 6) AS percent FROM br WHERE percent > lim")
def _(spark, sf_dir):
    return breaches(spark, sf_dir)


@query("mon11_breach_counts", f"WITH {BREACH} SELECT component, seq, string_agg(metric || '=' || round(round(percent, 6), 1)::DECIMAL(38,1) || '%', ';' ORDER BY metric DESC) AS summary FROM br WHERE percent > lim GROUP BY component, seq")
def _(spark, sf_dir):
    return mon.breach_summary(breaches(spark, sf_dir))


@query("mon12_status_rows", f"""WITH {LAT}, h AS (SELECT component, 'h' || (user_id % 4) AS label, {BOUND} AS upper_ns, count(*) AS count FROM lat GROUP BY ALL), f AS (SELECT component, min(label) AS label, sum(count)::BIGINT AS total FROM h GROUP BY component),
  r AS (SELECT h.*, sum(count) OVER (PARTITION BY component, label ORDER BY upper_ns ROWS UNBOUNDED PRECEDING) AS run, sum(count) OVER (PARTITION BY component, label) AS n FROM h)
  SELECT component, total AS requests, min(upper_ns) FILTER (run >= greatest(ceil(n * 0.5::DOUBLE)::BIGINT, 1)) AS p50_ns FROM r JOIN f USING (component, label) GROUP BY component, total""")
def _(spark, sf_dir):
    h = mon.histogram(latencies(spark, sf_dir).withColumn("label", F.concat(F.lit("h"), F.col("user_id") % 4)), ["component", "label"])
    rows = h.groupBy("component", "label").agg(F.sum("count").alias("n")).groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m"), F.min("label").alias("label"))
    total = rows.select("component", "label", F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("requests"))
    p = mon.percentile(h, ["component", "label"], 0.5)
    return total.join(p, ["component", "label"]).select("component", "requests", F.col("p_ns").alias("p50_ns"))


@query("mon13_target_merge", "SELECT n_name AS name, 'built-in' AS origin FROM nation WHERE n_nationkey < 15 UNION ALL SELECT n_name, 'configured' FROM nation WHERE n_nationkey >= 10 AND n_name NOT IN (SELECT n_name FROM nation WHERE n_nationkey < 15)")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    built = n.where("n_nationkey < 15").select(F.col("n_name").alias("name"), F.lit("built-in").alias("origin"))
    own = n.where("n_nationkey >= 10").select(F.col("n_name").alias("name"), F.lit("configured").alias("origin"))
    return built.unionAll(own.join(built, "name", "left_anti"))


@query("mon14_sensor_health", "WITH r AS (SELECT event_type AS component, user_id % 6 AS sensor, event_id AS seq, event_id % 4 = 1 AS down FROM events), e AS (SELECT component, sensor, arg_max(down, seq) AS down, sum(down::INT)::BIGINT AS errors FROM r GROUP BY ALL) SELECT component, bool_or(down) AS degraded, sum(errors)::BIGINT AS errors FROM e GROUP BY component")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return mon.sensor_state(e.select(F.col("event_type").alias("component"), (F.col("user_id") % 6).alias("sensor"), F.col("event_id").alias("seq"), (F.col("event_id") % 4 == 1).alias("down")))


@query("mon14_backoff", "WITH r AS (SELECT user_id AS sensor, event_id AS seq, event_id % 60 * 1000000000 AS ran_ns FROM events), g AS (SELECT *, sum((ran_ns >= 30000000000)::INT) OVER (PARTITION BY sensor ORDER BY seq ROWS UNBOUNDED PRECEDING) AS grp FROM r) SELECT sensor, seq, row_number() OVER (PARTITION BY sensor, grp ORDER BY seq) AS attempt FROM g")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return mon.backoff_reset(e.select(F.col("user_id").alias("sensor"), F.col("event_id").alias("seq"), (F.col("event_id") % 60 * 1_000_000_000).alias("ran_ns")))


@query("mon15_replay_gate", f"WITH {MEDIA_SQL}, p AS (SELECT DISTINCT title FROM media WHERE status = 'Playing' AND title <> '') SELECT count(*) AS events, count(DISTINCT title) AS titles, count(*) FILTER (title NOT IN (SELECT title FROM p)) AS unbacked FROM media")
def _(spark, sf_dir):
    m = media_events(spark, sf_dir)
    backed = m.where("status = 'Playing' AND title <> ''").select("title").distinct()
    n = m.agg(F.count(F.lit(1)).alias("events"), F.countDistinct("title").alias("titles"))
    return n.crossJoin(m.join(backed, "title", "left_anti").agg(F.count(F.lit(1)).alias("unbacked")))


@query("mon16_grades", """WITH a AS (SELECT c.conv_id % 7 = 0 AS control, (c.conv_id + c.turn) % 3 = 0 AS declined, lower(c.text) AS answer, list_slice(string_split(lower(p.text), ' '), 1, 3) AS expected
    FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 WHERE c.role = 'assistant' AND p.role = 'user')
  SELECT control, count(*) AS n, sum((CASE WHEN control THEN declined ELSE NOT declined AND len(list_filter(expected, lambda x: x <> '' AND contains(answer, x))) > 0 END)::INT)::BIGINT AS correct FROM a GROUP BY control""")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    asked = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.array_join(F.slice(F.split("text", " "), 1, 3), "|").alias("expected"))
    a = c.where("role = 'assistant'").join(asked, ["conv_id", "turn"]).select((F.col("conv_id") % 7 == 0).alias("control"), ((F.col("conv_id") + F.col("turn")) % 3 == 0).alias("declined"), F.col("text").alias("answer"), "expected")
    return mon.graded(a).groupBy("control").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("correct"))


@query("mon17_request_health", f"WITH {LAT} SELECT component, user_id % 4 AS label, count(*) AS requests, sum((seq % 11 = 0)::INT)::BIGINT AS errors, max({BOUND}) AS worst_ns FROM lat GROUP BY ALL")
def _(spark, sf_dir):
    s = latencies(spark, sf_dir).withColumn("label", F.col("user_id") % 4)
    return s.groupBy("component", "label").agg(F.count(F.lit(1)).alias("requests"), F.sum((F.col("seq") % 11 == 0).cast("long")).alias("errors"), F.max(mon.bound(F.col("ns"))).alias("worst_ns"))


@query("mon18_clamped_histogram", f"WITH lat AS (SELECT greatest((value * 1000)::BIGINT - 100000, 0) AS ns FROM events) SELECT {BOUND} AS upper_ns, count(*) AS count FROM lat GROUP BY 1")
def _(spark, sf_dir):
    return mon.histogram(table(spark, sf_dir, "events").select((F.round(F.col("value") * 1000).cast("long") - 100_000).alias("ns")), [])


QUERIES_SQL = "q AS (SELECT event_type AS family, event_id AS seq, (value * 400000)::BIGINT AS ns, epoch_us(ts) * 1000 AS t_ns FROM events)"


def family_queries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("family"), F.col("event_id").alias("seq"), F.round(F.col("value") * 400_000).cast("long").alias("ns"), (micros(F.col("ts")) * 1000).alias("t_ns"))


@query("vec05_index_promotion", f"WITH {QUERIES_SQL}, r AS (SELECT *, count(*) OVER w AS n, sum(({BOUND} <= 5000000)::INT) OVER w AS fast FROM q WINDOW w AS (PARTITION BY family ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT family, min(seq) AS seq FROM r WHERE (ns > 100000000 OR n >= 20) AND fast < greatest(ceil(n * 0.99::DOUBLE), 1) GROUP BY family")
def _(spark, sf_dir):
    return mon.promotions(family_queries(spark, sf_dir))


@query("vec11_quiet_periods", f"WITH {QUERIES_SQL} SELECT family, seq FROM (SELECT *, lead(t_ns) OVER (PARTITION BY family ORDER BY t_ns, seq) AS nx FROM q) WHERE nx IS NULL OR nx - t_ns > 3600000000000")
def _(spark, sf_dir):
    return mon.quiet_ends(family_queries(spark, sf_dir), 3_600_000_000_000).select("family", "seq")


@query("vec12_compactions", f"WITH {QUERIES_SQL} SELECT family, seq, k FROM (SELECT family, seq, row_number() OVER (PARTITION BY family ORDER BY seq) AS k FROM q) WHERE k % 256 = 0")
def _(spark, sf_dir):
    return mon.compactions(family_queries(spark, sf_dir)).select("family", "seq", "k")


DRAINED = "SELECT batch, least(n, {0}) AS kept, greatest(n - {0}, 0) AS dropped, {2}(seq) AS edge FROM (SELECT *, count(*) OVER (PARTITION BY batch) AS n, row_number() OVER (PARTITION BY batch ORDER BY seq {1}) AS k FROM o) WHERE k <= {0} GROUP BY batch, n"


@query("snk07_fan_out_drops", "WITH o AS (SELECT user_id AS batch, event_id AS seq FROM events) " + DRAINED.format(50, "DESC", "min"))
def _(spark, sf_dir):
    return mon.drained(table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), F.col("event_id").alias("seq")), 50, newest=True)


@query("snk08_queue_drops", "WITH o AS (SELECT l_suppkey AS batch, l_orderkey * 10 + l_linenumber AS seq FROM lineitem) " + DRAINED.format(500, "ASC", "max"))
def _(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("batch"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return mon.drained(line, 500, newest=False)


DEFAULTS = ", ".join(f"'{x}'" for x in priv.EXCLUDED)
EX = f"ex AS (SELECT unnest(['app-1', {DEFAULTS}]) AS app_id), pz AS (SELECT t_ns AS from_ns, CASE WHEN n % 2 = 0 THEN least(t_ns + 36000000000000, coalesce(nx, 9223372036854775807)) ELSE coalesce(nx, 9223372036854775807) END AS until_ns FROM (SELECT *, lead(t_ns) OVER (ORDER BY t_ns, seq) AS nx FROM ctl) WHERE action = 'pause')"
CTL = "ctl AS (SELECT seq, t_ns, CASE WHEN seq % 1000 = 0 THEN 'pause' ELSE 'resume' END AS action, seq // 1000 AS n FROM tel WHERE seq % 500 = 0)"


def controls(spark, sf_dir):
    t = telemetry(spark, sf_dir).where("seq % 500 = 0")
    return t.select("seq", "t_ns", F.when(F.col("seq") % 1000 == 0, "pause").otherwise("resume").alias("action"), F.when(F.floor(F.col("seq") / 1000) % 2 == 0, 36_000_000_000_000).otherwise(0).cast("long").alias("for_ns"))


def exclusions(spark):
    defaults = spark.createDataFrame([(x,) for x in priv.EXCLUDED], "app_id string")
    return privacy.excluded_apps(defaults, spark.createDataFrame([("app-1",), ("keepassxc",)], "app_id string"))


@query("prv01_event_gate", f"WITH {TELEMETRY_SQL}, {CTL}, {EX} SELECT seq, app_id FROM tel WHERE (app_id IS NULL OR app_id NOT IN (SELECT app_id FROM ex)) AND NOT EXISTS (SELECT 1 FROM pz WHERE t_ns >= from_ns AND t_ns < until_ns)")
def _(spark, sf_dir):
    return privacy.allowed(telemetry(spark, sf_dir), exclusions(spark), privacy.pauses(controls(spark, sf_dir))).select("seq", "app_id")


@query("prv02_pauses", f"WITH {TELEMETRY_SQL}, {CTL}, {EX} SELECT from_ns, until_ns FROM pz")
def _(spark, sf_dir):
    return privacy.pauses(controls(spark, sf_dir))


@query("prv03_exclusions", "SELECT DISTINCT lower(s_name) AS app_id FROM supplier WHERE s_suppkey < 20 UNION SELECT DISTINCT lower(s_name) FROM supplier WHERE s_suppkey % 2 = 0")
def _(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("app_id", F.lower("s_name"))
    return privacy.excluded_apps(s.where("s_suppkey < 20").select("app_id"), s.where("s_suppkey % 2 = 0").select("app_id"))


@query("prv07_status", f"WITH {TELEMETRY_SQL}, {CTL}, {EX} SELECT (SELECT count(*) FROM pz WHERE from_ns <= 1705000000000000000 AND until_ns > 1705000000000000000) > 0 AS paused, coalesce((SELECT max(until_ns) FROM pz WHERE from_ns <= 1705000000000000000 AND until_ns > 1705000000000000000), 0) AS until_ns, (SELECT string_agg(app_id, ',' ORDER BY app_id) FROM ex) AS excluded, (SELECT count(*) FROM customer) AS subscribers, (SELECT sum(c_custkey % 3)::BIGINT FROM customer) AS dropped")
def _(spark, sf_dir):
    drops = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 3).alias("dropped"))
    s = privacy.status(exclusions(spark), privacy.pauses(controls(spark, sf_dir)), 1_705_000_000_000_000_000, drops)
    return s.withColumn("excluded", F.array_join("excluded", ","))


def placeholder_sql(key: bytes, kind: str, e: str) -> str:
    """The keyed hash in SQL: HMAC over the length of the kind, the kind and the value."""
    pad = lambda x: f"unhex('{bytes(b ^ x for b in key.ljust(64, bytes(1))).hex()}')"
    head = (len(kind).to_bytes(8, "little") + kind.encode()).hex()
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || unhex('{head}') || encode({e}))))[:16]"


PATH_SQL = "regexp_replace(url, '^[a-z]+:/', '')"


@query("prv05_anonymous_paths", rf"WITH p AS (SELECT page_id, {PATH_SQL} AS path, regexp_extract({PATH_SQL}, '[^/]\.([^./]+)$', 1) AS ext FROM pages) SELECT page_id, CASE WHEN path = '' THEN '' ELSE '/anon/' || {placeholder_sql(b'a key', 'path', 'path')} || CASE WHEN ext = '' THEN '' ELSE '.' || ext END END AS path FROM p")
def _(spark, sf_dir):
    path = F.regexp_replace("url", "^[a-z]+:/", "")
    return table(spark, sf_dir, "pages").select("page_id", priv.anonymous_path(b"a key", path).alias("path"))


@query("prv04_pseudonyms", f"SELECT c_custkey, CASE WHEN c_name = '' THEN '' ELSE 'title-' || {placeholder_sql(b'a key', 'title', 'c_name')} END AS name FROM customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", priv.placeholder(b"a key", "title", F.col("c_name")).alias("name"))


@query("prv06_anonymised_events", f"WITH {MEDIA_SQL} SELECT seq, status, player, CASE WHEN title = '' THEN '' ELSE 'title-' || {placeholder_sql(b'k', 'title', 'title')} END AS title, CASE WHEN artist = '' THEN '' ELSE 'artist-' || {placeholder_sql(b'k', 'artist', 'artist')} END AS artist FROM media")
def _(spark, sf_dir):
    m = media_events(spark, sf_dir).withColumn("media", F.struct("player", "status", "title", "artist"))
    hidden = F.col("media").withField("title", priv.placeholder(b"k", "title", F.col("title"))).withField("artist", priv.placeholder(b"k", "artist", F.col("artist")))
    return m.select("seq", hidden.alias("m")).select("seq", "m.status", "m.player", "m.title", "m.artist")


@query("tnt01_taint_union", f"WITH {CHUNK_SQL} SELECT entity_id, bit_or(taint) AS taint FROM chunks GROUP BY entity_id")
def _(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("entity_id").agg(F.coalesce(F.bit_or("taint"), F.lit(0)).alias("taint"))


@query("tnt02_escalates", f"WITH {CHUNK_SQL} SELECT doc_id, taint & 1 = 1 AS escalates FROM chunks")
def _(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", priv.escalates(F.col("taint")).alias("escalates"))


@query("tnt03_wrapped", f"WITH {CHUNK_SQL} SELECT doc_id, CASE WHEN taint & 1 = 1 THEN '<untrusted_external_doc taint=\"true\">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</untrusted_external_doc>' ELSE text END AS text FROM chunks")
def _(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", priv.wrapped(F.col("text"), F.col("taint")).alias("text"))


@query("tnt04_defused", "SELECT page_id, replace(replace(replace(html, '<', '<|'), '<|', '< |'), '|>', '| >') AS html FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", priv.defused(F.replace("html", F.lit("<"), F.lit("<|"))).alias("html"))


@query("tnt05_known_bits", "SELECT o_orderkey, o_orderkey & 15 AS taint FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", priv.known_bits(F.col("o_orderkey")).alias("taint"))


@query("tnt06_model_taint", f"WITH {CHUNK_SQL} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN taint | 4 ELSE taint END AS taint FROM chunks")
def _(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("taint").bitwiseOR(priv.MODEL)).otherwise(F.col("taint")).alias("taint"))


@query("tnt07_tiers", f"WITH {CHUNK_SQL} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'DENY' WHEN doc_id % 2 = 0 AND taint & 1 = 1 THEN 'REVIEW' WHEN doc_id % 2 = 0 THEN 'SAFE' ELSE 'CONFIRM' END AS tier FROM chunks")
def _(spark, sf_dir):
    i = F.col("doc_id")
    return chunks(spark, sf_dir).select("doc_id", priv.tier(i % 5 != 0, F.when(i % 2 == 0, "SAFE").otherwise("CONFIRM"), F.col("taint")).alias("tier"))


SNAPS = "snap AS (SELECT user_id AS toplevel_id, event_id AS seq, 'app-' || (event_id % 3 // 2) AS app_id, 'page ' || (event_id % 4 // 2) AS title, event_type = 'view' AS active FROM events)"


def snapshots(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(F.col("user_id").alias("toplevel_id"), i.alias("seq"), F.concat(F.lit("app-"), F.floor(i % 3 / 2)).alias("app_id"), F.concat(F.lit("page "), F.floor(i % 4 / 2)).alias("title"), (F.col("event_type") == "view").alias("active"))


@query("src05_window_changes", f"WITH {SNAPS}, l AS (SELECT *, row_number() OVER w AS k, lag(app_id) OVER w AS a, lag(title) OVER w AS t, lag(active) OVER w AS s FROM snap WINDOW w AS (PARTITION BY toplevel_id ORDER BY seq)) SELECT toplevel_id, seq, 'Opened' AS kind FROM l WHERE k = 1 UNION ALL SELECT toplevel_id, seq, 'TitleChanged' FROM l WHERE k > 1 AND title <> t UNION ALL SELECT toplevel_id, seq, 'AppIdChanged' FROM l WHERE k > 1 AND app_id <> a UNION ALL SELECT toplevel_id, seq, 'StateChanged' FROM l WHERE k > 1 AND active <> s")
def _(spark, sf_dir):
    return sensors.changes(snapshots(spark, sf_dir)).select("toplevel_id", "seq", "kind")


@query("src05_closed_at_loss", f"WITH {TELEMETRY_SQL} SELECT toplevel_id, 800::BIGINT AS seq, 'Closed' AS kind FROM tel WHERE seq <= 800 GROUP BY toplevel_id HAVING bool_or(kind = 'Opened') AND arg_max(kind, seq) <> 'Closed'")
def _(spark, sf_dir):
    return sensors.closed_at_loss(telemetry(spark, sf_dir), 800)


@query("src06_idle_transitions", f"WITH {TELEMETRY_SQL} SELECT seq, NOT active AS idle FROM tel WHERE kind = 'StateChanged'")
def _(spark, sf_dir):
    return telemetry(spark, sf_dir).where("kind = 'StateChanged'").select("seq", (~F.col("active")).alias("idle"))


@query("src07_media_snapshots", f"WITH {MEDIA_SQL} SELECT seq, status, title, '' AS album, CASE WHEN artist = '' THEN '' ELSE artist || ', ' || player END AS artist FROM media")
def _(spark, sf_dir):
    m = media_events(spark, sf_dir)
    data = F.create_map(F.lit("title"), F.col("title"))
    artists = F.when(F.col("artist") == "", F.array().cast("array<string>")).otherwise(F.array("artist", "player"))
    return m.select("seq", sensors.media_snapshot(F.col("status"), data, artists).alias("s")).select("seq", "s.*")


@query("src08_owner_changes", f"WITH {MEDIA_SQL} SELECT seq, CASE WHEN NOT starts_with(player, 'org.mpris.MediaPlayer2.') THEN 'Ignore' WHEN seq % 2 = 0 THEN 'Stop' WHEN seq % 3 <> 0 THEN 'Start' ELSE 'Ignore' END AS change FROM media")
def _(spark, sf_dir):
    return media_events(spark, sf_dir).select("seq", sensors.owner_change(F.col("player"), F.col("seq") % 2 == 1, F.col("seq") % 3 == 0).alias("change"))


@query("src09_cpu_percent", "WITH t AS (SELECT user_id AS host, event_id AS seq, floor(value * 10)::BIGINT AS busy, event_id // 3 * 100 AS total FROM events), d AS (SELECT host, seq, greatest(busy - lag(busy) OVER w, 0) AS b, greatest(total - lag(total) OVER w, 0) AS t, lag(seq) OVER w AS p FROM t WINDOW w AS (PARTITION BY host ORDER BY seq)) SELECT host, seq, CASE WHEN p IS NULL THEN NULL WHEN t > 0 THEN round(b / t * 100, 6) ELSE 0.0 END AS cpu FROM d")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = e.select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), F.floor(F.col("value") * 10).alias("busy"), (F.floor(F.col("event_id") / 3) * 100).alias("total"))
    return sensors.cpu_percent(t)


@query("src10_mem_used", "SELECT p_partkey, greatest(40 - coalesce(CASE WHEN p_size % 3 > 0 THEN p_size END, p_partkey % 60), 0) AS used FROM part")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", sensors.mem_used(F.lit(40), F.when(F.col("p_size") % 3 > 0, F.col("p_size")), F.col("p_partkey") % 60).alias("used"))


TREE = "tree AS (SELECT c_custkey AS pid, CASE WHEN c_custkey = 17 THEN 35 ELSE c_custkey // 2 END AS ppid, CASE WHEN c_custkey % 4 = 0 THEN left(lower(c_mktsegment), 15) ELSE 'app' || (c_custkey % 50) END AS comm FROM customer)"


def processes(spark, sf_dir):
    c, i = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(i.alias("pid"), F.when(i == 17, 35).otherwise(F.floor(i / 2)).alias("ppid"), F.when(i % 4 == 0, F.left(F.lower("c_mktsegment"), F.lit(15))).otherwise(F.concat(F.lit("app"), i % 50)).alias("comm"))


@query("src11_process_subtrees", f"WITH RECURSIVE {TREE}, sub(root, pid, depth) AS (SELECT pid, pid, 0 FROM tree WHERE pid IN (SELECT n_nationkey FROM nation) UNION ALL SELECT s.root, t.pid, s.depth + 1 FROM sub s JOIN tree t ON t.ppid = s.pid WHERE t.pid <> s.root AND s.depth < 40) SELECT root, pid, min(depth) AS depth FROM sub GROUP BY root, pid")
def _(spark, sf_dir):
    p = processes(spark, sf_dir)
    return sensors.subtree(p, p.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pid")), "pid", "left_semi"))


@query("src12_app_pids", f"WITH {TREE}, apps AS (SELECT DISTINCT 'org.' || n_name || CASE n_nationkey % 4 WHEN 0 THEN '.App7' WHEN 1 THEN '.Buildings' WHEN 2 THEN '.' ELSE '.HOUSEHOLD' END AS app_id FROM nation), g AS (SELECT app_id, lower(string_split(app_id, '.')[-1]) AS g FROM apps) SELECT app_id, min(pid) AS pid FROM g JOIN tree ON g <> '' AND (comm = g OR (length(g) >= 3 AND starts_with(comm, g)) OR (length(comm) = 15 AND starts_with(g, comm))) GROUP BY app_id")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    tail = F.element_at(F.array(*map(F.lit, (".App7", ".Buildings", ".", ".HOUSEHOLD"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return sensors.app_pids(n.select(F.concat(F.lit("org."), "n_name", tail).alias("app_id")), processes(spark, sf_dir))


@query("src13_folder_changes", "SELECT page_id, (['Created', 'Renamed', 'Modified', 'Deleted', NULL])[page_id % 5 + 1] AS change FROM pages")
def _(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("create", "rename", "modify", "remove", "access"))), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", sensors.folder_change(kind).alias("change"))


ROOTS = "roots AS (SELECT unnest(['/a', '/a/b', '/a/b/c', '/ab']) AS root, unnest(['one', 'two', 'three', 'four']) AS label), paths AS (SELECT DISTINCT '/' || (['a', 'ab', 'a/b', 'a/bc', 'a/b/c', 'x'])[p_partkey % 6 + 1] || '/f' || (p_partkey % 20) AS path FROM part)"


@query("src14_watch_labels", f"WITH {ROOTS} SELECT path, arg_max(label, length(root)) AS label FROM paths LEFT JOIN roots ON path = root OR starts_with(path, root || '/') GROUP BY path")
def _(spark, sf_dir):
    roots = spark.createDataFrame([("/a", "one"), ("/a/b", "two"), ("/a/b/c", "three"), ("/ab", "four")], "root string, label string")
    part = F.element_at(F.array(*map(F.lit, ("a", "ab", "a/b", "a/bc", "a/b/c", "x"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    paths = table(spark, sf_dir, "part").select(F.concat(F.lit("/"), part, F.lit("/f"), F.col("p_partkey") % 20).alias("path")).distinct()
    return sensors.watch_label(paths, roots)


@query("src16_focused_app", f"WITH {SNAPS} SELECT (SELECT app_id FROM snap WHERE active ORDER BY toplevel_id, seq LIMIT 1) AS app_id")
def _(spark, sf_dir):
    return sensors.focused_app(snapshots(spark, sf_dir))


@query("gen02_reassembled", "WITH s AS (SELECT conv_id AS generation, turn, text, turn = 5 AS eos FROM conversations WHERE conv_id % 4 <> 3), e AS (SELECT generation, min(turn) AS e FROM s WHERE eos GROUP BY generation) SELECT generation, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM s LEFT JOIN e USING (generation) WHERE e IS NULL OR turn < e GROUP BY generation")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    s = c.select(F.col("conv_id").alias("generation"), F.col("turn").alias("seq"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("piece"), (F.col("turn") == 5).alias("eos"))
    return mon.reassembled(s, None, s.where("generation % 4 = 3").select("generation").distinct())


@query("gen03_one_generation", "SELECT 8 AS generation, string_agg(text, '' ORDER BY turn) AS text FROM conversations WHERE conv_id = 8 AND turn < 5")
def _(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    s = c.select(F.col("conv_id").alias("generation"), F.col("turn").alias("seq"), F.encode("text", "UTF-8").alias("piece"), (F.col("turn") == 5).alias("eos"))
    return mon.reassembled(s, 8, s.where("generation < 0").select("generation"))


@query("gen05_derived_rates", """WITH e AS (SELECT user_id AS generation, event_id AS seq, epoch_us(ts) * 1000 AS t_ns, floor(value)::BIGINT % 50 AS prompt, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  s AS (SELECT generation, t_ns AS start, prompt FROM e WHERE k = 1), g AS (SELECT generation, arg_min(t_ns, seq) AS a, arg_max(t_ns, seq) AS z, count(*) AS n FROM e WHERE k > 1 GROUP BY generation)
  SELECT generation, round(CASE WHEN prompt > 0 THEN (a - start) / 1e6 / prompt ELSE 0 END, 4) AS prefill_ms, round(CASE WHEN n > 1 THEN (z - a) / 1e6 / (n - 1) ELSE 0 END, 4) AS decode_ms FROM g JOIN s USING (generation)""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("generation"), F.col("event_id").alias("seq"), (micros(F.col("ts")) * 1000).alias("t_ns"), (F.floor("value") % 50).alias("prompt_tokens"))
    # a user's first event asks, the later ones are its tokens
    first = e.groupBy("generation").agg(F.min_by(F.struct("seq", F.col("t_ns").alias("start_ns"), "prompt_tokens"), "seq").alias("q"))
    tokens = e.drop("prompt_tokens").join(first, "generation").where("seq > q.seq").select("generation", "seq", "t_ns", "q.start_ns", "q.prompt_tokens")
    return mon.generation_rates(tokens).select("generation", F.round("prefill_ms", 4).alias("prefill_ms"), F.round("decode_ms", 4).alias("decode_ms"))


@query("gen06_digests", "SELECT page_id, sha256(html) AS digest, sha256(html) = sha256(trim(html)) AS equal FROM pages")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.sha2("html", 256).alias("digest"), (F.sha2("html", 256) == F.sha2(F.trim("html"), 256)).alias("equal"))


