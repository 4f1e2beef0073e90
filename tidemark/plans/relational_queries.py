"""Queries of counters, entities, edges and focus history over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import relational as rel
from tidemark.plans.ingest_queries import FOCUS_SQL, HOUR_NS, focus_history
from tidemark.plans.registry import query
from tidemark.sources.tables import CHUNK_SQL, EDGE_SQL, ENTITY_SQL, TELEMETRY_SQL, chunks, edges, entities, micros, table, telemetry

NOW_NS = 900_000_000_000_000_000  # 1998-07-09, within the orders' dates
DAY = 86_400_000_000_000


def touches(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("domain"), (F.col("user_id") % 40).alias("key"), (micros(F.col("ts")) * 1000).alias("at_ns"), F.floor("value").alias("dwell_ms"))


TOUCH = "touch AS (SELECT event_id AS seq, event_type AS domain, user_id % 40 AS key, epoch_us(ts) * 1000 AS at_ns, floor(value)::BIGINT AS dwell_ms FROM events)"


@query("rel01_counter_upsert", f"WITH {TOUCH} SELECT domain, key, count(*) AS count, arg_min(at_ns, seq) AS first_ns, arg_max(at_ns, seq) AS last_ns, sum(dwell_ms)::BIGINT AS total_dwell_ms FROM touch GROUP BY domain, key")
def _(spark, sf_dir):
    return rel.count_upserts(touches(spark, sf_dir))


@query("rel02_entity_upsert", f"WITH {TELEMETRY_SQL} SELECT event_type AS domain, 'u' || toplevel_id AS label, arg_min(kind, seq) AS kind, bit_or(seq % 4) AS taint, arg_min(t_ns, seq) AS created_ns, arg_max(t_ns, seq) AS last_seen_ns, arg_min(seq % 2 = 0, seq) AS permanent, min(seq) AS id FROM tel GROUP BY 1, 2")
def _(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return rel.entity_upserts(t.select("seq", F.col("event_type").alias("domain"), F.concat(F.lit("u"), "toplevel_id").alias("label"), "kind", (F.col("seq") % 4).alias("taint"), F.col("t_ns").alias("at_ns"), (F.col("seq") % 2 == 0).alias("permanent")))


@query("rel03_existing_entities", f"WITH {CHUNK_SQL}, {ENTITY_SQL} SELECT doc_id, domain FROM chunks c WHERE EXISTS (SELECT 1 FROM ent e WHERE e.domain = c.domain AND e.label = 'label ' || c.entity_id)")
def _(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("label", F.concat(F.lit("label "), "entity_id"))
    return c.join(entities(spark, sf_dir).select("domain", "label"), ["domain", "label"], "left_semi").select("doc_id", "domain")


NEW_EDGE = "fresh AS (SELECT src, dst, kind, weight + 1 AS weight, reinforced_ns + 1 AS reinforced_ns, true AS hypothesis FROM edge WHERE src % 3 = 0 UNION ALL SELECT dst + 1000000, src, 'co_occurs', 0.5, 1, true FROM edge WHERE src % 5 = 0 AND kind = 'mentions')"


def new_edges(e):
    a = e.where("src % 3 = 0").select("src", "dst", "kind", (F.col("weight") + 1).alias("weight"), (F.col("reinforced_ns") + 1).alias("reinforced_ns"), F.lit(True).alias("hypothesis"))
    return a.unionAll(e.where("src % 5 = 0 AND kind = 'mentions'").select(F.col("dst") + 1_000_000, "src", F.lit("co_occurs"), F.lit(0.5), F.lit(1).cast("long"), F.lit(True)))


@query("rel04_edge_upsert", f"WITH {EDGE_SQL}, {NEW_EDGE} SELECT * FROM fresh UNION ALL SELECT * FROM edge ANTI JOIN fresh USING (src, dst, kind)")
def _(spark, sf_dir):
    e = edges(spark, sf_dir)
    return rel.replaced(e, new_edges(e), ["src", "dst", "kind"])


@query("rel05_entities_since", f"WITH {ENTITY_SQL} SELECT id, domain, label, last_seen_ns FROM ent WHERE last_seen_ns >= {NOW_NS}::BIGINT - 30 * {DAY}::BIGINT")
def _(spark, sf_dir):
    return entities(spark, sf_dir).where(F.col("last_seen_ns") >= NOW_NS - 30 * DAY).select("id", "domain", "label", "last_seen_ns")


@query("rel06_all_edges", f"WITH {EDGE_SQL} SELECT * FROM edge")
def _(spark, sf_dir):
    return edges(spark, sf_dir)


@query("rel07_prune_edges", f"WITH {EDGE_SQL} SELECT src, dst, kind FROM edge WHERE NOT (hypothesis AND reinforced_ns < {NOW_NS}::BIGINT - 3 * {DAY}::BIGINT)")
def _(spark, sf_dir):
    return edges(spark, sf_dir).where(~rel.prunable(NOW_NS - 3 * DAY)).select("src", "dst", "kind")


@query("rel07_pruned_count", f"WITH {EDGE_SQL} SELECT kind, count(*) AS n FROM edge WHERE hypothesis AND reinforced_ns < {NOW_NS}::BIGINT GROUP BY kind")
def _(spark, sf_dir):
    return edges(spark, sf_dir).where(rel.prunable(NOW_NS)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


SNAP = """, probe AS (SELECT seq AS probe_id, t_ns + {shift}::BIGINT AS t_ns FROM tel), near AS (
  SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY NOT (t_ns BETWEEN t_start_ns AND t_end_ns), least(abs(t_start_ns - t_ns), abs(t_end_ns - t_ns)), t_start_ns, id) AS k
  FROM probe JOIN focus ON t_end_ns >= t_ns - {w}::BIGINT AND t_start_ns <= t_ns + {w}::BIGINT)
  SELECT probe_id, p.t_ns, n.id, app_id, title, t_start_ns, t_end_ns FROM probe p LEFT JOIN (SELECT * EXCLUDE (t_ns) FROM near WHERE k = 1) n USING (probe_id)"""


def snap(spark, sf_dir, shift, around):
    p = telemetry(spark, sf_dir).select(F.col("seq").alias("probe_id"), (F.col("t_ns") + shift).alias("t_ns"))
    return rel.snapped(p, focus_history(spark, sf_dir), around).select("probe_id", "t_ns", "id", "app_id", "title", "t_start_ns", "t_end_ns")


@query("rel08_focus_snap", f"WITH {FOCUS_SQL}" + SNAP.format(shift=0, w=HOUR_NS))
def _(spark, sf_dir):
    return snap(spark, sf_dir, 0, HOUR_NS)


@query("rel09_batched_snap", f"WITH {FOCUS_SQL}" + SNAP.format(shift=7_000_000_000, w=6 * HOUR_NS))
def _(spark, sf_dir):
    return snap(spark, sf_dir, 7_000_000_000, 6 * HOUR_NS)


WINDOWS = "SELECT app_id, title, min(t_start_ns) AS first_ns, max(t_end_ns) AS last_ns, sum(dwell_ms)::BIGINT AS dwell_ms FROM focus WHERE {0} title <> '' GROUP BY app_id, title"


@query("rel10_activity_windows", f"WITH {FOCUS_SQL} {WINDOWS.format('')}")
def _(spark, sf_dir):
    return rel.activity(focus_history(spark, sf_dir))


MID = "(SELECT min(t_start_ns) + (max(t_end_ns) - min(t_start_ns)) // 2 FROM focus)"


@query("rel10_activity_top", f"WITH {FOCUS_SQL} {WINDOWS.format('t_end_ns >= 1704672000000000000 AND t_start_ns <= 1705536000000000000 AND')} ORDER BY dwell_ms DESC, app_id, title LIMIT 18")
def _(spark, sf_dir):
    return rel.activity(focus_history(spark, sf_dir), 1_704_672_000_000_000_000, 1_705_536_000_000_000_000, 18)


@query("rel11_activity_media", f"WITH {CHUNK_SQL} SELECT chunk_id, doc_id, text, t_ns, taint FROM chunks WHERE domain = 'media_playback' AND t_ns >= 60000000000 AND t_ns <= 120000000000000 ORDER BY t_ns, doc_id LIMIT 50")
def _(spark, sf_dir):
    return rel.activity_media(chunks(spark, sf_dir), 60_000_000_000, 120_000_000_000_000, 50)


@query("rel12_append_focus", f"WITH {FOCUS_SQL} SELECT id, app_id, dwell_ms FROM focus UNION ALL SELECT o_orderkey, 'order', o_orderkey % 100 FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf_dir):
    more = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("app_id"), (F.col("o_orderkey") % 100).alias("dwell_ms"))
    return focus_history(spark, sf_dir).select("id", "app_id", "dwell_ms").unionByName(more)


@query("rel13_index_meta", f"WITH {CHUNK_SQL} SELECT domain AS collection, CASE WHEN max(doc_id) % 2 = 0 THEN 'b' ELSE 'a' END AS model_id, 64 AS dim, max(t_ns) AS updated_ns FROM chunks GROUP BY domain")
def _(spark, sf_dir):
    c = chunks(spark, sf_dir).groupBy(F.col("domain").alias("collection")).agg(F.max("t_ns").alias("updated_ns"), F.max("doc_id").alias("d"))
    old = c.select("collection", F.lit("a").alias("model_id"), F.lit(64).alias("dim"), "updated_ns")
    new = c.where("d % 2 = 0").select("collection", F.lit("b").alias("model_id"), F.lit(64).alias("dim"), "updated_ns")
    return rel.replaced(old, new, ["collection"])


MERGE = f"""{ENTITY_SQL}, kept AS (SELECT domain, label, min(id) AS keep, arg_min(kind, id) AS kind, bit_or(taint) AS taint, min(created_ns) AS created_ns, max(last_seen_ns) AS last_seen_ns, bool_or(permanent) AS permanent FROM ent GROUP BY domain, label),
  ren AS (SELECT id, keep FROM ent JOIN kept USING (domain, label) WHERE id <> keep)"""


def coarse(spark, sf_dir):
    """Entities with one domain for each label, so that labels repeat."""
    return entities(spark, sf_dir).withColumn("domain", F.concat(F.lit("d"), F.floor(F.col("id") / 2) % 3))


COARSE = MERGE.replace(ENTITY_SQL, ENTITY_SQL.replace("ent AS (", "ent0 AS (") + ", ent AS (SELECT * REPLACE ('d' || (id // 2 % 3) AS domain) FROM ent0)")


@query("rel14_merge_entities", f"WITH {COARSE} SELECT keep AS id, domain, label, kind, taint, created_ns, last_seen_ns, permanent FROM kept")
def _(spark, sf_dir):
    return rel.merged_entities(coarse(spark, sf_dir))[0]


@query("rel14_merge_edges", f"""WITH {COARSE}, {EDGE_SQL}, m AS (SELECT coalesce(a.keep, src) AS to_src, coalesce(b.keep, dst) AS to_dst, kind, src AS o_src, dst AS o_dst, coalesce(a.keep, b.keep) IS NOT NULL AS moved, weight, reinforced_ns, hypothesis
  FROM edge LEFT JOIN ren a ON a.id = src LEFT JOIN ren b ON b.id = dst)
  SELECT to_src AS src, to_dst AS dst, kind, weight, reinforced_ns, hypothesis FROM m WHERE to_src <> to_dst QUALIFY row_number() OVER (PARTITION BY to_src, to_dst, kind ORDER BY moved, o_src, o_dst) = 1""")
def _(spark, sf_dir):
    return rel.merged_edges(edges(spark, sf_dir), rel.merged_entities(coarse(spark, sf_dir))[1])


@query("rel14_merge_chunks", f"WITH {COARSE}, {CHUNK_SQL} SELECT doc_id, coalesce(keep, entity_id) AS entity_id FROM chunks LEFT JOIN ren ON ren.id = entity_id")
def _(spark, sf_dir):
    renames = rel.merged_entities(coarse(spark, sf_dir))[1].withColumnRenamed("id", "entity_id")
    return chunks(spark, sf_dir).join(renames, "entity_id", "left").select("doc_id", F.coalesce("keep", "entity_id").alias("entity_id"))


@query("rel15_forget_app", f"WITH {FOCUS_SQL} SELECT id, app_id, dwell_ms FROM focus WHERE app_id <> 'app-3'")
def _(spark, sf_dir):
    return focus_history(spark, sf_dir).where("app_id <> 'app-3'").select("id", "app_id", "dwell_ms")


GONE = "gone AS (SELECT id FROM ent WHERE label = 'label 7')"


@query("rel15_forget_app_edges", f"WITH {ENTITY_SQL}, {EDGE_SQL}, {GONE} SELECT src, dst, kind FROM edge WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)")
def _(spark, sf_dir):
    gone = entities(spark, sf_dir).where("label = 'label 7'").select("id")
    return rel.without_entities(edges(spark, sf_dir), gone).select("src", "dst", "kind")


@query("rel16_forget_since", f"WITH {ENTITY_SQL}, {CHUNK_SQL} SELECT c.doc_id FROM chunks c WHERE t_ns < 100000000000000 AND NOT EXISTS (SELECT 1 FROM ent e WHERE e.id = c.entity_id AND created_ns >= {NOW_NS}::BIGINT - 1800 * {DAY}::BIGINT)")
def _(spark, sf_dir):
    gone = entities(spark, sf_dir).where(F.col("created_ns") >= NOW_NS - 1800 * DAY).select(F.col("id").alias("entity_id"))
    return chunks(spark, sf_dir).where("t_ns < 100000000000000").join(gone, "entity_id", "left_anti").select("doc_id")


@query("rel17_cascade_delete", f"WITH {ENTITY_SQL}, {EDGE_SQL}, gone AS (SELECT id FROM ent WHERE id % 4 = 1) SELECT kind, count(*) AS n, sum(weight) AS weight FROM edge WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY kind")
def _(spark, sf_dir):
    e = rel.without_entities(edges(spark, sf_dir), entities(spark, sf_dir).where("id % 4 = 1").select("id"))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


CUT = f"CASE WHEN domain IN ('git_activity', 'notes', 'calendar') THEN NULL WHEN domain = 'external_documents' THEN {NOW_NS}::BIGINT - 90 * {DAY}::BIGINT ELSE {NOW_NS}::BIGINT - 14 * {DAY}::BIGINT END"


@query("rel18_expired_entities", f"WITH {ENTITY_SQL} SELECT domain, count(*) AS n, sum(coalesce(last_seen_ns < {CUT}, false)::INT)::BIGINT AS expired FROM ent GROUP BY domain")
def _(spark, sf_dir):
    e = entities(spark, sf_dir)
    return e.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum(rel.expired(e, "last_seen_ns", NOW_NS).cast("long")).alias("expired"))


@query("rel18_kept_entities", f"WITH {ENTITY_SQL} SELECT id, domain, last_seen_ns FROM ent WHERE NOT coalesce(last_seen_ns < {CUT}, false)")
def _(spark, sf_dir):
    e = entities(spark, sf_dir)
    return e.where(~rel.expired(e, "last_seen_ns", NOW_NS)).select("id", "domain", "last_seen_ns")


VNOW = 200_000_000_000_000


@query("rel19_vector_expiry", f"WITH {CHUNK_SQL} SELECT doc_id, domain FROM chunks WHERE NOT (coalesce(t_ns + 1300 * 1000000000000 < CASE WHEN domain IN ('git_activity', 'notes') THEN NULL WHEN domain = 'external_documents' THEN 9000000000000000 - 90 * {DAY}::BIGINT ELSE 2700000000000000 - 14 * {DAY}::BIGINT END, false) OR entity_id IN (3, 5))")
def _(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("seen", F.col("t_ns") + 1_300_000_000_000_000)
    late = F.when(F.col("domain") == "external_documents", rel.expired(c, "seen", 9_000_000_000_000_000)).otherwise(rel.expired(c, "seen", 2_700_000_000_000_000))
    return c.where(~(late | F.col("entity_id").isin(3, 5))).select("doc_id", "domain")


LITERAL = "s_suppkey || (['s', 'm', 'h', 'd', 'w', 'x', ''])[s_suppkey % 7 + 1]"


@query("rel20_durations", f"SELECT {LITERAL} AS literal, s_suppkey * (CASE s_suppkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 WHEN 4 THEN 604800 END) * 1000000000 AS ns FROM supplier")
def _(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    text = F.concat(F.col("s_suppkey").cast("string"), F.element_at(F.array(*map(F.lit, ("s", "m", "h", "d", "w", "x", ""))), (F.col("s_suppkey") % 7 + 1).cast("int")))
    return s.select(text.alias("literal"), rel.duration_ns(text).alias("ns"))


@query("rel21_forget_times", "SELECT s_suppkey, greatest(1000000000000000 - s_suppkey * 86400 * 1000000000, 0) AS since_ns FROM supplier")
def _(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    back = rel.duration_ns(F.concat(F.col("s_suppkey").cast("string"), F.lit("d")))
    return s.select("s_suppkey", F.greatest(F.lit(1_000_000_000_000_000) - back, F.lit(0)).alias("since_ns"))


@query("rel22_clamped_counts", "SELECT p_partkey, least(greatest(p_size * 10 - 20, 1), 256) AS top_k FROM part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", rel.clamped(F.col("p_size") * 10 - 20, 256).alias("top_k"))


@query("rel15_forget_counters", f"WITH {TOUCH} SELECT domain, key, count(*) AS count FROM touch WHERE key <> 7 GROUP BY domain, key")
def _(spark, sf_dir):
    return rel.count_upserts(touches(spark, sf_dir)).where("key <> 7").select("domain", "key", "count")


