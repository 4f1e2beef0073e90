"""Domain adapters: what an accepted event adds to counters, entities, focus history and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ingest import cooled, root_comm

#: Fixed values, these and those below.
FAMILIES = {
    "window_focus": "attention", "app_lifecycle": "attention", "idle_presence": "attention", "process_activity": "work", "build_job": "work", "git_activity": "work",
    "notes": "knowledge", "calendar": "knowledge", "media_playback": "system", "system_resource": "system",
}
BUILD_TOOLS = ("cc1", "gcc", "clang", "rustc", "cargo", "make", "ninja", "cmake", "ld", "mvn", "gradle", "npm", "webpack", "tsc", "go")
CHURN = (".git", "target", "node_modules", "__pycache__", ".cache", ".venv", ".mypy_cache", ".pytest_cache")
GIT_FILES = ("COMMIT_EDITMSG", "MERGE_MSG", "TAG_EDITMSG", "SQUASH_MSG")
SCRATCH = r"(~|\.swp|\.swx|\.tmp|\.lock)$|^\.#|^\..*\.kate-swp$"
BROWSERS = ("brave", "chromium", "chrome", "firefox", "vivaldi", "opera", "edge", "epiphany")
LABELS = {"git": "git_activity", "notes": "notes", "calendar": "calendar", "ics": "calendar"}


def mapped(column: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in values.items():
        out = F.when(column == key, value).otherwise(out)
    return out


def family(domain: Column) -> Column:
    return F.coalesce(mapped(domain, FAMILIES), F.lit("external"))


def counters(events: DataFrame, key: Column, domain: str) -> DataFrame:
    """(domain, key, count, first_ns, last_ns): events (seq, t_ns) counted by key in order of arrival."""
    rows = events.select(F.lit(domain).alias("domain"), key.alias("key"), "seq", "t_ns")
    return rows.groupBy("domain", "key").agg(F.count(F.lit(1)).alias("count"), F.min_by("t_ns", "seq").alias("first_ns"), F.max_by("t_ns", "seq").alias("last_ns"))


def dispatched(events: DataFrame) -> DataFrame:
    """Counters (domain, key, count, first_ns, last_ns) of events (payload, seq, t_ns, and the columns of each payload): windows that
    open by application, idle changes by state, samples by themselves and their bands, media by title, files by path in the domain of
    their label. Each payload goes to its own rule; other payloads to none."""
    label = mapped(F.col("watch_label"), LABELS)
    one = lambda domain, *keys: F.struct(domain.alias("domain"), F.array(*keys).alias("keys"))
    bands = [F.lit("sample"), F.concat(F.lit("cpu:"), cpu_band(F.col("cpu"))), F.concat(F.lit("mem:"), mem_band(F.col("mem_used"), F.col("mem_total")))]
    rule = (
        F.when((F.col("payload") == "window") & (F.col("kind") == "Opened"), one(F.lit("app_lifecycle"), F.col("app_id")))
        .when(F.col("payload") == "idle", one(F.lit("idle_presence"), F.when(F.col("active"), "active").otherwise("idle")))
        .when(F.col("payload") == "resource", one(F.lit("system_resource"), *bands))
        .when((F.col("payload") == "media") & (F.col("title") != ""), one(F.lit("media_playback"), F.col("title")))
        .when((F.col("payload") == "file") & label.isNotNull() & ~churn(F.col("path")), one(label, F.col("path")))
    )
    rows = events.select("seq", "t_ns", rule.alias("r")).where("r IS NOT NULL").select("seq", "t_ns", "r.domain", F.explode("r.keys").alias("key"))
    return rows.groupBy("domain", "key").agg(F.count(F.lit(1)).alias("count"), F.min_by("t_ns", "seq").alias("first_ns"), F.max_by("t_ns", "seq").alias("last_ns"))


def focus_rows(promoted: DataFrame, roots: DataFrame) -> DataFrame:
    """Focus history of promoted touches that end a segment; an unknown pid and its root are 0."""
    done = promoted.where("promoted AND t_end_ns IS NOT NULL").withColumn("pid", F.coalesce("pid", F.lit(0)))
    done = done.join(roots, "pid", "left").withColumn("root_pid", F.when(F.col("pid") == 0, 0).otherwise(F.coalesce("root_pid", "pid")))
    dwell = F.expr("greatest(t_end_ns - t_start_ns, 0) div 1000000")
    return done.select(F.col("seq").alias("id"), "app_id", "title", "pid", "root_pid", "t_start_ns", "t_end_ns", dwell.alias("dwell_ms"))


def focus_chunks(focus: DataFrame) -> DataFrame:
    return focus.where("title <> ''").select(F.concat_ws(": ", "app_id", "title").alias("text"), F.col("t_end_ns").alias("t_ns"), F.lit("window_focus").alias("domain"))


def build_jobs(trees: DataFrame) -> DataFrame:
    """(root_comm, seq, t_ns) of snapshots that hold a build tool."""
    tool = F.exists("processes", lambda p: p["comm"].isin(*BUILD_TOOLS))
    return trees.where(tool).select(root_comm(F.col("processes"), F.col("root_pid")).alias("root_comm"), "seq", "t_ns")


def build_chunks(jobs: DataFrame, gap_ns: int) -> DataFrame:
    return cooled(jobs.select(F.concat(F.lit("build job under "), "root_comm").alias("text"), "t_ns"), "text", "t_ns", gap_ns)


def churn(path: Column) -> Column:
    """A path that tools write: scratch files are, the files a commit is written in are not, else any
    excluded part makes it so."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(SCRATCH), True).when(name.isin(*GIT_FILES), False).otherwise(F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, CHURN))))


def file_activity(promoted: DataFrame) -> DataFrame:
    """promoted file events of known labels, without churn, with their domain."""
    return promoted.withColumn("domain", mapped(F.col("watch_label"), LABELS)).where(F.col("domain").isNotNull() & ~churn(F.col("path")))


def cpu_band(cpu: Column) -> Column:
    return F.when(F.isnan(cpu), "unknown").when(cpu < 10, "idle").when(cpu < 40, "light").when(cpu < 80, "busy").otherwise("saturated")


def mem_band(used: Column, total: Column) -> Column:
    share = used / total * 100
    return F.when(total == 0, "unknown").when(share < 50, "low").when(share < 85, "high").otherwise("pressure")


def resource_counts(samples: DataFrame) -> DataFrame:
    """Each sample counts as itself, its cpu band and its memory band."""
    keys = F.array(F.lit("sample"), F.concat(F.lit("cpu:"), cpu_band(F.col("cpu"))), F.concat(F.lit("mem:"), mem_band(F.col("mem_used"), F.col("mem_total"))))
    return counters(samples.select("seq", "t_ns", F.explode(keys).alias("k")), F.col("k"), "system_resource")


def player(bus_name: Column) -> Column:
    return F.split(F.regexp_replace(bus_name, r"^(org\.mpris\.MediaPlayer2\.)+", ""), r"\.")[0]


def media_chunks(events: DataFrame) -> DataFrame:
    """(title, text, t_ns, last_seen_ns): the first time each title is seen playing, told once."""
    playing = events.where("status = 'Playing' AND title <> ''")
    first = playing.groupBy("title").agg(F.min_by(F.struct("player", "artist", "t_ns"), "seq").alias("f"), F.max_by("t_ns", "seq").alias("last_seen_ns"))
    name = player(F.col("f.player"))
    by = F.when(F.col("f.artist") == "", "").when(name.isin(*BROWSERS), F.concat(F.lit(" (channel: "), "f.artist", F.lit(")"))).otherwise(F.concat(F.lit(" by "), "f.artist"))
    return first.select("title", F.concat(name, F.lit(' played "'), "title", F.lit('"'), by).alias("text"), F.col("f.t_ns").alias("t_ns"), "last_seen_ns")


def latest_documents(docs: DataFrame) -> DataFrame:
    """External documents (doc_id, url, text, t_ns): a later fetch replaces an earlier one. taint 1."""
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("t_ns").desc()))
    text = F.when(F.col("url") == "", F.col("text")).otherwise(F.concat_ws("\n", "url", "text"))
    return docs.withColumn("rank", rank).where("rank = 1").select("doc_id", text.alias("text"), F.lit(1).cast("long").alias("taint"), "t_ns")
