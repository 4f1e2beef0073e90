"""Sensors: raw observations turned into events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.storage import stored


def changes(snapshots: DataFrame) -> DataFrame:
    """Window events of successive snapshots (toplevel_id, seq, app_id, title, active): the first one opens,
    later ones tell what differs from the one before."""
    order = W.partitionBy("toplevel_id").orderBy("seq")
    s = snapshots.withColumns({f"old_{c}": F.lag(c).over(order) for c in ("app_id", "title", "active")}).withColumn("k", F.row_number().over(order))
    change = lambda kind, c: F.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")), F.lit(kind))
    kinds = F.when(F.col("k") == 1, F.array(F.lit("Opened"))).otherwise(F.array_compact(F.array(change("TitleChanged", "title"), change("AppIdChanged", "app_id"), change("StateChanged", "active"))))
    return s.select("toplevel_id", "seq", F.explode(kinds).alias("kind"), "app_id", "title", "active")


def closed_at_loss(events: DataFrame, lost_seq: int) -> DataFrame:
    """Closed events for the windows that are open when the connection is lost."""
    last = events.where(F.col("seq") <= lost_seq).groupBy("toplevel_id").agg(F.max_by("kind", "seq").alias("kind"), F.bool_or(F.col("kind") == "Opened").alias("opened"))
    return last.where("opened AND kind <> 'Closed'").select("toplevel_id", F.lit(lost_seq).cast("long").alias("seq"), F.lit("Closed").alias("kind"))


def media_snapshot(status: Column, metadata: Column, artists: Column) -> Column:
    get = lambda k: F.coalesce(F.try_element_at(metadata, F.lit(k)), F.lit(""))
    return F.struct(status.alias("status"), get("title").alias("title"), get("album").alias("album"), F.coalesce(F.array_join(artists, ", "), F.lit("")).alias("artist"))


def owner_change(name: Column, has_owner: Column, watched: Column, prefix: str = "org.mpris.MediaPlayer2.") -> Column:
    return F.when(~name.startswith(prefix), "Ignore").when(~has_owner, "Stop").when(~watched, "Start").otherwise("Ignore")


def cpu_percent(ticks: DataFrame) -> DataFrame:
    """(host, seq, cpu) of tick counters (host, seq, busy, total): the busy share of the ticks since the sample before,
    none for the first, 0 if none passed."""
    order = W.partitionBy("host").orderBy("seq")
    busy = F.greatest(F.col("busy") - F.lag("busy").over(order), F.lit(0))
    total = F.greatest(F.col("total") - F.lag("total").over(order), F.lit(0))
    t = ticks.select("host", "seq", busy.alias("b"), total.alias("t"), F.lag("seq").over(order).isNotNull().alias("seen"))
    return t.select("host", "seq", F.when(F.col("seen") & (F.col("t") > 0), F.round(F.col("b") / F.col("t") * 100, 6)).when(F.col("seen"), 0.0).alias("cpu"))


def mem_used(total: Column, available: Column, free: Column) -> Column:
    return F.greatest(total - F.coalesce(available, free), F.lit(0))


def subtree(processes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, pid, depth): each root (pid,) and its descendants in processes (pid, ppid), however deep, cycles cut: a level is
    joined to its children until none is new. What is known is stored every few levels, so that no plan holds all of them."""
    processes = stored(processes.select("pid", "ppid"))
    level = stored(roots.select(F.col("pid").alias("root"), "pid").withColumn("depth", F.lit(0)))
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        next_ = level.select("root", F.col("pid").alias("ppid")).join(processes, "ppid").select("root", "pid").distinct()
        level = stored(next_.join(out, ["root", "pid"], "left_anti").withColumn("depth", F.lit(depth)))
        out = out.unionAll(level) if depth % 16 else stored(out.unionAll(level))
    return out


def app_pids(apps: DataFrame, processes: DataFrame) -> DataFrame:
    """(app_id, pid): the lowest pid whose comm is the application's binary name: its last dotted part in lower case, or a
    comm that it starts (three characters or more), or a comm of 15 characters that starts it. Each side gives
    the keys under which the other can match, so the join has an equal key."""
    guess = F.lower(F.element_at(F.split("app_id", r"\."), -1))
    a = apps.select("app_id", guess.alias("guess")).where("guess <> ''").distinct()
    keys_a = F.array(F.col("guess"), F.left("guess", F.lit(15)))
    by_a = a.select("app_id", "guess", F.explode(F.array_distinct(keys_a)).alias("key"))
    prefixes = F.transform(F.sequence(F.lit(3), F.greatest(F.length("comm"), F.lit(3))), lambda n: F.left("comm", n))
    by_p = processes.select("pid", "comm", F.explode(F.array_distinct(F.concat(F.array("comm"), prefixes))).alias("key"))
    fits = (F.col("comm") == F.col("guess")) | ((F.length("guess") >= 3) & F.startswith("comm", "guess")) | ((F.length("comm") == 15) & F.startswith("guess", "comm"))
    return by_a.join(by_p, "key").where(fits).groupBy("app_id").agg(F.min("pid").alias("pid"))


def folder_change(kind: Column) -> Column:
    return F.when(kind == "create", "Created").when(kind == "rename", "Renamed").when(kind == "modify", "Modified").when(kind == "remove", "Deleted")


def watch_label(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths (path) with `label` of the longest watched root (root, label) that holds it. A path is looked up by each of its
    own parents, so the join has an equal key."""
    parts = F.split("path", "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = paths.select("path", F.explode(parents).alias("root")).join(roots, "root")
    best = each.groupBy("path").agg(F.max_by("label", F.length("root")).alias("label"))
    return paths.join(best, "path", "left")


def focused_app(events: DataFrame) -> DataFrame:
    """(app_id,) of the first active window by toplevel, null if there is none."""
    return events.agg(F.min_by("app_id", F.when(F.col("active"), F.struct("toplevel_id", "seq"))).alias("app_id"))
