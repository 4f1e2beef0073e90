"""The ingest filter: from raw events to sessions and promoted keys.

Columns follow sources.tables.telemetry. Every order is (seq); windows are keyed by toplevel or by gate
key, so state is as large as one window or one application.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import normal_title
from tidemark.operators.prefix import running

OCCURRENCES, DWELL_NS = 3, 5_000_000_000
COOLDOWN_NS = 600_000_000_000
TRACKED, TRACKED_TTL_NS = 4096, 3_600_000_000_000


def self_observed(name: Column, own: tuple[str, ...], prefix: str) -> Column:
    """An application or process of the observer itself."""
    return name.isin(*own) | name.startswith(prefix) if own else name.startswith(prefix)


def root_comm(processes: Column, root: Column) -> Column:
    """comm of the root in a snapshot, empty if it is not there."""
    return F.coalesce(F.get(F.filter(processes, lambda p: p["pid"] == root), F.lit(0))["comm"], F.lit(""))


def pid_roots(trees: DataFrame) -> DataFrame:
    """(pid, root_pid): each root's latest snapshot, and for a pid in several of those the latest."""
    last = trees.groupBy("root_pid").agg(F.max_by(F.struct("seq", "processes"), "seq").alias("s"))
    each = last.select("root_pid", F.col("s.seq").alias("seq"), F.explode("s.processes").alias("p"))
    return each.groupBy(F.col("p.pid").alias("pid")).agg(F.max_by("root_pid", "seq").alias("root_pid"))


def collapse(pids: DataFrame, roots: DataFrame) -> DataFrame:
    """pids with `root_pid`, the pid itself where unknown."""
    return pids.join(roots, "pid", "left").withColumn("root_pid", F.coalesce("root_pid", "pid"))


def attributed(events: DataFrame, own: tuple[str, ...] = (), prefix: str = "\x00") -> DataFrame:
    """Events of known windows with the window's app, title and pid at that time, and `old_title`, the
    title before the event. Windows of the observer itself are unknown, and so are closed ones."""
    e = events.where((F.col("kind") != "Opened") | ~self_observed(F.col("app_id"), own, prefix))
    order = W.partitionBy("toplevel_id").orderBy("seq")
    e = e.withColumn("span", F.coalesce(F.sum((F.col("kind") == "Closed").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    life = W.partitionBy("toplevel_id", "span").orderBy("seq")
    upto, before = life.rowsBetween(W.unboundedPreceding, 0), life.rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("opened", F.sum((F.col("kind") == "Opened").cast("int")).over(upto)).where("opened > 0")
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    return e.select("seq", "t_ns", "toplevel_id", "span", "kind", "active", last("app_id", upto).alias("app_id"), last("title", upto).alias("title"), last("title", before).alias("old_title"), last("pid", upto).alias("pid"))


def segments(known: DataFrame) -> DataFrame:
    """Focus touches (seq, t_ns, toplevel_id, app_id, pid, occurrence, t_start_ns, t_end_ns, title):
    an activation is an occurrence; a deactivation, a close or a real title change while active ends a
    segment, which bears the title that was shown in it. Activating again starts anew."""
    plain = lambda c: F.coalesce(normal_title(F.col(c)), F.lit(""))
    changed = (F.col("kind") == "TitleChanged") & (plain("title") != plain("old_title"))
    mark = F.when(F.col("kind") == "StateChanged", F.when(F.col("active"), "A").otherwise("D")).when(F.col("kind") == "Closed", "D").when(changed, "T")
    m = known.withColumn("mark", mark).where("mark IS NOT NULL")
    order = W.partitionBy("toplevel_id").orderBy("seq")
    focus = F.last(F.when(F.col("mark") != "T", F.col("mark")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    m = m.withColumn("focus", focus).where("mark <> 'T' OR focus = 'A'")
    m = m.withColumn("since", F.lag("t_ns").over(order)).withColumn("ended", (F.col("mark") != "A") & (F.col("focus") == "A"))
    m = m.where("mark = 'A' OR ended")
    on = lambda c: F.when(F.col("ended"), c)
    return m.select("seq", "t_ns", "toplevel_id", "app_id", "pid", (F.col("mark") == "A").alias("occurrence"), on(F.col("since")).alias("t_start_ns"), on(F.col("t_ns")).alias("t_end_ns"), on(plain("old_title")).alias("title"))


def gated(touches: DataFrame, key: str, occurrences: int = OCCURRENCES, dwell_ns: int = DWELL_NS, slice_rows: int | None = None) -> DataFrame:
    """touches with `promoted`: the key's occurrences so far reach the gate, or its dwell exceeds it. Both only grow, so a promoted
    key stays so. Counts run on over slices, so a key may hold all touches."""
    dwell = F.greatest(F.coalesce(F.col("t_end_ns") - F.col("t_start_ns"), F.lit(0)), F.lit(0))
    counted = running(touches, [key], ["seq"], {"_seen": ("sum", F.col("occurrence").cast("long")), "_dwell": ("sum", dwell)}, slice_rows)
    return counted.withColumn("promoted", (F.col("_seen") >= occurrences) | (F.col("_dwell") > dwell_ns)).drop("_seen", "_dwell")


def gate_key(kind: Column, app: Column, root: Column, root_known: Column, label: Column) -> Column:
    """Key under which an event counts; none for kinds that bypass the gate."""
    return F.when(kind == "window", app).when((kind == "proc_tree") & root_known, F.concat(F.lit("proc:"), root.cast("string"))).when(kind == "file", F.concat(F.lit("file:"), label))


def outcomes(events: DataFrame, own: tuple[str, ...], prefix: str, dwell_ns: int = DWELL_NS) -> DataFrame:
    """(payload, seq, outcome) of events of all kinds: the columns of window events, `payload` (window, proc_tree, file, media or
    another), `key` (watch label of a file, root of a process tree, null if unknown) and `comm`, a root's name. Windows and
    keys pass the gate; media events are always Demoted; idle times, resource samples and unknown roots are NotApplicable."""
    windows = events.where("payload = 'window'")
    touched = gated(segments(attributed(windows, own, prefix)), "app_id", dwell_ns=dwell_ns).select("seq", "promoted")
    keyed = events.where("payload IN ('file', 'proc_tree') AND key IS NOT NULL").where((F.col("payload") == "file") | ~self_observed(F.coalesce("comm", F.lit("")), own, prefix))
    none = F.lit(None).cast("long")
    counted = gated(keyed.select("payload", "seq", F.concat_ws(":", "payload", "key").alias("key"), F.lit(True).alias("occurrence"), none.alias("t_start_ns"), none.alias("t_end_ns")), "key")
    passed = touched.select(F.lit("window").alias("payload"), "seq", "promoted").unionByName(counted.select("payload", "seq", "promoted"))
    name = F.when(F.col("payload") == "window", F.when(F.col("kind") == "Opened", F.col("app_id"))).when(F.col("payload") == "proc_tree", F.col("comm"))
    tag = F.when(F.col("payload") == "media", "Demoted").when(self_observed(name, own, prefix), "Excluded").when(F.col("promoted"), "Promoted").when(~F.col("promoted"), "NotYetPromoted").otherwise("NotApplicable")
    return events.join(passed, ["payload", "seq"], "left").select("payload", "seq", tag.alias("outcome"))


def cooled(rows: DataFrame, text: str, t: str, gap_ns: int = COOLDOWN_NS) -> DataFrame:
    """(text, t) pairs kept when each is taken only if more than gap_ns after the last one taken. What is kept depends on
    what was, so a text's times are read in order; only the last text and time taken are held, so no text is too frequent. A null
    time is dropped."""
    times = rows.select(F.col(text), F.col(t).cast("bigint")).where(F.col(t).isNotNull()).distinct().repartition(text).sortWithinPartitions(text, t)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            names, at = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            edges = np.append(np.flatnonzero(np.diff(code, prepend=code[:1] - 1)), len(code))
            kept = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                name = batch.column(0)[a].as_py()
                k = a + int(np.searchsorted(at[a:b], last[1] + gap_ns, "right")) if last is not None and last[0] == name else a
                while k < b:
                    kept.append(k)
                    last = (name, int(at[k]))
                    k += int(np.searchsorted(at[k:b], at[k] + gap_ns, "right"))
            yield batch.take(pa.array(kept, pa.int64()))

    return times.mapInArrow(take, times.schema)


def evicted(counters: DataFrame, now_ns: int, most: int = TRACKED, ttl_ns: int = TRACKED_TTL_NS) -> DataFrame:
    """Counters (key, last_ns, promoted) that a bounded state keeps: above `most` keys the stale unpromoted ones
    go; if that is not enough, the oldest, unpromoted first, down to three quarters."""
    n = counters.agg(F.count(F.lit(1)).alias("n"))
    fresh = counters.crossJoin(F.broadcast(n)).where((F.col("n") <= most) | F.col("promoted") | (now_ns - F.col("last_ns") <= ttl_ns))
    m = fresh.agg(F.count(F.lit(1)).alias("m"))
    ranked = fresh.orderBy(F.col("promoted").desc(), F.col("last_ns").desc(), "key").limit(most * 3 // 4).select("key")
    all_ = fresh.crossJoin(F.broadcast(m))
    return all_.where(F.col("m") <= most).select("key", "last_ns", "promoted").unionAll(all_.where(F.col("m") > most).join(ranked, "key").select("key", "last_ns", "promoted"))
