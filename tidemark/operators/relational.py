"""Counters, entities, edges and focus history: upserts, look-ups, forgetting, expiry and merging.

Tables are immutable, so an upsert or a delete is a new version of a table made by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.adapters import mapped
from tidemark.operators.prefix import SLICE, sliced
from tidemark.sources.storage import stored

DAY_NS = 86_400_000_000_000
#: Days that a domain's rows are kept; None is for ever.
RETENTION = {
    "window_focus": 14, "app_lifecycle": 14, "idle_presence": 14, "process_activity": 14, "media_playback": 14, "system_resource": 14,
    "build_job": 90, "external_documents": 90, "git_activity": None, "notes": None, "calendar": None,
}
FOCUS_DAYS, OTHER_DAYS = 14, 14
SNAP_NS = 1_500_000_000
#: Rows of a slice of time, in the order in which a task reads them.
OVER, START, END, PROBE = range(4)
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def count_upserts(touches: DataFrame) -> DataFrame:
    """touches (seq, domain, key, at_ns, dwell_ms) as counters; first and last by arrival."""
    return touches.groupBy("domain", "key").agg(F.count(F.lit(1)).alias("count"), F.min_by("at_ns", "seq").alias("first_ns"), F.max_by("at_ns", "seq").alias("last_ns"), F.sum("dwell_ms").alias("total_dwell_ms"))


def entity_upserts(seen: DataFrame) -> DataFrame:
    """seen (seq, domain, label, kind, taint, at_ns, permanent) as entities: the first kind, creation and
    permanence stay, the last time counts, taints unite. Ids follow the first arrival."""
    first = lambda c: F.min_by(c, "seq")
    e = seen.groupBy("domain", "label").agg(first("kind").alias("kind"), F.bit_or("taint").alias("taint"), first("at_ns").alias("created_ns"), F.max_by("at_ns", "seq").alias("last_seen_ns"), first("permanent").alias("permanent"), F.min("seq").alias("id"))
    return e


def replaced(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those of equal key, and the others of new added."""
    rest = [c for c in old.columns if c not in key]
    there = F.col("n._new").isNotNull()
    both = old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), key, "full")
    return both.select(*key, *(F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest))


def prunable(cutoff_ns: int) -> Column:
    return F.col("hypothesis") & (F.col("reinforced_ns") < cutoff_ns)


def snapped(probes: DataFrame, focus: DataFrame, around_ns: int = SNAP_NS, slice_rows: int = SLICE) -> DataFrame:
    """For each probe (probe_id, t_ns) the focus row whose time is within around_ns of it: one that
    contains it first, then the one with the nearest end; ties fall to the earlier start, then the id. Probes, starts and ends are cut
    into slices of about slice_rows rows in order of time. A task holds the starts and ends of one slice, through which its
    probes go one batch after the other; what a slice inherits from the others (`inherited`) is four rows."""
    focus = stored(focus)
    f = focus.where("t_start_ns IS NOT NULL AND t_end_ns IS NOT NULL").select(F.col("id").cast("bigint").alias("key"), F.col("t_start_ns").alias("s"), F.col("t_end_ns").alias("e"))
    p = probes.where("t_ns IS NOT NULL").select(F.lit(PROBE).alias("kind"), F.col("t_ns").alias("t"), F.col("probe_id").cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("e"))
    ends = f.select(F.explode(F.array(F.struct(F.lit(START).alias("kind"), F.col("s").alias("t")), F.struct(F.lit(END).alias("kind"), F.col("e").alias("t")))).alias("x"), "key", "s", "e").select("x.*", "key", "s", "e")
    events = stored(ends.unionByName(p))
    dealt = sliced(events, ["t"], max(1, -(-events.count() // slice_rows)))
    whole = dealt.unionByName(inherited(dealt)).repartition("_slice").sortWithinPartitions("_slice", "kind")
    found = whole.select("_slice", "kind", "t", "key", "s", "e").mapInArrow(lambda batches: nearest_rows(batches, around_ns), "probe_id bigint, t_ns bigint, id bigint")
    found = found.unionByName(probes.where("t_ns IS NULL").select(F.col("probe_id").cast("bigint").alias("probe_id"), "t_ns", F.lit(None).cast("bigint").alias("id")))
    rest = [c for c in focus.columns if c != "id"]
    return found.join(focus, "id", "left").select("probe_id", "t_ns", "id", *rest)


def inherited(dealt: DataFrame) -> DataFrame:
    """Rows for the slices of `dealt`, as they are there: of rows in focus over a whole slice the one of latest start and that of earliest end, the last
    end before the slice and the first start after it. A row over many slices is cut into the aligned powers of two that make
    up those between its own; each slice looks into the one of each size that holds it."""
    last = lambda kind: dealt.where(F.col("kind") == kind)
    row = F.struct("key", "s", "e")
    heads = dealt.groupBy("_slice").agg(  # a row a slice
        F.max(F.when(F.col("kind") == END, F.struct("e", (-F.col("s")).alias("s"), (-F.col("key")).alias("key"), row.alias("row")))).alias("end"),
        F.min(F.when(F.col("kind") == START, F.struct("s", "key", row.alias("row")))).alias("start"),
    )
    heads = stored(heads)
    before, after = (W.orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in ("_slice", F.desc("_slice")))
    next_to = heads.select("_slice", F.max("end").over(before)["row"].alias("a"), F.min("start").over(after)["row"].alias("b"))
    beside = next_to.select("_slice", F.explode(F.array(F.struct(F.lit(END).alias("kind"), F.col("a").alias("row")), F.struct(F.lit(START).alias("kind"), F.col("b").alias("row")))).alias("x")).select("_slice", "x.*")
    levels = max(1, heads.count().bit_length())
    spans = last(START).where("s <= e").select("key", "s", "e", (F.col("_slice") + 1).alias("l0")).join(last(END).select("key", F.col("_slice").alias("r0")), "key").where("l0 < r0")
    parts = spans.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    parts = parts.withColumn("l", F.expr("shiftright(l0 + shiftleft(1, k) - 1, k)")).withColumn("r", F.expr("shiftright(r0, k)")).where("l < r")
    nodes = F.filter(F.array(F.when(F.col("l") % 2 != 0, F.col("l")), F.when(F.col("r") % 2 != 0, F.col("r") - 1)), lambda x: x.isNotNull())
    best = (F.min(F.struct((-F.col("s")).alias("order"), "key", row.alias("row"))).alias("late"), F.min(F.struct("e", "s", "key", row.alias("row"))).alias("early"))
    nodes = parts.select("k", F.explode(nodes).alias("node"), "key", "s", "e").groupBy("k", "node").agg(*best)
    asked = heads.select("_slice", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("k")).withColumn("node", F.expr("shiftright(_slice, k)"))
    over = asked.join(nodes, ["k", "node"]).groupBy("_slice").agg(F.min("late").alias("late"), F.min("early").alias("early"))
    over = over.select("_slice", F.lit(OVER).alias("kind"), F.explode(F.array("late.row", "early.row")).alias("row"))
    return beside.unionByName(over).where("row IS NOT NULL").select("_slice", "kind", F.lit(0).cast("bigint").alias("t"), "row.*")


def nearest_rows(batches: Iterator[pa.RecordBatch], around_ns: int) -> Iterator[pa.RecordBatch]:
    """(probe_id, t_ns, id) of slices one after the other, each with its rows in focus before its probes."""
    at, held, slice_ = None, [], None
    for batch in batches:
        of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        key = of.astype(np.int64) * 2 + (kind == PROBE)
        edges = np.flatnonzero(np.diff(key)) + 1
        for a, b in zip([0, *edges], [*edges, len(key)], strict=True):
            if a == b:
                continue
            if of[a] != at:
                at, held, slice_ = of[a], [], None
            t, ids, s, e = (batch.column(c)[a:b].to_numpy() for c in (2, 3, 4, 5))
            if key[a] % 2 == 0:
                held.append((kind[a:b], ids, s, e))
                continue
            if slice_ is None:
                slice_ = Slice(*(np.concatenate(c) for c in zip(*held, strict=True))) if held else Slice(*(np.empty(0, np.int64) for _ in range(4)))
            found, there = slice_.nearest(t, around_ns)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(t), pa.array(found, pa.int64(), mask=~there)], ["probe_id", "t_ns", "id"])


class Slice:
    """Rows in focus that begin, end or lie over a slice of time. Those that contain a time are found in a tree over the places
    of starts and ends and the gaps between, which keeps at each node the rows of latest start and of earliest end."""

    def __init__(self, kind: np.ndarray, ids: np.ndarray, s: np.ndarray, e: np.ndarray):
        self.ids, self.s, self.e = ids, s, e
        starts, ends = np.flatnonzero(kind == START), np.flatnonzero(kind == END)
        self.starts, self.ends = starts[np.lexsort((ids[starts], s[starts]))], ends[np.lexsort((-ids[ends], -s[ends], e[ends]))]
        self.marks = np.unique(np.concatenate([s[starts], e[ends]]))
        self.width = 1 << int(2 * len(self.marks) + 1).bit_length()
        self.orders = [np.lexsort((ids, -s)), np.lexsort((ids, s, e))]
        self.trees = [np.full(2 * self.width, len(ids)) for _ in self.orders]
        own = np.flatnonzero(s <= e)
        over = kind[own] == OVER
        low, high = np.where(over, 0, self.place(s[own])), np.where(over, 2 * len(self.marks), self.place(e[own]))
        for order, tree in zip(self.orders, self.trees, strict=True):
            rank = np.empty(len(ids), int)
            rank[order] = np.arange(len(ids))
            left, right, of = low + self.width, high + self.width + 1, rank[own]
            while len(left):
                odd = (left & 1) == 1
                np.minimum.at(tree, left[odd], of[odd])
                left = left + odd
                odd = (right & 1) == 1
                np.minimum.at(tree, right[odd] - 1, of[odd])
                right = right - odd
                more = left >> 1 < right >> 1
                left, right, of = left[more] >> 1, right[more] >> 1, of[more]

    def place(self, t: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.marks, t, "left") + np.searchsorted(self.marks, t, "right")

    def nearest(self, t: np.ndarray, around_ns: int) -> tuple[np.ndarray, np.ndarray]:
        """(id, whether there is one) for each time."""
        choices = []
        for order, tree in zip(self.orders, self.trees, strict=True):
            node, rank = self.place(t) + self.width, np.full(len(t), len(self.ids))
            while len(node) and node[0] > 0:
                rank = np.minimum(rank, tree[node])
                node = node >> 1
            choices.append(np.append(order, -1)[rank])
        for rows, at in ((self.ends, np.searchsorted(self.e[self.ends], t, "right") - 1), (self.starts, np.searchsorted(self.s[self.starts], t, "left"))):
            choices.append(np.where((at >= 0) & (at < len(rows)), np.append(rows, -1)[np.clip(at, 0, len(rows))], -1))
        best, there = np.full(len(t), -1), np.zeros(len(t), bool)
        s, e, ids = (np.append(c, 0) for c in (self.s, self.e, self.ids))
        worst = np.iinfo(np.int64).max
        keys = [np.full(len(t), worst) for _ in range(4)]
        for row in choices:
            before, after = np.abs(s[row] - t), np.abs(e[row] - t)
            inside, edge = (s[row] <= t) & (t <= e[row]), np.minimum(before, after)
            own = [(~inside).astype(np.int64), edge, s[row], ids[row]]
            good, same = np.zeros(len(t), bool), (row >= 0) & (inside | (edge <= around_ns))
            there = there | same
            for mine, best_ in zip(own, keys, strict=True):
                good |= same & (mine < best_)
                same &= mine == best_
            best = np.where(good, row, best)
            keys = [np.where(good, mine, best_) for mine, best_ in zip(own, keys, strict=True)]
        return ids[best], there


def activity(focus: DataFrame, since_ns: int = 0, until_ns: int = 0, limit: int | None = None) -> DataFrame:
    """Time by application and title of the rows that overlap [since, until]; until 0 is open. Whole
    dwells count. Longest first."""
    rows = focus.where((F.col("t_end_ns") >= since_ns) & (F.lit(until_ns == 0) | (F.col("t_start_ns") <= until_ns)) & (F.col("title") != ""))
    out = rows.groupBy("app_id", "title").agg(F.min("t_start_ns").alias("first_ns"), F.max("t_end_ns").alias("last_ns"), F.sum("dwell_ms").alias("dwell_ms"))
    order = [F.desc("dwell_ms"), "app_id", "title"]
    return out.orderBy(*order).limit(limit) if limit else out


def activity_media(chunks: DataFrame, since_ns: int, until_ns: int, limit: int) -> DataFrame:
    rows = chunks.where((F.col("domain") == "media_playback") & (F.col("t_ns") >= since_ns) & (F.lit(until_ns == 0) | (F.col("t_ns") <= until_ns)))
    return rows.select("chunk_id", "doc_id", "text", "t_ns", "taint").orderBy("t_ns", "doc_id").limit(limit)


def merged_entities(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, renames): entities of one domain and label become the one of smallest id, which spans
    them all, is permanent if any was and bears all taints. renames: (id, keep) of the others."""
    keep = entities.groupBy("domain", "label").agg(F.min("id").alias("keep"), F.min_by("kind", "id").alias("kind"), F.bit_or("taint").alias("taint"), F.min("created_ns").alias("created_ns"), F.max("last_seen_ns").alias("last_seen_ns"), F.bool_or("permanent").alias("permanent"))
    renames = entities.select("id", "domain", "label").join(keep.select("domain", "label", "keep"), ["domain", "label"]).where("id <> keep").select("id", "keep")
    return keep.withColumnRenamed("keep", "id"), renames


def merged_edges(edges: DataFrame, renames: DataFrame) -> DataFrame:
    """edges between kept entities: of those that fall together the one that was there stays, else the
    one of smallest old ends; edges that become loops go."""
    a, b = (renames.select(F.col("id").alias(x), F.col("keep").alias(f"new_{x}")) for x in ("src", "dst"))
    m = edges.join(a, "src", "left").join(b, "dst", "left")
    moved = F.coalesce(F.col("new_src"), F.col("new_dst")).isNotNull()
    m = m.select(F.coalesce("new_src", "src").alias("to_src"), F.coalesce("new_dst", "dst").alias("to_dst"), "kind", F.struct(moved.alias("moved"), "src", "dst").alias("rank"), "weight", "reinforced_ns", "hypothesis")
    best = m.where("to_src <> to_dst").groupBy("to_src", "to_dst", "kind").agg(F.min_by(F.struct("weight", "reinforced_ns", "hypothesis"), "rank").alias("e"))
    return best.select(F.col("to_src").alias("src"), F.col("to_dst").alias("dst"), "kind", "e.*")


def without_entities(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges with neither end among gone (id)."""
    return edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select(*edges.columns)


def cutoffs(domain: Column, now_ns: int) -> Column:
    """The time before which rows of a domain expire; null for domains that are kept."""
    days = {k: str(v) for k, v in RETENTION.items() if v is not None}
    kept = domain.isin(*[k for k, v in RETENTION.items() if v is None])
    return F.when(~kept, F.lit(now_ns) - F.coalesce(mapped(domain, days).cast("long"), F.lit(OTHER_DAYS)) * DAY_NS)


def expired(rows: DataFrame, time: str, now_ns: int) -> Column:
    return F.coalesce(F.col(time) < cutoffs(F.col("domain"), now_ns), F.lit(False))


def duration_ns(text: Column) -> Column:
    """Nanoseconds of 30s, 15m, 2h, 1d or 1w; null for anything else and for what overflows."""
    unit = F.regexp_extract(text, r"^([0-9]+)([smhdw])$", 2)
    seconds = mapped(unit, {k: str(v) for k, v in UNITS.items()}).cast("long")
    return F.try_multiply(F.regexp_extract(text, r"^([0-9]+)([smhdw])$", 1).try_cast("long"), seconds * F.lit(1_000_000_000))


def clamped(count: Column, most: int) -> Column:
    return F.least(F.greatest(count, F.lit(1)), F.lit(most))
