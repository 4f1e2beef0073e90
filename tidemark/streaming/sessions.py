"""The ingest filter on live events: the batch operators' results, one micro-batch after another.

State is one small row a window, until it closes. The gate and the cool-down, whose keys leave, are in streaming.bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.text import normal_title
from tidemark.operators.ingest import self_observed
from tidemark.sources.storage import entries, file_system

TOUCH = "seq long, t_ns long, toplevel_id long, app_id string, pid long, occurrence boolean, t_start_ns long, t_end_ns long, title string"
WINDOW = "app_id string, title string, plain string, pid long, since long"


def segments(events: DataFrame, own: tuple[str, ...] = (), prefix: str = "\x00") -> DataFrame:
    """The touches of operators.ingest.segments from a stream of window events that arrive in order. A window is known until it
    closes, however long it is silent: its state is one small row."""
    e = events.where((F.col("kind") != "Opened") | ~self_observed(F.col("app_id"), own, prefix))
    e = e.select("seq", "t_ns", "toplevel_id", "kind", "app_id", "title", F.coalesce(normal_title(F.col("title")), F.lit("")).alias("plain"), "pid", "active")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        app, title, plain, pid, since = state.get if state.exists else (None, None, None, None, None)
        out = []

        def touch(r, occurrence: bool) -> None:
            end = None if occurrence else r.t_ns
            out.append((r.seq, r.t_ns, key[0], app, pid, occurrence, None if occurrence else since, end, None if occurrence else plain))

        rows = sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: r.seq)
        for r in rows:
            if r.kind == "Opened":
                app, title, plain = r.app_id, r.title, r.plain
                pid = pid if pd.isna(r.pid) else int(r.pid)
            elif app is None:
                continue
            elif r.kind == "AppIdChanged":
                app = r.app_id
            elif r.kind == "TitleChanged":
                if since is not None and r.plain != plain:
                    touch(r, False)
                    since = r.t_ns
                title, plain = r.title, r.plain
            elif r.kind == "StateChanged" and r.active:
                since = r.t_ns
                touch(r, True)
            else:
                if since is not None:
                    touch(r, False)
                since = None
                if r.kind == "Closed":
                    app = title = plain = pid = None
        if app is None:
            if state.exists:
                state.remove()
        else:
            state.update((app, title, plain, pid, since))
        if out:
            # nanoseconds do not survive a float column, which None would make
            exact = {"long": "Int64", "string": object, "boolean": bool}
            names = [c.split() for c in TOUCH.split(", ")]
            yield pd.DataFrame({n: pd.array(v, dtype=exact[kind]) for (n, kind), v in zip(names, zip(*out, strict=True), strict=True)})

    return e.groupBy("toplevel_id").applyInPandasWithState(fold, TOUCH, WINDOW, "append", GroupStateTimeout.NoTimeout)


def bursts(inserts: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(family, start, end, n): runs of inserts (family, at timestamp) without a pause longer than gap."""
    s = inserts.withWatermark("at", late).groupBy("family", F.session_window("at", gap).alias("w"))
    return s.agg(F.count(F.lit(1)).alias("n")).select("family", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def written_once(batch: DataFrame, batch_id: int, root: str, names: dict[str, object]) -> None:
    """For foreachBatch: every table that a micro-batch makes goes to a folder named by the batch, overwritten when the batch
    is run again; a mark written last says that all of them are there. So a retry neither loses nor doubles rows, and
    whole_batches() shows all tables of a batch or none. names: table -> function of the batch."""
    batch.persist()
    try:
        for name, make in names.items():
            make(batch).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        fs, mark = file_system(batch.sparkSession, f"{root}/_whole/{batch_id}")
        fs.create(mark, True).close()
    finally:
        batch.unpersist()


def whole_batches(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of written_once(), without batches that were not finished."""
    done = [int(x) for x in entries(spark, f"{root}/_whole")]
    if not done:
        raise LookupError(f"no finished batch in {root}")
    return spark.read.parquet(f"{root}/{name}").where(F.col("batch").isin(done)).drop("batch")
