"""A live source over recordings that grow: a stream of their frames that stops and resumes anywhere, also within a file.

An offset holds, for each file, the place behind its last whole frame and the number of frames so far, so a frame that is still
being written is left for later and each one comes once. The driver reads the lengths of new frames only, at most
`frames_a_batch` a file and micro-batch; the frames themselves are read by tasks. A frame that cannot be decoded is a row of the
table of bad events and stops nothing; where a file can no longer be cut into frames, one row says so and the file ends there.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.sources.recordings import BATCH, HEADER, MAGIC, MOST, VERSION

SCHEMA = "path string, seq bigint, frame binary, fault string"


@dataclass
class Range(InputPartition):
    """Frames of a file between two places that lie behind whole frames, or what is wrong at the first of them."""

    path: str
    start: int
    end: int
    seq: int
    fault: str


class LiveRecordings(DataSource):
    """spark.readStream.format("live_recording").option("path", folder); new files and new frames are found as they come."""

    @classmethod
    def name(cls) -> str:
        return "live_recording"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> LiveReader:  # noqa: N802
        return LiveReader(self.options["path"], int(self.options.get("frames_a_batch", "100000")))


class LiveReader(DataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most, self.reached = path if "://" in path else f"file://{path}", most, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = {x.path: x.size for x in fs.get_file_info(pafs.FileSelector(root)) if x.is_file and x.path.endswith(".rec")}
        for path, size in sorted(found.items()):
            at, seq, fault = self.reached.get(path, [0, 0, ""])
            if not fault and size > at:
                self.reached[path] = self.walked(fs, path, at, seq, size)
        return {"files": {p: list(v) for p, v in self.reached.items()}}

    def walked(self, fs: pafs.FileSystem, path: str, at: int, seq: int, size: int) -> list:
        """[place, frames, fault] behind the whole frames that are there by now."""
        with fs.open_input_file(path) as f:
            if at == 0:
                if size < HEADER.size:
                    return [0, 0, ""]
                magic, version, _, _ = HEADER.unpack(f.read_at(HEADER.size, 0))
                if magic != MAGIC or version != VERSION:
                    return [0, 0, f"not a recording of version {VERSION}"]
                at = HEADER.size
            for _ in range(self.most):
                if at + 4 > size:
                    break
                (n,) = struct.unpack("<I", f.read_at(4, at))
                if n > MOST:
                    return [at, seq, f"frame of {n} bytes, more than {MOST}"]
                if at + 4 + n > size:
                    break
                at, seq = at + 4 + n, seq + 1
            return [at, seq, ""]

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.reached |= {p: v for p, v in end["files"].items() if p not in self.reached}  # after a restart
        out = []
        for path, (at, seq, fault) in end["files"].items():
            a, s, known = start["files"].get(path, [0, 0, ""])
            if at > a or fault != known:
                out.append(Range(path, max(a, HEADER.size), at, s, "" if fault == known else fault))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        frames, held, seq, at = [], 0, partition.seq, partition.start
        with fs.open_input_file(partition.path) as f:
            while at < partition.end:
                (n,) = struct.unpack("<I", f.read_at(4, at))
                frames.append(f.read_at(n, at + 4))
                at, held = at + 4 + n, held + n
                if held > BATCH or len(frames) == 4096:
                    yield rows(partition.path, seq, frames, [None] * len(frames))
                    seq, frames, held = seq + len(frames), [], 0
        faults = [None] * len(frames)
        if partition.fault:
            frames.append(None)
            faults.append(partition.fault)
        if frames:
            yield rows(partition.path, seq, frames, faults)

    def commit(self, end: dict) -> None:
        pass


def rows(path: str, seq: int, frames: list, faults: list) -> pa.RecordBatch:
    n = len(frames)
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(seq, seq + n), pa.int64()), pa.array(frames, pa.binary()), pa.array(faults, pa.string())], ["path", "seq", "frame", "fault"])


def live(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The stream of frames (path, seq, frame, fault) of the recordings in a folder."""
    spark.dataSource.register(LiveRecordings)
    return spark.readStream.format("live_recording").options(path=path, **options).load()


def decoded(frames: DataFrame, schema: str) -> DataFrame:
    """frames (path, seq, frame, fault) with `event`, the frame as JSON of a schema, and in `fault` why there is none."""
    event = F.from_json(F.decode("frame", "UTF-8"), f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = frames.withColumn("event", event)
    broken = F.col("frame").isNotNull() & (F.col("event").isNull() | F.col("event._broken").isNotNull())
    return rows.withColumn("fault", F.coalesce("fault", F.when(broken, "frame cannot be decoded"))).withColumn("event", F.when(F.col("fault").isNull(), F.col("event").dropFields("_broken")))


def events(rows: DataFrame) -> DataFrame:
    return rows.where("fault IS NULL").select("path", "seq", "event.*")


def bad_events(rows: DataFrame) -> DataFrame:
    """(path, seq, frame, fault) of what could not be taken."""
    return rows.where("fault IS NOT NULL").select("path", "seq", "frame", "fault")
