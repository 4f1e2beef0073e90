"""Binary recordings: a header (magic, version, creation time, anonymised or not), then frames with a
little-endian length before each."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.sources.storage import file_system

#: Fixed values of the format.
MAGIC, VERSION, MOST = b"NRMD", 1, 4 << 20
HEADER, BATCH = struct.Struct("<4sIQB"), 8 << 20


class RecordingError(ValueError):
    """A recording that cannot be read: not one, of another version, or cut off."""


def frames(content: bytes) -> Iterator[bytes]:
    """Frames in order; the end of the content after a whole frame is the end."""
    if len(content) < HEADER.size:
        raise RecordingError("header is cut off")
    magic, version, _, _ = HEADER.unpack_from(content)
    if magic != MAGIC or version != VERSION:
        raise RecordingError(f"not a recording of version {VERSION}")
    at = HEADER.size
    while at < len(content):
        if at + 4 > len(content):
            raise RecordingError("frame length is cut off")
        (size,) = struct.unpack_from("<I", content, at)
        if size > MOST:
            raise RecordingError(f"frame of {size} bytes, more than {MOST}")
        if at + 4 + size > len(content):
            raise RecordingError("frame is cut off")
        yield content[at + 4 : at + 4 + size]
        at += 4 + size


def made(content: bytes) -> tuple[int, bool]:
    """When a recording was made and whether it is anonymised."""
    _, _, created, anonymised = HEADER.unpack_from(content)
    return created, bool(anonymised)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, created_ns, anonymised, seq, frame) of the recordings at a path or glob, one file a task at most. Frames leave
    in batches of about BATCH bytes."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_buffer()
                parts, held, seq, (created, anonymised) = [], 0, 0, (0, False)
                for n, part in enumerate(frames(memoryview(content))):
                    created, anonymised = made(memoryview(content))
                    parts.append(part)
                    held += len(part)
                    if held > BATCH or len(parts) == 4096:
                        yield rows(name, created, anonymised, seq, parts)
                        parts, held, seq = [], 0, n + 1
                yield rows(name, created, anonymised, seq, parts)

    def rows(name: str, created: int, anonymised: bool, seq: int, parts: list) -> pa.RecordBatch:
        n = len(parts)
        return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([created] * n, pa.int64()), pa.array([anonymised] * n, pa.bool_()), pa.array(range(seq, seq + n), pa.int64()), pa.array([bytes(x) for x in parts], pa.binary())], ["path", "created_ns", "anonymised", "seq", "frame"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(split, "path string, created_ns bigint, anonymised boolean, seq bigint, frame binary")


def encode(parts: list[bytes], created_ns: int, anonymised: bool) -> bytes:
    if any(len(x) > MOST for x in parts):
        raise RecordingError(f"a frame has more than {MOST} bytes")
    return HEADER.pack(MAGIC, VERSION, created_ns, anonymised) + b"".join(struct.pack("<I", len(x)) + x for x in parts)


class Recordings(DataSource):
    """Spark's sink of recordings: df.write.format("recording").option("created_ns", ...).save(path)."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def writer(self, schema: StructType, overwrite: bool) -> RecordingWriter:
        return RecordingWriter({k: self.options[k] for k in ("path", "created_ns", "anonymised") if k in self.options})


class RecordingWriter(DataSourceWriter):
    """Each task writes its frames, in order, to a file of its own under a hidden name; the files get their names once all tasks
    are done, so a task that failed or ran twice leaves nothing behind."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def write(self, iterator: Iterator) -> Part:
        fs, root = pafs.FileSystem.from_uri(self.options["path"])
        task = TaskContext.get()
        name = f"{root}/_part-{task.partitionId():06d}-{task.taskAttemptId()}"
        with fs.open_output_stream(name) as out:
            out.write(encode([], int(self.options["created_ns"]), self.options["anonymised"] == "true"))
            for row in iterator:
                if len(row.frame) > MOST:
                    raise RecordingError(f"a frame has more than {MOST} bytes")
                out.write(struct.pack("<I", len(row.frame)) + bytes(row.frame))
        return Part(name)

    def commit(self, messages: list) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.options["path"])
        for m in messages:
            folder, _, name = m.name.rpartition("/")
            fs.move(m.name, f"{folder}/{name[1:].rpartition('-')[0]}.rec")

    def abort(self, messages: list) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.options["path"])
        for m in messages:
            if m is not None:
                fs.delete_file(m.name)


@dataclass
class Part(WriterCommitMessage):
    name: str


def write(rows: DataFrame, path: str, created_ns: int, anonymised: bool) -> None:
    """Rows (seq, frame) as recordings under a folder that must not exist yet, one for each partition, read back by read()."""
    spark = rows.sparkSession
    fs, at = file_system(spark, path)
    if fs.exists(at):
        raise RecordingError(f"{path} is there already")
    fs.mkdirs(at)
    spark.dataSource.register(Recordings)
    uri = path if "://" in path else f"file://{path}"
    ordered = rows.select("seq", "frame").sortWithinPartitions("seq").select("frame")
    ordered.write.format("recording").mode("append").option("created_ns", created_ns).option("anonymised", str(anonymised).lower()).save(uri)
