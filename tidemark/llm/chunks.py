"""Finding repeats across a corpus with packed arrays.

Documents are dealt by a hash of doc_id and text into chunks of about CHUNK_BYTES of text. A chunk sends the
distinct keys of its windows, sorted and packed, to shards (ranges of the key space); a shard sees
each key of a chunk once, however often the chunk has it, and answers every chunk with a few bits for
each key, in the order sent. A hot key therefore costs a shard one entry a chunk. Every step is a
grouped Arrow function with a bounded group: a chunk, or a shard whose range shrinks as the corpus
grows. Nothing is collected or broadcast but the total size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
CHUNK_BYTES = 2 << 20
LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Corpus:
    """texts: (chunk, doc_id, text), dealt out by chunk; total: bytes of text."""

    texts: DataFrame
    total: int
    shards: int

    @property
    def bits(self) -> int:
        """log2 of a key space with at least one place for each byte of text."""
        return max(16, int(self.total).bit_length())

    def ask(self, f: Callable[[pa.Table, pa.Table | None], list], answers: DataFrame | None = None) -> DataFrame:
        """Rows (shard, chunk, body) that f makes from each chunk and the answers to it."""
        schema = "shard int, chunk int, body binary"
        return self.over(lambda rows, got: as_rows(f(rows, got), int(rows["chunk"][0].as_py())), schema, answers)

    def over(self, f: Callable[[pa.Table, pa.Table | None], pa.Table], schema: str, answers: DataFrame | None = None) -> DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]
        if answers is None:
            return self.texts.groupBy("chunk").applyInArrow(lambda rows: f(ordered(rows), None), schema)
        empty = lambda: pa.table({n: pa.array([], pa.int64()) for n in names})
        return self.texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda rows, got: f(ordered(rows), got) if rows.num_rows else typed(empty(), schema), schema)


def ordered(rows: pa.Table) -> pa.Table:
    """A chunk's rows in one order however often they are read: answers refer to places."""
    return rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def typed(table: pa.Table, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return table.cast(pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]))


def as_rows(sent: list[tuple[int, list[np.ndarray]]], chunk: int) -> pa.Table:
    return pa.table({"shard": pa.array([k for k, _ in sent], pa.int32()), "chunk": pa.array([chunk] * len(sent), pa.int32()), "body": pa.array([packed(*x) for _, x in sent], pa.binary())})


def corpus(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> Corpus:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n = max(1, -(-total // chunk_bytes))
    texts = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("chunk"), "doc_id", "text").repartition(n, "chunk")
    return Corpus(texts, total, 1 << max(0, (n // 2).bit_length() - 1))


def answered(asked: DataFrame, f: Callable[[list[list[np.ndarray]]], list[np.ndarray]], kind: int) -> DataFrame:
    """(chunk, kind, shard, body): what f answers to each asking chunk of a shard, packed."""

    def merge(rows: pa.Table) -> pa.Table:
        got = f([unpacked(x) for x in rows["body"].to_pylist()])
        return pa.table({"chunk": rows["chunk"], "kind": pa.array([kind] * len(got), pa.int32()), "shard": rows["shard"], "body": pa.array([packed(x) for x in got], pa.binary())})

    return asked.groupBy("shard").applyInArrow(merge, "chunk int, kind int, shard int, body binary")


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes (an ascending uint64 array as its differences), compressed."""
    parts = []
    for a in arrays:
        rising = a.dtype == U and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        flat = np.diff(a, prepend=U(0)) if rising else a
        parts += [np.array([len(a), rising], np.int64).tobytes() + f"{a.dtype.str:8}".encode(), np.ascontiguousarray(flat.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b""]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(body: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    while at < len(raw):
        n, rising = np.frombuffer(raw, np.int64, 2, at)
        dtype = np.dtype(raw[at + 16 : at + 24].decode().strip())
        at += 24
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        flat = np.ascontiguousarray(planes.T).view(dtype).reshape(n)
        out.append(np.cumsum(flat, dtype=U) if rising else flat)
        at += n * dtype.itemsize
    return out


def dealt(key: np.ndarray, bits: int, shards: int, *more: np.ndarray) -> list[tuple[int, list[np.ndarray]]]:
    """Ascending keys below 2**bits, and what goes with them, by shard."""
    edges = np.searchsorted(key, np.array([(k << bits) // shards for k in range(1, shards)], U))
    edges = [0, *edges.tolist(), len(key)]
    return [(k, [x[a:b] for x in (key, *more)]) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]


def told(got: pa.Table, kind: int) -> np.ndarray:
    """The answers of a kind, put together in the order in which dealt() sent the keys."""
    rows = sorted((s, b) for s, k, b in zip(got["shard"].to_pylist(), got["kind"].to_pylist(), got["body"].to_pylist(), strict=True) if k == kind)
    parts = [unpacked(b)[0] for _, b in rows]
    return np.concatenate(parts) if parts else np.empty(0, np.uint8)


def ids(rows: pa.Table) -> np.ndarray:
    """doc_id of each row; a null id is larger than all others."""
    return np.asarray(rows["doc_id"].combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False), np.int64)
