"""A stored index of vectors that outlives a query: cells, product-quantised residuals, exact re-ranking.

A model (centres of cells, codebooks for the parts of what is left of a vector after its cell's centre) is fitted once on a
bounded sample. Every vector is stored with its cell and its code of one byte a part, packed into blocks of one cell. A search
compares codes alone in the cells nearest to a probe; its `refine` best by code are then compared in full. New vectors are
appended to the blocks. Families are stored apart; a family has generations, each in a folder of its own and with the id of the model
that embedded it, and a new one takes the place of the old one with the file that names it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.search import PROBES, matrix, members, of_width
from tidemark.sources.storage import entries

#: Vectors in a block, and distances by code that are held at a time.
BLOCK, HELD = 8192, 1 << 21


def kmeans(x: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """At most n centres of x; where x has fewer rows, those."""
    centres = x[rng.permutation(len(x))[: min(n, len(x))]].copy()
    for _ in range(rounds if len(centres) < len(x) else 0):
        own = nearest_centres(x, centres, 1)[:, 0]
        count = np.bincount(own, minlength=len(centres))
        total = np.stack([np.bincount(own, weights=column, minlength=len(centres)) for column in x.T], axis=1)
        centres[count > 0] = (total[count > 0] / count[count > 0, None]).astype(x.dtype)
    return centres


def nearest_centres(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    far = (centres * centres).sum(axis=1) - 2 * x @ centres.T
    return far.argmin(axis=1)[:, None] if k == 1 else np.argsort(far, axis=1, kind="stable")[:, :k]


@dataclass(frozen=True)
class Model:
    """centres: (cells, width); books: (parts, codes, width / parts), of residuals."""

    centres: np.ndarray
    books: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, cells: int, parts: int, codes: int, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        centres = kmeans(x, cells, 10, rng)
        left = (x - centres[nearest_centres(x, centres, 1)[:, 0]]).reshape(len(x), parts, -1)
        books = [kmeans(np.ascontiguousarray(left[:, p]), codes, 10, rng) for p in range(parts)]
        return Model(centres, np.stack(books))

    def cells(self, x: np.ndarray, k: int) -> np.ndarray:
        return nearest_centres(x, self.centres, min(k, len(self.centres)))

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        left = (x - self.centres[cell]).reshape(len(x), len(self.books), -1)
        return np.stack([nearest_centres(left[:, p], book, 1)[:, 0] for p, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def by_code(self, probes: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """(probes, codes): squared distances from probes to what codes of a cell stand for."""
        left = (probes - self.centres[cell]).reshape(len(probes), len(self.books), -1)
        out = np.zeros((len(probes), len(codes)), np.float32)
        for p, book in enumerate(self.books):
            far = (left[:, p] ** 2).sum(axis=1)[:, None] + (book**2).sum(axis=1)[None, :] - 2 * left[:, p] @ book.T
            out += far[:, codes[:, p]]
        return out


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


class VectorIndex:
    """An index in the folder `path`: model, blocks by family and generation, and the generations of families."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        row = spark.read.parquet(f"{self.path}/model").first()
        self.width = row.width
        self.model = Model(np.frombuffer(row.centres, np.float32).reshape(-1, row.width), np.frombuffer(row.books, np.float32).reshape(row.parts, -1, row.width // row.parts))

    @classmethod
    def create(cls, vectors: DataFrame, path: str, cells: int = 32, parts: int = 16, codes: int = 256, sample: int = 20_000, seed: int = 11) -> VectorIndex:
        """An index without vectors, its model fitted on at most `sample` of these (id, vector), the first by a hash of the id. The
        width of a vector is a multiple of `parts`; codes are 256 at most."""
        rows = vectors.where("vector IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
        if not rows.num_rows:
            raise ValueError("an index needs vectors to fit its model on")
        x = matrix(rows["vector"].combine_chunks(), rows.num_rows).astype(np.float32)
        if x.shape[1] % parts or not 0 < codes <= 256:
            raise ValueError("the parts must divide the width, and a code is one byte")
        model = Model.fit(x, cells, parts, codes, seed)
        row = [(x.shape[1], parts, bytearray(packed(model.centres)), bytearray(packed(model.books)))]
        vectors.sparkSession.createDataFrame(row, "width int, parts int, centres binary, books binary").coalesce(1).write.parquet(f"{path}/model")
        return cls(vectors.sparkSession, path)

    # ---- families ----

    def families(self) -> DataFrame:
        """(family, generation, folder, model_id) that count: the newest generation of each family."""
        schema = "family string, generation int, folder string, model_id string"
        if not entries(self.spark, f"{self.path}/families"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/families")
        return rows.groupBy("family").agg(F.max(F.struct("generation", "folder", "model_id")).alias("g")).select("family", "g.*")

    def current(self) -> dict[str | None, tuple[int, str, str]]:
        """Generation, folder and model of each family: a fixed handful, with one small file for each of their generations."""
        return {r.family: (r.generation, r.folder, r.model_id) for r in self.families().collect()}

    def name(self, found: list[tuple[str | None, int, str, str]]) -> None:
        self.spark.createDataFrame(found, "family string, generation int, folder string, model_id string").coalesce(1).write.mode("append").parquet(f"{self.path}/families")

    def insert(self, vectors: DataFrame, model_id: str = "") -> None:
        """Appends vectors (id, family, vector) with new ids to their families; a family that is new gets its first generation. A
        vector of another width is an error; rows without one are left out."""
        known = self.current()
        rows = of_width(vectors.where("vector IS NOT NULL"), self.width)
        new = {r.family: uuid.uuid4().hex for r in rows.select("family").distinct().collect() if r.family not in known}
        self.write(rows, {f: folder for f, (_, folder, _) in known.items()} | new)
        if new:
            self.name([(f, 1, folder, model_id) for f, folder in new.items()])

    def replace(self, family: str, vectors: DataFrame, model_id: str) -> None:
        """Puts vectors (id, vector) in the place of all of a family's. They are written first, to a folder that nobody reads; readers
        see the old ones until the one file that names the new folder and its model is there, and the new ones from then on."""
        folder = uuid.uuid4().hex
        self.write(of_width(vectors.where("vector IS NOT NULL"), self.width).withColumn("family", F.lit(family)), {family: folder})
        self.name([(family, self.current().get(family, (0, "", ""))[0] + 1, folder, model_id)])

    def write(self, rows: DataFrame, folders: dict[str | None, str]) -> None:
        """Vectors by blocks. A block is a share of a cell by a hash of the id, so a cell with most of the vectors has many."""
        model, shares = self.model, max(1, -(-rows.count() // (len(self.model.centres) * BLOCK)))
        schema = "family string, cell int, block string, n int, ids binary, codes binary, vectors binary"

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell = model.cells(matrix(batch.column(2), batch.num_rows).astype(np.float32), 1)[:, 0]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["id", "family", "vector", "cell"])

        def pack(own: pa.Table) -> pa.Table:
            x = matrix(own["vector"].combine_chunks(), own.num_rows).astype(np.float32)
            cell, ids = own["cell"].to_numpy(), own["id"].to_numpy()
            codes, at = model.encode(x, cell), range(0, own.num_rows, BLOCK)
            part = lambda a: [packed(a[i : i + BLOCK]) for i in at]
            first = {"family": [own["family"][0].as_py()] * len(at), "cell": [int(cell[0])] * len(at), "block": [uuid.uuid4().hex for _ in at], "n": [min(BLOCK, own.num_rows - i) for i in at]}
            return pa.table(first | {"ids": part(ids), "codes": part(codes), "vectors": part(x)}).cast(pa.schema([("family", pa.string()), ("cell", pa.int32()), ("block", pa.string()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "codes", "vectors"))]))

        cells = rows.select(F.col("id").cast("bigint"), "family", "vector").mapInArrow(assign, "id bigint, family string, vector array<float>, cell int")
        blocks = cells.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int")).groupBy("family", "cell", "share").applyInArrow(pack, schema)
        folder = F.coalesce(*[F.when(F.col("family").eqNullSafe(f), F.lit(x)) for f, x in folders.items()], F.lit("none"))
        blocks.withColumn("folder", folder).write.mode("append").partitionBy("family", "folder").parquet(f"{self.path}/blocks")

    def blocks(self, families: list[str] | None = None) -> DataFrame:
        """The blocks that count, of some families alone if named."""
        schema, known = "cell int, block string, n int, ids binary, codes binary, vectors binary, family string, folder string", self.current()
        if not known:
            return self.spark.createDataFrame([], schema)
        own = [F.col("family").eqNullSafe(f) & (F.col("folder") == folder) for f, (_, folder, _) in known.items() if families is None or f in families]
        return self.spark.read.schema(schema).parquet(f"{self.path}/blocks").where(reduce(lambda a, b: a | b, own, F.lit(False)))

    def vectors(self, families: list[str] | None = None) -> DataFrame:
        """(id, family, vector) of all that is stored."""
        width = self.width

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for family, ids, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    ids = np.frombuffer(ids, np.int64)
                    flat = pa.array(np.frombuffer(x, np.float32))
                    offsets = pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([family] * len(ids), pa.string()), pa.ListArray.from_arrays(offsets, flat)], ["id", "family", "vector"])

        return self.blocks(families).select("family", "ids", "vectors").mapInArrow(unpack, "id bigint, family string, vector array<float>")

    # ---- search ----

    def search(self, probes: DataFrame, k: int, visits: int, refine: int, families: list[str] | None = None, by_family: bool = False) -> DataFrame:
        """(q_id, id, family, distance, rank): the k nearest of the `refine` vectors that are nearest by code to each probe (q_id, probe)
        in the `visits` cells nearest to it; within each family if asked. refine * probes vectors are compared in full."""
        model, width, by = self.model, self.width, ["q_id", "family"] if by_family else ["q_id"]
        asked = probes.where("probe IS NOT NULL").select(F.col("q_id").cast("bigint"), F.col("probe").cast("array<float>").alias("probe"))
        groups = F.lit(max(1, -(-asked.count() // PROBES)))
        asked = asked.withColumn("part", F.pmod(F.xxhash64("q_id"), groups).cast("int"))

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell = model.cells(matrix(batch.column(1), batch.num_rows).astype(np.float32), visits)
                    take = pa.array(np.repeat(np.arange(batch.num_rows), cell.shape[1]))
                    yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(cell.reshape(-1).astype(np.int32))], ["q_id", "probe", "part", "cell"])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, (ids, x) in zip(batch.drop_columns("asked").to_pylist(), members(batch.column("asked"), "q_id", "probe"), strict=True):
                    codes, x = np.frombuffer(row["codes"], np.uint8).reshape(row["n"], -1), x.astype(np.float32)
                    step = max(1, HELD // row["n"])
                    for at in range(0, len(x), step):
                        far = model.by_code(x[at : at + step], row["cell"], codes)
                        few = min(refine, row["n"])
                        best = np.argpartition(far, few - 1, axis=1)[:, :few]
                        of = np.repeat(np.arange(len(far)), few)
                        flat = best.reshape(-1)
                        n = len(flat)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[at:][of]), pa.array([row["family"]] * n, pa.string()), pa.array([row["block"]] * n), pa.array(flat.astype(np.int32)), pa.array(far[of, flat].astype(np.float64))],
                            ["q_id", "family", "block", "place", "near"],
                        )

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, (q, place, probe) in zip(batch.drop_columns("asked").to_pylist(), members(batch.column("asked"), "q_id", "place", "probe"), strict=True):
                    x, ids = np.frombuffer(row["vectors"], np.float32).reshape(-1, width), np.frombuffer(row["ids"], np.int64)
                    far = ((x[place].astype(np.float64) - probe) ** 2).sum(axis=1).round(6)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[place]), pa.array([row["family"]] * len(q), pa.string()), pa.array(far)], ["q_id", "id", "family", "distance"])

        blocks = self.blocks(families)
        cells = asked.mapInArrow(places, "q_id bigint, probe array<float>, part int, cell int").groupBy("cell", "part").agg(F.collect_list(F.struct("q_id", "probe")).alias("asked"))
        coded = blocks.select("family", "cell", "block", "n", "codes").join(cells.drop("part"), "cell").mapInArrow(scan, "q_id bigint, family string, block string, place int, near double")
        order = W.partitionBy(*by).orderBy("near", "block", "place")
        few = coded.withColumn("r", F.row_number().over(order)).where(F.col("r") <= refine).join(asked, "q_id")
        wanted = few.groupBy("block", "part").agg(F.collect_list(F.struct("q_id", "place", "probe")).alias("asked"))
        full = blocks.select("family", "block", "ids", "vectors").join(wanted.drop("part"), "block").mapInArrow(compare, "q_id bigint, id bigint, family string, distance double")
        rank = F.row_number().over(W.partitionBy(*by).orderBy("distance", "id"))
        return full.withColumn("rank", rank).where(F.col("rank") <= k)
