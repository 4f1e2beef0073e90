"""Near-duplicate documents by MinHash and a multi-index Hamming join.

A document's set holds its distinct `shingle`-word runs (words lower-cased in A-Z); with fewer words,
the whole sequence is one. Signatures have PLACES components of 16 bits. Two sets of the wanted
similarity differ in more than `radius` components with a chance below 1e-5; signatures are split
into (radius + 1) / 2 chunks, so a pair within the radius has a chunk with one error at most, and
leaving out each component of each chunk in turn gives keys of which such a pair shares one. Every
pair within the radius is therefore met, and links are confirmed on full sets.

Equal sets collapse into one node before anything is joined. In the bucket of a key, members are first
tried against its hub, the member whose keys meet most others, which settles groups of copies in as many
pairs as members. Two sets that share a key also share its hub; so the members of a hub that are
not in its component then meet all its members, exactly and in blocks of bounded size. No bucket is
capped and none goes to one task.

A text without words (or null) has an empty set and is linked with nothing. Rows that share a
doc_id are one document and so linked; a null id is one too, larger than all others. Extra columns are
ignored by classes() and kept by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.shared import stored
from tidemark.llm.textops import U, Words, mix, slices

PLACES, BLOCK, BLOCK_SHINGLES, COLUMNS, SALTS = 64, 1024, 1 << 20, 4096, 16
LAST = (1 << 63) - 1


def radius(percent: int) -> int:
    """Components in which sets of that similarity differ, and 4.5 standard deviations more."""
    p = 1 - percent / 100
    most = PLACES * p + 4.5 * (PLACES * p * (1 - p)) ** 0.5
    return min(PLACES - 1, 2 * int(-(-(most + 1) // 2)) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes by row, ascending within a row, and the bounds of the rows."""
    words = Words(data, offsets, lower=True)
    at, code = words.windows(shingle)
    row = words.row()[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
    for n in range(1, shingle):
        rows = short[words.counts[short] == n]
        whole = np.zeros(len(rows), U)
        for k in range(n):
            whole = mix(whole + words.code[words.first[rows] + k] + U(n))
        row, code = np.concatenate([row, rows]), np.concatenate([code, whole])
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    row, code = row[new], code[new]
    return code, np.searchsorted(row, np.arange(len(offsets)))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sig): set size, a 128-bit hash of the set, MinHash components."""
    odd = mix(np.arange(PLACES) + 99) | U(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            code, first = shingle_sets(data, offsets, shingle)
            n = np.diff(first)
            full = np.flatnonzero(n)
            sums, sig = np.zeros((2, len(n)), U), np.zeros((len(n), PLACES), np.uint16)
            if len(full):
                starts = first[:-1][full]
                for k in range(2):
                    sums[k][full] = np.add.reduceat(mix(code + U(k)), starts)
                for k in range(PLACES):
                    sig[full, k] = mix(np.minimum.reduceat(code * odd[k], starts)) >> U(48)
            columns = [part.column(0), n.astype(np.int64), sums[0].view(np.int64), sums[1].view(np.int64), pa.array([x.tobytes() for x in sig], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], ["doc_id", "n_shingles", "h1", "h2", "sig"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(sign, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, sig binary")


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, PLACES)


def keyed(nodes: DataFrame, most: int) -> DataFrame:
    """(key, id): for each chunk of a signature and each component left out of it, a hash of the rest."""
    chunks = np.array_split(np.arange(PLACES), (most + 1) // 2)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                codes = mix(matrix(part.column(1)).astype(U) * U(PLACES) + np.arange(PLACES, dtype=U))
                keys = np.empty_like(codes)
                for chunk in chunks:
                    keys[:, chunk] = mix(codes[:, chunk].sum(axis=1, dtype=U)[:, None] - codes[:, chunk] + mix(chunk + 7))
                ids = np.repeat(part.column(0).to_numpy(), PLACES)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "id"])

    return nodes.select("id", "sig").mapInArrow(emit, "key bigint, id bigint")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets, made anew from the texts, are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 64)
                at += 64
                sets = []
                for k in (2, 3):
                    own = []
                    for _, data, offsets in slices(iter([pa.RecordBatch.from_arrays([part.column(k)], ["text"])]), "text"):
                        code, first = shingle_sets(data, offsets, shingle)
                        own += [code[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
                    sets.append(own)
                good = []
                for x, y in zip(*sets, strict=True):
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    good.append(100 * common >= percent * (len(both) - common) and len(both) > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(good))

    t = texts.select("id", "text")
    joined = pairs.join(t.withColumnRenamed("id", "a").withColumnRenamed("text", "text_a"), "a").join(t.withColumnRenamed("id", "b").withColumnRenamed("text", "text_b"), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(check, "a bigint, b bigint")


def across(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between different labels of one hub's members (hub, id, label, size), found
    exactly: the members that are not of the hub's own component (main) meet all others, in pairs of
    blocks of at most BLOCK members and about BLOCK_SHINGLES shingles. A pair of blocks returns no more
    links than it has labels. Members are counted by hub and label before they are by hub, and the
    counts go back to them by salted keys: no task sees all members of a large hub."""
    n, s, main = F.sum("n"), F.sum("s"), F.max(F.when(F.col("own"), F.struct("label", "n", "s")))
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    each = members.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.max(F.col("id") == F.col("hub")).alias("own"))
    shape = each.groupBy("hub").agg(n.alias("n"), s.alias("s"), main.alias("main"))
    shape = shape.select("hub", F.col("main.label").alias("hub_label"), blocks(F.col("main.n"), F.col("main.s")).alias("mains"), blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("others"))
    shape = shape.where("others > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    m = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(shape, ["hub", "salt"]).withColumn("main", F.col("label") == F.col("hub_label"))
    m = m.withColumn("own", F.pmod(F.hash("id"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))))
    m = m.withColumn("own", F.when(F.col("main"), F.col("own") + F.col("others")).otherwise(F.col("own")))
    last = F.when(F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), last))).join(texts, "id")
    m = m.select("hub", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "label", "text")

    def compare(rows: pa.Table) -> pa.Table:
        own, ids, label = (rows[c].to_numpy() for c in ("own", "id", "label"))
        left, right = [], []
        if len(np.unique(label)) > 1:
            sets = []
            for _, data, offsets in slices(rows.select(["text"]).to_batches(), "text"):
                code, first = shingle_sets(data, offsets, shingle)
                sets += [code[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
            one, two = np.flatnonzero(own == rows["x"][0].as_py()), np.flatnonzero(own == rows["y"][0].as_py())
            common = intersections(sets, one, two)
            size = np.array([len(x) for x in sets])
            union = size[one][:, None] + size[two][None, :] - common
            i, j = np.nonzero((100 * common >= percent * union) & (label[one][:, None] != label[two][None, :]))
            i, j = one[i], two[j]
            _, some = np.unique(np.stack([label[i], label[j]]), axis=1, return_index=True)
            root: dict[int, int] = {}
            for k in some:
                a, b = (find(root, int(label[e[k]])) for e in (i, j))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    left.append(min(ids[i[k]], ids[j[k]]))
                    right.append(max(ids[i[k]], ids[j[k]]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return m.groupBy("hub", "x", "y").applyInArrow(compare, "a bigint, b bigint").distinct()


def find(root: dict[int, int], x: int) -> int:
    while root.get(x, x) != x:
        x = root[x]
    return x


def intersections(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[one] with sets[two]: products of 0/1 matrices over the codes
    that occur twice or more, some columns at a time."""
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    kept = (count > 1)[column]
    row, column = row[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        out += part[one] @ part[two].T
    return out.astype(np.int64)


def same_document(rows: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of rows (doc_id, id) that share a doc_id."""
    first = rows.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z")
    return rows.join(first, "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def links(docs: DataFrame, nodes: DataFrame, same: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Confirmed links between nodes (id, n_shingles, sig) and those given, enough of them to connect what
    is linked, and the labels (id, label) of the nodes that have some."""
    rows = keyed(nodes, radius(percent))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bucket = stored(rows.join(shared, "key"))
    central = bucket.groupBy("id").agg(F.sum("n").alias("central"))
    best = bucket.join(central, "id").groupBy("key").agg(F.max(F.struct("central", (-F.col("id")).alias("minus"))).alias("best"))
    star = stored(bucket.select("key", "id").join(best.select("key", (-F.col("best.minus")).alias("hub")), "key").select("hub", "id").distinct())
    sizes = nodes.select("id", "n_shingles")
    pairs = star.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    found = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("id"), F.col("text").cast("string").alias("text"))
    # a merge join at every size: near the broadcast limit the plan would change with the input
    texts = stored(found.join(star.select("id").distinct().hint("shuffle_merge"), "id", "left_semi"))
    edges = stored(confirmed(fitting(pairs, sizes, percent), texts, shingle, percent).unionAll(same))
    labels = components(edges)
    named = star.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = named.join(sizes.withColumnRenamed("n_shingles", "size"), "id")
    more = stored(across(named.select("hub", "id", "label", "size"), texts, shingle, percent))
    edges = edges.unionAll(more)
    return edges, components(edges, labels, more)


def fitting(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes allow the similarity."""
    a, b = (sizes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}")) for x in "ab")
    ok = pairs.join(a, "a").join(b, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return ok.select("a", "b")


def classes(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): component_id is the smallest doc_id reachable."""
    base = stored(signatures(docs, shingle))
    nodes = stored(base.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")))
    same = same_document(base.where("n_shingles > 0").select("doc_id", "h1", "h2").join(nodes.select("h1", "h2", "id"), ["h1", "h2"]).select("doc_id", "id"))
    _, labels = links(docs, nodes.select("id", "n_shingles", "sig"), same, shingle, percent)
    named = nodes.select("h1", "h2", "id").join(labels, "id", "left").select("h1", "h2", F.coalesce("label", "id").alias("label"))
    own = base.select("doc_id", "n_shingles", "h1", "h2")
    full = own.where("n_shingles > 0").join(named, ["h1", "h2"]).select("doc_id", "n_shingles", F.col("label").alias("component_id"))
    out = full.unionAll(own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    real = lambda c: F.nullif(F.col(c), F.lit(LAST)).alias(c)
    return out.select(real("doc_id"), "n_shingles", real("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, whose document is the first of its class."""
    gone = classes(docs, shingle, percent).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select(F.col("doc_id").alias("gone"))
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(gone, F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("gone")), "left_anti").select("row.*")
