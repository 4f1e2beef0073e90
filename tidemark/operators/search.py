"""Keyword and vector search, their fusion, evidence and prompts.

Questions come as a DataFrame, so a search answers many of them in one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.privacy import defused, wrapped
from tidemark.functions.stem import folded
from tidemark.operators.patterns import counts, occurrences, present
from tidemark.sources.storage import spread

K1, B, LEAST_IDF, RRF, FAR = 1.2, 0.75, 1e-6, 60.0, 2.0
MAX_DISTANCE, MIN_KEYWORDS, TOP, FETCH = 0.775, 1.0, 5, 4
SYSTEM_TOKENS, DEICTIC_TOKENS, EVIDENCE_TOKENS, SEPARATOR_TOKENS = 128, 64, 320, 4
TOTAL_TOKENS = SYSTEM_TOKENS + DEICTIC_TOKENS + EVIDENCE_TOKENS
SEPARATOR = "\n---\n"
#: Probes and vectors in a block, distances that are held at a time, vectors that a task holds.
PROBES, PACK, CELLS, LANE = 1024, 4096, 1 << 21, 1 << 17


def tokens(text: Column) -> Column:
    return T.words(folded(F.lower(text)))


def of_width(vectors: DataFrame, width: int) -> DataFrame:
    """vectors, or an error on one of another width."""
    return vectors.withColumn("vector", F.when(F.size("vector") == width, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit(f"vector must have {width} numbers, has "), F.size("vector").cast("string")))))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(rows, -1)


def numbers(column: pa.Array, rows: int) -> np.ndarray:
    """Lists of numbers as a matrix of their own precision."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(rows, -1)


def members(column: pa.ListArray, *names: str) -> Iterator[list[np.ndarray]]:
    """Of each list of structs, the named fields as arrays, lists of numbers as matrices."""
    flat, bounds = column.flatten(), column.offsets.to_numpy()
    columns = [matrix(c, len(flat)) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in (flat.field(n) for n in names)]
    for a, b in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0], strict=True):
        yield [c[a:b] for c in columns]


def packed(ids: np.ndarray, x: np.ndarray, of: np.ndarray, pack: int) -> dict[int, list[tuple]]:
    """For each kind in `of` its rows in packs: (rows, ids, vectors, vectors as float32, their squared lengths)."""
    packs = {}
    for kind in np.unique(of).tolist():
        own = np.flatnonzero(of == kind)
        for part in np.split(own, range(pack, len(own), pack)):
            v = x[part]
            packs.setdefault(kind, []).append((part, ids[part], v, v.astype(np.float32), np.einsum("ij,ij->i", v, v, dtype=np.float64)))
    return packs


def nearest_in_packs(probes: np.ndarray, packs: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probe, row, distance): the k rows of all packs nearest to each probe by squared Euclidean distance, rounded to six places, then id. A
    product in single precision rules out rows that are farther than the k found so far by more than its error can be; of the
    others the distance is computed in full from the differences."""
    p32, pp = probes.astype(np.float32), np.einsum("ij,ij->i", probes, probes, dtype=np.float64)
    limit, error = np.full(len(probes), np.inf), (probes.shape[1] + 16) * 2.0**-23
    of, row, id_, far = np.empty(0, int), np.empty(0, int), np.empty(0, np.int64), np.empty(0)
    for rows, ids, x, x32, xx in packs:
        rough = p32 @ x32.T
        rough *= -2
        rough += xx.astype(np.float32)  # the squared distance without the probe's own part
        slack = error * (pp + xx.max()) + 1e-6  # and what rounding to six places moves
        first = np.partition(rough, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1] + 2 * slack if not len(far) else limit - pp + slack
        cut = np.nextafter(first.astype(np.float32), np.float32(np.inf))
        o, at = np.nonzero(~(rough > cut[:, None]))
        if not len(o):
            continue
        full = np.empty(len(o))
        for i in range(0, len(o), CELLS >> 6):
            part = slice(i, i + (CELLS >> 6))
            d = x[at[part]].astype(np.float64) - probes[o[part]]
            full[part] = np.einsum("ij,ij->i", d, d)
        of, row, id_, far = (np.concatenate(c) for c in ((of, o), (row, rows[at]), (id_, ids[at]), (far, full.round(6))))
        order = np.lexsort((id_, far, of))
        order = order[np.arange(len(order)) - np.searchsorted(of[order], of[order]) < k]
        of, row, id_, far = of[order], row[order], id_[order], far[order]
        last = np.flatnonzero(np.arange(len(of)) - np.searchsorted(of, of) == k - 1)
        limit[of[last]] = far[last]
    return of, row, far


def knn(probes: DataFrame, vectors: DataFrame, k: int, family: bool = False) -> DataFrame:
    """(q_id, id, family, distance, rank): the k nearest vectors (id, family, vector) of each probe (q_id, probe), within each family
    if asked. Vectors are dealt to lanes of at most about LANE; every lane gets all probes, in several parts where lanes are fewer than
    cores. A task holds one lane, through which its probes go in blocks of PROBES; each probe leaves with its k best there,
    and of those the whole keep k. The plan is the same for any number of probes. Rows without a vector are left out."""
    by = ["q_id", "family"] if family else ["q_id"]
    known = probes.where("probe IS NOT NULL").select(F.col("q_id").cast("bigint").alias("id"), F.lit(None).cast("string").alias("family"), F.col("probe").alias("vector"))
    rows = vectors.where("vector IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "family", "vector")
    cores, n = vectors.sparkSession.sparkContext.defaultParallelism, rows.count()
    lanes = max(-(-n // LANE), min(cores, -(-n // PACK)), 1)
    parts = max(1, min(-(-cores // lanes), -(-known.count() // PROBES)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, packs, names = None, [], None, None
        for batch in batches:
            key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()  # cell, and whether a probe
            edges = np.flatnonzero(np.diff(key)) + 1
            for a, b in zip([0, *edges], [*edges, len(key)], strict=True):
                if a == b:
                    continue
                own, at = batch.slice(a, b - a), key[a] // 2
                if key[a] % 2 == 0:  # a cell's vectors come before its probes
                    cell, held, packs = at, held + [own] if cell == at else [own], None
                    continue
                if cell != at:
                    continue
                if packs is None:
                    ids = np.concatenate([h.column(2).to_numpy() for h in held])
                    kinds = pa.chunked_array([h.column(3) for h in held]).combine_chunks().dictionary_encode()
                    names, code = kinds.dictionary, kinds.indices.fill_null(len(kinds.dictionary)).to_numpy(zero_copy_only=False)
                    x = np.concatenate([numbers(h.column(4), h.num_rows) for h in held])
                    packs, held = packed(ids, x, code if family else np.zeros(len(ids), int), PACK), []
                    known_ids, codes = ids, kinds.indices
                q_id, asked = own.column(2).to_numpy(), numbers(own.column(4), own.num_rows)
                step = max(1, min(PROBES, CELLS // PACK))
                for i in range(0, len(q_id), step):
                    for group in packs.values():
                        of, row, far = nearest_in_packs(asked[i : i + step], group, k)
                        yield pa.RecordBatch.from_arrays([pa.array(q_id[i:][of]), pa.array(known_ids[row]), names.take(codes.take(pa.array(row))), pa.array(far)], ["q_id", "id", "family", "distance"])

    each = lambda of, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(of)
    lane, part = (F.pmod(F.xxhash64("id"), F.lit(m)).cast("int") for m in (lanes, parts))
    cells = rows.select("*", lane.alias("lane"), each("part", parts)).withColumn("probe", F.lit(0)).unionByName(known.select("*", part.alias("part"), each("lane", lanes)).withColumn("probe", F.lit(1)))
    cells = cells.select((F.col("lane") * parts + F.col("part")).cast("int").alias("cell"), "probe", "id", "family", "vector").repartitionById(lanes * parts, "cell").sortWithinPartitions("cell", "probe")
    out = cells.mapInArrow(search, "q_id bigint, id bigint, family string, distance double")
    rank = F.row_number().over(W.partitionBy(*by).orderBy("distance", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_all_families(probes: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest of all families: the k best of each family's k best are the k best of all."""
    return knn(probes, vectors, k)


def fused(dense: DataFrame, keyword: DataFrame, questions: DataFrame, k: int, texts: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (q_id, rank, chunk_id, text, taint, t_ns, domain, and
    distance in the dense one) by text. Dense ranks count repeats, keyword ranks do not; the taint of
    every copy unites; a chunk found by keyword only is FAR. Ties stay dense first, then by rank. With
    `texts` (doc_id, text) the lists have doc_id and, as text, a hash of it; the k winners get the texts."""
    one, own = ["q_id", "text"], ["chunk_id", "t_ns", "domain"] + ["doc_id"] * (texts is not None)
    d = dense.groupBy(*one).agg(F.min("rank").alias("d_rank"), F.bit_or("taint").alias("d_taint"), F.min_by(F.struct(*own, "distance"), "rank").alias("d"))
    w = keyword.groupBy(*one).agg(F.min("rank").alias("raw"), F.bit_or("taint").alias("w_taint"), F.min_by(F.struct(*own, F.lit(FAR).alias("distance")), "rank").alias("w"))
    w = w.withColumn("w_rank", F.row_number().over(W.partitionBy("q_id").orderBy("raw")))
    score = lambda r: F.coalesce(1.0 / (RRF + F.col(r)), F.lit(0.0))
    both = d.join(w, one, "full").select(
        "q_id", "text", F.coalesce("d", "w").alias("c"), F.coalesce("d_taint", F.lit(0).cast("long")).bitwiseOR(F.coalesce("w_taint", F.lit(0).cast("long"))).alias("taint"),
        F.round(score("d_rank") + score("w_rank"), 9).alias("rrf"), "d_rank", "w_rank",
    )
    order = W.partitionBy("q_id").orderBy(F.desc("rrf"), F.col("d_rank").asc_nulls_last(), "w_rank")
    best = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if texts is not None:
        best = best.drop("text").withColumn("doc_id", F.col("c.doc_id")).join(texts, "doc_id")
    searchable = F.concat_ws(" ", F.col("text"), T.search_aliases(F.col("text")))
    matched = F.when(F.col("w_rank").isNotNull(), T.terms_matched(F.col("terms"), searchable)).otherwise(0).cast("double")
    best = best.join(questions.select("q_id", T.query_terms(F.col("question")).alias("terms")), "q_id")
    return best.select("q_id", "rank", "text", "c.chunk_id", "c.t_ns", "c.domain", "c.distance", "taint", matched.alias("keyword_score"), "rrf")


def evidence(candidates: DataFrame, k: int = TOP) -> DataFrame:
    """Candidates that are near or share more than one question term, each text once, the first k."""
    good = candidates.where((F.col("distance") <= MAX_DISTANCE) | (F.col("keyword_score") > MIN_KEYWORDS))
    first = good.withColumn("copy", F.row_number().over(W.partitionBy("q_id", "text").orderBy("rank"))).where("copy = 1").drop("copy")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy("rank"))).where(F.col("rank") <= k)


def around_range(hits: DataFrame, before: Column, near_ns: int) -> DataFrame:
    """(q_id, since_ns, until_ns): the hour before or after the first known time of a question's hits."""
    first = hits.where("t_ns > 0").groupBy("q_id").agg(F.min("t_ns").alias("t"), F.first(before).alias("b"))
    return first.select("q_id", F.when(F.col("b"), F.greatest(F.col("t") - near_ns, F.lit(0))).otherwise(F.col("t") + 1).alias("since_ns"), F.when(F.col("b"), F.col("t") - 1).otherwise(F.col("t") + near_ns).alias("until_ns"))


def overview(activity: DataFrame, work: bool, keep: int) -> DataFrame:
    """Lines `N min total: app: title` of the longest activities, without players for questions of work."""
    rows = activity.where(~T.media_window(F.col("app_id"), F.col("title"))) if work else activity
    line = F.concat(T.minutes(F.col("dwell_ms")).cast("string"), F.lit(" min total: "), "app_id", F.lit(": "), "title")
    top = rows.orderBy(F.desc("dwell_ms"), "app_id", "title").limit(keep)
    return top.select(line.alias("text"), F.col("first_ns").alias("t_ns"), "dwell_ms")


def matched(questions: DataFrame, chunks: DataFrame, zeros: bool = False) -> DataFrame:
    """(q_id, doc_id, matched): how many terms (repeats counted) of each question (q_id, question) each chunk (doc_id, text) has by their
    stems. With `zeros` every question meets every chunk, one that is null with null; else pairs without any term are left out. A
    text is read once for the stems of all questions."""
    said = questions.select(F.col("q_id").alias("key"), F.transform(T.query_terms(F.col("question")), T.stem).alias("patterns"))
    found = counts(spread(chunks.select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))), said, zeros)
    return found.select(F.col("key").alias("q_id"), F.col("id").alias("doc_id"), F.col("n").alias("matched"))


def names_known(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """(q_id, known): whether every proper noun of a question (q_id, question) occurs in some text (text)."""
    nouns = questions.select("q_id", F.explode_outer(T.proper_nouns(F.col("question"))).alias("pattern"))
    hit = present(spread(texts.select(F.lower("text").alias("text"))), nouns).withColumn("hit", F.lit(True))
    return nouns.join(hit, "pattern", "left").groupBy("q_id").agg(F.bool_and(F.col("pattern").isNull() | F.coalesce("hit", F.lit(False))).alias("known"))


def on_topic(questions: DataFrame, media: DataFrame, salts: int = 16) -> DataFrame:
    """Media rows (m_id, text) that share a telling word with each question (q_id, question); all if none does, which are dealt out
    by a salt. A text is read once for the words of all questions; texts join the pairs at the end."""
    said = questions.where("question IS NOT NULL").select("q_id", F.explode_outer(F.array_distinct(T.media_words(F.col("question")))).alias("pattern"))
    hits = occurrences(spread(media.select(F.col("m_id").alias("id"), F.lower("text").alias("text"))), said)
    pairs = hits.join(said, "pattern").select("q_id", F.col("id").alias("m_id")).distinct()
    none = said.select("q_id").distinct().join(pairs.select("q_id").distinct(), "q_id", "left_anti")
    dealt = media.select("m_id", F.pmod(F.xxhash64("m_id"), F.lit(salts)).cast("int").alias("salt"))
    every = none.select("q_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")).join(dealt, "salt").select("q_id", "m_id")
    return pairs.unionAll(every).join(media, "m_id").select("q_id", "m_id", "text")


def with_media(found: DataFrame, media: DataFrame, most: int = TOP + 3) -> DataFrame:
    """found (q_id, rank, text) and, after it, media rows (q_id, m_id, text) whose text it lacks, up to
    `most` in all; media that repeat among themselves stay."""
    new = media.join(found.select("q_id", "text"), ["q_id", "text"], "left_anti")
    both = found.select("q_id", F.lit(0).alias("part"), F.col("rank").cast("long").alias("at"), "text").unionAll(new.select("q_id", F.lit(1), F.col("m_id").cast("long"), "text"))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("q_id").orderBy("part", "at"))).where(F.col("rank") <= most).select("q_id", "rank", "text", (F.col("part") == 1).alias("media"))


def specific_order(found: DataFrame) -> DataFrame:
    """Media first, then retrieved rows with the best last."""
    key = F.when(F.col("media"), F.struct(F.lit(0).alias("p"), F.col("rank").alias("r"))).otherwise(F.struct(F.lit(1).alias("p"), (-F.col("rank")).alias("r")))
    return found.withColumn("place", F.row_number().over(W.partitionBy("q_id").orderBy(key)))


def token_count(text: Column) -> Column:
    """Stand-in for a model's tokenizer: a token for every four bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4)


def piece(text: Column, taint: Column) -> Column:
    return wrapped(defused(text), taint)


def evidence_block(pieces: DataFrame, budget: int = EVIDENCE_TOKENS) -> DataFrame:
    """(q_id, block, used) of pieces (q_id, rank, piece): all of them if their bytes or tokens fit, else the
    longest prefix whose tokens and separators do."""
    order = W.partitionBy("q_id").orderBy("rank")
    cost = token_count(F.col("piece")) + F.when(F.row_number().over(order) == 1, 0).otherwise(SEPARATOR_TOKENS)
    p = pieces.withColumn("cost", cost).withColumn("sum", F.sum("cost").over(order.rowsBetween(W.unboundedPreceding, 0)))
    texts = F.sort_array(F.collect_list(F.struct("rank", "piece", "sum")))
    join = lambda c: F.array_join(F.transform(c, lambda x: x["piece"]), SEPARATOR)
    g = p.groupBy("q_id").agg(texts.alias("all"))
    fits = F.filter("all", lambda x: x["sum"] <= budget)
    whole = join(F.col("all"))
    block = F.when((F.octet_length(whole) <= budget) | (token_count(whole) <= budget), whole).otherwise(join(fits))
    return g.select("q_id", block.alias("block"), F.least(token_count(whole), F.lit(budget)).alias("used"))


def deictic(app: Column, title: Column, question: Column) -> Column:
    asked = defused(question)
    seen = F.concat(F.lit('The user is looking at "'), defused(title), F.lit('" in '), defused(app), F.lit(" and asked: "), asked)
    return F.when(app.isNotNull(), seen).otherwise(F.concat(F.lit("Question: "), asked))


def fitted_deictic(app: Column, title: Column, question: Column, budget: int = DEICTIC_TOKENS) -> Column:
    """The deictic text within a budget: title and application cut to ever fewer bytes, three times,
    else the whole cut."""
    full = deictic(app, title, question)
    fits = lambda c: (F.octet_length(c) <= budget) | (token_count(c) <= budget)
    out = F.when(fits(full), full)
    for n in (budget, budget // 2, budget // 4):
        cut = deictic(T.truncate_bytes(app, n), T.truncate_bytes(title, n), T.truncate_bytes(question, budget))
        out = out.when(fits(cut), cut)
    return out.otherwise(T.truncate_bytes(full, budget))


def prompt(system: str, block: Column, deictic_text: Column) -> Column:
    return F.concat(F.lit(f"System: {system}<|eot_id|>User: Evidence:\n"), block, F.lit("\n\n"), deictic_text, F.lit("<|eot_id|>Assistant: "))
