"""The queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, language, linededup, mixing, neardup, periods, personal, quality, resample, substring, suffixes, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.report(table(spark, sf_dir, "documents"))


def streamed(log: DataFrame) -> DataFrame:
    """The log of events in which turns come about, three of them each in one of three ways: a message and deltas, a draft that an
    edit replaces, or a start that is regenerated and then goes on."""
    text, half = F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    head, tail = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    order = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    event = lambda k, kind, said: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), said.alias("text"))
    ways = F.array(
        F.array(event(0, "message", head), event(1, "delta", tail)),
        F.array(event(0, "message", F.concat(tail, F.lit("?"))), event(1, "edit", text)),
        F.array(event(0, "message", tail), event(1, "regenerate", head), event(2, "delta", tail)),
    )
    which = (F.pmod(F.coalesce(F.col("conv_id") + F.col("turn"), F.lit(0)), F.lit(3)) + 1).cast("int")
    rows = log.repartition("conv_id").withColumn("copy", F.row_number().over(order)).select("conv_id", "turn", "role", "copy", F.explode(F.element_at(ways, which)).alias("e"))
    return rows.select("conv_id", "turn", (F.col("copy") * 3 + F.col("e.k")).alias("seq"), "e.kind", "role", "e.text")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = chat.read_back(chat.render(chat.messages(streamed(log.unionByName(extra)))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periods.detect(docs.withColumn("text", periods.planted(docs.doc_id, docs.text)), text=False)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(table(spark, sf_dir, "documents")).drop("kept")


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_decontamination, op3_language, op4_near_dedup, op5_mixing, op6_personal_data, op7_substring_dedup, op8_toxicity, op9_quality, op10_chat_format, op11_periodic_runs, op12_line_dedup, op13_importance_resample, pipeline)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES: dict[str, str] = {
    "op12_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS k FROM d),
m AS (SELECT *, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM m WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
g AS (SELECT m.*, r.keeper IS NOT NULL AND m.doc_id < r.keeper AS gone FROM m LEFT JOIN r ON m.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id""",
    # CRC-32 byte by byte: a register of 32 bits and the table of its steps, over distinct features only.
    "op13_importance_resample": rf"""
WITH RECURSIVE step(v, c, k) AS (
  SELECT range, range, 0 FROM range(256) UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
steps AS (SELECT list(c ORDER BY v) AS c FROM step WHERE k = 8),
words AS (
  SELECT side, id, list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM (SELECT 0 AS side, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, item_id, coalesce(text, '') FROM benchmark)),
f AS (
  SELECT side, id, unnest(w) AS feature FROM words
  UNION ALL SELECT side, id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
n AS (SELECT side, id, feature, count(*) AS n FROM f GROUP BY ALL),
coded AS (SELECT feature, hex(encode(feature)) AS code FROM (SELECT DISTINCT feature FROM n)),
crc AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(code) // 2), lambda i: ('0x' || substr(code, 2 * i + 1, 2))::BIGINT)),
    lambda r, b: xor(r >> 8, steps.c[(xor(r, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM coded, steps),
s AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM n JOIN crc USING (feature) GROUP BY bucket),
total AS (SELECT sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM s),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(s.t, 0) + 1)::DOUBLE * (total.s + 10000) / ((coalesce(s.s, 0) + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS gain FROM s, total),
d AS (SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM n JOIN crc USING (feature) JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (
  SELECT w.id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS able,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || w.id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words w LEFT JOIN d ON w.id = d.id WHERE w.side = 0),
placed AS (SELECT *, row_number() OVER (ORDER BY able DESC, score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM placed""",
}
