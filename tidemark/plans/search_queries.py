"""Queries of text functions, keyword and vector search, fusion, evidence and prompts.

Questions are the benchmark items and a few fixed ones for the intents; searches ask those whose id is divisible
by 20. Question q's probe vector is the embedding of vec_id q. Thresholds are scaled to the tables where the note says so.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import monitor, search
from tidemark.operators import relational as rel
from tidemark.operators import vectors as ann
from tidemark.operators.adapters import family
from tidemark.operators.keyword_index import KeywordIndex
from tidemark.operators.vector_index import VectorIndex
from tidemark.plans.ingest_queries import FOCUS_SQL, focus_history
from tidemark.plans.registry import query
from tidemark.plans.stem_sql import stemmed_sql
from tidemark.sources.storage import kept, scratch, stored
from tidemark.sources.tables import CHUNK_SQL, chunks, domain, table

FIXED = (
    "What did I do before Reading Emails?", "What was on screen after the standup?!", "how did I spend my time on the project", "What was the last thing I watched on YouTube?",
    "Which J.A.R.V.I.S videos played in r/rust and U.S.A. today", "what", "Installing boxes passed watches es sing", "After lunch", "Did I watch Netflix with Ana", "x before . ",
)


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def words_sql(e: str) -> str:
    return rf"list_filter(regexp_split_to_array({e}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def terms_sql(e: str) -> str:
    return f"list_filter({words_sql(f'lower({e})')}, lambda w: NOT list_contains({quoted(T.STOPWORDS)}, w))"


def stem_sql(t: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({t}, '{s}') AND strlen({t}) >= {len(s) + 3} THEN left({t}, length({t}) - {len(s)})" for s in ("ing", "ed", "es", "s")) + f" ELSE {t} END"


def aliases_sql(e: str) -> str:
    parts = "list_filter(string_split(w, '.'), lambda p: p <> '')"
    acronym = f"CASE WHEN len({parts}) >= 3 AND len(list_filter({parts}, lambda p: length(p) <> 1)) = 0 THEN [array_to_string({parts}, '')] ELSE [] END"
    forum = "CASE WHEN starts_with(w, 'r/') AND length(w) > 2 THEN ['reddit subreddit'] ELSE [] END"
    return rf"array_to_string(flatten(list_transform(list_filter(regexp_split_to_array({e}, '\s+'), lambda w: w <> ''), lambda w: list_concat({acronym}, {forum}))), ' ')"


def matched_sql(terms: str, e: str) -> str:
    return f"len(list_filter({terms}, lambda t: contains(lower({e}), {stem_sql('t')})))"


QUESTION_SQL = f"question AS (SELECT item_id AS q_id, text AS question FROM benchmark UNION ALL SELECT -i, ({quoted(FIXED)})[i] FROM range(1, {len(FIXED) + 1}) r(i))"


def questions(spark, sf_dir):
    fixed = spark.range(1, len(FIXED) + 1).select((-F.col("id")).alias("q_id"), F.element_at(F.array(*map(F.lit, FIXED)), F.col("id").cast("int")).alias("question"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question")).unionAll(fixed)


@query("txt01_query_terms", f"WITH {QUESTION_SQL} SELECT q_id, array_to_string({terms_sql('question')}, ' ') AS terms FROM question")
def _(spark, sf_dir):
    return questions(spark, sf_dir).select("q_id", F.array_join(T.query_terms(F.col("question")), " ").alias("terms"))


@query("txt02_search_aliases", f"WITH {QUESTION_SQL} SELECT q_id, {aliases_sql('question')} AS aliases FROM question")
def _(spark, sf_dir):
    return questions(spark, sf_dir).select("q_id", T.search_aliases(F.col("question")).alias("aliases"))


@query("txt03_stems", f"WITH {QUESTION_SQL}, w AS (SELECT DISTINCT unnest({terms_sql('question')}) AS term FROM question) SELECT term, {stem_sql('term')} AS stem FROM w")
def _(spark, sf_dir):
    w = questions(spark, sf_dir).select(F.explode(T.query_terms(F.col("question"))).alias("term")).distinct()
    return w.select("term", T.stem(F.col("term")).alias("stem"))


@query("txt04_terms_matched", f"WITH {QUESTION_SQL}, {CHUNK_SQL} SELECT q_id, doc_id, {matched_sql(terms_sql('question'), 'text')} AS matched FROM question, chunks WHERE q_id >= 0 AND q_id % 20 = 0")
def _(spark, sf_dir):
    """Chunks are documents, one for each of their labels or one without; the labels join the counts, so no text is shuffled for them."""
    found = search.matched(asked(spark, sf_dir), table(spark, sf_dir, "documents"), zeros=True)
    return found.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left").select("q_id", "doc_id", "matched")


PLAIN_SQL = "strip_accents(lower({}))"
POSTING_SQL = f"""toks AS (SELECT doc_id, list_concat({words_sql(PLAIN_SQL.format('text'))}, {words_sql(PLAIN_SQL.format(aliases_sql('text')))}) AS t FROM chunks),
  {stemmed_sql('vocab', 'SELECT unnest(t) AS word FROM toks')},
  post AS (SELECT stem AS term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS word FROM toks) JOIN vocab USING (word) GROUP BY stem, doc_id)"""


def bm25_sql(asked: str, k: int) -> str:
    said = f"SELECT q_id, unnest({terms_sql(PLAIN_SQL.format('question'))}) AS word FROM question WHERE {asked}"
    return f"""{CHUNK_SQL}, {QUESTION_SQL}, {POSTING_SQL}, said AS ({said}), {stemmed_sql('sought', 'SELECT word FROM said')},
  asked AS (SELECT q_id, stem AS term FROM said JOIN sought USING (word)),
  total AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM toks), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
  part AS (SELECT p.term, p.doc_id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean)) AS part FROM post p JOIN df USING (term) JOIN toks USING (doc_id), total),
  scored AS (SELECT q_id, doc_id, round(sum(part), 6) AS score FROM asked JOIN part USING (term) GROUP BY q_id, doc_id),
  kw AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= {k})"""


def asked(spark, sf_dir):
    """The stated query set: items whose id is divisible by 20."""
    return questions(spark, sf_dir).where("q_id >= 0 AND q_id % 20 = 0")


ASKED_SQL = "q_id >= 0 AND q_id % 20 = 0"


def keyword_index(spark, sf_dir):
    """The index over the texts of all chunks, built once from the files of the documents and read by later queries; half of them are
    an insert of their own."""

    def build(path):
        c = table(spark, sf_dir, "documents").select("doc_id", "text")
        for part in (c.where("doc_id % 2 = 0"), c.where("doc_id % 2 <> 0")):
            KeywordIndex(spark, path, 16).insert(part)

    return KeywordIndex(spark, kept(spark, "keyword-1", [f"{sf_dir}/documents.parquet"], build), 16)


@query("txt05_bm25", f"WITH {bm25_sql(ASKED_SQL, 20)} SELECT q_id, doc_id, score, rank FROM kw")
def _(spark, sf_dir):
    return keyword_index(spark, sf_dir).search(asked(spark, sf_dir), 20)


@query("txt06_keyword_index", f"WITH {CHUNK_SQL}, {POSTING_SQL} SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM post GROUP BY term")
def _(spark, sf_dir):
    return keyword_index(spark, sf_dir).terms()


def cue_sql(cues) -> str:
    return "(" + " OR ".join(f"contains(q, '{c}')" for c in cues) + ")"


ANCHOR = r"trim(regexp_replace(CASE WHEN contains(q, ' {0} ') THEN substring(q, strpos(q, ' {0} ') + {1}) END, '[?.!]+$', ''))"


@query("txt07_intents", f"""WITH {QUESTION_SQL}, a AS (SELECT q_id, q, {ANCHOR.format('before', 8)} AS b, {ANCHOR.format('after', 7)} AS f FROM (SELECT q_id, lower(question) AS q FROM question))
  SELECT q_id, CASE WHEN b <> '' OR f <> '' THEN 'around' WHEN {cue_sql(T.OVERVIEW_CUES)} THEN 'overview' WHEN {cue_sql(T.LATEST_CUES)} THEN 'latest' ELSE 'specific' END AS intent,
    CASE WHEN b <> '' THEN true WHEN f <> '' THEN false END AS before, CASE WHEN b <> '' THEN b WHEN f <> '' THEN f END AS anchor FROM a""")
def _(spark, sf_dir):
    return questions(spark, sf_dir).select("q_id", T.intent(F.col("question")).alias("i")).select("q_id", "i.*")


@query("txt08_cues", f"WITH {QUESTION_SQL}, {FOCUS_SQL}, c AS (SELECT q_id, {cue_sql(T.WORK_CUES)} AS work, {cue_sql(T.MEDIA_CUES)} AS media FROM (SELECT q_id, lower(question) AS q FROM question)) SELECT q_id, work, media, (SELECT count(*) FROM focus WHERE contains(lower(app_id), 'vlc') OR contains(title, 'YouTube')) AS players FROM c")
def _(spark, sf_dir):
    q = F.lower("question")
    n = focus_history(spark, sf_dir).agg(F.count(F.when(T.media_window(F.col("app_id"), F.col("title")), 1)).alias("players"))
    return questions(spark, sf_dir).select("q_id", T.any_of(q, T.WORK_CUES).alias("work"), T.any_of(q, T.MEDIA_CUES).alias("media")).crossJoin(F.broadcast(n))


NOUN_SQL = rf"list_transform(list_filter({words_sql('question')}[2:], lambda w: w <> 'I' AND regexp_matches(w, '^\p{{Lu}}')), lambda w: lower(w))"


@query("txt09_proper_nouns", f"WITH {QUESTION_SQL} SELECT q_id, array_to_string({NOUN_SQL}, ' ') AS nouns FROM question")
def _(spark, sf_dir):
    return questions(spark, sf_dir).select("q_id", F.array_join(T.proper_nouns(F.col("question")), " ").alias("nouns"))


@query("txt10_names_known", f"WITH {QUESTION_SQL}, {CHUNK_SQL}, n AS (SELECT q_id, unnest({NOUN_SQL}) AS noun FROM question), m AS (SELECT DISTINCT q_id, noun, EXISTS (SELECT 1 FROM chunks WHERE domain = 'media_playback' AND contains(lower(text), noun)) AS hit FROM n) SELECT q.q_id, coalesce(bool_and(hit), true) AS known FROM question q LEFT JOIN m USING (q_id) GROUP BY q.q_id")
def _(spark, sf_dir):
    media = chunks(spark, sf_dir).where("domain = 'media_playback'")
    return search.names_known(questions(spark, sf_dir), media)


MEDIA_ROW = "mrow AS (SELECT doc_id AS m_id, text, t_ns FROM chunks WHERE domain = 'media_playback')"
MWORD_SQL = f"list_filter({words_sql('lower(question)')}, lambda w: strlen(w) > 2 AND NOT list_contains({quoted(T.GENERIC_WORDS)}, w))"
TOPIC_SQL = f"""hits AS (SELECT q_id, m_id, text, len(list_filter({MWORD_SQL}, lambda w: contains(lower(text), w))) > 0 AS hit FROM question, mrow WHERE q_id >= 0 AND q_id % 20 = 0),
  topic AS (SELECT q_id, m_id, text FROM hits QUALIFY hit OR NOT bool_or(hit) OVER (PARTITION BY q_id))"""


def media_rows(spark, sf_dir):
    return chunks(spark, sf_dir).where("domain = 'media_playback'").select(F.col("doc_id").alias("m_id"), "text")


@query("txt11_relevant_media", f"WITH {QUESTION_SQL}, {CHUNK_SQL}, {MEDIA_ROW}, {TOPIC_SQL} SELECT * FROM topic")
def _(spark, sf_dir):
    return search.on_topic(asked(spark, sf_dir), media_rows(spark, sf_dir))


@query("txt12_minutes", f"WITH {FOCUS_SQL} SELECT id, (dwell_ms + 30000) // 60000 AS minutes FROM focus")
def _(spark, sf_dir):
    return focus_history(spark, sf_dir).select("id", T.minutes(F.col("dwell_ms")).alias("minutes"))


@query("txt13_timestamped", f"WITH {CHUNK_SQL} SELECT doc_id, CASE WHEN t_ns > 0 THEN '[' || strftime(make_timestamp(t_ns // 1000) + INTERVAL 330 MINUTE, '%H:%M') || '] ' || domain ELSE domain END AS line FROM chunks")
def _(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", T.timestamped(F.col("domain"), F.col("t_ns"), "Asia/Kolkata").alias("line"))


@query("txt14_utc_labels", f"WITH {CHUNK_SQL} SELECT doc_id, strftime(make_timestamp(t_ns // 1000), '%Y%m%dT%H%M%SZ') AS label FROM chunks")
def _(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", T.utc_label(F.col("t_ns")).alias("label"))


@query("txt15_truncated", f"WITH {CHUNK_SQL}, p AS (SELECT doc_id, text, n FROM chunks, (VALUES (0), (5), (33), (100)) v(n)), c AS (SELECT *, list_filter(range(0, n + 1), lambda k: strlen(left(text, k::BIGINT)) <= n) AS fits FROM p) SELECT doc_id, n, left(text, list_max(fits)) AS cut FROM c")
def _(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", "text", F.explode(F.array(*map(F.lit, (0, 5, 33, 100)))).alias("n")).select("doc_id", "n", T.truncate_bytes(F.col("text"), F.col("n")).alias("cut"))


TYPES = ("", "text/plain; charset=utf-8", " Text/HTML", "image/png", "application/json", "application/octet-stream", "APPLICATION/XHTML+XML;q=1", "video/mp4")


@query("txt16_text_types", f"SELECT page_id, (page_id % 8) IN (0, 1, 2, 4, 6) AS is_text FROM pages")
def _(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("page_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", T.text_type(kind).alias("is_text"))


PROBED = "vec_id % 20 = 0"
FAMILY = "CASE WHEN domain = 'window_focus' THEN 'attention' WHEN domain = 'git_activity' THEN 'work' WHEN domain = 'notes' THEN 'knowledge' WHEN domain = 'media_playback' THEN 'system' ELSE 'external' END"


def vector_sql(probed: str, join: str) -> str:
    return f"""{CHUNK_SQL}, vec AS (SELECT vec_id AS id, {FAMILY} AS family, embedding AS vector FROM embeddings {join} chunks ON doc_id = vec_id), probe AS (SELECT vec_id AS q_id, embedding AS probe FROM embeddings WHERE {probed}),
  dist AS (SELECT q_id, id, family, round(list_sum(list_transform(list_zip(vector, probe), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS distance FROM vec, probe)"""


VECTOR_SQL = vector_sql(PROBED, "LEFT JOIN")


def vectors(spark, sf_dir):
    """All vectors (id, vector, family); one without a chunk is of the family of unknown domains."""
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), domain(F.col("doc_id")).alias("domain"))
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return v.join(c, "id", "left").select("id", "vector", family(F.col("domain")).alias("family"))


def probes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("probe"))


def probe_set(spark, sf_dir):
    """The stated query set: vectors whose id is divisible by 20."""
    return probes(spark, sf_dir).where("q_id % 20 = 0")


@query("vec02_knn_in_family", f"WITH {VECTOR_SQL} SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, id) AS rank FROM dist WHERE family = 'work' QUALIFY rank <= 5")
def _(spark, sf_dir):
    return search.knn(probe_set(spark, sf_dir), search.of_width(vectors(spark, sf_dir), 64).where("family = 'work'"), 5)


@query("vec03_knn_all_families", f"WITH {VECTOR_SQL} SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, id) AS rank FROM dist QUALIFY rank <= 20")
def _(spark, sf_dir):
    return search.knn_all_families(probe_set(spark, sf_dir), vectors(spark, sf_dir), 20)


@query("snk03_vector_inserts", f"WITH {VECTOR_SQL} SELECT family, count(*) AS n, round(sum(vector[1]), 4) AS x FROM vec GROUP BY family")
def _(spark, sf_dir):
    v = vectors(spark, sf_dir)
    at = scratch(spark)
    for part in (v.where("id % 2 = 0"), v.where("id % 2 = 1")):
        ann.inserted(part, at, 64)
    return spark.read.parquet(at).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("vector")[0].cast("double")), 4).alias("x"))


@query("vec06_family_scan", f"WITH {VECTOR_SQL} SELECT family, count(*) AS n, min(id) AS first_id FROM vec GROUP BY family")
def _(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("vec07_vector_update", f"WITH {VECTOR_SQL} SELECT id, round(CASE WHEN id % 3 = 0 THEN -1 ELSE 1 END * list_sum(list_transform(vector, lambda x, i: x::DOUBLE * i)), 5) AS x FROM vec")
def _(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", "vector")
    new = v.where("id % 3 = 0").select("id", F.transform("vector", lambda x: -x).alias("vector"))
    return v.alias("o").join(new.alias("n"), "id", "left").select("id", F.round(F.aggregate(F.transform(F.coalesce("n.vector", "o.vector"), lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), 5).alias("x"))


@query("vec09_predicate_delete", f"WITH {VECTOR_SQL} SELECT id, family FROM vec WHERE NOT (family = 'system' OR id % 10 = 3)")
def _(spark, sf_dir):
    return vectors(spark, sf_dir).where(~((F.col("family") == "system") | (F.col("id") % 10 == 3))).select("id", "family")


def fuse_sql(asked: str = ASKED_SQL, probed: str = PROBED) -> str:
    return f"""{vector_sql(probed, 'JOIN')}, {bm25_sql(asked, 80).removeprefix(CHUNK_SQL + ', ')},
  short AS (SELECT doc_id, text, chunk_id, taint, t_ns, domain FROM chunks),
  dense AS (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY distance, id) AS rank, distance, s.* FROM dist JOIN short s ON s.doc_id = id QUALIFY rank <= 80),
  words AS (SELECT q_id, rank, s.* FROM kw JOIN short s USING (doc_id)),
  d AS (SELECT q_id, text, min(rank) AS d_rank, bit_or(taint) AS d_taint, arg_min(struct_pack(chunk_id, t_ns, domain, distance), rank) AS d FROM dense GROUP BY q_id, text),
  w0 AS (SELECT q_id, text, min(rank) AS raw, bit_or(taint) AS w_taint, arg_min(struct_pack(chunk_id, t_ns, domain, distance := 2.0::DOUBLE), rank) AS w FROM words GROUP BY q_id, text),
  w AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY raw) AS w_rank FROM w0),
  f AS (SELECT q_id, text, coalesce(d, w) AS c, coalesce(d_taint, 0) | coalesce(w_taint, 0) AS taint, d_rank, w_rank, round(coalesce(1.0::DOUBLE / (60 + d_rank), 0) + coalesce(1.0::DOUBLE / (60 + w_rank), 0), 9) AS rrf,
    CASE WHEN w_rank IS NULL THEN 0 ELSE {matched_sql(terms_sql('question'), "text || ' ' || " + aliases_sql('text'))} END::DOUBLE AS keyword_score FROM d FULL JOIN w USING (q_id, text) JOIN question USING (q_id)),
  fuse AS (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY rrf DESC, d_rank NULLS LAST, w_rank) AS rank, text, c.chunk_id AS chunk_id, c.t_ns AS t_ns, c.domain AS domain, c.distance AS distance, taint, keyword_score, rrf FROM f QUALIFY rank <= 20)"""


FUSE_SQL = fuse_sql()


def hybrid(spark, sf_dir, q=None):
    """Fused hits of questions, the stated set unless given; hits have a text, so only vectors of chunks are ranked."""
    c, q = chunks(spark, sf_dir), asked(spark, sf_dir) if q is None else q
    own = probes(spark, sf_dir).join(q.select("q_id"), "q_id", "left_semi")
    v = vectors(spark, sf_dir).join(c.select(F.col("doc_id").alias("id")), "id", "left_semi")
    keyed = c.select("doc_id", F.sha2("text", 256).alias("text"), "chunk_id", "taint", "t_ns", "domain")
    dense = search.knn_all_families(own, v, 80).select("q_id", "rank", "distance", F.col("id").alias("doc_id")).join(keyed, "doc_id")
    words = keyword_index(spark, sf_dir).search(q, 80).select("q_id", "rank", "doc_id").join(keyed, "doc_id")
    return search.fused(dense, words, q, 20, c.select("doc_id", "text"))


@query("hyb01_rrf", f"WITH {FUSE_SQL} SELECT * FROM fuse")
def _(spark, sf_dir):
    return hybrid(spark, sf_dir)


@query("vec10_hybrid_query", f"WITH {FUSE_SQL} SELECT q_id, rank, chunk_id, rrf FROM fuse WHERE rank <= 5")
def _(spark, sf_dir):
    return hybrid(spark, sf_dir).where("rank <= 5").select("q_id", "rank", "chunk_id", "rrf")


def evidence_sql(fuse: str) -> str:
    return f"""{fuse}, good AS (SELECT * EXCLUDE (rank), rank AS r0 FROM fuse WHERE distance <= 0.775 OR keyword_score > 1),
  evid AS (SELECT * EXCLUDE (r0), row_number() OVER (PARTITION BY q_id ORDER BY r0) AS rank FROM (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY q_id, text ORDER BY r0) = 1) QUALIFY rank <= 5)"""


EVIDENCE_SQL = evidence_sql(FUSE_SQL)


@query("hyb02_evidence", f"WITH {EVIDENCE_SQL} SELECT q_id, rank, text, distance, keyword_score, taint FROM evid")
def _(spark, sf_dir):
    return search.evidence(hybrid(spark, sf_dir)).select("q_id", "rank", "text", "distance", "keyword_score", "taint")


@query("hyb04_overview", f"WITH {FOCUS_SQL}, a AS (SELECT app_id, title, min(t_start_ns) AS first_ns, sum(dwell_ms)::BIGINT AS dwell_ms FROM focus WHERE title <> '' GROUP BY app_id, title ORDER BY dwell_ms DESC, app_id, title LIMIT 18) SELECT ((dwell_ms + 30000) // 60000) || ' min total: ' || app_id || ': ' || title AS text, first_ns AS t_ns, dwell_ms FROM a WHERE NOT contains(title, 'YouTube') ORDER BY dwell_ms DESC, app_id, title LIMIT 6")
def _(spark, sf_dir):
    return search.overview(rel.activity(focus_history(spark, sf_dir), limit=18), True, 6)


@query("hyb05_latest", f"WITH {EVIDENCE_SQL} SELECT q_id, text, row_number() OVER (PARTITION BY q_id ORDER BY t_ns DESC, rank) AS place FROM evid")
def _(spark, sf_dir):
    from pyspark.sql import Window as W

    e = search.evidence(hybrid(spark, sf_dir))
    return e.select("q_id", "text", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("t_ns"), "rank")).alias("place"))


WITH_MEDIA_SQL = f"""{EVIDENCE_SQL}, {MEDIA_ROW}, {TOPIC_SQL}, new AS (SELECT * FROM topic t WHERE NOT EXISTS (SELECT 1 FROM evid e WHERE e.q_id = t.q_id AND e.text = t.text)),
  allm AS (SELECT q_id, text, part = 1 AS media, row_number() OVER (PARTITION BY q_id ORDER BY part, pos) AS rank FROM (SELECT q_id, 0 AS part, rank AS pos, text FROM evid UNION ALL SELECT q_id, 1, m_id, text FROM new) QUALIFY rank <= 8)"""


def evidence_with_media(spark, sf_dir):
    topic = search.on_topic(asked(spark, sf_dir), media_rows(spark, sf_dir))
    return search.with_media(search.evidence(hybrid(spark, sf_dir)).select("q_id", "rank", "text"), topic)


@query("hyb07_media_merge", f"WITH {WITH_MEDIA_SQL} SELECT q_id, rank, text, media FROM allm")
def _(spark, sf_dir):
    return evidence_with_media(spark, sf_dir)


@query("hyb06_specific_order", f"WITH {WITH_MEDIA_SQL} SELECT q_id, text, row_number() OVER (PARTITION BY q_id ORDER BY media DESC, CASE WHEN media THEN rank ELSE -rank END) AS place FROM allm")
def _(spark, sf_dir):
    return search.specific_order(evidence_with_media(spark, sf_dir)).select("q_id", "text", "place")


COST = "ceil(strlen({0}) / 4.0)::BIGINT"
BLOCK_SQL = f"""cost AS (SELECT *, {COST.format('piece')} + CASE WHEN row_number() OVER (PARTITION BY q_id ORDER BY rank) = 1 THEN 0 ELSE 4 END AS cost FROM pc),
  run AS (SELECT *, sum(cost) OVER (PARTITION BY q_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS run FROM cost),
  blk AS (SELECT q_id, string_agg(piece, chr(10) || '---' || chr(10) ORDER BY rank) AS whole, coalesce(string_agg(piece, chr(10) || '---' || chr(10) ORDER BY rank) FILTER (run <= 320), '') AS part FROM run GROUP BY q_id)"""


def deictic_sql(a: str, t: str, q: str) -> str:
    safe = lambda e: f"replace(replace({e}, '<|', '< |'), '|>', '| >')"
    return f"CASE WHEN {a} IS NULL THEN 'Question: ' || {safe(q)} ELSE 'The user is looking at \"' || {safe(t)} || '\" in ' || {safe(a)} || ' and asked: ' || {safe(q)} END"


def cut_sql(e: str, n: int) -> str:
    return f"left({e}, coalesce(list_max(list_filter(range(0, {n + 1}), lambda k: strlen(left({e}, k::BIGINT)) <= {n})), 0))"


def fit_sql() -> str:
    out = f"CASE WHEN {COST.format('full_')} <= 64 THEN full_ "
    for n in (64, 32, 16):
        c = deictic_sql(cut_sql("a", n), cut_sql("t", n), cut_sql("q", 64)).replace("CASE WHEN " + cut_sql("a", n), "CASE WHEN a")
        out += f"WHEN {COST.format('(' + c + ')')} <= 64 THEN {c} "
    return out + f"ELSE {cut_sql('full_', 64)} END"


@query("prm06_distillation", "WITH big AS (SELECT doc_id, source, doc_id AS inserted FROM documents WHERE strlen(text) > 1000 AND ceil(strlen(text) / 4.0) > 1000) SELECT doc_id, source FROM big QUALIFY row_number() OVER (ORDER BY inserted DESC) <= 32")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    big = d.where((F.octet_length("text") > 1000) & (search.token_count(F.col("text")) > 1000))
    return big.orderBy(F.desc("doc_id")).limit(32).select("doc_id", "source")


@query("prm01_budgets", f"SELECT doc_id, ceil(strlen(text) / 4.0) <= 512 AS fits FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (search.token_count(F.col("text")) <= search.TOTAL_TOKENS).alias("fits"))


@query("gen01_token_counts", "SELECT doc_id, ceil(strlen(text) / 4.0)::BIGINT AS tokens FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", search.token_count(F.col("text")).alias("tokens"))


def dense_index(spark, sf_dir):
    """The index over all vectors, built once from the files of the tables and read by later queries; half of the vectors are an insert
    of their own."""

    def build(path):
        v = vectors(spark, sf_dir)
        index = VectorIndex.create(v, path)
        index.insert(v.where("id % 2 = 0"), "given")
        index.insert(v.where("id % 2 = 1"), "given")

    return VectorIndex(spark, kept(spark, "dense-1", [f"{sf_dir}/embeddings.parquet", f"{sf_dir}/documents.parquet"], build))


@query("vec04_ivf_search")
def _(spark, sf_dir):
    return dense_index(spark, sf_dir).search(probe_set(spark, sf_dir), 10, visits=24, refine=50).select("q_id", "id", "distance", "rank")


@query("vec01_embedded_chunks")
def _(spark, sf_dir):
    return ann.embedded(chunks(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")).select("id", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


@query("vec08_stale_families", f"WITH {CHUNK_SQL} SELECT domain AS family FROM chunks GROUP BY domain HAVING max(doc_id) % 2 = 0")
def _(spark, sf_dir):
    f = chunks(spark, sf_dir).groupBy(F.col("domain").alias("family")).agg(F.max("doc_id").alias("d"))
    meta = f.select("family", F.when(F.col("d") % 2 == 0, "old").otherwise("new").alias("model_id"))
    return ann.stale(f.select("family"), meta, "new")


@query("vec08_reembedded", f"""WITH {CHUNK_SQL}, f AS (SELECT domain AS family, max(doc_id) % 2 = 0 AS old, count(*) AS texts, count(vec_id) AS given FROM chunks LEFT JOIN embeddings ON vec_id = doc_id GROUP BY domain)
  SELECT family, 'new' AS model_id, CASE WHEN old THEN 2 ELSE 1 END AS generation, CASE WHEN old THEN texts ELSE given END AS n, CASE WHEN old THEN 0 ELSE given END AS n_given FROM f WHERE family <> 'external_documents'""")
def _(spark, sf_dir):
    c = chunks(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("domain").alias("family"), "text")
    given = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    old = c.groupBy("family").agg(F.max("id").alias("d")).where("family <> 'external_documents'").select("family", (F.col("d") % 2 == 0).alias("old"))
    rows = stored(given.join(c.drop("text"), "id").join(old, "family"))  # one domain was never indexed
    index = VectorIndex.create(rows, scratch(spark))
    for was, model_id in ((True, "old"), (False, "new")):
        index.insert(rows.where(F.col("old") == was), model_id)
    ann.reembedded(index, c, "new", lambda texts: ann.embedded(texts, index.width))
    now = index.vectors().alias("v").join(given.alias("g"), F.expr("v.id = g.id AND v.vector = g.vector"), "left")
    n = now.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count("g.id").alias("n_given"))
    return index.families().join(n, "family").select("family", "model_id", "generation", "n", "n_given")


@query("vec13_fragments", f"WITH {VECTOR_SQL} SELECT family, count(DISTINCT id // 100) AS fragments, count(*) AS n FROM vec GROUP BY family")
def _(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", "family", F.floor(F.col("id") / 100).alias("batch"))  # each hundred is an insert of its own
    return ann.fragments(stored(v.repartition("family", "batch"), "family", "batch"))


@query("gen04_common_prefix", "WITH t AS (SELECT item_id AS seq, string_split(lower(text), ' ') AS tokens FROM benchmark), p AS (SELECT *, lag(tokens) OVER (ORDER BY seq) AS prev FROM t) SELECT seq, CASE WHEN prev IS NULL THEN 0 ELSE len(list_filter(range(1, len(tokens) + 1), lambda k: list_slice(tokens, 1, k) = list_slice(prev, 1, k) AND k <= len(prev))) END AS shared FROM p")
def _(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq"), F.split(F.lower("text"), " ").alias("tokens"))
    return monitor.common_prefix(b)
