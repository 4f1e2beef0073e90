"""The SQL of no query cuts rows or texts that its job has; tests/test_oracles.py holds every query against that SQL."""

import math
import re
import unicodedata

import xxhash

from tidemark.plans.registry import ORACLES, QUERIES

SEARCHES = "txt04_terms_matched txt05_bm25 txt11_relevant_media vec02_knn_in_family vec03_knn_all_families vec10_hybrid_query hyb01_rrf hyb02_evidence hyb03_around hyb05_latest hyb06_specific_order hyb07_media_merge".split()
GRAPH = "grf01_candidate_pairs grf02_graph_assembly grf03_normalised_adjacency grf04_appnp grf05_seeds grf06_pair_scores grf08_reinforcement grf09_lookback".split()


def test_graph_has_every_entity():
    assert not [n for n in GRAPH if re.search(r"\bid % \d", ORACLES[n])]


def test_searches_take_every_twentieth():
    for n in SEARCHES:
        assert "_id % 20 = 0" in ORACLES[n] and not re.search(r"(q_id|vec_id|doc_id) < \d", ORACLES[n]), n


def test_texts_are_whole():
    for n in [*SEARCHES, "prm02_evidence_block", "prm03_fitted_deictic", "prm04_prompts", "prm05_declined", "mon16_grades", "tnt03_wrapped", "adp11_external_documents", "adp08_media_chunks", "src07_media_snapshots", "prv06_anonymised_events", "mon15_replay_gate"]:
        assert not re.search(r"(left|substring|substr)\((text|html), ", ORACLES[n]), n


def test_every_chunk_is_embedded(spark, sf_dir):
    """Against the hashing embedder in plain Python: Spark's xxhash64 has the seed 42."""
    got = {r.id: r.vector for r in QUERIES["vec01_embedded_chunks"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows) == 200
    for r in rows:
        plain = "".join(c for c in unicodedata.normalize("NFD", (r.text or "").lower()) if not unicodedata.combining(c))
        x = [0.0] * 64
        for word in "".join(c if c.isalnum() else " " for c in plain).split():
            code = xxhash.xxh64(word.encode(), seed=42).intdigest()
            x[code % 64] += -1.0 if code >> 62 & 1 else 1.0
        norm = math.sqrt(sum(v * v for v in x)) or 1.0
        assert all(abs(a - v / norm) < 2e-4 for a, v in zip(got[r.doc_id], x, strict=True)), r.doc_id
