"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes
log-count ratios, trained on labelled text.

Null and empty texts have no features; their score is the model's share of toxic rows. Every row
is scored on its own, so repeated rows and ids get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.linear import Grams, Model, calibrated, features, held_out, sample, share
from tidemark.llm.textops import slices

GRAMS = Grams(chars=(3, 4, 5, 6), bits=20)


def train(docs: DataFrame, labels: DataFrame, each: int = 1000, weight: float = 2.5) -> Model:
    """Fits on up to `each` rows of either label that are not held out. A toxic row that is not found counts as much as
    `weight` false alarms, so scores are calibrated for toxic rows that many times as frequent as they are."""
    rows, y = features(sample(docs, labels, "toxic", each), GRAMS)
    known = share(labels, "toxic")
    return calibrated(rows, y, GRAMS, unit=False, bayes=True, l2=1e-3, prior=weight * known / (weight * known + 1 - known))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            p = shared.value.scores(data, offsets)
            columns = [part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    judged = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(judge, "doc_id bigint, score double, predicted int")
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
