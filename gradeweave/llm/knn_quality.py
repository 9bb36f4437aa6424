"""Quality classifier: a vote of the nearest labelled documents in a latent space.

A document's terms are its byte pairs, hashed, and its structure: three-word
windows and lines, each as new or repeated. Weighted by inverse document
frequency over the training rows, they are projected by the singular vectors of
the training matrix. The projected training rows and their labels are
broadcast; every document's cosines with all of them are computed in blocks,
and the nearest ``NEIGHBOURS`` vote with their similarity.

Training is bounded by ``MAX_LABELLED`` rows, the first by a hash of doc_id,
which bounds what the driver collects (``MAX_LABELLED`` times ``TERMS`` numbers, as one Arrow buffer) and broadcasts
(``MAX_LABELLED`` times ``DIMENSIONS`` plus ``TERMS`` times ``DIMENSIONS`` numbers). Only rows outside the fold that is
held out are learnt from; language, source, labels and ids are no inputs.

Cosines are taken in double precision and rounded to ``STEP``, so that neither the size of a batch nor the order of a
sum decides who votes: of equally near neighbours, those vote whose doc_id has the smaller hash.

Defined results: a null or empty text gets the share of good rows in training, and any text does where no row is
labelled (0.5 then); of several labels of a document the lowest counts; extra columns are kept by ``keep_good``.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from gradeweave.llm.common import fresh
from gradeweave.session import materialize

MAX_LABELLED = 6_000
PAIR_TERMS, STRUCTURE_TERMS = 1_024, 4
TERMS = PAIR_TERMS + STRUCTURE_TERMS
DIMENSIONS, NEIGHBOURS, SHARPNESS = 48, 25, 4
BLOCK = 512
#: What cosines are rounded to.
STEP = 1e-9


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def term_vector(text: str | None) -> np.ndarray:
    """Term weights of one text before the inverse document frequency: the parts on pairs and on structure have length
    one each."""
    text = text or ""
    out = np.zeros(TERMS, np.float32)
    raw = np.frombuffer(text.encode(), np.uint8)
    for k in range(0, len(raw) - 1, 1 << 20):  # a very long text, part by part
        part = raw[k:k + (1 << 20) + 1].astype(np.uint32)
        pairs = (part[:-1] * 256 + part[1:]) * np.uint32(2_654_435_761) >> np.uint32(22)
        out[:PAIR_TERMS] += np.bincount(pairs, minlength=PAIR_TERMS)
    words = text.split()
    if not words:
        return out * 0
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    lines = Counter(x for x in text.split("\n") if x.strip())
    n_windows = max(1, len(words) - 2)
    fresh_windows = sum(1 for n in windows.values() if n == 1) if len(words) > 2 else 1
    out[PAIR_TERMS:] = (
        fresh_windows / n_windows, 1 - fresh_windows / n_windows,
        len(lines) / max(1, lines.total()), 1 - len(lines) / max(1, lines.total()),
    )
    out[:PAIR_TERMS] = np.sqrt(out[:PAIR_TERMS])
    for part in (slice(0, PAIR_TERMS), slice(PAIR_TERMS, TERMS)):
        out[part] /= max(float(np.linalg.norm(out[part])), 1e-9)
    return out


@F.arrow_udf(BinaryType())
def _terms(texts: pa.Array) -> pa.Array:
    return pa.array([term_vector(t.as_py()).tobytes() for t in texts], pa.binary())


@dataclass(frozen=True)
class NeighbourModel:
    """Projection of term vectors, and the labelled vectors in latent space."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray) -> NeighbourModel:
        seen = (rows > 0).sum(axis=0)
        idf = np.log((1 + len(rows)) / (1 + seen)) + 1
        _, vectors = np.linalg.eigh((rows.T @ rows).astype(np.float64) * idf[:, None] * idf[None, :])
        projection = idf[:, None] * vectors[:, ::-1][:, :DIMENSIONS]
        return cls(projection, cls.latent(rows, projection), labels.astype(np.float64))

    @staticmethod
    def latent(rows: np.ndarray, projection: np.ndarray) -> np.ndarray:
        """Rows of terms as unit vectors of the latent space."""
        out = np.empty((len(rows), projection.shape[1]))
        for begin in range(0, len(rows), BLOCK):
            out[begin:begin + BLOCK] = rows[begin:begin + BLOCK].astype(np.float64) @ projection
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of good labels among the nearest, for rows of terms."""
        out = np.full(len(rows), self.prior())
        k = min(NEIGHBOURS, len(self.labels))
        if k == 0:
            return out
        n = len(self.labels)
        for begin in range(0, len(rows), BLOCK):
            steps = np.rint(self.latent(rows[begin:begin + BLOCK], self.projection) @ self.vectors.T / STEP).astype(np.int64)
            order = n - 1 - np.arange(n) + steps * n  # by cosine, then by place: no two are equal
            near = np.sort(np.partition(order, n - k, axis=1)[:, n - k:], axis=1)
            weight = np.clip((near // n) * STEP, 0, None) ** SHARPNESS
            total = weight.sum(axis=1)
            vote = (weight * self.labels[n - 1 - near % n]).sum(axis=1)
            out[begin:begin + BLOCK] = np.where(total > 0, vote / np.where(total > 0, total, 1), out[begin:begin + BLOCK])
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> NeighbourModel:
    """Model of at most ``limit`` labelled documents outside the held-out fold."""
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    chosen = (
        usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    # Stored first, so that a few files and not all tasks send their rows to the driver.
    held = materialize(
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``limit`` rows
        .select("doc_id", "quality", _terms("text").alias("terms")), "quality-terms")
    rows = held.orderBy(F.xxhash64("doc_id"), "doc_id", "terms").limit(limit).select("quality", "terms").toArrow()
    if len(rows) == 0:
        return NeighbourModel(np.zeros((TERMS, DIMENSIONS)), np.zeros((0, DIMENSIONS)), np.zeros(0))
    raw = rows["terms"].combine_chunks()
    begin, end = (np.frombuffer(raw.buffers()[1], np.int32)[at] for at in (raw.offset, raw.offset + len(raw)))
    terms = np.frombuffer(raw.buffers()[2], np.float32, (end - begin) // 4, begin).reshape(-1, TERMS)
    return NeighbourModel.fit(terms, rows["quality"].to_numpy())


def scored(docs: DataFrame, model: NeighbourModel, name: str) -> DataFrame:
    """``docs`` with the score as column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        rows = np.stack([term_vector(t.as_py()) for t in texts]) if len(texts) else np.zeros((0, TERMS), np.float32)
        return pa.array(shared.value.scores(rows))

    return docs.withColumn(name, score.asNondeterministic()("text"))  # so that it is computed once


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return (
        scored(docs.select("doc_id", "text"), fit(docs, labels), "score")
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model takes for good, with all their columns."""
    name = fresh(docs, "quality_score")
    return scored(docs, fit(docs, labels), name).filter(F.col(name) >= 0.5).select(docs.columns)
