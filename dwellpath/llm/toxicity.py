"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text is unlabelled, a mixture that
holds an unknown toxic share.  A linear classifier is trained in numpy to minimise

    prior * loss(positives as toxic)
      + max(0, loss(unlabelled as clean) - prior * loss(positives as clean))

where the last difference estimates the loss on clean documents; were it to go negative,
the classifier is fitting noise, and the step is taken back (Kiryo et al., 2017).

Features are words and their five-byte substrings.  How many documents hold each feature
is counted over the whole corpus; features clearly commoner among the positives are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellpath.llm.common import documents, free_name, id_remainder, pieces_of, table, text_bytes
from dwellpath.llm.decontaminate import words_of

FEATURE_BITS = 18
GRAM = 5
LEAST = 5  # positive documents that hold a feature; fewer suffice where there are fewer than ten
# Bounds of the training sample, drawn by a hash of the id.
POSITIVES, UNLABELLED = 8_000, 24_000
KNOWN_WORDS = 300_000


@dataclass(frozen=True)
class Model:
    """A linear classifier over hashed features that occur in a text or do not."""

    buckets: np.ndarray  # kept features, ascending
    weights: np.ndarray
    bias: float


class _WordFeatures(dict):
    """Word to its hashed features, or to the positions of the kept ones if ``kept`` is given."""

    def __init__(self, kept: np.ndarray | None = None) -> None:
        super().__init__()
        self.place = None if kept is None else {int(bucket): at for at, bucket in enumerate(kept)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        import xxhash
        framed = b"^" + word + b"$"
        grams = {framed, *(framed[at:at + GRAM] for at in range(len(framed) - GRAM + 1))}
        found = {xxhash.xxh32_intdigest(gram) >> (32 - FEATURE_BITS) for gram in grams}
        if self.place is not None:
            found = {self.place[bucket] for bucket in found if bucket in self.place}
        self[word] = features = tuple(found)
        return features

    def trim(self) -> None:
        if len(self) > KNOWN_WORDS:
            self.clear()


def _feature_counts(docs: DataFrame, positives: np.ndarray) -> DataFrame:
    """Documents per feature: ``bucket``, ``positive`` (among the given ids) and ``total``."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(positives))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known = shared.value, _WordFeatures()
        totals = np.zeros((2, 1 << FEATURE_BITS), np.int64)
        for batch in pieces_of(batches):
            known.trim()
            positive = np.isin(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False), ids)
            for text, marked in zip(text_bytes(batch.column(1)), positive):
                words = set(words_of(text))
                found = np.fromiter(set().union(*map(known.__getitem__, words)), np.int64)
                totals[1, found] += 1
                if marked:
                    totals[0, found] += 1
        used = np.flatnonzero(totals[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(totals[0, used]), pa.array(totals[1, used])], names=["bucket", "positive", "total"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "bucket long, positive long, total long")
    return counted.groupBy("bucket").agg(F.sum("positive").alias("positive"), F.sum("total").alias("total"))


def _kept_features(counts: DataFrame, positives: int, rows: int) -> np.ndarray:
    """The features whose count among the positives clearly exceeds what their share of all texts predicts."""
    expected = F.col("total") * (positives / max(1, rows))
    excess = (F.col("positive") - expected) / F.sqrt(expected)
    least = max(1, min(LEAST, positives // 2))
    best = counts.where((F.col("positive") >= least) & (excess > 4))
    return np.sort(np.array([r["bucket"] for r in best.select("bucket").collect()], np.int64))


def _sample_features(docs: DataFrame, chosen: DataFrame, kept: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Id and kept features of each sampled document; the sample's size is bounded."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordFeatures(kept)
        for batch in pieces_of(batches):
            known.trim()
            found = [np.array(sorted(set().union(*map(known.__getitem__, set(words_of(t))))), np.int32).tobytes()
                     for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "at"])

    sampled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    return [(r["doc_id"], np.frombuffer(r["at"], np.int32)) for r in
            sampled.mapInArrow(find, "doc_id long, at binary").toLocalIterator()]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_nnpu(positives: list[np.ndarray], unlabelled: list[np.ndarray], features: int, prior: float,
             steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with the sigmoid loss."""
    rows = positives + unlabelled
    n_pos, n_un = max(1, len(positives)), max(1, len(unlabelled))
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    column = np.concatenate([np.zeros(0, np.int32), *rows])
    is_pos = np.arange(len(rows)) < len(positives)
    theta = np.zeros(features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        margin = np.bincount(owner, theta[column], len(rows)) + theta[-1]
        toxic = _sigmoid(margin)
        slope = toxic * (1 - toxic)  # of the loss "clean", and minus that of the loss "toxic"
        clean_risk = toxic[~is_pos].sum() / n_un - prior * toxic[is_pos].sum() / n_pos
        clean_slope = np.where(is_pos, -prior / n_pos, 1 / n_un) * slope
        if clean_risk >= 0:
            pull = clean_slope + np.where(is_pos, -prior / n_pos, 0) * slope
        else:
            pull = -clean_slope  # the estimate went below zero: step back
        gradient = np.append(np.bincount(column, pull[owner], features), pull.sum())
        gradient[:-1] += decay * theta[:-1] / features
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient ** 2
        theta -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> Model:
    """Learn from the labels of the folds other than ``held_out``.

    ``docs``: ``doc_id``, ``text``; ``labels``: ``doc_id``, ``toxic`` (null labels are no
    labels, repeated ones count as toxic if any is).  A row's fold is crc32 of its id as
    text, modulo ``folds``.  The sample has at most ``POSITIVES`` toxic and ``UNLABELLED``
    other documents; feature counts cover all of ``docs``.  Without toxic examples the
    model calls nothing toxic.
    """
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").alias("toxic")).where(id_remainder(F.col("doc_id"), folds) != held_out)
    share = known.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()["p"]
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(
        F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), folds) != held_out))
    mixed = [F.xxhash64("doc_id"), F.col("doc_id")]
    positive = known.where("toxic = 1").join(ids.distinct(), "doc_id", "left_semi").orderBy(*mixed).limit(POSITIVES)
    positive_ids = np.array([r["doc_id"] for r in positive.select("doc_id").collect()], np.int64)
    if not len(positive_ids) or not share or share >= 1:
        return Model(np.zeros(0, np.int64), np.zeros(0), -5.0)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kept = _kept_features(_feature_counts(text, positive_ids), len(positive_ids), docs.count())
    others = [r["doc_id"] for r in ids.distinct().orderBy(*mixed).limit(UNLABELLED).collect()]
    marked = set(positive_ids.tolist())
    chosen = spark.createDataFrame([(int(i),) for i in sorted(marked.union(others))], "doc_id long")
    rows = _sample_features(text, chosen, kept)
    rows.sort(key=lambda row: (row[0], row[1].tolist()))
    unlabelled = set(others)
    weights, bias = fit_nnpu([at for i, at in rows if i in marked], [at for i, at in rows if i in unlabelled], len(kept), share)
    return Model(kept, weights, bias)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> tuple[DataFrame, str]:
    """Add the probability that each text is toxic; a null text scores like an empty one."""
    column = free_name(docs, out)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    names, text_at = schema.fieldNames(), docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, bias = _WordFeatures(shared.value.buckets), shared.value.weights, shared.value.bias
        for batch in pieces_of(batches):
            known.trim()
            margins = []
            for value in text_bytes(batch.column(text_at)):
                found = set().union(*filter(None, map(known.__getitem__, words_of(value))))
                margins.append(bias + float(weights[sorted(found)].sum()) if found else bias)
            scores = _sigmoid(np.array(margins, float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    return docs.mapInArrow(run, schema), column


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more."""
    scored, column = score(docs, train(docs.select("doc_id", "text"), labels))
    return scored.where(F.col(column) < threshold).select(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored, column = score(docs, model)
    return scored.select(
        "doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col(column).alias("score"),
        (F.col(column) >= 0.5).cast("int").alias("predicted"))
