"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of 3 to 6 letters with word boundaries. Each slot's ratio r = log P(slot | toxic) / P(slot |
not toxic) is counted over the training rows; the ``features`` slots with the largest |r| x frequency are kept, a
document's feature is r x count / sqrt(length), and a logistic regression is fitted over them and calibrated, so that a
score of 0.5 parts the classes at equal odds. Scoring folds ratios and calibration into the weights, so a text's score is
one pass of table look-ups and sums over all of it.

Training uses at most ``per_class`` labelled rows of each class, the first in hash order; the fit weighs them back to
the classes' true shares, counted over all labelled ids. Their n-grams are counted where the texts are; the driver gets
bounded counts and vectors, never texts. Every document is scored, in one narrow map without a shuffle.

Defined cases: null and empty texts get the score of an empty text; without toxic or without other labelled rows every
score is the smoothed share of toxic rows; labels other than 0 and 1 and labels without a document are not learned from;
an id with both labels counts once for each; repeated rows score alike; very long texts are scored whole, a text at a
time; further columns, whatever their names, are ignored by :func:`score` and pass through :func:`keep_clean`; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm import ngrams
from nodeloom.llm.common import Scratch, texts_of
from nodeloom.llm.linear import calibrate, logistic

SIZES, BITS = (3, 4, 5, 6), 18


def remainder(id_col: str, of: int) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


class Model:
    """Slots, their weights (ratios folded in) and the intercept."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, intercept: float) -> None:
        self.slots, self.weights, self.intercept = slots.astype(np.int32), weights.astype(np.float32), float(intercept)

    def scores(self, column: pa.Array) -> np.ndarray:
        table = np.zeros((1, (1 << BITS) + 1), np.float32)
        table[0, self.slots] = self.weights
        total, length, _ = ngrams.sums(*texts_of(column), SIZES, BITS, table)
        return 1 / (1 + np.exp(-np.clip(total[0] / np.sqrt(np.maximum(length, 1)) + self.intercept, -30, 30)))


def _counts(sample: DataFrame) -> np.ndarray:
    """Of a sample (toxic, text): in how many rows of either class each slot occurs; summed by block of slots."""
    blocks = 16
    schema = "block int, data binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            for (slots, _), t in zip(ngrams.slots_of(*texts_of(b.column(1)), SIZES, BITS), b.column(0).to_pylist(), strict=True):
                seen[t, np.unique(slots)] += 1
        parts = np.split(seen, blocks, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["block", "data"])

    def merge(table: pa.Table) -> pa.Table:
        data = np.sum([np.frombuffer(x.as_py(), np.int32) for x in table["data"]], axis=0, dtype=np.int32)
        return pa.table({"block": table["block"][:1].cast(pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})

    found = sample.select("toxic", "text").mapInArrow(count, schema).groupBy("block").applyInArrow(merge, schema).collect()
    out = np.zeros((2, 1 << BITS), np.int64)
    width = (1 << BITS) // blocks
    for r in found:
        out[:, r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["data"], np.int32).reshape(2, width)
    return out


def _vectors(sample: DataFrame, keep: np.ndarray, ratio: np.ndarray) -> list[tuple[int, bytes]]:
    """(toxic, vector) of the sample's rows: ratio x count / sqrt(length) of the slots kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1)
        place[keep] = np.arange(len(keep))
        for b in batches:
            rows = []
            for slots, length in ngrams.slots_of(*texts_of(b.column(1)), SIZES, BITS):
                found, count = np.unique(place[slots], return_counts=True)
                use = found >= 0
                rows.append(ngrams.pack(found[use], count[use] * ratio[keep[found[use]]] / np.sqrt(max(length, 1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["toxic", "vector"])

    return sorted((r["toxic"], bytes(r["vector"])) for r in sample.select("toxic", "text").mapInArrow(run, "toxic int, vector binary").collect())


def train(sample: DataFrame, share: float, features: int = 4096, penalty: float = 3e-7) -> Model:
    """Learns from a bounded sample (toxic 0 or 1, text); ``share``: of toxic rows among all labelled ones.

    Texts stay on the executors. The driver gets the slots' counts and a vector of ``features`` numbers at most a row.
    """
    have = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(have) < 2:
        return Model(np.zeros(0), np.zeros(0), np.log(share / (1 - share)))
    seen = _counts(sample) + 1.0
    part = seen / (np.array([have[0], have[1]])[:, None] + 2.0)
    ratio = np.log(part[1] / part[0])
    keep = np.sort(np.argsort(-np.abs(ratio) * part.max(axis=0), kind="stable")[:features])
    rows = _vectors(sample, keep, ratio)
    toxic = np.array([t == 1 for t, _ in rows])
    x = ngrams.unpack([v for _, v in rows], len(keep))
    weight = np.where(toxic, share / toxic.sum(), (1 - share) / (~toxic).sum())
    truth = np.where(toxic, 1.0, -1.0)
    w, b = logistic(x, truth, weight, penalty)
    slope, shift = calibrate(x @ w.astype(np.float32) + b, truth, weight)
    return Model(keep, slope * w * ratio[keep], slope * b + shift)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 2000) -> Model:
    """Learns from at most 2 x ``per_class`` rows whose crc32 of the id is not a multiple of 5, however often ids repeat."""
    known = labels.where(F.col(label_col).isin(0, 1) & (remainder(id_col, 5) != 0)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).distinct()
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    texts = docs.select(F.col(id_col).alias("own"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(drawn[0].unionByName(drawn[1])), F.col("own") == F.col("id")).select("toxic", "text", F.xxhash64("id", "text").alias("draw"))
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(rows, "labelled")
    sample = reduce(DataFrame.unionByName, [rows.where(F.col("toxic") == k).orderBy("draw", "text").limit(per_class) for k in (0, 1)])
    sample = scratch.keep(sample.select("toxic", "text").repartition(8), "sample")
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1.5)
    model = train(sample, share)
    scratch.drop()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` predicted not toxic, all columns as they were."""
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(b.column(b.schema.get_field_index(text_col))) < 0.5))

    return docs.mapInArrow(run, fields)
