"""Language identification in two steps: the family first, then one-versus-one linear machines inside it.

Features are frequencies of hashed 1- to 3-letter n-grams over the whole text. A linear support vector machine per family
(one against the rest) picks the family; for every pair of languages of a family another machine votes, ties going to
the larger sum of margins. Languages are those that the training rows carry; :data:`FAMILIES` groups those it names, any
other language is a family of its own.

Training uses about ``per_language`` rows of each language, drawn by a hash of the id; rates come from counts over all
rows. N-grams are counted where the texts are, and the driver gets vectors of fixed size, never texts. Every document is
predicted, in one narrow map without a shuffle.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is every text if nothing was learned;
with a single language all texts with letters are that one; repeated rows get the same answer and are learned from once;
very long texts are read whole, a text at a time; further columns, whatever their names, are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.llm import ngrams
from nodeloom.llm.common import Scratch, texts_of
from nodeloom.llm.linear import dense_svm
from nodeloom.llm.toxicity import remainder

SIZES, BITS = (1, 2, 3), 12
#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


class Model:
    """Per family a machine (one table if there are two families), per pair of languages of a family another."""

    def __init__(self, languages: list[str], features: np.ndarray | None = None, truth: np.ndarray | None = None) -> None:
        self.languages = languages
        self.family = [_FAMILY_OF.get(c, c) for c in languages]
        self.families = sorted(set(self.family))
        self.tables, self.offsets = np.zeros((0, (1 << BITS) + 1), np.float32), []
        self.pairs = [(a, b) for a, b in combinations(range(len(languages)), 2) if self.family[a] == self.family[b]]
        if features is None or len(languages) < 2:
            return
        own = np.array([self.families.index(f) for f in self.family])[truth]
        rivals = [own == k for k in range(len(self.families))] if len(self.families) > 2 else [own == 0] if len(self.families) == 2 else []
        fits = [dense_svm(features, np.where(up, 1.0, -1.0)) for up in rivals]
        for a, b in self.pairs:
            use = (truth == a) | (truth == b)
            fits.append(dense_svm(features[use], np.where(truth[use] == a, 1.0, -1.0)))
        self.tables = np.stack([np.append(w, np.float32(0)) for w, _ in fits]).astype(np.float32)
        self.offsets = [b for _, b in fits]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        total, length, letters = ngrams.sums(*texts_of(column), SIZES, BITS, self.tables)
        n = len(column)
        margin = total / np.maximum(length, 1)[None, :] + np.array(self.offsets).reshape(-1, 1)
        f = len(self.families)
        heads = margin[: f if f > 2 else f - 1] if f else margin
        family_margin = heads if f > 2 else np.concatenate([heads, -heads]) if f == 2 else np.ones((1, n))
        chosen = family_margin.argmax(axis=0)
        votes = np.zeros((len(self.languages), n))
        certainty = np.zeros((len(self.languages), n))
        for k, (a, b) in enumerate(self.pairs):
            m = margin[len(heads) + k]
            votes[a] += m > 0
            votes[b] += m <= 0
            certainty[a] += m
            certainty[b] -= m
        own = np.array([self.families.index(x) for x in self.family])
        rank = np.where(own[:, None] == chosen[None, :], votes + 0.5 * np.tanh(certainty / 8) if len(self.languages) else votes, -np.inf)
        best = rank.argmax(axis=0) if len(self.languages) else np.zeros(n, int)
        rivals = np.bincount(own, minlength=max(f, 1))[own] - 1 if len(self.languages) else np.zeros(1)
        inner = np.where(rivals[best] > 0, certainty[best, np.arange(n)] / np.maximum(rivals[best], 1), 9.0) if len(self.languages) else np.zeros(n)
        score = 1 / (1 + np.exp(-2 * np.clip(np.minimum(family_margin.max(axis=0) if f > 1 else 9.0, inner), -15, 15)))
        known = (letters > 0) & bool(self.languages)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, known, strict=True)], np.where(known, score, 0.0)


def _vectors(sample: DataFrame) -> list[tuple[str, bytes]]:
    """(lang, vector) of a sample (lang, text): the frequencies of its n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for slots, n in ngrams.slots_of(*texts_of(b.column(1)), SIZES, BITS):
                found, count = np.unique(slots, return_counts=True)
                rows.append(ngrams.pack(found, count / max(1, n)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["lang", "vector"])

    return sorted((r["lang"], bytes(r["vector"])) for r in sample.select("lang", "text").mapInArrow(run, "lang string, vector binary").collect())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 800, most_rows: int = 8000) -> Model:
    """Learns from rows whose crc32 of the id leaves no remainder of 2 by 4: about ``per_language`` of each language, and of
    all languages together at most ``most_rows`` (or one a language). Texts stay on the executors."""
    known = docs.where(F.col(lang_col).isNotNull() & (remainder(id_col, 4) != 2)).select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).alias("id"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return Model([])
    each = max(1, min(per_language, most_rows // len(counts)))
    # a few more than needed are drawn, so that rows that repeat and chance leave enough
    rate = F.element_at(F.create_map(*[F.lit(x) for k in sorted(counts) for x in (k, min(1.0, 1.25 * each / counts[k]))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    scratch = Scratch(docs.sparkSession)
    drawn = known.where(draw < rate).withColumn("key", F.xxhash64("id", "text"))
    drawn = scratch.keep(drawn.groupBy("lang", "key").agg(F.first("text").alias("text")), "languages")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    sample = scratch.keep(drawn.withColumn("place", place).where(F.col("place") <= each).select("lang", "text").repartition(8), "languages")
    rows = _vectors(sample)
    scratch.drop()
    languages = sorted({lang for lang, _ in rows})
    return Model(languages, ngrams.unpack([v for _, v in rows], 1 << BITS), np.array([languages.index(lang) for lang, _ in rows], int))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, score = model.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
