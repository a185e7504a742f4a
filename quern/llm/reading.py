"""Reading level of each document (problem 10).

From graded texts each word gets its acquisition grade: the mean grade of the texts
it occurs in, every grade weighing the same.  A document's level is predicted from
the quantiles of the grades of its known words, calibrated on the labelled
documents.  Words are Latin words in English and pairs of neighbouring ideographs
in Chinese; each language has its own word list and calibration.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, table
from .language import language

GRADES = (1, 2, 3, 4)
LANGUAGES = ("en", "zh")
#: Labelled documents the model is fitted on, at most; which ones is decided by a hash of the id.
FIT_DOCUMENTS = 20_000
#: Labelled documents a word must occur in to be known.
LEAST_DOCUMENTS = 3
QUANTILES = np.linspace(0.05, 0.95, 10)
_ENGLISH = re.compile("[a-z]{2,}")
_HAN = re.compile("[一-鿿]{2,}")


def words(text: str, lang: str) -> list[str]:
    if lang == "en":
        return _ENGLISH.findall(text.lower())
    out: list[str] = []
    for run in _HAN.findall(text):
        out += map("".join, zip(run, run[1:]))
    return out


def features(grades: dict[str, float], found: list[str]) -> np.ndarray:
    """Quantiles and mean of the grades of the known words; the middle grade where none is known."""
    known = [g for g in map(grades.get, found) if g is not None]
    if not known:
        return np.full(len(QUANTILES) + 1, 2.5)
    x = np.sort(np.array(known))
    return np.append(x[(QUANTILES * (len(x) - 1)).astype(int)], x.mean())


@dataclass
class Calibration:
    """Multinomial logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def grade(self, x: np.ndarray) -> int:
        z = np.append(1.0, (x - self.mean) / self.scale)
        return int(np.argmax(z @ self.weights)) + 1

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 400) -> Calibration:
        """x: features by document; y: share of raters by grade."""
        mean, scale = x.mean(0), x.std(0) + 1e-6
        z = np.c_[np.ones(len(x)), (x - mean) / scale]
        w = np.zeros((z.shape[1], len(GRADES)))
        shrink = np.r_[0.0, np.full(z.shape[1] - 1, ridge / len(z))][:, None]
        for _ in range(steps):
            s = z @ w
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            w -= z.T @ (p - y) / len(z) + shrink * w
        return cls(mean, scale, w)


@dataclass
class ReadingModel:
    grades: dict[str, dict[str, float]] = field(default_factory=dict)
    calibrations: dict[str, Calibration] = field(default_factory=dict)

    def predict(self, text: str) -> int | None:
        """Grade of a text; None if it is blank, in another language or there is no model of its language."""
        lang = language(text) if text and not text.isspace() else ""
        if lang not in self.calibrations:
            return None
        return self.calibrations[lang].grade(features(self.grades[lang], words(text, lang)))


def fit(documents: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> ReadingModel:
    """Fit on the labelled documents, or on ``fit_documents`` of them if there are more.

    Null or other grades than 1 to 4 and repeated label rows are ignored; documents
    with blank text or in other languages teach nothing.  The labelled documents are
    written once and counted in one pass; the driver gets every word that enough of
    them have, which their number bounds, and one row of features of each.
    """
    marks = labels.where(F.col("grade").isin(*GRADES)).select("label_id", "doc_id", "rater", "grade").distinct()
    shares = [F.avg((F.col("grade") == g).cast("double")).alias(f"g{g}") for g in GRADES]
    marks = marks.groupBy("doc_id").agg(*shares).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_documents)
    # At most fit_documents rows of five numbers: small whatever the corpus.
    graded = documents.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", *[f"g{g}" for g in GRADES])
    graded = cut(graded)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums: dict[tuple[str, str], np.ndarray] = {}
            for t, *y in b.itertuples(index=False):
                lang = language(t)
                if lang not in LANGUAGES:
                    continue
                found = Counter(words(t, lang))
                n = sum(found.values())
                one = np.array([1.0, *y])
                total = sums.setdefault((lang, ""), np.zeros(5))
                total += one
                for w, c in found.items():
                    s = sums.get((lang, w))
                    if s is None:
                        s = sums[lang, w] = np.zeros(5)
                    s[0] += 1
                    s[1:] += one[1:] * (c / n)
            yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["lang", "word", "n", *[f"g{g}" for g in GRADES]])

    schema = "lang string, word string, n double, g1 double, g2 double, g3 double, g4 double"
    sums = graded.mapInPandas(count, schema).groupBy("lang", "word").agg(*[F.sum(c).alias(c) for c in ("n", "g1", "g2", "g3", "g4")])
    known = sums.where(F.col("n") >= LEAST_DOCUMENTS).toPandas()
    model = ReadingModel()
    for lang, top in known.groupby("lang"):
        top = top.sort_values("word")
        whole, top = top[top.word == ""], top[top.word != ""]
        if whole.empty or top.empty:
            continue
        mass = np.maximum(whole[["g1", "g2", "g3", "g4"]].to_numpy()[0], 1e-9)
        p = top[["g1", "g2", "g3", "g4"]].to_numpy() / mass
        p += 0.02 * p.sum(1, keepdims=True)
        model.grades[lang] = dict(zip(top.word, (p @ np.array(GRADES)) / p.sum(1)))
    sent = documents.sparkSession.sparkContext.broadcast(model.grades)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, *y in b.itertuples(index=False):
                lang = language(t)
                if lang in sent.value:
                    rows.append((lang, features(sent.value[lang], words(t, lang)).tolist(), y))
            yield pd.DataFrame(rows, columns=["lang", "x", "y"])

    points = graded.mapInPandas(describe, "lang string, x array<double>, y array<double>").toPandas()
    for lang, part in points.groupby("lang"):
        model.calibrations[lang] = Calibration.fit(np.array(part.x.tolist()), np.array(part.y.tolist()))
    return model


def reading_levels(documents: DataFrame, model: ReadingModel) -> DataFrame:
    """(doc_id, grade) of every document with a non-blank text in Chinese or English.

    Null and blank texts, texts in other languages and documents without a doc_id
    give no row; equal texts get equal grades; repeated rows are kept as they are;
    whole texts are read; other columns are ignored; an empty table gives no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            grades = [model.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grades, pa.int32())], names=["doc_id", "grade"])

    rows = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("grade", T.IntegerType())])
    return rows.mapInArrow(run, schema).where("grade IS NOT NULL")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return reading_levels(documents, fit(documents, table(spark, sf_dir, "reading_labels")))
