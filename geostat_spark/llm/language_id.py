"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader with elastic-net penalties, then temperature calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Settings:
    """``per_class`` bounds the labelled documents of one language that the classifier is fitted on; document
    frequencies come from all training documents."""

    n_grams: int = 3
    buckets: int = 1 << 14
    per_class: int = 300
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    calibration_share: float = 0.25


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray  # classes x buckets
    bias: np.ndarray
    temperature: float
    settings: Settings

    def probabilities(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        scores = (self.weights[:, index] @ value + self.bias) / self.temperature
        scores = np.exp(scores - scores.max())
        return scores / scores.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.classes or not has_letter(text):
            return UNDETERMINED, 0.0
        p = self.probabilities(*weighted(n_gram_counts(text, self.settings), self.idf))
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def n_gram_counts(text: str, settings: Settings) -> np.ndarray:
    """How often each bucket is hit by the text's lower-cased character n-grams of length 1 to ``n_grams``."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    counts = np.zeros(settings.buckets, np.int64)
    gram = np.zeros(len(codes), np.uint64)
    for n in range(1, settings.n_grams + 1):
        if len(codes) < n:
            break
        gram = gram[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        mixed = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        counts += np.bincount(((mixed >> np.uint64(40)) % np.uint64(settings.buckets)).astype(np.int64), minlength=settings.buckets)
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in use and their TF-IDF, of unit length."""
    index = np.flatnonzero(counts)
    value = (1 + np.log(counts[index])) * idf[index]
    return index, value / max(float(np.sqrt((value * value).sum())), 1e-12)


def _document_frequencies(training: DataFrame, settings: Settings) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                seen += n_gram_counts(text.as_py(), settings) > 0
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])

    found = np.zeros(settings.buckets, np.int64)
    for row in training.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[row["bucket"]] = row["n"]
    return found


def _sample(training: DataFrame, totals: dict[str, int], settings: Settings, idf: np.ndarray) -> list:
    """(language, buckets, values) of at most ``per_class`` documents a language, chosen by hash of the rows."""
    order = F.xxhash64("id", "text")
    share = F.lit(0.0)
    for language, n in totals.items():
        share = F.when(F.col("lang") == language, F.lit(min(1.0, 1.5 * settings.per_class / n + 20 / n))).otherwise(share)
    near = training.where(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30)).withColumn("at", F.pmod(order, F.lit(1 << 30)))
    window = Window.partitionBy("lang").orderBy("at", "id")
    few = near.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= settings.per_class)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [weighted(n_gram_counts(t.as_py(), settings), idf) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang"),
                    batch.column("at"),
                    pa.array([i.astype(np.int32) for i, _ in pairs], pa.list_(pa.int32())),
                    pa.array([v.astype(np.float32) for _, v in pairs], pa.list_(pa.float32())),
                ],
                names=["lang", "at", "index", "value"],
            )

    rows = few.select("lang", "at", "text").mapInArrow(features, "lang string, at long, index array<int>, value array<float>").toPandas()
    rows = rows.sort_values(["at", "lang"], kind="stable")
    return [(a, np.asarray(b), np.asarray(c, dtype=np.float64)) for a, b, c in zip(rows["lang"], rows["index"], rows["value"])]


def follow_the_leader(examples: list, n_classes: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal; ``examples``: (class number, buckets, values)."""
    size = settings.buckets + 1  # the last bucket is the bias
    z, n = np.zeros((n_classes, size)), np.zeros((n_classes, size))

    def current(at) -> np.ndarray:
        zi = z[:, at]
        shrunk = -(zi - np.sign(zi) * settings.l1) / ((settings.beta + np.sqrt(n[:, at])) / settings.alpha + settings.l2)
        return np.where(np.abs(zi) > settings.l1, shrunk, 0.0)

    for _ in range(settings.epochs):
        for label, index, value in examples:
            at, x = np.append(index, settings.buckets), np.append(value, 1.0)
            w = current(at)
            p = w @ x
            p = np.exp(p - p.max())
            p /= p.sum()
            p[label] -= 1
            g = p[:, None] * x[None, :]
            before = n[:, at]
            after = before + g * g
            z[:, at] += g - (np.sqrt(after) - np.sqrt(before)) / settings.alpha * w
            n[:, at] = after
    w = current(np.arange(size))
    return w[:, :-1], w[:, -1]


def calibrate(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that minimises the log loss of held-back scores; 1 without any."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    return float(min(np.geomspace(0.05, 10, 200), key=loss))


def fit(docs: DataFrame, training: Column, id: str = "doc_id", text: str = "text", lang: str = "lang", settings: Settings | None = None) -> Model:
    """The classifier learnt from the rows where ``training`` holds, text is not empty and lang is not null."""
    settings = settings or Settings()
    rows = docs.where(training).select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where("text is not null and text <> '' and lang is not null")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    classes = sorted(totals)
    if not classes:
        return Model([], np.ones(settings.buckets), np.zeros((0, settings.buckets)), np.zeros(0), 1.0, settings)
    idf = np.log((1 + sum(totals.values())) / (1 + _document_frequencies(rows, settings))) + 1
    examples = [(classes.index(a), b, c) for a, b, c in _sample(rows, totals, settings, idf)]
    held = int(len(examples) * settings.calibration_share)
    weights, bias = follow_the_leader(examples[held:], len(classes), settings)
    scores = np.array([weights[:, i] @ v + bias for _, i, v in examples[:held]]).reshape(held, len(classes))
    temperature = calibrate(scores, np.array([e[0] for e in examples[:held]], dtype=int))
    return Model(classes, idf, weights, bias, temperature, settings)


def predict(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of the documents with ``lang_pred`` and ``score`` (see ``identify_language``)."""
    names = ["lang_pred", "score"]
    # Plain values, so that a worker needs no import to read them: classes x buckets numbers, whatever the data's size.
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.classes, model.idf, model.weights, model.bias, model.temperature, asdict(model.settings))
    )
    rows = docs.drop(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *values, settings = shared.value
        own = Model(*values, Settings(**settings))
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())],
                names=[*batch.schema.names, *names],
            )

    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify_language(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    held_out: Column | None = None,
    settings: Settings | None = None,
) -> DataFrame:
    """All columns of the documents with ``lang_pred`` and ``score``, the calibrated probability.

    Learns from the rows that ``held_out`` leaves, with a label; the prediction sees the text alone, whole.
    Null and empty texts and texts without a letter are ``und`` with score 0, as are all texts when nothing is
    labelled. A null ``held_out`` counts as false. Ties go to the smaller language name. Rows that repeat count
    once each; columns named lang_pred or score are replaced. No rows give no rows."""
    training = F.lit(True) if held_out is None else ~F.coalesce(held_out, F.lit(False))
    return predict(docs, fit(docs, training, id, text, lang, settings), id, text)
