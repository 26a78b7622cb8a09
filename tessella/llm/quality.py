"""Compression classifier: two zstandard dictionaries, one of good and one of bad text; the score is the calibrated
difference of the sizes a text is compressed to with each.

Whole texts are compressed in blocks, as a dictionary helps at the start of a block only. With g and b the summed
sizes and n the bytes of the text, the difference is normalised by the sizes, (b - g) / (b + g), and by the text,
(b - g) / n; log(g / n) tells how far the text repeats itself, which shrinks the second. A logistic curve over the three
gives a probability, higher for text like the good examples.

Training reads a bounded sample of the labelled rows: `per_class` rows of each label in the order of a hash of the id,
no longer than `max_bytes` each. Half of it makes the dictionaries, the other half fits the curve. Nothing but the text
enters a score.

Nulls: a null text is the empty text; empty texts get the share of good labels in training. Rows with a null label
teach nothing. With labels of one kind only, or none, every score is that share (0.5 with none). Repeated rows are
scored one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessella.llm.common import small_batches, whole_text

PER_CLASS = 1500
MAX_BYTES = 65_536
DICTIONARY_BYTES = 112_640
BLOCK = 8192
LEVEL = 3
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes | None = None
    bad: bytes | None = None
    raw: bool = False
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    prior: float = 0.5
    ready: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "ready"} | {"ready": []}

    def compressors(self) -> list:
        import zstandard

        if not self.ready:
            for data in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT if self.raw else zstandard.DICT_TYPE_AUTO)
                d.precompute_compress(level=LEVEL)
                self.ready.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False).compress)
        return self.ready

    def features(self, text: bytes) -> tuple[float, float, float]:
        g = b = 0
        good, bad = self.compressors()
        for i in range(0, len(text), BLOCK):
            part = text[i : i + BLOCK]
            g += len(good(part))
            b += len(bad(part))
        return (b - g) / (b + g), (b - g) / len(text), math.log(g / len(text))

    def score(self, text: bytes) -> float:
        if not text or self.good is None:
            return self.prior
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Intercept and slopes by Newton steps; a small ridge keeps them finite where the classes part fully."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    m = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, penalty = np.zeros(m.shape[1]), ridge * len(x) * np.ones(m.shape[1])
    penalty[0] *= 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + np.diag(penalty), m.T @ (y - p) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[1:] / scale
    return (float(w[0] - slopes @ mean), *map(float, slopes))


def fit(texts: dict[int, list[bytes]], dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """texts: examples of label 0 and 1."""
    import zstandard

    n = {k: len(texts.get(k, [])) for k in (0, 1)}
    if not sum(n.values()):
        return Model()
    prior = n[1] / sum(n.values())
    if min(n.values()) < 2:
        return Model(prior=prior)
    model = Model(prior=prior)
    learn, rest = {k: v[::2] for k, v in texts.items()}, {k: v[1::2] for k, v in texts.items()}

    def dictionary(k: int, raw: bool) -> bytes:
        parts = [t[i : i + BLOCK] for t in learn[k] for i in range(0, len(t), BLOCK)]
        return b"".join(parts)[-dictionary_bytes:] if raw else zstandard.train_dictionary(dictionary_bytes, parts).as_bytes()

    try:
        model.good, model.bad = dictionary(1, False), dictionary(0, False)
    except zstandard.ZstdError:  # too few examples to pick from: the examples themselves serve
        model.good, model.bad, model.raw = dictionary(1, True), dictionary(0, True), True
    x = np.array([model.features(t) for k in (0, 1) for t in rest[k]])
    y = np.array([float(k) for k in (0, 1) for _ in rest[k]])
    model.weights = logistic(x, y)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """From docs (doc_id, text) and labels (doc_id, label 0/1); labels are few columns, so only sampled texts move."""
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"))
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for k in (0, 1):
        some = known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select(F.col("doc_id").alias("sampled"))
        kept = docs.select("doc_id", whole_text().cast("binary").alias("text")).where((F.length("text") > 0) & (F.length("text") <= max_bytes))
        rows = kept.join(F.broadcast(some), F.col("doc_id") == F.col("sampled"), "left_semi")
        texts[k] = [bytes(r["text"]) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(per_class).collect()]
    return fit(texts)


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs, all columns, with the score of `text` as column `name`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            scores = pa.array([model.score((t or "").encode("utf-8", "replace")) for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], [*b.schema.names, name])

    return docs.mapInArrow(score, schema)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without those that a classifier learnt from labels (doc_id, label) rejects."""
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    return with_score(docs, train(docs.select("doc_id", "text"), labels), name).where(F.col(name) >= threshold).drop(name)
