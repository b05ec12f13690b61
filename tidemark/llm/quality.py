"""Quality classifier by compression.

Two zstandard dictionaries hold slices of good and of bad labelled texts. A text that a dictionary knows compresses to
less with it, so the difference of the two sizes, divided by their sum, tells the classes apart. A logistic model of
this difference, of the compression ratio and of the length, fitted on labelled texts that no dictionary holds, turns it
into a calibrated score.

What is gathered from the corpus is bounded, whatever its size: ``DICT_TEXTS`` slices of ``SLICE`` characters and
``FIT_TEXTS`` rows of three numbers for each class. Which labelled rows these are goes by a hash of their id. Scoring
reads every whole text.

Defined cases: a null text counts as empty; empty texts get the score that their sizes give; without labelled rows of
both classes every score is the smoothed share of good ones; labels of unknown documents, null labels and repeated
labels are harmless; repeated rows are scored each; an empty table gives an empty result; labels, lang, source and id
are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import release

#: Bounds of the training sample, for each class.
DICT_TEXTS, FIT_TEXTS, SLICE = 600, 2500, 1000
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.sizes = model, Sizes(model.good, model.bad)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.model.weights):
            return np.full(len(texts), self.model.prior)
        x = (features(self.sizes(texts)) - self.model.mean) / self.model.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.model.weights, -30, 30)))


class Sizes:
    """(with the good dictionary, with the bad one, plain) sizes in bytes."""

    def __init__(self, good: bytes, bad: bytes):
        self.compress = []
        for data in (good, bad):
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False).compress)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty((len(texts), 3))
        for i, text in enumerate(texts):
            data = (text or "").encode()
            out[i] = len(self.compress[0](data)), len(self.compress[1](data)), len(data)
        return out


def features(sizes: np.ndarray) -> np.ndarray:
    """Difference over sum, logarithms of ratio and length, and their products."""
    good, bad, plain = sizes.T
    d, ratio, length = (bad - good) / (bad + good), np.log((good + bad + 1) / (2 * plain + 1)), np.log(plain + 1)
    return np.stack([np.ones_like(d), d, ratio, length, d * d, ratio * ratio, length * length, d * ratio, d * length, ratio * length], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) by Newton's method with halved steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[0], scale[0] = 0, 1
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    held = ridge * len(y)

    def loss(w: np.ndarray) -> float:
        t = z @ w
        return float(np.sum(np.logaddexp(0, t) - y * t) + held / 2 * w @ w)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + held * np.eye(len(w)), z.T @ (y - p) - held * w)
        rate = 1.0
        while loss(w + rate * step) > loss(w) and rate > 1e-6:
            rate /= 2
        w = w + rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    return mean, scale, w


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the labelled rows (id, quality) for which ``learn`` holds."""
    known = labels.where(learn & F.col("quality").isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("quality")).withColumn("h", F.xxhash64("id"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    nothing = Model(b"", b"", np.empty(0), np.empty(0), np.empty(0), prior)
    if min(counts.get(0, 0), counts.get(1, 0)) < 2:
        return nothing
    picked = None
    for quality in (0, 1):
        held = min(DICT_TEXTS, counts[quality] // 2)
        some = known.where(F.col("quality") == quality).orderBy("h", "id").limit(held + FIT_TEXTS)
        some = some.select("id", "quality", (F.row_number().over(_order()) <= held).alias("dict"))
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), "id")
    at = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.lit(1), F.char_length("text") - SLICE)).cast("int") + 1
    slices = rows.where("dict").select("quality", "id", F.substring("text", at, F.lit(SLICE)).alias("s")).collect()
    by = {q: b"\n".join(r["s"].encode() for r in sorted(slices, key=lambda r: (r["id"], r["s"])) if r["quality"] == q) for q in (0, 1)}
    if min(map(len, by.values())) < 8:
        return nothing
    good, bad = by[1], by[0]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            out = sizes(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in out.T)], ["quality", "good", "bad", "plain"])

    fit = rows.where("NOT dict").select("quality", "text").mapInArrow(measure, "quality int, good double, bad double, plain double").collect()
    if len({r["quality"] for r in fit}) < 2:
        return nothing
    fit.sort(key=tuple)
    x, y = features(np.array([r[1:] for r in fit], float)), np.array([r[0] for r in fit], float)
    mean, scale, weights = fit_logistic(x, y)
    # the sample has as many of either class as it can; the intercept goes back to the share among all labelled rows
    sampled = y.mean()
    weights[0] += np.log(prior / (1 - prior)) - np.log(sampled / (1 - sampled))
    return Model(good, bad, mean, scale, weights, prior)


def _order():
    from pyspark.sql import Window

    return Window.orderBy("h", "id")


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with one more column: the probability that a text is good. A column of that name that ``docs`` has is replaced."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.select(*(c for c in docs.columns if c == text_col or c.lower() != name.lower()))
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = held.value.scorer()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):  # texts are copied to Python few at a time
                part = batch.slice(k, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer(part.column(at).to_pylist()), pa.float64())], [*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
