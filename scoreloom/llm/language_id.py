"""Language identification: sparse multinomial logistic regression on TF-IDF weights of hashed character n-grams.

Document frequencies cover all training documents. Weights are learned by follow-the-regularised-leader (FTRL-proximal)
with an elastic-net penalty: shards of a bounded sample train side by side, and their weights are averaged between
rounds. A temperature fitted on examples kept out of training calibrates the probabilities.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_SLICE = 1 << 20  # characters that are hashed at once


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(text: str | None) -> np.ndarray:
    """How often each bucket's character n-grams occur in the lower-cased text. Signs and digits of ASCII are gaps; all
    else, letters and signs from U+0080 too, counts as it is."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found = np.zeros(BUCKETS)
    for at in range(0, max(len(points), 1), _SLICE):
        part = points[at : at + _SLICE + ORDERS[-1] - 1].astype(np.uint64)
        part[(part < 0x61) | ((part > 0x7A) & (part < 0x80))] = 32
        for n in ORDERS:
            size = min(len(part) - n + 1, _SLICE)
            if size <= 0:
                continue
            code = np.full(size, n, np.uint64)
            for k in range(n):
                code = (code ^ part[k : k + size]) * _MIX[k]
                code ^= code >> np.uint64(29)
            found += np.bincount((code % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return found


@dataclass(frozen=True)
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (languages, buckets)
    temperature: float = 1.0

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        found = counts(text)
        at = np.flatnonzero(found)
        x = np.log1p(found[at]) * self.idf[at]
        return at, x / (np.linalg.norm(x) or 1.0)

    def logits(self, text: str | None) -> np.ndarray:
        at, x = self.features(text)
        return self.weights[:, at] @ x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def held_out(col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Of each bucket, over all rows of docs (text); and their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df += counts(text.as_py()) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    df = np.zeros(BUCKETS + 1, np.int64)  # BUCKETS + 1 rows at most
    df[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return df[:-1], int(df[-1])


def _ftrl(model: Model, texts: list[str], labels: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """One pass of FTRL-proximal from the model's weights; returns the new weights."""
    start, shape = model.weights, model.weights.shape
    z, n = np.zeros(shape), np.zeros(shape)
    z -= start * (beta / alpha + l2) + np.sign(start) * l1  # the state whose weights are the start
    for text, label in zip(texts, labels, strict=True):
        at, x = model.features(text)
        za, na = z[:, at], n[:, at]
        w = np.where(np.abs(za) <= l1, 0.0, (np.sign(za) * l1 - za) / ((beta + np.sqrt(na)) / alpha + l2))
        p = _softmax(w @ x)
        p[label] -= 1.0
        g = np.outer(p, x)
        sigma = (np.sqrt(na + g * g) - np.sqrt(na)) / alpha
        z[:, at] = za + g - sigma * w
        n[:, at] = na + g * g
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))


def fit(docs: DataFrame, sample: int = 12_000, shards: int = 6, rounds: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> Model:
    """Learn from rows of docs (doc_id, text, lang) whose id is not held out, whose lang is set and whose text has a
    letter. sample: the most rows that FTRL and the temperature see, by a hash of the id (a documented bound on the
    training set; document frequencies cover all training rows). Fewer languages than two give a constant model."""
    train = docs.where(~held_out()).where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    chosen = train.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    examples = train.join(F.broadcast(chosen), "doc_id").select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)).alias("place"))
    examples = materialize(examples.withColumn("shard", F.when(F.col("place") % 10 == 0, -1).otherwise(F.col("place") % shards).cast("int")), "examples")
    langs = sorted(r["lang"] for r in examples.select("lang").distinct().collect())  # `sample` languages at most
    df, n = document_frequencies(train)
    model = Model(langs, np.log((1 + n) / (1.0 + df)) + 1.0, np.zeros((max(len(langs), 1), BUCKETS)))
    if len(langs) < 2:
        return Model(langs or ["und"], model.idf, model.weights)
    code = {lang: i for i, lang in enumerate(langs)}
    spark = docs.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def train_shard(rows: pd.DataFrame) -> pd.DataFrame:  # runs before shared changes
            rows = rows.sort_values("place", kind="stable")
            kept = [(t, code[x]) for t, x in zip(rows["text"], rows["lang"], strict=True) if has_letter(t)]
            w = _ftrl(shared.value, [t for t, _ in kept], np.array([c for _, c in kept]), alpha, beta, l1, l2)
            return pd.DataFrame({"n": [len(kept)], "weights": [pickle.dumps(w.astype(np.float32))]})

        trained = examples.where("shard >= 0").groupBy("shard").applyInPandas(train_shard, "n long, weights binary").collect()
        total = sum(r["n"] for r in trained) or 1
        model = Model(langs, model.idf, sum(pickle.loads(r["weights"]).astype(float) * (r["n"] / total) for r in trained))
    return _calibrate(model, examples.where("shard < 0"), code)


def _calibrate(model: Model, examples: DataFrame, code: dict[str, int]) -> Model:
    """The temperature with the least log loss on a tenth of the sample that no shard trained on."""
    shared = examples.sparkSession.sparkContext.broadcast(model)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.logits(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["lang", "logits"])

    rows = examples.select("lang", "text").mapInArrow(logits, "lang string, logits array<double>").collect()
    if not rows:
        return model
    z, y = np.array([r["logits"] for r in rows]), np.array([code[r["lang"]] for r in rows])
    return Model(model.langs, model.idf, model.weights, temperature(z, y))


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """1 / b for the b with the least log loss of softmax(b z) against the labels y, of which a share of 1 / (n + 1) is
    spread over all languages, so that separable examples have a finite one too. The loss is convex in b: its slope's
    zero is bracketed, without a limit, and halved down."""
    n, share = len(y), 1 / (len(y) + 1)
    wanted = (1 - share) * z[np.arange(n), y] + share * z.mean(axis=1)
    slope = lambda b: float(((_softmax(b * z) * z).sum(axis=1) - wanted).mean())
    low, high = 1.0, 1.0
    while slope(low) > 0 and low > 1e-300:
        low /= 2
    while slope(high) < 0 and high < 1e300:
        high *= 2
    for _ in range(100):
        middle = (low * high) ** 0.5
        low, high = (middle, high) if slope(middle) < 0 else (low, middle)
    return 1 / high


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row: `und` with score 1 if the text is null or has no letter. Equal scores go
    to the smaller language name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column(1):
                text = text.as_py()
                if has_letter(text):
                    p = _softmax(model.logits(text) / model.temperature)
                    names.append(model.langs[int(p.argmax())])
                    scores.append(float(p.max()))
                else:
                    names.append("und")
                    scores.append(1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
