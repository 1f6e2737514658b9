"""Toxicity by maximum-scoring segments.

Word log-odds with an informative Dirichlet prior come from labelled documents; a word without evidence of its own
takes those of its first letters. A linear-time scan finds every maximal segment of positive score in a document.
Since scores are log-odds against clean text, segment scores follow an extreme-value law of rate 1: a segment of score
S in n words has p = 1 - exp(-K n exp(-S)). K comes from clean training documents; the significant segments' -log p
add up, and a logistic curve makes the sum a score between 0 and 1.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, table

_WORD = re.compile(r"[^\W\d_]+")
STEM = 4


@dataclass(frozen=True)
class Model:
    """words: log-odds of words; stems: of the first STEM letters of other words; other: of all else."""

    words: dict[str, float]
    stems: dict[str, float]
    other: float
    k: float = 1.0
    slope: float = 1.0
    offset: float = -3.0

    def scorer(self) -> dict[str, float]:
        return _Scores(self)


class _Scores(dict):
    """Word to score. Keeps what it has looked up, within a bound."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.stems, self.other, self.room = model.stems, model.other, 200_000

    def __missing__(self, word: str) -> float:
        score = self.stems.get(word[:STEM], self.other) if len(word) > STEM else self.other
        if self.room > 0:
            self.room -= 1
            self[word] = score
        return score


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, end) of positive score, in order. Linear time: each candidate holds
    a link to the closest earlier one with a smaller left sum, so no candidate is passed twice."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, start, end, earlier candidate
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, start = float(total[i]), float(total[i + 1]), i
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                found.append((left, right, start, i + 1, j))
                break
            left, start = found[j][0], found[j][2]
            del found[j:]
            j -= 1
    return [(right - left, start, end) for left, right, start, end, _ in found]


def evidence(text: str | None, scores: dict[str, float], k: float, significance: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
    """The summed -log p of the significant segments, and those segments as (first word, end word, p)."""
    seq = _WORD.findall((text or "").lower())
    if not seq:
        return 0.0, []
    total, kept = 0.0, []
    for score, start, end in segments(np.fromiter(map(scores.__getitem__, seq), np.float64, len(seq))):
        p = -math.expm1(-k * len(seq) * math.exp(-score))
        if p <= significance:
            total -= math.log(max(p, 1e-300))
            kept.append((start, end, p))
    return total, kept


def _id_text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(col: str = "doc_id") -> Column:
    return F.crc32(_id_text(col).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = 30_000, features: int = 50_000, prior: float = 0.5, least_z: float = 3.0) -> Model:
    """Learn from labelled documents whose id is not held out.

    sample: the most labelled documents that are read, taken in the order of a hash of their id (a bound on the
    training set, documented here). features: the most words and stems that are kept, by |z|. prior: the
    pseudo-count of each word in the Dirichlet prior. A word counts once per example, and equal texts are one example
    (toxic if one is), so long texts and copies weigh no more. Null labels and null texts are no examples. Without
    both classes every score is the same.
    """
    bound_batches(docs.sparkSession)
    chosen = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    examples = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL").groupBy("text").agg(F.max("toxic").alias("toxic")), "examples")
    counts = _term_counts(examples)
    size = {r["kind"]: (r["a"], r["b"]) for r in counts.groupBy("kind").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}
    if not all(size.get("word", (0, 0))):
        return Model({}, {}, -1.0)
    tables: dict[str, dict[str, float]] = {"word": {}, "stem": {}}
    share = {}
    for kind, (na, nb) in size.items():
        odds = lambda x, total: F.log((x + prior) / (total - x + prior))
        scored = counts.where(F.col("kind") == kind).select(
            "term", "a", "b",
            (odds(F.col("a"), na) - odds(F.col("b"), nb)).alias("delta"),
            F.sqrt(1 / (F.col("a") + prior) + 1 / (F.col("b") + prior)).alias("sd"),
        )
        kept = scored.withColumn("z", F.abs(F.col("delta") / F.col("sd"))).where((F.col("z") >= least_z) & (F.col("delta") > 0))
        top = kept.orderBy(F.desc("z"), "term").limit(features).collect()
        tables[kind] = {r["term"]: r["delta"] for r in top}
        share[kind] = (sum(r["a"] for r in top) / max(na, 1), sum(r["b"] for r in top) / max(nb, 1))
    other = min(-1e-3, math.log((1 - min(share["word"][0], 0.99)) / (1 - min(share["word"][1], 0.99))))
    model = Model(tables["word"], tables["stem"], other)
    return _calibrate(model, examples)


def _term_counts(examples: DataFrame) -> DataFrame:
    """(kind, term, a, b): toxic and other examples with each word, and with each stem of a longer word."""
    seq = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    stems = F.array_distinct(F.transform(F.filter("seq", lambda w: F.char_length(w) > STEM), lambda w: F.substring(w, 1, STEM)))
    both = F.map_from_arrays(F.array(F.lit("word"), F.lit("stem")), F.array("seq", stems))
    terms = examples.select("toxic", seq.alias("seq")).select("toxic", F.explode(both).alias("kind", "terms")).select("toxic", "kind", F.explode("terms").alias("term"))
    return materialize(terms.groupBy("kind", "term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")), "terms")


def _calibrate(model: Model, examples: DataFrame) -> Model:
    """K from how often a clean example has a segment of a typical toxic word's score, then the logistic curve by
    Newton's method, centred where it makes the fewest errors."""
    if not model.words and not model.stems:
        return model
    level = float(np.median([*model.words.values(), *model.stems.values()]))

    def exceedances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scorer()
        for batch in batches:
            over, sizes = [], []
            for text in batch.column(0):
                seq = _WORD.findall(text.as_py().lower())
                found = segments(np.fromiter(map(scores.__getitem__, seq), np.float64, len(seq)))
                over.append(sum(s >= level for s, _, _ in found))
                sizes.append(len(seq))
            yield pa.RecordBatch.from_arrays([pa.array(over, pa.int64()), pa.array(sizes, pa.int64())], ["over", "size"])

    clean = examples.where("toxic = 0").select("text").mapInArrow(exceedances, "over long, size long").agg(F.sum("over").alias("n"), F.sum("size").alias("size")).first()
    model = Model(model.words, model.stems, model.other, k=((clean["n"] or 0) + 1) * math.exp(level) / max(clean["size"] or 1, 1))
    scored = examples.select("text", "toxic").mapInArrow(_evidence(model, 1), "toxic int, evidence double").toArrow().to_pandas()  # `sample` rows at most
    x, y = np.minimum(scored["evidence"].to_numpy(), 60.0), scored["toxic"].to_numpy()
    slope, offset = 1.0, -3.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([np.dot(p - y, x) + 1e-2 * slope, np.sum(p - y) + 1e-2 * offset])
        h = np.array([[np.dot(w, x * x) + 1e-2, np.dot(w, x)], [np.dot(w, x), np.sum(w) + 1e-2]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - np.clip(step[0], -1, 1), offset - np.clip(step[1], -1, 1)
    slope = max(float(slope), 1e-3)
    return Model(model.words, model.stems, model.other, model.k, slope, -slope * _fewest_errors(x, y))


def _fewest_errors(x: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the fewest errors on the examples; of equal ones the middle."""
    cuts = np.unique(x)
    cuts = (cuts[1:] + cuts[:-1]) / 2
    if not len(cuts):
        return float(x.max(initial=0.0)) + 1.0
    order = np.argsort(x)
    missed = np.concatenate(([0], np.cumsum(y[order])))  # toxic examples below the cut
    at = np.searchsorted(x[order], cuts)
    errors = missed[at] + (len(y) - at) - (missed[-1] - missed[at])
    best = cuts[errors == errors.min()]
    return float(best[len(best) // 2])


def _evidence(model: Model, ids: int):
    """Batches of (text, kept columns) to (kept columns, evidence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scorer()
        for batch in batches:
            found = [evidence(text.as_py(), scores, model.k)[0] for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1 : 1 + ids], pa.array(found, pa.float64())], [*batch.schema.names[1 : 1 + ids], "evidence"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row; null and empty texts have no evidence. Only text enters the score."""
    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("text", "doc_id").mapInArrow(_evidence(model, 1), f"doc_id {kind}, evidence double")
    value = 1 / (1 + F.exp(-(F.least("evidence", F.lit(60.0)) * model.slope + model.offset)))
    return rows.select("doc_id", value.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def remove_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose score is below 0.5. Each row is judged by its own text."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scorer()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            clean = [evidence(t.as_py(), scores, model.k)[0] * model.slope + model.offset < 0 for t in batch.column(at)]
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
