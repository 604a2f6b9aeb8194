"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the words of whole texts, and over byte sequences in words, is trained in numpy from confirmed toxic documents (positives) and
documents without a label (unlabelled). Its risk is the class-prior-corrected estimate
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; while the second part is negative the step goes against it, which
keeps the model from explaining the unlabelled positives away.

Only the sample to fit on is bounded: about MAX_POSITIVE and MAX_UNLABELLED rows, the same at every run, chosen by
hashes of their ids, and of ids and texts where ids repeat. The class prior and the counts behind these bounds come from
all labels and documents; every feature of the sample's whole texts is considered; scoring reads every whole text.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, settle, tidied, words_of

MAX_POSITIVE = 6_000
MAX_UNLABELLED = 12_000
#: A feature takes part if so many positives of the sample hold it.
LEAST_POSITIVES = 4
#: ... and if its shares of positives and of unlabelled texts lie so many standard errors apart.
LEAST_APART = 4.0
#: ... and if, by the prior, at least this share of the unlabelled texts that hold it are positive.
LEAST_SHARE = 0.5
THRESHOLD = 0.7
HELD_OUT_FOLD = 1
GRAM = 6
#: Words whose features a Python worker remembers, and features that it counts before it hands the counts on.
CACHE_WORDS = 200_000
COUNTED = 500_000
#: Bits of a hash that sampling compares, so that a sample of a few thousand is not empty at any number of rows.
BITS = 62


def features_of(word: bytes) -> set[bytes]:
    """A word between marks, and the byte sequences of GRAM bytes in it."""
    marked = b"<" + word + b">"
    return {marked, *(marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1))}


class Finder:
    """Finds the features of texts that a vocabulary holds (None: all features); remembers those of words."""

    def __init__(self, vocabulary):
        self.vocabulary, self.known = vocabulary, {}

    def __call__(self, text: str | None) -> dict[bytes, float]:
        """Feature -> x / (1 + x) with x its occurrences in a hundred words: what long texts hold by chance weighs little."""
        words = words_of(text)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        found: dict[bytes, int] = {}
        for word, n in Counter(words).items():
            own = self.known.get(word)
            if own is None:
                own = self.known[word] = tuple(f for f in features_of(word) if self.vocabulary is None or f in self.vocabulary)
            for f in own:
                found[f] = found.get(f, 0) + n
        return {f: 100 * n / (100 * n + len(words)) for f, n in found.items()}


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    bias: float
    prior: float

    def scorer(self):
        """A function from texts to the probability of label 1; empty texts get the bias alone."""
        find = Finder(self.weights)

        def score(text: str | None) -> float:
            z = self.bias + math.fsum(self.weights[f] * x for f, x in find(text).items())
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

        return score


def nn_pu_step(theta: np.ndarray, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk with the logistic loss, and the direction to leave: its gradient, or against that of the second part while it is negative.

    theta: weights and bias. rows, cols, values: the features that documents hold.
    """
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    z = theta[-1] + np.bincount(rows, theta[cols] * values, len(positive))
    sigma = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    plus, minus = np.logaddexp(0, -z), np.logaddexp(0, z)  # losses of calling it positive, and negative
    rest = minus[~positive].sum() / n_u - prior * minus[positive].sum() / n_p
    risk = prior * plus[positive].sum() / n_p + max(0.0, rest)
    grad = np.where(positive, -prior * sigma / n_p, sigma / n_u)
    grad = np.where(positive, prior * (sigma - 1) / n_p, 0.0) + grad if rest >= 0 else -grad
    return risk, np.append(np.bincount(cols, grad[rows] * values, len(theta) - 1), grad.sum())


def nn_pu_fit(features: list[dict[int, float]], positive: np.ndarray, n_features: int, prior: float, steps: int = 600, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative risk with the logistic loss.

    features: the numbers and values of the features each document holds. prior: share of positives among the unlabelled.
    """
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    cols = np.array([c for f in features for c in f], np.int64)
    values = np.array([x for f in features for x in f.values()], np.float64)
    theta, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    theta[-1] = math.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        g = nn_pu_step(theta, rows, cols, values, positive, prior)[1]
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def least_hashes(hashed: Column, n: int, most: int) -> Column:
    """Whether a row belongs to a sample of about `most` of n rows, by its hash: the same at every run and partitioning."""
    return F.lit(True) if n <= most else hashed.bitwiseAND(F.lit(2**BITS - 1)) < F.lit((most << BITS) // n)


def _sample(ids: DataFrame, most: int) -> DataFrame:
    return ids.filter(least_hashes(F.xxhash64("doc_id"), ids.count(), most))


def _texts(docs: DataFrame, positives: DataFrame, others: DataFrame) -> DataFrame:
    """positive and text of the rows to fit on: those of a sample of each kind of ids, and of these a sample, where ids repeat."""
    chosen = _sample(positives, MAX_POSITIVE).withColumn("positive", F.lit(True)).unionByName(_sample(others, MAX_UNLABELLED).withColumn("positive", F.lit(False)))
    chosen = F.broadcast(settle(chosen))  # about MAX_POSITIVE and MAX_UNLABELLED ids
    n = {r.positive: r["count"] for r in docs.select("doc_id").join(chosen, "doc_id").groupBy("positive").count().collect()}
    row = F.xxhash64(F.lit(1), "doc_id", "text")
    stays = F.when(F.col("positive"), least_hashes(row, n.get(True, 0), MAX_POSITIVE)).otherwise(least_hashes(row, n.get(False, 0), MAX_UNLABELLED))
    texts = docs.join(chosen, "doc_id").filter(stays).select("positive", "text", F.xxhash64("text").alias("copy"))
    return settle(texts.dropDuplicates(["positive", "copy"]).select("positive", "text"))  # a text with many copies counts once


def _counts(texts: DataFrame) -> DataFrame:
    """Per feature of the sample: positives that hold it, and sums of its values and of their squares over positives and unlabelled."""
    names = ["word", "held", "p", "pp", "u", "uu"]

    def count(batches):
        places: dict[bytes, int] = {}
        sums = array("d")  # five numbers for each feature, by its place

        def told():
            cols = np.asarray(sums, np.float64).reshape(-1, 5)
            return pa.record_batch([pa.array(list(places), pa.binary()), *(pa.array(np.ascontiguousarray(c)) for c in cols.T)], names)

        find, zeros = Finder(None), [0.0] * 5
        for batch in batches:
            for positive, text in zip(batch.column("positive").to_pylist(), batch.column("text"), strict=True):
                for f, x in find(text.as_py()).items():
                    at = places.setdefault(f, len(sums))
                    if at == len(sums):
                        sums.extend(zeros)
                    if positive:
                        sums[at] += 1
                        sums[at + 1] += x
                        sums[at + 2] += x * x
                    else:
                        sums[at + 3] += x
                        sums[at + 4] += x * x
                if len(places) > COUNTED:
                    yield told()
                    places, sums = {}, array("d")
        yield told()

    rows = texts.mapInArrow(tidied(count), "word binary, held double, p double, pp double, u double, uu double")
    return rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in names[1:]])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labels of folds other than the held-out one.

    Labels with a null id or a null toxic value are ignored; an id with several labels counts as toxic if one says so.
    Without any positive (or any other document) the model gives the prior, or 0, to every text. Null texts count as
    empty ones; very long texts are read whole, and what they hold by chance weighs little. Equal texts count once.
    """
    learn = F.coalesce(fold_of(F.col("doc_id")) != HELD_OUT_FOLD, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = settle(marked.filter(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return Model({}, -500.0, 0.0)
    prior = min(max(toxic / total, 1e-4), 0.9)
    others = docs.select("doc_id").filter(learn).distinct().join(marked.select("doc_id").distinct(), "doc_id", "left_anti")
    others = settle(others)
    if others.isEmpty():  # everything is labelled: the labelled mixture is the unlabelled sample
        others = known.select("doc_id")
    texts = _texts(docs, known.filter("toxic = 1").select("doc_id"), others)
    sizes = {r.positive: float(r["count"]) for r in texts.groupBy("positive").count().collect()}
    n_p, n_u = sizes.get(True, 1.0), sizes.get(False, 1.0)
    # How far a feature's means over positives and over unlabelled texts lie apart, in standard errors of their difference.
    mean = (F.col("p") + F.col("u")) / (n_p + n_u)
    spread = (F.col("pp") + F.col("uu") + 1.0) / (n_p + n_u + 2.0) - mean * mean
    apart = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(F.greatest(spread, F.lit(1e-12)) * (1 / n_p + 1 / n_u))
    share = prior * (F.col("p") / n_p) / ((F.col("u") + 0.5) / (n_u + 1.0))
    best = _counts(texts).filter(F.col("held") >= LEAST_POSITIVES).filter((F.abs(apart) >= LEAST_APART) & (share >= LEAST_SHARE))
    # Features of the bounded sample that pass: each is in several of its positives.
    words = sorted(bytes(r.word) for r in best.select("word").toLocalIterator())
    place = {w: i for i, w in enumerate(words)}

    def index(batches):
        find = Finder(place)
        for batch in batches:
            rows = [{place[f]: x for f, x in find(t.as_py()).items()} for t in batch.column("text")]
            yield pa.record_batch([batch.column("positive"), pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.float64()))], ["positive", "cols", "xs"])

    sample = texts.mapInArrow(tidied(index), "positive boolean, cols array<int>, xs array<double>").toArrow()  # the bounded sample
    features = [dict(zip(c.as_py(), x.as_py(), strict=True)) for c, x in zip(sample.column("cols"), sample.column("xs"), strict=True)]
    positive = np.array(sample.column("positive").to_pylist(), bool)
    if not positive.any() or positive.all():
        return Model({}, math.log(prior / (1 - prior)), prior)
    weights, bias = nn_pu_fit(features, positive, len(words), prior)
    return Model({w: float(x) for w, x in zip(words, weights, strict=True) if x}, bias, prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of docs: doc_id, held_out, score, predicted. Null texts score as empty ones; a row without an id is never held out."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold_of(F.col("doc_id").cast("long")) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        score = sent.value.scorer()
        for batch in batches:
            found = np.array([score(t.as_py()) for t in batch.column("text")], np.float64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int")


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic; all columns stay. One pass scores and filters, without a shuffle of texts."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def keep(batches):
        score = sent.value.scorer()
        for batch in batches:
            good = [score(t.as_py()) < THRESHOLD for t in batch.column("text")]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(tidied(keep), docs.schema)
