"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Each distinct character n-gram (letters in lower case, other characters as one space) of a
document hashes into 2**bits features, present or not. A feature's scale is the log ratio of
its smoothed counts in toxic and other documents, drawn towards 0 by ``DOUBT`` of its standard
errors, so that n-grams seen a few times don't outweigh those seen often; a logistic regression
is then learnt on the scaled features from a bounded sample. Scoring adds weight times ratio over the distinct
features present in the whole text, map-side, with one broadcast of 2**bits floats.

Defined cases: null, empty and letterless texts get the score of the bias; repeated rows are
scored each; without labels of both kinds the score is the share of toxic labels (0.5 with
none at all); columns besides those named stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sample import labelled
from .storage import written
from .tokens import letter_streams, mix, text_blocks
from .workers import bounded, tidy

BITS = 20
#: Characters whose n-grams are made together.
BLOCK = 1 << 15
SIZES = (3, 4, 5, 6)
#: Bound of the training sample: so many labelled documents of either class.
PER_CLASS = 2500
#: Standard errors by which a log-count ratio is drawn towards 0, and what is added to every count.
DOUBT, SMOOTH = 2.0, 0.5


@dataclass
class Model:
    weights: np.ndarray  # ratio times learnt weight
    bias: float


def grams(texts: list[str | None], bits: int = BITS, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(features at each place, the text each belongs to), repeats included; of all or the ``wanted`` features."""
    points, first, _ = letter_streams(texts, 1)
    value = points.astype(np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    out, of = [], []
    rolled = value.copy()
    for k in range(1, max(SIZES)):
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + value[k:]
        if k + 1 in SIZES and len(rolled):
            feature = (mix(rolled + np.uint64(k << 56)) >> np.uint64(64 - bits)).astype(np.int64)
            inside = doc[: len(rolled)] == doc[k:]
            if wanted is not None:
                inside &= wanted[feature]
            out.append(feature[inside])
            of.append(doc[: len(rolled)][inside])
    return (np.concatenate(out), np.concatenate(of)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def _present(feature: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((doc.astype(np.int64) << bits) | feature)
    return both & ((1 << bits) - 1), both >> bits


def scores(model: Model, texts: list[str | None], bits: int = BITS) -> np.ndarray:
    out, wanted = np.empty(len(texts)), model.weights != 0
    for lo, hi in text_blocks(texts, BLOCK):
        f, doc = _present(*grams(texts[lo:hi], bits, wanted), bits)
        dot = np.bincount(doc, model.weights[f], hi - lo) + model.bias
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
    return out


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, other): how many documents of a batch have each feature."""
    for batch in batches:
        texts, y = batch.column("text").to_pylist(), batch.column("y").to_numpy(zero_copy_only=False)
        count = np.zeros((2, 1 << BITS), np.int32)
        for lo, hi in text_blocks(texts, BLOCK):
            f, doc = _present(*grams(texts[lo:hi]), BITS)
            for label in (0, 1):
                np.add.at(count[label], f[y[lo:hi][doc] == label], 1)
        at = np.flatnonzero(count.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[1, at].astype(np.int64)), pa.array(count[0, at].astype(np.int64))], names=["feature", "toxic", "other"])


def _sparse(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, y, i): the features of each document whose ratio isn't 0."""
        tells = np.unpackbits(np.frombuffer(held.value, np.uint8)).astype(bool)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            got: list[np.ndarray] = []
            for lo, hi in text_blocks(texts, BLOCK):
                f, doc = _present(*grams(texts[lo:hi], BITS, tells), BITS)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                got += [f[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(got, pa.list_(pa.int32()))], names=["doc_id", "y", "i"])

    return run


def ratios(toxic: np.ndarray, other: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-count ratios of features from the numbers of toxic and other documents that have them, drawn towards 0."""
    a, b = toxic + SMOOTH, other + SMOOTH
    ratio = np.log(a / (n1 + 2 * SMOOTH)) - np.log(b / (n0 + 2 * SMOOTH))
    return np.sign(ratio) * np.maximum(np.abs(ratio) - DOUBT * np.sqrt(1 / a + 1 / b), 0)


def fit(y: np.ndarray, kept: list[np.ndarray], ratio: np.ndarray, epochs: int = 15, rate: float = 0.5, l2: float = 1e-3) -> Model:
    """Logistic regression (adaptive gradient steps) on scaled features; ``kept``: each document's, of a ratio other than 0."""
    size, n1, n0 = len(ratio), int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1)
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    w, seen, b, seen_b = np.zeros(size), np.full(size, 1e-8), float(np.log(n1 / n0)), 1e-8
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for k in order.permutation(len(kept)):
            i = kept[k]
            r = ratio[i]
            g = 1 / (1 + np.exp(-np.clip(w[i] @ r + b, -30, 30))) - y[k]
            step = g * r + l2 * w[i]
            seen[i] += step * step
            w[i] -= rate * step / np.sqrt(seen[i])
            seen_b += g * g
            b -= rate * g / seen_b**0.5
    return Model((w * ratio).astype(np.float32), b)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``per_class`` documents of either label for which ``allowed`` holds.

    Spark counts the documents that have each feature; then the driver gets, of each document,
    only the features that the counts tell something about.
    """
    picked = written(bounded(labelled(docs, labels, label, allowed, per_class)), "toxicity-sample")
    n = {r["y"]: r["count"] for r in picked.groupBy("y").count().collect()}
    counts = picked.mapInArrow(tidy(_presence), "feature int, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toArrow()
    toxic, other = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = counts["feature"].to_numpy()
    toxic[at], other[at] = counts["toxic"].to_numpy(), counts["other"].to_numpy()
    ratio = ratios(toxic, other, n.get(1, 0), n.get(0, 0))
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(ratio != 0).tobytes())
    table = picked.mapInArrow(tidy(_sparse(held)), "doc_id long, y int, i array<int>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    return fit(table["y"].to_numpy().astype(np.int64), [v.values.to_numpy(zero_copy_only=False) for v in table["i"]], ratio)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out`` from 0 to 1 (higher: toxic likelier); one map-side pass."""
    at = np.flatnonzero(model.weights)
    held = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32).tobytes(), model.weights[at].tobytes(), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS, np.float32)
        weights[np.frombuffer(held.value[0], np.int32)] = np.frombuffer(held.value[1], np.float32)
        m = Model(weights, held.value[2])
        for batch in batches:
            got = pa.array(scores(m, batch.column(text).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, out])

    docs = docs.drop(out)
    return bounded(docs).mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def flagged(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is ``threshold`` or more."""
    return score(docs, model, out="__toxic").where(F.col("__toxic") >= threshold).drop("__toxic")
