"""Quality classifier: logistic regression on hashed word n-grams.

Words (runs of letters and digits, and runs of signs) and pairs of neighbouring words hash
into 2**bits features; a pair whose first word returns 1 to 4 words later is counted as the pattern
"word, the same word" of that distance, whichever the word, in a place of its own; a document's feature values are its counts times ``SCALE`` over the
number of its n-grams. Training is per-coordinate follow-the-regularised-leader (FTRL
proximal) over a bounded sample; scoring is a sparse dot product on whole texts, map-side,
with one broadcast of 2**bits floats (1 MiB at the default).

Defined cases: null, empty and blank texts have no feature and get the score of the bias;
rows that repeat are scored each; a null doc_id is scored, but never learnt from; without
any label the score is 0.5; columns besides those named stay as they are.
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
from .tokens import Block, blocks, mix, words
from .workers import bounded, tidy

BITS = 18
#: Features in all: hashed ones and those of repetition.
SIZE = (1 << BITS) + 5
SCALE = 40.0
#: A pair counts as "the same word again" if its first word returns after so many words.
LAGS = (4, 3, 2, 1)
#: Bound of the training sample: so many labelled documents of either class.
PER_CLASS = 2000


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def features(block: Block, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each word and of each pair, first): document k has features[first[k]:first[k + 1]]."""
    w = words(block, by_kind=True)
    n = len(w.hash)
    one = mix(w.hash + np.uint64(1)) >> np.uint64(64 - bits)
    two = mix(w.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.hash[1:]) >> np.uint64(64 - bits) if n else one
    two, doc = two.astype(np.int64), w.doc
    for lag in LAGS:
        again = (w.hash[lag:] == w.hash[:-lag]) & (doc[lag:] == doc[:-lag])
        two[: max(n - lag, 0)][again] = (1 << bits) + lag
    both = np.empty((n, 2), np.int64)
    both[:, 0] = one
    both[: n - 1, 1] = two
    last = np.zeros(n, bool)
    last[w.first[1:][np.diff(w.first) > 0] - 1] = True
    keep = np.ones((n, 2), bool)
    keep[last, 1] = False
    count = np.diff(w.first)
    first = np.concatenate([[0], np.cumsum(np.maximum(2 * count - 1, 0))])
    return both[keep], first


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def scores(model: Model, column: pa.Array, bits: int = BITS) -> np.ndarray:
    out = np.empty(len(column))
    for b in blocks(column):
        f, first = features(b, bits)
        dot = _sums(model.weights[f], first) * SCALE / np.maximum(np.diff(first), 1)
        out[b.lo : b.hi] = 1 / (1 + np.exp(-np.clip(dot + model.bias, -30, 30)))
    return out


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        index, value = [], []
        for b in blocks(batch.column("text")):
            f, first = features(b)
            for lo, hi in zip(first[:-1], first[1:], strict=True):
                i, n = np.unique(f[lo:hi], return_counts=True)
                index.append(i.astype(np.int32))
                value.append((n * (SCALE / max(hi - lo, 1))).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["doc_id", "y", "i", "x"]
        )


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], size: int, epochs: int = 6, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, bias0: float = 0.0) -> Model:
    """FTRL-proximal over (y, indexes, values); the bias is one more coordinate, not regularised."""
    z, n = np.zeros(size), np.zeros(size)
    zb, nb = -bias0 * (beta / alpha), 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            y, i, x = rows[k]
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            b = -zb / ((beta + nb**0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w @ x + b, -30, 30))) - y
            gx = g * x
            sq = gx * gx
            z[i] = zi + gx - (np.sqrt(ni + sq) - root) / alpha * w
            n[i] = ni + sq
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * b
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(w.astype(np.float32), float(-zb / ((beta + nb**0.5) / alpha)))


def train(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learn from at most ``per_class`` documents of either label for which ``allowed`` holds."""
    picked = labelled(docs, labels, label, allowed, per_class)
    table = bounded(picked).mapInArrow(tidy(_sparse), "doc_id long, y int, i array<int>, x array<float>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    rows = [(y, np.asarray(i, np.int64), np.asarray(x, np.float64)) for y, i, x in zip(table["y"].to_pylist(), (v.values for v in table["i"]), (v.values for v in table["x"]), strict=True)]
    if not rows:
        return Model(np.zeros(SIZE, np.float32), 0.0)
    return ftrl(rows, SIZE)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out`` from 0 to 1 (higher: label 1 likelier); one map-side pass."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights.tobytes(), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(np.frombuffer(held.value[0], np.float32), held.value[1])
        for batch in batches:
            got = pa.array(scores(m, batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, out])

    docs = docs.drop(out)
    return bounded(docs).mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def filtered(docs: DataFrame, labels: DataFrame, allowed: Column, threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier accepts (score at least ``threshold``), with their columns."""
    model = train(docs, labels, allowed)
    name = "__quality"
    return score(docs, model, out=name).where(F.col(name) >= threshold).drop(name)
