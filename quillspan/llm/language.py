"""Language identification by interpolated Kneser-Ney character models.

Counting: every character n-gram (letters in lower case, other characters as one space) of
the training texts up to ``ORDER`` is counted, per language, in one pass; partial counts of a
block leave the workers, so a hot language is summed before it is shuffled. Modified counts
follow Kneser and Ney: full counts at the highest order, numbers of distinct predecessors
below, one absolute discount an order. The models of all languages share sorted hash arrays,
one an order: (hash, log-probability per language) with (hash, log back-off per language) for
contexts. Scoring finds every character by binary search, falls back to shorter n-grams with
the contexts' weights, and takes the language of the lowest cross-entropy a character.

Rejection: one training text in ``CALIBRATION`` is set apart. Models of the others give the
cross-entropies of all texts set apart in their own languages, whose mean and deviation Spark
takes by language; ``accepted`` is false above mean + ``TOLERANCE`` deviations. A language with
fewer than ``LEAST`` such texts of 20 letters has no threshold, and nothing is rejected for it.
The models that answer are then built from the counts of all training texts, those set apart too.

Every n-gram stays. Up to ``HELD`` cells (n-grams of all orders by languages) one model is built on
the driver and broadcast. Beyond that, Spark computes the same probabilities and weights as
tables, and texts are scored in rounds: a round broadcasts the n-grams of a range of code points,
by the character before the last, which all n-grams that end at one place and their contexts
share, and adds what its places give. A range has about ``HELD`` cells, or one character's n-grams
where these alone are more; single characters, bounded by the alphabet, are part of each range.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and not
accepted; so is everything if no language was learnt. Ties go to the language that sorts
first. Repeated rows are answered each; other columns stay.
"""

from __future__ import annotations

import weakref
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written
from .tokens import letter_streams, mix, text_blocks
from .workers import bounded, tidy

ORDER = 4
#: Most cells, n-grams by languages, of a model that is broadcast.
HELD = 1 << 21
TOLERANCE = 6.0
#: One training text in so many is set apart to calibrate the rejection.
CALIBRATION = 50
#: Fewest texts set apart that make a language's threshold.
LEAST = 5
UNKNOWN = "und"


def _keys(points: np.ndarray, order: int) -> list[np.ndarray]:
    """Rolling hashes of the n-grams that end at each character, for n = 1..order (0 where there is none yet)."""
    value = points.astype(np.uint64)
    out, rolled = [mix(value + np.uint64(1 << 40))], value
    for n in range(2, order + 1):
        # the n-gram that ends at i is the character n-1 places before it, then the (n-1)-gram that ends at i
        longer = np.zeros(len(value), np.uint64)
        longer[n - 1 :] = value[: len(value) - n + 1] * np.uint64(pow(0x100000001B3, n - 1, 1 << 64)) + rolled[n - 1 :]
        rolled = longer
        out.append(mix(rolled + np.uint64(n << 40)))
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, apart, gram, n): how often each n-gram of the highest order occurs in a batch."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        aparts = np.array(batch.column("apart").to_pylist(), bool)
        texts = batch.column("text").to_pylist()
        for lang, apart in sorted(set(zip(langs, aparts.tolist(), strict=True))):
            mine = [texts[i] for i in np.flatnonzero((langs == lang) & (aparts == apart))]
            keys, grams, counts = [], [], []
            for lo, hi in text_blocks(mine):
                points, first, _ = letter_streams(mine[lo:hi], ORDER - 1)
                own = _own(points, first)
                key, at, n = np.unique(_keys(points, ORDER)[-1][own], return_index=True, return_counts=True)
                at = np.flatnonzero(own)[at]
                keys.append(key)
                grams.append(np.stack([points[at - (ORDER - 1 - k)] for k in range(ORDER)], 1))
                counts.append(n)
            key, at, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            total = np.bincount(back, np.concatenate(counts)).astype(np.int64)
            text = np.concatenate(grams)[at].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([apart] * len(at), pa.bool_()), pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)], pa.string()), pa.array(total, pa.int64())], names=["lang", "apart", "gram", "n"])


def _own(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which characters are a text's own, not the spaces put before it."""
    own = np.ones(len(points), bool)
    for k in range(ORDER - 1):
        own[first[:-1] + k] = False
    return own


@dataclass
class Model:
    langs: list[str]
    grams: list[np.ndarray] = field(default_factory=list)  # by order: sorted hashes
    logp: list[np.ndarray] = field(default_factory=list)  # by order: (n-gram, language)
    contexts: list[np.ndarray] = field(default_factory=list)  # by length 1..ORDER-1: sorted hashes
    backoff: list[np.ndarray] = field(default_factory=list)
    floor: float = -14.0
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None


def _hash_of(points: np.ndarray) -> np.ndarray:
    """Hashes of n-grams given as rows of code points, as ``_keys`` has them."""
    n = points.shape[1]
    value = points[:, n - 1].astype(np.uint64)
    for k in range(2, n + 1):
        value += points[:, n - k].astype(np.uint64) * np.uint64(pow(0x100000001B3, k - 1, 1 << 64))
    return mix(value + np.uint64(n << 40))


def build(tables: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> Model:
    """The models from modified counts; tables[n - 1] holds n-grams (rows of code points) and their counts by language."""
    model = Model(langs)
    lower: tuple[np.ndarray, np.ndarray] | None = None
    size = max(len(tables[0][0]), 1)
    model.floor = float(np.log(1 / (size + 1))) - 3
    for n, (points, count) in enumerate(tables, 1):
        if not len(points):
            break
        names, of = np.unique(_hash_of(points[:, :-1]) if n > 1 else np.zeros(len(points), np.uint64), return_inverse=True)
        columns = range(len(langs))
        total = np.stack([np.bincount(of, count[:, j], len(names)) for j in columns], 1)
        types = np.stack([np.bincount(of, count[:, j] > 0, len(names)) for j in columns], 1)
        ones, twos = (count == 1).sum(0), (count == 2).sum(0)
        discount = np.where(ones + 2 * twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5).clip(0.1, 0.95)
        gamma = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
        below = np.full(count.shape, 1 / (size + 1))
        if lower is not None:
            at, hit = _find(lower[0], _hash_of(points[:, 1:]))
            below[hit] = lower[1][at[hit]]
        p = np.maximum(count - discount, 0) / np.maximum(total[of], 1) + gamma[of] * below
        key = _hash_of(points)
        order = np.argsort(key)
        lower = (key[order], p[order])
        model.grams.append(lower[0])
        model.logp.append(np.log(np.maximum(lower[1], 1e-12)).astype(np.float32))
        if n > 1:
            model.contexts.append(names)
            model.backoff.append(np.log(np.maximum(gamma, 1e-12)).astype(np.float32))
    return model


_starts: dict[int, tuple[weakref.ref, np.uint64, np.ndarray]] = {}


def _buckets(sorted_keys: np.ndarray) -> tuple[np.uint64, np.ndarray]:
    """(shift, starts): where the keys of each leading part begin in a sorted array; about one key a part.

    Kept as long as the array: a worker loads the models anew for each task.
    """
    key = id(sorted_keys)
    known = _starts.get(key)
    if known is None or known[0]() is not sorted_keys:
        bits = max(1, int(len(sorted_keys)).bit_length() + 1)
        shift = np.uint64(64 - bits)
        starts = np.searchsorted(sorted_keys >> shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        known = _starts[key] = (weakref.ref(sorted_keys, lambda _: _starts.pop(key, None)), shift, starts)
    return known[1], known[2]


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted array, whether it holds the key) of each key."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    shift, starts = _buckets(sorted_keys)
    part = (keys >> shift).astype(np.int64)
    at, stop = starts[part], starts[part + 1]
    np.minimum(at, len(sorted_keys) - 1, out=at)
    hit = sorted_keys[at] == keys
    rest = np.flatnonzero(~hit & (at + 1 < stop))
    while len(rest):
        at[rest] += 1
        same = sorted_keys[at[rest]] == keys[rest]
        hit[rest[same]] = True
        rest = rest[~same & (at[rest] + 1 < stop[rest])]
    return at, hit


@dataclass
class Spread:
    """Models too large to broadcast: tables, and the code points at which each range of them begins."""

    langs: list[str]
    grams: list[DataFrame]  # by order: gram, p (by language)
    contexts: list[DataFrame]  # by length 1..ORDER-1: gram, p
    begins: list[int]
    floor: float
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None

    def parts(self) -> Iterator[tuple[Model, int, int]]:
        """Models of the ranges, with the ranges."""
        for lo, hi in zip(self.begins, [*self.begins[1:], 1 << 32], strict=True):
            model = Model(self.langs, floor=self.floor)
            for n, table in enumerate(self.grams, 1):
                keys, p = _sorted(table if n == 1 else table.where((_before_last(n) >= lo) & (_before_last(n) < hi)), n, len(self.langs))
                model.grams.append(keys)
                model.logp.append(p)
            for n, table in enumerate(self.contexts, 1):
                keys, p = _sorted(table.where((_code_point(n) >= lo) & (_code_point(n) < hi)), n, len(self.langs))
                model.contexts.append(keys)
                model.backoff.append(p)
            yield model, lo, hi


def _code_point(n: int) -> Column:
    return F.ascii(F.substring("gram", n, 1))


def _before_last(n: int) -> Column:
    return _code_point(n - 1)


def _points(grams: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)


def _sorted(table: DataFrame, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    rows = table.toArrow()
    keys = _hash_of(_points(rows["gram"].to_pylist(), n))
    p = rows["p"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    order = np.argsort(keys)
    return keys[order], np.log(np.maximum(p[order], 1e-12)).astype(np.float32)


def entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy a character by text and language, letters of each text)."""
    total, chars, letters = _sums(model, texts)
    return -total / np.maximum(chars, 1)[:, None], letters


def _sums(model: Model, texts: list[str | None], lo: int = 0, hi: int = 1 << 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-probability by text and language of the characters behind one in lo..hi, all characters, letters)."""
    points, first, letters = letter_streams(texts, ORDER - 1)
    order = len(model.grams)
    keys = _keys(points, order)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    own = _own(points, first)
    out = np.zeros((len(texts), len(model.langs)))
    own[1:] &= (points[:-1] >= lo) & (points[:-1] < hi)
    left, pending = np.flatnonzero(own), None
    for n in range(order, 0, -1):
        at, hit = _find(model.grams[n - 1], keys[n - 1][left])
        value = model.logp[n - 1][at[hit]]
        if pending is not None:
            value = value + pending[hit]
        if len(value):  # places go by text, so that a text's values are neighbours
            of = owner[left[hit]]
            cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            out[of[cut]] += np.add.reduceat(value, cut, axis=0, dtype=np.float64)
        miss = ~hit
        left = left[miss]
        pending = pending[miss] if pending is not None else np.zeros((len(left), len(model.langs)), np.float32)
        if n > 1 and len(left):
            at, known = _find(model.contexts[n - 2], keys[n - 2][left - 1])
            pending[known] += model.backoff[n - 2][at[known]]
    if len(left):
        for j in range(len(model.langs)):
            out[:, j] += np.bincount(owner[left], pending[:, j] + model.floor, len(texts))
    return out, np.diff(first) - (ORDER - 1), letters


def train(docs: DataFrame) -> Model | Spread:
    """Models from (doc_id, text, lang): all its rows with a text and a language are training texts."""
    known = docs.where("text is not null and lang is not null").select("text", "lang", (F.pmod(F.xxhash64("doc_id", "text"), F.lit(CALIBRATION)) == 0).alias("apart"))
    full = bounded(known).select("lang", "apart", "text").mapInArrow(tidy(_counts), "lang string, apart boolean, gram string, n long")
    full = written(full.groupBy("lang", "apart", "gram").agg(F.sum("n").alias("n")), "char-counts")
    langs = sorted(r[0] for r in full.select("lang").distinct().collect())
    if not langs:
        return Model([])
    # counts of all texts (c) and of those that aren't set apart (b), by language, in one table an order
    cols, rest = [f"c{i}" for i in range(len(langs))], [f"b{i}" for i in range(len(langs))]
    here = lambda x: F.when(F.col("lang") == x, F.col("n")).otherwise(0)
    sums = [F.sum(here(x)).alias(c) for c, x in zip(cols, langs, strict=True)] + [F.sum(F.when(F.col("apart"), 0).otherwise(here(x))).alias(b) for b, x in zip(rest, langs, strict=True)]
    tables = [written(full.groupBy("gram").agg(*sums), "char-grams")]
    for _ in range(ORDER - 1):
        # distinct predecessors: how many n-grams one character longer end in this one, by language
        wide = tables[0].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(*[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in cols + rest])
        tables.insert(0, written(wide, "char-grams"))
    if sum(t.count() for t in tables) * len(langs) > HELD:
        make = lambda names: _spread(tables, names, langs)
    else:
        counted = [_table(t, cols + rest, n) for n, t in enumerate(tables, 1)]
        make = lambda names: build([(points, count[:, [(cols + rest).index(c) for c in names]]) for points, count in counted], langs)
    mean, deviation = _calibrated(make(rest), known.where("apart"), langs)
    model = make(cols)
    model.mean, model.deviation = mean, deviation
    return model


def _table(wide: DataFrame, cols: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    rows = wide.toArrow()
    return _points(rows["gram"].to_pylist(), n), np.stack([rows[c].to_numpy().astype(np.float64) for c in cols], 1)


def _spread(tables: list[DataFrame], cols: list[str], langs: list[str]) -> Spread:
    """What ``build`` computes, as tables."""
    size = max(tables[0].count(), 1)
    grams, contexts = [], []
    for n, table in enumerate(tables, 1):
        seen = table.agg(*[F.count(F.when(F.col(c) == k, 1)).alias(f"{c}_{k}") for c in cols for k in (1, 2)]).first()
        off = [min(max(seen[f"{c}_1"] / (seen[f"{c}_1"] + 2 * seen[f"{c}_2"]), 0.1), 0.95) if seen[f"{c}_1"] + seen[f"{c}_2"] else 0.5 for c in cols]
        behind = F.substring("gram", 1, n - 1).alias("context")
        sums = [F.sum(c).alias(f"t_{c}") for c in cols]
        gamma = [F.when(F.sum(c) > 0, F.lit(d) * F.count(F.when(F.col(c) > 0, 1)) / F.sum(c)).otherwise(1.0) for c, d in zip(cols, off, strict=True)]
        of = written(table.groupBy(behind).agg(*sums, F.array(*gamma).alias("gamma")), "char-contexts")
        rows = table.withColumn("context", behind).join(of, "context")
        below = [F.lit(1 / (size + 1))] * len(cols)
        if grams:
            rows = rows.withColumn("end", F.expr("substring(gram, 2)")).join(grams[-1].select(F.col("gram").alias("end"), F.col("p").alias("below")), "end")
            below = [F.get("below", F.lit(j)) for j in range(len(cols))]
        p = [F.greatest(F.col(c) - d, F.lit(0.0)) / F.greatest(F.col(f"t_{c}"), F.lit(1)) + F.get("gamma", F.lit(j)) * below[j] for j, (c, d) in enumerate(zip(cols, off, strict=True))]
        grams.append(written(rows.select("gram", F.array(*p).alias("p")), "char-p"))
        if n > 1:
            contexts.append(of.select(F.col("context").alias("gram"), F.col("gamma").alias("p")))
    cells = None
    for n, table in enumerate(grams[1:], 2):
        own = table.groupBy(_before_last(n).alias("at")).count()
        cells = own if cells is None else cells.unionByName(own)
    begins, held = [0], 0
    for at, n in sorted(map(tuple, cells.groupBy("at").agg(F.sum("count")).collect())):
        if held and (held + n) * len(cols) > HELD:
            begins.append(at)
            held = 0
        held += n
    return Spread(langs, grams, contexts, begins, float(np.log(1 / (size + 1))) - 3)


def _with_sums(docs: DataFrame, model: Model | Spread, text: str) -> DataFrame:
    """``docs`` with __sums (log-probability by language), __chars and __letters; a round for each range of the models."""
    kinds = [T.StructField("__sums", T.ArrayType(T.DoubleType())), T.StructField("__chars", T.LongType()), T.StructField("__letters", T.LongType())]
    schema = T.StructType([*docs.schema.fields, *kinds])
    rounds = [(model, 0, 1 << 32)] if isinstance(model, Model) else model.parts()
    for part, lo, hi in rounds:
        held = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], held=held, lo=lo, hi=hi) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, width = batch.column(text).to_pylist(), len(held.value.langs)
                total, chars, letters = np.zeros((len(texts), width)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for a, b in text_blocks(texts):
                    total[a:b], chars[a:b], letters[a:b] = _sums(held.value, texts[a:b], lo, hi)
                if "__sums" in batch.schema.names:
                    total += batch.column("__sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    batch = batch.select(batch.schema.names[:-3])
                sums = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * width, pa.int32()), pa.array(total.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, sums, pa.array(chars), pa.array(letters)], names=schema.names)

        docs = bounded(docs).mapInArrow(tidy(run), schema)
        if isinstance(model, Spread):
            docs = written(docs, "char-sums")
            held.destroy()
    return docs


def _calibrated(model: Model | Spread, apart: DataFrame, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation by language of the entropies of all texts apart, by models of the others."""
    mean, deviation = np.full(len(langs), np.inf), np.ones(len(langs))
    own = F.get("__sums", F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1)
    rows = _with_sums(apart.select("lang", "text"), model, "text").where("__letters >= 20")
    rows = rows.select("lang", (-own / F.greatest("__chars", F.lit(1))).alias("e"))
    for lang, n, m, d in rows.groupBy("lang").agg(F.count("e"), F.avg("e"), F.stddev_pop("e")).collect():
        if n >= LEAST:
            mean[langs.index(lang)], deviation[langs.index(lang)] = m, max(d, 0.02)
    return mean, deviation


def identify(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, accepted) of each text; score is the posterior with each text's evidence capped at 40 characters."""
    lang, score, ok = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
    if not model.langs:
        return [UNKNOWN] * len(texts), score, ok
    for lo, hi in text_blocks(texts):
        own, score[lo:hi], ok[lo:hi] = _judged(model, *entropies(model, texts[lo:hi]))
        lang += own
    return lang, score, ok


def _judged(model: Model | Spread, e: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    best = e.argmin(1)
    p = np.exp(-(e - e.min(1, keepdims=True)) * np.minimum(letters, 40)[:, None])
    ok = (letters > 0) & (e[np.arange(len(e)), best] <= (model.mean + TOLERANCE * model.deviation)[best])
    return [model.langs[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters > 0, 1 / p.sum(1), 0), ok


def predict(docs: DataFrame, model: Model | Spread, text: str = "text", reject: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score and accepted; with ``reject`` a text that isn't accepted is ``und``."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    docs = docs.drop("lang_pred", "score", "accepted")
    schema = T.StructType([*docs.schema.fields, *added])
    whole = isinstance(model, Model)
    if not whole:
        docs = _with_sums(docs, model, text)
        model = Model(model.langs, mean=model.mean, deviation=model.deviation)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if whole:
                lang, score, ok = identify(held.value, batch.column(text).to_pylist())
            else:
                total = batch.column("__sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(held.value.langs))
                chars, letters = batch.column("__chars").to_numpy(), batch.column("__letters").to_numpy()
                lang, score, ok = _judged(held.value, -total / np.maximum(chars, 1)[:, None], letters)
                batch = batch.select(batch.schema.names[:-3])
            if reject:
                lang = [x if y else UNKNOWN for x, y in zip(lang, ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(ok)], names=schema.names)

    return bounded(docs).mapInArrow(tidy(run), schema)
