"""Exact token counts in one map-side pass, with two tiers of known pre-tokens.

A text is normalised and cut into pre-tokens as the vocabulary's own pipeline does; the count
of a text is the sum of its pre-tokens' counts. Tier one is a compact broadcast table of
frequent pre-tokens and their counts (at most ``FREQUENT``, found in ``SAMPLE`` documents of
each of ``PARTS`` partitions; it only saves time and never changes a count). Tier two encodes what it lacks with the library
and keeps the answers in a cache of each worker, bounded by ``CACHE`` entries. Nothing is
shuffled but the sample's partial counts.

Texts whose cutting could depend on the Unicode version (unassigned code points), on context
(capital sigma) or on special strings go to the library whole.

Defined cases: null counts as empty, with 0 bytes and 0 tokens; repeated rows are counted
each; other columns stay.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workers import bounded, tidy

FREQUENT = 1 << 16
PARTS, SAMPLE = 32, 100
CACHE = 1 << 20
#: Longer pre-tokens are encoded each time and not kept.
LONGEST = 64


class PieceCounter:
    """A vocabulary file's content, ready to count; ``known`` is the first tier."""

    def __init__(self, content: str, known: dict[str, int] | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.loads(content)
        self.whole = Tokenizer.from_str(content)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.cut = regex.compile(steps[0]["pattern"]["Regex"])
        # pre-tokens hold no white space, so many go to the library as one text, parted by spaces
        parted = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
        bare = spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [parted, steps[1]]}}
        self.piece = Tokenizer.from_str(json.dumps(bare))
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.unsure = _unassigned()
        self.known = known or {}
        self.cache: dict[str, int] = {}

    def plain(self, text: str) -> bool:
        if any(s in text for s in self.specials):
            return False
        return text.isascii() or not self.unsure[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any()

    def pieces(self, text: str) -> list[str]:
        return self.cut.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())

    def lengths(self, pieces: list[str]) -> list[int]:
        """Each piece's number of tokens."""
        out: list[int] = []
        for i in range(0, len(pieces), 1000):
            part = pieces[i : i + 1000]
            of = self.piece.encode(" ".join(part), add_special_tokens=False).word_ids
            out += np.bincount(np.array(of, np.int64), minlength=len(part)).tolist()
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.plain(text):
            return len(self.whole.encode(text, add_special_tokens=False).ids)
        pieces = self.pieces(text)
        found = list(map(self.known.get, pieces))
        total = 0
        if None in found:
            late = [p for p, n in zip(pieces, found, strict=True) if n is None]
            total = sum(n for n in found if n is not None)
            again = list(map(self.cache.get, late))
            new = list({p for p, n in zip(late, again, strict=True) if n is None})
            fresh = dict(zip(new, self.lengths(new), strict=True)) if new else {}
            total += sum(fresh[p] if n is None else n for p, n in zip(late, again, strict=True))
            if len(self.cache) + len(fresh) > CACHE:
                self.cache.clear()
            self.cache.update((p, n) for p, n in fresh.items() if len(p) <= LONGEST)
            return total
        return sum(found)


_unsure: list[np.ndarray] = []


def _unassigned() -> np.ndarray:
    """For each code point, whether its treatment may differ: none in this Python's Unicode, or capital sigma."""
    if not _unsure:
        _unsure.append(np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)]))
        _unsure[0][ord("\u03a3")] = True
    return _unsure[0]


_workers: dict[int, PieceCounter] = {}


def _worker(key: int, content: str, names: str = "", counts: bytes = b"") -> PieceCounter:
    """One counter for each worker process and broadcast, so that its cache outlives a task."""
    if key not in _workers:
        _workers.clear()
        _workers[key] = PieceCounter(content, dict(zip(names.split(" "), counts, strict=True)) if counts else {})
    return _workers[key]


def _frequent(docs: DataFrame, content: str, text: str) -> tuple[str, bytes]:
    held = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() >= PARTS:
            return
        counter, seen, left = PieceCounter(held.value), Counter(), SAMPLE
        for batch in batches:
            for t in batch.column(0).slice(0, left).to_pylist():
                left -= 1
                if t and counter.plain(t):
                    seen.update(p for p in counter.pieces(t) if len(p) <= LONGEST)
            if not left:
                break
        best = seen.most_common(FREQUENT)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["piece", "n"])

    best = bounded(docs).select(text).mapInArrow(tidy(run), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(FREQUENT)
    names = [r[0] for r in best.collect()]
    counter = PieceCounter(content)
    sizes = counter.lengths(names) if names else []
    short = [(p, n) for p, n in zip(names, sizes, strict=True) if n < 256]
    return " ".join(p for p, _ in short), bytes(n for _, n in short)


def counted(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes (UTF-8) and n_tokens; ``vocabulary`` is the path of a tokenizers file."""
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    docs = docs.drop("n_bytes", "n_tokens")
    held = docs.sparkSession.sparkContext.broadcast((content, *_frequent(docs, content, text)))
    key = held._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _worker(key, *held.value)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            size = pa.array([len((t or "").encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, size, pa.array([counter.count(t) for t in texts], pa.int64())], names=[*batch.schema.names, "n_bytes", "n_tokens"])

    added: list[Any] = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return bounded(docs).mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *added]))
