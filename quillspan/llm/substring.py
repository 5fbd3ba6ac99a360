"""Removal of repeated passages: Rabin-Karp hashes of all windows of ``WIDTH`` words, counted in Spark.

Every window hashes to 64 bits; a second rolling hash, of independent hashes of the words,
assigns it to one of the buckets, whose number follows the size of the input, so that windows are
told apart by 64 + log2(buckets) bits. Words hash to sums of random values of their bytes by place,
so that equality is as unlikely for texts of any structure: over 100 TB, 1.7e13 windows and 87
bits, one false match is expected; below a terabyte, less than 1e-5. A batch of documents first settles its own repeats, so that a passage however
common leaves a batch once; what is left travels as packed arrays, a row a batch and bucket.
In its bucket a window is flagged if a smaller doc_id has it too. The flags return to their
documents, packed by groups of documents of about ``BUCKET`` / ``GROUPS`` bytes, where
overlapping windows merge into maximal intervals of words to remove.

Defined cases: null text has no words; texts of fewer than ``WIDTH`` words are kept whole; a
null doc_id neither removes anything nor loses anything; rows of one doc_id are judged each
against smaller ids, so that equal rows stay equal; windows are judged on the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import blocks, mix, windows, words
from .workers import BATCH, bounded, tidy, tidy_group, tidy_pair

WIDTH = 13
#: Bytes of text for each bucket.
BUCKET = 8 << 20
#: Groups of documents for each bucket.
GROUPS = 4
#: Bytes of text that settle their own repeats together; bounds a worker's memory.
PART = BATCH
_PACKED = "key long, settled boolean, docs binary, counts binary, hashes binary"
_FLAGS = "__group long, docs binary, counts binary, hashes binary"


def _pack(doc: np.ndarray, value: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Hashes in order of their documents, with each document's id and number of hashes."""
    new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return doc[new].tobytes(), np.diff(np.append(new, len(doc))).astype(np.uint32).tobytes(), value.tobytes()


def _unpack(docs: bytes, counts: bytes, hashes: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.frombuffer(docs, np.int64), np.frombuffer(counts, np.uint32)), np.frombuffer(hashes, np.uint64)


def _mapper(width: int, buckets: int):
    def settle(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = batch["doc_id"].to_numpy().astype(np.int64)
        value, place, doc = [], [], []
        for b in blocks(batch["text"]):
            w = words(b, twice=True)
            h, at = windows(w, width)
            second, _ = windows(w, width, seed=1)
            value.append(h)
            place.append((second % np.uint64(buckets)).astype(np.int32))
            doc.append(ids[b.lo : b.hi][w.doc[at]])
        if not value or not sum(map(len, value)):
            return
        value, place, doc = map(np.concatenate, (value, place, doc))
        # one sort brings equal windows together, the smallest doc_id first
        order = np.argsort(value, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = (value[order[1:]] != value[order[:-1]]) | (place[order[1:]] != place[order[:-1]])
        smallest = doc[order[new]][np.cumsum(new) - 1]
        settled = np.sort(order[doc[order] > smallest])
        rows = []
        for part in np.array_split(settled, -(-len(settled) // 200_000) or 1):
            if len(part):
                rows.append((int(doc[part[0]]) % buckets, True, *_pack(doc[part], value[part])))
        kept = np.sort(order[new])
        del order, new, smallest
        kept = kept[np.argsort(place[kept], kind="stable")]
        cut = np.searchsorted(place[kept], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(cut)):
            own = kept[cut[k] : cut[k + 1]]
            rows.append((int(k), False, *_pack(doc[own], value[own])))
        kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
        for i in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64], strict=True), kinds, strict=True)], names=["key", "settled", "docs", "counts", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            whole = whole.filter(pc.is_valid(whole["doc_id"])).sort_by("doc_id")
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole["text"]), 0).to_numpy().astype(np.int64))
            lo = 0
            while lo < len(whole):  # documents in order of their ids, so many that they hold about PART bytes
                start = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, start + PART, "right")))
                yield from settle(whole.slice(lo, hi - lo))
                lo = hi

    return run


def _group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _judge(groups: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one bucket: by group of documents, the hashes of the windows that a smaller doc_id has too."""
        doc, value = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        flagged, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for settled, d, c, h in zip(*(table[n].to_pylist() for n in ("settled", "docs", "counts", "hashes")), strict=True):
            a, b = _unpack(d, c, h)
            (flagged if settled else doc).append(a)
            (hashes if settled else value).append(b)
        doc, value = np.concatenate(doc), np.concatenate(value)
        if len(value):
            order = np.argsort(value)
            doc, value = doc[order], value[order]
            new = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            late = doc > np.repeat(np.minimum.reduceat(doc, new), np.diff(np.append(new, len(doc))))
            flagged.append(doc[late])
            hashes.append(value[late])
        doc, value = np.concatenate(flagged), np.concatenate(hashes)
        group = _group_of(doc, groups)
        order = np.lexsort((doc, group))
        doc, value, group = doc[order], value[order], group[order]
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        rows = [(int(group[a]), *_pack(doc[a:b], value[a:b])) for a, b in zip(edge, np.append(edge[1:], len(doc)), strict=True)] if len(edge) else []
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], names=["__group", "docs", "counts", "hashes"])

    return run


def _squeeze(groups: int):
    """Texts compressed, and the group that a document's flags go to; a null doc_id goes by its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raw = [None if t is None else t.encode() for t in batch.column("text").to_pylist()]
            text = pa.array([None if t is None else pack.compress(t) for t in raw], pa.binary())
            ids = [zlib.crc32(t or b"") if i is None else i for i, t in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), raw, strict=True)]
            out = batch.set_column(batch.schema.get_field_index("text"), "text", text)
            yield out.append_column("__group", pa.array(_group_of(np.array(ids, np.int64), groups)))

    return run


def _remover(width: int):
    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        own, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for d, c, h in zip(*(flags[n].to_pylist() for n in ("docs", "counts", "hashes")), strict=True):
            a, b = _unpack(d, c, h)
            own.append(a)
            hashes.append(b)
        own, hashes = np.concatenate(own), np.concatenate(hashes)
        order = np.argsort(own, kind="stable")
        own, hashes = own[order], hashes[order]
        raw = [None if t is None else unpack.decompress(t) for t in docs["text"].to_pylist()]
        kept, total, spans = [], [], []
        for i, t in zip(docs["doc_id"].cast(pa.int64()).to_pylist(), raw, strict=True):
            parts = (t or b"").split()
            total.append(len(parts))
            found: list[dict[str, int]] = []
            lo, hi = (0, 0) if i is None else np.searchsorted(own, [i, i + 1])
            if hi > lo and len(parts) >= width:
                w = words(next(iter(blocks(pa.array([t.decode()])))))
                h, at = windows(w, width)
                hit = at[np.isin(h, hashes[lo:hi])]
                gone = np.zeros(len(parts) + 1, np.int64)
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + width, -1)
                gone = np.cumsum(gone)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                found = [{"begin": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                parts = [p for p, g in zip(parts, gone.tolist(), strict=True) if not g]
            spans.append(found)
            kept.append(b" ".join(parts).decode())
        text = pa.array([None if t is None else t.decode() for t in raw], pa.string())
        names = [n for n in docs.schema.names if n != "__group"]
        cols = [text if n == "text" else docs[n] for n in names]
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        return pa.Table.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], names=[*names, "n_words", "removed", "kept"])

    return run


def removals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with n_words, removed (intervals of words) and kept (the rest, joined by spaces)."""
    docs = docs.drop("n_words", "removed", "kept")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-int(size) // BUCKET))
    packed = bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_mapper(width, buckets)), _PACKED)
    flags = packed.groupBy("key").applyInArrow(tidy_group(_judge(GROUPS * buckets)), _FLAGS)
    fields = [T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in docs.schema.fields]
    small = docs.mapInArrow(tidy(_squeeze(GROUPS * buckets)), T.StructType([*fields, T.StructField("__group", T.LongType())]))
    added = T.StructType.fromDDL("n_words long, removed array<struct<begin: int, end: int>>, kept string")
    both = small.groupBy("__group").cogroup(flags.groupBy("__group"))
    return both.applyInArrow(tidy_pair(_remover(width)), T.StructType([*docs.schema.fields, *added.fields]))


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; n_chars, if there, follows the new text."""
    out = removals(docs, width).withColumn("text", F.when(F.size("removed") > 0, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
