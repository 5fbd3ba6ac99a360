"""Interleaved document sequences: ordered text and media references from HTML, resolved by digest.

``interleaved`` parses each page into an array of parts in reading order: texts, and media
references with the digest in their address (``sha256:<hex>``), the alternative text and the
caption of the figure they stand in. ``stored`` packs payloads losslessly as 8-bit grey PNG
images, 64 samples a row, into a written table keyed by the SHA-256 of the stored bytes.
``resolved`` joins references with what reading the store back gave; positions and captions
stay with their references, whether or not a payload was found, and texts keep their places.

A payload that many documents share is stored once a batch and described once a digest before
the join, and the payload bytes themselves are never shuffled.

Defined cases: null HTML has no parts; broken markup is read as far as it goes, and a caption that
nothing closes ends with its figure; a reference
without a digest or without a stored payload stays, unresolved; a null text is an empty
payload, padded to one row; equal texts give equal bytes; other columns stay.
"""

from __future__ import annotations

import contextlib
import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written
from .workers import bounded, tidy

ROW = 64
PART = "struct<position: int, kind: string, text: string, address: string, digest: string, caption: string>"
_PART = pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "address", "digest", "caption"))])
_BLOCK = set("address article aside blockquote body br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_SKIP = {"script", "style", "template", "noscript"}
_MEDIA = {"img": "image", "audio": "audio", "video": "video", "embed": "document", "object": "document", "iframe": "document"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.words: list[str] = []
        self.skip = 0
        self.figures: list[list[int]] = []
        self.captions: list[str | None] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words.clear()
        if text:
            self.put("text", text, None)

    def put(self, kind: str, text: str | None, address: str | None) -> None:
        digest = address[7:].lower() if address and address.lower().startswith("sha256:") else None
        self.parts.append({"position": len(self.parts), "kind": kind, "text": text, "address": address, "digest": digest, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SKIP:
            self.skip += 1
        elif tag in _MEDIA:
            self.flush()
            own = dict(attrs)
            if self.figures:
                self.figures[-1].append(len(self.parts))
            self.put(_MEDIA[tag], own.get("alt") or own.get("title"), own.get("src") or own.get("data"))
        elif tag in _BLOCK:
            if self.caption is None:
                self.flush()
            if tag == "figure":
                self.figures.append([])
                self.captions.append(None)
            elif tag == "figcaption" and self.figures:
                self._close_caption()
                self.caption = []

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            self._close_caption()
        elif tag in _BLOCK:
            if tag == "figure":  # a caption ends with its figure at the latest
                self._close_caption()
            if self.caption is None:
                self.flush()
            if tag == "figure" and self.figures:
                self._close_figure()

    def _close_caption(self) -> None:
        if self.caption is not None:
            self.captions[-1] = " ".join("".join(self.caption).split())
            self.caption = None

    def _close_figure(self) -> None:
        text = self.captions.pop()
        for i in self.figures.pop():
            self.parts[i]["caption"] = text

    def finish(self) -> list[dict]:
        with contextlib.suppress(AssertionError):  # what the library makes of some broken declarations
            self.close()
        self._close_caption()
        self.flush()
        while self.figures:
            self._close_figure()
        return self.parts

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.words if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    reader = _Reader()
    with contextlib.suppress(AssertionError):
        reader.feed(html or "")
    return reader.finish()


def interleaved(pages: DataFrame, html: str = "html", out: str = "parts") -> DataFrame:
    """``pages`` with their parts in reading order instead of ``html``."""
    rest = pages.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pa.array([parse(h) for h in batch.column(html).to_pylist()], pa.list_(_PART))
            names = [n for n in batch.schema.names if n != html]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), parts], names=[*names, out])

    fields = [f for f in rest.schema.fields if f.name != html]
    return bounded(rest).mapInArrow(tidy(run), T.StructType([*fields, T.StructField(out, T.ArrayType(T.StructType.fromDDL(PART[7:-1])))]))


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % ROW if raw else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey image, ``ROW`` samples a row, each row unfiltered."""
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """The samples of an image of ``encode_png``; a damaged one raises ValueError."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, width = 8, [], 0
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + part):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width = struct.unpack(">I", part[:4])[0]
        elif kind == b"IDAT":
            body.append(part)
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean, deviation and shares of 8 bands of sample values."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x >> 5, minlength=8) / len(x)
    return f"gray8 {ROW}x{len(x) // ROW} mean={x.mean():.3f} std={x.std():.3f} bands=" + ",".join(f"{s:.3f}" for s in share)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, digest, media, seen = [], [], [], {}
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode()
            size.append(len(raw))
            key = hashlib.sha256(raw).digest()
            if key in seen:
                digest.append(seen[key])
                media.append(None)
            else:
                data = encode_png(padded(text))
                seen[key] = hashlib.sha256(data).hexdigest()
                digest.append(seen[key])
                media.append(data)
        for i in range(0, len(size), 500):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 500), pa.array(size[i : i + 500], pa.int64()), pa.array(digest[i : i + 500], pa.string()), pa.array(media[i : i + 500], pa.binary())], names=["doc_id", "n_bytes", "digest", "media"])


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digest, media) as a written table; of texts that repeat in a batch, one has the bytes."""
    return written(bounded(docs).select("doc_id", "text").mapInArrow(tidy(_encode), "doc_id long, n_bytes long, digest string, media binary"), "media")


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for digest, data in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
            payload = decode_png(data)
            rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=names)


def described(store: DataFrame) -> DataFrame:
    """One row for each digest of ``store`` (digest, media), from the stored bytes read back."""
    read = store.where("media is not null").select("digest", "media").mapInArrow(tidy(_describe), "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return written(read.dropDuplicates(["digest"]), "media-features")


def resolved(pages: DataFrame, described: DataFrame, key: str) -> DataFrame:
    """A row for each part of ``pages`` (key, parts): texts as they are, references with what is known of their payload.

    A page's parts keep their positions, so that the whole sequence can be put in order again.
    """
    parts = pages.select(key, F.explode("parts").alias("part")).select(key, "part.position", "part.kind", "part.text", F.col("part.address").alias("address"), F.col("part.digest").alias("digest"), F.col("part.caption").alias("caption"))
    return parts.join(described, "digest", "left")
