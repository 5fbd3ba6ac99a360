"""Book files: PalmDB containers, position chunks and EPUB archives, decoded in the workers.

Whole files come in through ``binaryFile`` and leave as rows; what can't be decoded leaves as a
row with its reason.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.markup import plain_text
from quillspan.functions.text import normal_map, normalized


class Unreadable(Exception):
    """Why a file has no text for us."""


def lz77(data: bytes) -> bytes:
    """PalmDOC's compression undone."""
    out, stream = bytearray(), iter(data)
    for code in stream:
        if 1 <= code <= 8:
            out.extend(b for _, b in zip(range(code), stream, strict=False))
        elif code < 0x80:
            out.append(code)
        elif code >= 0xC0:
            out += bytes((0x20, code & 0x7F))
        else:
            pair = ((code & 0x3F) << 8) | next(stream, 0)
            back, count = pair >> 3, (pair & 7) + 3
            if not 0 < back <= len(out):
                raise Unreadable("back-reference before the start")
            for _ in range(count):
                out.append(out[len(out) - back])
    return bytes(out)


def backward_number(data: bytes) -> int:
    """The variable-length number at the end of ``data``: seven bits a byte, at most four bytes."""
    value = 0
    for shift, byte in enumerate(reversed(data[-4:])):
        value |= (byte & 0x7F) << (7 * shift)
        if byte & 0x80:
            break
    return value


def untrailed(record: bytes, flags: int) -> bytes:
    """A text record without the entries that ``flags`` say stand behind it."""
    for _ in range((flags >> 1).bit_count()):
        record = record[: max(0, len(record) - backward_number(record))]
    if flags & 1 and record:
        record = record[: len(record) - 1 - (record[-1] & 3)]
    return record


def palm_text(data: bytes) -> tuple[bytes, str]:
    """(markup bytes, encoding) of a PalmDB book."""
    if data[60:68] != b"BOOKMOBI" or len(data) < 78:
        raise Unreadable("not a PalmDB book")
    number = lambda raw, at, size: int.from_bytes(raw[at : at + size], "big")
    starts = [number(data, 78 + 8 * i, 4) for i in range(number(data, 76, 2))] + [len(data)]
    records = [data[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    if not records:
        raise Unreadable("no records")
    head = records[0]
    compression, length, count, locked = number(head, 0, 2), number(head, 4, 4), number(head, 8, 2), number(head, 12, 2)
    if locked:
        raise Unreadable(f"encrypted ({locked})")
    if compression not in (1, 2):
        raise Unreadable("HUFF/CDIC compression" if compression == 17480 else f"unknown compression {compression}")
    if head[16:20] != b"MOBI":
        raise Unreadable("no MOBI header")
    encoding = {65001: "utf-8", 1252: "cp1252"}.get(number(head, 28, 4))
    if encoding is None:
        raise Unreadable(f"unknown encoding {number(head, 28, 4)}")
    flags = number(head, 0xF2, 2) if number(head, 20, 4) >= 0xE4 and len(head) >= 0xF4 else 0
    parts = (untrailed(r, flags) for r in records[1 : count + 1])
    raw = b"".join(map(lz77, parts) if compression == 2 else parts)
    if len(raw) < length:
        raise Unreadable(f"{len(raw)} bytes of text, {length} declared")
    return raw[:length], encoding


def read_palm(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, raw, encoding, text_length, text, first, last, norm, norm_map, reason): a row a file."""
    schema = "path string, raw binary, encoding string, text_length int, text string, first array<int>, last array<int>, reason string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    raw, encoding = palm_text(bytes(content))
                    rows.append((name, raw, encoding, len(raw), *plain_text(raw, encoding), None))
                except Unreadable as e:
                    rows.append((name, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "raw", "encoding", "text_length", "text", "first", "last", "reason"]).astype({"text_length": "Int32"})

    books = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)
    return books.withColumn("norm", normalized(F.col("text"))).withColumn("norm_map", normal_map(F.col("text")))


def read_chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, text_length, text, positions, norm, norm_map) from JSON files {max_position, chunks: [[pid, text]]}."""
    from quillspan.operators.spans import chunk_positions, chunk_text

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "max_position bigint, chunks array<array<string>>").alias("d"))
    chunks = F.transform("d.chunks", lambda c: F.struct(F.get(c, F.lit(0)).cast("int").alias("pid"), F.get(c, F.lit(1)).alias("text")))
    rows = whole.select("path", F.col("d.max_position").alias("text_length"), chunks.alias("chunks"))
    rows = rows.select("path", "text_length", chunk_text(F.col("chunks")).alias("text"), chunk_positions(F.col("chunks")).alias("positions"))
    return rows.withColumn("norm", normalized(F.col("text"))).withColumn("norm_map", normal_map(F.col("text")))


def containers(files: DataFrame) -> DataFrame:
    """(folder, path): in each folder of ``files`` (path, length, content), the largest that begins with CONT."""
    known = files.where(F.substring("content", 1, 4) == F.lit(b"CONT")).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "path", "length")
    # of equal lengths the path that sorts first
    best = F.min_by("path", F.struct(-F.col("length"), "path"))
    return known.groupBy("folder").agg(best.alias("path"))


_SILENT = {"head", "script", "style", "title"}


class _Lenient(HTMLParser):
    """Markup that isn't well-formed XML, as a tree all the same."""

    _VOID = set("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = ElementTree.Element("root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        el = ElementTree.SubElement(self.open[-1], tag, {k: v or "" for k, v in attrs})
        if tag not in self._VOID:
            self.open.append(el)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ElementTree.SubElement(self.open[-1], tag, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        at = self.open[-1]
        if len(at):
            at[-1].tail = (at[-1].tail or "") + data
        else:
            at.text = (at.text or "") + data


def _name(el: ElementTree.Element) -> str:
    return str(el.tag).rpartition("}")[2]


def _tree(data: bytes) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError:
        lenient = _Lenient()
        lenient.feed(data.decode("utf-8", "replace"))
        found = next((e for e in lenient.root if _name(e) == "html"), None)
        if found is None:
            raise Unreadable("no markup") from None
        return found


def text_runs(data: bytes) -> list[tuple[list[tuple[int, str | None]], str, int]]:
    """(steps, text, start): the text runs of a document's body, in reading order.

    Children count in steps: elements even, the runs between them odd.
    """
    runs: list[tuple[list[tuple[int, str | None]], str, int]] = []
    total = 0

    def add(steps: list, text: str | None) -> None:
        nonlocal total
        if text:
            runs.append((steps, text, total))
            total += len(text)

    # a stack instead of recursion: markup may nest deeply
    todo: list[tuple] = []
    for i, child in enumerate(_tree(data), 1):
        if _name(child) == "body":
            todo.append(("element", child, [(2 * i, child.get("id"))]))
            break
    while todo:
        kind, what, steps = todo.pop()
        if kind == "run":
            add(steps, what)
            continue
        later = [("run", what.text, [*steps, (1, None)])]
        for i, child in enumerate(what, 1):
            if _name(child) not in _SILENT:
                later.append(("element", child, [*steps, (2 * i, child.get("id"))]))
            later.append(("run", child.tail, [*steps, (2 * i + 1, None)]))
        todo.extend(reversed(later))
    return runs


def spine(book: zipfile.ZipFile) -> list[tuple[int, str, str, str]]:
    """(place in the spine, idref, step, file name) of an EPUB's documents in reading order."""
    container = ElementTree.fromstring(book.read("META-INF/container.xml"))
    package_name = next(e.get("full-path") for e in container.iter() if _name(e) == "rootfile")
    package = ElementTree.fromstring(book.read(package_name))
    parts = {_name(e): (2 * i, e) for i, e in enumerate(package, 1)}
    if "spine" not in parts or "manifest" not in parts:
        raise Unreadable("no spine or manifest")
    hrefs = {e.get("id"): e.get("href") for e in parts["manifest"][1]}
    at, order = parts["spine"]
    folder = posixpath.dirname(package_name)
    listed = ((i, ref.get("idref")) for i, ref in enumerate(order))
    return [(i, ref, f"/{at}/{2 * (i + 1)}[{ref}]", posixpath.normpath(posixpath.join(folder, hrefs[ref]))) for i, ref in listed if hrefs.get(ref)]


def read_epub(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, spine, idref, step, runs, text, norm, norm_map, reason): a row a document of each EPUB file."""
    schema = "path string, spine int, idref string, step string, runs array<struct<steps: array<struct<index: int, assertion: string>>, text: string, doc_start: int>>, reason string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    book = zipfile.ZipFile(io.BytesIO(bytes(content)))
                    docs = spine(book)
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a file, others go on
                    rows.append((name, None, None, None, None, str(e) or type(e).__name__))
                    continue
                for i, ref, step, file in docs:
                    try:
                        found = [{"steps": [{"index": a, "assertion": b} for a, b in s], "text": t, "doc_start": d} for s, t, d in text_runs(book.read(file))]
                        rows.append((name, i, ref, step, found, None))
                    except (Unreadable, KeyError, ElementTree.ParseError) as e:
                        rows.append((name, i, ref, step, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "spine", "idref", "step", "runs", "reason"]).astype({"spine": "Int32"})

    docs = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)
    docs = docs.withColumn("text", F.array_join(F.transform("runs", lambda r: r["text"]), ""))
    return docs.withColumn("norm", normalized(F.col("text"))).withColumn("norm_map", normal_map(F.col("text")))
