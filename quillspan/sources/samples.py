"""Small files in the formats that the sources read, made of given texts; for tests and registered queries."""

from __future__ import annotations

import html
import io
import json
import sqlite3
import struct
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame


def packed(data: bytes) -> bytes:
    """PalmDOC's compression, by its three means: literals, a space with its letter, and references back."""
    out, at = bytearray(), 0
    last: dict[bytes, int] = {}
    while at < len(data):
        piece = data[at : at + 3]
        back = at - last[piece] if len(piece) == 3 and piece in last else 0
        if len(piece) == 3:
            last[piece] = at
        if 0 < back < 2048:
            size = 3
            while size < 10 and at + size < len(data) and data[at + size] == data[at + size - back]:
                size += 1
            out += struct.pack(">H", 0x8000 | back << 3 | size - 3)
            at += size
        elif data[at] == 0x20 and at + 1 < len(data) and 0x40 <= data[at + 1] < 0x80:
            out.append(data[at + 1] | 0x80)
            at += 2
        elif data[at] == 0 or 9 <= data[at] < 0x80:
            out.append(data[at])
            at += 1
        else:
            run = data[at : at + 1]
            out += bytes([len(run)]) + run
            at += 1
    return bytes(out)


def palm(markup: bytes, compression: int = 2, encoding: int = 65001, trailing: bool = False, locked: int = 0, size: int = 4096) -> bytes:
    """A PalmDB book of ``markup``; with ``trailing`` each record has entries behind its text."""
    parts = [markup[i : i + size] for i in range(0, len(markup), size)]
    records = [packed(p) if compression == 2 else p for p in parts]
    flags = 0
    if trailing:  # one entry of three bytes whose last gives its size, and a multibyte entry of one byte
        flags, records = 0b11, [r + b"\0" + b"xy\x83" for r in records]
    head = bytearray(0xF8)
    struct.pack_into(">HHIHHH", head, 0, compression, 0, len(markup), len(parts), size, locked)
    head[16:20] = b"MOBI"
    struct.pack_into(">II", head, 20, 0xE8, 2)
    struct.pack_into(">I", head, 28, encoding)
    struct.pack_into(">H", head, 0xF2, flags)
    records = [bytes(head), *records]
    out = bytearray(78)
    out[60:68] = b"BOOKMOBI"
    struct.pack_into(">H", out, 76, len(records))
    at = 78 + 8 * len(records)
    for r in records:
        out += struct.pack(">II", at, 0)
        at += len(r)
    return bytes(out) + b"".join(records)


def epub(documents: Iterable[tuple[str, str]]) -> bytes:
    """An EPUB of (idref, XHTML) in reading order."""
    documents, out = list(documents), io.BytesIO()
    items = "".join(f'<item id="{i}" href="{i}.xhtml"/>' for i, _ in documents)
    refs = "".join(f'<itemref idref="{i}"/>' for i, _ in documents)
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="in/book.opf"/></rootfiles></container>')
        book.writestr("in/book.opf", f'<package xmlns="urn:o"><metadata/><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for i, text in documents:
            book.writestr(f"in/{i}.xhtml", text)
    return out.getvalue()


def page(paragraphs: Iterable[str]) -> str:
    """XHTML whose body has the paragraphs and nothing else."""
    return "<html><head><title>t</title></head><body>" + "".join(f"<p>{html.escape(p, False)}</p>" for p in paragraphs) + "</body></html>"


def chunks(pieces: Iterable[tuple[int, str]]) -> str:
    """The JSON of position chunks."""
    pieces = [[p, t] for p, t in pieces]
    return json.dumps({"max_position": max((p + len(t) - 1 for p, t in pieces), default=0), "chunks": pieces})


def store(path: str, tables: dict[str, tuple[str, Iterable[tuple]]]) -> str:
    """A SQLite file of tables given as (columns with types, rows)."""
    with sqlite3.connect(path) as con:
        for name, (columns, rows) in tables.items():
            con.execute(f"CREATE TABLE {name} ({columns})")
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * (columns.count(',') + 1))})", rows)
    con.close()
    return path


def stored(path: str, tables: dict[str, tuple[str, DataFrame]]) -> str:
    """``store`` of tables given as (columns with types, DataFrame), each filled by one task, batch by batch; no row reaches the driver.

    A table is filled within one transaction, so that a task that runs again begins anew.
    """

    def writer(name: str, columns: str):
        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            con = sqlite3.connect(path, timeout=600, isolation_level=None)
            try:
                con.execute("BEGIN IMMEDIATE")
                con.execute(f"DELETE FROM {name}")
                count = 0
                for batch in batches:
                    con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * (columns.count(',') + 1))})", zip(*(c.to_pylist() for c in batch.columns), strict=True))
                    count += batch.num_rows
                con.execute("COMMIT")
            finally:
                con.close()
            yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["rows"])

        return write

    if not Path(path).exists():
        store(path, {name: (columns, ()) for name, (columns, _) in tables.items()})
    for name, (columns, rows) in tables.items():
        named = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
        named.coalesce(1).mapInArrow(writer(name, columns), "rows bigint").collect()  # one number
    return path
