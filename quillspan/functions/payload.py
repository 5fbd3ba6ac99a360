"""Annotation payloads: decoding, encoding, ids, colours and the two epochs in use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the stores and their payloads: dataset numbers, colours, the epoch, field names.
HIGHLIGHT, BOOKMARK, NOTE, UNDERLINE = 1, 2, 3, 12
#: Seconds from 1970 to the other application's epoch, 2001.
EPOCH_2001 = 978307200
POSITION = "struct<longPosition: string, shortPosition: bigint>"
SCHEMA = f"struct<book_data: struct<asin: string, contentType: string, guid: string, isOwnedByCustomer: int, isSample: int>, created_time: bigint, end_position: {POSITION}, json_metadata: string, last_modified: bigint, position_type: int, start_position: {POSITION}, type: string>"
_COLOURS = {0: "yellow", 1: "orange", 2: "blue", 3: "yellow", 4: "pink", 5: "blue"}


def decoded(payload: Column) -> Column:
    """The payload as a struct; fields of bad JSON and positions that aren't whole numbers are null."""
    return F.from_json(payload, SCHEMA)


def positions(payload: Column) -> tuple[Column, Column]:
    data = decoded(payload)
    return data["start_position"]["shortPosition"], data["end_position"]["shortPosition"]


def colour(style: Column) -> Column:
    pairs = [F.lit(x) for item in _COLOURS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(style, F.lit(0)).cast("int")), F.lit("yellow"))


def content_type(book_id: Column) -> Column:
    return F.when(F.length(book_id) == 10, "EBOK").otherwise("PDOC")


def clean_id(book_id: Column) -> Column:
    """A catalogue id without its ``A:`` prefix, then without its ``-0`` suffix."""
    return F.regexp_replace(F.regexp_replace(book_id, "^A:", ""), "-0$", "")


def dataset_id(book_id: Column, kind: Column, guid: Column) -> Column:
    return F.concat_ws("-", book_id, kind, F.coalesce(guid, F.lit("")))


def annotation_id(kind: Column, start: Column, prefix: str = "app") -> Column:
    """``prefix.kind-start``; two annotations of one kind at one place have the same id."""
    return F.concat(F.lit(f"{prefix}."), kind, F.lit("-"), start.cast("string"))


def note_position(end: Column, offset: int = 6) -> Column:
    return end + offset


def encoded(book_id: Column, kind: Column, guid: Column, start: Column, end: Column, metadata: Column, created_ms: Column) -> Column:
    """A payload as JSON with its keys in order; ``metadata`` (a struct) becomes JSON inside JSON."""
    place = lambda at: F.struct(F.lit("").alias("longPosition"), at.cast("bigint").alias("shortPosition"))
    book = F.struct(book_id.alias("asin"), content_type(book_id).alias("contentType"), F.coalesce(guid, F.lit("")).alias("guid"), F.lit(1).alias("isOwnedByCustomer"), F.lit(0).alias("isSample"))
    fields = {"book_data": book, "created_time": created_ms, "end_position": place(end), "json_metadata": F.to_json(metadata), "last_modified": created_ms, "position_type": F.lit(0), "start_position": place(start), "type": kind}
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def from_epoch_2001(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds + EPOCH_2001)


def to_epoch_2001(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6 - EPOCH_2001


def content_key(*parts: Column) -> Column:
    """A short key of a file's path, size and time, for caches."""
    return F.left(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), F.lit(16))
