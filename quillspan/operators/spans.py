"""From spans in normalised text back to the coordinates of the source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import let

STEP = "struct<index: int, assertion: string>"
RUN = f"struct<steps: array<{STEP}>, text: string, doc_start: int>"


def original_span(norm_map: Column, start: Column, length: Column) -> tuple[Column, Column]:
    """(start, end exclusive) in the original of a span in its normalised text."""
    return F.get(norm_map, start), F.get(norm_map, start + length - 1) + 1


def native_range(norm_map: Column, first: Column, last: Column, start: Column, length: Column) -> tuple[Column, Column]:
    """Inclusive native positions of a normalised span; ``first`` and ``last`` are by character."""
    return F.get(first, F.get(norm_map, start)), F.get(last, F.get(norm_map, start + length - 1))


def text_between(chars: Column, positions: Column, start: Column, end: Column) -> Column:
    """The characters whose position lies in the closed range."""
    both = F.arrays_zip(chars.alias("c"), positions.alias("p"))
    return F.array_join(F.transform(F.filter(both, lambda x: x["p"].between(start, end)), lambda x: x["c"]), "")


def run_at(runs: Column, offset: Column) -> Column:
    """The last run that begins at or before ``offset``, or the first run."""
    before = F.filter(runs, lambda r: r["doc_start"] <= offset)
    return F.when(F.size(before) > 0, F.element_at(before, -1)).otherwise(F.get(runs, F.lit(0)))


def point(runs: Column, offset: Column, is_end: bool) -> Column:
    """(steps, place in the run) of a document offset; an end belongs to the run that it closes."""
    place = lambda run: F.struct(run["steps"].alias("steps"), F.greatest(F.lit(0), F.least(offset - run["doc_start"], F.length(run["text"]))).alias("at"))
    return let(run_at(runs, offset - 1 if is_end else offset), place)


def _path(steps: Column) -> Column:
    one = lambda s: F.concat(F.lit("/"), s["index"].cast("string"), F.when(F.coalesce(s["assertion"], F.lit("")) != "", F.concat(F.lit("["), s["assertion"], F.lit("]"))).otherwise(""))
    return F.array_join(F.transform(steps, one), "")


def range_address(spine_step: Column, runs: Column, start: Column, end: Column) -> Column:
    """The address of a document range: common parent, then start and end relative to it."""

    def of_points(p: Column) -> Column:
        a, b = p["a"], p["b"]
        n = F.least(F.size(a["steps"]), F.size(b["steps"]))
        same = F.zip_with(F.slice(a["steps"], F.lit(1), n), F.slice(b["steps"], F.lit(1), n), lambda x, y: x.eqNullSafe(y))
        # how many leading steps agree: up to the first that differs
        return let(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, n).cast("int"), lambda common: joined(a, b, common))

    def joined(a: Column, b: Column, common: Column) -> Column:
        rest = lambda p: F.concat(_path(F.slice(p["steps"], common + 1, F.size(p["steps"]))), F.lit(":"), p["at"].cast("string"))
        return F.concat(F.lit("epubcfi("), spine_step, F.lit("!"), _path(F.slice(a["steps"], F.lit(1), common)), F.lit(","), rest(a), F.lit(","), rest(b), F.lit(")"))

    return let(F.struct(point(runs, start, False).alias("a"), point(runs, end, True).alias("b")), of_points)


def spine_index(address: Column) -> Column:
    """0-based document number from an address: half its second step, less one; null without one."""
    step = F.try_element_at(F.split(F.regexp_extract(address, r"^epubcfi\((/\d+/\d+)", 1), "/"), F.lit(3))
    return (F.floor(F.nullif(step, F.lit("")).cast("int") / 2) - 1).cast("int")


def document_part(address: Column) -> Column:
    return F.substring_index(address, "!", 1)


def chunk_positions(chunks: Column) -> Column:
    """Chunks (pid, text) in order of pid, one position a character."""
    ordered = F.array_sort(F.filter(chunks, lambda c: F.length(c["text"]) > 0))
    return F.flatten(F.transform(ordered, lambda c: F.sequence(c["pid"], c["pid"] + F.length(c["text"]) - 1)))


def chunk_text(chunks: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(chunks), lambda c: c["text"]), "")


def last_position(chunks: Column) -> Column:
    """The largest position that any chunk covers."""
    return F.array_max(F.transform(chunks, lambda c: c["pid"] + F.length(c["text"]) - 1))
