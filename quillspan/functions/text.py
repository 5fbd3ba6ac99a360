"""Normalising and parsing of text as Column expressions; but for ``normal_map`` nothing here leaves the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.bounds import codes, lengths

# Characters that compare equal - apostrophes, quotation marks, dashes, ellipsis, spaces - and
# the words of a title that carry no meaning.
_FOLDS = {
    "'": "\u2018\u2019\u02bc",
    '"': "\u201c\u201d\u201e",
    "-": "\u2013\u2014\u2015",
    ".": "\u2026",
    " ": "\u00a0\u2009\u200a\u2002\u2003\t\r\n\f\v",
}
_FROM = "".join(_FOLDS.values())
_TO = "".join(k * len(v) for k, v in _FOLDS.items())
_SPACES = [ord(c) for c in " " + _FOLDS[" "]]
_STOP = ["the", "a", "an", "of", "and", "in", "to", "for", "on", "s"]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed, and written into the plan, once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(text: Column) -> Column:
    """Each character replaced by the representative of its class; case is kept."""
    return F.translate(text, _FROM, _TO)


def normalized(text: Column) -> Column:
    """Lower case, folded characters, runs of spaces as one, none at either end."""
    return F.trim(F.regexp_replace(F.lower(folded(text)), " +", " "))


def _places(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, number of places of each text) of ``normal_map``."""
    code, size = codes(texts), lengths(texts)
    start = np.cumsum(size) - size
    space = np.isin(code, _SPACES)
    first = np.zeros(len(code), bool)
    first[start[size > 0]] = True
    before = np.ones(len(code), bool)
    before[1:] = space[:-1]
    kept = np.where(code == 0x130, 2, 1) * ~(space & (first | before))
    # a text that ends in a space has one more place than normal characters, unless it has none at all
    ends = (start + size - 1)[size > 0]
    sums = np.concatenate([[0], np.cumsum(kept)])
    count = sums[start + size] - sums[start]
    last = np.zeros(len(texts), bool)
    last[size > 0] = space[ends]
    for row in np.flatnonzero(last & (count > 0)):
        end = start[row] + size[row] - 1
        while not kept[end]:
            end -= 1
        kept[end] = 0
        count[row] -= 1
    return np.repeat(np.arange(len(code)) - np.repeat(start, size), kept).astype(np.int32), count


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _normal_map(texts: pa.Array) -> pa.Array:
    rows, parts, counts = texts.to_pylist(), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(rows):  # some texts at a time, so that what is made on the way stays small
        upto, size = at, 0
        while upto < len(rows) and (upto == at or size < 1 << 20):
            size += len(rows[upto] or "")
            upto += 1
        places, count = _places([r or "" for r in rows[at:upto]])
        parts.append(places)
        counts.append(count)
        at = upto
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)), mask=pa.array([r is None for r in rows], pa.bool_()))


def normal_map(text: Column) -> Column:
    """For each character of ``normalized(text)``, its 0-based place in ``text``.

    A character whose lower case has two code points (U+0130) gives its place twice, so that
    map and text stay in step. The places are counted in Arrow batches, all texts of one at once.
    """
    return _normal_map(text)


def without_markers(text: Column) -> Column:
    """Footnote markers such as [3], [*3] and [*] taken out."""
    return F.regexp_replace(text, r"(?U)\[(?:\*|\*?\d+)\]", "")


def key_of(text: Column) -> Column:
    """What two passages have in common if they differ in markers, case, spacing or typography only."""
    return normalized(without_markers(text))


# Fixed value: what Java's \s is in the Unicode sense.
_SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without white space, in the Unicode sense, at either end."""
    return F.btrim(text, F.lit(_SPACES))


def title_key(title: Column) -> Column:
    """A title for comparison: underscores as spaces, a tail behind ``--`` dropped, words only."""
    plain = F.regexp_replace(F.replace(title, F.lit("_"), F.lit(" ")), r"--[^\n]*$", "")
    words = F.regexp_replace(F.lower(plain), r"(?U)[^\w\s]", " ")
    return stripped(F.regexp_replace(words, r"(?U)\s+", " "))


def title_tokens(title: Column) -> Column:
    """The distinct words of a title's key that carry meaning."""
    words = F.array_except(F.split(title_key(title), " "), F.array(*map(F.lit, [*_STOP, ""])))
    return F.array_distinct(words)


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over those of the smaller set; null if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least)


def heading_title(line: Column) -> Column:
    """The title of a heading ``Title (Author)``; the whole line if it has no author."""
    clean = stripped(F.regexp_replace(stripped(line), "^\ufeff+", ""))
    return F.when(clean.rlike(_HEADING), stripped(F.regexp_extract(clean, _HEADING, 1))).otherwise(clean)


def heading_author(line: Column) -> Column:
    """The author of a heading, or null."""
    clean = stripped(F.regexp_replace(stripped(line), "^\ufeff+", ""))
    return F.when(clean.rlike(_HEADING), stripped(F.regexp_extract(clean, _HEADING, 2)))


_HEADING = r"^(.*)\(([^()]*)\)\s*$"
_DAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"


def log_date(text: Column) -> Column:
    """``Sunday, 5 May 2024 10:11:12`` as a timestamp without zone; anything else is null."""
    rest = F.regexp_extract(stripped(text), rf"^(?i:{_DAYS}), (\d{{1,2}} \p{{L}}+ \d{{4}} \d{{1,2}}:\d{{1,2}}:\d{{1,2}})$", 1)
    return F.try_to_timestamp(F.nullif(rest, F.lit("")), F.lit("d MMMM yyyy H:m:s")).cast("timestamp_ntz")


def shares_edge(a: Column, b: Column, n: int = 20) -> Column:
    """Whether the longer text starts or ends with the first or last ``n`` characters of the shorter."""
    swap = F.length(a) <= F.length(b)
    short, long = F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a)
    return F.startswith(long, F.left(short, F.lit(n))) | F.endswith(long, F.right(short, F.lit(n)))


def related(a: Column, b: Column) -> Column:
    """Whether one text contains the other or they share an edge."""
    return F.contains(a, b) | F.contains(b, a) | shares_edge(a, b)


def least_block(needle: Column) -> Column:
    """The shortest matching block that counts, by the needle's length."""
    return F.greatest(F.lit(6), F.least(F.lit(12), F.floor(F.length(needle) / 6)))
