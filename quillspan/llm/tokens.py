"""Vectorised words, character n-grams and their 64-bit hashes over Arrow string columns.

Texts are handled as one byte buffer per block of documents, so that every step is a
NumPy pass. Blocks hold about ``BLOCK`` bytes (one document at least), which bounds the
temporary memory for texts of common length whatever the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes, or characters, that are handled together: so many that NumPy's calls don't tell, so few
#: that their arrays stay in a core's cache.
BLOCK = 1 << 17
_U = np.uint64
#: Bytes of a word up to this place have their value in a table.
_PLACES = 64
_tables: dict[int, np.ndarray] = {}

#: Bytes 0x20 and 0x09-0x0D part words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: 0 separates, 1 is a letter, a digit or part of a multi-byte character, 2 is a sign.
_KIND = np.full(256, 2, np.uint8)
_KIND[SEPARATOR] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the result depends on every bit of x."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _byte_values(place: np.ndarray, byte: np.ndarray, seed: int) -> np.ndarray:
    """A random 64-bit value for each byte at each place of a word; ``seed`` chooses among independent ones."""
    table = _tables.get(seed)
    if table is None:
        table = _tables[seed] = mix(mix(np.arange(_PLACES << 8, dtype=_U) + _U(1)) ^ _U((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    index = (np.minimum(place, _PLACES - 1) << 8) | byte
    value = table[index]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        value[far] = mix(mix(((place[far] << 8) | byte[far]).astype(_U) + _U(1)) ^ _U((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return value


@dataclass
class Block:
    """Documents lo..hi of a column: ``data`` are their bytes, ``ends`` where each begins and ends."""

    lo: int
    hi: int
    data: np.ndarray
    ends: np.ndarray


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[Block]:
    """The UTF-8 bytes of a string column by blocks; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield Block(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


@dataclass
class Words:
    """Words of a block: byte spans, 64-bit hashes and, by document, where they begin."""

    start: np.ndarray
    stop: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # word index at which each document begins, and the total
    second: np.ndarray | None = None  # independent hashes, if asked for

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _spans(kind: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of one kind other than 0, none of which crosses from one document to another."""
    n = len(kind)
    change = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[ends] = True
    at = np.flatnonzero(change)
    full = kind[at[:-1]] != 0 if n else np.zeros(0, bool)
    return at[:-1][full], at[1:][full]


def words(block: Block, lower: bool = False, by_kind: bool = False, twice: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` (``by_kind``: also parted where signs and letters meet).

    A word's hash adds up random values of its bytes at their places, so that no arrangement of
    letters, whatever the word's length, has an edge; ``twice`` also gives a second, independent hash.
    """
    data = ASCII_LOWER[block.data] if lower else block.data
    kind = _KIND[data] if by_kind else (~SEPARATOR[data]).view(np.uint8)
    start, stop = _spans(kind, block.ends)
    size = stop - start
    ends = np.cumsum(size)
    byte = data[kind != 0].astype(np.int32)
    place = np.arange(len(byte), dtype=np.int32) - np.repeat((ends - size).astype(np.int32), size)
    hashes = []
    for seed in range(1 + twice):
        total = np.zeros(len(byte) + 1, _U)
        np.cumsum(_byte_values(place, byte, seed), out=total[1:])
        hashes.append(mix(total[ends] - total[ends - size] + size.astype(_U) * _U(0xD6E8FEB86659FD93)))
    return Words(start, stop, hashes[0], np.searchsorted(start, block.ends), hashes[1] if twice else None)


def windows(w: Words, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all runs of ``width`` words inside one document, and the first words' indexes.

    Words enter as random 64-bit numbers; ``seed`` 1 takes their second hashes, and another base.
    """
    source = w.second if seed else w.hash
    n = len(source) - width + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    base = _U(0xC2B2AE3D27D4EB4F + 2 * seed)
    value = np.zeros(n, _U)
    for k in range(width):
        value *= base
        value += source[k : k + n]
    fits = np.ones(n, bool)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        fits[max(a, b - width + 1, 0) : b] = False
    at = np.flatnonzero(fits)
    return mix(value[at] + _U(seed * 0x632BE59BD9B4E019 % (1 << 64))), at


def shingle_sets(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingles of each document, hashed, in order within a document.

    Returns (hashes, first): document k has hashes[first[k]:first[k + 1]]. A document of
    fewer words has its whole sequence as its one shingle; without words it has none.
    """
    w = words(block, lower=True)
    value, at = windows(w, width)
    doc = w.doc[at] if len(at) else np.zeros(0, np.int64)
    count = np.diff(w.first)
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        whole = np.zeros(len(few), _U)
        for i, d in enumerate(few):
            h = 0
            for x in w.hash[w.first[d] : w.first[d + 1]].tolist():
                h = (h * 0x9FB21C651E98DF25 + x + 1) % (1 << 64)
            whole[i] = _U(h)
        value, doc = np.concatenate([value, mix(whole + _U(7))]), np.concatenate([doc, few])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(block.ends)))


_fold: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: itself in lower case if it is a letter, else a space; and whether it is one."""
    if not _fold:
        low = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low[c] = ord(x) if len(x := ch.lower()) == 1 else c
        _fold.extend([low, low != 32])
    return _fold[0], _fold[1]


def letter_streams(texts: list[str | None], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, runs of anything but letters as one space.

    Each text stands behind ``pad`` spaces and ends with one. Returns (code points, where
    each text's own part begins and, at the end, the total, letters of each text).
    """
    low, is_letter = _letters()
    joined = "".join(" " * pad + (t or "") + " " for t in texts)
    size = np.array([pad + len(t or "") + 1 for t in texts], np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = low[raw]
    letter = is_letter[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays as a space
    for k in range(pad):
        keep[ends[:-1] + k] = True
    seen = np.concatenate([[0], np.cumsum(letter)])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return folded[keep], kept[ends], seen[ends[1:]] - seen[ends[:-1]]


def text_blocks(texts: list[str | None], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``size`` characters, one text at least."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > lo and held + n > size:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(texts):
        yield lo, len(texts)
