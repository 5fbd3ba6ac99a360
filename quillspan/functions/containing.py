"""Which texts stand inside others, and which ranges a later one meets; for many texts at once."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np

#: Bytes by which the start and the end of a text are told.
EDGE = 16
#: Places of the texts that are looked up at once, so that what is made of them stays in a core's cache.
PLACES = 1 << 15
#: Sizes that are tried at once behind the starts found.
TRIALS = 1 << 18
#: A text of so many bytes has at least 20 characters.
SURE = 80
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mixed(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _K[0]
    x += b * _K[1]
    x += key * _K[2]
    x ^= x >> np.uint64(31)
    x *= _K[0]
    return x


def _words(edges: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each edge as numbers; what is shorter ends in zeros."""
    both = np.frombuffer(b"".join(x.ljust(EDGE, b"\0") for x in edges), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


class _Known:
    """Sorted numbers, with a table by their upper bits that lets few others through."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = np.unique(numbers)
        bits = max(12, int(len(self.numbers)).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.numbers >> self.shift] = True

    def among(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``x`` of known numbers, and where among the known each is."""
        maybe = np.flatnonzero(self.table[x >> self.shift])
        at = np.minimum(np.searchsorted(self.numbers, x[maybe]), len(self.numbers) - 1)
        right = self.numbers[at] == x[maybe]
        return maybe[right], at[right]


class Needles:
    """Texts to find, each by the key of its group, its size in bytes, its first and its last bytes.

    A text of fewer than ``EDGE`` bytes is known by its key and size whole. Of others the start is looked up
    at every place, then each size that a text of this start has, by its end: what is in the middle isn't
    compared, so that more may be found, but nothing is lost.
    """

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, heads: list[bytes], tails: list[bytes]):
        keys = keys.astype(np.int64).view(np.uint64)
        (a, b), (c, d) = _words(heads), _words(tails)
        starts = _mixed(keys, a, b)
        self.empty = np.unique(keys[sizes == 0])
        self.short = {int(n): _Known(starts[sizes == n]) for n in np.unique(sizes[(sizes > 0) & (sizes < EDGE)])}
        long = sizes >= EDGE
        self.starts = self.ends = None
        if long.any():
            self.starts = _Known(starts[long])
            self.ends = _Known(_mixed(starts[long] + sizes[long].astype(np.uint64), c[long], d[long]))
            # the sizes of each start, one start behind the other
            start, size = starts[long], sizes[long].astype(np.int64)
            order = np.lexsort((size, start))
            start, size = start[order], size[order]
            new = np.append(True, (start[1:] != start[:-1]) | (size[1:] != size[:-1]))
            start, self.sizes = start[new], size[new]
            self.first = np.searchsorted(start, self.starts.numbers)
            self.count = np.diff(np.append(self.first, len(start)))

    def inside(self, texts: list[bytes], keys: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(text, sha256) of the pieces of the texts that may be one of the needles of the same key.

        Not of a whole text, nor of one of ``SURE`` bytes or more at either end of it: such texts share an
        edge. A piece may come more than once.
        """
        keys = keys.astype(np.int64).view(np.uint64)
        nothing = sha256(b"").digest()
        for i in np.flatnonzero(np.isin(keys, self.empty)).tolist():
            yield i, nothing
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        stop = np.cumsum(size)
        begin = stop - size
        whole = b"".join(texts)
        padded = whole + bytes(EDGE)
        words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
        same = len(np.unique(keys)) == 1
        for low in range(0, len(whole), PLACES):
            high = min(low + PLACES, len(whole))
            if same:
                key = keys[:1]
            else:
                rows = np.arange(*np.searchsorted(stop, [low, high - 1], "right") + [0, 1])
                key = np.repeat(keys[rows], np.minimum(stop[rows], high) - np.maximum(begin[rows], low))
            a, b = words[low:high], words[low + 8 : high + 8]
            seen = set()
            for p, n in self._found(key, a, b, low, words, stop):
                row = np.searchsorted(stop, p, "right")
                edge = (p == begin[row]) | (p + n == stop[row])
                fine = (p + n <= stop[row]) & (n < size[row]) & ~(edge & (n >= SURE))
                for i, at, to in zip(row[fine].tolist(), p[fine].tolist(), (p + n)[fine].tolist(), strict=True):
                    piece = i, whole[at:to]
                    if piece not in seen:
                        seen.add(piece)
                        yield i, sha256(piece[1]).digest()

    def _found(self, key: np.ndarray, a: np.ndarray, b: np.ndarray, low: int, words: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, sizes) of what begins, and for a long one ends, as a needle does."""
        for n, known in self.short.items():
            masks = [np.uint64((1 << 8 * k) - 1) for k in (min(n, 8), max(n - 8, 0))]
            at, which = known.among(_mixed(key, a & masks[0], b & masks[1]))
            row = np.searchsorted(stop, at + low, "right")
            fits = at + low + n <= stop[row]
            # the same one once in a text
            _, once = np.unique(row[fits] * len(known.numbers) + which[fits], return_index=True)
            yield at[fits][once] + low, np.full(len(once), n)
        if self.starts is None:
            return
        x = _mixed(key, a, b)
        at, which = self.starts.among(x)
        upto = np.cumsum(self.count[which])
        done = 0
        while done < len(at):
            before = int(upto[done - 1]) if done else 0
            to = max(done + 1, int(np.searchsorted(upto, before + TRIALS, "right")))
            count = self.count[which[done:to]]
            place = np.repeat(at[done:to], count)
            n = self.sizes[np.repeat(self.first[which[done:to]] - (upto[done:to] - count - before), count) + np.arange(len(place))]
            fits = place + low + n <= stop[-1]
            place, n = place[fits], n[fits]
            end = place + low + n
            right, _ = self.ends.among(_mixed(x[place] + n.astype(np.uint64), words[end - EDGE], words[end - 8]))
            yield place[right] + low, n[right]
            done = to


class Met:
    """Closed ranges, of which those are kept that no other one reaches beyond on both sides."""

    def __init__(self):
        self.starts: list = []
        self.ends: list = []

    def add(self, start, end) -> None:
        i = bisect_right(self.starts, start)
        if i and self.ends[i - 1] >= end:
            return
        i = bisect_left(self.starts, start, 0, i)
        j = bisect_right(self.ends, end, i)
        self.starts[i:j], self.ends[i:j] = [start], [end]

    def meets(self, start, end) -> bool:
        """Whether some range starts at ``end`` or before and ends at ``start`` or behind."""
        i = bisect_right(self.starts, end)
        return i > 0 and self.ends[i - 1] >= start
