"""Upper bounds of what two texts can share, for many pairs at once; nothing that could match is lost by them."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np

#: Columns of a table of counted runs; of more runs several share a column, which only loosens the bound.
WIDTH = 1 << 13


def codes(texts: list[str]) -> np.ndarray:
    """The code points of all texts, one behind the other."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def _numbered(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of each run of ``n`` characters, 1 or 2, numbered among its equals in the text."""
    code, row = codes(texts).astype(np.int64), np.repeat(np.arange(len(texts)), lengths(texts))
    if n == 2:
        inside = row[:-1] == row[1:]
        code, row = (code[:-1] << 21 | code[1:])[inside], row[:-1][inside]
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(first)
    number = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
    return row, code << 21 | number


def shared(a: list[str], b: list[str], n: int) -> np.ndarray:
    """For each text of ``a`` and each of ``b`` at least the number of runs of ``n`` characters that they share."""
    (ra, ca), (rb, cb) = _numbered(a, n), _numbered(b, n)
    both = np.intersect1d(ca, cb)
    if not len(both):
        return np.zeros((len(a), len(b)), np.float32)
    width = min(len(both), WIDTH)

    def table(row: np.ndarray, code: np.ndarray, rows: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(both, code), len(both) - 1)
        known = both[at] == code
        return np.bincount(row[known] * width + at[known] % width, minlength=rows * width).reshape(rows, width).astype(np.float32)

    return table(ra, ca, len(a)) @ table(rb, cb, len(b)).T


def masks(a: str) -> dict[str, int]:
    """For each character of ``a`` its places, as the bits of one integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    return at


def common(at: dict[str, int], size: int, b: str) -> int:
    """Length of the longest common subsequence with ``b`` of the text of ``size`` characters whose masks are ``at``."""
    full = (1 << size) - 1
    rest, get = full, at.get
    for c in b:
        hit = rest & get(c, 0)
        if hit:
            rest = (rest + hit | rest - hit) & full
    return size - rest.bit_count()


#: Largest product of two lengths whose table of runs is made; longer texts are compared by difflib itself.
CELLS = 1 << 22


def _parts(a: str, b: str) -> Iterator[tuple[int, int, int, int]]:
    """(start in a, start in b, size, most that is still to come) of difflib's matching blocks without junk, the longest of a range first.

    A table has the length of the common run that ends at each two places; the first largest value
    of a range of it, clipped at the range's start, is the block that difflib takes there.
    """
    x, y = codes([a]), codes([b])
    run = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, same in enumerate(x[:, None] == y, 1):
        np.add(run[i - 1, :-1], 1, out=run[i, 1:])
        run[i, 1:] *= same
    rows, columns = np.arange(1, len(a) + 1, dtype=np.int32)[:, None], np.arange(1, len(b) + 1, dtype=np.int32)
    todo = [(0, len(a), 0, len(b))]
    most = min(len(a), len(b))
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        most -= min(ahi - alo, bhi - blo)
        here = run[alo + 1 : ahi + 1, blo + 1 : bhi + 1]
        if alo or blo:
            here = np.minimum(here, np.minimum(rows[: ahi - alo], columns[: bhi - blo]))
        i, j = divmod(int(here.argmax()), bhi - blo)
        size = int(here[i, j])
        if size:
            i, j = alo + i + 1 - size, blo + j + 1 - size
            for part in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
                if part[0] < part[1] and part[2] < part[3]:
                    todo.append(part)
                    most += min(part[1] - part[0], part[3] - part[2])
            yield i, j, size, most


def reaches(a: str, b: str, threshold: float) -> bool:
    """Whether difflib's ratio, without junk, is at least the threshold."""
    if a == b or len(a) * len(b) > CELLS:
        return a == b and threshold <= 1 or SequenceMatcher(isjunk=None, a=a, b=b, autojunk=False).ratio() >= threshold
    total, enough = 0, lambda n: 2.0 * n / (len(a) + len(b)) >= threshold
    for _, _, size, most in _parts(a, b) if a and b else ():
        total += size
        if enough(total) or not enough(total + most):
            break
    return enough(total)


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """(start in a, start in b, size): difflib's matching blocks without junk, neighbours joined, in order."""
    if not a or not b or len(a) * len(b) > CELLS:
        return [tuple(m) for m in SequenceMatcher(isjunk=None, a=a, b=b, autojunk=False).get_matching_blocks() if m.size]
    out: list[tuple[int, int, int]] = []
    for i, j, size in sorted((i, j, size) for i, j, size, _ in _parts(a, b)):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + size)
        else:
            out.append((i, j, size))
    return out


class Words:
    """Texts as one table of characters, to compare a text of at most 64 characters with many at once."""

    def __init__(self, texts: list[str]):
        sizes = lengths(texts)
        self.alphabet, found = np.unique(codes(texts), return_inverse=True)
        self.table = np.full((len(texts), int(sizes.max(initial=0))), len(self.alphabet), np.int32)
        self.table[np.arange(self.table.shape[1]) < sizes[:, None]] = found

    def common(self, a: str, rows: np.ndarray) -> np.ndarray:
        """The lengths of the longest common subsequences of ``a`` with the texts in ``rows``."""
        full = np.uint64((1 << len(a)) - 1)
        bits = np.zeros(len(self.alphabet) + 1, np.uint64)
        for c, places in masks(a).items():
            at = np.searchsorted(self.alphabet, ord(c))
            if at < len(self.alphabet) and self.alphabet[at] == ord(c):
                bits[at] = places
        rest = np.full(len(rows), full)
        for column in bits[self.table[rows]].T:
            hit = rest & column
            rest = rest + hit | rest - hit
        return len(a) - np.bitwise_count(rest & full).astype(np.int64)


def similar_pairs(a: list[str], b: list[str], threshold: float, once: bool) -> list[tuple[int, int]]:
    """(i, j) of all texts that ``similar`` calls so: one contains the other, or lengths and difflib's ratio are close.

    With ``once`` a text of ``a`` is given with one of its partners only. Pairs are told apart by
    length, by pairs of characters and by the longest common subsequence before they are compared:
    m matched characters have at least 3 m - x - y - 1 pairs of neighbours in common, for lengths x and y.
    """
    out: list[tuple[int, int]] = []
    la, lb = lengths(a), lengths(b)
    done, inside = set(), set()
    for i, j in _containing(a, b, once):
        done.add(i)
        inside.add((i, j))
        out.append((i, j))
    for low in range(0, len(a), 512):
        rows = [i for i in range(low, min(low + 512, len(a))) if a[i] and not (once and i in done)]
        for left in range(0, len(b), 2048) if rows else ():
            x, y = la[rows][:, None], lb[left : left + 2048][None, :]
            open_ = (np.abs(x - y) <= np.maximum(x, y) * (1 - threshold)) & (y > 0)
            if open_.sum() > 8:
                # rows and columns without any open pair aren't counted
                some, other = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
                least = threshold * (x + y) / 2
                near = shared([a[rows[k]] for k in some], [b[left + k] for k in other], 2)
                open_[np.ix_(some, other)] &= near >= (3 * least - x - y - 1)[np.ix_(some, other)] - 1e-3
            for k, of in enumerate(open_):
                i = rows[k]
                if once and i in done:
                    continue
                at = None
                for j in np.flatnonzero(of) + left:
                    j = int(j)
                    if (i, j) in inside:
                        continue
                    at = at or masks(a[i])
                    if 2 * common(at, len(a[i]), b[j]) >= threshold * (len(a[i]) + len(b[j])) and reaches(a[i], b[j], threshold):
                        out.append((i, j))
                        if once:
                            done.add(i)
                            break
    return out


def _containing(a: list[str], b: list[str], once: bool):
    """(i, j) of texts of which one contains the other; with ``once`` one j for each i."""
    met: set[int] = set()
    for mine, theirs, turned in ((a, b, False), (b, a, True)):
        # all texts of one side behind each other, parted by what no text has
        part = next(c for c in map(chr, range(0x10FFFF, 0, -1)) if not any(c in t for t in (*a, *b)))
        whole = part.join(theirs)
        starts = np.concatenate([[0], np.cumsum(lengths(theirs) + 1)])
        for i, text in enumerate(mine):
            if not text or once and not turned and i in met:
                continue
            at = whole.find(text)
            while at >= 0:
                j = int(np.searchsorted(starts, at, "right")) - 1
                pair = (j, i) if turned else (i, j)
                # of equal texts the first round tells
                if not (turned and a[j] == b[i]) and not (once and pair[0] in met):
                    met.add(pair[0])
                    yield pair
                if once and not turned:
                    break
                at = whole.find(text, int(starts[j + 1]))
