import random
from difflib import SequenceMatcher

import pytest

from quillspan.functions import bounds


def texts(rng, n, size, letters):
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(size))) for _ in range(n)]
    return out + ["".join(c for k, c in enumerate(t) if k % 10 != 9) for t in out[: n // 2]] + out[:2] + ["", letters[0] * size]


@pytest.mark.parametrize(("size", "letters"), [(12, "ab"), (90, "abcd e"), (300, "étha ns\U0001f600")])
def test_blocks_and_pairs_are_difflibs(size, letters):
    rng = random.Random(size)
    for _ in range(3):
        a, b = texts(rng, 12, size, letters), texts(rng, 8, size, letters)
        b += a[:5]
        for x in a:
            for y in b[:6]:
                assert bounds.matching_blocks(x, y) == [tuple(m) for m in SequenceMatcher(None, x, y, False).get_matching_blocks() if m.size]
        for threshold in (0.3, 0.8, 0.9):
            want = set()
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    close = abs(len(x) - len(y)) <= max(len(x), len(y)) * (1 - threshold)
                    if x and y and (x in y or y in x or close and SequenceMatcher(None, x, y, False).ratio() >= threshold):
                        want.add((i, j))
            got = bounds.similar_pairs(a, b, threshold, False)
            assert len(got) == len(set(got)) and set(got) == want
            once = bounds.similar_pairs(a, b, threshold, True)
            assert set(once) <= want and sorted(i for i, _ in once) == sorted({i for i, _ in want})

