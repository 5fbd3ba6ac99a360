"""The search cascade against a plain one that compares every needle with every text."""

import os
import random
from difflib import SequenceMatcher

import pytest

from quillspan import catalogue
from quillspan.functions.text import key_of, normalized
from quillspan.operators import locate

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def plain(hay, needle, exact=True, anchor=True, fuzzy=True):
    """(stage, start, length, score) of a needle in one text, or None, stage after stage."""
    n = len(needle)
    if not n:
        return None
    if exact and needle in hay:
        return ("exact", hay.find(needle), n, 1.0)
    if anchor and n > 120 and (a := hay.find(needle[:60])) >= 0 and (b := hay.find(needle[-60:], a)) >= 0 and b + 60 - a <= 1.3 * n + 60:
        return ("anchor", a, b + 60 - a, 0.95)
    if not fuzzy:
        return None
    starts = []
    for offset in range(0, n - 11, 12):
        at, hits = hay.find(needle[offset : offset + 12]), 0
        while at >= 0 and hits < 50:
            starts.append(max(0, at - offset))
            hits += 1
            at = hay.find(needle[offset : offset + 12], at + 1)
    clusters = []
    for s in sorted(starts):
        if clusters and s - clusters[-1][0] < 12:
            clusters[-1][1] += 1
        else:
            clusters.append([s, 1])
    best = None
    for s, _ in sorted(clusters, key=lambda c: -c[1])[:5]:
        low = max(0, s - 40)
        blocks = [b for b in SequenceMatcher(None, hay[low : s + n + 40], needle, False).get_matching_blocks() if b.size >= max(6, min(12, n // 6))]
        if blocks:
            score, length = sum(b.size for b in blocks) / n, blocks[-1].a + blocks[-1].size - blocks[0].a
            if score >= 0.55 and length <= 1.6 * n + 40 and (best is None or score > best[3]):
                best = ("fuzzy", low + blocks[0].a, length, score)
    return best


def found(df, *key):
    return {tuple(r[k] for k in key): (r["stage"], r["start"], r["length"], round(r["score"], 9)) for r in df.collect()}


def rounded(hit):
    return (*hit[:3], round(hit[3], 9))


def test_cascade_is_the_plain_one(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    hays = [" ".join(word() for _ in range(rng.choice([3, 60, 300]))) for _ in range(25)] + ["", "aaaa " * 200, "ab" * 300]
    needles = ["", "a", "aaaa aaaa aaaa", "abababababababab", "x" * 130]
    for _ in range(60):
        hay = rng.choice(hays)
        at, n = rng.randrange(max(1, len(hay))), rng.choice([5, 11, 12, 30, 90, 200])
        needle = list(hay[at : at + n])
        for _ in range(rng.choice([0, 0, 1, 4, 12])):
            if needle:
                k = rng.randrange(len(needle))
                needle[k : k + rng.randrange(2)] = rng.choice(["", "#", "zz"])
        needles.append(" ".join("".join(needle).split()))
    needles += [(t[10:90] + t[95:260]).strip() for t in hays if len(t) > 400]
    h = spark.createDataFrame([(i, i % 3, i % 2, t) for i, t in enumerate(hays)], "hay_id long, book_id int, spine int, hay string")
    q = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(needles)], "needle_id long, book_id int, needle string")
    every = {(i, j): plain(t, n) for i, n in enumerate(needles) for j, t in enumerate(hays)}
    want = {k: rounded(v) for k, v in every.items() if v}
    assert {v[0] for v in want.values()} == {"exact", "anchor", "fuzzy"}
    for bound in (1 << 20, 40):  # 40: keys are joined instead of broadcast, seeds go in blocks
        monkeypatch.setattr(locate, "BROADCAST", bound)
        monkeypatch.setattr(locate, "SEEDS", bound)
        assert found(locate.located(h.drop("book_id", "spine"), q.drop("book_id")), "needle_id", "hay_id") == want
    own = {k: v for k, v in want.items() if k[0] % 3 == k[1] % 3}
    assert found(locate.located(h.drop("spine"), q, group="book_id"), "needle_id", "hay_id") == own


def test_books_rank_candidates_together(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7)))
    texts = {(b, s): " ".join(word() for _ in range(80)) for b in range(4) for s in range(3)}
    needles = []
    for _ in range(30):
        t = texts[rng.randrange(4), rng.randrange(3)]
        at = rng.randrange(150)
        needles.append((t[at : at + 30] + "#" * rng.choice([0, 9]) + t[at + 30 : at + 100]).strip())
    want = {}
    for i, n in enumerate(needles):
        for b in range(4):
            for stage in ("exact", "anchor"):
                for s in range(3):
                    hit = plain(texts[b, s], n, exact=stage == "exact", anchor=stage == "anchor", fuzzy=False)
                    if hit and (i, b) not in want:
                        want[i, b] = (s, *rounded(hit))
    h = spark.createDataFrame([(10 * b + s, b, s, t) for (b, s), t in texts.items()], "hay_id long, book_id int, spine int, hay string")
    q = spark.createDataFrame(list(enumerate(needles)), "needle_id long, needle string")
    got = {(r["needle_id"], r["book_id"]): (r["hay_id"] % 10, r["stage"], r["start"], r["length"], round(r["score"], 9)) for r in locate.located_in_books(h, q).collect()}
    assert {k: v for k, v in got.items() if v[1] != "fuzzy"} == want and any(v[1] == "fuzzy" for v in got.values())
    for (i, b), v in got.items():
        if v[1] == "fuzzy":  # the window may compete with those of other documents, so the place is one of theirs
            hits = [plain(texts[b, s], needles[i], exact=False, anchor=False) for s in range(3)]
            assert v[4] == max(round(x[3], 9) for x in hits if x)


@pytest.mark.parametrize("name", ["locate_fuzzy", "locate_cascade"])
def test_registered_searches(spark, name):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", normalized("text")).collect()}
    items = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", key_of("text")).collect()}
    kinds = [lambda n: n, lambda n: n[:80] + n[100:], lambda n: "#" * 12 + n[12:]]
    want = {}
    for i, n in items.items():
        needle = kinds[2 if name == "locate_fuzzy" else i % 3](n)
        for d, t in docs.items():
            if t is not None and (hit := plain(t, needle, exact=name != "locate_fuzzy", anchor=name != "locate_fuzzy")):
                want[i, d] = rounded(hit)
    got = catalogue.QUERIES[name](spark, SF)
    got = found(got if "stage" in got.columns else got.selectExpr("*", "'fuzzy' as stage"), "item_id", "doc_id")
    assert got == want
