"""Removal of repeated passages against all windows of all documents."""

import random

from quillspan.llm import substring


def brute(rows, width):
    least = {}
    split = [(i, (t or "").split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1 if i is not None else 0):
            if least[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def test_removals(spark, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET", 1 << 11)
    monkeypatch.setattr(substring, "PART", 1 << 11)
    rng = random.Random(3)
    shared = [" ".join(f"w{rng.randrange(500)}" for _ in range(30)) for _ in range(4)]
    rows = [(None, None), (None, shared[0]), (1, None), (2, ""), (3, " \n\t "), (4, "a b c"), (5, "x " * 60), (6, "x " * 12), (7, "x " * 13), (-4, shared[1])]
    for i in range(60):
        own = [f"v{rng.randrange(9999)}" for _ in range(40)]
        at = rng.randrange(40)
        rows.append((i + 10, " ".join(own[:at] + rng.choice(shared).split() + own[at:])))
    rows += [(20, rows[15][1]), (20, rows[15][1]), (21, " ".join(f"q{k}" for k in range(3000))), (22, " ".join(f"q{k}" for k in range(3000)))]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, n_words int, key string").repartition(3)
    got = substring.removals(docs)
    assert set(got.columns) == {"doc_id", "text", "key", "n_words", "removed", "kept"}
    found = got.collect()
    assert sorted([(r["doc_id"], r["n_words"], sum(x["end"] - x["begin"] for x in r["removed"]), r["kept"]) for r in found], key=str) == brute(rows, substring.WIDTH)
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=str) == sorted(rows, key=str)
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert substring.removals(docs.limit(0)).count() == 0


def thue_morse(n, letters="ab"):
    """Two words of n letters whose polynomial hashes modulo 2^64 are equal, whatever the base."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def test_words_of_adverse_structure_stay_apart(spark):
    rest = " " + " ".join(f"w{k}" for k in range(12))
    for n in (64, 1024, 2048):
        a, b = thue_morse(n)
        docs = spark.createDataFrame([(1, a + rest), (2, b + rest), (3, a + rest)], "doc_id long, text string")
        got = {r["doc_id"]: sum(x["end"] - x["begin"] for x in r["removed"]) for r in substring.removals(docs).collect()}
        assert got == {1: 0, 2: 0, 3: 13}
