"""Near-duplicate grouping against all pairs."""

import random

import numpy as np
import pytest

from quillspan.llm import neardup


def reachable(ids, sets, percent):
    at = {i: i for i in ids}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    a, b = root(i), root(j)
                    at[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text, k):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("shingle,rounds,chunk", [(2, 6, 256), (5, 0, 4)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, shingle, rounds, chunk):
    monkeypatch.setattr(neardup, "PAIRS", 0 if rounds else 256)
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    monkeypatch.setattr(neardup, "TOGETHER", 3)
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "one"), (4, "One"), (5, "one two"), (6, " \n\t"), (None, "one"), (None, None)]
    for k in range(12):
        base = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(60)]
        for m in range(9):
            ws = list(base)
            for _ in range(rng.randrange(9)):
                ws[rng.randrange(len(ws))] = "edit" + str(rng.randrange(99))
            rows.append((100 * k + m + 10, " ".join(ws)))
    rows += [(5000 + i, "same words in every row of this group") for i in range(40)]
    rows += [(3, "one"), (10, rows[8][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = neardup.groups(docs, shingle, 80).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t in rows if i is not None}
    sets = {i: shingles(t, shingle) for i, t in text.items()}
    want = reachable(sorted(sets), sets, 80)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    kept = neardup.without_copies(docs, shingle, 80)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda i: -1 if i is None else i)
    assert ids == [None, None] + sorted({i for i in want if want[i] == i})


def test_texts_of_one_id_tie_their_classes(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    docs = spark.createDataFrame([(10, a), (10, b), (3, a), (20, b), (5, "alone in the world here")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in neardup.groups(docs).collect()) == [(3, 3), (5, 5), (10, 3), (10, 3), (20, 3)]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.groups(docs).count() == 0 and neardup.without_copies(docs).count() == 0


def test_linked_counts_shared_elements():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 9000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (6000, 6000, 50, 1)] + [np.zeros(0, np.uint64)]
    sets.append(np.unique(np.concatenate([sets[0][:-400], pool[:3]])))
    part = np.array([0, 1, 2, 3, 4, 5])
    i, j = neardup.linked(sets, part, 80)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 5)]
    assert len(neardup.linked(sets, part * 0, 80)[0]) == 0


def test_words_of_adverse_structure_stay_apart(spark):
    from tests.llm.test_substring import thue_morse

    rows = []
    for k, n in enumerate((64, 1024, 2048)):
        a, b = thue_morse(n)
        rows += [(10 * k + 1, f"{a} x{k}"), (10 * k + 2, f"{b} x{k}"), (10 * k + 3, f"{a} x{k}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(docs, 2, 80).collect()}
    assert got == {i: i - 2 if i % 10 == 3 else i for i, _ in rows}
