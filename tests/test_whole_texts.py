"""Queries over whole texts: what differs late in a text counts."""

import random

from quillspan import catalogue
from quillspan.functions import similarity
from quillspan.operators import dedupe


def folder(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_shared_opening_is_not_known(spark, tmp_path):
    opening = "a common opening of more than thirty characters, "
    at = folder(spark, tmp_path, [(1, opening + "one", "s"), (2, opening + "two", "s"), (3, opening + "two", "s")])
    assert [r[0] for r in catalogue.QUERIES["exact_text_anti"](spark, at).collect()] == [1]


def talk(spark, path, texts):
    rows = [(1, k, "user", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_resembling_by_whole_texts(spark):
    rng = random.Random(3)
    said = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    opening, end = said(20), said(60)
    known = [(0, "s", opening + " " + end), (0, "s", "short bit"), (0, "t", opening)]
    rows = [(1, "s", opening + " " + said(60)), (2, "s", opening + " " + end[:-9] + "otherends"), (3, "s", "with a short bit inside"), (4, "t", opening + " " + end), (5, "s", end), (6, "t", "short bit"), (7, "s", "")]
    names = "row_id long, book_id string, norm string"
    rows, known = spark.createDataFrame(rows, names), spark.createDataFrame(known, names)
    assert sorted(r[0] for r in dedupe.with_similar(rows, known).select("row_id").collect()) == [2, 3, 4, 5]
    assert sorted(r[0] for r in dedupe.without_similar(rows, known, 0.8).select("row_id").collect()) == [1, 6, 7]


def test_resembling_is_that_of_all_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5)))
    base = [" ".join(word() for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    spoilt = ["".join(c for c in rng.choice(base) if rng.random() < 0.93).strip() for _ in range(60)]
    rows = [(i, rng.choice("xy"), " ".join(t.split())) for i, t in enumerate(spoilt)]
    known = [(0, rng.choice("xy"), t) for t in base]
    want = sorted(i for i, g, t in rows if any(g == h and t and (t in k or k in t or (abs(len(t) - len(k)) <= 0.2 * max(len(t), len(k)) and similarity._ratio(t, k, False) >= 0.8)) for _, h, k in known))
    names = "row_id long, book_id string, norm string"
    got = dedupe.with_similar(spark.createDataFrame(rows, names), spark.createDataFrame(known, names), 0.8)
    assert sorted(r[0] for r in got.select("row_id").collect()) == want


def test_bound_loses_nothing():
    rng = random.Random(4)
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
        b = "".join(c if rng.random() < 0.9 else rng.choice("abc") for c in a)
        for threshold in (0.5, 0.8, 0.85, 1.0):
            assert similarity._reaches(a, b, threshold) == (similarity._ratio(a, b, False) >= threshold)


def test_similar_turns_are_compared_whole(spark, tmp_path):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    whole, opening = text(), text()[:210]
    at = talk(spark, tmp_path, [whole, "#" + whole[1:], opening + text(), opening + text(), whole[50:150]])
    got = {(r["row_id"] - 1000, r["other"], r["contained"]) for r in catalogue.QUERIES["similar_text"](spark, at).collect() if r["other"] >= 0}
    assert got == {(0, 1001, False), (0, 1004, True), (1, 1004, True)}
