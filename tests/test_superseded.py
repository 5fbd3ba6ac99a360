"""Clips that later ones replace, found without comparing all pairs of a title."""

from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import containing
from quillspan.functions.text import related, stripped
from quillspan.operators import dedupe

CLIPS = "title string, seq long, loc_start int, loc_end int, text string"


def _texts(rng: random.Random, n: int) -> list[str]:
    """Texts of many sizes of which some stand in others, at their start, middle or end."""
    words = ["the", "Étion", "ß", "of", "a", "quemente", "ciónó", "in", "日本", "\0", "ed", "🙂"]
    out = ["", "a", "the", "ß"]
    while len(out) < n:
        text = "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.choice([1, 3, 8, 20, 60])))
        if rng.random() < 0.5:
            other = rng.choice(out)
            low = rng.randrange(len(other) + 1)
            text = rng.choice([other + text, text + other + rng.choice(words), other[low : low + rng.randrange(120)], "head of all texts, " + other])
        out.append(text)
    return out


def test_rows_of_one_number_are_told_apart(spark):
    """Of two rows of a title with the same seq only the one that is replaced goes."""
    rows = [("b", 1, 0, 9, "first text"), ("b", 1, 50, 60, "another"), ("b", 2, 5, 9, "first text and more"), (None, 1, 0, 9, "first text"), ("b", 0, 0, 9, None), ("b", None, 0, 9, "first")]
    kept = dedupe.without_superseded(spark.createDataFrame(rows, CLIPS)).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, rows[1:]))


@pytest.mark.parametrize("part", [dedupe.PART, 1 << 9])
def test_superseded_equals_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(dedupe, "PART", part)
    rng = random.Random(part)
    rows = []
    for text in _texts(rng, 700):
        # some ranges are the wrong way round, some numbers are given twice
        start = rng.choice([None, *range(400)])
        end = None if start is None or rng.random() < 0.2 else start + rng.randrange(-3, 25)
        rows.append((f"t{rng.randrange(3)}", rng.randrange(600), start, end, rng.choice(["", " ", " "]) + text + rng.choice(["", "\n"])))
    clips = spark.createDataFrame(rows, CLIPS).coalesce(1).withColumn("row", F.monotonically_increasing_id())
    end, t = F.coalesce("loc_end", "loc_start").alias("end"), stripped(F.col("text")).alias("t")
    k = clips.select("row", "title", "seq", "loc_start", end, t)
    n = k.toDF("row2", "title2", "seq2", "start2", "end2", "t2")
    pairs = k.join(n, (F.col("title") == F.col("title2")) & (F.col("seq2") > F.col("seq")) & (F.col("loc_start") <= F.col("end2")) & (F.col("start2") <= F.col("end")) & related(F.col("t"), F.col("t2")))
    gone = {r[0] for r in pairs.select("row").distinct().collect()}
    assert 50 < len(gone) < 500
    assert sorted(r["row"] for r in dedupe.without_superseded(clips).collect()) == sorted(set(range(len(rows))) - gone)


@pytest.mark.parametrize(("places", "trials"), [(containing.PLACES, containing.TRIALS), (7, 3)])
def test_needles_are_found_where_they_stand(monkeypatch, places, trials):
    monkeypatch.setattr(containing, "PLACES", places)
    monkeypatch.setattr(containing, "TRIALS", trials)
    texts = [t.encode() for t in _texts(random.Random(5), 260)]
    keys = np.arange(len(texts)) % 3 - 1
    edge = containing.EDGE
    known = containing.Needles(keys, np.array([len(t) for t in texts]), [t[:edge] for t in texts], [t[-edge:] for t in texts])
    got = set(known.inside(texts, keys))
    marks = [sha256(t).digest() for t in texts]
    held = {(i, marks[j]) for i, a in enumerate(texts) for j, b in enumerate(texts) if keys[i] == keys[j] and b in a}
    # what is left out has an edge in common, or is the whole text
    for i, mark in held - got:
        a, b = texts[i], texts[marks.index(mark)]
        assert a == b or len(b) >= containing.SURE and (a.startswith(b) or a.endswith(b))
    wrong = [x for x in got - held if x[1] in marks]
    assert len(held & got) > 200 and not wrong


def test_tries_grow_with_the_texts(monkeypatch):
    """Texts that all start alike and hold that start again aren't tried with each other, but by size."""
    rng = random.Random(2)
    head = "a start that all texts have, "
    texts = [(head + "".join(rng.choices("abcd ", k=60)) + head + "".join(rng.choices("abcd ", k=60))).encode() for _ in range(3000)]
    tried = []
    known = containing.Needles(np.zeros(3000, np.int64), np.array([len(t) for t in texts]), [t[:16] for t in texts], [t[-16:] for t in texts])
    among = known.ends.among
    monkeypatch.setattr(known.ends, "among", lambda x: tried.append(len(x)) or among(x))
    assert list(known.inside(texts, np.zeros(3000, np.int64))) == []
    assert sum(tried) < 3 * 3000


def test_met_equals_all_ranges():
    rng = random.Random(3)
    for _ in range(200):
        met, ranges = containing.Met(), []
        for _ in range(30):
            start = rng.randrange(40)
            end = start + rng.randrange(-5, 12)
            assert met.meets(start, end) == any(s <= end and start <= e for s, e in ranges)
            met.add(start, end)
            ranges.append((start, end))


def test_stripped_equals_white_space(spark):
    every = spark.createDataFrame([(chr(i),) for i in range(0x3100)], "c string")
    c = F.col("c")
    for t in (c, F.concat(c, F.lit("x "), c, F.lit("y"), c), F.concat(F.lit(" "), c, F.lit("b\n"), c, F.lit("\r\n"))):
        assert every.where(stripped(t) != F.regexp_replace(t, r"(?U)^\s+|\s+$", "")).count() == 0
    assert every.where(stripped(c) == "").count() == 25
