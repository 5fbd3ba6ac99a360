"""Normalising, parsing and similarity against plain Python definitions and hand-made cases."""

import random
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import functions as F

from quillspan.functions import markup
from quillspan.functions import payload as P
from quillspan.functions import text as X
from quillspan.functions.markup import plain_text
from quillspan.functions.similarity import similar
from quillspan.sources import textlog


def one(spark, expr, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first()
    return row["r"]


def reference_norm(s):
    fold = {c: k for k, v in X._FOLDS.items() for c in v}
    out, places = [], []
    for i, ch in enumerate(s):
        ch = fold.get(ch, ch)
        if ch == " ":
            if out and out[-1] != " ":
                out.append(" ")
                places.append(i)
        else:
            for c in ch.lower():
                out.append(c)
                places.append(i)
    if out and out[-1] == " ":
        out.pop()
        places.pop()
    return "".join(out), places


def test_normal_text_and_map(spark):
    rng = random.Random(3)
    alphabet = "aB \t\n'\"-.‘”—…  İ\U0001f600é"
    rows = [("".join(rng.choice(alphabet) for _ in range(rng.randrange(25))),) for _ in range(400)] + [("",), ("   ",)]
    got = spark.createDataFrame(rows, "t string").select("t", X.normalized(F.col("t")).alias("n"), X.normal_map(F.col("t")).alias("m")).collect()
    for r in got:
        assert (r["n"], r["m"]) == reference_norm(r["t"]), repr(r["t"])
    again = spark.createDataFrame([(r["n"],) for r in got], "t string").select("t", X.normalized(F.col("t")).alias("n")).collect()
    assert all(r["n"] == r["t"] for r in again)


def test_markers_titles_and_headings(spark):
    assert one(spark, X.without_markers, "a[3] b[*] c[*12] d[x] [**]") == "a b c d[x] [**]"
    assert one(spark, X.title_key, "The_Book: Été!  -- Author -- 1999") == "the book été"
    assert sorted(one(spark, X.title_tokens, "The art of the Art, and war")) == ["art", "war"]
    assert one(spark, X.title_tokens, "the of") == []
    assert one(spark, X.heading_title, "﻿Title (a) (Doe, Jane) ") == "Title (a)"
    assert one(spark, X.heading_author, "﻿Title (a) (Doe, Jane) ") == "Doe, Jane"
    assert one(spark, X.heading_author, "No author (nested (x))") is None
    assert one(spark, X.shares_edge, "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrst!") is True
    assert one(spark, X.shares_edge, "abc", "xyzw") is False


def test_dates(spark):
    assert str(one(spark, X.log_date, "Sunday, 5 May 2024 10:11:12")) == "2024-05-05 10:11:12"
    for bad in ("Sunday, May 5, 2024 10:11:12 AM", "Someday, 5 May 2024 10:11:12", "", "Sunday, 31 February 2024 1:1:1"):
        assert one(spark, X.log_date, bad) is None


LOG = (
    "﻿First (Doe, Jane)\r\n- Your Highlight on page 12 | Location 100-105 | Added on Sunday, 5 May 2024 10:11:12\r\n\r\nsome text\r\nmore\r\n==========\r\n"
    "Second\r\n- Your Note on Location 7 | Added on bad date\r\n\r\nnote\r\n==========\r\n"
    "Third\r\n- Your Bookmark on page xii | Location 0\r\n\r\n\r\n==========\r\n"
    "broken\r\n==========\r\nFourth\r\n- Votre surlignement\r\n\r\nx\r\n=========="
)


def test_log(spark, tmp_path):
    (tmp_path / "log.txt").write_bytes(LOG.encode())
    rows = textlog.read(spark, str(tmp_path / "log.txt")).orderBy("seq").collect()
    assert [(r["title"], r["author"], r["kind"], r["page"], r["loc_start"], r["loc_end"], r["text"]) for r in rows] == [
        ("First", "Doe, Jane", "Highlight", "12", 100, 105, "some text\nmore"),
        ("Second", None, "Note", None, 7, None, "note"),
        ("Third", None, "Bookmark", "xii", None, None, ""),
    ]
    assert rows[0]["added"] is not None and rows[1]["added"] is None
    logs = spark.createDataFrame([("p", LOG)], "path string, value string")
    assert textlog.rejected(logs).count() == 2
    assert textlog.texts_by_title(textlog.parsed(logs)).count() == 2


def test_similarity(spark):
    rng = random.Random(5)
    rows = [("", "a"), ("abc", "xabcx"), ("a" * 30, "b" * 10), (None, "x")]
    for _ in range(60):
        a = "".join(rng.choice("abc ") for _ in range(30))
        b = "".join(c if rng.random() > 0.15 else "z" for c in a)
        rows.append((a, b))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", similar(F.col("a"), F.col("b"), 0.8).alias("s")).collect()
    for r in got:
        a, b = r["a"] or "", r["b"] or ""
        want = bool(a and b) and (a in b or b in a or (abs(len(a) - len(b)) <= max(len(a), len(b)) * 0.2 and SequenceMatcher(a=a, b=b, autojunk=False).ratio() >= 0.8))
        assert r["s"] == want, (a, b)


def test_markup_text():
    text, first, last = plain_text(b"<p>a&amp;b&apos;<br>c<br />d<br/>e<!-- x --> &#x41;&nbsp;&shy;z<i>w</i> & &bad; \xc3\xa9\x80<unclosed")
    assert text == " a&b&apos; c de A zw & &bad; é�"
    assert first[1] == 3 and (first[2], last[2]) == (4, 8)
    assert plain_text(b"caf\xe9", "cp1252")[0] == "café"
    assert plain_text(b"a<br/>b", self_closing=True)[0] == "a b"
    assert plain_text(None) == ("", [], [])
    assert plain_text(b"x\xe2\x82")[0] == "x�"


def test_payload(spark):
    bad = spark.createDataFrame([('{"start_position":{"shortPosition":7},"end_position":{"shortPosition":9}}',), ('{"start_position":{"shortPosition":"7"}}',), ("{bad",)], "p string")
    s, e = P.positions(F.col("p"))
    assert [(r[0], r[1]) for r in bad.select(s, e).collect()] == [(7, 9), (None, None), (None, None)]
    styles = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 4, 5, 9, None)], "s int").select(P.colour(F.col("s"))).collect()
    assert [r[0] for r in styles] == ["yellow", "orange", "blue", "yellow", "pink", "blue", "yellow", "yellow"]
    assert one(spark, P.clean_id, "A:B00-0") == "B00"
    assert one(spark, P.content_type, "B012345678") == "EBOK"


def test_markup_is_handed_back_in_slices(spark, monkeypatch):
    """Rows come back in slices of few bytes, with what ``plain_text`` says of each, nulls and empty ones too."""
    sizes = [n for _, n in markup._slices(pa.array([b"x" * 600_000, None, b"", b"y" * 700_000, b"z" * 3_000_000, b"a"], pa.binary()))]
    assert sizes == [3, 1, 1, 1]
    rows = [(k, None if k % 7 == 0 else f"<p>{'é&amp;' * k}</p>x".encode()) for k in range(40)]
    got = markup.with_markup_stripped(spark.createDataFrame(rows, "k long, raw binary")).collect()
    assert {r["k"]: (r["text"], r["first"], r["last"]) for r in got} == {k: markup.plain_text(raw) for k, raw in rows}
