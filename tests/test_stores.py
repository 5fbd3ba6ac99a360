"""Stores and book files that the tests write, read back; the flows on them against a plain fold."""

import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspan.catalogue import QUERIES
from quillspan.functions.markup import plain_text
from quillspan.functions.text import normal_map, normalized
from quillspan.operators import dedupe
from quillspan.plans import apply, flows, outcomes
from quillspan.sources import annotated, books, samples, sqlite, textlog
from quillspan.streaming import incremental
from quillspan.stores import ORACLES

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud".split()
PROSE = " ".join(f"{WORDS[i * 7 % 24]}{i}" for i in range(400))


def spread(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def test_sqlite_partitions_cover_all_rows(spark, tmp_path):
    rows = [(i - 3, float(i), "t" * i, b"b") for i in range(11)] + [(None, None, None, None)]
    path = samples.store(str(tmp_path / "a.db"), {"t": ("a INTEGER, b REAL, c TEXT, d BLOB", rows)})
    with sqlite3.connect(path) as con:
        con.execute("UPDATE t SET rowid = rowid - 6")
        con.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
        con.executemany("INSERT INTO keyed VALUES (?, ?)", [("x", 1), ("y", 2)])
    sqlite.table(spark, path, "t")
    read = lambda name, n: spark.read.format("quillspan_sqlite").option("path", path).option("table", name).option("partitions", n).load()
    for n in (1, 3, 4):
        assert sorted(map(tuple, read("t", n).collect()), key=str) == sorted([(a, b, c, bytearray(d) if d else None) for a, b, c, d in rows], key=str)
        assert sorted(map(tuple, read("keyed", n).collect())) == [("x", 1), ("y", 2)]
    assert read("t", 4).where("a > 0 and c is not null and b <= 6.0 and length(c) > 4").count() == 2
    with pytest.raises(Exception, match="no table"):
        read("nothing", 1).count()


def test_library_and_ground_truth(spark, tmp_path):
    rows = [("a1", "One", "X", "/b/one.epub"), ("a2", "Two", None, "/b/two.pdf"), ("a3", None, None, "/b/three.epub"), ("a4", "Four", None, None), ("a5", "Five", None, "/b/gone.epub")]
    path = samples.store(str(tmp_path / "lib.db"), {"ZBKLIBRARYASSET": ("ZASSETID TEXT, ZTITLE TEXT, ZAUTHOR TEXT, ZPATH TEXT", rows)})
    assert {r["key"] for r in sqlite.library(spark, path).collect()} == {"a1", "a2", "a4", "a5"}
    there = spark.createDataFrame([("/b/one.epub",), ("/b/two.pdf",), ("/b/three.epub",)], "path string")
    assert {r["key"] for r in sqlite.library(spark, path, there).collect()} == {"a1"}
    notes = spark.createDataFrame([("a1", "epubcfi(/6/4)", "t"), ("a1", None, "t"), ("a1", "other", "t"), ("a2", "epubcfi(/6/4)", "t")], "asset_id string, location string, text string")
    assert sqlite.ground_truth(notes, "a1").count() == 1
    addresses, texts = sqlite.known_keys(notes, normalized)
    assert addresses.count() == 3 and texts.count() == 2


@pytest.mark.parametrize("compression,trailing,size", [(1, False, 4096), (2, False, 4096), (2, True, 700), (1, True, 64)])
def test_palm_books(spark, tmp_path, compression, trailing, size):
    markup = ("<html><body><p>Curly “q” &amp; café " + PROSE + "</p><p>" + PROSE[:300] + "</p></body></html>").encode()
    at = spread(tmp_path / "books", "a.azw", samples.palm(markup, compression, trailing=trailing, size=size))
    (row,) = books.read_palm(spark, at).collect()
    text, first, last = plain_text(markup)
    assert row["reason"] is None and (row["text"], row["first"], row["last"], row["text_length"]) == (text, first, last, len(markup))


def test_unreadable_palm_books_say_why(spark, tmp_path):
    good = samples.palm(b"<p>x</p>")
    cases = {"locked": samples.palm(b"x", locked=2), "huff": samples.palm(b"x", compression=17480), "odd": samples.palm(b"x", compression=7), "coded": samples.palm(b"x", encoding=932), "not": b"nothing at all" * 20, "cut": good[:-4], "good": good}
    for name, content in cases.items():
        at = spread(tmp_path / "books", name, content)
    why = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in books.read_palm(spark, at).collect()}
    assert why.pop("good") is None
    assert why == {"locked": "encrypted (2)", "huff": "HUFF/CDIC compression", "odd": "unknown compression 7", "coded": "unknown encoding 932", "not": "not a PalmDB book", "cut": why["cut"]} and "declared" in why["cut"]


def test_back_references():
    assert books.lz77(bytes([97, 98, 99]) + (0x8000 | 3 << 3 | 4).to_bytes(2, "big")) == b"abcabcabca"
    assert books.lz77(bytes([3, 1, 2, 3, 0xE1])) == b"\x01\x02\x03 a"
    for data in (b"", b"aaaaaaaaaaaaaaaaaaaa", bytes(range(256)) * 2, PROSE.encode()):
        assert books.lz77(samples.packed(data)) == data
    with pytest.raises(books.Unreadable):
        books.lz77(bytes([0x80, 0x18]))


@pytest.mark.parametrize(
    "raw,encoding,text",
    [
        (b"a<br>b<br/>c<br />d", "utf-8", "a bc d"),
        (b"any<i>where</i> <!-- no --> x<!-- open", "utf-8", "anywhere  x"),
        (b"x<div", "utf-8", "x"),
        (b"x<divs", "utf-8", "x "),
        (b"&amp;&apos;&#x41;&#66;&nope;& &nbsp;.&shy;", "utf-8", "&&apos;AB&nope;&  ."),
        ("a­b c€".encode(), "utf-8", "ab c€"),
        (b"\xe2\x82", "utf-8", "�"),
        (b"\x93q\x94", "cp1252", "“q”"),
        (b"", "utf-8", ""),
        (None, "utf-8", ""),
    ],
)
def test_markup(raw, encoding, text):
    got, first, last = plain_text(raw, encoding)
    assert got == text and len(first) == len(last) == len(text) and all(a <= b for a, b in zip(first, last, strict=True))


def test_chunks_and_containers(spark, tmp_path):
    at = spread(tmp_path / "books", "a.json", samples.chunks([(100, "World"), (10, "Hello "), (50, "")]))
    (row,) = books.read_chunks(spark, at).collect()
    assert (row["text"], row["positions"], row["text_length"]) == ("Hello World", [*range(10, 16), *range(100, 105)], 104)
    for name, content in (("b/x", b"CONTshort"), ("b/y", b"CONTlonger"), ("b/z", b"other and very long"), ("c/q", b"CONT1"), ("c/p", b"CONT2")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    files = spark.read.format("binaryFile").load([str(tmp_path / "b"), str(tmp_path / "c")])
    assert sorted(r["path"].rsplit("/", 2)[1:] for r in books.containers(files).collect()) == [["b", "y"], ["c", "p"]]


def test_broken_documents_of_a_book(spark, tmp_path):
    pages = [("a", samples.page(["one", "two & three"])), ("b", "<html><body><p>open <b>bold</p><script>no</script>tail<p>next"), ("c", "no markup"), ("d", "<html><head><title>t</title></head><body id='x'>top<p id='q'>in</p> after</body></html>")]
    at = spread(tmp_path / "books", "a.epub", samples.epub(pages))
    spread(tmp_path / "books", "b.epub", b"no zip")
    rows = {(r["path"][-6:], r["idref"]): r for r in books.read_epub(spark, at).collect()}
    assert rows["b.epub", None]["reason"] and rows["a.epub", "c"]["reason"] == "no markup"
    assert rows["a.epub", "a"]["text"] == "onetwo & three" and rows["a.epub", "a"]["step"] == "/6/2[a]"
    assert "open bold" in rows["a.epub", "b"]["text"] and "no" not in rows["a.epub", "b"]["text"].split("tail")[0].replace("open bold", "")
    runs = rows["a.epub", "d"]["runs"]
    assert [(r["text"], r["doc_start"], [(s["index"], s["assertion"]) for s in r["steps"]]) for r in runs] == [("top", 0, [(4, "x"), (1, None)]), ("in", 3, [(4, "x"), (2, "q"), (1, None)]), (" after", 5, [(4, "x"), (3, None)])]


def test_cache_reads_new_files_only(spark, tmp_path):
    at, seen = spread(tmp_path / "books", "a.json", samples.chunks([(0, "one")])), []

    def read(session, paths):
        seen.append(sorted(p.rsplit("/", 1)[1] for p in paths))
        return books.read_chunks(session, paths)

    look = lambda: sorted(r["text"] for r in annotated.cached(spark, at, str(tmp_path / "kept"), read).collect())
    assert look() == ["one"] and look() == ["one"]
    spread(tmp_path / "books", "b.json", samples.chunks([(0, "two")]))
    assert look() == ["one", "two"] and seen == [["a.json"], ["b.json"]]


def test_reconstruction_with_rejects(spark, tmp_path):
    markup = b"<p>first passage of words</p><p> </p>"
    at = spread(tmp_path / "books", "a.azw", samples.palm(markup))
    palm = books.read_palm(spark, at)
    path = palm.first()["path"]
    shelf = [("B1", "One", "", path, "mobipocket", len(markup)), ("B2", "Two", "", path, "mobipocket", 7), ("B3", "Three", "", path, "pdf", None), ("B4", "Four", "", "/gone", "mobipocket", None)]
    shelf = spark.createDataFrame(shelf, "book_id string, title string, author string, path string, mime string, max_position long").withColumn("is_mobi", F.contains("mime", F.lit("mobi"))).withColumn("is_kfx", F.lit(False))
    note = lambda book, data, a, b, source="server_view": (source, data, f"{book}-PDOC-x", a, b, '{"created_time": 1714903872000}')
    notes = [note("B1", 1, 3, 15), note("B1", 12, 10, 24), note("B1", 1, 29, 33), note("B1", 3, 3, 15), note("B1", 1, 3, 15, "local_edit"), note("B2", 1, 3, 4), note("B3", 1, 3, 4), note("B4", 1, 3, 4), note("B9", 1, 3, 4)]
    notes = spark.createDataFrame(notes, "source string, dataset long, dataset_id string, start long, end long, serialized_payload string")
    clips, rejects = annotated.reconstructed(notes, annotated.opened(shelf, palm))
    assert sorted((r["title"], r["kind"], r["loc_start"], r["text"], str(r["added"])) for r in clips.collect()) == [("One", "Highlight", 3, "first passage", "2024-05-05 10:11:12"), ("One", "Underline", 10, "assage of words", "2024-05-05 10:11:12")]
    assert {r["title"]: r["reason"] for r in rejects.collect()} == {"Two": f"position space mismatch ({len(markup)} != app 7)", "Three": "unsupported format pdf", "Four": "no such file"}
    few, none = annotated.reconstructed(notes, annotated.opened(shelf, palm), title="oNE")
    assert few.count() == 2 and none.count() == 0
    assert annotated.opened(shelf).where("reason = 'no reader'").count() == 4


def test_plan_is_inserted_once_in_order(spark, tmp_path):
    columns = "Z_PK INTEGER, Z_ENT INTEGER, Z_OPT INTEGER, ZANNOTATIONDELETED INTEGER, ZANNOTATIONISUNDERLINE INTEGER, ZANNOTATIONSTYLE INTEGER, ZANNOTATIONTYPE INTEGER, ZPLABSOLUTEPHYSICALLOCATION INTEGER, ZPLLOCATIONRANGEEND INTEGER, ZPLLOCATIONRANGESTART INTEGER, ZANNOTATIONCREATIONDATE NUMERIC, ZANNOTATIONMODIFICATIONDATE NUMERIC, ZANNOTATIONASSETID TEXT, ZANNOTATIONCREATORIDENTIFIER TEXT, ZANNOTATIONLOCATION TEXT, ZANNOTATIONREPRESENTATIVETEXT TEXT, ZANNOTATIONSELECTEDTEXT TEXT, ZANNOTATIONUUID TEXT, ZFUTUREPROOFING6 TEXT, ZFUTUREPROOFING11 TEXT"
    path = samples.store(str(tmp_path / "w.db"), {"ZAEANNOTATION": (columns, []), "Z_PRIMARYKEY": ("Z_NAME TEXT, Z_MAX INTEGER", [("AEAnnotation", 40), ("Other", 7)])})
    rows = [(2, "a", "cfi2", "two", True, 3), (1, "a", "cfi1", "one", False, 0)]
    plan = spark.createDataFrame(rows, "plan_seq long, asset_id string, address string, matched_text string, is_underline boolean, spine int").withColumn("added", F.when(F.col("plan_seq") == 1, F.lit("2024-05-05 10:11:12").cast("timestamp")))
    assert apply.insert_annotations(plan, path, "maker", backup=str(tmp_path / "safe"), now=1714903872.0) == 2
    with sqlite3.connect(path) as con:
        got = con.execute("SELECT Z_PK, ZANNOTATIONLOCATION, ZANNOTATIONSTYLE, ZANNOTATIONISUNDERLINE, ZPLLOCATIONRANGESTART, typeof(ZANNOTATIONCREATIONDATE), ZANNOTATIONSELECTEDTEXT FROM ZAEANNOTATION ORDER BY 1").fetchall()
        assert got == [(41, "cfi1", 3, 0, 0, "real", "one"), (42, "cfi2", 0, 1, 3, "real", "two")]
        assert con.execute("SELECT Z_MAX FROM Z_PRIMARYKEY ORDER BY Z_NAME").fetchall() == [(42,), (7,)]
    (safe,) = (tmp_path / "safe").iterdir()
    with sqlite3.connect(safe) as con:
        assert con.execute("SELECT count(*) FROM ZAEANNOTATION").fetchone() == (0,)
    bad = plan.withColumn("asset_id", F.array("asset_id"))
    with pytest.raises(Exception):
        apply.insert_annotations(bad, path, "maker")
    with sqlite3.connect(path) as con:
        assert con.execute("SELECT count(*) FROM ZAEANNOTATION").fetchone() == (2,)
        assert con.execute("SELECT Z_MAX FROM Z_PRIMARYKEY WHERE Z_NAME = 'AEAnnotation'").fetchone() == (42,)


def test_outbox_and_codes(spark, tmp_path):
    path = samples.store(str(tmp_path / "o.db"), {"local_edit": (", ".join(f"{c} TEXT" for c in apply.OUTBOX), []), "narrow": ("a TEXT", [])})
    rows = spark.createDataFrame([("app.highlight-7", 1, "b-PDOC-", "{}", 5)], "annotation_id string, dataset long, dataset_id string, payload string, created_ms long")
    file = str(tmp_path / "codes.json")
    with pytest.raises(FileNotFoundError):
        apply.load_codes(file)
    apply.save_codes({"action": 2, "dirty_flag": 1}, file)
    assert apply.append_outbox(rows, path, apply.load_codes(file)) == 1
    with sqlite3.connect(path) as con:
        assert con.execute("SELECT annotation_id, action, dirty_flag, retry_count, created_time, modified_time FROM local_edit").fetchall() == [("app.highlight-7", "2", "1", "0", "5", "5")]
        con.execute("ALTER TABLE local_edit DROP COLUMN retry_count")
    with pytest.raises(apply.SchemaChanged, match="retry_count"):
        apply.append_outbox(rows, path, {"action": 2, "dirty_flag": 1})
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "only.sqlite").touch()
    assert apply.only_store(str(tmp_path), "*/only.sqlite").endswith("d/only.sqlite")
    with pytest.raises(FileNotFoundError):
        apply.only_store(str(tmp_path), "*/none.sqlite")


def test_saved_chunks_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a.json", [(5, "one"), (20, "é two")]), ("b.json", [])], "name string, chunks array<struct<pid: int, text: string>>")
    apply.save_chunks(rows, str(tmp_path))
    apply.save_chunks(rows, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["text_length"]) for r in books.read_chunks(spark, f"{tmp_path}/*.json").collect()}
    assert got == {"a.json": ("oneé two", 24), "b.json": ("", 0)} and len(list(tmp_path.iterdir())) == len([p for p in tmp_path.iterdir() if p.name in ("a.json", "b.json")])


def book(spark, texts):
    """Books of texts whose character i has position 10 + 2 i."""
    rows = [(b, t, [10 + 2 * i for i in range(len(t))]) for b, t in texts.items()]
    df = spark.createDataFrame(rows, "book_id string, text string, first array<int>").withColumn("last", F.col("first"))
    return df.withColumn("norm", normalized(F.col("text"))).withColumn("norm_map", normal_map(F.col("text")))


def test_highlights_to_positions(spark):
    place = lambda a, b: (10 + 2 * a, 10 + 2 * (b - 1))
    at = PROSE.index(" ", 700) + 1
    said = {1: PROSE[200:300], 2: PROSE[400:500], 3: PROSE[600:700], 4: "words that no book has anywhere at all", 5: "", 6: PROSE[200:260], 7: PROSE[900:1000], 8: PROSE[at : at + 100], 9: PROSE[1000:1020] + "#" * 55 + PROSE[1075:1150]}
    rows = spark.createDataFrame([(k, "B", t, k == 8) for k, t in said.items()] + [(20, "C", PROSE[200:300], False)], "seq long, book_id string, text string, is_underline boolean")
    known = [("B", *place(380, 480), "gone", "app.highlight-99"), ("B", 1, 2, PROSE[600:695], "app.note-1"), ("B", 5, 6, "far", f"app.underline-{place(at, at + 100)[0]}")]
    known = spark.createDataFrame(known, "book_id string, start int, end int, norm string, ann_id string")
    log = spark.createDataFrame([("B", PROSE[905:1000])], "book_id string, norm string")
    out = {r["seq"]: r for r in flows.highlights_to_positions(rows, book(spark, {"B": PROSE, "C": "nothing"}), known, log).collect()}
    assert {k: r["outcome"] for k, r in out.items()} == {1: "found", 2: "duplicate", 3: "duplicate", 4: "miss", 5: "empty", 6: "duplicate", 7: "echo", 8: "duplicate", 9: "weak", 20: "miss"}
    assert (out[1]["start"], out[1]["end"]) == place(200, 300)


def test_round_trip_with_corroboration(spark):
    text = PROSE + " | " + PROSE[100:160]
    n = len(PROSE) + 3
    rows = [(1, "B", 10 + 2 * 100, 10 + 2 * 159), (2, "B", 10 + 2 * n, 10 + 2 * (n + 59)), (3, "B", 10 + 2 * 300, 10 + 2 * 399), (4, "B", 1, 2)]
    rows = spark.createDataFrame(rows, "row_id long, book_id string, start int, end int")
    log = spark.createDataFrame([("B", PROSE[300:400])], "book_id string, norm string")
    out = flows.round_trip(rows, book(spark, {"B": text}), log)
    assert {r["row_id"]: (r["class"], r["corroborated"]) for r in out.collect()} == {1: ("exact", False), 2: ("close", False), 3: ("exact", True), 4: ("miss", False)}
    total = outcomes.validation(out).where("book_id is null").first()
    assert (total["total"], total["exact"], total["close"], total["miss"], total["corroborated"], total["passes"]) == (4, 2, 1, 1, 1, False)


def test_report(spark):
    rows = [("a", 1, "x" * 90, "miss", None), ("a", 2, "weak one", "weak", 0.7), ("b", 3, "q", "unmatched", None), ("b", 4, "q", "unmatched", None), ("a", 5, "q", "found", 1.0)]
    got = outcomes.report(spark.createDataFrame(rows, "title string, seq long, text string, outcome string, score double")).collect()
    assert sorted(tuple(r) for r in got) == [("a", "MISS", 1, "MISS: " + "x" * 70), ("a", "WEAK", 2, "WEAK (0.70): weak one"), ("b", "UNMATCHED", 3, "2 rows")]
    none = spark.createDataFrame([(None, 5), (5, 5), (4, 5)], "maximum int, n int")
    assert [r[0] for r in none.select(outcomes.same_space(F.col("n"), F.col("maximum"))).collect()] == [True, True, False]


def test_numbers_without_gaps(spark):
    rows = spark.range(1000).selectExpr("id % 7 as k", "id")
    got = outcomes.numbered(rows, [F.col("k"), F.col("id")], "n", 5).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(6, 1006)) and [(r["k"], r["id"]) for r in got] == sorted((i % 7, i) for i in range(1000))
    same = outcomes.numbered(spark.range(300).selectExpr("0 as k"), [F.col("k")])
    assert sorted(r["plan_seq"] for r in same.collect()) == list(range(1, 301))
    assert outcomes.numbered(spark.range(0).selectExpr("id as k"), [F.col("k")]).count() == 0


LOG = "﻿Title One (Doe, Jane)\r\n- Your Highlight on page xii | Location 100-105 | Added on Sunday, 5 May 2024 10:11:12\r\n\r\nsome passage\r\nof two lines\r\n==========\r\nTitle Two\r\n- Your Note on Location 7 | Added on Sunday, 5 May 2024 1:02:03\r\n\r\nmine\r\n==========\r\nBad\r\n- Your Guess on page 3\r\n\r\nx\r\n==========\r\none line\r\n==========\r\nT (A (b))\r\n- Your Bookmark on page 3 | location 0\r\n\r\n\r\n==========\r\nT\r\n- Your Underline | Added on Noday, 5 May 2024 10:11:12\r\n\r\nz"


def test_log_entries(spark):
    logs = spark.createDataFrame([("p", LOG)], "path string, value string")
    got = [(r["title"], r["author"], r["kind"], r["page"], r["loc_start"], r["loc_end"], r["added"] and r["added"].isoformat(), r["text"]) for r in textlog.parsed(logs).orderBy("seq").collect()]
    assert got == [
        ("Title One", "Doe, Jane", "Highlight", "xii", 100, 105, "2024-05-05T10:11:12", "some passage\nof two lines"),
        ("Title Two", None, "Note", None, 7, None, "2024-05-05T01:02:03", "mine"),
        ("T (A (b))", None, "Bookmark", "3", None, None, None, ""),
        ("T", None, "Underline", None, None, None, None, "z"),
    ]
    assert sorted(r["seq"] for r in textlog.rejected(logs).collect()) == [2, 3]
    lines = ["- Your Highlight", "- Your Highlight on page 3-4", "- Your Highlight on location 12-13 | Location 5", "- Your Highlight on page 3 | Location x", "- Your Highlight on page A", "- your highlight", "- Your Highlight | Added on ", "- Your Highlight | Location 5-6 | other", "- Your Highlight |Location 5|Added on a | b"]
    odd = spark.createDataFrame([(str(k), f"T\n{line}\n\nx") for k, line in enumerate(lines)], "path string, value string")
    assert {int(r["path"]): (r["loc_start"], r["loc_end"], r["page"]) for r in textlog.parsed(odd).collect()} == {0: (None, None, None), 1: (None, None, "3-4"), 2: (5, None, None), 8: (5, None, None)}


def test_new_logs_as_a_stream(spark, tmp_path):
    spread(tmp_path / "logs", "a.txt", LOG)
    out, kept = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        incremental.start(spark, str(tmp_path / "logs"), out, kept).awaitTermination(120)
    assert {r["title"] for r in spark.read.parquet(out).collect()} == {"Title One", "T"}
    spread(tmp_path / "logs", "b.txt", LOG + "\r\n==========\r\nTitle Three\r\n- Your Highlight on page 4\r\n\r\nnew\r\n==========\r\n")
    incremental.start(spark, str(tmp_path / "logs"), out, kept).awaitTermination(120)
    assert sorted(r["title"] for r in spark.read.parquet(out).collect()) == ["T", "Title One", "Title Three"]
    clips = textlog.read(spark, str(tmp_path / "logs"))
    assert textlog.distinct_titles(clips).first()["titles"] == 5 and textlog.titled(clips, "ONE").count() == 2
    assert {r["title"]: r["texts"] for r in textlog.texts_by_title(clips).collect()}["Title Two"] == ["mine", "mine"]


def test_changed_actions(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "id string, action int")
    diff = dedupe.snapshot_diff(rows.limit(0), rows)
    assert [r["id"] for r in dedupe.changed_actions(diff, rows.where("id = 'a'")).collect()] == ["b"]


def test_sample_stores_bypass_the_driver(spark, monkeypatch, tmp_path):
    """No row of a sample store is collected; an empty table is made all the same, and written again it's as before."""
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)
    tables = {"a": ("k INTEGER, t TEXT", spark.range(500).selectExpr("id", "if(id % 2 = 0, 'x' || id, null)")), "b": ("k INTEGER", spark.range(0))}
    for _ in range(2):
        path = samples.stored(str(tmp_path / "s.db"), tables)
    assert sorted(tuple(r) for r in sqlite.table(spark, path, "a").collect()) == [(k, None if k % 2 else f"x{k}") for k in range(500)]
    assert sqlite.table(spark, path, "b").count() == 0
    docs = spark.createDataFrame([(1, 0, "one"), (1, 1, None), (5, 6, "x")], "conv_id long, turn long, text string")
    docs.write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r["uuid"] for r in QUERIES["scan_highlights"](spark, str(tmp_path)).collect()] == ["1.0"]


def test_validation_has_every_conversation(spark, tmp_path):
    """Also one turn in five that the title's flow knows no book of, and those without conversation or turn."""
    rows = [(5, 0, "a first turn of five"), (5, 1, "its second turn"), (6, None, "a turn without its number"), (6, 0, "a numbered one"), (None, 0, "a turn of no conversation"), (None, 1, None), (7, 0, "again again"), (7, 1, "again")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(ORACLES["validate_addresses"]).fetchall()
    got = [tuple(r) for r in QUERIES["validate_addresses"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[0]: r[1] for r in got} == {"5": 2, "6": 2, "7": 2, "null": 1, None: 7}
