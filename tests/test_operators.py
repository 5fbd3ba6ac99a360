"""Locating, matching, deduplication, spans and plans against plain Python definitions."""

import random
from difflib import SequenceMatcher
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from quillspan.operators import dedupe, locate, match, spans
from quillspan.plans import outcomes

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def hays(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "hay_id long, hay string")


def needles(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "needle_id long, needle string")


def test_cascade(spark):
    text = prose(1, 300)
    exact = text[500:700]
    middle = text[900:980] + text[1000:1100]
    fuzzy = "#" * 12 + text[1312:1500]
    found = {r["needle_id"]: r for r in locate.located(hays(spark, text, "other words"), needles(spark, exact, middle, fuzzy, "zz" * 30, "", text[20:26] + "~")).collect()}
    assert set(found) == {0, 1, 2}
    assert (found[0]["stage"], found[0]["start"], found[0]["length"], found[0]["score"]) == ("exact", 500, 200, 1.0)
    assert (found[1]["stage"], found[1]["start"], found[1]["length"]) == ("anchor", 900, 200)
    assert found[2]["stage"] == "fuzzy" and found[2]["start"] == 1312 and found[2]["score"] == pytest.approx(188 / 200)


def test_first_occurrence_and_many_needles(spark):
    text = prose(2, 120)
    twice = text + " | " + text
    many = [text[i : i + 90] for i in range(0, 400, 5)]
    many += [text[3:15], text[7:9], "nowhere at all"]
    got = {(r["needle_id"], r["hay_id"], r["start"]) for r in locate.located_natively(hays(spark, twice, "nothing"), needles(spark, *many)).where("stage = 'exact'").collect()}
    assert got == {(i, h, hay.find(n)) for i, n in enumerate(many) for h, hay in enumerate([twice, "nothing"]) if n in hay}


def test_seeds_and_clusters(spark):
    cut = locate.seeds(needles(spark, "abcdefghijklmnopqrstuvwxyz", "abcdefg", "")).collect()
    assert [(r["needle_id"], r["offset"], r["piece"]) for r in cut] == [(0, 0, "abcdefghijkl"), (0, 12, "mnopqrstuvwx")]
    assert locate.clustered([30, 0, 11, 12, 22], 12) == [(0, 2), (12, 2), (30, 1)]


def test_books_prefer_stage_then_spine(spark):
    text = prose(3, 200)
    passage = text[300:500]
    spoilt = text[:380] + "@@" + text[400:]
    docs = spark.createDataFrame([(0, "b", 0, spoilt), (1, "b", 1, "none"), (2, "b", 2, text), (3, "b", 3, text)], "hay_id long, book_id string, spine int, hay string")
    row = locate.located_in_books(docs, needles(spark, passage)).collect()
    assert [(r["hay_id"], r["stage"]) for r in row] == [(2, "exact")]


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_best_match(spark, monkeypatch, small):
    monkeypatch.setattr(match, "PAIRS", small)
    titles = spark.createDataFrame([(1, "Walden", "Thoreau"), (2, "the of", None), (3, "A Modern Utopia -- H. G. Wells", None), (4, "Nothing alike", None), (5, "Walden", "Somebody Else")], "key long, title string, author string")
    library = spark.createDataFrame([(1, "a", "Walden, or Life in the Woods", "Henry Thoreau"), (2, "b", "Walden Pond", "H. Thoreau"), (3, "c", "Modern Utopias", None)], "seq long, lib_key string, lib_title string, lib_author string")
    got = {r["key"]: r["lib_key"] for r in match.best_match(titles, library).collect()}
    assert got == {1: "a", 3: "c", 5: "a"}


def test_best_match_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(match, "PAIRS", 0)
    rng = random.Random(4)
    names = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    spoilt = ["".join(c if rng.random() < 0.85 else rng.choice("aeiou ") for c in n) for n in names]
    titles = spark.createDataFrame([(i, n, None) for i, n in enumerate(spoilt)], "key long, title string, author string")
    library = spark.createDataFrame([(i, str(i), n, None) for i, n in enumerate(names)], "seq long, lib_key string, lib_title string, lib_author string")
    got = {r["key"]: (r["lib_key"], round(r["score"], 9)) for r in match.best_match(titles, library).collect()}
    monkeypatch.setattr(match, "PAIRS", 1 << 20)
    assert got == {r["key"]: (r["lib_key"], round(r["score"], 9)) for r in match.best_match(titles, library).collect()}

    def tokens(x):
        return {w for w in x.lower().split() if w not in ("the", "a", "an", "of", "and", "in", "to", "for", "on", "s")}

    want = {}
    for i, n in enumerate(spoilt):
        a, key = tokens(n), " ".join(n.lower().split())
        best = (0.0, None)
        for j, m in enumerate(names):
            b = tokens(m)
            if a and b:
                score = max(len(a & b) / min(len(a), len(b)), SequenceMatcher(None, key, " ".join(m.split())).ratio())
                if score > best[0]:
                    best = (score, str(j))
        if best[0] >= 0.75:
            want[i] = (best[1], round(best[0], 9))
    assert got == want


def test_superseded_equals_fold(spark):
    rng = random.Random(9)
    rows = []
    for seq in range(400):
        s = rng.choice([None, *range(0, 200)])
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 6)))
        rows.append((f"t{rng.randrange(6)}", seq, s, None if s is None or rng.random() < 0.2 else s + rng.randrange(90), text))
    kept = []
    for c in rows:
        def loses(k, c=c):
            if k[0] != c[0] or k[2] is None or c[2] is None:
                return False
            overlap = k[2] <= (c[3] or c[2]) and c[2] <= (k[3] or k[2])
            a, b = sorted((k[4], c[4]), key=len)
            return overlap and (a in b or b.startswith(a[:20]) or b.endswith(a[-20:]))
        kept = [k for k in kept if not loses(k)] + [c]
    df = spark.createDataFrame(rows, "title string, seq long, loc_start int, loc_end int, text string")
    assert {r["seq"] for r in dedupe.without_superseded(df).collect()} == {k[1] for k in kept}


def test_small_anti_joins(spark):
    rows = spark.createDataFrame([(1, "b", 0, 10), (2, "b", 6, 20), (3, "c", 0, 10), (4, "b", 5, 5)], "row_id long, book_id string, start int, end int")
    known = spark.createDataFrame([("b", 0, 9)], "book_id string, start int, end int")
    assert {r[0] for r in dedupe.without_covered(rows, known).select("row_id").collect()} == {2, 3}
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert sorted((r["k"], r["op"]) for r in dedupe.snapshot_diff(a, b).collect()) == [(1, "removed"), (1, "removed"), (3, "added")]
    ids = spark.createDataFrame([(1, "b", "h-5", 5), (2, "b", "u-5", 5), (3, "b", "u-5", 5)], "seq long, book_id string, ann_id string, start int")
    taken = spark.createDataFrame([("b", "h-5")], "book_id string, ann_id string")
    assert [r["seq"] for r in dedupe.first_per_start(ids, taken).collect()] == [2]
    clips = spark.createDataFrame([("Highlight", "x"), ("Note", "x"), ("Underline", ""), ("Highlight", dedupe.LIMIT_NOTICE + " of")], "kind string, text string")
    assert dedupe.eligible(clips).count() == 1


def test_addresses(spark):
    runs = [([(4, "body"), (2, None), (1, None)], "Hello ", 0), ([(4, "body"), (2, None), (2, "em"), (1, None)], "big", 6), ([(4, "body"), (4, "p2"), (1, None)], "World", 9)]
    data = [([{"steps": [{"index": i, "assertion": a} for i, a in s], "text": t, "doc_start": d} for s, t, d in runs],)]
    df = spark.createDataFrame(data, f"runs array<{spans.RUN}>")
    at = lambda a, b: df.select(spans.range_address(F.lit("/6/8[ch]"), F.col("runs"), F.lit(a), F.lit(b))).first()[0]
    assert at(1, 5) == "epubcfi(/6/8[ch]!/4[body]/2/1,:1,:5)"
    assert at(2, 8) == "epubcfi(/6/8[ch]!/4[body]/2,/1:2,/2[em]/1:2)"
    assert at(6, 14) == "epubcfi(/6/8[ch]!/4[body],/2/2[em]/1:0,/4[p2]/1:5)"
    assert at(0, 6) == "epubcfi(/6/8[ch]!/4[body]/2/1,:0,:6)"
    parts = spark.range(1).select(spans.spine_index(F.lit("epubcfi(/6/8[ch]!/4,/1:0,/1:2)")), spans.spine_index(F.lit("nonsense")), spans.document_part(F.lit("epubcfi(/6/8!/4)"))).first()
    assert tuple(parts) == (3, None, "epubcfi(/6/8")


def test_outcomes_and_plan(spark):
    rows = spark.createDataFrame([(1, True, 1.0, False), (2, False, None, False), (3, False, 0.6, True), (4, False, 1.0, True), (5, False, 1.0, False), (6, False, 0.7, False)], "seq long, known_text boolean, score double, known_address boolean")
    name = lambda **k: [r["o"] for r in rows.select("seq", outcomes.to_addresses(**k).alias("o")).orderBy("seq").collect()]
    assert name() == ["duplicate", "miss", "weak", "duplicate", "found", "weak"]
    assert name(accept_weak=0.65) == ["duplicate", "miss", "weak", "duplicate", "found", "found"]
    many = spark.range(500).select((499 - F.col("id")).alias("seq"), F.lit("found").alias("outcome"), F.when(F.col("id") % 2 == 0, "t").alias("title"))
    planned = outcomes.plan(many, limit=7).orderBy("plan_seq").collect()
    assert [r["plan_seq"] for r in planned] == list(range(1, 8)) and [r["seq"] for r in planned] == [1, 3, 5, 7, 9, 11, 13]
    whole = outcomes.plan(many).collect()
    assert sorted(r["plan_seq"] for r in whole) == list(range(1, 501))
    assert outcomes.plan(many, limit=0).count() == 0
    with pytest.raises(ValueError):
        outcomes.plan(many, limit=-1)


def test_unlike_titles_make_no_candidates(spark):
    """Hexadecimal titles share many characters, but only equal ones can match."""
    names = [md5(str(i).encode()).hexdigest() for i in range(120)]
    library = [(i, f"k{i}", n, None) for i, n in enumerate(names[:100])]
    mine = spark.createDataFrame([(n, None, [n], n, [], [c + "1" for c in sorted(set(n))]) for n in names], "title string, author string, tokens array<string>, norm string, authors array<string>, bag array<string>")
    theirs = spark.createDataFrame([(i, k, n, [n], n, [], [c + "1" for c in sorted(set(n))]) for i, k, n, _ in library], "seq long, lib_key string, lib_title string, lib_tokens array<string>, lib_norm string, lib_authors array<string>, lib_bag array<string>")
    assert sorted((r["title"], r["seq"]) for r in match._candidates(mine, theirs, 0.75).collect()) == sorted((n, i) for i, _, n, _ in library)
