"""The registered queries that SQL cannot express, over whole tables, against plain definitions and held-out labels."""

import hashlib
import html
import os
import re
import zlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillspan.llm import queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    return {n: con.execute(f"SELECT * FROM '{SF}/{n}.parquet'").df() for n in ("documents", "labels", "pages")}


def rest(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.mark.parametrize("name,label,modulus,held,cut", [("op1_quality_classifier", "quality", 4, 2, 0.7), ("op6_toxicity", "toxic", 5, 0, 0.5)])
def test_classifiers_on_held_out_rows(spark, name, label, modulus, held, cut):
    sf = SF.replace("sf0.001", "sf0.01")  # the smaller table has too few labels to learn from
    known = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{sf}/labels.parquet'").fetchall())
    rows = queries.QUERIES[name](spark, sf).collect()
    assert len(rows) == duckdb.sql(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchall()[0][0]
    assert all(r["held_out"] == (rest(r["doc_id"], modulus) == held) and r["predicted"] == int(r["score"] >= cut) for r in rows)
    asked = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert sum(r["predicted"] == known[r["doc_id"]] for r in asked) >= 0.9 * len(asked) > 50


def test_language_on_held_out_rows(spark, tables):
    lang = {i: x for i, x in zip(tables["documents"]["doc_id"], tables["documents"]["lang"], strict=True)}
    rows = queries.QUERIES["op3_language_id"](spark, SF).collect()
    assert all(r["held_out"] == (rest(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in rows)
    asked = [r for r in rows if r["held_out"] and isinstance(lang[r["doc_id"]], str) and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in asked) >= 0.97 * len(asked) > 10


def test_mixing_columns(spark, tables):
    docs = tables["documents"]
    size = {i: len(WORD.findall((t or "").encode())) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    of = {i: s for i, s in zip(docs["doc_id"], docs["source"], strict=True)}
    total = {}
    for i, n in size.items():
        total[of[i]] = total.get(of[i], 0) + n
    from tests.llm.test_edges import shared

    want, taken = shared(total, 3), dict.fromkeys(total, 0)
    for r in queries.QUERIES["op5_source_mixing"](spark, SF).collect():
        i = r["doc_id"]
        assert (r["size"], r["source_size"]) == (size[i], total[of[i]]) and r["target"] == pytest.approx(want[of[i]], rel=1e-9)
        assert r["taken"] <= 3 * size[i] and (r["taken"] == 0 or r["taken"] % size[i] == 0)
        taken[of[i]] += r["taken"]
    largest = {s: max(n for i, n in size.items() if of[i] == s) for s in want}
    assert all(abs(taken[s] - want[s]) <= max(0.02 * want[s], largest[s]) for s in want)


def test_media_query(spark, tables):
    from quillspan.llm import media

    text = dict(zip(tables["documents"]["doc_id"], tables["documents"]["text"], strict=True))
    rows = queries.QUERIES["op9_media_columns"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        padded = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        stored = media.encode_png(padded)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == media.feature(padded)


def test_pages_keep_their_words_in_order(spark, tables):
    rows = {}
    for r in queries.QUERIES["media_pages"](spark, SF).collect():
        rows.setdefault(r["page_id"], []).append((r["position"], r["kind"], r["text"], r["address"]))
    for page, text in zip(tables["pages"]["page_id"], tables["pages"]["html"], strict=True):
        parts = sorted(rows.get(page, []), key=lambda p: p[0])
        assert [p[0] for p in parts] == list(range(len(parts)))
        bare = re.sub(r"(?s)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1>|<!DOCTYPE[^>]*>", "", text or "")
        bare = "".join(html.unescape(re.sub(r"<[^>]*>", "", bare)).split())
        assert "".join("".join(t for _, k, t, _ in parts if k == "text").split()) == bare
        assert len([1 for p in parts if p[1] == "image"]) == len(re.findall(r"<img\b", text or ""))


def test_token_query(spark, tables):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = dict(zip(tables["documents"]["doc_id"], tables["documents"]["text"], strict=True))
    for r in queries.QUERIES["op10_token_counts"](spark, SF).collect():
        t = text[r["doc_id"]] or ""
        n = len(whole.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 2048)


def test_pipeline_stages_one_by_one(spark, tables, tmp_path):
    from tests.llm.test_edges import held_items
    from tests.llm.test_neardup import reachable, shingles
    from tests.llm.test_substring import brute

    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    ending = corpus_pipeline.run(spark, SF).collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = columns or docs.columns
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"]: r for r in docs.collect()}
        if name != "source_mixing":
            assert docs.columns == columns
        if name == "quality_classifier":
            assert all(after[i] == before[i] for i in after) and 0.5 * len(before) < len(after) < len(before)
        elif name == "minhash_neardup":
            sets = {i: shingles(r["text"], 5) for i, r in before.items()}
            root = reachable(sorted(sets), sets, 80)
            assert after == {i: r for i, r in before.items() if root[i] == i}
        elif name == "substring_dedup":
            kept = {i: (gone, text) for i, _, gone, text in brute([(i, r["text"]) for i, r in before.items()], 13)}
            assert set(after) == set(before)
            assert all(after[i]["text"] == (text if gone else before[i]["text"]) for i, (gone, text) in kept.items())
        elif name == "benchmark_decontamination":
            bad = {d for d, *_ in held_items([(i, r["text"]) for i, r in before.items()], items)}
            assert after == {i: r for i, r in before.items() if i not in bad}
        else:
            assert docs.columns == [*columns, "size", "source_size", "target", "copies", "taken"]
            assert {i: tuple(r)[: len(columns)] for i, r in after.items()} == {i: tuple(r) for i, r in before.items()}
            assert sorted(map(tuple, after.values()), key=str) == sorted(map(tuple, ending), key=str)
