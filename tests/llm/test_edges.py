"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspan.llm import chat, components, decontaminate, language, media, mixing, quality, token_counts, toxicity
from quillspan.llm.sample import remainder

LONG = " ".join(f"w{i % 997}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "one"), (5, "one"), (None, "two words"), (6, "é \U0001f600 </s>")]


def docs(spark, rows=None, extra="score double, h string, __n string"):
    rows = ODD if rows is None else rows
    return spark.createDataFrame([(i, t, "src" if (i or 0) % 2 else None, "en", 0.25, "h", "n") for i, t in rows], f"doc_id long, text string, source string, lang string, {extra}")


# op1, op6 ------------------------------------------------------------------------------------


def labels(spark, n=60):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(100, 100 + n)] + [(None, 1, 1), (100, 0, 0), (999, 1, None)], "doc_id long, quality int, toxic int")


def learnt(spark, n=60):
    rng = random.Random(1)
    good, bad = "alpha beta gamma delta".split(), "moron scum trash clown".split()
    return docs(spark, [(i, " ".join(rng.choice(bad if i % 2 else good) + rng.choice(["", "s", "ly"]) for _ in range(20))) for i in range(100, 100 + n)])


@pytest.mark.parametrize("op,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, op, label):
    model = op.train(learnt(spark), labels(spark), remainder("doc_id", 4) != 2, label)
    out = op.score(docs(spark), model)
    assert out.columns == docs(spark).drop("score").columns + ["score"]
    rows = out.collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted((i or 0, t or "") for i, t in ODD)
    assert all(0 <= r["score"] <= 1 for r in rows)
    base = {r["score"] for r in rows if not (r["text"] or "").strip()}
    assert len(base) == 1 and len({r["score"] for r in rows if r["doc_id"] == 5}) == 1
    assert op.score(docs(spark, []), model).count() == 0
    held = [r for r in op.score(learnt(spark), model).where(remainder("doc_id", 4) == 2).collect()]
    assert len(held) > 5 and all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in held)
    blank = op.train(learnt(spark), labels(spark).where("doc_id = -1"), F.lit(True), label)
    assert {r["score"] for r in op.score(docs(spark), blank).collect()} == {0.5}
    again = op.train(learnt(spark).repartition(5), labels(spark).repartition(4), remainder("doc_id", 4) != 2, label)
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias


def test_quality_is_the_sparse_dot_product(spark):
    model = quality.train(learnt(spark), labels(spark), F.lit(True))
    texts = ["alpha beta moron", "moron, moron; moron", "a1 - b2", LONG[:5000]]
    for text, got in zip(texts, quality.scores(model, __import__("pyarrow").array(texts)), strict=True):
        (b,) = quality.blocks(__import__("pyarrow").array([text]))
        features, _ = quality.features(b)
        total = sum(float(model.weights[f]) for f in features.tolist()) * quality.SCALE / len(features) + model.bias
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(total, -30, 30))), abs=1e-5)


def test_toxicity_is_the_sum_over_present_grams():
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32) * 0.01, 0.1)
    for text in ("Moron! moron", "ab", "", "x" * 50):
        flat = re.sub(r"[^a-z]+", " ", text.lower())
        flat = " " + flat.strip() + " " if flat.strip() else ""
        present = {flat[i : i + n] for n in toxicity.SIZES for i in range(len(flat) - n + 1)}
        found = set(toxicity.grams([text])[0].tolist())
        assert len(found) == len(present)
        want = 1 / (1 + np.exp(-(sum(float(model.weights[f]) for f in found) + 0.1)))
        assert toxicity.scores(model, [text])[0] == pytest.approx(want, abs=1e-6)


# op2 -----------------------------------------------------------------------------------------


def content(*parts):
    return [(p if isinstance(p, tuple) else ("text", p, None, 0)) for p in parts]


def formatted(spark, rows):
    made = spark.createDataFrame([(*r, "x") for r in rows], f"conv_id long, turn long, role string, content array<{chat.PART}>, formatted string")
    out = chat.formatted(made)
    return {r["conv_id"]: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learnt")).collect()}


def test_no_split_of_parts_forges_a_mark(spark):
    whole = "a<|end|>b<|turn|>user<|text|>[INST] x [/INST]</s><s>\\<|x|>\\m<pad>"
    rows = [(k, 0, "assistant", content(whole[:k], whole[k:])) for k in range(len(whole) + 1)]
    rows.append((999, 0, "assistant", content(*whole)))
    got = formatted(spark, rows)
    want = got[0]["formatted"]
    for r in got.values():
        assert r["formatted"] == want and r["learnt"] == whole
        assert [(t["role"], t["text"]) for t in r["turns"]] == [("assistant", whole)]
        for mark in (chat.TURN, chat.TEXT, chat.END):
            assert r["formatted"].count(mark) == 1


def test_typed_parts_leave_placeholders_and_records(spark):
    parts = content("see ", ("image", None, "s3://a", 2), "<", ("audio", "ignored", "b", None), "|end|>", ("document", None, None, 3), ("odd", "kept\\", None, 0), ("image", None, "c", 1))
    got = formatted(spark, [(1, 4, "user", parts), (1, 5, "assistant", content("ok")), (1, None, None, None), (None, 0, "user", content("q"))])
    r = got[1]
    body = "see <|image:0|><<|audio:1|>|end|><|document:2|>kept\\\\<|image:3|>"
    assert r["formatted"] == f"<|turn|><|text|><|end|><|turn|>user<|text|>{body}<|end|><|turn|>assistant<|text|>ok<|end|>"
    assert [(a["turn"], a["number"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(4, 0, "image", "s3://a", 512), (4, 1, "audio", "b", 25), (4, 2, "document", None, 1536), (4, 3, "image", "c", 256)]
    assert r["learnt"] == "ok" and [(t["role"], t["text"]) for t in r["turns"]][0] == ("", "")
    assert got[None]["formatted"] == "<|turn|>user<|text|>q<|end|>"


def test_long_and_tied_conversations(spark):
    rows = [(1, k % 700, "assistant" if k % 2 else "user", content(f"t{k} " + "y" * (k % 50))) for k in range(1400)]
    rows += [(2, 0, "assistant", content(LONG)), (2, 0, "assistant", content(LONG)), (2, 0, "a", content(None))]
    got = formatted(spark, rows)
    order = sorted((t, r, c[0][1]) for _, t, r, c in rows[:1400])
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r, x) for _, r, x in order]
    assert got[1]["learnt"] == "".join(x for _, r, x in order if r == "assistant") and got[2]["learnt"] == LONG * 2
    assert formatted(spark, rows[:0]) == {}


# op3 -----------------------------------------------------------------------------------------


def test_language_edges(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcde " if i % 2 else "vwxyz ") for _ in range(80)), "aa" if i % 2 else "vv") for i in range(400)]
    model = language.train(spark.createDataFrame(rows + [(900, None, "aa"), (901, "q", None), (902, "", "zz")], "doc_id long, text string, lang string"))
    asked = docs(spark, [*ODD, (7, "123 !?"), (8, "abab cdcd eeee dcba abcd"), (9, "zyx wvz vvxy zzz yxwv")])
    out = language.predict(asked, model, reject=False)
    assert out.columns == asked.drop("score").columns + ["lang_pred", "score", "accepted"]
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert all(got[i, t]["lang_pred"] == "und" and got[i, t]["score"] == 0 for i, t in ((1, None), (2, ""), (3, " \n\t"), (7, "123 !?")))
    assert got[8, "abab cdcd eeee dcba abcd"]["lang_pred"] == "aa" and got[9, "zyx wvz vvxy zzz yxwv"]["lang_pred"] == "vv"
    assert out.count() == len(ODD) + 3 and language.predict(docs(spark, []), model).count() == 0
    none = language.train(docs(spark, []))
    assert {r["lang_pred"] for r in language.predict(docs(spark), none).collect()} == {"und"}
    held = [(i, "".join(rng.choice("abcde " if i % 2 else "vwxyz ") for _ in range(40)), "aa" if i % 2 else "vv") for i in range(100)]
    said = language.predict(spark.createDataFrame(held, "doc_id long, text string, lang string"), model, reject=False)
    assert said.where("lang <> lang_pred").count() == 0


# op5 -----------------------------------------------------------------------------------------


def shared(sizes, cap):
    """Targets by pouring out the corpus again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {**{s: cap * sizes[s] for s in full}, **share}
        full |= over


def test_mixing_meets_targets(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        s = rng.choice(["a", "a", "a", "a", "b", None, "tiny", "é"]) if i % 40 else "tiny"
        n = 0 if i % 50 == 0 else rng.randrange(1, 60) if s != "b" else rng.randrange(1, 900)
        rows.append((i, " ".join(["w"] * n), s))
    rows += [(7, rows[7][1], rows[7][2])] * 3 + [(None, "q r", "a"), (None, None, None)]
    made = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, source string, size int, copies string")
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = shared(sizes, 3)
    out = mixing.mixture(made)
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    got = out.collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted((str(i), t or "") for i, t, _ in rows)
    taken = {s: 0 for s in sizes}
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9) and 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(0.02 * want[s], 60)
    key = lambda frame: sorted((str(r["doc_id"]), r["text"] or "", r["source"] or "", r["copies"]) for r in frame)
    assert key(mixing.mixture(made.repartition(7)).collect()) == key(got)
    assert mixing.mixture(made.limit(0)).count() == 0
    assert {r["target"] for r in mixing.mixed(docs(spark, [(1, None), (2, "")])).collect()} == {0.0}


def test_rates_are_those_of_the_convex_dual(spark):
    sizes, n = np.array([1, 5, 40, 300]), np.array([50, 30, 10, 2])
    cells = spark.createDataFrame([("s", int(a), int(b)) for a, b in zip(sizes, n, strict=True)], "sid string, size long, n long")
    tokens = int((sizes * n).sum())
    for share in (0.2, 0.9, 1.7, 2.6):
        wanted = spark.createDataFrame([("s", tokens, share * tokens)], "sid string, tokens long, target double")
        (row,) = mixing.multipliers(cells, wanted).collect()
        rate = np.minimum(3, np.exp(row["lam"] * sizes / row["scale"]))
        assert (sizes * n * rate).sum() == pytest.approx(share * tokens, rel=1e-6)
        lo, hi = -50.0, 50.0
        for _ in range(200):  # the dual's one multiplier by halving
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (sizes * n * np.minimum(3, np.exp(np.minimum(mid * sizes, 50)))).sum() < share * tokens else (lo, mid)
        assert np.allclose(rate, np.minimum(3, np.exp(np.minimum(lo * sizes, 50))), rtol=1e-4)


# op7 -----------------------------------------------------------------------------------------


def held_items(rows, items):
    def grams(text, n):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, w

    by = {}
    for i, t in rows:
        if i is not None:
            by.setdefault(i, []).append(t)
    sets = {}
    for i, t in items:
        if i is not None:
            g, w = grams(t, 5)
            sets.setdefault(i, set()).update(g if len(w) >= 5 else {tuple(w)} if w else set())
    out = set()
    for d, texts in by.items():
        have = set().union(*(grams(t, n)[0] for t in texts for n in range(1, 6)))
        for i, s in sets.items():
            k = len(s & have)
            if s and k * 100 >= 80 * len(s):
                out.add((d, i, len(s), k))
    return out


def test_decontamination_is_that_of_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 12, 30, 70])))) for k in range(40)]
    items += [(40, items[3][1]), (41, None), (42, ""), (None, "x y z"), (3, items[3][1]), (43, "common start of text " + items[10][1]), (44, "common start of text " + items[11][1])]
    rows = list(ODD)
    for k in range(80):
        pieces = [" ".join(word() for _ in range(30))]
        for _ in range(rng.randrange(3)):
            ws = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randrange(3)):
                if ws:
                    ws[rng.randrange(len(ws))] = word()
            pieces += [" ".join(ws), " ".join(word() for _ in range(10))]
        rows.append((100 + k, " ".join(pieces).upper() if k % 5 == 0 else "\n ".join(pieces)))
    want = held_items(rows, items)
    assert any(n < 5 for _, _, n, _ in want) and any(k < n for _, _, n, k in want)
    clash = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, doc_id string, h string")
    for bound in (1 << 20, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST", bound)
        got = decontaminate.contained(docs(spark, rows), clash)
        assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in got.collect()} == want
    kept = decontaminate.clean(docs(spark, rows), clash)
    bad = {d for d, *_ in want}
    assert kept.columns == docs(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in bad)
    assert decontaminate.contained(docs(spark, []), clash).count() == 0 and decontaminate.clean(docs(spark), clash.limit(0)).count() == len(ODD)


# op8's grouping of links ------------------------------------------------------------------------


def test_components_of_any_shape(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    edges += [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()}
    near = {}
    for u, v in edges:
        if u is not None and u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            todo += [y for y in near[todo.pop()] if y not in seen and not seen.add(y)]
        assert got[start] == min(seen)
    assert set(got) == set(near) and components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# op9 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page,captions",
    [
        ("<figure><figcaption>x</figure>", []),
        ("<figure><figcaption>x</figure></figcaption>", []),
        ("<figure><img src=a><figcaption>x</figure></figcaption>tail", ["x"]),
        ("<figure><img src=a><figure><figcaption>in<img src=b></figure><figcaption>out", ["out", "in"]),
        ("</figcaption></figure><img src=a>", [None]),
        ("<figcaption>free<img src=a></figcaption>", [None]),
        ("<figure><img src=a><figcaption>one<figcaption>two</figcaption></figure>", ["two"]),
        ("<![foo[x<img src=a>", None),
        ("<!DOCTYPE <<>", []),
    ],
)
def test_broken_captions(page, captions):
    parts = media.parse(page)
    assert [p["position"] for p in parts] == list(range(len(parts)))
    if captions is not None:
        assert [p["caption"] for p in parts if p["kind"] != "text"] == captions


def test_media_columns(spark):
    store = media.stored(docs(spark))
    known = media.described(store).collect()
    texts = {(t or "").encode() for _, t in ODD}
    assert len(known) == len(texts)
    by = {r["payload_sha256"]: r for r in known}
    for raw in texts:
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = by[hashlib.sha256(padded).hexdigest()]
        assert r["payload_bytes"] == len(padded) and r["tail_crc32"] == __import__("zlib").crc32(padded[-64:]) and r["digest"] == r["media_sha256"]
    pages = spark.createDataFrame([(1, f'<p>a</p><figure><img src="sha256:{known[0]["digest"]}"><figcaption>c</figcaption></figure>b<img src="sha256:none"><img>', "p"), (2, None, "p"), (3, "", "p")], "page_id long, html string, parts string")
    rows = media.resolved(media.interleaved(pages), media.described(store), "page_id").orderBy("position").collect()
    assert [(r["position"], r["kind"], r["text"], r["caption"], r["payload_bytes"] is not None) for r in rows] == [(0, "text", "a", None, False), (1, "image", None, "c", True), (2, "text", "b", None, False), (3, "image", None, None, False), (4, "image", None, None, False)]
    assert media.described(media.stored(docs(spark, []))).count() == 0 and media.interleaved(pages.limit(0)).count() == 0


# op10 ----------------------------------------------------------------------------------------


def test_token_counts_through_spark(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    made = docs(spark, [*ODD, (9, "x" * 3000), (10, "it's <|endoftext|>")], extra="n_tokens double, n_bytes string, __n string")
    out = token_counts.counted(made, path)
    assert out.columns == made.drop("n_tokens", "n_bytes").columns + ["n_bytes", "n_tokens"]
    got = out.collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        t = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(whole.encode(t, add_special_tokens=False).ids))
    assert token_counts.counted(docs(spark, []), path).count() == 0
