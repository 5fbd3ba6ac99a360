"""Units without Spark: hashes, signatures, models, counting and media against plain definitions."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspan.llm import language, media, neardup, quality, token_counts, toxicity
from quillspan.llm.tokens import blocks, letter_streams, shingle_sets, windows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab c\t\né\U0001f600\x85", max_size=25)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_and_shingles(texts, size):
    column, docs, seen = pa.array(texts, pa.string()), [], {}
    for b in blocks(column, size):
        w = words(b)
        for k in range(b.hi - b.lo):
            spans = slice(w.first[k], w.first[k + 1])
            found = [bytes(b.data[s:e]).decode() for s, e in zip(w.start[spans], w.stop[spans], strict=True)]
            docs.append(found)
            for word, h in zip(found, w.hash[spans].tolist(), strict=True):
                assert seen.setdefault(word, h) == h
    assert docs == [WORD.findall(t or "") for t in texts]
    assert len(set(seen.values())) == len(seen)
    sizes = [n for b in blocks(column, size) for n in np.diff(shingle_sets(b, 2)[1]).tolist()]
    lower = [WORD.findall((t or "").lower()) for t in texts]
    assert sizes == [len(set(zip(w, w[1:], strict=False))) if len(w) > 1 else len(w) for w in lower]


def test_windows_do_not_cross_documents():
    (b,) = blocks(pa.array(["a b c d", "b c d", "a b", None, "c d e"]))
    w = words(b)
    h, at = windows(w, 3)
    assert len(h) == 4 and h[1] == h[2] and w.doc[at].tolist() == [0, 0, 1, 4]


def signature(sets):
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    return neardup.super_minhash(np.array([x for s in sets for x in s], np.uint64), first)


def test_super_minhash_estimates_and_bands():
    rng = random.Random(1)
    gaps = []
    for _ in range(40):
        pool = [rng.getrandbits(64) for _ in range(400)]
        a, b = pool[:360], pool[40:]
        sig = signature([a, b])
        assert not (sig == np.uint64(2**64 - 1)).any()
        gaps.append((sig[0] == sig[1]).mean() - 0.8)
        assert (neardup.band_hashes(sig)[0] == neardup.band_hashes(sig)[1]).any()
    assert abs(np.mean(gaps)) < 0.02
    small = signature([[1, 2, 3, 4], [1, 2, 3, 4, 5], [], [9]])
    assert (neardup.band_hashes(small)[0] == neardup.band_hashes(small)[1]).any()
    # each element's permutation visits each slot once
    assert all(len(set(row.tolist())) > 200 for row in signature([[7]]))


def test_letter_streams():
    points, first, letters = letter_streams(["Ab1 c!", None, "", "é"], 2)
    text = "".join(map(chr, points))
    assert [text[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == ["  ab c ", "  ", "  ", "  é "] and letters.tolist() == [3, 0, 0, 1]


def test_kneser_ney_sums_to_one():
    text = "abracadabra abba cab"
    tables = []
    grams = {}
    points, first, _ = letter_streams([text], language.ORDER - 1)
    for i in range(language.ORDER - 1, len(points)):
        g = tuple(points[i - language.ORDER + 1 : i + 1].tolist())
        grams[g] = grams.get(g, 0) + 1
    for n in range(language.ORDER, 0, -1):
        tables.insert(0, (np.array(list(grams), np.uint32).reshape(-1, n), np.array([[float(c)] for c in grams.values()])))
        lower = {}
        for g in grams:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        grams = lower
    model = language.build(tables, ["x"])
    # behind a known context, all characters' probabilities sum to one, those that back off included
    chars = sorted({int(c) for c in points.tolist()})
    for context in ("abr", "aca", "cab"):
        total = 0.0
        for c in chars:
            stream = np.array([*map(ord, context), c], np.uint32)
            keys, left, p = language._keys(stream, language.ORDER), len(stream) - 1, 0.0
            for n in range(language.ORDER, 0, -1):
                at, hit = language._find(model.grams[n - 1], keys[n - 1][left : left + 1])
                if hit[0]:
                    total += np.exp(p + model.logp[n - 1][at[0], 0])
                    break
                at, hit = language._find(model.contexts[n - 2], keys[n - 2][left - 1 : left]) if n > 1 else (None, [False])
                p += model.backoff[n - 2][at[0], 0] if hit[0] else 0
        assert 0.9 < total <= 1.0 + 1e-6
    known, _ = language.entropies(model, [text])
    strange, _ = language.entropies(model, ["xyzzy qwop"])
    assert known[0, 0] < 2 < strange[0, 0]
    assert language.identify(language.Model([]), ["a", None])[0] == ["und", "und"]


def test_linear_models_learn():
    rng = random.Random(2)
    clean = ["".join(rng.choice("abcdef ") for _ in range(200)) for _ in range(120)]
    bad = [c[:100] + " moron " + c[100:] for c in clean[:60]]
    rows, y = [], []
    for t, label in [(t, 1) for t in bad] + [(t, 0) for t in clean[60:]]:
        f, doc = toxicity._present(*toxicity.grams([t]), toxicity.BITS)
        rows.append(f)
        y.append(label)
    have = [sum(np.bincount(f, minlength=1 << toxicity.BITS) for f, k in zip(rows, y, strict=True) if k == label) for label in (1, 0)]
    ratio = toxicity.ratios(*have, 60, 60)
    model = toxicity.fit(np.array(y), [f[ratio[f] != 0] for f in rows], ratio)
    s = toxicity.scores(model, ["x" * 3000 + " Moron! ", clean[0], "", None])
    assert s[0] > 0.5 and s[1] < 0.5 and s[2] == s[3]
    none = toxicity.fit(np.array([], int), [], np.zeros(16))
    assert none.bias == 0 and not none.weights.any()
    batch = pa.RecordBatch.from_arrays([pa.array(range(80)), pa.array([1, 0] * 40, pa.int32()), pa.array(["good words here indeed", "BAD!! BAD!! $$$ %%%"] * 40)], names=["doc_id", "y", "text"])
    f = next(quality._sparse(iter([batch])))
    q = quality.ftrl([(a, np.asarray(i.values, np.int64), np.asarray(x.values, float)) for a, i, x in zip(f["y"].to_pylist(), f["i"], f["x"], strict=True)], quality.SIZE)
    got = quality.scores(q, pa.array(["good words here", "BAD!! $$$", "", None, " \n"]))
    assert got[0] > 0.7 > 0.3 > got[1] and got[2] == got[3] == got[4]


COUNTER = token_counts.PieceCounter(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
WHOLE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_counts_are_the_library_s(text):
    assert COUNTER.count(text) == len(WHOLE.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["", None, "it's <|endoftext|> we'll <|startoftext|>x", "ΣΊΣΥΦΟΣ Σ", "é İ ẞ ß", "a\u0088b\u0085c​d e\x1ff", "x" * 5000, "日本語テキスト١٢٣", "🙂🙂 !!!???", "͸ Ᲊ", "don't DON'T 'tis 12345"])
def test_counts_of_odd_texts(text):
    assert COUNTER.count(text) == len(WHOLE.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.none(), st.text(max_size=300)))
def test_media_round_trip(text):
    payload = media.padded(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.rstrip(b"\0") == (text or "").encode().rstrip(b"\0")
    assert media.decode_png(media.encode_png(payload)) == payload
    assert media.feature(payload) == media.feature(bytes(payload))


def test_damaged_media():
    data = bytearray(media.encode_png(media.padded("abc")))
    data[45] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(data))


def test_html_parts():
    parts = media.parse('<p>One &amp; two<img src="SHA256:AB" alt="x">three</p><figure><video src="http://v"></video><figcaption>A <b>cap</b></figcaption></figure><script>no</script>tail<figure><img src="sha256:cd">')
    assert [(p["position"], p["kind"], p["text"], p["digest"], p["caption"]) for p in parts] == [
        (0, "text", "One & two", None, None),
        (1, "image", "x", "ab", None),
        (2, "text", "three", None, None),
        (3, "video", None, None, "A cap"),
        (4, "text", "tail", None, None),
        (5, "image", None, "cd", None),
    ]
    assert media.parse(None) == [] and media.parse("<<p") is not None
