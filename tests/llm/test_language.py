"""Language models keep every n-gram, whether they are broadcast whole or in ranges."""

import random

import numpy as np

from quillspan.llm import language


def rows(n=100):
    rng = random.Random(5)
    made = []
    for lang, letters in (("aa", "abcdefgh "), ("bb", "efghijkl "), ("zh", "".join(map(chr, range(0x4E00, 0x4E60))))):
        made += [(len(made) + i, "".join(rng.choice(letters) for _ in range(60)), lang) for i in range(n)]
    return made


def test_no_gram_is_dropped_and_ranges_agree(spark, monkeypatch):
    made = rows()
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    whole = language.train(docs)
    counted = sum(len(k) for k in whole.grams)
    monkeypatch.setattr(language, "HELD", counted)
    spread = language.train(docs)
    parts = list(spread.parts())
    assert len(parts) >= 3
    assert sum(len(k) for part, _, _ in parts for k in part.grams[1:]) + len(whole.grams[0]) == counted
    assert np.allclose(whole.mean, spread.mean) and np.allclose(whole.deviation, spread.deviation)
    new = [(i, t) for i, (_, t, _) in enumerate(made[::40])] + [(90, None), (91, ""), (92, "é 世 abc")]
    asked = spark.createDataFrame(new, "doc_id long, text string")
    a, b = ({r["doc_id"]: r for r in language.predict(asked, m).collect()} for m in (whole, spread))
    assert {k: (r["lang_pred"], r["accepted"]) for k, r in a.items()} == {k: (r["lang_pred"], r["accepted"]) for k, r in b.items()}
    assert all(abs(a[k]["score"] - b[k]["score"]) < 1e-6 for k in a)


def test_grams_beyond_the_old_bound_stay(spark):
    # more distinct n-grams than 2^18, with a rare language whose n-grams all have small counts
    rng = random.Random(6)
    hot = [(i, "".join(chr(rng.randrange(0x4E00, 0x6E00)) for _ in range(2000)), "zh") for i in range(150)]
    rare = [(1000 + i, "".join(rng.choice("abcdefgh ") for _ in range(80)), "aa") for i in range(12)]
    docs = spark.createDataFrame(hot + rare, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert len(model.grams[language.ORDER - 1]) > 1 << 18
    texts = [t for _, t, _ in rare]
    points, first, _ = language.letter_streams(texts, language.ORDER - 1)
    keys = language._keys(points, language.ORDER)[-1][language._own(points, first)]
    known = language._find(model.grams[-1], keys)[1]
    assert known.mean() > 0.8


def test_rare_language_has_a_threshold_and_few_texts_are_learnt(spark):
    # of 400 rare texts about 8 are set apart, of 300,000 others about 6,000: a pool of 2,000 rows holds about 3 rare ones
    rng = random.Random(7)
    rare = [(400_000 + i, "".join(rng.choice("rstuvw ") for _ in range(60)), "rare") for i in range(400)]
    docs = spark.createDataFrame(rare, "doc_id long, text string, lang string")
    hot = spark.range(300_000).selectExpr("id as doc_id", "concat('abcde fghij klmno ', translate(cast(id as string), '0123456789', 'abcdefghij')) as text", "'hot' as lang")
    apart = lambda i: spark.sql(f"select pmod(xxhash64({i}L, 'qqqqq xxxxx yyyyy zzzzz'), {language.CALIBRATION}) = 0").first()[0]
    alone = next(i for i in range(500_000, 500_900) if apart(i))
    one = spark.createDataFrame([(alone, "qqqqq xxxxx yyyyy zzzzz", "one")], "doc_id long, text string, lang string")
    model = language.train(docs.unionByName(hot).unionByName(one))
    assert model.langs == ["hot", "one", "rare"]
    assert np.isfinite(model.mean).tolist() == [True, False, True]
