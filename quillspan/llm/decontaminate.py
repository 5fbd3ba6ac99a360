"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment.

A short item lies in a long document if at least ``PERCENT`` of the item's distinct shingles of
``SHINGLE`` words are the document's too; the document's size plays no part, so the similarity
that a pair of ordinary signatures estimates would be near 0. The search is therefore that of
containment MinHash: the small set is sketched by its k smallest hash values, the large one is
asked for each of them, and the share found estimates the containment.

Items are partitioned by the size n of their shingle set, in classes that double. A class has its
own k: what an item of its largest size may lack, and ``MEET`` more. A document that holds an item
has at least k less what that item may lack of its sketch, and this many a candidate must have; a
document that shares but one common shingle has not. So the search has no false negatives.

Documents' shingles are hashed and looked up among the sketches, which are broadcast only if their
counted number is at most ``BROADCAST``, and joined by hash otherwise; nothing of the documents is
shuffled in the first case. Verification compares the shingles themselves, of candidate documents only.

Everything is DataFrame operations. Defined cases: an item of fewer than ``SHINGLE`` words has its
whole sequence as its one shingle, and is found wherever its words stand in a row; null and
wordless texts have no shingle and match nothing; rows that share a doc_id or item_id are taken
together; null ids are left out; equal items are found each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

SHINGLE = 5
PERCENT = 80
#: Sketch entries that a candidate shares with an item of its class's largest size.
MEET = 2
#: Largest number of sketch entries (16 bytes each) that is broadcast.
BROADCAST = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _runs(words: Column, n: int, of) -> Column:
    """What ``of`` makes of each start of ``n`` neighbouring words; null if there are fewer."""
    return F.transform(F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))), of)


def _hashes(words: Column, lengths: list[int]) -> Column:
    """Hashes of a text's runs of each of the lengths."""
    none = F.array().cast("array<bigint>")
    of = lambda n: lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(n)])
    parts = [F.coalesce(_runs(words, n, of(n)), none) for n in lengths]
    return F.array_distinct(F.concat(*parts))


def _strings(words: Column, lengths: list[int]) -> Column:
    none = F.array().cast("array<string>")
    of = lambda n: lambda i: F.array_join(F.slice(words, i, n), " ")
    parts = [F.coalesce(_runs(words, n, of(n)), none) for n in lengths]
    return F.array_distinct(F.concat(*parts))


def _item_grams(items: DataFrame, shingle: int) -> DataFrame:
    """(item_id, gram, words): each item's distinct shingles, and of how many words they are."""
    ws = items.where("item_id is not null").select("item_id", word_array(F.col("text")).alias("ws")).where("size(ws) > 0")
    whole = F.array(F.array_join("ws", " "))
    own = F.when(F.size("ws") < shingle, whole).otherwise(_strings(F.col("ws"), [shingle]))
    return ws.select("item_id", F.explode(own).alias("gram"), F.least(F.size("ws"), F.lit(shingle)).alias("words")).distinct()


def _lack(n: Column, percent: int) -> Column:
    """How many of n shingles a document that holds the item may lack."""
    return (n - F.ceil(n * percent / 100)).cast("int")


def sketches(grams: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(item_id, n, need, h): each item's sketch, a row a hash, and how many of them a candidate has at least.

    ``n`` is the item's number of shingles; its class holds the sizes from 2^j to 2^(j+1) - 1.
    """
    word = lambda k: F.get(F.split("gram", " "), F.lit(k))
    hashed = F.xxhash64(*[word(k) for k in range(shingle)])
    for length in range(1, shingle):
        hashed = F.when(F.col("words") == length, F.xxhash64(*[word(k) for k in range(length)])).otherwise(hashed)
    sets = grams.groupBy("item_id").agg(F.array_sort(F.collect_set(hashed)).alias("hs"), F.count("*").alias("n"))
    largest = F.pow(F.lit(2), F.floor(F.log2(F.col("n").cast("double"))) + 1) - 1
    k = F.least(F.size("hs"), _lack(largest, percent) + MEET)  # a hash that two shingles share shortens the set
    need = F.greatest(F.lit(1), k - _lack(F.col("n"), percent))
    return sets.select("item_id", "n", need.alias("need"), F.explode(F.slice("hs", F.lit(1), k)).alias("h"))


def contained(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared) of all items that lie in a document."""
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    grams = written(_item_grams(items, shingle), "item-shingles")
    lengths = sorted(r[0] for r in grams.select("words").distinct().collect()) or [shingle]
    index = written(sketches(grams, shingle, percent), "item-sketches")
    small = index.count() <= BROADCAST
    found = docs.where("doc_id is not null and text is not null").select("doc_id", word_array(F.col("text")).alias("ws"))
    found = found.select("doc_id", F.explode(_hashes(F.col("ws"), lengths)).alias("h"))
    hits = found.join(F.broadcast(index) if small else index, "h")
    # rows that share a doc_id may have the same shingles
    met = hits.groupBy("doc_id", "item_id").agg(F.count_distinct("h").alias("hits"), F.first("need").alias("need"))
    candidates = written(met.where("hits >= need").select("doc_id", "item_id"), "candidates")

    suspects = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    held = suspects.select("doc_id", word_array(F.col("text")).alias("ws")).select("doc_id", F.explode(_strings(F.col("ws"), lengths)).alias("gram")).distinct()
    size = grams.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    pairs = candidates.join(grams.drop("words"), "item_id").join(held, ["doc_id", "gram"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    return pairs.join(size, "item_id").where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent).select("doc_id", "item_id", "n_shingles", "n_shared")


def clean(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` without those that hold an item; rows with a null doc_id stay."""
    bad = written(contained(docs, items, shingle, percent).select("doc_id").distinct(), "contaminated")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
