"""Best match of titles and authors between two catalogues."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import bounds
from quillspan.functions.similarity import ratio
from quillspan.functions.text import overlap, title_key, title_tokens
from quillspan.operators.locate import fanned
from quillspan.storage import written

# The least score, and what authors without a common word take from it.
THRESHOLD, PENALTY = 0.75, 0.25
#: Catalogues of at most so many pairs, counted first, are compared pair by pair.
PAIRS = 1 << 22
#: Titles and library rows, about, of a block; two blocks meet in one task.
TITLES, LIBRARY = 1 << 11, 1 << 14


def _bag(text: Column) -> Column:
    """The characters of a text, each with its number among its equals, so that bags become sets."""
    sorted_chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.transform(sorted_chars, lambda c, i: F.concat(c, (i + 1 - F.array_position(sorted_chars, c)).cast("string")))


def _pairs_of(text: Column) -> Column:
    """The pairs of neighbouring characters of a text, numbered like ``_bag``."""
    two = F.array_sort(F.transform(F.when(F.length(text) > 1, F.sequence(F.lit(1), F.length(text) - 1)), lambda i: F.substring(text, i, F.lit(2))))
    return F.coalesce(F.transform(two, lambda c, i: F.concat(c, (i + 1 - F.array_position(two, c)).cast("string"))), F.array().cast("array<string>"))


def _ranked(sets: DataFrame, freq: DataFrame, keep: Column) -> DataFrame:
    """``sets`` (..., items) with ``all`` items and the ``prefix``: the ``keep`` rarest of its ``size`` items."""
    names = [c for c in sets.columns if c != "items"]
    each = sets.select(*names, F.explode("items").alias("item")).join(freq, "item")
    found = each.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("ranked"))
    found = found.withColumn("size", F.size("ranked"))
    return found.select(*names, F.transform("ranked", lambda x: x["item"]).alias("all"), F.transform(F.slice("ranked", F.lit(1), keep.cast("int")), lambda x: x["item"]).alias("prefix"))


def _met(mine: DataFrame, theirs: DataFrame, left: str, right: str) -> DataFrame:
    a = mine.select("title", "author", F.explode(left).alias("item"))
    b = theirs.select("seq", F.explode(right).alias("item"))
    return a.join(b, "item").select("title", "author", "seq").distinct()


def _overlapping(mine: DataFrame, theirs: DataFrame, threshold: float) -> DataFrame:
    """(title, author, seq) of all pairs whose overlap can reach the threshold.

    Of the smaller token set at least the share ``threshold`` is common, so the rarest tokens of
    one of the two, as many as may be missing and one more, meet a token of the other.
    """
    share = F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - 1e-9) + 1
    a = mine.select("title", "author", F.col("tokens").alias("items"))
    b = theirs.select("seq", F.col("lib_tokens").alias("items"))
    freq = a.select(F.explode("items").alias("item")).unionByName(b.select(F.explode("items").alias("item"))).groupBy("item").agg(F.count("*").alias("n"))
    a, b = _ranked(a, freq, share), _ranked(b, freq, share)
    return _met(a, b, "prefix", "all").unionByName(_met(a, b, "all", "prefix")).distinct()


def _near(threshold: float):
    """Two blocks of titles to the pairs whose longest common subsequence, which no ratio exceeds, reaches the threshold."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = sorted(left["norm"].to_pylist(), key=len), sorted(right["lib_norm"].to_pylist(), key=len)
        sizes, out = bounds.lengths(b), ([], [])
        for at in range(0, len(a), 512):
            part = a[at : at + 512]
            low, high = len(part[0]) * threshold / (2 - threshold), len(part[-1]) * (2 - threshold) / threshold
            theirs = b[int(np.searchsorted(sizes, low - 1e-6)) : int(np.searchsorted(sizes, high + 1e-6, "right"))]
            if not theirs:
                continue
            least = threshold * (bounds.lengths(part)[:, None] + bounds.lengths(theirs)) / 2 - 1e-6
            words, may = bounds.Words(theirs), bounds.shared(part, theirs, 1) >= least
            for i, mine in enumerate(part):
                rows = np.flatnonzero(may[i])
                if not len(rows):
                    continue
                if len(mine) <= 64:
                    reach = words.common(mine, rows)
                else:
                    masks = bounds.masks(mine)
                    reach = np.array([bounds.common(masks, len(mine), theirs[j]) for j in rows])
                for j in rows[reach >= least[i][rows]]:
                    out[0].append(mine)
                    out[1].append(theirs[j])
        return pa.table({"norm": pa.array(out[0], pa.string()), "lib_norm": pa.array(out[1], pa.string())})

    return run


def _alike(mine: DataFrame, theirs: DataFrame, threshold: float) -> DataFrame:
    """(title, author, seq) of all pairs whose ratio can reach the threshold.

    All pairs are examined, block by block over all tasks, as titles without common words have
    no key by which alike ones alone would meet; a block has a bounded number of titles.
    """
    a, b = written(mine.select("norm").distinct(), "titles"), written(theirs.select("lib_norm").distinct(), "library")
    down, across = max(1, -(-a.count() // TITLES)), max(1, -(-b.count() // LIBRARY))
    x = a.withColumn("__i", F.pmod(F.xxhash64("norm"), F.lit(down))).withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(across - 1)).cast("array<bigint>")))
    y = b.withColumn("__j", F.pmod(F.xxhash64("lib_norm"), F.lit(across))).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(down - 1)).cast("array<bigint>")))
    met = x.groupBy("__i", "__j").cogroup(y.groupBy("__i", "__j")).applyInArrow(_near(threshold), "norm string, lib_norm string")
    return written(met, "alike").join(mine.select("title", "author", "norm"), "norm").join(theirs.select("seq", "lib_norm"), "lib_norm").select("title", "author", "seq")


def _candidates(mine: DataFrame, theirs: DataFrame, threshold: float) -> DataFrame:
    """(title, author, seq) of all pairs that can be a title's best match.

    A library row of full overlap, whose author isn't another, can't be bettered, so that only
    other titles are searched for alike ones.
    """
    met = written(_overlapping(mine, theirs, threshold), "overlapping")
    both = met.join(mine.select(F.col("title").alias("__t"), F.col("author").alias("__a"), "tokens", "authors"), (F.col("title") == F.col("__t")) & F.col("author").eqNullSafe(F.col("__a"))).join(theirs.select("seq", "lib_tokens", "lib_authors"), "seq")
    full = both.where((overlap(F.col("tokens"), F.col("lib_tokens")) >= 1) & ~_apart())
    full = written(full.groupBy("title", "author").agg(F.min("seq").alias("seq")), "settled")
    done = full.select(F.col("title").alias("__t"), F.col("author").alias("__a"))
    rest = lambda rows: rows.join(done, (F.col("title") == F.col("__t")) & F.col("author").eqNullSafe(F.col("__a")), "left_anti")
    return full.unionByName(rest(met)).unionByName(_alike(rest(mine), theirs, threshold)).distinct()


def _apart() -> Column:
    """Whether both authors are known and share no word."""
    return (F.size("authors") > 0) & (F.size("lib_authors") > 0) & ~F.arrays_overlap("authors", "lib_authors")


def best_match(titles: DataFrame, library: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, lib_key, score): for each title (key, title, author) its best library row, if any is good enough.

    ``library`` has (seq, lib_key, lib_title, lib_author); the row with the smallest seq wins a tie. The
    score is the larger of token overlap and sequence ratio, less a penalty if both authors are
    known and share no word. A title without meaningful words matches nothing. Titles are
    compared once each, however many rows carry them, and, unless both sides are small, only with
    library rows that share enough of their rare words or, if none has all of these, characters.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie above 0 and not above 1")
    author_tokens = lambda c: title_tokens(F.coalesce(F.col(c), F.lit("")))
    mine = titles.select("title", "author").distinct().withColumn("tokens", title_tokens(F.col("title"))).withColumn("norm", title_key(F.col("title"))).withColumn("authors", author_tokens("author")).where(F.size("tokens") > 0).withColumn("bag", _bag(F.col("norm"))).withColumn("two", _pairs_of(F.col("norm")))
    theirs = library.select("seq", "lib_key", "lib_title", "lib_author").withColumn("lib_tokens", title_tokens(F.col("lib_title"))).withColumn("lib_norm", title_key(F.col("lib_title"))).withColumn("lib_authors", author_tokens("lib_author")).where(F.size("lib_tokens") > 0).withColumn("lib_bag", _bag(F.col("lib_norm"))).withColumn("lib_two", _pairs_of(F.col("lib_norm")))
    pairs = mine.count() * theirs.count()
    met = _candidates(mine, theirs, threshold).toDF("__t", "__a", "__s") if pairs > PAIRS else None
    both = fanned(mine, "title", "author").crossJoin(F.broadcast(theirs)) if met is None else met.join(mine, (F.col("__t") == F.col("title")) & F.col("__a").eqNullSafe(F.col("author"))).join(theirs, F.col("__s") == F.col("seq"))
    fine = both.withColumn("less", F.when(_apart(), PENALTY).otherwise(0.0)).withColumn("shared", overlap(F.col("tokens"), F.col("lib_tokens")))
    # a full overlap can't be bettered by the ratio, which is bounded by the lengths, by the characters in
    # common, and by the pairs in common: m matched characters have at least 3 m - a - b - 1 of these
    a, b = F.length("norm"), F.length("lib_norm")
    bound = 2 * F.least(a, b) / F.greatest(a + b, F.lit(1))
    least = (threshold + F.col("less")) * (a + b) / 2 - 1e-6
    common = lambda x, y: F.size(F.array_intersect(x, y))
    useful = (F.col("shared") < 1) & (bound - F.col("less") >= threshold) & (bound > F.col("shared"))
    useful = useful & F.when(useful, common("bag", "lib_bag") >= least).otherwise(False)
    useful = useful & F.when(useful, common("two", "lib_two") >= 3 * least - a - b - 1).otherwise(False)
    fine = fine.withColumn("useful", useful).where("useful or shared - less >= " + repr(float(threshold)))
    fine = fanned(fine.select("title", "author", "seq", "lib_key", "norm", "lib_norm", "less", "shared", "useful"), "title", "seq")
    useful = F.col("useful")
    like = F.coalesce(ratio(F.when(useful, F.col("norm")), F.when(useful, F.col("lib_norm"))), F.lit(0.0))
    fine = fine.withColumn("score", F.greatest(F.col("shared"), like) - F.col("less")).where((F.col("score") >= threshold) & (F.col("score") > 0))
    best = fine.groupBy("title", "author").agg(F.max_by(F.struct("lib_key", "score", "seq"), F.struct("score", -F.col("seq"))).alias("m"))
    best = best.select(F.col("title").alias("__t"), F.col("author").alias("__a"), "m.lib_key", "m.score")
    return titles.join(best, (F.col("title") == F.col("__t")) & F.col("author").eqNullSafe(F.col("__a"))).select("key", "lib_key", "score")
