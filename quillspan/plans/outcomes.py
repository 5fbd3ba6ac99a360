"""What becomes of each annotation, the plan that follows, and reports on both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.spans import document_part
from quillspan.storage import written

ACCEPT = 0.85
#: Ranges of keys, about, in which rows are numbered.
RANGES = 200


def to_addresses(min_score: float = ACCEPT, accept_weak: float | None = None) -> Column:
    """Outcome of (known_text, score, known_address): duplicate text, miss, weak, duplicate address or found.

    A weak match is weak even if its address is known; with ``accept_weak`` one that scores at
    least that and isn't known is found after all.
    """
    taken = F.coalesce("known_address", F.lit(False))
    out = F.when(F.coalesce("known_text", F.lit(False)), "duplicate").when(F.col("score").isNull(), "miss")
    if accept_weak is not None:
        out = out.when((F.col("score") < min_score) & (F.col("score") >= accept_weak) & ~taken, "found")
    return out.when(F.col("score") < min_score, "weak").when(taken, "duplicate").otherwise("found")


def to_positions(min_score: float = ACCEPT) -> Column:
    """Outcome of (norm, echo, score, self_check, covered, similar, collides), tested in this order."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (
        F.when(F.coalesce("norm", F.lit("")) == "", "empty")
        .when(yes("echo"), "echo")
        .when(F.col("score").isNull(), "miss")
        .when(F.col("score") < min_score, "weak")
        .when(~yes("self_check"), "miss")
        .when(yes("covered") | yes("similar"), "duplicate")
        .when(yes("collides"), "duplicate")
        .otherwise("found")
    )


def same_space(text_length: Column, max_position: Column) -> Column:
    """Whether positions of text and catalogue count alike; an unknown maximum passes."""
    return max_position.isNull() | (text_length == max_position)


def plan(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The found rows (title, seq), in plan order with ``plan_seq`` from 1, at most ``limit``."""
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    found = rows.where("outcome = 'found'")
    order = [F.coalesce("title", F.lit("~")), F.col("seq")]
    if limit is not None:
        found = found.orderBy(*order).limit(limit)
    return numbered(found, order)


def numbered(rows: DataFrame, order: list[Column], name: str = "plan_seq", base: Column | int = 0) -> DataFrame:
    """``rows`` with base + 1, 2, ... in ``order``.

    Rows are dealt to about ``RANGES`` ranges of their keys and numbered within these; only the
    ranges' counts meet in one task. The bounds come from the rows themselves, by a hash, so that
    a task that runs again after a lost executor deals as the first did.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    keyed = written(rows.withColumn("__k", key), "numbered")
    each = max(1, keyed.count() // RANGES)
    bounds = keyed.where(F.pmod(F.xxhash64("__k"), F.lit(each)) == 0).agg(F.collect_set("__k").alias("__b"))
    dealt = keyed.crossJoin(F.broadcast(bounds)).withColumn("__p", F.size(F.filter("__b", lambda b: b <= F.col("__k")))).drop("__b")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__p").count().select("__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__s"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy("__k"))
    base = base if isinstance(base, Column) else F.lit(base)
    return dealt.withColumn("__r", own).join(F.broadcast(starts), "__p").withColumn(name, (base + F.col("__s") + F.col("__r")).cast("bigint")).drop("__k", "__p", "__s", "__r")


def outcome_counts(rows: DataFrame, by: str = "title") -> DataFrame:
    """One row for each ``by``, one column for each outcome."""
    names = ["found", "weak", "miss", "duplicate", "echo", "empty"]
    return rows.groupBy(by).agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in names])


def round_trip_class(start: Column, end: Column, got_start: Column, got_end: Column, tolerance: int = 2) -> Column:
    """exact within the tolerance at both ends, close if found elsewhere, miss if not found."""
    near = (F.abs(start - got_start) <= tolerance) & (F.abs(end - got_end) <= tolerance)
    return F.when(got_start.isNull(), "miss").when(near, "exact").otherwise("close")


def address_class(want: Column, got: Column) -> Column:
    """exact for the same address, close for another one in the same document, miss for any other or none."""
    same = F.coalesce(document_part(want) == document_part(got), F.lit(False))
    return F.when(F.coalesce(want == got, F.lit(False)), "exact").when(same, "close").otherwise("miss")


def validation(rows: DataFrame, by: str = "book_id", gate: float = 0.95) -> DataFrame:
    """Counts of ``class`` by book and, with a null book, in all; rate and whether it passes the gate.

    If the rows say what is ``corroborated``, that is counted too.
    """
    sure = [F.count_if("corroborated").alias("corroborated")] if "corroborated" in rows.columns else []
    counts = [*sure, F.count("*").alias("total"), *[F.count_if(F.col("class") == c).alias(c) for c in ("exact", "close", "miss")]]
    out = rows.rollup(by).agg(*counts)
    return out.withColumn("rate", F.col("exact") / F.col("total")).withColumn("passes", F.col("rate") >= gate)


def counts_by_title(clips: DataFrame) -> DataFrame:
    """(title, n) by falling n; of equal counts, the title seen first comes first."""
    return clips.groupBy("title").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).orderBy(F.desc("n"), "first_seq")


def report(rows: DataFrame, width: int = 70) -> DataFrame:
    """(title, kind, seq, line) for people: what was missed, what was weak, with its score, and what matched no book.

    ``rows``: (title, seq, text, outcome, score). A title without a book has one line with its number of rows.
    """
    said = F.left("text", F.lit(width))
    line = F.when(F.col("outcome") == "miss", F.concat(F.lit("MISS: "), said)).when(F.col("outcome") == "weak", F.concat(F.lit("WEAK ("), F.format_number("score", 2), F.lit("): "), said))
    single = rows.where(F.col("outcome").isin("miss", "weak")).select("title", F.upper("outcome").alias("kind"), "seq", line.alias("line"))
    lost = rows.where("outcome = 'unmatched'").groupBy("title").agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    return single.unionByName(lost.select("title", F.lit("UNMATCHED").alias("kind"), "seq", F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("line")))
