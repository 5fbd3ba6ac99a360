"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document starts at rate 1. Among all rates of at most ``CAP``, those nearest to 1 in
relative entropy that meet each source's token target are exponentially tilted,
rate = min(CAP, exp(lambda * size / scale)), with one multiplier a source: the maximiser of a
concave dual. Since a rate depends only on source and size, documents are first counted by
(source, size), which also sums a hot source before anything else is shuffled; the Newton
iterations then run, for all sources at once, as one distributed aggregation each. They are
safeguarded by a bracket, so that capped and flat duals converge too. Sums are exact decimals,
so that no order of execution changes a multiplier.

Rates become copies by systematic rounding along increasing size: the cumulated rates of a
source are rounded at whole numbers, so that every prefix holds the right number of copies to
within one. Where the counting starts is chosen, for each source, among ``OFFSETS`` places
by the exact tokens that follow from it.
Documents of one source and size are numbered in hashed sub-groups whose number follows the
group, so that a hot group is neither sorted nor numbered in one task.

Targets: sources in order of code point, null last, weigh 1, 2, 3, 1, ...; they share the
corpus in that proportion, but stop at ``CAP`` times their own size, the excess being shared
again by weight among the others.

Defined cases: null text has size 0 and takes nothing; rows of one doc_id are rounded each
(equal rows may then differ in copies, but the multiset of results is the same on every run);
a corpus without words has targets of 0. ``mixed`` returns the columns it names, ``mixture`` all
columns of the documents, of which those named like its own give way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

CAP = 3
ITERATIONS = 60
#: Largest relative error of a source's expected tokens at which the iterations end.
PRECISION = 1e-7
#: Places tried to round a source's cumulated rates from.
OFFSETS = 32
#: Least number of documents of one source and size that are numbered together.
TOGETHER = 256
_WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, the number of words of the whole text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, tokens, weight, target) from (source, tokens): one row a source, so one small window."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    t = sizes.withColumn("weight", (F.pmod(rank - 1, F.lit(3)) + 1).cast("double"))
    full = F.col("tokens").cast("double") * cap
    by_cap = Window.orderBy((F.col("tokens") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    t = t.withColumn("total", F.sum("tokens").over(everything).cast("double"))
    # the share of weight 1 if all sources with a lower cap for their weight are full, and this one isn't
    t = t.withColumn("unit", (F.col("total") - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    t = t.withColumn("open", F.col("unit") * F.col("weight") < full)
    level = F.min(F.when(F.col("open"), F.struct(F.col("tokens") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("unit")))).over(everything)["unit"]
    return t.withColumn("level", level).select("source", "tokens", "weight", F.when(F.col("level").isNull(), full).otherwise(F.least(full, F.col("level") * F.col("weight"))).alias("target"))


def _exact(value) -> F.Column:
    return F.sum(value.cast("decimal(38,9)")).cast("double")


def multipliers(cells: DataFrame, wanted: DataFrame, cap: int = CAP) -> DataFrame:
    """(sid, lam, full): Newton iterations on the dual, over (sid, size, n) and (sid, tokens, target)."""
    start = cells.groupBy("sid").agg(_exact(F.col("n") * F.col("size").cast("double") * F.col("size")).alias("square"))
    state = wanted.join(start, "sid").where("tokens > 0").select(
        "sid",
        "tokens",
        "target",
        (F.col("square") / F.col("tokens")).alias("scale"),
        (F.col("target") >= F.col("tokens") * cap * (1 - 1e-9)).alias("full"),
    )
    state = state.withColumn("lam", F.when(F.col("target") > 0, F.log(F.col("target") / F.col("tokens"))).otherwise(F.lit(-700.0)))
    state = written(state.withColumn("lo", F.lit(-float("inf"))).withColumn("hi", F.lit(float("inf"))).withColumn("error", F.lit(1.0)), "multipliers")
    x = F.col("size") / F.col("scale")
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * x, F.lit(50.0))))
    tokens = F.col("n") * F.col("size") * rate
    slope = F.when(rate < cap, tokens * x).otherwise(F.lit(0.0))
    for _ in range(ITERATIONS):
        held = cells.join(state.where("not full").select("sid", "lam", "scale"), "sid").groupBy("sid").agg(_exact(tokens).alias("got"), _exact(slope).alias("slope"))
        s = state.join(held, "sid", "left")
        over = F.col("got") - F.col("target")
        s = s.withColumn("error", F.when(F.col("full") | (F.col("target") <= 0), F.lit(0.0)).otherwise(F.abs(over) / F.col("target")))
        s = s.withColumn("lo", F.when(over < 0, F.greatest("lo", "lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(over > 0, F.least("hi", "lam")).otherwise(F.col("hi")))
        newton = F.when(F.col("slope") > 0, F.col("lam") - over / F.col("slope"))
        wide = F.lit(float("inf"))
        middle = F.when((F.col("lo") > -wide) & (F.col("hi") < wide), (F.col("lo") + F.col("hi")) / 2).when(F.col("lo") > -wide, F.col("lo") + F.abs("lo") * 2 + 1).otherwise(F.col("hi") - F.abs("hi") * 2 - 1)
        inside = newton.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton - F.col("lam")) <= 20)
        s = s.withColumn("lam", F.when(F.col("error") <= PRECISION, F.col("lam")).when(inside, newton).otherwise(middle))
        state = written(s.select("sid", "tokens", "target", "scale", "full", "lam", "lo", "hi", "error"), "multipliers")
        if not state.where(F.col("error") > PRECISION).limit(1).count():
            break
    return state.select("sid", "lam", "scale", "full")


def _offsets(rated: DataFrame) -> DataFrame:
    """(sid, offset): of ``OFFSETS`` places to round from, the one that brings a source nearest to its target."""
    found = []
    for k in range(OFFSETS):
        u = F.lit((k + 0.5) / OFFSETS)
        copies = F.floor(F.col("before") + F.col("n") * F.col("rate") + u) - F.floor(F.col("before") + u)
        found.append(F.struct(F.abs(F.sum(copies * F.col("size")) - F.first("target")).alias("miss"), F.lit(abs(k - OFFSETS // 2)).alias("k"), u.alias("offset")))
    return written(rated.groupBy("sid").agg(F.array_min(F.array(*found))["offset"].alias("offset")), "mix-offsets")


def mixture(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """``docs``, whole, with size, source_size, target, copies and taken (words, repeats counted)."""
    added = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*added)
    rates = mixed(docs, cap).withColumn("taken", F.col("copies") * F.col("size"))
    # equal rows are one key, and take what its rows have, in any order
    number = F.row_number().over(Window.partitionBy("__id", "__h").orderBy(F.lit(1)))
    whole = docs.withColumn("__id", F.col("doc_id")).withColumn("__h", F.xxhash64("doc_id", "text", "source")).withColumn("__n", number)
    key = rates.select(F.col("doc_id").alias("__id"), F.col("__h"), *added).withColumn("__n", number).withColumnRenamed("__id", "__i").withColumnRenamed("__h", "__g").withColumnRenamed("__n", "__m")
    met = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__g")) & (F.col("__n") == F.col("__m"))
    return whole.join(key, met).select(*docs.columns, *added)


def mixed(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): copies, 0 to ``cap``, meet the source's target.

    A column ``__h`` more, of doc_id, text and source, tells rows of one doc_id apart.
    """
    # a null source is one of its own; other sources keep their text as their key
    sid = F.concat(F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce("source", F.lit("")))
    rows = written(sized(docs.select("doc_id", "text", "source")).select("doc_id", "source", "size", sid.alias("sid"), F.xxhash64("doc_id", "text", "source").alias("h")), "mix-sizes")
    cells = written(rows.groupBy("sid", "source", "size").agg(F.count("*").alias("n")), "mix-cells")
    sources = cells.groupBy("sid", "source").agg(F.sum(F.col("n") * F.col("size")).alias("tokens"))
    wanted = written(sources.join(targets(sources.select("source", "tokens"), cap).select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).select("sid", "tokens", "target"), "mix-targets")
    lam = multipliers(cells.where("size > 0").select("sid", "size", "n"), wanted, cap)
    tilted = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0))))
    rate = F.when((F.col("size") == 0) | F.col("full").isNull(), F.lit(0.0)).when(F.col("full"), F.lit(float(cap))).otherwise(tilted)
    along = Window.partitionBy("sid").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = cells.join(lam, "sid", "left").withColumn("rate", rate)
    rated = rated.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(along), F.lit(0.0)))
    parts = F.greatest(F.lit(1), F.floor(F.col("n") / F.greatest(F.lit(TOGETHER), F.floor(F.sqrt("n")))))
    rated = written(rated.join(wanted, "sid").select("sid", "size", "n", "rate", "before", parts.alias("parts"), F.col("tokens").alias("source_size"), "target"), "mix-rates")

    rated = rated.join(_offsets(rated), "sid").withColumn("before", F.col("before") + F.col("offset")).drop("n", "offset")
    placed = written(rows.join(rated, ["sid", "size"]).withColumn("part", F.pmod("h", "parts")), "mix-rows")
    earlier = Window.partitionBy("sid", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    hot = placed.where("parts > 1").groupBy("sid", "size", "part").agg(F.count("*").alias("k")).withColumn("skipped", F.coalesce(F.sum("k").over(earlier), F.lit(0))).drop("k")
    own = F.row_number().over(Window.partitionBy("sid", "size", "part").orderBy("h", "doc_id"))
    numbered = placed.withColumn("k", own).join(hot, ["sid", "size", "part"], "left").withColumn("k", F.col("k") + F.coalesce("skipped", F.lit(0)))
    upto = F.floor(F.col("before") + F.col("k") * F.col("rate"))
    below = F.floor(F.col("before") + (F.col("k") - 1) * F.col("rate"))
    return numbered.select("doc_id", "source", "size", "source_size", "target", F.least(F.lit(cap), upto - below).cast("int").alias("copies"), F.col("h").alias("__h"))
