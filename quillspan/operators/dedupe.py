"""Removal of superseded, known and colliding annotations, and differences of snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quillspan.functions.bounds import similar_pairs
from quillspan.functions.containing import EDGE, Met, Needles
from quillspan.functions.text import stripped

# Fixed value: what a clip says whose text the device kept back.
LIMIT_NOTICE = "<You have reached the clipping limit"


def eligible(clips: DataFrame) -> DataFrame:
    """Highlights and underlines that have a text of their own."""
    return clips.where(F.col("kind").isin("Highlight", "Underline") & (F.col("text") != "") & ~F.startswith("text", F.lit(LIMIT_NOTICE)))


#: Texts under one title are dealt so that their parts, and how often its needles are sent, grow with the root of their size: to one part up to so many bytes, to two up to four times as many.
PART = 1 << 19
_BUCKETS = 1 << 12
#: How a row of a group of texts takes part: with all rows, or needles with texts that they may stand in.
_ALL, _NEEDLE, _TEXT = 0, 1, 2


def without_superseded(clips: DataFrame) -> DataFrame:
    """Clips (title, seq, loc_start, loc_end, text) that no later clip of the title replaces.

    A later one replaces an earlier one if their closed ranges overlap and their texts are related:
    they have the first or last 20 characters in common, which a shorter text than that has with its
    equals only, or one contains the other. So texts meet in groups, by either edge and by each text
    that others contain, and a group is gone through once, from its last clip to its first. Clips
    without a location stay.
    """
    whole, mark = stripped(F.col("text")), F.unhex(F.sha2(stripped(F.col("text")).cast("binary"), 256))
    placed = clips.select("title", "seq", F.col("loc_start").alias("start"), F.coalesce("loc_end", "loc_start").alias("end"), whole.alias("t"), mark.alias("mark")).dropna(subset=["title", "seq", "start", "t"])
    kept = ["title", "seq", "start", "end", "mark"]

    def by(kind: str, key: Column, role: int) -> Column:
        return F.struct(F.concat(F.lit(kind).cast("binary"), key.cast("binary")).alias("key"), F.lit(role).alias("role"))

    groups = F.array(by("<", F.left("t", F.lit(20)), _ALL), by(">", F.right("t", F.lit(20)), _ALL), by("=", F.col("mark"), _NEEDLE))
    members = placed.select(*kept, F.explode(groups).alias("of")).select(*kept, "of.*")
    members = members.unionByName(_containing(placed).select(*kept, by("=", F.col("inner"), _TEXT).alias("of")).select(*kept, "of.*"))
    dealt = members.repartition("title", "key").sortWithinPartitions("title", "key", F.desc("seq"))
    gone = dealt.mapInArrow(_met_later, placed.select(*kept).schema)
    gone = gone.toDF(*[f"__{c}" for c in kept])
    same = (F.col("title") == F.col("__title")) & (F.col("seq") == F.col("__seq")) & (F.col("loc_start") == F.col("__start")) & (F.coalesce("loc_end", "loc_start") == F.col("__end")) & (mark == F.col("__mark"))
    return clips.join(gone, same, "left_anti")


def _containing(placed: DataFrame) -> DataFrame:
    """Rows (title, seq, start, end, mark) of ``placed`` with ``inner``, the mark of a text that may stand inside theirs.

    A title's texts are dealt over parts; each part meets all of the title's texts by their edges only. Of equal
    texts at the same place only the last is searched: it replaces the others, and whatever they would.
    """
    apart = F.when(F.col("start") > F.col("end"), F.col("seq")).alias("apart")
    placed = placed.groupBy("title", "start", "end", "mark", apart).agg(F.max("seq").alias("seq"), F.first("t").alias("t")).select(placed.columns)
    size = F.octet_length("t").cast("bigint")
    texts = placed.select("*", F.xxhash64("title").alias("of")).withColumn("bucket", F.pmod("of", F.lit(_BUCKETS)).cast("int"))
    parts = texts.groupBy("bucket").agg(F.greatest(F.lit(1), F.ceil(F.sqrt(F.sum(size) / PART))).cast("int").alias("parts"))
    texts = texts.join(F.broadcast(parts), "bucket")
    needles = texts.select("bucket", "parts", "of", size.alias("size"), F.substring(F.col("t").cast("binary"), 1, EDGE).alias("head"), F.substring(F.col("t").cast("binary"), -EDGE, EDGE).alias("tail")).distinct()
    needles = needles.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    needles = needles.toDF(*needles.columns)
    texts = texts.select("bucket", F.pmod(F.xxhash64("seq", "mark"), F.col("parts")).cast("int").alias("part"), "of", "title", "seq", "start", "end", "mark", F.col("t").cast("binary").alias("t"))
    kept = ["title", "seq", "start", "end", "mark"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        known = Needles(right["of"].to_numpy(), right["size"].to_numpy(), right["head"].to_pylist(), right["tail"].to_pylist())
        found = list(known.inside(left["t"].to_pylist(), left["of"].to_numpy()))
        return left.select(kept).take(pa.array([i for i, _ in found], pa.int64())).append_column("inner", pa.array([x for _, x in found], pa.binary()))

    schema = StructType([*placed.select(*kept).schema, StructField("inner", BinaryType())])
    return texts.groupBy("bucket", "part").cogroup(needles.groupBy("bucket", "part")).applyInArrow(search, schema)


def _met_later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by title and key, the last first, those whose range meets one of a later row that they are compared with."""
    before = group = seq = None
    later: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        titles, keys = batch["title"], batch["key"]
        new = np.ones(len(keys) + 1, bool)
        new[1:-1] = pc.or_(pc.not_equal(keys[1:], keys[:-1]), pc.not_equal(titles[1:], titles[:-1])).to_numpy(zero_copy_only=False)
        new[0] = before != (titles[0].as_py(), keys[0].as_py())
        before = titles[-1].as_py(), keys[-1].as_py()
        # the last row may go on in the next batch; another one alone in its group meets none
        new[-1] = False
        rows = np.flatnonzero(~(new[:-1] & new[1:]))
        out = []
        some = batch.select(["seq", "start", "end", "role"]).take(pa.array(rows))
        for i, first, now, start, end, role in zip(rows.tolist(), new[rows].tolist(), *(c.to_pylist() for c in some.columns), strict=True):
            if first:
                group, seq, later = (Met(), Met(), Met()), None, []
            if now != seq:
                for at, *reach in later:
                    group[at].add(*reach)
                seq, later = now, []
            if group[(_ALL, _TEXT, _NEEDLE)[role]].meets(start, end):
                out.append(i)
            later.append((role, start, end))
        yield batch.select(["title", "seq", "start", "end", "mark"]).take(pa.array(out, pa.int64()))


def without_known(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key isn't known yet."""
    return rows.join(known.select(*on).distinct(), on, "left_anti").select(*rows.columns)


def without_covered(rows: DataFrame, known: DataFrame, group: str = "book_id", share: float = 0.5) -> DataFrame:
    """Ranges (start, end) that share less than ``share`` of the shorter range with every known one."""
    k = known.select(F.col(group).alias("__g"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    met = F.least("end", "__e") - F.greatest("start", "__s") >= share * F.least(F.col("end") - F.col("start"), F.col("__e") - F.col("__s"))
    return rows.join(k, (F.col(group) == F.col("__g")) & met, "left_anti")


def _compared(rows: DataFrame, known: DataFrame, threshold: float, group: str, once: bool, columns: str, give) -> DataFrame:
    """What ``give`` (rows, known, pairs) makes of the distinct texts of each group that are similar; a group meets in one task."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, theirs = (sorted(set(t["norm"].to_pylist()), key=lambda x: (len(x), x)) for t in (left, right))
        return give(left, right, [(mine[i], theirs[j]) for i, j in similar_pairs(mine, theirs, threshold, once)])

    own, other = (x.where(F.col(group).isNotNull() & (F.col("norm") != "")) for x in (rows, known))
    return own.groupBy(group).cogroup(other.groupBy(group)).applyInArrow(meet, columns)


def _resembling(rows: DataFrame, known: DataFrame, threshold: float, group: str) -> DataFrame:
    """(group, norm): the texts of ``rows`` that resemble a known one of their group; equal texts are compared once."""

    def give(left: pa.Table, right: pa.Table, pairs: list) -> pa.Table:
        texts = [a for a, _ in pairs]
        return pa.table({group: left[group].combine_chunks().take(pa.array([0] * len(texts), pa.int64())), "norm": pa.array(texts, pa.string())})

    kind = rows.schema[group].dataType.simpleString()
    return _compared(rows.select(group, "norm"), known.select(group, "norm"), threshold, group, True, f"`{group}` {kind}, norm string", give)


def similar_pairs_of(rows: DataFrame, others: DataFrame, threshold: float, group: str = "book_id", later: bool = False) -> DataFrame:
    """(row_id, other, contained) of rows (row_id, norm) and others (other, norm) of a group whose texts are similar.

    With ``later`` only of others above the row's own id.
    """

    def give(left: pa.Table, right: pa.Table, pairs: list) -> pa.Table:
        mine: dict[str, list] = {}
        theirs: dict[str, list] = {}
        for of, ids, table in ((mine, "row_id", left), (theirs, "other", right)):
            for text, k in zip(table["norm"].to_pylist(), table[ids].to_pylist(), strict=True):
                if k is not None:
                    of.setdefault(text, []).append(k)
        found = [(i, j, a in b or b in a) for a, b in pairs for i in mine.get(a, ()) for j in theirs.get(b, ()) if not later or i < j]
        i, j, inside = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"row_id": pa.array(i, left["row_id"].type), "other": pa.array(j, right["other"].type), "contained": pa.array(inside, pa.bool_())})

    kinds = rows.schema["row_id"].dataType.simpleString(), others.schema["other"].dataType.simpleString()
    return _compared(rows.select(group, "row_id", "norm"), others.select(group, "other", "norm"), threshold, group, False, f"row_id {kinds[0]}, other {kinds[1]}, contained boolean", give)


def without_similar(rows: DataFrame, known: DataFrame, threshold: float = 0.8, group: str = "book_id") -> DataFrame:
    """Rows (row_id, norm) whose text resembles no known one of the group; equal known texts count once."""
    return rows.join(_resembling(rows, known, threshold, group), [group, "norm"], "left_anti").select(*rows.columns)


def with_similar(rows: DataFrame, known: DataFrame, threshold: float = 0.85, group: str = "book_id") -> DataFrame:
    """Rows (row_id, norm) that some known text of the group corroborates."""
    return rows.join(_resembling(rows, known, threshold, group), [group, "norm"], "left_semi").select(*rows.columns)


def first_per_start(rows: DataFrame, known_ids: DataFrame, group: str = "book_id") -> DataFrame:
    """Of rows (ann_id, start, seq) whose id isn't taken, the first at each start."""
    free = without_known(rows, known_ids, [group, "ann_id"])
    w = Window.partitionBy(group, "start").orderBy("seq")
    return free.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows with ``op`` added or removed; nulls equal nulls, and repeated rows stay repeated."""

    def lacking(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.distinct().toDF(*[f"__{c}" for c in a.columns])
        same = F.lit(True)
        for c in a.columns:
            same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
        return a.join(b, same, "left_anti")

    after = after.select(*before.columns)
    return lacking(after, before).withColumn("op", F.lit("added")).unionByName(lacking(before, after).withColumn("op", F.lit("removed")))


def changed_actions(diff: DataFrame, created: DataFrame, action: str = "action") -> DataFrame:
    """Of the rows that a ``snapshot_diff`` says were added, those whose action isn't one of ``created``."""
    return diff.where("op = 'added'").join(created.select(action).distinct(), action, "left_anti").select(*diff.columns)


def with_lineage(*sources: tuple[str, DataFrame]) -> DataFrame:
    """All rows of the named sources with a column that says whence; repeats stay."""
    out = None
    for name, df in sources:
        part = df.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
