"""Finding passages in long texts: exact, then by both ends, then fuzzily around common seeds.

Texts and needles are normalised first. Texts are scanned for the needles' heads in the first
two stages and for pieces of ``SEED`` characters in the third, by automata over all needles, so
that texts don't travel. Of what the third stage compares it hands on the windows alone, and
only for the pairs that the stages before it left open.

A needle is searched in every text, or, with ``group``, in the texts of its own group only.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.bounds import matching_blocks
from quillspan.functions.text import least_block
from quillspan.storage import written

# Fixed values of the search: the anchor's head and tail, its score and its slack; the seed's
# length and least length, hits a seed; the window's margin, the span's slack, candidates, floor.
ANCHOR, ANCHOR_SCORE, ANCHOR_STRETCH, ANCHOR_SLACK = 60, 0.95, 1.3, 60
SEED, LEAST_SEED, SEED_HITS = 12, 6, 50
MARGIN, STRETCH, SLACK = 40, 1.6, 40
TOP, FLOOR = 5, 0.55

#: Largest number of needles that is broadcast at once; more go in blocks.
BROADCAST = 1 << 20
#: Largest number of seeds, about, whose needles are broadcast at once; more go in blocks.
SEEDS = 1 << 18
_MATCH = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("score", T.DoubleType())])



def spread(texts: DataFrame) -> DataFrame:
    """``texts``, dealt over all cores where their files would leave cores idle."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(cores) if texts.rdd.getNumPartitions() < cores else texts


def fanned(rows: DataFrame, *keys: str) -> DataFrame:
    """Few rows that each take long, dealt over as many tasks as a shuffle has; small ones would else share one."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def exact_start(hay: Column, needle: Column) -> Column:
    """0-based place of the needle's first occurrence, or null; an empty needle is nowhere."""
    at = F.instr(hay, needle)
    return F.when((at > 0) & (F.length(needle) > 0), at - 1)


def anchor_span(hay: Column, needle: Column) -> Column:
    """(start, length) if the first head of the needle is followed by its tail within bounds, else null."""
    n = F.length(needle)
    head = F.instr(hay, F.left(needle, F.lit(ANCHOR)))
    tail = F.call_function("locate", F.right(needle, F.lit(ANCHOR)), hay, F.greatest(head, F.lit(1)))
    length = tail + ANCHOR - head
    fits = (n > 2 * ANCHOR) & (head > 0) & (tail > 0) & (length <= n * F.lit(ANCHOR_STRETCH) + ANCHOR_SLACK)
    return F.when(fits, F.struct((head - 1).alias("start"), length.alias("length")))


def clustered(starts: list[int], reach: int = SEED) -> list[tuple[int, int]]:
    """(start, votes): sorted starts, each joined to the cluster whose first start is less than ``reach`` before."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        if out and s < out[-1][0] + reach:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((s, 1))
    return out


def seeds(needles: DataFrame, *others: str) -> DataFrame:
    """(needle_id, others, offset, piece): needles cut into pieces of ``SEED`` characters, what is left over dropped.

    A needle of fewer characters would be its own only seed, so a text that has it holds it
    exactly; one of fewer than ``LEAST_SEED`` has none. Both are left to the exact stage.
    """
    offsets = F.sequence(F.lit(0), F.length("needle") - SEED, F.lit(SEED))
    cut = needles.where(F.length("needle") >= SEED).select("needle_id", *others, "needle", F.explode(offsets).alias("offset"))
    return cut.select("needle_id", *others, "offset", F.substring("needle", F.col("offset") + 1, F.lit(SEED)).alias("piece"))


class _Index:
    """Needles with what finds them: automata over their heads and over their seeds, each made when first used."""

    def __init__(self, ids: pa.Array, needles: list[str]):
        self.ids, self.needles = ids, needles

    @staticmethod
    def _made(words: dict[str, list]):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, of in words.items():
            automaton.add_word(word, of)
        if words:
            automaton.make_automaton()
        return automaton

    @functools.cached_property
    def heads(self):
        """What every text has that holds the needle or its head: the head, or all of a shorter needle."""
        words: dict[str, list[int]] = {}
        for k, needle in enumerate(self.needles):
            if needle:
                words.setdefault(needle[:ANCHOR], []).append(k)
        return self._made(words)

    @functools.cached_property
    def seeds(self):
        words: dict[str, list[tuple[int, int]]] = {}
        for k, needle in enumerate(self.needles):
            for offset in range(0, len(needle) - SEED + 1 if needle else 0, SEED):
                words.setdefault(needle[offset : offset + SEED], []).append((k, offset))
        return self._made(words)


_held: dict[int, _Index] = {}


def _index(block: _Block) -> _Index:
    """What a broadcast block of needles gives, made once in each worker."""
    if block.id not in _held:
        _held.clear()
        table = pa.ipc.open_stream(block.value).read_all()
        _held[block.id] = _Index(table["needle_id"].combine_chunks(), table["needle"].to_pylist())
    return _held[block.id]


def _taken(ids: pa.Array | pa.ChunkedArray, rows) -> pa.Array:
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return ids.take(pa.array(rows, pa.int64()))


def _scanned(hays: DataFrame, needles: DataFrame, group: str | None, rows_of: Callable, columns: str, others: tuple[str, ...] = ()) -> DataFrame:
    """(needle_id, hay_id, columns) that ``rows_of`` (index, texts) finds of needles in texts.

    Needles, counted first, are broadcast in blocks of at most about ``SEEDS`` seeds and ``BROADCAST`` needles. A block is
    one pass over the texts, which never leave their task. With ``group`` a group's needles and
    texts meet in one task, so that each text is read once, however many groups there are.
    """
    kinds = {f.name: f.dataType.simpleString() for f in [*hays.schema.fields, *needles.schema.fields]}
    schema = f"needle_id {kinds['needle_id']}, hay_id {kinds['hay_id']}, {columns}"
    if group:

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            return pa.Table.from_batches([rows_of(_Index(right["needle_id"].combine_chunks(), right["needle"].to_pylist()), left)])

        texts = hays.where(F.col(group).isNotNull()).select("hay_id", group, "hay", *others)
        wanted = needles.where(F.col(group).isNotNull() & (F.col("needle") != "")).select("needle_id", group, "needle")
        return texts.groupBy(group).cogroup(wanted.groupBy(group)).applyInArrow(meet, schema)
    wanted = needles.where("needle <> ''").select("needle_id", "needle")
    size, count = wanted.agg(F.coalesce(F.sum(F.ceil(F.length("needle") / SEED)), F.lit(0)), F.count("*")).first()
    blocks, found = max(1, -(-size // SEEDS), -(-count // BROADCAST)), None
    for k in range(blocks):
        table = (wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("needle_id"), F.lit(blocks)) == k)).toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        block = _Block(hays.sparkSession, sink.getvalue().to_pybytes())

        def scan(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield rows_of(_index(block), batch)

        part = hays.select("hay_id", "hay", *others).mapInArrow(scan, schema)
        found = part if found is None else found.unionByName(part)
    return found


class _Block:
    """A broadcast block of seeds and the key by which workers keep what they made of it."""

    def __init__(self, spark, content: bytes):
        self.held = spark.sparkContext.broadcast(content)
        self.id = self.held._jbroadcast.id()

    def __getstate__(self):
        return {"held": self.held, "id": self.id}

    @property
    def value(self) -> bytes:
        return self.held.value


def _native(index: _Index, texts: list[str | None]) -> Iterator[tuple]:
    """(needle, text, is exact, start, length) of what the first two stages find; needles and texts by number."""
    for i, hay in enumerate(texts):
        met: set[int] = set()
        for _, of in index.heads.iter(hay) if hay and len(index.heads) else ():
            met.update(of)
        for k in met:
            needle = index.needles[k]
            n, at = len(needle), hay.find(needle)
            if at >= 0:
                yield k, i, True, at, n
            elif n > 2 * ANCHOR:
                head = hay.find(needle[:ANCHOR])
                tail = hay.find(needle[-ANCHOR:], head)
                length = tail + ANCHOR - head
                if tail >= 0 and length <= n * ANCHOR_STRETCH + ANCHOR_SLACK:
                    yield k, i, False, head, length


def _native_rows(index: _Index, rows: pa.Table | pa.RecordBatch) -> pa.RecordBatch:
    found = list(_native(index, rows.column("hay").to_pylist()))
    k, i, exact, start, length = zip(*found, strict=True) if found else ((), (), (), (), ())
    stage, score = pa.array(["exact" if e else "anchor" for e in exact], pa.string()), pa.array([1.0 if e else ANCHOR_SCORE for e in exact], pa.float64())
    return pa.RecordBatch.from_arrays([_taken(index.ids, k), _taken(rows.column("hay_id"), i), stage, pa.array(start, pa.int32()), pa.array(length, pa.int32()), score], names=["needle_id", "hay_id", "stage", "start", "length", "score"])


def located_natively(hays: DataFrame, needles: DataFrame, group: str | None = None) -> DataFrame:
    """(needle_id, hay_id, stage, start, length, score) of the exact and the anchor stage."""
    return _scanned(hays, needles, group, _native_rows, "stage string, start int, length int, score double")


def _covers(window: str, needle: str, least: int, floor: float) -> bool:
    """Whether matching blocks of ``least`` characters and more can make up the share ``floor`` of the needle.

    Every character of such a block lies in a run of ``least`` characters that the window has too.
    """
    runs = {window[i : i + least] for i in range(len(window) - least + 1)}
    covered = upto = 0
    for i in range(len(needle) - least + 1):
        if needle[i : i + least] in runs:
            covered += i + least - max(i, upto)
            upto = i + least
    return covered > 0 and covered >= floor * len(needle) - 1e-6


def _fuzzy_rows(most: int, top: int, floor: float, open_only: bool):
    """Texts to (needle_id, hay_id, start, votes, low, window): each pair's ``top`` candidates, by one automaton.

    The window is null where ``_covers`` says that nothing in it can match; its candidate has a
    rank all the same. With ``open_only`` pairs that the first two stages find are left out.
    """

    def run(index: _Index, rows: pa.Table | pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for i, hay in enumerate(rows.column("hay").to_pylist()):
            seen: Counter[int] = Counter()
            found: dict[int, list[int]] = {}
            for end, uses in index.seeds.iter(hay) if hay and len(index.seeds) else ():
                seen[id(uses)] += 1
                if seen[id(uses)] <= most:
                    for k, offset in uses:
                        found.setdefault(k, []).append(max(0, end - SEED + 1 - offset))
            for k in {k for k, *_ in _native(index, [hay])} if open_only and found else ():
                found.pop(k, None)
            for k, starts in found.items():
                needle = index.needles[k]
                least = max(6, min(12, len(needle) // 6))
                for start, votes in sorted(clustered(starts), key=lambda c: (-c[1], c[0]))[:top]:
                    low = max(0, start - MARGIN)
                    window = hay[low : min(len(hay), start + len(needle) + MARGIN)]
                    out.append((k, i, start, votes, low, window if _covers(window, needle, least, floor) else None))
        k, i, start, votes, low, window = zip(*out, strict=True) if out else ((), (), (), (), (), ())
        arrays = [_taken(index.ids, k), _taken(rows.column("hay_id"), i), *(pa.array(x, pa.int32()) for x in (start, votes, low)), pa.array(window, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["needle_id", "hay_id", "start", "votes", "low", "window"])

    return run


def candidates(hays: DataFrame, needles: DataFrame, most: int = SEED_HITS, group: str | None = None, top: int = TOP, floor: float = FLOOR, open_only: bool = False) -> DataFrame:
    """(needle_id, hay_id, start, votes, low, window) where a fuzzy match may begin; the first ``most`` hits of a seed in a text count."""
    return _scanned(hays, needles.where(F.length("needle") >= SEED), group, _fuzzy_rows(most, top, floor, open_only), "start int, votes int, low int, window string")


def _best_blocks(window: str, needle: str, least: int, floor: float) -> tuple[int, int, float] | None:
    blocks = [b for b in matching_blocks(window, needle) if b[2] >= least]
    if not blocks or not needle:
        return None
    score = sum(size for _, _, size in blocks) / len(needle)
    first, last = blocks[0], blocks[-1]
    length = last[0] + last[2] - first[0]
    return (first[0], length, score) if score >= floor and length <= STRETCH * len(needle) + SLACK else None


def window_match(floor: float):
    """A pandas UDF: (window, needle, least block) to (start in the window, length, score), or null."""

    @F.pandas_udf(_MATCH)
    def match(window: pd.Series, needle: pd.Series, least: pd.Series) -> pd.DataFrame:
        found = [_best_blocks(w, n, int(b), floor) for w, n, b in zip(window, needle, least, strict=True)]
        return pd.DataFrame([f or (None, None, None) for f in found], columns=["start", "length", "score"]).astype({"start": "Int32", "length": "Int32", "score": "float64"})

    return match


def located_fuzzily(hays: DataFrame, needles: DataFrame, floor: float = FLOOR, top: int = TOP, within: str = "hay_id", order: str | None = None, settled: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """(needle_id, hay_id, stage, start, length, score): of the ``top`` candidates by votes, the best window.

    ``within`` is what candidates compete in: one text, or a book of several texts in the order
    of ``order``, whose candidates are ranked together. Pairs (needle_id, ``within``) of
    ``settled``, which the stages before found in the same texts, are left out before anything is compared.
    """
    # among a group's own needles many are settled, whose windows need not leave the scan
    found = candidates(hays, needles, group=group, top=top, floor=floor, open_only=settled is not None and group is not None)
    place = hays.select("hay_id", *[c for c in {within, order} if c and c != "hay_id"])
    if len(place.columns) > 1:
        found = found.join(place, "hay_id")
    if settled is not None:
        found = found.join(settled.select("needle_id", within).distinct(), ["needle_id", within], "left_anti")
    sequence = [F.col(order)] if order else []
    ranked = Window.partitionBy("needle_id", within).orderBy(F.desc("votes"), *sequence, "start")
    best = found.withColumn("rank", F.row_number().over(ranked)).where((F.col("rank") <= top) & F.col("window").isNotNull())
    near = best.join(needles.select("needle_id", "needle"), "needle_id")
    near = fanned(near.select("needle_id", *dict.fromkeys([within, "hay_id"]), "rank", "low", "window", "needle"), "needle_id", "hay_id", "rank")
    scored = near.select("needle_id", *dict.fromkeys([within, "hay_id"]), "rank", "low", window_match(floor)("window", "needle", least_block(F.col("needle"))).alias("m")).where("m.score is not null")
    pick = F.max_by(F.struct("hay_id", (F.col("low") + F.col("m.start")).alias("start"), F.col("m.length").alias("length"), F.col("m.score").alias("score")), F.struct(F.col("m.score"), -F.col("rank")))
    return scored.groupBy("needle_id", within).agg(pick.alias("p")).select("needle_id", "p.hay_id", F.lit("fuzzy").alias("stage"), "p.start", "p.length", "p.score")


def located(hays: DataFrame, needles: DataFrame, floor: float = FLOOR, group: str | None = None) -> DataFrame:
    """The whole cascade for every pair of text and needle: a row for each pair that matches."""
    native = written(located_natively(hays, needles, group), "located")
    return native.unionByName(located_fuzzily(hays, needles, floor, settled=native, group=group))


def located_in_books(docs: DataFrame, needles: DataFrame, floor: float = FLOOR, group: str | None = None) -> DataFrame:
    """One place for each needle and book of several documents (book_id, spine, hay_id, hay).

    An exact match in any document comes before an anchored one in any, and that before a fuzzy
    one; within the first two stages the first document wins.
    """
    native = located_natively(docs, needles, group).join(docs.select("hay_id", "book_id", "spine"), "hay_id")
    first = F.min_by(F.struct("hay_id", "stage", "start", "length", "score"), F.struct(-F.col("score"), F.col("spine")))
    native = written(native.groupBy("needle_id", "book_id").agg(first.alias("p")).select("needle_id", "book_id", "p.*"), "located")
    fuzzy = located_fuzzily(docs, needles, floor, within="book_id", order="spine", settled=native, group=group).join(docs.select("hay_id", "book_id"), "hay_id")
    return native.unionByName(fuzzy.select(*native.columns))
