"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full sets, union-find.

A document's set is its distinct word shingles (words lower-cased in A-Z). Each element ranks
all ``SLOTS`` slots by a keyed permutation of its own and draws a value for each rank; a slot
keeps the smallest rank-and-value. Ranks are dealt in rounds over all elements of a block of
documents at once, and a document stops as soon as every slot is filled, since later ranks are
larger. ``BANDS`` bands of ``ROWS`` slots make candidates: at similarity 0.8 a pair misses
all of them with probability (1 - 0.8**6)**42 = 3e-6.

Texts with equal sets are one class (128-bit digest), represented by their smallest doc_id.
In a band's bucket, classes are compared with a leader instead of all with all. Every
comparison is on the full sets of hashes, and every link is confirmed on the shingles themselves.
The text of a leader with many followers travels to salted parts of them. Links make components; buckets whose classes still lie in several
components are then compared across components - with new leaders while that leaves far fewer
pairs, at last exhaustively, a bucket by pairs of chunks that hold at most about ``CHUNK`` classes
and ``ELEMENTS`` elements each. So no link between different components is left unexamined,
whatever the size of a bucket, no task gathers a whole bucket, and only links leave the workers.

Defined cases: null or wordless texts have an empty set and are linked with nothing; fewer
words than a shingle's make one shingle; a null doc_id is linked with nothing and has a null
component, kept; rows of one doc_id are one node, which links all that its texts resemble.
``groups`` returns the columns it names; ``without_copies`` all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import written
from .tokens import ASCII_LOWER, blocks, mix, shingle_sets
from .workers import bounded, tidy

SLOTS, ROWS = 256, 6
BANDS = SLOTS // ROWS
#: Largest number of candidate ids that is broadcast.
BROADCAST = 1 << 19
#: Most rounds of new leaders before all that is left is compared.
ROUNDS = 6
#: What is left is compared at once if it is at most so many pairs for each row of a bucket.
PAIRS = 256
#: Classes and elements of a bucket that are compared together with as many others.
CHUNK, ELEMENTS = 1024, 1 << 19
#: Pairs of one class that are verified together with one copy of its text.
TOGETHER = 2048
_FULL = np.uint64((1 << 64) - 1)
_U = np.uint64
_LOWER = ASCII_LOWER.tobytes()


def super_minhash(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signatures (document, slot) of sets of hashes; document k has value[first[k]:first[k + 1]]."""
    n = len(first) - 1
    out = np.full((n, SLOTS), _FULL)
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(n), np.diff(first))
    keys = mix(value ^ _U(0xA5A5A5A5A5A5A5A5))
    a, b, c, d = ((keys >> _U(s)).astype(np.int64) & 255 for s in (0, 8, 16, 24))
    a, c = a | 1, c | 1
    live = np.diff(first) > 0
    for rank in range(SLOTS):
        on = live[doc]
        if not on.all():
            doc, value, a, b, c, d = doc[on], value[on], a[on], b[on], c[on], d[on]
        if not len(doc):
            break
        slot = (rank * a + b) & 255
        slot ^= slot >> 4
        slot = (slot * c + d) & 255
        drawn = (mix(value + _U((rank + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> _U(8)) | _U(rank << 56)
        np.minimum.at(flat, doc * SLOTS + slot, drawn)
        at = np.flatnonzero(live)
        live[at] = (out[at] == _FULL).any(1)
    return out


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    part = signatures[:, : BANDS * ROWS].reshape(len(signatures), BANDS, ROWS)
    value = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U) * _U(0xD6E8FEB86659FD93), part.shape[:2]).copy()
    for k in range(ROWS):
        value = mix(value * _U(0x9FB21C651E98DF25) + part[:, :, k])
    return value


def _digests(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits of each set: sums of two independent mixes of its elements, mixed once more."""
    out = np.empty((len(first) - 1, 2), _U)
    for j, salt in enumerate((0x1234567, 0x7654321)):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(value ^ _U(salt)), dtype=_U)])
        out[:, j] = mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(_U))
    return out


def _signer(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, bands = [], [], []
            for b in blocks(batch.column("text")):
                value, first = shingle_sets(b, shingle)
                size.append(np.diff(first))
                digest.append(_digests(value, first))
                bands.append(band_hashes(super_minhash(value, first)))
            if not size:
                continue
            pairs, flat = np.concatenate(digest), np.concatenate(bands).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(size), pa.int64()), pa.array([p.tobytes() for p in pairs], pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), BANDS).cast(pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "bands"],
            )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, compressed: a third of the size of their sets of hashes, which are made again where they meet."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([pack.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())], names=["rep", "packed"])


def _sets(raw: list[bytes], shingle: int, unpack: zstandard.ZstdDecompressor) -> list[np.ndarray]:
    """The sets of packed texts, equal ones made once."""
    distinct = list(dict.fromkeys(raw))
    made: dict[bytes, np.ndarray] = {}
    for b in blocks(pa.array([unpack.decompress(x).decode() for x in distinct], pa.string())):
        value, first = shingle_sets(b, shingle)
        made |= {distinct[b.lo + k]: value[first[k] : first[k + 1]] for k in range(b.hi - b.lo)}
    return [made[x] for x in raw]


def _shingles(packed: bytes, shingle: int, unpack: zstandard.ZstdDecompressor) -> set[bytes]:
    """The shingles of a packed text as they are."""
    ws = unpack.decompress(packed).translate(_LOWER).split()
    return {b" ".join(ws[i : i + shingle]) for i in range(max(1, len(ws) - shingle + 1))}


def _alike(x: set[bytes], y: set[bytes], percent: int) -> bool:
    shared = len(x & y)
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirm(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, ok = batch.slice(i, 256), []
                left, right = part.column("x").to_pylist(), part.column("y").to_pylist()
                known: dict[bytes, set[bytes]] = {}
                for p, q, x, y in zip(left, right, _sets(left, shingle, unpack), _sets(right, shingle, unpack), strict=True):
                    both = np.concatenate([x, y])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    near = 100 * shared >= percent * (len(x) + len(y) - shared)
                    if near:  # leaders stand beside many, so their shingles are kept
                        if p not in known:
                            known = {p: _shingles(p, shingle, unpack)}
                        near = _alike(known[p], _shingles(q, shingle, unpack), percent)
                    ok.append(near)
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def linked(sets: list[np.ndarray], part: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of all sets of different parts that are as similar as asked."""
    size = np.array([len(x) for x in sets], np.int32)
    near = 100 * np.minimum.outer(size, size) >= percent * np.maximum.outer(size, size)
    i, j = np.nonzero(np.triu(part[:, None] != part, 1) & near & (size > 0))
    if not len(i):
        return i, j
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count > 1
    keep = common[element]
    owner = np.repeat(np.arange(len(sets)), size)[keep]
    column = (np.cumsum(common) - 1)[element[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    wide = min(1 << 12, max(1, int(common.sum())))
    cut = np.searchsorted(column, np.arange(0, int(common.sum()) + wide, wide))
    for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):  # exact: counts stay far below 2**24
        has = np.zeros((len(sets), wide), np.float32)
        has[owner[a:b], column[a:b] - k * wide] = 1
        shared += has @ has.T
    n = shared[i, j].astype(np.int64)
    ok = 100 * n >= percent * (size[i].astype(np.int64) + size[j] - n)
    return i[ok], j[ok]


_GROUP = ("band", "lo", "hi")


def _compare(shingle: int, percent: int):
    """Rows sorted by (band, lo, hi) to the links inside each such group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def links(table: pa.Table) -> pa.RecordBatch:
            key = np.stack([table[c].to_numpy() for c in _GROUP])
            rep, part = table["rep"].to_numpy(), table["part"].to_numpy()
            edge = np.concatenate([[0], 1 + np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)), [table.num_rows]])
            found, lo = [np.zeros((2, 0), np.int64)], 0
            while lo < len(edge) - 1:  # several groups together, so that their texts are handled in blocks
                hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + CHUNK, "right")) - 1)
                packed = table["packed"].slice(edge[lo], edge[hi] - edge[lo]).to_pylist()
                sets = _sets(packed, shingle, unpack)
                for a, b in zip(edge[lo:hi], edge[lo + 1 : hi + 1], strict=True):
                    i, j = linked(sets[a - edge[lo] : b - edge[lo]], part[a:b], percent)
                    known = {k: _shingles(packed[a - edge[lo] + k], shingle, unpack) for k in set(i.tolist()) | set(j.tolist())}
                    ok = np.array([_alike(known[p], known[q], percent) for p, q in zip(i.tolist(), j.tolist(), strict=True)], bool)
                    i, j = i[ok], j[ok]
                    found.append(np.sort(np.stack([rep[a:b][i], rep[a:b][j]]), axis=0))
                lo = hi
            both = np.unique(np.concatenate(found, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], names=["u", "v"])

        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            last = np.ones(held.num_rows, bool)
            for c in _GROUP:
                column = held[c].to_numpy()
                last &= column == column[-1] if len(column) else True
            done = held.num_rows - int(last.sum())
            if done:  # the last group may go on in the next batch
                yield links(held.slice(0, done))
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield links(held)

    return run


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are as similar as asked.

    Of a pair, the class with fewer pairs gets its text first; that of the other then comes in
    as many salted copies as its pairs need.
    """
    degree = pairs.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count("*").alias("k"))
    degree = written(degree, "degrees")
    sized = pairs.join(degree.select(F.col("rep").alias("u"), F.col("k").alias("ku")), "u").join(degree.select(F.col("rep").alias("v"), F.col("k").alias("kv")), "v")
    swap = F.col("ku") > F.col("kv")
    turned = sized.select("u", "v", F.when(swap, F.col("v")).otherwise(F.col("u")).alias("a"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("b"), F.pmod(F.xxhash64("u", "v"), F.ceil(F.greatest("ku", "kv") / TOGETHER)).alias("salt"))
    with_a = turned.join(texts.select(F.col("rep").alias("a"), F.col("packed").alias("y")), "a")
    copies = degree.select(F.col("rep").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("k") / TOGETHER) - 1)).alias("salt"))
    with_both = with_a.join(copies.join(texts.select(F.col("rep").alias("b"), F.col("packed").alias("x")), "b"), ["b", "salt"])
    return with_both.select("u", "v", "x", "y").mapInArrow(tidy(_confirm(shingle, percent)), "u long, v long").distinct()


def _pairs_with_leaders(members: DataFrame, salt: int, percent: int) -> DataFrame:
    """Each class with its bucket's leader, where their parts differ and their sizes allow a link."""
    choice = F.struct(F.xxhash64("rep", F.lit(salt)).alias("h"), "rep", "n", "part")
    leaders = written(members.groupBy("band").agg(F.min(choice).alias("lead"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("band", "lead"), "leaders")
    near = F.expr(f"100 * least(n, lead.n) >= {percent} * greatest(n, lead.n)")
    met = members.join(leaders, "band").where((F.col("part") != F.col("lead.part")) & near)
    return met.select(F.least("rep", "lead.rep").alias("u"), F.greatest("rep", "lead.rep").alias("v")).distinct()


def _links_across(members: DataFrame, buckets: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """All links of each bucket between different parts: its chunks meet two by two."""
    wide = F.greatest(F.ceil(F.col("s") / CHUNK), F.ceil(F.col("elements") / ELEMENTS)).cast("int")
    placed = members.join(buckets.select("band", wide.alias("chunks")), "band")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep", "band"), F.col("chunks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "rep", "part")
    full = dealt.join(texts, "rep").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return full.select(*_GROUP, "rep", "part", "packed").mapInArrow(tidy(_compare(shingle, percent)), "u long, v long").distinct()


def groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = written(bounded(docs).mapInArrow(tidy(_signer(shingle)), "doc_id long, n_shingles long, digest binary, bands array<long>"), "signatures")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    classes = written(real.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    heads = real.join(classes, "digest").where("doc_id = rep").select("rep", F.col("n_shingles").alias("n"), "bands")
    reps = heads.select("rep", "n", F.explode("bands").alias("band"))
    shared = reps.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("band")
    members = written(reps.join(shared, "band").select("band", "rep", "n", F.col("rep").alias("part")), "band-members")

    wanted = written(members.select("rep").distinct(), "candidates")
    few = wanted.count() <= BROADCAST
    wanted = F.broadcast(wanted) if few else wanted
    texts = written(docs.withColumnRenamed("doc_id", "rep").join(wanted, "rep", "left_semi").mapInArrow(tidy(_packed), "rep long, packed binary"), "candidate-texts")
    first = written(_pairs_with_leaders(members, 0, percent), "pairs")
    links = _verified(first, texts, shingle, percent)
    # a doc_id whose rows have several texts ties their classes together
    many = real.select("doc_id", "digest").distinct().groupBy("doc_id").agg(F.collect_set("digest").alias("ds")).where("size(ds) > 1")
    tied = many.select("doc_id", F.explode("ds").alias("digest")).join(classes, "digest").where("doc_id <> rep").select(F.greatest("doc_id", "rep").alias("u"), F.least("doc_id", "rep").alias("v"))
    links = written(links.unionByName(tied), "links")
    parts, tried, before = written(components(links), "parts"), 0, float("inf")
    while True:
        tried += 1
        # buckets that lie in one part are settled for good, so that each round is of what the last one left
        placed = members.drop("part").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")
        placed = written(placed, "placed-members")
        counts = placed.groupBy("band", "part").agg(F.count("*").alias("count"), F.sum("n").alias("elements")).groupBy("band").agg(F.count("*").alias("k"), F.sum("count").alias("s"), F.sum("elements").alias("elements"), F.sum(F.col("count") * F.col("count")).alias("q"))
        # a bucket of two has been settled by its leader
        split = written(counts.where("k > 1 and s > 2"), "split-buckets")
        left = split.agg(F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.lit(0)).alias("pairs"), F.coalesce(F.sum("s"), F.lit(0)).alias("rows")).first()
        if not left["pairs"]:
            break
        members = written(placed.join(split.select("band"), "band"), "split-members")
        last = left["pairs"] <= PAIRS * left["rows"] or left["pairs"] > 0.7 * before or tried > ROUNDS
        before = left["pairs"]
        if last:
            fresh = written(_links_across(members, split, texts, shingle, percent), "links")
        else:
            more = written(_pairs_with_leaders(members, tried, percent).join(first, ["u", "v"], "left_anti"), "more-pairs")
            first = first.unionByName(more)
            fresh = written(_verified(more, texts, shingle, percent), "links")
        if not fresh.isEmpty():
            links = links.unionByName(fresh)
            parts = written(components(links), "parts")
        if last:
            break
    named = written(classes.join(parts, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component")), "class-components")
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    return out.join(named, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def without_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest doc_id; a repeated row goes too."""
    found = groups(docs, shingle, percent)
    ids = written(found.where("doc_id is not null").select("doc_id", (F.col("doc_id") != F.col("component_id")).alias("copy")), "copies")
    copies = ids.groupBy("doc_id").agg(F.max("copy").alias("copy"), F.count("*").alias("k")).where("copy or k > 1")
    gone, again = copies.where("copy").select("doc_id"), copies.where("not copy").select("doc_id")
    gone = written(gone, "gone")
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST else gone, "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").select(*docs.columns)
    from pyspark.sql import Window

    first = once.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("__k = 1").drop("__k")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(first)
