"""The two directions and the round trip, from parsed rows to rows with an outcome.

Nothing here writes: each flow ends in a DataFrame with an ``outcome`` for every input row,
from which ``plan`` takes what is to be applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.payload import annotation_id
from quillspan.functions.similarity import similar
from quillspan.functions.text import key_of, normalized
from quillspan.operators import dedupe, locate, match
from quillspan.operators.spans import native_range, original_span, range_address
from quillspan.plans.outcomes import ACCEPT, round_trip_class, to_addresses, to_positions
from quillspan.storage import written


def log_to_addresses(clips: DataFrame, library: DataFrame, documents: DataFrame, known: DataFrame, min_score: float = ACCEPT, accept_weak: float | None = None) -> DataFrame:
    """Clips as annotations of EPUB documents.

    clips: (seq, title, author, kind, text, ...); library: (seq, key, title, author);
    documents: (path key ``book_id``, spine, step, runs, text, norm, norm_map); known: (asset_id,
    address, norm). Clips without a library match are ``unmatched``.
    """
    keyed = clips.select(F.col("seq").alias("key"), "title", "author")
    lib = library.select("seq", F.col("key").alias("lib_key"), F.col("title").alias("lib_title"), F.col("author").alias("lib_author"))
    documents = written(documents, "documents")
    matched = written(match.best_match(keyed, lib), "matched")
    rows = clips.join(matched.select(F.col("key").alias("seq"), F.col("lib_key").alias("asset_id")), "seq", "left")
    rows = rows.withColumn("norm", normalized(F.col("text")))
    texts = known.select("asset_id", "norm").where("norm is not null").distinct().withColumn("known_text", F.lit(True))
    rows = rows.join(texts, ["asset_id", "norm"], "left")
    # known texts are left out before anything is searched
    wanted = rows.where("asset_id is not null and known_text is null").select(F.col("seq").alias("needle_id"), key_of(F.col("text")).alias("needle"), "asset_id").where("needle <> ''")
    hays = documents.where("norm is not null").select(F.concat_ws("#", "book_id", F.col("spine").cast("string")).alias("hay_id"), "book_id", "spine", F.col("norm").alias("hay"))
    # a clip is searched in its own book only
    hays, wanted = written(hays, "texts"), written(wanted, "needles")
    places = locate.located_in_books(hays, wanted.select("needle_id", "needle", F.col("asset_id").alias("book_id")), group="book_id")
    docs = documents.select(F.concat_ws("#", "book_id", F.col("spine").cast("string")).alias("hay_id"), "step", "runs", F.col("text").alias("full"), "norm_map")
    start, end = original_span(F.col("norm_map"), F.col("start"), F.col("length"))
    placed = places.join(docs, "hay_id").withColumn("from", start).withColumn("to", end)
    placed = placed.select(F.col("needle_id").alias("seq"), range_address(F.col("step"), F.col("runs"), F.col("from"), F.col("to")).alias("address"), F.substring("full", F.col("from") + 1, F.col("to") - F.col("from")).alias("matched_text"), "score", "stage")
    addresses = known.select("asset_id", "address").where("address is not null").distinct().withColumn("known_address", F.lit(True))
    rows = rows.join(placed, "seq", "left").join(addresses, ["asset_id", "address"], "left")
    return rows.withColumn("outcome", F.when(F.col("asset_id").isNull(), "unmatched").otherwise(to_addresses(min_score, accept_weak)))


def highlights_to_positions(rows: DataFrame, books: DataFrame, known: DataFrame, log_texts: DataFrame, min_score: float = ACCEPT, prefix: str = "app") -> DataFrame:
    """Highlights as positions in books whose text maps characters to native positions.

    rows: (seq, book_id, text, is_underline); books: (book_id, norm, norm_map, first, last, text);
    known: (book_id, start, end, norm, ann_id); log_texts: (book_id, norm) of the source's own log.
    """
    books, known, log_texts = written(books, "books"), written(known, "known"), written(log_texts, "log-texts")
    rows = written(rows.withColumn("norm", key_of(F.col("text"))).withColumn("row_id", F.col("seq")), "highlights")
    needles = rows.where("norm <> ''").select(F.col("seq").alias("needle_id"), F.col("norm").alias("needle"), "book_id")
    hays = books.select(F.col("book_id").alias("hay_id"), "book_id", F.col("norm").alias("hay"))
    places = locate.located(hays, needles, group="book_id").withColumnRenamed("needle_id", "seq").withColumnRenamed("hay_id", "book_id")
    maps = books.select("book_id", "norm_map", "first", "last", F.col("text").alias("full"))
    native = native_range(F.col("norm_map"), F.col("first"), F.col("last"), F.col("start"), F.col("length"))
    a, b = original_span(F.col("norm_map"), F.col("start"), F.col("length"))
    placed = rows.join(places, ["seq", "book_id"], "left").join(maps, "book_id", "left")
    placed = placed.withColumn("back", key_of(F.substring("full", a + 1, b - a))).withColumn("at", native[0]).withColumn("to", native[1]).drop("start").withColumnRenamed("at", "start").withColumnRenamed("to", "end").drop("full", "norm_map", "first", "last")
    placed = placed.withColumn("self_check", similar(F.col("back"), F.col("norm"), 0.9)).withColumn("ann_id", annotation_id(F.when(F.col("is_underline"), "underline").otherwise("highlight"), F.col("start"), prefix))
    placed = written(placed, "placed")

    def marked(kept: DataFrame, name: str, on: DataFrame) -> DataFrame:
        """``on`` with ``name``: whether the row is missing from ``kept``."""
        return written(on.join(kept.select("row_id", F.lit(True).alias("__k")), "row_id", "left").withColumn(name, F.col("__k").isNull()).drop("__k"), name)

    out = marked(dedupe.without_similar(placed, log_texts, 0.9), "echo", placed)
    out = marked(dedupe.without_covered(out.where("start is not null"), known), "covered", out)
    out = marked(dedupe.without_similar(out, known.select("book_id", "norm"), 0.8), "similar", out)
    survivors = out.withColumn("collides", F.lit(False)).withColumn("outcome", to_positions(min_score)).where("outcome = 'found'")
    firsts = dedupe.first_per_start(survivors, known.select("book_id", "ann_id"))
    out = marked(firsts, "collides", out)
    return out.withColumn("outcome", to_positions(min_score))


def round_trip(rows: DataFrame, books: DataFrame, log_texts: DataFrame | None = None) -> DataFrame:
    """Known annotations (row_id, book_id, start, end) searched for again by their own text, with their class.

    With ``log_texts`` (book_id, norm) also whether some text of the log corroborates each that was found.
    """
    books = written(books, "books")
    maps = books.select("book_id", "norm", "norm_map", "first", "last", "text")
    inside = lambda p: (p["s"] >= F.col("start")) & (p["e"] <= F.col("end"))
    chars = F.filter(F.arrays_zip(F.split("text", "").alias("c"), F.col("first").alias("s"), F.col("last").alias("e")), inside)
    own = rows.join(maps.select("book_id", "text", "first", "last"), "book_id").select("row_id", "book_id", "start", "end", key_of(F.array_join(F.transform(chars, lambda p: p["c"]), "")).alias("needle"))
    own = written(own, "own-texts")
    hays = books.select(F.col("book_id").alias("hay_id"), "book_id", F.col("norm").alias("hay"))
    hits = locate.located(hays, own.where("needle <> ''").select(F.col("row_id").alias("needle_id"), "needle", "book_id"), group="book_id").select(F.col("needle_id").alias("row_id"), F.col("hay_id").alias("book_id"), F.col("start").alias("at"), "length")
    placed = own.join(hits, ["row_id", "book_id"], "left").join(maps.select("book_id", "norm_map", "first", "last"), "book_id")
    a, b = native_range(F.col("norm_map"), F.col("first"), F.col("last"), F.col("at"), F.col("length"))
    out = placed.select("row_id", "book_id", "start", "end", F.col("needle").alias("norm"), a.alias("got_start"), b.alias("got_end"))
    if log_texts is not None:
        out = written(out, "round-trip")
        sure = dedupe.with_similar(out.where("got_start is not null").select("row_id", "book_id", "norm"), log_texts).select("row_id", F.lit(True).alias("corroborated"))
        out = out.join(sure, "row_id", "left").withColumn("corroborated", F.coalesce("corroborated", F.lit(False)))
    return out.drop("norm").withColumn("class", round_trip_class(F.col("start"), F.col("end"), F.col("got_start"), F.col("got_end")))
