"""Books of every format as one table, and the annotations whose text is read back out of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import payload as P
from quillspan.functions.markup import text_of_range
from quillspan.functions.text import stripped
from quillspan.operators.spans import text_between
from quillspan.plans.outcomes import same_space
from quillspan.sources.textlog import titled

BOOK = ["path", "text_length", "text", "first", "last", "norm", "norm_map", "raw", "encoding", "reason"]


def opened(books: DataFrame, palm: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """``books`` (path, is_mobi, is_kfx, mime, ...) with the text of the reader that their format asks for.

    ``palm`` is what ``read_palm`` gave, ``chunks`` what ``read_chunks`` did. A book of neither
    format, or that its reader lacks, has a ``reason`` instead of a text.
    """
    none = F.lit(None)
    parts = []
    if palm is not None:
        parts.append(palm.select(F.lit("palm").alias("reader"), *BOOK))
    if chunks is not None:
        own = chunks.withColumn("first", F.col("positions")).withColumn("last", F.col("positions")).withColumn("text_length", F.col("text_length").cast("int"))
        parts.append(own.withColumn("raw", none.cast("binary")).withColumn("encoding", none.cast("string")).withColumn("reason", none.cast("string")).select(F.lit("chunks").alias("reader"), *BOOK))
    wanted = books.withColumn("reader", F.when(F.col("is_kfx"), "chunks").when(F.col("is_mobi"), "palm"))
    if not parts:
        return wanted.withColumn("reason", F.lit("no reader"))
    texts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    found = wanted.join(texts.withColumn("__there", F.lit(True)), ["reader", "path"], "left")
    missing = F.when(F.col("reader").isNull(), F.concat(F.lit("unsupported format "), F.coalesce("mime", F.lit("")))).when(F.col("__there").isNull(), "no such file")
    return found.withColumn("reason", F.coalesce(missing, "reason")).drop("__there")


def annotated(books: DataFrame, annotations: DataFrame) -> DataFrame:
    """The reader's synced highlights and underlines (server_view) with their books, joined by the id in front of the dataset's dash."""
    mine = annotations.where((F.col("source") == "server_view") & F.col("dataset").isin(P.HIGHLIGHT, P.UNDERLINE))
    return mine.withColumn("book_id", F.substring_index("dataset_id", "-", 1)).drop("dataset_id").join(books, "book_id")


def reconstructed(annotations: DataFrame, books: DataFrame, title: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(clips, rejects) from the reader's annotations and its ``opened`` books (book_id, title, author, max_position, ...).

    clips: (title, author, kind, loc_start, loc_end, added, text); an annotation whose text is
    blank is left out. rejects: (title, reason), a row for each book that has annotations but
    no trustworthy text: another format, an unreadable file, or a text that counts otherwise
    than the reader's positions.
    """
    rows = titled(annotated(books, annotations), title)
    apart = F.concat(F.lit("position space mismatch ("), F.col("text_length").cast("string"), F.lit(" != app "), F.col("max_position").cast("string"), F.lit(")"))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(~same_space(F.col("text_length"), F.col("max_position")), apart)))
    rejects = rows.where("reason is not null").select("title", "reason").distinct()
    fit = rows.where("reason is null")
    by_bytes = fit.where("reader = 'palm'").withColumn("said", text_of_range("raw", "encoding", "start", "end"))
    by_place = fit.where("reader = 'chunks'").withColumn("said", text_between(F.split("text", ""), F.col("first"), F.col("start"), F.col("end")))
    clips = by_bytes.unionByName(by_place).withColumn("said", stripped(F.col("said"))).where("said <> ''")
    data = P.decoded(F.col("serialized_payload"))
    created = F.coalesce(F.nullif(data["created_time"], F.lit(0)), data["last_modified"])
    return clips.select(
        "title",
        F.nullif("author", F.lit("")).alias("author"),
        F.when(F.col("dataset") == P.UNDERLINE, "Underline").otherwise("Highlight").alias("kind"),
        F.col("start").cast("int").alias("loc_start"),
        F.col("end").cast("int").alias("loc_end"),
        P.from_epoch_ms(F.when(created > 0, created)).cast("timestamp_ntz").alias("added"),
        F.col("said").alias("text"),
    ), rejects


def cached(spark: SparkSession, path: str, folder: str, read: Callable[[SparkSession, str | list[str]], DataFrame]) -> DataFrame:
    """What ``read`` makes of the files at ``path``, kept in ``folder`` by a key of path, size and time.

    Only files whose key isn't kept are read; the list of their paths passes through the driver.
    """
    files = spark.read.format("binaryFile").load(path).select("path", P.content_key(F.col("path"), F.col("length"), F.col("modificationTime")).alias("key"))
    kept = f"{folder}/kept"
    try:
        known = spark.read.parquet(kept).select("key").distinct()
        fresh = files.join(known, "key", "left_anti")
    except Exception as e:  # noqa: BLE001 - only the missing table of a first run
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = files
    if paths := [r["path"] for r in fresh.select("path").toLocalIterator()]:
        read(spark, paths).join(F.broadcast(fresh), "path").write.mode("append").parquet(kept)
    return spark.read.parquet(kept).join(F.broadcast(files), ["path", "key"], "left_semi").drop("key")
