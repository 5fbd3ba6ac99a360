"""A Spark data source over SQLite files, and the scans and sinks that the annotation stores need."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from quillspan.functions import payload as P
from quillspan.operators.dedupe import with_lineage

_OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _type(declared: str):
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if any(k in d for k in ("REAL", "FLOA", "DOUB", "TIMESTAMP", "NUM", "DEC")):
        return DoubleType()
    return BinaryType() if "BLOB" in d else StringType()


class SqliteSource(DataSource):
    """``format("quillspan_sqlite")`` with options path, table and, for parallel scans, partitions."""

    @classmethod
    def name(cls) -> str:
        return "quillspan_sqlite"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as con:
            found = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']!r}")
        return StructType([StructField(row[1], _type(row[2] or "")) for row in found])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


class _Rows(InputPartition):
    def __init__(self, k: int, of: int):
        self.k, self.of = k, of


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.fields, self.options = schema, options
        self.conditions: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons and null tests run in SQLite, the rest in Spark."""
        for f in filters:
            column = _quoted(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if column and isinstance(f, IsNotNull | IsNull):
                self.conditions.append(f"{column} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL")
            elif column and type(f) in _OPERATORS and isinstance(f.value, int | float | str):
                self.conditions.append(f"{column} {_OPERATORS[type(f)]} ?")
                self.values.append(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """As many as the option says, by rowid; a table without rowids is read as one."""
        n = max(1, int(self.options.get("partitions", "1")))
        if n > 1:
            with _open(self.options["path"]) as con:
                try:
                    con.execute(f"SELECT rowid FROM {_quoted(self.options['table'])} LIMIT 0")
                except sqlite3.OperationalError:
                    n = 1
        return [_Rows(k, n) for k in range(n)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        where = list(self.conditions)
        if partition.of > 1:
            n = partition.of  # the remainder of a negative rowid is negative
            where.append(f"((rowid % {n}) + {n}) % {n} = {partition.k}")
        columns = ", ".join(_quoted(f.name) for f in self.fields)
        sql = f"SELECT {columns} FROM {_quoted(self.options['table'])}" + (" WHERE " + " AND ".join(where) if where else "")
        casts = [_CASTS[type(f.dataType)] for f in self.fields]
        with _open(self.options["path"]) as con:
            for row in con.execute(sql, self.values):
                yield tuple(None if v is None else c(v) for c, v in zip(casts, row, strict=True))


_CASTS = {LongType: int, DoubleType: float, StringType: lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v), BinaryType: lambda v: v if isinstance(v, bytes) else str(v).encode()}


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off by default, and a reader that pushes is then refused
    return spark.read.format("quillspan_sqlite").option("path", path).option("table", name).load()


def library(spark: SparkSession, path: str, present: DataFrame | None = None) -> DataFrame:
    """(key, title, author, path) of titled books; with ``present`` (path) only files that are there and no PDFs."""
    books = table(spark, path, "ZBKLIBRARYASSET").where("ZTITLE is not null").select(F.col("ZASSETID").alias("key"), F.col("ZTITLE").alias("title"), F.col("ZAUTHOR").alias("author"), F.col("ZPATH").alias("path"))
    if present is None:
        return books
    return books.where(F.col("path").isNotNull() & ~F.endswith("path", F.lit(".pdf"))).join(present.select("path").distinct(), "path", "left_semi").select("key", "title", "author", "path")


def highlights(spark: SparkSession, path: str, asset: str | None = None) -> DataFrame:
    """Annotations that are neither deleted nor without text, with their colour and whether they arose there."""
    rows = table(spark, path, "ZAEANNOTATION").where("ZANNOTATIONDELETED = 0 and ZANNOTATIONTYPE = 2 and ZANNOTATIONSELECTEDTEXT is not null")
    if asset is not None:
        rows = rows.where(F.col("ZANNOTATIONASSETID") == asset)
    chapter = F.col("ZFUTUREPROOFING5")
    return rows.select(
        F.col("ZANNOTATIONUUID").alias("uuid"),
        F.col("ZANNOTATIONASSETID").alias("asset_id"),
        F.col("ZANNOTATIONSELECTEDTEXT").alias("text"),
        F.nullif(F.col("ZANNOTATIONNOTE"), F.lit("")).alias("note"),
        F.coalesce("ZANNOTATIONSTYLE", F.lit(0)).cast("int").alias("style"),
        F.coalesce(F.col("ZANNOTATIONISUNDERLINE") != 0, F.lit(False)).alias("is_underline"),
        P.from_epoch_2001(F.col("ZANNOTATIONCREATIONDATE")).alias("created"),
        chapter.alias("chapter"),
        chapter.isNotNull().alias("native"),
        P.colour(F.col("ZANNOTATIONSTYLE")).alias("color"),
        F.col("ZANNOTATIONLOCATION").alias("location"),
    )


def ground_truth(rows: DataFrame, asset: str) -> DataFrame:
    """Of ``highlights``, an asset's with an address of the kind that we make."""
    return rows.where((F.col("asset_id") == asset) & F.startswith("location", F.lit("epubcfi")))


def known_keys(rows: DataFrame, normal) -> tuple[DataFrame, DataFrame]:
    """(asset_id, address) and (asset_id, norm) that exist already, each once."""
    return rows.where("location is not null").select("asset_id", F.col("location").alias("address")).distinct(), rows.select("asset_id", normal(F.col("text")).alias("norm")).distinct()


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Books of the reader's catalogue, ids cleaned, with what follows from id and format."""
    rows = table(spark, path, "ZBOOK").where("ZBOOKID is not null and ZDISPLAYTITLE is not null and ZPATH is not null")
    mime, key = F.coalesce("ZMIMETYPE", F.lit("")), P.clean_id(F.col("ZBOOKID"))
    kind = P.content_type(key)
    guid = F.coalesce("ZPERASINGUID", F.lit(""))
    return rows.select(key.alias("book_id"), F.col("ZDISPLAYTITLE").alias("title"), F.col("ZPATH").alias("path"), mime.alias("mime"), guid.alias("guid"), F.col("ZRAWMAXPOSITION").alias("max_position"), kind.alias("content_type"), P.dataset_id(key, kind, guid).alias("dataset_id"), F.lit("").alias("author"), F.contains(mime, F.lit("mobipocket")).alias("is_mobi"), F.contains(mime, F.lit("kfx")).alias("is_kfx"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """The reader's annotations from its three tables, with the table's name as ``source``.

    Rows whose payload isn't JSON or whose positions aren't whole numbers are left out.
    """
    wide = [(n, table(spark, path, n).select("annotation_id", "dataset", "dataset_id", "serialized_payload")) for n in ("server_view", "local_edit")]
    wide.append(("nonsyncable_annotations", table(spark, path, "nonsyncable_annotations").select("annotation_id", "dataset", F.col("book_id").alias("dataset_id"), "serialized_payload")))
    rows = with_lineage(*wide)
    start, end = P.positions(F.col("serialized_payload"))
    return rows.withColumn("start", start).withColumn("end", end).where("start is not null and end is not null")


def marked_datasets(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("dataset").isin(P.HIGHLIGHT, P.UNDERLINE)).select("dataset_id").distinct()


def snapshot(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """Whole tables as they are now, columns as found; for ``snapshot_diff``."""
    return {n: table(spark, path, n) for n in names}
