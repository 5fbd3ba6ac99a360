"""Registered queries over stores and book files that are first written from the driver's tables."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.catalogue import ORACLES, QUERIES, _norm
from quillspan.functions import payload as P
from quillspan.functions.text import key_of, normalized
from quillspan.operators.locate import fanned
from quillspan.plans import flows, outcomes
from quillspan.sources import annotated, books, samples, sqlite
from quillspan.storage import shared_dir


def query(sql: str | None = None):
    """Register a function of (session, table reader, an empty folder that all executors see)."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            base = shared_dir(spark)
            if not base.startswith(("file:", "/")):
                raise RuntimeError("SQLite and book files of the samples need a mounted shared folder")
            folder = Path(base.removeprefix("file://")) / f"{f.__name__}-{uuid.uuid4().hex}"
            folder.mkdir(parents=True)
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), str(folder))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _files(contents: DataFrame, folder: str) -> None:
    """Write (name, content) as files, each by the worker that has it."""

    def write(rows) -> None:
        for r in rows:
            Path(folder, r["name"]).write_bytes(r["content"])

    contents.foreachPartition(write)


_PICK = "CASE {0} WHEN 0 THEN 'application/x-mobipocket-ebook' WHEN 1 THEN 'application/x-kfx-ebook' WHEN 2 THEN 'application/pdf' END"


@query(
    f"""WITH b AS (SELECT CAST(p_partkey AS VARCHAR) AS book_id, p_name AS title, p_brand AS path, coalesce({_PICK.format('p_partkey % 4')}, '') AS mime, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_type END AS guid, CAST(p_size AS BIGINT) AS max_position
  FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 11 <> 0)
SELECT *, CASE WHEN length(book_id) = 10 THEN 'EBOK' ELSE 'PDOC' END AS content_type, book_id || '-' || CASE WHEN length(book_id) = 10 THEN 'EBOK' ELSE 'PDOC' END || '-' || guid AS dataset_id, contains(mime, 'mobipocket') AS is_mobi, contains(mime, 'kfx') AS is_kfx FROM b"""
)
def scan_catalogue(spark, t, folder):
    key = F.col("p_partkey")
    mime = F.when(key % 4 == 0, "application/x-mobipocket-ebook").when(key % 4 == 1, "application/x-kfx-ebook").when(key % 4 == 2, "application/pdf")
    book = F.when(key % 3 == 0, F.concat(F.lit("A:"), key.cast("string"), F.lit("-0"))).otherwise(key.cast("string"))
    rows = t("part").select(book, F.when(key % 10 != 0, F.col("p_name")), F.when(key % 11 != 0, F.col("p_brand")), mime, F.when(key % 5 != 0, F.col("p_type")), F.col("p_size").cast("long"))
    path = samples.stored(f"{folder}/books.sqlite", {"ZBOOK": ("ZBOOKID TEXT, ZDISPLAYTITLE TEXT, ZPATH TEXT, ZMIMETYPE TEXT, ZPERASINGUID TEXT, ZRAWMAXPOSITION INTEGER", rows)})
    return sqlite.catalogue(spark, path).drop("author")


@query(
    """SELECT 'e' || event_id AS annotation_id, CASE event_id % 3 WHEN 0 THEN 'server_view' WHEN 1 THEN 'local_edit' ELSE 'nonsyncable_annotations' END AS source, CAST(1 + event_id % 12 AS BIGINT) AS dataset, CAST(user_id AS VARCHAR) || '-PDOC-' AS dataset_id, event_id % 1000 AS start, event_id % 1000 + 17 AS "end"
FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0"""
)
def scan_annotations(spark, t, folder):
    key, at = F.col("event_id"), F.col("event_id") % 1000
    place = lambda value: F.concat(F.lit('{"longPosition":"","shortPosition":'), value, F.lit("}"))
    start = F.when(key % 17 == 0, F.lit('"7"')).when(key % 19 == 0, F.lit("7.5")).otherwise(at.cast("string"))
    payload = F.when(key % 13 == 0, F.lit("{not json")).otherwise(F.concat(F.lit('{"start_position":'), place(start), F.lit(',"end_position":'), place((at + 17).cast("string")), F.lit("}")))
    rows = t("events").select(F.concat(F.lit("e"), key.cast("string")).alias("id"), (1 + key % 12).cast("long"), F.concat(F.col("user_id").cast("string"), F.lit("-PDOC-")), payload, (key % 3).alias("k"))
    shape = "annotation_id TEXT, dataset INTEGER, {} TEXT, serialized_payload TEXT"
    names = {"server_view": "dataset_id", "local_edit": "dataset_id", "nonsyncable_annotations": "book_id"}
    path = samples.stored(f"{folder}/reader.sqlite", {n: (shape.format(c), rows.where(F.col("k") == k).drop("k")) for k, (n, c) in enumerate(names.items())})
    return sqlite.annotations(spark, path).select("annotation_id", "source", "dataset", "dataset_id", "start", "end")


@query(
    """SELECT conv_id || '.' || turn AS uuid, 'c' || conv_id AS asset_id, text, CASE WHEN turn % 3 = 1 THEN 'a note' END AS note, CAST(CASE WHEN turn % 4 = 3 THEN 0 ELSE turn % 7 END AS INTEGER) AS style, conv_id % 2 = 1 AS is_underline, turn % 5 = 0 AS native,
  CASE CASE WHEN turn % 4 = 3 THEN 0 ELSE turn % 7 END WHEN 0 THEN 'yellow' WHEN 1 THEN 'orange' WHEN 2 THEN 'blue' WHEN 3 THEN 'yellow' WHEN 4 THEN 'pink' WHEN 5 THEN 'blue' ELSE 'yellow' END AS color, 'epubcfi(' || turn || ')' AS location
FROM conversations WHERE text IS NOT NULL AND conv_id % 4 <> 3 AND turn <> 6"""
)
def scan_highlights(spark, t, folder):
    c, turn = F.col("conv_id"), F.col("turn")
    rows = t("conversations").select(
        F.concat_ws(".", c.cast("string"), turn.cast("string")), F.concat(F.lit("c"), c.cast("string")), "text", F.when(turn % 3 == 1, "a note").when(turn % 3 == 2, ""), F.when(turn % 4 != 3, turn % 7),
        (c % 2), F.lit(700000000.5), F.when(turn % 5 == 0, "chapter"), F.concat(F.lit("epubcfi("), turn.cast("string"), F.lit(")")), (c % 4 == 3).cast("int"), F.when(turn == 6, 1).otherwise(2),
    )
    columns = "ZANNOTATIONUUID TEXT, ZANNOTATIONASSETID TEXT, ZANNOTATIONSELECTEDTEXT TEXT, ZANNOTATIONNOTE TEXT, ZANNOTATIONSTYLE INTEGER, ZANNOTATIONISUNDERLINE INTEGER, ZANNOTATIONCREATIONDATE TIMESTAMP, ZFUTUREPROOFING5 TEXT, ZANNOTATIONLOCATION TEXT, ZANNOTATIONDELETED INTEGER, ZANNOTATIONTYPE INTEGER"
    path = samples.stored(f"{folder}/annotations.sqlite", {"ZAEANNOTATION": (columns, rows)})
    return sqlite.highlights(spark, path).drop("created", "chapter")


def _talks(t) -> DataFrame:
    """(conv_id, ts): each conversation's turns in order, null texts as empty ones."""
    c = t("conversations").where("conv_id is not null and turn is not null")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("ts"))


def _all_talks(t) -> DataFrame:
    """The same of all rows: those without a conversation are one of their own, turns without a number come first."""
    return t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("ts"))


def _conversation() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))


_TALKS = "WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"


def _palm_books(t, folder: str) -> str:
    made = F.udf(lambda ts, k: samples.palm("".join(f"<p>{samples.html.escape(x['text'], False)}</p>" for x in ts).encode(), compression=1 + k % 2, trailing=k % 3 == 0), "binary")
    _files(fanned(_talks(t), "conv_id").select(F.concat("conv_id", F.lit(".azw")).alias("name"), made("ts", "conv_id").alias("content")), folder)
    return folder


@query(_TALKS + " SELECT conv_id, string_agg(' ' || replace(replace(x, chr(160), ' '), chr(173), '') || ' ', '' ORDER BY i) AS text, NULL::VARCHAR AS reason FROM c GROUP BY conv_id")
def read_palm(spark, t, folder):
    read = books.read_palm(spark, _palm_books(t, folder))
    return read.select(F.regexp_extract("path", r"([^/]+)[.]azw$", 1).cast("bigint").alias("conv_id"), "text", "reason")


def _epubs(talks: DataFrame, folder: str) -> str:
    made = F.udf(lambda ts: samples.epub((f"t{k}", samples.page([x["text"]])) for k, x in enumerate(ts)), "binary")
    _files(fanned(talks, "conv_id").select(F.concat(_conversation(), F.lit(".epub")).alias("name"), made("ts").alias("content")), folder)
    return folder


@query(_TALKS + " SELECT conv_id, CAST(i AS INTEGER) AS spine, 't' || i AS idref, '/6/' || (2 * i + 2) || '[t' || i || ']' AS step, replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text, NULL::VARCHAR AS reason FROM c")
def read_epub(spark, t, folder):
    read = books.read_epub(spark, _epubs(_talks(t), folder))
    return read.select(F.regexp_extract("path", r"([^/]+)[.]epub$", 1).cast("bigint").alias("conv_id"), "spine", "idref", "step", "text", "reason")


def _chunk_books(t, folder: str) -> str:
    made = F.udf(lambda ts: samples.chunks((20_000 * k, x["text"]) for k, x in enumerate(ts)).encode(), "binary")
    _files(fanned(_talks(t), "conv_id").select(F.concat("conv_id", F.lit(".json")).alias("name"), made("ts").alias("content")), folder)
    return folder


def _chunked(spark, t, folder: str) -> DataFrame:
    read = books.read_chunks(spark, _chunk_books(t, folder))
    return read.withColumn("book_id", F.regexp_extract("path", r"([^/]+)[.]json$", 1)).withColumn("first", F.col("positions")).withColumn("last", F.col("positions"))


@query(_TALKS + " SELECT CAST(conv_id AS VARCHAR) AS book_id, string_agg(x, '' ORDER BY i) AS text, CAST(sum(length(x)) AS INTEGER) AS n, CAST(max(20000 * i + length(x) - 1) FILTER (x <> '') AS INTEGER) AS final FROM c GROUP BY conv_id")
def read_chunks(spark, t, folder):
    return _chunked(spark, t, folder).select("book_id", "text", F.size("positions").alias("n"), F.try_element_at("positions", F.lit(-1)).alias("final"))


@query(
    _TALKS
    + """, b AS (SELECT conv_id, i, CASE WHEN conv_id % 4 = 3 THEN 'unsupported format application/pdf' END AS reason, x FROM c)
SELECT 'book ' || conv_id AS title, CASE WHEN i % 2 = 0 THEN 'Highlight' ELSE 'Underline' END AS kind, CAST(20000 * i AS INTEGER) AS loc_start, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS text, NULL::VARCHAR AS reason FROM b WHERE reason IS NULL AND regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> ''
UNION ALL SELECT DISTINCT 'book ' || conv_id, NULL, NULL, NULL, reason FROM b WHERE reason IS NOT NULL AND x <> ''"""
)
def reconstruct_clips(spark, t, folder):
    read = _chunked(spark, t, folder)
    found = _talks(t).select("conv_id", F.posexplode("ts").alias("i", "x")).where("x.text <> ''")
    end = 20_000 * F.col("i") + F.length("x.text") - 1
    payload = F.to_json(F.struct(F.lit(1714903872000).alias("created_time")))
    notes = found.select(F.lit("server_view").alias("source"), F.when(F.col("i") % 2 == 0, P.HIGHLIGHT).otherwise(P.UNDERLINE).alias("dataset"), F.concat(F.col("conv_id").cast("string"), F.lit("-PDOC-")).alias("dataset_id"), (20_000 * F.col("i")).alias("start"), end.alias("end"), payload.alias("serialized_payload"))
    key = F.col("conv_id")
    shelf = _talks(t).select(key.cast("string").alias("book_id"), F.concat(F.lit("book "), key.cast("string")).alias("title"), F.lit("").alias("author"), F.lit(None).cast("bigint").alias("max_position"), (key % 4 != 3).alias("is_kfx"), F.lit(False).alias("is_mobi"), F.when(key % 4 == 3, "application/pdf").otherwise("kfx").alias("mime"))
    shelf = shelf.join(read.select("book_id", "path"), "book_id")
    clips, rejects = annotated.reconstructed(notes, annotated.opened(shelf, chunks=read))
    none = F.lit(None).cast("string")
    return clips.select("title", "kind", "loc_start", "text", none.alias("reason")).unionByName(rejects.select("title", none.alias("kind"), F.lit(None).cast("int").alias("loc_start"), none.alias("text"), "reason"))


@query(
    _TALKS
    + f""", d AS (SELECT conv_id, i, x, {_norm('x')} AS n FROM c),
q AS (SELECT conv_id, i, CASE WHEN i % 4 = 3 THEN 'no such words anywhere' ELSE x END AS said FROM d),
m AS (SELECT q.*, {_norm('said')} AS needle, {_norm(r"regexp_replace(said, '\[(?:\*|\*?\d+)\]', '', 'g')")} AS bare FROM q),
h AS (SELECT m.conv_id, m.i, min(d.i) AS hit FROM m JOIN d ON m.conv_id = d.conv_id AND contains(d.n, m.bare) WHERE m.bare <> '' GROUP BY 1, 2)
SELECT 1000 * m.conv_id + m.i AS seq, CASE WHEN m.conv_id % 5 = 0 THEN 'unmatched' WHEN m.conv_id % 5 = 1 AND EXISTS (SELECT 1 FROM d k WHERE k.conv_id = m.conv_id AND k.i = 0 AND k.n = m.needle) THEN 'duplicate' WHEN hit IS NULL THEN 'miss'
  WHEN m.conv_id % 5 = 2 AND hit = 1 AND strpos(w.n, bare) = 1 AND length(w.n) = length(bare) AND length(w.n) = length(w.x) THEN 'duplicate' ELSE 'found' END AS outcome, CASE WHEN m.conv_id % 5 <> 0 AND NOT (m.conv_id % 5 = 1 AND EXISTS (SELECT 1 FROM d k WHERE k.conv_id = m.conv_id AND k.i = 0 AND k.n = m.needle)) THEN CAST(hit AS INTEGER) END AS spine
FROM m LEFT JOIN h USING (conv_id, i) LEFT JOIN d w ON w.conv_id = m.conv_id AND w.i = h.hit"""
)
def flow_to_addresses(spark, t, folder):
    """Every turn as a clip of its conversation's book; one in four says what no book does."""
    read = books.read_epub(spark, _epubs(_talks(t), folder)).withColumn("book_id", F.regexp_extract("path", r"([^/]+)[.]epub$", 1))
    turns = _talks(t).select("conv_id", F.posexplode("ts").alias("i", "x"))
    name = F.md5(F.col("conv_id").cast("string").cast("binary"))
    said = F.when(F.col("i") % 4 == 3, "no such words anywhere").otherwise(F.col("x.text"))
    clips = turns.select((1000 * F.col("conv_id") + F.col("i")).alias("seq"), name.alias("title"), F.lit(None).cast("string").alias("author"), F.lit("Highlight").alias("kind"), said.alias("text"))
    shelf = _talks(t).where("conv_id % 5 <> 0").select(F.col("conv_id").alias("seq"), F.col("conv_id").cast("string").alias("key"), name.alias("title"), F.lit(None).cast("string").alias("author"))
    none = F.lit(None).cast("string")
    texts = turns.where("conv_id % 5 = 1 and i = 0").select(F.col("conv_id").cast("string").alias("asset_id"), none.alias("address"), normalized(F.col("x.text")).alias("norm"))
    whole = F.concat(F.lit("epubcfi(/6/4[t1]!/4/2/1,:0,:"), F.length("x.text").cast("string"), F.lit(")"))
    places = turns.where("conv_id % 5 = 2 and i = 1").select(F.col("conv_id").cast("string").alias("asset_id"), whole.alias("address"), none.alias("norm"))
    out = flows.log_to_addresses(clips, shelf, read, texts.unionByName(places))
    spine = F.regexp_extract("address", r"^epubcfi\(/6/(\d+)", 1)
    return out.select("seq", "outcome", (F.nullif(spine, F.lit("")).cast("int") / 2 - 1).cast("int").alias("spine"))


@query(
    f"""WITH c AS (SELECT coalesce(CAST(conv_id AS VARCHAR), 'null') AS book_id, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(text, '')) - 1 AS i FROM conversations),
d AS (SELECT book_id, i, x, {_norm('x')} AS n FROM c),
h AS (SELECT m.book_id, m.i, min(d.i) AS hit, any_value(length(m.n) = length(m.x)) AS plain FROM d m JOIN d ON m.book_id = d.book_id AND contains(d.n, m.n) WHERE m.n <> '' GROUP BY 1, 2)
SELECT book_id, count(*) AS total, count(*) FILTER (hit = i AND plain) AS exact, count(*) FILTER (hit = i AND NOT plain) AS close, count(*) FILTER (hit <> i) AS miss, count(*) FILTER (hit = i AND plain) / count(*) AS rate, count(*) FILTER (hit = i AND plain) / count(*) >= 0.95 AS passes FROM h GROUP BY ROLLUP (1)"""
)
def validate_addresses(spark, t, folder):
    """Ground truth: the address of every turn as a whole, searched for by its text in its conversation's book."""
    read = books.read_epub(spark, _epubs(_all_talks(t), folder)).withColumn("book_id", F.regexp_extract("path", r"([^/]+)[.]epub$", 1))
    turns = _all_talks(t).select("conv_id", _conversation().alias("book_id"), F.posexplode("ts").alias("i", "x"))
    step = F.concat(F.lit("epubcfi(/6/"), (2 * F.col("i") + 2).cast("string"), F.lit("[t"), F.col("i").cast("string"), F.lit("]!/4/2/1,:0,:"), F.length("x.text").cast("string"), F.lit(")"))
    # a number that no conversation has stands for the one without
    number = F.coalesce(F.col("conv_id").cast("decimal(20,0)"), F.lit("-10000000000000000000").cast("decimal(20,0)"))
    truth = turns.select(F.concat_ws("#", "book_id", F.col("i").cast("string")).alias("seq"), F.md5(F.col("book_id").cast("binary")).alias("title"), F.lit(None).cast("string").alias("author"), F.lit("Highlight").alias("kind"), F.col("x.text").alias("text"), step.alias("want"), "book_id", number.alias("number"))
    truth = truth.where(normalized(F.col("text")) != "")
    shelf = truth.select(F.col("number").alias("seq"), F.col("book_id").alias("key"), "title", "author").distinct()
    none = spark.createDataFrame([], "asset_id string, address string, norm string")
    got = flows.log_to_addresses(truth.drop("want", "book_id", "number"), shelf, read, none).select("seq", "address")
    rows = truth.join(got, "seq", "left").withColumn("class", outcomes.address_class(F.col("want"), F.col("address")))
    return outcomes.validation(rows)


def _ranges(t) -> DataFrame:
    """(row_id, book_id, start, end, text) of every turn that has a text."""
    turns = _talks(t).select("conv_id", F.posexplode("ts").alias("i", "x")).where("x.text <> ''")
    return turns.select((1000 * F.col("conv_id") + F.col("i")).alias("row_id"), F.col("conv_id").cast("string").alias("book_id"), (20_000 * F.col("i")).alias("start"), (20_000 * F.col("i") + F.length("x.text") - 1).alias("end"), F.col("x.text").alias("text"))


@query()
def flow_to_positions(spark, t, folder):
    """Every turn as a highlight of its conversation's book, of which some are known and some come from the log."""
    rows = _ranges(t)
    known = rows.where("row_id % 1000 = 0 and floor(row_id / 1000) % 4 = 1")
    log = rows.where("row_id % 1000 = 2 and floor(row_id / 1000) % 4 = 2").select("book_id", key_of(F.col("text")).alias("norm"))
    known = known.select("book_id", "start", "end", key_of(F.col("text")).alias("norm"), P.annotation_id(F.lit("highlight"), F.col("start")).alias("ann_id"))
    wanted = rows.select(F.col("row_id").alias("seq"), "book_id", "text", F.lit(False).alias("is_underline"))
    out = flows.highlights_to_positions(wanted, _chunked(spark, t, folder), known, log)
    return out.select("seq", "book_id", "outcome", "start", "end")


@query()
def round_trip(spark, t, folder):
    rows = _ranges(t)
    log = rows.where("row_id % 2 = 0").select("book_id", key_of(F.col("text")).alias("norm"))
    return outcomes.validation(flows.round_trip(rows.drop("text"), _chunked(spark, t, folder), log))
