"""Registered queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import payload as P
from quillspan.functions import text as X
from quillspan.functions.markup import with_markup_stripped
from quillspan.operators import dedupe, locate, match, spans
from quillspan.plans import outcomes
from quillspan.sources import textlog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (table reader) under its name, with its SQL."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sql_text(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


def _norm(x: str) -> str:
    """``normalized`` in DuckDB's SQL."""
    return f"trim(regexp_replace(lower(translate({x}, {_sql_text(X._FROM)}, {_sql_text(X._TO)})), ' +', ' ', 'g'))"


_MARKERS = r"'\[(?:\*|\*?\d+)\]'"


def _hays(t) -> DataFrame:
    return locate.spread(t("documents").select("doc_id", "text")).select(F.col("doc_id").alias("hay_id"), X.normalized(F.col("text")).alias("hay"))


def _needles(t, change=lambda n: n) -> DataFrame:
    norm = X.key_of(F.col("text"))
    return t("benchmark").select(F.col("item_id").alias("needle_id"), change(norm).alias("needle"))


_HN = f"WITH h AS (SELECT doc_id, {_norm('text')} AS hay FROM documents), n0 AS (SELECT item_id, {_norm(f'regexp_replace(text, {_MARKERS}, {chr(39) * 2}, {chr(39)}g{chr(39)})')} AS needle FROM benchmark)"


@query(_HN + " SELECT item_id, doc_id, CAST(strpos(hay, needle) - 1 AS INTEGER) AS start, CAST(length(needle) AS INTEGER) AS length FROM n0 JOIN h ON contains(hay, needle) WHERE needle <> ''")
def locate_exact(t):
    hits = locate.located_natively(_hays(t), _needles(t)).where("stage = 'exact'")
    return hits.select(F.col("needle_id").alias("item_id"), F.col("hay_id").alias("doc_id"), "start", "length")


@query(f"SELECT doc_id, {_norm('text')} AS norm FROM documents")
def normalize_text(t):
    return t("documents").select("doc_id", X.normalized(F.col("text")).alias("norm"))


_FOLDED = f"translate(text, {_sql_text(X._FROM)}, {_sql_text(X._TO)})"


@query(f"SELECT doc_id, CAST(length({_norm('text')}) AS INTEGER) AS n, CAST(length({_FOLDED}) - length(ltrim({_FOLDED}, ' ')) AS INTEGER) AS first_at, CAST(length(rtrim({_FOLDED}, ' ')) - 1 AS INTEGER) AS last_at FROM documents WHERE {_norm('text')} <> ''")
def normalize_map_stats(t):
    m = t("documents").select("doc_id", X.normal_map(F.col("text")).alias("m")).where(F.size("m") > 0)
    return m.select("doc_id", F.size("m").alias("n"), F.get("m", F.lit(0)).alias("first_at"), F.element_at("m", -1).alias("last_at"))


@query(r"SELECT doc_id, regexp_replace(left(text, 40) || '[*4] and [12]' || substr(text, 41) || '[*]', '\[(?:\*|\*?\d+)\]', '', 'g') AS plain FROM documents")
def strip_markers(t):
    marked = F.concat(F.left("text", F.lit(40)), F.lit("[*4] and [12]"), F.substring("text", F.lit(41), F.length("text")), F.lit("[*]"))
    return t("documents").select("doc_id", X.without_markers(marked).alias("plain"))


def _cut(n):
    return F.concat(F.left(n, F.lit(80)), F.substring(n, F.lit(101), F.length(n)))


@query(
    _HN
    + """, n AS (SELECT item_id, left(needle, 80) || substr(needle, 101) AS needle FROM n0),
p AS (SELECT item_id, doc_id, hay, needle, strpos(hay, left(needle, 60)) AS a FROM n JOIN h ON contains(hay, left(needle, 60)) WHERE length(needle) > 120 AND NOT contains(hay, needle)),
q AS (SELECT *, strpos(substr(hay, a), right(needle, 60)) AS b FROM p)
SELECT item_id, doc_id, CAST(a - 1 AS INTEGER) AS start, CAST(b - 1 + 60 AS INTEGER) AS length FROM q WHERE b > 0 AND b - 1 + 60 <= length(needle) * 1.3 + 60"""
)
def locate_anchor(t):
    hits = locate.located_natively(_hays(t), _needles(t, _cut)).where("stage = 'anchor'")
    return hits.select(F.col("needle_id").alias("item_id"), F.col("hay_id").alias("doc_id"), "start", "length")


def _spoilt(n):
    return F.concat(F.lit("#" * 12), F.substring(n, F.lit(13), F.length(n)))


@query()
def locate_fuzzy(t):
    hits = locate.located_fuzzily(_hays(t), _needles(t, _spoilt))
    return hits.select(F.col("needle_id").alias("item_id"), F.col("hay_id").alias("doc_id"), "start", "length", "score")


@query()
def locate_cascade(t):
    kinds = [lambda n: n, _cut, _spoilt]
    mixed = _needles(t, lambda n: F.when(F.col("item_id") % 3 == 0, kinds[0](n)).when(F.col("item_id") % 3 == 1, kinds[1](n)).otherwise(kinds[2](n)))
    hits = locate.located(_hays(t), mixed)
    return hits.select(F.col("needle_id").alias("item_id"), F.col("hay_id").alias("doc_id"), "stage", "start", "length", "score")


@query()
def locate_in_books(t):
    docs = _hays(t).withColumn("book_id", F.floor(F.col("hay_id") / 10)).withColumn("spine", (F.col("hay_id") % 10).cast("int"))
    return locate.located_in_books(docs, _needles(t, _spoilt)).select(F.col("needle_id").alias("item_id"), "book_id", "hay_id", "stage", "start", "length", "score")


_CLIPS_SQL = "WITH c AS (SELECT 'b' || (conv_id % 40) AS title, conv_id * 1000 + turn AS seq, CAST((conv_id * 7 + turn * 5) % 300 AS INTEGER) AS s, CAST((conv_id * 7 + turn * 5) % 300 + length(text) % 30 AS INTEGER) AS e, substr(text, CAST(1 + turn % 3 AS INTEGER)) AS txt FROM conversations WHERE text IS NOT NULL)"


def _clips(t) -> DataFrame:
    at = ((F.col("conv_id") * 7 + F.col("turn") * 5) % 300).cast("int")
    c = t("conversations").where("text is not null")
    return c.select(F.concat(F.lit("b"), (F.col("conv_id") % 40).cast("string")).alias("title"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), at.alias("loc_start"), (at + F.length("text") % 30).cast("int").alias("loc_end"), F.substring("text", (1 + F.col("turn") % 3).cast("int"), F.length("text")).alias("text"))


@query(
    _CLIPS_SQL
    + r""", u AS (SELECT *, regexp_replace(txt, '^\s+|\s+$', '', 'g') AS x FROM c)
SELECT title, seq FROM u k WHERE NOT EXISTS (SELECT 1 FROM u n WHERE n.title = k.title AND n.seq > k.seq AND k.s <= n.e AND n.s <= k.e AND (
  contains(k.x, n.x) OR contains(n.x, k.x)
  OR (CASE WHEN length(k.x) <= length(n.x) THEN starts_with(n.x, left(k.x, 20)) OR ends_with(n.x, right(k.x, 20)) ELSE starts_with(k.x, left(n.x, 20)) OR ends_with(k.x, right(n.x, 20)) END)))"""
)
def dedupe_overlap(t):
    return dedupe.without_superseded(_clips(t)).select("title", "seq")


_EVENT_RANGES = "SELECT event_id, user_id, CAST(epoch_us(ts) // 1000000 % 100000 AS BIGINT) AS s, CAST(epoch_us(ts) // 1000000 % 100000 + CAST(floor(abs(value)) AS BIGINT) % 5000 AS BIGINT) AS e FROM events WHERE value IS NOT NULL"


def _ranges(t) -> DataFrame:
    s = (F.unix_micros(F.col("ts").cast("timestamp")).cast("bigint") / 1000000).cast("bigint") % 100000
    return t("events").where("value is not null").select("event_id", F.col("user_id").alias("book_id"), s.alias("start"), (s + F.floor(F.abs("value")) % 5000).alias("end"))


@query(f"WITH r AS ({_EVENT_RANGES}) SELECT event_id FROM r a WHERE event_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM r b WHERE b.event_id % 3 = 0 AND a.user_id = b.user_id AND least(a.e, b.e) - greatest(a.s, b.s) >= 0.5 * least(a.e - a.s, b.e - b.s))")
def range_overlap_anti(t):
    r = _ranges(t)
    return dedupe.without_covered(r.where("event_id % 3 <> 0"), r.where("event_id % 3 = 0")).select("event_id")


@query(f"SELECT doc_id FROM documents WHERE {_norm('text')} NOT IN (SELECT {_norm('text')} FROM documents WHERE doc_id % 2 = 0) AND doc_id % 2 = 1")
def exact_text_anti(t):
    keyed = t("documents").select("doc_id", F.sha2(X.normalized(F.col("text")).cast("binary"), 256).alias("norm"))
    return dedupe.without_known(keyed.where("doc_id % 2 = 1"), keyed.where("doc_id % 2 = 0"), ["norm"]).select("doc_id")


@query("WITH f AS (SELECT * FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_orderkey % 7 = 0 AND k.l_suppkey = l.l_suppkey AND k.l_partkey = l.l_partkey)) SELECT l_suppkey, CAST(l_quantity AS INTEGER) AS q, min(l_orderkey * 10 + l_linenumber) AS seq FROM f GROUP BY 1, 2")
def first_per_start(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("book_id"), F.col("l_quantity").cast("int").alias("start"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").alias("ann_id"), "l_orderkey")
    kept = dedupe.first_per_start(rows, rows.where("l_orderkey % 7 = 0"))
    return kept.select(F.col("book_id").alias("l_suppkey"), F.col("start").alias("q"), "seq")


@query(
    """WITH a AS (SELECT o_orderkey % 500 AS k, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS p FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey % 500 AS k, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS p FROM orders WHERE o_orderkey % 4 <> 0)
SELECT *, 'added' AS op FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = b.k AND a.o_orderstatus = b.o_orderstatus AND a.p IS NOT DISTINCT FROM b.p)
UNION ALL SELECT *, 'removed' AS op FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.k = b.k AND a.o_orderstatus = b.o_orderstatus AND a.p IS NOT DISTINCT FROM b.p)"""
)
def snapshot_diff(t):
    rows = t("orders").select((F.col("o_orderkey") % 500).alias("k"), "o_orderstatus", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("p"), "o_orderkey")
    return dedupe.snapshot_diff(rows.where("o_orderkey % 3 <> 0").drop("o_orderkey"), rows.where("o_orderkey % 4 <> 0").drop("o_orderkey"))


@query("SELECT c_custkey AS id, c_nationkey AS nation, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, s_nationkey, 'supplier' FROM supplier")
def union_lineage(t):
    return dedupe.with_lineage(("customer", t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))), ("supplier", t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))))


_TITLE_SQL = r"trim(regexp_replace(regexp_replace(lower(regexp_replace(replace({0}, '_', ' '), '--.*$', '')), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_STOPS = ", ".join(f"'{w}'" for w in [*X._STOP, ""])


@query(f"SELECT p_partkey, p_name || ' - The ' || p_type AS title, {_TITLE_SQL.format(chr(40) + 'p_name || ' + chr(39) + ' - The ' + chr(39) + ' || p_type' + chr(41))} AS title_key FROM part")
def title_keys(t):
    title = F.concat("p_name", F.lit(" - The "), "p_type")
    return t("part").select("p_partkey", title.alias("title"), X.title_key(title).alias("title_key"))


@query(
    f"""WITH p AS (SELECT p_partkey, list_distinct(list_filter(string_split({_TITLE_SQL.format('p_name')}, ' '), lambda w: w NOT IN ({_STOPS}))) AS a,
  list_distinct(list_filter(string_split({_TITLE_SQL.format('p_type')}, ' '), lambda w: w NOT IN ({_STOPS}))) AS b FROM part)
SELECT p_partkey, len(a) AS n_name, len(b) AS n_type, len(list_intersect(a, b)) / least(len(a), len(b)) AS overlap FROM p"""
)
def title_tokens_overlap(t):
    a, b = X.title_tokens(F.col("p_name")), X.title_tokens(F.col("p_type"))
    return t("part").select("p_partkey", F.size(a).cast("bigint").alias("n_name"), F.size(b).cast("bigint").alias("n_type"), X.overlap(a, b).alias("overlap"))


@query()
def match_best(t):
    """Titles as they are, inside a longer one, misspelt, and of another author, against the names of all parts."""
    parts, k = t("part"), F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat("p_name", F.lit(" -- Vol. 1"))).when(k == 1, F.concat(F.lit("The "), "p_name", F.lit(" of the "), "p_type")).when(k == 2, F.translate("p_name", "aei", "eia")).otherwise(F.col("p_name"))
    titles = parts.select(F.col("p_partkey").alias("key"), name.alias("title"), F.when(k == 3, "Nobody Else").otherwise(F.col("p_brand")).alias("author"))
    library = parts.groupBy("p_name").agg(F.min("p_partkey").alias("seq"), F.min("p_brand").alias("lib_author")).select("seq", F.col("seq").alias("lib_key"), F.col("p_name").alias("lib_title"), "lib_author")
    return match.best_match(titles, library)


def _said(t, text) -> DataFrame:
    """(row_id, book_id, norm): a row a turn, its conversation as its book."""
    turns = t("conversations").where("conv_id is not null")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("conv_id").alias("book_id"), X.key_of(text).alias("norm"))


@query()
def similar_text(t):
    """Whole turns of a conversation against each other, and against what users said with every tenth character gone."""
    own = _said(t, F.col("text"))
    spoilt = _said(t, F.when(F.col("role") == "user", F.regexp_replace("text", "(.{9}).", "$1"))).withColumn("row_id", -F.col("row_id") - 1)
    turns = dedupe.similar_pairs_of(own, own.withColumnRenamed("row_id", "other"), 0.8, later=True)
    return turns.unionByName(dedupe.similar_pairs_of(own, spoilt.withColumnRenamed("row_id", "other"), 0.8))


@query()
def corroborated(t):
    """Turns that another turn of their conversation, a tenth of whose characters are gone, corroborates."""
    rows = _said(t, F.col("text"))
    known = _said(t, F.when(F.col("turn") % 2 == 0, F.regexp_replace("text", "(.{9}).", "$1")).otherwise(F.reverse("text")))
    return dedupe.with_similar(rows, known).select("row_id", "book_id")


@query()
def similar_anti(t):
    """Turns that no known turn of their conversation resembles."""
    rows = _said(t, F.col("text"))
    return dedupe.without_similar(rows, rows.where("row_id % 3 = 0").withColumn("norm", F.left("norm", F.greatest(F.lit(1), (F.length("norm") * 0.9).cast("int"))))).select("row_id", "book_id")


@query("SELECT event_id, TRY_CAST(props ->> '$.k' AS BIGINT) AS k FROM events WHERE TRY_CAST(props ->> '$.k' AS BIGINT) IS NOT NULL")
def payload_decode(t):
    return t("events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k")).where("k is not null")


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS asin, CASE WHEN length(CAST(user_id AS VARCHAR)) = 10 THEN 'EBOK' ELSE 'PDOC' END AS kind, event_id % 1000 AS start, event_id % 1000 + 17 AS until, event_type AS color, 'app.highlight-' || (event_id % 1000) AS ann_id FROM events")
def payload_round_trip(t):
    e, at, book = t("events"), F.col("event_id") % 1000, F.col("user_id").cast("string")
    made = P.encoded(book, F.lit("HIGHLIGHT"), F.lit(None).cast("string"), at, at + 17, F.struct(F.col("event_type").alias("mchl_color")), F.lit(1714903872000))
    p = e.select("event_id", P.decoded(made).alias("p"), P.annotation_id(F.lit("highlight"), at).alias("ann_id"))
    inner = F.from_json("p.json_metadata", "mchl_color string").getField("mchl_color")
    return p.select("event_id", F.col("p.book_data.asin").alias("asin"), F.col("p.book_data.contentType").alias("kind"), F.col("p.start_position.shortPosition").alias("start"), F.col("p.end_position.shortPosition").alias("until"), inner.alias("color"), "ann_id")


@query("SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'yellow' WHEN 1 THEN 'orange' WHEN 2 THEN 'blue' WHEN 3 THEN 'yellow' WHEN 4 THEN 'pink' WHEN 5 THEN 'blue' ELSE 'yellow' END AS color FROM part")
def style_colour(t):
    return t("part").select("p_partkey", P.colour(F.col("p_size") % 8).alias("color"))


@query("SELECT p_partkey, regexp_replace(regexp_replace('A:' || p_partkey || '-0', '^A:', ''), '-0$', '') AS book_id, 'PDOC' AS content_type, p_partkey || '-PDOC-' || p_brand AS dataset_id, split_part(p_partkey || '-PDOC-' || p_brand, '-', 1) AS back FROM part WHERE length(CAST(p_partkey AS VARCHAR)) <> 10")
def catalogue_ids(t):
    key = P.clean_id(F.concat(F.lit("A:"), F.col("p_partkey").cast("string"), F.lit("-0")))
    rows = t("part").select("p_partkey", key.alias("book_id"), P.content_type(key).alias("content_type"), P.dataset_id(key, P.content_type(key), F.col("p_brand")).alias("dataset_id")).where(F.length(F.col("p_partkey").cast("string")) != 10)
    return rows.withColumn("back", F.substring_index("dataset_id", "-", 1))


@query("SELECT event_id, epoch_us(ts) // 1000 - 978307200000 AS ms_2001, epoch_us(ts) // 1000 AS ms FROM events")
def epoch_convert(t):
    ts = F.col("ts").cast("timestamp")
    back = P.from_epoch_ms(F.unix_millis(ts))
    return t("events").select("event_id", F.floor(F.round(P.to_epoch_2001(ts) * 1e6) / 1000).alias("ms_2001"), F.unix_millis(back).alias("ms"))


_LOCATED = _HN + ", l AS (SELECT DISTINCT item_id FROM n0 JOIN h ON contains(hay, needle) WHERE needle <> '')"


def _outcomes(t) -> DataFrame:
    hits = locate.located_natively(_hays(t), _needles(t)).groupBy("needle_id").agg(F.max("score").alias("score"))
    rows = t("benchmark").select("item_id", F.concat(F.lit("t"), (F.col("item_id") % 5).cast("string")).alias("title"), F.col("item_id").alias("seq"), (F.col("item_id") % 7 == 0).alias("known_text"), (F.col("item_id") % 11 == 1).alias("known_address"))
    # of those that are found, every third is but weakly
    found = rows.join(hits, F.col("item_id") == F.col("needle_id"), "left").withColumn("score", F.when(F.col("item_id") % 3 == 2, F.col("score") * 0.6).otherwise(F.col("score")))
    return found.withColumn("outcome", outcomes.to_addresses())


_FOUND = "item_id % 7 <> 0 AND item_id IN (SELECT item_id FROM l)"


@query(
    _LOCATED
    + f""" SELECT 't' || (item_id % 5) AS title, count(*) FILTER ({_FOUND} AND item_id % 3 <> 2 AND item_id % 11 <> 1) AS found, count(*) FILTER ({_FOUND} AND item_id % 3 = 2) AS weak,
count(*) FILTER (item_id % 7 <> 0 AND item_id NOT IN (SELECT item_id FROM l)) AS miss, count(*) FILTER (item_id % 7 = 0 OR ({_FOUND} AND item_id % 3 <> 2 AND item_id % 11 = 1)) AS duplicate, 0::BIGINT AS echo, 0::BIGINT AS empty FROM benchmark GROUP BY 1"""
)
def outcome_counts(t):
    return outcomes.outcome_counts(_outcomes(t))


@query(_LOCATED + " SELECT item_id, 't' || (item_id % 5) AS title, row_number() OVER (ORDER BY 't' || (item_id % 5), item_id) AS plan_seq FROM benchmark WHERE item_id % 7 <> 0 AND item_id IN (SELECT item_id FROM l) AND item_id % 3 <> 2 AND item_id % 11 <> 1 ORDER BY 2, 1 LIMIT 10")
def plan_limit(t):
    return outcomes.plan(_outcomes(t), limit=10).select("item_id", "title", "plan_seq")


@query("WITH v AS (SELECT CAST(event_id % 4 AS BIGINT) AS book_id, CASE WHEN event_id % 11 = 0 THEN 'miss' WHEN event_id % 5 <= 2 THEN 'exact' ELSE 'close' END AS c FROM events) SELECT book_id, count(*) AS total, count(*) FILTER (c = 'exact') AS exact, count(*) FILTER (c = 'close') AS close, count(*) FILTER (c = 'miss') AS miss, count(*) FILTER (c = 'exact') / count(*) AS rate, count(*) FILTER (c = 'exact') / count(*) >= 0.95 AS passes FROM v GROUP BY ROLLUP (book_id)")
def validate_rates(t):
    e, at = t("events"), F.col("event_id")
    got = F.when(at % 11 != 0, at + at % 5)
    rows = e.select((at % 4).alias("book_id"), outcomes.round_trip_class(at, at + 9, got, got + 9).alias("class"))
    return outcomes.validation(rows)


@query("SELECT source AS title, count(*) AS n, min(doc_id) AS first_seq FROM documents GROUP BY source ORDER BY n DESC, first_seq LIMIT 10")
def group_counts_topn(t):
    return outcomes.counts_by_title(t("documents").select(F.col("source").alias("title"), F.col("doc_id").alias("seq"))).limit(10)


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_partkey) + 1000 AS pk FROM part")
def surrogate_keys(t):
    return outcomes.numbered(t("part").select("p_partkey", "p_brand"), [F.col("p_brand"), F.col("p_partkey")], "pk", 1000).select("p_partkey", "pk")


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM lineitem),
q AS (SELECT o_orderkey, o_custkey % 120 AS off FROM orders)
SELECT o_orderkey, off, r.l_linenumber FROM q ASOF JOIN r ON q.o_orderkey = r.l_orderkey AND q.off >= r.at"""
)
def asof_run(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("bigint").alias("n")))).alias("ls"))
    starts = F.transform("ls", lambda x, i: F.struct(x["l_linenumber"].alias("line"), F.aggregate(F.slice("ls", F.lit(1), i), F.lit(0).cast("bigint"), lambda a, y: a + y["n"]).alias("doc_start")))
    q = t("orders").select("o_orderkey", (F.col("o_custkey") % 120).alias("off"))
    met = q.join(lines.select(F.col("l_orderkey").alias("o_orderkey"), starts.alias("runs")), "o_orderkey")
    return met.select("o_orderkey", "off", spans.run_at(F.col("runs"), F.col("off"))["line"].alias("l_linenumber"))


@query("SELECT o_orderkey, CAST(o_orderkey % 40 AS INTEGER) AS spine, 'epubcfi(/6/' || (2 * (o_orderkey % 40) + 2) || '[ch' || o_orderkey || ']' AS document FROM orders")
def spine_of_address(t):
    address = F.concat(F.lit("epubcfi(/6/"), (2 * (F.col("o_orderkey") % 40) + 2).cast("string"), F.lit("[ch"), F.col("o_orderkey").cast("string"), F.lit("]!/4/2,/1:0,/1:9)"))
    return t("orders").select("o_orderkey", spans.spine_index(address).alias("spine"), spans.document_part(address).alias("document"))


@query("WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations) SELECT conv_id, string_agg(x, '' ORDER BY turn, x) AS whole, CAST(sum(length(x)) AS INTEGER) AS n, CAST(max(turn * 5000 + length(x) - 1) AS INTEGER) AS last_position, CAST(min(turn * 5000) FILTER (x <> '') AS INTEGER) AS first_position FROM c GROUP BY conv_id")
def chunk_map(t):
    chunks = t("conversations").groupBy("conv_id").agg(F.collect_list(F.struct((F.col("turn") * 5000).cast("int").alias("pid"), F.coalesce("text", F.lit("")).alias("text"))).alias("cs"))
    at = spans.chunk_positions(F.col("cs"))
    return chunks.select("conv_id", spans.chunk_text(F.col("cs")).alias("whole"), F.size(at).alias("n"), spans.last_position(F.col("cs")).alias("last_position"), F.get(at, F.lit(0)).alias("first_position"))


@query("SELECT doc_id, substr(text, 6, greatest(length(text) - 10, 0)) AS part FROM documents WHERE text IS NOT NULL")
def text_of_positions(t):
    docs = t("documents").where("text is not null").select("doc_id", F.filter(F.split("text", ""), lambda c: c != "").alias("cs"), F.length("text").alias("n"))
    at = F.transform("cs", lambda c, i: i * 3 + 100)
    return docs.select("doc_id", spans.text_between(F.col("cs"), at, F.lit(115), 100 + 3 * (F.col("n") - 6)).alias("part"))


@query("SELECT doc_id, 'Vol. ' || doc_id AS title, source AS author, CASE WHEN doc_id % 2 = 0 THEN 'Highlight' ELSE 'Note' END AS kind, CAST(doc_id + 1 AS INTEGER) AS loc_start, CAST(doc_id + 9 AS INTEGER) AS loc_end, make_timestamp(2024, 5, CAST(1 + doc_id % 28 AS BIGINT), 10, 11, 12.0) AS added, regexp_replace(regexp_replace(string_split(text, '==========')[1], '\\r\\n?', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS body FROM documents WHERE text IS NOT NULL")
def parse_log(t):
    day = (1 + F.col("doc_id") % 28).cast("string")
    head = F.concat(F.lit("\ufeffVol. "), F.col("doc_id").cast("string"), F.lit(" ("), "source", F.lit(")\r\n- Your "), F.when(F.col("doc_id") % 2 == 0, "Highlight").otherwise("Note"))
    meta = F.concat(F.lit(" on page xii | Location "), (F.col("doc_id") + 1).cast("string"), F.lit("-"), (F.col("doc_id") + 9).cast("string"), F.lit(" | Added on Sunday, "), day, F.lit(" May 2024 10:11:12\r\n\r\n"))
    docs = t("documents").where("text is not null")
    logs = docs.select(F.col("doc_id").cast("string").alias("path"), F.concat(head, meta, "text", F.lit("\r\n==========\r\nno entry\r\n==========\r\n")).alias("value"))
    return textlog.parsed(logs).select(F.col("path").cast("bigint").alias("doc_id"), "title", "author", "kind", "loc_start", "loc_end", "added", F.col("text").alias("body"))


@query("SELECT p_partkey, p_name AS title, p_brand AS author FROM part UNION ALL SELECT -p_partkey, p_name || ' (' || p_brand, NULL FROM part")
def title_author(t):
    p = t("part")
    lines = p.select("p_partkey", F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("line")).unionByName(p.select((-F.col("p_partkey")).alias("p_partkey"), F.concat("p_name", F.lit(" ("), "p_brand").alias("line")))
    return lines.select("p_partkey", X.heading_title(F.col("line")).alias("title"), X.heading_author(F.col("line")).alias("author"))


@query()
def strip_html(t):
    pages = with_markup_stripped(t("pages").select("page_id", F.col("html").cast("binary").alias("raw")))
    return pages.select("page_id", X.normalized(F.col("text")).alias("text"), F.size("first").alias("n"))


@query(
    """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, sum(length(x)) OVER (PARTITION BY conv_id ORDER BY k) - length(x) AS s FROM c),
a AS (SELECT conv_id, arg_max(turn, k) AS turn, arg_max(least(3 - s, length(x)), k) AS at FROM r WHERE s <= 3 GROUP BY 1), b AS (SELECT conv_id, arg_max(turn, k) AS turn, arg_max(least(60 - s, length(x)), k) AS at FROM r WHERE s <= 59 GROUP BY 1)
SELECT a.conv_id, CASE WHEN a.turn = b.turn THEN 'epubcfi(/6/4[c]!/4[body]/' || (2 * a.turn + 2) || '/1,:' || a.at || ',:' || b.at || ')'
  ELSE 'epubcfi(/6/4[c]!/4[body],/' || (2 * a.turn + 2) || '/1:' || a.at || ',/' || (2 * b.turn + 2) || '/1:' || b.at || ')' END AS address FROM a JOIN b USING (conv_id)"""
)
def range_addresses(t):
    c = t("conversations").where("conv_id is not null")
    step = F.array(F.struct(F.lit(4).alias("index"), F.lit("body").alias("assertion")), F.struct((2 * F.col("turn") + 2).cast("int").alias("index"), F.lit(None).cast("string").alias("assertion")), F.struct(F.lit(1).alias("index"), F.lit(None).cast("string").alias("assertion")))
    runs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", step.alias("steps"), F.coalesce("text", F.lit("")).alias("text")))).alias("ts"))
    placed = F.transform("ts", lambda x, i: F.struct(x["steps"].alias("steps"), x["text"].alias("text"), F.aggregate(F.slice("ts", F.lit(1), i), F.lit(0), lambda a, y: a + F.length(y["text"])).alias("doc_start")))
    rows = runs.select("conv_id", placed.alias("runs"))
    return rows.select("conv_id", spans.range_address(F.lit("/6/4[c]"), F.col("runs"), F.lit(3), F.lit(60)).alias("address"))


@query("SELECT count(DISTINCT source) AS titles FROM documents WHERE contains(lower(source), 'e')")
def titles_like(t):
    return textlog.distinct_titles(textlog.titled(t("documents").select(F.col("source").alias("title")), "E"))


@query("SELECT event_id, event_type AS action FROM events WHERE event_id % 3 = 0 AND event_type NOT IN (SELECT event_type FROM events WHERE event_id % 100000 = 1) AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 6 = 0)")
def changed_actions(t):
    rows = t("events").select("event_id", F.col("event_type").alias("action"))
    diff = dedupe.snapshot_diff(rows.where("event_id % 6 = 0"), rows.where("event_id % 3 = 0"))
    return dedupe.changed_actions(diff, rows.where("event_id % 100000 = 1")).select("event_id", "action")


@query(
    _LOCATED
    + f""" SELECT 't' || (item_id % 5) AS title, 'WEAK' AS kind, item_id AS seq, 'WEAK (0.60): ' || left(text, 70) AS line FROM benchmark WHERE {_FOUND} AND item_id % 3 = 2
UNION ALL SELECT 't' || (item_id % 5), 'MISS', item_id, 'MISS: ' || left(text, 70) FROM benchmark WHERE item_id % 7 <> 0 AND item_id NOT IN (SELECT item_id FROM l)"""
)
def report_lines(t):
    texts = t("benchmark").select(F.col("item_id").alias("seq"), "text")
    return outcomes.report(_outcomes(t).join(texts, "seq"))
