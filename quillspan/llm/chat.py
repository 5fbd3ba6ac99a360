"""Chat formatting: typed content parts become one marked string with a loss mask and attachments.

A turn's content is an array of typed parts. A visitor - one CASE over the part's type - flattens
them into one text: text parts, and parts of an unknown type, give what they say, image, audio and
document parts a numbered placeholder, and leave a record of the reference and of the tokens it
will expand to. The flat text is escaped as a whole, so that no control string can form where two
parts meet. Turns are joined as

    <|turn|>role<|text|>content<|end|>

Escaping is reversible: a backslash doubles, and one is put behind the ``<`` or ``[`` of every
control string (anything in ``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<pad>``, ``<unk>``),
so no text can form one. Unescaping drops each backslash and keeps what follows it. Until the
rest is escaped, a placeholder begins with one backslash and an m, which no doubled text has.

All of it is DataFrame functions. A conversation's turns are first joined by runs of ``RUN``
turn numbers, then the runs are joined, so that long conversations neither build one huge array
nor count offsets in quadratic time; what must be one string ends as one row.

Defined cases: null text, role and content count as empty; a conversation's turns go by turn,
role and text (null turns first), so ties and repeated rows have one order; a null conv_id is
one conversation; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
RUN = 64
#: Tokens that a placeholder stands for: by the part's type, for each of its units (tiles, seconds, pages).
EXPANSION = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type: string, text: string, ref: string, units: int>"
_CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|pad>|unk>)"


def _doubled(text: Column) -> Column:
    return F.replace(text, F.lit("\\"), F.lit("\\\\"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(_doubled(text), _CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("units"))).cast(f"array<{PART}>")


def _visit(part: Column, index: Column) -> Column:
    """What a part becomes; attachments are numbered within their turn."""
    kind = part["type"]
    place = F.concat(F.lit("\\m"), kind, F.lit(":"), index.cast("string"), F.lit("|>"))
    return F.when(kind.isin(*EXPANSION), place).otherwise(_doubled(F.coalesce(part["text"], F.lit(""))))


def _body(parts: Column) -> Column:
    """Visited parts as one escaped text."""
    whole = F.regexp_replace(F.array_join(parts, ""), _CONTROL, r"$1\\")
    return F.regexp_replace(whole, r"(?<!\\)((?:\\\\)*)\\m", r"$1<|")


def _attachments(content: Column) -> Column:
    kept = F.filter(content, lambda p: p["type"].isin(*EXPANSION))
    tokens = lambda p: F.coalesce(p["units"], F.lit(1)) * F.when(p["type"] == "image", EXPANSION["image"]).when(p["type"] == "audio", EXPANSION["audio"]).otherwise(EXPANSION["document"])
    return F.transform(kept, lambda p, i: F.struct(i.alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))


def formatted(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss, attachments) from (conv_id, turn, role, content).

    ``loss`` lists the spans (0-based code point start and length in ``formatted``) of what role
    ``learn`` says; ``attachments`` has (turn order, number, type, ref, tokens) of all placeholders.
    """
    content = F.coalesce("content", F.array().cast(f"array<{PART}>"))
    before = lambda i: F.size(F.filter(F.slice(content, F.lit(1), i), lambda p: p["type"].isin(*EXPANSION)))
    body = _body(F.transform(content, lambda p, i: _visit(p, before(i))))
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(TURN), escaped(role), F.lit(TEXT))
    one = turns.select(
        "conv_id",
        F.floor(F.col("turn") / RUN).alias("run"),
        F.struct(F.col("turn"), role.alias("role"), body.alias("body"), F.length(head).cast("long").alias("skip"), F.concat(head, body, F.lit(END)).alias("piece"), (role == learn).alias("own"), _attachments(content).alias("files")).alias("t"),
    )
    spans = "array<struct<start: bigint, length: bigint>>"

    def joined(items: Column, text: str, found) -> Column:
        """Concatenate ``text`` of all items and shift their spans by what stands before them."""
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(spans).alias("spans"))
        step = lambda acc, x: F.struct((acc["at"] + F.length(x[text])).alias("at"), F.concat(acc["spans"], F.transform(found(x), lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["length"].alias("length")))).alias("spans"))
        return F.aggregate(items, start, step)["spans"]

    mine = lambda t: F.when(t["own"], F.array(F.struct(t["skip"].alias("start"), F.length(t["body"]).cast("long").alias("length")))).otherwise(F.array().cast(spans))
    runs = one.groupBy("conv_id", "run").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    runs = runs.select("conv_id", F.struct("run", F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("text"), joined(F.col("ts"), "piece", mine).alias("spans"), F.transform("ts", lambda t: F.struct(t["turn"].alias("turn"), t["files"].alias("files"))).alias("files")).alias("r"))
    whole = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    files = F.flatten(F.transform(F.flatten(F.transform("rs", lambda r: r["files"])), lambda t: F.transform(t["files"], lambda f: F.struct(t["turn"].alias("turn"), f["number"].alias("number"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    return whole.select("conv_id", F.array_join(F.transform("rs", lambda r: r["text"]), "").alias("formatted"), joined(F.col("rs"), "text", lambda r: r["spans"]).alias("loss"), files.alias("attachments"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, as an array of (role, text), placeholders left as they stand."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")
    body = lambda p: F.split(F.substring(p, F.lit(len(TURN) + 1), F.length(p)), r"<\|text\|>", 2)
    return F.transform(pieces, lambda p: F.struct(unescaped(body(p)[0]).alias("role"), unescaped(body(p)[1]).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
