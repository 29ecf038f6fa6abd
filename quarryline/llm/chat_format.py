"""Chat formatting: a visitor flattens typed content parts into one marked text per conversation.

A turn is ``<|im_start|>role``, a new line, its content, ``<|im_end|>`` and a new line. A content part is
visited by its type: text is escaped and put down; image, audio and document parts become placeholders
``<|type|>`` in their order, and their references and expanded token counts are recorded as attachments: the
part's own count if it has one, else that of EXPANDED.

Escaping is reversible: a backslash becomes ``\\s`` and ``<|`` becomes ``<\\p|``, so no text can hold a
control string; in roles a new line becomes ``\\l``. ``read_back`` takes formatted text apart again.

``loss_spans`` are the code-point ranges that count for the loss: the content of every assistant turn.
``masked`` cuts them out of the formatted text again.

All of it is DataFrame functions with one shuffle by conversation. A conversation ends up in one row, as
its formatted text is one value. Defined results: turns go by turn, role and text, nulls first, repeated
rows stay; null role or text counts as empty; rows with a null conv_id form one conversation. The types of
parts are a closed set, so no type can make a control string: a part of another type, or of none, is the
placeholder ``<|other|>``, its type is kept in the attachment alone. Columns of other names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import cut

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
PART = "struct<type:string,text:string,ref:string,tokens:long>"
#: Tokens that a placeholder stands for where its part doesn't say.
EXPANDED = {"image": 256, "audio": 100, "document": 512, "other": 1}


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("\n")), F.lit("\\p"), F.lit("")), F.lit("\\s"), F.lit("\\"))


def _kind(part: Column) -> Column:
    """Type of a part that isn't text, of the closed set."""
    return F.when(part["type"].isin("image", "audio", "document"), part["type"]).otherwise(F.lit("other"))


def _visit(part: Column) -> Column:
    """Content of one part: escaped text, or the placeholder of its type."""
    text = escape(F.coalesce(part["text"], F.lit("")))
    return F.when(part["type"] == "text", text).otherwise(F.concat(F.lit("<|"), _kind(part), F.lit("|>")))


def _expanded(part: Column) -> Column:
    known = F.lit(None).cast("long")
    for kind, n in EXPANDED.items():
        known = F.when(_kind(part) == kind, F.lit(n).cast("long")).otherwise(known)
    return F.when(part["tokens"] >= 0, part["tokens"]).otherwise(known)


def format_chats(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """conv_id, formatted, loss_spans (start, end) and attachments (position, type, ref, tokens) per conversation.

    turns: conv_id, turn, role and text; ``parts`` names a column of typed parts (``PART``) that stands in for text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    list_of = F.col(parts).cast(f"array<{PART}>") if parts else F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    visited = F.array_join(F.transform("parts", _visit), "")
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("plain") if not parts else F.lit("").alias("plain"), F.coalesce(list_of, F.array().cast(f"array<{PART}>")).alias("parts"))
    rows = rows.select("conv_id", "turn", "role", (visited if parts else F.col("plain")).alias("text"), visited.alias("content"), F.filter("parts", lambda p: F.coalesce(p["type"] != "text", F.lit(True))).alias("media"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\l")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("piece", F.concat("head", "content", F.lit(f"{END}\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("at", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    begin = F.coalesce("at", F.lit(0)) + F.length("head")
    loss = F.when(F.col("role") == LOSS_ROLE, F.struct(begin.alias("start"), (begin + F.length("content")).alias("end")))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "piece", loss.alias("loss"), "media"))).alias("t"))
    spans = F.filter(F.transform("t", lambda x: x["loss"]), lambda x: x.isNotNull())
    media = F.transform(F.flatten(F.transform("t", lambda x: x["media"])), lambda p, i: F.struct(i.alias("position"), p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p).alias("tokens")))
    return grouped.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"), media.alias("attachments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns``: array of (role, text), as taken apart from the formatted text."""
    pieces = F.split("formatted", r"<\|im_start\|>", -1)
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.length(head) + 2, F.length(piece) - F.length(head) - 2 - len(END))
        return F.struct(unescape(head).alias("role"), unescape(body).alias("text"))

    return formatted.withColumn("turns", F.transform(pieces, turn))


def masked(formatted: DataFrame) -> DataFrame:
    """Add ``loss``: the unescaped texts under ``loss_spans``, in order."""
    return formatted.withColumn("loss", F.transform(cut(F.col("formatted"), F.col("loss_spans")), unescape))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what ``read_back`` and ``masked`` give."""
    rows = masked(read_back(formatted)).withColumn("loss", F.array_join("loss", ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
