"""Chat formatting with typed content parts, in native expressions only (operator 6).

A message's content is an array of typed parts. A visitor, one branch a type, flattens them in order:
text stands as itself, an image, audio clip or document as a placeholder that numbers it within its
conversation; its reference, where it stands, and the tokens it expands to are recorded. A turn is
``<|im_start|>role`` newline, content, ``<|im_end|>`` newline.

Control strings inside texts are escaped reversibly: every backslash is doubled, then ``<|`` becomes
``<\\|``; a newline in a role becomes ``<\\N``. A single backslash behind ``<`` comes from nowhere else,
so unescaping is exact, and no text can open or close a turn, be it cut into parts wherever.

Edge cases: null texts, roles and refs count as empty; null parts and null part arrays give nothing;
a part of an unknown type, or of none, is a document; rows of a null conversation id form one
conversation; equal turn numbers (ties) are ordered by role and parts, null turns come first; repeated
rows are turns of their own; texts of any length are formatted whole (a conversation is one row, so it
must fit a task); an empty table gives an empty result. Only the four columns asked for are read, so
others, whatever their names, have no influence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelet.llm.common import quoted

START, STOP = "<|im_start|>", "<|im_end|>"
MASKED = "assistant"
#: Bounds and rates of expanded token counts: an image patch is so many pixels wide, a second of audio and a page so many tokens.
PATCH, AUDIO_TOKENS, PAGE_TOKENS, LEAST = 14, 25, 256, 1
FOUND = "array<struct<number:int,type:string,ref:string,at:int,tokens:bigint>>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\N"))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("<\\N"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """The content of a plain text message."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"] == "text", F.lit(False))


def expanded(part: Column) -> Column:
    """Tokens that a part other than text expands to."""
    side = lambda n: F.ceil(F.coalesce(part[n], F.lit(0)) / PATCH)
    image = side("width") * side("height")
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS)
    pages = F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS
    return F.greatest(F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).otherwise(pages).cast("long"), F.lit(LEAST).cast("long"))


def visited(parts: Column, before: Column) -> Column:
    """(pieces, attachments) of one message; ``before``: attachments of the messages before it.

    The pieces joined are the content. Texts are escaped as if they were joined first: where one ends
    in ``<`` and the next begins with ``|``, the backslash goes between them.
    """
    kind = lambda p: F.when(p["type"].isin("image", "audio"), p["type"]).otherwise("document")
    read = F.transform(parts, lambda p: F.struct(F.when(is_text(p), escaped(F.coalesce(p["text"], F.lit("")))).alias("text"), kind(p).alias("type"), F.coalesce(p["ref"], F.lit("")).alias("ref"), expanded(p).alias("tokens")))
    empty = F.struct(F.array().cast("array<string>").alias("pieces"), F.array().cast(FOUND).alias("found"), F.lit(0).alias("at"), F.lit(False).alias("open"))

    def visit(seen: Column, part: Column) -> Column:
        text = part["text"]
        number = (before + F.size(seen["found"]) + 1).cast("int")
        mark = F.concat(F.lit("<|"), part["type"], F.lit("_"), number.cast("string"), F.lit("|>"))
        between = F.when(seen["open"] & F.startswith(text, F.lit("|")), "\\").otherwise("")
        piece = F.coalesce(F.concat(between, text), mark)
        entry = F.struct(number.alias("number"), part["type"].alias("type"), part["ref"].alias("ref"), seen["at"].alias("at"), part["tokens"].alias("tokens"))
        return F.struct(
            F.concat(seen["pieces"], F.array(piece)).alias("pieces"),
            F.when(text.isNull(), F.concat(seen["found"], F.array(entry))).otherwise(seen["found"]).alias("found"),
            (seen["at"] + F.char_length(piece)).alias("at"),
            F.when(text == "", seen["open"]).otherwise(F.coalesce(F.endswith(text, F.lit("<")), F.lit(False))).alias("open"),
        )

    return F.aggregate(read, empty, visit)


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row (conv_id, formatted, loss, attachments) for each conversation.

    ``loss``: (start, length) of the assistant contents in the formatted text, in code points.
    ``attachments``: (turn index, number, type, ref, place in the content, tokens) in order.

    Numbers and places run on from turn to turn as running sums over a conversation's rows, which are
    sorted once; texts are joined once, so the work grows with the length of a conversation.
    """
    given = F.coalesce(quoted(parts).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    rows = messages.select(quoted(conv).alias("conv_id"), quoted(turn).alias("t"), F.coalesce(quoted(role).cast("string"), F.lit("")).alias("r"), F.filter(given, lambda p: p.isNotNull()).alias("p"))
    order = Window.partitionBy("conv_id").orderBy(F.col("t").asc_nulls_first(), "r", "p")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    told = rows.withColumns({"n": F.row_number().over(order) - 1, "before": F.coalesce(F.sum(F.size(F.filter("p", lambda p: ~is_text(p)))).over(earlier), F.lit(0))})
    made = told.select("conv_id", "n", "r", F.concat(F.lit(START), escaped_role(F.col("r")), F.lit("\n")).alias("head"), visited(F.col("p"), F.col("before")).alias("v"))
    turns = made.select("conv_id", "n", "r", "head", F.array_join("v.pieces", "").alias("content"), F.col("v.found").alias("found"))
    size = F.char_length("head") + F.char_length("content") + len(STOP) + 1
    placed = turns.withColumn("at", (F.coalesce(F.sum(size).over(Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.char_length("head")).cast("int"))
    span = F.when(F.col("r") == MASKED, F.struct(F.col("at").alias("start"), F.char_length("content").alias("length")))
    own = F.transform("found", lambda a: F.struct(F.col("n").alias("turn"), a["number"].alias("number"), a["type"].alias("type"), a["ref"].alias("ref"), a["at"].alias("at"), a["tokens"].alias("tokens")))
    one = placed.select("conv_id", F.struct("n", F.concat("head", "content", F.lit(STOP + "\n")).alias("text"), span.alias("loss"), own.alias("found")).alias("m"))
    whole = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return whole.select("conv_id", F.array_join("m.text", "").alias("formatted"), F.array_compact("m.loss").alias("loss"), F.flatten("m.found").alias("attachments"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; placeholders stand as they are."""
    whole = F.array_compact(F.transform(F.split(formatted, "\\Q" + STOP + "\\E\n"), lambda s: F.when(F.startswith(s, F.lit(START)), s)))

    def turn(s: Column) -> Column:
        body = F.substr(s, F.lit(len(START) + 1))
        cut = F.instr(body, F.lit("\n"))
        return F.struct(unescaped_role(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescaped(F.substr(body, cut + 1)).alias("text"))

    return F.transform(whole, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["length"]))), "")
