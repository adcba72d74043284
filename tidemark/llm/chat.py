"""Chat formatting of typed content parts (operator 9).

A turn is `<s>` role, newline, body, `</s>`.  The body is what a visitor makes of the turn's parts: text is escaped, an
image, audio or document part becomes a placeholder such as `[image]` and is recorded as an attachment, in order, with
the number of tokens it expands to.  Every control string begins with `<` or `[`; inside texts these two and the
backslash are written as `\\l`, `\\b` and `\\s`, so no text can end a turn or forge one, and reading back gives every
text as it was.  The loss mask is a list of spans (begin, length in code points) over the bodies of the trained role.

Only DataFrame functions.  Scale: one exchange by conversation.  A conversation is one output row, so its turns have to
meet; a running sum of turn lengths gives the spans without a second pass.

Defined cases: null text and null role count as empty; turns come by number, null first, equal ones by role and body;
null conversation identifiers form one conversation; unknown part kinds count as documents; a part without units has one;
an empty table gives an empty result; columns beside those named are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"))
NEWLINE = ("\n", "\\n")
#: Tokens that one unit stands for: an image tile, a second of audio, a page of a document.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), ESCAPES, F.coalesce(text, F.lit("")))


def unescape(text: Column) -> Column:
    """Undo `escape`; the backslash comes last, so nothing it gives back is read again."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[1]), F.lit(pair[0])), reversed(ESCAPES), text)


def text_part(text: Column) -> Column:
    """A turn of one text as an array of typed parts."""
    nothing = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), nothing.cast("string").alias("ref"), nothing.cast("bigint").alias("units")))


def _kind(part: Column) -> Column:
    return F.when(part["kind"].isin("text", *UNIT_TOKENS), part["kind"]).otherwise(F.lit("document"))


def _visit(part: Column) -> Column:
    """What stands in the body for a part."""
    return F.when(_kind(part) == "text", escape(part["text"])).otherwise(F.concat(F.lit("["), _kind(part), F.lit("]")))


def _tokens(part: Column) -> Column:
    units = F.coalesce(part["units"], F.lit(1).cast("bigint"))
    of_kind = reduce(lambda c, item: c.when(_kind(part) == item[0], units * item[1]), UNIT_TOKENS.items(), F.when(F.lit(False), units))
    return of_kind.otherwise(F.regexp_count(F.coalesce(part["text"], F.lit("")), F.lit(r"\S+")).cast("bigint"))


def flatten_parts(parts: Column) -> tuple[Column, Column, Column]:
    """Body, attachments (kind, ref, tokens) in order, and expanded tokens; texts count as their words."""
    body = F.array_join(F.transform(parts, _visit), "")
    files = F.transform(F.filter(parts, lambda p: _kind(p) != "text"),
                        lambda p: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    tokens = F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, p: total + _tokens(p))
    return body, files, tokens


def format_conversations(
    turns: DataFrame, parts: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role", trained: str = "assistant"
) -> DataFrame:
    """conv_id, formatted, loss (spans over `formatted`), attachments, n_tokens; one row per conversation."""
    parts = F.coalesce(parts, F.array().cast("array<struct<kind:string,text:string,ref:string,units:bigint>>"))
    body, files, tokens = flatten_parts(parts)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    name = F.replace(escape(F.col(role)), F.lit(NEWLINE[0]), F.lit(NEWLINE[1]))
    head = F.concat(F.lit(BEGIN), F.col("role"), F.lit("\n"))
    rows = (
        turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), name.alias("role"), body.alias("body"),
                     files.alias("files"), tokens.alias("tokens"), F.coalesce(F.col(role) == trained, F.lit(False)).alias("trained"))
        .withColumn("piece", F.concat(head, F.col("body"), F.lit(END)))
        .withColumn("before", F.coalesce(F.sum(F.char_length("piece").cast("bigint")).over(order), F.lit(0).cast("bigint")))
    )
    span = F.struct((F.col("before") + F.char_length(head)).alias("begin"), F.char_length("body").cast("bigint").alias("length"))
    packed = F.struct("before", "piece", F.when(F.col("trained"), span).alias("span"), "files")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(packed)).alias("t"), F.sum("tokens").alias("n_tokens")).select(
        "conv_id", F.array_join("t.piece", "").alias("formatted"),
        F.filter("t.span", lambda s: s.isNotNull()).alias("loss"), F.flatten("t.files").alias("attachments"), "n_tokens")


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, text), unescaped; placeholders stay as they are."""
    pieces = F.split(formatted, END)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        unescape(F.replace(F.substring_index(F.substr(p, F.lit(len(BEGIN) + 1)), "\n", 1), F.lit(NEWLINE[1]), F.lit(NEWLINE[0]))).alias("role"),
        unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["begin"] + 1).cast("int"), s["length"].cast("int")))), "")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation says when read back: counts and digests of its turns and its loss text."""
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return formatted.withColumn("turns", read_turns(F.col("formatted"))).withColumn("under", loss_text(F.col("formatted"), F.col("loss"))).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length("under").cast("bigint").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"))
