"""Chat formatting: typed content parts flattened into one template, with a loss mask.

A message is a row (conversation, turn, role, parts). A visitor, one case for each kind of
part, turns text parts into escaped text and image, audio and document parts into
placeholders such as ``<|image|>``; every attachment's reference, its place in the output and
the number of tokens that its placeholder expands to are recorded in order.

The template is::

    <|turn|>ROLE<|body|>TEXT<|end|>

Control strings inside roles and texts are escaped: each backslash is doubled, and a backslash
goes in after the first character of each control string. Removing one backslash before every
character restores the text, and no control string is left that the template did not write.
The control strings of other common templates are escaped too.

Defined results: a null text or role is empty, null parts are no parts; turns are ordered by
turn (nulls first), then by role and text, so ties and repeated rows have a fixed order and all
stay; rows without a conversation id form one conversation with a null id; an empty table gives
no rows; other columns are not read. One conversation becomes one value, as its output is one
string; turns are formatted before they are gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rowloom.llm.common import slices

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
KINDS = ("image", "audio", "document")
# Strings that this or other templates give a meaning to.
CONTROL = (TURN, BODY, END, *(f"<|{k}|>" for k in KINDS), "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
PARTS = "array<struct<kind:string,text:string,ref:string,size:long>>"

#: Tokens of an attachment from its size: image and document tiles or pages, audio seconds.
TOKENS = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A plain text as the only part of a message."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("size")))


def visit(part: Column) -> Column:
    """The output of one part: escaped text, a placeholder, or nothing for an unknown kind."""
    out = F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
    for kind in KINDS:
        out = out.when(part["kind"] == kind, F.lit(f"<|{kind}|>"))
    return out.otherwise(F.lit(""))


def expanded(part: Column) -> Column:
    """Tokens that the placeholder of an attachment stands for; sizes count from 1."""
    out = F.when(F.lit(False), F.lit(0).cast("long"))
    for kind in KINDS:
        out = out.when(part["kind"] == kind, F.greatest(F.coalesce(part["size"], F.lit(1).cast("long")), F.lit(1).cast("long")) * TOKENS[kind])
    return out


def format_conversations(messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", trained_role: str = "assistant") -> DataFrame:
    """One row for each conversation.

    conv_id, formatted, loss (array of first, last: code points of ``formatted`` under the loss
    mask, the bodies of the trained role), attachments (array of turn number, kind, ref, tokens
    in order), n_attachment_tokens. One shuffle, by conversation.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(PARTS))
    attached = F.filter(parts, lambda p: p["kind"].isin(*KINDS))
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = messages.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.concat_ws("", F.transform(parts, lambda p: p["text"])).alias("plain"),
        F.concat(F.lit(TURN), escape(role), F.lit(BODY)).alias("head"), F.concat_ws("", F.transform(parts, visit)).alias("body"),
        F.transform(attached, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), expanded(p).alias("tokens"))).alias("attached"),
    )
    # Where each turn begins is summed up before turns are gathered, so the work is linear in them.
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "plain", "body", "attached")
    placed = rows.withColumn("nth", F.row_number().over(by) - 1).withColumn("before", F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = F.col("before") + F.length("head")
    turn = F.struct("nth", F.concat("head", "body", F.lit(END)).alias("piece"), (F.col("role") == trained_role).alias("trained"), first.alias("first"), (first + F.length("body")).alias("last"), "attached")
    out = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["first"].alias("first"), t["last"].alias("last")))
    attachments = F.flatten(F.transform("turns", lambda t: F.transform(t["attached"], lambda p: F.struct(t["nth"].alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))))
    return out.select("conv_id", F.concat_ws("", F.transform("turns", lambda t: t["piece"])).alias("formatted"), spans.alias("loss"), attachments.alias("attachments")).withColumn(
        "n_attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, p: a + p["tokens"])
    )


def read_back(formatted: DataFrame, column: str = "formatted") -> DataFrame:
    """Adds turns (array of role, text), read from the output alone; placeholders stay in the text."""
    marks = F.filter(F.split(column, TURN.replace("|", "\\|")), lambda _, i: i > 0)
    body = lambda x: F.split(x, BODY.replace("|", "\\|"), 2)
    read = lambda x: F.struct(unescape(body(x)[0]).alias("role"), unescape(F.substring_index(body(x)[1], END, 1)).alias("text"))
    return formatted.withColumn("turns", F.transform(marks, read))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all read from ``formatted`` and its mask.

    The masked text is cut out in Python, where a slice costs its own length; SQL's substring counts characters from the start for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "formatted"):
                masked = []
                for text, loss in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    masked.append("".join(re.sub(r"(?s)\\(.)", r"\1", text[s["first"] : s["last"]]) for s in loss))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(masked, pa.string())], names=["conv_id", "formatted", "masked"])

    back = read_back(formatted.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, formatted string, masked string"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
