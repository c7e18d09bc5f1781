"""Chat formatting with DataFrame functions only: typed content parts, one string a conversation, a loss mask.

A turn is formatted as `<turn role="ROLE">TEXT</turn>` and a newline. In texts `&` and `<` become `&amp;` and
`&lt;` (in roles and kinds `"` and `>` too become `&quot;` and `&gt;`), so every `<` of the output is the template's own
and escaping is undone exactly. A turn's content is an array of typed parts (see PART), visited in order: text parts
give their text, image, audio and document parts (and any other kind) give `<image 0>`, `<audio 1>`, ... numbered
through the conversation, with a record of their reference, sizes and the tokens that they expand to. A turn without
parts is one text part of its `text`. `parse` gives back the turns with their parts.

The mask holds, for each assistant turn, the code points [from, to) of its content in the output. Offsets come from a
running sum over the turns of a conversation, so a conversation of many turns costs no more for each; its one row
is as large as the conversation itself, which is the result that is asked for.

Defined cases: null texts and roles are empty; turns are taken by (turn, role, text, parts), nulls first, repeated rows
are repeated turns; rows of a null conv_id are one conversation; a null kind is text; an unknown kind is kept as a
placeholder of that kind with no tokens; a missing size counts as one unit; neighbouring text parts come back as one and
empty ones not at all; texts may be of any length; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import picked, table

#: A content part: its kind, the text of a text part, the reference of another one and its size.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: What a placeholder expands to: a token for each square of so many pixels of an image, and so many tokens a second of
#: audio and a page of a document.
IMAGE_SIDE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512
_ATTACHED = f"array<struct<index:bigint,kind:string,tokens:bigint,part:{PART}>>"
_CLOSE = "</turn>\n"
_PLACEHOLDER = r"<([^<>]*) (\d+)>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _role(c: Column) -> Column:
    return F.replace(F.replace(escape(c), F.lit('"'), F.lit("&quot;")), F.lit(">"), F.lit("&gt;"))


def _unrole(c: Column) -> Column:
    return unescape(F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&gt;"), F.lit(">")))


def _kind(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text"))


def _tokens(p: Column) -> Column:
    """The tokens that an attachment's placeholder expands to, by its size."""
    squares = lambda n: F.ceil(F.coalesce(n, F.lit(IMAGE_SIDE)) / IMAGE_SIDE)
    return (
        F.when(p["kind"] == "image", squares(p["width"]) * squares(p["height"]))
        .when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(1.0)) * AUDIO_RATE))
        .when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(1)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def _visit(parts: Column, before: Column) -> tuple[Column, Column]:
    """The content of a turn's parts, and its attachments; before: the number of attachments of earlier turns."""
    others = F.filter(parts, lambda p: _kind(p) != "text")
    attached = F.transform(others, lambda p, i: F.struct((before + i).cast("bigint").alias("index"), p["kind"].alias("kind"), _tokens(p).alias("tokens"), p.alias("part")))
    number = lambda i: before + F.size(F.filter(F.slice(parts, F.lit(1), i), lambda q: _kind(q) != "text"))
    seen = lambda p, i: F.when(_kind(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<"), _role(p["kind"]), F.lit(" "), number(i).cast("string"), F.lit(">"))
    )
    return F.array_join(F.transform(parts, seen), ""), attached


def text_part(text: Column) -> Column:
    """A turn's text as its one content part."""
    null = F.lit(None)
    fields = [F.lit("text").alias("kind"), text.alias("text"), *(null.alias(x) for x in ("ref", "width", "height", "seconds", "pages"))]
    return F.array(F.struct(*fields).cast(PART))


def format_chat(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """conv_id, formatted, loss (array of struct from, to), attachments; turns: conv_id, turn, role, text.

    parts: the name of a column with typed content parts (array of PART); a turn that has none there is its text.
    """
    wanted = {"conv_id": dict(turns.dtypes).get("conv_id", "bigint"), "turn": "bigint", "role": "string", "text": "string"} | ({parts: f"array<{PART}>"} if parts else {})
    rows = picked(turns, **wanted)
    own = text_part(F.coalesce("text", F.lit("")))
    visited = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        (F.coalesce(F.col(parts), own) if parts else own).alias("parts"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", *([F.to_json("parts")] if parts else []))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    if parts:
        n = F.size(F.filter("parts", lambda p: _kind(p) != "text"))
        visited = visited.withColumn("n_attached", n).withColumn("first", F.coalesce(F.sum("n_attached").over(before), F.lit(0)))
    else:
        visited = visited.withColumn("first", F.lit(0))
    body, attached = _visit(F.col("parts"), F.col("first"))
    head = F.concat(F.lit('<turn role="'), _role(F.col("role")), F.lit('">'))
    made = visited.select("conv_id", "turn", "role", "text", *(["parts"] if parts else []), head.alias("head"), body.alias("body"), attached.cast(_ATTACHED).alias("attached"))
    made = made.withColumn("size", F.char_length("head") + F.char_length("body") + len(_CLOSE))
    made = made.withColumn("n", F.row_number().over(order)).withColumn("begin", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.char_length("head"))
    row = F.struct("n", F.concat("head", "body", F.lit(_CLOSE)).alias("turn"), (F.col("role") == "assistant").alias("learnt"), F.col("begin").cast("bigint").alias("from"), (F.col("begin") + F.char_length("body")).cast("bigint").alias("to"), "attached")
    grouped = made.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["turn"]), "").alias("formatted"),
        F.transform(F.filter("rows", lambda r: r["learnt"]), lambda r: F.struct(r["from"].alias("from"), r["to"].alias("to"))).alias("loss"),
        F.flatten(F.transform("rows", lambda r: r["attached"])).alias("attachments"),
    )


def parse(formatted: Column, attachments: Column) -> Column:
    """The turns (array of struct role, parts) that a formatted string holds; placeholders are attachments' parts again."""
    pieces = F.split(formatted, _CLOSE, -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def parts(body: Column) -> Column:
        texts = F.transform(F.split(body, _PLACEHOLDER, -1), lambda t: F.transform(F.filter(F.array(unescape(t)), lambda x: x != ""), lambda x: text_part(x)[0]))
        found = F.transform(F.regexp_extract_all(body, F.lit(_PLACEHOLDER), 2), lambda i: F.array(F.element_at(attachments, i.cast("int") + 1)["part"]))
        none = F.array().cast(f"array<{PART}>")
        return F.flatten(F.transform(F.arrays_zip(texts.alias("t"), found.alias("a")), lambda z: F.concat(z["t"], F.coalesce(z["a"], none))))

    return F.transform(
        turns,
        lambda t: F.struct(
            _unrole(F.substring(t, F.lit(13), F.instr(t, F.lit('">')) - 13)).alias("role"),
            parts(F.substring(t, F.instr(t, F.lit('">')) + 2, F.char_length(t))).alias("parts"),
        ),
    )


def said(turn: Column) -> Column:
    """The text of a turn's text parts."""
    return F.array_join(F.transform(turn["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), "")


def learnt(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = lambda s: unescape(F.substring(formatted, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))
    return F.array_join(F.transform(loss, cut), "")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string")
    turns = picked(table(spark, sf_dir, "conversations"), conv_id="bigint", turn="bigint", role="string", text="string").unionByName(more)
    out = format_chat(turns).withColumn("turns", parse(F.col("formatted"), F.col("attachments"))).withColumn("learnt", learnt(F.col("formatted"), F.col("loss")))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), said(t), F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said_all.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<turn role="') + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;'), '>', '&gt;'))
           + length('">') + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""
