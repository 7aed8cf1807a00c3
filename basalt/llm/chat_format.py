"""Chat formatting with typed content parts.

A visitor flattens the parts of each message in order: text is escaped, and each
image, audio or document part becomes a numbered placeholder. Attachment
references and the tokens that placeholders expand to are recorded beside the
text. The template is

    <turn ROLE>CONTENT</turn>

with ROLE and text escaped so that neither ``<`` nor ``>`` of a text survives:
``\\`` is ``\\b``, ``<`` is ``\\l`` and ``>`` is ``\\g``. No control string can
thus come from a text, and ``unescape`` inverts it exactly. Everything is a
DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
END = "</turn>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A message of one text part; null text is empty."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    fields = [F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text")]
    return F.array(F.struct(*fields, *(F.lit(None).cast(t).alias(k) for k, t in none.items())))


def part_tokens(part: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """Tokens that an attachment's placeholder expands to; unknown sizes count one unit."""
    side = lambda v: F.ceil(F.greatest(F.coalesce(v, F.lit(1)), F.lit(1)) / F.lit(patch))
    return (
        F.when(part["type"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * audio_rate))
        .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * page_tokens)
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def format_chats(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    loss_roles: tuple[str, ...] = ("assistant",),
    patch: int = 14,
    audio_rate: float = 25.0,
    page_tokens: int = 1024,
) -> DataFrame:
    """One row per conversation: conv_id, segments, attachments, expanded_tokens.

    ``segments`` is an array of (text, loss) whose texts joined are the formatted
    conversation (``formatted``); those with ``loss`` hold what is trained on.
    ``attachments`` lists (message, type, ref, tokens) in placeholder order.

    Turns go by ``turn_col`` (nulls first; equal turns by role, then text; all
    repeated rows stay). Null roles, null part types and null texts are an empty
    role, ``text`` and an empty text; a null conversation id is a conversation of
    its own; an unknown part type is a placeholder of its type without tokens. A
    null or empty part list gives an empty turn. An empty table gives no rows, and
    other columns are ignored.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))
    content = F.array_join(
        F.transform(
            parts,
            lambda p: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
                F.concat(F.lit("<part "), escape(p["type"]), F.lit(">"))
            ),
        ),
        "",
    )
    refs = F.transform(
        F.filter(parts, lambda p: ~_is_text(p)),
        lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p, patch, audio_rate, page_tokens).alias("tokens")),
    )
    role = F.coalesce(F.col(role_col), F.lit(""))
    # equal turns go by what they say, not by how it is escaped
    said = F.transform(parts, lambda p: F.coalesce(F.when(_is_text(p), p["text"]).otherwise(p["type"]), F.lit("")))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), F.array_join(said, "").alias("said"), content.alias("content"), refs.alias("refs"))
    chats = messages.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
    segments = F.flatten(
        F.transform(
            "ts",
            lambda t: F.array(
                plain(F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">"))),
                F.struct(t["content"].alias("text"), t["role"].isin(*loss_roles).alias("loss")),
                plain(F.lit(END)),
            ),
        )
    )
    attachments = F.flatten(
        F.transform(
            "ts",
            lambda t, i: F.transform(t["refs"], lambda r: F.struct(i.alias("message"), r["type"].alias("type"), r["ref"].alias("ref"), r["tokens"].alias("tokens"))),
        )
    )
    out = chats.select("conv_id", segments.alias("segments"), attachments.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_turns(text: Column) -> Column:
    """The (role, text) of each turn of a formatted conversation, unescaped."""
    chunks = F.filter(F.split(text, END), lambda c: c != "")
    return F.transform(
        chunks,
        lambda c: F.struct(
            unescape(F.regexp_extract(c, r"^<turn ([^>]*)>", 1)).alias("role"),
            unescape(F.regexp_replace(c, r"^<turn [^>]*>", "")).alias("text"),
        ),
    )
