"""Chat formatting with typed content parts. DataFrame functions only.

A turn's content is an array of parts (``PARTS``). Neighbouring text parts are joined and then escaped; image, audio and
document parts become a placeholder of their kind, and their attachments with expanded token counts are listed in order of
the placeholders. The turns of a conversation are joined in order. Control strings inside texts are escaped reversibly,
so the formatted text can be read back by splitting at the marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,millis:bigint,pages:int>>"

# Expansion of attachments into tokens.
PATCH = 28
AUDIO_TOKENS_PER_SECOND = 25
TOKENS_PER_PAGE = 256


def escape(text: Column) -> Column:
    r"""One backslash more between every ``<`` and ``|`` that only backslashes part, so no mark is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    r"""Roles stand on a line of their own: backslashes and line feeds are written ``\\`` and ``\n``."""
    return escape(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unrole(role: Column) -> Column:
    back = F.regexp_replace(unescape(role), r"\\n|\\\\", "\u0000$0")
    return F.replace(F.replace(back, F.lit("\u0000\\n"), F.lit("\n")), F.lit("\u0000\\\\"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """Content of one text part."""
    none = F.lit(None)
    one = F.struct(
        F.lit("text").alias("kind"), text.cast("string").alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"),
        none.cast("int").alias("height"), none.cast("bigint").alias("millis"), none.cast("int").alias("pages"),
    )
    return F.array(one)


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment takes: image patches, audio seconds or pages, at least one; a text takes none here."""
    up = lambda a, b: F.ceil(F.coalesce(a, F.lit(0)) / F.lit(b))
    n = (
        F.when(part["kind"] == "image", up(part["width"], PATCH) * up(part["height"], PATCH))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["millis"], F.lit(0)) * AUDIO_TOKENS_PER_SECOND / 1000))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * TOKENS_PER_PAGE)
    )
    return F.when(n.isNotNull(), F.greatest(n.cast("long"), F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long"))


_FILES = ("image", "audio", "document")
_SIGN = "\u0001"  # while parts are joined: with "a" before an attachment's kind, with "t" for itself in a text


def _visit(part: Column) -> Column:
    """Text of a part that stands alone."""
    return F.when(part["kind"].isin(*_FILES), F.concat(F.lit("<|"), part["kind"], F.lit("|>"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def _body(content: Column) -> Column:
    """Text of all parts. Texts are escaped after they are joined, as a mark may lie across neighbouring parts."""
    raw = F.transform(
        content,
        lambda p: F.when(p["kind"].isin(*_FILES), F.concat(F.lit(_SIGN + "a"), p["kind"], F.lit(";"))).otherwise(
            F.replace(F.coalesce(p["text"], F.lit("")), F.lit(_SIGN), F.lit(_SIGN + "t"))
        ),
    )
    marked = F.regexp_replace(escape(F.array_join(raw, "")), _SIGN + "a(" + "|".join(_FILES) + ");", "<|$1|>")
    many = F.replace(marked, F.lit(_SIGN + "t"), F.lit(_SIGN))
    return F.when(F.size(content) > 1, many).otherwise(F.array_join(F.transform(content, _visit), ""))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, pieces, attachments, attachment_tokens, n_turns): one row per conversation.

    ``turns`` has conv_id, turn, role and content (``PARTS``). Turns go in order of ``turn``, then role and content;
    missing turns come first, repeated turns all stay. A missing role, text or content is empty, a missing conv_id is a
    conversation of its own, an unknown kind of part counts as text. ``pieces`` is the formatted text cut at the edges of
    the loss mask, each with its flag, so joined they are ``formatted``; under the mask is what turns of ``loss_role``
    say. ``attachments`` lists kind, reference, turn number and tokens in order of the placeholders. Other columns are
    not looked at. Turns are written before they are gathered; one conversation becomes one row, which is what is asked.
    """
    content = F.coalesce(F.col("content"), F.expr(f"cast(array() as {PARTS})"))
    said = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        _body(content).alias("body"),
        F.transform(
            F.filter(content, lambda p: p["kind"].isin(*_FILES)),
            lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")),
        ).alias("files"),
    )
    one = F.struct(
        "turn", "role", "body", F.concat(F.lit(START), _role(F.col("role")), F.lit("\n")).alias("head"),
        (F.col("role") == loss_role).alias("loss"), "files",
    )
    conv = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    pieces = F.flatten(
        F.transform(
            "t",
            lambda x: F.array(
                F.struct(x["head"].alias("text"), F.lit(False).alias("loss")),
                F.struct(x["body"].alias("text"), x["loss"].alias("loss")),
                F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    files = F.flatten(
        F.transform(
            "t",
            lambda x, i: F.transform(
                x["files"], lambda f: F.struct(f["kind"].alias("kind"), f["ref"].alias("ref"), i.alias("turn_no"), f["tokens"].alias("tokens"))
            ),
        )
    )
    out = conv.select("conv_id", pieces.alias("pieces"), files.alias("attachments"), F.size("t").cast("long").alias("n_turns"))
    return out.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        "pieces",
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, f: a + f["tokens"]).alias("attachment_tokens"),
        "n_turns",
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>; placeholders stay as they are written."""
    marked = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda s: s != "")
    end = F.lit(END + "\n")

    def turn(s: Column) -> Column:
        head = F.substring_index(s, "\n", 1)
        body = F.substring(s, F.char_length(head) + 2, F.char_length(s) - F.char_length(head) - 1 - F.char_length(end))
        return F.struct(_unrole(head).alias("role"), unescape(body).alias("text"))

    return F.transform(marked, turn)


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")
