"""Chat formatting: a visitor turns each turn's typed parts into text with ordered placeholders, and turns into one string.

One turn is written as::

    ### role <text>
    body
    </turn>

Inside roles and bodies a backslash goes before each ``\\``, ``<`` and ``#`` of the source. All control strings hold a ``<``
after a blank or a line break, or a ``#`` at a turn's start, so none of them can arise from a text, and removing one
backslash from each escaped pair gives the source back.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, OPEN, CLOSE = "### ", " <text>\n", "\n</turn>\n"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<place:int,kind:string,ref:string,n_tokens:bigint>"


@dataclass(frozen=True)
class Expansion:
    """How many tokens a placeholder stands for: an image's tiles, a recording's frames, a document's pages."""

    tile: int = 336
    per_tile: int = 144
    image_base: int = 1
    audio_per_second: float = 25.0
    per_page: int = 512
    roles: Mapping[str, str] = field(default_factory=dict)  # other names of roles, as "human" for "user"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<#])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\<#])", "$1")


def text_part(text: Column) -> Column:
    """A turn's plain text as its only part."""
    empty = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in empty.items()]))


def _tokens(part: Column, how: Expansion) -> Column:
    """Tokens behind a placeholder; missing sizes count as nothing but the base."""
    tiles = F.ceil(F.coalesce(part["width"], F.lit(0)) / F.lit(how.tile)) * F.ceil(F.coalesce(part["height"], F.lit(0)) / F.lit(how.tile))
    return (
        F.when(part["kind"] == "image", F.lit(how.image_base) + tiles * F.lit(how.per_tile))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(how.audio_per_second)))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * F.lit(how.per_page))
        .otherwise(F.lit(0)).cast("long"))


def _visit(parts: Column, how: Expansion) -> tuple[Column, Column]:
    """The body, and the attachments in order. A text part is escaped; any other becomes a placeholder with its number.

    A placeholder has lines of its own, so the character before its ``<`` is a line break and never a backslash.
    """
    kept = F.filter(parts, lambda p: p.isNotNull())
    others = F.filter(kept, lambda p: ~F.coalesce(p["kind"], F.lit("text")).isin("text"))
    attachments = F.transform(others, lambda p, i: F.struct(i.alias("place"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p, how).alias("n_tokens")))
    # A part's number is the count of attachments before it; a fold carries it, as parts are visited in order.
    start = F.struct(F.lit("").alias("body"), F.lit(0).alias("n"))
    body = F.aggregate(kept, start, lambda acc, p: F.when(
        F.coalesce(p["kind"], F.lit("text")) == "text",
        F.struct(F.concat(acc["body"], escape(F.coalesce(p["text"], F.lit("")))).alias("body"), acc["n"].alias("n")),
    ).otherwise(F.struct(
        F.concat(acc["body"], F.lit("\n<|"), escape(p["kind"]), F.lit(" "), acc["n"].cast("string"), F.lit("|>\n")).alias("body"),
        (acc["n"] + 1).alias("n"))))["body"]
    return body, attachments


def format_chats(turns: DataFrame, parts: str | None = None, how: Expansion = Expansion(), loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, turn_chars, loss, attachments, n_tokens_expanded) for each conversation of ``turns``.

    ``turns`` has conv_id, turn, role and text, or typed parts in the column named ``parts`` (an array of ``PART``). Turns
    are ordered by turn, then role and text where turns tie; repeated rows are repeated turns. Null text, role and parts are
    empty; a null turn number comes first; rows with a null conv_id are one conversation. An unknown kind of part gets a
    placeholder of no tokens. ``turn_chars`` has each turn's length in characters. ``loss`` lists the spans to learn from:
    turn, start in the turn, start in the whole string, and length. A conversation is one string, so it must fit in a row.
    """
    own = F.col(parts).cast(f"array<{PART}>") if parts else text_part(F.col("text"))
    body, attachments = _visit(F.coalesce(own, F.array().cast(f"array<{PART}>")), how)
    role = F.coalesce(F.col("role"), F.lit(""))
    for old, new in how.roles.items():
        role = F.when(role == old, F.lit(new)).otherwise(role)
    said = turns.select(
        "conv_id", F.col("turn").alias("turn__"), role.alias("role__"), body.alias("body__"), attachments.alias("attachments__")).withColumn(
        "head__", F.concat(F.lit(HEAD), escape(F.col("role__")), F.lit(OPEN))).withColumn(
        "chars__", (F.length("head__") + F.length("body__") + F.lit(len(CLOSE))).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("turn__", "role__", "body__", "attachments__").rowsBetween(Window.unboundedPreceding, -1)
    placed = said.withColumn("start__", F.coalesce(F.sum("chars__").over(before), F.lit(0))).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn__", "role__", "body__", "attachments__", "start__", "head__", "chars__"))).alias("turns"))
    zero = F.lit(0).cast("long")
    spans = F.transform("turns", lambda t, i: F.struct(
        i.alias("turn"), F.length(t["head__"]).cast("long").alias("start_in_turn"),
        (t["start__"] + F.length(t["head__"])).alias("start"), F.length(t["body__"]).cast("long").alias("n_chars"), t["role__"].alias("role")))
    return placed.select(
        "conv_id", F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head__"], t["body__"], F.lit(CLOSE)))).alias("formatted"),
        F.transform("turns", lambda t: t["chars__"]).alias("turn_chars"),
        F.transform(F.filter(spans, lambda s: s["role"].isin(*loss_roles)), lambda s: s.dropFields("role")).alias("loss"),
        F.flatten(F.transform("turns", lambda t, i: F.transform(
            t["attachments__"], lambda a: F.struct(i.alias("turn"), a["place"].alias("place"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["n_tokens"].alias("n_tokens"))))).alias("attachments"),
        F.aggregate(F.flatten(F.transform("turns", lambda t: t["attachments__"])), zero, lambda acc, a: acc + a["n_tokens"]).alias("n_tokens_expanded"))


def read_chats(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns`` (role, text) and ``loss_text`` read back from ``formatted`` and ``loss`` alone.

    Placeholders stay in the texts, as they were written. Each turn is cut out once, and spans are read inside their turn.
    """
    raw = F.filter(F.split("formatted", CLOSE), lambda x: x != "")
    cut = chats.withColumn("raw__", raw)
    turns = F.transform("raw__", lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, len(HEAD) + 1, 2**31 - 1), OPEN, 1)).alias("role"),
        unescape(F.array_join(F.slice(F.split(x, OPEN, 2), 2, 1), "")).alias("text")))
    masked = F.transform("loss", lambda s: unescape(F.substring(F.get("raw__", s["turn"]), s["start_in_turn"].cast("int") + 1, s["n_chars"].cast("int"))))
    return cut.withColumn("turns", turns).withColumn("loss_text", F.concat_ws("", masked)).drop("raw__")


def digests(chats: DataFrame) -> DataFrame:
    """Counts and checksums of what :func:`read_chats` reads back."""
    back = read_chats(chats)
    spoken = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(spoken, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "n_tokens_expanded")
