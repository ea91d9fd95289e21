"""Chat formatting of typed content parts, with a loss mask and attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
PATCH, AUDIO_TOKENS_A_SECOND, TOKENS_A_PAGE = 14, 25, 512
HEAD, ROLE_END, TURN_END = "### ", ":\n", "</turn>\n"
# Control characters of the template and what stands for them in a text; every
# backslash of an escaped text begins one of these codes.
CODES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))


def escape(text: Column) -> Column:
    for char, code in CODES:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for char, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def text_part(text: Column) -> Column:
    """A list with one text part; null text is empty."""
    none = F.lit(None)
    part = F.struct(F.lit("text"), F.coalesce(text, F.lit("")), none, none, none, none, none)
    return F.array(part).cast(PART)


def _image(part: Column) -> Column:
    return F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)


def _audio(part: Column) -> Column:
    return F.ceil(part["seconds"] * AUDIO_TOKENS_A_SECOND)


def _document(part: Column) -> Column:
    return part["pages"] * TOKENS_A_PAGE


VISITORS = {"image": _image, "audio": _audio, "document": _document}


def visit(part: Column, place: Column) -> Column:
    """A part as (body, kind, place, uri, tokens).

    Text becomes its escaped form; any other kind the placeholder
    ``<kind:place>``. Unknown and null kinds are ``unknown``, with no tokens.
    """
    known = part["kind"].isin("text", *VISITORS)
    kind = F.when(known, part["kind"]).otherwise("unknown")
    tokens = F.lit(0).cast("long")
    for name, count in VISITORS.items():
        tokens = F.when(kind == name, F.coalesce(count(part), F.lit(0)).cast("long")).otherwise(tokens)
    mark = F.concat(F.lit("<"), kind, F.lit(":"), place.cast("string"), F.lit(">"))
    body = F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark)
    return F.struct(body.alias("body"), kind.alias("kind"), place.alias("place"), part["uri"].alias("uri"), tokens.alias("tokens"))


def format_chats(turns: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments.

    ``turns`` has conv_id, turn, role and parts (see ``PART``). Each turn is
    ``### role:``, a line end, its parts and ``</turn>``. loss_spans are
    (start, length) in code points of the bodies of learned roles. attachments
    lists the other parts with turn number, place in the turn, uri and tokens.

    Turns are ordered by turn (null first), ties by role and content; repeated
    rows are turns of their own. Null role is empty, null parts are none, a null
    conv_id is one conversation. A conversation is one output row and so is
    made by one task. An empty table gives no rows.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(PART))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.transform(parts, visit).alias("seen"))
    rows = rows.withColumn("body", F.array_join(F.transform("seen", lambda p: p["body"]), ""))
    role = F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c"))
    rows = rows.withColumn("head", F.concat(F.lit(HEAD), role, F.lit(ROLE_END)))
    rows = rows.withColumn("rendered", F.concat("head", "body", F.lit(TURN_END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.row_number().over(order)
    start = F.sum(F.length("rendered")).over(until) - F.length("rendered") + F.length("head")
    rows = rows.withColumn("place", place).withColumn("start", start)
    files = F.transform(
        F.filter("seen", lambda p: p["kind"] != "text"),
        lambda p: F.struct(F.col("place").alias("turn"), p["place"].alias("place"), p["kind"].alias("kind"), p["uri"].alias("uri"), p["tokens"].alias("tokens")),
    )
    span = F.when(F.col("role").isin(*learned), F.struct(F.col("start"), F.length("body").cast("long").alias("length")))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "rendered", span.alias("span"), files.alias("files")))).alias("turns"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["files"])).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as (role, text), unescaped."""
    pieces = F.split(formatted, TURN_END)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        name = F.substring_index(piece, ROLE_END, 1)
        body = F.substr(piece, F.length(name) + len(ROLE_END) + 1)
        name = F.replace(F.substr(name, F.lit(len(HEAD) + 1)), F.lit("\\c"), F.lit(":"))
        return F.struct(unescape(name).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
