"""Chat formatting: typed content parts become one training text per conversation, with a loss mask.

A visitor turns the parts of a turn (text, image, audio, document) into text with ordered placeholders;
each placeholder records its attachment and the tokens it will expand to. Markers separate the turns.
Control strings inside a text are escaped by one backslash after their first character, so they can be
told from markers and restored exactly. All steps are column expressions.

Defined results: a null text or role is empty; a null part list has no parts; parts of unknown kind, or
null parts, give nothing; rows of one turn number go by role, then content; repeated rows are repeated
turns; a null conversation id is a conversation of its own; a long text is formatted in whole; other columns, of whatever
name, are ignored; an empty table gives no rows.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = ("array<struct<kind:string,text:string,uri:string,width:int,height:int,"
        "seconds:double,pages:int>>")

# Strings that steer common chat templates; "<|" covers all markers of this one.
_CONTROL = r"(/?s>|/?INST\]|\|)"
_ESCAPE = (r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")
_UNESCAPE = (r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


@dataclass(frozen=True)
class Template:
    """Markers, and how many tokens an attachment expands to."""

    opening: str = "<s>"
    turn: str = "<|turn|>"
    body: str = "<|body|>"
    end: str = "<|end|>"
    patch: int = 28
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 768


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE[0]), F.lit(_ESCAPE[1]))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE[0]), F.lit(_UNESCAPE[1]))


def _ceil_div(a: Column, b: int) -> Column:
    return F.ceil(F.greatest(F.coalesce(a, F.lit(0)), F.lit(0)) / F.lit(b))


def expanded_tokens(part: Column, template: Template) -> Column:
    """Tokens that the placeholder of an attachment stands for; 0 for other parts."""
    seconds = F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0))
    tokens = (
        F.when(part["kind"] == "image",
               _ceil_div(part["width"], template.patch) * _ceil_div(part["height"], template.patch))
        .when(part["kind"] == "audio", F.ceil(seconds * F.lit(template.audio_tokens_per_second)))
        .when(part["kind"] == "document",
              F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(0)) * F.lit(template.tokens_per_page)))
    return F.coalesce(tokens, F.lit(0)).cast("long")


ATTACHMENTS = ("image", "audio", "document")


def visit_text(part: Column) -> Column:
    """What one part puts into the text: escaped text, a placeholder, or nothing."""
    return (F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
            .when(part["kind"].isin(*ATTACHMENTS), F.concat(F.lit("<|"), part["kind"], F.lit("|>")))
            .otherwise(F.lit("")))


def text_part(text: Column) -> Column:
    """A list of one part, a text."""
    fields = [f.split(":") for f in PART.removeprefix("array<struct<").removesuffix(">>").split(",")]
    given = {"kind": F.lit("text"), "text": text}
    return F.array(F.struct(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields]))


def flatten_parts(parts: Column) -> Column:
    """The text of a turn: its parts in order, attachments as placeholders."""
    return F.coalesce(F.array_join(F.transform(parts, visit_text), ""), F.lit(""))


def attachments(parts: Column, template: Template = Template()) -> Column:
    """(kind, uri, tokens) of each placeholder of a turn, in the order of the placeholders."""
    kept = F.filter(parts, lambda p: F.coalesce(p["kind"].isin(*ATTACHMENTS), F.lit(False)))
    found = F.transform(kept, lambda p: F.struct(
        p["kind"].alias("kind"), p["uri"].alias("uri"), expanded_tokens(p, template).alias("tokens")))
    return F.coalesce(found, F.array().cast("array<struct<kind:string,uri:string,tokens:bigint>>"))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str | None = "text", parts: str | None = None,
                         template: Template = Template(), trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, length), attachments.

    ``parts`` names a column of type ``PART``; without it a turn has one part, its ``text``. Spans are in code
    points from 1, over the texts of turns whose role is ``trained``. A conversation is one output value,
    so its turns meet in one task; nothing else does.
    """
    content = F.col(parts) if parts else text_part(F.col(text))
    lean = rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        flatten_parts(content).alias("content"), attachments(content, template).alias("files"))
    head = F.concat(F.lit(template.turn), escape(F.col("role")), F.lit(template.body))
    piece = F.concat("head", "content", F.lit(template.end + "\n"))
    pieces = lean.withColumn("head", head).withColumn("piece", piece)
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    before = F.sum(F.length("piece")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    placed = pieces.select(
        "conv_id", "piece", "files", F.row_number().over(ordered).alias("k"),
        F.when(F.col("role") == trained, F.struct(
            (F.coalesce(before, F.lit(0)) + F.length("head") + len(template.opening) + 1)
            .cast("long").alias("start"),
            F.length("content").cast("long").alias("length"))).alias("span"))
    gathered = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("k", "piece", "span", "files"))).alias("t"))
    return gathered.select(
        "conv_id",
        F.concat(F.lit(template.opening), F.array_join("t.piece", "")).alias("formatted"),
        F.filter("t.span", lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten("t.files").alias("attachments"))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The (role, text) of each turn, read from a formatted text; attachments stay placeholders."""
    pieces = F.split(formatted, r"\Q" + template.turn + r"\E")
    turns = F.filter(pieces, lambda p, i: i > 0)
    rest = lambda p: F.substring_index(p, template.body, -1)
    return F.transform(turns, lambda p: F.struct(
        unescape(F.substring_index(p, template.body, 1)).alias("role"),
        unescape(F.substring_index(rest(p), template.end, 1)).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(
        spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")
