r"""Chat formatting: typed content parts become text with placeholders, turns become segments with a loss mask.

A visitor over the parts of a turn (one handler a type) flattens them in order: text is escaped and joined by spaces
of nothing; image, audio and document parts become a numbered placeholder, with a record of what it refers to and how
many tokens it expands to. The template is local to a turn:

    <s>[TURN] role [/TURN] content</s>

so formatting is a projection without a shuffle, and a conversation's text is its segments in order. Control strings
inside texts and roles get one backslash after their opening bracket (`</s>` -> `<\/s>`, `<\/s>` -> `<\\/s>`), which
is undone by taking one away. The loss mask is a span of characters (code points) in a segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Control strings of the template, without their opening bracket.
CONTROLS = (r"/?s>", r"/?INST\]", r"/?TURN\]", r"/?SYS\]", r"IMAGE [0-9]+\]", r"AUDIO [0-9]+\]", r"DOCUMENT [0-9]+\]")
_NAMES = "(?:" + "|".join(CONTROLS) + ")"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TILE, TILE_TOKENS, AUDIO_TOKENS, PAGE_TOKENS = 512, 170, 25, 600


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*{_NAMES})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*{_NAMES})", "$1$2")


def _image_tokens(part: Column) -> Column:
    """Tiles of 512 x 512 and one overview; an unknown size is one tile."""
    tiles = lambda side: F.greatest(F.ceil(F.coalesce(side, F.lit(TILE)) / TILE), F.lit(1))
    return (tiles(part["width"]) * tiles(part["height"]) + 1) * TILE_TOKENS


def _audio_tokens(part: Column) -> Column:
    return F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_TOKENS)


def _document_tokens(part: Column) -> Column:
    return F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS


# What the visitor does on an attachment: name in the placeholder, tokens it expands to.
ATTACHMENTS = {"image": ("IMAGE", _image_tokens), "audio": ("AUDIO", _audio_tokens), "document": ("DOCUMENT", _document_tokens)}


def flatten_parts(parts: Column) -> Column:
    """struct(content, attachments, attachment_tokens) of an array of PART.

    Placeholders are numbered over the turn from 1. Null arrays and parts count as none, null texts as empty, and a
    part of another or no type as text. attachments holds (n, type, ref, tokens) in order.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    start = F.struct(
        F.lit("").alias("content"),
        F.array().cast("array<struct<n:int,type:string,ref:string,tokens:bigint>>").alias("attachments"),
    )

    def visit(acc: Column, part: Column) -> Column:
        n = F.size(acc["attachments"]) + 1
        content = F.concat(acc["content"], escape(F.coalesce(part["text"], F.lit(""))))
        tokens = F.lit(None).cast("bigint")
        for kind, (name, cost) in ATTACHMENTS.items():
            here = F.coalesce(part["type"] == kind, F.lit(False))
            content = F.when(here, F.concat(acc["content"], F.lit(f"[{name} "), n.cast("string"), F.lit("]"))).otherwise(content)
            tokens = F.when(here, cost(part).cast("bigint")).otherwise(tokens)
        found = F.array(F.struct(n.alias("n"), part["type"].alias("type"), part["ref"].alias("ref"), tokens.alias("tokens")))
        return F.struct(
            content.alias("content"),
            F.when(tokens.isNull(), acc["attachments"]).otherwise(F.concat(acc["attachments"], found)).alias("attachments"),
        )

    flat = F.aggregate(parts, start, visit)
    return F.struct(
        flat["content"].alias("content"),
        flat["attachments"].alias("attachments"),
        F.aggregate(flat["attachments"], F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"),
    )


def text_parts(text: Column) -> Column:
    """A plain text as one part."""
    empty = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(
        F.lit("text").alias("type"), text.cast("string").alias("text"), empty("string").alias("ref"), empty("int").alias("width"),
        empty("int").alias("height"), empty("double").alias("seconds"), empty("int").alias("pages"),
    ))


def format_turns(turns: DataFrame, parts: Column, learn: str = "assistant") -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_chars, attachments, attachment_tokens), a row for each turn row.

    Texts of the role `learn` are under the loss mask, others have loss_chars 0. A null role is empty. Null ids and
    turn numbers, repeated rows and empty tables pass through as they are; other columns are not looked at.
    """
    role = escape(F.coalesce(F.col("role").cast("string"), F.lit("")))
    flat = turns.select("conv_id", "turn", "role", role.alias("_role"), flatten_parts(parts).alias("_flat"))
    head = F.concat(F.lit("<s>[TURN] "), F.col("_role"), F.lit(" [/TURN] "))
    learned = F.coalesce(F.col("role") == learn, F.lit(False))
    return flat.select(
        "conv_id",
        "turn",
        F.concat(head, F.col("_flat.content"), F.lit("</s>")).alias("segment"),
        F.length(head).alias("loss_start"),
        F.when(learned, F.length("_flat.content")).otherwise(0).alias("loss_chars"),
        F.col("_flat.attachments").alias("attachments"),
        F.col("_flat.attachment_tokens").alias("attachment_tokens"),
    )


def read_back(segments: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, loss_text, segment) from segments alone: the template parsed, texts unescaped."""
    pattern = r"(?s)^<s>\[TURN\] (.*?) \[/TURN\] (.*)</s>$"
    part = lambda k: unescape(F.regexp_extract("segment", pattern, k))
    masked = F.substring(F.col("segment"), F.col("loss_start") + 1, F.col("loss_chars"))
    return segments.select("conv_id", "turn", part(1).alias("role"), part(2).alias("text"), unescape(masked).alias("loss_text"), "segment")


class _Digest:
    def __init__(self, conv_id) -> None:
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.text, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self) -> dict:
        return {
            "conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.text.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars,
        }


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_ARROW = pa.schema([(c, pa.int64() if t == "bigint" else pa.string()) for c, t in (x.split() for x in DIGEST.split(", "))])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running digests of conversations whose rows follow each other; holds one state, never a conversation."""
    state, done = None, []
    for batch in batches:
        for conv, role, text, loss, chars in zip(*[batch.column(k).to_pylist() for k in range(5)]):
            if state is None or state.conv_id != conv:
                if state is not None:
                    done.append(state.row())
                state = _Digest(conv)
            state.turns += 1
            state.chars += chars
            state.text.update(f"{role}\n{text}\n".encode())
            state.loss_chars += len(loss)
            state.loss.update(loss.encode())
        if len(done) > 1000:
            yield pa.RecordBatch.from_pylist(done, _ARROW)
            done = []
    if state is not None:
        yield pa.RecordBatch.from_pylist([*done, state.row()], _ARROW)


def digests(turns: DataFrame) -> DataFrame:
    """Digest of each conversation of `read_back`, turns in order (ties by role and text; a null turn first).

    A digest runs over its whole conversation in order, so a conversation's rows stream through one task, sorted on
    disk where needed; no task holds more of it than a batch. Null conv_ids are one conversation.
    """
    ordered = turns.select("conv_id", "role", "text", "loss_text", F.length("segment").cast("long").alias("chars"), "turn")
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.drop("turn").mapInArrow(_fold, DIGEST)
