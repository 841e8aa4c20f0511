"""Chat formatting of conversations with typed content parts.

A turn has a role and a list of parts ``struct<kind, text, ref, units>``.  A
visitor flattens them in order: text parts are escaped and kept, image, audio
and document parts become one placeholder each, with their reference, place
and expanded token count (units times the kind's tokens per unit) recorded.
Everything runs on DataFrame functions.

Template, per turn:  ``<|im_start|>`` role ``<|im_sep|>`` parts ``<|im_end|>\\n``.
Two text parts that follow each other are kept apart by ``<|part|>``.  A
control string can only arise from ``<|``; inside texts and roles every
``<~*|`` (a "<", tildes, a "|") gets one more tilde, which is reversible.

Defined results for odd input: null role or text is empty, a null part list is
one empty text part, an unknown kind is an ``attachment`` of no tokens; turns
are ordered by turn (nulls first), then role, then content, so ties and
repeated rows keep a fixed order and each stays; rows without a conversation
id form one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: control strings and tokens per unit of each kind ----------
START, SEP, END, PART = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|part|>"
KIND_TOKENS = {"image": 256, "audio": 25, "document": 768, "attachment": 0}

PART_TYPE = "struct<kind:string,text:string,ref:string,units:bigint>"
_PLACEHOLDER = r"<\|(?:part|" + "|".join(KIND_TOKENS) + r")\|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(~*)\|", r"<$1~|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<~(~*)\|", r"<$1|")


def text_part(text: Column) -> Column:
    """The part list of a plain text turn."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("bigint").alias("units"))).cast(f"array<{PART_TYPE}>")


def _visit(part: Column, before: Column) -> Column:
    """One part as struct<piece, skip, kind, ref, tokens>; ``skip`` is the
    length of the separator at the start of a text piece."""
    is_text = F.coalesce(part["kind"], F.lit("text")) == "text"
    kind = F.when(part["kind"].isin(*KIND_TOKENS), part["kind"]).otherwise("attachment")
    per_unit = F.lit(0)
    for name, tokens in KIND_TOKENS.items():
        per_unit = F.when(kind == name, F.lit(tokens)).otherwise(per_unit)
    skip = F.when(is_text & before, F.lit(len(PART))).otherwise(F.lit(0))
    return F.struct(
        F.when(is_text, F.concat(F.when(before, F.lit(PART)).otherwise(""), escape(part["text"])))
        .otherwise(F.concat(F.lit("<|"), kind, F.lit("|>"))).alias("piece"),
        skip.alias("skip"),
        F.when(~is_text, kind).alias("kind"), F.when(~is_text, part["ref"]).alias("ref"),
        F.when(~is_text, per_unit * F.coalesce(part["units"], F.lit(1))).cast("bigint").alias("tokens"))


def _flatten(parts: Column) -> Column:
    """array<struct<piece, skip, kind, ref, tokens>> of a part list."""
    listed = F.coalesce(parts, text_part(F.lit("")))
    is_text = F.transform(listed, lambda p: F.coalesce(p["kind"], F.lit("text")) == "text")
    last_is_text = F.slice(F.concat(F.array(F.lit(False)), is_text), 1, F.size(listed))
    return F.zip_with(listed, last_is_text, _visit)


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         parts: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation:

    ``formatted``; ``marks``, per turn ``struct<start, loss>`` with the turn's
    first character and the text spans ``struct<start, length>`` (characters
    from the turn's start) that the loss covers; ``attachments``
    ``struct<turn, kind, ref, position, tokens>`` in order; ``n_turns`` and
    ``attachment_tokens``.  A conversation's text is one value, so its turns
    meet in one task; the pieces are joined once, in linear time.
    """
    head = F.concat(F.lit(START), escape(F.col(role)), F.lit(SEP))
    rows = turns.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"),
        head.alias("_head"), _flatten(F.col(parts)).alias("_parts"))
    rows = rows.select("*", F.array_join(F.transform("_parts", lambda p: p["piece"]), "").alias("_body"))
    rows = rows.select("*", F.concat("_head", "_body", F.lit(END)).alias("_text"))
    order = [F.col("_turn").asc_nulls_first(), F.col("_role").asc(), F.col("_body").asc()]
    w = Window.partitionBy("_conv").orderBy(*order)
    placed = rows.select(
        "*", F.row_number().over(w).alias("_n"),
        F.coalesce(F.sum(F.length("_text").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_start"))
    # places of the parts inside their turn: few parts a turn, so a fold
    first = F.length("_head").cast("bigint")
    spans = F.aggregate(
        "_parts", F.struct(first.alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>")
                           .alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["piece"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + p["skip"]).cast("bigint").alias("start"),
                                                  (F.length(p["piece"]) - p["skip"]).cast("bigint").alias("length"))))
            .alias("out")), lambda acc: acc["out"])
    placed = placed.select("*", F.zip_with(spans, "_parts", lambda span, part: F.struct(
        span.alias("span"), part.alias("part"))).alias("_placed"))
    loss = F.when(F.col("_role") == loss_role, F.transform(
        F.filter("_placed", lambda x: x["part"]["kind"].isNull()),
        lambda x: F.struct(x["span"]["start"].alias("start"), x["span"]["length"].alias("length")))).otherwise(
        F.array().cast("array<struct<start:bigint,length:bigint>>"))
    attached = F.transform(
        F.filter("_placed", lambda x: x["part"]["kind"].isNotNull()),
        lambda x: F.struct(F.col("_turn").alias("turn"), x["part"]["kind"].alias("kind"), x["part"]["ref"].alias("ref"),
                           (F.col("_start") + x["span"]["start"]).alias("position"),
                           x["part"]["tokens"].alias("tokens")))
    one = F.struct(F.col("_n").alias("n"), F.col("_text").alias("text"),
                   F.struct(F.col("_start").alias("start"), loss.alias("loss")).alias("mark"), attached.alias("attached"))
    listed = placed.groupBy("_conv").agg(F.sort_array(F.collect_list(one)).alias("_t"))
    attachments = F.flatten(F.transform("_t", lambda t: t["attached"]))
    return listed.select(
        F.col("_conv").alias(conv), F.size("_t").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("_t", lambda t: t["text"]), "").alias("formatted"),
        F.transform("_t", lambda t: t["mark"]).alias("marks"), attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda acc, a: acc + a["tokens"]).alias("attachment_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` again, without its ``marks``: adds ``turns``
    (array of role and text, unescaped) and, with them, ``loss_texts``."""
    def turn_of(segment: Column) -> Column:
        content = F.regexp_replace(F.substring_index(segment, SEP, -1), r"<\|im_end\|>\n$", "")
        return F.struct(
            unescape(F.substring_index(segment, SEP, 1)).alias("role"),
            F.array_join(F.transform(F.split(content, _PLACEHOLDER), unescape), "").alias("text"))

    segments = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda s: s != "")
    turns_back = F.transform(segments, turn_of)
    masked = F.zip_with(segments, F.col("marks"), lambda s, m: F.array_join(F.transform(
        # a segment lacks the start string that the split took
        m["loss"], lambda x: unescape(F.substring(s, x["start"] + 1 - len(START), x["length"]))), ""))
    return formatted.select("*", turns_back.alias("turns"), masked.alias("loss_texts"))
