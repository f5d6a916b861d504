"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role are merged
into a block of several parts; blocks are concatenated.  The template:

``<|im_start|>role\\npart<|im_sep|>part<|im_end|>\\n``

Inside texts every ``<``, any number of backslashes and ``|`` get one more backslash after the
``<``, so that no text contains a control string and the escape is reversible; roles are
percent-encoded.  ``segments`` are the pieces of ``formatted`` in order, each with ``train``: the
loss mask covers an assistant's texts and nothing else.

Edge cases: a null role or text is empty; a null turn sorts first and equal turns by role and
text; repeated rows stay; an empty table gives an empty result; each row without an id is a
conversation of its own, so that these never meet in one task; other columns are ignored, whatever
their names.  One conversation is one value, so that its length is bounded by a row's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelweave.llm.common import let, take

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", train_role: str = "assistant") -> DataFrame:
    """``(conv_col, segments, formatted)``, one row for each conversation."""
    rows = take(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col).withColumn("_lone", F.when(F.col("conv").isNull(), F.monotonically_increasing_id()))
    one = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sorted_turns = rows.groupBy(F.col("conv").alias(conv_col), "_lone").agg(F.sort_array(F.collect_list(one)).alias("_turns"))

    def segment(text: Column, train: Column | None = None) -> Column:
        return F.struct(text.alias("text"), (F.lit(False) if train is None else train).alias("train"))

    def block(own: Column, from_: Column, upto: Column) -> Column:
        role = own[from_ - 1]["role"]
        parts = F.flatten(F.transform(F.slice(own, from_, upto - from_), lambda t, i: F.array(segment(F.when(i == 0, F.lit("")).otherwise(F.lit(SEP))), segment(escape(t["text"]), t["role"] == train_role))))
        return F.concat(F.array(segment(F.concat(F.lit(START), F.url_encode(role), F.lit("\n")))), parts, F.array(segment(F.lit(END))))

    def merged(own: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: (i == 1) | (own[i - 1]["role"] != F.get(own, i - 2)["role"]))
        return let(heads, lambda h: F.flatten(F.transform(h, lambda at, k: block(own, at, F.coalesce(F.get(h, k + 1), F.size(own) + 1)))))

    made = sorted_turns.select(conv_col, let(F.col("_turns"), merged).alias("segments"))
    made = made.select(conv_col, F.filter("segments", lambda s: s["text"] != "").alias("segments"))
    return made.select(conv_col, "segments", F.array_join(F.col("segments.text"), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, as structs of role and text."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = F.url_decode(F.substring(F.substring_index(b, "\n", 1), len(START) + 1, 1 << 30))
        body = F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.lit(1 << 30))
        return let(role, lambda r: F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))

    return F.flatten(F.transform(blocks, turns))


def digest(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Counts and digests of the formatted conversations, read back from them."""
    made = format_conversations(turns, conv_col, turn_col, role_col, text_col)
    back = made.select(conv_col, "formatted", read_back(F.col("formatted")).alias("_turns"), F.array_join(F.transform(F.filter("segments", lambda s: s["train"]), lambda s: unescape(s["text"])), "").alias("_loss"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        conv_col,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
