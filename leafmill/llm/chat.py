"""Chat formatting with Spark expressions only.

Turns of a conversation are collected, sorted and written with a template; neighbouring turns of one role share a
block. Every control string inside a text or role is escaped, so `parse` reads back exactly what was written.

Template: ``<|turn|>role<|text|>first text<|more|>next text of the same role<|end|>`` and a line feed for each block.

Cases: a null text or role is empty; rows with the same turn are ordered by role, then text; a null turn comes first;
rows without conv_id are one conversation; an empty table gives no rows; other columns are left out.
A conversation is one cell of the result, so its rows meet in one row; they are gathered map-side before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>\n"


def escape(c: Column) -> Column:
    """A backslash before each backslash, and after the first character of whatever looks like a control string of this
    or another usual template."""
    doubled = F.regexp_replace(c, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"<(?=\||/?s>)|\[(?=/?INST\])", r"$0\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _clean(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def formatted(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, segments: array of (text, loss) whose texts in a row are `formatted`; loss marks the texts
    (still escaped) that a model is trained on."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct(F.col("turn").alias("turn"), _clean("role").alias("role"), _clean("text").alias("text")))).alias("_t"))
    t = F.col("_t")

    def near(i: Column, step: int) -> Column:
        return F.get(t, i + step)["role"]

    def parts(x: Column, i: Column) -> Column:
        joined = near(i, -1).eqNullSafe(x["role"])
        goes_on = near(i, 1).eqNullSafe(x["role"])
        head = F.when(joined, F.lit(MORE)).otherwise(F.concat(F.lit(TURN), escape(x["role"]), F.lit(TEXT)))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(head, F.lit(False)), part(escape(x["text"]), x["role"].isin(*loss_roles)),
                       part(F.when(goes_on, F.lit("")).otherwise(F.lit(END)), F.lit(False)))

    segments = rows.select("conv_id", F.flatten(F.transform(t, parts)).alias("segments"))
    return segments.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse(formatted_text: Column) -> Column:
    """array of (role, text), read back from the text alone."""
    blocks = F.split(formatted_text, r"<\|end\|>\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        halves = F.split(F.substring(block, len(TURN) + 1, 2**31 - 1), r"<\|text\|>", 2)
        return F.transform(F.split(halves[1], r"<\|more\|>", -1),
                           lambda x: F.struct(unescape(halves[0]).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, in order, as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
