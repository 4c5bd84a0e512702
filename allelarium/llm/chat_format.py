"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant, the others as named users, and a loss mask over the
speaker's own turns. A participant is a role that speaks in the conversation;
`system` is no participant: its turns are part of every rendering. A rendering
is returned turn by turn - segment, mask, and where it starts and ends in the
whole, in characters - so a conversation of any length, however many rows it
has, is never gathered in one row; `whole_dialogues` joins the segments where
conversations are known to be small.

The places are running sums in two levels, over blocks of turns and then
within a block, so a very long conversation is spread over tasks.

Edge cases: a null role is a participant named `unknown`; a null text is
rendered as empty; a null turn comes first; turns with equal numbers are
ordered by role and text, and rows that are equal throughout are all rendered,
one after the other; a conversation with system turns alone has no
perspective and gives no rows; a null conv_id is a conversation; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelarium.llm.common import read_table

SYSTEM = "system"
UNKNOWN = "unknown"
HEAD, MIDDLE, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"
#: Turn numbers of one block of the running sums.
BLOCK = 1024


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, seq, segment, is_target, start_char, end_char) for every participant and turn."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN)).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # one row for each set of equal rows, so that a turn repeated over and over is one row here too
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times"))
    speakers = rows.where(F.col("role") != SYSTEM).groupBy("conv_id").agg(F.collect_set("role").alias("speakers"))
    rows = rows.withColumn("block", F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(-(1 << 62))))
    both = rows.join(speakers.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    each = both.select("conv_id", "turn", "role", "text", "times", "block", F.explode("speakers").alias("perspective"))
    own = F.col("role") == F.col("perspective")
    header = F.when(F.col("role") == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.col("role")))
    segment = F.concat(F.lit(HEAD), header, F.lit(MIDDLE), F.col("text"), F.lit(TAIL))
    each = each.select("conv_id", "perspective", "turn", "role", "text", "block", "times", segment.alias("segment"), own.alias("is_target"))
    each = each.withColumn("chars", F.length("segment").cast("long"))

    blocks = each.groupBy("conv_id", "perspective", "block").agg(F.sum(F.col("times") * F.col("chars")).alias("b_chars"), F.sum("times").alias("b_turns"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(F.col("conv_id").alias("_conv"), F.col("perspective").alias("_who"), F.col("block").alias("_block"), F.coalesce(F.sum("b_chars").over(earlier), zero).alias("chars_before"), F.coalesce(F.sum("b_turns").over(earlier), zero).alias("turns_before"))
    within = Window.partitionBy("conv_id", "perspective", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("inner_chars", F.coalesce(F.sum(F.col("times") * F.col("chars")).over(within), zero)).withColumn("inner_turns", F.coalesce(F.sum("times").over(within), zero))
    placed = placed.join(blocks, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_who")) & (F.col("block") == F.col("_block")))
    placed = placed.withColumn("again", F.explode(F.sequence(zero, F.col("times") - 1)))
    start = F.col("chars_before") + F.col("inner_chars") + F.col("again") * F.col("chars")
    return placed.select(
        "conv_id", "perspective", "turn", (F.col("turns_before") + F.col("inner_turns") + F.col("again")).alias("seq"), "segment", "is_target", start.alias("start_char"), (start + F.col("chars")).alias("end_char")
    )


def whole_dialogues(segments: DataFrame, max_chars: int = 1 << 20) -> DataFrame:
    """(conv_id, perspective, part, text, target_spans): segments joined in order, a part for each `max_chars` characters."""
    part = F.expr(f"start_char div {max_chars}").alias("part")
    grouped = segments.groupBy("conv_id", "perspective", part).agg(F.sort_array(F.collect_list(F.struct("seq", "segment", "is_target", "start_char", "end_char"))).alias("s"))
    spans = F.transform(F.filter("s", lambda x: x["is_target"]), lambda x: F.struct(x["start_char"].alias("start"), x["end_char"].alias("end")))
    return grouped.select("conv_id", "perspective", "part", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("text"), spans.alias("target_spans"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of `conversations` as every participant's rendering has it."""
    return rotate_perspectives(read_table(spark, sf_dir, "conversations"))


QUERIES = {"op6_chat_format": op6_chat_format}
SQL = {
    "op6_chat_format": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '{UNKNOWN}') AS role, coalesce(text, '') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> '{SYSTEM}'),
each AS (
  SELECT t.conv_id, s.perspective, t.turn, t.role, t.text, t.role = s.perspective AS is_target,
    '{HEAD}' || CASE WHEN t.role = '{SYSTEM}' THEN '{SYSTEM}' WHEN t.role = s.perspective THEN 'assistant' ELSE 'user name=' || t.role END
    || chr(10) || t.text || '{TAIL.strip()}' || chr(10) AS segment
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, row_number() OVER w - 1 AS seq, sum(length(segment)) OVER w AS end_char FROM each
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, turn, seq, segment, is_target,
  CAST(end_char - length(segment) AS BIGINT) AS start_char, CAST(end_char AS BIGINT) AS end_char FROM placed
"""
}
