"""Preference pairs of conversations as one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Fixed values of the chat template: marks before the role and after the text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turn_text(role: Column, text: Column) -> Column:
    """One rendered turn. Marks inside a role or text lose their bar, so neither can end its own turn."""
    plain = lambda c, other: F.replace(F.coalesce(c, F.lit(other)), F.lit("<|"), F.lit("< "))
    return F.concat(F.lit(OPEN), plain(role, "unknown"), F.lit("\n"), plain(text, ""), F.lit(CLOSE + "\n"))


def turn_start(role: Column) -> Column:
    """Characters of a rendered turn before its text."""
    return F.length(F.coalesce(role, F.lit("unknown"))) + (len(OPEN) + 1)


def _side(side: str) -> Column:
    """A side's turns in order, as structs that sort by turn, then role and text."""
    row = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    return F.array_sort(F.collect_list(F.when(F.col("side") == side, row))).alias(side)


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: turn_text(t["role"], t["text"])), "")


def _mask(turns: Column, trained: str) -> Column:
    """`start-end` of each trained turn's text and closing mark within the joined turns, end exclusive."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + turn_start(t["role"])
        end = acc["at"] + F.length(turn_text(t["role"], t["text"]))
        span = F.concat_ws("-", start.cast("string"), (end - 1).cast("string"))
        own = F.when(t["role"] == trained, F.array(span)).otherwise(F.array().cast("array<string>"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], own).alias("spans"))

    return F.aggregate(turns, empty, step, lambda acc: F.array_join(acc["spans"], " "))


def format_preferences(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per pair: prompt, chosen and rejected completions, their masks, n_common.

    turns: (pair_id, side 'chosen' or 'rejected', turn, role, text); other columns are ignored.
    The longest prefix of turns with equal role and text (nulls equal each other) on both sides
    is rendered once as prompt; what follows on a side is its completion. Masks list the spans
    of the completion that are trained on: texts of `trained` turns with their closing mark.
    Turns are ordered by turn, ties by role and text. A pair that lacks a side has an empty
    prompt and that side's completion is empty; null roles render as 'unknown', null texts as
    empty; rows with null pair_id, which nothing tells apart, take no part; long texts are
    rendered whole, rows that repeat stand one after the other; no rows give no rows. A conversation is one
    row of the result, so one task holds one pair at a time.
    """
    pairs = turns.filter(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(_side("chosen"), _side("rejected"))
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]) & a.isNotNull() & b.isNotNull(), F.lit(False)))
    pairs = pairs.withColumn("same", same)
    stop = F.array_position("same", F.lit(False)).cast("int")
    pairs = pairs.withColumn("n_common", F.when(stop == 0, F.size("same")).otherwise(stop - 1))
    rest = {side: F.slice(F.col(side), F.col("n_common") + 1, F.greatest(F.size(side), F.lit(1))) for side in ("chosen", "rejected")}
    pairs = pairs.withColumns({"c_rest": rest["chosen"], "r_rest": rest["rejected"]})
    return pairs.select(
        "pair_id", _joined(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"), _joined(F.col("c_rest")).alias("chosen"), _joined(F.col("r_rest")).alias("rejected"),
        _mask(F.col("c_rest"), trained).alias("chosen_mask"), _mask(F.col("r_rest"), trained).alias("rejected_mask"), F.col("n_common").cast("long").alias("n_common"))


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: each with the copy that ends in another's reply.

    Chosen is the conversation; rejected is it up to its last assistant turn, followed by the
    last assistant turn of the conversation whose conv_id differs in the lowest bit. All turns
    take part. Where either has no assistant turn, rejected is the conversation without its
    last assistant turn and what follows, or the whole of it.
    """
    last = (conversations.filter(F.col("role") == "assistant").groupBy("conv_id")
            .agg(F.max(F.struct("turn", "text")).alias("reply")))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("reply.text").alias("other_text"))
    ends = last.select("conv_id", F.col("reply.turn").alias("last_turn"))
    chosen = conversations.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    before = (conversations.join(ends, "conv_id", "left").filter(F.col("last_turn").isNull() | (F.col("turn") < F.col("last_turn")))
              .select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text"))
    swapped = (ends.join(other, "conv_id")
               .select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), F.col("last_turn").alias("turn"), F.lit("assistant").alias("role"), F.col("other_text").alias("text")))
    return chosen.unionByName(before).unionByName(swapped)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a preference pair against another conversation's reply."""
    return format_preferences(reply_pairs(table(spark, sf_dir, "conversations")))


OP2_SQL = r"""
WITH last AS (
  SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS reply FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
turns AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM conversations
  UNION ALL
  SELECT c.conv_id, 'rejected', c.turn, c.role, c.text FROM conversations c LEFT JOIN last l ON c.conv_id = l.conv_id
  WHERE l.last_turn IS NULL OR c.turn < l.last_turn
  UNION ALL
  SELECT a.conv_id, 'rejected', a.last_turn, 'assistant', b.reply FROM last a JOIN last b ON b.conv_id = xor(a.conv_id, 1)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS pos,
    '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || replace(coalesce(text, ''), '<|', '< ') || '<|im_end|>' || chr(10) AS shown
  FROM turns),
diff AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.pos, r.pos) AS pos
  FROM (SELECT * FROM placed WHERE side = 'chosen') c FULL JOIN (SELECT * FROM placed WHERE side = 'rejected') r ON c.pair_id = r.pair_id AND c.pos = r.pos
  WHERE c.pos IS NULL OR r.pos IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text),
common AS (
  SELECT p.pair_id, coalesce(d.stop - 1, p.n) AS n_common
  FROM (SELECT pair_id, max(pos) AS n FROM placed GROUP BY pair_id) p LEFT JOIN (SELECT pair_id, min(pos) AS stop FROM diff GROUP BY pair_id) d USING (pair_id)),
spans AS (
  SELECT p.*, n_common, pos > n_common AS own,
    coalesce(sum(CASE WHEN pos > n_common THEN length(shown) END) OVER (PARTITION BY p.pair_id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_char
  FROM placed p JOIN common USING (pair_id))
SELECT pair_id,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 'chosen' AND NOT own), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 'chosen' AND own), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 'rejected' AND own), '') AS rejected,
  coalesce(string_agg((at_char + length(coalesce(role, 'unknown')) + 13)::VARCHAR || '-' || (at_char + length(shown) - 1)::VARCHAR, ' ' ORDER BY pos) FILTER (side = 'chosen' AND own AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((at_char + length(coalesce(role, 'unknown')) + 13)::VARCHAR || '-' || (at_char + length(shown) - 1)::VARCHAR, ' ' ORDER BY pos) FILTER (side = 'rejected' AND own AND role = 'assistant'), '') AS rejected_mask,
  max(n_common)::BIGINT AS n_common
FROM spans GROUP BY pair_id
"""
