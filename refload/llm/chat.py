"""Dialogues seen from every speaker: that one as assistant, the others as named users, losses masked accordingly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refload.llm.common import running_totals
from refload.session import materialize

#: Turns of these roles are for everybody; they are nobody's perspective.
SHARED = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def perspectives(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", shared: tuple[str, ...] = SHARED
) -> DataFrame:
    """(conv, perspective, seq, turn, speaker, chat_role, segment, char_from, char_to, mask_from, mask_to).

    One row for each turn and each speaker of its dialogue; the segments of a (conv, perspective) put together in the
    order of seq, from 0, are the rendered dialogue, and char_from/char_to are a segment's place in it. mask_from and
    mask_to bound what is learnt: the text and the closing mark of the assistant's own turns; null elsewhere. A
    dialogue is never gathered into one row, so one of any length is fine.

    Turns stand in the order of turn, speaker and checksum (nulls first); equal rows stay. A null speaker is a user named
    "unknown" and no perspective; null texts are empty; a null dialogue is one of its own. Marks inside a text are
    broken by a space. A dialogue of shared turns only has no perspective and no rows, as has an empty table.
    """
    said = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(speaker).alias("speaker"),
        F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    said = said.withColumn("print", F.md5(F.col("text").cast("binary")))
    here = F.col("speaker").isNotNull() & ~F.col("speaker").isin(*shared)
    people = said.filter(here).select(F.col("conv").alias("of"), F.col("speaker").alias("perspective")).distinct()
    people = materialize(people, "chat-speakers")
    seen = said.join(people, F.col("conv").eqNullSafe(F.col("of")))
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    general = F.coalesce(F.col("speaker").isin(*shared), F.lit(False))
    role = F.when(own, "assistant").when(general, F.col("speaker")).otherwise("user")
    name = F.when(own | general, "").otherwise(F.concat(F.lit(" name="), F.coalesce("speaker", F.lit("unknown"))))
    head = F.concat(F.lit(OPEN), role, name, F.lit("\n"))
    seen = seen.select(
        "conv", "perspective", "turn", "speaker", "print", role.alias("chat_role"), F.length(head).alias("head"), own.alias("own"),
        F.concat(head, "text", F.lit(CLOSE)).alias("segment"),
    )
    seen = materialize(seen.withColumn("chars", F.length("segment").cast("long")), "chat-seen")
    placed = running_totals(seen, ["conv", "perspective"], ["turn", "speaker", "print"], ["chars"], "chat-order")
    start, end = F.col("chars_before"), F.col("chars_before") + F.col("chars")
    return placed.select(
        F.col("conv").alias(conv), "perspective", F.col("rank").alias("seq"), F.col("turn").alias(turn), F.col("speaker").alias(speaker),
        "chat_role", "segment", start.alias("char_from"), end.alias("char_to"),
        F.when(F.col("own"), start + F.col("head")).alias("mask_from"), F.when(F.col("own"), end - 1).alias("mask_to"),
    )


PERSPECTIVES_SQL = """
WITH said AS (
  SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations
), people AS (
  SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role IS NOT NULL AND role <> 'system'
), seen AS (
  SELECT s.conv_id, p.perspective, s.turn, s.role, md5(s.body) AS print,
    CASE WHEN s.role = p.perspective THEN 'assistant' WHEN s.role = 'system' THEN 'system' ELSE 'user' END AS chat_role,
    CASE WHEN s.role = p.perspective OR s.role = 'system' THEN '' ELSE ' name=' || coalesce(s.role, 'unknown') END AS named,
    s.body
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), made AS (
  SELECT *, '<|im_start|>' || chat_role || named || chr(10) || body || '<|im_end|>' || chr(10) AS segment FROM seen
), placed AS (
  SELECT *, row_number() OVER w - 1 AS seq,
    CAST(sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_to
  FROM made
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, print)
)
SELECT conv_id, perspective, seq, turn, role, chat_role, segment, char_to - length(segment) AS char_from, char_to,
  CASE WHEN role = perspective THEN char_to - length(body) - 11 ELSE -1 END AS mask_from,
  CASE WHEN role = perspective THEN char_to - 1 ELSE -1 END AS mask_to
FROM placed
"""
