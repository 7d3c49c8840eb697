"""Chat formatting with perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and the others as named users; the mask covers what the assistant says, with its
closing mark. A rendering is returned turn by turn, each with its place, so a conversation of any
length is many rows and never one string. Concatenated in order of ``position`` the segments are
the rendering.

Turns are ordered by ``turn`` (null last), role and text; equal rows count each. ``system`` turns are
no participant's and stay as they are; a conversation of such turns alone has no rendering. A null
role is the speaker ``unknown``; a null or empty text is an empty turn; rows without ``conv_id`` form
one conversation. Marks inside texts are broken up, and names keep word characters only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolsift.llm.common import whole

#: Turn numbers per block: places are added up within blocks, then over block totals.
BLOCK = 512


def perspectives(turns: DataFrame) -> DataFrame:
    """``conv_id, speaker, position, segment, start, mask_start, mask_end`` in code points of the rendering."""
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.regexp_replace(whole(F.col("text")), r"<\|", "< |").alias("text"),
    )
    speakers = rows.where("role <> 'system'").select(F.col("conv_id").alias("_c"), F.col("role").alias("speaker")).distinct()
    rows = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    name = F.regexp_replace("role", r"[^\p{L}\p{N}_]", "_")
    head = (
        F.when(F.col("role") == "system", F.lit("<|im_start|>system\n"))
        .when(F.col("role") == F.col("speaker"), F.lit("<|im_start|>assistant\n"))
        .otherwise(F.concat(F.lit("<|im_start|>user name="), name, F.lit("\n")))
    )
    rows = rows.withColumns({"_head": head, "_block": F.floor(F.coalesce(F.col("turn"), F.lit((1 << 62))) / BLOCK)})
    rows = rows.withColumn("segment", F.concat("_head", "text", F.lit("<|im_end|>\n")))
    keys = ["conv_id", "speaker", "_block"]
    inner = Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {"_n": F.row_number().over(inner), "_at": F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0))}
    )
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.length("segment")).alias("_size"))
    outer = Window.partitionBy("conv_id", "speaker").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("conv_id").alias("_c"),
        F.col("speaker").alias("_s"),
        F.col("_block").alias("_b"),
        F.coalesce(F.sum("_rows").over(outer), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_size").over(outer), F.lit(0)).alias("_size_before"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("speaker") == F.col("_s")) & (F.col("_block") == F.col("_b"))
    rows = rows.join(totals, same)
    start = F.col("_size_before") + F.col("_at")
    spoken = F.col("role") == F.col("speaker")
    return rows.select(
        "conv_id",
        "speaker",
        (F.col("_rows_before") + F.col("_n") - 1).alias("position"),
        "segment",
        start.alias("start"),
        F.when(spoken, start + F.length("_head")).alias("mask_start"),
        F.when(spoken, start + F.length("segment") - 1).alias("mask_end"),
    )


SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
s AS (
    SELECT t.*, speaker,
        CASE WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
             WHEN role = speaker THEN '<|im_start|>assistant' || chr(10)
             ELSE '<|im_start|>user name=' || regexp_replace(role, '[^\p{L}\p{N}_]', '_', 'g') || chr(10) END AS head
    FROM t JOIN speakers p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
),
g AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM s),
p AS (
    SELECT *, row_number() OVER w - 1 AS position,
        (coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS LAST, role, text
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
    FROM g WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS LAST, role, text)
)
SELECT conv_id, speaker, position, segment, start,
    CASE WHEN role = speaker THEN start + length(head) END AS mask_start,
    CASE WHEN role = speaker THEN start + length(segment) - 1 END AS mask_end
FROM p
"""
