"""Multi-party perspective rotation of conversations.

Every participant of a conversation gets a rendering of the whole dialogue in which their own turns
are the assistant's, all others speak as named users, and the loss mask covers their own words only.
Turns of a narrator (``system``) are rendered as such in every perspective and are no perspective.

A rendering is one row, the whole dialogue. Where conversations may be too long for a row (2 GB), ``chunk`` cuts a rendering
into rows of so many turns: turns are numbered over range partitions, not per conversation, so then no
conversation meets in one row or task. A mask holds code-point spans within its own row's text.

Edge cases: null text is an empty turn, a very long one is rendered whole; columns beside the four, whatever their names, are ignored; a null role is the speaker ``unknown``; turns with a null
conv_id form one conversation; equal turn numbers are ordered by role and text, null ones first;
repeated rows are turns of their own; an empty table gives no rows. ``<|`` inside a text or a role is
written ``<\\|``, and ``|>`` inside a role ``|\\>``, so that neither can forge a mark; between these two signs
one backslash is added to those that are there, so taking one away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, numbered

#: Fixed marks of the rendered format.
OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"
NARRATORS, UNKNOWN = ("system",), "unknown"


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def _clean_name(c: Column) -> Column:
    return F.regexp_replace(_clean(c), r"\|(\\*)>", r"|\\$1>")


def render(conversations: DataFrame, chunk: int | None = None) -> DataFrame:
    """conv_id, perspective, chunk, n_turns, text, mask (array of start and end): one row per perspective, or per chunk of each."""
    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(UNKNOWN)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    placed = numbered(turns, [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")])
    begins = placed.groupBy("conv").agg(F.min("pos").alias("begin"))
    placed = placed.join(begins, "conv").withColumn("place", F.col("pos") - F.col("begin"))
    placed = placed.withColumn("chunk", (F.floor(F.col("place") / chunk) if chunk else F.lit(0)).cast("int")).select("conv", "chunk", "place", "role", "text")

    speakers = turns.where(~F.col("role").isin(*NARRATORS)).select("conv", F.col("role").alias("perspective")).distinct()
    seen = placed.join(speakers, "conv")
    mine = F.col("role") == F.col("perspective")
    head = F.when(mine, F.lit("assistant")).when(F.col("role").isin(*NARRATORS), F.col("role")).otherwise(F.concat(F.lit("user name="), _clean_name(F.col("role"))))
    parts = seen.select(
        "conv", "perspective", "chunk",
        F.struct("place", F.concat(F.lit(OPEN), head, F.lit(CLOSE + "\n")).alias("head"), F.concat(_clean(F.col("text")), F.lit(END)).alias("body"), mine.alias("mine")).alias("turn"),
    )
    row = ["conv", "perspective", "chunk"]
    size = F.length("turn.head") + F.length("turn.body")
    ends = parts.withColumn("stop", F.sum(size).over(Window.partitionBy(*row).orderBy("turn.place")))
    own = F.when(F.col("turn.mine"), F.struct((F.col("stop") - F.length("turn.body")).cast("int").alias("start"), F.col("stop").cast("int").alias("end")))
    each = ends.select(*row, F.struct("turn.place", F.concat("turn.head", "turn.body").alias("text"), own.alias("span")).alias("turn"))
    gathered = each.groupBy(*row).agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return gathered.select(
        F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), "perspective", "chunk", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("text"), F.array_compact(F.transform("turns", lambda t: t["span"])).alias("mask"),
    )


def rotated(conversations: DataFrame) -> DataFrame:
    """``render`` with the mask as text, start:end joined by commas."""
    spans = F.array_join(F.transform("mask", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return render(conversations).withColumn("mask", spans)


#: DuckDB SQL for ``rotated``.
ROTATED_SQL = r"""
WITH t AS (
  SELECT coalesce(conv_id, -9223372036854775808) AS conv, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM t
), s AS (
  SELECT DISTINCT conv, role AS perspective FROM t WHERE role <> 'system'
), r AS (
  SELECT n.conv, perspective, CAST(0 AS INT) AS chunk, place, role = perspective AS mine,
    '<|' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN role ELSE 'user name=' || regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') END || '|>' || chr(10) AS head,
    regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS body
  FROM n JOIN s ON n.conv = s.conv
), p AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv, perspective, chunk ORDER BY place) AS stop FROM r
)
SELECT nullif(conv, -9223372036854775808) AS conv_id, perspective, chunk, count(*) AS n_turns,
  string_agg(head || body, '' ORDER BY place) AS text,
  coalesce(string_agg(CAST(CAST(stop - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY place) FILTER (mine), '') AS mask
FROM p GROUP BY conv, perspective, chunk
"""
