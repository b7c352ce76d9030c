"""Multi-party perspective rotation of dialogues. DataFrame operations only.

For every participant of a conversation, the dialogue is rendered with that
speaker as the assistant and all others as named users. The mask marks what is
to be learned: the assistant's own words with their end marks, as character
spans of the rendered text. System turns are rendered as such from every
perspective and belong to no participant.

A dialogue may be longer than a task should hold, so it is rendered in parts of
PART_TURNS turn numbers, and a part in pieces of PIECE_ROWS rows, if its turn
numbers repeat. The rows of one perspective, by (part, piece), put together are
the dialogue from that perspective, whatever its length: ``start`` is where a
row's text begins in it, and the spans of the mask count from there.

Turns are ordered by (turn, role, text), null turns first, in part -1. A null
or blank role is the speaker ``unknown``, who has no perspective. A null text
is empty, a long one is never cut. Columns other than these are not read. Rows with a null conv_id are one conversation, as null; a
conversation with only system or unknown turns has no perspective and no rows.
Repeated rows are rendered each time.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

PART_TURNS = 64
PIECE_ROWS = 1024
#: Lengths are summed in groups of so many parts, and over groups then, so that no dialogue's sums pass one task.
GROUP_PARTS = 4096
SYSTEM, UNKNOWN = "system", "unknown"
# The marks of a turn. In texts and names, OPEN is broken up.
OPEN, CLOSE, END = "<|turn_start|>", "<|turn_end|>", "<|"


def _clean(text: Column) -> Column:
    return F.replace(text, F.lit(END), F.lit("< |"))


def spoken(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, speaker, text, part, piece: the turns, with the share of the dialogue each belongs to."""
    role = F.btrim(F.coalesce(F.col("role").cast("string"), F.lit("")))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(role == "", UNKNOWN).otherwise(role).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(-1)).cast("long"))
    crowded = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n")).where(F.col("n") > PIECE_ROWS)
    crowded = written(crowded.select(F.col("conv_id").alias("c"), F.col("part").alias("p")), "crowded")
    if crowded.isEmpty():
        return rows.withColumn("piece", F.lit(0).cast("long"))
    here = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    plain = rows.join(crowded, here, "left_anti").withColumn("piece", F.lit(0).cast("long"))
    return plain.unionByName(_numbered(rows.join(crowded, here, "left_semi")))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``piece``, by their place in their part: equal rows are counted first, the others
    dealt to tasks by ranges of the order, so that a part of any size is numbered by many."""
    keys = [F.col("conv_id"), F.col("part"), F.col("turn"), F.encode("speaker", "UTF-8"), F.encode("text", "UTF-8")]
    counted = rows.groupBy("conv_id", "part", "turn", "speaker", "text").agg(F.count("*").alias("times"))
    dealt = counted.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = written(dealt.withColumn("task", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "dealt")
    upto = lambda *by: Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("times").over(upto("conv_id", "part", "task")), F.lit(0))
    shares = dealt.groupBy("conv_id", "part", "task").agg(F.sum("times").alias("n"))
    order = Window.partitionBy("conv_id", "part").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("task").alias("k"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("task") == F.col("k"))
    placed = dealt.withColumn("before", before).join(shares, same)
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("copy")
    every = placed.select("conv_id", "turn", "speaker", "text", "part", "base", "before", copy)
    piece = F.floor((F.col("base") + F.col("before") + F.col("copy")) / PIECE_ROWS).cast("long")
    return every.select("conv_id", "turn", "speaker", "text", "part", piece.alias("piece"))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, part, piece, n_turns, n_learned, start, rendered, mask (array of start, end): one row for each piece of each perspective."""
    turns = spoken(conversations)
    people = turns.where(~F.col("speaker").isin(SYSTEM, UNKNOWN)).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    views = turns.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own, head = F.col("speaker") == F.col("perspective"), _head()
    body = F.concat(_clean(F.col("text")), F.lit(CLOSE))
    segment = F.struct(
        "turn", "speaker", "text", own.alias("own"), F.concat(F.lit(OPEN), head, F.lit("\n"), body, F.lit("\n")).alias("s"), F.char_length(body).cast("long").alias("learned")
    )
    keys = ["conv_id", "perspective", "part", "piece"]
    starts = _starts(turns, people).select(*keys, F.lit(None).alias("segment"), "start")  # one more row of each piece
    dealt = views.select(*keys, segment.alias("segment"), F.lit(None).cast("long").alias("start")).unionByName(starts).repartition(*keys)
    grouped = dealt.groupBy(*keys).agg(F.sort_array(F.collect_list("segment")).alias("all"), F.max("start").alias("start"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.char_length(x["s"])
        span = F.struct((end - 1 - x["learned"]).alias("start"), (end - 1).alias("end"))
        return F.struct(end.alias("at"), F.when(x["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    mask = F.aggregate("all", zero, step, lambda acc: acc["spans"])
    return grouped.select(
        *keys,
        F.size("all").cast("long").alias("n_turns"),
        F.size(F.filter("all", lambda x: x["own"])).cast("long").alias("n_learned"),
        "start",
        F.array_join(F.transform("all", lambda x: x["s"]), "").alias("rendered"),
        mask.alias("mask"),
    )


def _head() -> Column:
    """How a turn of ``speaker`` is headed from ``perspective``."""
    return F.when(F.col("speaker") == F.col("perspective"), "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), _clean(F.col("speaker"))))


def _starts(turns: DataFrame, people: DataFrame) -> DataFrame:
    """conv_id, perspective, part, piece, start: the length of all that comes before in its perspective, from sums by speaker, without texts."""
    said = turns.groupBy("conv_id", "part", "piece", "speaker").agg(F.count("*").alias("times"), F.sum(F.char_length(_clean(F.col("text")))).alias("chars"))
    own = ["conv_id", "perspective"]
    around = F.char_length(F.concat(F.lit(OPEN), _head(), F.lit("\n"), F.lit(CLOSE), F.lit("\n")))
    views = said.join(people, F.col("conv_id").eqNullSafe(F.col("c")))
    lengths = views.groupBy(*own, "part", "piece").agg(F.sum(F.col("chars") + F.col("times") * around).alias("n")).withColumn("g", F.floor(F.col("part") / GROUP_PARTS))
    upto = lambda by, *order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda by, *order: F.coalesce(F.sum("n").over(upto(by, *order)), F.lit(0))
    groups = lengths.groupBy(*own, "g").agg(F.sum("n").alias("n")).withColumn("of_group", before(own, "g"))
    groups = groups.select(*(F.col(c).alias(f"{c}_") for c in (*own, "g")), "of_group")
    within = lengths.withColumn("within", before([*own, "g"], "part", "piece"))
    joined = within.join(groups, functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*own, "g"))))
    return joined.select(*own, "part", "piece", (F.col("of_group") + F.col("within")).cast("long").alias("start"))


def digest(rotated: DataFrame) -> DataFrame:
    """``rotated`` with the mask as text ``start-end,...``."""
    spans = F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))
    return rotated.select("conv_id", "perspective", "part", "piece", "n_turns", "n_learned", "start", "rendered", F.array_join(spans, ",").alias("mask"))


#: The digest in DuckDB.
ORACLE_SQL = """
WITH named AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS speaker,
    coalesce(text, '') AS text, coalesce(CAST(floor(CAST(turn AS DOUBLE) / CAST(64 AS DOUBLE)) AS BIGINT), -1) AS part
  FROM conversations
), turns AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, encode(speaker), encode(text)) - 1) // 1024 AS piece FROM named
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker NOT IN ('system', 'unknown')
), views AS (
  SELECT t.*, p.perspective, t.speaker = p.perspective AS own, replace(t.text, '<|', '< |') || '<|turn_end|>' AS body,
    CASE WHEN t.speaker = p.perspective THEN 'assistant' WHEN t.speaker = 'system' THEN 'system' ELSE 'user name=' || replace(t.speaker, '<|', '< |') END AS head
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), segments AS (
  SELECT *, '<|turn_start|>' || head || chr(10) || body || chr(10) AS s FROM views
), placed AS (
  SELECT *, sum(length(s)) OVER (PARTITION BY conv_id, perspective, part, piece ORDER BY turn NULLS FIRST, encode(speaker), encode(text) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM segments
), parts AS (
  SELECT conv_id, perspective, part, piece, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_learned,
    string_agg(s, '' ORDER BY turn NULLS FIRST, encode(speaker), encode(text)) AS rendered,
    coalesce(string_agg(CASE WHEN own THEN CAST(CAST(upto - 1 - length(body) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(upto - 1 AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn NULLS FIRST, encode(speaker), encode(text)), '') AS mask
  FROM placed GROUP BY conv_id, perspective, part, piece
)
SELECT *, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY part, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM parts
"""
