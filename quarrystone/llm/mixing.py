"""Mixing sources to target weights by weighted fair queueing. DataFrame operations only.

Every document is served up to MAX_EPOCHS times. Its source's documents are
shuffled by a hash; the virtual finish time of a serving is the source's
words served up to and including it, divided by the source's target. The
serving in which a source reaches its target is split there, so that its first
piece finishes at time 1. Pieces sorted by finish time over all sources are
taken until the total budget is reached.

Cumulative sums are taken in two levels, so that no source and no time range
has to pass one task: sums over slices of the order first, then within a
slice. A slice is a range of the shuffle hash (within a source) or of finish
times (globally). Of the latter only the one in which the budget is reached
needs its own order.

A null text has size 0; a document of size 0 is never taken. Null sources are
one source, sorted last. Repeated rows and null doc_ids are documents of
their own: rows equal in (source, size, doc_id) are counted first, have one
place in the shuffle and are served one after the other, so which of them is
taken makes no difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import word_count, written

WEIGHTS = (5, 2, 1)
#: Words to take, as a percentage of all words.
SHARE_PERCENT = 150
MAX_EPOCHS = 2
#: Slices of the finish times up to 1, where the budget is reached, for the global order.
TIME_SLICES = 1 << 16
#: Distinct documents that a slice of a source should have; their hash's first digits make the slice.
SLICE_ROWS = 100_000
#: The source table goes to every executor while it has at most so many rows.
BROADCAST_SOURCES = 100_000


def weigh_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, rank, weight) from (source, source_size): WEIGHTS in turn, by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod("rank", F.lit(len(WEIGHTS))) + 1).cast("int"))
    return sizes.withColumn("rank", rank).withColumn("weight", weight.cast("long"))


def targets(weighed: DataFrame) -> DataFrame:
    """(source, source_size, rank, target): SHARE_PERCENT of all words dealt by weight, at most
    MAX_EPOCHS times a source's own, the excess dealt again until none is above.

    With sources sorted by size over weight, those that are full are a prefix:
    source i is full if the level that the rest would get, were all before it
    full, reaches its cap.
    """
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    ranked = (
        weighed.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("full_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    # level >= cap / weight, in whole numbers
    room = F.col("total") * SHARE_PERCENT - F.col("full_before") * (100 * MAX_EPOCHS)
    full = room * F.col("weight") >= F.col("source_size") * (100 * MAX_EPOCHS) * (F.col("all_weight") - F.col("weight_before"))
    flagged = ranked.withColumn("full", full)
    left = lambda c: F.coalesce(F.sum(F.when(~F.col("full"), F.col(c))).over(everything), F.lit(0))
    level = (F.col("total") * SHARE_PERCENT - (F.col("total") - left("source_size")) * (100 * MAX_EPOCHS)) / F.lit(100.0)
    level = F.try_divide(level, left("weight"))
    target = F.when(F.col("full"), F.col("source_size") * float(MAX_EPOCHS)).otherwise(F.col("weight") * level)
    return flagged.select("source", "source_size", "rank", target.alias("target"))


def shuffled(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sized`` (doc_id, source, size) with its source's columns, ``turn`` (the shuffle hash) and
    ``served``: the words of its source up to and including it, in the order of turns.

    How many digits make a slice follows the number of documents; the sums do not depend on it.
    """
    counted = written(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("times")), "counted")
    most = counted.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    digits = 1
    while most > SLICE_ROWS * 16**digits:
        digits += 1
    if sources.count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    d, s = counted.alias("d"), sources.alias("s")
    turn = F.md5(F.concat_ws(":", F.lit("mix"), F.coalesce(F.col("d.doc_id").cast("string"), F.lit("-")), F.col("size").cast("string")).cast("binary"))
    dealt = (
        d.join(s, F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("d.doc_id", "size", "times", "source_size", "rank", "target", turn.alias("turn"))
        .withColumn("slice", F.substring("turn", 1, digits))
    )
    before = Window.partitionBy("rank").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("rank", "slice").agg(F.sum(F.col("size") * F.col("times")).alias("n")).select("rank", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.sum(F.col("size") * F.col("times")).over(Window.partitionBy("rank", "slice").orderBy("turn", "size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = dealt.withColumn("within", within).join(base, ["rank", "slice"]).withColumn("end", F.col("base") + F.col("within"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")
    every = placed.select("doc_id", "size", "source_size", "rank", "target", "turn", "times", "end", each)
    served = F.col("end") - F.col("size") * (F.col("times") - F.col("copy"))
    return every.withColumn("served", served).drop("times", "end", "copy")


def _pieces() -> list[tuple[Column, Column]]:
    """For each epoch, the two pieces of a serving: what they are sorted by, and their words."""
    out = []
    for epoch in range(MAX_EPOCHS):
        end = F.col("source_size") * epoch + F.col("served")
        finish = F.try_divide(end, "target")
        first = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - (end - F.col("size"))))
        for piece, (at, n) in enumerate(((F.least(finish, F.lit(1.0)), first), (finish, F.col("size") - first))):
            out.append((F.struct(at.alias("finish"), F.col("rank").alias("rank"), F.lit(epoch).alias("epoch"), F.col("served").alias("served"), F.lit(piece).alias("piece")), n.cast("long")))
    return out


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each row of ``docs`` (doc_id, text, source)."""
    sized = written(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "sized")
    sources = written(targets(weigh_sources(sized.groupBy("source").agg(F.sum("size").alias("source_size")))), "sources")
    budget = (sources.agg(F.sum("source_size")).first()[0] or 0) * SHARE_PERCENT // 100
    ordered = written(shuffled(sized, sources), "ordered")
    slice_of = lambda finish: F.least(F.floor(finish * TIME_SLICES), F.lit(MAX_EPOCHS * 64 * TIME_SLICES))
    pieces = (
        ordered.where("size > 0")
        .select(F.explode(F.array(*(F.struct(k.alias("s"), n.alias("n")) for k, n in _pieces()))).alias("p"))
        .select("p.s", "p.n")
        .where("n > 0")
        .withColumn("slice", slice_of(F.col("s.finish")))
    )
    upto = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = pieces.groupBy("slice").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(upto))
    full = sums.where(F.col("upto") <= budget).agg(F.max("slice").alias("slice"), F.max("upto").alias("upto")).first()
    after, used = (-1, 0) if full["slice"] is None else full
    cut = pieces.where(F.col("slice") > after).agg(F.min("slice")).first()[0]
    runs = pieces.where(F.col("slice") == F.lit(cut)).withColumn("run", F.sum("n").over(Window.orderBy("s")))
    last = runs.where(F.col("run") <= budget - used).agg(F.max("s").alias("s")).first()["s"]
    taken = F.lit(0)
    for s, n in _pieces():
        goes = slice_of(s["finish"]) <= after
        if last is not None:
            goes = goes | (s <= F.struct(*(F.lit(last[f]).alias(f) for f in ("finish", "rank", "epoch", "served", "piece"))))
        taken = taken + F.when((F.col("size") > 0) & goes, n).otherwise(0)
    return ordered.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


#: The same rows in DuckDB, over a view or table ``{docs}`` (doc_id, text, source).
ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {docs}
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1 AS rank FROM per
), weighed AS (
  SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight FROM ranked
), summed AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS all_weight,
    CAST(coalesce(sum(source_size) OVER w, 0) AS BIGINT) AS full_before, CAST(coalesce(sum(weight) OVER w, 0) AS BIGINT) AS weight_before
  FROM weighed
  WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / CAST(weight AS DOUBLE), weight, encode(source) ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), flagged AS (
  SELECT *, (total * 150 - full_before * 200) * weight >= source_size * 200 * (all_weight - weight_before) AS is_full FROM summed
), levels AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN NOT is_full THEN source_size END) OVER (), 0) AS BIGINT) AS left_size,
    CAST(coalesce(sum(CASE WHEN NOT is_full THEN weight END) OVER (), 0) AS BIGINT) AS left_weight
  FROM flagged
), aimed AS (
  SELECT source, source_size, rank, total, CASE WHEN is_full THEN CAST(source_size AS DOUBLE) * CAST(2 AS DOUBLE)
    ELSE CAST(weight AS DOUBLE) * (CAST(total * 150 - (total - left_size) * 200 AS DOUBLE) / CAST(100 AS DOUBLE) / CAST(left_weight AS DOUBLE)) END AS target
  FROM levels
), turned AS (
  SELECT d.doc_id, d.size, a.source_size, a.rank, a.target, a.total, md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '-') || ':' || CAST(d.size AS VARCHAR)) AS turn
  FROM sized d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source
), ordered AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY rank ORDER BY turn, size, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS served FROM turned
), servings AS (
  SELECT o.size, o.total, o.rank, o.served, e.epoch, CAST(o.source_size * e.epoch + o.served AS DOUBLE) / o.target AS finish,
    greatest(0, least(o.size, CAST(floor(o.target) AS BIGINT) - (o.source_size * e.epoch + o.served - o.size))) AS head
  FROM ordered o CROSS JOIN (VALUES (0), (1)) e(epoch) WHERE o.size > 0
), pieces AS (
  SELECT total, rank, served, epoch, 0 AS piece, least(finish, CAST(1 AS DOUBLE)) AS finish, head AS n FROM servings WHERE head > 0
  UNION ALL SELECT total, rank, served, epoch, 1, finish, size - head FROM servings WHERE size > head
), runs AS (
  SELECT *, sum(n) OVER (ORDER BY finish, rank, epoch, served, piece) AS run FROM pieces
), taken AS (
  SELECT rank, served, n FROM runs WHERE run <= (total * 150) // 100
), per_doc AS (
  SELECT rank, served, sum(n) AS words FROM taken GROUP BY rank, served
)
SELECT o.doc_id, o.size, o.source_size, o.target, CAST(coalesce(s.words, 0) AS BIGINT) AS taken
FROM ordered o LEFT JOIN per_doc s ON o.rank = s.rank AND o.served = s.served AND o.size > 0
"""
