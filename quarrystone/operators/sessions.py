"""Sessions and carried state from ordered event rows, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Seconds of one step of time, the most that one task holds of a busy key.
STEP = 86_400


def pair_sessions(events: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column, step: Column | None = None) -> DataFrame:
    """Each opening with the closing that ends it, last in first out within ``keys``.

    Without a stack: S is the running sum of +1 and -1, M the lowest S so far
    (0 at most). A closing that lowers M has nothing to close and is dropped;
    all others sit on level S - M (+1 for closings), and on one level openings
    and closings alternate, so an opening ends at the next row of its level if
    that is a closing. One shuffle on ``keys``, one sort per window.

    With ``step``, which must never fall along ``order``, a busy key is cut into
    its steps; sums, lowest sums and open levels are carried over their edges.

    Adds ``opened`` (all columns of the opening row), ``closed`` (those of the
    closing, or null) and ``state``.
    """
    if step is not None:
        return _paired_by_steps(events, keys, order, opens, closes, step)
    columns = F.struct(*events.columns)
    by = Window.partitionBy(*keys).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = events.where(opens | closes).select(*keys, *[c for c in order if c not in keys], columns.alias("row_"), F.when(opens, 1).otherwise(-1).alias("d_"))
    run = steps.withColumn("s_", F.sum("d_").over(upto))
    run = run.withColumn("m_", F.least(F.lit(0), F.min("s_").over(upto)))
    run = run.withColumn("before_", F.coalesce(F.lag("m_").over(by), F.lit(0)))
    met = run.where((F.col("d_") == 1) | (F.col("s_") >= F.col("before_")))
    level = met.withColumn("level_", F.col("s_") - F.col("m_") + F.when(F.col("d_") == -1, 1).otherwise(0))
    on = Window.partitionBy(*keys, "level_").orderBy(*order)
    nxt = level.withColumn("next_", F.lead(F.struct("d_", "row_")).over(on)).where("d_ = 1")
    return _sessions(nxt)


def _sessions(openings: DataFrame) -> DataFrame:
    closed = F.when(F.col("next_.d_") == -1, F.col("next_.row_"))
    return openings.select(F.col("row_").alias("opened"), closed.alias("closed"), F.when(closed.isNotNull(), "closed").otherwise("still open at the end of this log").alias("state"))


def _paired_by_steps(events: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column, step: Column) -> DataFrame:
    """``pair_sessions`` with no window longer than a step, or than the number of steps."""
    marks = events.where(opens | closes).select(F.struct(*keys).alias("k_"), step.alias("step_"), F.struct(*order).alias("o_"), F.struct(*events.columns).alias("row_"), F.when(opens, 1).otherwise(-1).alias("d_"))
    by = Window.partitionBy("k_", "step_").orderBy("o_")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = written(marks.withColumn("s_", F.sum("d_").over(upto)).withColumn("low_", F.min("s_").over(upto)), "steps")
    past = Window.partitionBy("k_").orderBy("step_").rowsBetween(Window.unboundedPreceding, -1)
    edges = inside.groupBy("k_", "step_").agg(F.sum("d_").alias("d"), F.min("s_").alias("low"))
    edges = edges.withColumn("s0_", F.coalesce(F.sum("d").over(past), F.lit(0)))
    edges = edges.withColumn("m0_", F.least(F.lit(0), F.min(F.col("s0_") + F.col("low")).over(past))).select("k_", "step_", "s0_", "m0_")
    run = inside.join(edges, ["k_", "step_"]).withColumn("m_", F.least("m0_", F.col("s0_") + F.col("low_")))
    run = run.withColumn("s_", F.col("s_") + F.col("s0_")).withColumn("before_", F.coalesce(F.lag("m_").over(by), F.col("m0_")))
    met = run.where((F.col("d_") == 1) | (F.col("s_") >= F.col("before_")))
    level = met.select("k_", "step_", "o_", "d_", "row_", (F.col("s_") - F.col("m_") + F.when(F.col("d_") == -1, 1).otherwise(0)).alias("level_"))
    level = written(level, "levels")
    mark = F.struct("d_", "row_")
    here = level.withColumn("next_", F.lead(mark).over(Window.partitionBy("k_", "step_", "level_").orderBy("o_"))).where("d_ = 1")
    firsts = level.groupBy("k_", "step_", "level_").agg(F.min_by(mark, "o_").alias("first_"))
    later = firsts.withColumn("later_", F.lead("first_").over(Window.partitionBy("k_", "level_").orderBy("step_"))).select("k_", "step_", "level_", "later_")
    return _sessions(here.join(later, ["k_", "step_", "level_"], "left").withColumn("next_", F.coalesce("next_", "later_")))


def backward_asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, tolerance_s: int) -> DataFrame:
    """``left`` with the latest non-null ``value`` of ``right`` at or up to ``tolerance_s`` seconds before ``time``, by ``keys``.

    Both sides go through one shuffle on ``keys`` and one running window; of equal
    times the greatest value counts.
    """
    return _asof(left, right, keys, time, value, tolerance_s, backward=True)


def forward_asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, tolerance_s: int) -> DataFrame:
    """``left`` with the earliest non-null ``value`` of ``right`` at or up to ``tolerance_s`` seconds after ``time``; of equal times the least value."""
    return _asof(left, right, keys, time, value, tolerance_s, backward=False)


def _asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, tolerance_s: int, backward: bool) -> DataFrame:
    """Time is cut into steps no shorter than the tolerance; a hit stands in each step that it reaches (two at most),
    so a row has all its hits in its own step and a busy key is many short windows. Null times meet nothing."""
    tolerance = tolerance_s * 1_000_000
    long = max(tolerance, 3_600_000_000)
    step = lambda at: F.floor(at / long)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    a = left.select(F.lit(True).alias("left_"), *keys, micros.alias("at_"), F.struct(*left.columns).alias("row_")).withColumn("step_", step(F.col("at_")))
    reach = F.array_distinct(F.array(step(micros), step(micros + (tolerance if backward else -tolerance))))
    b = right.where(F.col(value).isNotNull() & F.col(time).isNotNull()).select(F.lit(False).alias("left_"), *keys, micros.alias("at_"), F.struct(micros.alias("t"), F.col(value).alias("v")).alias("hit_"), F.explode(reach).alias("step_"))
    both = a.unionByName(b, allowMissingColumns=True)
    # In time order (backwards: reversed), hits before the rows that look for them, the best of equal times last:
    # the last hit so far is the one wanted, whatever the window's length.
    order = [F.asc("at_"), F.asc("left_"), F.asc("hit_")] if backward else [F.desc("at_"), F.asc("left_"), F.desc("hit_")]
    w = Window.partitionBy(*keys, "step_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = both.withColumn("last_", F.last("hit_", ignorenulls=True).over(w)).where("left_")
    near = F.abs(F.col("at_") - F.col("last_.t")) <= tolerance
    return last.withColumn("met_", F.when(near, F.col("last_"))).select("row_.*", F.col("met_.v").alias(f"asof_{value}"), F.timestamp_micros("met_.t").alias(f"asof_{time}"))


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], marker: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the last non-null ``marker`` at or before each row (block and section headers)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(marker, ignorenulls=True).over(w))


def carry_to_next(rows: DataFrame, keys: list[str], order: list[str], marker: Column, name: str) -> DataFrame:
    """The rows that are no marker, with the marker on the row just before, if any: it applies once."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("marker_", marker).withColumn(name, F.lag("marker_").over(w)).where("marker_ IS NULL").drop("marker_")


def block_ids(rows: DataFrame, keys: list[str], order: list[str], header: Column, name: str = "block") -> DataFrame:
    """``rows`` numbered by the header that opens their block; 0 before the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.sum(F.when(header, 1).otherwise(0)).over(w))


def terminal_sessions(records: DataFrame) -> DataFrame:
    """Login records (file, line, ord, type, user, host, ts) to sessions with an end and a state.

    On one terminal a login opens; the next login closes it without a logout
    record; DEAD closes it; a boot or a shutdown closes every terminal's.
    Boots and shutdowns are copied to each terminal of their file, which
    costs one join with the distinct terminals.
    """
    wide = F.col("type").isin("BOOT", "SHUTDOWN")
    lines = records.where(~wide).select("file", "line").distinct()
    ends = records.where(wide).drop("line").join(lines, "file").select(*records.columns)
    both = records.where(F.col("type").isin("LOGIN", "DEAD")).unionByName(ends)
    w = Window.partitionBy("file", "line").orderBy("ord")
    nxt = both.withColumn("next_", F.lead(F.struct("type", "ts")).over(w)).where("type = 'LOGIN'")
    kind = F.col("next_.type")
    state = F.when(kind == "DEAD", "closed").when(kind == "BOOT", "ended at reboot").when(kind == "SHUTDOWN", "ended at shutdown").when(kind == "LOGIN", "no logout record")
    return nxt.select("file", "line", "user", "host", F.col("ts").alias("start"), F.col("next_.ts").alias("end"), F.coalesce(state, F.lit("still open at the end of this wtmp")).alias("state"))


def boot_segments(rows: DataFrame, boots: DataFrame, keys: list[str], time: str) -> DataFrame:
    """``rows`` with boot (the latest boot of their keys at or before ``time``, null before the first) and newest: whether it is the last one.

    ``boots`` has keys and ``time``. Rows are windowed with the boots of their own
    step of time; the boot that a step begins with comes from a table of the
    steps of each key, so no window holds all the rows of a busy host.
    """
    a = rows.select(F.lit(1).alias("order_"), F.struct(*keys).alias("k_"), F.col(time).cast("timestamp").alias("at_"), F.struct(*rows.columns).alias("row_")).withColumn("step_", time_step("at_"))
    b = boots.where(F.col(time).isNotNull()).select(F.lit(0).alias("order_"), F.struct(*keys).alias("k_"), F.col(time).cast("timestamp").alias("at_")).distinct().withColumn("step_", time_step("at_"))
    per = a.select("k_", "step_").distinct().unionByName(b.select("k_", "step_", "at_"), allowMissingColumns=True).groupBy("k_", "step_").agg(F.max("at_").alias("at"))
    past = Window.partitionBy("k_").orderBy("step_").rowsBetween(Window.unboundedPreceding, -1)
    edges = per.select(F.col("k_"), F.col("step_").alias("of_"), F.max("at").over(past).alias("first_"), F.max("at").over(Window.partitionBy("k_")).alias("last_"))
    upto = Window.partitionBy("k_", "step_").orderBy("at_", "order_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    booted = F.when(F.col("order_") == 0, F.col("at_"))
    seen = a.unionByName(b, allowMissingColumns=True).withColumn("here_", F.last(booted, ignorenulls=True).over(upto)).where("order_ = 1")
    met = seen.join(edges.withColumnRenamed("k_", "of_key_"), (F.col("k_") == F.col("of_key_")) & F.col("step_").eqNullSafe(F.col("of_")), "left").withColumn("boot", F.coalesce("here_", "first_"))
    return met.select("row_.*", "boot", F.coalesce(F.col("boot") == F.col("last_"), F.lit(False)).alias("newest"))


def time_step(time: str) -> Column:
    """The step of time that a row is in."""
    return F.floor(F.unix_seconds(time) / STEP)


def unclean_boots(records: DataFrame, keys: list[str], time: str, kind: str = "type") -> DataFrame:
    """Boots (rows of kind BOOT) that end in another boot with no SHUTDOWN between: keys, boot, next_boot. Of equal times a shutdown comes first."""
    marks = records.where(F.col(kind).isin("BOOT", "SHUTDOWN")).select(*keys, F.col(time).alias("at_"), F.col(kind).alias("kind_")).distinct()
    w = Window.partitionBy(*keys).orderBy("at_", F.when(F.col("kind_") == "SHUTDOWN", 0).otherwise(1))
    nxt = marks.withColumn("next_", F.lead(F.struct("kind_", "at_")).over(w))
    return nxt.where("kind_ = 'BOOT' AND next_.kind_ = 'BOOT'").select(*keys, F.col("at_").alias("boot"), F.col("next_.at_").alias("next_boot"))
