"""Times for lines that only have an offset from the boot: the boot's instant from lines that have both.

Every line with a wall time and an offset says when its host was booted. A clock
that was stepped says so twice; the instant that most lines agree on, within
AGREE_S, counts, and of equally common ones the latest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGREE_S = 5


def boot_instants(pairs: DataFrame, keys: list[str], agree_s: int = AGREE_S) -> DataFrame:
    """keys, booted, support, disagree of rows (keys, wall, offset_s): the boot that most rows agree on; a group without pairs has no row.

    Instants are counted in cells of ``agree_s`` and each with the cell after it,
    so that no cell's edge parts what agrees; the median of the chosen two cells
    is the boot. Partial counts by cell, then one row for each cell.
    """
    at = F.unix_micros("wall") - F.round(F.col("offset_s") * 1_000_000).cast("long")
    cell = F.floor(F.col("at_") / (agree_s * 1_000_000))
    known = pairs.where(F.col("wall").isNotNull() & F.col("offset_s").isNotNull()).select(*keys, at.alias("at_")).withColumn("cell_", cell)
    counts = known.groupBy(*keys, "cell_").agg(F.count("*").alias("n_"))
    spread = counts.select(*keys, F.explode(F.array(F.col("cell_"), F.col("cell_") - 1)).alias("cell_"), "n_")
    both = spread.groupBy(*keys, "cell_").agg(F.sum("n_").alias("n_"))
    best = both.groupBy(*keys).agg(F.max(F.struct("n_", "cell_")).alias("best_"))
    k, b = known.alias("k"), best.alias("b")
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    near = F.col("cell_").between(F.col("best_.cell_"), F.col("best_.cell_") + 1)
    joined = k.join(b, same).select(*(F.col(f"k.{c}").alias(c) for c in keys), "at_", near.alias("near_"))
    middle = F.percentile(F.when(F.col("near_"), F.col("at_")), 0.5)
    return joined.groupBy(*keys).agg(F.timestamp_micros(F.round(middle).cast("long")).alias("booted"), F.count_if("near_").alias("support"), F.count_if(~F.col("near_")).alias("disagree"))


def dated(ring: DataFrame, boots: DataFrame, keys: list[str]) -> DataFrame:
    """``ring`` (keys, offset_s) with timestamp_utc: boot and offset; null where no boot is known. ``boots`` has a row for each key."""
    r, b = ring.alias("r"), boots.select(*keys, "booted").alias("b")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    when = F.timestamp_micros(F.unix_micros("b.booted") + F.round(F.col("r.offset_s") * 1_000_000).cast("long"))
    return r.join(b, same, "left").select("r.*", when.alias("timestamp_utc"))
