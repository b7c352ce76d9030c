"""Weighted votes on what a host is set to, with conflicts told, and the offset that its clock ran at joined to its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import offset_seconds
from ..functions.words import between, parts

#: A value with this share of the winner's weight contradicts it.
CONTRADICTS = 0.5
# Weights of evidence on a clock's offset: what the host says of itself, and the offset of a line of its logs.
STATED, LOGGED = 50, 1


def decided(evidence: DataFrame, keys: list[str], contradicts: float = CONTRADICTS) -> DataFrame:
    """keys, value, weight, share, sources, conflict, against of evidence (keys, value, weight, source).

    The value with the most weight wins; of equally heavy ones none does (value
    is null). ``conflict``: another value has ``contradicts`` of its weight;
    ``against`` lists such values. Null values say nothing.
    """
    sums = evidence.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_set("source")).alias("sources"))
    each = sums.groupBy(*keys).agg(F.sum("weight").alias("all_"), F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("minus"), F.col("value"), F.col("sources")))).alias("v_"))
    top = F.col("v_")[0]
    tie = (F.size("v_") > 1) & (F.try_element_at("v_", F.lit(2))["minus"] == top["minus"])
    rivals = F.filter(F.slice("v_", 2, F.greatest(F.size("v_"), F.lit(1))), lambda x: x["minus"] <= top["minus"] * contradicts)
    return each.select(
        *keys, F.when(~tie, top["value"]).alias("value"), (-top["minus"]).alias("weight"), F.round(-top["minus"] / F.col("all_"), 4).alias("share"), top["sources"].alias("sources"),
        (F.size(rivals) > 0).alias("conflict"), F.transform(rivals, lambda x: x["value"].cast("string")).alias("against"),
    )


def offset_evidence(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence (keys, value: seconds east, weight, source) on the offset of each host's clock, from lines with keys, path and line.

    ``Time zone: Europe/Berlin (CET, +0100)`` is what the host states; a log line
    that begins with a stamp with an offset tells what it ran at. ``Z`` tells nothing.
    """
    stated = F.regexp_extract(between(F.col("line"), "Time zone:", ")"), "([-+][0-9]{4})$", 1)
    first = parts(F.col("line"), 2)[0]
    logged = F.when(F.substring(first, 11, 1) == "T", F.regexp_extract(first, "([-+][0-9]{2}:?[0-9]{2})$", 1)).otherwise("")
    said = F.when(stated != "", F.struct(stated.alias("zone"), F.lit(STATED).alias("weight"), F.lit("stated").alias("source"))).when(logged != "", F.struct(logged.alias("zone"), F.lit(LOGGED).alias("weight"), F.lit("logged").alias("source")))
    rows = lines.select(*keys, F.inline(F.array_compact(F.array(said))))
    return rows.groupBy(*keys, offset_seconds(F.col("zone")).alias("value"), "source").agg(F.sum("weight").alias("weight"))


def with_offsets(lines: DataFrame, votes: DataFrame, keys: list[str], name: str = "host_offset_s", unknown: Column | None = None) -> DataFrame:
    """``lines`` with the offset of their host (``unknown``, or 0, where none was decided): one join, the lines stay whole."""
    v = votes.select(*(F.col(k).alias(f"{k}_v_") for k in keys), F.col("value").cast("int").alias("offset_v_"))
    on = [F.col(k).eqNullSafe(F.col(f"{k}_v_")) for k in keys]
    return lines.join(v, on, "left").select(*lines.columns, F.coalesce("offset_v_", unknown if unknown is not None else F.lit(0)).alias(name))
