"""Results of collectors whose columns nobody has declared: JSON lines to one typed table for each artifact.

A line becomes a VARIANT once. The columns of an artifact and their types are
found by aggregation over all its rows (the smallest type that holds every
value), and its table reads them out of the same VARIANT column. Lines that are
no JSON object are kept apart with their place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(lines: DataFrame, artifact: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): lines (path, line_no, line) as (path, line_no, artifact, v); and lines with text that hold no JSON object."""
    texts = lines.where(F.btrim("line") != "").select("path", "line_no", "line", F.explode(F.array(F.try_parse_json("line"))).alias("v"))
    good = F.coalesce(F.schema_of_variant(F.col("v")).startswith("OBJECT"), F.lit(False))
    return texts.where(good).withColumn("artifact", artifact).select("path", "line_no", "artifact", "v"), texts.where(~good).select("path", "line_no", "line")


def fields(schema: str) -> dict[str, str]:
    """Columns and types of ``OBJECT<name: TYPE, ...>``; what is nested stays whole."""
    body = schema[schema.index("<") + 1 : -1] if "<" in schema else ""
    out, depth, start = {}, 0, 0
    for i, c in enumerate(body + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            name, _, kind = body[start:i].strip().rpartition(": ") if "<" not in body[start:i] else body[start:i].strip().partition(": ")
            if name:
                out[name.strip("`")] = kind
            start = i + 1
    return out


def schemas(rows: DataFrame) -> dict[str, dict[str, str]]:
    """Columns and types of each artifact: one aggregation over all rows, one small row for each artifact."""
    found = rows.groupBy("artifact").agg(F.schema_of_variant_agg("v").alias("s")).collect()
    return {r["artifact"]: fields(r["s"]) for r in found}


def _cell(name: str, kind: str) -> Column:
    """A column of an artifact; nested values and those of several kinds are their JSON text."""
    path = "$." + name if re.fullmatch(r"\w+", name) else "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
    plain = re.fullmatch(r"BIGINT|DOUBLE|STRING|BOOLEAN|DECIMAL\(\d+,\s*\d+\)|DATE|TIMESTAMP", kind)
    value = F.try_variant_get("v", path, kind.lower() if plain and kind != "VOID" else "string")
    return value if plain or kind == "VOID" else F.coalesce(value, F.to_json(F.try_variant_get("v", path, "variant")))


def artifact_table(rows: DataFrame, artifact: str, columns: dict[str, str]) -> DataFrame:
    """path, line_no, and the typed columns of one artifact, in order of name."""
    own = [(n, k) for n, k in sorted(columns.items())]
    return rows.where(F.col("artifact") == artifact).select("path", "line_no", *(_cell(n, k).alias(n) for n, k in own))
