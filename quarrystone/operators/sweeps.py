"""Sweeps of text for many words or indicators at once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def any_of(words: list[str]) -> str:
    """A regular expression for any of the words, common prefixes factored out."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def text(node: dict) -> str:
        ends = "" in node
        parts = [re.escape(c) + text(n) for c, n in sorted(node.items()) if c]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and not ends else f"(?:{'|'.join(parts)})"
        return body + "?" if ends else body

    return text(root)


def found_words(text: Column, words: list[str]) -> Column:
    """The distinct words of a list in a text, whatever the case, with no letter, digit or underscore beside them.

    The edges are looked at, not taken, so neighbours share theirs.
    """
    pattern = f"(?<![a-z0-9_])({any_of([w.lower() for w in words])})(?![a-z0-9_])"
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)))


def keyword_hits(rows: DataFrame, column: str, words: dict[str, str]) -> DataFrame:
    """``rows`` once for each word in ``column``, with word and category: one scan, however many words."""
    category = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    hit = rows.withColumn("word", F.explode(found_words(F.col(column), list(words))))
    return hit.withColumn("category", category[F.col("word")])


def indicator_sweep(lines: DataFrame, text: str, terms: list[str], artifact: str, order: list[str], per_term: int = 60, per_artifact: int = 6) -> tuple[DataFrame, DataFrame]:
    """(hits, totals) of literal terms in lines: exact totals for every term, also those never seen; capped hits.

    A term's neighbours may be anything but what would make it part of a
    longer address, name or hash.
    """
    low = [t.lower() for t in terms]
    pattern = f"(?<![a-z0-9])({any_of(low)})(?![a-z0-9])"
    found = lines.withColumn("term", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)))))
    near, far = Window.partitionBy("term", artifact).orderBy(*order), Window.partitionBy("term").orderBy(artifact, *order)
    hits = found.withColumn("i_", F.row_number().over(near)).where(F.col("i_") <= per_artifact).withColumn("j_", F.row_number().over(far)).where(F.col("j_") <= per_term).drop("i_", "j_")
    named = lines.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(low)], "term string")
    counts = found.groupBy("term").agg(F.count("*").alias("count"), F.count_distinct(artifact).alias("artifacts"))
    return hits, named.join(counts, "term", "left").fillna(0, ["count", "artifacts"])


def executable_position(command: Column, name: Column) -> Column:
    """Whether a word stands where a command line has a program: first, after a shell operator, or after sudo and its like."""
    quoted = F.regexp_replace(name, r"([^A-Za-z0-9_])", r"\\$1")
    lead = r"(?:^|[;&|(`]|\$\()\s*(?:[A-Za-z_][A-Za-z0-9_]*=\S*\s+)*(?:(?:sudo|nohup|env|exec|time|nice|setsid|doas)\s+(?:-\S+\s+)*)*(?:\S*/)?"
    return F.regexp_like(F.lower(command), F.concat(F.lit(lead), F.lower(quoted), F.lit(r"(?:\.[a-z0-9]{1,4})?(?:\s|$|[;&|)])")))
