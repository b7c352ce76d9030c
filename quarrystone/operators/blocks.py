"""Nested blocks in braces: the headers that enclose each line, from running sums and last-opened values.

The depth before a line is the sum of braces above it. The header of level k
that encloses a line is the last one opened on that level, as long as the depth
has not fallen below it: had it, another header would have been opened since.
Windows run over one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r"))


def enclosing(lines: DataFrame, text: Column, levels: int, keys: list[str] = ["path"], order: list[str] = ["line_no"]) -> DataFrame:  # noqa: B006
    """``lines`` with statement, depth, headers (array, outermost first) and opens: whether the line opens a block.

    A line holds one statement, one opening or one closing (as these tools write
    them); ``text`` is the line without comments. Blocks deeper than ``levels``
    keep the headers of the first ``levels``.
    """
    t = _trim(text)
    opens, closes = t.endswith("{"), t.startswith("}")
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    statement = _trim(F.when(opens, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(F.rtrim(t, F.lit(";"))))
    rows = lines.withColumn("statement", statement).withColumn("opens", opens)
    rows = rows.withColumn("after_", F.sum(F.when(opens, 1).otherwise(0) - F.when(closes, 1).otherwise(0)).over(upto))
    rows = rows.withColumn("depth", F.col("after_") - F.when(opens, 1).otherwise(0)).withColumn("closes_", closes)
    for k in range(1, levels + 1):
        mine = F.when(F.col("opens") & (F.col("after_") == k), F.struct(F.col("statement").alias("header"), *(F.col(c) for c in order)))
        rows = rows.withColumn(f"level{k}_", F.when(F.col("depth") >= k, F.last(mine, ignorenulls=True).over(upto)))
    own = F.filter(F.array(*(F.col(f"level{k}_") for k in range(1, levels + 1))), lambda x: x.isNotNull())
    kept = rows.withColumn("blocks_", own).where(~F.col("closes_") & (F.col("statement") != ""))
    return kept.withColumn("headers", F.transform("blocks_", lambda x: x["header"])).withColumn("block_ids", F.transform("blocks_", lambda x: x[order[0]])).drop("after_", "closes_", "blocks_", *(f"level{k}_" for k in range(1, levels + 1)))


def nft_rules(lines: DataFrame) -> DataFrame:
    """FIREWALL from ``nft list ruleset``: family, table, chain, hook, policy, rule; a chain's hook and policy reach all its rules."""
    text = F.regexp_replace("line", r"\s#.*$", "")
    rows = enclosing(lines.where(~_trim(F.col("line")).startswith("#")), text, 3).where(~F.col("opens"))
    inner = F.element_at("headers", -1)
    rules = rows.where(F.size("headers") >= 2).withColumn("kind", F.split(inner, r"\s+")[0]).where("kind = 'chain'")
    head = F.split(F.col("headers")[0], r"\s+")
    chain = Window.partitionBy("path", F.col("block_ids")[1])
    is_hook = F.col("statement").startswith("type ")
    said = lambda pattern: F.coalesce(F.max(F.when(is_hook, F.nullif(F.regexp_extract("statement", pattern, 1), F.lit("")))).over(chain), F.lit(""))
    named = rules.select("*", head[1].alias("family"), F.element_at(head, -1).alias("table"), F.element_at(F.split(inner, r"\s+"), -1).alias("chain"), said(r"hook (\w+)").alias("hook"), said(r"policy (\w+)").alias("policy"))
    return named.where(~is_hook).select("family", "table", "chain", "hook", "policy", F.col("statement").alias("rule"), F.col("path").alias("source"), "line_no")


def iptables_rules(lines: DataFrame) -> DataFrame:
    """FIREWALL from ``iptables-save``: table, chain, policy, rule; ``*table`` holds until the next, policies meet rules by chain."""
    t = _trim(F.col("line"))
    upto = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("t", t).withColumn("table", F.last(F.when(t.startswith("*"), F.substring(t, F.lit(2), F.length(t))), ignorenulls=True).over(upto))
    words = F.split("t", r"\s+")
    policies = rows.where(F.col("t").startswith(":")).select("path", "table", F.substring(words[0], F.lit(2), F.length(words[0])).alias("chain"), words[1].alias("policy")).dropDuplicates(["path", "table", "chain"])
    rules = rows.where(F.col("t").startswith("-A ")).select("path", "line_no", "table", words[1].alias("chain"), F.substring_index("t", " ", -1).alias("target"), F.col("t").alias("rule"))
    return rules.join(policies, ["path", "table", "chain"], "left").select("table", "chain", F.coalesce("policy", F.lit("")).alias("policy"), "rule", F.col("path").alias("source"), "line_no")


def web_config(lines: DataFrame, levels: int = 6) -> DataFrame:
    """WEB_CONFIG from nginx-like files: directive, value, the blocks around it (outermost first, ``>`` between), line."""
    rows = enclosing(lines.where(~_trim(F.col("line")).startswith("#")), F.regexp_replace("line", r"\s#.*$", ""), levels).where(~F.col("opens"))
    words = F.split("statement", r"\s+", 2)
    return rows.select(words[0].alias("directive"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("value"), F.array_join("headers", " > ").alias("context"), F.col("path").alias("source"), "line_no")
