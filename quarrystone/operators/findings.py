"""Rules that turn rows into findings: thresholds, time stamps, ranked reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BRUTE, SPRAY, BRUTE_HIGH = 10, 5, 50
SKEW_S, BACKDATE_DAYS, ROWS_PER_RULE, BULK = 2, 180, 5000, 200


def failed_sources(attempts: DataFrame, source: str, user: str, failed: Column, succeeded: Column, brute: int = BRUTE, spray: int = SPRAY) -> DataFrame:
    """Sources with many failures or many accounts tried: counts, severity, and whether they also got in.

    Success is counted in the same pass, so the semi join costs no second shuffle.
    """
    per = attempts.groupBy(F.col(source).alias("source")).agg(F.count_if(failed).alias("failures"), F.count_distinct(F.when(failed, F.col(user))).alias("accounts"), F.count_if(succeeded).alias("successes"))
    hot = per.where((F.col("failures") >= brute) | (F.col("accounts") >= spray))
    severity = F.when((F.col("failures") > 0) & (F.col("successes") > 0), "CRITICAL").when((F.col("accounts") >= spray) | (F.col("failures") >= BRUTE_HIGH), "HIGH").otherwise("MEDIUM")
    return hot.withColumn("severity", severity)


def stamp_rules(atime: Column, mtime: Column, ctime: Column, crtime: Column, window_start: Column, suspicious: Column) -> Column:
    """The names of the rules that a file's time stamps break, as an array. Seconds; absent is null.

    ``suspicious``: the file is executable or in a system or temporary place.
    """
    second = lambda c: F.pmod(c, F.lit(60))
    any_stamp = F.coalesce(atime, mtime, ctime, crtime).isNotNull()
    rules = {
        "mtime_ahead": ctime < mtime - SKEW_S,
        "minute_aligned": (atime == mtime) & (atime != ctime) & (second(atime) == 0) & (second(ctime) != 0),
        "stamp_missing": (mtime.isNull() | ctime.isNull()) & any_stamp,
        "pre_creation": ctime < crtime - SKEW_S,
        "new_file_old_mtime": (crtime >= window_start) & (mtime < crtime - BACKDATE_DAYS * 86_400) & suspicious,
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), name) for name, test in rules.items())))


# Severities of the rules.
STAMP_SEVERITY = {"mtime_ahead": "HIGH", "minute_aligned": "MEDIUM", "stamp_missing": "MEDIUM", "pre_creation": "HIGH", "new_file_old_mtime": "MEDIUM"}


def stamp_findings(rows: DataFrame, rules: Column, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, findings): one row per file and rule, ROWS_PER_RULE at most of each; counts by rule, INFO where there are over BULK."""
    severity = F.create_map(*[F.lit(x) for kv in STAMP_SEVERITY.items() for x in kv])
    each = rows.withColumn("rule", F.explode(rules)).withColumn("severity", severity[F.col("rule")])
    w = Window.partitionBy("rule").orderBy(*order)
    kept = each.withColumn("rank_", F.row_number().over(w)).where(F.col("rank_") <= ROWS_PER_RULE).drop("rank_")
    found = each.groupBy("rule").agg(F.count("*").alias("count"), F.first("severity").alias("severity"))
    return kept, found.withColumn("severity", F.when(F.col("count") > BULK, "INFO").otherwise(F.col("severity")))


def ranked(findings: DataFrame) -> DataFrame:
    """Findings by severity, category and title."""
    from .entities import severity_rank

    return findings.orderBy(severity_rank(F.col("severity")), "category", "title")


def first_match(text: Column, patterns: list[tuple[str, str, str]]) -> Column:
    """(description, severity) of the first pattern in order that a line matches, or null: one ordered CASE."""
    out = None
    for pattern, description, severity in patterns:
        hit = F.struct(F.lit(description).alias("description"), F.lit(severity).alias("severity"))
        out = F.when(text.rlike(pattern), hit) if out is None else out.when(text.rlike(pattern), hit)
    return out


def grouped_finding(rows: DataFrame, title: str, severity: str, category: str, evidence: str, keep: int = 20) -> DataFrame:
    """All rows as one finding row, or none: count, first and last ``ts``, and a sample of evidence."""
    sample = rows.orderBy(evidence).limit(keep).agg(F.sort_array(F.collect_list(evidence)).alias("evidence"))
    total = rows.agg(F.count("*").alias("count"), F.min("ts").alias("first_utc"), F.max("ts").alias("last_utc")).where("count > 0")
    shown = F.format_string(title.replace("%d", "%s"), F.col("count")) if "%d" in title else F.lit(title)
    return total.crossJoin(F.broadcast(sample)).select(F.lit(severity).alias("severity"), F.lit(category).alias("category"), shown.alias("title"), "count", "first_utc", "last_utc", "evidence")  # one row each
