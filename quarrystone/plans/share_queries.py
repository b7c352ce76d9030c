"""Queries on the star tables: hosts are nations, files are parts; merges, shared values, time stamps, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correlate, entities, findings, grid
from .catalog import query, table


@query("""
SELECT 'web01' AS collection, CAST(r_regionkey AS INTEGER) AS key, r_name AS name, CAST(NULL AS INTEGER) AS parent FROM region
UNION ALL SELECT 'db02', CAST(n_nationkey AS INTEGER), n_name, CAST(n_regionkey AS INTEGER) FROM nation
""")
def union_by_name_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("int").alias("key"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("parent"))
    return entities.merge_by_name({"web01": r, "db02": n}).select("collection", "key", "name", "parent")


def _bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, part, ts): parts by the nation that bought them. The small sides have a bounded size per scale; Catalyst picks the joins."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("host"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("ts"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part"))
    return li.join(o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey")).select("host", "part", "ts")


_BOUGHT = """bought AS (
  SELECT 'n' || c_nationkey AS host, l_partkey AS part, o_orderdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
)"""


@query(f"""
WITH {_BOUGHT}, per AS (SELECT part AS value, host, count(*) AS n, min(ts) AS a, max(ts) AS b FROM bought GROUP BY part, host)
SELECT value, count(*) AS host_count, string_agg(host, ', ' ORDER BY host) AS hosts, arg_min(host, struct_pack(t := a, h := host)) AS first_host, strftime(min(a), '%Y-%m-%d') AS first_utc,
  arg_max(host, struct_pack(t := b, h := host)) AS last_host, strftime(max(b), '%Y-%m-%d') AS last_utc, CAST(sum(n) AS BIGINT) AS total_mentions
FROM per GROUP BY value HAVING count(*) >= 2
""")
def shared_value_across_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _bought(spark, sf_dir).select("host", F.col("part").alias("value"), F.lit("bought").alias("why"), F.lit(1).alias("count"), F.col("ts").alias("first"), F.col("ts").alias("last"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return correlate.shared_indicators(seen).select("value", "host_count", "hosts", "first_host", day("first_utc"), "last_host", day("last_utc"), "total_mentions")


@query("""
WITH g AS (SELECT DISTINCT p_brand AS key, 'size' || (p_size % 4) AS host FROM part), every AS (SELECT list_sort(list(DISTINCT host)) AS h FROM g)
SELECT key, CAST(count(*) AS INTEGER) AS host_count, string_agg(host, ', ' ORDER BY host) AS hosts,
  array_to_string(list_filter((SELECT h FROM every), lambda x: NOT list_contains(list(host), x)), ', ') AS missing_from
FROM g GROUP BY key
""")
def missing_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.concat(F.lit("size"), (F.col("p_size") % 4).cast("string")).alias("host"))
    return correlate.missing_from(p.distinct(), "key")


@query("""
SELECT c_mktsegment AS name, count(DISTINCT host) AS host_count, string_agg(DISTINCT host, ', ' ORDER BY host) AS hosts,
  count(DISTINCT rich) = 1 AS same_rich, count(DISTINCT kind) = 1 AS same_kind, count(DISTINCT rich) = 1 AND count(DISTINCT kind) = 1 AS consistent
FROM (SELECT c_mktsegment, 'n' || c_nationkey AS host, c_acctbal > 5000 AS rich, length(c_mktsegment) AS kind FROM customer)
GROUP BY c_mktsegment HAVING count(DISTINCT host) >= 2
""")
def consistency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("host"), (F.col("c_acctbal") > 5000).alias("rich"), F.length("c_mktsegment").alias("kind"))
    return correlate.consistency(c, "name", ["rich", "kind"])


@query(f"""
WITH {_BOUGHT}, f AS (SELECT part, host, min(ts) AS t FROM bought GROUP BY part, host),
e AS (SELECT part, min(struct_pack(t := t, h := host)) AS a, max(struct_pack(t := t, h := host)) AS b, count(*) AS host_count FROM f GROUP BY part)
SELECT CAST(part AS VARCHAR) AS digest, a.h AS from_host, b.h AS to_host, strftime(a.t, '%Y-%m-%d') AS first_utc, strftime(b.t, '%Y-%m-%d') AS last_utc, host_count FROM e WHERE host_count >= 2 AND a.t < b.t
""")
def file_transfer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _bought(spark, sf_dir).select("host", F.col("part").cast("string").alias("digest"), F.lit("/opt/part").alias("path"), F.col("ts").alias("crtime"), F.col("ts").alias("mtime"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return correlate.transfers(files).select("digest", "from_host", "to_host", day("first_utc"), day("last_utc"), "host_count")


_STAMPS = """s AS (
  SELECT l_orderkey, l_linenumber, epoch(l_shipdate) // 1 AS m, epoch(o_orderdate) // 1 AS c,
    CASE WHEN l_linenumber % 2 = 0 THEN epoch(l_shipdate) // 1 ELSE epoch(o_orderdate) // 1 + 30 END AS a,
    CASE WHEN l_linenumber % 3 = 0 THEN epoch(o_orderdate) // 1 + 86400 END AS b, l_returnflag = 'A' AS suspicious
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


@query(f"""
WITH {_STAMPS}, r AS (SELECT l_orderkey, l_linenumber, unnest(list_filter([
    CASE WHEN c < m - 2 THEN 'mtime_ahead' END,
    CASE WHEN a = m AND a <> c AND a % 60 = 0 AND c % 60 <> 0 THEN 'minute_aligned' END,
    CASE WHEN m IS NULL OR c IS NULL THEN 'stamp_missing' END,
    CASE WHEN c < b - 2 THEN 'pre_creation' END,
    CASE WHEN b >= 852076800 AND m < b - 15552000 AND suspicious THEN 'new_file_old_mtime' END], lambda x: x IS NOT NULL)) AS rule FROM s)
SELECT rule, count(*) AS n, min(l_orderkey) AS first_order FROM r GROUP BY rule
""")
def timestomp_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    s = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", seconds("l_shipdate").alias("m"), seconds("o_orderdate").alias("c"), (F.col("l_returnflag") == "A").alias("suspicious"))
    a = F.when(F.col("l_linenumber") % 2 == 0, F.col("m")).otherwise(F.col("c") + 30)
    b = F.when(F.col("l_linenumber") % 3 == 0, F.col("c") + 86_400)
    rules = findings.stamp_rules(a, F.col("m"), F.col("c"), b, F.lit(852_076_800), F.col("suspicious"))
    return s.select("l_orderkey", F.explode(rules).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


@query("SELECT p_partkey, p_name FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_returnflag = 'R' AND l.l_quantity > 40)")
def anti_join_unparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no large return claims."""
    claims = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return entities.unclaimed(table(spark, sf_dir, "part").select("p_partkey", "p_name"), claims, "p_partkey")


@query("""
SELECT * FROM (SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') AND lower(o_orderpriority) LIKE '%urgent%'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)
""")
def typed_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    kept = grid.matching(o, columns={"o_orderpriority": "URGENT"}, ticked={"o_orderstatus": ["F", "P"]})
    return grid.typed_sort(kept, "o_totalprice", descending=True, ties=["o_orderkey"]).limit(100).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT coalesce(o_orderpriority, '') AS value, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.facet(table(spark, sf_dir, "orders"), "o_orderpriority", ticked={"o_orderpriority": ["1-URGENT"], "o_orderstatus": ["F"]})


@query("SELECT p_type AS value, count(*) AS n, (SELECT count(DISTINCT p_type) FROM part) AS \"distinct\" FROM part GROUP BY p_type")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.histogram(table(spark, sf_dir, "part"), "p_type")


@query("""
WITH legs AS (SELECT 'n' || c_nationkey AS f, 'n' || s_nationkey AS t, o_orderdate AS ts, o_orderstatus = 'F' AS ok FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey),
outs AS (SELECT f, t, ts, bool_and(ok) AS ok FROM legs GROUP BY f, t, ts),
chained AS (SELECT a.f AS a, a.t AS mid, o.t AS c, a.ts AS ts, a.ok AS ok, min(struct_pack(t := o.ts, ok := o.ok)) AS nxt
  FROM (SELECT row_number() OVER () AS id, * FROM legs) a JOIN outs o ON o.f = a.t AND o.t <> a.f AND o.ts >= a.ts AND o.ts <= a.ts + INTERVAL 86400 SECOND GROUP BY a.id, a.f, a.t, o.t, a.ts, a.ok)
SELECT a || ' -> ' || mid || ' -> ' || c AS path, count(*) AS chains, strftime(min(ts), '%Y-%m-%d') AS first_utc, strftime(max(nxt.t), '%Y-%m-%d') AS last_utc, bool_or(ok AND nxt.ok) AS reached, CAST(min(epoch(nxt.t) - epoch(ts)) AS BIGINT) AS tightest
FROM chained GROUP BY 1
""")
def two_hop_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    host = lambda n: F.concat(F.lit("n"), F.col(n).cast("string"))
    legs = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    legs = legs.select(host("c_nationkey").alias("from_host"), host("s_nationkey").alias("to_host"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("").alias("user"), (F.col("o_orderstatus") == "F").alias("ok"))
    day = lambda x: F.date_format(x, "yyyy-MM-dd").alias(x)
    return correlate.routes(legs).select("path", "chains", day("first_utc"), day("last_utc"), "reached", "tightest")


@query("""
WITH t AS (SELECT 'n' || n_nationkey AS host, CASE WHEN n_nationkey % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity, (n_nationkey * 7) || ' files in region ' || n_regionkey AS title, n_nationkey + 1 AS n FROM nation)
SELECT 'Filesystem' AS category, regexp_replace(title, '\\d[\\d,]*', '#', 'g') AS finding, count(DISTINCT host) AS host_count, string_agg(DISTINCT host, ', ' ORDER BY host) AS hosts,
  CASE WHEN bool_or(severity = 'HIGH') THEN 'HIGH' ELSE 'LOW' END AS severity, CAST(sum(n) AS BIGINT) AS total_occurrences
FROM t GROUP BY 2 HAVING count(DISTINCT host) >= 2
""")
def shared_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    rows = n.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("host"),
        F.when(F.col("n_nationkey") % 3 == 0, "HIGH").otherwise("LOW").alias("severity"),
        F.lit("Filesystem").alias("category"),
        F.concat((F.col("n_nationkey") * 7).cast("string"), F.lit(" files in region "), F.col("n_regionkey").cast("string")).alias("title"),
        (F.col("n_nationkey") + 1).alias("count"),
    )
    return correlate.shared_findings(rows)


@query("""
WITH r AS (SELECT 'n' || s_nationkey AS host, l_shipdate AS ts, l_returnflag AS method, l_linenumber AS resource, 200 + (l_orderkey % 5) * 50 AS status FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
one AS (SELECT host, method, resource, count(*) AS n, count(*) FILTER (WHERE status BETWEEN 200 AND 399) AS answered, min(ts) AS a, max(ts) AS b FROM r GROUP BY ALL)
SELECT method, resource, count(DISTINCT host) AS host_count, string_agg(host, ', ' ORDER BY host) AS hosts, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(answered) AS BIGINT) AS answered, strftime(min(a), '%Y-%m-%d') AS first_utc, strftime(max(b), '%Y-%m-%d') AS last_utc
FROM one GROUP BY method, resource HAVING count(DISTINCT host) >= 2
""")
def shared_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("resource"), F.col("l_shipdate").alias("ts"))
    r = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("host"), "method", "resource", "ts", (200 + F.col("l_orderkey") % 5 * 50).alias("status"))
    day = lambda x: F.date_format(x, "yyyy-MM-dd").alias(x)
    return correlate.web_clients(r, ["method", "resource"]).select("method", "resource", "host_count", "hosts", "requests", "answered", day("first_utc"), day("last_utc"))
