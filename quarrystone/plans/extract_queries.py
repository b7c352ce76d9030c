"""Queries that run the extractors on lines written from the driver's tables: what was written must be read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import files, logs
from .catalog import query, table

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _lines(spark: SparkSession, sf_dir: str, path: str, line: Column, where: str = "true") -> DataFrame:
    """(path, line_no, line) with a line for each event."""
    e = table(spark, sf_dir, "events").where(where).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k"))
    return e.select(F.lit(path).alias("path"), F.col("event_id").alias("line_no"), line.alias("line"))


def _shown(c: str) -> Column:
    return F.date_format(F.min(c), "yyyy-MM-dd HH:mm:ss").alias("first")


@query(f"""
WITH a AS (
  SELECT 'u' || user_id AS "user", ts, CASE event_type WHEN 'error' THEN 'failed password' WHEN 'purchase' THEN 'accepted login' ELSE 'session opened' END AS event,
    CASE event_type WHEN 'signup' THEN 'session' ELSE 'auth' END AS event_class, CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END AS result,
    CASE event_type WHEN 'signup' THEN '' ELSE '10.0.' || {K} || '.7' END AS source_ip
  FROM events WHERE event_type IN ('error', 'purchase', 'signup')
)
SELECT event, event_class, result, source_ip, count(*) AS n, count(DISTINCT "user") AS users, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first FROM a GROUP BY event, event_class, result, source_ip
""")
def auth_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("event_type") == "error", F.format_string("Failed password for u%d from 10.0.%s.7 port 22 ssh2", "user_id", "k"))
    said = said.when(F.col("event_type") == "purchase", F.format_string("Accepted publickey for u%d from 10.0.%s.7 port 51 ssh2", "user_id", "k"))
    said = said.otherwise(F.format_string("pam_unix(sshd:session): session opened for user u%d(uid=0) by (uid=0)", "user_id"))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00 web01 sshd["), F.col("user_id").cast("string"), F.lit("]: "), said)
    auth = logs.auth_log(_lines(spark, sf_dir, "/var/log/auth.log", line, "event_type IN ('error', 'purchase', 'signup')"))
    source = F.coalesce("source_ip", F.lit("")).alias("source_ip")
    return auth.groupBy("event", "event_class", "result", source).agg(F.count("*").alias("n"), F.countDistinct("user").alias("users"), _shown("timestamp_utc"))


@query(f"""
SELECT '10.0.' || {K} || '.7' AS client_ip, CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status,
  count(*) AS requests, count(DISTINCT '/' || event_type || '/' || user_id) AS resources, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first
FROM events GROUP BY 1, 2, 3
""")
def web_log_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(F.col("event_type") == "purchase", "POST").otherwise("GET")
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    line = F.format_string('10.0.%s.7 - - [%s +0000] "%s /%s/%d HTTP/1.1" %s %d "-" "curl"', F.col("k"), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), method, F.col("event_type"), F.col("user_id"), status, F.col("event_id"))
    web = logs.web_log(_lines(spark, sf_dir, "/var/log/nginx/access.log", line))
    return web.groupBy("client_ip", "method", "status").agg(F.count("*").alias("requests"), F.countDistinct("resource").alias("resources"), _shown("timestamp_utc"))


@query("""
SELECT 'SYSCALL' AS type, event_type AS comm, '/bin/' || event_type AS exe, CAST(user_id % 10 AS VARCHAR) AS uid, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first
FROM events GROUP BY event_type, user_id % 10
""")
def audit_log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string('type=SYSCALL msg=audit(%d.123:%d): syscall=59 success=yes uid=%d comm="%s" exe=%s', F.unix_seconds("ts"), F.col("event_id"), F.col("user_id") % 10, F.col("event_type"), F.hex(F.concat(F.lit("/bin/"), F.col("event_type")).cast("binary")))
    audit = logs.audit_log(_lines(spark, sf_dir, "/var/log/audit/audit.log", line))
    return audit.groupBy("type", "comm", "exe", "uid").agg(F.count("*").alias("n"), _shown("timestamp_utc"))


@query("SELECT '/srv/' || doc_id AS path, md5(text) AS md5, CAST(NULL AS VARCHAR) AS sha1, CASE WHEN doc_id % 2 = 0 THEN sha256(text) END AS sha256 FROM documents")
def hash_list_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    listed = F.array_compact(F.array(F.md5("raw"), F.when(F.col("doc_id") % 2 == 0, F.upper(F.sha2("raw", 256)))))
    lines = d.select("doc_id", F.explode(listed).alias("digest")).select(F.format_string("%s  /srv/%d", "digest", "doc_id").alias("line"))
    return files.file_hashes(lines)


# What a daemon says for each kind of failed login, by number: the kind, and the message with the user and the address put in.
FAILURES = {
    0: ("bad password", "sshd", "Failed password for %1$s from %2$s port 40122 ssh2"),
    1: ("bad key", "sshd", "Failed publickey for invalid user %1$s from %2$s port 40122 ssh2: RSA SHA256:x"),
    2: ("unknown account", "sshd", "Invalid user %1$s from %2$s port 40122"),
    3: ("aborted before authenticating", "sshd", "Connection closed by authenticating user %1$s %2$s port 40122 [preauth]"),
    4: ("too many attempts", "sshd", "error: maximum authentication attempts exceeded for %1$s from %2$s port 40122 ssh2 [preauth]"),
    5: ("account not permitted", "sshd", "User %1$s from %2$s not allowed because not listed in AllowUsers"),
    6: ("su failure", "su", "FAILED SU (to %1$s) nobody on pts/3 %2$s"),
    7: ("sudo not permitted", "sudo", "   %1$s : user NOT in sudoers ; TTY=pts/1 ; PWD=/ ; USER=root ; COMMAND=/bin/%2$s"),
    8: ("", "sshd", "Accepted password for %1$s from %2$s port 40122 ssh2"),
    9: ("", "CRON", "pam_unix(cron:session): session opened for user %1$s(uid=0) by %2$s(uid=0)"),
}


@query(f"""
WITH k AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{kind}')" for i, (kind, _, _) in FAILURES.items())}) v(i, kind)),
e AS (SELECT kind, i, 'u' || (user_id % 97) AS "user", '10.1.' || {K} || '.' || (user_id % 200) AS ip, ts FROM events JOIN k ON event_id % 10 = i WHERE kind <> '')
SELECT kind, "user", CASE WHEN i IN (6, 7) THEN '' ELSE ip END AS source_ip, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first FROM e GROUP BY 1, 2, 3
""")
def failed_login_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("")
    ip = F.format_string("10.1.%s.%d", F.col("k"), F.col("user_id") % 200)
    for i, (_, program, message) in FAILURES.items():
        text = F.format_string(f"h1 {program}[77]: {message}", F.format_string("u%d", F.col("user_id") % 97), ip)
        said = F.when(F.col("event_id") % 10 == i, text).otherwise(said)
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00 "), said)
    found = logs.failed_logins(logs.auth_log(_lines(spark, sf_dir, "/var/log/secure", line)))
    return found.groupBy("kind", "user", "source_ip").agg(F.count("*").alias("n"), _shown("timestamp_utc"))
