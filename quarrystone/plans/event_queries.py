"""Queries on the events table: thresholds, sessions, as-of lookups, calendars, carried state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities, findings, grid, sessions
from .catalog import query, table

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _k(props: str = "props") -> F.Column:
    return F.get_json_object(props, "$.k").cast("long")


@query("""
WITH per AS (
  SELECT user_id AS source, count(*) FILTER (WHERE event_type = 'error') AS failures,
    count(DISTINCT CASE WHEN event_type = 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END) AS accounts,
    count(*) FILTER (WHERE event_type = 'purchase') AS successes
  FROM events GROUP BY user_id
)
SELECT source, failures, accounts, successes,
  CASE WHEN failures > 0 AND successes > 0 THEN 'CRITICAL' WHEN accounts >= 5 OR failures >= 50 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM per WHERE failures >= 10 OR accounts >= 5
""")
def failed_source_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("user_id", "event_type", _k().alias("account"))
    return findings.failed_sources(e, "user_id", "account", F.col("event_type") == "error", F.col("event_type") == "purchase")


@query("""
SELECT user_id, count(*) AS failures FROM events e
WHERE event_type = 'error' AND EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase')
GROUP BY user_id
""")
def fail_then_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    good = e.where("event_type = 'purchase'").select("user_id")
    return e.where("event_type = 'error'").join(good, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("failures"))


@query("""
WITH steps AS (
  SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN 1 ELSE -1 END AS d FROM events WHERE event_type IN ('signup', 'purchase')
), run AS (
  SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM steps
), low AS (
  SELECT *, least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS m FROM run
), kept AS (
  SELECT * FROM (SELECT *, coalesce(lag(m) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS before FROM low) WHERE d = 1 OR s >= before
), leveled AS (
  SELECT *, s - m + CASE WHEN d = -1 THEN 1 ELSE 0 END AS level FROM kept
), nxt AS (
  SELECT *, lead(d) OVER w AS nd, lead(event_id) OVER w AS ne, lead(ts) OVER w AS nt FROM leveled WINDOW w AS (PARTITION BY user_id, level ORDER BY ts, event_id)
)
SELECT user_id, event_id AS opened_id, CASE WHEN nd = -1 THEN ne END AS closed_id,
  CASE WHEN nd = -1 THEN epoch_us(nt) - epoch_us(ts) END AS micros,
  CASE WHEN nd = -1 THEN 'closed' ELSE 'still open at the end of this log' END AS state
FROM nxt WHERE d = 1
""")
def open_close_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    paired = sessions.pair_sessions(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase", sessions.time_step("ts"))
    micros = F.unix_micros("closed.ts") - F.unix_micros("opened.ts")
    return paired.select("opened.user_id", F.col("opened.event_id").alias("opened_id"), F.col("closed.event_id").alias("closed_id"), micros.alias("micros"), "state")


@query("""
SELECT e.event_id, e.user_id, CASE WHEN min(p.ts) IS NOT NULL THEN true END AS within, strftime(min(p.ts), '%Y-%m-%d %H:%M:%S.%f') AS next_purchase
FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts >= e.ts AND p.ts <= e.ts + INTERVAL 24 HOUR
WHERE e.event_type = 'error' GROUP BY e.event_id, e.user_id, e.ts
""")
def asof_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    met = sessions.forward_asof(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), ["user_id"], "ts", "event_id", 86_400)
    return met.select("event_id", "user_id", F.when(F.col("asof_ts").isNotNull(), True).alias("within"), F.date_format("asof_ts", STAMP).alias("next_purchase"))


@query("""
SELECT p.event_id, p.user_id, max(c.event_id) AS click_id
FROM events p LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
  ON c.user_id = p.user_id AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 300 SECOND
    AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'click' AND x.user_id = p.user_id AND x.ts <= p.ts AND x.ts > c.ts)
WHERE p.event_type = 'purchase' GROUP BY p.event_id, p.user_id
""")
def backward_asof_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    met = sessions.backward_asof(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), ["user_id"], "ts", "event_id", 300)
    return met.select("event_id", "user_id", F.col("asof_event_id").alias("click_id"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def activity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def hour_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


SEVERITY_OF = {"error": "CRITICAL", "signup": "MEDIUM", "purchase": "LOW"}


def _severity() -> F.Column:
    out = F.lit("INFO")
    for kind, severity in SEVERITY_OF.items():
        out = F.when(F.col("event_type") == kind, severity).otherwise(out)
    return out


_SEVERITY_SQL = "CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"


@query(f"""
SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n,
  ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'][min({_SEVERITY_SQL}) + 1] AS worst
FROM events GROUP BY 1, 2
""")
def weekday_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("severity", _severity())
    return e.groupBy(F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), entities.worst(F.col("severity")).alias("worst"))


@query(f"SELECT user_id, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'][min({_SEVERITY_SQL}) + 1] AS worst, count(*) AS n FROM events GROUP BY user_id")
def severity_rank_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("severity", _severity())
    return e.groupBy("user_id").agg(entities.worst(F.col("severity")).alias("worst"), F.count("*").alias("n"))


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header
FROM events
""")
def forward_fill_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marker = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return sessions.carry_forward(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], marker, "header").select("event_id", "user_id", "header")


@query("""
WITH b AS (SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM events)
SELECT user_id, block, count(*) AS n, min(event_id) AS first_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS kinds FROM b GROUP BY user_id, block
""")
def header_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sessions.block_ids(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    kinds = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]), ",")
    return b.groupBy("user_id", "block").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), kinds.alias("kinds"))


@query("""
WITH m AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN md5(text) END AS marker, lag(CASE WHEN role = 'user' THEN md5(text) END) OVER (PARTITION BY conv_id ORDER BY turn) AS carried FROM conversations)
SELECT conv_id, turn, role, carried FROM m WHERE marker IS NULL
""")
def marker_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    marker = F.when(F.col("role") == "user", F.md5(F.col("text").cast("binary")))
    return sessions.carry_to_next(c, ["conv_id"], ["turn"], marker, "carried").select("conv_id", "turn", "role", "carried")


@query("""
WITH span AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS last FROM span
WHERE a <= TIMESTAMP '2024-01-09 23:59:59' AND b >= TIMESTAMP '2024-01-05 00:00:00'
""")
def time_window_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = datetime(2024, 1, 30)
    low, high = grid.parse_when("2024-01-05", newest), grid.parse_when("2024-01-09", newest, end=True)
    span = _events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return span.where(grid.overlaps(F.col("a"), F.col("b"), F.lit(low), F.lit(high))).select("user_id", F.date_format("a", STAMP).alias("first"), F.date_format("b", STAMP).alias("last"))


@query("""
WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rank, count(*) OVER (PARTITION BY event_type) AS total FROM events)
SELECT * FROM r WHERE rank <= 12
""")
def sample_cap_with_exact_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_type", "event_id", "ts")
    return entities.capped(e, ["event_type"], ["ts", "event_id"], 12).select("event_type", "event_id", "rank", "total")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS BIGINT) AS bucket FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", _k().alias("k"), (_k() % 7).alias("bucket"))


@query("SELECT event_id, trim(regexp_extract(props, '\"k\": *([0-9]+)', 1)) AS value FROM events")
def kv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.str_to_map(F.regexp_replace("props", '[{}"]', ""), F.lit(","), F.lit(":"))
    return _events(spark, sf_dir).select("event_id", F.btrim(F.element_at(pairs, "k")).alias("value"))


@query("""
SELECT event_id, concat_ws(',', CASE WHEN event_id & 1 <> 0 THEN 'P' END, CASE WHEN event_id & 4 <> 0 THEN 'S' END, CASE WHEN event_id & 512 <> 0 THEN 'W' END, CASE WHEN event_id & 4096 <> 0 THEN 'O' END) AS flags FROM events
""")
def bitmask_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.indicators import bits_set

    return _events(spark, sf_dir).select("event_id", F.array_join(bits_set(F.col("event_id"), {0: "P", 2: "S", 9: "W", 12: "O"}), ",").alias("flags"))


@query("SELECT event_id, concat_ws('.', event_id % 256, (event_id // 256) % 256, (event_id // 65536) % 256, (event_id // 16777216) % 256) AS address FROM events")
def hex_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.net import hex_ipv4

    return _events(spark, sf_dir).select("event_id", hex_ipv4(F.lpad(F.hex("event_id"), 8, "0")).alias("address"))


@query("""
WITH o AS (SELECT CAST(user_id AS VARCHAR) AS value, event_type AS why, 'k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS source, ts FROM events)
SELECT value, string_agg(DISTINCT why, '; ' ORDER BY why) AS why, string_agg(DISTINCT source, '; ' ORDER BY source) AS sources, count(*) AS count,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last
FROM o GROUP BY value
""")
def indicator_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("value"), F.col("event_type").alias("why"), F.concat(F.lit("k"), (_k() % 3).cast("string")).alias("source"), "ts")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return entities.indicator_rollup(seen).select("value", "why", "sources", "count", shown("first"), shown("last"))


@query("""
WITH facts AS (
  SELECT user_id, 0 AS p, 'signup' AS s, max(CASE WHEN event_type = 'signup' THEN CAST(event_id AS VARCHAR) END) AS a, CAST(NULL AS VARCHAR) AS b FROM events WHERE event_type = 'signup' GROUP BY user_id
  UNION ALL SELECT user_id, 1, 'click', max(CAST(event_id AS VARCHAR)), min(CAST(event_id AS VARCHAR)) FROM events WHERE event_type = 'click' GROUP BY user_id
  UNION ALL SELECT user_id, 2, 'view', NULL, max(CAST(event_id AS VARCHAR)) FROM events WHERE event_type = 'view' GROUP BY user_id
)
SELECT user_id, arg_min(a, p) FILTER (WHERE a <> '') AS a, arg_min(b, p) FILTER (WHERE b <> '') AS b, string_agg(s, ', ' ORDER BY s) AS sources FROM facts GROUP BY user_id
""")
def first_writer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("user_id", "event_type", F.col("event_id").cast("string").alias("id"))
    of = lambda kind, *aggs: e.where(F.col("event_type") == kind).groupBy("user_id").agg(*aggs)
    tables = [of("signup", F.max("id").alias("a")), of("click", F.max("id").alias("a"), F.min("id").alias("b")), of("view", F.max("id").alias("b"))]
    return entities.first_writer(tables, "user_id", ["signup", "click", "view"]).select("user_id", "a", "b", "sources")


@query("""
WITH t AS (SELECT n AS node, CASE WHEN n = 0 THEN -1 ELSE n // 2 END AS parent FROM (SELECT CAST(user_id AS BIGINT) AS n FROM events GROUP BY user_id)),
r AS (SELECT node, parent FROM t WHERE parent NOT IN (SELECT node FROM t)),
w AS (WITH RECURSIVE w(node, parent, depth, path) AS (
  SELECT node, parent, 0, CAST(node AS VARCHAR) FROM r
  UNION ALL SELECT t.node, t.parent, w.depth + 1, w.path || '/' || CAST(t.node AS VARCHAR) FROM t JOIN w ON t.parent = w.node WHERE t.node <> t.parent
) SELECT * FROM w)
SELECT w.node, w.parent, CAST(w.depth AS INTEGER) AS depth, w.path, coalesce(c.children, 0) AS children
FROM w LEFT JOIN (SELECT parent, count(*) AS children FROM t GROUP BY parent) c ON c.parent = w.node
""")
def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _events(spark, sf_dir).select(F.col("user_id").alias("n")).distinct().select("n", F.when(F.col("n") == 0, -1).otherwise(F.floor(F.col("n") / 2)).cast("long").alias("p"))
    return entities.tree(nodes, "n", "p").select("node", "parent", "depth", F.array_join("path", "/").alias("path"), "children")


@query("""
SELECT event_id, CASE WHEN event_id >= 172800 THEN (event_id // 86400) || ' days' WHEN event_id < 60 THEN CASE WHEN event_id <= 0 THEN '' ELSE event_id || 's' END WHEN event_id < 120 THEN event_id || 's' WHEN event_id < 3600 THEN (event_id // 60) || 'm'
    ELSE (event_id // 3600) || 'h' || CASE WHEN (event_id % 3600) // 60 > 0 THEN ((event_id % 3600) // 60) || 'm' ELSE '' END END AS gap
FROM events
""")
def gap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.times import gap

    return _events(spark, sf_dir).select("event_id", gap(F.col("event_id")).alias("gap"))


@query("""
SELECT strftime(time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2
""")
def failure_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _events(spark, sf_dir).where("event_type = 'error'").groupBy(F.window("ts", "10 minutes").alias("w"), "user_id").agg(F.count("*").alias("failures"))
    return w.where("failures >= 2").select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "failures")
