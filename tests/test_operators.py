import gzip
import random
import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrystone.extract import logs
from quarrystone.operators import correlate, entities, findings, grid, sessions, sigma, sweeps
from quarrystone.plans.ask import Case, CaseError, checked
from quarrystone.sources import files, sinks

T0 = datetime(2026, 3, 24)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_pairing_equals_a_stack(spark):
    rng = random.Random(7)
    rows = [(k, n, rng.choice("oc")) for k in range(20) for n in range(40)]
    want = set()
    for k in range(20):
        stack = []
        for _, n, step in (r for r in rows if r[0] == k):
            if step == "o":
                stack.append(n)
            elif stack:
                want.add((k, stack.pop(), n))
        want |= {(k, n, None) for n in stack}
    df = spark.createDataFrame(rows, "k int, n int, step string").repartition(7)
    out = sessions.pair_sessions(df, ["k"], ["n"], F.col("step") == "o", F.col("step") == "c")
    assert {(r["opened"]["k"], r["opened"]["n"], r["closed"]["n"] if r["closed"] else None) for r in out.collect()} == want


def test_asof_both_ways(spark):
    left = spark.createDataFrame([("a", 1, at(100)), ("a", 2, at(500)), ("b", 3, at(0))], "k string, id int, ts timestamp")
    right = spark.createDataFrame([("a", at(100), 10), ("a", at(90), 9), ("a", at(450), 45), ("a", at(499), None), ("b", at(301), 30)], "k string, ts timestamp, v int")
    back = {r["id"]: r["asof_v"] for r in sessions.backward_asof(left, right, ["k"], "ts", "v", 300).collect()}
    ahead = {r["id"]: r["asof_v"] for r in sessions.forward_asof(left, right, ["k"], "ts", "v", 300).collect()}
    assert back == {1: 10, 2: 45, 3: None} and ahead == {1: 10, 2: None, 3: None}


def test_terminal_sessions(spark):
    rows = [("w", "pts/0", 1, "LOGIN", "ann", "h", at(1)), ("w", "pts/0", 2, "LOGIN", "bob", "h", at(2)), ("w", "pts/0", 3, "DEAD", "", "", at(3)), ("w", "pts/1", 4, "LOGIN", "eve", "h", at(4)), ("w", "~", 5, "BOOT", "reboot", "", at(5)), ("w", "pts/1", 6, "LOGIN", "zed", "h", at(6))]
    out = sessions.terminal_sessions(spark.createDataFrame(rows, "file string, line string, ord int, type string, user string, host string, ts timestamp"))
    assert {r["user"]: r["state"] for r in out.collect()} == {"ann": "no logout record", "bob": "closed", "eve": "ended at reboot", "zed": "still open at the end of this wtmp"}


def test_login_records_decode(spark, tmp_path):
    rec = lambda t, line, user, sec: struct.pack("<hxxi32s4s32s256shhiii4i20x", t, 77, line, b"", user, b"host", 0, 0, 0, sec, 0, 0x0100007F, 0, 0, 0)
    (tmp_path / "wtmp").write_bytes(rec(7, b"pts/0", b"ann", 1774367248) + rec(1, b"~", b"shutdown", 1774367300) + b"torn")
    rows = files.login_records(files.contents(spark, str(tmp_path))).orderBy("ord").collect()
    assert [(r["type"], r["user"], r["line"], r["address"]) for r in rows] == [("LOGIN", "ann", "pts/0", "127.0.0.1"), ("SHUTDOWN", "shutdown", "~", "127.0.0.1")]


def test_lines_and_json_and_exports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("one\r\ntwo\n\nlast")
    assert [(r["line_no"], r["line"]) for r in files.lines(spark, f"{tmp_path}/in").orderBy("line_no").collect()] == [(1, "one"), (2, "two"), (3, ""), (4, "last")]
    (tmp_path / "j.json").write_text('{"Pid": 1, "Name": "x"}\nnot json\n{"Pid": 2}\n')
    rows, bad = files.json_rows(spark, f"{tmp_path}/j.json")
    assert bad.count() == 1
    assert sorted(tuple(r) for r in files.aliased(rows, {"pid": ["pid"], "process": ["exe", "name"]}).collect() if r["pid"]) == [("1", "x"), ("2", None)]
    df = spark.createDataFrame([(at(1), "a", None, True), (None, "", "b", False)], "timestamp_utc timestamp, x string, y string, flag boolean")
    sinks.write_ndjson(df, f"{tmp_path}/o.ndjson", "T", host="h")
    out = spark.read.json(f"{tmp_path}/o.ndjson").orderBy("_time").collect()
    assert out[1]["_time"] == int((at(1) - datetime(1970, 1, 1)).total_seconds()) and out[1]["triage_table"] == "T" and out[0]["y"] == "b"
    sinks.write_any(df, f"{tmp_path}/o.csv")
    assert spark.read.csv(f"{tmp_path}/o.csv", header=True).where("flag = 'yes'").first()["x"] == "a"
    assert sinks.inside("/case/in/out", "/case/in") and not sinks.inside("/case/input", "/case/in")
    assert [bool(__import__("re").match(files.glob_regex(p), s)) for p, s in (("/var/log/*.log", "/var/log/A.LOG"), ("/var/log/*.log", "/var/log/x/a.log"), ("/var/**/a.log", "/var/log/x/a.log"))] == [True, False, True]


def test_first_writer_any_order(spark):
    a = spark.createDataFrame([(1, "x", ""), (2, None, "q")], "pid int, exe string, user string")
    b = spark.createDataFrame([(1, "y", "root"), (3, "z", None)], "pid int, exe string, user string")
    got = {r["pid"]: (r["exe"], r["user"], r["sources"]) for r in entities.first_writer([a.repartition(3), b.repartition(2)], "pid", ["ps", "lsof"]).collect()}
    assert got == {1: ("x", "root", "lsof, ps"), 2: (None, "q", "ps"), 3: ("z", None, "lsof")}


def test_tree_with_orphans_and_a_loop(spark):
    nodes = spark.createDataFrame([(1, 0), (2, 1), (10, 1), (3, 2), (7, 99), (8, 9), (9, 8)], "n int, p int")
    rows = entities.tree(nodes, "n", "p").collect()
    assert [r["node"] for r in sorted((r for r in rows if r["depth"] is not None), key=lambda r: r["path"])] == [1, 2, 3, 10, 7]
    assert {r["node"] for r in rows if r["depth"] is None} == {8, 9} and {r["node"]: r["children"] for r in rows}[1] == 2


def test_tree_of_long_chains_and_of_loops_with_tails(spark):
    chain = [(i, i - 1 if i else None) for i in range(70)]
    loop = [(100, 102), (101, 100), (102, 101), (103, 102), (104, 103), (105, 105), (106, 105)]
    got = {r["node"]: r for r in entities.tree(spark.createDataFrame(chain + loop + [(200, 999)], "n long, p long"), "n", "p").collect()}
    assert all(got[i]["depth"] == i and got[i]["path"] == list(range(i + 1)) for i in range(70))
    assert all(got[i]["depth"] is None and got[i]["path"] == [i] for i, _ in loop) and got[200]["depth"] == 0
    assert entities.tree(spark.createDataFrame([], "n long, p long"), "n", "p").collect() == []


def test_routes_over_the_edges_of_steps(spark):
    import random

    from quarrystone.operators import correlate

    rng, day = random.Random(3), correlate.HOP_GAP
    legs = [(rng.choice("ABCD"), rng.choice("ABCD"), rng.randrange(4 * day) // 900 * 900, rng.choice(["u", None]), rng.random() < 0.5) for _ in range(150)]
    legs += [("A", "B", day - 1, "u", True), ("B", "C", 2 * day - 1, "u", True), ("B", "D", 2 * day, "u", True)] + legs[:20]
    want = {}
    for a, mid, t, _, ok in legs:
        for c in {x[1] for x in legs if x[0] == mid and x[1] != a}:
            later = sorted(((x[2], x[3] is not None, x[3] or "", x[4]) for x in legs if (x[0], x[1]) == (mid, c) and x[2] >= t))
            if later and later[0][0] - t <= day:
                n, reached, gap = want.get(f"{a} -> {mid} -> {c}", (0, False, 1 << 40))
                want[f"{a} -> {mid} -> {c}"] = (n + 1, reached or (ok and later[0][3]), min(gap, later[0][0] - t))
    df = spark.createDataFrame(legs, "from_host string, to_host string, s long, user string, ok boolean").selectExpr("from_host", "to_host", "timestamp_seconds(s) AS ts", "user", "ok")
    got = {r["path"]: (r["chains"], r["reached"], r["tightest"]) for r in correlate.routes(df).collect()}
    assert got == want


def test_routes_read_their_legs_once(spark):
    from quarrystone.operators import correlate

    legs = spark.range(3000).selectExpr(
        "CASE id % 4 WHEN 0 THEN 'A' WHEN 3 THEN NULL ELSE 'B' END AS from_host", "if(id % 4 = 0, 'B', 'C') AS to_host",
        "timestamp_seconds(if(id % 4 = 0, 100, if(id % 8 = 2, NULL, 160))) AS ts", "concat('u', id % 30) AS user", "id % 3 = 0 AS ok",
    )
    df = correlate.routes(legs)
    (r,) = df.collect()
    assert (r["path"], r["chains"], r["reached"], r["tightest"]) == ("A -> B -> C", 750, True, 60)  # of equal times the least user leads, u0, whose legs are all ok
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Range (") <= 1


def test_indicators_are_counted_once_each(spark):
    rows = [("1.2.3.4", "ssh", "a", at(3600 * 9)), ("1.2.3.4", "web", "b", at(3600 * 11)), ("1.2.3.4", "ssh", "c", None), ("1.2.3.4", "bad", "a", at(3600 * 10)), (" ", "x", "y", None), ("z", "w", "v", None)]
    got = {r["value"]: r for r in entities.indicator_rollup(spark.createDataFrame(rows, "value string, why string, source string, ts timestamp")).collect()}
    assert set(got) == {"1.2.3.4", "z"} and got["z"]["count"] == 1 and got["z"]["first"] is None
    assert (got["1.2.3.4"]["count"], got["1.2.3.4"]["why"], got["1.2.3.4"]["first"].hour, got["1.2.3.4"]["last"].hour) == (4, "bad; ssh; web", 9, 11)


def test_failures_then_success_from_raw_lines(spark):
    text = [("auth", i, f"2026-03-24T10:00:{i:02d}Z h sshd[1]: Failed password for u{i % 6} from 1.1.1.1 port 22 ssh2") for i in range(12)]
    text += [("auth", 20, "2026-03-24T11:00:00Z h sshd[1]: Accepted password for u1 from 1.1.1.1 port 22 ssh2"), ("auth", 21, "2026-03-24T11:00:00Z h sshd[1]: Failed password for u1 from 2.2.2.2 port 22 ssh2")]
    auth = logs.auth_log(spark.createDataFrame(text, "path string, line_no long, line string"))
    hot = findings.failed_sources(auth, "source_ip", "user", F.col("event") == "failed password", F.col("event") == "accepted login").collect()
    assert [(r["source"], r["failures"], r["accounts"], r["severity"]) for r in hot] == [("1.1.1.1", 12, 6, "CRITICAL")]


RULE = {"title": "t", "level": "high", "tags": ["attack.t1059.004", "attack.execution"], "detection": {}}


@pytest.mark.parametrize(
    ("detection", "want"),
    [
        ({"a": {"cmd|contains": "CURL"}, "condition": "a"}, {1, 2}),
        ({"a": {"cmd|contains|all": ["curl", "bash"]}, "condition": "a"}, {1}),
        ({"a": {"cmd|startswith": "ls"}, "b": {"user": "root"}, "condition": "a and not b"}, {3, 4}),
        ({"a": {"cmd": "*http?://*"}, "condition": "a"}, {2}),
        ({"a": {"user": None}, "condition": "a"}, {4}),
        ({"k": ["bash"], "condition": "k"}, {1}),
        ({"a1": {"user": "ann"}, "a2": {"cmd|re": "^l.\\s"}, "condition": "2 of a*"}, {3}),
        ({"a": {"ip|cidr": "10.0.0.0/8"}, "condition": "a"}, {2}),
        ({"a": {"Image|endswith": "-LA"}, "condition": "all of them"}, {3, 4}),
        ({"a": [{"user": "root"}, {"cmd|contains": "ls"}], "condition": "(a)"}, {1, 2, 3, 4}),
    ],
)
def test_sigma_rules(spark, detection, want):
    rows = [(1, "curl x | bash", "root", ""), (2, "CURL https://h", "root", "10.1.1.1"), (3, "ls -la", "ann", "11.0.0.1"), (4, "ls -la", "", None)]
    df = spark.createDataFrame(rows, "id int, cmd string, user string, ip string")
    hits, errors = sigma.matches(df, [RULE | {"detection": detection}], ["id"], {"Image": ["cmd"]})
    assert errors == [] and {r["id"] for r in hits.collect()} == want


def test_sigma_refuses_what_it_cannot_do():
    for bad in ({"a": {"x|gt": 3}, "condition": "a"}, {"a": {"x": 1}, "condition": "a | count() > 3"}, {"a": {"x": 1}, "condition": "b"}, {"a": {"x": 1}, "condition": "(a"}, {"a": {"x": 1}}):
        with pytest.raises(sigma.RuleError):
            sigma.compile_rule({"detection": bad}, ["x"])
    assert sigma.technique_tags(RULE) == ["T1059.004"]


def test_sweeps(spark):
    df = spark.createDataFrame([(1, "run nmap -sS and NMAP, hydra"), (2, "nmapper"), (3, "see 1.2.3.4: and 11.2.3.45")], "id int, t string")
    assert {(r["id"], r["word"]) for r in sweeps.keyword_hits(df, "t", {"nmap": "scan", "hydra": "brute"}).collect()} == {(1, "nmap"), (1, "hydra")}
    hits, totals = sweeps.indicator_sweep(df.withColumn("art", F.lit("a")), "t", ["1.2.3.4", "absent"], "art", ["id"])
    assert [r["id"] for r in hits.collect()] == [3] and {r["term"]: r["count"] for r in totals.collect()} == {"1.2.3.4": 1, "absent": 0}
    cmds = spark.createDataFrame([("sudo john -w rockyou shadow",), ("/home/john/john x",), ("ssh john@db01",), ("cat john.txt",)], "c string")
    assert [r[0] for r in cmds.select(sweeps.executable_position(F.col("c"), F.lit("john"))).collect()] == [True, True, False, False]


def test_grid(spark):
    df = spark.createDataFrame([(1, "10", "a"), (2, "9", "b"), (3, "x", "a"), (4, "", "b"), (5, None, "c")], "id int, v string, k string")
    assert [r["id"] for r in grid.typed_sort(df, "v", ties=["id"]).collect()] == [2, 1, 3, 4, 5]
    assert [r["id"] for r in grid.typed_sort(df, "v", descending=True, ties=["id"]).collect()] == [3, 1, 2, 4, 5]
    assert {r["id"] for r in grid.matching(df, box="10|X", ticked={"k": ["a"]}).collect()} == {1, 3}
    assert [tuple(r) for r in grid.facet(df, "k", ticked={"k": ["a"]}).collect()] == [("a", 2), ("b", 2), ("c", 1)]
    assert [r["id"] for r in grid.page(df, ["id"], 1, 2).collect()] == [2, 3]
    new = datetime(2026, 1, 10)
    assert grid.parse_when("2026-01-05", new, end=True) == datetime(2026, 1, 5, 23, 59, 59) and grid.parse_when("-3h", new) == new - timedelta(hours=3) and grid.parse_when("x", new) is None


def test_routes_and_shared_values(spark):
    legs = spark.createDataFrame([("web01", "db02", at(0), "u", True), ("db02", "app03", at(900), "u", True), ("db02", "app03", at(950), "u", False), ("db02", "web01", at(10), "u", True), ("app03", "web01", at(6 * 86400), "u", True)], "from_host string, to_host string, ts timestamp, user string, ok boolean")
    (r,) = [x for x in correlate.routes(legs).collect()]
    assert (r["path"], r["chains"], r["reached"], r["tightest"]) == ("web01 -> db02 -> app03", 1, True, 900)
    iocs = spark.createDataFrame([("web01", "203.0.113.9", "ssh", 40, at(0), at(10)), ("db02", "203.0.113.9", "ssh", 3, at(20), at(30)), ("app03", "203.0.113.9", "web", 4, at(3600), at(3600)), ("web01", "198.51.100.7", "x", 1, at(0), at(0))], "host string, value string, why string, count long, first timestamp, last timestamp")
    (r,) = correlate.shared_indicators(iocs).collect()
    assert (r["value"], r["host_count"], r["first_host"], r["last_host"], r["total_mentions"]) == ("203.0.113.9", 3, "web01", "app03", 47)
    f = spark.createDataFrame([("web01", "HIGH", "F", "3 executable file(s) in tmpfs", 3), ("db02", "CRITICAL", "F", "7 executable file(s) in tmpfs", 7), ("db02", "LOW", "F", "alone", 1)], "host string, severity string, category string, title string, count long")
    (r,) = correlate.shared_findings(f).collect()
    assert (r["finding"], r["severity"], r["total_occurrences"]) == ("# executable file(s) in tmpfs", "CRITICAL", 10)
    h = spark.createDataFrame([("web01", "A" * 64, "/usr/bin/x", None, None), ("db02", "a" * 64, "/usr/bin/x", None, None), ("web01", "b" * 64, "/tmp/e", at(0), at(5)), ("db02", "b" * 64, "/tmp/e", at(1200), at(1)), ("web01", "c" * 64, "/opt/p", None, at(1)), ("app03", "c" * 64, "/srv/q", at(9), at(9))], "host string, digest string, path string, crtime timestamp, mtime timestamp")
    got = {r["digest"][0]: (r["notable"], r["same_path"]) for r in correlate.shared_hashes(h).collect()}
    assert got == {"a": (False, True), "b": (True, True), "c": (True, False)}
    assert {r["digest"][0]: (r["from_host"], r["to_host"], r["basis"]) for r in correlate.transfers(h).collect()} == {"b": ("web01", "db02", "crtime"), "c": ("web01", "app03", "mtime")}


def test_case_queries(spark):
    case = Case(spark, {"FAILED_LOGINS": spark.createDataFrame([("ssh", "1.1.1.1", "ann"), ("ssh", "1.1.1.1", "bob")], "kind string, source_ip string, user string"), "WEB_LOG": spark.createDataFrame([], "client_ip string, status string")})
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "INSERT INTO x VALUES (1)", "", "SET a=b"):
        with pytest.raises(CaseError):
            checked(bad)
    assert checked("SELECT ';' AS x;") == "SELECT ';' AS x"
    a = case.query("SELECT user FROM FAILED_LOGINS ORDER BY user", limit=1)
    assert a.rows == [{"user": "ann"}] and "only the first 1 rows" in a.notes[0]
    assert "'1.1.1.1'" in case.query("SELECT * FROM FAILED_LOGINS WHERE source_ip = '9.9.9.9'").notes[0]
    assert case.query("SELECT * FROM WEB_LOG").notes == ["WEB_LOG is empty"]
    with pytest.raises(CaseError, match="kind, source_ip, user"):
        case.query("SELECT nope FROM FAILED_LOGINS")
    with pytest.raises(CaseError, match="stopped after"):
        case.query("SELECT count(*) FROM range(10000000000) a WHERE a.id % 7 <> a.id % 11", seconds=1)
    assert case.values("FAILED_LOGINS", "kind").rows == [{"value": "ssh", "n": "2"}] and len(case.row("FAILED_LOGINS", {"user": "bob"}).rows) == 1
    steps = dict(case.playbook("profile_address", address="1.1.1.1"))
    assert steps["Failures"].rows == [{"kind": "ssh", "n": "2"}] and "not collected" in steps["Sign-ins"]


def test_streams(spark, tmp_path):
    from quarrystone.streaming import windows

    rows = [("a", at(0), 1), ("a", at(10), 1), ("a", at(20), -1), ("b", at(30), -1), ("z", at(90_000), 1)]
    spark.createDataFrame(rows, "key string, ts timestamp, step int").coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("key string, ts timestamp, step int").parquet(f"{tmp_path}/in")
    for name, df in (("paired", windows.paired_sessions(src)), ("counts", windows.failure_counts(src, F.col("step") > 0, "key", least=2))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert [(r["key"], r["opened"], r["closed"]) for r in spark.table("paired").where("state = 'closed'").collect()] == [("a", at(10), at(20))]
    assert [(r["key"], r["failures"]) for r in spark.table("counts").collect()] == [("a", 2)]


def test_sessions_by_steps_are_those_of_whole_keys(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), n, rng.choice("ooccx")) for n in range(400)]
    df = spark.createDataFrame(rows, "k string, n int, step string").repartition(3)
    whole = sessions.pair_sessions(df, ["k"], ["n"], F.col("step") == "o", F.col("step") == "c").collect()
    for size in (1, 7, 1000):
        cut = sessions.pair_sessions(df, ["k"], ["n"], F.col("step") == "o", F.col("step") == "c", F.floor(F.col("n") / size)).collect()
        assert sorted(map(repr, cut)) == sorted(map(repr, whole)) and len(whole) > 100
    assert sessions.pair_sessions(df.limit(0), ["k"], ["n"], F.col("step") == "o", F.col("step") == "c", F.col("n")).count() == 0


def test_asof_over_the_edges_of_steps(spark):
    rng = random.Random(5)
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    left = [(i, rng.choice([None, "a"]), rng.choice([None, *range(0, 40_000, 600)])) for i in range(150)]
    right = [(rng.choice([None, "a"]), rng.randrange(0, 40_000, 600), rng.choice([None, 1, 2, 3])) for _ in range(60)]
    ldf = spark.createDataFrame([(i, k, None if s is None else at(s)) for i, k, s in left], "id int, k string, ts timestamp").repartition(3)
    rdf = spark.createDataFrame([(k, at(s), v) for k, s, v in right], "k string, ts timestamp, v int")
    for tolerance in (0, 600, 3600, 9000):
        back = {r["id"]: r["asof_v"] for r in sessions.backward_asof(ldf, rdf, ["k"], "ts", "v", tolerance).collect()}
        ahead = {r["id"]: r["asof_v"] for r in sessions.forward_asof(ldf, rdf, ["k"], "ts", "v", tolerance).collect()}
        for i, k, s in left:
            near = lambda low, high: [(t, v) for rk, t, v in right if rk == k and v is not None and s is not None and low <= t <= high]  # noqa: B023, E731
            assert back[i] == max(near(s - tolerance, s) if s is not None else [], default=(0, None))[1]
            assert ahead[i] == min(near(s, s + tolerance) if s is not None else [], default=(0, None))[1]


def test_boots_of_busy_hosts(spark):
    rng = random.Random(6)
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(200)])) for i in range(200)]
    boots = [(k, rng.randrange(200)) for k in ("a", None) for _ in range(8)]
    got = sessions.boot_segments(
        spark.createDataFrame([(i, k, None if h is None else at(h)) for i, k, h in rows], "id int, k string, ts timestamp").repartition(3), spark.createDataFrame([(k, at(h)) for k, h in boots], "k string, ts timestamp"), ["k"], "ts"
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [at(h) for k, h in boots if k == r["k"]]
        boot = max((b for b in own if r["ts"] is not None and b <= r["ts"]), default=None)
        assert (r["boot"], r["newest"]) == (boot, boot is not None and boot == max(own))


def test_lines_of_files_read_in_blocks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = [f"line {i} " + "x" * (i % 90) for i in range(5000)]
    (tmp_path / "in" / "long.log").write_bytes("\r\n".join(text[:2500]).encode() + b"\n" + "\n".join(text[2500:]).encode())
    (tmp_path / "in" / "empty.log").write_bytes(b"")
    (tmp_path / "in" / "short.log.gz").write_bytes(gzip.compress(b"a\n\nb\n"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        df = files.lines(spark, f"{tmp_path}/in")
        got = {}
        for r in df.collect():
            got.setdefault(r["path"].rsplit("/", 1)[-1], []).append((r["line_no"], r["line"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got["long.log"]) == list(enumerate(text, 1))
    assert sorted(got["short.log.gz"]) == [(1, "a"), (2, ""), (3, "b")] and set(got) == {"long.log", "short.log.gz"}
