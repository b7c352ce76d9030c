"""Votes, collectors' results, boots, and commands that name other hosts: against plain versions."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarrystone.extract import logs
from quarrystone.operators import correlate, sessions, votes
from quarrystone.sources import collector

START = datetime(2026, 3, 1)


def test_votes_ties_and_contradictions(spark):
    rows = [("a", 1, 5, "x"), ("a", 2, 2, "y"), ("b", 1, 3, "x"), ("b", 2, 3, "y"), ("c", 7, 1, "x"), ("d", 1, 4, "x"), ("d", 2, 2, "y"), ("d", 2, 1, "z"), ("e", None, 9, "x"), (None, 4, 1, "x")]
    got = {r["host"]: r for r in votes.decided(spark.createDataFrame(rows, "host string, value int, weight int, source string"), ["host"]).collect()}
    assert got["a"]["value"] == 1 and not got["a"]["conflict"] and got["a"]["share"] == round(5 / 7, 4)
    assert got["b"]["value"] is None and got["b"]["conflict"] and got["c"]["value"] == 7 and got["c"]["share"] == 1
    assert got["d"]["value"] == 1 and got["d"]["conflict"] and list(got["d"]["against"]) == ["2"] and "e" not in got and got[None]["value"] == 4


def test_offsets_of_two_hosts_in_one_run(spark):
    proof = [("n", "2026-03-01T10:00:00+02:00 h x: y"), ("n", "2026-03-01T10:00:00-05:00 h x: y"), ("n", "Time zone: Area/City (EET, +0200)"), ("m", "2026-03-01T10:00:00-0330 h x: y"), ("m", "2026-03-01T10:00:00Z h x: y"), ("m", "plain")]
    decided = votes.decided(votes.offset_evidence(spark.createDataFrame(proof, "host string, line string"), ["host"]), ["host"])
    assert {r["host"]: (r["value"], r["conflict"]) for r in decided.collect()} == {"n": (7200, False), "m": (-12600, False)}
    text = [("n", "/n", 1, "2026-03-01 10:00:00 h x: y"), ("m", "/m", 1, "2026-03-01 10:00:00 h x: y"), ("u", "/u", 1, "2026-03-01 10:00:00 h x: y"), ("n", "/n", 2, "2026-03-01T10:00:00+01:00 h x: y")]
    lines = votes.with_offsets(spark.createDataFrame(text, "host string, path string, line_no long, line string"), decided, ["host"])
    got = {(r["log"], r["line_no"]): r["timestamp_utc"].strftime("%H:%M") for r in logs.var_log(lines, host_offset_s=F.col("host_offset_s")).collect()}
    assert got == {("/n", 1): "08:00", ("/m", 1): "13:30", ("/u", 1): "10:00", ("/n", 2): "09:00"}


def test_artifacts_of_unknown_schema(spark):
    text = ['{"A": "x", "n": 1, "deep": {"b": [1, 2]}, "odd name": "q"}', '{"A": "x", "n": 2.5, "t": true}', '{"A": "y", "n": "text", "mixed": 1}', '{"A": "y", "mixed": "two"}', "[1]", "7", "{cut", "", '{"A": "x", "n": null}']
    lines = spark.createDataFrame([("/f", i, t) for i, t in enumerate(text)], "path string, line_no long, line string").repartition(3)
    rows, bad = collector.parsed(lines, F.try_variant_get("v", "$.A", "string"))
    assert sorted(r["line_no"] for r in bad.collect()) == [4, 5, 6]
    found = collector.schemas(rows)
    assert set(found["x"]) == {"A", "n", "deep", "odd name", "t"} and set(found["y"]) == {"A", "n", "mixed"}
    x = collector.artifact_table(rows, "x", found["x"])
    assert x.columns == ["path", "line_no", "A", "deep", "n", "odd name", "t"]
    got = {r["line_no"]: r for r in x.collect()}
    assert got[0]["deep"] == '{"b":[1,2]}' and float(got[1]["n"]) == 2.5 and got[1]["t"] is True and got[0]["odd name"] == "q" and got[8]["n"] is None
    y = {r["line_no"]: r["mixed"] for r in collector.artifact_table(rows, "y", found["y"]).collect()}
    assert y == {2: "1", 3: "two"} or {k: v.strip('"') for k, v in y.items()} == {2: "1", 3: "two"}
    assert collector.fields("OBJECT<a: BIGINT, `b c`: OBJECT<x: ARRAY<BIGINT>, y: STRING>, d: DECIMAL(3,1)>") == {"a": "BIGINT", "b c": "OBJECT<x: ARRAY<BIGINT>, y: STRING>", "d": "DECIMAL(3,1)"}
    assert collector.fields("VOID") == {}


def test_boots(spark):
    rng = random.Random(5)
    at = lambda: START + timedelta(minutes=rng.randrange(60))
    rows = [(i, rng.choice(["a", "b", None]), at()) for i in range(120)]
    boots = [(rng.choice(["a", "b"]), at()) for _ in range(7)]
    got = sessions.boot_segments(spark.createDataFrame(rows, "id int, host string, ts timestamp"), spark.createDataFrame(boots, "host string, ts timestamp"), ["host"], "ts")
    want = []
    for i, h, t in rows:
        own = [b for x, b in boots if x == h]
        boot = max((b for b in own if b <= t), default=None)
        want.append((i, boot, boot is not None and boot == max(own)))
    assert sorted((r["id"], r["boot"], r["newest"]) for r in got.collect()) == sorted(want)
    marks = [("a", START + timedelta(hours=n), k) for n, k in enumerate(["BOOT", "BOOT", "SHUTDOWN", "BOOT", "LOGIN", "SHUTDOWN", "BOOT"])]
    found = sessions.unclean_boots(spark.createDataFrame(marks, "host string, ts timestamp, type string"), ["host"], "ts").collect()
    assert [tuple(r) for r in found] == [("a", START, START + timedelta(hours=1))]


def test_commands_that_name_other_hosts(spark):
    ids = spark.createDataFrame([("db", "db01.corp"), ("db", "10.0.0.5"), ("db", "db01"), ("web", "WEB-1"), ("web", ""), ("v6", "fe80::5")], "host string, value string")
    said = ["ssh root@db01.corp", "scp x 10.0.0.5:/tmp/", "curl http://web-1:8080/a", "ping 10.0.0.55", "echo db01.corp.example", "ssh -p 22 'db01'", "ping fe80::5", "", None]
    commands = spark.createDataFrame([(i, "web", c) for i, c in enumerate(said)], "id int, host string, command string")
    found = correlate.commands_naming_hosts(commands, ids, ["id"])
    assert sorted((r["id"], r["named_host"], r["token"]) for r in found.collect()) == [(0, "db", "db01.corp"), (1, "db", "10.0.0.5"), (5, "db", "db01"), (6, "v6", "fe80::5")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
