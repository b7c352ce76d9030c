"""Timeline, rules on bytes, Sigma gates and coverage, nested blocks, the kernel's clock: against plain versions."""

import itertools
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import blocks, byte_rules, clock, sigma, sigma_gates, timeline


def lines(spark, text, path="/x"):
    return spark.createDataFrame([(path, i, x) for i, x in enumerate(text, 1)], "path string, line_no long, line string").repartition(3)


def test_a_timeline_is_numbered_without_one_sort_of_all(spark):
    rng = random.Random(1)
    rows = [(i, datetime(2026, 1, 1) + timedelta(seconds=rng.randrange(50)) if i % 9 else None, rng.choice("ab")) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, at timestamp, kind string").repartition(4)
    t = timeline.timeline({"x": (df, [timeline.Source(F.col("at"), F.col("id"), F.col("kind"))]), "y": (df, [timeline.Source(F.date_add("at", 1), F.col("id") % 7, F.lit("later"), severity=F.lit("LOW"))])})
    want = sorted((str(ts), "x", str(i), k) for i, ts, k in rows if ts) + sorted((str(ts.replace(hour=0, minute=0, second=0) + timedelta(days=1)), "y", str(i % 7), "later") for i, ts, k in rows if ts)
    out = timeline.numbered(t, parts=5)
    got = [(str(r.ts), r.table, r.key, r.event) for r in sorted(out.collect(), key=lambda r: r.number)]
    assert got == sorted(want) and sorted(r.number for r in out.collect()) == list(range(1, len(want) + 1))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan.split("before_")[0].split("Window")[0]
    assert timeline.numbered(t.limit(0), parts=3).count() == 0


def test_pages_follow_each_other(spark):
    df = spark.range(100).select("id", F.timestamp_seconds(F.col("id") % 10).alias("at"))
    t = timeline.timeline({"x": (df, [timeline.Source(F.col("at"), F.col("id"), F.lit("e"))])})
    whole = [tuple(r) for r in t.orderBy(*timeline.ORDER).collect()]
    first = timeline.page(t, None, None, 30).collect()
    last = first[-1]
    second = timeline.page(t, None, None, 30, after=tuple(str(last["ts"]) if c == "ts" else last[c] for c in timeline.ORDER)).collect()
    assert [tuple(r) for r in [*first, *second]] == whole[:60]
    assert timeline.page(t, "1970-01-01 00:00:03", "1970-01-01 00:00:04", 99).count() == 10


PATTERNS = {
    "$plain": byte_rules.Text("aba"), "$nocase": byte_rules.Text("AbA", nocase=True), "$wide": byte_rules.Text("ab", wide=True), "$word": byte_rules.Text("ab", fullword=True), "$wideword": byte_rules.Text("a", wide=True, fullword=True),
    "$hex": byte_rules.Hex("61 ?? 61"), "$half": byte_rules.Hex("6? ?2"), "$jump": byte_rules.Hex("61 [0-3] 62"), "$either": byte_rules.Hex("( 61 62 | 62 | 00 ) 61"), "$zero": byte_rules.Hex("00"),
}


def plain_count(pattern, raw):
    return len(re.findall(f"(?s)(?={pattern.regex()})", raw.decode("latin-1")))


@pytest.mark.parametrize("chunk", [2, 3, 7, 1 << 20])
def test_patterns_are_counted_once_across_chunks(spark, chunk):
    rng = random.Random(chunk)
    files = [(i, bytes(rng.choice(b"abAB\x00 \xff\n") for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(60, None), (61, b""), (62, b"aba" * 400)]
    df = spark.createDataFrame(files, "id long, content binary").repartition(3)
    rule = byte_rules.ByteRule("r", PATTERNS)
    got = {r.id: (r.size, list(r.counts)) for r in byte_rules.pattern_counts(df, [rule], ["id"], chunk=chunk).collect()}
    assert got == {i: (len(raw or b""), [plain_count(p, raw or b"") for p in PATTERNS.values()]) for i, raw in files}


def test_byte_conditions(spark):
    files = spark.createDataFrame([(1, b"MZ__upx!upx!"), (2, b"_MZ"), (3, b"MZ" + b"x" * 3000), (4, b"")], "id long, content binary")
    mz, upx = byte_rules.Text("MZ"), byte_rules.Text("UPX!", nocase=True)

    def met(condition):
        rule = byte_rules.ByteRule("r", {"$mz": mz, "$upx": upx, "$up": byte_rules.Hex("75 70")}, condition)
        return sorted(r.id for r in byte_rules.matches(files, [rule], ["id"], chunk=4).collect())

    assert met("$mz at 0") == [1, 3] and met("$mz at 1") == [2] and met("#upx == 2 or filesize > 2KB") == [1, 3]
    assert met("not any of them") == [4] and met("all of them") == [1] and met("2 of ($up*)") == [1] and met("any of ($u*) and not $mz at 0") == []
    assert met("filesize < 1 or ($mz and not #up >= 1 and filesize <= 3)") == [2, 4]
    for bad in ("$none", "$mz at x", "all of", "$mz and", "2 off them", "$mz ~ 1", "(any of them"):
        with pytest.raises(byte_rules.ByteRuleError):
            met(bad)
    for bad in ("6", "( 61", "[3-1] 61", "zz", ""):
        with pytest.raises(byte_rules.ByteRuleError):
            byte_rules.Hex(bad).regex()


def random_rule(rng, n):
    pieces = ["abc", "bcd", "cde", "ab", "a*bcd", "deab", "xyz", "abcd"]

    def body():
        kind = rng.randrange(5)
        if kind == 0:
            return [rng.choice(pieces) for _ in range(2)]
        if kind == 1:
            return [{"x|contains": rng.choice(pieces)}, {"y": rng.choice(pieces)}]
        key = rng.choice(["x", "y", "missing"]) + rng.choice(["|contains", "|startswith", "", "|contains|all", "|re"])
        return {key: [rng.choice(pieces[:4] if key.endswith("re") else pieces) for _ in range(rng.randint(1, 2))], **({"y|contains": rng.choice(pieces)} if rng.random() < 0.4 else {})}

    names = ["s1", "s2", "t"]
    condition = rng.choice(["s1 and s2", "s1 or t", "s1 and not t", "1 of s*", "all of them", "not s1", "2 of them", "(s1 or s2) and not (t and s1)", "s1 and not s1"])
    return {"title": f"r{n}", "level": "low", "detection": {k: body() for k in names} | {"condition": condition}}


def test_gated_rules_match_what_all_rules_match(spark):
    rng = random.Random(7)
    rules = [random_rule(rng, i) for i in range(60)]
    rows = [(i, "".join(rng.choice("abcde xyz") for _ in range(rng.randint(0, 14))), "".join(rng.choice("abcdeXYZ") for _ in range(rng.randint(0, 8)))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x string, y string").repartition(3)
    some = lambda f: sorted((r["rule"], r["id"], r["rank"], r["count"]) for r in f(df, rules, ["id"], most=20)[0].collect())
    plain = some(sigma.matches)
    assert some(sigma_gates.gated_matches) == plain and len({r[0] for r in plain}) > 20
    assert sum(sigma_gates.rule_gate(r) is not None for r in rules) > 15
    scans = sigma_gates.gated_matches(df, rules, ["id"])[0]._jdf.queryExecution().executedPlan().toString()
    assert scans.count("Scan ") == 1


def test_conditions_that_can_be_true(spark):
    rng = random.Random(3)
    names = ["a", "b", "c", "d"]

    def tree(depth):
        kind = rng.randrange(5 if depth else 1)
        if kind == 0:
            return ("sel", rng.choice(names))
        if kind == 1:
            return ("not", tree(depth - 1))
        if kind == 2:
            return ("of", rng.randint(0, 4), rng.sample(names, rng.randint(1, 3)))
        return (("and", "or")[kind - 3], [tree(depth - 1) for _ in range(rng.randint(1, 3))])

    def holds(t, v):
        kind, *rest = t
        return v[rest[0]] if kind == "sel" else not holds(rest[0], v) if kind == "not" else sum(v[n] for n in rest[1]) >= rest[0] if kind == "of" else (all if kind == "and" else any)(holds(x, v) for x in rest[0])

    for _ in range(400):
        t, fixed = tree(3), {n: rng.random() < 0.5 for n in names if rng.random() < 0.5}
        worlds = (dict(zip(names, v, strict=True)) | fixed for v in itertools.product([True, False], repeat=4))
        assert sigma_gates.satisfiable(t, fixed) == any(holds(t, v) for v in worlds)
    rule = {"title": "r", "detection": {"a": {"Image": "x"}, "b": {"url": "y"}, "condition": "a and b"}}
    assert sigma_gates.coverage([rule], {"web": ["url"], "all": ["url", "image"]}) == [("r", "web", False, "no field Image"), ("r", "all", True, "")]
    assert sigma_gates.coverage([rule], {"web": ["url", "exe"]}, {"image": ["exe"]})[0][2]
    free = {"title": "n", "detection": {"a": {"Image": None}, "condition": "a"}}
    assert sigma_gates.coverage([free], {"web": ["url"]}) == [("n", "web", True, "")]


def test_nested_blocks(spark):
    nft = ["table inet filter {", "\tchain input {", "\t\ttype filter hook input priority 0; policy drop;", "\t\tiif lo accept # own", "\t\ttcp dport 22 accept", "\t}", "\tset bad {", "\t\ttype ipv4_addr", "\t}", "\tchain out {", "\t\ttype filter hook output priority 0;", "\t\tdrop", "\t}", "}", "table ip nat {", "  chain post {", "    masquerade", "  }", "}"]
    got = sorted(tuple(r) for r in blocks.nft_rules(lines(spark, nft)).select("line_no", "family", "table", "chain", "hook", "policy", "rule").collect())
    assert got == [(4, "inet", "filter", "input", "input", "drop", "iif lo accept"), (5, "inet", "filter", "input", "input", "drop", "tcp dport 22 accept"), (12, "inet", "filter", "out", "output", "", "drop"), (17, "ip", "nat", "post", "", "", "masquerade")]
    saved = ["# Generated", "*filter", ":INPUT DROP [0:0]", ":FORWARD ACCEPT [1:2]", "-A INPUT -p tcp --dport 22 -j ACCEPT", "COMMIT", "*nat", ":INPUT ACCEPT [0:0]", "-A INPUT -j LOG", "-A EXTRA -j RETURN", "COMMIT"]
    got = sorted(tuple(r) for r in blocks.iptables_rules(lines(spark, saved)).select("line_no", "table", "chain", "policy", "rule").collect())
    assert got == [(5, "filter", "INPUT", "DROP", "-A INPUT -p tcp --dport 22 -j ACCEPT"), (9, "nat", "INPUT", "ACCEPT", "-A INPUT -j LOG"), (10, "nat", "EXTRA", "", "-A EXTRA -j RETURN")]
    web = ["user www;", "http {", "  server {", "    listen 80;", "    location / {", "      root /srv; # here {", "    }", "    location /b {", "    }", "  }", "}"]
    got = [tuple(r) for r in blocks.web_config(lines(spark, web)).orderBy("line_no").select("directive", "value", "context").collect()]
    assert got == [("user", "www", ""), ("listen", "80", "http > server"), ("root", "/srv", "http > server > location /")]


def test_the_boot_that_most_lines_agree_on(spark):
    boot = datetime(2026, 3, 1, 4)
    rows = [("a", boot + timedelta(seconds=s, milliseconds=s % 7 * 100), float(s)) for s in range(0, 300, 3)]
    rows += [("a", boot + timedelta(hours=9, seconds=s), float(s)) for s in range(60)] + [("b", boot, None), ("b", None, 4.0), (None, boot + timedelta(seconds=2), 2.0)]
    pairs = spark.createDataFrame(rows, "host string, wall timestamp, offset_s double")
    boots = {r["host"]: r for r in clock.boot_instants(pairs, ["host"]).collect()}
    assert abs((boots["a"]["booted"] - boot).total_seconds()) < 1 and boots["a"]["support"] == 100 and boots["a"]["disagree"] == 60 and "b" not in boots and boots[None]["booted"] == boot
    ring = spark.createDataFrame([("a", 10.0), ("b", 1.0), ("a", None)], "host string, offset_s double")
    got = clock.dated(ring, clock.boot_instants(pairs, ["host"]), ["host"]).orderBy("host", "offset_s").collect()
    assert [r["timestamp_utc"] is None for r in got] == [True, False, True]
