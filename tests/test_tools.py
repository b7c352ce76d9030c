from datetime import datetime

from quarrystone.operators import tools

CELLS = "table string, column string, kind string, value string, ts timestamp, tool string, weak string"


def cells(spark, *rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], CELLS)


def test_where_a_name_counts(spark):
    cases = {
        "john hashes": ["john"], "sudo john": ["john"], "FOO=1; john x": ["john"], "ls | john": ["john"], "ssh john@db": [], "echo john": [],
        "/opt/john/run/john": ["john"], "cat /home/john/notes": [], "johnson": [], "cat gost.so": [], "/x/gost": ["gost"], "/x/nmap-7.94": [], "/x/nmap": ["nmap"],
        "cp mimikatz_x64.zip /tmp": ["mimikatz"], "mimikatzen": [], "python /a/node_modules/quasar": [], "/usr/share/hydra": [], "/usr/share/x/mimikatz": ["mimikatz"],
        "/x/quasar.conf.js": [], "/x/quasar.py": ["quasar"], "john medusa": ["john"], "john; nmap": ["john", "nmap"], "": [], None: [],
    }
    rows = [("T", "c", "command", v, None) for v in cases]
    found = {}
    for r in tools.tool_hits(cells(spark, *rows)).collect():
        found.setdefault(r["value"], []).append(r["tool"])
    assert {v: sorted(t) for v, t in found.items()} == {v: t for v, t in cases.items() if t}


def test_text_and_weak_places_lower_the_severity(spark):
    rows = [("A", "m", "text", "saw mimikatz. and john", None), ("A", "m", "text", "mimikatz_x", None), ("B", "p", "path", "/usr/lib/mimikatz", None), ("B", "p", "path", "/a/vendor/xmrig", None), ("B", "p", "path", "/home/john/", None), ("B", "p", "path", "/home/john/john", None)]
    accounts = spark.createDataFrame([("john", "/home/john"), ("john", "/home/john/"), (None, None)], "name string, home string")
    out = sorted((r["table"], r["value"], r["tool"], r["severity"], r["weak"]) for r in tools.tool_hits(cells(spark, *rows), accounts).collect())
    assert out == [
        ("A", "saw mimikatz. and john", "mimikatz", "HIGH", ""), ("B", "/a/vendor/xmrig", "xmrig", "HIGH", "library"), ("B", "/home/john/", "john", "INFO", "account"),
        ("B", "/home/john/john", "john", "CRITICAL", ""), ("B", "/usr/lib/mimikatz", "mimikatz", "HIGH", "distro"),
    ]


def test_samples_variants_and_findings_keep_counts_whole(spark):
    at = lambda d: datetime(2024, 1, d)
    rows = [("H", "cmd", "command", f"nmap -p {i % 5}", at(1 + i % 20)) for i in range(40)] + [("P", "path", "path", "/root/nmap", None), ("P", "path", "path", "/home/john", at(3))]
    hits = tools.tool_hits(cells(spark, *rows), spark.createDataFrame([("john", "/home/john")], "name string, home string"))
    samples = tools.tool_samples(hits).collect()
    assert sorted((r["tool"], r["table"], r["count"]) for r in samples) == [("john", "P", 1)] + [("nmap", "H", 41)] * 12 + [("nmap", "P", 41)]
    variants = {r["detail"]: r for r in tools.tool_variants(hits, 2).collect() if r["tool"] == "nmap"}
    assert {d: (r["count"], r["tables"]) for d, r in variants.items()} == {"nmap -p 0": (8, "H x8"), "nmap -p 1": (8, "H x8"), "(other)": (24, "H x24"), "/root/nmap": (1, "P x1")}
    assert all(r["tool_total"] == 41 for r in variants.values())
    (finding,) = tools.tool_findings(hits).collect()
    assert finding["tool"] == "nmap" and finding["severity"] == "HIGH" and finding["count"] == 41 and finding["seen_in"] == "H (command) x40; P (path) x1"
    assert (finding["first_utc"], finding["last_utc"]) == (at(1), at(20))


def test_nothing_and_own_words(spark):
    none = cells(spark, ("T", "c", "text", "x", None)).limit(0)
    assert tools.tool_hits(none).collect() == [] and tools.tool_variants(tools.tool_hits(none)).collect() == []
    own = tools.tool_hits(cells(spark, ("T", "c", "text", "a Widget here", None)), unmistakable={"user keyword": ("widget",)}, ordinary={}).collect()
    assert [(r["tool"], r["category"], r["severity"]) for r in own] == [("widget", "user keyword", "MEDIUM")]
