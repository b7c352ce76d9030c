from datetime import datetime

from pyspark.sql import functions as F

from quarrystone.functions import indicators, net, times


def apply(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows)]


def test_log_timestamps(spark):
    stamps = {
        "2026-03-24T15:47:28.123+02:00": "2026-03-24 13:47:28", "2026-03-24 15:47:28": "2026-03-24 19:47:28", "2026-03-24T15:47:28Z": "2026-03-24 15:47:28",
        "24/Mar/2026:15:47:28 -0400": "2026-03-24 19:47:28", "24/Mar/2026:15:47:28": "2026-03-24 15:47:28", "Tue Mar 24 11:53:47 EDT 2026": "2026-03-24 15:53:47", "Tue Mar  4 11:53:47 2026": "2026-03-04 15:53:47",
        "Mar  4 01:00:00": "2026-03-04 05:00:00", "Dec 31 10:00:00": "2025-12-31 14:00:00", "Xyz 31 10:00:00": "", "": "", "2026-13-40 10:00:00": "", "nonsense": "",
    }
    collected = F.lit(datetime(2026, 3, 25, 12)).cast("timestamp")
    assert apply(spark, list(stamps), lambda v: times.shown(times.log_timestamp(v, -4 * 3600, collected))) == list(stamps.values())


def test_durations_sizes_and_epochs(spark):
    assert apply(spark, ["0", "45", "119", "120", "3600", "19200", "172800"], lambda v: times.gap(v.cast("long"))) == ["", "45s", "119s", "2m", "1h", "5h20m", "2 days"]
    assert apply(spark, ["5", "2048", "1572864"], lambda v: times.human_size(v.cast("long"))) == ["5 B", "2.0 KB", "1.5 MB"]
    assert apply(spark, ["1774367248.7", "0", "-5", "x"], lambda v: times.shown(times.epoch(v))) == ["2026-03-24 15:47:28", "", "", ""]


def test_addresses(spark):
    assert apply(spark, ["192.168.56.101:", "1.2.3.4:51004", "[2001:db8::1]:443", '"10.0.0.1",', "-", "unknown", None, "::"], net.clean_address) == ["192.168.56.101", "1.2.3.4", "2001:db8::1", "10.0.0.1", "", "", "", ""]
    assert [tuple(x) for x in apply(spark, ["127.0.0.1:3333", "[::1]:22", "*:22", "2001:db8::1", "host", "1.2.3.4:x"], net.host_port)] == [("127.0.0.1", 3333), ("::1", 22), ("0.0.0.0", 22), ("2001:db8::1", None), ("host", None), ("1.2.3.4", None)]
    assert apply(spark, ["10.1.2.3", "8.8.8.8", "172.32.0.1", "localhost", "*", "203.0.113.9"], net.is_private) == [True, False, False, True, True, True]
    assert apply(spark, ["0100007F", "xyz"], net.hex_ipv4) == ["127.0.0.1", "xyz"]
    assert apply(spark, ["0A", "01", "FF"], net.tcp_state) == ["LISTEN", "ESTABLISHED", "FF"]
    assert apply(spark, ["255.255.255.0", "255.255.0.0", "255.0.255.0", "x"], net.prefix_length) == [24, 16, None, None]
    assert apply(spark, ["10.0.0.77", "10.0.1.1", "", None], lambda v: net.in_cidr(v, "10.0.0.0/24")) == [True, False, False, False]


def test_indicator_kinds(spark):
    kinds = {"port:4444": "port", "pid:1": "pid", "http://x/y": "url", "/etc/passwd": "path", "123": "number", "a" * 32: "md5", "b" * 40: "sha1", "c" * 64: "sha256", "deadbeefdeadbeef": "hex", "dead": "string", "1.2.3.4": "ipv4", "1.2.3.999": "filename", "fe80::1": "ipv6", "a@b.org": "email", "evil.example.com": "domain", "": ""}
    assert apply(spark, list(kinds), indicators.kind) == list(kinds.values())
    assert apply(spark, ["T1059.004 and T1110, T1110", None], indicators.techniques) == [["T1059.004", "T1110"], []]
    assert apply(spark, ["hXXps://evil[.]example(.)com", "a[@]b[dot]org"], indicators.refang) == ["https://evil.example.com", "a@b.org"]
    assert apply(spark, ["4097", "0"], lambda v: indicators.bits_set(v.cast("long"), {0: "P", 12: "O"})) == [["P", "O"], []]
