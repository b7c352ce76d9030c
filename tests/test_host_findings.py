import struct
from datetime import datetime

from pyspark.sql import functions as F

from quarrystone.extract import host, slots
from quarrystone.operators import analyzers, correlate, host_findings


def lines(spark, text, path):
    return spark.createDataFrame([(path, i, x) for i, x in enumerate(text, 1)], "path string, line_no long, line string").repartition(3)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_local_sockets_beside_the_others(spark):
    text = [
        "Active Internet connections (servers and established)", "Proto Recv-Q Send-Q Local Address  Foreign Address  State  PID/Program name", "tcp        0      0 0.0.0.0:ssh     0.0.0.0:*     LISTEN      7/sshd: /usr/sb",
        "udp        0      0 :::68     :::*     -", "Active UNIX domain sockets (servers and established)", "Proto RefCnt Flags       Type       State         I-Node   PID/Program name     Path",
        "unix  2      [ ACC ]     STREAM     LISTENING     20718    1/init               /run/systemd/private", "unix  3      [ ]         DGRAM                    9001     -                    @/tmp/a b", "unix  3      [ ]         STREAM     CONNECTED     9002", "unix  x      [ ]    cut",
    ]
    got = rows(host.netstat(lines(spark, text, "live/netstat_-anp.txt"), local_too=True), "proto", "state", "recv_q", "local_addr", "local_port", "pid", "process", "inode")
    assert got == [
        ("tcp", "LISTEN", "0", "0.0.0.0", "ssh", "7", "sshd:", ""), ("udp", "", "0", "::", "68", "", "", ""), ("unix", "", "3", "@/tmp/a b", "", "", "", "9001"),
        ("unix", "CONNECTED", "3", "", "", "", "", "9002"), ("unix", "LISTENING", "2", "/run/systemd/private", "", "1", "init", "20718"),
    ]


def test_both_forms_of_ifconfig(spark):
    new = ["eth0: flags=4163<UP,BROADCAST,RUNNING>  mtu 1500", "        inet 10.0.0.5  netmask 255.0.0.0", "        inet6 fe80::1  prefixlen 64", "        ether 02:00:00:00:00:07  txqueuelen 1000", "", "lo: flags=73<LOOPBACK>  mtu 65536"]
    old = ["wlan0     Link encap:Ethernet  HWaddr 02:00:00:00:00:09", "          inet addr:10.0.0.6  Bcast:10.255.255.255", "          inet6 addr: fe80::2/64 Scope:Link", "          UP RUNNING  MTU:1500"]
    ip = ["2: eth1@if9: <UP> mtu 9000 qdisc x state UP", "    link/ether 02:00:00:00:00:0a brd ff", "    inet 10.0.0.7/8 brd 1"]
    all_ = lines(spark, new, "live/ifconfig_-a.txt").union(lines(spark, old, "old/ifconfig.txt")).union(lines(spark, ip, "live/ip_a.txt"))
    assert rows(host.interfaces(all_), "index", "name", "flags", "mtu", "state", "mac", "addresses") == [
        ("", "eth0", "UP,BROADCAST,RUNNING", "1500", "UP", "02:00:00:00:00:07", "10.0.0.5 fe80::1"), ("", "lo", "LOOPBACK", "65536", "", "", ""),
        ("", "wlan0", "", "", "", "02:00:00:00:00:09", "10.0.0.6 fe80::2/64"), ("2", "eth1", "UP", "9000", "UP", "02:00:00:00:00:0a", "10.0.0.7/8"),
    ]


def test_open_files_and_what_is_expected(spark):
    text = ["COMMAND PID USER FD TYPE DEVICE SIZE/OFF NODE NAME", "chrome 5 u 3u REG 0,1 1 2 /memfd:x (deleted)", "pulse 6 u 3u REG 0,1 1 2 /dev/shm/pulse-shm-1", "short 7 u cwd DIR", "x y z 3u REG 0,1 1 2 /tmp/no", "sh 8 u txt REG 8,1 1 2 /opt/a b (deleted)"]
    df = host.open_files(lines(spark, text, "live/lsof_-nPl.txt"))
    assert rows(df, "command", "pid", "name") == [("chrome", 5, "/memfd:x (deleted)"), ("pulse", 6, "/dev/shm/pulse-shm-1"), ("sh", 8, "/opt/a b (deleted)")]
    started = spark.createDataFrame([(8, datetime(2024, 1, 2)), (8, datetime(2024, 1, 1)), (None, None)], "pid int, started timestamp")
    rules = host_findings.open_file_rules()
    found = host_findings.strongest(analyzers.findings(analyzers.hits(host_findings.with_started(df, started), rules, F.col("name")), rules))
    assert rows(found, "severity", "title", "count") == [
        ("HIGH", "Process(es) with a deleted executable image open", 1), ("LOW", "Open regular files in temp / shared-memory directories", 1), ("LOW", "memfd-backed (fileless) mappings open", 1),
    ]
    assert [r["first_utc"] for r in found.where("severity = 'HIGH'").collect()] == [datetime(2024, 1, 1)]
    nothing = df.limit(0).withColumn("started", F.lit(None).cast("timestamp"))
    assert analyzers.findings(analyzers.hits(nothing, rules, F.col("name")), rules).count() == 0


def test_slots_of_logins(spark):
    slot = lambda t, line=b"", name=b"": struct.pack("<i32s256s", t, line, name)
    content = slot(0) + slot(1_700_000_000, b"pts/0", b"h\xff\xfe") + slot(0) * 3 + slot(5, b"x" * 32, b"") + b"cut"
    files = spark.createDataFrame([("/a", bytearray(content)), ("/empty", bytearray()), ("/none", None)], "path string, content binary")
    users = spark.createDataFrame([(1, "b"), (1, "a"), (None, "n")], "uid int, username string")
    got = rows(slots.last_logins(files, users), "uid", "username", "last_login_utc", "terminal", "remote_host")
    assert got == [(1, "a", datetime(2023, 11, 14, 22, 13, 20), "pts/0", "h��"), (5, "", datetime(1970, 1, 1, 0, 0, 5), "x" * 32, "")]


def test_slots_of_failures(spark):
    long = struct.pack("<hh12sqq", 3, 5, b"tty1", 1_700_000_000, 60) + bytes(32) + struct.pack("<hh12sqq", -1, 0, b"", 0, 0)
    short = struct.pack("<hh12sll".replace("l", "i"), 0, 5, b"tty2", 1_700_000_000, 60)
    files = spark.createDataFrame([("/l", bytearray(long)), ("/s", bytearray(short)), ("/odd", bytearray(short + b"1")), ("/empty", bytearray()), ("/none", None)], "path string, content binary")
    at = datetime(2023, 11, 14, 22, 13, 20)
    got = [tuple(r[c] for c in ("source", "uid", "count", "most", "terminal", "last_utc", "lock_s")) for r in slots.failed_counts(files).orderBy("source", "uid").collect()]
    assert got == [("/l", 0, 3, 5, "tty1", at, 60), ("/l", 2, -1, 0, "", None, 0), ("/s", 0, 0, 5, "tty2", at, 60)]


def test_logging(spark):
    text = ["[Journal]", "#Storage=none", " Storage = volatile", "MaxRetentionSec=10h", "SystemMaxUse=10GB", "Storage=persistent", "SystemMaxUse = 5m"]
    df = lines(spark, text, "[root]/etc/systemd/journald.conf").union(lines(spark, ["Storage=none"], "/etc/other.conf"))
    assert rows(host_findings.journal_setting_findings(df), "severity", "title", "count") == [
        ("LOW", "journald retention limited (MaxRetentionSec=10h)", 1), ("LOW", "journald retention limited (SystemMaxUse = 5m)", 1), ("MEDIUM", "journald not persisting logs (Storage = volatile)", 1),
    ]
    rules = host_findings.socket_file_rules()
    listed = lines(spark, ["/tmp/s", "/run/s", " /dev/shm/x", ""], "live/socket_files.txt")
    assert rows(analyzers.findings(analyzers.hits(listed, rules, F.col("line")), rules), "severity", "count") == [("MEDIUM", 2)]
    silent = host_findings.package_operation_rules(F.lit(None).cast("timestamp"), 1)
    ops = spark.createDataFrame([(datetime(2024, 1, 1), "install", "gcc")], "timestamp_utc timestamp, action string, package string")
    assert analyzers.findings(analyzers.hits(ops, silent, F.col("package")), silent).count() == 0


def test_what_hosts_share(spark):
    rules = spark.createDataFrame([(h, r, "/etc/sudoers", "NOPASSWD" in r) for h in ("a", "b") for r in ("root  ALL=(ALL) ALL", "%wheel ALL=(ALL) NOPASSWD: ALL", "eve ALL=(ALL) ALL", "eve ALL=(ALL) ALL")] + [("a", "solo ALL", "x", False), (None, "solo ALL", "x", None)], "host string, rule string, where string, nopasswd boolean")
    members = spark.createDataFrame([(h, "sudo", m, None) for h in ("a", "b") for m in ("eve", "root", "svc")], "host string, group string, member string, where string")
    accounts = spark.createDataFrame([("a", "eve", "1000"), ("a", "root", "0"), ("b", "svc", "200"), ("b", "svc", None)], "host string, username string, uid string")
    got = rows(correlate.shared_grants(rules, members, accounts), "kind", "grant", "hosts", "notable", "nopasswd", "where")
    both = "a: /etc/sudoers | b: /etc/sudoers"
    assert got == [
        ("group", "sudo: eve", "a, b", True, False, "a:  | b: "), ("group", "sudo: root", "a, b", False, False, "a:  | b: "), ("group", "sudo: svc", "a, b", False, False, "a:  | b: "),
        ("sudoers", "%wheel ALL=(ALL) NOPASSWD: ALL", "a, b", True, True, both), ("sudoers", "eve ALL=(ALL) ALL", "a, b", True, False, both), ("sudoers", "root ALL=(ALL) ALL", "a, b", False, False, both),
    ]
    found = correlate.shared_findings_of(correlate.shared_grants(rules, members, accounts), F.col("nopasswd"), correlate.GRANT_TITLES)
    assert rows(found, "severity", "count") == [("HIGH", 3), ("INFO", 3)]
    assert correlate.shared_grants(rules.limit(0), members.limit(0), accounts.limit(0)).count() == 0
    commands = {"wget -qO- http://x | sudo sh": True, "curl x ; cat y | sh": False, "echo a | base64 -d": True, "/usr/bin/find / -name x": False, "python3 /usr/bin/a -c": False, "run /opt/x": True, "curl x | tee y | sh": False, "CURL x |BASH": True}
    entries = spark.createDataFrame([(h, "cron", c, None) for h in ("a", "b") for c in commands] + [("a", "cron", None, None)], "host string, kind string, value string, where string")
    assert {r["value"]: r["notable"] for r in correlate.shared_autostarts(entries).collect()} == commands
