from pyspark.sql import functions as F

from quarrystone.operators import analyzers as A


def found(df, rules, evidence="path"):
    return {(r["severity"], r["title"]): r["count"] for r in A.findings(A.hits(df, rules, F.col(evidence)), rules).collect()}


def test_bodyfile_rules(spark):
    day = 86_400
    rows = [
        ("/tmp/x", "-rwxr-xr-x", 5, 100, 100, None), ("/tmp/systemd-private-1/x", "-rwxr-xr-x", 5, 100, 100, None), ("/dev/shm/d", "drwxrwxrwt", 5, 100, 100, None), ("/tmp/e", "-rw-r--r--", 0, 1, 1, None), ("/tmp/f", "-rw-r--r--", 1, 1, 1, None),
        ("/usr/bin/a", "-rwsr-xr-x", 5, 10 * day, 400 * day, None), ("/usr/bin/b", "-rwxr-xr-x", 5, 10 * day, 400 * day, 395 * day), ("/etc/c", "-rw-r--r--", 5, 395 * day, 395 * day, None), ("/root/.ssh/authorized_keys", "-rw-------", 5, None, 500 * day, None), ("/srv/n", "-rw-r--r--", 5, None, None, None),
    ]
    df = spark.createDataFrame(rows, "path string, mode string, size long, mtime_s long, ctime_s long, crtime_s long").repartition(3)
    at = lambda d: F.timestamp_seconds(F.lit(d * day))
    assert found(df, A.bodyfile_rules(at(390), at(450), 24)) == {
        ("CRITICAL", "1 executable file(s) in world-writable temp directories"): 1, ("HIGH", "authorized_keys file timestamps"): 1, ("HIGH", "File(s) timestamped after the collection ran"): 1,
        ("MEDIUM", "1 system file(s) with an mtime far older than a ctime inside the window"): 1, ("INFO", "1 setuid/setgid file(s) in the filesystem timeline"): 1,
        ("MEDIUM", "3 system file(s) created or modified within 24h of collection"): 3, ("LOW", "1 non-executable file(s) in temp / shared-memory directories"): 1, ("INFO", "10 filesystem entries in the bodyfile"): 10,
    }
    none = F.lit(None).cast("timestamp")
    assert len(found(df, A.bodyfile_rules(none, none, 24))) == 5 and found(df.limit(0), A.bodyfile_rules(none, none, 24)) == {}


def test_bulk_and_samples(spark):
    rules = [A.Rule("HIGH", "c", "%d of it", F.col("id") >= 0, bulk=9), A.Rule("LOW", "c", "odd", F.col("id") % 2 == 1)]
    met = A.hits(spark.range(10), rules, F.col("id"))
    assert {(r["severity"], r["title"]) for r in A.findings(met, rules).collect()} == {("INFO", "10 of it"), ("LOW", "odd")}
    assert sorted((r["title"], r["evidence"]) for r in A.samples(met, rules, 2).collect()) == [("%d of it", 0), ("%d of it", 1), ("odd", 1), ("odd", 3)]


def test_preloads_and_packages(spark):
    rows = [
        ("/etc/ld.so.preload", "/lib/x.so"), ("/etc/ld.so.preload", " "), ("/etc/environment", "export LD_AUDIT=/x"), ("live/env.txt", "LD_PRELOAD=/x"), ("live/env.txt", "LD_AUDIT= "), ("live/env.txt", "MY_LD_PRELOAD=/x"),
        ("/etc/ld.so.conf.d/a.conf", " /home/u/lib"), ("/etc/ld.so.conf.d/a.conf", "# /tmp/lib"), ("/etc/ld.so.conf.d/a.conf", "/usr/lib"), (None, "x"), ("/etc/environment", None),
    ]
    assert {t: n for (_, t), n in found(spark.createDataFrame(rows, "path string, line string"), A.preload_rules()).items()} == {
        "/etc/ld.so.preload is populated": 1, "LD_PRELOAD set system-wide in /etc/environment": 1, "Loader environment variable set: LD_PRELOAD": 1, "Library search path in a writable directory": 1,
    }
    packages = spark.createDataFrame([("ii", "nmap:amd64"), ("iU", "a"), ("rc", "b"), ("", "nmap"), ("install ok installed", "tor")], "status string, name string")
    assert sorted(found(packages, A.package_rules(), "name").values()) == [1, 1]


def test_taint(spark):
    rows = A.taint_findings(spark.createDataFrame([("a", "0"), ("b", "4"), ("c", "12289"), ("d", "no"), ("e", None)], "host string, value string"))
    assert {r["host"]: (r["severity"], r["title"], r["flags"]) for r in rows.collect()} == {
        "a": ("INFO", "Kernel not tainted (0)", []),
        "b": ("LOW", "Kernel taint flags set (value 4)", ["bit 4 unsafe SMP / kernel running on out-of-spec CPU config"]),
        "c": ("HIGH", "Kernel taint flags set (value 12289)", ["bit 1 proprietary module loaded", "bit 4096 OUT-OF-TREE module loaded", "bit 8192 UNSIGNED module loaded"]),
    }
