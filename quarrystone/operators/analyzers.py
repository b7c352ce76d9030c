"""Findings from typed tables: a list of rules, each a Column, tested in one scan.

A row meets any number of rules; the rules that it meets are exploded and
grouped by rule, with partial sums, so a rule that half of all rows meet costs
what a rare one does. Counts and spans cover all rows; evidence is a sample,
whose top rows are chosen within each partition before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..extract.files import under
from .entities import severity_rank

KEEP = 25

# Places of temporary files, programs and configuration.
TMPFS = ("/tmp/", "/var/tmp/", "/dev/shm/", "/run/shm/", "/dev/mqueue/")
SYSTEM_BIN = ("/bin/", "/sbin/", "/usr/bin/", "/usr/sbin/", "/usr/local/bin/", "/usr/local/sbin/", "/usr/lib/", "/lib/", "/lib64/", "/usr/lib64/")
SYSTEM_CFG = ("/etc/", "/boot/", "/usr/lib/systemd/", "/lib/systemd/")
# Packages that are tools of attackers as well.
DUAL_USE = (
    "nmap", "netcat", "netcat-openbsd", "netcat-traditional", "ncat", "socat", "tcpdump", "hydra", "john", "hashcat", "masscan", "proxychains", "proxychains4", "tor", "sshpass", "telnet", "nikto", "sqlmap", "metasploit-framework", "responder", "aircrack-ng", "ettercap-text-only", "chisel", "ngrok", "openvpn", "wireguard", "cryptsetup", "upx-ucl",
)
# What the bits of the kernel's taint value mean, from bit 0.
TAINT = (
    ("proprietary module loaded", "LOW"), ("module force-loaded", "HIGH"), ("unsafe SMP / kernel running on out-of-spec CPU config", "INFO"), ("module force-unloaded", "HIGH"), ("machine check exception", "LOW"), ("bad page", "LOW"),
    ("user forced taint", "MEDIUM"), ("kernel died (oops/BUG)", "MEDIUM"), ("ACPI table overridden", "LOW"), ("kernel warning issued", "INFO"), ("staging driver loaded", "INFO"), ("firmware bug workaround", "INFO"),
    ("OUT-OF-TREE module loaded", "MEDIUM"), ("UNSIGNED module loaded", "HIGH"), ("soft lockup", "LOW"), ("kernel live-patched", "MEDIUM"), ("auxiliary taint", "LOW"), ("struct randomisation plugin", "INFO"),
)


@dataclass
class Rule:
    """``when``: the rows that it is about; ``%d`` in the title is their number; beyond ``bulk`` rows the severity is ``bulk_severity``."""

    severity: str
    category: str
    title: str
    when: Column
    first: Column | None = None
    last: Column | None = None
    bulk: int | None = None
    bulk_severity: str = "INFO"


def hits(rows: DataFrame, rules: list[Rule], evidence: Column) -> DataFrame:
    """(rule, first_utc, last_utc, evidence): a row for each rule that a row meets; rule is its place in ``rules``."""
    never = F.lit(None).cast("timestamp")
    time = lambda c: (never if c is None else c.cast("timestamp"))
    met = [F.when(r.when, F.struct(F.lit(i).alias("rule"), time(r.first).alias("first_utc"), time(r.last if r.last is not None else r.first).alias("last_utc"))) for i, r in enumerate(rules)]
    return rows.select(F.explode(F.array_compact(F.array(*met))).alias("x"), evidence.alias("evidence")).select("x.*", "evidence")


def findings(met: DataFrame, rules: list[Rule]) -> DataFrame:
    """severity, category, title, count, first_utc, last_utc: one row for each rule that any row of ``met`` meets."""
    by = lambda values: F.get(F.array(*(F.lit(v) for v in values)), F.col("rule"))
    found = met.groupBy("rule").agg(F.count("*").alias("count"), F.min("first_utc").alias("first_utc"), F.max("last_utc").alias("last_utc"))
    many = F.col("count") > by([r.bulk if r.bulk is not None else (1 << 62) for r in rules])
    severity = F.when(many, by([r.bulk_severity for r in rules])).otherwise(by([r.severity for r in rules]))
    title = F.replace(by([r.title for r in rules]), F.lit("%d"), F.col("count").cast("string"))
    return found.select(severity.alias("severity"), by([r.category for r in rules]).alias("category"), title.alias("title"), "count", "first_utc", "last_utc")


def samples(met: DataFrame, rules: list[Rule], keep: int = KEEP) -> DataFrame:
    """(title, evidence): the ``keep`` smallest of each rule."""
    top = met.withColumn("n_", F.row_number().over(Window.partitionBy("rule").orderBy("evidence"))).where(F.col("n_") <= keep)
    return top.select(F.get(F.array(*(F.lit(r.title) for r in rules)), F.col("rule")).alias("title"), "evidence")


def bodyfile_rules(window_start: Column, collected: Column, hours: int) -> list[Rule]:
    """Rules on BODYFILE rows; a null window or time of collection silences the rules that need it."""
    path, mode = F.col("path"), F.col("mode")
    at = lambda name: F.timestamp_seconds(f"{name}_s")
    newest = F.greatest(at("mtime"), at("ctime"), at("crtime"))
    regular, folder = mode.startswith("-"), mode.startswith("d")
    runs = regular & F.substring(mode, 2, 9).contains("x")
    temporary = under(path, TMPFS) & (regular | folder) & ~path.contains("/systemd-private-")
    system = regular & under(path, SYSTEM_BIN + SYSTEM_CFG)
    old = (F.col("ctime_s") - F.col("mtime_s") >= 181 * 86_400) & (at("ctime") >= window_start)
    # a file that was created in the window has a stronger rule of its own
    created = (at("crtime") >= window_start) & (F.col("crtime_s") - F.col("mtime_s") >= 181 * 86_400)
    keys = path.endswith(".ssh/authorized_keys") | path.endswith(".ssh/authorized_keys2")
    return [
        Rule("CRITICAL", "Filesystem", "%d executable file(s) in world-writable temp directories", temporary & runs, at("mtime")),
        Rule("HIGH", "Persistence", "authorized_keys file timestamps", keys, F.least(at("mtime"), at("ctime")), F.greatest(at("mtime"), at("ctime"))),
        Rule("HIGH", "Anti-forensics", "File(s) timestamped after the collection ran", newest > collected + F.expr("INTERVAL 1 HOUR"), newest),
        Rule("MEDIUM", "Anti-forensics", "%d system file(s) with an mtime far older than a ctime inside the window", system & old & ~F.coalesce(created, F.lit(False)), at("ctime"), bulk=200),
        Rule("INFO", "Privilege", "%d setuid/setgid file(s) in the filesystem timeline", regular & F.substring(mode, 2, 6).contains("s"), newest),
        Rule("MEDIUM", "Filesystem", f"%d system file(s) created or modified within {hours}h of collection", system & (newest >= window_start), newest, bulk=2000, bulk_severity="LOW"),
        Rule("LOW", "Filesystem", "%d non-executable file(s) in temp / shared-memory directories", temporary & regular & ~runs & (F.col("size") != 0), at("mtime")),
        Rule("INFO", "Filesystem", "%d filesystem entries in the bodyfile", F.lit(True), newest),
    ]


def package_rules() -> list[Rule]:
    """Rules on PACKAGES rows of a listing with states."""
    stated = F.col("status").rlike(r"^[a-z][a-zA-Z]$")
    return [
        Rule("MEDIUM", "Software", "Dual-use / offensive tooling installed", stated & F.split("name", ":")[0].isin(*DUAL_USE)),
        Rule("LOW", "Software", "Package(s) not in a fully installed state", stated & ~F.col("status").isin("ii", "rc")),
    ]


def preload_rules() -> list[Rule]:
    """Rules on lines (path, line) of preload lists, environments and library search paths."""
    path, text = F.col("path"), F.btrim("line")
    environment = path.rlike(r"/(env|printenv)\.txt$")
    loader = [Rule("HIGH", "Rootkit", f"Loader environment variable set: {v}", environment & F.col("line").startswith(f"{v}=") & (F.btrim(F.substr("line", F.lit(len(v) + 2))) != "")) for v in ("LD_PRELOAD", "LD_LIBRARY_PATH", "LD_AUDIT")]
    return [
        Rule("CRITICAL", "Rootkit", "/etc/ld.so.preload is populated", (path.endswith("/etc_ld_so_preload.txt") | (path == "/etc/ld.so.preload")) & (text != "")),
        Rule("CRITICAL", "Rootkit", "LD_PRELOAD set system-wide in /etc/environment", (path == "/etc/environment") & (text.contains("LD_PRELOAD") | text.contains("LD_AUDIT"))),
        *loader,
        Rule("HIGH", "Rootkit", "Library search path in a writable directory", path.startswith("/etc/ld.so.conf.d/") & under(text, (*TMPFS, "/home/"))),
    ]


def taint_findings(values: DataFrame) -> DataFrame:
    """severity, category, title, flags from (host, value): the worst of the bits that are set, LOW at least; 0 is INFO."""
    v = F.col("value").try_cast("long")
    flags = F.array_compact(F.array(*(F.when(F.shiftright(v, i).bitwiseAND(1) == 1, F.struct(severity_rank(F.lit(s)).alias("rank"), F.lit(s).alias("severity"), F.lit(f"bit {1 << i} {d}").alias("flag"))) for i, (d, s) in enumerate(TAINT))))
    worst = F.get(F.array_sort(F.transform("flags_", lambda x: F.struct(x["rank"], x["severity"]))), F.lit(0))["severity"]
    rows = values.where(v >= 0).select("host", v.alias("v"), flags.alias("flags_"))
    severity = F.when(F.col("v") == 0, "INFO").when(F.coalesce(worst, F.lit("INFO")) == "INFO", "LOW").otherwise(worst)
    title = F.when(F.col("v") == 0, "Kernel not tainted (0)").otherwise(F.format_string("Kernel taint flags set (value %d)", "v"))
    return rows.select("host", severity.alias("severity"), F.lit("Kernel").alias("category"), title.alias("title"), F.transform("flags_", lambda x: x["flag"]).alias("flags"))
