"""Findings from open files, logging and package operations, as rules of one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import has_prefix
from .analyzers import DUAL_USE, TMPFS, Rule
from .entities import severity_rank

# Programs that hold anonymous memory files, and temporary files that desktops keep open.
MEMORY_USERS = ("pipewire", "wireplumb", "systemd", "gnome-she", "chrome", "firefox", "web content", "dbus-", "snapd", "mutter", "xwayland")
USUAL_TEMPORARY = ("lttng-ust-wait", "cups-dbus-notifier-lockfile", "pulse-shm", "/dev/shm/sem.")
DESKTOP_SOCKETS = ("/tmp/.X11", "/tmp/.ICE", "/tmp/.font", "/tmp/.XIM")
# Packages that build programs.
BUILDERS = (
    "build-essential", "gcc", "g++", "clang", "make", "cmake", "nasm", "yasm", "git", "golang-go", "rustc", "linux-headers-generic", "libpam0g-dev", "libssl-dev", "libgcrypt-dev",
    "libcap-dev", "libelf-dev", "libbpf-dev", "bpftool", "dkms", "kmod", "python3-dev", "autoconf", "automake", "libtool", "patch",
)
# Logs that a running host writes to.
WRITTEN_LOGS = (
    "auth.log", "secure", "syslog", "messages", "wtmp", "audit/audit.log", "cron", "kern.log", "apache2/access.log", "nginx/access.log", "apache2/error.log", "nginx/error.log",
    "httpd/access_log", "httpd/error_log",
)


def _holds(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def open_file_rules() -> list[Rule]:
    """Rules on OPEN_FILES rows with ``started``, the time of the process; two of one title are settled by ``strongest``."""
    name, started = F.col("name"), F.col("started")
    sockets = F.col("source").endswith("_-U.txt")
    gone = name.contains("(deleted)") & ~sockets
    memory = gone & name.contains("/memfd:")
    expected = has_prefix(F.lower("command"), MEMORY_USERS)
    kept = (F.col("type") == "REG") & _holds(name, ("/tmp/", "/var/tmp/", "/dev/shm/")) & ~_holds(name, DESKTOP_SOCKETS) & ~sockets
    words = F.split(F.concat_ws(" ", "fd", "type", "device", "node", "name"), r"[^A-Za-z0-9_]+")
    raw = F.arrays_overlap(words, F.array(*map(F.lit, ("pack", "raw", "RAW")))) & F.exists(words, lambda x: x.startswith("IPv")) & ~sockets
    return [
        Rule("HIGH", "Process", "Process(es) with a deleted executable image open", gone & (F.col("fd") == "txt") & ~memory, started),
        Rule("MEDIUM", "Process", "memfd-backed (fileless) mappings open", memory & ~expected, started),
        Rule("LOW", "Process", "memfd-backed (fileless) mappings open", memory, started),
        Rule("MEDIUM", "Process", "Open regular files in temp / shared-memory directories", kept & ~_holds(name, USUAL_TEMPORARY), started),
        Rule("LOW", "Process", "Open regular files in temp / shared-memory directories", kept, started),
        Rule("MEDIUM", "Network", "Raw / packet socket(s) open", raw, started),
        Rule("MEDIUM", "Network", "Unix domain socket(s) in a temp directory", sockets & _holds(name, ("/tmp/", "/var/tmp/", "/dev/shm/")) & ~_holds(name, DESKTOP_SOCKETS), started),
    ]


def with_started(rows: DataFrame, processes: DataFrame) -> DataFrame:
    """``rows`` with the earliest ``started`` that ``processes`` (pid, started) has for their pid."""
    times = processes.where("pid IS NOT NULL").groupBy(F.col("pid").cast("int").alias("of_pid_")).agg(F.min("started").alias("started"))
    return rows.join(times, F.col("pid") == F.col("of_pid_"), "left").drop("of_pid_")


def strongest(found: DataFrame) -> DataFrame:
    """Of findings of one category and title the most severe: what is expected is only told where nothing unexpected is."""
    w = Window.partitionBy("category", "title").orderBy(severity_rank(F.col("severity")), F.desc("count"))
    return found.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def socket_file_rules() -> list[Rule]:
    """Rules on lines of a list of socket files."""
    return [Rule("MEDIUM", "Network", "Socket file(s) in a world-writable directory", has_prefix(F.btrim("line"), TMPFS))]


def journal_setting_findings(lines: DataFrame) -> DataFrame:
    """severity, category, title, count from lines (path, line) of journald's configuration: each setting as it is written."""
    s = F.btrim("line", F.lit(" \t\r"))
    name, value = F.rtrim(F.substring_index(s, "=", 1)), F.lower(F.ltrim(F.substring_index(s, "=", -1)))
    named = lambda *names: F.lower(name).isin(*names) & s.contains("=")
    digits = F.rtrim(value, F.lit("smh"))
    limited = (digits != "") & (F.translate(digits, "0123456789", "") == "") & (F.length(value) - F.length(digits) <= 1)
    kind = F.when(named("storage") & has_prefix(value, ("none", "volatile")), F.struct(F.lit("MEDIUM").alias("severity"), F.lit("journald not persisting logs (%s)").alias("title")))
    kind = kind.when(named("maxretentionsec", "systemmaxuse") & limited, F.struct(F.lit("LOW").alias("severity"), F.lit("journald retention limited (%s)").alias("title")))
    own = F.col("path").endswith("/etc/systemd/journald.conf") | F.col("path").contains("/etc/systemd/journald.conf.d/")
    met = lines.where(own).select(kind.alias("k"), s.alias("said")).where("k IS NOT NULL")
    return met.groupBy("k.severity", F.lit("Anti-forensics").alias("category"), F.replace(F.col("k.title"), F.lit("%s"), F.col("said")).alias("title")).agg(F.count("*").alias("count"))


def log_file_findings(files: DataFrame) -> DataFrame:
    """host, severity, category, title, count from collected files (host, path, size): empty logs, journals, no record of authentication.

    Each host's files are summed up once; a host with no files at all has no finding.
    """
    below = F.when(F.col("path").contains("/var/log/"), F.substring_index("path", "/var/log/", -1))
    empty = below.isin(*WRITTEN_LOGS) & (F.col("size") == 0)
    journal = below.startswith("journal/") & F.element_at(F.split("path", "/"), -1).contains(".journal") & (F.size(F.split(below, "/")) == 3)
    seen = files.groupBy("host").agg(F.count_if(empty).alias("empty"), F.count_if(journal).alias("journals"), F.count_if(below.isin("auth.log", "secure")).alias("auth"))
    told = lambda test, severity, category, title, count: F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), title.alias("title"), count.alias("count")))
    each = F.array_compact(
        F.array(
            told(F.col("empty") > 0, "HIGH", "Anti-forensics", F.lit("Log file(s) present but empty"), F.col("empty")),
            told(F.col("auth") == 0, "LOW", "Collection", F.lit("No auth.log/secure collected"), F.lit(1).cast("long")),
            told(F.col("journals") > 0, "INFO", "Logging", F.format_string("%d systemd journal file(s) collected", "journals"), F.col("journals")),
        )
    )
    return seen.select("host", F.explode(each).alias("x")).select("host", "x.*")


def package_operation_rules(window_start: Column, hours: int) -> list[Rule]:
    """Rules on package operations (timestamp_utc, action, package) since ``window_start``; a null start silences them. A hundred and more are an installation."""
    at = F.col("timestamp_utc")
    inside = at >= window_start
    name = F.substring_index("package", ":", 1)
    return [
        Rule("MEDIUM", "Software", f"%d package operation(s) within {hours}h of collection", inside & F.col("action").isin("install", "upgrade", "remove", "purge"), at, bulk=100, bulk_severity="LOW"),
        Rule("MEDIUM", "Software", "Compiler / dual-use package(s) installed inside the incident window", inside & (F.col("action") == "install") & name.isin(*BUILDERS, *DUAL_USE), at),
    ]
