"""Findings of everyday places: shell history, scheduled tasks, units, startup scripts, sshd's settings, capabilities, mounts.

What a command does is decided once, by the programs that it runs and what they
are given; history, cron, units and scripts are all commands and share that
judgement. Each kind of finding is one grouped aggregation over its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import let
from .analyzers import TMPFS, Rule
from .entities import severity_rank

# Programs by what they are used for.
SHELLS = ("sh", "bash", "dash", "zsh", "ksh", "ash")
FETCHERS = ("curl", "wget", "fetch", "lwp-download")
LISTENERS = ("nc", "ncat", "netcat", "socat")
WIPERS = ("rm", "shred", "truncate", "wipe", "unlink")
WATCHERS = ("auditd", "rsyslog", "syslog", "firewalld", "ufw", "apparmor", "fail2ban", "crowdsec")
HISTORY_FILES = (".bash_history", ".zsh_history", ".history", "fish_history")
INTERACTIVE = ("bash", "zsh", "sh", "ksh", "fish")


def _judged(x: Column) -> Column:
    """struct (severity, why) of a command's words (all, small letters) and programs (last part of each word), or null."""
    text, words, names = x["text"], x["words"], x["names"]
    runs = lambda programs: F.arrays_overlap(names, F.array(*map(F.lit, programs)))
    says = lambda *parts: _any(text.contains(p) for p in parts)
    given = lambda *flags: F.arrays_overlap(words, F.array(*map(F.lit, flags)))
    stages = F.transform(F.slice(F.split(text, r"\|"), 2, 1 << 20), lambda s: F.regexp_replace(F.btrim(s), r"^(?:(?:sudo|nohup|env)\s+)+", ""))
    piped = F.arrays_overlap(F.transform(stages, lambda s: F.element_at(F.split(F.split(s, r"\s+")[0], "/"), -1)), F.array(*map(F.lit, SHELLS)))
    temporary = _any(F.element_at(words, 1).startswith(d) for d in TMPFS)
    cases = [
        ("CRITICAL", "shell over a network connection", says("/dev/tcp/", "/dev/udp/") | (runs(LISTENERS) & given("-e", "-c", "--exec", "exec:/bin/sh", "exec:/bin/bash"))),
        ("CRITICAL", "second account with uid 0", runs(("useradd", "usermod")) & given("-o") & says("-u 0", "--uid 0")),
        ("HIGH", "download run by a shell", runs(FETCHERS) & piped),
        ("HIGH", "decoded payload run", says("base64 -d", "base64 --decode", "xxd -r", "openssl enc -d") & (piped | says("eval "))),
        ("HIGH", "history cleared or switched off", says("history -c", "unset histfile", "histfile=/dev/null", "histsize=0", "histfilesize=0") | (runs(WIPERS) & _any(text.contains(h) for h in HISTORY_FILES))),
        ("HIGH", "logs removed", runs(WIPERS) & says("/var/log/", "/run/log/") | says("> /var/log/", "journalctl --vacuum")),
        ("HIGH", "setuid put on a file", runs(("chmod",)) & (given("u+s", "+s", "g+s", "ug+s") | F.exists(words, lambda w: w.rlike("^[4267][0-7]{3}$")))),
        ("HIGH", "program run from a temporary folder", temporary),
        ("MEDIUM", "password hashes read", says("/etc/shadow", "/etc/gshadow")),
        ("MEDIUM", "protection switched off", (runs(("systemctl", "service")) & given("stop", "disable", "mask") & _any(text.contains(s) for s in WATCHERS)) | says("setenforce 0", "ufw disable", "iptables -f", "nft flush ruleset")),
        ("MEDIUM", "file made immutable", runs(("chattr",)) & given("+i", "+a")),
        ("LOW", "download", runs(FETCHERS) & says("http://", "https://", "ftp://")),
    ]
    out = None
    for severity, why, test in cases:
        row = F.struct(F.lit(severity).alias("severity"), F.lit(why).alias("why"))
        out = F.when(test, row) if out is None else out.when(test, row)
    return out


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def judged(command: Column) -> Column:
    """struct (severity, why) of a command line; null if there is nothing to say about it, or no command."""
    text = F.lower(F.btrim(F.coalesce(command, F.lit(""))))
    words = F.filter(F.split(text, r"[\s;&|()`]+"), lambda w: w != "")
    known = F.struct(text.alias("text"), words.alias("words"), F.transform(words, lambda w: F.element_at(F.split(w, "/"), -1)).alias("names"))
    return F.when(F.size(words) > 0, let(known, _judged))


def suspicious(rows: DataFrame, command: str, category: str, title: str, keys: tuple[str, ...] = (), time: str | None = None) -> DataFrame:
    """keys, severity (the worst), category, title, count, reasons, first_utc, last_utc of the rows whose command is suspicious."""
    when = F.col(time).cast("timestamp") if time else F.lit(None).cast("timestamp")
    hit = rows.select(*keys, when.alias("at_"), F.explode(F.array(judged(F.col(command)))).alias("j")).where("j IS NOT NULL")
    each = hit.groupBy(*keys, "j.severity", "j.why").agg(F.count("*").alias("n"), F.min("at_").alias("first_"), F.max("at_").alias("last_"))
    worst = F.min_by("severity", severity_rank(F.col("severity")))
    reasons = F.array_sort(F.collect_list(F.concat(F.col("why"), F.lit(": "), F.col("n").cast("string"))))
    found = each.groupBy(*keys).agg(worst.alias("severity"), F.sum("n").alias("count"), reasons.alias("reasons"), F.min("first_").alias("first_utc"), F.max("last_").alias("last_utc"))
    return found.where("count > 0").select(*keys, "severity", F.lit(category).alias("category"), F.lit(title).alias("title"), "count", "reasons", "first_utc", "last_utc")


def history_findings(history: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Suspicious commands in SHELL_HISTORY rows (command, timestamp_utc)."""
    return suspicious(history, "command", "Execution", "Suspicious commands in shell history", keys, "timestamp_utc")


def missing_history(users: DataFrame, files: DataFrame) -> DataFrame:
    """Interactive accounts (username, shell, home) with a home of their own whose .bash_history is absent from files (path, size) or empty."""
    shell = F.element_at(F.split("shell", "/"), -1)
    own = users.where(shell.isin(*INTERACTIVE) & (F.col("home").startswith("/home") | F.col("home").startswith("/root")))
    own = own.select("username", F.concat(F.rtrim("home", F.lit("/")), F.lit("/.bash_history")).alias("path"))
    f = files.groupBy("path").agg(F.max("size").alias("size"))
    state = F.when(F.col("size").isNull(), "not collected").when(F.col("size") == 0, "empty")
    return own.join(f, "path", "left").select("username", "path", state.alias("state"), F.lit("MEDIUM").alias("severity"), F.lit("Anti-forensics").alias("category"), F.lit("Shell history missing or empty for interactive user(s)").alias("title")).where("state IS NOT NULL")


def persistence_findings(cron: DataFrame, units: DataFrame, scripts: DataFrame) -> DataFrame:
    """Suspicious content of CRON rows (command), SYSTEMD_UNITS rows (exec_start) and lines (line) of startup scripts."""
    parts = [
        suspicious(cron, "command", "Persistence", "Suspicious content in scheduled task definitions"),
        suspicious(units.select(F.explode(F.split("exec_start", r" \| ")).alias("command")).select(F.ltrim("command", F.lit("-+!@: ")).alias("command")), "command", "Persistence", "Suspicious systemd unit definition(s)"),
        suspicious(scripts.where(~F.ltrim("line").startswith("#")), "line", "Persistence", "Suspicious content in startup / shell / hook scripts"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sshd_rules() -> list[Rule]:
    """Rules on sshd's settings (setting, value): small letters, the value as the server takes it."""
    is_ = lambda setting, *values: (F.lower("setting") == setting) & F.lower("value").isin(*values)
    permissive = is_("permitrootlogin", "yes") | is_("permitemptypasswords", "yes") | is_("permituserenvironment", "yes") | is_("strictmodes", "no") | (F.lower("setting") == "authorizedkeyscommand") & (F.lower("value") != "none")
    interest = is_("passwordauthentication", "yes") | is_("x11forwarding", "yes") | is_("allowtcpforwarding", "yes") | is_("gatewayports", "yes", "clientspecified")
    return [Rule("HIGH", "Remote Access", "Permissive sshd configuration", permissive), Rule("INFO", "Remote Access", "sshd configuration of interest", ~permissive & interest)]


def capability_rules() -> list[Rule]:
    """Rules on CAPABILITIES rows (path, capabilities)."""
    strong = _any(F.lower("capabilities").contains(c) for c in ("cap_setuid", "cap_setgid", "cap_dac_override", "cap_dac_read_search", "cap_sys_admin", "cap_sys_ptrace", "cap_sys_module", "cap_chown", "cap_fowner"))
    return [Rule("HIGH", "Privilege", "File capabilities that enable privilege escalation", strong), Rule("INFO", "Privilege", "%d file(s) with capabilities", F.col("capabilities") != "")]


def mount_rules() -> list[Rule]:
    """Rules on MOUNTS rows: temporary file systems that programs may be run from."""
    point = F.rtrim("mountpoint", F.lit("/"))
    return [Rule("LOW", "Filesystem", "Temp filesystem mounted with exec permitted", point.isin(*(d.rstrip("/") for d in TMPFS)) & ~F.array_contains(F.split("options", ","), "noexec"))]


def sshd_settings(lines: DataFrame) -> DataFrame:
    """(path, setting, value) of sshd_config lines outside Match blocks; of a repeated setting of a file the first counts, as the server takes it."""
    s = F.btrim("line", F.lit(" \t\r"))
    parts = F.split(s, r"[\s=]+", 2)
    first_match = lines.groupBy("path").agg(F.min(F.when(F.lower(s).startswith("match "), F.col("line_no"))).alias("match_"))
    own = lines.join(first_match, "path").where((F.col("match_").isNull() | (F.col("line_no") < F.col("match_"))) & (s != "") & ~s.startswith("#"))
    return own.select("path", "line_no", F.lower(parts[0]).alias("setting"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("value")).groupBy("path", "setting").agg(F.min_by("value", "line_no").alias("value"))
