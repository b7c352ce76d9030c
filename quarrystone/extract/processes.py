"""Processes, sockets and modules from command output and /proc files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import hex_endpoint, host_port, is_private, tcp_state
from ..operators.entities import first_writer
from .files import TMPFS, under

# Ports and protocols that matter.
IMPLANT_PORTS = (1337, 4444, 4445, 5555, 6666, 6667, 8443, 9001, 9050, 12345, 31337)
ADMIN_PORTS = (22, 23, 445, 3389, 5985, 5986)
USUAL_LISTENERS = (22, 53, 67, 68, 123, 631, 5353)

PS = r"^(\S+)\s+(\d+)\s+(\d+)\s+(.*)$"


def ps_lines(lines: DataFrame) -> DataFrame:
    """``user pid ppid command`` lines."""
    g = lambda i: F.regexp_extract(F.btrim("line"), PS, i)
    return lines.where(F.btrim("line").rlike(PS)).select(g(2).cast("int").alias("pid"), g(3).cast("int").alias("ppid"), g(1).alias("user"), g(4).alias("cmdline"))


PROC_PATH = r"/proc/(\d+)/([^/]+)$"


def proc_status(lines: DataFrame) -> DataFrame:
    """/proc/<pid>/status: one row for each process."""
    rows = lines.where(F.col("path").rlike(r"/proc/\d+/status$") & F.col("line").contains(":"))
    key, value = F.split("line", ":", 2)[0], F.btrim(F.split("line", ":", 2)[1])
    of = lambda k: F.max(F.when(key == k, value))
    first = lambda c: F.split(c, r"\s+")[0].try_cast("int")
    return rows.groupBy(F.regexp_extract("path", PROC_PATH, 1).cast("int").alias("pid")).agg(of("Name").alias("comm"), of("State").alias("state"), of("PPid").try_cast("int").alias("ppid"), first(of("Uid")).alias("uid"), first(of("Gid")).alias("gid"), of("Threads").try_cast("int").alias("threads"), first(of("VmRSS")).alias("rss_kb"))


def proc_environ(files: DataFrame) -> DataFrame:
    """/proc/<pid>/environ (path, content) as (pid, variable, value)."""
    pairs = F.explode(F.split(F.make_valid_utf8(F.col("content").cast("string")), "\x00"))
    rows = files.where(F.col("path").rlike(r"/proc/\d+/environ$")).select(F.regexp_extract("path", PROC_PATH, 1).cast("int").alias("pid"), pairs.alias("p"))
    return rows.where(F.col("p").contains("=")).select("pid", F.split("p", "=", 2)[0].alias("variable"), F.split("p", "=", 2)[1].alias("value"))


def process_master(sources: dict[str, DataFrame]) -> DataFrame:
    """PROCESS_MASTER: tables with a ``pid``, the most trusted first, as one row for each process, with its parent's command and flags."""
    merged = first_writer(list(sources.values()), "pid", list(sources))
    parent = merged.select(F.col("pid").alias("ppid"), F.col("cmdline").alias("parent")) if "cmdline" in merged.columns else merged.select(F.col("pid").alias("ppid"), F.lit(None).cast("string").alias("parent"))
    joined = merged.withColumn("ppid", F.col("ppid").try_cast("int")).join(parent.withColumn("ppid", F.col("ppid").cast("int")), "ppid", "left")
    return joined.withColumn("flags", F.array_join(F.array_compact(F.array(*process_flags(joined.columns))), ", "))


def process_flags(columns: list[str]) -> list[Column]:
    has = lambda c: F.coalesce(F.col(c), F.lit("")) if c in columns else F.lit("")
    exe, args, cwd = has("exe"), has("cmdline"), has("cwd")
    name = lambda p: F.element_at(F.split(p, "/"), -1)
    argv0 = F.split(args, r"\s+")[0]
    return [
        F.when(exe.endswith("(deleted)"), "deleted"),
        F.when(under(exe, TMPFS), "tmp exe"),
        F.when(~under(exe, TMPFS) & under(exe, ("/home/", "/root/", "/var/www/", "/srv/")), "home exe"),
        F.when(args.startswith("[") & args.endswith("]") & (exe != ""), "fake kernel thread"),
        F.when((exe != "") & (argv0 != "") & ~argv0.startswith("(") & (name(argv0) != name(F.regexp_replace(exe, r" \(deleted\)$", ""))) & under(exe, (*TMPFS, "/home/")), "masquerade"),
        F.when(under(F.concat(cwd, F.lit("/")), TMPFS) | cwd.endswith("(deleted)"), "odd cwd"),
    ]


def hidden_processes(proc: DataFrame, ps: DataFrame) -> DataFrame:
    """Processes in /proc that ps does not list."""
    return proc.join(ps.select("pid"), "pid", "left_anti")


SS_USERS = r'\("([^"]*)",pid=(\d+)'


def ss_lines(lines: DataFrame) -> DataFrame:
    """``ss`` output with a netid and state first: endpoints split, owning processes as one list each."""
    f = F.split(F.btrim("line"), r"\s+")
    rows = lines.where(f[0].isin("tcp", "udp", "sctp") & (F.size(f) >= 6)).select(f[0].alias("proto"), f[1].alias("state"), host_port(f[4]).alias("l"), host_port(f[5]).alias("p"), F.regexp_extract_all("line", F.lit(SS_USERS), F.lit(1)).alias("names"), F.regexp_extract_all("line", F.lit(SS_USERS), F.lit(2)).alias("pids"), "path")
    return rows.select("proto", "state", F.col("l.host").alias("local_addr"), F.col("l.port").alias("local_port"), F.col("p.host").alias("peer_addr"), F.col("p.port").alias("peer_port"), F.array_join(F.array_sort(F.array_distinct("pids")), ", ").alias("pid"), F.array_join(F.array_sort(F.array_distinct("names")), ", ").alias("process"), F.col("path").alias("source"))


def proc_net(lines: DataFrame) -> DataFrame:
    """/proc/net/tcp and udp: hexadecimal endpoints and states decoded, with uid and inode."""
    f = F.split(F.btrim("line"), r"\s+")
    rows = lines.where(f[0].rlike(r"^\d+:$") & (F.size(f) >= 10)).select(F.element_at(F.split("path", "/"), -1).alias("proto"), hex_endpoint(f[1]).alias("l"), hex_endpoint(f[2]).alias("r"), tcp_state(f[3]).alias("state"), f[7].try_cast("int").alias("uid"), f[9].alias("inode"))
    return rows.select("proto", F.col("l.host").alias("local_addr"), F.col("l.port").alias("local_port"), F.col("r.host").alias("remote_addr"), F.col("r.port").alias("remote_port"), "state", "uid", "inode")


def attributed(net: DataFrame, by_inode: DataFrame, by_endpoint: DataFrame) -> DataFrame:
    """``net`` with the owning pid: by inode (inode, pid) first, then by endpoint (local_addr, local_port, pid)."""
    i = by_inode.groupBy("inode").agg(F.min("pid").alias("pid_i"))
    e = by_endpoint.groupBy("local_addr", "local_port").agg(F.min("pid").alias("pid_e"))
    joined = net.join(i, "inode", "left").join(e, ["local_addr", "local_port"], "left")
    return joined.withColumn("pid", F.coalesce("pid_i", "pid_e")).withColumn("attributed_by", F.when(F.col("pid_i").isNotNull(), "inode").when(F.col("pid_e").isNotNull(), "endpoint").otherwise("")).drop("pid_i", "pid_e")


def unlisted(net: DataFrame, ss: DataFrame) -> DataFrame:
    """Sockets in /proc/net that ss does not show: by both ends, or by the local end alone while listening."""
    key = lambda d, remote, port: d.withColumn("k", F.when((F.col("state") == "LISTEN") | (F.coalesce(F.col(port), F.lit(0)) == 0), F.concat_ws("|", "local_addr", F.col("local_port").cast("string"))).otherwise(F.concat_ws("|", "local_addr", F.col("local_port").cast("string"), remote, F.col(port).cast("string"))))
    return key(net, "remote_addr", "remote_port").join(key(ss, "peer_addr", "peer_port").select("k"), "k", "left_anti").drop("k")


def socket_findings(ss: DataFrame) -> DataFrame:
    """(severity, title, local_addr, local_port, peer_addr, peer_port, process): each socket once for each rule."""
    one = ss.dropDuplicates(["proto", "state", "local_addr", "local_port", "peer_addr", "peer_port"])
    listening, active = F.col("state") == "LISTEN", F.col("state").isin("ESTAB", "ESTABLISHED", "SYN-SENT")
    nobody, port, peer = F.col("process") == "", F.col("local_port"), F.col("peer_port")
    everywhere = F.col("local_addr").isin("0.0.0.0", "::", "*")
    rules = [
        ("CRITICAL", "listening socket(s) with no owning process", listening & nobody),
        ("CRITICAL", "established connection(s) with no owning process", active & nobody),
        ("HIGH", "Socket(s) on ports associated with implants", port.isin(*IMPLANT_PORTS) | peer.isin(*IMPLANT_PORTS)),
        ("HIGH", "Outbound administrative protocol session(s)", peer.isin(*ADMIN_PORTS) & ~F.col("peer_addr").startswith("127.")),
        ("MEDIUM", "connection(s) to non-RFC1918 addresses", active & ~is_private(F.col("peer_addr"))),
        ("LOW", "Service(s) listening on all interfaces", listening & everywhere & ~port.isin(*USUAL_LISTENERS)),
    ]
    hits = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(n).alias("title"))) for s, n, t in rules)))
    return one.withColumn("r", F.explode(hits)).select("r.severity", "r.title", "local_addr", "local_port", "peer_addr", "peer_port", "process")


def modules(listed: DataFrame, sysfs: DataFrame) -> DataFrame:
    """Loaded modules (module) that /sys/module (module) does not have; dashes and underscores are one."""
    same = lambda d: d.withColumn("k", F.replace("module", F.lit("-"), F.lit("_")))
    return same(listed).join(same(sysfs).select("k"), "k", "left_anti").drop("k")
