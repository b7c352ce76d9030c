"""What several hosts share. Input tables carry a ``host`` column; every result is a grouped aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Longest time between two hops of one route, in seconds.
HOP_GAP = 86_400
# Places whose files are worth a second look.
NOTABLE_DIRS = ("/tmp/", "/var/tmp/", "/dev/shm/", "/home/", "/root/", "/srv/", "/opt/", "/var/www/", "/usr/local/")

# Sudo rules that systems are shipped with, and accounts of theirs that look like a person's.
STOCK_RULES = (
    "root ALL=(ALL) ALL", "root ALL=(ALL:ALL) ALL", "%admin ALL=(ALL) ALL", "%admin ALL=(ALL:ALL) ALL", "%sudo ALL=(ALL) ALL", "%sudo ALL=(ALL:ALL) ALL",
    "%wheel ALL=(ALL) ALL", "%wheel ALL=(ALL:ALL) ALL", "%wheel ALL=(ALL) NOPASSWD: ALL",
)
STOCK_ACCOUNTS = ("root", "nobody", "sync", "shutdown", "halt", "operator")
SYSTEM_UID_MAX = 999


def notable(path: Column) -> Column:
    return reduce(lambda a, b: a | b, [path.startswith(d) for d in NOTABLE_DIRS])


def joined(c: str) -> Column:
    return F.array_join(F.sort_array(F.collect_set(c)), ", ")


def on_hosts(rows: DataFrame, keys: list[str], *more: Column, least: int = 2) -> DataFrame:
    """Keys seen on ``least`` hosts or more: host_count, hosts, and ``more`` aggregates."""
    return rows.groupBy(*keys).agg(F.count_distinct("host").alias("host_count"), joined("host").alias("hosts"), *more).where(F.col("host_count") >= least)


def shared_indicators(iocs: DataFrame) -> DataFrame:
    """(host, value, why, count, first, last) to one row per value on several hosts: where it was first and last, and how far apart.

    Hosts are summed up first, so a value that one host has a million times is one row before the second shuffle.
    """
    per = iocs.groupBy("value", "host").agg(F.sum("count").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.collect_set("why").alias("why"))
    return (
        per.groupBy("value")
        .agg(
            F.count("*").alias("host_count"),
            joined("host").alias("hosts"),
            F.min_by("host", F.when(F.col("first").isNotNull(), F.struct("first", "host"))).alias("first_host"),
            F.min("first").alias("first_utc"),
            F.max_by("host", F.when(F.col("last").isNotNull(), F.struct("last", "host"))).alias("last_host"),
            F.max("last").alias("last_utc"),
            F.sum("n").alias("total_mentions"),
            F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("why")))), "; ").alias("why"),
            F.array_join(F.sort_array(F.collect_list(F.concat_ws(": ", "host", F.col("n").cast("string")))), ", ").alias("per_host"),
        )
        .where("host_count >= 2")
    )


def shared_findings(findings: DataFrame) -> DataFrame:
    """(host, severity, category, title, count) by category and title without its numbers, on several hosts, worst severity first."""
    from .entities import severity_rank, worst

    masked = findings.withColumn("finding", mask_digits(F.col("title")))
    shared = on_hosts(masked, ["category", "finding"], worst(F.col("severity")).alias("severity"), F.sum("count").alias("total_occurrences"))
    return shared.orderBy(severity_rank(F.col("severity")), F.desc("host_count"), "category", "finding")


def mask_digits(title: Column) -> Column:
    return F.regexp_replace(title, r"\d[\d,]*", "#")


def shared_hashes(files: DataFrame, packaged: int | None = None) -> DataFrame:
    """(host, path, digest) by digest on several hosts; with ``packaged``, of those only in packaged places so many, the most spread."""
    rows = on_hosts(
        files.withColumn("digest", F.lower("digest")),
        ["digest"],
        F.bool_or(notable(F.col("path"))).alias("notable"),
        (F.count_distinct("path") == 1).alias("same_path"),
        joined("path").alias("paths"),
    )
    if packaged is None:
        return rows
    few = rows.where(~F.col("notable")).orderBy(F.desc("same_path"), F.desc("host_count"), "digest").limit(packaged)
    return rows.where("notable").unionByName(few)


def transfers(files: DataFrame) -> DataFrame:
    """(host, path, digest, crtime, mtime) to digests that one host had before another: from, to, when, on what clock."""
    per = files.where(notable(F.col("path"))).withColumn("when", F.coalesce("crtime", "mtime")).withColumn("basis", F.when(F.col("crtime").isNotNull(), "crtime").otherwise("mtime"))
    first = per.where(F.col("when").isNotNull()).groupBy("digest", "host").agg(F.min(F.struct("when", "path", "basis")).alias("f"))
    ends = first.groupBy("digest").agg(
        F.min(F.struct("f.when", "host", "f.path", "f.basis")).alias("a"), F.max(F.struct("f.when", "host", "f.path", "f.basis")).alias("b"), F.count("*").alias("host_count")
    )
    basis = F.when((F.col("a.basis") == "crtime") & (F.col("b.basis") == "crtime"), "crtime").otherwise("mtime")
    return ends.where("host_count >= 2 AND a.when < b.when").select(
        "digest", F.col("a.host").alias("from_host"), F.col("b.host").alias("to_host"), F.col("a.when").alias("first_utc"), F.col("b.when").alias("last_utc"), basis.alias("basis"), F.col("a.path").alias("from_path"), F.col("b.path").alias("to_path"), "host_count"
    )


def routes(legs: DataFrame) -> DataFrame:
    """Two-hop routes from legs (from_host, to_host, ts, user, ok): each leg into a host with the first leg out of it
    at or after, within HOP_GAP, to a third host.

    Equal legs are one row with their number, counted by hash and written once for all that reads them, so the rest
    grows with the different legs only. Time is cut into steps of HOP_GAP, and a leg out stands in its own
    step and the one before, so a leg in has all that may follow it in its own: it is stacked with the legs out of
    those third hosts only that have one there, and the earliest is one running window in reversed time.
    A host's key is a step long, however busy the host. Null hosts and times have no routes.
    """
    each = legs.where("from_host IS NOT NULL AND to_host IS NOT NULL AND ts IS NOT NULL").groupBy("from_host", "to_host", "ts", "user", "ok").agg(F.count("*").alias("n"))
    each = written(each, "legs")
    step = F.floor(F.unix_seconds("ts") / HOP_GAP)
    out = F.min(F.struct("ts", "user", "ok")).alias("out")
    outs = each.groupBy(F.col("from_host").alias("mid"), F.col("to_host").alias("c"), "ts").agg(out).withColumn("step", F.explode(F.array(step, step - 1)))
    ends = outs.select("mid", "step", "c").distinct()
    ins = each.groupBy(F.col("to_host").alias("mid"), F.col("from_host").alias("a"), "ts", "ok").agg(F.sum("n").alias("n")).withColumn("step", step)
    ins = ins.select("mid", "step", "a", "ts", F.struct("ts", "ok", "n").alias("in")).join(ends, ["mid", "step"]).where("a <> c")
    both = ins.unionByName(outs, allowMissingColumns=True).withColumn("at", F.unix_seconds("ts"))
    w = Window.partitionBy("mid", "c", "step").orderBy(F.desc("at"), F.col("in").isNotNull(), F.desc("out")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chained = both.withColumn("nxt", F.last("out", ignorenulls=True).over(w)).where("in IS NOT NULL AND nxt IS NOT NULL")
    gap = F.unix_seconds("nxt.ts") - F.col("at")
    found = chained.where(gap <= HOP_GAP).groupBy("a", "mid", "c").agg(
        F.sum("in.n").alias("chains"), F.min("in.ts").alias("first_utc"), F.max("nxt.ts").alias("last_utc"), F.bool_or(F.col("in.ok") & F.col("nxt.ok")).alias("reached"), F.min(gap).alias("tightest")
    )
    return found.select(F.concat_ws(" -> ", "a", "mid", "c").alias("path"), "chains", "first_utc", "last_utc", "reached", "tightest")


def sign_ins(sessions: DataFrame, identities: DataFrame) -> DataFrame:
    """Sign-ins (host, user, source, ts, result) whose source is another host: ``identities`` has (host, token)."""
    names = identities.groupBy(F.lower("token").alias("token")).agg(F.min("host").alias("from_host"))
    return sessions.join(names, F.lower("source") == F.col("token")).where("from_host <> host").select("ts", "from_host", F.col("host").alias("to_host"), "user", "result", ~F.lower("result").contains("fail"))


def missing_from(rows: DataFrame, key: str) -> DataFrame:
    """Each key with the hosts that have it and those that have not."""
    every = rows.agg(F.sort_array(F.collect_set("host")).alias("all_hosts"))
    per = rows.groupBy(key).agg(F.sort_array(F.collect_set("host")).alias("have"))
    return per.crossJoin(F.broadcast(every)).select(key, F.size("have").alias("host_count"), F.array_join("have", ", ").alias("hosts"), F.array_join(F.array_except("all_hosts", "have"), ", ").alias("missing_from"))  # one row


def consistency(accounts: DataFrame, name: str, attributes: list[str]) -> DataFrame:
    """Names on several hosts, and whether each attribute is the same on all."""
    same = [(F.count_distinct(F.coalesce(F.col(a).cast("string"), F.lit(""))) == 1).alias(f"same_{a}") for a in attributes]
    return on_hosts(accounts, [name], *same).withColumn("consistent", reduce(lambda a, b: a & b, [F.col(f"same_{a}") for a in attributes]))


def web_clients(requests: DataFrame, keys: list[str], per_host: int | None = None, most: int | None = None) -> DataFrame:
    """Requests (host, *keys, status, ts) by keys on several hosts; where they are given, each host brings
    its ``per_host`` most frequent only, and the ``most`` widest are shown."""
    ok = F.col("status").between(200, 399)
    one = requests.groupBy("host", *keys).agg(F.count("*").alias("n"), F.count_if(ok).alias("answered"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    if per_host is not None:
        w = Window.partitionBy("host").orderBy(F.desc("n"), *keys)
        one = one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_host)
    shared = on_hosts(one, keys, F.sum("n").alias("requests"), F.sum("answered").alias("answered"), F.min("first").alias("first_utc"), F.max("last").alias("last_utc"))
    return shared if most is None else shared.orderBy(F.desc("host_count"), F.desc("requests"), *keys).limit(most)


def one_per_act(rows: DataFrame) -> DataFrame:
    """Timeline rows (ts, from_host, to_host, event, detail, basis) as one per act, with all that it rests on."""
    subject = F.split(F.col("detail"), " over ")[0]
    return rows.groupBy("ts", "from_host", "to_host", "event", subject.alias("detail")).agg(F.array_join(F.sort_array(F.collect_set("basis")), "; ").alias("basis"))


def commands_naming_hosts(commands: DataFrame, identities: DataFrame, keys: list[str], host: str = "host", command: str = "command") -> DataFrame:
    """CROSS_COMMANDS: commands (keys, host, command) that name another host, once for each: keys, host, named_host, token, command.

    A command's distinct tokens (words between blanks, quotes and the like, cut at
    ``@``, ``/`` and ports) meet the hosts' names and addresses (host, value) in a
    hash join. The shortest token that names a host is shown.
    """
    cut = lambda text: F.split(F.lower(text), r"[^a-z0-9._:-]+")
    words = F.array_union(cut(F.col(command)), cut(F.regexp_replace(F.col(command), r":[0-9]+(?![0-9.])", " ")))  # with ports and without
    tokens = F.filter(F.array_distinct(F.transform(words, lambda t: F.rtrim(F.btrim(t, F.lit(".-")), F.lit(":")))), lambda t: F.length(t) > 1)
    said = commands.select(*keys, F.col(host).alias("host"), F.col(command).alias("command"), F.explode(tokens).alias("token"))
    known = identities.select(F.lower("value").alias("token"), F.col("host").alias("named_host")).where("token <> ''").distinct()
    met = said.join(known, "token").where(~F.col("host").eqNullSafe(F.col("named_host")))
    return met.groupBy(*keys, "host", "named_host").agg(F.min(F.struct(F.length("token").alias("n"), "token")).getField("token").alias("token"), F.first("command").alias("command"))


def _placed() -> Column:
    """``host: where`` of each host, in order."""
    places = F.sort_array(F.collect_set(F.struct(F.col("host").alias("h"), F.coalesce("where", F.lit("")).alias("w"))))
    return F.array_join(F.transform(places, lambda x: F.concat_ws(": ", x["h"], x["w"])), " | ").alias("where")


def shared_grants(rules: DataFrame, members: DataFrame, accounts: DataFrame) -> DataFrame:
    """CROSS_PRIVILEGE: sudo rules (host, rule, where, nopasswd) and members of groups (host, group, member, where) that several hosts have.

    ``notable``: somebody decided it. A rule is notable if it is passwordless on any
    host or none that systems ship with; a member if some host knows the account
    (host, username, uid) as a person's or as uid 0. Each host is summed up first,
    by the least of its places, so a rule repeated in a file is one row.
    """
    text = F.btrim(F.regexp_replace("rule", r"\s+", " "))
    ruled = rules.select("host", F.lit("sudoers").alias("kind"), text.alias("grant"), F.lit(None).cast("string").alias("member"), "where", F.coalesce("nopasswd", F.lit(False)).alias("free"))
    named = members.select("host", F.lit("group").alias("kind"), F.concat_ws(": ", "group", "member").alias("grant"), F.col("member").cast("string").alias("member"), "where", F.lit(False).alias("free"))
    per = ruled.unionByName(named).where("host IS NOT NULL AND grant <> ''").groupBy("kind", "grant", "member", "host").agg(F.min("where").alias("where"), F.bool_or("free").alias("free"))
    shared = on_hosts(per, ["kind", "grant", "member"], F.bool_or("free").alias("nopasswd"), _placed())
    uid = F.col("uid").try_cast("long")
    people = accounts.where((uid == 0) | (uid > SYSTEM_UID_MAX)).where(~F.col("username").isin(*STOCK_ACCOUNTS)).select(F.col("username").alias("member")).distinct().withColumn("person", F.lit(True))
    judged = shared.join(people, "member", "left")
    chosen = F.when(F.col("kind") == "sudoers", F.col("nopasswd") | ~F.col("grant").isin(*STOCK_RULES)).otherwise(F.coalesce("person", F.lit(False)))
    return judged.select("kind", "grant", "host_count", "hosts", chosen.alias("notable"), "nopasswd", "where")


def shared_autostarts(entries: DataFrame) -> DataFrame:
    """CROSS_PERSISTENCE: autostart entries (host, kind, value, where) that several hosts have.

    ``notable``: a preload, a command from a place that packages do not install
    to, or one that feeds what it fetches or decodes to an interpreter.
    """
    shared = on_hosts(entries.where("host IS NOT NULL AND value <> ''").groupBy("kind", "value", "host").agg(F.min("where").alias("where")), ["kind", "value"], _placed())
    return shared.select("kind", "value", "host_count", "hosts", ((F.col("kind") == "ld.so.preload") | _of_somebody(F.col("value"))).alias("notable"), "where")


def _of_somebody(command: Column) -> Column:
    words = F.filter(F.split(F.lower(command), r"[^a-z0-9_.-]+"), lambda w: w != "")
    feeds = F.transform(F.split(F.lower(command), r"[;&]+"), lambda part: F.transform(F.split(part, r"\|"), lambda stage: F.filter(F.split(stage, r"[^a-z0-9_.-]+"), lambda w: w != "")))
    fetches = lambda stage: F.arrays_overlap(stage, F.array(*map(F.lit, ("curl", "wget", "fetch"))))
    runner = lambda stage: F.coalesce(F.when(F.get(stage, F.lit(0)) == "sudo", F.get(stage, F.lit(1))).otherwise(F.get(stage, F.lit(0))), F.lit("")).isin("sh", "bash", "dash", "ksh", "zsh")
    piped = F.exists(feeds, lambda stages: F.exists(F.sequence(F.lit(1), F.greatest(F.size(stages) - 1, F.lit(1))), lambda i: F.coalesce(fetches(F.get(stages, i - 1)) & runner(F.get(stages, i)), F.lit(False))))
    pair = lambda first, then: F.exists(F.arrays_zip(words.alias("a"), F.slice(words, 2, 1 << 20).alias("b")), lambda x: first(x["a"]) & (x["b"] == then))
    inline = pair(lambda a: F.translate(a, "0123456789", "") == "python", "-c") | pair(lambda a: a == "base64", "-d")
    from_place = reduce(lambda a, b: a | b, [command.contains(d) for d in NOTABLE_DIRS])
    return from_place | F.coalesce(piped | inline, F.lit(False))


def shared_findings_of(rows: DataFrame, urgent: Column, titles: tuple[str, str]) -> DataFrame:
    """severity, category, title, count of shared grants or autostarts: those that somebody decided (HIGH if any is ``urgent``), and the rest."""
    found = rows.groupBy("notable").agg(F.count("*").alias("count"), F.bool_or(F.coalesce(urgent, F.lit(False))).alias("urgent"))
    severity = F.when(F.col("notable") & F.col("urgent"), "HIGH").when(F.col("notable"), "MEDIUM").otherwise("INFO")
    title = F.replace(F.when(F.col("notable"), titles[0]).otherwise(titles[1]), F.lit("%d"), F.col("count").cast("string"))
    return found.select(severity.alias("severity"), F.lit("Correlation").alias("category"), title.alias("title"), "count")


# Titles of findings on what hosts share.
GRANT_TITLES = ("%d privilege grant(s) somebody added are identical across these hosts", "%d further privilege grant(s) are identical across these hosts")
AUTOSTART_TITLES = ("%d autostart entry(ies) somebody added appear on more than one host", "%d further autostart entry(ies) appear on more than one host")
