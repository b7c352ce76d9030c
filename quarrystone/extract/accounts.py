"""Account files to USERS, GROUPS, SUDOERS, SSH keys and CRON; joins are on names, with counts grouped first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import epoch

# Groups that give privilege; shells that let nobody in.
PRIVILEGED = ("root", "sudo", "wheel", "admin", "adm", "docker", "lxd", "disk", "shadow", "kmem", "video", "libvirt", "systemd-journal", "netdev", "staff", "sys", "bin")
NO_LOGIN = ("nologin", "false", "sync", "shutdown", "halt")


def _fields(line: Column, n: int) -> list[Column]:
    parts = F.split(line, ":")
    return [F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit("")) for i in range(n)]


def _entries(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line").contains(":") & ~F.btrim("line").startswith("#"))


def passwd(lines: DataFrame) -> DataFrame:
    f = _fields(F.col("line"), 7)
    shell = F.element_at(F.split(f[6], "/"), -1)
    return _entries(lines).select(
        f[0].alias("username"), f[2].try_cast("int").alias("uid"), f[3].try_cast("int").alias("gid"), f[4].alias("gecos"), f[5].alias("home"), f[6].alias("shell"), (~shell.isin(*NO_LOGIN) & (f[6] != "")).alias("login_capable")
    )


def shadow(lines: DataFrame) -> DataFrame:
    f = _fields(F.col("line"), 8)
    status = F.when(f[1] == "", "EMPTY").when(f[1].startswith("!") | f[1].startswith("*"), "locked").when(f[1].startswith("$"), "set").otherwise("other")
    days = lambda c: epoch((c.try_cast("long") * 86_400).cast("string"))
    return _entries(lines).select(f[0].alias("username"), status.alias("password_status"), days(f[2]).alias("last_change"), f[3].alias("min"), f[4].alias("max"), f[5].alias("warn"), f[6].alias("inactive"), days(f[7]).alias("expire"))


def groups(lines: DataFrame) -> DataFrame:
    f = _fields(F.col("line"), 4)
    members = F.filter(F.transform(F.split(f[3], ","), F.btrim), lambda m: m != "")
    return _entries(lines).select(f[0].alias("group"), f[2].try_cast("int").alias("gid"), F.array_join(members, ", ").alias("members"), F.size(members).alias("member_count"), members.alias("member_list"))


def users(passwd_rows: DataFrame, shadow_rows: DataFrame, group_rows: DataFrame, counts: dict[str, DataFrame] | None = None) -> DataFrame:
    """USERS: passwd with shadow, groups, and ``counts``: column name to a table with a ``username`` column, whose rows are counted."""
    first = shadow_rows.dropDuplicates(["username"])
    of = group_rows.select("group", F.explode("member_list").alias("username")).distinct()
    primary = group_rows.groupBy("gid").agg(F.min("group").alias("primary_group"))
    joined = passwd_rows.join(first, "username", "left").join(primary, "gid", "left")
    own = of.unionByName(joined.where("primary_group IS NOT NULL").select(F.col("primary_group").alias("group"), "username")).groupBy("username").agg(F.sort_array(F.collect_set("group")).alias("groups"))
    privileged = F.array(*map(F.lit, PRIVILEGED))
    out = joined.join(own, "username", "left").withColumn("all_groups", F.array_join("groups", ", ")).withColumn("privileged_groups", F.array_join(F.array_intersect("groups", privileged), ", ")).drop("groups")
    for name, rows in (counts or {}).items():
        out = out.join(rows.groupBy("username").agg(F.count("*").alias(name)), "username", "left").fillna(0, [name])
    return out


def account_findings(users_rows: DataFrame, backup: DataFrame | None = None) -> DataFrame:
    """(severity, title, username): uid 0, shared uids, system accounts with a shell, empty passwords, privileged members, accounts not in the backup."""
    shared = users_rows.groupBy("uid").agg(F.count("*").alias("n")).where("n > 1 AND uid IS NOT NULL").select("uid")
    rules = [
        (users_rows.where("uid = 0 AND username <> 'root'"), "CRITICAL", "Non-root account(s) with uid 0"),
        (users_rows.join(shared, "uid", "left_semi"), "HIGH", "Duplicate uid(s) in /etc/passwd"),
        (users_rows.where("uid > 0 AND uid < 1000 AND login_capable"), "MEDIUM", "System account(s) with an interactive shell"),
        (users_rows.where("password_status = 'EMPTY'"), "CRITICAL", "Account(s) with an empty password hash"),
        (users_rows.where("privileged_groups <> ''"), "MEDIUM", "Membership of privileged groups"),
    ]
    if backup is not None:
        rules.append((users_rows.join(backup.select("username"), "username", "left_anti"), "MEDIUM", "Account(s) present in /etc/passwd but not in the backup copy"))
    parts = [df.select(F.lit(s).alias("severity"), F.lit("Account").alias("category"), F.lit(t).alias("title"), "username") for df, s, t in rules]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sudoers(lines: DataFrame) -> DataFrame:
    s = F.btrim("line")
    rule = lines.where((s != "") & ~s.startswith("#"))
    return rule.select(F.col("path").alias("file"), "line_no", F.regexp_replace(s, r"\s+", " ").alias("rule"), (s.contains("NOPASSWD") | s.contains("!authenticate")).alias("nopasswd"))


def ssh_keys(lines: DataFrame) -> DataFrame:
    """Authorized keys: type from the key's own header, body, comment."""
    s = F.btrim("line")
    token = F.element_at(F.filter(F.split(s, r"\s+"), lambda t: t.rlike("^AAAA[A-Za-z0-9+/=]{36,}$")), 1)
    head = F.unbase64(F.substring(token, 1, 52))
    size = F.conv(F.hex(F.substring(head, 1, 4)), 16, 10).cast("int")
    rows = lines.where((s != "") & ~s.startswith("#") & s.rlike(r"(^|\s)AAAA[A-Za-z0-9+/=]{36,}"))
    return rows.select("path", "line_no", F.decode(F.substr(head, F.lit(5), F.least(size, F.lit(64))), "UTF-8").alias("key_type"), token.alias("key"), F.btrim(F.regexp_extract(s, r"AAAA\S+\s*(.*)$", 1)).alias("comment"))


MACRO = r"^(@\w+)\s+(.*)$"
FIELDS = r"^((?:\S+\s+){5})(.*)$"


def cron(lines: DataFrame) -> DataFrame:
    """CRON: five fields or a macro; the system's own tables name the account after them; NAME=value lines are environment."""
    s = F.btrim("line")
    kept = lines.where((s != "") & ~s.startswith("#"))
    system = F.col("path").rlike(r"/etc/(crontab|cron\.d/)")
    env, macro, fields = s.rlike(r"^[A-Za-z_]\w*\s*="), s.rlike(MACRO), s.rlike(FIELDS)
    rest = F.when(macro, F.regexp_extract(s, MACRO, 2)).otherwise(F.regexp_extract(s, FIELDS, 2))
    kind = F.when(env, "environment").when(macro | fields, "crontab").otherwise("script")
    timed = kind == "crontab"
    return kept.select(
        F.col("path").alias("file"),
        kind.alias("kind"),
        F.when(timed & macro, F.regexp_extract(s, MACRO, 1)).when(timed, F.btrim(F.regexp_extract(s, FIELDS, 1))).otherwise("").alias("schedule"),
        F.when(timed & system, F.regexp_extract(rest, r"^(\S+)", 1)).when(timed, F.element_at(F.split("path", "/"), -1)).otherwise("").alias("run_as"),
        F.when(timed & system, F.btrim(F.regexp_extract(rest, r"^\S+\s+(.*)$", 1))).when(timed, rest).otherwise(s).alias("command"),
        "line_no",
    )
