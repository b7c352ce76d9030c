"""Authorization logs (path, line_no, line) to AUTH_LOG and FAILED_LOGINS, program by program.

A line's program says how its message is to be read: the SSH daemon, sudo, su,
the account tools, PAM modules, polkit and the login manager each have a table
of what their messages begin with. Fields are words by their neighbours
(``from`` an address, ``port`` a number) or ``KEY=value`` lists, not patterns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import clean_address
from ..functions.times import log_timestamp
from ..functions.words import after, at, between, following, has_prefix
from .lines import split_line

# Events and their classes.
CLASSES = {
    "sudo command": "priv", "sudo denied": "priv", "su": "priv", "su failed": "priv", "polkit authorization": "priv", "pkexec": "priv", "run0/systemd-run elevation": "priv",
    "account created": "priv", "account deleted": "priv", "account modified": "priv", "group created": "priv", "group deleted": "priv", "group membership change": "priv", "password changed": "priv",
    "failed password": "auth", "invalid user": "auth", "accepted login": "auth", "public key accepted": "auth", "root login refused": "auth", "max auth attempts": "auth", "connection closed": "auth",
    "session opened": "session", "session closed": "session", "new session": "session", "session removed": "session",
    "authentication failure": "auth", "pam module failure": "auth", "cron session": "session",
}
# Programs that grant or change privileges, and words of failure.
PRIVILEGED = ("sudo", "su", "su-l", "pkexec", "polkitd", "useradd", "userdel", "usermod", "groupadd", "groupdel", "groupmod", "gpasswd", "chage", "passwd", "visudo", "run0")
FAILURE_WORDS = ("fail", "failed", "failure", "denied", "refused", "invalid", "incorrect", "error")
SWITCHERS = ("su", "su-l", "runuser")


def _any(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _event(program: Column, message: Column) -> Column:
    """The event that a message tells of; blank if none."""
    holds = lambda *texts: _any(*(message.contains(t) for t in texts))
    opens = lambda *texts: has_prefix(message, texts)
    daemon = program.startswith("sshd")
    said = F.regexp_replace(message, "^(error|fatal): ", "")
    speaks = lambda *texts: daemon & has_prefix(said, texts)
    elevates, switches = program.contains("sudo"), program.isin(*SWITCHERS)
    cases = [
        # sudo writes one list of settings behind the user's name; a refusal stands before them.
        ("sudo denied", elevates & holds(" incorrect password attempt", "NOT in sudoers", " : command not allowed", "sorry, you must have a tty", "a password is required")),
        ("sudo command", elevates & holds("COMMAND=")),
        ("su", switches & (holds("(to ") | opens("Successful su for "))),
        ("su failed", switches & opens("FAILED su", "FAILED SU")),
        ("pkexec", program.startswith("pkexec") & holds(": Executing command [")),
        ("polkit authorization", program.startswith("polkit") & holds("successfully authenticated as unix-user:", "Registered Authentication Agent")),
        ("run0/systemd-run elevation", program.isin("run0", "systemd-run") & holds(" user ")),
        # The account tools.
        ("account created", opens("new user: ")),
        ("account deleted", opens("delete user '")),
        ("account modified", opens("change user '", "changed shell for ", "changed home directory for ", "changed password expiry for ")),
        ("group created", opens("new group: ")),
        ("group deleted", opens("removed group '") | (opens("group '") & holds("' removed"))),
        ("group membership change", (opens("add '", "delete '") & holds(" group '")) | (opens("user ") & holds(" by ") & holds(" to group ", " from group "))),
        ("password changed", holds("password changed for ")),
        # The SSH daemon.
        ("failed password", speaks("Failed ") & holds(" for ")),
        ("invalid user", speaks("Invalid user ")),
        ("accepted login", speaks("Accepted ")),
        ("public key accepted", speaks("Found matching ")),
        ("root login refused", daemon & (speaks("ROOT LOGIN REFUSED", "Root login rejected") | (speaks("User root from ") & holds(" not allowed")))),
        ("max auth attempts", speaks("maximum authentication attempts exceeded", "Too many authentication failures") | (daemon & holds(": Too many authentication failures"))),
        ("connection closed", speaks("Connection closed by ", "Connection reset by ", "Disconnected from ", "Received disconnect from ", "Disconnecting ")),
        # PAM modules speak for any program; the login manager counts sessions.
        ("session opened", holds("session opened for user ")),
        ("session closed", holds("session closed for user ")),
        ("new session", program.startswith("systemd-logind") & opens("New session ")),
        ("session removed", program.startswith("systemd-logind") & (opens("Removed session ") | (opens("Session ") & holds("logged out")))),
        ("authentication failure", holds("authentication failure;")),
        ("pam module failure", opens("PAM ") & holds(" more authentication failure") | (opens("pam_") & holds("could not identify password", "check pass; user unknown"))),
        ("cron session", opens("pam_unix(cron:session)")),
    ]
    out = F.when(cases[0][1], cases[0][0])
    for label, test in cases[1:]:
        out = out.when(test, label)
    return out.otherwise("")


def _listed(message: Column) -> Column:
    """sudo's settings as a map: what stands between semicolons as ``KEY=value``; a command keeps its own semicolons."""
    head = F.substring_index(message, "COMMAND=", 1)
    pairs = F.filter(F.transform(F.split(head, ";"), lambda x: F.split(F.regexp_replace(F.btrim(x), "^[^=]* : ", ""), "=", 2)), lambda x: F.size(x) == 2)
    return F.map_from_entries(_last_of(pairs))


def _last_of(pairs: Column) -> Column:
    """Pairs (array of two) as entries with distinct keys, of repeated ones the last."""
    keys = F.transform(pairs, lambda x: F.btrim(x[0]))
    last = F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("k"), F.array_max(F.transform(F.sequence(F.lit(1), F.size(keys)), lambda i: F.when(F.element_at(keys, i) == k, i))).alias("i"))))
    return F.transform(F.map_entries(last), lambda e: F.struct(e["key"].alias("k"), F.btrim(F.element_at(pairs, e["value"])[1]).alias("v")))


def _bracketed(message: Column) -> Column:
    """``[KEY=value]`` lists as a map."""
    found = F.regexp_extract_all(message, F.lit(r"\[([A-Z]+=[^\]]*)"), F.lit(1))
    return F.map_from_entries(_last_of(F.transform(found, lambda x: F.split(x, "=", 2))))


def _pair(words: Column, *keys: str) -> Column:
    """The first ``key=value`` among the words, keys in order of choice, with a value that is not blank."""
    value = lambda w: F.btrim(F.get(F.split(w, "=", 2), F.lit(1)), F.lit("\"';,"))
    said = lambda key: F.try_element_at(F.filter(words, lambda w: w.startswith(f"{key}=") & (value(w) != "")), F.lit(1))
    return F.coalesce(*(value(said(k)) for k in keys), F.lit(""))


def _in_quotes(message: Column, i: int) -> Column:
    """What the i-th pair of single quotes holds."""
    return F.coalesce(F.get(F.split(message, "'"), F.lit(2 * i - 1)), F.lit(""))


def auth_log(lines: DataFrame, collected: Column | None = None, host_offset_s: Column | int = 0) -> DataFrame:
    """AUTH_LOG: lines with a header, the event they tell of, and its fields; k=v pairs fill what the event leaves open."""
    # Each step is a generator of one row: its expressions run once, whatever later steps ask of them.
    offset = F.lit(host_offset_s) if isinstance(host_offset_s, int) else host_offset_s
    head = lines.select("path", "line_no", offset.alias("offset_"), F.inline(F.array(split_line(F.col("line"))))).where("timestamp_raw <> '' AND host <> '' AND process <> '' AND process <> 'http'")
    message = F.col("message")
    step = F.struct(F.lower("process").alias("program"), _event(F.lower("process"), message).alias("event"), F.split("message", " ").alias("words"))
    told = head.select("offset_", "timestamp_raw", "host", "process", "pid", "message", F.col("path").alias("source"), "line_no", F.inline(F.array(step)))
    event, words = F.col("event"), F.col("words")
    sudo, exec_ = F.when(event == "sudo command", _listed(message)), F.when(event == "pkexec", _bracketed(message))
    told = told.withColumn("listed", F.coalesce(sudo, exec_, F.create_map().cast("map<string,string>")))
    key = lambda name: F.coalesce(F.try_element_at("listed", F.lit(name)), F.lit(""))
    asked = F.when(message.contains("invalid user "), at(F.split(after(message, "invalid user "), " "), 1))
    account = F.when(message.contains(" user "), at(F.split(after(message, " user "), " "), 1))
    named = F.when(message.contains("name="), F.substring_index(after(message, "name="), ",", 1))
    trimmed = lambda x: F.substring_index(F.substring_index(F.rtrim(x, F.lit(".,")), "(", 1), ",", 1)
    both = message.contains(" by ")
    user = (
        F.when(event.startswith("sudo"), F.btrim(F.substring_index(message, " : ", 1)))
        .when(event == "su", F.when(message.contains("(to "), at(F.split(F.btrim(after(message, ")")), " "), 1)).otherwise(following(words, "by")))
        .when(event == "su failed", following(words, "by"))
        .when(event == "pkexec", F.substring_index(message, ":", 1))
        .when(event == "polkit authorization", at(F.split(after(message, "unix-user:"), " "), 1))
        .when(event == "group membership change", F.when(both, following(words, "by")).otherwise(""))
        .when(event == "failed password", F.coalesce(asked, following(words, "for")))
        .when(event == "invalid user", at(F.split(after(message, "user "), " "), 1))
        .when(event.isin("accepted login", "max auth attempts"), F.coalesce(asked, following(words, "for")))
        .when(event == "connection closed", F.coalesce(account, F.lit("")))
        .when(event.isin("session opened", "session closed", "new session"), trimmed(F.coalesce(account, F.lit(""))))
        .otherwise("")
    )
    target = (
        F.when(event.isin("sudo command", "pkexec"), key("USER"))
        .when(event == "su", F.when(message.contains("(to "), between(message, "(to ", ")")).otherwise(following(words, "for")))
        .when(event == "su failed", following(words, "for"))
        .when(event.isin("account created", "group created"), F.coalesce(named, F.lit("")))
        .when(event.isin("account deleted", "group deleted"), _in_quotes(message, 1))
        .when(event == "account modified", F.when(message.contains("'"), _in_quotes(message, 1)).otherwise(following(words, "for")))
        .when(event == "group membership change", F.when(both, following(words, "user")).otherwise(_in_quotes(message, 1)))
        .when(event == "password changed", trimmed(at(F.split(after(message, "password changed for "), " "), 1)))
        .when(event == "run0/systemd-run elevation", F.coalesce(account, F.lit("")))
        .otherwise("")
    )
    group = F.when(event == "group membership change", F.when(both, following(words, "group")).otherwise(_in_quotes(message, 2))).otherwise("")
    remote = event.isin("failed password", "invalid user", "accepted login", "root login refused", "max auth attempts", "connection closed")
    address = F.when(remote, F.coalesce(F.nullif(following(words, "port", -1), F.lit("")), F.nullif(following(words, "from"), F.lit("")), F.nullif(following(words, "by"), F.lit("")))).otherwise("")
    or_pair = lambda value, *keys: F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(_pair(words, *keys))
    classes = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    kind = F.coalesce(F.try_element_at(classes, event), F.lit(""))
    failing = F.arrays_overlap(F.split(F.lower(message), "[^a-z]+"), F.array(*map(F.lit, FAILURE_WORDS))) | F.lower(message).contains("not in sudoers")
    return told.select(
        log_timestamp(F.col("timestamp_raw"), F.col("offset_"), collected).alias("timestamp_utc"),
        "timestamp_raw", "host", "process", "pid", "event",
        F.when((kind == "") & F.split("program", r"[^a-z0-9-]")[0].isin(*PRIVILEGED), "priv").otherwise(kind).alias("event_class"),
        or_pair(user, "user", "acct", "ruser", "logname").alias("user"),
        F.coalesce(target, F.lit("")).alias("target_user"),
        F.coalesce(group, F.lit("")).alias("target_group"),
        clean_address(or_pair(address, "rhost")).alias("source_ip"),
        F.when(remote, F.regexp_extract(following(words, "port"), "^[0-9]+", 0)).otherwise("").alias("port"),
        or_pair(key("TTY"), "tty").alias("tty"),
        F.when(event == "pkexec", key("CWD")).otherwise(key("PWD")).alias("pwd"),
        F.when(event == "sudo command", after(message, "COMMAND=")).otherwise(key("COMMAND")).alias("command"),
        F.when(failing, "failure").when(event != "", "success").otherwise("").alias("result"),
        "message", "source", "line_no",
    )


def failed_logins(auth: DataFrame) -> DataFrame:
    """FAILED_LOGINS from AUTH_LOG rows: why, who, from where."""
    event, message = F.col("event"), F.col("message")
    method = F.when(event == "failed password", F.split(message, " ")[1]).otherwise("")
    early = message.contains("[preauth]") | message.contains(" authenticating user ") | message.contains(" invalid user ")
    console = has_prefix(message, ("FAILED LOGIN", "LOGIN FAILURE", "authentication error"))
    switched = F.lower("process").isin(*SWITCHERS) & has_prefix(message, ("FAILED su", "FAILED SU"))
    kind = (
        F.when(event == "failed password", F.when(method == "password", "bad password").otherwise("bad key"))
        .when((event == "invalid user") | message.contains("check pass; user unknown"), "unknown account")
        .when(message.contains("authentication failure;"), "pam authentication failure")
        .when(event == "max auth attempts", "too many attempts")
        .when(event == "root login refused", "root login refused")
        .when((message.startswith("User ") & message.contains(" not allowed because")) | message.startswith("Authentication refused") | (message.startswith("pam_access(") & message.contains(": access denied")), "account not permitted")
        .when((event == "connection closed") & early, "aborted before authenticating")
        .when((event == "sudo denied") & message.contains("incorrect password attempt"), "sudo password failure")
        .when((event == "sudo denied") & (message.contains("NOT in sudoers") | message.contains("command not allowed")), "sudo not permitted")
        .when(switched, "su failure")
        .when(console, "failed login")
    )
    words, named = F.split(message, " "), kind
    kind = F.col("kind")
    denied = kind.isin("sudo password failure", "sudo not permitted")
    detail = F.when(denied, F.btrim(F.substring_index(after(message, " : "), " ;", 1))).otherwise("")
    user = (
        F.when(kind == "pam authentication failure", "")
        .when(kind == "su failure", F.when(message.contains("(to "), F.col("target_user")).otherwise(F.col("user")))
        .when(kind == "account not permitted", following(words, "User"))
        .when(kind == "failed login", F.btrim(following(words, "FOR"), F.lit("',\"")))
        .when((kind == "unknown account") & (event != "invalid user"), "")
        .otherwise(F.col("user"))
    )
    source = F.when(kind == "pam authentication failure", "").when(kind == "account not permitted", following(words, "from")).when(kind == "failed login", F.btrim(following(words, "FROM"), F.lit("',\""))).otherwise(F.col("source_ip"))
    found = auth.select("*", F.explode(F.array(named)).alias("kind")).where("kind IS NOT NULL")
    return found.select("timestamp_utc", "kind", user.alias("user"), clean_address(source).alias("source_ip"), "port", method.alias("method"), detail.alias("detail"), F.col("process").alias("service"), "source", "line_no")
