"""Names of offensive tools in cells of any table: hits with their place, samples with exact counts, distinct references.

A cell is (table, column, kind, value, ts); its kind is ``command``, ``path`` or
``text``. Names that nobody uses for anything else count anywhere; in commands and
paths, digits and marks may touch them (linpeas_amd64). Names that are ordinary
words count only where they name a program: as the last part of a path, as a
file name, or as the first word of a command or after a word that runs others;
never as an account (john@db), as data (gost.so), or in a folder of the
distribution or of a package manager. A cell counts once for each category.

Every cell is scanned once by two expressions, however many names there are. Null
and blank values have no hits, equal cells count each, a null ts is no time, and
columns beyond these five are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entities import SEVERITIES, severity_rank, worst
from .sweeps import any_of

Names = dict[str, tuple[str, ...]]

# Names by category, unmistakable ones and ordinary words; severities; folders; words that run others; suffixes.
UNMISTAKABLE: Names = {
    "credential access": ("mimikatz", "mimipenguin", "mimidump", "lazagne", "secretsdump", "gosecretsdump", "hashdump", "pypykatz", "kerberoast", "asreproast", "dumpert", "nanodump", "procdump", "keethief", "lsassy", "hekatomb", "certipy", "gettgtpkinit", "krbrelayx", "ticketer", "getnpusers", "getuserspns", "dcsync", "ntdsutil", "ntds.dit", "creddump7", "chntpw", "unshadow", "hashcat", "johntheripper"),
    "privilege escalation enumeration": ("linpeas", "winpeas", "linenum", "lse.sh", "linux-smart-enumeration", "unix-privesc-check", "linux-exploit-suggester", "les.sh", "pspy", "gtfoblookup", "beroot", "privesccheck", "suid3num", "sudo_killer", "sudokiller"),
    "active directory attack": ("bloodhound", "sharphound", "azurehound", "rusthound", "soaphound", "crackmapexec", "netexec", "smbmap", "smbexec", "wmiexec", "psexec", "atexec", "dcomexec", "evil-winrm", "kerbrute", "rubeus", "impacket", "ntlmrelayx", "mitm6", "petitpotam", "printnightmare", "zerologon", "nopac", "adidnsdump", "windapsearch", "ldapdomaindump"),
    "command and control": ("meterpreter", "msfvenom", "msfconsole", "metasploit", "cobaltstrike", "cobalt strike", "teamserver", "beacon.dll", "sliver-client", "sliver-server", "poshc2", "brute ratel", "bruteratel", "havoc-client", "koadic", "pupy", "hoaxshell", "ligolo", "revsocks", "frpc", "frps", "sshuttle", "ngrok", "cloudflared tunnel", "pivotnacci", "regeorg", "neo-regeorg", "tunna"),
    "scanning and exploitation": ("masscan", "zmap", "nuclei", "gobuster", "feroxbuster", "dirbuster", "wfuzz", "sqlmap", "nikto", "wpscan", "joomscan", "commix", "xsstrike", "searchsploit", "exploitdb", "routersploit", "arachni", "whatweb", "enum4linux", "smbclient -n", "onesixtyone", "snmpwalk -c public"),
    "webshell": ("c99shell", "r57shell", "b374k", "weevely", "wso shell", "antsword", "behinder", "godzilla webshell", "chinachopper", "china chopper", "phpspy", "wsomanager", "indoxploit", "alfashell", "marijuana shell"),
    "cryptomining": ("xmrig", "minerd", "cpuminer", "nbminer", "phoenixminer", "ethminer", "lolminer", "t-rex miner", "nanominer", "xmr-stak", "cgminer"),
    "container escape": ("deepce", "amicontained", "cdk-team", "botb ", "break-out-the-box", "kubeletctl", "peirates"),
    "exfiltration staging": ("rclone copy", "megatools", "transfer.sh", "filebin", "0x0.st", "termbin", "oshi.at"),
}
ORDINARY: Names = {
    "credential access": ("john", "hydra", "medusa", "patator", "crowbar", "cewl", "ophcrack"),
    "active directory attack": ("certify", "seatbelt", "sharpview", "responder"),
    "privilege escalation enumeration": ("traitor",),
    "command and control": ("empire", "sliver", "havoc", "merlin", "beacon", "silenttrinity", "quasar", "gost", "chisel", "covenant", "villain", "mythic"),
    "scanning and exploitation": ("nmap", "dirb", "ffuf", "amass", "subfinder", "arjun", "dalfox"),
    "container escape": ("cdk",),
}
BASE_SEVERITY = {"credential access": "CRITICAL", "active directory attack": "HIGH", "command and control": "CRITICAL", "privilege escalation enumeration": "HIGH", "scanning and exploitation": "HIGH", "webshell": "CRITICAL", "cryptomining": "CRITICAL", "container escape": "HIGH", "exfiltration staging": "HIGH"}
DISTRIBUTION = ("/usr/share/", "/usr/src/", "/usr/lib/", "/usr/include/", "/lib/", "/lib64/", "/usr/share/man/", "/usr/share/doc/", "/usr/lib64/", "/usr/lib32/", "/usr/libexec/", "/opt/rh/", "/var/lib/dpkg/", "/var/lib/rpm/", "/snap/", "/etc/alternatives/")
DEPENDENCIES = ("/node_modules/", "/site-packages/", "/dist-packages/", "/vendor/", "/.git/", "/.cache/", "/.npm/", "/.cargo/", "/.m2/", "/gems/", "/bower_components/", "/.venv/", "/virtualenv/", "/.gradle/", "/.nuget/", "/target/classes/", "/pkg/mod/", "/.pub-cache/", "/wp-content/", "/.terraform/")
RUNNERS = ("sudo", "doas", "su", "nohup", "setsid", "exec", "env", "time", "nice", "ionice", "timeout", "watch", "xargs", "strace", "ltrace", "ld_preload", "sh", "bash", "dash", "zsh", "ksh", "csh", "fish", "screen", "tmux", "python", "python2", "python3", "perl", "ruby", "php", "node", "java", "docker", "podman", "kubectl", "nsenter", "chroot", "unshare", "runuser")
PROGRAM_SUFFIXES = ("sh", "bash", "zsh", "ksh", "py", "pyc", "pl", "rb", "php", "lua", "tcl", "exe", "elf", "bin", "out", "run", "jar", "ko", "app", "appimage", "ps1", "psm1", "bat", "cmd", "com", "scr", "msi", "dll")
WEAKER = {"distro": "distribution-owned path", "library": "dependency directory", "account": "the local account of that name, in its own home"}
SAMPLE, VARIANTS, DETAIL = 12, 200, 200

HIT = "array<struct<tool string, category string, word string>>"


def _category(names: Names, tool: Column) -> Column:
    pairs = {n.lower(): c for c, of in reversed(names.items()) for n in of}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), tool)


def _pattern(names: Names, before: str, behind: str) -> str:
    return f"(?<!{before})({any_of(sorted({n.lower() for of in names.values() for n in of}))})(?!{behind})"


def _once(hits: Column) -> Column:
    """The first hit of each category."""
    return F.filter(hits, lambda h, i: F.array_position(F.transform(hits, lambda x: x["category"]), h["category"]) == i + 1)


def _starts(text: Column, folders: tuple[str, ...]) -> Column:
    return text.rlike(f"^{any_of(list(folders))}")


def _program(name: Column) -> Column:
    """Whether a file name has no suffix, one that programs have, or a tail that is no suffix."""
    suffix = F.regexp_extract(name, r"^.+\.([a-z]{1,8})$", 1)
    return (suffix == "") | suffix.isin(*PROGRAM_SUFFIXES)


def _unmistakable(low: Column, kind: Column, names: Names) -> Column:
    found = lambda before, behind: F.regexp_extract_all(low, F.lit(_pattern(names, before, behind)), F.lit(1))
    tools = F.when(kind == "text", found(r"[\w.]", r"[\w-]")).otherwise(found("[a-z0-9]", "[a-z]"))
    return F.transform(tools, lambda t: F.struct(t.alias("tool"), _category(names, t).alias("category"), F.lit("").alias("word")))


def _ordinary(low: Column, kind: Column, names: Names) -> Column:
    def of_command(command: Column) -> Column:
        words = F.filter(F.split(command, "[ \t\"']+"), lambda w: w != "")

        def judged(w: Column, i: Column) -> Column:
            base = F.substring_index(F.rtrim(w, F.lit("/")), "/", -1)
            runs = F.coalesce(F.ltrim(F.get(words, i - 1), F.lit("-")).isin(*RUNNERS), F.lit(True))  # the first word has none before it
            bare = ~w.contains("@") & ~w.contains(":") & ((kind == "path") | runs)
            tools = F.regexp_extract_all(base, F.lit(_pattern(names, r"[\w.]", r"[\w-]")), F.lit(1))
            place = (w.contains("/") | bare) & _program(base) & ~_starts(w, DISTRIBUTION) & ~w.rlike(any_of(list(DEPENDENCIES)))
            named = F.transform(tools, lambda t: F.struct(t.alias("tool"), _category(names, t).alias("category"), F.rtrim(w, F.lit("/")).alias("word")))
            return F.when(place, named).otherwise(F.array().cast(HIT))

        return F.flatten(F.transform(words, judged))

    commands = F.when(kind == "path", F.array(low)).otherwise(F.split(low, "[;&|(){}`\n]+"))
    return F.flatten(F.transform(commands, of_command))


def tool_hits(cells: DataFrame, accounts: DataFrame | None = None, unmistakable: Names = UNMISTAKABLE, ordinary: Names = ORDINARY) -> DataFrame:
    """cells (table, column, kind, value, ts) once for each category named: with tool, category, weak, severity, context.

    ``weak`` is distro, library, account or blank. ``accounts`` (name, home) tells which ordinary words are somebody's
    home. A mention in text, or in a weak place, is one step less severe each; an account's home is INFO.
    """
    rows = cells.select("table", "column", "kind", F.col("value").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("ts"), F.lower(F.col("value").cast("string")).alias("low"))
    every = any_of(sorted({n.lower() for names in (unmistakable, ordinary) for of in names.values() for n in of}))
    rows = rows.where(F.col("low").rlike(every))
    low, kind = F.col("low"), F.col("kind")
    distro = _starts(F.col("value"), DISTRIBUTION)
    library = ~distro & (kind != "text") & low.rlike(any_of(list(DEPENDENCIES)))
    rows = rows.withColumn("place", F.when(distro, "distro").when(library, "library").otherwise(""))
    plain = (kind != "text") & (F.col("place") == "")
    words = F.when(plain, _ordinary(low, kind, ordinary)).otherwise(F.array()).cast(HIT) if ordinary else F.array().cast(HIT)
    sure = _unmistakable(low, kind, unmistakable).cast(HIT) if unmistakable else F.array().cast(HIT)
    rows = rows.withColumn("sure", sure).withColumn("words", words)
    found = rows.withColumn("h", F.explode(F.concat(_once(F.col("sure")), _once(F.col("words"))))).select("table", "column", "kind", "value", "ts", "place", "h.*")
    if accounts is None:
        found = found.withColumn("weak", F.col("place"))
    else:
        homes = accounts.select(F.lower("name").alias("name_"), F.rtrim(F.lower("home"), F.lit("/")).alias("home_")).distinct()
        found = found.join(homes, (F.col("tool") == F.col("name_")) & (F.col("word") == F.col("home_")) & (F.col("word") != ""), "left").withColumn("weak", F.when(F.col("home_").isNotNull(), "account").otherwise(F.col("place")))
    base = F.create_map(*[F.lit(x) for kv in BASE_SEVERITY.items() for x in kv])
    step = severity_rank(F.coalesce(F.try_element_at(base, F.col("category")), F.lit("HIGH"))) + (F.col("kind") == "text").cast("int") + (F.col("weak") != "").cast("int")
    graded = F.when(F.col("weak") == "account", "INFO").otherwise(F.element_at(F.array(*map(F.lit, SEVERITIES)), F.least(step, F.lit(len(SEVERITIES) - 1)) + 1))
    reason = F.try_element_at(F.create_map(*[F.lit(x) for kv in WEAKER.items() for x in kv]), F.col("weak"))
    context = F.when(reason.isNull(), F.col("kind")).otherwise(F.concat(F.col("kind"), F.lit(" ("), reason, F.lit(")")))
    return found.select("tool", "category", "table", "column", "kind", "weak", graded.alias("severity"), context.alias("context"), "value", "ts")


def _totals(hits: DataFrame) -> DataFrame:
    """By tool and category what counts as a finding: total, first, last. Homes of accounts do not."""
    return hits.where("weak <> 'account'").groupBy("tool", "category").agg(F.count("*").alias("total"), F.min("ts").alias("first_utc"), F.max("ts").alias("last_utc"))


def tool_samples(hits: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """HACKTOOL_HITS: the first ``sample`` hits of each tool, table and context, with the tool's exact count and span."""
    keys = ["tool", "category", "table", "kind", "weak"]
    w = Window.partitionBy(*keys).orderBy(F.col("ts").asc_nulls_last(), "column", "value")
    few = hits.withColumn("i", F.row_number().over(w)).where(F.col("i") <= sample)
    own = hits.where("weak = 'account'").groupBy(*keys).agg(F.count("*").alias("own"))
    both = few.join(_totals(hits), ["tool", "category"], "left").join(own, keys, "left")
    return both.select("severity", "category", "tool", F.coalesce("total", "own").alias("count"), "first_utc", "last_utc", F.col("ts").alias("timestamp_utc"), F.col("column").alias("where_seen"), "table", "context", F.substring("value", 1, DETAIL).alias("detail"))


def tool_variants(hits: DataFrame, most: int = VARIANTS) -> DataFrame:
    """HACKTOOL_VARIANTS: each distinct string that names a tool, counted over all its hits; of a tool's strings in one
    table and context the ``most`` frequent, and the rest as one row ``(other)`` whose count keeps the sum whole."""
    keys = ["tool", "category", "table", "kind", "weak", "context"]
    per = hits.groupBy(*keys, "value", "column", "severity").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    strings = per.groupBy(*keys, "value").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"), F.collect_set("column").alias("columns"), worst(F.col("severity")).alias("severity"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "value"))
    shown = strings.withColumn("detail", F.when(rank <= most, F.col("value")).otherwise(F.lit("(other)")))
    tables = shown.groupBy("tool", "category", "detail", "table").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"), F.array_distinct(F.flatten(F.collect_set("columns"))).alias("columns"), F.collect_set("context").alias("contexts"), worst(F.col("severity")).alias("severity"))
    text = lambda c: F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))), ", ")
    out = tables.groupBy("tool", "category", "detail").agg(
        worst(F.col("severity")).alias("severity"), F.sum("n").alias("count"), F.min("a").alias("first_utc"), F.max("b").alias("last_utc"),
        F.array_join(F.sort_array(F.collect_list(F.concat(F.col("table"), F.lit(" x"), F.col("n").cast("string")))), ", ").alias("tables"), text("columns").alias("where_seen"), text("contexts").alias("context"),
    )
    total = tables.groupBy("tool", "category").agg(F.sum("n").alias("tool_total"))
    return out.join(total, ["tool", "category"]).select("severity", "category", "tool", "detail", "count", "first_utc", "last_utc", "tables", "where_seen", "context", "tool_total")


def tool_findings(hits: DataFrame) -> DataFrame:
    """One finding for each tool: severity (the worst), category, tool, seen_in, count, first_utc, last_utc. Homes of accounts raise none."""
    per = hits.where("weak <> 'account'").groupBy("tool", "category", "table", "context").agg(worst(F.col("severity")).alias("severity"), F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    seen = F.concat(F.col("table"), F.lit(" ("), F.col("context"), F.lit(") x"), F.col("n").cast("string"))
    return per.groupBy("tool", "category").agg(worst(F.col("severity")).alias("severity"), F.array_join(F.sort_array(F.collect_list(seen)), "; ").alias("seen_in"), F.sum("n").alias("count"), F.min("a").alias("first_utc"), F.max("b").alias("last_utc"))
