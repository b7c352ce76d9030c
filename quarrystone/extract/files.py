"""File metadata: BODYFILE, TIMESTOMP, inventories by precedence, hashes, path lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import basename, dirname
from ..functions.times import epoch
from ..operators.findings import stamp_rules

# Places where a file's times matter most.
TMPFS = ("/tmp/", "/var/tmp/", "/dev/shm/", "/run/")
SYSTEM_BIN = ("/bin/", "/sbin/", "/usr/bin/", "/usr/sbin/", "/lib/", "/lib64/", "/usr/lib/", "/usr/local/bin/", "/usr/local/sbin/")
SYSTEM_CFG = ("/etc/", "/boot/")


def under(path: Column, places: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [path.startswith(p) for p in places])


def bodyfile(lines: DataFrame) -> DataFrame:
    """BODYFILE: ``md5|name|inode|mode|uid|gid|size|atime|mtime|ctime|crtime``.

    The nine last fields are taken from the right, so a name may hold the
    separator. Times are seconds; zero and less are absent.
    """
    parts = F.split("line", r"\|")
    last = lambda k: F.try_element_at(parts, F.lit(-k))
    name = F.array_join(F.slice(parts, 2, F.size(parts) - 10), "|")
    whole = F.split(name, " -> ", 2)
    seconds = lambda k: F.when(last(k).try_cast("double") > 0, F.floor(last(k).try_cast("double")))
    rows = lines.where(F.size(parts) >= 11).select(
        last(9).alias("inode"), whole[0].alias("path"), F.coalesce(F.try_element_at(whole, F.lit(2)), F.lit("")).alias("link_target"), last(8).alias("mode"), last(7).try_cast("long").alias("uid"), last(6).try_cast("long").alias("gid"), last(5).try_cast("long").alias("size"),
        *(seconds(k).alias(f"{n}_s") for k, n in ((4, "atime"), (3, "mtime"), (2, "ctime"), (1, "crtime"))),
    )
    times = [F.timestamp_seconds(f"{n}_s").alias(f"{n}_utc") for n in ("atime", "mtime", "ctime", "crtime")]
    return rows.select("*", dirname(F.col("path")).alias("directory"), basename(F.col("path")).alias("basename"), *times)


def with_owners(rows: DataFrame, users: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the names of their uid and gid; the two lists are as small as a host's account files."""
    u = users.groupBy("uid").agg(F.min("username").alias("owner"))
    g = groups.groupBy("gid").agg(F.min("group").alias("group"))
    return rows.join(u, "uid", "left").join(g, "gid", "left")


def timestomp(body: DataFrame, window_start_s: int | None) -> DataFrame:
    """One row for each regular file and rule that it breaks; without a window the backdating rule is silent."""
    regular = body.where(F.col("mode").startswith("-") | F.col("mode").startswith("r/"))
    suspicious = F.substring("mode", 2, 9).contains("x") | under(F.col("path"), TMPFS + SYSTEM_BIN + SYSTEM_CFG)
    start = F.lit(window_start_s).cast("long")
    rules = stamp_rules(F.col("atime_s"), F.col("mtime_s"), F.col("ctime_s"), F.col("crtime_s"), start, suspicious)
    return regular.withColumn("rule", F.explode(rules))


# What gives root when setuid, and where a setuid file is never expected.
ROOT_SHELLS = ("bash", "sh", "dash", "zsh", "python", "python3", "perl", "find", "vim", "vi", "nano", "less", "more", "awk", "gawk", "nmap", "tar", "cp", "env", "docker", "gdb", "ruby", "lua", "php", "socat", "tclsh", "ed")
ODD_PLACES = (*TMPFS, "/home/", "/srv/", "/var/www/", "/opt/")


def setuid_files(body: DataFrame, baseline: list[str]) -> DataFrame:
    """Setuid and setgid files with a severity: odd places and root shells first, then whatever is not in the baseline."""
    mode = F.col("mode")
    own = body.withColumn("kind", F.when(F.lower(F.substring(mode, 2, 3)).contains("s"), "suid").when(F.lower(F.substring(mode, 5, 3)).contains("s"), "sgid")).where("kind IS NOT NULL")
    severity = F.when(under(F.col("path"), ODD_PLACES) | F.col("basename").isin(*ROOT_SHELLS), "CRITICAL").when(~F.col("path").isin(baseline), "MEDIUM").otherwise("INFO")
    return own.withColumn("severity", severity)


def inventory(files: DataFrame, body: DataFrame, claims: DataFrame) -> DataFrame:
    """FILE_INVENTORY: files (path, size, owner, mtime) with owner and times from the bodyfile where it has them, and what parsed them."""
    b = body.groupBy("path").agg(F.max(F.struct("crtime_utc", "mtime_utc", "atime_utc", "ctime_utc", "uid")).alias("b"))
    taken = claims.groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("table")), "; ").alias("parsed_into"))
    joined = files.join(b, "path", "left").join(taken, "path", "left")
    inode = F.col("b.uid").cast("string")
    return joined.select(
        "path", F.regexp_extract("path", "^/?([^/]+)", 1).alias("top_level"), F.col("size").alias("size_bytes"),
        F.coalesce(inode, F.col("owner"), F.lit("")).alias("owner"),
        F.when(inode.isNotNull(), "bodyfile").when(F.col("owner").isNotNull(), "header").otherwise("").alias("owner_source"),
        F.coalesce("b.mtime_utc", "mtime").alias("mtime_utc"), F.col("b.atime_utc").alias("atime_utc"), F.col("b.ctime_utc").alias("ctime_utc"), F.col("b.crtime_utc").alias("crtime_utc"),
        F.when(F.col("b.mtime_utc").isNotNull(), "bodyfile").when(F.col("mtime").isNotNull(), "header").otherwise("").alias("time_source"),
        F.coalesce("parsed_into", F.lit("")).alias("parsed_into"),
    )


HASH_LINE = r"^\s*([0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})\s+\*?(.+?)\s*$"


def file_hashes(lines: DataFrame) -> DataFrame:
    """FILE_HASHES: digest lists merged by path, a column for each algorithm."""
    digest, path = F.lower(F.regexp_extract("line", HASH_LINE, 1)), F.regexp_extract("line", HASH_LINE, 2)
    rows = lines.where(F.col("line").rlike(HASH_LINE)).select(path.alias("file"), digest.alias("digest"))
    of = lambda n, name: F.max(F.when(F.length("digest") == n, F.col("digest"))).alias(name)
    return rows.groupBy(F.col("file").alias("path")).agg(of(32, "md5"), of(40, "sha1"), of(64, "sha256"))


def content_hashes(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """Digests of ``files`` (path, content) that ``recorded`` (path, md5, sha1, sha256) does not have; a recorded one is never computed again."""
    own = files.join(recorded.select("path"), "path", "left_anti").select("path", F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"), F.lit("computed").alias("hash_source"))
    return own.unionByName(recorded.select("path", "md5", "sha1", "sha256", F.lit("recorded").alias("hash_source")))


def changed_images(running: DataFrame, disk: DataFrame) -> DataFrame:
    """Running images (pid, path, md5) that differ from the file (path, md5) on disk."""
    return running.alias("r").join(disk.alias("d"), "path").where(F.lower("r.md5") != F.lower("d.md5")).select("pid", "path", F.col("r.md5").alias("running_md5"), F.col("d.md5").alias("disk_md5"))


def same_content(hashes: DataFrame) -> DataFrame:
    """Digests under more than one name."""
    return hashes.groupBy("md5").agg(F.sort_array(F.collect_set(basename(F.col("path")))).alias("names"), F.count("*").alias("files")).where(F.size("names") > 1)


def path_list(lines: DataFrame) -> DataFrame:
    """World-writable, hidden, orphaned and socket lists: path, directory, basename."""
    p = F.btrim("line")
    return lines.where(p.startswith("/")).select(p.alias("path"), dirname(p).alias("directory"), basename(p).alias("basename"), F.col("path").alias("source"))


def unparsed(files: DataFrame, claims: DataFrame) -> DataFrame:
    """UNPARSED_FILES: files (path, size) that no table took, with why."""
    reason = F.when(F.col("size") == 0, "empty").when(F.lower("path").rlike(r"\.(png|jpe?g|gif|ico|woff2?|ttf|mp4|mp3|pdf)$"), "media").when(F.lower("path").rlike(r"\.(so(\.\d+)*|o|a|ko|bin|exe)$"), "binary").otherwise("no extractor for it")
    return files.join(claims.select("path").distinct(), "path", "left_anti").withColumn("reason", reason)


def epoch_text(value: Column) -> Column:
    return F.date_format(epoch(value), "yyyy-MM-dd HH:mm:ss")
