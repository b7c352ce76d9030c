"""Files that are arrays of fixed slots, one for each uid: last logins and counted failures. Column expressions on their bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of a slot of lastlog; of faillog with long and with short times.
LAST_SLOT = 292
FAIL_SLOTS = (32, 24)


def whole(raw: Column, place: Column, size: int) -> Column:
    """An unsigned integer of ``size`` bytes, the lowest first, at byte ``place`` from 0."""
    digits = F.concat(*(F.hex(F.substring(raw, place + i + 1, F.lit(1))) for i in reversed(range(size))))
    return F.conv(digits, 16, 10).cast("decimal(20,0)").try_cast("long")


def text(raw: Column, place: Column, size: int) -> Column:
    """The text of a field that ends at its first zero byte; bytes that are no UTF-8 are replaced."""
    return F.make_valid_utf8(F.substring_index(F.substring(raw, place + 1, F.lit(size)).cast("string"), "\x00", 1))


def _slots(raw: Column, size: Column) -> Column:
    """The uids of all whole slots; none for an empty or missing file."""
    count = F.floor(F.length(raw) / size).cast("long")
    return F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<long>"))


def last_logins(files: DataFrame, users: DataFrame) -> DataFrame:
    """LASTLOG (uid, username, last_login_utc, terminal, remote_host, source) from lastlog files (path, content).

    Only slots that were written are exploded, so the file's bytes are not copied
    for each uid. ``users`` has uid and username; a uid of several names shows
    the least, one of none a blank. A cut slot at the end is left out.
    """
    raw = F.col("content")
    used = F.filter(_slots(raw, F.lit(LAST_SLOT)), lambda uid: whole(raw, uid * LAST_SLOT, 4) != 0)
    slot = lambda uid: F.struct(uid.alias("uid"), whole(raw, uid * LAST_SLOT, 4).alias("at"), text(raw, uid * LAST_SLOT + 4, 32).alias("terminal"), text(raw, uid * LAST_SLOT + 36, 256).alias("remote_host"))
    rows = files.select(F.col("path").alias("source"), F.explode(F.transform(used, slot)).alias("x"))
    names = users.where("uid IS NOT NULL").groupBy(F.col("uid").cast("long").alias("uid")).agg(F.min("username").alias("username"))
    return rows.select("x.*", "source").join(names, "uid", "left").select("uid", F.coalesce("username", F.lit("")).alias("username"), F.timestamp_seconds("at").alias("last_login_utc"), "terminal", "remote_host", "source")


def failed_counts(files: DataFrame) -> DataFrame:
    """Slots of faillog files (path, content): uid, count, most, terminal, last_utc, lock_s, source; slots with neither count nor time are left out.

    A file's length decides the size of its slots; one that fits neither has none.
    """
    raw = F.col("content")
    fits = lambda size: F.length(raw) % size == 0
    long, short = FAIL_SLOTS
    small = lambda at: (whole(raw, at, 2) + 32_768) % 65_536 - 32_768

    def parsed(size: int) -> Column:
        width = (size - 16) // 2
        time = lambda uid: whole(raw, uid * size + 16, width)
        used = F.filter(_slots(raw, F.lit(size)), lambda uid: (small(uid * size) != 0) | (F.coalesce(time(uid), F.lit(1)) != 0))
        return F.transform(
            used,
            lambda uid: F.struct(
                uid.alias("uid"), small(uid * size).alias("count"), small(uid * size + 2).alias("most"), text(raw, uid * size + 4, 12).alias("terminal"),
                F.when((time(uid) > 0) & (time(uid) < 1 << (36 if width == 8 else 31)), F.timestamp_seconds(time(uid))).alias("last_utc"), whole(raw, uid * size + 16 + width, width).alias("lock_s"),
            ),
        )

    slots = F.when(fits(long), parsed(long)).when(fits(short), parsed(short))
    return files.select(F.col("path").alias("source"), F.explode(slots).alias("x")).select("x.*", "source")
