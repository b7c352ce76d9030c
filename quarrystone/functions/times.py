"""Times as log files write them, durations and sizes as people read them. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import at, let, parts

#: How the forms of log time stamps read once their zone is written behind them.
DASHED, SLASHED, NAMED = "yyyy-MM-dd HH:mm:ss xx", "dd/MMM/yyyy:HH:mm:ss xx", "yyyy MMM d HH:mm:ss xx"
UTC = "+0000"
#: Stamps that read as they are: DASHED without a zone.
WHOLE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"


def _zone(text: Column) -> Column:
    """The offset at the end of a stamp as ``+hhmm``; blank where it has none."""
    return let(F.regexp_extract(text, "(Z|[-+][0-9:]{4,5})$", 1), lambda tail: F.when(tail == "Z", UTC).otherwise(F.replace(tail, F.lit(":"), F.lit(""))))


def offset_seconds(zone: Column) -> Column:
    """``+0200``, ``-04:00`` or ``Z`` as seconds east; null, blank and what is no offset: 0."""
    z = F.coalesce(_zone(zone), F.lit(""))
    known = F.try_to_timestamp(F.concat(F.lit("1970-01-01 00:00:00 "), F.when(z == "", UTC).otherwise(z)), F.lit(DASHED))
    return F.coalesce(-F.unix_seconds(known), F.lit(0))


def _read(body: Column, form: str, zone: Column | None = None) -> Column:
    return F.try_to_timestamp(F.concat(body, F.lit(" "), F.lit(UTC) if zone is None else F.when(zone == "", UTC).otherwise(zone)), F.lit(form))


def _minus(ts: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(ts) - seconds)


def log_timestamp(text: Column, host_offset_s: Column | int = 0, collected: Column | None = None) -> Column:
    """A log's time stamp as UTC. An offset of its own wins; else the host's is taken off, but never from the
    web form. A year-less stamp takes the year of ``collected``, or the one before if that would be later than it.

    Forms: ISO 8601 with or without a fraction, the web servers' day/month/year, ``date``'s and syslog's.
    The text is computed once, and each form takes the steps that it needs only.
    """
    host = F.lit(host_offset_s) if isinstance(host_offset_s, int) else host_offset_s
    body = lambda t, zone: F.rtrim(F.when(zone == "", t).otherwise(F.regexp_replace(t, "(Z|[-+][0-9:]{4,5})$", "")))
    known = lambda t: let(_zone(t), lambda zone: let(body(t, zone), lambda b: _log_timestamp(t, b, zone, host, collected)))
    return let(F.btrim(text), lambda t: F.when(t.rlike(WHOLE), _minus(_read(t, DASHED), host)).otherwise(known(t)))


def _log_timestamp(text: Column, body: Column, zone: Column, host: Column, collected: Column | None) -> Column:
    plain = F.regexp_replace(F.regexp_replace(body, "([0-9])(?:T| +)([0-9])", "$1 $2"), "[.,][0-9]+$", "")
    iso = _minus(_read(plain, DASHED, zone), F.when(zone == "", host).otherwise(0))
    digit = F.substring(body, 1, 1).between("0", "9")
    return F.when(digit & body.contains("/"), _read(body, SLASHED, zone)).when(digit, iso).otherwise(let(parts(text), lambda w: _named(w, host, collected)))


def _named(w: Column, host: Column, collected: Column | None) -> Column:
    named = _minus(_read(F.concat_ws(" ", at(w, -1), at(w, 2), at(w, 3), at(w, 4)), NAMED), host)
    out = F.when(F.size(w) >= 5, named)
    if collected is None:
        return out
    of = lambda year: _minus(_read(F.concat_ws(" ", year.cast("string"), at(w, 1), at(w, 2), at(w, 3)), NAMED), host)
    short = lambda this: F.when(this.isNull() | (F.to_date(this) > F.to_date(collected)), F.coalesce(of(F.year(collected) - 1), this)).otherwise(this)
    return out.when(F.size(w) == 3, let(of(F.year(collected)), short))


def epoch(value: Column) -> Column:
    """Seconds since 1970 as a time; not a number, or zero or less: null."""
    x = value.try_cast("double")
    return F.when(x > 0, F.timestamp_seconds(F.floor(x)))


def shown(ts: Column) -> Column:
    """A time as the exports write it."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def gap(seconds: Column) -> Column:
    """``3 days`` from two days on, else ``5h20m``, ``12m`` from two minutes on, ``45s``; nothing for zero or less."""
    h, m = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)
    hours = F.when(m > 0, F.concat(h.cast("string"), F.lit("h"), m.cast("string"), F.lit("m"))).otherwise(F.concat(h.cast("string"), F.lit("h")))
    return (
        F.when(seconds.isNull() | (seconds <= 0), "")
        .when(seconds >= 172_800, F.concat(F.floor(seconds / 86_400).cast("string"), F.lit(" days")))
        .when(seconds >= 3600, hours)
        .when(seconds >= 120, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m")))
        .otherwise(F.concat(seconds.cast("string"), F.lit("s")))
    )


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB by 1024, with one decimal above B."""
    scaled = lambda k, unit: F.concat(F.format_string("%.1f", n / F.lit(1024.0**k)), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1, " KB")).when(n < 1024**3, scaled(2, " MB")).when(n < 1024**4, scaled(3, " GB")).otherwise(scaled(4, " TB"))
