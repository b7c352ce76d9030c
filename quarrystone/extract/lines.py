"""A log line's header: when, which host, which program, and what is left of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.words import after, at, between, let, parts

# Months as logs name them, levels of a print server's log.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
CUPS_LEVELS = {"E": "error", "W": "warning", "I": "info", "D": "debug", "N": "notice"}
FIELDS = ("timestamp_raw", "host", "process", "pid", "message")


def _is_clock(word: Column) -> Column:
    """hh:mm:ss, with anything behind it."""
    return F.translate(F.substring(word, 1, 8), "123456789", "000000000") == "00:00:00"


def _is_day(word: Column) -> Column:
    """yyyy-mm-dd, with anything behind it."""
    return F.translate(F.substring(word, 1, 10), "123456789", "000000000") == "0000-00-00"


def _row(**cells: Column) -> Column:
    return F.struct(*(cells.get(name, F.lit("")).alias(name) for name in FIELDS))


def cups_line(line: Column) -> tuple[Column, Column, Column, Column]:
    """(whether it is one, stamp, level, message) of a print server's ``E [24/Mar/2026:19:16:30 -0400] text``."""
    level = F.create_map(*[F.lit(x) for kv in CUPS_LEVELS.items() for x in kv])
    stamp = between(line, "[", "]")
    good = F.substring(line, 1, 1).rlike("[A-Z]") & (F.ltrim(F.substring(line, 2, 1 << 20)).startswith("[")) & (F.substring(line, 2, 1) == " ") & _is_clock(F.substring(stamp, 13, 8))
    return good, stamp, F.coalesce(F.try_element_at(level, F.substring(line, 1, 1)), F.lit("")), F.ltrim(after(line, "]"))


def split_line(line: Column) -> Column:
    """struct (timestamp_raw, host, process, pid, message) of a log line; a line without a header is its message.

    A stamp is three words that begin with a month, or one or two that begin
    with a day. Behind it, ``program[pid]:`` with or without a host; access
    lines, print servers' and installers' lines are told by their brackets and
    by where their stamp is.
    """
    known = F.struct(line.alias("line"), parts(line, 4).alias("w"), F.split(line, '"', 3).alias("quotes"))
    return let(known, lambda x: _split(x["line"], x["w"], x["quotes"]))


def _split(line: Column, w: Column, quotes: Column) -> Column:
    dated = at(w, 1).isin(*MONTHS) & at(w, 2).try_cast("int").isNotNull() & _is_clock(at(w, 3)) & (F.length(at(w, 3)) == 8)
    iso_one = _is_day(at(w, 1)) & F.substring(at(w, 1), 11, 1).isin("T", "t") & _is_clock(F.substring(at(w, 1), 12, 8))
    iso_two = _is_day(at(w, 1)) & (F.length(at(w, 1)) == 10) & _is_clock(at(w, 2))
    # Stamps are kept as they are written, blanks included.
    stamp = F.when(dated, F.regexp_extract(line, r"^\S+\s+\S+\s+\S+", 0)).when(iso_one, at(w, 1)).when(iso_two, F.regexp_extract(line, r"^\S+\s+\S+", 0))

    front, behind = parts(F.get(quotes, F.lit(0))), parts(F.get(quotes, F.lit(2)))
    status = at(behind, 1)
    access = (F.size(quotes) == 3) & F.rtrim(F.get(quotes, F.lit(0))).endswith("]") & (F.size(front) >= 4) & (F.length(status) == 3) & status.try_cast("int").between(100, 599) & (F.size(behind) >= 2)
    asked = F.concat(F.get(quotes, F.lit(1)), F.lit(" -> "), status, F.lit(" ("), at(behind, 2), F.lit(" bytes) user="), at(front, 3))
    served = _row(timestamp_raw=between(line, "[", "]"), host=at(front, 1), process=F.lit("http"), message=asked)

    printed, when, level, message = cups_line(line)
    tooled = _is_day(at(w, 2)) & (F.length(at(w, 2)) == 10) & _is_clock(at(w, 3)) & at(w, 3).endswith(":")
    installer = _row(timestamp_raw=F.rtrim(F.regexp_extract(line, r"\d{4}-\d\d-\d\d +[0-9:]+\d", 0)), process=at(w, 1), message=at(w, 4))
    inner = F.btrim(line, F.lit("- "))
    banner = F.btrim(line).startswith("--") & F.btrim(line).endswith("-") & (F.size(parts(inner)) >= 5) & at(parts(inner), 2).isin(*MONTHS) & _is_clock(at(parts(inner), 4))
    started = line.startswith("Log started:") | line.startswith("Log ended:")
    return let(stamp, lambda x: (
        F.when(x.isNotNull(), _stamped(x, F.ltrim(F.substring(line, F.length(x) + 1, F.lit(1 << 30)))))
        .when(access, served)
        .when(printed, _row(timestamp_raw=when, process=level, message=message))
        .when(tooled, installer)
        .when(banner, _row(timestamp_raw=inner, message=F.btrim(line)))
        .when(started, _row(timestamp_raw=F.ltrim(after(line, ":")), message=F.substring_index(line, ":", 1)))
        .otherwise(_row(message=F.rtrim(line)))
    ))


def _stamped(stamp: Column, rest: Column) -> Column:
    """What follows a stamp: ``program[pid]: message`` with or without a host before it, or any text."""
    first = F.substring_index(rest, " ", 1)
    hosted = ~first.contains(":")
    own = F.when(hosted, F.ltrim(F.substring(rest, F.length(first) + 1, F.lit(1 << 30)))).otherwise(rest)
    speaker = lambda x: F.struct(x["own"].alias("own"), x["first"].alias("first"), x["hosted"].alias("hosted"), F.substring_index(x["own"], ":", 1).alias("head"))

    def said(x: Column) -> Column:
        head = x["head"]
        row = _row(
            timestamp_raw=stamp, host=F.when(x["hosted"], x["first"]).otherwise(""), process=F.substring_index(head, "[", 1),
            pid=F.when(head.contains("["), F.substring_index(F.substring_index(head, "[", -1), "]", 1)).otherwise(""), message=F.ltrim(F.substring(x["own"], F.length(head) + 2, F.lit(1 << 30))),
        )
        good = (head != "") & ~head.contains(" ") & (F.length(head) < F.length(x["own"]))
        return F.when(good, row).otherwise(_row(timestamp_raw=stamp, message=rest))

    return let(F.struct(own.alias("own"), first.alias("first"), hosted.alias("hosted")), lambda x: let(speaker(x), said))
