"""Addresses, ports and the hexadecimal forms of the kernel's tables. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a log writes when it has no address, and the ranges that are not routable.
PLACEHOLDERS = ("", "-", "?", "::", "unknown", "unknown-host", "n/a")
WRAP = " \t\r\n\"'<>(),;"
NOT_GLOBAL = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
TCP_STATES = ("ESTABLISHED", "SYN_SENT", "SYN_RECV", "FIN_WAIT1", "FIN_WAIT2", "TIME_WAIT", "CLOSE", "CLOSE_WAIT", "LAST_ACK", "LISTEN", "CLOSING")
IPV4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def ipv4_number(ip: Column) -> Column:
    """A dotted address as a number; anything else null."""
    parts = [F.regexp_extract(ip, IPV4, i).try_cast("long") for i in range(1, 5)]
    value = ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3]
    good = parts[0] <= 255
    for p in parts[1:]:
        good = good & (p <= 255)
    return F.when(good, value)


def in_cidr(ip: Column, cidr: str) -> Column:
    """Whether a dotted address is in ``a.b.c.d/n``; a bare address is a network of one."""
    base, _, bits = cidr.partition("/")
    a, b, c, d = map(int, base.split("."))
    size = 1 << (32 - int(bits or 32))
    low = ((a * 256 + b) * 256 + c) * 256 + d
    low -= low % size
    return F.coalesce(ipv4_number(ip).between(low, low + size - 1), F.lit(False))


def canonical(ip: Column) -> Column:
    """One text form: no brackets, no zone; ``*`` and blank are 0.0.0.0."""
    s = F.btrim(F.btrim(ip), F.lit("[]"))
    return F.when(ip.isNull(), "").when(s.isin("", "*"), "0.0.0.0").otherwise(F.split(s, "%")[0])


def is_private(ip: Column) -> Column:
    """True for anything that is not a routable IPv4 address: names and ``*`` are no sign of traffic leaving."""
    n = canonical(ip)
    inside = ipv4_number(n).isNull()
    for cidr in NOT_GLOBAL:
        inside = inside | in_cidr(n, cidr)
    return inside


def clean_address(value: Column) -> Column:
    """A host or address without the punctuation around it and without its port; placeholders are blank."""
    s = F.rtrim(F.btrim(F.coalesce(value, F.lit("")), F.lit(WRAP)), F.lit(".,;:"))
    bracket, v4 = r"^\[([0-9A-Fa-f:.]+)\](?::\d+)?$", r"^(\d{1,3}(?:\.\d{1,3}){3})(?::\d+)?$"
    return F.when(F.lower(s).isin(*PLACEHOLDERS), "").when(s.rlike(bracket), F.regexp_extract(s, bracket, 1)).when(s.rlike(v4), F.regexp_extract(s, v4, 1)).otherwise(s)


def host_port(text: Column) -> Column:
    """``1.2.3.4:22``, ``[::1]:22``, ``*:22`` to a struct (host, port); a bare IPv6 address has no port."""
    s = F.btrim(F.coalesce(text, F.lit("")))
    cut = r"^(.*):([^:]*)$"
    host, port = F.regexp_extract(s, cut, 1), F.regexp_extract(s, cut, 2).try_cast("int")
    colons = F.regexp_count(host, F.lit(":"))
    whole = ~s.contains(":") | (~s.startswith("[") & (colons >= 2)) | (s.startswith("[") & ~s.contains("]:"))
    return F.struct(F.when(whole, canonical(s)).otherwise(canonical(host)).alias("host"), F.when(~whole, port).alias("port"))


def hex_ipv4(text: Column) -> Column:
    """``0100007F`` to 127.0.0.1: four bytes, last first."""
    byte = lambda i: F.conv(F.substring(text, i, 2), 16, 10)
    return F.when(text.rlike("^[0-9A-Fa-f]{8}$"), F.concat_ws(".", byte(7), byte(5), byte(3), byte(1))).otherwise(text)


def hex_endpoint(text: Column) -> Column:
    """``0100007F:1F90`` to a struct (host, port)."""
    parts = F.split(text, ":")
    return F.struct(hex_ipv4(parts[0]).alias("host"), F.conv(parts[1], 16, 10).cast("int").alias("port"))


def tcp_state(text: Column) -> Column:
    """The kernel's hexadecimal state by name; an unknown one stays."""
    n = F.conv(text, 16, 10).cast("int")
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, TCP_STATES)), F.when(n > 0, n)), text)


def prefix_length(netmask: Column) -> Column:
    """255.255.255.0 to 24; a mask with holes is null."""
    n = ipv4_number(netmask)
    ones = F.bit_count(n)
    return F.when(n == F.lit(0xFFFFFFFF) - (F.pow(F.lit(2.0), F.lit(32) - ones).cast("long") - 1), ones)
