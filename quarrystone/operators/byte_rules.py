"""Rules on bytes: text and hexadecimal patterns, counted in chunks of files, and conditions on the counts.

    rule = ByteRule("packed", {"$a": Text("upx!", nocase=True), "$h": Hex("7F 45 4C 46 ?? [2-4] 01")}, "$h at 0 and #a > 2 and filesize < 1000000")

A pattern becomes a regular expression over bytes (one character each). Files
are cut into chunks; a chunk is read with a tail as long as the longest pattern
less one byte, and counts the places where a pattern begins in it. A place is in
one chunk only, so nothing is counted twice and nothing is lost at an edge:
places in the tail are those of the tail alone, and are taken off.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20


class ByteRuleError(ValueError):
    """A rule that cannot be compiled, with the reason."""


@dataclass(frozen=True)
class Text:
    """Literal text as UTF-8. ``nocase``: ASCII letters of either case; ``wide``: a zero byte after each byte; ``fullword``: no letter or digit beside it."""

    text: str
    nocase: bool = False
    wide: bool = False
    fullword: bool = False

    def regex(self) -> str:
        each = [_byte(b, self.nocase) + ("\\x00" if self.wide else "") for b in self.text.encode()]
        body = "".join(each)
        edge = "[0-9A-Za-z]\\x00" if self.wide else "[0-9A-Za-z]"
        return f"(?<!{edge}){body}(?!{edge})" if self.fullword else body

    def longest(self) -> int:
        return len(self.text.encode()) * (2 if self.wide else 1)


@dataclass(frozen=True)
class Hex:
    """Bytes as ``4D 5A``, ``??`` for any, ``4?`` or ``?A`` for half of one, ``[2-5]`` for so many of any, ``( 01 02 | 03 )`` for either."""

    pattern: str

    def _read(self) -> tuple[str, int]:
        tokens = re.findall(r"\[[^\]]*\]|[()|]|[0-9A-Fa-f?]{2}|\S", self.pattern)
        out: list[str] = []
        lengths: list[list[int]] = [[0]]  # of the alternatives of each open group
        for t in tokens:
            if t == "(":
                out.append("(?:")
                lengths.append([0])
            elif t == "|" and len(lengths) > 1:
                out.append("|")
                lengths[-1].append(0)
            elif t == ")" and len(lengths) > 1:
                out.append(")")
                most = max(lengths.pop())
                lengths[-1][-1] += most
            elif m := re.fullmatch(r"\[(\d+)(?:-(\d+))?\]", t):
                low, high = int(m[1]), int(m[2] or m[1])
                if low > high:
                    raise ByteRuleError(f"a jump from {low} to {high}")
                out.append(f"[\\x00-\\xff]{{{low},{high}}}")
                lengths[-1][-1] += high
            elif re.fullmatch(r"[0-9A-Fa-f?]{2}", t):
                out.append(_nibbles(t))
                lengths[-1][-1] += 1
            else:
                raise ByteRuleError(f"{t} is no part of a hexadecimal pattern")
        if len(lengths) != 1 or not lengths[0][0]:
            raise ByteRuleError("a group is not closed, or the pattern is empty")
        return "".join(out), lengths[0][0]

    def regex(self) -> str:
        return self._read()[0]

    def longest(self) -> int:
        return self._read()[1]


@dataclass(frozen=True)
class ByteRule:
    name: str
    patterns: dict[str, Text | Hex] = field(default_factory=dict)
    condition: str = "any of them"


def _byte(b: int, nocase: bool) -> str:
    c = chr(b)
    return f"[{c.upper()}{c.lower()}]" if nocase and c.isascii() and c.isalpha() else f"\\x{b:02x}"


def _nibbles(t: str) -> str:
    if t == "??":
        return "[\\x00-\\xff]"
    if "?" not in t:
        return f"\\x{t.lower()}"
    fits = [b for b in range(256) if all(x in ("?", y) for x, y in zip(t.upper(), f"{b:02X}", strict=True))]
    return "[" + "".join(f"\\x{b:02x}" for b in fits) + "]"


def _as_text(raw: Column) -> Column:
    """Bytes as a text of one character each."""
    return F.decode(raw, "ISO-8859-1")


def _begins(pattern: Text | Hex) -> Column:
    """An expression that holds at every place where the pattern begins, also within another match."""
    return F.lit(f"(?s)(?={pattern.regex()})")


_TOKEN = re.compile(r"\s*(\(|\)|[#$@][A-Za-z0-9_]*\*?|==|!=|<=|>=|<|>|\d+(?:KB|MB)?|[A-Za-z_]\w*|,)")


class _Condition:
    """``not`` binds tightest, then ``and``, then ``or``; counts, places and the file's size are compared with numbers."""

    def __init__(self, rule: ByteRule, counts: dict[str, Column], raw: Column, size: Column):
        self.rule, self.counts, self.raw, self.size = rule, counts, raw, size
        self.tokens, self.at, end = [], 0, 0
        for m in _TOKEN.finditer(rule.condition):
            if m.start() != end:
                break
            self.tokens.append(m[1])
            end = m.end()
        if rule.condition[end:].strip():
            raise ByteRuleError(f"{rule.name}: {rule.condition[end:].strip()[:20]} is not understood")

    def column(self) -> Column:
        out = self._any()
        if self.at < len(self.tokens):
            raise ByteRuleError(f"{self.rule.name}: unexpected {self.tokens[self.at]}")
        return out

    def _peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def _take(self, wanted: str | None = None) -> str:
        t = self._peek()
        if not t or (wanted and t != wanted):
            raise ByteRuleError(f"{self.rule.name}: {wanted or 'more'} is expected")
        self.at += 1
        return t

    def _any(self) -> Column:
        out = self._all()
        while self._peek() == "or":
            self._take()
            out = out | self._all()
        return out

    def _all(self) -> Column:
        out = self._one()
        while self._peek() == "and":
            self._take()
            out = out & self._one()
        return out

    def _number(self) -> int:
        m = re.fullmatch(r"(\d+)(KB|MB)?", self._take())
        if not m:
            raise ByteRuleError(f"{self.rule.name}: a number is expected")
        return int(m[1]) * {None: 1, "KB": 1 << 10, "MB": 1 << 20}[m[2]]

    def _compared(self, value: Column) -> Column:
        op = self._take()
        ops = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
        if op not in ops:
            raise ByteRuleError(f"{self.rule.name}: {op} compares nothing")
        return ops[op](value, F.lit(self._number()))

    def _named(self, name: str) -> Column:
        if name not in self.counts:
            raise ByteRuleError(f"{self.rule.name}: there is no {name}")
        return self.counts[name]

    def _one(self) -> Column:
        t = self._take()
        if t == "not":
            return ~self._one()
        if t == "(":
            inner = self._any()
            self._take(")")
            return inner
        if t in ("true", "false"):
            return F.lit(t == "true")
        if t == "filesize":
            return self._compared(self.size)
        if t.startswith("#"):
            return self._compared(self._named("$" + t[1:]))
        if t.startswith("$"):
            if self._peek() != "at":
                return self._named(t) > 0
            self._take()
            place, pattern = self._number(), self.rule.patterns.get(t)
            if pattern is None:
                raise ByteRuleError(f"{self.rule.name}: there is no {t}")
            return F.coalesce(_as_text(F.substring(self.raw, place + 1, pattern.longest())).rlike(f"(?s)^{pattern.regex()}"), F.lit(False))
        if t in ("any", "all") or t.isdigit():
            self._take("of")
            wanted = self._take()
            names = list(self.counts) if wanted == "them" else self._set(wanted)
            if not names:
                raise ByteRuleError(f"{self.rule.name}: nothing is named {wanted}")
            need = 1 if t == "any" else len(names) if t == "all" else int(t)
            return sum((F.when(self.counts[n] > 0, 1).otherwise(0) for n in names), F.lit(0)) >= need
        raise ByteRuleError(f"{self.rule.name}: unexpected {t}")

    def _set(self, first: str) -> list[str]:
        names = []
        if first != "(":
            raise ByteRuleError(f"{self.rule.name}: a set of patterns is expected")
        while True:
            t = self._take()
            names += [n for n in self.counts if n == t or (t.endswith("*") and n.startswith(t[:-1]))]
            if self._take() == ")":
                return names


def pattern_counts(files: DataFrame, rules: list[ByteRule], keys: list[str], content: str = "content", chunk: int = CHUNK_BYTES, head: int = 0) -> DataFrame:
    """keys, size, an array of counts of all rules' patterns (in the order of rules and patterns), and the first ``head`` bytes, for each file.

    Null contents have no bytes. ``keys`` must tell files apart; a chunk has two bytes at least.
    """
    if chunk < 2:
        raise ByteRuleError("a chunk has two bytes at least")
    flat = [p for r in rules for p in r.patterns.values()]
    tail = max((p.longest() for p in flat), default=1) - 1
    raw = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    size = F.octet_length(raw)
    pieces = files.select(*keys, raw.alias("raw_"), size.alias("size_"), F.explode(F.sequence(F.lit(0), F.floor(F.greatest(size - 1, F.lit(0)) / chunk).cast("int"))).alias("piece_"))
    # A fullword pattern looks up to two bytes to either side, so a piece is read from there to there; places count from its own start.
    start = F.col("piece_") * chunk
    lead = F.least(start, F.lit(2))
    texts = pieces.select(
        *keys, "size_",
        _as_text(F.substring(F.col("raw_"), start - lead + 1, lead + chunk + tail + 2)).alias("whole_"),
        _as_text(F.substring(F.col("raw_"), F.greatest(start + chunk - 2, F.lit(0)) + 1, F.lit(tail + 4))).alias("rest_"),
        lead.alias("lead_"), (F.col("size_") > start + chunk).alias("more_"), F.when(F.col("piece_") == 0, F.substring("raw_", 1, head)).alias("head_"),
    )
    # Places in the lead belong to the piece before, those in the tail to the one after.
    own = []
    for p in flat:
        at = _begins(p)
        first = F.concat(F.lit("(?s)(?<=^.{0,1})"), at)  # at one of the first two places
        before = F.when(F.col("lead_") > 0, F.regexp_count("whole_", first)).otherwise(0)
        behind = F.when(F.col("more_"), F.regexp_count("rest_", at) - F.regexp_count("rest_", first)).otherwise(0)
        own.append((F.regexp_count("whole_", at) - before - behind).cast("long"))
    counted = texts.select(*keys, "size_", "head_", F.array(*own).alias("counts_") if own else F.array().cast("array<bigint>").alias("counts_"))
    sums = F.array(*(F.sum(F.col("counts_")[i]) for i in range(len(flat)))) if flat else F.array().cast("array<bigint>")
    return counted.groupBy(*keys, F.col("size_").alias("size")).agg(sums.alias("counts"), F.max("head_").alias("head"))


def matches(files: DataFrame, rules: list[ByteRule], keys: list[str], content: str = "content", chunk: int = CHUNK_BYTES) -> DataFrame:
    """keys, rule, size, counts (map by pattern) of every file and every rule that it meets: one scan of the contents, however many rules.

    What stands at a fixed place is read from the file's head, which travels with its first piece.
    """
    head = max((int(n) + 64 + max((p.longest() for p in r.patterns.values()), default=0) for r in rules for n in re.findall(r"\bat\s+(\d+)", r.condition)), default=0)
    counts = pattern_counts(files, rules, keys, content, chunk, head)
    met, at = [], 0
    for r in rules:
        own = {name: F.col("counts")[at + i] for i, name in enumerate(r.patterns)}
        at += len(own)
        test = _Condition(r, own, F.col("head"), F.col("size")).column()
        said = F.create_map(*[x for name, c in own.items() for x in (F.lit(name), c)]) if own else F.create_map().cast("map<string,bigint>")
        met.append(F.when(test, F.struct(F.lit(r.name).alias("rule"), said.alias("counts"))))
    hits = counts.select(*keys, "size", F.explode(F.array_compact(F.array(*met))).alias("hit_"))
    return hits.select(*keys, F.col("hit_.rule").alias("rule"), "size", F.col("hit_.counts").alias("counts"))
