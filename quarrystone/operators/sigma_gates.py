"""Which Sigma rules a row can meet, by one scan for literals; which rules a table can meet at all.

A gate of a rule is a set of literals of which every match has at least one
somewhere in its row. All gates make one index, literal to rules; a row is
searched once for all literals, and only the rules whose literals it has are
evaluated on it. Rules without a gate are evaluated on every row.

Coverage asks whether a condition can be true although selections on fields
that the table lacks are false (or true, where null is asked for).
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sigma import LEVELS, MOST_HITS, PROVENANCE, Compiler, RuleError, Tree, _parts, compile_rule, parsed, sampled
from .sweeps import any_of

#: Shorter literals are in nearly every row and gate nothing.
LEAST_LITERAL = 3


def _longest(value: object, words: bool = False) -> str | None:
    """The longest stretch of a value without wildcards (and blanks, with ``words``) in small letters; None where it is too short."""
    if value is None or isinstance(value, bool):
        return None
    best = max(re.split(r"[*?\\\s]" if words else r"[*?\\]", str(value).lower()), key=len)
    return best if len(best) >= LEAST_LITERAL and best.isascii() else None


def _any(sets: Iterable[set[str] | None]) -> set[str] | None:
    """The gate of alternatives: all their literals, if each has a gate."""
    out: set[str] = set()
    for s in sets:
        if s is None:
            return None
        out |= s
    return out or None


def _best(sets: Iterable[set[str] | None]) -> set[str] | None:
    """The gate of what must all hold: one of theirs, that with the longest shortest literal."""
    return max((s for s in sets if s is not None), key=lambda s: (min(map(len, s)), -len(s)), default=None)


def selection_gate(body: object) -> set[str] | None:
    """The gate of a selection as its YAML reads."""
    if isinstance(body, dict):
        return _best(_pair_gate(k, v) for k, v in body.items())
    values = body if isinstance(body, list) else [body]
    if any(isinstance(x, dict) for x in values):
        return _any(selection_gate(x) for x in values)
    return _any({lit} if (lit := _longest(v, words=True)) else None for v in values)  # words may stand in neighbouring fields


def _pair_gate(key: str, value: object) -> set[str] | None:
    mods = set(key.split("|")[1:])
    if mods & {"re", "cidr"}:
        return None
    each = [{lit} if (lit := _longest(v)) else None for v in (value if isinstance(value, list) else [value])]
    return _best(each) if "all" in mods else _any(each)


def tree_gate(tree: Tree, gates: dict[str, set[str] | None]) -> set[str] | None:
    """The gate of a condition; a negation has none."""
    kind, *rest = tree
    if kind == "sel":
        return gates[rest[0]]
    if kind == "not":
        return None
    if kind == "and":
        return _best(tree_gate(t, gates) for t in rest[0])
    if kind == "or":
        return _any(tree_gate(t, gates) for t in rest[0])
    need, names = rest
    if need <= 0:
        return None
    return _best(gates[n] for n in names) if need >= len(names) else _any(gates[n] for n in names)


def rule_gate(rule: dict) -> set[str] | None:
    """The literals of which a row that the rule matches has one; None: any row can match."""
    detection, conditions = _parts(rule)
    gates = {name: selection_gate(body) for name, body in detection.items()}
    return _any(tree_gate(parsed(c, list(detection)), gates) for c in conditions)


def found_literals(hay: Column, literals: list[str]) -> Column:
    """The literals in a text of small letters, longest at each place; overlapping ones are all found."""
    return F.array_distinct(F.regexp_extract_all(hay, F.lit(f"(?s)(?=({any_of(literals)}))"), F.lit(1)))


def gated_matches(df: DataFrame, rules: list[dict], order: list[str], synonyms: dict[str, list[str]] | None = None, most: int = MOST_HITS) -> tuple[DataFrame, list[tuple[str, str]]]:
    """What ``sigma.matches`` returns: the table is read once, each row is searched once, and only rules whose literals it has are evaluated."""
    good, errors = [], []
    for rule in rules:
        try:
            good.append((rule, compile_rule(rule, df.columns, synonyms), rule_gate(rule)))
        except RuleError as e:
            errors.append((str(rule.get("title")), str(e)))
    literals = sorted({lit for _, _, gate in good for lit in gate or ()})
    # A literal at a place hides those it begins with, so it stands for them too.
    index = {lit: [i for i, (_, _, gate) in enumerate(good) if gate and any(lit.startswith(x) for x in gate)] for lit in literals}
    always = [i for i, (_, _, gate) in enumerate(good) if gate is None]
    hay = F.lower(F.concat_ws("\n", *(F.col(c).cast("string") for c in df.columns)))
    tried = F.array(*map(F.lit, always)).cast("array<int>")
    if literals:
        by_literal = F.create_map(*[x for lit, ids in index.items() for x in (F.lit(lit), F.array(*map(F.lit, ids)))])
        tried = F.array_distinct(F.concat(tried, F.flatten(F.transform(found_literals(hay, literals), lambda lit: by_literal[lit]))))
    rows = df.select(F.struct(*df.columns).alias("row_"), F.explode(tried).alias("rule_")).select("rule_", "row_.*")
    test = F.lit(False)
    for i, (_, t, _) in reversed(list(enumerate(good))):
        test = F.when(F.col("rule_") == i, t).otherwise(test)
    of = lambda f: F.element_at(F.array(*(F.lit(f(r)) for r, _, _ in good)), F.col("rule_") + 1)
    if not good:
        return sampled(df.select(F.lit("").alias("rule"), F.lit("").alias("severity"), *df.columns).where("false"), order, most), errors
    hits = rows.where(test).select(of(lambda r: str(r["title"])).alias("rule"), of(lambda r: LEVELS.get(r.get("level", ""), "LOW")).alias("severity"), *df.columns)
    return sampled(hits, order, most), errors


def satisfiable(tree: Tree, fixed: dict[str, bool]) -> bool:
    """Whether a condition can be true with the selections of ``fixed`` as given and all others free."""
    value = _value(tree, fixed)
    if value is not None:
        return value
    free = next(n for n in _names(tree) if n not in fixed)
    return satisfiable(tree, fixed | {free: True}) or satisfiable(tree, fixed | {free: False})


def _names(tree: Tree) -> list[str]:
    kind, *rest = tree
    if kind == "sel":
        return [rest[0]]
    if kind == "not":
        return _names(rest[0])
    return list(rest[1]) if kind == "of" else [n for t in rest[0] for n in _names(t)]


def _value(tree: Tree, fixed: dict[str, bool]) -> bool | None:
    """The condition's value if the known selections decide it."""
    kind, *rest = tree
    if kind == "sel":
        return fixed.get(rest[0])
    if kind == "not":
        inner = _value(rest[0], fixed)
        return None if inner is None else not inner
    if kind == "of":
        known = [fixed.get(n) for n in rest[1]]
        sure, open_ = known.count(True), known.count(None)
        return True if sure >= rest[0] else False if sure + open_ < rest[0] else None
    values = [_value(t, fixed) for t in rest[0]]
    decisive = kind == "or"
    return decisive if decisive in values else None if None in values else not decisive


def _readable(body: object, compiler: Compiler) -> tuple[bool | None, set[str]]:
    """(the value a selection is bound to by fields the table lacks, or None if it is free; those fields)."""
    if isinstance(body, dict):
        lacking = {k.split("|")[0] for k in body if compiler.field(k.split("|")[0]) is None}
        denied = {f for k, v in body.items() if (f := k.split("|")[0]) in lacking and v is not None}
        return (False, denied) if denied else (True if body and len(lacking) == len(body) else None, lacking)
    if isinstance(body, list) and any(isinstance(x, dict) for x in body):
        each = [_readable(x, compiler) for x in body if isinstance(x, dict)]
        lacking = set().union(*(f for _, f in each))
        if any(v is True for v, _ in each):
            return True, lacking
        return (False if len(each) == len(body) and all(v is False for v, _ in each) else None), lacking
    return (None if [c for c in compiler.columns if c.lower() not in PROVENANCE] else False), set()


def coverage(rules: list[dict], tables: dict[str, list[str]], synonyms: dict[str, list[str]] | None = None) -> list[tuple[str, str, bool, str]]:
    """(rule, table, can_hit, why_not) of every rule on every table (name to columns): a condition over its free selections that can be true."""
    out = []
    for rule in rules:
        for table, columns in tables.items():
            title = str(rule.get("title"))
            try:
                detection, conditions = _parts(rule)
                compiler = Compiler(columns, synonyms)
                compile_rule(rule, columns, synonyms)
                bound = {name: _readable(body, compiler) for name, body in detection.items()}
                fixed = {name: v for name, (v, _) in bound.items() if v is not None}
                can = any(satisfiable(parsed(c, list(detection)), fixed) for c in conditions)
                lacking = sorted(set().union(*(f for _, f in bound.values())))
                why = "" if can else f"no field {', '.join(lacking)}" if lacking else "its condition is never true"
            except RuleError as e:
                can, why = False, str(e)
            out.append((title, table, can, why))
    return out


def coverage_table(tables: dict[str, DataFrame], rules: list[dict], synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """SIGMA_COVERAGE: rule, table, can_hit, why_not, hits (of all rows of the table)."""
    spark = next(iter(tables.values())).sparkSession
    said = spark.createDataFrame(coverage(rules, {name: df.columns for name, df in tables.items()}, synonyms), "rule string, table string, can_hit boolean, why_not string")
    hits = None
    for name, df in tables.items():
        mine = gated_matches(df, rules, df.columns[:1], synonyms, most=1)[0].select("rule", F.lit(name).alias("table"), F.col("count").alias("hits"))
        hits = mine if hits is None else hits.unionByName(mine)
    return said.join(hits, ["rule", "table"], "left").fillna(0, ["hits"])
