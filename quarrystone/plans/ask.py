"""Read-only SQL over a case's tables, within limits of time and size; playbooks of parameterised steps."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, MOST_ROWS, CELL, SECONDS = 200, 2000, 600, 30


class CaseError(ValueError):
    """A question that is not answered, with the reason."""


@dataclass
class Answer:
    columns: list[str]
    rows: list[dict[str, str]]
    notes: list[str] = field(default_factory=list)


def checked(sql: str) -> str:
    """The statement, if it is one SELECT or WITH."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";").strip()
    if ";" in re.sub(r"'(?:[^']|'')*'", "''", text):
        raise CaseError("one statement at a time")
    if not re.match(r"(?is)^(select|with)\b", text):
        raise CaseError("only SELECT and WITH are answered")
    return text


class Case:
    """Tables by name; names are temporary views of one session."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, tables
        for name, df in tables.items():
            df.createOrReplaceTempView(name)

    def list_tables(self) -> list[dict]:
        return [{"table": n, "columns": df.columns, "rows": df.count()} for n, df in sorted(self.tables.items())]

    def query(self, sql: str, limit: int = ROWS, seconds: float = SECONDS, args: dict | None = None) -> Answer:
        """At most ``limit`` rows. A plan that is a command is refused; a run that takes too long is cancelled."""
        cap = max(1, min(MOST_ROWS, int(limit)))
        text = checked(sql)
        try:
            df = self.spark.sql(text, args=args or {})
        except Exception as e:
            raise CaseError(self._explained(text, str(e).split("\n")[0][:300])) from None
        rows = self._within(df.limit(cap + 1), seconds)
        notes = [f"only the first {cap} rows are shown"] if len(rows) > cap else []
        if not rows:
            notes += self._why_empty(text)
        return Answer(df.columns, [{c: self._cell(r[i]) for i, c in enumerate(df.columns)} for r in rows[:cap]], notes)

    @staticmethod
    def _cell(v: object) -> str:
        s = "" if v is None else str(v)
        return s if len(s) <= CELL else s[: CELL - 3] + "..."

    def _within(self, df: DataFrame, seconds: float) -> list:
        """The rows, if they are there in time. The run has a thread of its own, so the answer is not
        held up by tasks that take long to notice that they are cancelled. A task in a nested loop over a
        broadcast side notices only between its outer rows; spark.task.reaper ends such tasks on a cluster."""
        sc, group = self.spark.sparkContext, f"case-{uuid.uuid4().hex}"
        out: list = []
        failed: list[Exception] = []

        def run() -> None:
            sc.setJobGroup(group, "a question to the case", interruptOnCancel=True)
            try:
                out.append(df.collect())
            except Exception as e:
                failed.append(e)

        worker = InheritableThread(target=run, session=self.spark)
        worker.daemon = True
        worker.start()
        worker.join(seconds)
        if worker.is_alive():
            sc.cancelJobGroup(group)
            raise CaseError(f"stopped after {seconds:g} s; narrow the question")
        if failed:
            raise failed[0]
        return out[0]

    def _named(self, sql: str) -> list[str]:
        return [n for n in self.tables if re.search(rf"(?i)\b{re.escape(n)}\b", sql)]

    def _explained(self, sql: str, error: str) -> str:
        return error + "".join(f"; {n} has {', '.join(self.tables[n].columns)}" for n in self._named(sql))

    def _why_empty(self, sql: str) -> list[str]:
        """For columns that are compared with a text, what they really hold."""
        notes = []
        for n in self._named(sql):
            if self.tables[n].isEmpty():
                notes.append(f"{n} is empty")
                continue
            for c in dict.fromkeys(re.findall(r"(?i)\b(\w+)\s*(?:=|LIKE|ILIKE)\s*'", sql)):
                if c in self.tables[n].columns:
                    top = self.tables[n].groupBy(F.col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(8).collect()
                    notes.append(f"{n}.{c} has values such as " + ", ".join(repr(r["v"]) for r in top))
        return notes

    def values(self, table: str, column: str, limit: int = ROWS) -> Answer:
        df = self._table(table)
        if column not in df.columns:
            raise CaseError(f"{table} has no column {column}; it has {', '.join(df.columns)}")
        top = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(min(limit, MOST_ROWS)).collect()
        return Answer(["value", "n"], [{"value": self._cell(r["value"]), "n": str(r["n"])} for r in top])

    def row(self, table: str, where: dict[str, str], limit: int = 20) -> Answer:
        df = self._table(table)
        for c, v in where.items():
            df = df.where(F.coalesce(F.col(c).cast("string"), F.lit("")) == v)
        rows = df.limit(max(1, min(MOST_ROWS, int(limit)))).collect()
        return Answer(df.columns, [{c: self._cell(r[c]) for c in df.columns} for r in rows])

    def _table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise CaseError(f"no table called {name}; there are {', '.join(sorted(self.tables))}")
        return self.tables[name]

    def playbook(self, name: str, **args: str) -> list[tuple[str, Answer | str]]:
        """Each step's title and answer, or that its table is absent."""
        if name not in PLAYBOOKS:
            raise CaseError(f"no playbook called {name}; there are {', '.join(PLAYBOOKS)}")
        out: list[tuple[str, Answer | str]] = []
        for title, needs, sql in PLAYBOOKS[name]:
            absent = [t for t in needs if t not in self.tables]
            used = {k: v for k, v in args.items() if f":{k}" in sql}
            try:
                out.append((title, f"{', '.join(absent)} was not collected" if absent else self.query(sql, args=used)))
            except CaseError as e:  # a table without a column that the step needs
                out.append((title, str(e)))
        return out


PLAYBOOKS = {
    "triage_host": [
        ("Findings by severity", ["FINDINGS"], "SELECT severity, count(*) AS n FROM FINDINGS GROUP BY severity"),
        ("Sources of failed logins", ["FAILED_LOGINS"], "SELECT source_ip, count(*) AS n, count(DISTINCT user) AS users FROM FAILED_LOGINS GROUP BY source_ip ORDER BY n DESC"),
        ("What starts by itself", ["CRON"], "SELECT file, schedule, run_as, command FROM CRON"),
    ],
    "profile_address": [
        ("Sign-ins", ["AUTH_LOG"], "SELECT timestamp_utc, event, user, result FROM AUTH_LOG WHERE source_ip = :address ORDER BY timestamp_utc"),
        ("Failures", ["FAILED_LOGINS"], "SELECT kind, count(*) AS n FROM FAILED_LOGINS WHERE source_ip = :address GROUP BY kind"),
        ("Requests", ["WEB_LOG"], "SELECT method, resource, status, count(*) AS n FROM WEB_LOG WHERE client_ip = :address GROUP BY method, resource, status"),
        ("Open sockets", ["SOCKETS"], "SELECT process, peer_port, state FROM SOCKETS WHERE peer_addr = :address"),
    ],
    "profile_user": [
        ("Sign-ins", ["AUTH_LOG"], "SELECT timestamp_utc, event, source_ip, result FROM AUTH_LOG WHERE user = :user ORDER BY timestamp_utc"),
        ("Commands", ["SHELL_HISTORY"], "SELECT timestamp_utc, command FROM SHELL_HISTORY WHERE user = :user"),
    ],
    "persistence": [("Schedules", ["CRON"], "SELECT * FROM CRON"), ("Units", ["SYSTEMD_UNITS"], "SELECT unit, exec_start, scope FROM SYSTEMD_UNITS")],
    "web_intrusion": [("Answered requests", ["WEB_LOG"], "SELECT client_ip, resource, count(*) AS n FROM WEB_LOG WHERE try_cast(status AS INT) BETWEEN 200 AND 399 GROUP BY client_ip, resource ORDER BY n DESC")],
    "privilege_escalation": [("Privilege use", ["AUTH_LOG"], "SELECT timestamp_utc, event, user, target_user, result FROM AUTH_LOG WHERE event_class = 'priv' ORDER BY timestamp_utc")],
    "egress": [("Connections out", ["SOCKETS"], "SELECT process, peer_addr, peer_port FROM SOCKETS WHERE state ILIKE 'estab%'")],
}
