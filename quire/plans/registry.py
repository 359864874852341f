"""Queries over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"l": ("bigint", "BIGINT"), "s": ("string", "VARCHAR"), "d": ("double", "DOUBLE"), "b": ("boolean", "BOOLEAN")}


@dataclass(frozen=True)
class Query:
    """``columns``: names with a type letter, as ``doc_id:l text:s``; doubles count to six places."""

    columns: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    def fields(self) -> list[tuple[str, str]]:
        return [tuple(c.split(":")) for c in self.columns.split()]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.run(spark, sf_dir)
        typed = [(n, F.col(n).cast(TYPES[t][0]), t) for n, t in self.fields()]
        return out.select(*[(F.round(c, 6) if t == "d" else c).alias(n) for n, c, t in typed])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        typed = [(n, f"CAST({n} AS {TYPES[t][1]})", t) for n, t in self.fields()]
        head, body = split_with(self.sql)
        return f"{head}SELECT {', '.join((f'round({c}, 6)' if t == 'd' else c) + f' AS {n}' for n, c, t in typed)} FROM ({body}) AS q"


def split_with(sql: str) -> tuple[str, str]:
    """The leading WITH clause, marked by a line ``--``, and the query proper."""
    if "\n--\n" not in sql:
        return "", sql.strip()
    head, body = sql.split("\n--\n")
    return head.strip() + "\n", body.strip()
