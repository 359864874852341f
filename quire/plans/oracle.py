"""Comparing a query's rows with its SQL's, as sorted rows of plain values."""

from __future__ import annotations

import math
import os
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def spark_rows(df: DataFrame) -> list[tuple]:
    return sorted_rows(df.columns, df.collect())


def duckdb_rows(sql: str, sf_dir: str) -> list[tuple]:
    import duckdb

    with duckdb.connect() as c:
        for t in TABLES:
            path = f"{sf_dir}/{t}.parquet"
            if os.path.exists(path):
                c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'").fetchall()
        found = c.execute(sql)
        names = [d[0] for d in found.description]
        return sorted_rows(names, found.fetchall())


def differences(run: Callable[[SparkSession, str], DataFrame], sql: str, spark: SparkSession, sf_dir: str) -> list[str]:
    """What tells the two results apart; nothing if they are equal."""
    ours, theirs = spark_rows(run(spark, sf_dir)), duckdb_rows(sql, sf_dir)
    if ours == theirs:
        return []
    both = [(a, b) for a, b in zip(ours, theirs, strict=False) if a != b][:3]
    return [f"{len(ours)} and {len(theirs)} rows", *(f"{str(a)[:600]}\n  {str(b)[:600]}" for a, b in both)]
