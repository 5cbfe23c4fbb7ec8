"""Registering queries with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: CTEs of the table that crc() looks up: tab(t) is to be in the FROM clause.
CRC = """byte AS (SELECT range AS b FROM range(256)),
    step(b, k, c) AS (SELECT b, 0, b FROM byte UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
    tab AS (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8)"""


def crc(key: str, seed: int = 42) -> str:
    """SQL for ranks.checksum of an ASCII key."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({key}::VARCHAR || '/{seed}', ''), lambda ch: ord(ch)::BIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"""


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable:
        def of(query: Callable[[SparkSession, str], DataFrame]) -> Callable:
            self.queries[name or query.__name__] = query
            if sql:
                self.oracles[name or query.__name__] = sql
            return query

        return of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
