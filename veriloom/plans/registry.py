"""Registry of queries: name to function of (session, folder), SQL and the operators they cover."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    operators: str
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(operators: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if f.__name__ in ENTRIES:
            raise ValueError(f"two queries named {f.__name__}")
        ENTRIES[f.__name__] = Entry(f, operators, sql)
        return f

    return add
