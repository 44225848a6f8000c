"""The catalogue of runnable queries: name, Spark job, and (where SQL can say it) a twin in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    job: Job
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def add(job: Job) -> Job:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Entry(job, sql)
        return job

    return add
