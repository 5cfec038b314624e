"""Registered queries: name -> (builder, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Builder
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Builder], Builder]:
    """Registers a builder under its own name, with its SQL twin where there is one."""

    def add(build: Builder) -> Builder:
        key = name or build.__name__
        if key in REGISTRY:
            raise ValueError(f"{key} is registered twice")
        REGISTRY[key] = Entry(build, sql)
        return build

    return add
