"""A registered query: a function (spark, folder) -> DataFrame and, where it can be said in SQL, its check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    check: str | None = None


REGISTRY: dict[str, Query] = {}


def register(name: str, build: Build, check: str | None = None) -> None:
    if name in REGISTRY:
        raise ValueError(f"query {name} is registered twice")
    REGISTRY[name] = Query(build, check)
