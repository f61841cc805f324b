"""The table of registered queries; query modules fill it, ``catalog`` imports them all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None):
    def deco(fn):
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(fn, sql)
        return fn
    return deco


def joined(col: str, sep: str = " -> "):
    return F.concat_ws(sep, F.col(col)).alias(col)
