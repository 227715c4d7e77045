"""Registration of queries: a function over the fixture views, and its comparison SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import AS_OF, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class Views:
    """The fixture views of one data folder, read when asked for."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(*views: str, sql: str | None = None, name: str | None = None):
    """Register ``f(v)``; ``sql`` may use the named views and ``$AS_OF``."""

    def register(f: Callable[[Views], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            text = sql.replace("$AS_OF", f"TIMESTAMP '{AS_OF}'")
            ORACLES[key] = with_views(text, *views) if views else text
        return f

    return register
