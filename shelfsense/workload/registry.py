"""Registration of queries and access to the tables they read."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..operators.sentiment import word_table
from ..session import scratch_path
from ..sources.readers import spread_small
from .fixtures import FIXTURES

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Tables whose rows cost much work each, and the key that spreads a small copy of them.
SPREAD = {"documents": "doc_id", "pages": "page_id", "part": "p_partkey"}


class Tables:
    """Given tables and the ones derived from them, by attribute; all lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = self._load(name)
        return self._known[name]

    def _load(self, name: str) -> DataFrame:
        if name in FIXTURES:
            sources = {n: getattr(self, n) for n in _sources(FIXTURES[name])}
            return self.spark.sql(FIXTURES[name], **sources)
        if name in GIVEN:
            table = self.spark.read.parquet(self.path(name))
            return spread_small(table, SPREAD[name]) if name in SPREAD else table
        raise AttributeError(f"no table {name}")

    def provide(self, name: str, table: DataFrame) -> None:
        """Use ``table`` where the given or derived table ``name`` is asked for."""
        self._known[name] = table

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    @property
    def words(self) -> DataFrame:
        return word_table(self.valence_lexicon, self.polarity_lexicon, self.modifiers)

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)


class Query(NamedTuple):
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(run, sql)
        return run

    return register


def _sources(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def _prelude(sql: str) -> str:
    """WITH list of the derived tables ``sql`` names, in order of dependence."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in needed or name not in FIXTURES:
            return
        for source in _sources(FIXTURES[name]):
            add(source)
        needed.append(name)

    words = set(re.findall(r"\w+", sql))
    for name in FIXTURES:
        if name in words:
            add(name)
    parts = [
        f"{n} AS ({FIXTURES[n].format(**{s: s for s in _sources(FIXTURES[n])})})" for n in needed
    ]
    own = re.match(r"\s*WITH\s+(.*)", sql, re.S | re.I)
    if not parts:
        return sql
    if own:
        return "WITH " + ",\n".join(parts) + ",\n" + own.group(1)
    return "WITH " + ",\n".join(parts) + "\n" + sql


def oracle_texts() -> dict[str, str]:
    return {name: _prelude(q.sql) for name, q in QUERIES.items() if q.sql}


def runners() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query):
        return lambda spark, folder: q.run(Tables(spark, folder))

    return {name: bind(q) for name, q in QUERIES.items()}
