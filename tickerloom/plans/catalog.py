"""All queries of the engine with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickerloom.operators import advice, changes, clients, dedupe, duplicate_registry, feeds, graph, ingest, lookups, piece_index, search, source_history, store_queries, trends
from tickerloom.sources.domain import News
from tickerloom.streaming import alerts, stateful

MODULES = (feeds, trends, dedupe, duplicate_registry, graph, lookups, changes, ingest, source_history, search, piece_index, store_queries, advice, clients, alerts, stateful)


def _over_folder(query: Callable[[News], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(News(spark, sf_dir))


QUERIES = {name: _over_folder(query) for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: text for m in MODULES for name, text in m.SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["client_feed"](spark, sf_dir)
