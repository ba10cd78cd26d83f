"""All queries of the library by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import bundle_queries, catalog_queries, function_queries, passage_queries, reader_queries, search_queries, stream_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _module in (search_queries, passage_queries, catalog_queries, text_queries, stream_queries, reader_queries, function_queries, bundle_queries):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
FLAGSHIP = "kwic_literal"
