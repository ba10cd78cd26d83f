"""Table functions for SQL: ``kwic(text, query, context)`` and ``shingles(text, n)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf


class Kwic:
    """Every, also overlapping, occurrence of a literal with its context."""

    def eval(self, text: str, query: str, context: int) -> Iterator[tuple[int, str, str, str]]:
        at = (text or "").find(query) if query else -1
        while at >= 0:
            end = at + len(query)
            yield at, text[max(0, at - context) : at], text[at:end], text[end : end + context]
            at = text.find(query, at + 1)


class Shingles:
    """Every window of n characters with its position."""

    def eval(self, text: str, n: int) -> Iterator[tuple[int, str]]:
        for at in range(len(text or "") - n + 1):
            yield at, text[at : at + n]


_KWIC = T.StructType([T.StructField("master_offset", T.IntegerType())] + [T.StructField(c, T.StringType()) for c in ("left", "match", "right")])
_SHINGLES = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("gram", T.StringType())])


def register(spark: SparkSession) -> None:
    spark.udtf.register("kwic", udtf(Kwic, returnType=_KWIC))
    spark.udtf.register("shingles", udtf(Shingles, returnType=_SHINGLES))
