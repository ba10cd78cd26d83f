"""A thin command line over tables of texts: ``python -m lectern COMMAND --data DIR``.

``run`` runs a registered query; the other commands are operators with their
parameters at the operators' own defaults.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import catalog, chars, passages, search
from lectern.plans import registry
from lectern.plans.search_queries import sources
from lectern.shipping import ship
from lectern.sources import readers
from lectern.storage import stored

Arguments = argparse.Namespace


@dataclass
class Command:
    """What a command says of itself, its options (flag: settings) and the rows it makes."""

    help: str
    make: Callable[[SparkSession, Arguments], DataFrame]
    options: dict[str, dict] = field(default_factory=dict)


def _texts(spark: SparkSession, given: Arguments) -> DataFrame:
    rows = sources(spark, given.data)
    return rows.where(F.col("textid").isin(given.textid)) if given.textid else rows


def _search(spark: SparkSession, given: Arguments) -> DataFrame:
    return search.search(sources(spark, given.data), given.query, given.context, given.distance, given.textid)


def _spans(spark: SparkSession, given: Arguments) -> DataFrame:
    return stored(passages.scan(_texts(spark, given), given.anchor, given.least, given.most, given.edits), "spans")


def _clusters(spark: SparkSession, given: Arguments) -> DataFrame:
    if given.edits:
        return passages.fuzzy_occurrences(_texts(spark, given), _spans(spark, given), given.edits, given.occurrences)
    found = passages.exact_occurrences(_texts(spark, given), _spans(spark, given), given.occurrences)
    return passages.listed(passages.uncontained(found, given.occurrences) if given.uncontained else found)


def _pairs(spark: SparkSession, given: Arguments) -> DataFrame:
    lengths = _texts(spark, given).select("bucket_id", F.length("text").alias("chars"))
    return passages.pair_rows(_spans(spark, given), lengths, given.chars)


def _facets(spark: SparkSession, given: Arguments) -> DataFrame:
    counts = search.facets(search.neighbours(_search(spark, given)), ["textid", "kind", "left_char", "right_char", "left_bigram", "right_bigram", "around"])
    return counts.orderBy("dim", F.desc("n"), "value")


def _catalog(spark: SparkSession, given: Arguments) -> DataFrame:
    return catalog.from_csv_rows(readers.catalog_rows(spark, given.csv))


QUERY = {"query": {"help": "a literal, /expression/flags, A NEAR B or A NOT B"}, "--context": {"type": int, "default": 20}, "--distance": {"type": int, "default": 20}}
SCAN = {
    "--anchor": {"type": int, "default": 12, "help": "characters of an anchor"},
    "--least": {"type": int, "default": 24, "help": "characters of a passage at least"},
    "--most": {"type": int, "default": 200, "help": "places of an anchor at most"},
    "--edits": {"type": int, "default": 0, "help": "edits that two places may be apart"},
}
COMMANDS = {
    "run": Command("a registered query", lambda spark, given: registry.QUERIES[given.name](spark, given.data), {"name": {"choices": sorted(registry.QUERIES)}}),
    "search": Command("concordance of a query", _search, QUERY),
    "summary": Command("hits of a query by text", lambda spark, given: search.textids(_search(spark, given)), QUERY),
    "facets": Command("facets of a query's hits", _facets, QUERY),
    "survey": Command("characters and how often they occur", lambda spark, given: chars.survey(_texts(spark, given))),
    "spans": Command("repeated passages of pairs of texts", _spans, SCAN),
    "clusters": Command("repeated passages with all their places", _clusters, SCAN | {"--occurrences": {"type": int, "default": 2}, "--uncontained": {"action": "store_true", "help": "leave out clusters that a longer one contains"}}),
    "pairs": Command("duplicated pairs of texts", _pairs, SCAN | {"--chars": {"type": int, "default": 100, "help": "characters in common at least"}}),
    "catalog": Command("a catalog table with dates and sections", _catalog, {"csv": {"help": "the table's path"}}),
}


def parser() -> argparse.ArgumentParser:
    whole = argparse.ArgumentParser(prog="lectern", description=__doc__)
    commands = whole.add_subparsers(dest="command", required=True)
    for name, command in COMMANDS.items():
        own = commands.add_parser(name, help=command.help)
        for flag, settings in command.options.items():
            own.add_argument(flag, **settings)
        own.add_argument("--data", required=name != "catalog", help="folder of the tables")
        own.add_argument("--textid", action="append", help="only this text; may be repeated")
        own.add_argument("--out", help="folder for the result as Parquet; without it, rows are shown")
        own.add_argument("--rows", type=int, default=20, help="rows shown")
    commands.add_parser("list", help="names of registered queries")
    return whole


def main(arguments: list[str] | None = None) -> None:
    given = parser().parse_args(arguments)
    if given.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    rows = COMMANDS[given.command].make(spark, given)
    if given.out:
        rows.write.mode("overwrite").parquet(given.out)
    else:
        rows.show(given.rows, truncate=False)


if __name__ == "__main__":
    main()
