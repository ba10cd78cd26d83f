"""Knowledge graph: notes, labels and links as tables, and the questions asked of them.

notes(uuid, type, collection, label); labels(uuid, label, label_type, folded);
links(source, target, relation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as fn

BODY = ("body", "body-wikilink")


def backlinks(links: DataFrame, notes: DataFrame, target: object, per_group: int = 200) -> DataFrame:
    """Notes that link to one, by collection: relation, number in the group, place in it.

    Of several relations of one source, those outside its prose go first. The
    limit is the operator's own: items listed of a group.
    """
    own = links.where(F.col("target") == target).groupBy("source").agg(F.coalesce(F.min(F.when(~F.col("relation").isin(*BODY), F.col("relation"))), F.min("relation")).alias("relation"))
    found = own.join(notes.select(F.col("uuid").alias("source"), "collection", "label"), "source")
    by = Window.partitionBy("collection")
    return found.withColumns({"total": F.count(F.lit(1)).over(by), "place": F.row_number().over(by.orderBy("label", "source")).cast("bigint")}).where(F.col("place") <= per_group)


def out_links(links: DataFrame, notes: DataFrame, source: object) -> DataFrame:
    """A note's links with the labels of their targets; unknown targets have none."""
    return links.where(F.col("source") == source).join(notes.select(F.col("uuid").alias("target"), "collection", "label"), "target", "left")


def usage(functions: DataFrame, senses: DataFrame, links: DataFrame) -> DataFrame:
    """(uuid, sense_count, usage): how often senses use each function, also of those never used.

    ``senses`` has uuid and n as text, of which the number it starts with counts.
    """
    used = links.join(senses.select(F.col("uuid").alias("source"), "n"), "source").groupBy(F.col("target").alias("uuid")).agg(F.count(F.lit(1)).alias("sense_count"), F.sum(fn.numeric_prefix("n")).alias("usage"))
    return functions.join(used, "uuid", "left").withColumns({"sense_count": F.coalesce("sense_count", F.lit(0)), "usage": F.coalesce("usage", F.lit(0))})


def relation_types(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct records for each relation type."""
    return links.join(labels.select(F.col("uuid").alias("source"), "label"), "source").groupBy("label").agg(F.countDistinct("source").alias("records"))


def collection_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


def browse(notes: DataFrame, labels: DataFrame, collection: str, query: str | None = None) -> DataFrame:
    """Notes of a collection: with capitals in the query, whose label starts with it; else whose folded labels hold it."""
    own = notes.where(F.col("collection") == collection)
    if not query:
        return own
    if query != query.lower():
        return own.where(F.col("label").startswith(query))
    hits = labels.where(F.col("folded").contains(query)).select("uuid").distinct()
    return own.join(hits, "uuid", "left_semi")


def wikilinks(prose: DataFrame, entries: DataFrame) -> DataFrame:
    """(source, target) of ``[[name]]`` in a text; the first entry of a name counts, none links to itself.

    ``prose`` (uuid, text); ``entries`` (uuid, orth, ordinal).
    """
    first = entries.groupBy("orth").agg(F.min_by("uuid", F.struct("ordinal", "uuid")).alias("target"))
    names = prose.select(F.col("uuid").alias("source"), F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))).alias("orth")).withColumn("orth", F.trim("orth"))
    return names.join(first, "orth").where("source <> target").select("source", "target").distinct()


def label_lists(rows: DataFrame, lookup: DataFrame, key: str, ids: str) -> DataFrame:
    """(key, labels): the labels of an id list in its order; unknown ids leave a blank, only unknown ones give null."""
    items = rows.select(key, F.posexplode(ids).alias("place", "id")).join(lookup.select("id", "label"), "id", "left")
    entry = F.struct("place", F.coalesce("label", F.lit("")).alias("label"))
    joined = items.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("l"), F.count("label").alias("known"))
    made = joined.select(key, F.when(F.col("known") > 0, F.array_join(F.transform("l", lambda x: x["label"]), ", ")).alias("labels"))
    return rows.select(key).join(made, key, "left")


def concept_words(concept: object, words: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct entries with a word of a concept."""
    return words.where(F.col("concept") == concept).join(entries, "entry", "left").select("entry", "orth", "word").distinct()


def entries_full(entries: DataFrame, words: DataFrame, senses: DataFrame) -> DataFrame:
    """Entries with their words, and the words' senses in order, as nested lists."""
    sense = senses.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("ordinal", "uuid", "definition"))).alias("senses"))
    word = words.join(sense, "word", "left").groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("word", "concept", "senses"))).alias("words"))
    return entries.join(word, "entry", "left")


def sense_walk(trees: DataFrame, depth: int = 8) -> DataFrame:
    """(root, parent, node, level): nested senses as edges, level by level until none is left.

    ``trees`` (node, parent), roots without a parent. ``depth`` only stops cycles.
    """
    level = trees.where("parent is null").select(F.col("node").alias("root"), F.lit(None).cast(trees.schema["parent"].dataType).alias("parent"), "node", F.lit(0).alias("level"))
    found = level
    for n in range(1, depth + 1):
        level = level.select("root", F.col("node").alias("parent")).join(trees.where("parent is not null").select("node", "parent"), "parent").select("root", "parent", "node", F.lit(n).alias("level"))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def upserted(table: DataFrame, key: str, changed: DataFrame) -> DataFrame:
    """``table`` with all rows of the changed keys replaced."""
    return table.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed.select(table.columns))


def without(table: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return table.join(gone.select(F.col(gone.columns[0]).alias(key)).distinct(), key, "left_anti")


LABELS = {"concept": ("zh", "alt"), "word": ("orth",), "bibliography": ("title", "title_zh"), "sense": ("definition",), "syntactic-function": ("code",), "graph": ("graph",)}


def extract_labels(records: DataFrame) -> DataFrame:
    """(uuid, label, label_type) of records (uuid, type, fields map<string, array<string>>): each type has its fields."""
    rules = F.create_map(*[x for kind, fields in LABELS.items() for x in (F.lit(kind), F.array(*[F.lit(f) for f in fields]))])
    named = records.select("uuid", F.explode(F.coalesce(rules[F.col("type")], F.array().cast("array<string>"))).alias("label_type"), "fields")
    return named.select("uuid", F.explode(F.col("fields")[F.col("label_type")]).alias("label"), "label_type").where("trim(label) <> ''").dropDuplicates(["uuid", "label", "label_type"])


def extract_links(records: DataFrame, relations: dict[str, str]) -> DataFrame:
    """(source, target, relation) of records whose fields hold uuids; repeats are dropped."""
    rows = records.select(F.col("uuid").alias("source"), F.explode("fields").alias("field", "values")).where(F.col("field").isin(list(relations)))
    names = F.create_map(*[F.lit(x) for pair in relations.items() for x in pair])
    return rows.select("source", F.explode("values").alias("target"), names[F.col("field")].alias("relation")).withColumn("target", fn.bare_uuid("target")).where("target <> ''").distinct()
