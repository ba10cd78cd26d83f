"""Characters: survey, charset checks, canonical forms, variants, private-use counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as fn

PUA_LOW, PUA_HIGH = 0x105000, 0x108FFF


def survey(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, char, codepoint, n): how often each character occurs.

    Characters are split off and counted in one aggregation, which combines
    them where they lie: a corpus of any size shuffles a row for each character
    and task.
    """
    chars = rows.where("text <> ''").select(*keys, F.explode(F.split("text", "")).alias("char"))
    return chars.groupBy(*keys, "char").agg(F.count(F.lit(1)).alias("n")).withColumn("codepoint", F.ascii("char"))


def rollup(counts: DataFrame, ranges: list[tuple[str, int, int]]) -> DataFrame:
    """(block, distinct, total) of a survey by named codepoint ranges; the rest is ``other``."""
    block = F.lit("other")
    for name, low, high in reversed(ranges):
        block = F.when(F.col("codepoint").between(low, high), name).otherwise(block)
    return counts.groupBy(block.alias("block")).agg(F.countDistinct("char").alias("distinct_chars"), F.sum("n").alias("total"))


def findings(rows: DataFrame, key: str, allowed: Column) -> DataFrame:
    """(key, char, severity, n): characters outside the set; control characters are errors."""
    counts = survey(rows, key).where(~allowed)
    severity = F.when(F.col("codepoint") < 32, "error").otherwise("warning")
    return counts.select(key, "char", severity.alias("severity"), "n")


def canonical(text: Column, mapping: dict[str, str]) -> Column:
    """A text with each mapped character replaced, one for one; others pass."""
    return F.translate(text, "".join(mapping), "".join(mapping.values()))


def substitutions(rows: DataFrame, key: str, mapping: dict[str, str]) -> DataFrame:
    """(key, offset, content, replacement) for each place that ``canonical`` changes."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    chars = rows.where(F.col("text").rlike("[" + "".join(fn.quoted(c) for c in mapping) + "]")).select(key, F.posexplode(F.split("text", "")).alias("offset", "content"))
    return chars.where(F.col("content").isin(list(mapping))).withColumn("replacement", table[F.col("content")])


def unmapped(rows: DataFrame, charset: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(char, n): characters that are neither in the charset (char) nor mapped into it."""
    counts = survey(rows).where(~F.col("char").isin(list(mapping)))
    return counts.join(charset.select("char").distinct(), "char", "left_anti").select("char", "n")


def strict(rows: DataFrame, charset: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """``rows`` in canonical form; a character without one is an error."""
    bad = unmapped(rows, charset, mapping).orderBy(F.desc("n"), "char").limit(5).collect()
    if bad:
        raise ValueError(f"no canonical form for {[r['char'] for r in bad]}")
    return rows.withColumn("text", canonical(F.col("text"), mapping))


def reverted(text: Column, marks: Column) -> Column:
    """A text with substitution marks (offset, content, replacement) undone; null if a replacement is not in place."""
    valid = ~F.exists(marks, lambda m: F.substring(text, m["offset"] + 1, 1) != m["replacement"])
    unique = F.size(F.array_distinct(F.transform(marks, lambda m: m["offset"]))) == F.size(marks)
    undone = F.aggregate(marks, text, lambda t, m: F.overlay(t, m["content"], m["offset"] + 1, F.lit(1)))
    return F.when(valid & unique, undone)


def check_mapping(entries: DataFrame, charset: DataFrame) -> DataFrame:
    """(char, problem): sources that are canonical already, replacements that are not, repeated sources."""
    chars = charset.select("char").distinct()
    source = entries.select(F.col("source").alias("char")).join(chars, "char", "left_semi").withColumn("problem", F.lit("source is canonical"))
    target = entries.select(F.col("replacement").alias("char")).join(chars, "char", "left_anti").withColumn("problem", F.lit("replacement is not canonical"))
    twice = entries.groupBy(F.col("source").alias("char")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("char", F.lit("repeated source").alias("problem"))
    return source.unionByName(target).unionByName(twice).distinct()


def lemma_repeats(rows: DataFrame, sign: str = "丨") -> DataFrame:
    """(voice, position, replacement): repeat signs in dictionary spans, filled with their lemma's characters in turn.

    ``rows`` has voice, lemma, start and text, the span's own text.
    """
    from pyspark.sql import Window

    signs = rows.where(F.col("text").contains(sign)).select("voice", "lemma", "start", F.explode(fn.positions("text", sign)).alias("at"))
    turn = F.row_number().over(Window.partitionBy("voice").orderBy("at")) - 1
    return signs.withColumn("__t", turn).select("voice", (F.col("start") + F.col("at")).alias("position"), F.substring(F.col("lemma"), F.pmod(F.col("__t"), F.length("lemma")) + 1, F.lit(1)).alias("replacement"))


def variant_pairs(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Unordered pairs with both members in the corpus: major and minor by count, ratio, types.

    ``pairs`` has a, b and type; ``counts`` char and n.
    """
    unordered = pairs.where("a <> b").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.array_sort(F.collect_set("type")).alias("types"))
    joined = unordered.join(counts.select(F.col("char").alias("x"), F.col("n").alias("nx")), "x").join(counts.select(F.col("char").alias("y"), F.col("n").alias("ny")), "y")
    swap = F.col("ny") > F.col("nx")
    return joined.select(
        F.when(swap, F.col("y")).otherwise(F.col("x")).alias("major"),
        F.greatest("nx", "ny").alias("count_major"),
        F.when(swap, F.col("x")).otherwise(F.col("y")).alias("minor"),
        F.least("nx", "ny").alias("count_minor"),
        (F.least("nx", "ny") / F.greatest("nx", "ny")).alias("ratio"),
        "types",
    )


def variant_overlap(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(type, side, distinct_chars, total): how much of the corpus each variant type touches."""
    sides = pairs.select("type", F.lit("source").alias("side"), F.col("a").alias("char")).unionByName(pairs.select("type", F.lit("target").alias("side"), F.col("b").alias("char"))).distinct()
    return sides.join(counts.select("char", "n"), "char").groupBy("type", "side").agg(F.count(F.lit(1)).alias("distinct_chars"), F.sum("n").alias("total"))


def pending(pairs: DataFrame, folded: DataFrame) -> DataFrame:
    """Pairs that are not folded yet, either way round."""
    known = folded.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    return pairs.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(known, ["x", "y"], "left_anti").drop("x", "y")


def usage_share(rows: DataFrame, low: float = 0.0) -> DataFrame:
    """``rows`` (reg, var counts) with the share of the regular form, from ``low`` on."""
    share = F.when(F.col("reg") + F.col("var") > 0, F.col("reg") / (F.col("reg") + F.col("var")))
    return rows.withColumn("reg_share", share).where(F.col("reg_share") >= low)


def private_use(rows: DataFrame, key: str) -> DataFrame:
    """(key, char, n) of characters of the private plane."""
    return survey(rows, key).where(F.col("codepoint").between(PUA_LOW, PUA_HIGH)).select(key, "char", "codepoint", "n")


def dossier(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, chars, unique_chars) of texts."""
    return survey(rows, *keys).groupBy(*keys).agg(F.sum("n").alias("chars"), F.count(F.lit(1)).alias("unique_chars"))
