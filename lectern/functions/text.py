"""Column expressions on codepoint-addressed text.

Offsets are 0-based and half-open and count codepoints. Nothing here is a UDF.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quoted(literal: str) -> str:
    """A literal as a Java regular expression."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&~#" else c for c in literal)


#: Parts of a text that one running sum takes; sums of so many are summed in turn.
_PART = 512


def _running(sizes: Column) -> Column:
    """Running sums of an array of integers.

    An array grows by copying, so the sums are made in parts of a bounded size,
    each from the sum of those before it: time in proportion to the array.
    """
    ints = "array<int>"

    def sums(values: Column, start: Column) -> Column:
        zero = F.struct(start.cast("int").alias("at"), F.array().cast(ints).alias("found"))
        return F.aggregate(values, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["found"], F.array(acc["at"] + n)).alias("found")), lambda acc: acc["found"])

    count = F.ceil(F.size(sizes) / _PART).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(sizes, i * _PART + 1, _PART))
    totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda acc, n: acc + n))
    starts = F.concat(F.array(F.lit(0)), sums(totals, F.lit(0)))
    return F.flatten(F.transform(parts, lambda part, i: sums(part, F.get(starts, i))))


def positions(text: ColumnLike, query: str) -> Column:
    """Offsets of every, also overlapping, occurrence of a literal; one pass over the text.

    The text is split in front of each occurrence, so running lengths of the
    parts are the offsets.
    """
    text = _c(text)
    parts = F.split(text, f"(?={quoted(query)})")
    inner = F.slice(parts, 1, F.size(parts) - 1)
    ends = _running(F.transform(inner, lambda part: F.length(part)))
    first = F.when(text.startswith(query), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.when(text.contains(query), F.concat(first, ends)).otherwise(F.array().cast("array<int>"))


def _joined(array: Column, step: int, count: int, length: Column) -> Column:
    """Each element with those ``step``, 2 * ``step``... places on, as one text; incomplete ones are left out."""
    shifted = F.arrays_zip(*[(F.slice(array, k * step + 1, length) if k else array).alias(f"c{k}") for k in range(count)])
    made = F.transform(shifted, lambda z: F.concat(*[z[f"c{k}"] for k in range(count)]))
    return F.filter(made, lambda g: g.isNotNull())


def exploded_grams(rows: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """(``keep``, position, gram): every window of n characters of ``text``; shorter texts have none.

    Characters are split off once; windows of a part of the length are made
    first and joined, so a long text costs time in proportion.
    """
    part = next(d for d in range(int(n**0.5), 0, -1) if n % d == 0)
    size = F.length("text")
    rows = rows.where(size >= n).select(*keep, size.alias("__n"), F.split("text", "").alias("__chars"))
    if part > 1:
        rows = rows.withColumn("__chars", _joined(F.col("__chars"), 1, part, F.col("__n")))
    if n // part > 1:
        rows = rows.withColumn("__chars", _joined(F.col("__chars"), part, n // part, F.col("__n")))
    return rows.select(*keep, F.posexplode("__chars").alias("position", "gram"))


def left_context(text: ColumnLike, start: Column, width: int) -> Column:
    return F.substring(_c(text), F.greatest(start - width, F.lit(0)) + 1, F.least(start, F.lit(width)))


def slice_text(text: ColumnLike, start: Column, length: Column) -> Column:
    return F.substring(_c(text), start + 1, length)


def left_char(left: ColumnLike) -> Column:
    return F.right(_c(left), F.lit(1))


def right_char(right: ColumnLike) -> Column:
    return F.substring(_c(right), 1, 1)


def left_bigram(left: ColumnLike) -> Column:
    return F.when(F.length(_c(left)) >= 2, F.right(_c(left), F.lit(2))).otherwise("")


def right_bigram(right: ColumnLike) -> Column:
    return F.when(F.length(_c(right)) >= 2, F.substring(_c(right), 1, 2)).otherwise("")


def around(left: ColumnLike, right: ColumnLike) -> Column:
    """The last character before and the first after, where both exist."""
    return F.when((F.length(_c(left)) > 0) & (F.length(_c(right)) > 0), F.concat(left_char(left), right_char(right))).otherwise("")


def years(raw: ColumnLike) -> Column:
    """All years in free text; "- 390" is BCE, a dash after a digit is a range."""
    found = F.regexp_extract_all(_c(raw), F.lit(r"((?<!\d)-?\s*\d+)"), F.lit(1))
    return F.transform(found, lambda y: F.regexp_replace(y, r"\s", "").cast("int"))


def period_year(period: ColumnLike) -> Column:
    """The first number of a period, made negative when the period is marked BCE; null when there is none."""
    number = F.regexp_extract(_c(period), r"(-?\d+)", 1)
    year = F.when(number != "", number.cast("int"))
    return F.when((year > 0) & _c(period).rlike(r"前|BC|B\.C\."), -year).otherwise(year)


def century(year: ColumnLike) -> Column:
    """struct(key, label, start, end); years up to 0 are BCE, 0 in the first century."""
    year = _c(year)
    number = F.when(year > 0, F.floor((year - 1) / 100) + 1).otherwise(F.greatest(F.floor((-year - 1) / 100) + 1, F.lit(1))).cast("int")
    teens = F.pmod(number, F.lit(100)).between(10, 20)
    ones = F.pmod(number, F.lit(10))
    suffix = F.when(teens, "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")
    ce = year > 0
    era = F.when(ce, "ce").otherwise("bce")
    return F.struct(
        F.concat(era, F.lit("-"), F.when(number < 10, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))).alias("key"),
        F.concat(number.cast("string"), suffix, F.lit(" c. "), F.upper(era)).alias("label"),
        F.when(ce, (number - 1) * 100 + 1).otherwise(-(number * 100)).alias("start"),
        F.when(ce, number * 100).otherwise(F.when(number == 1, 0).otherwise(-((number - 1) * 100 + 1))).alias("end"),
    )


def index_date(not_before: ColumnLike, not_after: ColumnLike, other_before: ColumnLike, other_after: ColumnLike) -> Column:
    """struct(value, source): the second pair of bounds wins if both are there.

    Equal bounds give their value, more than a hundred years the start, else the
    midpoint rounded down.
    """

    def of(a: Column, b: Column, single: str, middle: str, wide: str) -> Column:
        low, high = F.least(a, b), F.greatest(a, b)
        value = F.when(high - low > 100, low).otherwise(F.floor((low + high) / 2)).cast("int")
        source = F.when(low == high, single).when(high - low > 100, wide).otherwise(middle)
        return F.struct(value.alias("value"), source.alias("source"))

    a, b, c, d = _c(not_before), _c(not_after), _c(other_before), _c(other_after)
    second = of(c, d, "dzt_date", "dzt_date_midpoint", "dzt_date_not_before_wide_range")
    first = of(a, b, "midpoint", "midpoint", "not_before_wide_range")
    return F.when(c.isNotNull() & d.isNotNull(), second).when(a.isNotNull() & b.isNotNull(), first)


def section_code(textid: ColumnLike) -> Column:
    code = F.regexp_extract(_c(textid), r"^(KR\d+[a-z]+)", 1)
    return F.when(code != "", code)


def normal_text_id(value: ColumnLike) -> Column:
    """``1h4`` and ``KR1h4`` become ``KR1h0004``; other values pass through."""
    value = F.trim(_c(value))
    section, serial = (F.regexp_extract(value, r"^(?:KR)?([0-9][a-z])([0-9]{1,4})$", i) for i in (1, 2))
    return F.when(serial != "", F.concat(F.lit("KR"), section, F.lpad(serial, 4, "0"))).otherwise(value)


def short_ref(textid: ColumnLike, seq: ColumnLike, bucket: ColumnLike, start: ColumnLike, length: ColumnLike) -> Column:
    """``1h4/1/@0+86``; the bucket is left out when it is the body. Null for other schemes of ids."""
    section, serial = (F.regexp_extract(_c(textid), r"^KR([0-9][a-z])0*([0-9]+)$", i) for i in (1, 2))
    bucket = F.when(_c(bucket) == "body", "").otherwise(_c(bucket))
    text = lambda c: _c(c).cast("string")
    return F.when(serial != "", F.concat(section, serial, F.lit("/"), text(seq), F.lit("/"), bucket, F.lit("@"), text(start), F.lit("+"), text(length)))


_REF = r"^(?:KR)?([0-9][a-z])([0-9]{1,4})/([0-9]+)(?:/(?=@|(?:front|body|back)(?:@|$))(front|body|back)?(?:@([0-9]+)\+([0-9]+))?)?$"


def parsed_ref(ref: ColumnLike) -> Column:
    """struct(textid, seq, bucket, offset, length) of a short reference; null when it is none."""
    ref = F.trim(_c(ref))
    part = lambda i: F.regexp_extract(ref, _REF, i)
    number = lambda i: F.when(part(i) != "", part(i).cast("int"))
    return F.when(
        ref.rlike(_REF),
        F.struct(
            F.concat(F.lit("KR"), part(1), F.lpad(part(2), 4, "0")).alias("textid"),
            number(3).alias("seq"),
            F.when(part(4) != "", part(4)).otherwise("body").alias("bucket"),
            number(5).alias("offset"),
            number(6).alias("length"),
        ),
    )


def numeric_prefix(value: ColumnLike) -> Column:
    """The integer at the start of a text, else 0: how a lenient cast reads it."""
    return F.coalesce(F.regexp_extract(_c(value), r"^\s*([-+]?\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def bare_uuid(value: ColumnLike) -> Column:
    """Without ``uuid-``, anything after white space, and any fragment."""
    return F.substring_index(F.element_at(F.split(F.regexp_replace(F.trim(_c(value)), "^uuid-", ""), r"\s+"), 1), "#", 1)


def relative_marker(marker_id: ColumnLike) -> Column:
    return F.substring_index(_c(marker_id), "_tls_", -1)


def is_ai(title: ColumnLike, names: ColumnLike) -> Column:
    """Whether a title or any named contributor says AI."""
    word = r"\bAI\b"
    return F.coalesce(_c(title).rlike(word), F.lit(False)) | F.coalesce(F.exists(_c(names), lambda n: n.rlike(word)), F.lit(False))


def body_char(char: ColumnLike) -> Column:
    """Whether a character may stand in a text's body: ideographs and the private plane 16 range."""
    cp = F.ascii(_c(char))
    ranges = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2EE5D), (0x2F800, 0x2FA1F), (0x30000, 0x323AF), (0x105000, 0x108FFF))
    test = F.lit(False)
    for low, high in ranges:
        test = test | cp.between(low, high)
    return test


def iso_micros(stamp: ColumnLike) -> Column:
    """Microseconds of an ISO-8601 stamp, 0 when it cannot be read."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(_c(stamp))), F.lit(0).cast("bigint"))


def text_hash(text: ColumnLike) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_c(text), 256))


def plain_word(pattern: str) -> bool:
    """Whether a regular expression is a literal."""
    return re.escape(pattern) == pattern
