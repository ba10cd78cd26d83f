"""Files as DataFrames: bundles, catalogs, annotations, translations, reports, markup.

Whole-file formats are read with Spark's own file scans and parsed where they
lie, so a corpus is listed once and parsed by all executors. A file that cannot
be parsed is a row with ``parse_error``, not an end of the job.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.sources import schemas

BUCKETS = ("front", "body", "back")
MARKER_KEYS = ("offset", "length", "type", "id", "content")


def files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, modified, content) of whole files anywhere below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("content"))


def discover(spark: SparkSession, root: str, prefix: str | None = None, text_ids: list[str] | None = None, max_depth: int = 4) -> DataFrame:
    """(textid, path, modified, content) of manifests ``X/X.manifest.yaml`` up to a depth."""
    found = files(spark, root, "*.manifest.yaml")
    textid, folder = F.regexp_extract("path", r"([^/]+)\.manifest\.yaml$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    base = re.sub("^file:/+", "/", root.rstrip("/"))  # Spark's own paths have one slash there, whatever the root has
    below = F.size(F.split(F.regexp_replace("path", "^.*?" + fn.quoted(base), ""), "/")) - 2
    found = found.withColumn("textid", textid).where((textid == folder) & (below <= max_depth))
    if prefix is not None:
        found = found.where(F.col("textid").startswith(prefix))
    if text_ids is not None:
        found = found.where(F.col("textid").isin(text_ids))
    return found.select("textid", "path", "modified", "content")


def _parsed(frame: pd.DataFrame, parse: Callable[..., Any], columns: list[str]) -> pd.DataFrame:
    rows = []
    for row in frame.itertuples(index=False):
        try:
            rows.extend(parse(row))
        except Exception as error:  # reported in the row
            rows.append({k: v for k, v in {"parse_error": f"{type(error).__name__}: {error}", **_identity(row)}.items() if k in columns})
    return pd.DataFrame(rows, columns=columns).astype(object).where(lambda f: f.notna(), None)


def _runner(parse: Callable[..., Any], columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``parse`` over the rows of frames, for ``mapInPandas``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(made := _parsed(frame, parse, columns)):
                yield made

    return run


def _identity(row: Any) -> dict[str, Any]:
    known = {k: getattr(row, k) for k in ("textid", "path", "juan_seq") if hasattr(row, k)}
    return known | {"translation_id": known.get("textid") or known.get("path")}


def _columns(ddl: str) -> list[str]:
    depth, names, word = 0, [], ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            names.append(word.split()[0])
            word = ""
        else:
            word += c
    return names


def _number(value: Any) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def _text(value: Any) -> str | None:
    return None if value is None else str(value)


def manifests(found: DataFrame) -> DataFrame:
    """Manifests as typed rows; spans of contents that are not [bucket, start, end] are skipped."""
    columns = _columns(schemas.MANIFEST)

    def parse(row: Any) -> list[dict]:
        import yaml

        m = yaml.safe_load(row.content) or {}
        meta = m.get("metadata") or {}
        toc = []
        for entry in m.get("table_of_contents") or []:
            ref = entry.get("ref") or {}
            span = ref.get("span")
            if isinstance(span, list) and len(span) == 3 and isinstance(span[0], str) and all(_number(x) is not None for x in span[1:]):
                toc.append({"marker_id": _text(ref.get("marker_id")), "label": _text(entry.get("label")), "seq": _number(ref.get("seq")), "bucket": span[0], "start": span[1], "end": span[2]})
        idents: dict[str, list[str]] = {}
        for source in (meta.get("identifiers"), m.get("identifiers")):
            for kind, value in (source or {}).items():
                idents.setdefault(str(kind), []).extend(str(v) for v in (value if isinstance(value, list) else [value]) if v is not None)
        assets = m.get("assets") or {}
        part = lambda p, names: {n: (_number(p.get(n)) if n == "seq" else _text(p.get(n))) for n in names}
        return [
            {
                "textid": row.textid,
                "hash": _text(m.get("hash")),
                "title": _text(meta.get("title")),
                "base_edition": _text(meta.get("base_edition")),
                "editions": [{"short": _text(e.get("short")), "label": _text(e.get("label"))} for e in m.get("editions") or []],
                "parts": [part(p, ("seq", "filename", "hash")) for p in assets.get("parts") or []],
                "marker_assets": [part(p, ("seq", "role", "filename", "hash")) for p in assets.get("markers") or []],
                "toc": toc,
                "identifiers": idents,
                "keys": sorted(str(k) for k in m),
                "path": row.path,
            }
        ]

    return found.select("textid", "path", "content").mapInPandas(_runner(parse, columns), schemas.MANIFEST)


def marker(raw: dict) -> dict:
    """A marker with its core fields, and all others as text in ``extras``."""
    extras = {str(k): v if isinstance(v, str) else str(v) for k, v in raw.items() if k not in MARKER_KEYS and v is not None}
    return {"offset": _number(raw.get("offset")), "length": _number(raw.get("length")), "type": _text(raw.get("type")), "id": _text(raw.get("id")), "content": _text(raw.get("content")), "extras": extras}


def juans(found: DataFrame) -> DataFrame:
    """(textid, juan_seq, bucket, text, hash, markers) of part files; texts are NFC.

    ``found`` has path and content of ``X_001.yaml`` files.
    """
    columns = _columns(schemas.BUCKET)
    named = found.withColumns({"textid": F.regexp_extract("path", r"([^/]+?)_\d+[^/]*$", 1), "juan_seq": F.regexp_extract("path", r"_(\d+)[^/_]*$", 1).cast("int")})

    def parse(row: Any) -> list[dict]:
        import yaml

        doc = yaml.safe_load(row.content) or {}
        out = []
        for bucket in BUCKETS:
            part = doc.get(bucket)
            if isinstance(part, dict):
                out.append(
                    {"textid": row.textid, "juan_seq": _number(doc.get("seq")) or row.juan_seq, "bucket": bucket, "text": unicodedata.normalize("NFC", part.get("text") or ""), "hash": _text(part.get("hash") or doc.get("hash")), "markers": [marker(m) for m in part.get("markers") or [] if isinstance(m, dict)]}
                )
        return out

    return named.select("textid", "juan_seq", "content").mapInPandas(_runner(parse, columns), schemas.BUCKET)


def with_assets(inline: DataFrame, assets: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets with the markers of their asset files mixed in: by offset, external ones first, each in its order.

    ``assets`` has the keys and markers.
    """
    own = assets.groupBy(*keys).agg(F.flatten(F.collect_list("markers")).alias("__external"))
    joined = inline.join(own, keys, "left")
    rank = lambda source, items: F.transform(F.coalesce(items, F.array().cast(f"array<{schemas.MARKER}>")), lambda m, i: F.struct(m["offset"].alias("offset"), F.lit(source).alias("source"), i.alias("place"), F.to_json(m).alias("json"), m.alias("marker")))
    # maps cannot be compared, so the sort key leaves the marker out
    both = F.concat(rank(0, F.col("__external")), rank(1, F.col("markers")))
    order = lambda a, b: F.when(a["offset"] != b["offset"], F.when(a["offset"] < b["offset"], -1).otherwise(1)).when(a["source"] != b["source"], a["source"] - b["source"]).otherwise(a["place"] - b["place"])
    return joined.withColumn("markers", F.transform(F.array_sort(both, order), lambda x: x["marker"])).drop("__external")


STRUCTURAL = ("page-break", "line-break", "head", "paragraph-break")


def split_markers(rows: DataFrame, keep_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Markers that stay inline (structural, or named by contents) and those that move to assets."""
    test = F.col("type").isin(*STRUCTURAL)
    if keep_ids is not None:
        rows = rows.join(keep_ids.select("id").distinct().withColumn("__keep", F.lit(True)), "id", "left")
        test = test | F.coalesce("__keep", F.lit(False))
    flagged = rows.withColumn("__inline", F.coalesce(test, F.lit(False)))
    drop = ["__inline", "__keep"]
    return flagged.where("__inline").drop(*drop), flagged.where("not __inline").drop(*drop)


def variants(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, offset, length, content, witness, form): one row for each reading of a variant marker."""
    rows = buckets.select(*keys, F.explode(F.filter("markers", lambda m: m["type"] == "variant")).alias("m"))
    return rows.select(*keys, F.col("m.offset").alias("offset"), F.coalesce("m.length", F.length("m.content"), F.lit(0)).alias("length"), F.col("m.content").alias("content"), F.explode("m.extras").alias("witness", "form"))


def voices(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r_start, r_end, name, id, responds_to) of voice markers."""
    rows = buckets.select(*keys, F.explode(F.filter("markers", lambda m: m["type"] == "voice")).alias("m"))
    end = F.col("m.offset") + F.col("m.length")
    return rows.select(*keys, F.col("m.offset").alias("r_start"), end.alias("r_end"), F.col("m.extras")["name"].alias("name"), F.col("m.id").alias("id"), F.col("m.extras")["responds_to"].alias("responds_to"))


def text_ids(spark: SparkSession, path: str) -> DataFrame:
    """(textid, place) of a list: the first word of each line, without comments, blank lines and repeats."""
    lines = spark.read.text(path).withColumn("place", F.monotonically_increasing_id())
    word = F.element_at(F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"\s+"), 1)
    named = lines.select(fn.normal_text_id(word).alias("textid"), "place").where(F.col("textid").rlike(r"^KR[0-9][a-z][0-9]{4}$"))
    return named.groupBy("textid").agg(F.min("place").alias("place"))


def catalog_rows(spark: SparkSession, path: str) -> DataFrame:
    """A catalog table with its line order; the required columns must be there."""
    rows = spark.read.option("header", True).option("enforceSchema", False).option("encoding", "UTF-8").option("multiLine", True).csv(path)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    missing = [c for c in _columns(schemas.FRONTMATTER) if c not in rows.columns]
    if missing:
        raise ValueError(f"the catalog table lacks {missing}")
    return rows.select(*_columns(schemas.FRONTMATTER)).withColumn("ordinal", F.monotonically_increasing_id())


def annotation_lines(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of JSON lines with the hash of their line; malformed lines are skipped."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("path"))
    parsed = lines.withColumn("r", F.from_json("value", schemas.ANNOTATION + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    good = parsed.where("r is not null and r._corrupt_record is null")
    return good.select("r.*", F.sha1(F.trim("value")).alias("line_hash"), F.regexp_extract("path", r"([^/]+?)_(\d+)[^/]*$", 1).alias("textid"), F.regexp_extract("path", r"([^/]+?)_(\d+)[^/]*$", 2).try_cast("int").alias("seq")).drop("_corrupt_record")


def scan_report(spark: SparkSession, path: str) -> DataFrame:
    """Clusters of an earlier scan; a malformed line is an error."""
    return spark.read.schema(schemas.SCAN).option("mode", "FAILFAST").json(path)


def duplication_report(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """A versioned duplication report; another version or header is an error."""
    first = spark.read.text(path).limit(1).first()
    if first is None or f"version={version}" not in first["value"]:
        raise ValueError("not a duplication report of this version")
    rows = spark.read.option("sep", "\t").option("comment", "#").option("header", True).option("enforceSchema", False).schema(schemas.DUPLICATIONS).csv(path)
    return rows.withColumn("row_id", F.monotonically_increasing_id() + 1)


FRONT = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"


def markdown(found: DataFrame) -> DataFrame:
    """``found`` with its front matter and body; a file without front matter is all body."""
    head = F.regexp_extract("content", FRONT, 1)
    return found.withColumns({"header": F.when(head != "", head), "body": F.when(head != "", F.regexp_extract("content", FRONT, 2)).otherwise(F.col("content"))})


SEGMENT = r"\[((?:[^\[\]\\]|\\.)*)\]\{([^}]*)\}"


def translation_segments(found: DataFrame) -> DataFrame:
    """(translation_id, juan_seq, ord, corresp, text, parse_error) of ``[text]{attributes}`` spans.

    Spans go with the markers of the front matter by their order; blank ones are
    left out, and a backslash keeps the character after it. A file that cannot
    be read is a row with ``parse_error``.
    """
    columns = _columns(schemas.TRANSLATION)

    def parse(row: Any) -> list[dict]:
        import yaml

        header = (yaml.safe_load(row.header) if row.header else None) or {}
        marks = header.get("markers") if isinstance(header.get("markers"), list) else []
        out = []
        for n, span in enumerate(re.finditer(SEGMENT, row.body or "")):
            text = re.sub(r"\\(.)", r"\1", span[1]).strip()
            mark = marks[n] if n < len(marks) and isinstance(marks[n], dict) else {}
            corresp = mark.get("corresp")
            if text:
                out.append({"translation_id": row.textid, "juan_seq": row.juan_seq, "ord": n, "corresp": [corresp] if isinstance(corresp, str) else [c for c in corresp or [] if isinstance(c, str)], "text": text})
        return out

    named = markdown(found).withColumns({"textid": F.regexp_extract("path", r"([^/]+?)(?:_\d+)?\.md$", 1), "juan_seq": F.coalesce(F.regexp_extract("path", r"_(\d+)\.md$", 1).try_cast("int"), F.lit(0))})
    return named.select("textid", "juan_seq", "path", "header", "body").mapInPandas(_runner(parse, columns), schemas.TRANSLATION)


# -- markup ----------------------------------------------------------------------

PUNCTUATION = "()/，。、；：？！「」『』《》〈〉〔〕【】〖〗・…—–·"
SCROLL = "path string, section int, head string, text string, markers array<struct<offset:int,type:string,id:string,content:string>>"


_BODY = "㐀-鿿豈-﫿\U00020000-\U000323af\U00105000-\U00108fff"
#: What a line is made of, each at its place: a private character, white space, a mark, other signs, a body character.
_PIECE = re.compile(rf"&KR(?P<private>\d+);|(?P<blank>[\s\u3000]+)|(?P<mark>[{re.escape(PUNCTUATION)}])|(?P<other>[^\s\u3000&{re.escape(PUNCTUATION)}{_BODY}]+)|(?P<plain>.)", re.DOTALL)
_JUAN = re.compile(r"#\+PROPERTY:\s+JUAN\s+(.*)")
_HEAD = re.compile(r"(\*+)\s+(.*)")
_TAG = re.compile(r"<(pb|md):([^>]+)>")


def scroll_sections(content: str, text_id: str, edition: str, seq: int) -> list[dict]:
    """A plain-text scroll as sections of text and markers.

    The text keeps ideographs alone. Page breaks ``<pb:id>``, lines (ended by
    the pilcrow), headings at the start of a line, comments, newlines, indents
    and punctuation are markers; ``&KR0001;`` is a private character. A JUAN
    property opens a section. Each character is looked at once.
    """
    sections: list[dict] = []
    state = {"page": "", "line": 0, "heads": 0, "title": "", "broken": None}
    text: list[str] = []
    marks: list[dict] = []

    def mark(kind: str, content: str = "", ident: str = "") -> None:
        marks.append({"offset": len(text), "type": kind, "id": ident, "content": content})

    def close() -> None:
        if text or marks or state["title"]:
            sections.append({"head": state["title"] or f"juan {seq:03d}", "text": "".join(text), "markers": list(marks)})
        text.clear()
        marks.clear()
        state["broken"] = None

    def characters(line: str) -> None:
        for piece in _PIECE.finditer(line):
            kind, found = piece.lastgroup, piece[piece.lastgroup]
            if kind == "private":
                text.append(chr(0x105000 + int(found)))
            elif kind == "plain":
                text.append(found)
            else:
                mark({"blank": "space" if piece.start() else "indent", "mark": "punctuation", "other": "non-cjk"}[kind], found)

    def page(ident: str) -> None:
        state["page"], state["line"] = ident, 0
        if state["broken"] != (ident, len(text)):  # a page that is named twice at one place breaks once
            mark("page-break", "", ident)
            state["broken"] = (ident, len(text))

    def run(part: str) -> None:
        if part:
            state["line"] += 1
            mark("line-break", "", f"{state['page'] or f'{text_id}_{edition}_{seq:03d}-front'}{state['line']:02d}")
            characters(part)

    lines = content.split("\n")
    body = next((i for i, line in enumerate(lines) if line and not line.startswith("#")), len(lines))
    titles = (_JUAN.match(line) for line in lines[:body])
    state["title"] = next((title[1].strip() for title in titles if title and title[1].strip()), "")
    newlines = 0
    for line in lines[body:]:
        if not line:
            newlines += 1
            continue
        if newlines:
            mark("newline" if newlines == 1 else "paragraph-break", "\n" * newlines)
        newlines = 1
        title, head = _JUAN.match(line), _HEAD.match(line)
        if title:
            close()
            state["title"] = title[1].strip()
        elif line.startswith("#"):
            mark("comment", line)
        elif head:
            state["heads"] += 1
            mark("head", head[2].strip().rstrip("¶").strip(), f"{text_id}_{edition}_{seq:03d}-h{state['heads']}")
        else:
            for chunk in line.split("¶"):
                at = 0
                for tag in _TAG.finditer(chunk):
                    run(chunk[at : tag.start()])
                    if tag[1] == "pb":
                        page(tag[2])
                    at = tag.end()
                run(chunk[at:])
    close()
    return sections


def scrolls(found: DataFrame, edition: str) -> DataFrame:
    """Sections of plain-text scrolls ``X_001.txt``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                name = re.search(r"([^/]+?)_(\d+)[^/]*$", path)
                made = scroll_sections(content, name[1] if name else "", edition, int(name[2]) if name else 0)
                rows += [{"path": path, "section": n, **s} for n, s in enumerate(made)]
            if rows:
                yield pd.DataFrame(rows, columns=_columns(SCROLL))

    return found.select("path", "content").mapInPandas(run, SCROLL)


def _local(tag: Any) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


TEI = "path string, section int, head string, text string, markers array<struct<offset:int,type:string,id:string,content:string>>, variants array<struct<offset:int,length:int,witness:string,form:string>>, parse_error string"


def tei_sections(content: str) -> list[dict]:
    """A TEI text as sections: milestones and lines as markers, apparatus as variants, notes as ranges."""
    root = ElementTree.fromstring(content)
    body = next((e for e in root.iter() if _local(e.tag) == "text"), root)
    sections: list[dict] = [{"head": "", "text": "", "markers": [], "variants": []}]

    def add(value: str | None) -> None:
        if value:
            sections[-1]["text"] += re.sub(r"\s+", "", value)

    def mark(kind: str, element: Any, content: str = "") -> None:
        ident = element.get("n") or next((v for k, v in element.attrib.items() if _local(k) == "id"), "")
        sections[-1]["markers"].append({"offset": len(sections[-1]["text"]), "type": kind, "id": ident, "content": content})

    def walk(element: Any) -> None:
        tag = _local(element.tag)
        if tag == "div" and (sections[-1]["text"] or sections[-1]["markers"]):
            sections.append({"head": "", "text": "", "markers": [], "variants": []})
        if tag in ("pb", "lb", "milestone", "cb"):
            mark({"pb": "page-break", "lb": "line-break"}.get(tag, tag), element, element.get("unit") or "")
        elif tag == "head":
            title = "".join(element.itertext()).strip()
            sections[-1]["head"] = sections[-1]["head"] or title
            mark("head", element, title)
        elif tag == "app":
            start = len(sections[-1]["text"])
            lemma = next((c for c in element if _local(c.tag) == "lem"), None)
            if lemma is not None:
                add("".join(lemma.itertext()))
            for reading in (c for c in element if _local(c.tag) == "rdg"):
                for witness in (reading.get("wit") or "").split():
                    sections[-1]["variants"].append({"offset": start, "length": len(sections[-1]["text"]) - start, "witness": witness.lstrip("#"), "form": re.sub(r"\s+", "", "".join(reading.itertext()))})
        elif tag not in ("teiHeader",):
            if tag == "seg":
                mark("seg", element)
            add(element.text)
            for child in element:
                walk(child)
                add(child.tail)

    walk(body)
    return sections


def tei(found: DataFrame) -> DataFrame:
    """Sections of TEI files."""

    def parse(row: Any) -> list[dict]:
        return [{"path": row.path, "section": n, **section} for n, section in enumerate(tei_sections(row.content))]

    return found.select("path", "content").mapInPandas(_runner(parse, _columns(TEI)), TEI)


HEADER = "path string, titles array<struct<level:string,lang:string,text:string>>, identifiers map<string,string>, people array<struct<role:string,name:string>>, extent string, date string, witnesses map<string,string>, parse_error string"


def tei_header(content: str) -> dict:
    """What a TEI header says of its text: titles, identifiers, people by their part in it, extent, date, witnesses."""
    root = ElementTree.fromstring(content)
    header = next((e for e in root.iter() if _local(e.tag) == "teiHeader"), None)
    found: dict = {"titles": [], "identifiers": {}, "people": [], "extent": None, "date": None, "witnesses": {}}
    plain_ = lambda e: " ".join("".join(e.itertext()).split())
    attribute = lambda e, name: next((v for k, v in e.attrib.items() if _local(k) == name), None)
    for element in header.iter() if header is not None else ():
        tag, text = _local(element.tag), plain_(element)
        if not text:
            continue
        if tag == "title":
            found["titles"].append({"level": attribute(element, "level"), "lang": attribute(element, "lang"), "text": text})
        elif tag == "idno":
            found["identifiers"].setdefault(attribute(element, "type") or "", text)
        elif tag in ("author", "editor", "publisher"):
            found["people"].append({"role": tag, "name": text})
        elif tag == "respStmt":
            part = {_local(e.tag): plain_(e) for e in element}
            found["people"].append({"role": part.get("resp") or "resp", "name": part.get("name") or part.get("persName") or text})
        elif tag == "witness":
            found["witnesses"].setdefault(attribute(element, "id") or "", text)
        elif tag in ("extent", "date"):
            found[tag] = found[tag] or attribute(element, "when") or text
    return found


def tei_headers(found: DataFrame) -> DataFrame:
    """Headers of TEI files, one row for each."""

    def parse(row: Any) -> list[dict]:
        return [{"path": row.path, **tei_header(row.content)}]

    return found.select("path", "content").mapInPandas(_runner(parse, _columns(HEADER)), HEADER)


RECORD = "uuid string, type string, path string, fields map<string,array<string>>, parse_error string"


def record_fields(content: str) -> dict[str, list[str]]:
    """A lexicon record's texts and attributes by their path of element names, in document order."""
    root = ElementTree.fromstring(content)
    out: dict[str, list[str]] = {}

    def walk(element: Any, path: str) -> None:
        for key, value in element.attrib.items():
            out.setdefault(f"{path}@{_local(key)}", []).append(value)
        if element.text and element.text.strip():
            out.setdefault(path or _local(element.tag), []).append(element.text.strip())
        for child in element:
            walk(child, f"{path}/{_local(child.tag)}" if path else _local(child.tag))

    walk(root, "")
    return out


def lexicon(found: DataFrame, kind: str) -> DataFrame:
    """Records of one type of lexicon file: their uuid and all their fields.

    The nine types differ in which paths matter, not in how they are read; the
    graph's label and link rules pick their fields.
    """

    def parse(row: Any) -> list[dict]:
        fields = record_fields(row.content)
        uuid = re.sub("^uuid-", "", (fields.get("@id") or [""])[0])
        return [{"uuid": uuid, "type": kind, "path": row.path, "fields": fields}] if uuid else []

    return found.select("path", "content").mapInPandas(_runner(parse, _columns(RECORD)), RECORD)


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Flat XML elements as rows, read in splits."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def translation_xml(found: DataFrame) -> DataFrame:
    """(translation_id, juan_seq, ord, corresp, text, parse_error) of ``seg`` elements; the scroll is part of the segment's target."""

    def parse(row: Any) -> list[dict]:
        name = re.sub(r"^.*/|\.xml$", "", row.path)
        rows = []
        for n, seg in enumerate(e for e in ElementTree.fromstring(row.content).iter() if _local(e.tag) == "seg"):
            target = (seg.get("corresp") or "").lstrip("#")
            juan = re.search(r"_(\d{3})[-_]", target)
            text = " ".join("".join(seg.itertext()).split())
            if text:
                rows.append({"translation_id": name, "juan_seq": int(juan[1]) if juan else 0, "ord": n, "corresp": [target] if target else [], "text": text})
        return rows

    return found.select("path", "content").mapInPandas(_runner(parse, _columns(schemas.TRANSLATION)), schemas.TRANSLATION)


class _Plain(HTMLParser):
    """Text of a page: blocks on lines, scripts and styles left out."""

    BLOCKS = frozenset({"p", "br", "div", "li", "h1", "h2", "h3", "h4", "tr", "article", "section", "title", "nav", "lb", "pb"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def plain(markup: str | None) -> str:
    """The text of markup, a block to a line."""
    parser = _Plain()
    parser.feed(markup or "")
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.parts).split("\n"))
    return "\n".join(line for line in lines if line)


def plain_text(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the text of a column of markup."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def of(markup: pd.Series) -> pd.Series:
        return markup.map(plain)

    return rows.withColumn("text", of(column))


LEAF = "path string, key string, value string, parse_error string"


def leaves(value: Any, key: str = "") -> Iterator[tuple[str, str]]:
    """(dotted key, text) of everything in a parsed document that is not a mapping or list."""
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from leaves(inner, f"{key}.{name}" if key else str(name))
    elif isinstance(value, list):
        for inner in value:
            yield from leaves(inner, key)
    elif value is not None:
        yield key, value if isinstance(value, str) else str(value)


def yaml_leaves(found: DataFrame, skip: tuple[str, ...] = ("hash",)) -> DataFrame:
    """(path, key, value, parse_error) of all leaves of YAML files, those named in ``skip`` left out."""

    def parse(row: Any) -> list[dict]:
        import yaml

        return [{"path": row.path, "key": key, "value": value} for key, value in leaves(yaml.safe_load(row.content)) if key.rpartition(".")[2] not in skip]

    return found.select("path", "content").mapInPandas(_runner(parse, _columns(LEAF)), LEAF)


def yaml_records(found: DataFrame) -> DataFrame:
    """Records of YAML files, one to a file: uuid, type and all fields by their dotted keys."""
    rows = yaml_leaves(found, ()).where("parse_error is null")
    grouped = rows.groupBy("path", "key").agg(F.collect_list("value").alias("values")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("fields"))
    first = lambda name: F.get(F.col("fields")[name], F.lit(0))
    return grouped.select(fn.bare_uuid(first("uuid")).alias("uuid"), F.coalesce(first("type"), F.lit("")).alias("type"), "path", "fields").where("uuid <> ''")


PARALLEL = "textid string, juan_seq int, bucket string, start int, end int, to_ref string"


def parallel_assets(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """Parallel markers of ``X_001.parallels.yaml`` files from any number of roots, each once; ranges outside their text are left out.

    ``lengths`` has textid, juan_seq, bucket and chars.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                name = re.search(r"([^/]+?)_(\d+)[^/]*$", path)
                try:
                    buckets = (yaml.safe_load(content) or {}).get("markers") or {}
                except (yaml.YAMLError, AttributeError):
                    continue
                for bucket, marks in buckets.items() if name and isinstance(buckets, dict) else ():
                    for mark in marks or []:
                        at, n = _number(mark.get("offset")), _number(mark.get("length"))
                        if at is not None and n is not None and mark.get("ref"):
                            rows.append((name[1], int(name[2]), bucket, at, at + n, str(mark["ref"])))
            if rows:
                yield pd.DataFrame(rows, columns=_columns(PARALLEL))

    rows = found.select("path", "content").mapInPandas(run, PARALLEL).distinct()
    return rows.join(lengths, ["textid", "juan_seq", "bucket"]).where("start >= 0 and end >= start and end <= chars").drop("chars")
