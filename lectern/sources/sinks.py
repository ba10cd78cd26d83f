"""Writers: tables, reports, bundles and exports.

Tables are Parquet, which Spark commits as a whole; a schema version goes with
each table, and a reader of another version is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources import schemas


def write_files(rows: DataFrame, root: str) -> int:
    """Write (path, content) rows as files below a folder of any store that Arrow knows; how many there are.

    Each task writes its own files, and one that runs again writes the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{base.rstrip('/')}/{path}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                with store.open_output_stream(target) as out:
                    out.write(content.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_index(tables: dict[str, DataFrame], path: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """All tables of an index, with the schema version beside them."""
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        writer = rows.write.mode("overwrite")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(f"{path}/{name}")
    spark.createDataFrame([(schemas.SCHEMA_VERSION,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str, name: str) -> DataFrame:
    version = spark.read.parquet(f"{path}/meta").first()["version"]
    if version != schemas.SCHEMA_VERSION:
        raise ValueError(f"the index has schema version {version}, not {schemas.SCHEMA_VERSION}")
    return spark.read.parquet(f"{path}/{name}")


def merged_corpus(parts: list[DataFrame], key: str) -> DataFrame:
    """Tables of several corpora as one; of rows with the same key the first corpus's stay."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part.join(whole.select(key).distinct(), key, "left_anti"))
    return whole


def write_clusters(clusters: DataFrame, path: str, kind: str = "json") -> None:
    """Clusters with their locations: JSON lines, or a row for each location in tab-separated text."""
    if kind == "json":
        clusters.write.mode("overwrite").json(path)
        return
    flat = clusters.select("cluster_id", "length", "occurrence_count", F.explode("locations").alias("l")).select("cluster_id", "length", "occurrence_count", "l.*")
    flat.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_duplications(rows: DataFrame, path: str, version: int = 1) -> None:
    """A duplication report with its version in the first line of each file."""
    names = [c.split()[0] for c in schemas.DUPLICATIONS.split(", ")]
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [f"# duplications version={version}", "\t".join(names)]})
        yield from frames

    # a report is read by people and has one row for each duplicated pair: one file, streamed through one task
    rows.select(line.alias("value")).coalesce(1).mapInPandas(run, "value string").write.mode("overwrite").text(path)


def updated_action(rows: DataFrame, row_id: int, action: str, actor: str, at: str) -> DataFrame:
    """A report's rows with the action taken on one of them."""
    here = F.col("row_id") == row_id
    return rows.withColumns({"action": F.when(here, action).otherwise(F.col("action")), "action_actor": F.when(here, actor).otherwise(F.col("action_actor")), "action_at": F.when(here, at).otherwise(F.col("action_at"))})


def woven(rows: DataFrame, prefix: dict[str, str]) -> DataFrame:
    """``rows`` (text, markers) as plain text again: markers' content, or what stands for their type, at their offsets."""
    table = F.create_map(*[F.lit(x) for pair in prefix.items() for x in pair])
    shown = lambda m: F.coalesce(F.when(F.length(m["content"]) > 0, m["content"]), F.replace(table[m["type"]], F.lit("{id}"), F.coalesce(m["id"], F.lit(""))), F.lit(""))
    marks = F.transform(F.array_sort(F.transform("markers", lambda m, i: F.struct(m["offset"].alias("offset"), i.alias("place"), shown(m).alias("shown")))), lambda x: x)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(
        marks,
        zero,
        lambda acc, m: F.struct(m["offset"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, m["offset"] - acc["at"]), m["shown"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return rows.withColumn("exported", whole)


SCROLL_MARKS = {"page-break": "<pb:{id}>", "line-break": "", "head": "\n"}


def to_xml(rows: DataFrame, root: str = "text", row: str = "seg") -> DataFrame:
    """Each row as an XML element of its columns."""
    return rows.select(F.to_xml(F.struct(*[F.col(c) for c in rows.columns]), {"rowTag": row, "declaration": "", "rootTag": root}).alias("xml"))


_TEI_MARKS = {"page-break": "pb", "line-break": "lb"}


def tei_section(head: str, text: str, markers: list[dict], variants: list[dict]) -> str:
    """One section as a ``div``: milestones at their places, readings as apparatus around what they replace."""
    readings: dict[tuple[int, int], dict[str, list[str]]] = {}
    for v in variants:
        readings.setdefault((v["offset"], v["offset"] + v["length"]), {}).setdefault(v["form"], []).append(v["witness"])
    marks = sorted(markers, key=lambda m: m["offset"])
    out, at, place = [], 0, 0

    def milestones(upto: int) -> None:
        nonlocal at, place
        while place < len(marks) and marks[place]["offset"] <= upto:
            mark = marks[place]
            out.append(escape(text[at : mark["offset"]]))
            at = max(at, mark["offset"])
            ident = f" n={quoteattr(mark['id'])}" if mark["id"] else ""
            if mark["type"] == "head":
                out.append(f"<head{ident}>{escape(mark['content'] or head)}</head>")
            else:
                unit = f" unit={quoteattr(mark['content'])}" if mark["content"] else ""
                out.append(f"<{_TEI_MARKS.get(mark['type'], mark['type'])}{ident}{unit}/>")
            place += 1

    for (start, end), forms in sorted(readings.items()):
        milestones(start)
        out.append(escape(text[at:start]))
        shown = "".join(f"<rdg wit={quoteattr(' '.join('#' + w for w in sorted(wits)))}>{escape(form)}</rdg>" for form, wits in sorted(forms.items()))
        out.append(f"<app><lem>{escape(text[start:end])}</lem>{shown}</app>")
        at = max(at, end)
    milestones(len(text))
    return "<div>" + "".join(out) + escape(text[at:]) + "</div>"


def tei_documents(sections: DataFrame, key: str = "textid") -> DataFrame:
    """(key, content): sections (key, section, head, text, markers, variants) of each text as one TEI file.

    What ``readers.tei`` reads back; milestones inside a lemma stand before it.
    """

    def build(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("section").itertuples(index=False)
        made = "".join(tei_section(r.head or "", r.text or "", list(r.markers), list(r.variants)) for r in rows)
        return pd.DataFrame({key: [keys[0]], "content": [f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>{made}</body></text></TEI>']})

    return sections.select(key, "section", "head", "text", "markers", "variants").groupBy(key).applyInPandas(build, f"{key} string, content string")


def to_markdown(segments: DataFrame) -> DataFrame:
    """(translation_id, juan_seq, document): spans of a translation with its front matter."""
    escaped = F.regexp_replace("text", r"([\[\]\\{}])", r"\\$1")
    one = F.struct("ord", F.concat(F.lit("["), escaped, F.lit("]{.seg}")).alias("span"), F.to_json(F.struct("corresp")).alias("marker"))
    grouped = segments.groupBy("translation_id", "juan_seq").agg(F.sort_array(F.collect_list(one)).alias("s"))
    header = F.concat(F.lit("---\nid: "), F.col("translation_id"), F.lit("\nmarkers: ["), F.array_join(F.transform("s", lambda x: x["marker"]), ", "), F.lit("]\n---\n"))
    return grouped.select("translation_id", "juan_seq", F.concat(header, F.array_join(F.transform("s", lambda x: x["span"]), "\n"), F.lit("\n")).alias("document"))


def write_records(records: DataFrame, path: str) -> None:
    """Lexicon records, a folder for each type."""
    records.write.mode("overwrite").partitionBy("type").json(path)


def bundle_documents(buckets: DataFrame) -> DataFrame:
    """(path, content) of the YAML files of bundles: a file for each scroll, and a manifest with their hashes.

    Every text carries its hash, every file's hash is that of its content; how
    files get to a store is the caller's choice.
    """

    def juan(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        import yaml

        textid, seq = key
        doc: dict = {"seq": int(seq)}
        for row in frame.sort_values("bucket").itertuples(index=False):
            whole = lambda k, v: int(v) if k in ("offset", "length") else v
            marks = [{k: whole(k, v) for k, v in m.items() if v is not None and v == v and v != ""} for m in row.markers]
            doc[row.bucket] = {"text": row.text, "hash": "sha256:" + hashlib.sha256(row.text.encode()).hexdigest(), "markers": marks}
        content = yaml.safe_dump(doc, allow_unicode=True, sort_keys=False)
        return pd.DataFrame([(textid, int(seq), f"{textid}/{textid}_{int(seq):03d}.yaml", content)], columns=["textid", "seq", "path", "content"])

    plain = buckets.select("textid", "juan_seq", "bucket", "text", F.transform("markers", lambda m: F.struct(m["offset"].alias("offset"), m["length"].alias("length"), m["type"].alias("type"), m["id"].alias("id"), m["content"].alias("content"))).alias("markers"))
    files = plain.groupBy("textid", "juan_seq").applyInPandas(juan, "textid string, seq int, path string, content string")
    part = F.struct("seq", F.substring_index("path", "/", -1).alias("filename"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"))
    line = lambda p: F.concat(F.lit("  - {seq: "), p["seq"].cast("string"), F.lit(", filename: "), p["filename"], F.lit(", hash: '"), p["hash"], F.lit("'}\n"))
    listed = files.groupBy("textid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), line), "").alias("parts"))
    manifests = listed.select(F.concat("textid", F.lit("/"), "textid", F.lit(".manifest.yaml")).alias("path"), F.concat(F.lit("canonical_identifier: "), F.col("textid"), F.lit("\nassets:\n  parts:\n"), F.col("parts")).alias("content"))
    return files.select("path", "content").unionByName(manifests)
