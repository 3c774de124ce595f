"""Readers and writers of delimited, JSON, text, XML and HTML files. Schemas are explicit, never inferred.

Nulls and blanks stay apart where a format can tell them apart; Spark's CSV reader cannot, so string columns
read blanks as ``''`` unless ``na`` names them.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.memory import rows_of
from ..plans.documents import SECTION, html_sections, section_rows


def _blanks(df: DataFrame, na: Sequence[str]) -> DataFrame:
    """Absent strings are blank; those that ``na`` names are null."""
    strings = [c for c, kind in df.dtypes if kind == "string"]
    out = df.fillna("", strings)
    return out.withColumns({c: F.when(~F.col(c).isin(list(na)), F.col(c)) for c in strings}) if na else out


def scan_tsv_noquote(spark: SparkSession, path: str, schema: str, na: Sequence[str] = ()) -> DataFrame:
    """Tab-separated with a header; quotes are data."""
    return _blanks(spark.read.csv(path, sep="\t", header=True, quote="", schema=schema), na)


def scan_csv(spark: SparkSession, path: str, schema: str, na: Sequence[str] = ()) -> DataFrame:
    return _blanks(spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=True), na)


def scan_pipe_headerless(spark: SparkSession, path: str, columns: Sequence[str], na: Sequence[str] = ("", "NA")) -> DataFrame:
    """Pipe-separated without a header; short lines are filled, a trailing delimiter is dropped."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _rest string"
    return _blanks(spark.read.csv(path, sep="|", quote="", schema=schema, mode="PERMISSIVE").drop("_rest"), na)


def scan_csv_with_footer(spark: SparkSession, path: str, schema: str, keys: Sequence[str], separator: str = "---") -> DataFrame:
    """A CSV body and ``Key: Value`` lines behind a separator line; the values become columns of every row."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), '(?m)^"(-+)"$', "$1").alias("value"))
    parts = F.split("value", rf"(?m)^{re.escape(separator)}\n?")
    lines = F.filter(F.split(F.trim(parts[0]), "\n"), lambda x: x != "")
    body = whole.select(F.explode(F.slice(lines, F.lit(2), F.size(lines))).alias("line"), F.array_join(F.slice(parts, 2, 1000), "\n").alias("foot"))
    footer = {k: F.nullif(F.trim(F.regexp_extract("foot", rf'(?m)^"?{re.escape(k)}: *([^"\n]*)', 1)), F.lit("")) for k in keys}
    return body.withColumns(footer).select(F.from_csv("line", schema).alias("row"), *footer).select("row.*", *footer)


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def scan_json_array(spark: SparkSession, path: str) -> DataFrame:
    """The strings of a JSON array in order, blanks dropped."""
    own = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("a"), F.col("_metadata.file_path").alias("path"))
    return own.select("path", F.posexplode(F.filter("a", lambda x: x != "")).alias("pos", "value"))


def scan_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Annotated records (text, pubmed_id, label spans); a bad id is -1, missing text blank, missing spans none."""
    schema = "text string, pubmed_id string, date string, country string, label array<array<string>>"
    own = spark.read.json(path, schema=schema)
    spans = F.transform(F.coalesce("label", F.array().cast("array<array<string>>")), lambda x: F.struct(F.get(x, F.lit(0)).try_cast("int").alias("start"), F.get(x, F.lit(1)).try_cast("int").alias("end"), F.get(x, F.lit(2)).alias("tag")))
    return own.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("pubmed_id").try_cast("long"), F.lit(-1)).alias("pubmed_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("date", "country")], spans.alias("label"))


def parse_xml(raw: str) -> ET.Element | None:
    """A tree; undeclared prefixes are declared and the parse tried again. None if it isn't XML."""
    for text in (raw, None):
        if text is None:
            text = raw.strip()
            used = set(re.findall(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]", text)) - {"xml", "xmlns"}
            missing = [p for p in sorted(used) if f"xmlns:{p}" not in text]
            text = re.sub(r"<([A-Za-z_][\w.:-]*)", lambda m: m[0] + "".join(f' xmlns:{p}="urn:{p}"' for p in missing), text, count=1)
            text = re.sub(r"&(?!#?\w+;)", "&amp;", text)
        try:
            return ET.fromstring(text)
        except (ET.ParseError, ValueError):
            continue
    return None


def xml_sections(raw: str) -> list[dict]:
    """Sections of an article (title, text, level), whatever its namespaces."""
    root = parse_xml(raw)
    out: list[dict] = []

    def local(e):
        return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""

    def walk(e, level):
        for child in e:
            if local(child) in ("sec", "div"):
                title = next((" ".join("".join(t.itertext()).split()) for t in child if local(t) in ("title", "head")), "")
                text = " ".join(" ".join("".join(p.itertext()).split()) for p in child if local(p) == "p")
                out.append({"pos": len(out), "level": level, "title": title, "text": text})
                walk(child, level + 1)
            else:
                walk(child, level)

    if root is not None:
        walk(root, 1)
    return out


def xml_section_rows(df: DataFrame, xml: str, *keys: str) -> DataFrame:
    """(keys, pos, level, title, text) of a column of XML articles; what isn't XML gives no rows."""

    return rows_of(df, list(keys), xml, lambda raw: section_rows(xml_sections(raw or "")), SECTION)


def scan_xml_sections(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, level, title, text) of XML articles; files that aren't XML give no rows."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("raw"))
    return xml_section_rows(files, "raw", "path")


def scan_html_sections(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("html"))
    return html_sections(files, "path", "html")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, id): file names without their extension; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("id"))


def first_source(candidates: DataFrame, key: str, priority: str) -> DataFrame:
    """Of each key's candidates, the one of least priority."""
    return candidates.withColumn("_p", F.row_number().over(Window.partitionBy(key).orderBy(priority))).where("_p = 1").drop("_p")


def waterfall(keys: DataFrame, sources: Sequence[DataFrame], key: str) -> DataFrame:
    """Each key from the first source that has it, with ``source`` (its place); keys of no source are left out."""
    union = None
    for k, source in enumerate(sources):
        own = source.withColumn("source", F.lit(k))
        union = own if union is None else union.unionByName(own)
    return first_source(union.join(keys.select(key).distinct(), key, "left_semi"), key, "source")


def batched_lookup(keys: DataFrame, key: str, fetch, schema: str, size: int = 200) -> DataFrame:
    """Rows that ``fetch(list of keys) -> DataFrame of pandas`` gives, asked in batches within each task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own = part[key].tolist()
            for k in range(0, len(own), size):
                yield fetch(own[k : k + size])

    return keys.select(key).distinct().mapInPandas(run, schema)


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def sink_jsonl(df: DataFrame, path: str) -> None:
    """A JSON object a line; empty arrays are ``[]``."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def sink_text(df: DataFrame, path: str, key: str, text: str) -> None:
    """A folder for each key."""
    df.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)



def sink_article_xml(sections: DataFrame, path: str, key: str) -> None:
    """(key, pos, level, title, text) as articles, a line each: nested ``sec`` elements of a ``body``, in order of pos."""

    def escape(c):
        return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    before = F.lag("level", 1, 0).over(Window.partitionBy(key).orderBy("pos"))
    # A section at a level closes those at its own and deeper ones that are open.
    closed = F.repeat(F.lit("</sec>"), F.greatest(F.lit(0), before - F.col("level") + 1).cast("int"))
    text = F.concat(closed, F.lit("<sec><title>"), escape(F.col("title")), F.lit("</title><p>"), escape(F.regexp_replace("text", r"\s+", " ")), F.lit("</p>"))
    lines = sections.select(key, "pos", "level", text.alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "")
    end = F.repeat(F.lit("</sec>"), F.max_by("level", "pos").cast("int"))
    out = lines.groupBy(key).agg(F.concat(F.lit("<article><body>"), whole, end, F.lit("</body></article>")).alias("value"))
    out.select("value").write.mode("overwrite").text(path)
