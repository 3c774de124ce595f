"""Sources and sinks: a test table written to files, read back, and compared with the table itself."""

import pandas as pd
from pyspark.sql import functions as F

from ..operators.resolve import scratch_folder
from ..sources import tables as src
from .registry import query

PARTS = "SELECT p_partkey, p_name, p_size FROM part"
PART_SCHEMA = "p_partkey long, p_name string, p_size long"


def parts(t):
    return t.part.select(F.col("p_partkey").cast("long"), "p_name", F.col("p_size").cast("long"))


def written(t, name, lines):
    """A folder with the lines of a one-column table."""
    path = f"{scratch_folder(t.spark)}/{name}"
    lines.write.mode("overwrite").text(path)
    return path


@query("S1_scan_tsv", "SELECT p_partkey, '\"' || p_name AS p_name, p_size FROM part")
def _(t):
    path = f"{scratch_folder(t.spark)}/tsv"
    own = parts(t).withColumn("p_name", F.concat(F.lit('"'), "p_name"))
    own.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="")
    return src.scan_tsv_noquote(t.spark, path, PART_SCHEMA)


@query("S2_scan_csv", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN p_name || ', \"x\"' ELSE p_name END AS p_name, p_size FROM part")
def _(t):
    path = f"{scratch_folder(t.spark)}/csv"
    name = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit(', "x"'))).otherwise(F.col("p_name"))
    parts(t).withColumn("p_name", name).write.mode("overwrite").csv(path, header=True, escape='"')
    return src.scan_csv(t.spark, path, PART_SCHEMA)


@query("S3_scan_pipe_headerless", "SELECT CAST(p_partkey AS VARCHAR) AS a, nullif(CASE WHEN p_size % 2 = 0 THEN 'NA' ELSE p_name END, 'NA') AS b, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS c FROM part")
def _(t):
    even = F.col("p_size") % 2 == 0
    line = F.when(even, F.concat_ws("|", "p_partkey", F.lit("NA"), "p_size", F.lit(""))).otherwise(F.concat_ws("|", "p_partkey", "p_name"))
    return src.scan_pipe_headerless(t.spark, written(t, "pipe", t.part.select(line)), ["a", "b", "c"])


@query("S5_scan_csv_with_footer", "SELECT *, 'Quarterly' AS \"Title\", NULL::VARCHAR AS \"Notes\" FROM (SELECT n_nationkey, n_name FROM nation)")
def _(t):
    own = t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.concat_ws(",", "n_nationkey", "n_name").alias("line"))
    body = own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("b"))
    path = written(t, "footer", body.select(F.concat(F.lit("n_nationkey,n_name\n"), "b", F.lit('\n---\nTitle: Quarterly\nNotes:\n'))).coalesce(1))
    return src.scan_csv_with_footer(t.spark, path, "n_nationkey long, n_name string", ["Title", "Notes"])


@query("S6_scan_lines", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1")
def _(t):
    return src.scan_lines(t.spark, written(t, "lines", t.part.select("p_name"))).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("S7_scan_json_array", "SELECT CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS INTEGER) AS pos, n_name AS value FROM nation")
def _(t):
    arrays = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("a")).select("n_regionkey", F.to_json(F.array_append("a", F.lit(""))).alias("value"))
    path = f"{scratch_folder(t.spark)}/arrays"
    arrays.write.mode("overwrite").partitionBy("n_regionkey").text(path)
    return src.scan_json_array(t.spark, f"{path}/*").select("pos", "value")


@query("S8_scan_jsonl", "SELECT text, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE doc_id END AS pubmed_id, coalesce(lang, '') AS country, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS spans FROM documents WHERE text IS NOT NULL")
def _(t):
    ident = F.when(F.col("doc_id") % 5 == 0, "unknown").otherwise(F.col("doc_id").cast("string"))
    spans = F.when(F.col("doc_id") % 2 == 0, F.array(F.array(F.lit("0"), F.lit("4"), F.lit("COHORT"))))
    own = t.documents.where("text is not null").select("text", ident.alias("pubmed_id"), F.col("lang").alias("country"), spans.alias("label"))
    path = f"{scratch_folder(t.spark)}/records"
    src.sink_jsonl(own, path)
    out = src.scan_jsonl(t.spark, path)
    return out.select("text", "pubmed_id", "country", F.size("label").alias("spans"))


def articles(t, broken=False):
    """One XML article for each page: two sections, of which one is nested; ``broken`` ones use a prefix that isn't declared."""
    key = F.col("page_id").cast("string")
    link = F.lit('<x:ref href="u">r</x:ref> & co' if broken else "<ref>r</ref> &amp; co")
    xml = F.concat(F.lit("<article><body><sec><title>Methods "), key, F.lit("</title><p>We saw "), key, F.lit(" cases "), link, F.lit("</p><sec><title>Data</title><p>From A.</p></sec></sec></body></article>"))
    path = f"{scratch_folder(t.spark)}/articles-{broken}"
    t.pages.select(xml.alias("value")).write.mode("overwrite").text(f"{path}")
    lines = t.spark.read.text(path).select("value")
    return lines


XML_ROWS = "SELECT CAST(s.pos AS INTEGER) AS pos, CAST(s.pos + 1 AS INTEGER) AS level, CASE s.pos WHEN 0 THEN 'Methods ' || page_id ELSE 'Data' END AS title, CASE s.pos WHEN 0 THEN 'We saw ' || page_id || ' cases r & co' ELSE 'From A.' END AS text FROM pages, (VALUES (0), (1)) s(pos)"


@query("S9_scan_xml", XML_ROWS)
def _(t):
    return src.xml_section_rows(articles(t), "value").select("pos", "level", "title", "text")


@query("S10_scan_xml_repair", XML_ROWS)
def _(t):
    return src.xml_section_rows(articles(t, broken=True), "value").select("pos", "level", "title", "text")


@query("S11_scan_html", "SELECT 'Nation ' || n_name AS title, 'Key ' || n_nationkey || ' & more' AS text FROM nation")
def _(t):
    html = F.concat(F.lit("<html><script>var x;</script><h2>Nation "), "n_name", F.lit("</h2><p>Key "), "n_nationkey", F.lit(" &amp; more</p></html>"))
    path = f"{scratch_folder(t.spark)}/html"
    t.nation.select("n_nationkey", html.alias("value")).write.mode("overwrite").partitionBy("n_nationkey").text(path)
    return src.scan_html_sections(t.spark, f"{path}/*").select("title", "text")


@query("S12_list_files", "SELECT r_regionkey AS k FROM region")
def _(t):
    path = f"{scratch_folder(t.spark)}/listed"
    src.sink_text(t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), path, "k", "name")
    return src.list_files(t.spark, f"{path}/*", "*.txt").select(F.regexp_extract("path", "k=([0-9]+)/", 1).cast("long").alias("k")).distinct()


@query("S13_first_source", "SELECT p_name, arg_min(p_brand, p_size * 1000000 + p_partkey) AS p_brand FROM part GROUP BY 1")
def _(t):
    own = t.part.withColumn("rank", F.col("p_size") * 1000000 + F.col("p_partkey"))
    return src.first_source(own, "p_name", "rank").select("p_name", "p_brand")


@query("S15_batched_lookup", "SELECT DISTINCT c_nationkey AS k, c_nationkey * 2 AS v FROM customer")
def _(t):
    fetch = lambda keys: pd.DataFrame({"k": keys, "v": [2 * k for k in keys]})
    return src.batched_lookup(t.customer.select(F.col("c_nationkey").cast("long").alias("k")), "k", fetch, "k long, v long", size=7)


@query("S16_waterfall", "SELECT c_custkey AS k, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END AS INTEGER) AS source FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 0")
def _(t):
    own = t.customer.select(F.col("c_custkey").alias("k"), "c_mktsegment", "c_acctbal")
    sources = [own.where("c_mktsegment = 'BUILDING'").select("k"), own.where("c_acctbal > 0").select("k")]
    return src.waterfall(own, sources, "k")


@query("K1_sink_csv", PARTS)
def _(t):
    path = f"{scratch_folder(t.spark)}/sink-csv"
    src.sink_csv(parts(t), path)
    return t.spark.read.csv(path, header=True, schema=PART_SCHEMA)


@query("K3_sink_json", PARTS)
def _(t):
    path = f"{scratch_folder(t.spark)}/sink-json"
    src.sink_jsonl(parts(t), path)
    return t.spark.read.json(path, schema=PART_SCHEMA)


@query("K4_sink_text", "SELECT n_regionkey AS k, n_name AS value FROM nation")
def _(t):
    path = f"{scratch_folder(t.spark)}/sink-text"
    src.sink_text(t.nation.select(F.col("n_regionkey").alias("k"), "n_name"), path, "k", "n_name")
    return t.spark.read.text(path).select(F.col("k").cast("long").alias("k"), "value")


@query("K5_sink_article_xml", XML_ROWS)
def _(t):
    key = F.col("page_id").cast("string")
    rows = t.pages.select("page_id", F.explode(F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(k + 1).alias("level"), title.alias("title"), text.alias("text")) for k, (title, text) in enumerate([(F.concat(F.lit("Methods "), key), F.concat(F.lit("We saw "), key, F.lit(" cases r & co"))), (F.lit("Data"), F.lit("From A."))])])).alias("s")).select("page_id", "s.*")
    path = f"{scratch_folder(t.spark)}/sink-xml"
    src.sink_article_xml(rows, path, "page_id")
    return src.xml_section_rows(t.spark.read.text(path), "value").select("pos", "level", "title", "text")
