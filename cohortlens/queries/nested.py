"""Set operations, reshaping, nested values and scalar functions over the test tables."""

from pyspark.sql import functions as F

from ..functions import codes, semantics as sem, text, vectors
from ..operators import patch, reshape
from ..operators.resolve import entity_groups
from .registry import query

CELL = "(SELECT l_orderkey AS k, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS cell FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"


def cells(t):
    own = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return own.groupBy(F.col("l_orderkey").alias("k")).agg(sem.flatten_unique(F.col("p_type")).alias("cell"))


@query("U1_bind_rows", "SELECT n_name AS name, n_regionkey AS r, NULL::VARCHAR AS extra FROM nation UNION ALL SELECT r_name, NULL, 'region' FROM region")
def _(t):
    return t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("r")).unionByName(t.region.select(F.col("r_name").alias("name"), F.lit("region").alias("extra")), allowMissingColumns=True)


@query("U2_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def _(t):
    return t.part.select("p_brand", "p_type").distinct()


@query("U3_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("U4_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("U5_setdiff", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def _(t):
    return t.nation.select(F.col("n_nationkey").alias("k")).subtract(t.supplier.where("s_acctbal < 0").select("s_nationkey"))


@query("U6_separate_longer", f"SELECT k, unnest(string_split(cell, ', ')) AS cell FROM {CELL}")
def _(t):
    return reshape.separate_longer(cells(t), "cell", ", ")


@query("U7_separate_paired", f"SELECT k, unnest(string_split(cell, ', ')) AS a, lower(unnest(string_split(cell, ', '))) AS b FROM {CELL}")
def _(t):
    own = cells(t).select("k", F.col("cell").alias("a"), F.lower("cell").alias("b"))
    return reshape.separate_longer_paired(own, "a", "b")


@query("U8_protect_phrases", f"SELECT k, unnest(string_split(replace(cell, 'ECONOMY, LARGE', 'ECONOMY*LARGE'), ', ')) AS part FROM {CELL}")
def _(t):
    own = cells(t).select("k", reshape.protect_phrases(F.col("cell"), ["ECONOMY, LARGE"]).alias("part"))
    return reshape.separate_longer(own, "part", ", ")


RANGES = "(VALUES ('A10-A15'), ('B20'), ('C30.1-C30.4'), ('D05-D05')) v(code)"
CODES = [("A10-A15",), ("B20",), ("C30.1-C30.4",), ("D05-D05",)]


@query("U9_separate_range", f"SELECT code, string_split(code, '-')[1] AS start_code, string_split(code, '-')[-1] AS end_code FROM {RANGES}")
def _(t):
    own = t.spark.createDataFrame(CODES, "code string")
    return reshape.separate_range(own.withColumn("c", F.col("code")), "c", "start_code", "end_code").select("code", "start_code", "end_code")


@query("U10_unnest", "SELECT n_regionkey, unnest(list_sort(list(n_name))) AS n_name FROM nation GROUP BY 1")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("a")).select("n_regionkey", F.explode_outer("a").alias("n_name"))


@query("U11_pivot_wider", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1")
def _(t):
    wide = t.orders.groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count(F.lit(1))).fillna(0)
    return wide.withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@query("U12_pivot_longer", "SELECT p_partkey, 'p_brand' AS name, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part")
def _(t):
    return t.part.unpivot("p_partkey", ["p_brand", "p_type"], "name", "value")


@query("U13_deframe", "SELECT n_regionkey, CAST(count(*) AS INTEGER) AS n, min(n_nationkey) AS first_key FROM nation GROUP BY 1")
def _(t):
    m = t.nation.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    return m.select("n_regionkey", F.size("m").alias("n"), F.array_min(F.map_values("m")).alias("first_key"))


@query("U14_canonical_cell", f"SELECT k, array_to_string(list_sort(list_distinct(string_split(cell || ', PROMO, ' || cell, ', '))), ', ') AS cell FROM {CELL}")
def _(t):
    return cells(t).select("k", sem.canonical_cell(F.concat("cell", F.lit(", PROMO, "), "cell")).alias("cell"))


MAP = [("ECONOMY", "cheap"), ("LARGE", None), ("PROMO", "offer"), ("MEDIUM", "offer"), ("SMALL", None)]


@query("U15_recode_cells", f"SELECT k, CASE WHEN v IS NULL THEN NULL ELSE v END AS cell FROM (SELECT c.k, string_agg(nv, ', ' ORDER BY first_pos) AS v FROM {CELL} c LEFT JOIN (SELECT k, nv, min(pos) AS first_pos FROM (SELECT k, pos, CASE p WHEN 'ECONOMY' THEN 'cheap' WHEN 'LARGE' THEN NULL WHEN 'PROMO' THEN 'offer' WHEN 'MEDIUM' THEN 'offer' WHEN 'SMALL' THEN NULL ELSE p END AS nv FROM (SELECT k, unnest(string_split(cell, ', ')) AS p, unnest(range(len(string_split(cell, ', ')))) AS pos FROM {CELL})) WHERE nv IS NOT NULL GROUP BY 1, 2) x ON c.k = x.k GROUP BY 1)")
def _(t):
    return reshape.recode_cells(cells(t), "k", "cell", t.spark.createDataFrame(MAP, "term string, new_term string"))


@query("U16_sorted_mapped_parts", f"SELECT k, array_to_string(list_sort(list_distinct(list_transform(string_split(cell, ', '), lambda x: lower(substr(x, 1, 1))))), ', ') AS initials FROM {CELL}")
def _(t):
    return cells(t).select("k", F.array_join(F.array_sort(F.array_distinct(F.transform(F.split("cell", ", "), lambda x: F.lower(F.substring(x, 1, 1))))), ", ").alias("initials"))


@query("U17_subset", f"SELECT a.k AS a, b.k AS b FROM {CELL} a JOIN {CELL} b ON a.k // 100 = b.k // 100 AND len(list_filter(string_split(a.cell, ', '), lambda x: NOT list_contains(string_split(b.cell, ', '), x))) = 0 AND len(string_split(a.cell, ', ')) < len(string_split(b.cell, ', '))")
def _(t):
    own = cells(t).select("k", F.floor(F.col("k") / 100).alias("g"), F.split("cell", ", ").alias("s"))
    return reshape.subsets(own, "g", "k", "s")


@query("U18_components", "WITH RECURSIVE v AS (SELECT s_suppkey AS r, 'n' || (s_suppkey // 3) AS x FROM supplier UNION SELECT s_suppkey, 'm' || (s_suppkey % 40) FROM supplier WHERE s_suppkey % 4 = 1), e AS (SELECT DISTINCT a.r AS a, b.r AS b FROM v a JOIN v b USING (x)), c AS (SELECT r, r AS g FROM v UNION SELECT e.b, c.g FROM c JOIN e ON c.r = e.a) SELECT r AS s_suppkey, min(g) AS group_id FROM c GROUP BY 1")
def _(t):
    key = F.col("s_suppkey")
    own = t.supplier.select("s_suppkey", F.concat(F.lit("N"), F.floor(key / 3).cast("string")).alias("full_name"), F.when(key % 4 == 1, F.concat(F.lit(" m"), (key % 40).cast("string"))).alias("synonym"))
    return entity_groups(own, "s_suppkey", ["full_name", "synonym"]).select("s_suppkey", "group_id")


@query("U19_group_size", "SELECT p_partkey, count(*) OVER (PARTITION BY p_name) AS size, CASE WHEN count(*) OVER (PARTITION BY p_name, p_brand) > 1 THEN 'name; brand' ELSE 'name' END AS match_type FROM part")
def _(t):
    from pyspark.sql import Window

    brand = F.count(F.lit(1)).over(Window.partitionBy("p_name", "p_brand")) > 1
    return t.part.select("p_partkey", F.count(F.lit(1)).over(Window.partitionBy("p_name")).alias("size"), F.concat_ws("; ", F.lit("name"), F.when(brand, "brand")).alias("match_type"))


@query("F1_replace", "SELECT doc_id, regexp_replace(text, '[aeiou]+', '_', 'g') AS a, regexp_replace(text, '[aeiou]+', '_') AS f FROM documents")
def _(t):
    return t.documents.select("doc_id", F.regexp_replace("text", "[aeiou]+", "_").alias("a"), text.replace_first(F.col("text"), "[aeiou]+", "_").alias("f"))


@query("F2_remove", "SELECT conv_id, turn, regexp_replace(text, '[0-9,.]+', '', 'g') AS t FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.regexp_replace("text", "[0-9,.]+", "").alias("t"))


@query("F3_extract", "SELECT doc_id, nullif(regexp_extract(text, '[A-Z]{4,}[0-9]*'), '') AS code FROM documents")
def _(t):
    return t.documents.select("doc_id", text.extract(F.col("text"), "[A-Z]{4,}[0-9]*").alias("code"))


@query("F4_extract_all", "SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]{3,}'), '|') AS numbers FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit("[0-9]{3,}"), F.lit(0)), "|").alias("numbers"))


@query("F5_match_group", "SELECT event_id, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INTEGER) AS k FROM events")
def _(t):
    return t.events.select("event_id", text.extract(F.col("props"), '"k": ([0-9]+)', 1).try_cast("int").alias("k"))


@query("F6_detect", "SELECT doc_id, regexp_matches(text, 'the|le|der') AS hit FROM documents")
def _(t):
    return t.documents.select("doc_id", F.col("text").rlike("the|le|der").alias("hit"))


@query("F7_count", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[.!?]')) AS INTEGER) AS ends, CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS BIGINT) AS th FROM documents")
def _(t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit("[.!?]")).alias("ends"), text.count_literal(F.col("text"), "th").alias("th"))


@query("F8_locate_all", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS INTEGER) AS n, CAST(coalesce(nullif(length(regexp_extract(text, '^[^0-9]*')), length(text)), -1) AS INTEGER) AS first_start FROM documents")
def _(t):
    s = text.locate_all(F.col("text"), "[0-9]+")
    return t.documents.select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n"), F.coalesce(F.get("s", F.lit(0))["start"], F.lit(-1)).alias("first_start"))


@query("F9_substring", "SELECT doc_id, substr(text, 11, 20) AS piece FROM documents")
def _(t):
    return t.documents.select("doc_id", F.substring("text", 11, 20).alias("piece"))


@query("F10_strsplit", "SELECT s, CAST(n_keep AS INTEGER) AS n_keep, CAST(CASE WHEN s = '' THEN 0 WHEN s LIKE '%|' THEN n_keep - 1 ELSE n_keep END AS INTEGER) AS n_drop FROM (SELECT s, len(string_split(s, '|')) AS n_keep FROM (VALUES (''), ('a'), ('a|'), ('|a'), ('a||b'), (NULL)) v(s))")
def _(t):
    own = t.spark.createDataFrame([("",), ("a",), ("a|",), ("|a",), ("a||b",), (None,)], "s string")
    n = lambda a: F.when(F.col("s").isNotNull(), F.size(a))
    return own.select("s", n(sem.split_keep(F.col("s"), r"\|")).alias("n_keep"), n(sem.strsplit(F.col("s"), r"\|")).alias("n_drop"))


@query("F11_case", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l FROM part")
def _(t):
    return t.part.select("p_partkey", F.upper("p_name").alias("u"), F.lower("p_type").alias("l"))


@query("F12_squish", "SELECT page_id, trim(regexp_replace(html, '[\\t\\n\\f\\r ]+', ' ', 'g')) AS s FROM pages")
def _(t):
    return t.pages.select("page_id", text.squish(F.col("html")).alias("s"))


@query("F13_length", "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.length("text").alias("n"))


@query("F14_paste", "SELECT s_suppkey, printf('%05d-%s', s_suppkey, s_name) AS tag, concat_ws('; ', s_name, NULL, 'x') AS joined FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", F.format_string("%05d-%s", "s_suppkey", "s_name").alias("tag"), F.concat_ws("; ", "s_name", F.lit(None).cast("string"), F.lit("x")).alias("joined"))


@query("F15_fold", "SELECT doc_id, strip_accents(text) AS folded FROM documents")
def _(t):
    return t.documents.select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("F16_numbers", "SELECT p_partkey, round_even(p_retailprice, 0) AS even, log10(p_retailprice) > 2.9 AS big, CAST(ceil(p_retailprice / 7) AS BIGINT) AS up FROM part")
def _(t):
    price = F.col("p_retailprice")
    return t.part.select("p_partkey", F.bround(price, 0).alias("even"), (F.log10(price) > 2.9).alias("big"), F.ceil(price / 7).alias("up"))


@query("F17_dates", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderdate >= TIMESTAMP '1997-01-01' AS late FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.year("o_orderdate").alias("yr"), (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")).alias("late"))


@query("F18_try_cast", "SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS a, TRY_CAST(p_type AS DOUBLE) AS b FROM part")
def _(t):
    return t.part.select("p_partkey", F.replace("p_brand", F.lit("Brand#"), F.lit("")).try_cast("int").alias("a"), F.col("p_type").try_cast("double").alias("b"))


@query("F19_distances", "SELECT a.r_name AS a, b.r_name AS b, CAST(levenshtein(a.r_name, b.r_name) AS INTEGER) AS d FROM region a, region b WHERE a.r_regionkey < b.r_regionkey")
def _(t):
    a, b = t.region.select(F.col("r_name").alias("a"), F.col("r_regionkey").alias("ka")), t.region.select(F.col("r_name").alias("b"), F.col("r_regionkey").alias("kb"))
    return a.join(F.broadcast(b), F.col("ka") < F.col("kb")).select("a", "b", F.levenshtein("a", "b").alias("d"))


@query("F20_expand_range", "SELECT * FROM (VALUES ('A10-A15', 'A10'), ('A10-A15', 'A11'), ('A10-A15', 'A12'), ('A10-A15', 'A13'), ('A10-A15', 'A14'), ('A10-A15', 'A15'), ('B20', 'B20'), ('C30.1-C30.4', 'C30.1'), ('C30.1-C30.4', 'C30.2'), ('C30.1-C30.4', 'C30.3'), ('C30.1-C30.4', 'C30.4'), ('D05-D05', 'D05')) v(code, each)")
def _(t):
    own = t.spark.createDataFrame(CODES, "code string")
    return own.select("code", F.explode(codes.expand_range(F.col("code"))).alias("each"))


@query("F21_collapse_degenerate", "SELECT code, CASE WHEN code = 'D05-D05' THEN 'D05' ELSE code END AS short FROM " + RANGES)
def _(t):
    return t.spark.createDataFrame(CODES, "code string").select("code", codes.collapse_degenerate(F.col("code")).alias("short"))


@query("F22_code_parts", "SELECT p_partkey, substr(p_type, 1, 1) AS letter, CAST(p_size AS DOUBLE) + 0.5 AS num FROM part")
def _(t):
    own = t.part.withColumn("c", F.concat(F.substring("p_type", 1, 1), F.col("p_size").cast("string"), F.lit(".5")))
    return own.select("p_partkey", codes.letter(F.col("c")).alias("letter"), codes.number(F.col("c")).alias("num"))


@query("F23_counts", "SELECT * FROM (VALUES ('1,234 European ancestry cases, 500 controls', CAST(1234 AS BIGINT), CAST(1734 AS BIGINT)), ('up to 5,000 individuals', NULL, 5000), ('none', NULL, NULL)) v(s, lead, total)")
def _(t):
    own = t.spark.createDataFrame([("1,234 European ancestry cases, 500 controls",), ("up to 5,000 individuals",), ("none",)], "s string")
    return own.select("s", codes.leading_count(F.col("s")).alias("lead"), codes.all_counts(F.col("s")).alias("total"))


@query("F24_coalesce", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END, ''), 'unknown') AS v FROM part")
def _(t):
    return t.part.select("p_partkey", F.coalesce(sem.blank_to_null(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type"))), F.lit("unknown")).alias("v"))


@query("F25_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    a = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea"), (F.col("vec_id") + 1).alias("b"))
    b = t.embeddings.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    return a.join(b, "b").select("a", "b", F.round(vectors.cosine(F.col("ea"), F.col("eb")), 6).alias("sim"))


@query("F26_softmax", "SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS best, round(1.0 / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 6) AS top FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def _(t):
    e = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", vectors.argmax(e).alias("best"), F.round(F.array_max(vectors.softmax(e)), 6).alias("top"))


@query("F27_path_parts", "SELECT page_id, string_split(url, '/')[-1] AS base FROM pages")
def _(t):
    return t.pages.select("page_id", F.element_at(F.split("url", "/"), -1).alias("base"))


@query("F28_json_access", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
