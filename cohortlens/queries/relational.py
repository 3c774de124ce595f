"""Projection, filters, joins and patches over the test tables."""

from pyspark.sql import functions as F

from ..functions.semantics import if_else, is_in, not_in
from ..operators import joins, patch, reshape
from .registry import query

# A label with blanks and nulls, in both engines alike.
def label():
    return F.when(F.col("p_size") % 7 == 0, None).when(F.col("p_size") % 7 == 1, "").otherwise(F.col("p_type"))


SQL_LABEL = "CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN '' ELSE p_type END"


@query("P1_select_rename_drop", "SELECT n_nationkey AS nation_id, n_name AS nation FROM nation")
def _(t):
    return t.nation.withColumnsRenamed({"n_nationkey": "nation_id", "n_name": "nation"}).drop("n_regionkey")


@query("P2_rename_with", "SELECT r_regionkey AS \"REGIONKEY\", r_name AS \"NAME\" FROM region")
def _(t):
    return reshape.rename_with(t.region, lambda c: c.removeprefix("r_").upper())


@query("P3_rename_any_of", "SELECT r_regionkey AS id, r_name FROM region")
def _(t):
    return reshape.rename_any_of(t.region, {"r_regionkey": "id", "absent": "gone"})


@query("P4_mutate", "SELECT o_orderkey, o_totalprice * 2 AS twice, CAST(year(o_orderdate) AS INTEGER) AS yr FROM orders")
def _(t):
    return t.orders.select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice"), F.year("o_orderdate").alias("yr"))


@query("P5_mutate_across", "SELECT s_suppkey, lower(trim(s_name)) AS s_name, s_nationkey, s_acctbal FROM supplier")
def _(t):
    df = t.supplier
    return df.withColumns({c: F.lower(F.trim(c)) for c, kind in df.dtypes if kind == "string"})


@query("P6_if_else", f"SELECT p_partkey, CASE WHEN l = '' THEN 'blank' WHEN NOT (l = '') THEN 'named' END AS kind FROM (SELECT p_partkey, {SQL_LABEL} AS l FROM part)")
def _(t):
    return t.part.select("p_partkey", if_else(label() == "", F.lit("blank"), F.lit("named")).alias("kind"))


@query("P7_case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' END AS size_class FROM part")
def _(t):
    return t.part.select("p_partkey", F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").alias("size_class"))


@query("P8_filter", f"SELECT p_partkey FROM part WHERE {SQL_LABEL} <> 'x' AND p_size > 30")
def _(t):
    return t.part.where((label() != "x") & (F.col("p_size") > 30)).select("p_partkey")


@query("P9_in", f"SELECT p_partkey, coalesce({SQL_LABEL} IN ('', 'ECONOMY'), false) AS hit FROM part")
def _(t):
    return t.part.select("p_partkey", is_in(label(), ["", "ECONOMY"]).alias("hit"))


@query("P10_not_in", f"SELECT p_partkey FROM part WHERE NOT coalesce({SQL_LABEL} IN ('', 'ECONOMY'), false)")
def _(t):
    return t.part.where(not_in(label(), ["", "ECONOMY"])).select("p_partkey")


@query("P11_regex_predicate", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e') OR contains(text, '@')")
def _(t):
    return t.documents.where(F.col("text").rlike("(?i)licen[sc]e") | F.contains("text", F.lit("@"))).select("doc_id")


@query("P12_lookbehind", "SELECT doc_id FROM documents WHERE contains(replace(text, 'and the', '#'), ' the')")
def _(t):
    return t.documents.where(F.col("text").rlike("(?<!and) the")).select("doc_id")


@query("P13_between", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 11")
def _(t):
    return t.lineitem.where(F.col("l_quantity").between(10, 11)).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("P14_presence", f"SELECT p_partkey, l IS NULL AS missing, coalesce(length(trim(l)) > 0, false) AS content FROM (SELECT p_partkey, {SQL_LABEL} AS l FROM part)")
def _(t):
    from ..functions.semantics import has_content

    return t.part.select("p_partkey", label().isNull().alias("missing"), has_content(label()).alias("content"))


@query("P15_group_filter", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 5)")
def _(t):
    five = t.orders.groupBy("o_custkey").count().where("count = 5").select("o_custkey")
    return t.orders.join(five, "o_custkey", "left_semi").select("o_custkey", "o_orderkey")


@query("P16_unite", f"SELECT p_partkey, concat_ws(', ', l, p_brand) AS united FROM (SELECT *, {SQL_LABEL} AS l FROM part)")
def _(t):
    return reshape.unite(t.part.withColumn("l", label()), "united", ["l", "p_brand"]).select("p_partkey", "united")


@query("P17_constants", "SELECT r_regionkey, r_name, 'catalog' AS origin, 2025 AS release FROM region")
def _(t):
    return reshape.with_constants(t.region, {"origin": "catalog", "release": 2025})


@query("P18_literal_table", "SELECT * FROM (VALUES ('EUROPE', 'Old World'), ('ASIA', 'Old World'), ('AMERICA', 'New World')) v(r_name, world)")
def _(t):
    return t.spark.createDataFrame([("EUROPE", "Old World"), ("ASIA", "Old World"), ("AMERICA", "New World")], "r_name string, world string")


@query("P19_assert_unique", "SELECT CAST(count(*) AS BIGINT) AS n FROM nation")
def _(t):
    return patch.assert_unique(t.nation, ["n_nationkey"]).agg(F.count(F.lit(1)).alias("n"))


@query("J1_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def _(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("J2_natural_join", "SELECT a.n_nationkey, a.n_regionkey, a.n_name, b.r_name FROM nation a LEFT JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region WHERE r_regionkey < 3) b USING (n_regionkey)")
def _(t):
    b = t.region.where("r_regionkey < 3").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.natural_join(t.nation, b)


@query("J3_inner_join", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query("J4_full_join", "SELECT coalesce(a.k, b.k) AS k, a.n_cust, b.n_supp FROM (SELECT c_nationkey AS k, count(*) AS n_cust FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_supp FROM supplier WHERE s_nationkey > 9 GROUP BY 1) b ON a.k = b.k")
def _(t):
    a = t.customer.where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_cust"))
    b = t.supplier.where("s_nationkey > 9").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_supp"))
    return a.join(b, "k", "full")


@query("J5_join_contract", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    one = patch.assert_unique(t.nation, ["n_nationkey"])
    return t.customer.join(one, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


BANDS = "(VALUES ('B1', 0.0, 950.0, 'low'), ('B1', 900.0, 1300.0, 'mid'), ('B2', 1000.0, 1500.0, 'mid'), ('B4', 0.0, 5000.0, 'all')) v(letter, lo, hi, band)"


@query("J6_interval_join", f"SELECT p_partkey, letter, price, lo, hi, band FROM (SELECT p_partkey, 'B' || substr(p_brand, length(p_brand), 1) AS letter, p_retailprice AS price FROM part) f LEFT JOIN (SELECT letter, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, band FROM {BANDS}) r USING (letter) WHERE price BETWEEN lo AND hi OR band IS NULL UNION ALL SELECT p_partkey, letter, price, NULL, NULL, NULL FROM (SELECT p_partkey, 'B' || substr(p_brand, length(p_brand), 1) AS letter, p_retailprice AS price FROM part) f WHERE EXISTS (SELECT 1 FROM {BANDS} WHERE v.letter = f.letter) AND NOT EXISTS (SELECT 1 FROM {BANDS} WHERE v.letter = f.letter AND f.price BETWEEN v.lo AND v.hi)")
def _(t):
    bands = t.spark.createDataFrame([("B1", 0.0, 950.0, "low"), ("B1", 900.0, 1300.0, "mid"), ("B2", 1000.0, 1500.0, "mid"), ("B4", 0.0, 5000.0, "all")], "letter string, lo double, hi double, band string")
    facts = t.part.select("p_partkey", F.concat(F.lit("B"), F.right("p_brand", F.lit(1))).alias("letter"), F.col("p_retailprice").alias("price"))
    return joins.interval_join(facts, bands, "letter", "price", width=250.0)


@query("J7_rows_patch", "SELECT x.p_partkey, coalesce(x.code, y.code) AS code, coalesce(x.origin, y.origin) AS origin FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand END AS code, CASE WHEN p_size % 2 = 0 THEN 'direct' END AS origin FROM part) x LEFT JOIN (SELECT p_partkey, p_type AS code, 'patched' AS origin FROM part WHERE p_partkey % 2 = 0) y USING (p_partkey)")
def _(t):
    x = t.part.select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("code"), F.when(F.col("p_size") % 2 == 0, "direct").alias("origin"))
    y = t.part.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_type").alias("code"), F.lit("patched").alias("origin"))
    return patch.rows_patch(x, y, ["p_partkey"])


@query("J8_rows_update", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_size > 25 THEN p_type END ELSE p_brand END AS code FROM part")
def _(t):
    x = t.part.select("p_partkey", F.col("p_brand").alias("code"))
    y = t.part.where("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_type")).alias("code"))
    return patch.rows_update(x, y, ["p_partkey"])


@query("J9_rows_append", "SELECT * FROM region UNION ALL SELECT r_regionkey + 100 AS r_regionkey, r_name FROM region")
def _(t):
    return patch.rows_append(t.region, t.region.withColumn("r_regionkey", F.col("r_regionkey") + 100))


@query("J10_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("J11_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("J12_normalised_key", "SELECT a.p_name AS left_name, b.r_name AS right_name FROM (SELECT DISTINCT p_name FROM part) a JOIN region b ON lower(right(trim(a.p_name), 1)) = lower(right(trim(b.r_name), 1))")
def _(t):
    a, b = t.part.select("p_name").distinct().withColumn("k", F.lower(F.right(F.trim("p_name"), F.lit(1)))), t.region.withColumn("k", F.lower(F.right(F.trim("r_name"), F.lit(1))))
    return a.join(b, "k").select(F.col("p_name").alias("left_name"), F.col("r_name").alias("right_name"))


@query("J13_two_hop", "SELECT a.p_name AS term, string_agg(DISTINCT c.p_type, ', ' ORDER BY c.p_type) AS codes FROM (SELECT DISTINCT p_name, p_brand FROM part) a JOIN (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 40) c USING (p_brand) GROUP BY 1")
def _(t):
    concepts = t.part.select(F.col("p_brand").alias("cui"), F.upper("p_name").alias("str"), F.when(F.col("p_size") > 40, F.col("p_type")).alias("code"))
    return joins.concept_codes(t.part.select(F.col("p_name").alias("term")), concepts)


@query("J14_near_pairs", "SELECT DISTINCT a.p_name AS \"left\", b.p_name AS \"right\", CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS d FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name <> b.p_name AND levenshtein(a.p_name, b.p_name) <= 3")
def _(t):
    return joins.near_pairs(t.part, t.part, "p_name", 3)


@query("J15_text_contains", "SELECT DISTINCT doc_id, term FROM (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS hay FROM documents) d JOIN (VALUES ('of the'), ('all rights reserved'), ('Licensed under'), ('le'), ('zzz')) v(term) ON contains(hay, ' ' || lower(term) || ' ')")
def _(t):
    terms = t.spark.createDataFrame([("of the",), ("all rights reserved",), ("Licensed under",), ("le",), ("zzz",)], "term string")
    return joins.contains_terms(t.documents, terms, "doc_id", "text")


@query("J16_keyed_ratio", "SELECT n_name, round(max(CASE WHEN s = 'BUILDING' THEN b END) / max(CASE WHEN s = 'MACHINERY' THEN b END), 6) AS ratio FROM (SELECT c_nationkey AS k, c_mktsegment AS s, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS b FROM customer GROUP BY 1, 2) JOIN nation ON k = n_nationkey GROUP BY 1")
def _(t):
    money = F.sum(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal").cast("decimal(18,2)"))).cast("double")
    other = F.sum(F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_acctbal").cast("decimal(18,2)"))).cast("double")
    by = t.customer.groupBy("c_nationkey").agg(F.round(money / other, 6).alias("ratio"))
    return by.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "ratio")


@query("J17_per_key", "SELECT p_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (p_size > 25) AS BIGINT) AS n_large FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_size") > 25).alias("n_large"))
