"""Composite operators: representation, harmonisation, code cascade, documents, labels."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import semantics as sem, text, vectors
from ..operators import joins, patch, reshape, stats, windows
from ..plans import documents as docs, labels, representation as rep
from .aggregates import SPEARMAN
from .nested import CELL, cells
from .registry import query

WORLDS = [("AMERICA", "Americas"), ("ASIA", "Asia"), ("EUROPE", "Europe")]
CAT = "CASE r_name WHEN 'AMERICA' THEN 'Americas' WHEN 'ASIA' THEN 'Asia' WHEN 'EUROPE' THEN 'Europe' ELSE r_name END"


def facts(t, parts=None):
    """Quantities by region and order date: the fact table of the representation queries; with columns of ``parts``, if given."""
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    orders = joins.dealt(orders, orders.count(), "o_custkey").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    orders = orders.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    own = t.lineitem.select("l_orderkey", "l_quantity", "l_partkey")
    n = own.count()
    if parts is not None:
        own = joins.dealt(own, n, "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joins.dealt(own, n, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


FACTS = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("B1_map_category", f"SELECT n_name, CASE WHEN label = 'AMERICA' THEN 'Americas' WHEN label = 'ASIA' THEN 'Asia' WHEN label = 'EUROPE' THEN 'Europe' WHEN contains(label, ', ') THEN 'Multiple' ELSE label END AS category FROM (SELECT n_name, CASE WHEN n_nationkey % 4 = 0 THEN r_name || ', ASIA' ELSE r_name END AS label FROM nation JOIN region ON n_regionkey = r_regionkey)")
def _(t):
    own = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    own = own.select("n_name", F.when(F.col("n_nationkey") % 4 == 0, F.concat("r_name", F.lit(", ASIA"))).otherwise(F.col("r_name")).alias("label"))
    return rep.map_category(own, "label", t.spark.createDataFrame(WORLDS, "source_label string, category string")).drop("label")


@query("B2_valid_counts", "SELECT p_partkey, v FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 0 ELSE p_size END AS v FROM part) WHERE v <> 0")
def _(t):
    own = t.part.select("p_partkey", F.when(F.col("p_size") % 5 == 0, None).when(F.col("p_size") % 5 == 1, 0).otherwise(F.col("p_size")).alias("v"))
    return rep.valid_counts(own, "v")


@query("B3_group_totals", f"SELECT r_name, sum(l_quantity) / 1000000 AS total, round(100.0 * sum(l_quantity) / sum(sum(l_quantity)) OVER (), 6) AS pct FROM {FACTS} GROUP BY 1")
def _(t):
    own = stats.share(facts(t), ["r_name"], F.col("l_quantity"), "total")
    return own.select("r_name", (F.col("total") / 1000000).alias("total"), F.round("pct", 6).alias("pct"))


@query("B4_running_total_by_group", f"WITH r AS (SELECT category, d, sum(q) OVER (PARTITION BY category ORDER BY d ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT {CAT} AS category, CAST(o_orderdate AS DATE) AS d, sum(l_quantity) AS q FROM {FACTS} WHERE l_quantity <> 0 GROUP BY 1, 2)) SELECT category, CAST(d AS VARCHAR) AS d, n FROM (SELECT * FROM r UNION ALL SELECT category, (SELECT max(d) FROM r), max(n) FROM r GROUP BY 1 HAVING max(d) < (SELECT max(d) FROM r))")
def _(t):
    own = rep.map_category(facts(t), "r_name", t.spark.createDataFrame(WORLDS, "source_label string, category string"))
    own = own.select("category", F.to_date("o_orderdate").alias("d"), F.col("l_quantity").alias("n"))
    return rep.group_running_totals(own, "category", "d", "n").withColumn("d", F.col("d").cast("string"))


@query("B5_top_traits", "SELECT trait, count(*) AS n_papers FROM (SELECT DISTINCT p_name AS trait, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1 ORDER BY n_papers DESC, trait LIMIT 10")
def _(t):
    own = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_name").alias("trait"), "l_orderkey").distinct()
    return own.groupBy("trait").agg(F.count(F.lit(1)).alias("n_papers")).orderBy(F.desc("n_papers"), "trait").limit(10)


PROFILE = f"SELECT trait, sum(t) AS total_n, coalesce(sum(g), 0) AS group_n, count(*) AS n_papers, max(m) AS max_n, median(t) AS median_n, round(median(CASE WHEN a THEN 100.0 * g / t END), 6) AS median_share, round(quantile_cont(CASE WHEN a THEN 100.0 * g / t END, 0.25), 6) AS q1_share, round(100.0 * coalesce(sum(g), 0) / sum(t), 6) AS group_pct FROM (SELECT p_name AS trait, l_orderkey, sum(l_quantity) AS t, sum(l_quantity) FILTER (r_name = 'EUROPE') AS g, max(l_quantity) AS m, bool_or(r_name = 'EUROPE') AS a FROM {FACTS} JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 2"


def profile(t):
    # Parts are met first: grouping by trait and order then finds the rows dealt by order.
    own = facts(t, t.part.select("p_partkey", "p_name"))
    return rep.trait_profile(own.withColumnRenamed("p_name", "trait"), "trait", "l_orderkey", "l_quantity", F.col("r_name") == "EUROPE")


@query("B6_trait_profile", PROFILE)
def _(t):
    return profile(t).withColumns({c: F.round(c, 6) for c in ("median_share", "q1_share", "group_pct")})


@query("B7_trait_correlations", SPEARMAN.format("SELECT 'all' AS g, total_n AS x, n_papers AS y FROM (" + PROFILE + ")") + " UNION ALL " + SPEARMAN.format("SELECT 'large' AS g, total_n AS x, n_papers AS y FROM (" + PROFILE + ") WHERE n_papers > 900"))
def _(t):
    own = profile(t).select("total_n", "n_papers")
    both = own.withColumn("g", F.lit("all")).unionByName(own.where("n_papers > 900").withColumn("g", F.lit("large")))
    return stats.spearman(both, "total_n", "n_papers", ["g"]).withColumn("rho", F.round("rho", 6))


@query("B8_burden_vs_effort", "SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM (SELECT lower(p_name) AS c, sum(p_size) AS x FROM part GROUP BY 1) JOIN (SELECT lower(p_name) AS c, sum(l_quantity) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) USING (c))")
def _(t):
    a = t.part.groupBy(F.lower("p_name").alias("c")).agg(F.sum("p_size").alias("x"))
    b = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.lower("p_name").alias("c")).agg(F.sum("l_quantity").alias("y"))
    return stats.spearman(a.join(b, "c"), "x", "y").withColumn("rho", F.round("rho", 6))


@query("B9_unattributed_burden", "SELECT c_custkey, round(c_acctbal * (1 - greatest(0.0, (c_custkey % 7 - 2) / 10.0)), 6) AS rest FROM customer ORDER BY rest DESC, c_custkey LIMIT 15")
def _(t):
    own = t.customer.select("c_custkey", F.round(rep.unattributed(F.col("c_acctbal"), (F.col("c_custkey") % 7 - 2) / 10.0), 6).alias("rest"))
    return windows.top(own, 15, [F.desc("rest"), "c_custkey"], ties=False)


@query("B10_year_profile", "SELECT c_mktsegment, min(y) AS min, quantile_cont(y, 0.25) AS q1, median(y) AS median, round(avg(y), 6) AS mean, quantile_cont(y, 0.75) AS q3, max(y) AS max, CAST(0 AS BIGINT) AS n_null FROM (SELECT DISTINCT c_mktsegment, o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS y FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1")
def _(t):
    own = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "o_orderkey", F.year("o_orderdate").alias("y")).distinct()
    return stats.six_numbers(own, "y", ["c_mktsegment"]).withColumn("mean", F.round("mean", 6))


@query("B11_coverage_by_year", "SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS n, round(100.0 * count(*) FILTER (o_orderstatus = 'P') / count(*), 6) AS pct_missing, count(*) FILTER (o_totalprice > 200000) AS n_full FROM orders GROUP BY 1")
def _(t):
    missing = F.count_if(F.col("o_orderstatus") == "P")
    return t.orders.groupBy(F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * missing / F.count(F.lit(1)), 6).alias("pct_missing"), F.count_if(F.col("o_totalprice") > 200000).alias("n_full"))


RULES = [(1, "SMALL", "MEDIUM"), (2, "MEDIUM", "LARGE"), (3, "PROMO", "STANDARD")]
ROLLED = "CASE x WHEN 'SMALL' THEN 'LARGE' WHEN 'MEDIUM' THEN 'LARGE' WHEN 'PROMO' THEN 'STANDARD' ELSE x END"


@query("C1_whole_term", f"SELECT k, array_to_string(list_transform(string_split(cell, ', '), lambda x: CASE WHEN x = 'LARGE' THEN 'HUGE' ELSE x END), ', ') AS cell FROM {CELL}")
def _(t):
    return cells(t).withColumn("cell", reshape.replace_terms(F.col("cell"), {"LARGE": "HUGE"}))


@query("C2_rollup_terms", f"SELECT k, array_to_string(list_sort(list_distinct(list_transform(string_split(cell, ', '), lambda x: {ROLLED}))), ', ') AS cell FROM {CELL}")
def _(t):
    rolled = reshape.replace_terms(F.col("cell"), reshape.rollup_fixpoint(RULES))
    return cells(t).withColumn("cell", sem.canonical_cell(rolled))


@query("C3_conditional_rollup", f"SELECT k, CASE WHEN k % 2 = 0 AND contains(cell, 'PROMO') THEN array_to_string(list_transform(string_split(cell, ', '), lambda x: {ROLLED}), ', ') ELSE cell END AS cell FROM {CELL}")
def _(t):
    rolled = reshape.replace_terms(F.col("cell"), reshape.rollup_fixpoint(RULES))
    return cells(t).withColumn("cell", F.when((F.col("k") % 2 == 0) & F.col("cell").rlike("PROMO"), rolled).otherwise(F.col("cell")))


@query("C4_ontology_descendants", "SELECT label, CAST(row_number() OVER (ORDER BY length(label) DESC, label) AS INTEGER) AS place FROM (SELECT DISTINCT lower(trim(p_name)) AS label FROM part WHERE p_type = 'PROMO')")
def _(t):
    own = t.part.where("p_type = 'PROMO'").select(F.lower(F.trim("p_name")).alias("label")).distinct()
    return own.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.length("label").desc(), "label")))


@query("C5_exclusive_class", "SELECT p_name AS term, arg_min(p_type, p_size * 1000000 + p_partkey) AS class FROM part GROUP BY 1")
def _(t):
    own = t.part.withColumn("_p", F.row_number().over(Window.partitionBy("p_name").orderBy("p_size", "p_partkey")))
    return own.where("_p = 1").select(F.col("p_name").alias("term"), F.col("p_type").alias("class"))


@query("C6_flag_any", "SELECT o_custkey, bool_or(coalesce(f, false)) AS flag FROM (SELECT o_custkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority IN ('1-URGENT', '2-HIGH') END AS f FROM orders) GROUP BY 1")
def _(t):
    f = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return t.orders.groupBy("o_custkey").agg(sem.any_known(f).alias("flag"))


@query("C7_codes_by_prefix", "SELECT DISTINCT p_name FROM part WHERE CAST(replace(p_brand, 'Brand#', '') AS INTEGER) BETWEEN 10 AND 12 AND p_size < 10")
def _(t):
    return t.part.where(F.replace("p_brand", F.lit("Brand#"), F.lit("")).try_cast("int").between(10, 12) & (F.col("p_size") < 10)).select("p_name").distinct()


@query("D1_mapping_base", f"SELECT DISTINCT k, term FROM (SELECT k, unnest(string_split(cell, ', ')) AS term FROM {CELL}) WHERE term <> ''")
def _(t):
    return reshape.separate_longer(cells(t), "cell", ", ").select("k", F.col("cell").alias("term")).where("term <> ''").distinct()


# Codes in the four ways in which studies write them, from the numbers of each part.
STATED = "CASE p_partkey % 6 WHEN 0 THEN 'ICD10 K' || p_size || ': ' || p_name WHEN 1 THEN 'Source of report of K7' || p_size % 10 || ' (' || p_name || ')' WHEN 2 THEN p_name || ' (Union E1' || p_size % 10 || ')' WHEN 3 THEN p_name || ' ICD-10 J' || (10 + p_size) || '.1' WHEN 4 THEN 'Union of ' || p_name ELSE p_name END"


@query("D2_provided_code", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'K' || p_size WHEN 1 THEN 'K7' || p_size % 10 WHEN 2 THEN 'E1' || p_size % 10 WHEN 3 THEN 'J' || (10 + p_size) || '.1' END AS code, CASE WHEN p_partkey % 6 < 5 THEN 'Study Provided' END AS origin FROM part")
def _(t):
    return rep.provided_codes(t.part.select("p_partkey", F.expr(STATED).alias("trait")), "trait").select("p_partkey", "code", "origin")


@query("D3_group_codes", "SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS codes FROM part WHERE p_size < 12 GROUP BY 1")
def _(t):
    return t.part.where("p_size < 12").groupBy("p_brand").agg(sem.flatten_unique(F.col("p_type")).alias("codes"))


@query("D4_label_cleanup", "SELECT DISTINCT p_name, trim(regexp_replace(p_name, '(red|blue|green) ', '', 'g')) AS label FROM part")
def _(t):
    return t.part.select("p_name", F.trim(F.regexp_replace("p_name", "(red|blue|green) ", "")).alias("label")).distinct()


SOURCE = "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_brand END AS code, CASE WHEN p_size % 4 = 0 THEN 'author' END AS origin FROM part"


def cascade(t):
    x = t.part.select("p_partkey", F.when(F.col("p_size") % 4 == 0, F.col("p_brand")).alias("code"), F.when(F.col("p_size") % 4 == 0, "author").alias("origin"))
    for rest, column, origin in ((1, "p_type", "description"), (2, "p_name", "synonym")):
        y = t.part.where(f"p_size % 4 <= {rest}").select("p_partkey", F.col(column).alias("code"), F.lit(origin).alias("origin"))
        x = patch.rows_patch(x, y, ["p_partkey"])
    return x


CASCADE = "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN p_name END AS code, CASE p_size % 4 WHEN 0 THEN 'author' WHEN 1 THEN 'description' WHEN 2 THEN 'synonym' END AS origin FROM part"


@query("D5_match_cascade", CASCADE)
def _(t):
    return cascade(t)


@query("D6_infer_from_similar", "SELECT p_partkey, coalesce(code, other) AS code FROM (SELECT p_partkey, p_name, CASE WHEN p_size % 4 = 0 THEN p_brand END AS code FROM part) LEFT JOIN (SELECT p_name, min(p_brand) AS other FROM part WHERE p_size % 4 = 0 GROUP BY 1) USING (p_name)")
def _(t):
    x = t.part.select("p_partkey", "p_name", F.when(F.col("p_size") % 4 == 0, F.col("p_brand")).alias("code"))
    y = x.where("code is not null").groupBy("p_name").agg(F.min("code").alias("code"))
    return patch.rows_patch(x, y, ["p_name"]).select("p_partkey", "code")


@query("D7_provenance", f"SELECT coalesce(origin, 'none') AS origin, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM ({CASCADE}) GROUP BY 1")
def _(t):
    return stats.share(cascade(t).withColumn("origin", F.coalesce("origin", F.lit("none"))), ["origin"]).withColumn("pct", F.bround("pct", 4))


@query("D9_assign_cause", "SELECT p_partkey, cause FROM part LEFT JOIN (VALUES ('P', 0, 20, 'low'), ('P', 15, 50, 'high'), ('S', 10, 30, 'mid')) v(letter, lo, hi, cause) ON substr(p_type, 1, 1) = letter AND p_size BETWEEN lo AND hi")
def _(t):
    ranges = t.spark.createDataFrame([("P", 0.0, 20.0, "low"), ("P", 15.0, 50.0, "high"), ("S", 10.0, 30.0, "mid")], "letter string, lo double, hi double, cause string")
    own = t.part.select("p_partkey", F.substring("p_type", 1, 1).alias("letter"), F.col("p_size").cast("double").alias("num"))
    return joins.interval_join(own, ranges, "letter", "num").select("p_partkey", "cause")


@query("D10_recall_audit", "SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_or(o_orderpriority = '1-URGENT') AND bool_and(o_orderstatus <> 'P')")
def _(t):
    own = t.orders.groupBy("o_custkey").agg(sem.any_known(F.col("o_orderpriority") == "1-URGENT").alias("says"), sem.all_known(F.col("o_orderstatus") != "P").alias("none"))
    return own.where("says and none").select("o_custkey")


@query("D11_precision_audit", "SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND NOT regexp_matches(p_name, 'ring|bolt')")
def _(t):
    return t.part.where((F.col("p_type") == "PROMO") & ~F.col("p_name").rlike("ring|bolt")).select("p_partkey")


@query("E1_clean_labels", f"SELECT k, array_to_string(list_filter(string_split(cell, ', '), lambda x: x NOT IN ('PROMO', 'SMALL')), '|') AS cell FROM {CELL}")
def _(t):
    return cells(t).select("k", F.array_join(F.filter(F.split("cell", ", "), lambda x: ~x.isin("PROMO", "SMALL")), "|").alias("cell"))


@query("E2_paper_labels", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS labels FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(sem.flatten_unique(F.col("o_orderpriority"), "|").alias("labels"))


@query("E3_singletons", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").count().where("count = 1").select("l_orderkey")


@query("E5_canonical_names", "SELECT p_brand, p_name, arg_min(p_name, length(p_name) * 1000000 + r) OVER (PARTITION BY p_brand) AS canonical FROM (SELECT DISTINCT p_brand, p_name, dense_rank() OVER (ORDER BY p_name) AS r FROM part)")
def _(t):
    from ..operators.resolve import shortest

    own = t.part.select("p_brand", "p_name").distinct()
    return own.join(own.groupBy("p_brand").agg(shortest("p_name").alias("canonical")), "p_brand")


@query("E6_dictionary_coverage", "SELECT p_name, count(*) AS n FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey < 40) GROUP BY 1")
def _(t):
    known = t.part.where("p_partkey < 40").select("p_name")
    return t.part.join(known, "p_name", "left_anti").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))


@query("E7_cocitation", "SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def _(t):
    own = t.lineitem.select("l_orderkey", "l_suppkey")
    n = own.count()
    own = joins.dealt(own, n, "l_orderkey").distinct()
    pairs = own.withColumnRenamed("l_suppkey", "a").join(own.withColumnRenamed("l_suppkey", "b"), "l_orderkey").where("a < b")
    if n > joins.ROWS:
        size = own.groupBy("l_orderkey").count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]
        pairs = joins.dealt(pairs, size or 0, "a", "b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


# Pages are HTML; each is given one of six shapes of article around it.
SHAPED = "CASE page_id % 6 WHEN 0 THEN '<?xml version=\"1.0\"?><article><p/></article>' WHEN 1 THEN '<TEI xmlns=\"u\"/>' WHEN 2 THEN '<collection/>' WHEN 3 THEN '<x><t:sec >a</t:sec></x>' WHEN 4 THEN '<doc><passage/></doc>' ELSE html END"


@query("T1_detect_format", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'jats' WHEN 1 THEN 'tei' WHEN 2 THEN 'bioc' WHEN 3 THEN 'jats' WHEN 4 THEN 'bioc' ELSE CASE WHEN regexp_matches(html, '^\\s*(<[?!][^>]*>\\s*)*<article[\\s>]') THEN 'jats' ELSE 'unknown' END END AS format FROM pages")
def _(t):
    return t.pages.select("page_id", docs.detect_format(F.expr(SHAPED)).alias("format"))


@query("T2_clean_text", f"SELECT doc_id, {text.rules_sql('nfc_normalize(text)', text.CLEAN_RULES, trim=True)} AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", text.clean(F.col("text")).alias("text"))


@query("T4_html_sections")
def _(t):
    return docs.html_sections(t.pages, "page_id", "html")


@query("T6_strip_latex", f"SELECT doc_id, {text.rules_sql('text', text.LATEX_RULES, trim=True)} AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", text.strip_latex(F.col("text")).alias("text"))


@query("T7_chunks")
def _(t):
    return docs.chunks(t.documents, "doc_id", "text")


@query("T8_sentences")
def _(t):
    return t.conversations.select("conv_id", "turn", F.size(text.sentences(F.col("text"))).alias("n"))


@query("T9_repaired_sentences")
def _(t):
    return docs.repaired(t.conversations.withColumn("parts", text.sentences(F.col("text"))), ["conv_id", "turn"], "parts")


CHECKS = ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p, _ in docs.CHECKS)
ISSUES = " + ".join(f"CAST({n} > 0 AS INTEGER)" for n, _, kind in docs.CHECKS if kind == "issue")
WARNINGS = " + ".join(f"CAST({n} > {50 if n == 'double_space' else 0} AS INTEGER)" for n, _, kind in docs.CHECKS if kind == "warning")


@query("T11_text_checks", f"SELECT *, n_issues = 0 AS passes FROM (SELECT *, {ISSUES} AS n_issues, {WARNINGS} AS n_warnings FROM (SELECT doc_id, {CHECKS} FROM documents))")
def _(t):
    return docs.text_checks(t.documents, "doc_id", "text")


@query("T12_heading_filter", "SELECT conv_id, turn FROM conversations WHERE length(text) - length(replace(text, ' ', '')) < 5 AND regexp_matches(text, '^[A-Za-z0-9]') AND length(replace(text, '(', '')) = length(replace(text, ')', '')) AND NOT regexp_matches(text, '[,(]$') AND NOT contains(text, 'http')")
def _(t):
    c = F.col("text")
    balanced = F.regexp_count(c, F.lit(r"\(")) == F.regexp_count(c, F.lit(r"\)"))
    keep = (text.count_literal(c, " ") < 5) & c.rlike("^[A-Za-z0-9]") & balanced & ~c.rlike(r"[,(]$") & ~F.contains(c, F.lit("http"))
    return t.conversations.where(keep).select("conv_id", "turn")


@query("T16_entity_rows", "SELECT doc_id, x AS surface FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS x FROM documents)")
def _(t):
    own = t.documents.select("doc_id", "text", F.explode(text.locate_all(F.col("text"), "[0-9]{4,}")).alias("s"))
    return own.select("doc_id", F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("surface"))


ACCESSIONS = " UNION ALL ".join(f"SELECT conv_id, turn, '{n}' AS family, unnest(regexp_extract_all(said, '{p}')) AS accession FROM s" for n, p in docs.ACCESSIONS)
# The turns have no accessions of their own: each is given some, written from its numbers.
SAID = "text || ' See phs' || lpad(CAST(conv_id AS VARCHAR), 6, '0') || '.v2.p1, EGAS' || turn || ' and xNCT12345678, NCT' || lpad(CAST(conv_id AS VARCHAR), 8, '0') || ', PRJEB' || turn || ' JGAD7'"


@query("T19_accessions", f"WITH s AS (SELECT conv_id, turn, {SAID} AS said FROM conversations) {ACCESSIONS}")
def _(t):
    key = F.col("conv_id").cast("string")
    said = F.concat("text", F.lit(" See phs"), F.lpad(key, 6, "0"), F.lit(".v2.p1, EGAS"), "turn", F.lit(" and xNCT12345678, NCT"), F.lpad(key, 8, "0"), F.lit(", PRJEB"), "turn", F.lit(" JGAD7"))
    return docs.accessions(t.conversations.withColumn("said", said), ["conv_id", "turn"], "said")


@query("T20_mention_stats", "SELECT term, count(*) AS docs, CAST(sum(n) AS BIGINT) AS mentions FROM (SELECT doc_id, term, len(regexp_extract_all(lower(text), pattern)) AS n FROM documents, (VALUES ('licence', 'licen[sc]e'), ('of the', 'of the'), ('token', 'token')) v(term, pattern)) WHERE n > 0 GROUP BY 1")
def _(t):
    terms = [("licence", "licen[sc]e"), ("of the", "of the"), ("token", "token")]
    found = F.array(*[F.struct(F.lit(n).alias("term"), F.regexp_count(F.lower("text"), F.lit(p)).alias("n")) for n, p in terms])
    own = t.documents.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*").where("n > 0")
    return own.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("mentions"))


@query("T21_consume", "SELECT p_partkey, CASE WHEN contains(p_name, 'red ring') THEN 'set' ELSE coalesce(nullif(concat_ws('; ', CASE WHEN contains(p_name, 'red') THEN 'colour' END, CASE WHEN contains(p_name, 'ring') THEN 'thing' END), ''), 'NR') END AS found FROM part")
def _(t):
    return t.part.select("p_partkey", docs.consume(F.col("p_name"), [("red ring", "set"), ("red", "colour"), ("ring", "thing")]).alias("found"))


@query("T25_funnel", "SELECT count(*) AS n_all, count(*) FILTER (length(text) > 100) AS n_long, count(*) FILTER (length(text) > 100 AND lang = 'en') AS n_english FROM documents")
def _(t):
    long = F.length("text") > 100
    return t.documents.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(long).alias("n_long"), F.count_if(long & (F.col("lang") == "en")).alias("n_english"))


BEST = "SELECT b.vec_id AS b, max(round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5)) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.label = 0 AND b.label = 1 GROUP BY 1"


def best_match(t):
    """Best cosine of each vector of one label to those of another."""
    own = joins.best_cosine(t.embeddings.where("label = 0"), t.embeddings.where("label = 1"), "vec_id", "embedding")
    return own.select("b", F.round("sim", 5).alias("sim"))


@query("V2_best_match", BEST)
def _(t):
    return best_match(t)


@query("V3_hard_negatives", f"WITH m AS ({BEST}) SELECT b FROM m WHERE sim >= (SELECT quantile_cont(sim, 0.8) FROM m)")
def _(t):
    own = best_match(t)
    return own.join(F.broadcast(own.agg(sem.quantile(F.col("sim"), 0.8).alias("cut")))).where("sim >= cut").select("b")


@query("V4_nearest", f"SELECT b, sim FROM ({BEST}) ORDER BY sim DESC, b LIMIT 10")
def _(t):
    return windows.top(best_match(t), 10, [F.desc("sim"), "b"], ties=False)


TOKENS = [(1, 0, 0, 3, "O"), (1, 1, 4, 8, "B-X"), (1, 2, 9, 12, "I-X"), (1, 3, 13, 15, "B-X"), (2, 0, 0, 4, "I-Y"), (2, 1, 5, 9, "O"), (2, 2, 10, 12, "I-X")]


@query("V6_bio_align", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0, 'O'), (1, 1, 'B-X'), (1, 2, 'I-X'), (1, 3, 'B-X'), (2, 0, 'B-Y'), (2, 1, 'O'), (2, 2, 'B-X')) v(doc_id, pos, label)")
def _(t):
    tokens = t.spark.createDataFrame([x[:4] for x in TOKENS], "doc_id long, pos int, start int, end int")
    spans = t.spark.createDataFrame([(1, 4, 12, "X"), (1, 13, 15, "X"), (2, 0, 4, "Y"), (2, 10, 12, "X")], "doc_id long, s int, e int, tag string")
    return labels.bio_align(tokens, spans).select("doc_id", "pos", "label")


@query("V7_bio_decode", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'X', 1, 2), (1, 'X', 3, 3), (2, 'Y', 0, 0), (2, 'X', 2, 2)) v(doc_id, tag, first_pos, last_pos)")
def _(t):
    tokens = t.spark.createDataFrame(TOKENS, "doc_id long, pos int, start int, end int, label string")
    return labels.bio_decode(tokens)


@query("V8_label_counts", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def _(t):
    return t.labels.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("V9_set_scores", "SELECT o_custkey, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM (SELECT o_custkey, CAST(count(*) FILTER (a AND b) AS INTEGER) AS tp, CAST(count(*) FILTER (b AND NOT a) AS INTEGER) AS fp, CAST(count(*) FILTER (a AND NOT b) AS INTEGER) AS fn FROM (SELECT o_custkey, o_orderpriority, bool_or(o_orderstatus = 'F') AS a, bool_or(o_totalprice > 200000) AS b FROM orders GROUP BY 1, 2) GROUP BY 1)")
def _(t):
    pick = lambda c: F.collect_set(F.when(c, F.col("o_orderpriority")))
    own = t.orders.groupBy("o_custkey").agg(pick(F.col("o_orderstatus") == "F").alias("truth"), pick(F.col("o_totalprice") > 200000).alias("predicted"))
    return labels.set_scores(own, "truth", "predicted").drop("truth", "predicted")
