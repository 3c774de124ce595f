"""Aggregations, windows and samples over the test tables."""

from pyspark.sql import functions as F

from ..functions import semantics as sem
from ..operators import sampling, stats, windows
from .registry import query


@query("A1_count", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("A2_distinct_with_null", "SELECT p_brand, CAST(count(DISTINCT CASE WHEN p_size % 5 > 0 THEN p_type END) + max(CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(stats.mirror_distinct(F.when(F.col("p_size") % 5 > 0, F.col("p_type"))).cast("long").alias("n"))


@query("A3_distinct_pairs", "SELECT p_type, count(*) AS n FROM (SELECT DISTINCT p_type, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1")
def _(t):
    pairs = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("p_type", "l_suppkey").distinct()
    return pairs.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query("A4_conditional_sum", "SELECT l_returnflag, sum(l_quantity) AS qty, CAST(count(*) FILTER (l_linestatus = 'O') AS BIGINT) AS n_open FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("qty"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"))


@query("A5_moments", "SELECT l_linestatus, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS med, min(l_quantity) AS lo, max(l_quantity) AS hi, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS var FROM lineitem GROUP BY 1")
def _(t):
    q = F.col("l_quantity")
    return t.lineitem.groupBy("l_linestatus").agg(F.round(F.avg(q), 6).alias("mean"), sem.median(q).alias("med"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.round(F.stddev_samp(q), 6).alias("sd"), F.round(F.var_samp(q), 6).alias("var"))


@query("A6_quantile", "SELECT p_type, quantile_cont(p_retailprice, 0.1) AS p10, quantile_cont(p_retailprice, 0.98) AS p98 FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_type").agg(sem.quantile(F.col("p_retailprice"), 0.1).alias("p10"), sem.quantile(F.col("p_retailprice"), 0.98).alias("p98"))


@query("A7_six_numbers", "SELECT p_brand, min(v) AS min, quantile_cont(v, 0.25) AS q1, median(v) AS median, round(avg(v), 6) AS mean, quantile_cont(v, 0.75) AS q3, max(v) AS max, CAST(count(*) - count(v) AS BIGINT) AS n_null FROM (SELECT p_brand, CAST(CASE WHEN p_size % 9 > 0 THEN p_size END AS DOUBLE) AS v FROM part) GROUP BY 1")
def _(t):
    own = t.part.select("p_brand", F.when(F.col("p_size") % 9 > 0, F.col("p_size")).alias("v"))
    return stats.six_numbers(own, "v", ["p_brand"]).withColumn("mean", F.round("mean", 6))


@query("A8_share", "SELECT o_orderpriority, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM orders GROUP BY 1")
def _(t):
    return stats.share(t.orders, ["o_orderpriority"]).withColumn("pct", F.round("pct", 6))


@query("A9_any_all", "SELECT o_custkey, bool_or(o_totalprice > 300000) AS any_large, bool_and(o_orderstatus = 'F') AS all_done FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(sem.any_known(F.col("o_totalprice") > 300000).alias("any_large"), sem.all_known(F.col("o_orderstatus") == "F").alias("all_done"))


@query("A10_flatten_unique", "SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(sem.flatten_unique(F.col("p_type")).alias("types"))


@query("A11_set_per_key", "SELECT n_regionkey, CAST(count(DISTINCT n_name) AS INTEGER) AS n, min(n_name) AS first_name FROM nation GROUP BY 1")
def _(t):
    s = F.array_sort(F.collect_set("n_name"))
    return t.nation.groupBy("n_regionkey").agg(s.alias("s")).select("n_regionkey", F.size("s").alias("n"), F.element_at("s", 1).alias("first_name"))


@query("A12_frequency", "SELECT p_name AS term, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, term")
def _(t):
    return t.part.groupBy(F.col("p_name").alias("term")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term")


@query("A13_one_minus_product", "SELECT l_orderkey, round(1 - product(1 - l_discount), 6) AS combined FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(1 - F.product(1 - F.col("l_discount")), 6).alias("combined"))


@query("A14_two_levels", "SELECT yr, CAST(count(*) AS BIGINT) AS customers, max(n) AS most FROM (SELECT year(o_orderdate) AS yr, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1".replace("SELECT yr", "SELECT CAST(yr AS INTEGER) AS yr"))
def _(t):
    one = t.orders.groupBy(F.year("o_orderdate").alias("yr"), "o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("yr").agg(F.count(F.lit(1)).alias("customers"), F.max("n").alias("most"))


SPEARMAN = "SELECT g, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM ({})) GROUP BY 1"


@query("A15_spearman", SPEARMAN.format("SELECT p_type AS g, p_size AS x, p_retailprice AS y FROM part WHERE p_size % 4 > 0"))
def _(t):
    own = t.part.select(F.col("p_type").alias("g"), F.when(F.col("p_size") % 4 > 0, F.col("p_size")).alias("x"), F.col("p_retailprice").alias("y"))
    return stats.spearman(own, "x", "y", ["g"]).withColumn("rho", F.round("rho", 6))


@query("A16_argmin", "SELECT p_brand, arg_min(p_name, length(trim(p_name)) * 1000000 + r) AS shortest FROM (SELECT *, dense_rank() OVER (ORDER BY p_name) AS r FROM part) GROUP BY 1")
def _(t):
    from ..operators.resolve import shortest

    return t.part.groupBy("p_brand").agg(shortest("p_name").alias("shortest"))


@query("A17_set_combinations", "SELECT combo, degree, count(*) AS n FROM (SELECT l_orderkey, string_agg(DISTINCT p_type, '&' ORDER BY p_type) AS combo, count(DISTINCT p_type) AS degree FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) GROUP BY 1, 2")
def _(t):
    own = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_type")
    return stats.set_combinations(own, "l_orderkey", "p_type")


@query("A18_set_coverage", "SELECT count(a.k) AS n_a, count(b.k) AS n_b, count(*) AS n_union, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS n_both, round(100.0 * count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) / count(a.k), 6) AS pct_a FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') b ON a.k = b.k")
def _(t):
    a, b = t.orders.where("o_totalprice > 200000"), t.orders.where("o_orderstatus = 'P'")
    return stats.set_coverage(a, b, "o_custkey").withColumn("pct_a", F.round("pct_a", 6))


@query("A19_duplicates_under", "SELECT norm, string_agg(DISTINCT v, '|' ORDER BY v) AS members, count(DISTINCT v) AS n FROM (SELECT lower(v) AS norm, v FROM (SELECT p_name AS v FROM part UNION ALL SELECT upper(p_name) FROM part WHERE p_size < 20)) GROUP BY 1 HAVING count(DISTINCT v) > 1")
def _(t):
    own = t.part.select(F.col("p_name").alias("v")).unionAll(t.part.where("p_size < 20").select(F.upper("p_name").alias("v")))
    return stats.duplicates_under(own, "v", F.lower("v"))


@query("A20_group_modify", "SELECT o_custkey, CAST(max(o_totalprice) AS DOUBLE) AS top, arg_max(o_orderkey, o_totalprice) AS top_order FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"), stats.arg_max("o_orderkey", "o_totalprice").alias("top_order"))


@query("A21_order_of_magnitude", "SELECT c_mktsegment, CAST(max(floor(log10(abs(c_acctbal)))) AS BIGINT) AS magnitude FROM customer WHERE c_acctbal <> 0 GROUP BY 1")
def _(t):
    return t.customer.where("c_acctbal <> 0").groupBy("c_mktsegment").agg(stats.order_of_magnitude(F.col("c_acctbal")).cast("long").alias("magnitude"))


@query("A22_histogram", "SELECT CASE WHEN l_quantity < 0 THEN 0 WHEN l_quantity >= 50 THEN 11 ELSE CAST(floor(l_quantity / 5) AS BIGINT) + 1 END AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return stats.histogram(t.lineitem, "l_quantity", 0.0, 50.0, 10)


@query("A23_crosstab", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).fillna(0)


@query("W1_running_total", "SELECT CAST(d AS VARCHAR) AS d, CAST(sum(q) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total FROM (SELECT CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1)")
def _(t):
    return windows.running_total(t.lineitem.withColumn("d", F.to_date("l_shipdate")), [], "d", "l_quantity").withColumn("d", F.col("d").cast("string"))


@query("W2_grouped_running_total", "SELECT l_returnflag, CAST(d AS VARCHAR) AS d, sum(q) OVER (PARTITION BY l_returnflag ORDER BY d ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)")
def _(t):
    return windows.running_total(t.lineitem.withColumn("d", F.to_date("l_shipdate")), ["l_returnflag"], "d", "l_quantity").withColumn("d", F.col("d").cast("string"))


RUN = "WITH r AS (SELECT g, d, sum(q) OVER (PARTITION BY g ORDER BY d ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT p_type AS g, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)) "


def _run(t):
    own = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("g"), F.to_date("l_shipdate").alias("d"), "l_quantity")
    return windows.running_total(own, ["g"], "d", "l_quantity")


@query("W3_final_totals", RUN + "SELECT g, CAST(d AS VARCHAR) AS d, total FROM (SELECT * FROM r UNION ALL SELECT g, (SELECT max(d) FROM r), max(total) FROM r GROUP BY g HAVING max(d) < (SELECT max(d) FROM r))")
def _(t):
    return windows.add_final_totals(_run(t), ["g"], "d").withColumn("d", F.col("d").cast("string"))


@query("W4_final_totals_reversed", RUN + "SELECT g, CAST(d AS VARCHAR) AS d, total FROM (SELECT * FROM r UNION ALL SELECT g, (SELECT min(d) FROM r), max(total) FROM r GROUP BY g UNION ALL SELECT g, (SELECT max(d) FROM r), 0 FROM r GROUP BY g)")
def _(t):
    return windows.add_final_totals_reversed(_run(t), ["g"], "d").withColumn("d", F.col("d").cast("string"))


@query("W5_row_number", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS idx FROM orders")
def _(t):
    from pyspark.sql import Window

    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("idx"))


@query("W6_fill_up", "SELECT o_custkey, o_orderkey, first_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS v FROM orders)")
def _(t):
    own = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("v"))
    return windows.fill_up(own, ["o_custkey"], "o_orderkey", "v")


@query("W7_top_with_ties", "SELECT p_brand, p_partkey, p_size FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) <= 3")
def _(t):
    return windows.top(t.part.select("p_brand", "p_partkey", "p_size"), 3, [F.desc("p_size")], ["p_brand"])


@query("W7_top_without_ties", "SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= 3")
def _(t):
    return windows.top(t.part.select("p_brand", "p_partkey", "p_size"), 3, [F.desc("p_size"), "p_partkey"], ["p_brand"], ties=False)


@query("W8_arrange", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def _(t):
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy(F.desc_nulls_last("s_acctbal"), "s_suppkey")


@query("W9_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t):
    return windows.top(t.orders.select("o_orderkey", "o_totalprice"), 20, [F.desc("o_totalprice"), "o_orderkey"], ties=False)


@query("W10_longest_first", "SELECT term, CAST(row_number() OVER (ORDER BY length(term) DESC, term) AS INTEGER) AS place FROM (SELECT DISTINCT p_name AS term FROM part)")
def _(t):
    from pyspark.sql import Window

    terms = t.part.select(F.col("p_name").alias("term")).distinct()
    return terms.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.length("term").desc(), "term")))


@query("W11_factor_order", "SELECT o_orderpriority, ord, count(*) AS n FROM orders JOIN (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 4), ('5-LOW', 5)) v(p, ord) ON o_orderpriority = p GROUP BY 1, 2")
def _(t):
    order = t.spark.createDataFrame([("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3), ("4-NOT SPECIFIED", 4), ("5-LOW", 5)], "o_orderpriority string, ord int")
    return t.orders.join(F.broadcast(order), "o_orderpriority").groupBy("o_orderpriority", "ord").agg(F.count(F.lit(1)).alias("n"))


def hashed(key, seed=0):
    return f"((({key} % 1000003) * 2654435761 + {seed} * 40503) % 4294967296)"


@query("W12_sample_n", f"SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY {hashed('c_custkey', 7)}, c_custkey) <= 5")
def _(t):
    return sampling.sample_n(t.customer.select("c_mktsegment", "c_custkey"), 5, "c_custkey", ["c_mktsegment"], 7)


@query("W13_sample_share", f"SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {hashed('c_custkey', 3)}, c_custkey) AS p, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE p <= floor(0.25 * n)")
def _(t):
    return sampling.sample_share(t.customer.select("c_nationkey", "c_custkey"), 0.25, "c_custkey", ["c_nationkey"], 3)


@query("W14_trim_to_n", f"SELECT c_custkey, c_acctbal > 9000 AS sel FROM customer ORDER BY CASE WHEN c_acctbal > 9000 THEN 0 ELSE 1 END, {hashed('c_custkey', 1)}, c_custkey LIMIT 300")
def _(t):
    return sampling.trim_to_n(t.customer.select("c_custkey", (F.col("c_acctbal") > 9000).alias("sel")), "sel", 300, "c_custkey", 1)


@query("W15_monte_carlo", "SELECT seed, round(1 - CAST(count(DISTINCT CASE WHEN p <= 200 THEN p_name END) AS DOUBLE) / count(DISTINCT p_name), 6) AS unseen FROM (SELECT seed, p_name, row_number() OVER (PARTITION BY seed ORDER BY ((p_partkey % 1000003) * 2654435761 + seed * 40503) % 4294967296, p_partkey) AS p FROM part, (SELECT unnest(range(20)) AS seed)) GROUP BY 1")
def _(t):
    return sampling.unseen_share(t.part, "p_name", "p_partkey", 200, 20).withColumn("unseen", F.round("unseen", 6))


@query("W16_group_folds", f"SELECT fold, CAST(count(DISTINCT c_nationkey) AS BIGINT) AS n_groups, count(*) AS n FROM customer JOIN (SELECT c_nationkey, CAST((row_number() OVER (PARTITION BY rate ORDER BY {hashed('c_nationkey', 2)}, c_nationkey) - 1) % 5 AS INTEGER) AS fold FROM (SELECT c_nationkey, round(avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END) * 4) AS rate FROM customer GROUP BY 1)) USING (c_nationkey) GROUP BY 1")
def _(t):
    folds = sampling.group_folds(t.customer.withColumn("y", (F.col("c_mktsegment") == "BUILDING").cast("int")), "c_nationkey", "y", 5, 2)
    return folds.groupBy("fold").agg(F.countDistinct("c_nationkey").alias("n_groups"), F.count(F.lit(1)).alias("n"))


@query("W17_one_per_key", f"SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {hashed('o_orderkey', 5)}, o_orderkey) = 1")
def _(t):
    return sampling.sample_n(t.orders.select("o_custkey", "o_orderkey"), 1, "o_orderkey", ["o_custkey"], 5)
