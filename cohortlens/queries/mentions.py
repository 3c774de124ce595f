"""Mentions in texts, method sections, code normalisation, and what is derived from vectors."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import joins, stats
from ..plans import documents as docs, labels, representation as rep
from .registry import query

HAY = "SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array({}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' ' AS hay FROM documents"
NAMES, SHORT = ["of the", "all rights reserved", "Licensed under"], ["LLC", "API", "MIT", "THE"]
values = lambda terms: ", ".join(f"('{x}')" for x in terms)


@query("T3_method_sections", f"WITH s AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, CASE o_orderpriority WHEN '1-URGENT' THEN 'Materials and Methods' WHEN '5-LOW' THEN 'Results' WHEN '3-MEDIUM' THEN 'Discussion' ELSE o_orderpriority END AS title, CASE WHEN o_totalprice > 300000 THEN 'Participants were recruited' ELSE 'Other' END AS text FROM orders), m AS (SELECT *, max(CASE WHEN title = 'Materials and Methods' THEN pos END) OVER w AS started, max(CASE WHEN title IN ('Results', 'Discussion') THEN pos END) OVER w AS stopped, bool_or(title = 'Materials and Methods') OVER (PARTITION BY doc) AS any_start FROM s WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING)), k AS (SELECT *, bool_or(NOT any_start AND title NOT IN ('Results', 'Discussion') AND text LIKE 'Part%') OVER (PARTITION BY doc) AS any_key FROM m) SELECT doc, pos, CASE WHEN any_start THEN 1 WHEN any_key THEN 2 ELSE 3 END AS priority FROM k WHERE (any_start AND started IS NOT NULL AND (stopped IS NULL OR started > stopped)) OR (NOT any_start AND any_key AND title NOT IN ('Results', 'Discussion') AND text LIKE 'Part%') OR (NOT any_start AND NOT any_key AND title NOT IN ('Results', 'Discussion'))")
def _(t):
    title = F.when(F.col("o_orderpriority") == "1-URGENT", "Materials and Methods").when(F.col("o_orderpriority") == "5-LOW", "Results").when(F.col("o_orderpriority") == "3-MEDIUM", "Discussion").otherwise(F.col("o_orderpriority"))
    own = t.orders.select(F.col("o_custkey").alias("doc"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("pos"), title.alias("title"), F.when(F.col("o_totalprice") > 300000, "Participants were recruited").otherwise("Other").alias("text"))
    return docs.method_sections(own, "doc").select("doc", "pos", "priority")


SPLIT = "SELECT conv_id, turn, unnest(parts) AS s, unnest(range(len(parts))) AS pos FROM (SELECT conv_id, turn, {} AS parts FROM conversations WHERE text IS NOT NULL)"
SIDED = "SELECT conv_id, turn, pos, s, lag(s) OVER w AS before, lead(s) OVER w AS after FROM ({}) WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)"


@query("T10_splitter_diff", " UNION ALL ".join(f"SELECT '{side}' AS side, conv_id, turn, CAST(pos AS INTEGER) AS pos, s AS sentence, before, after FROM ({SIDED.format(SPLIT.format(one))}) x WHERE NOT EXISTS (SELECT 1 FROM ({SPLIT.format(other)}) y WHERE x.conv_id = y.conv_id AND x.turn = y.turn AND x.s = y.s)" for side, one, other in (("a", "string_split(text, '. ')", "regexp_split_to_array(text, '[.,?!] ')"), ("b", "regexp_split_to_array(text, '[.,?!] ')", "string_split(text, '. ')"))))
def _(t):
    keys = ["conv_id", "turn"]
    rows = lambda pattern: t.conversations.select(*keys, F.posexplode(F.split("text", pattern, -1)).alias("pos", "sentence"))
    return docs.splitter_diff(rows(r"\. "), rows("[.,?!] "), keys)


@query("T13_dictionary_match", f"SELECT doc_id, string_agg(DISTINCT term, '|' ORDER BY term) AS terms FROM (SELECT doc_id, term FROM ({HAY.format('lower(text)')}), (VALUES {values(NAMES)}) v(term) WHERE contains(hay, ' ' || lower(term) || ' ') UNION ALL SELECT doc_id, term FROM ({HAY.format('text')}), (VALUES {values(SHORT)}) v(term) WHERE contains(hay, ' ' || term || ' ')) GROUP BY 1")
def _(t):
    table = lambda terms: t.spark.createDataFrame([(x,) for x in terms], "term string")
    return docs.dictionary_match(t.documents, table(NAMES), table(SHORT), "doc_id", "text")


@query("T14_mask_then_match", "SELECT doc_id, len(regexp_extract_all(masked, '␟')) AS masked, len(regexp_extract_all(masked, 'the')) AS context FROM (SELECT doc_id, regexp_replace(text, '(?i)(of the thing|of the|the)', '␟', 'g') AS masked FROM documents)")
def _(t):
    own = t.documents.select("doc_id", docs.mask(F.col("text"), ["the", "of the", "of the thing"]).alias("m"))
    return own.select("doc_id", F.regexp_count("m", F.lit(docs.MASK)).cast("long").alias("masked"), F.regexp_count("m", F.lit("the")).cast("long").alias("context"))


SPANS = "SELECT doc_id, CAST(list_sum(list_transform(parts[:i], lambda x: length(x))) + 3 * (i - 1) AS INTEGER) AS s FROM (SELECT doc_id, parts, unnest(range(1, len(parts))) AS i FROM (SELECT doc_id, string_split(text, 'the') AS parts FROM documents))"


def spans(t):
    return t.documents.select("doc_id", F.explode(text.locate_all(F.col("text"), "the")).alias("x")).select("doc_id", F.col("x.start").alias("start"), F.col("x.end").alias("end"))


@query("T15_span_annotations", f"SELECT doc_id, s AS start, s + 3 AS \"end\", 'THE' AS tag FROM ({SPANS})")
def _(t):
    return spans(t).withColumn("tag", F.lit("THE"))


COUNTED = "text || ' We saw 1,234 patients, 9 women and n = ' || (turn * 7) || '.'"


@query("T17_numeric_mentions", f"SELECT conv_id, turn, surface, CAST(replace(regexp_extract(surface, '[0-9][0-9,]*'), ',', '') AS BIGINT) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all({COUNTED}, '\\b(?:n_total|Neffective|Ncontrol|Ncase|ncase|Neff|N|n)\\s*=\\s*[0-9][0-9,]*|\\b[0-9][0-9,]*\\s+(?:participants|individuals|adolescents|neonates|patients|children|subjects|controls|families|siblings|infants|proband|samples|adults|female|donors|cases|women|trios|twins|pairs|male|men)\\b')) AS surface FROM conversations WHERE text IS NOT NULL) WHERE CAST(replace(regexp_extract(surface, '[0-9][0-9,]*'), ',', '') AS BIGINT) > 10")
def _(t):
    own = t.conversations.withColumn("said", F.concat("text", F.lit(" We saw 1,234 patients, 9 women and n = "), (F.col("turn") * 7).cast("string"), F.lit(".")))
    return docs.numeric_mentions(own, ["conv_id", "turn"], "said").select("conv_id", "turn", "surface", "n")


@query("T18_annotated_documents", f"SELECT doc_id, string_agg(s || '-' || (s + 3), ';' ORDER BY s) AS label FROM ({SPANS}) GROUP BY 1")
def _(t):
    own = docs.regroup(spans(t).withColumn("tag", F.lit("THE")), "doc_id")
    return own.select("doc_id", F.array_join(F.transform("label", lambda x: F.concat_ws("-", x["start"], x["end"])), ";").alias("label"))


GROUPED = "SELECT l_orderkey AS k, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'basic' ELSE 'other' END AS derived, CASE WHEN l_returnflag = 'N' THEN 'other' ELSE 'basic' END AS declared, CAST(l_quantity AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey"


@query("T22_descriptor_match", f"SELECT k, sum(n) FILTER (derived = declared)::BIGINT AS matched, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (derived = declared) = sum(n), false) AS agrees FROM ({GROUPED}) GROUP BY 1")
def _(t):
    own = t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    own = own.select(F.col("l_orderkey").alias("k"), F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "basic").otherwise("other").alias("derived"), F.when(F.col("l_returnflag") == "N", "other").otherwise("basic").alias("declared"), F.col("l_quantity").cast("long").alias("n"))
    return rep.descriptor_match(own, "k", "derived", "declared", "n")


@query("T23_meta_analysis_flag", "SELECT conv_id, turn, regexp_matches(text, '(?i)of the|and the|meta-?analys[ie]s') AS flagged FROM conversations")
def _(t):
    said = F.exists(text.sentences(F.col("text")), lambda x: x.rlike("(?i)of the|and the|meta-?analys[ie]s"))
    return t.conversations.select("conv_id", "turn", said.alias("flagged"))


RAW = "CASE p_size % 4 WHEN 0 THEN 'K70-K72, E11' WHEN 1 THEN 'N18.3-N18.5' WHEN 2 THEN 'D05-D05' ELSE 'X99' END"
EACH = "CASE p_size % 4 WHEN 0 THEN ['K70', 'K71', 'K72', 'E11'] WHEN 1 THEN ['N18.3', 'N18.4', 'N18.5'] WHEN 2 THEN ['D05'] ELSE ['X99'] END"
REWRITES = [("K71", "K71.9"), ("X99", "X98")]
DESCRIBED = [("K71.9", "toxic liver disease"), ("E11", "diabetes"), ("N18.3", "kidney disease")]


@query("D8_normalise_codes", f"SELECT p_partkey, code, description FROM (SELECT p_partkey, CASE c WHEN 'K71' THEN 'K71.9' WHEN 'X99' THEN 'X98' ELSE c END AS code FROM (SELECT p_partkey, unnest({EACH}) AS c FROM part)) LEFT JOIN (VALUES ('K71.9', 'toxic liver disease'), ('E11', 'diabetes'), ('N18.3', 'kidney disease')) v(code, description) USING (code)")
def _(t):
    own = t.part.select("p_partkey", F.expr(RAW).alias("code"))
    return rep.normalise_codes(own, "code", t.spark.createDataFrame(REWRITES, "old string, new string"), t.spark.createDataFrame(DESCRIBED, "code string, description string"))


@query("D12_condition_subset", "SELECT combo, degree, count(*) AS n FROM (SELECT o_custkey, string_agg(DISTINCT family, '&' ORDER BY family) AS combo, count(DISTINCT family) AS degree FROM (SELECT o_custkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'basic' WHEN p_type = 'PROMO' THEN 'offer' WHEN p_type = 'LARGE' THEN 'large' END AS family FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) WHERE family IS NOT NULL GROUP BY 1) GROUP BY 1, 2")
def _(t):
    family = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "basic").when(F.col("p_type") == "PROMO", "offer").when(F.col("p_type") == "LARGE", "large")
    own = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return stats.set_combinations(own.select("o_custkey", family.alias("family")).where("family is not null"), "o_custkey", "family")


LABELS = "SELECT p_name || ' ' || p_brand AS v, count(*) AS n FROM part GROUP BY 1"


@query("E4_near_duplicates", f"SELECT a.v AS \"left\", b.v AS \"right\", CAST(levenshtein(a.v, b.v) AS INTEGER) AS d FROM ({LABELS}) a JOIN ({LABELS}) b ON a.n = 1 AND a.v <> b.v AND levenshtein(a.v, b.v) <= 2")
def _(t):
    own = t.part.groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return joins.near_pairs(own.where("n = 1"), own, "v", 2)


@query("V5_pca")
def _(t):
    return vectors.explained_variance(t.embeddings, "embedding", 10)


SOFT = "list_transform(l, lambda x: exp(x - list_max(l)))"


@query("V10_confidence", f"SELECT doc, round(coalesce(avg(CASE WHEN label = 1 THEN 1.0 / list_sum({SOFT}) END), 1.0), 6) AS confidence FROM (SELECT vec_id // 10 AS doc, label, CAST(embedding[1:5] AS DOUBLE[]) AS l FROM embeddings) GROUP BY 1")
def _(t):
    own = t.embeddings.select(F.floor(F.col("vec_id") / 10).alias("doc"), (F.col("label") == 1).alias("gold"), F.slice("embedding", 1, 5).cast("array<double>").alias("logits"))
    return labels.confidence(own, "doc", "gold", "logits").select("doc", F.round("confidence", 6).alias("confidence"))


@query("V11_same_text_negatives", f"SELECT DISTINCT doc_id FROM ({HAY.format('lower(text)')}) JOIN labels USING (doc_id), (VALUES {values(NAMES)}) v(term) WHERE quality = 0 AND contains(hay, ' ' || lower(term) || ' ')")
def _(t):
    negatives = t.documents.join(t.labels.where("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    terms = t.spark.createDataFrame([(x,) for x in NAMES], "term string")
    return joins.contains_terms(negatives, terms, "doc_id", "text").select("doc_id").distinct()
