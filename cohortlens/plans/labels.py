"""Span labels, decoding and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import softmax


def bio_align(tokens: DataFrame, spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """tokens (doc, pos, start, end) and spans (doc, s, e, tag) -> label: B- at a span's first token, I- in it, else O."""
    hit = (tokens[doc] == spans[doc]) & (tokens["start"] < spans["e"]) & (tokens["end"] > spans["s"])
    both = tokens.join(spans, hit, "left").select(tokens[doc], "pos", "start", "end", "s", "tag")
    first = Window.partitionBy(doc, "s", "tag").orderBy("pos")
    own = both.withColumn("label", F.when(F.col("tag").isNull(), "O").otherwise(F.concat(F.when(F.row_number().over(first) == 1, "B-").otherwise("I-"), "tag")))
    return own.groupBy(doc, "pos", "start", "end").agg(F.min_by("label", F.coalesce("s", F.lit(0))).alias("label"))


def bio_decode(tokens: DataFrame, doc: str = "doc_id", label: str = "label") -> DataFrame:
    """doc, tag, first_pos, last_pos of each span; an I- without its B- begins a span."""
    own = Window.partitionBy(doc).orderBy("pos")
    tag, before = F.substring(F.col(label), F.lit(3), F.length(label)), F.lag(label, 1, "O").over(own)
    starts = F.startswith(label, F.lit("B-")) | (F.startswith(label, F.lit("I-")) & (F.substring(before, F.lit(3), F.length(before)) != tag) | F.startswith(label, F.lit("I-")) & (before == "O"))
    marked = tokens.withColumn("tag", tag).withColumn("_s", F.when(starts, 1).otherwise(0))
    marked = marked.withColumn("_span", F.sum("_s").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where(F.col(label) != "O").groupBy(doc, "tag", "_span").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")).drop("_span")


def set_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """tp, fp, fn, precision and recall of two array columns; a rate without a base is null."""
    tp = F.size(F.array_intersect(truth, predicted))
    fp, fn = F.size(F.array_except(predicted, truth)), F.size(F.array_except(truth, predicted))
    out = df.withColumns({"tp": tp, "fp": fp, "fn": fn})
    return out.withColumns({"precision": F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))), "recall": F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))})


def confidence(tokens: DataFrame, doc: str, gold: str, logits: str) -> DataFrame:
    """doc, confidence: the mean of the largest softmax over tokens of gold entities; 1 where a document has none."""
    top = F.array_max(softmax(F.col(logits)))
    return tokens.groupBy(doc).agg(F.coalesce(F.avg(F.when(F.col(gold), top)), F.lit(1.0)).alias("confidence"))
