"""Language identification in two levels (operator 7): the language family first, then one-versus-one linear
support vector machines between the languages of the family.

Features are hashed byte n-grams (1 to 4) of the lower-cased whole text, square roots of their counts, of
unit length. Training reads a bounded sample: at most ``per_language`` labelled texts of each language,
chosen by a hash of their ids (the documented bound of the model; prediction covers every row). A few
words cut from each training text join it, so that short texts are known too.

A text that is null or has no letter is ``und`` with score 0. Ties between languages go to the first by
name. With one learned language all other texts are that language; with none, all are ``und``. Repeated
rows get a prediction each. Columns named as an output are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import lean, read_table

UNDETERMINED = "und"
BUCKETS = 4096
SALTS = 64

# Which languages are close relatives, by ISO 639-1 code. Any other is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def features(text: str) -> np.ndarray:
    """Counts of hashed byte n-grams; the whole text counts."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.float32)
    gram = np.zeros(len(raw), np.uint32)
    for n in range(1, 5):
        if len(raw) < n:
            break
        gram = gram[: len(raw) - n + 1] * np.uint32(2654435761) + raw[n - 1 :] + np.uint32(n)
        mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(2246822519)
        counts += np.bincount(mixed >> np.uint32(20), minlength=BUCKETS)
    counts = np.sqrt(counts)
    return counts / max(1e-9, float(np.sqrt(counts @ counts)))


def _snippet(text: str, key: int, words: int = 6) -> str:
    own = text.split()
    at = (key * 2654435761) % max(1, len(own) - words + 1)
    return " ".join(own[at : at + words])


def linear_svm(x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, cost: float = 2.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """L2-loss linear SVM by dual coordinate descent; the last weight is the bias. y: -1 or 1. rows: of x, those that y is about; they are not copied."""
    rng = np.random.default_rng(seed)
    rows = np.arange(len(y)) if rows is None else rows
    w = np.zeros(x.shape[1] + 1)
    alpha = np.zeros(len(y))
    diagonal = np.array([(x[k] * x[k]).sum() for k in rows], x.dtype) + 1.0 + 0.5 / cost
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            own = x[rows[i]]
            gradient = y[i] * (own @ w[:-1] + w[-1]) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            step = (new - alpha[i]) * y[i]
            if step:
                w[:-1] += step * own
                w[-1] += step
                alpha[i] = new
    return w


class Model:
    """Families, their languages, and the machines that separate them."""

    def __init__(self, families: dict[str, list[str]], weights: np.ndarray, pairs: dict[tuple[str, str], int]):
        self.families, self.weights, self.pairs = families, weights, pairs

    def _vote(self, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        """The name that wins most comparisons, the surer on ties, and how sure its weakest win or loss is."""
        if len(names) == 1:
            return names[0], 1.0
        total = {n: [0, 0.0, 1.0] for n in names}
        for a, b in combinations(names, 2):
            sure = 1 / (1 + np.exp(-4 * float(margins[self.pairs[a, b]])))
            for n, p in ((a, sure), (b, 1 - sure)):
                total[n][0] += p >= 0.5
                total[n][1] += p
                total[n][2] = min(total[n][2], p)
        best = max(names, key=lambda n: (total[n][0], total[n][1]))
        return best, total[best][2]

    def predict(self, text: str) -> tuple[str, str, float]:
        """Family, language, score."""
        f = features(text)
        margins = self.weights[:, :-1] @ f + self.weights[:, -1]
        family, sure = self._vote(sorted(self.families), margins)
        language, surer = self._vote(self.families[family], margins)
        return family, language, sure * surer


def train(samples: list[tuple[int, str, str]]) -> Model | None:
    """samples: (key, language, text)."""
    languages = sorted({lang for _, lang, _ in samples})
    if not languages:
        return None
    families: dict[str, list[str]] = {}
    for lang in languages:
        families.setdefault(FAMILY_OF.get(lang.lower(), lang), []).append(lang)
    texts, labels = [], []
    for key, lang, text in samples:
        texts += [text, _snippet(text, key), _snippet(text, key + 1, 3)]
        labels += [lang] * 3
    x = np.zeros((len(texts), BUCKETS), np.float32)  # the driver's largest table
    for k, t in enumerate(texts):
        x[k] = features(t)
    own = np.array(labels)
    groups = {f: np.isin(own, members) for f, members in families.items()}
    problems = [(a, b, groups[a], groups[b]) for a, b in combinations(sorted(families), 2)]
    for members in families.values():
        problems += [(a, b, own == a, own == b) for a, b in combinations(members, 2)]
    pairs: dict[tuple[str, str], int] = {}
    weights = np.zeros((len(problems), BUCKETS + 1), np.float32)
    for k, (a, b, first, second) in enumerate(problems):
        rows = np.flatnonzero(first | second)
        weights[k] = linear_svm(x, np.where(first[rows], 1.0, -1.0), rows)
        pairs[a, b] = k
    return Model(families, weights, pairs)


def fit(docs: DataFrame, per_language: int = 500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    """Learn from labelled rows that aren't held out; at most ``per_language`` of each language."""
    text = F.col(text_col).cast("string")
    known = docs.where(F.col(label_col).isNotNull() & text.rlike(r"\p{L}") & ~F.coalesce(held_out(F.col(id_col)), F.lit(False)))
    known = known.select(F.xxhash64(id_col).alias("key"), F.col(label_col).cast("string").alias("lang"), F.xxhash64(text).alias("body"), text.alias("text"))
    # The rows are chosen by numbers alone, in two steps, so that no task holds a language; then their texts are read.
    order = ["key", "body"]
    names = known.select("lang", *order).distinct().withColumn("salt", F.pmod(F.xxhash64("key", "body"), F.lit(SALTS)))
    some = names.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= per_language)
    chosen = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= per_language)
    # At most per_language rows of each language.
    rows = known.join(F.broadcast(chosen.select("lang", *order)), ["lang", *order]).groupBy("lang", *order).agg(F.first("text").alias("text")).collect()
    return train(sorted((r["key"], r["lang"], r["text"]) for r in rows))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_family, lang_pred and score (those names are replaced)."""
    own = docs.drop("lang_family", "lang_pred", "score")
    held = own.sparkSession.sparkContext.broadcast(model)
    at = own.columns.index(text_col)
    letters = f"letters_{uuid.uuid4().hex}"  # no column of the table has that name
    has_letter = own.select("*", F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)).alias(letters))
    extra = [StructField("lang_family", StringType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    schema = StructType([*own.schema.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            letters = batch.column(batch.num_columns - 1).to_pylist()
            out = [known.predict(t.as_py()) if ok and known else (None, UNDETERMINED, 0.0) for t, ok in zip(batch.column(at), letters)]
            columns = [*batch.columns[:-1], pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return has_letter.mapInArrow(lean(run), schema)


def op7_language_id(spark, sf_dir):
    """Contract query: a prediction for every document, learned from those that aren't held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs)
    out = identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "lang_family")
