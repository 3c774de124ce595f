"""Vector functions on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector is null."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size))


def cosine(a: Column, b: Column) -> Column:
    """Null if one of them is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    powers = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def argmax(a: Column) -> Column:
    """Place of the first largest, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def explained_variance(df: DataFrame, vector: str, k: int) -> DataFrame:
    """component (from 1), share: the part of the variance of centred and scaled components that each of the first k principal components explains."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    own = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    scaled = StandardScaler(withMean=True, withStd=True, inputCol="v", outputCol="s").fit(own).transform(own)
    found = PCA(k=k, inputCol="s", outputCol="p").fit(scaled).explainedVariance.toArray()
    return df.sparkSession.createDataFrame([(i + 1, float(x)) for i, x in enumerate(found)], "component int, share double")
