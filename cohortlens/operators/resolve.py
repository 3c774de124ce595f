"""Entity resolution: rows that share a normalised value in any field are one entity."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's ``spark.checkpoint.dir``; a local session without one gets a local folder. It goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    own = f"{root.rstrip('/')}/resolve-{uuid.uuid4().hex[:12]}"

    def remove() -> None:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(own)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has gone; the folder's owner cleans it
            return

    atexit.register(remove)
    return own


def scratch(df: DataFrame):
    """A ``keep`` for iterative operators: Parquet in a scratch folder."""
    spark = df.sparkSession
    own = scratch_folder(spark)

    def keep(table: DataFrame, name: str) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{own}/{name}")
        return spark.read.schema(table.schema).parquet(f"{own}/{name}")

    return keep


def normalise(c: Column) -> Column:
    """Lower case, white space squeezed; blanks are null."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit(""))


def entity_groups(df: DataFrame, row_id: str, fields: Sequence[str]) -> DataFrame:
    """``df`` with group_id: the smallest row_id among rows connected by shared values, across fields too.

    Each value's rows link to its smallest row, never to each other, so a common value makes no pairs.
    """
    values = df.select(F.col(row_id).alias("r"), F.explode(F.array(*[normalise(F.col(f)) for f in fields])).alias("v")).where("v is not null").distinct()
    least = values.groupBy("v").agg(F.min("r").alias("m"))
    edges = values.join(least, "v").select(F.col("r").alias("src"), F.col("m").alias("dst"))
    found = connected_components(edges, scratch(df)).select(F.col("node").alias(row_id), F.col("component").alias("_c"))
    return df.join(found, row_id, "left").withColumn("group_id", F.coalesce("_c", F.col(row_id))).drop("_c")


def shortest(c: str) -> Column:
    """Aggregate: the shortest value, the first in binary order among equals."""
    return F.min_by(F.col(c), F.struct(F.length(F.trim(c)), F.col(c)))
