"""What the operators of this subpackage share: scratch tables, text normalisation, filters by id, per-process caches and memory."""

from __future__ import annotations

import atexit
import gc
import os
import sys
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.memory import lean  # noqa: F401  the operators take it from here

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


class Workspace:
    """Scratch tables in the folder that the cluster names in ``spark.checkpoint.dir``.

    Tables written here are durable: executors that are lost later take nothing with them. What a
    job needs no more goes with ``drop``; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            # A local session, as in tests; a cluster must name a folder that its machines share.
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._remove, self.root)
        self.release()  # what an operator before this one left

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has gone; the folder's owner cleans it
            return

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` as a scratch table and read it back with its schema."""
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def release(self) -> None:
        """Let Spark's cleaner remove shuffle files whose plans are no longer referenced."""
        gc.collect()
        self.spark._jvm.System.gc()


def among(ids: DataFrame, most: int = 1 << 27) -> tuple[Callable[[str], Column], Callable[[np.ndarray], np.ndarray]]:
    """A bitmap of the ids, the only column of ``ids``, which may repeat: the slot of a column's ids, and a test of slots for tasks.

    The test is true for each of the ids, and for others in about one of 16 to 32, so what a join would drop need
    not be shuffled first. The bitmap has ``most`` bits at most (16 MB; beyond that others pass more often).
    """
    bits = min(most, max(1 << 15, 1 << (16 * ids.count()).bit_length()))
    slot = lambda name: F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(bits)).cast("int")
    found = ids.select(slot(ids.columns[0]).alias("slot")).groupBy(F.shiftright("slot", 15).alias("part"))
    marks = np.zeros(bits // 8, np.uint8)
    for part, raw in found.agg(F.bitmap_construct_agg(F.pmod(F.col("slot"), F.lit(1 << 15)))).collect():
        marks[part << 12 : (part + 1) << 12] = np.frombuffer(raw, np.uint8)
    held = ids.sparkSession.sparkContext.broadcast(marks)
    return slot, lambda at: (held.value[at >> 3] >> (at & 7) & 1).astype(bool)


def where_among(df: DataFrame, name: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that may hold one of the ids, and the others, nulls among either; only the ids' slots go to Python."""
    slot, may_be = among(ids)

    def test(slots: pa.Array) -> pa.Array:
        return pa.array(may_be(slots.to_numpy(zero_copy_only=False)))

    test.__annotations__ = {"slots": pa.Array, "return": pa.Array}  # as objects, for Spark
    found = F.arrow_udf(test, "boolean")(slot(name))
    return df.where(found), df.where(~found)


def per_process(key, make):
    """A value made once in each Python process, whatever number of tasks it serves."""
    store = sys.__dict__.setdefault("_cohortlens_cache", {})
    if key not in store:
        store[key] = make()
    return store[key]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same on pure ASCII texts, and faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def partitions(spark: SparkSession, factor: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))) * factor


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
