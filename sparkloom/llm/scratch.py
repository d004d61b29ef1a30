"""Shared scratch space: intermediate tables that outlive a lost executor.

Tables are written as Parquet below ``spark.checkpoint.dir``, the folder that the driver and all
executors share, and read back; this cuts lineage, and the re-read plan carries real exchanges that
AQE may split when a key is hot.  Where the setting is empty a local folder is used on one machine
(tests); on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_LOCAL: str | None = None
_CLEANED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder below ``spark.checkpoint.dir``."""
    global _LOCAL
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if _LOCAL is None:
            _LOCAL = tempfile.mkdtemp(prefix="sparkloom-")
        base = f"file://{_LOCAL}"
    top = f"{base.rstrip('/')}/scratch-{spark.sparkContext.applicationId}"
    if top not in _CLEANED:
        _CLEANED.add(top)
        atexit.register(_forget, spark, top)
    return top


def _forget(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the JVM may be gone at exit; the folder is the application's own
        return


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


class Stage:
    """Tables written by one run of an operator; ``drop`` removes those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def table(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, f"{self.name}-{label}")
        df.write.option("compression", "zstd").parquet(path)
        self.paths[label] = path
        return self.spark.read.schema(_nullable(df.schema)).parquet(path)

    def drop(self, *labels: str) -> None:
        for label in labels:
            drop_path(self.spark, self.paths.pop(label))

    def keep(self, *labels: str) -> None:
        """Remove every table but these; what was read from a removed one must not be used again."""
        self.drop(*[x for x in self.paths if x not in labels])


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
