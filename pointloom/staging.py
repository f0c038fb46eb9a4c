"""Tables staged in the folder that all executors share, to cut lineage in iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: list[tuple[SparkSession, str]] = []


class Staging:
    """Writes DataFrames as Parquet under ``spark.checkpoint.dir`` and reads them back."""

    def __init__(self, spark: SparkSession, name: str):
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            top = tempfile.mkdtemp(prefix="pointloom-")
            spark.conf.set("spark.checkpoint.dir", top)
        self.spark, self.root, self._n = spark, f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0
        _ROOTS.append((spark, self.root))

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, root in _ROOTS:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return
