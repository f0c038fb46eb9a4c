"""Helpers shared by the text operators: staging tables, bounded joins, label reading."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a staged table may be broadcast; its bytes are checked as well.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

_OPEN: list["Stage"] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder takes its place if the whole of Spark runs in this process's machine (tests);
    on a cluster that would lose rows, so it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pointloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Stage:
    """Tables written to the shared folder; they cut lineage and survive the loss of any executor.

    Tables that a returned DataFrame still reads stay until the driver's process ends.

    A join of a staged table by its key has plain shuffles on both sides, so Spark splits the partition of a hot key
    when it runs (adaptive skew join); a join with an aggregate that is not staged could not be split.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        _OPEN.append(self)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df once and returns the reread table."""
        at = self.path(name)
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def close(self) -> None:
        delete(self.spark, self.root)


@atexit.register
def _close_all() -> None:
    for s in _OPEN:
        try:
            s.close()
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def maybe_broadcast(table: DataFrame, row_bytes: int) -> DataFrame:
    """Marks a *staged* table for broadcast if its counted rows are within the bound; else Spark shuffles as usual.

    row_bytes: what one row takes at most (only for rows of fixed width).
    """
    n = table.count()
    return F.broadcast(table) if n <= BROADCAST_ROWS and n * row_bytes <= BROADCAST_BYTES else table


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no classifier learns from: crc32 of the id as text, modulo 5, is 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))


def whole(text: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c, F.lit(""))


def least_hashes(rows: DataFrame, h: str, most: int, total: int, *then: str) -> DataFrame:
    """The ``most`` rows of the least hashes. With many rows, a cut that about 4 * most of them pass goes ahead of the
    sorting, so that what meets in one place does not grow with the number of partitions."""
    if total > 8 * most:
        rows = rows.where(F.col(h) < int(-(2**63) + 2**64 * (4 * most / total)))
    return rows.orderBy(h, *then).limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """Learning rows (text, y): at most per_class of either label, never a held-out row.

    Rows are chosen by the smallest hash of their id, so the sample is the same on every run and
    on any partitioning. per_class bounds what the classifier is fitted on; nothing else is bounded.
    """
    ids = (
        labels.where(F.col(label).isin(0, 1) & ~held_out("doc_id") & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
        .withColumn("_h", F.xxhash64("_id"))
    )
    sizes = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = least_hashes(ids.where(F.col("y") == y), "_h", per_class, sizes.get(y, 0), "_id")
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.groupBy("_id").agg(F.min("y").alias("y"), F.count_distinct("y").alias("_n")).where("_n = 1").select("_id", "y")
    # at most 2 * per_class rows of 12 bytes: the bound of this broadcast is the parameter itself
    return docs.join(F.broadcast(picked), docs["doc_id"] == picked["_id"]).select(
        docs["doc_id"].alias("doc_id"), whole(docs["text"]).alias("text"), picked["y"].alias("y")
    )
