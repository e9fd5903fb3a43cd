"""Helpers shared by the training-data operators: the shared workspace, materialised tables and word splitting."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
#: ``bytes.split()`` without arguments separates at exactly these.
LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_made: dict[str, SparkSession] = {}


def workspace(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the whole of Spark runs on this machine and no folder is named (local tests) is a temporary folder set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="marlspark-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the workspace that is removed by ``release`` or at the end of the program."""
    path = f"{workspace(spark)}/{label}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def release(spark: SparkSession | None = None) -> None:
    """Remove the tables made so far (of one session); for drivers that live long, to be called when results have been read."""
    for path, owner in list(_made.items()):
        if spark is not None and owner is not spark:
            continue
        del _made[path]
        try:
            jvm, jsc = owner._jvm, owner.sparkContext._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; the folder's owner clears it
            continue


atexit.register(release)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the workspace and read it back: cuts lineage, survives lost executors, and has a known size."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches_by_bytes(batches, column: int, most: int = 8 << 20):
    """Split record batches so that none holds much more than ``most`` bytes in ``column``."""
    for batch in batches:
        n, size = batch.num_rows, batch.column(column).nbytes
        if size <= most or n <= 1:
            if n:
                yield batch
            continue
        step = max(1, n * most // size)
        for i in range(0, n, step):
            yield batch.slice(i, step)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return column.fill_null("").cast(pa.binary()).to_pylist()


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so other columns can't clash."""
    from pyspark.sql import functions as F

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ...: whatever an operator adds can't clash; ``toDF(*docs.columns)`` undoes it."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, shares: int = 4096) -> DataFrame:
    """Inner join of many rows with one row a key, where ``count`` says how many rows of ``left`` a key has.

    Keys with more than one part in ``shares`` of the rows, so fewer than ``shares``, are sent to every task; their rows stay where they are and aren't shuffled into one.
    """
    from pyspark.sql import functions as F

    most = left.count() // shares
    hot = F.broadcast(right.where(F.col(count) > most))
    cold = left.join(hot.select(*keys), keys, "left_anti").join(right.where(F.col(count) <= most), keys)
    return left.join(hot, keys).unionByName(cold)
