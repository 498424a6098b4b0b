"""Session helpers: durable cuts of the lineage in the shared folder."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A folder of this machine is made only where none is named and the session runs in
    local mode, where driver and executor are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            named = tempfile.mkdtemp(prefix="quire-shared-")
            spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Like a reliable checkpoint it ends the lineage and survives lost executors; columnar
    and compressed, it takes less room. The table is removed when the program ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quire-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def cut_in_buckets(df: DataFrame, n: int, column: str) -> DataFrame:
    """Like :func:`cut`, as a table of ``n`` buckets by ``column``, so groups and joins by it needn't move its rows.

    ``df`` should be partitioned so already, else every task writes a file for each bucket.
    """
    spark = df.sparkSession
    name = f"quire_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, column).saveAsTable(name)
    atexit.register(_remove, spark, path)
    out = spark.table(name)
    out._quire_path, out._quire_table = path, name
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables made by :func:`cut` that nothing still to run reads.

    The shuffle files of what was written are removed once the driver's collector has seen
    that nothing refers to them; it is asked to look, as it may not for half an hour.
    """
    for t in tables:
        if hasattr(t, "_quire_table"):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._quire_table}")
        _remove(t.sparkSession, t._quire_path)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
