"""Session settings and the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the queries are tested under; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pluvia")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """URI of the folder named by ``spark.checkpoint.dir``.

    Only where a local session names none (tests) a temporary folder is made; it goes when the process ends. On a
    cluster such a folder would be another one on every machine, so there the setting must be made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = tempfile.mkdtemp(prefix="pluvia-")
        atexit.register(shutil.rmtree, _own_roots[app], ignore_errors=True)
    return f"file://{_own_roots[app]}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Scratch:
    """Intermediate tables of one query, written as Parquet below :func:`shared_root`.

    A written table cuts lineage and survives lost executors, and later stages read only the columns they need.
    ``drop`` removes a table that no later plan reads. What is left goes at the end of the process.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/pluvia/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def uri(self, name: str) -> str:
        return f"{self.path}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.uri(name))
        return self.spark.read.schema(df.schema).parquet(self.uri(name))

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.uri(name) if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self.drop()
            except Exception:  # the JVM may have gone before the process ends
                pass
