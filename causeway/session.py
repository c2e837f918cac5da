"""Session settings and the shared folder used to cut long lineages."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that may be changed on a running session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the split costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # The files of a shuffle go with the query that made them; else they stay until the driver collects its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def build_session(app_name: str = "causeway", master: str | None = None, **settings: str) -> SparkSession:
    """A session with this package's settings; extra settings override them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else made."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


_PLANNED, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def measured_broadcasts(spark: SparkSession) -> SparkSession:
    """Let a join broadcast a side only when its rows have been made and measured.

    Before that Spark goes by the size of the files, which says little: written tables hold up to 30 times
    their files, so that millions of rows would go through the driver. The session's limit stays as it is.
    """
    limit = spark.conf.get(_PLANNED)
    if limit != "-1":
        if spark.conf.get(_MEASURED, None) is None:
            spark.conf.set(_MEASURED, limit)
        spark.conf.set(_PLANNED, "-1")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="causeway-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Intermediate tables of one job, written to the shared folder.

    A written table cuts the lineage and survives the loss of executors. Its files are compressed, so
    their size is no size of its rows (see ``measured_broadcasts``).
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self.root = f"{shared_dir(spark)}/causeway-{uuid.uuid4().hex}"
        self._count = 0
        self._lock = threading.Lock()

    def _path(self) -> str:
        with self._lock:
            self._count += 1
            return f"{self.root}/{self._count - 1}"

    def cut(self, df: DataFrame) -> DataFrame:
        path = self._path()
        df.write.option("compression", "zstd").parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Remove the tables; call once nothing reads them any more."""
        jvm_path = self._spark._jvm.org.apache.hadoop.fs.Path(self.root)
        conf = self._spark.sparkContext._jsc.hadoopConfiguration()
        jvm_path.getFileSystem(conf).delete(jvm_path, True)
