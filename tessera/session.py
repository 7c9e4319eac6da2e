"""Session defaults and the shared folder for materialised intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for a local session; a cluster brings its own.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}

_own_dir: str | None = None


def local_session(cpus: int | str = 8, app: str = "tessera", **conf: str) -> SparkSession:
    """A local session with the library's defaults."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is missing and all executors live in this process (tests,
    a laptop); on a cluster a machine-local folder would be read back in part, so there it is an error.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own_dir


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


#: Removes the shuffle files of a finished query at once instead of when the driver next collects garbage.
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Staging:
    """Tables written to the shared folder to cut lineage.

    A lost executor costs nothing but a re-read, since the folder outlives it. ``keep`` returns the
    written table, ``drop`` deletes one that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        schema = df.schema
        before = self.spark.conf.get(_CLEAN_SHUFFLES, "false")
        self.spark.conf.set(_CLEAN_SHUFFLES, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(_CLEAN_SHUFFLES, before)
        out = self.spark.read.schema(schema).parquet(path)
        out._staged_path = path  # noqa: SLF001
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            path = getattr(df, "_staged_path", None)
            if path:
                _delete(self.spark, path)
