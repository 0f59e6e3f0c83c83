"""Session settings and the shared scratch folder.

Results are compared across engines, so the session zone is pinned to UTC.  Nothing here
assumes a local file system shared by accident: intermediate tables go to the folder named by
``spark.checkpoint.dir``; only when that is unset (tests, a laptop) is a temporary folder made.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SCRATCH_KEY = "spark.checkpoint.dir"


def build_session(cores: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin(spark: SparkSession) -> SparkSession:
    """Set what every query relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables and checkpoints.

    It has to be set where executors run on other machines; only a local session makes its own.
    """
    root = spark.sparkContext.getConf().get(SCRATCH_KEY) or spark.conf.get(SCRATCH_KEY, None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{SCRATCH_KEY} must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(SCRATCH_KEY, root)
    return root.rstrip("/")


_made: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder's name; the session's folders lie in one, which goes when the session's JVM ends."""
    app = spark.sparkContext.applicationId
    home = f"{scratch_root(spark)}/tidemark-{app}"
    if app not in _made:
        _made[app] = []
        _file_system(spark, home).deleteOnExit(_hadoop_path(spark, home))
    path = f"{home}/{tag}-{uuid.uuid4().hex[:12]}"
    _made[app].append(path)
    return path


def sweep(spark: SparkSession) -> None:
    """Delete the intermediate tables this session made so far; results read from them are gone with them."""
    made = _made.get(spark.sparkContext.applicationId, [])
    while made:
        drop_scratch(spark, made.pop())


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete one folder made by :func:`scratch_path`."""
    _file_system(spark, path).delete(_hadoop_path(spark, path), True)
