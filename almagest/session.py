"""Session helpers: a configured local session for tests/bench, and the
checkpoint folder taken from the cluster's own configuration."""

from __future__ import annotations

import os
import shutil
import tempfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Settings every job relies on. ANSI stays on (Spark 4 default); every
# operator uses try_* / nullif so bad input gives NULL, not a failure.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "almagest") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("ALMAGEST_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's own code to the executors, once an application, for
    sessions that are started where the package is not installed."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="almagest-code-"), "almagest"), "zip",
                                      os.path.dirname(here), os.path.basename(here))
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is.
    Only when it is unset (unit tests on one machine) a scratch folder is
    created and registered.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="almagest-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, asked of the path's own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def publish(spark: SparkSession, draft: str, path: str) -> None:
    """Give a finished folder its name, atomically; if another session was
    first, its folder stays and the draft goes."""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    src, dst = jvm.Path(draft), jvm.Path(path)
    no_options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
    try:
        jvm.FileContext.getFileContext(src.toUri(), conf).rename(src, dst, no_options)
    except Py4JJavaError:
        if not path_exists(spark, path):
            raise
        src.getFileSystem(conf).delete(src, True)
