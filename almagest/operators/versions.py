"""A log-structured store of versioned results.

    root/<table>/run=N/   rows that run N appended, never rewritten
    root/heads/run=N/     key, version, run: each key's newest version after N

An append reads the head table (a row for each key) and its own batch, never
old rows: a key's next version is its head's plus one. The new head table is
written last and named by one rename, which commits the run; rows of a run
without heads (a writer that died) are not read and are overwritten by the next
append. ``is_current`` is a join with the heads on read, and current rows are
found by their run, a partition column.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.session import path_exists


class VersionStore:
    """Results by ``key``, each append a new version of the keys it holds."""

    def __init__(self, spark: SparkSession, root: str, key: list[str]):
        self.spark, self.root, self.key = spark, root.rstrip("/"), list(key)

    # commits

    def runs(self) -> list[int]:
        """Committed runs, oldest first."""
        heads = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/heads")
        if not path_exists(self.spark, f"{self.root}/heads"):
            return []
        found = heads.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(heads)
        names = [f.getPath().getName() for f in found]
        return sorted(int(n[4:]) for n in names if n.startswith("run="))

    def last_run(self) -> int:
        return max(self.runs(), default=0)

    def heads(self) -> DataFrame | None:
        """key, version, run: the newest version of each key."""
        run = self.last_run()
        return self.spark.read.parquet(f"{self.root}/heads/run={run}").withColumnRenamed("at_run", "run") if run else None

    # appends

    def staged(self, df: DataFrame) -> DataFrame:
        """df written to a draft folder and read back, so that it is computed
        once however often an append reads it."""
        path = f"{self.root}/_draft/{uuid.uuid4().hex}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.draft = path
        return back

    def numbered(self, batch: DataFrame) -> DataFrame:
        """key, version of the keys in batch: the next one of each."""
        keys, heads = batch.select(*self.key).distinct(), self.heads()
        if heads is None:
            return keys.withColumn("version", F.lit(1))
        nxt = (F.coalesce("version", F.lit(0)) + 1).cast("int").alias("version")
        return keys.join(heads.drop("run"), self.key, "left").select(*self.key, nxt)

    def append(self, table: str, batch: DataFrame, beside: dict[str, DataFrame] | None = None,
               logs: dict[str, DataFrame] | None = None) -> int:
        """Add batch to table as the next version of its keys; returns the run.
        ``beside``: further tables of the same key, which take the same
        versions (null for keys that batch lacks). ``logs``: tables without
        versions. Batches are evaluated once."""
        run, before = self.last_run() + 1, self.heads()
        batch = batch if hasattr(batch, "draft") else self.staged(batch)
        nxt = self.staged(self.numbered(batch))
        for name, df in {table: batch, **(beside or {})}.items():
            df.join(nxt, self.key, "left").write.mode("overwrite").parquet(f"{self.root}/{name}/run={run}")
        for name, df in (logs or {}).items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/run={run}")
        heads = nxt.withColumn("at_run", F.lit(run))
        if before is not None:
            heads = before.withColumnRenamed("run", "at_run").join(nxt.select(*self.key), self.key, "left_anti").unionByName(heads)
        self._commit(self.staged(heads).draft, run)
        self._drop(batch.draft, nxt.draft)
        return run

    def _commit(self, draft: str, run: int) -> None:
        """Name the new heads by one rename; it fails if the run is there."""
        jvm, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark._jsc.hadoopConfiguration()
        src, dst = jvm.Path(draft), jvm.Path(f"{self.root}/heads/run={run}")
        src.getFileSystem(conf).mkdirs(dst.getParent())
        plain = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
        try:
            jvm.FileContext.getFileContext(src.toUri(), conf).rename(src, dst, plain)
        except Py4JJavaError as e:
            if path_exists(self.spark, dst.toString()):
                raise RuntimeError(f"another append committed run {run} of {self.root} first") from e
            raise

    def _drop(self, *paths: str) -> None:
        for path in paths:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    # reads

    def log(self, table: str) -> DataFrame:
        """All rows of committed runs, with their ``run``."""
        return self.spark.read.parquet(f"{self.root}/{table}").filter(F.col("run") <= self.last_run())

    def read(self, table: str) -> DataFrame:
        """All versions, with ``is_current`` from the heads."""
        head = self.heads().select(*self.key, F.col("version").alias("_head"))
        return (self.log(table).join(head, self.key, "left")
                .withColumn("is_current", F.coalesce(F.col("version") == F.col("_head"), F.lit(False))).drop("_head", "run"))

    def current(self, table: str) -> DataFrame:
        """the newest version of each key. The heads name its run, so
        runs that hold no current version are pruned."""
        return self.log(table).join(self.heads(), [*self.key, "version", "run"], "left_semi").drop("run")

    def latest(self, table: str) -> DataFrame:
        """The last run's rows of a log that every run writes whole."""
        return self.spark.read.parquet(f"{self.root}/{table}/run={self.last_run()}")


def appended(spark: SparkSession, root: str, key: list[str], batches: list[Callable[[], DataFrame] | DataFrame]) -> DataFrame:
    """Batches appended one by one to a fresh store; all versions."""
    store = VersionStore(spark, root, key)
    for batch in batches:
        store.append("rows", batch() if callable(batch) else batch)
    return store.read("rows")
