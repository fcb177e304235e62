"""Sinks (K01-K06, K09, K10, K12, K13, W09).

No table format jar is available, so a keyed merge is expressed as
``existing LEFT ANTI new UNION new`` and written to a *new* snapshot folder
under the shared checkpoint/warehouse location; readers switch by path.
Writes are whole-job idempotent (overwrite of a fresh folder), so a lost
executor only re-runs its tasks.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almagest.session import ensure_checkpoint_dir


def upsert(existing: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Keyed merge, the new batch wins; inside the new batch the
    first record in ``order`` wins (T14), so a key never comes out twice. One
    shuffle of each side by key."""
    rec = F.struct(*[F.col(c) for c in new.columns if c not in key])
    new = new.groupBy(*key).agg(F.min_by(rec, F.col(order)).alias("_r")).select(*key, "_r.*")
    kept = existing.join(new.select(*key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def keep_newest(df: DataFrame, key: list[str], id_col: str = "id") -> DataFrame:
    """One row per key, the one with the largest id (aggregate, not a
    window, so a hot key is folded map-side)."""
    rec = F.struct(*[F.col(c) for c in df.columns if c not in key])
    return df.groupBy(*key).agg(F.max_by(rec, F.col(id_col)).alias("_r")).select(*key, "_r.*")


def versioned_append(history: DataFrame | None, batch: DataFrame, key: list[str],
                     version_col: str = "version") -> DataFrame:
    """Give ``batch`` version = max(previous)+1 per key, append, and
    recompute ``is_current`` (= newest version of its key)."""
    if history is None:
        nxt = batch.withColumn(version_col, F.lit(1))
        allv = nxt
    else:
        prev = history.groupBy(*key).agg(F.max(version_col).alias("_maxv"))
        nxt = (batch.join(prev, key, "left")
                    .withColumn(version_col, (F.coalesce("_maxv", F.lit(0)) + 1).cast("int"))
                    .drop("_maxv"))
        allv = history.drop("is_current").unionByName(nxt, allowMissingColumns=True)
    w = Window.partitionBy(*key)
    return allv.withColumn("is_current", F.col(version_col) == F.max(version_col).over(w))


def snapshot_path(spark: SparkSession, table: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", table, uuid.uuid4().hex)


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None,
                   sort_within: list[str] | None = None) -> str:
    """Write a table snapshot as Parquet. ``sort_within`` orders rows inside
    each file so row-group min/max statistics skip on the sort columns."""
    out = df
    if sort_within:
        out = out.sortWithinPartitions(*sort_within)
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def overwrite_table(df: DataFrame, path: str) -> str:
    """Full refresh (delete all + insert) = overwrite of the folder."""
    df.write.mode("overwrite").parquet(path)
    return path


def write_if_absent(df: DataFrame, path: str) -> str:
    """Seed only when nothing is there yet."""
    df.write.mode("ignore").parquet(path)
    return path


def export_csv(df: DataFrame, path: str, metadata: dict | None = None) -> str:
    """CSV with header and RFC-style quoting of , \" \\n \\r; the
    comment-style metadata header goes to a side JSON file (a comment line
    inside the data would break a parallel write and parallel read)."""
    (df.write.mode("overwrite").option("header", True).option("quote", '"')
       .option("escape", '"').option("quoteAll", False).csv(path))
    if metadata is not None:
        spark = df.sparkSession
        side = spark.createDataFrame([(json.dumps(metadata, sort_keys=True, default=str),)], "meta string")
        side.coalesce(1).write.mode("overwrite").text(path.rstrip("/") + "_metadata")
    return path


def label_back(respondents: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """Attach predicted labels to respondents by key (never by position, T12)."""
    return respondents.drop("cluster_id").join(labels.select(*key, "cluster_id"), key, "left")


def save_named(df: DataFrame, root: str, name: str, created_at: str) -> str:
    """Persist a result (e.g. a scenario sweep) under a name; the
    folder is partitioned by name so each save is its own partition."""
    out = df.withColumn("name", F.lit(name)).withColumn("created_at", F.to_timestamp(F.lit(created_at)))
    out.write.mode("append").partitionBy("name").parquet(root)
    return root


def list_named(spark: SparkSession, root: str) -> DataFrame:
    """Saved results, newest first, one row per name."""
    df = spark.read.parquet(root)
    return (df.groupBy("name").agg(F.max("created_at").alias("created_at"), F.count(F.lit(1)).alias("rows"))
              .orderBy(F.col("created_at").desc(), "name"))


def load_named(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One saved result by name (its newest save); no rows if there is none."""
    df = spark.read.parquet(root).filter(F.col("name") == name)
    return df.join(df.groupBy("name").agg(F.max("created_at").alias("created_at")), ["name", "created_at"], "left_semi")


def save_run(df: DataFrame, root: str, run_id: int, name: str, params: dict, created_at: str) -> int:
    """Keep a result with its id, name and parameters. The run's
    description is written last: a result without one is not listed."""
    df.write.mode("overwrite").parquet(f"{root}/results/run_id={run_id}")
    row = [(name, json.dumps(params, sort_keys=True), created_at)]
    about = df.sparkSession.createDataFrame(row, "name string, params string, created_at string")
    about.coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/run_id={run_id}")
    return run_id


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """Saved runs (run_id, name, params, created_at), newest first."""
    return spark.read.parquet(f"{root}/runs").orderBy(F.col("created_at").desc(), F.col("run_id").desc())


def compare_runs(spark: SparkSession, root: str, ids: list[int], most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted runs with their names and parameters (at
    most ``most`` runs, whose partitions alone are read), and the ids that
    there are none for."""
    if len(ids) > most:
        raise ValueError(f"at most {most} runs can be compared")
    wanted = spark.createDataFrame([(int(i),) for i in ids], "run_id int")
    runs = spark.read.parquet(f"{root}/runs").filter(F.col("run_id").isin(*ids))
    rows = spark.read.parquet(f"{root}/results").filter(F.col("run_id").isin(*ids))
    return rows.join(runs, "run_id"), wanted.join(runs, "run_id", "left_anti")


def save_model(model, path: str) -> str:
    """Persist a fitted pyspark.ml model (overwrite)."""
    model.write().overwrite().save(path)
    return path


def load_model(kind, path: str):
    """Read a model of class ``kind`` back."""
    return kind.load(path)


def point(df: DataFrame, **key) -> DataFrame:
    """the row of a key, by pushed-down equality filters; an empty frame
    says that there is none."""
    for column, value in key.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df.limit(1)
