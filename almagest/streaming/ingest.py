"""Structured Streaming operators.

R01  incremental landing-zone ingest: file source -> ``foreachBatch``
     (validate -> keyed merge, newest batch wins) -> rewrite of the touched
     partitions only.
     The stream checkpoint replaces the cron job's "what is new" question;
     ``Trigger.AvailableNow`` processes what has landed and stops.
R02  de-duplication by key inside a watermark over arrival time
     (``dropDuplicatesWithinWatermark``), state bounded by the watermark. The
     event's own time plays no part, so a late event is not lost.
R03  continuously maintained latest value and catalogue per series: points
     keyed by (series, period) in a table partitioned by period, and beside it
     a state table of series that each micro-batch brings up to date from
     what it adds or corrects. No watermark eviction: a late correction must
     still overwrite (the reference's rule).

All folders live under the session's shared checkpoint location. What a table
holds is asked of its folder, never of the driver's memory: a new driver on the
same folders goes on where the last one stopped, and a retried micro-batch
rewrites the same partitions with the same rows (idempotent).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.operators import sinks as K
from almagest.session import ensure_checkpoint_dir, path_exists


def workspace(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")


def land(df: DataFrame, folder: str, part_col: str, parts: int) -> str:
    """Write ``df`` as ``parts`` deliveries (part = part_col mod parts), in
    arrival order, each as many files as it has partitions."""
    for p in range(parts):
        (df.filter(F.col(part_col) % parts == p).drop(part_col)
           .write.mode("overwrite").parquet(os.path.join(folder, f"arrival={p:04d}")))
    return folder


class PartitionedTable:
    """A keyed table stored as Parquet partitioned by ``part_col``. A merge
    reads only the partitions the batch touches (partition pruning), upserts
    them, cuts lineage with a reliable checkpoint and rewrites just those
    partitions (dynamic partition overwrite), so the cost of a micro-batch
    follows the batch, not the table. Re-running a batch gives the same
    partitions (idempotent)."""

    def __init__(self, spark: SparkSession, root: str, part_col: str, schema=None):
        self.spark, self.root, self.part_col, self.schema = spark, root, part_col, schema

    def read(self) -> DataFrame | None:
        if not path_exists(self.spark, self.root):
            return None
        r = self.spark.read
        if self.schema is not None:
            r = r.schema(self.schema)
        return r.parquet(self.root)

    def merge(self, batch: DataFrame, key: list[str], batch_id: int) -> None:
        if self.schema is None:
            self.schema = batch.schema
        prev = self.read()
        if prev is not None:
            # the partitions of this batch, by a semi-join (dynamic pruning reads no others)
            touched = batch.select(self.part_col).distinct()
            merged = K.upsert(prev.join(touched, self.part_col, "left_semi"), batch, key, order=self.part_col)
        else:
            merged = batch
        merged = merged.select(*self.schema.fieldNames()).checkpoint(eager=True)
        (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
               .partitionBy(self.part_col).parquet(self.root))


def incremental_ingest(spark: SparkSession, landing: str, schema, validate, key: list[str],
                       work: str, max_files_per_trigger: int = 64, part_col: str = "period") -> PartitionedTable:
    """Process every landed file once, validate each micro-batch and
    merge its valid rows into the table (newest batch wins); only the
    partitions (periods) a batch touches are rewritten."""
    table = PartitionedTable(spark, os.path.join(work, "table"), part_col)
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
                   .option("recursiveFileLookup", "true").parquet(landing))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        valid = validate(batch).persist()  # read twice: touched partitions + merge
        try:
            table.merge(valid, key, batch_id)
        finally:
            valid.unpersist()

    q = (stream.writeStream.foreachBatch(on_batch)
               .option("checkpointLocation", os.path.join(work, "checkpoint"))
               .trigger(availableNow=True).start())
    q.awaitTermination()
    return table


def dedup_stream(spark: SparkSession, landing: str, schema, key: list[str],
                 delay: str, work: str, max_files_per_trigger: int = 64) -> DataFrame:
    """Drop repeated deliveries of a key that arrive within the delay of
    one another; results are appended to a Parquet sink and read back. Arrival
    is the time at which the row's file was written (file source metadata), so
    whatever the events' own times and order, none is dropped as late."""
    out = os.path.join(work, "out")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
                   .option("recursiveFileLookup", "true").parquet(landing))
    d = (stream.withColumn("_arrival", F.col("_metadata.file_modification_time"))
               .withWatermark("_arrival", delay).dropDuplicatesWithinWatermark(key).drop("_arrival"))
    q = (d.writeStream.format("parquet").option("path", out)
          .option("checkpointLocation", os.path.join(work, "checkpoint"))
          .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def latest_state(spark: SparkSession, landing: str, schema, key: list[str], work: str, order: str,
                 state_buckets: int | None = None, max_files_per_trigger: int = 64) -> DataFrame:
    """Per series, latest value (by period ordinal ``t``), first/last
    period and number of points, maintained incrementally.

    Of all rows of a (series, period) the one of largest ``order`` (a revision
    number, a fetch time) counts, in whatever order they arrive: a correction
    replaces the value and is no further point, an older revision that comes
    late changes nothing. A micro-batch reads and rewrites the periods and the
    series' buckets that it touches.

    A batch that is run again after a crash adds nothing twice: the state is
    written before the points, each of its rows says which batch it has, and
    those that have the batch stay as they are."""
    # as many buckets as shuffle partitions; a stream keeps the number that it began with
    state_buckets = state_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = PartitionedTable(spark, os.path.join(work, "points"), "period")
    state = PartitionedTable(spark, os.path.join(work, "state"), "bucket")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
                   .option("recursiveFileLookup", "true").parquet(landing))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rows = (batch.groupBy(*key, "period").agg(F.max_by(F.struct("t", "value", order), F.col(order)).alias("r"))
                     .select(*key, "period", "r.*"))
        news = accepted(rows, points.read(), key, order).checkpoint(eager=True)
        state.merge(caught_up(news, state.read(), key, batch_id, state_buckets), key, batch_id)
        points.merge(news.drop("is_new"), [*key, "period"], batch_id)

    q = (stream.writeStream.foreachBatch(on_batch)
               .option("checkpointLocation", os.path.join(work, "checkpoint"))
               .trigger(availableNow=True).start())
    q.awaitTermination()
    return state.read().select(*key, "latest_period", "latest_value", "first_period", "last_period", "n_points")


def accepted(rows: DataFrame, points: DataFrame | None, key: list[str], order: str) -> DataFrame:
    """Rows that are new or at least as late as the stored point, with
    ``is_new``. Only the rows' periods are read (partition pruning)."""
    if points is None:
        return rows.withColumn("is_new", F.lit(True))
    there = (points.join(rows.select("period").distinct(), "period", "left_semi")
                   .select(*key, "period", F.col(order).alias("_stored"), F.lit(True).alias("_there")))
    j = rows.join(there, [*key, "period"], "left")
    late = F.col("_there").isNull() | F.coalesce(F.col(order) >= F.col("_stored"), F.col("_stored").isNull())
    return j.filter(late).withColumn("is_new", F.col("_there").isNull()).drop("_stored", "_there")


def caught_up(news: DataFrame, state: DataFrame | None, key: list[str], batch_id: int, buckets: int) -> DataFrame:
    """State rows of the series in ``news``, with what it adds."""
    add = news.groupBy(*key).agg(
        F.max_by(F.struct("t", "period", "value"), F.col("t")).alias("latest"), F.min("period").alias("first_period"),
        F.max("period").alias("last_period"), F.count_if("is_new").alias("n_points")).select(
            *key, F.col("latest.t").alias("latest_t"), F.col("latest.period").alias("latest_period"),
            F.col("latest.value").alias("latest_value"), "first_period", "last_period", "n_points")
    add = add.withColumns({"batch": F.lit(batch_id).cast("long"), "bucket": F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")})
    if state is None:
        return add
    cols = [c for c in add.columns if c not in (*key, "bucket")]
    old = (state.join(add.select("bucket").distinct(), "bucket", "left_semi")
                .select(*key, F.struct(*cols).alias("o")))
    j = add.select(*key, "bucket", F.struct(*cols).alias("a")).join(old, key, "left")
    a, o = F.col("a"), F.col("o")
    later = a["latest_t"] >= o["latest_t"]
    both = {c: F.when(later, a[c]).otherwise(o[c]) for c in ("latest_t", "latest_period", "latest_value")}
    both |= {"first_period": F.least(a["first_period"], o["first_period"]), "last_period": F.greatest(a["last_period"], o["last_period"]),
             "n_points": a["n_points"] + o["n_points"], "batch": a["batch"]}
    merged = F.when(o.isNull(), a).when(o["batch"] >= a["batch"], o).otherwise(F.struct(*[both[c].alias(c) for c in cols]))
    return j.select(*key, merged.alias("m"), "bucket").select(*key, *[F.col(f"m.{c}").alias(c) for c in cols], "bucket")
