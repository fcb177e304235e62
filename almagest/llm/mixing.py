"""Mixing sources to target weights along a time-varying curriculum.

DataFrame functions only.

1. Every source's share of the mix: sources in code point order (null last)
   get weights in a repeating cycle, share ``RATIO`` times all words, and stop
   at ``MOST`` times their own size; what is above is shared anew by weight
   until no target is above its limit.
2. Within a source, documents queue in the order of a hash of their id. A
   document's place in the queue is a running sum of words: sums of hash
   buckets first, then sums within a bucket, so a source that holds a third of
   all rows is spread over many tasks. Whole passes are taken as often as the
   target holds the source; of the last pass, the documents whose middle lies
   within the rest.
3. Each source's weight changes over training: its rate at time t in 0..1 is
   its target times 1 + a (2t - 1), with a from ``SLOPES`` in turn. The
   integral is the source's cumulative token demand; inverting it at the middle
   of each copy in the queue gives the copy's training position.
4. Copies are range-sorted by position; files written from them keep the order
   in their names and rows (``written_order``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almagest.llm.common import WORD, as_row, doc_key, parallelism, text_key, written

WEIGHTS = (3, 1, 2)
RATIO = 1.5
MOST = 2
SLOPES = (-0.5, 0.0, 0.5)
#: Documents of a hash bucket, and the most buckets of a source.
BUCKET_ROWS = 4096
MOST_BUCKET_BITS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Ids, keys, source and size of every row, written."""
    text = F.col("text").cast("string")
    queue = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return written(spark, docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("k1"), text_key().alias("k2"),
        F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"),
        word_count(text).alias("size"), queue.alias("queue")), "sizes")


def _ranked(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """sources with their rank from 0 in code point order, null last: ranges
    first, then rows within a range, so no task sorts all sources."""
    dealt = written(spark, sources.repartitionByRange(parallelism(spark), "no_source", "src")
                    .withColumn("part", F.spark_partition_id()), "sources")
    before, parts = 0, []
    for r in dealt.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        parts.append((r["part"], before))
        before += r["count"]
    begins = spark.createDataFrame(parts, "part int, before long")
    within = F.row_number().over(Window.partitionBy("part").orderBy("no_source", "src"))
    return dealt.join(begins, "part").withColumn("rank", (F.col("before") + within - 1).cast("long")).drop("part", "before")


def _cycle(values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("rank") % len(values) + 1).cast("int"))


def targets(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """no_source, src, source_size, target and slope of every source."""
    sources = sizes.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"))
    sources = written(spark, _ranked(spark, sources).withColumns(
        {"weight": _cycle(WEIGHTS).cast("double"), "slope": _cycle(SLOPES)}), "ranked")
    total = RATIO * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = -1.0  # words for each unit of weight; grows until no open source is above its limit
    while True:
        full = F.col("weight") * level > MOST * F.col("source_size")
        spent, open_weight = sources.agg(
            F.coalesce(F.sum(F.when(full, MOST * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        nxt = (total - spent) / open_weight if open_weight else level
        if nxt == level:
            break
        level = nxt
    limit = (MOST * F.col("source_size")).cast("double")
    return sources.select("no_source", "src", "source_size", "slope",
                          F.least(F.col("weight") * max(level, 0.0), limit).alias("target"))


def _position(u: Column, slope: Column) -> Column:
    """t in 0..1 at which t + slope (t^2 - t) reaches u."""
    return 2 * u / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u))


def plan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """What the mix takes of every row: doc_id, k1, k2, size, source_size,
    target, taken (words) and positions (one for each copy, in 0..1).

    Null text has size 0 and is never taken more than 0 words; null sources
    form one source; ties in the queue (one id in several rows) go by text;
    equal rows are interchangeable; an empty table gives an empty plan."""
    sizes = sized(spark, docs)
    goal = targets(spark, sizes)
    bits = min(MOST_BUCKET_BITS, max(0, math.ceil(math.log2(max(1, sizes.count()) / BUCKET_ROWS))))
    bucket = F.shiftright(F.conv(F.substring("queue", 1, 4), 16, 10).cast("int"), 16 - bits)
    rows = sizes.withColumn("bucket", bucket)
    key = ["no_source", "src", "bucket"]
    sums = rows.groupBy(*key).agg(F.sum("size").alias("words"))
    through = F.sum("words").over(Window.partitionBy("no_source", "src").orderBy("bucket")
                                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = sums.select(*key, (through - F.col("words")).alias("ahead"))
    inside = F.sum("size").over(Window.partitionBy(*key).orderBy("queue", "k1", "k2")
                                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    queued = (rows.withColumn("inside", inside).join(sums, key).join(goal, ["no_source", "src"])
              .withColumn("begin", F.col("ahead") + F.col("inside") - F.col("size")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    queued = queued.withColumn("passes", passes.cast("long"))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    middle = F.col("begin") + F.col("size") / 2
    copies = F.col("passes") + F.when((F.col("size") > 0) & (middle <= rest), 1).otherwise(0)
    queued = queued.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("int"))
    reach = lambda c: F.least((c * F.col("source_size") + middle) / F.col("target"), F.lit(1.0))
    each = F.when(F.col("copies") > 0, F.transform(
        F.sequence(F.lit(0), F.col("copies") - 1), lambda c: _position(reach(c), F.col("slope")))).otherwise(
        F.array().cast("array<double>"))
    return queued.select("doc_id", "k1", "k2", "size", "source_size", "target",
                         (F.col("copies") * F.col("size")).cast("long").alias("taken"), each.alias("positions"))


def in_order(spark: SparkSession, planned: DataFrame) -> DataFrame:
    """A plan range-sorted by each row's first position, rows not taken last."""
    first = F.try_element_at("positions", F.lit(1))
    order = [first.isNull(), first, F.col("k1"), F.col("k2")]
    return planned.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)


def written_order() -> list[Column]:
    """Columns that order the rows of a mix that was written and read back from
    its files: by the number in a file's name (names have five digits up to
    99 999 and more from there on), then by place. Only for tables that come
    from files."""
    name = F.col("_metadata.file_name")
    return [F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), name, F.col("_metadata.row_index")]


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mixed corpus: docs' rows, each as often as the mix takes it, in
    order of training position (range-sorted), in docs' columns."""
    chosen = plan(spark, docs).filter(F.size("positions") > 0).groupBy("k1", "k2").agg(
        F.flatten(F.collect_list("positions")).alias("positions"))
    own = docs.select(as_row(docs), doc_key().alias("k1"), text_key().alias("k2"))
    # the same id and text in more rows than one: the positions of all hang on the first
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0)))
    placed = (own.join(chosen, ["k1", "k2"]).withColumn("nth", nth).filter("nth = 1")
              .withColumn("at", F.explode("positions")))
    return (placed.repartitionByRange(parallelism(spark), "at", "k1", "k2")
            .sortWithinPartitions("at", "k1", "k2").select("row.*"))
