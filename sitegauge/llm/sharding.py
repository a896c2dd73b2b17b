"""Operator 5: two-pass external shuffle of records into shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitegauge.llm.common import unused, write_out
from sitegauge.sources.tables import read_table

#: Buckets whose counts are summed up by one task of the running sum.
RUN = 1024
#: Bytes of a bucket: at least, and at most where the input is so large that MANY buckets would be larger.
LEAST_BYTES, MOST_BYTES, MANY = 4 << 20, 256 << 20, 4096


def record_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)


def scatter(df: DataFrame, buckets: int, seed: int, place: str) -> DataFrame:
    """First pass: every record gets a seeded hash bucket, independent of its content and so without skew.

    The hash is of the record's place in the input (its task and row), so that repeated rows and hot keys
    spread like any others. The buckets are written out: the places are drawn once, whatever task is
    run again later.
    """
    drawn = df.withColumn(place, F.monotonically_increasing_id())
    return write_out(drawn.withColumn(unused(df.columns, "__bucket"), F.pmod(F.xxhash64(F.lit(seed), place), F.lit(buckets)).cast("int")))


def bucket_starts(scattered: DataFrame, bucket: str) -> DataFrame:
    """(bucket, first, all): the number of records in all earlier buckets, and in all.

    Counts are summed in runs of RUN buckets, and then over runs, so that no task reads every bucket.
    """
    counts = scattered.groupBy(F.col(bucket).alias("__bucket")).agg(F.count("*").alias("__n")).withColumn("__run", F.floor(F.col("__bucket") / RUN))
    inside = Window.partitionBy("__run").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    over_runs = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)  # one row for RUN buckets
    runs = counts.groupBy("__run").agg(F.sum("__n").alias("__in_run"))
    before = runs.select("__run", F.coalesce(F.sum("__in_run").over(over_runs), F.lit(0)).alias("__before"), F.sum("__in_run").over(Window.partitionBy()).alias("__all"))
    within = counts.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    return within.join(before, "__run").select("__bucket", (F.col("__before") + F.col("__inside")).alias("__first"), "__all")


def shuffle_into_shards(
    df: DataFrame, shards: int = 24, seed: int = 20_011, bucket_bytes: int | None = None, text: str = "text"
) -> DataFrame:
    """Every record of ``df`` with shard, slot and law, in a uniformly random order.

    Pass one scatters records into memory-sized buckets by a seeded hash. Pass two moves each bucket to the
    task of its number, Fisher-Yates shuffles it there and deals its records. The buckets in a row are one
    random order of all records; shards are stretches of that order whose counts are at most one apart (law
    ``rows``), whatever the sizes of groups and texts. A task's records are in the order of their slots, so
    that ``write_shards`` needs no further shuffle.

    Rows with null columns, null texts, empty texts and repeated rows are records like others; an empty
    table gives an empty result. Columns named shard, slot or law are replaced. Without ``bucket_bytes`` there are
    about MANY buckets of LEAST_BYTES to MOST_BYTES of text.
    """
    df = df.drop("shard", "slot", "law")
    total = df.agg(F.sum(record_size(text)).alias("bytes")).first()["bytes"] or 0
    buckets = int(total // (bucket_bytes or min(MOST_BYTES, max(LEAST_BYTES, total // MANY)))) + 1
    names = df.columns
    place, bucket = unused(names, "__place"), unused(names, "__bucket")
    scattered = scatter(df, buckets, seed, place)

    def by_place(a: Column, b: Column) -> Column:
        return F.signum(a[place] - b[place]).cast("int")

    drawn = (
        scattered.repartitionById(buckets, F.col(bucket))
        .groupBy(F.col(bucket).alias("__bucket"))
        .agg(F.array_sort(F.collect_list(F.struct(place, *names)), by_place).alias("__records"))
        .select("__bucket", F.shuffle("__records", seed).alias("__records"))
    )
    starts = bucket_starts(scattered, bucket)
    placed = drawn.join(F.broadcast(starts) if buckets <= 1_000_000 else starts, "__bucket")
    dealt = placed.select("__first", "__all", F.posexplode("__records").alias("__at", "__record"))
    position, most = F.col("__first") + F.col("__at"), F.expr(f"__all div {shards}")
    larger = F.expr(f"__all % {shards}")  # shards that have one record more, the first ones
    edge = larger * (most + 1)
    rest = F.expr(f"(__first + __at - (__all % {shards}) * (__all div {shards} + 1)) div greatest(__all div {shards}, 1)")
    shard = F.when(position < edge, F.expr(f"(__first + __at) div (__all div {shards} + 1)")).otherwise(larger + rest)
    start = F.when(position < edge, F.col("shard") * (most + 1)).otherwise(edge + (F.col("shard") - larger) * most)
    return dealt.withColumn("shard", shard.cast("int")).select(
        *[F.col("__record")[c].alias(c) for c in names],
        F.lit("rows").alias("law"),
        "shard",
        (position - start).cast("long").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard as the folder shard=N of Parquet files below ``path``, in the pass that shuffles the buckets.

    A task writes one bucket, so the files of a shard, by name, hold its records in the order of their slots.
    """
    sharded.write.partitionBy("shard").parquet(path)


def op5_shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return shuffle_into_shards(docs).select(
        "doc_id",
        record_size().alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"),
        "law",
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
