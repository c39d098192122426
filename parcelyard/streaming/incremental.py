"""Incremental builds as streams: packages arrive as files, the keyed table is kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelyard.operators.dedup import first_by
from parcelyard.scratch import delete


def read_packages(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stream of package rows from a folder of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, keys: list[str], order: str, parts: int = 16) -> StreamingQuery:
    """Keep in the folder ``table`` the row of greatest ``order`` for each key, over all batches so far; of equal ones the greatest row.

    The table is dealt into ``parts`` by a hash of the key. A batch touches the parts that its keys are in: each gets a new
    version (``part=<p>/v=<batch>``) of its last one and the batch, and its versions but the last two are deleted. A batch
    that is run again after a failure writes the same versions again, so results don't depend on retries. Read with read_table.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).persist()
        try:
            touched = [r[0] for r in fresh.select("_part").distinct().collect()]
            old = {p: [v for v in versions(spark, f"{table}/part={p}") if v < number] for p in touched}
            rows = fresh
            for p in touched:
                if old[p]:
                    before = spark.read.schema(batch.schema).parquet(f"{table}/part={p}/v={old[p][-1]}")
                    rows = rows.unionByName(before.withColumn("_part", F.lit(p)))
            kept = first_by(rows, keys, [F.desc(order), F.desc(F.struct(*batch.columns))])
            staged = f"{table}/_staged-{number}"
            kept.repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(staged)
            for p in touched:
                delete(spark, f"{table}/part={p}/v={number}")
                move(spark, f"{staged}/_part={p}", f"{table}/part={p}/v={number}")
                for v in old[p][:-1]:
                    delete(spark, f"{table}/part={p}/v={v}")
            delete(spark, staged)
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions that are in a part's folder, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v="))


def move(spark: SparkSession, old: str, new: str) -> None:
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"cannot move {old}")


def read_table(spark: SparkSession, table: str, schema, parts: int = 16) -> DataFrame:
    """The last version of every part of a table that upsert_stream keeps."""
    last = [f"{table}/part={p}/v={v[-1]}" for p in range(parts) if (v := versions(spark, f"{table}/part={p}"))]
    return spark.read.schema(schema).parquet(*last) if last else spark.createDataFrame([], schema)


def finished(primary: DataFrame, filelists: DataFrame, other: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stream of packages of which all three parts have arrived within ``delay`` (event time column ``ts`` on each)."""
    a = primary.withWatermark("ts", delay).alias("a")
    b = filelists.withColumnRenamed("ts", "fil_ts").withWatermark("fil_ts", delay).alias("b")
    c = other.withColumnRenamed("ts", "oth_ts").withWatermark("oth_ts", delay).alias("c")
    near = lambda t: (F.col(t) >= F.col("a.ts") - F.expr(f"INTERVAL {delay}")) & (F.col(t) <= F.col("a.ts") + F.expr(f"INTERVAL {delay}"))
    first = a.join(b, (F.col("a.pkgid") == F.col("b.pkgid")) & near("fil_ts"))
    return first.join(c, (F.col("a.pkgid") == F.col("c.pkgid")) & near("oth_ts")).select("a.*", "b.files", "c.changelogs")
