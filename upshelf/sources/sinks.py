"""Sinks (S12-S16) and lineage cutting.

Intermediate tables are written as Parquet under the folder the cluster names
in ``spark.checkpoint.dir`` (shared storage on a cluster) and read back, which
cuts lineage and survives executor loss, unlike caching.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from upshelf.session import ensure_checkpoint_dir, release

_MATERIALISED: dict[tuple, tuple] = {}


def table_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/upshelf/{name}"


def input_version(spark: SparkSession, folder: str) -> str:
    """A short hash of the names, lengths and times of the files below ``folder``: tables written from rewritten
    inputs get names of their own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(seen)).encode()).hexdigest()[:12]


def materialise(spark: SparkSession, df_fn, name: str, key: tuple = (), partition_by: list[str] | None = None,
                range_by: list[str] | None = None, bucket_by: list[str] | None = None) -> DataFrame:
    """Write ``df_fn()`` once per (session, name, key) and return a DataFrame
    reading the written table.

    ``range_by`` deals the rows to the tasks by ranges of these columns (a
    sample sets the ranges, so a heavy value is split over tasks) and sorts
    them; with ``partition_by`` each task then writes few folders.
    ``bucket_by`` hashes the rows into as many buckets as the session has
    shuffle partitions, kept as a table of the session's catalog: joins on
    these columns then need no exchange of it."""
    k = (spark.sparkContext.applicationId, name, key)
    if k not in _MATERIALISED:
        h = hashlib.sha1(repr(k).encode()).hexdigest()[:12]
        path = table_path(spark, f"{name}-{h}")
        df = df_fn()
        schema = df.schema
        if range_by:
            df = df.repartitionByRange(*range_by).sortWithinPartitions(*range_by)
        if bucket_by:
            table = f"upshelf_{name}_{h}".replace("-", "_")
            # one file a bucket: rows are dealt to the buckets' tasks before they are written
            n = int(spark.conf.get("spark.sql.shuffle.partitions"))
            w = df.repartition(n, *bucket_by).write.mode("overwrite").bucketBy(n, *bucket_by).format("parquet").option("path", path)
            w.saveAsTable(table)
            _MATERIALISED[k] = (table, None)
        else:
            w = df.write.mode("overwrite")
            (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
            _MATERIALISED[k] = (path, schema)
        # a query writes dozens of tables: without this their plans and shuffle files stay until the driver's heap is full
        del df, w
        release(spark)
    at, schema = _MATERIALISED[k]
    return spark.table(at) if schema is None else spark.read.schema(schema).parquet(at)


def write_table(df: DataFrame, name: str) -> None:
    """Create-or-replace a catalogue table."""
    df.write.mode("overwrite").saveAsTable(name)


def write_weekly_base(base: DataFrame, path: str) -> None:
    """The weekly base partitioned by week, rows in ranges of (week, product, store): tasks get equal shares, so a
    heavy week is split over many tasks, and rows are sorted for min/max skipping."""
    cols = ["week_start", "product_number", "store_id"]
    base.repartitionByRange(*cols).sortWithinPartitions(*cols).write.mode("overwrite").partitionBy("week_start").parquet(path)


def write_compare(compare: DataFrame, path: str) -> None:
    """One dataset of compare rows partitioned by campaign / metric / grain
    (instead of one file per combination)."""
    cols = [c for c in ["booking_number", "metric", "level"] if c in compare.columns]
    compare.write.mode("overwrite").partitionBy(*cols).parquet(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """Small report as one CSV file with a header (reports are one row per
    campaign or feature, so a single partition is bounded)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str, column: str = "line", order: list[str] | None = None, partitions: int | None = None) -> None:
    """Text lines (one column). With ``order`` the rows are dealt to the
    files by ranges of these columns and sorted inside each, so the files in
    the order of their names hold the lines in order, however many there are.
    ``readers.read_lines`` reads them back with their place."""
    if order:
        df = df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    else:
        df = df.coalesce(1)
    df.select(column).write.mode("overwrite").text(path)
