"""Helpers shared by the operators: input hygiene, shared tables, components."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upshelf.session import ensure_checkpoint_dir, release  # noqa: F401  (release: for the operators)

#: Rows per Arrow batch: whole texts travel in batches, so this bounds a worker's memory.
ARROW_ROWS = 500


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, cast to the given types, under their own names.

    Extra columns (clashing names included) fall away here; a column that the
    table lacks becomes null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c)
                       for c, t in cols.items()])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def odd_ids(docs: DataFrame, nulls: bool = True) -> bool:
    """Whether a doc_id stands in more than one row or, with ``nulls``, is null."""
    odd = F.when(F.col("doc_id").isNull(), F.lit(nulls)).otherwise(F.col("n") > 1)
    return not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(odd).isEmpty()


def forget(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more: all that came from them must be written itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parts_for(df: DataFrame, mb: int = 24, least: int = 12, most: int = 200_000) -> int:
    """Partitions so that each holds about ``mb`` MB of the input as Spark estimates it (file sizes
    for file tables); where it has no estimate, the session's number of shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(min(most, max(least, math.ceil(size / (mb << 20)))))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable over undirected (a, b) edges.

    Minimum label propagation with pointer jumping; each round is joins and
    partial aggregates on the edge table, written to the shared folder, until
    no label changes. Only the number of changed labels reaches the driver."""
    e = edges.select("a", "b")
    both = written(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .where("a <> b").distinct(), f"{name}-edges")
    last = labels = written(both.groupBy("a").agg(F.min("b").alias("m"))
                            .select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        seen = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy("a").agg(F.min("label").alias("m")))
        nxt = (labels.join(seen, labels.node == seen.a)
               .select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("over"))
        nxt = written(nxt.join(up, "label", "left")
                      .select("node", "old", F.least("label", F.coalesce("over", "label")).alias("label")),
                      f"{name}-{step}")
        forget(last)
        last = nxt
        if nxt.where("old <> label").isEmpty():
            forget(both)
            return nxt.select("node", F.col("label").alias("component"))
        labels = nxt.select("node", "label")



def pieces(batches, column: int = 1, size: int = 4 << 20):
    """Record batches cut so that the strings of ``column`` hold about ``size`` bytes (one longer text stands alone):
    a worker's memory then follows the bytes, whatever number of rows the session puts in a batch."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
            yield batch.slice(a, b - a)
            a = b
