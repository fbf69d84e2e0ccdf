"""SparkSession helpers.

Library code never creates a session; callers pass one in. ``get_session`` is
for tests, the bench and scripts. Settings chosen for correctness and scale:

* session time zone pinned to UTC so ``to_date`` of timestamps is stable;
* AQE on, with partition coalescing and skew-join splitting, so hot keys
  (a brand or store holding a third of all rows) are split at runtime;
* the Spark UI is off (no server ports).
"""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "upshelf", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the project defaults."""
    master = master or os.environ.get("UPSHELF_MASTER", "local[8]")
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf["spark.driver.memory"] = os.environ.get("UPSHELF_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; set a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is left
    alone. Only in local runs (tests) where nothing is configured do we point
    it at a fresh temporary folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="upshelf-ckpt-")
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def release(spark: SparkSession) -> None:
    """Let the driver drop the plans of finished steps, and Spark's cleaner the shuffle files and broadcasts that they
    made: it does so once the driver has collected them. The driver's heap shrinks to what is still in use."""
    gc.collect()
    # the JVM is told of objects that Python let go by a worker that looks once a second: told here, they go now
    gone = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    while gone and isinstance(gone[-1], tuple):
        try:
            client, target = gone.pop()
        except IndexError:
            break
        client.garbage_collect_object(target, False)
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str | None:
    """Have the driver's JVM give back the memory that it freed outside its heap (compiled plans, buffers): it stays with
    the C library's allocator else. JVMs without this command keep it (None)."""
    sc = spark.sparkContext
    with contextlib.suppress(Py4JError):
        args = sc._gateway.new_array(sc._jvm.java.lang.Object, 4)
        args[0], args[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # the server's own class is closed to callers: called by its interface
        methods = sc._jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods()
        invoke = next(m for m in methods if m.getName() == "invoke")
        return invoke.invoke(sc._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
