"""Session helpers: a tuned local session for tests/bench, and a scratch folder
that lives under the cluster's shared checkpoint directory."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale as well as locally: AQE re-plans joins and
# coalesces shuffle partitions at runtime, skew-join splits hot partitions.
_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "aspectra") -> SparkSession:
    """Local session for tests and the bench.  On a cluster, build the session
    with the cluster's own settings and pass it to the operators instead."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    b = SparkSession.builder.master(master).appName(app_name)
    for k, v in _DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    b = b.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read.
    Only when it is unset (local tests) do we create one ourselves."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="aspectra-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint directory for files that a
    job writes and reads back (derived XML/CSV/JSON inputs, published tables)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/aspectra-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df, eager: bool = True):
    """Materialise ``df`` reliably (survives executor loss) and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def spread(df, factor: int = 2, enough: float | None = None):
    """Round-robin ``df`` over about ``factor`` x cores partitions when it has
    fewer (e.g. one small file = one scan task), so CPU-heavy row work (regex
    chains, the NFKD UDF) uses the whole cluster.  On large inputs the scan
    already has enough partitions and nothing is added (no extra shuffle).  ``enough``
    (partitions per core) leaves a scan alone earlier where the row work is light."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    target = factor * cores
    if df.rdd.getNumPartitions() >= (target if enough is None else enough * cores):
        return df
    return df.repartition(target)


MAX_BROADCAST_ROWS = 100_000


def broadcast_if_small(small, max_rows: int = MAX_BROADCAST_ROWS):
    """Broadcast a per-key table (one row per group / file / class) only after
    checking its size: up to ``max_rows`` rows it is persisted and broadcast,
    so the large side is not shuffled by a key that may hold a third of the
    rows; beyond the bound the ordinary join (AQE, skew-join) is used."""
    small = small.persist()
    if small.limit(max_rows + 1).count() <= max_rows:
        from pyspark.sql import functions as F
        return F.broadcast(small)
    return small
