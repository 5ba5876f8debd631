"""SparkSession construction and checkpoint-directory handling."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

# Defaults that hold from a laptop up to a large cluster.  Shuffle partition
# count is the only knob that must follow the data size: at scale set it so
# that one shuffle partition is ~128-256 MB (AQE then coalesces small ones
# and splits skewed ones).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Size-checked broadcast: the planner broadcasts a join side only when its
    # estimated (static) or measured (AQE, after a shuffle) size is below this.
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Remove checkpoint files once the materialised data is no longer referenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def sized_conf(input_bytes: int, cores: int, target_partition_mb: int = 256) -> dict:
    """Shuffle sizing for a run over ``input_bytes`` on ``cores`` executor cores.

    One shuffle partition per ~``target_partition_mb`` of input (so a reduce task
    fits in executor memory without spilling), never fewer than 2 waves of tasks
    across the cores; AQE then coalesces small partitions and splits skewed
    ones.  E.g. 100 TB on 4,000 cores -> 409,600 partitions.
    """
    parts = max(2 * cores, -(-input_bytes // (target_partition_mb * 2**20)))
    return {"spark.sql.shuffle.partitions": str(parts),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{target_partition_mb}m",
            "spark.sql.files.maxPartitionBytes": f"{min(target_partition_mb, 512)}m"}


def get_session(master: str | None = None, app: str = "chainlens", conf: dict | None = None) -> SparkSession:
    """Return (or create) a session with :data:`DEFAULT_CONF` applied.

    On a cluster pass ``master=None`` and let ``spark-submit`` decide.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``SparkContext`` has a reliable checkpoint directory.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that setting
    always wins.  Only in a single process (a ``local`` master: unit tests, local
    runs) do we create a scratch folder of our own; a cluster without the setting
    is an error, as executors could not read each other's files.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session: the server owns its checkpoint directory
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="chainlens-ckpt-")
        _remove_at_exit(configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def _remove_at_exit(folder: str) -> None:
    """Scratch of a local run goes when the process ends."""
    atexit.register(shutil.rmtree, folder, ignore_errors=True)


def materialize(df):
    """Reliable checkpoint of ``df`` (eager) in the session's checkpoint directory.

    Used only where several results are written one after the other from the
    same rows (the dashboard bundle).
    Never a local checkpoint: the files live in the shared folder the cluster
    names in ``spark.checkpoint.dir``, so they survive the loss of an executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
