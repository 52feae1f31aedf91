"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings the library assumes. Timestamps are compared with DuckDB and
# written to Parquet, so the session time zone is pinned to UTC.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A lake series is tens to hundreds of rows; Arrow batches of whole
    # groups stay small, but cap the batch for wide pixel groups.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
    # Every keyed operation here is partitioned by lake id (high cardinality,
    # one row per date): joins on (id, date) may reuse that partitioning
    # instead of reshuffling both sides on the full key.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def get_session(master: str | None = None, app: str = "lakeshift",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    On a cluster, pass ``master=None`` and let spark-submit decide; locally,
    ``master="local[8]"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Only when the setting is absent and the master is local (tests) do we
    create a folder of our own and register it; on a cluster the setting must
    point at shared storage, and a run without it is refused.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="lakeshift-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def cut_lineage(df):
    """Reliable checkpoint (never ``localCheckpoint``): survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df, name: str):
    """``df`` written once as Parquet in the shared folder and read back.

    Unlike a checkpoint it keeps columns and pushed filters, so that readers
    of a part of it read only that part.
    """
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kernel_partitions(spark: SparkSession, partitions: int | None = None) -> int:
    """Task count for CPU-bound grouped pandas kernels.

    AQE sizes shuffle partitions by bytes; a thin (id, date, value) frame
    would be packed into a few tasks although each lake costs milliseconds
    of Python. An explicit count (never coalesced) keeps every core busy:
    the larger of the shuffle partitions and the default parallelism.
    """
    if partitions:
        return int(partitions)
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, spark.sparkContext.defaultParallelism)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``lakeshift`` importable in the Python workers (once per context).

    Pandas UDFs, ``applyInPandas`` and ``mapInArrow`` functions defined in the
    package are pickled by reference, so the workers must import it. Like
    ``spark-submit --py-files``, the package is zipped on the driver and
    distributed by Spark with ``addPyFile``.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    fd, archive = tempfile.mkstemp(prefix="lakeshift-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def ship_to_active() -> None:
    """``ship_package`` for the active session (for Column-level helpers)."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)
