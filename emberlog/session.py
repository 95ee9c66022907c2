"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every operator relies on. All of them can be changed at run time, so they can
# also be applied to a session that somebody else has built.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A batch on its way to Python is held by Spark, as Arrow data and as Python's strings at once, by every task.
    # The default of 64 MB a batch, filled by whole texts, takes hundreds of MB of an executor; 8 MB are no slower.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

# A folder listed by a task of its own costs far more than the listing; a few tasks per core list as fast.
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
MIN_LISTING_TASKS = 64

# Stored bytes per shuffle partition; compressed columns grow a few times when read.
PARTITION_BYTES = 64 << 20
MAX_PARTITIONS = 200_000


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to an existing session."""
    settings = dict(RUNTIME_CONF)
    if getattr(spark, "_jvm", None) is not None:  # a remote session: the cluster's setting stands
        settings[LISTING_TASKS] = str(max(MIN_LISTING_TASKS, 4 * spark.sparkContext.defaultParallelism))
    for key, value in settings.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build(app: str = "emberlog", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or get) a session; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def size_shuffles(spark: SparkSession, path: str) -> SparkSession:
    """Raise (never lower) the number of shuffle partitions to suit the bytes below ``path``.

    Adaptive execution merges partitions that turn out small but cannot split what a fixed
    low number packs together."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:  # a remote session: the cluster's setting stands
        return spark
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    wanted = min(MAX_PARTITIONS, -(-files.getContentSummary(folder).getLength() // PARTITION_BYTES))
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", wanted)
    return spark


def streaming_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session of the same application for stateful streams. The number of state partitions
    is fixed when a stream first starts; two per core suits state that outlives the batches."""
    own = configure(spark.newSession())
    own.conf.set("spark.sql.shuffle.partitions", state_partitions or 2 * spark.sparkContext.defaultParallelism)
    return own


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder the cluster names in spark.checkpoint.dir.

    Only a local-mode session may fall back to a folder of this machine: its executors
    are on this machine too.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="emberlog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
