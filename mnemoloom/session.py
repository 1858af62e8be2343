"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings the operators rely on. They are only set where the
# session has not been given a value of its own.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Explodes here are of arrays computed from texts; a filter inferred from the explode would
    # compute each of them a second time, and ahead of any repartitioning.
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
    # State of streams outside the heap, with timers and several values per key.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Merge sessions map-side, so one hot key does not ship every event.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def get_spark(app: str = "mnemoloom", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session. `master` is left to spark-submit on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Rows in a task's hash maps and sorts take some thirty times the bytes of their shuffle files, so a task reads few of
# these, and few of a scan; what a task holds then depends on these sizes and not on the size of the tables.
_SHARES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.files.maxPartitionBytes": "32m"}
# Input bytes for each partition that a shuffle starts with; adaptive execution joins those that turn out small.
BYTES_PER_SHUFFLE = 4 << 20
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def tune(spark: SparkSession, path: str | None = None) -> SparkSession:
    """Apply the runtime settings to a session somebody else created; with the folder of the input, also tasks of bounded shares of it."""
    explicit = {k for k, _ in spark.sparkContext.getConf().getAll()}
    wanted = dict(_RUNTIME)
    if path is not None:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        wanted |= _SHARES | {_INITIAL: str(max(least, -(-_bytes_of(spark, path) // BYTES_PER_SHUFFLE)))}
    for key, value in wanted.items():
        if key not in explicit:
            spark.conf.set(key, value)
    return spark


def _bytes_of(spark: SparkSession, path: str) -> int:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        # One machine is the whole cluster here, so its own folder is shared.
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="mnemoloom-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, reachable by every executor."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise one round of an iteration in the shared checkpoint folder and forget its lineage.

    The result is on reliable storage, so a lost executor costs a re-read and not a replay.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Writes started inside leave no shuffle files: what they wrote is read from now on, and their shuffles never again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """Write a table that is read several times into the shared folder, and read it back.

    Columnar, so each reader takes the columns it needs, and of a size the optimizer knows.
    """
    folder = shared_folder(df.sparkSession, "stored")
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote and nothing will read again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not folder.rsplit("/", 1)[1].startswith("stored-"):
                raise ValueError(f"{folder} was not written by stored()")
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# Inputs beyond this size are spread well enough by their own splits, however many cores there are.
SMALL_BYTES = 4 << 30
BYTES_PER_CORE = 16 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of a small input that one or two splits would keep to themselves.

    Only for scans feeding heavy per-row work. The optimizer's estimate of the scan decides;
    an input of any size keeps the splits it has.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= min(cores * BYTES_PER_CORE, SMALL_BYTES):
        return df
    return df.repartition(cores, *keys)
