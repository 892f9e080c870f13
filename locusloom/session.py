"""Session settings and the shared working folder.

Nothing here is needed to use the operators: they run on any session. ``configure``
sets runtime SQL options that make the plans better on large inputs.
"""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import SparkSession

#: Tasks of a core that short partitions are joined down to: with hardly more than one, a few late ones double a stage's time.
TASKS_PER_CORE = 3
_FEWEST = "spark.sql.adaptive.coalescePartitions.minPartitionNum"
_ESTIMATED, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"

# Runtime options: Spark's default and the value used here. ``configure`` changes an option only
# where the session still has the default.
_RUNTIME = {
    # Re-plan from measured sizes: joins turn into broadcasts only when the built side was
    # measured to be small, and skewed partitions are split.
    "spark.sql.adaptive.enabled": ("true", "true"),
    "spark.sql.adaptive.skewJoin.enabled": ("true", "true"),
    "spark.sql.adaptive.coalescePartitions.enabled": ("true", "true"),
    # Split a skewed partition even where the next join then needs a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": ("false", "true"),
    # One person's array calls are about 25 MB; Spark checks the measured size before broadcasting. The limit for estimates stays
    # as it is: they follow the bytes of compressed files, a tenth of what the rows take in memory.
    _MEASURED: (None, str(64 * 1024 * 1024)),
    # A join on (chromosome, position, ref, alt) may reuse a (chromosome, position)
    # partitioning, so the wide panel rows are shuffled once for both user joins.
    "spark.sql.requireAllClusterKeysForCoPartition": ("true", "false"),
    # Tables in chromosome folders are written without first sorting the (51 times longer) rows.
    "spark.sql.maxConcurrentOutputFileWriters": ("0", "32"),
}


def build_session(app_name: str = "locusloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session with the options above, in UTC; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, (_, value) in _RUNTIME.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime options to an existing session, keeping what its owner has set."""
    for key, (default, value) in _RUNTIME.items():
        if key == _MEASURED and spark.conf.get(_ESTIMATED) != "10485760b":
            continue  # the owner's limit holds for both
        if value != default and spark.conf.get(key) == default:
            spark.conf.set(key, value)
    if spark.conf.get(_FEWEST) is None:
        spark.conf.set(_FEWEST, str(TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a missing
    setting is an error, because a machine-local folder is lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="locusloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Staging:
    """Owner of the tables that are staged inside its ``with`` block: ``drop`` removes them.

    Frames that read them are lazy, so the owner drops them when it is done with those frames, and not at the block's end.
    An error inside the block drops them at once. Blocks may be nested; the inner one then owns its tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/staged/owner-{uuid.uuid4().hex}"

    def __enter__(self) -> Staging:
        self._before = _owner.set(self.folder)
        return self

    def __exit__(self, kind, error, trace) -> None:
        _owner.reset(self._before)
        if kind is not None:
            self.drop()

    def drop(self) -> bool:
        """Remove the tables; False where there were none."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


_owner: ContextVar[str | None] = ContextVar("owner", default=None)


def staged_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, or its owner's part of it, for one staged table."""
    return f"{_owner.get() or shared_folder(spark) + '/staged'}/{name}-{uuid.uuid4().hex}"


def stage(df, name: str, partition_by: list[str] | None = None):
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with a written table, so a lost executor does not mean parsing the
    inputs again, and a frame that is used several times is computed once. Spark also knows
    the table's size when it plans, so an aggregate's short result is broadcast exactly when
    it is below the threshold and the large side then needs no shuffle.
    """
    spark = df.sparkSession
    path = staged_path(spark, name)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
