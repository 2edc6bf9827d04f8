"""Session helpers: the shared scratch folder and tables written into it."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession


# What a session should be built with. Adaptive execution and its skew join are on
# by default and named because the plans rely on them; the last one spares every
# column expression two calls that only serve error messages.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


# A score takes about this many bytes in a shuffle, and this much is a good size
# for one shuffle partition. Beyond the maximum the partitions grow instead: the
# number of shuffle blocks is mappers times partitions.
_SCORE_BYTES = 160
_PARTITION_BYTES = 256 * 1024 * 1024
# Adaptive execution may merge partitions up to this much memory of a task's sorts.
_MERGED_BYTES = 512 * 1024 * 1024
_MAX_PARTITIONS = 100_000


def shuffle_partitions(scores: int, cores: int) -> int:
    """A value for ``spark.sql.shuffle.partitions`` by the number of scores.

    Adaptive execution merges partitions that turn out small but does not split
    ordinary ones that are too large, so the number has to be high enough. The
    default of 200 holds up to about 300 million scores.
    """
    wanted = -(-scores * _SCORE_BYTES // _PARTITION_BYTES)
    return max(cores, min(wanted, _MAX_PARTITIONS))


# Rows that a task sorts for windows take this many times their bytes in a shuffle: they are
# not compressed, and the next sort fills while a window still holds the rows of the last one.
SORTED = 8


@contextmanager
def sized_shuffles(spark: SparkSession, scores: int, widths: int = 1) -> Iterator[None]:
    """At least as many shuffle partitions as so many scores need, for the jobs inside.

    ``widths`` is how many times the usual bytes a row takes: ``SORTED`` where tasks sort
    the rows, so that a partition stays in memory whatever the session's number is. Nor does
    adaptive execution then merge partitions into larger ones.
    """
    name, merged = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before, advised = spark.conf.get(name), spark.conf.get(merged)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(advised)
    spark.conf.set(name, str(shuffle_partitions(scores * widths, int(before))))
    spark.conf.set(merged, f"{min(size, max(1, _MERGED_BYTES // widths))}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)
        spark.conf.set(merged, advised)


# folders of local sessions without the setting, by application
_local_folders: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder of its own;
    on a cluster a missing setting is an error, because a machine-local folder
    would not outlive the executor that wrote it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    # local-cluster has executors of its own
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    # a running session refuses to have this setting changed
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="tallyboard-")
    return _local_folders[application]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the scratch folder nobody has used yet."""
    return f"{scratch_folder(spark)}/tallyboard/{label}-{uuid.uuid4().hex}"


# smaller files than the default's for little time, which higher levels take more of
STORED_CODEC, _LEVEL = "zstd", "1"
# keys and points hardly repeat: a dictionary of them is made in vain, and files get larger
_UNREPEATED = re.compile(r"id|((bonus|pass|acc|tech)_)?pp(_\d+)?")


def stored_options(df: DataFrame) -> dict[str, str]:
    """How the rows of stages and stored tables are written."""
    plain = [c for c in df.columns if _UNREPEATED.fullmatch(c)]
    return {
        "compression": STORED_CODEC,
        "parquet.compression.codec.zstd.level": _LEVEL,
        **{f"parquet.enable.dictionary#{c}": "false" for c in plain},
    }


# paths of the stages that the innermost ``own_stages`` removes
_owned: ContextVar[list[str] | None] = ContextVar("owned stages", default=None)


@contextmanager
def own_stages(spark: SparkSession) -> Iterator[None]:
    """Remove the stages written inside once the block is left.

    What is computed from them has to be written within the block, too.
    """
    stages: list[str] = []
    before = _owned.set(stages)
    try:
        yield
    finally:
        _owned.reset(before)
        for stage in stages:
            path = spark._jvm.org.apache.hadoop.fs.Path(stage)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of what is written inside once it is written.

    Otherwise they stay until the driver collects its garbage, so that those of all stages of
    a job lie on the disks together. Nothing reads them again: what is written is read instead.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder as Parquet and read it back.

    Cuts the lineage at a stage boundary. Unlike ``checkpoint()`` the written
    table is columnar, so the stages after it still prune columns and push
    filters, and it survives the loss of any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    stages = _owned.get()
    if stages is not None:
        stages.append(path)
    with passing_shuffles(spark):
        df.write.options(**stored_options(df)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measure(
    df: DataFrame, label: str, metrics: Mapping[str, Column]
) -> tuple[DataFrame, dict[str, object]]:
    """``materialise`` with aggregates of the rows taken as they are written.

    They cost no job of their own. They are observed on top of the plan, so in the stage
    that writes, where Spark counts each partition once, however often it is tried.
    """
    observation = Observation()
    observed = df.observe(observation, *[metric.alias(name) for name, metric in metrics.items()])
    stored = materialise(observed, label)
    return stored, observation.get


def expire_stages(spark: SparkSession, older_than: float, now: float | None = None) -> list[str]:
    """Remove stages in which nothing was written for so many seconds; their names.

    For those that no ``own_stages`` removes. Results still read from them must be younger.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_folder(spark)}/tallyboard")
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    limit = ((time.time() if now is None else now) - older_than) * 1000
    removed = []
    for stage in system.listStatus(root) if system.exists(root) else []:
        if last_written(system, stage) < limit:
            system.delete(stage.getPath(), True)
            removed.append(stage.getPath().getName())
    return removed


def last_written(system, folder) -> int:
    """Milliseconds of the newest change in a folder, its files included."""
    newest = folder.getModificationTime()
    files = system.listFiles(folder.getPath(), True)
    while files.hasNext():
        newest = max(newest, files.next().getModificationTime())
    return newest
