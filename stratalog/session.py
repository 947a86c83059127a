"""Session settings, and the shared scratch folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


MIB = 1024 * 1024
SHUFFLE_PARTITION_BYTES = 256 * MIB
MAX_SHUFFLE_PARTITIONS = 50_000
MAX_SCAN_TASKS = 100_000


def sizing(
    input_bytes: int,
    partition_bytes: int = SHUFFLE_PARTITION_BYTES,
    max_shuffle_partitions: int = MAX_SHUFFLE_PARTITIONS,
    max_scan_tasks: int = MAX_SCAN_TASKS,
) -> dict[str, str]:
    """Scan and shuffle settings for an input of that size.

    Deduplication shuffles whole rows, so partitions must fit a task that sorts and spills. A shuffle
    has scan tasks times partitions blocks, which the two limits bound: 12 TB is where partitions of
    ``partition_bytes`` reach the default limit and begin to grow, to 2 GB at 100 TB. Raise it where
    the shuffle service bears more blocks. Adaptive execution merges what turns out small, but never
    splits what was planned too large.
    """
    partitions = min(max(-(-input_bytes // partition_bytes), 200), max_shuffle_partitions)
    split = max(128 * MIB, -(-input_bytes // max_scan_tasks))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(split),
    }


def build_session(
    app: str = "stratalog",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    input_bytes: int | None = None,
) -> SparkSession:
    """A session with adaptive execution on.

    On a cluster leave ``master`` unset and give the size of the input; ``shuffle_partitions`` is
    for tests, where a few are enough.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.parquet.compression.codec", "snappy")
        # Plans are made of many small columns; noting the call site of each doubles the build time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
        builder = builder.config("spark.ui.showConsoleProgress", "false")
    for key, value in sizing(input_bytes).items() if input_bytes else ():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder that the cluster names.

    Only where none is named (a local test) does a temporary folder take its place. A named folder
    is reached by all executors, so a table written there survives the loss of any of them.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stratalog-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
