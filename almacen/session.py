"""Session and shared-storage helpers.

Intermediate tables are written below the directory the cluster names in
``spark.checkpoint.dir`` (shared storage that survives executor loss). Only a
local session without that setting, as in tests, gets a folder of its own; on
a cluster a missing setting is an error.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}
_SCRATCH: dict[str, list[str]] = {}
_RELEASED: dict[str, int] = {}
LOCAL_DRIVER_MEMORY = "8g"


def build_session(master: str | None = "local[8]", app: str = "almacen",
                  shuffle_partitions: int | None = 8,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session for local runs and tests; ``master=None`` keeps the master and
    ``shuffle_partitions=None`` the partition count that spark-submit or the
    cluster's defaults provide."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local["):         # elsewhere the launcher has sized the driver already
            builder = builder.config("spark.driver.memory", LOCAL_DRIVER_MEMORY)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def app_id(spark: SparkSession) -> str:
    """Identifier of the running application."""
    return spark.conf.get("spark.app.id", "connect")


def shared_dir(spark: SparkSession) -> str:
    """Base directory for written intermediate tables and checkpoints.

    The cluster's ``spark.checkpoint.dir`` (shared storage); only where that
    is unset in a local session, a private temporary folder is created.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder under master {master!r}")
        base = _LOCAL_FALLBACK.get(app_id(spark))
        if base is None:
            base = _LOCAL_FALLBACK[app_id(spark)] = tempfile.mkdtemp(prefix="almacen-ckpt-")
    return base.rstrip("/")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever storage holds it (nothing if it does not exist)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def file_stamps(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """``(path, bytes, modification time)`` of every data file at or below ``path``,
    read through the storage's own file system, so it works on any of them."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, todo = [], [top]
    while todo:
        for st in fs.globStatus(todo.pop()) or []:
            if st.isDirectory():
                todo += [x.getPath() for x in fs.listStatus(st.getPath())]
            elif not st.getPath().getName().startswith(("_", ".")):
                out.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    return sorted(out)


def release_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables that queries of this application have written.

    Results that are still lazy read them, so call it after the last action.
    """
    _RELEASED[app_id(spark)] = scratch_epoch(spark) + 1
    for path in _SCRATCH.pop(app_id(spark), []):
        remove_path(spark, path)


def scratch_epoch(spark: SparkSession) -> int:
    """How often scratch was released: what was kept there before is gone."""
    return _RELEASED.get(app_id(spark), 0)


def scratch_path(spark: SparkSession, name: str, workdir: str | None = None) -> str:
    """A fresh, unique path for one written intermediate table.

    ``workdir`` (e.g. a build's own folder) keeps intermediates together
    with what they were made for, so removing that folder removes them too;
    without it they go below the shared folder until :func:`release_scratch`.
    """
    if workdir:
        return f"{workdir.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    path = f"{shared_dir(spark)}/almacen-tmp/{app_id(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(app_id(spark), []).append(path)
    return path


_HELD_LOCK = threading.Lock()
_HELD: dict[tuple[str, str], list] = {}


@contextmanager
def held(spark: SparkSession, key: str, value: str):
    """A session setting with ``value`` while queries within are planned and run; threads may be within at the same time."""
    with _HELD_LOCK:
        inside = _HELD.setdefault((app_id(spark), key), [0, None])
        if not inside[0]:
            inside[1] = spark.conf.get(key, None)
            spark.conf.set(key, value)
        inside[0] += 1
    try:
        yield
    finally:
        with _HELD_LOCK:
            inside[0] -= 1
            if not inside[0]:
                spark.conf.unset(key) if inside[1] is None else spark.conf.set(key, inside[1])


def shuffles_dropped(spark: SparkSession):
    """Queries that end within leave no shuffle files behind (else they stay until the driver happens to collect
    garbage), so a chain of written tables never takes the disk of more than one query's shuffles."""
    return held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def file_by_file(spark: SparkSession):
    """Scans planned within read each file (or piece of a large one) in a task of its own, never two that are not neighbours."""
    return held(spark, "spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))


#: Codec of large tables that are written once and read a few times: a third less disk than Spark's default.
DENSE = "zstd"


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite", codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and return a DataFrame reading it back.

    Reading back cuts the lineage: later stages start from the files, not
    from a recomputation of everything above. Nothing needs the shuffles
    that made the table any more, so their files go as soon as it is written.
    """
    w = df.write.mode(mode)
    if codec:
        w = w.option("compression", codec)
    if partition_by:
        w = w.partitionBy(*partition_by)
    with shuffles_dropped(df.sparkSession):
        w.parquet(path)
    return df.sparkSession.read.parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
