"""The few places where a plan has to touch the cluster: cuts of lineage and the spread of a small file."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
log = logging.getLogger(__name__)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's own setting, a local one only where unset and on one machine.

    What the cluster names is taken as it is; one that looks private to a machine is named in a warning.
    """
    context = spark.sparkContext
    one_machine = context.master.startswith("local")
    now = context._jsc.sc().getCheckpointDir()
    path = now.get() if now.isDefined() else spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if not path:
        if not one_machine:
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="notaflux-checkpoint-")
    if not one_machine and looks_private(path):
        log.warning("%s is %s: unless every machine mounts it, the loss of one loses the cuts", CHECKPOINT_KEY, path)
    if not now.isDefined():
        context.setCheckpointDir(path)
    return path


def looks_private(path: str) -> bool:
    """Whether a path lies in the temporary space of one machine."""
    plain = "/" + path.removeprefix("file:").lstrip("/")
    own = (tempfile.gettempdir(), "/tmp", "/var/tmp", "/dev/shm")
    return (path.startswith(("file:", "/"))) and any(plain == o or plain.startswith(f"{o}/") for o in own)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` now, once, as a compressed table in the shared folder and go on from the files.

    Used where an expensive stage is read by several branches: without the cut each branch would run it again. The call
    runs a job, also while a plan is only being built. The files are in shared storage, so the loss of an executor loses
    nothing; they go at the end of the enclosing ``cuts`` block, else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/notaflux-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_drop_written, spark, 0)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


@contextmanager
def cuts(spark: SparkSession) -> Iterator[None]:
    """Delete the files of the cuts made inside at its end: for sessions that outlive their queries. Results must have
    been written or collected by then."""
    before = len(_written)
    try:
        yield
    finally:
        _drop_written(spark, before)


def _drop_written(spark: SparkSession, keep: int) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while len(_written) > keep:
            path = jvm.org.apache.hadoop.fs.Path(_written.pop())
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # the JVM may have ended first
        del _written[keep:]


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: for a small file that a heavy stage follows.

    Tables of more files than cores are left as they are, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
