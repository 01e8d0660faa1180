"""Session set-up and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Paths handed out and not yet deleted, by application.
_GIVEN: dict[str, list[str]] = {}
_KEPT: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local session gets a temporary one; a cluster has none, which is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _LOCAL:
            _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="tessera-")
        folder = _LOCAL[sc.applicationId]
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path below the shared folder, deleted by ``clean``, or with ``keep`` when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (_KEPT if keep else _GIVEN).setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: computed once, kept if executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession, since: int = 0) -> None:
    """Delete the written tables and stores handed out (after the first ``since``); results that still read them must be stored before."""
    paths = _GIVEN.get(spark.sparkContext.applicationId, [])
    while len(paths) > since:
        remove(spark, paths.pop())


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete at its end what was handed out within it."""
    since = len(_GIVEN.setdefault(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        clean(spark, since)


def _at_exit() -> None:
    with contextlib.suppress(Exception):
        spark = SparkSession.getActiveSession()
        if spark is not None:
            clean(spark)
            for path in _KEPT.get(spark.sparkContext.applicationId, []):
                remove(spark, path)
            if spark.sparkContext.applicationId in _LOCAL:
                remove(spark, _LOCAL[spark.sparkContext.applicationId])


atexit.register(_at_exit)
