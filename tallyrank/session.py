"""A session with the settings that results depend on, and the shared folder that its tables go to."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .files import Folder

#: Spark's setting by which an execution's shuffle files go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The open scopes of this thread (or task of an event loop): another one's tables don't go with them.
_scopes: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


def get_session(app: str = "tallyrank", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    wanted = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **settings}
    for key, value in wanted.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    broadcast_by_measure(spark)
    return spark


def broadcast_by_measure(spark: SparkSession) -> None:
    """Let joins broadcast a side by the size it turned out to have, not by that of the files it is read from.

    Parquet of repeated terms is many times smaller than its rows, and the driver has to hold
    what is broadcast. The session's threshold stays the one for measured sizes; hints stay as they are.
    """
    name, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(name) != "-1":
        if spark.conf.get(adaptive, None) is None:
            spark.conf.set(adaptive, spark.conf.get(name))
        spark.conf.set(name, "-1")


def ship(spark: SparkSession) -> None:
    """Send this package to the workers with the job, for clusters where it isn't installed."""
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tallyrank-code-")) / "tallyrank.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where the session sets none, a local master gets a temporary folder and a cluster a RuntimeError:
    a folder of one machine would lose what is written on the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyrank-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path of this application, inside the innermost open scope."""
    return "/".join([shared_dir(spark), spark.sparkContext.applicationId, *_scopes.get(), f"{name}-{uuid.uuid4().hex}"])


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is removed at the end; results have to be stored outside."""
    inner = (*_scopes.get(), f"scope-{uuid.uuid4().hex}")
    token, where = _scopes.set(inner), "/".join(inner)
    try:
        yield
    finally:
        _scopes.reset(token)
        Folder(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}").remove(where)


def release(spark: SparkSession) -> None:
    """Remove all that this application has stored; DataFrames that read it are void afterwards."""
    Folder(spark, shared_dir(spark)).remove(spark.sparkContext.applicationId)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once, as Parquet, to the shared folder, and read again.

    Its lineage ends there, a lost executor takes nothing with it, and later joins know its
    size when they are planned. What was shuffled on the way is removed as soon as it is written, not when
    the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what stored() has written for these DataFrames, which are void afterwards."""
    for df in tables:
        root = shared_dir(df.sparkSession)
        Folder(df.sparkSession, root).remove(df.stored_at[len(root) + 1 :])


checkpointed = stored
