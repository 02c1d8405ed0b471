"""Session defaults and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "answerloom", master: str | None = None, **extra) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one only for local runs."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="answerloom-checkpoint-")
    context.setCheckpointDir(folder)


#: Frees the shuffle files behind a table when it has been written.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, **held: str) -> Iterator[None]:
    """Settings (dots as double underscores) that hold inside."""
    names = {k.replace("__", "."): v for k, v in held.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def freeing(spark: SparkSession):
    """Tables written inside leave no shuffle files."""
    return settings(spark, **{FREE: "true"})


def _write(df: DataFrame, path: str) -> None:
    with freeing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so a lost executor costs no recompute.

    Rows are stored compressed, and the shuffle files behind them are freed.  The
    size of the files says little of the rows' size, so a plan does not see it: a
    table that compresses well would be broadcast.
    """
    if "void" in df.schema.simpleString():
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    path = scratch_folder(df.sparkSession)
    _write(df, path)
    kept = as_rows(df.sparkSession.read.schema(df.schema).parquet(path), df)
    kept._stored_at = path
    return kept


def as_rows(read: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """A table of files as it is split now, and without their size."""
    schema = (read if like is None else like)._jdf.schema()
    return DataFrame(read.sparkSession._jsparkSession.internalCreateDataFrame(read._jdf.queryExecution().toRdd(), schema, False), read.sparkSession)


def release(*tables: DataFrame) -> None:
    """Remove durable tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_answerloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="answerloom-package-")) / "answerloom.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for module in sorted(root.rglob("*.py")):
            target.write(module, module.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._answerloom_shipped = True


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name beside the checkpoints, where every executor can write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/files-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back.

    The rows then survive a lost executor and are computed once, however often
    they are used; a reader takes only the columns it needs.
    """
    path = scratch_folder(df.sparkSession)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
