"""Session helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package through Spark's file server, once per application."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="scholion-"), "scholion.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, names in os.walk(os.path.join(root, "scholion")):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        archive.write(path, os.path.relpath(path, root))
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(application)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of its own only where the setting is absent and all tasks run on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="scholion-checkpoint-")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame, free: bool = False) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor. With ``free``, what no variable refers to any more (the
    shuffle files behind it, older checkpoints) is given back at once."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if free:
        del df
        free_files(out.sparkSession)
    return out


def free_files(spark: SparkSession) -> None:
    """Collect garbage here and in the driver's JVM: Spark deletes shuffle and checkpoint files once their plans are gone,
    which else happens whenever memory runs short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again.

    Like a checkpoint, but the plan forgets where they came from: a checkpoint keeps the size that Spark estimated, joins
    multiply estimates, and after many rounds of joins the planner is busy with numbers of millions of digits.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
