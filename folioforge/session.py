"""Session factory, lineage cutting and input loading."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "folioforge", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every operator here assumes: UTC, ANSI and AQE on.

    ``conf`` keys use ``__`` for dots.  An existing session is returned as it is.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


ROOT = Path(__file__).resolve().parent.parent


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once a context.

    Nothing to do where it is installed or its folder is on the PYTHONPATH that workers
    inherit; else the driver serves it to them as a zip file.
    """
    context = spark.sparkContext
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    installed = "site-packages" in ROOT.parts or ROOT in paths
    if installed or getattr(context, "_folioforge_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="folioforge-")) / "folioforge.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted((ROOT / "folioforge").rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    context.addPyFile(str(path))
    context._folioforge_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The folder is that of :func:`shared_folder`.  The files outlive lost executors.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset one is made in local mode, as in tests; on a cluster a folder of one
    machine would lose data, so there it is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all machines share")
    if not hasattr(context, "_folioforge_folder"):
        context._folioforge_folder = "file://" + tempfile.mkdtemp(prefix="folioforge-checkpoint-")
    return context._folioforge_folder


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores, before costly work on few bytes that AQE would leave to one task."""
    spark = df.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a data directory."""
    ship_package(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
