"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers, once a session, so that they needn't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_mhqa_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="mhqa-package-")) / "mhqa_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
        for path in sorted(root.rglob("*.py")):
            file.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._mhqa_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the directory ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    A cluster names it in ``spark.checkpoint.dir``; where the setting is absent a temporary folder is made once a session, but only for a local master: on a cluster each
    machine would have its own (RuntimeError).
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="mhqa-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


_TABLES: list[str] = []


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written once, as Parquet, to a new table in the shared checkpoint folder, and read again.

    Several readers then share one computation, columns are pruned on reading, the lineage is cut, and a lost executor costs nothing. The
    table stays, since plans that read it may run at any time, until ``clear``.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the tables that ``materialise`` has made in this process; their number. No DataFrame that reads one may be used afterwards."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    count = 0
    while _TABLES:
        path = path_of(_TABLES.pop())
        count += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return count
