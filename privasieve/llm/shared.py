"""What the training-data operators share: shared storage, shipped code, and tables."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# White space between words, and a word.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"

_shipped: set[str] = set()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents")


def use_shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to `spark.checkpoint.dir`. Only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder)


def settle(frame: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there: work is not repeated, lost executors lose nothing."""
    use_shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    target = os.path.join(tempfile.mkdtemp(prefix="code-"), "privasieve.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, root))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def held(frame: DataFrame, *columns) -> DataFrame:
    """A select whose columns are worked out once, behind a one-row generator: the optimizer does not copy their
    expressions into the places that use them."""
    return frame.select(F.inline(F.array(F.struct(*columns))))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def code_points(text, default: str = ""):
    return F.length(F.coalesce(text, F.lit(default)))
