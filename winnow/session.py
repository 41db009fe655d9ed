"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's session is used."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("winnow")
    settings = dict(_SETTINGS, **{"spark.sql.shuffle.partitions": str(shuffle_partitions)}, **extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a temporary one only where none is named."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named:
        if not current or named.rstrip("/") not in current:
            context.setCheckpointDir(named)
        return named
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="winnow-checkpoint-")
    context.setCheckpointDir(made)
    return made


def ship_package(spark: SparkSession) -> None:
    """Give this package to the workers of the session, once."""
    context = spark.sparkContext
    if any(f.startswith("winnow-package-") for f in context._python_includes):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    handle, path = tempfile.mkstemp(prefix="winnow-package-", suffix=".zip")
    with os.fdopen(handle, "wb") as file, zipfile.ZipFile(file, "w") as archive:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
