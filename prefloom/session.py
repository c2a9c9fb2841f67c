"""Session defaults, the shared folder for intermediate tables, and the package on the workers."""

from __future__ import annotations

import atexit
import os
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def build_session(app: str = "prefloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; explicit settings win over the defaults."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: the one that the cluster names, else one beside the warehouse tables,
    which executors share as well. No machine-local temporary folder is ever used."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; it is removed at the end of :func:`tidy`, or when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/prefloom-{name}-{spark.sql('select uuid()').first()[0]}"
    if not _MADE:
        atexit.register(_sweep)
    _MADE.append((spark, path))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def tidy() -> Iterator[None]:
    """Folders made inside are removed at the end: for a query whose result has been written by then."""
    before = len(_MADE)
    try:
        yield
    finally:
        made = _MADE[before:]
        del _MADE[before:]
        for spark, path in made:
            _remove(spark, path)


def _sweep() -> None:
    for spark, path in _MADE:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  this session may have ended before, others may be there; nothing depends on the clean-up
            continue


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table that is costly to compute and read more than once to the shared folder, and read it back."""
    path = f"{scratch(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A stored table for work that is heavy per row. One that comes in fewer files than there are cores, such as a single file with one
    row group, which Spark can't split, is dealt out by ``key``; any other is left as it is. Results do not depend on it."""
    few = len(df.inputFiles()) < df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key) if few else df


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that they need no common working folder."""
    context = spark.sparkContext
    if getattr(context, "_prefloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(context._temp_dir, "prefloom.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in sorted(os.walk(here)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(target)
    context._prefloom_shipped = True
