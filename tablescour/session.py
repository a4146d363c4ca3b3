"""Session helpers: a local builder for tests and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

from tablescour.errors import CleanError

CHECKPOINT_CONF = "spark.checkpoint.dir"


# HotSpot compiles no method above 8000 bytes of bytecode. A generated stage that long
# runs interpreted, several times slower than the same operators generated one by one,
# which is what Spark falls back to above this limit.
METHOD_LIMIT = {"spark.sql.codegen.hugeMethodLimit": "8000"}
_SPARK_DEFAULT_LIMIT = "65535"


def tune(spark: SparkSession) -> SparkSession:
    """Lower the method limit of a session that still has Spark's default."""
    for key, value in METHOD_LIMIT.items():
        if spark.conf.get(key, _SPARK_DEFAULT_LIMIT) == _SPARK_DEFAULT_LIMIT:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, **conf) -> SparkSession:
    """A small local session for tests and the benchmark."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        **METHOD_LIMIT,
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tablescour")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Set session options for the time one plan is built and run."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for key, value in names.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def small_batches(spark: SparkSession):
    """Arrow batches of a tenth of Spark's rows, for rows as large as texts: a task and its
    Python worker hold several copies of a batch."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1000")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name for staged tables that every executor can reach.

    The cluster names the parent in ``spark.checkpoint.dir``. A machine-local folder
    is used only by a local-mode session that names none.
    """
    parent = spark.conf.get(CHECKPOINT_CONF, None)
    if not parent:
        if not spark.sparkContext.master.startswith("local"):
            raise CleanError(
                "dataset_missing",
                f"Set {CHECKPOINT_CONF} to a folder shared by all executors.",
            )
        parent = tempfile.mkdtemp(prefix="tablescour-")
        spark.conf.set(CHECKPOINT_CONF, parent)
    return f"{parent.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`shared_dir`."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    folder.getFileSystem(conf).delete(folder, True)
