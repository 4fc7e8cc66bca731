"""Session construction and the shared work folder.

Nothing here fixes sizes for one machine: shuffle parallelism is left to the cluster's configuration, and adaptive
execution merges or splits partitions at run time.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "lodeflow", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; ``conf`` overrides, ``master`` is for local use and tests."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent (local tests) a temporary folder of this machine is used and remembered.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodeflow-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def work_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodeflow-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage, survives the loss of an executor, and gives the optimizer the true size of what follows,
    so that it broadcasts a table only if it is small. What is written within ``temporaries`` is removed at its end, all
    else by ``cleanup``. group_rows: the most rows of a row group, for rows that are small on disk only.
    """
    spark = df.sparkSession
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
    for written in _OPEN:
        written.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.block.row.count.limit", group_rows) if group_rows else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_OPEN: list[list[str]] = []


@contextlib.contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was materialized within it. Write or collect the result inside: it is made from those tables."""
    written: list[str] = []
    _OPEN.append(written)
    try:
        yield
    finally:
        _OPEN.remove(written)
        for path in written:
            _delete(spark, path)


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Delete everything this application materialized."""
    _delete(spark, work_root(spark))
