"""Session settings and the one place that cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A session of one process; ``local-cluster`` is not one.
_LOCAL = re.compile(r"local(\[|$)")


def build_session(app_name: str = "quillframe", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume.

    Shuffle partitions and memory are left to the cluster unless passed in ``conf`` (dots in
    keys are fine: ``build_session(**{"spark.sql.shuffle.partitions": 8})``).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **{key: str(value) for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and cut its lineage.

    The folder is ``spark.checkpoint.dir``.  Only a local-mode session may run without that
    setting; a machine-local folder on a cluster would not survive the loss of an executor.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not _LOCAL.match(context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="quillframe-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextmanager
def temporary_conf(spark: SparkSession, **settings):
    """Set SQL settings for the duration of a block (keys use ``__`` for dots)."""
    keys = {key.replace("__", "."): value for key, value in settings.items()}
    before = {key: spark.conf.get(key, None) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for files a query writes, beside the checkpoints (see ``checkpointed``)."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not _LOCAL.match(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="quillframe-")
    return f"{shared.rstrip('/')}/quillframe-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to a scratch folder, for several scans that each read only some of its columns."""
    path = f"{scratch_folder(df.sparkSession)}/stored"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A small driver-side table.  Handed over as Arrow, it needs no Python worker and becomes a local relation."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [()] * len(arrow)
    table = pa.Table.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, struct)
