"""Session settings and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    # JSON with repeated members is read, the last one counts
    "spark.sql.variant.allowDuplicateKeys": "true",
    # checkpoints made here are small (keys, scores, chunk edges); drop them with their frames
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


#: JSON whose members repeat is only read with this setting.
REPEATED_MEMBERS = "spark.sql.variant.allowDuplicateKeys"


def accept_repeated_members(spark: SparkSession) -> None:
    """For sessions not made by ``build_session``: read JSON with repeated members, of which the last one counts."""
    spark.conf.set(REPEATED_MEMBERS, "true")


def build_session(app: str = "tracewing", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the library's settings; ``conf`` overrides them (use ``__`` for a dot)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = SESSION_CONF | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, also made the context's checkpoint folder.

    A machine-local folder is only ever chosen where driver and executors are
    one process, which ``local-cluster`` is not.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named is None and current is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="tracewing-")
    if current is None:
        context.setCheckpointDir(named)
    return named or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the application's part of the shared folder."""
    return f"{_scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tracewing/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them again.

    Later steps then start from files that outlive any executor, and rows that
    two branches must agree on are computed once.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of the Arrow batches in which texts and sets go to Python workers and back.
BATCH = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def bounded(df: DataFrame) -> DataFrame:
    """The rows, in a session whose Arrow batches are no larger than ``BATCH``; a smaller setting stays.

    A batch is held whole by the executor and by its worker, whatever a worker
    then does row by row.
    """
    conf = df.sparkSession.conf
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", conf.get(_BATCH_SETTING).strip().lower()).groups()
    if int(number) * _UNITS[unit] > BATCH:
        conf.set(_BATCH_SETTING, f"{BATCH}b")
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any file system that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def clear_scratch(spark: SparkSession) -> None:
    """Remove the tables that this application wrote to its scratch paths; frames that read them end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later branches read the same rows even if executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
