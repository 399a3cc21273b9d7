"""Sinks.  All writes are per task; none brings rows together on one machine."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import path_exists, stored


def write_events(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_events_csv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def append_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append below one folder per value of ``partition_by``; rows of up to ``KINDS`` values are not sorted by them.

    A task then holds a row group for each value, so row groups are small.
    """
    out = df.write.mode("append").partitionBy(*partition_by)
    if not partition_by:
        return out.parquet(path)
    with _kinds_open(df):
        out.option("parquet.block.size", ROW_GROUP).parquet(path)


def save_scored(df: DataFrame, name: str, fmt: str = "parquet") -> None:
    """Managed table, replaced; ``fmt`` may name an installed table format."""
    df.write.format(fmt).mode("overwrite").saveAsTable(name)


#: Text formats; their files of documents are several times smaller when compressed, and Spark reads them as they are.
TEXTS = ("json", "csv", "text")
#: The setting for files that a task may hold open, and the number of kinds of documents that get one each.
OPEN_FILES, KINDS = "spark.sql.maxConcurrentOutputFileWriters", 8
#: Bytes of a row group where a task writes several files at once.
ROW_GROUP = 16 << 20
#: Digests that each task may hold beside its rows.
FEW = 200_000


def _compressed(fmt: str) -> dict[str, str]:
    return {"compression": "gzip"} if fmt in TEXTS else {}


@contextmanager
def _kinds_open(df: DataFrame) -> Iterator[None]:
    """Meanwhile a task may hold a file open for each of up to ``KINDS`` kinds."""
    conf = df.sparkSession.conf
    before = conf.get(OPEN_FILES)
    conf.set(OPEN_FILES, str(max(int(before), KINDS)))
    try:
        yield
    finally:
        conf.set(OPEN_FILES, before)


def write_outbox(df: DataFrame, path: str, fmt: str = "json") -> None:
    """``endpoint, kind, body`` rows below one folder per kind, ready for a sender to ship; text files are gzipped.

    A task holds a file open for each of up to ``KINDS`` kinds, so Spark does
    not sort whole documents by kind; rows of further kinds are sorted.
    """
    with _kinds_open(df):
        df.write.mode("overwrite").partitionBy("kind").format(fmt).options(**_compressed(fmt)).save(path)


def _digested(outbox: DataFrame) -> DataFrame:
    return outbox.withColumn("digest", F.sha2(F.to_json(F.struct("endpoint", "kind", "body")), 256))


def unsent(outbox: DataFrame, ledger_path: str) -> DataFrame:
    """The outbox rows, with their digest, that the ledger at a path does not hold yet; equal rows are one."""
    spark = outbox.sparkSession
    rows = _digested(outbox).dropDuplicates(["digest"])
    if not path_exists(spark, ledger_path):
        return rows
    sent = spark.read.schema("digest string").parquet(ledger_path)
    return rows.join(sent, "digest", "left_anti")


def send_once(outbox: DataFrame, path: str, ledger_path: str, run: str, fmt: str = "json") -> None:
    """Write what was not sent before below ``path/run=<run>/kind=..`` and note its digests in the ledger.

    Files come first and the ledger after them, and a run that is repeated
    replaces its own files, so a failure between the two sends again and loses
    nothing.  A changed object is a new body and is sent.  What is new is
    found among the digests alone, and only new digests are kept, so the outbox
    is computed twice, three times where many are new beside a ledger, and must
    give the same rows again; bodies are shuffled only where neither the new
    nor the other digests are few.
    """
    # digests as bytes are half as long as their text, which the ledger holds
    spark, rows = outbox.sparkSession, _digested(outbox).withColumn("digest", F.unhex("digest"))
    found, sent = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), None
    if path_exists(spark, ledger_path):
        sent = spark.read.schema("digest string").parquet(ledger_path).select(F.unhex("digest").alias("digest"))
        found = found.join(sent, "digest", "left_anti")
    new = stored(found, "new-digests")
    counted = new.agg(F.count(F.lit(1)).alias("new"), F.count_if(F.col("n") > 1).alias("several")).first()
    if counted["new"] == 0:
        out = rows.limit(0)
    elif counted["new"] <= FEW:
        out = rows.join(F.broadcast(new.select("digest")), "digest", "left_semi").dropDuplicates(["digest"])
    else:
        several = new.where(F.col("n") > 1).select("digest")
        held, others = several, counted["several"]
        if sent is not None and others <= FEW:
            again = stored(rows.select("digest").join(sent, "digest", "left_semi").distinct(), "sent-digests")
            held, others = several.unionByName(again), others + again.count()
        if others <= FEW:
            out = rows.join(F.broadcast(held), "digest", "left_anti")
            if counted["several"]:
                out = out.unionByName(rows.join(F.broadcast(several), "digest", "left_semi").dropDuplicates(["digest"]))
        else:
            out = rows.join(new.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    write_outbox(out.select("endpoint", "kind", "body"), f"{path}/run={run}", fmt)
    new.select(F.lower(F.hex("digest")).alias("digest")).write.mode("append").option("compression", "zstd").parquet(ledger_path)
