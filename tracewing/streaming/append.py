"""Append what is new since the last run, once each; ingest documents batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.jsonld import document_rows, rejects, statements
from ..session import stored


def append_available(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Write everything the source holds that the checkpoint has not seen, then stop.

    Source offsets and committed files are in ``checkpoint``, so a run that is
    repeated after a failure neither loses nor repeats rows.
    """
    query = (
        stream.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return query


def write_batch(docs: DataFrame, batch: int, path: str, rejects_path: str) -> None:
    """Quads and rejects of one batch of ``doc_url, kind, body``, from one parse, in folders of the batch.

    A batch that comes again replaces what it wrote before.
    """
    keep = ["object_kind"]
    parsed = stored(document_rows(docs.withColumnRenamed("kind", "object_kind"), keep=keep), "parsed-batch")
    statements(parsed).write.mode("overwrite").partitionBy(*keep).parquet(f"{path}/batch={batch}")
    rejects(parsed, keep).write.mode("overwrite").parquet(f"{rejects_path}/batch={batch}")


def ingest_stream(stream: DataFrame, path: str, rejects_path: str, checkpoint: str) -> StreamingQuery:
    """Parse all documents that the checkpoint has not seen, batch by batch, then stop."""
    query = (
        stream.writeStream.foreachBatch(lambda docs, batch: write_batch(docs, batch, path, rejects_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def jsonld_line_stream(lines: DataFrame, kind: str, url_member: str = "@id") -> DataFrame:
    """Documents of a stream of text lines in a column ``value``, one a line, as ``doc_url, kind, body``."""
    own = F.try_variant_get(F.try_parse_json("value"), f"$['{url_member}']", "string")
    return lines.select(F.coalesce(own, F.concat(F.lit("#"), F.md5("value"))).alias("doc_url"), F.lit(kind).alias("kind"), F.col("value").alias("body"))
