"""Ingest, prepare, train, score and publish."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import name_based_id
from ..operators import learning
from ..operators.documents import (
    PAGE_SIZE,
    Names,
    booking_documents,
    event_documents,
    gather_members,
    gathered_shipments,
    outbox,
    piece_documents,
    waybill_documents,
)
from ..operators.features import TIE_BREAKERS, delivery_features, irregularity_features
from ..operators.jsonld import QUAD_FIELDS, TRIPLE_FIELDS, document_rows, rejects, statements
from ..operators.milestones import DELIVERY_RULES, EVENT_CODES, DeliveryRule, prepare_events
from ..operators.stats import hash_split
from ..schema import DOCUMENTS, PUBLISH_INPUT, require_columns
from ..session import stored
from ..sources.readers import read_milestones_csv
from ..sources.writers import append_parquet, write_events, write_events_csv


def ingest(docs: DataFrame, path: str, rejects_path: str | None = None, graphs: bool = False) -> None:
    """Flatten documents and append their triples, or with ``graphs`` quads, below one folder per kind of object.

    Documents are parsed once, into a scratch table that both results are
    taken from.  Those that can't be read are appended to ``rejects_path``;
    without one, the first of them raises an error before anything is written.
    """
    require_columns(docs, DOCUMENTS.fieldNames(), "ingest")
    keep = ["object_kind"]
    fields = QUAD_FIELDS if graphs else TRIPLE_FIELDS
    parsed = stored(document_rows(docs.withColumnRenamed("kind", "object_kind"), keep=keep, fields=fields), "parsed")
    rejected = rejects(parsed, keep)
    if rejects_path:
        append_parquet(rejected, rejects_path)
    else:
        bad = rejected.first()
        if bad is not None:
            raise ValueError(f"document {bad['doc_url']} can't be read ({bad['reason']}); name a rejects_path to go on")
    append_parquet(statements(parsed), path, keep)


def prepare(
    spark: SparkSession,
    csv_path: str,
    events_path: str,
    events_csv_path: str | None = None,
    codes: Sequence[str] = EVENT_CODES,
    rules: Sequence[DeliveryRule] = DELIVERY_RULES,
) -> DataFrame:
    """Milestone files to the event table; the CSV copy is made from the written table, not computed again."""
    write_events(prepare_events(read_milestones_csv(spark, csv_path), codes, rules), events_path)
    events = spark.read.parquet(events_path)
    if events_csv_path:
        write_events_csv(events, events_csv_path)
    return events


def irregularity_training_rows(
    events: DataFrame, keys: Sequence[str], tie_breakers: Sequence[str] = TIE_BREAKERS, look_ahead: bool = True
) -> DataFrame:
    return hash_split(irregularity_features(events, tie_breakers, keep=keys, look_ahead=look_ahead), keys)


def delivery_training_rows(events: DataFrame, keys: Sequence[str], tie_breakers: Sequence[str] = TIE_BREAKERS) -> DataFrame:
    return hash_split(delivery_features(events, tie_breakers, keep=keys), keys)


def train_irregularity(
    events: DataFrame,
    keys: Sequence[str],
    estimator: Estimator | Callable[[int], Estimator],
    tie_breakers: Sequence[str] = TIE_BREAKERS,
    look_ahead: bool = True,
) -> learning.Fitted:
    """Classifier for an irregularity at the next step; ``keys`` identify a row and decide its split."""
    rows = irregularity_training_rows(events, keys, tie_breakers, look_ahead)
    return learning.train(rows, learning.IRREGULARITY, estimator)


def train_delivery(
    events: DataFrame,
    keys: Sequence[str],
    estimator: Estimator | None = None,
    tie_breakers: Sequence[str] = TIE_BREAKERS,
) -> learning.Fitted:
    """Regressor for the hours from delivery to the proof of delivery."""
    rows = delivery_training_rows(events, keys, tie_breakers)
    return learning.train(rows, learning.DELIVERY, estimator or learning.boosted_regressor())


def score_irregularity(
    events: DataFrame,
    model: PipelineModel,
    tie_breakers: Sequence[str] = TIE_BREAKERS,
    look_ahead: bool = True,
) -> DataFrame:
    """All input columns and ``irregProbability``, in one plan: scores never leave their row."""
    rows = irregularity_features(
        events, tie_breakers, keep=events.columns, typed=False, look_ahead=look_ahead,
    )
    return model.transform(rows).select(*events.columns, vector_to_array("probability")[1].alias("irregProbability"))


def publish(
    scored: DataFrame,
    pieces: DataFrame,
    names: Names = Names(),
    recorder: str = "carrier",
    page_size: int = PAGE_SIZE,
    waybills: DataFrame | None = None,
    legs: DataFrame | None = None,
    actual: DataFrame | None = None,
) -> DataFrame:
    """Outbox rows for the shipments, pieces and predicted events of scored waybills.

    ``pieces`` has ``awbNo, piece_id, weight``.  Every scored waybill gets its
    shipment, with or without pieces; only pieces of scored waybills are
    published.  An event without a waybill is published without a link.
    Shipment identifiers are made from the waybill, so publishing again
    addresses the same objects.  ``waybills``, ``legs`` and ``actual`` have the
    columns of the waybill, booking and event builders and add their documents.
    """
    require_columns(scored, PUBLISH_INPUT, "publish")
    shipment = F.when(F.col("awbNo").isNotNull(), name_based_id(F.lit("shipment"), "awbNo"))
    # read by several documents: what they need of the scores and of the joined pieces is made once
    needed = ["awbNo", "eventCode", "eventDate", "departureLocation", "irregProbability"]
    told = stored(scored.select(*needed), "published-scores")
    known = told.select("awbNo").where(F.col("awbNo").isNotNull()).distinct()
    ids = {"shipment_id": shipment, "waybill_id": F.concat(F.lit("awb-"), F.col("awbNo"))}
    mine = stored(known.join(pieces.select("awbNo", "piece_id", "weight"), "awbNo", "left"), "published-pieces")
    events = told.select(
        F.col("eventCode").alias("event_code"),
        F.col("eventDate").alias("event_ts"),
        shipment.alias("linked_id"),
        F.lower("departureLocation").alias("location_id"),
        F.lit(recorder).alias("recorder_id"),
        F.col("irregProbability").alias("probability"),
    )
    docs = (
        gathered_shipments(gather_members(mine, "awbNo", [], ["piece_id"], page_size).withColumns(ids), names)
        .unionByName(piece_documents(mine.where(F.col("piece_id").isNotNull()), names))
        .unionByName(event_documents(events, "Predicted", names))
    )
    if waybills is not None:
        docs = docs.unionByName(waybill_documents(waybills, names))
    if legs is not None:
        docs = docs.unionByName(booking_documents(legs, names, page_size))
    if actual is not None:
        docs = docs.unionByName(event_documents(actual, "Actual", names))
    return outbox(docs, names)
