"""Linked JSON documents for waybills, bookings, shipments, pieces and events.

Each builder returns ``(doc_url, kind, body)``; members whose value is NULL are
left out.  Addresses and the vocabulary are parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import event_name, name_based_id, waybill_parts
from ..session import stored

XSD = "http://www.w3.org/2001/XMLSchema#"
EVENT_TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"
# about this many distinct members on a page of a shipment or booking
PAGE_SIZE = 1_000_000
# groups of keys in which large keys are looked for
BUCKETS = 16_384
# rows of small keys that one task gathers, about
TASK_ROWS = 250_000
# Fixed value: the description of goods where none is given.
GOODS = "General Cargo"

# Roles of the parties of a waybill, with the column that names the organization.
PARTY_ROLES = (("Shipper", "shipper"), ("Consignee", "consignee"), ("FreightForwarder", "forwarder"))


@dataclass(frozen=True)
class Names:
    """Where objects live and which vocabulary names classes and members."""

    base: str = "https://objects.example.org/logistics-objects"
    vocabulary: str = "https://vocabulary.example.org/cargo#"
    embedded: str = "urn:uuid:"

    def url(self, object_id: str | Column) -> Column:
        return F.concat(F.lit(f"{self.base}/"), F.col(object_id) if isinstance(object_id, str) else object_id)

    def term(self, name: str) -> str:
        return f"{self.vocabulary}{name}"

    def ref(self, object_id: str | Column) -> Column:
        url = self.url(object_id)
        return F.when(url.isNotNull(), F.struct(url.alias("@id")))

    def inner_id(self, *parts: str | Column) -> Column:
        return F.concat(F.lit(self.embedded), name_based_id(*parts))


def _node(names: Names, node_id: Column | None, cls: str, members: dict[str, Column | str]) -> Column:
    fields = [] if node_id is None else [node_id.alias("@id")]
    fields.append(F.lit(names.term(cls)).alias("@type"))
    for name, value in members.items():
        fields.append((F.lit(value) if isinstance(value, str) else value).alias(names.term(name)))
    return F.struct(*fields)


def _typed(value: Column, datatype: str) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(XSD + datatype).alias("@type"), value.alias("@value")))


def _documents(df: DataFrame, url: Column, kind: str, node: Column) -> DataFrame:
    return df.select(url.alias("doc_url"), F.lit(kind).alias("kind"), F.to_json(node).alias("body"))


# The member and class names below are fixed values of the documents' vocabulary.
def waybill_documents(df: DataFrame, names: Names = Names()) -> DataFrame:
    """From ``waybill_id, departure, arrival, shipper, consignee, forwarder, booking_id, shipment_id``."""
    parties = F.array(
        *[
            _node(
                names,
                names.inner_id("waybill_id", F.lit(role)),
                "Party",
                {"organization": names.ref(column), "role": role},
            )
            for role, column in PARTY_ROLES
        ]
    )
    parts = waybill_parts("waybill_id")
    members = {
        "arrivalLocation": names.ref("arrival"),
        "departureLocation": names.ref("departure"),
        "involvedParties": parties,
        "referredBookingOption": names.ref("booking_id"),
        "shipment": names.ref("shipment_id"),
        "waybillPrefix": parts["prefix"],
        "waybillType": "Master",
        "waybillnumber": parts["number"],
    }
    url = names.url("waybill_id")
    return _documents(df, url, "waybill", _node(names, url, "Waybill", members))


def gather_members(
    df: DataFrame,
    key: str,
    carried: Sequence[str],
    member: Sequence[str],
    page_size: int = PAGE_SIZE,
    derived: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """``key, carried.., page, pages, members``: the distinct members of each key in pages of about ``page_size``.

    ``carried`` columns depend on the key.  Keys of up to ``page_size`` rows
    have one page, and their rows are shuffled once.  For others the number of
    pages follows from the number of distinct members, a member's page from its
    hash; rows are grouped by page, so no task takes a large key whole.  Rows
    without a member give a key its first page.  ``derived`` fields of a member
    are made in its own row, which Spark compiles, unlike an expression over
    the members of an array.  Rows are counted when the plan is built, so the
    input must give the same rows again.
    """
    present = F.lit(True)
    for c in member:
        present = present & F.col(c).isNotNull()
    rows = df.select(key, *carried, F.when(present, F.struct(*member)).alias("_member"))
    large, n = _large_keys(rows, key, page_size)
    # Spark would join small partitions by their compressed size, and rows to gather are many times larger
    parts = max(-(-n // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    if large is None:
        return _one_page(rows, key, carried, derived, parts)
    on = F.col(key).eqNullSafe(F.col("_key"))
    plain = _one_page(rows.join(large, on, "left_anti"), key, carried, derived, parts)
    return plain.unionByName(_pages(rows.join(large, on, "left_semi"), key, carried, page_size, derived))


def _large_keys(rows: DataFrame, key: str, limit: int) -> tuple[DataFrame | None, int]:
    """``_key``: the keys with more than ``limit`` members, repeated ones too, or None if there are none; and the number of rows.

    Members are first counted for buckets of keys, which shuffles a row for
    each bucket and task; keys are counted in buckets of more than ``limit``.
    """
    keys = rows.select(F.col(key).alias("_key"), "_member", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket"))
    buckets = keys.groupBy("_bucket").agg(F.count("_member").alias("_n"), F.count(F.lit(1)).alias("_rows"))
    # at most a number for each bucket
    found = buckets.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.collect_list(F.when(F.col("_n") > limit, F.col("_bucket")))).first()
    if not found[1]:
        return None, found[0]
    counted = keys.where(F.col("_bucket").isin(found[1])).groupBy("_key").agg(F.count("_member").alias("_n"))
    large = stored(counted.where(F.col("_n") > limit).select("_key"), "large-keys")
    return (None if large.isEmpty() else large), found[0]


def _with_derived(rows: DataFrame, derived: dict[str, Callable[[Column], Column]] | None) -> DataFrame:
    if not derived:
        return rows
    m = F.col("_member")
    fields = [m[f].alias(f) for f in rows.schema["_member"].dataType.names]
    return rows.withColumn("_member", F.when(m.isNotNull(), F.struct(*fields, *[made(m).alias(n) for n, made in derived.items()])))


def _one_page(
    rows: DataFrame, key: str, carried: Sequence[str], derived: dict[str, Callable[[Column], Column]] | None, parts: int
) -> DataFrame:
    """One page for each key: rows meet by key, so neither finding distinct ones nor gathering them shuffles again."""
    met = _with_derived(rows.repartition(parts, F.col(key)).distinct(), derived)
    members = F.sort_array(F.collect_list("_member")).alias("members")
    return met.groupBy(key, *carried).agg(members).select(key, *carried, F.lit(0).alias("page"), F.lit(1).alias("pages"), "members")


def _pages(
    rows: DataFrame, key: str, carried: Sequence[str], page_size: int, derived: dict[str, Callable[[Column], Column]] | None
) -> DataFrame:
    rows = rows.distinct()
    sizes = rows.groupBy(F.col(key).alias("_key")).agg(
        F.greatest(F.ceil(F.count("_member") / page_size), F.lit(1)).cast("int").alias("pages")
    )
    paged = rows.join(sizes, F.col(key).eqNullSafe(F.col("_key")))
    page = F.when(F.col("_member").isNull(), 0).otherwise(F.pmod(F.xxhash64("_member"), F.col("pages"))).cast("int")
    # the first page always exists, for the links to the others
    heads = rows.select(key, *carried).distinct().join(sizes, F.col(key).eqNullSafe(F.col("_key")))
    every = paged.select(key, *carried, page.alias("page"), "pages", "_member").unionByName(
        heads.select(key, *carried, F.lit(0).alias("page"), "pages", F.lit(None).cast(rows.schema["_member"].dataType).alias("_member"))
    )
    return _with_derived(every, derived).groupBy(key, *carried, "page", "pages").agg(F.sort_array(F.collect_list("_member")).alias("members"))


def _paged_documents(
    gathered: DataFrame, names: Names, kind: str, cls: str, url: Column, name: str, items: Column, scalars: dict[str, Column | str]
) -> DataFrame:
    """The first page is the object itself, with its scalars and links to further pages, which have addresses of their own."""
    first = gathered.where("page = 0")
    further = F.when(
        F.col("pages") > 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.col("pages") - 1, F.lit(1))),
            lambda p: F.struct(F.concat(url, F.lit("/pages/"), p.cast("string")).alias("@id")),
        ),
    )
    members = dict(sorted({**scalars, name: items}.items()))
    whole = _documents(first, url, kind, _node(names, url, cls, members | {"pages": further}))
    page_url = F.concat(url, F.lit("/pages/"), F.col("page").cast("string"))
    page = _node(names, page_url, f"{cls}Page", {name: items, "pageOf": F.struct(url.alias("@id"))})
    return whole.unionByName(_documents(gathered.where("page > 0"), page_url, kind, page))


def booking_documents(legs: DataFrame, names: Names = Names(), page_size: int = PAGE_SIZE) -> DataFrame:
    """From one row per leg: ``booking_id, waybill_id, sequence, activity_id``."""
    step = {"step_id": lambda m: names.inner_id("booking_id", m["sequence"], m["activity_id"])}
    gathered = gather_members(legs, "booking_id", ["waybill_id"], ["sequence", "activity_id"], page_size, step)
    steps = F.transform(
        "members",
        lambda m: _node(
            names,
            m["step_id"],
            "ActivitySequence",
            {"activity": names.ref(m["activity_id"]), "sequenceNumber": m["sequence"].cast("string")},
        ),
    )
    scalars = {"issuedForWaybill": names.ref("waybill_id")}
    return _paged_documents(gathered, names, "booking", "Booking", names.url("booking_id"), "activitySequences", steps, scalars)


def shipment_documents(
    pieces: DataFrame, names: Names = Names(), goods: str = GOODS, page_size: int = PAGE_SIZE
) -> DataFrame:
    """From one row per piece: ``shipment_id, waybill_id, piece_id``; repeated pieces collapse, NULL pieces are none."""
    return gathered_shipments(gather_members(pieces, "shipment_id", ["waybill_id"], ["piece_id"], page_size), names, goods)


def gathered_shipments(gathered: DataFrame, names: Names = Names(), goods: str = GOODS) -> DataFrame:
    """From the pages of ``gather_members`` over ``piece_id``, with ``shipment_id`` and ``waybill_id``."""
    refs = F.transform("members", lambda m: names.ref(m["piece_id"]))
    scalars = {"goodsDescription": goods, "waybill": names.ref("waybill_id")}
    return _paged_documents(gathered, names, "shipment", "Shipment", names.url("shipment_id"), "shipmentOfPieces", refs, scalars)


def piece_documents(
    pieces: DataFrame, names: Names = Names(), goods: str = GOODS, unit: str = "KGM"
) -> DataFrame:
    """From ``piece_id, weight``; the weight node's identifier comes from the piece."""
    weight = _node(
        names,
        names.inner_id("piece_id", F.lit("grossWeight")),
        "Value",
        {"numericalValue": _typed(F.col("weight").cast("double").cast("string"), "double"), "unit": unit},
    )
    url = names.url("piece_id")
    members = {"goodsDescription": goods, "grossWeight": weight}
    return _documents(pieces, url, "piece", _node(names, url, "Piece", members))


def event_documents(events: DataFrame, time_type: str = "Actual", names: Names = Names()) -> DataFrame:
    """From ``event_code, event_ts, linked_id, location_id, recorder_id`` and, if predicted, ``probability``.

    Events have no identifier of their own.  Their address is the event list of
    the object they belong to, or a common one for events without an object,
    with a digest of the text to tell them apart.
    """
    if time_type not in ("Actual", "Predicted"):
        raise ValueError("time_type is Actual or Predicted")
    members = {
        "eventCode": F.col("event_code"),
        "eventDate": _typed(F.date_format("event_ts", EVENT_TIME), "dateTime"),
        "eventName": event_name("event_code"),
        "eventTimeType": time_type,
    }
    if time_type == "Predicted":
        members["irregularityProbability"] = _typed(F.col("probability").cast("string"), "double")
    members |= {
        "linkedObject": names.ref("linked_id"),
        "recordedAtLocation": names.ref("location_id"),
        "recordedBy": names.ref("recorder_id"),
    }
    texts = events.select(
        F.concat(F.coalesce(names.url("linked_id"), F.lit(names.base)), F.lit("/logistics-events")).alias("list"),
        F.to_json(_node(names, None, "LogisticsEvent", members)).alias("body"),
    )
    return texts.select(
        F.concat_ws("#", "list", F.md5("body")).alias("doc_url"), F.lit("event").alias("kind"), "body"
    )


def outbox(docs: DataFrame, names: Names = Names()) -> DataFrame:
    """``endpoint, kind, body``: objects go to the object list, events to their object's event list."""
    event_list = F.substring_index("doc_url", "#", 1)
    endpoint = F.when(F.col("kind") == "event", event_list).otherwise(F.lit(names.base))
    return docs.select(endpoint.alias("endpoint"), "kind", "body")
