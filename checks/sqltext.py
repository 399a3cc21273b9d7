"""SQL text that spells out documents and triples from the relational tables."""

from __future__ import annotations

from checks.views import BASE, VOCABULARY

XSD = "http://www.w3.org/2001/XMLSchema#"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def uuid_of(*parts: str) -> str:
    marked = [f"coalesce(length({p}) || ':' || {p}, '-')" for p in parts]
    digest = f"md5(concat_ws('|', {', '.join(marked)}))"
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return "concat_ws('-', " + ", ".join(f"substr({digest}, {a}, {n})" for a, n in cuts) + ")"


def url(expr: str) -> str:
    return f"({lit(BASE + '/')} || {expr})"


def term(name: str) -> str:
    return lit(VOCABULARY + name)


def text(expr: str) -> str:
    """A JSON string from an SQL expression that needs no escapes."""
    return f"('\"' || {expr} || '\"')"


def obj(*members: tuple[str, str], optional: tuple[str, ...] = ()) -> str:
    """A JSON object; members named in ``optional`` vanish when NULL."""
    parts = []
    for key, value in members:
        member = f"'\"{key}\":' || {value} || ','"
        parts.append(f"coalesce({member}, '')" if key in optional else member)
    return "('{' || rtrim(" + " || ".join(parts) + ", ',') || '}')"


def v(name: str) -> str:
    return VOCABULARY + name


def ref(expr: str) -> str:
    return obj(("@id", text(url(expr))))


PARTIES = (("Shipper", "shipper"), ("Consignee", "consignee"), ("FreightForwarder", "forwarder"))


def party_id(role: str) -> str:
    return f"('urn:uuid:' || {uuid_of('waybill_id', lit(role))})"


def waybill_body() -> str:
    parties = " || ',' || ".join(
        obj(
            ("@id", text(party_id(role))), ("@type", text(term("Party"))),
            (v("organization"), ref(column)), (v("role"), text(lit(role))),
        )
        for role, column in PARTIES
    )
    return obj(
        ("@id", text(url("waybill_id"))), ("@type", text(term("Waybill"))),
        (v("arrivalLocation"), ref("arrival")), (v("departureLocation"), ref("departure")),
        (v("involvedParties"), f"'[' || {parties} || ']'"),
        (v("referredBookingOption"), ref("booking_id")), (v("shipment"), ref("shipment_id")),
        (v("waybillPrefix"), text("split_part(waybill_id, '-', 2)")), (v("waybillType"), text("'Master'")),
        (v("waybillnumber"), text("split_part(waybill_id, '-', 3)")),
    )


STEP_ID = f"('urn:uuid:' || {uuid_of('booking_id', 'sequence::varchar', 'activity_id')})"


def booking_step() -> str:
    return obj(
        ("@id", text(STEP_ID)), ("@type", text(term("ActivitySequence"))),
        (v("activity"), ref("activity_id")), (v("sequenceNumber"), text("sequence::varchar")),
    )


def booking_documents() -> str:
    body = obj(
        ("@id", text(url("booking_id"))), ("@type", text(term("Booking"))),
        (v("activitySequences"), "'[' || steps || ']'"), (v("issuedForWaybill"), ref("waybill_id")),
    )
    return f"""select {url('booking_id')} doc_url, 'booking' kind, {body} body from (
      select booking_id, waybill_id, string_agg({booking_step()}, ',' order by sequence, activity_id) steps
      from (select distinct booking_id, waybill_id, sequence, activity_id from lines) group by all)"""


def shipment_documents(source: str = "lines") -> str:
    body = obj(
        ("@id", text(url("shipment_id"))), ("@type", text(term("Shipment"))),
        (v("goodsDescription"), text("'General Cargo'")), (v("shipmentOfPieces"), "'[' || pieces || ']'"),
        (v("waybill"), ref("waybill_id")),
    )
    return f"""select {url('shipment_id')} doc_url, 'shipment' kind, {body} body from (
      select shipment_id, waybill_id, string_agg({ref('piece_id')}, ',' order by piece_id) pieces
      from (select distinct shipment_id, waybill_id, piece_id from {source}) group by all)"""


WEIGHT_ID = f"('urn:uuid:' || {uuid_of('piece_id', lit('grossWeight'))})"


def piece_documents(source: str = "lines") -> str:
    number = obj(("@type", text(lit(XSD + "double"))), ("@value", text("weight::double::varchar")))
    weight = obj(
        ("@id", text(WEIGHT_ID)), ("@type", text(term("Value"))), (v("numericalValue"), number),
        (v("unit"), text("'KGM'")),
    )
    body = obj(
        ("@id", text(url("piece_id"))), ("@type", text(term("Piece"))),
        (v("goodsDescription"), text("'General Cargo'")), (v("grossWeight"), weight),
    )
    return f"select {url('piece_id')} doc_url, 'piece' kind, {body} body from {source}"


# codes with a name that occur in the tables; others have none
EVENT_NAME = "case event_code when 'DIS' then 'Irregularity' end"


def event_documents(time_type: str, source: str = "event_rows") -> str:
    when = obj(
        ("@type", text(lit(XSD + "dateTime"))), ("@value", text("strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ')"))
    )
    chance = obj(("@type", text(lit(XSD + "double"))), ("@value", text("probability::varchar")))
    predicted = [(v("irregularityProbability"), chance)] if time_type == "Predicted" else []
    body = obj(
        ("@type", text(term("LogisticsEvent"))), (v("eventCode"), text("event_code")), (v("eventDate"), when),
        (v("eventName"), text(EVENT_NAME)), (v("eventTimeType"), text(lit(time_type))), *predicted,
        (v("linkedObject"), ref("linked_id")), (v("recordedAtLocation"), ref("location_id")),
        (v("recordedBy"), ref("recorder_id")), optional=(v("eventDate"), v("eventName")),
    )
    return f"""select list || '#' || md5(body) doc_url, 'event' kind, body
      from (select {url('linked_id')} || '/logistics-events' list, {body} body from {source})"""


def triples(source: str, doc: str, rows: list[tuple[str, str, str, str, str]]) -> str:
    """Union of ``(subject, predicate, kind, value, datatype)`` expressions over one source."""
    return " union ".join(
        f"select {doc} doc_url, {s} subject, {p} predicate, {lit(k)} kind, {val} \"value\", {d} datatype from {source}"
        for s, p, k, val, d in rows
    )


NONE = "cast(null as varchar)"


def _type(subject: str, cls: str):
    return (subject, "'@type'", "type", term(cls), NONE)


def _ref(subject: str, name: str, target: str):
    return (subject, term(name), "ref", target, NONE)


def _value(subject: str, name: str, value: str, datatype: str = NONE):
    return (subject, term(name), "value", value, datatype)


def waybill_triples() -> str:
    u = url("waybill_id")
    rows = [
        _type(u, "Waybill"), _ref(u, "arrivalLocation", url("arrival")), _ref(u, "departureLocation", url("departure")),
        _ref(u, "referredBookingOption", url("booking_id")), _ref(u, "shipment", url("shipment_id")),
        _value(u, "waybillPrefix", "split_part(waybill_id, '-', 2)"), _value(u, "waybillType", "'Master'"),
        _value(u, "waybillnumber", "split_part(waybill_id, '-', 3)"),
    ]
    for role, column in PARTIES:
        p = party_id(role)
        rows += [
            _ref(u, "involvedParties", p), _type(p, "Party"), _ref(p, "organization", url(column)),
            _value(p, "role", lit(role)),
        ]
    return triples("waybills", u, rows)


def booking_triples() -> str:
    u = url("booking_id")
    return triples(
        "lines", u,
        [
            _type(u, "Booking"), _ref(u, "issuedForWaybill", url("waybill_id")),
            _ref(u, "activitySequences", STEP_ID), _type(STEP_ID, "ActivitySequence"),
            _ref(STEP_ID, "activity", url("activity_id")), _value(STEP_ID, "sequenceNumber", "sequence::varchar"),
        ],
    )


def shipment_triples() -> str:
    u = url("shipment_id")
    return triples(
        "lines", u,
        [
            _type(u, "Shipment"), _ref(u, "waybill", url("waybill_id")),
            _ref(u, "shipmentOfPieces", url("piece_id")), _value(u, "goodsDescription", "'General Cargo'"),
        ],
    )


def piece_triples() -> str:
    u = url("piece_id")
    return triples(
        "lines", u,
        [
            _type(u, "Piece"), _value(u, "goodsDescription", "'General Cargo'"), _ref(u, "grossWeight", WEIGHT_ID),
            _type(WEIGHT_ID, "Value"), _value(WEIGHT_ID, "unit", "'KGM'"),
            _value(WEIGHT_ID, "numericalValue", "weight::double::varchar", lit(XSD + "double")),
        ],
    )


def event_triples(time_type: str) -> str:
    """Equal events are equal documents, each with its own rows, so nothing is made distinct here."""
    s = "('_:' || md5(doc_url || '$'))"
    rows = [
        _type(s, "LogisticsEvent"), _value(s, "eventCode", "event_code"),
        _value(s, "eventDate", "strftime(event_ts, '%Y-%m-%dT%H:%M:%SZ')", lit(XSD + "dateTime")),
        _value(s, "eventName", EVENT_NAME), _value(s, "eventTimeType", lit(time_type)),
        _value(s, "irregularityProbability", "probability::varchar", lit(XSD + "double")),
        _ref(s, "linkedObject", url("linked_id")), _ref(s, "recordedAtLocation", url("location_id")),
        _ref(s, "recordedBy", url("recorder_id")),
    ]
    docs = event_documents(time_type).replace("select list ||", "select r.*, list ||").replace(
        "|| '/logistics-events' list,", "|| '/logistics-events' list, event_rows as r,"
    )
    found = triples(f"({docs})", "doc_url", rows).replace(" union select", " union all select")
    return f"select * from ({found}) where \"value\" is not null"
