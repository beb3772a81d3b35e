"""Readings to and from topic payloads, in either wire format."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tachyline.functions import codec
from tachyline.functions.time import micros

# The codec travels inside the task closure, so executors need no installation.
cloudpickle.register_pickle_by_value(codec)

WIRE_FORMATS = ("protobuf", "json")
JSON_EVENT = "carId string, sensorId string, timestamp string, value double, sequenceNo bigint, _corrupt string"
JSON_ROLLUP = (
    "carId string, sensorId string, windowLength string, windowStart timestamp, windowEnd timestamp, "
    "count bigint, average double, minimum double, maximum double, _corrupt string"
)
JSON_ALERT = (
    "carId string, sensorId string, windowStart timestamp, windowEnd timestamp, "
    "observedMaximum double, threshold double, _corrupt string"
)
# The first and the last microsecond that a timestamp's text form can name.
TIME_RANGE = (-62_135_596_800_000_000, 253_402_300_799_999_999)


def _column_codec(function, returns: str):
    """An Arrow column function, marked non-deterministic so that a filter on its result
    is not pushed below it, which would run it twice."""
    return F.arrow_udf(function, returns).asNondeterministic()


def nanos_of_milli(events: DataFrame) -> Column:
    """Nanoseconds within the millisecond: kept from the wire, or from microseconds."""
    if "ts_ns_remainder" in events.columns:
        return F.col("ts_ns_remainder")
    return (F.pmod(micros("event_time"), F.lit(1000)) * 1000).cast("int")


def millis_of(column: str = "event_time") -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def time_from_wire(millis: Column, nanos: Column) -> Column:
    """Microsecond timestamp from the wire pair, truncating in integer arithmetic.

    Null where the pair names no time: a wire field may hold any number, and none may stop a job.
    """
    instant = F.try_add(F.try_multiply(millis, F.lit(1000)), F.floor(nanos / F.lit(1000)).cast("bigint"))
    return F.when(instant.between(*TIME_RANGE), F.timestamp_micros(instant))


def encode_protobuf(events: DataFrame) -> DataFrame:
    """Readings to (key, value): keyed by car, binary payload."""
    payload = _column_codec(codec.encode, "binary")(
        "car_id", "sensor_id", millis_of(), nanos_of_milli(events), "value", "sequence_no"
    )
    return events.withColumn("_payload", payload)


def iso_instant(events: DataFrame, column: str = "event_time") -> Column:
    """ISO-8601 UTC text with 0, 3, 6 or 9 fraction digits, as few as needed."""
    millis = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    text = F.concat(millis, F.lpad(nanos_of_milli(events).cast("string"), 6, "0"))
    return F.concat(F.regexp_replace(text, r"\.000000000$|(?:000){1,2}$", ""), F.lit("Z"))


def encode_json(events: DataFrame) -> DataFrame:
    record = F.struct(
        F.col("car_id").alias("carId"),
        F.col("sensor_id").alias("sensorId"),
        iso_instant(events).alias("timestamp"),
        F.col("value"),
        F.col("sequence_no").alias("sequenceNo"),
    )
    absent = F.col("car_id").isNull() | F.col("sensor_id").isNull() | F.col("event_time").isNull()
    return events.withColumn("_payload", F.when(~absent, F.to_json(record).cast("binary")))


def encode(events: DataFrame, wire_format: str = "protobuf", keep: tuple[str, ...] = ()) -> DataFrame:
    """Readings to topic rows (key, value) in the named format.

    Both ends of a topic must use the same format. ``keep`` names further columns.
    """
    _check(wire_format)
    encoded = encode_protobuf(events) if wire_format == "protobuf" else encode_json(events)
    return encoded.select(F.col("car_id").alias("key"), F.col("_payload").alias("_value"), *keep).withColumnRenamed(
        "_value", "value"
    )


def _check(wire_format: str) -> None:
    if wire_format not in WIRE_FORMATS:
        raise ValueError(f"wire format must be one of {WIRE_FORMATS}")


def decode_protobuf(raw: DataFrame) -> DataFrame:
    parsed = raw.withColumn("_m", _column_codec(codec.decode, codec.DECODED)("value"))
    moment = time_from_wire(F.col("_m.ms"), F.col("_m.ns"))
    return _event_columns(
        parsed,
        moment,
        F.pmod(F.col("_m.ns"), F.lit(1_000_000)).cast("int"),
        {name: F.col(f"_m.{name}") for name in ("car_id", "sensor_id", "value", "sequence_no")},
        F.coalesce(F.col("_m.error"), F.when(F.col("_m.ms").isNotNull() & moment.isNull(), F.lit("invalid time"))),
    )


def _parsed(payload: str, ddl: str, options: dict[str, str]) -> Column:
    """The JSON record as one struct column.

    Made by a generator rather than a projection: filters on its fields then stay above
    the parser instead of being pushed below it, where they would parse once more.
    """
    return F.explode(F.array(F.from_json(F.col(payload).cast("string"), ddl, options))).alias("_m")


def decode_json(raw: DataFrame) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = raw.select("*", _parsed("value", JSON_EVENT, options))
    moment = F.try_to_timestamp("_m.timestamp")
    # The tables hold no nulls; only a missing time has a fallback.
    incomplete = F.coalesce(
        *[F.when(F.col(f"_m.{name}").isNull(), F.lit(True)) for name in ("carId", "sensorId", "value", "sequenceNo")],
        F.lit(False),
    )
    digits = F.rpad(F.regexp_extract("_m.timestamp", r"\.(\d{1,9})", 1), 9, "0")
    return _event_columns(
        parsed,
        moment,
        F.when(F.col("_m.timestamp").isNotNull(), (digits.cast("bigint") % 1_000_000).cast("int")),
        {
            "car_id": F.col("_m.carId"),
            "sensor_id": F.col("_m.sensorId"),
            "value": F.col("_m.value"),
            "sequence_no": F.col("_m.sequenceNo"),
        },
        F.when(F.col("value").isNull(), F.lit(None))
        .when(F.col("_m").isNull() | F.col("_m._corrupt").isNotNull(), F.lit("invalid record"))
        .when(incomplete, F.lit("missing field"))
        .when(F.col("_m.timestamp").isNotNull() & moment.isNull(), F.lit("invalid time")),
    )


def _event_columns(
    parsed: DataFrame, moment: Column, nanos: Column, fields: dict[str, Column], error: Column
) -> DataFrame:
    # A reading without a time falls back to the time its record was appended.
    fallback = F.when(F.col("value").isNotNull() & error.isNull(), F.col("timestamp"))
    return parsed.select(
        "key",
        F.col("value").alias("payload"),
        "partition",
        "offset",
        "timestamp",
        fields["car_id"].alias("car_id"),
        fields["sensor_id"].alias("sensor_id"),
        F.coalesce(moment, fallback).alias("event_time"),
        nanos.alias("ts_ns_remainder"),
        fields["value"].alias("value"),
        fields["sequence_no"].alias("sequence_no"),
        error.alias("error"),
    )


def decode(raw: DataFrame, wire_format: str = "protobuf") -> DataFrame:
    """Topic rows to readings plus ``error``; the result has one schema for both formats.

    Null payloads give null readings. Invalid payloads do not stop the job: they
    carry ``error`` and no fields (see ``dead_letters``).
    """
    _check(wire_format)
    return decode_protobuf(raw) if wire_format == "protobuf" else decode_json(raw)


def good_readings(decoded: DataFrame) -> DataFrame:
    """The decoded readings, with one integer ``arrival`` per record.

    Partition and offset are packed into it (15 and 48 bits), so that arrival order
    stays a plain long and aggregations over it stay hash-based.
    """
    packed = F.shiftleft(F.col("partition").cast("bigint"), 48).bitwiseOR(F.col("offset"))
    return decoded.filter(F.col("error").isNull() & F.col("payload").isNotNull()).select(
        "car_id", "sensor_id", "event_time", "value", "sequence_no", "ts_ns_remainder",
        F.col("partition").alias("topic_partition"),
        F.col("offset").alias("topic_offset"),
        F.col("timestamp").alias("arrived_at"),
        packed.alias("arrival"),
    )


def dead_letters(decoded: DataFrame) -> DataFrame:
    """The raw records that could not be decoded, with the reason."""
    return decoded.filter(F.col("error").isNotNull()).select(
        "key", F.col("payload").alias("value"), "partition", "offset", "timestamp", "error"
    )


def wire_size_audit(events: DataFrame) -> DataFrame:
    """Payload bytes per format over the whole table, and how they compare."""
    sized = (
        encode_json(encode_protobuf(events).withColumnRenamed("_payload", "_binary"))
        .select(F.octet_length("_binary").alias("binary"), F.octet_length("_payload").alias("json"))
        .agg(
            F.count("binary").alias("events"),
            F.sum("binary").alias("protobuf_bytes"),
            F.sum("json").alias("json_bytes"),
        )
    )
    return sized.select(
        "events",
        "protobuf_bytes",
        "json_bytes",
        (F.col("protobuf_bytes") / F.col("events")).alias("protobuf_per_event"),
        (F.col("json_bytes") / F.col("events")).alias("json_per_event"),
        (F.col("json_bytes") / F.col("protobuf_bytes")).alias("ratio"),
    )


def rollups_to_json(rollups: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Live rollups as topic rows, keyed by series. ``keep`` names columns that go along."""
    return _to_topic(
        rollups,
        keep,
        {
            "carId": "car_id", "sensorId": "sensor_id", "windowLength": "window_length",
            "windowStart": "window_start", "windowEnd": "window_end", "count": "count",
            "average": "average", "minimum": "minimum", "maximum": "maximum",
        },
    )


def alerts_to_json(alerts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Alerts as topic rows, keyed by series. ``keep`` names columns that go along."""
    return _to_topic(
        alerts,
        keep,
        {
            "carId": "car_id", "sensorId": "sensor_id", "windowStart": "window_start",
            "windowEnd": "window_end", "observedMaximum": "observed_maximum", "threshold": "threshold",
        },
    )


def _to_topic(rows: DataFrame, keep: tuple[str, ...], names: dict[str, str]) -> DataFrame:
    utc = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC"}
    record = F.struct(*[F.col(column).alias(name) for name, column in names.items()])
    return rows.select(
        F.concat_ws("|", "car_id", "sensor_id").alias("key"),
        F.to_json(record, utc).cast("binary").alias("value"),
        *keep,
    )


def _from_topic(raw: DataFrame, ddl: str, names: list[str]) -> DataFrame:
    """The records' fields with ``payload`` and ``error``; a null record has neither."""
    options = {
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC",
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
    }
    parsed = raw.select("value", "timestamp", _parsed("value", ddl, options))
    fields = [part.strip().split(" ")[0] for part in ddl.split(",")][: len(names)]
    missing = F.coalesce(*[F.when(F.col(f"_m.{field}").isNull(), F.lit(True)) for field in fields], F.lit(False))
    error = (
        F.when(F.col("value").isNull(), F.lit(None))
        .when(F.col("_m").isNull() | F.col("_m._corrupt").isNotNull(), F.lit("invalid record"))
        .when(missing, F.lit("missing field"))
    )
    return parsed.select(
        *[F.col(f"_m.{field}").alias(name) for field, name in zip(fields, names)],
        F.col("timestamp").alias("arrived_at"),
        F.col("value").alias("payload"),
        error.alias("error"),
    )


def decode_rollups(raw: DataFrame) -> DataFrame:
    """Rollup records, bad ones marked by ``error``."""
    return _from_topic(
        raw,
        JSON_ROLLUP,
        ["car_id", "sensor_id", "window_length", "window_start", "window_end",
         "count", "average", "minimum", "maximum"],
    )


def decode_alerts(raw: DataFrame) -> DataFrame:
    """Alert records, bad ones marked by ``error``."""
    return _from_topic(
        raw,
        JSON_ALERT,
        ["car_id", "sensor_id", "window_start", "window_end", "observed_maximum", "threshold"],
    )


def _good(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("error").isNull() & F.col("payload").isNotNull()).drop("payload", "error")


def json_to_rollups(raw: DataFrame) -> DataFrame:
    """The rollups of a topic; what can't be read is left to ``bad_records``."""
    return _good(decode_rollups(raw))


def json_to_alerts(raw: DataFrame) -> DataFrame:
    return _good(decode_alerts(raw))


def bad_records(decoded: DataFrame) -> DataFrame:
    """Rollup or alert records that could not be read, with the reason."""
    return decoded.filter(F.col("error").isNotNull()).select(
        F.col("payload").alias("value"), F.col("arrived_at").alias("timestamp"), "error"
    )
