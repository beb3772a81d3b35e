import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from helpers import W, readings, speed, values
from tachyline.functions import codec
from tachyline.sources import topics, wire

EXACT = dict(car="CAR-07", sensor="brake-temperature-front-left", value=947.9312345, number=4_294_967_296)


def records(spark, encoded):
    return encoded.select(
        "key", "value", F.lit(3).alias("partition"), F.monotonically_increasing_id().alias("offset"),
        F.lit("2026-08-23 13:00:00").cast("timestamp").alias("timestamp"),
    )


def one_event(spark):
    return spark.range(1).select(
        F.lit(EXACT["car"]).alias("car_id"), F.lit(EXACT["sensor"]).alias("sensor_id"),
        F.lit("2026-08-23 12:34:56.123456").cast("timestamp").alias("event_time"),
        F.lit(EXACT["value"]).alias("value"), F.lit(EXACT["number"]).alias("sequence_no"),
        F.lit(456_789).alias("ts_ns_remainder"),
    )


@pytest.mark.parametrize("wire_format", wire.WIRE_FORMATS)
def test_every_field_survives(spark, wire_format):
    raw = records(spark, wire.encode(one_event(spark), wire_format))
    row = wire.good_readings(wire.decode(raw, wire_format)).first()
    assert (row["car_id"], row["sensor_id"]) == (EXACT["car"], EXACT["sensor"])
    assert (row["value"], row["sequence_no"]) == (EXACT["value"], EXACT["number"])
    assert row["event_time"] == dt.datetime(2026, 8, 23, 12, 34, 56, 123456)
    assert row["ts_ns_remainder"] == 456_789
    assert row["arrival"] == (3 << 48) + row["topic_offset"]


def test_json_text_is_exact(spark):
    text = wire.encode(one_event(spark), "json").select(F.col("value").cast("string")).first()[0]
    assert text == (
        '{"carId":"CAR-07","sensorId":"brake-temperature-front-left",'
        '"timestamp":"2026-08-23T12:34:56.123456789Z","value":947.9312345,"sequenceNo":4294967296}'
    )


def test_micros_are_truncated_not_rounded(spark):
    row = spark.range(1).select(
        wire.time_from_wire(F.lit(1787488496123), F.lit(456789)).alias("t")
    ).first()
    assert row["t"].microsecond == 123456


@pytest.mark.parametrize("wire_format", wire.WIRE_FORMATS)
def test_null_in_null_out(spark, wire_format):
    nothing = one_event(spark).withColumn("car_id", F.lit(None).cast("string"))
    encoded = wire.encode(nothing, wire_format)
    assert encoded.first()["value"] is None
    decoded = wire.decode(records(spark, encoded), wire_format)
    row = decoded.first()
    assert row["car_id"] is None and row["event_time"] is None and row["error"] is None
    assert wire.good_readings(decoded).isEmpty() and wire.dead_letters(decoded).isEmpty()


def test_both_formats_decode_to_one_schema(spark):
    schemas = {
        wire.decode(records(spark, wire.encode(one_event(spark), name)), name).schema.simpleString()
        for name in wire.WIRE_FORMATS
    }
    assert len(schemas) == 1
    with pytest.raises(ValueError):
        wire.decode(one_event(spark), "avro")


def test_bad_payloads_become_dead_letters(spark):
    good = bytes(codec.encode(*arrays([("CAR-01", "speed", 5, 0, 1.5, 7)]))[0].as_py())
    payloads = [good, good[:-1] + b"\xff", b"\x07", b"\x00\x01", b"\x0a\x05ab", b"\x0a\x02\xff\xfe", None, b""]
    raw = spark.createDataFrame([("k", p, 0, n, W) for n, p in enumerate(payloads)], "key string, value binary, partition int, offset bigint, timestamp timestamp")
    decoded = wire.decode(raw)
    assert values(wire.dead_letters(decoded), "offset", "error") == [
        (1, "truncated message"), (2, "unsupported wire type"), (3, "invalid field number"),
        (4, "truncated message"), (5, "invalid text"),
    ]
    assert values(wire.good_readings(decoded), "topic_offset") == [0, 7]
    bad_json = raw.withColumn("value", F.lit("{not json").cast("binary"))
    assert wire.dead_letters(wire.decode(bad_json, "json")).count() == len(payloads)


def test_json_without_a_required_field_is_a_dead_letter(spark):
    whole = '{"carId":"CAR-01","sensorId":"speed","timestamp":"2026-08-23T12:00:00Z","value":1.0,"sequenceNo":4}'
    texts = [whole, whole.replace('"CAR-01"', "null"), whole.replace('"value":1.0,', ""), whole.replace("12:00:00Z", "noon")]
    raw = spark.createDataFrame([("k", text.encode(), 0, n, W) for n, text in enumerate(texts)], "key string, value binary, partition int, offset bigint, timestamp timestamp")
    decoded = wire.decode(raw, "json")
    assert values(wire.dead_letters(decoded), "offset", "error") == [
        (1, "missing field"), (2, "missing field"), (3, "invalid time"),
    ]
    assert values(wire.good_readings(decoded), "topic_offset", "car_id") == [(0, "CAR-01")]


def test_a_record_without_time_takes_its_append_time(spark):
    raw = spark.createDataFrame([("k", b'{"carId":"CAR-01","sensorId":"speed","value":1.0,"sequenceNo":4}', 0, 0, W)], "key string, value binary, partition int, offset bigint, timestamp timestamp")
    assert wire.good_readings(wire.decode(raw, "json")).first()["event_time"] == W


def test_sizes_match_the_published_measurement(spark):
    sample = spark.range(10_000).select(
        F.format_string("CAR-%02d", F.col("id") % 20 + 1).alias("car_id"),
        F.lit("brake-temperature-front-left").alias("sensor_id"),
        (F.lit("2026-08-23 12:00:00").cast("timestamp") + F.expr("INTERVAL '0.002' SECOND") * F.col("id")).alias("event_time"),
        (F.lit(200) + F.col("id") % 800 + F.lit(0.123456)).alias("value"),
        F.col("id").alias("sequence_no"),
    )
    row = wire.wire_size_audit(sample).first()
    assert round(row["json_per_event"], 1) == 135.9 and round(row["protobuf_per_event"], 1) == 57.0
    assert row["protobuf_bytes"] < row["json_bytes"] and round(row["ratio"], 2) == 2.38
    first = wire.encode(sample.filter("sequence_no = 0")).select(F.octet_length("value")).first()[0]
    assert first < 60


def arrays(rows):
    cars, sensors, ms, ns, doubles, numbers = zip(*rows)
    return (
        pa.array(cars, pa.string()), pa.array(sensors, pa.string()), pa.array(ms, pa.int64()),
        pa.array(ns, pa.int32()), pa.array(doubles, pa.float64()), pa.array(numbers, pa.int64()),
    )


ROW = st.tuples(
    st.text(max_size=20), st.text(max_size=200), st.integers(-(2**63), 2**63 - 1), st.integers(0, 999_999),
    st.floats(allow_nan=False), st.integers(-(2**63), 2**63 - 1),
)


@settings(max_examples=100, deadline=None)
@given(st.lists(ROW, min_size=1, max_size=20))
def test_codec_round_trip(rows):
    got = codec.decode(codec.encode(*arrays(rows))).to_pylist()
    names = ["car_id", "sensor_id", "ms", "ns", "value", "sequence_no"]
    assert [tuple(row[name] for name in names) for row in got] == rows
    assert all(row["error"] is None for row in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=20))
def test_codec_survives_any_bytes(payloads):
    alone = [codec.decode(pa.array([payload], pa.binary())).to_pylist()[0] for payload in payloads]
    together = codec.decode(pa.array(payloads, pa.binary())).to_pylist()
    assert repr(alone) == repr(together)


def test_codec_agrees_with_the_protobuf_library():
    protobuf = pytest.importorskip("google.protobuf")
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    kinds = descriptor_pb2.FieldDescriptorProto
    fields = [("a", kinds.TYPE_STRING), ("b", kinds.TYPE_STRING), ("c", kinds.TYPE_INT64),
              ("d", kinds.TYPE_INT32), ("e", kinds.TYPE_DOUBLE), ("f", kinds.TYPE_INT64)]
    file = descriptor_pb2.FileDescriptorProto(name="t.proto", syntax="proto3")
    message = file.message_type.add(name="M")
    for number, (name, kind) in enumerate(fields, 1):
        message.field.add(name=name, number=number, type=kind, label=kinds.LABEL_OPTIONAL)
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    made = message_factory.GetMessageClass(pool.FindMessageTypeByName("M"))
    rng = np.random.default_rng(7)
    rows = [("CAR-07", "speed", int(n), int(n) % 1_000_000, float(n) / 3, -int(n)) for n in rng.integers(0, 2**62, 50)]
    rows += [("", "", 0, 0, 0.0, 0), ("é", "x" * 300, 1, 1, -0.0, 127), ("c", "s", -5, 999_999, 1e300, 128)]
    for row, payload in zip(rows, codec.encode(*arrays(rows)).to_pylist()):
        assert payload == made(**dict(zip("abcdef", row))).SerializeToString()


def test_sliced_columns_are_encoded_by_their_own_rows():
    columns = arrays([("a", "b", 1, 2, 3.0, 4), ("car", "sensor", 5, 6, 7.0, 8)])
    part = codec.encode(*[column.slice(1) for column in columns])
    assert part.to_pylist() == codec.encode(*columns).to_pylist()[1:]
    assert codec.decode(codec.encode(*columns).slice(1)).to_pylist()[0]["car_id"] == "car"


@pytest.mark.parametrize("millis", [2**62, -(2**63), 253_402_300_800_000, -62_135_596_800_001])
def test_a_time_no_calendar_has_is_a_dead_letter(spark, millis):
    payload = bytes(codec.encode(*arrays([("CAR-01", "speed", millis, 0, 1.5, 7)]))[0].as_py())
    raw = spark.createDataFrame([("k", payload, 0, 4, W)], "key string, value binary, partition int, offset bigint, timestamp timestamp")
    decoded = wire.decode(raw)
    assert values(wire.dead_letters(decoded), "offset", "error") == [(4, "invalid time")]
    assert wire.good_readings(decoded).isEmpty()


def test_broken_rollups_and_alerts_are_kept_apart(spark):
    whole = '{"carId":"C","sensorId":"s","windowLength":"PT1S","windowStart":"2026-08-23T12:00:00.000000Z","windowEnd":"2026-08-23T12:00:01.000000Z","count":1,"average":1.0,"minimum":1.0,"maximum":1.0}'
    texts = [whole, "{oops", whole.replace('"C"', "null"), whole.replace('"count":1,', ""), "[]"]
    raw = spark.createDataFrame([(text.encode(), W) for text in texts] + [(None, W)], "value binary, timestamp timestamp")
    assert wire.json_to_rollups(raw).count() == 1
    bad = wire.bad_records(wire.decode_rollups(raw))
    assert values(bad, "error") == ["invalid record", "invalid record", "missing field", "missing field"]
    assert wire.json_to_alerts(raw).isEmpty()
    assert wire.bad_records(wire.decode_alerts(raw)).count() == 5


def test_events_are_keyed_by_car_into_partitions(spark, place):
    topic = topics.Topic(topics.EVENTS, root=place)
    events = readings(spark, [(f"CAR-{n % 20 + 1:02d}", "speed", n, n) for n in range(200)])
    topics.write_events(events, topic)
    rows = topic.table(spark)
    assert rows.count() == 200
    assert rows.select("partition").distinct().count() > 1
    per_car = rows.groupBy("key").agg(F.countDistinct("partition").alias("n"))
    assert per_car.filter("n > 1").isEmpty()
    assert wire.good_readings(wire.decode(rows)).filter("car_id like 'CAR-%'").count() == 200


def test_topics_need_one_place(spark, place):
    with pytest.raises(ValueError):
        topics.Topic("t")
    with pytest.raises(ValueError):
        topics.Topic("t", root="a", servers="b")
    with pytest.raises(ValueError):
        topics.Topic("t", root=place).stream(spark, "latest")
    with pytest.raises(ValueError):
        topics.Topic("t", root=place).stream(spark, "middle", group="g")


def test_a_group_starts_at_the_latest_record_once(spark, place):
    """Its start is kept: a reader that comes back gets what was published meanwhile."""
    topic = topics.Topic("late", root=place)
    events = readings(spark, [speed(n, n) for n in range(30)])

    def read(group):
        stream = topics.read_events(spark, topic, starting="latest", group=group).writeStream.format("parquet")
        stream = stream.option("path", f"{place}/{group}").option("checkpointLocation", f"{place}/c-{group}")
        stream.trigger(availableNow=True).start().awaitTermination()
        return sorted(row["value"] for row in spark.read.schema("value double").parquet(f"{place}/{group}").collect())

    topics.write_events(events.filter("arrival < 10"), topic)
    assert read("first") == []
    topics.write_events(events.filter("arrival >= 10 and arrival < 20"), topic)
    assert read("second") == []
    topics.write_events(events.filter("arrival >= 20"), topic)
    assert read("first") == [float(n) for n in range(10, 30)]
    assert read("second") == [float(n) for n in range(20, 30)]
    assert topic.start_of(spark, "first") != topic.start_of(spark, "second")


def test_records_without_offsets_have_no_latest_place(spark, place):
    topic = topics.Topic("bare", root=place)
    topic.append(spark.createDataFrame([("k", b"v")], "key string, value binary"))
    with pytest.raises(ValueError):
        topic.stream(spark, "latest", group="g")


def test_rollup_json_round_trip(spark):
    from tachyline.operators.alerts import alerts_for
    from tachyline.operators.rollups import rollup
    from tachyline.schemas import alert_rules

    rows = rollup(readings(spark, [speed(0.25, 380.125), speed(0.5, 1)]), "1 second")
    at = F.current_timestamp().alias("timestamp")
    encoded = wire.rollups_to_json(rows)
    assert encoded.first()["key"] == "CAR-01|speed"
    back = wire.json_to_rollups(encoded.select("*", at)).drop("arrived_at")
    assert back.collect() == rows.collect()
    raised = alerts_for(rows, alert_rules(spark, [("speed", 350.0)]))
    back = wire.json_to_alerts(wire.alerts_to_json(raised).select("*", at)).drop("arrived_at")
    assert back.collect() == raised.collect()
