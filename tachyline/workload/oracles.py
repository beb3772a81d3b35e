"""The SQL each registered query is checked against, over the driver's tables."""

from __future__ import annotations

from tachyline.schemas import BASE_CHANNELS, DEFAULT_RULES, SEED_CHANNELS, SYNTHETIC_RATES, SYNTHETIC_SHAPES
from tachyline.workload.stores import DROPOUT, RULES


def _text(value: object) -> str:
    return f"'{value}'" if isinstance(value, str) else repr(value)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"CAST({v} AS DOUBLE)" if isinstance(v, float) else _text(v) for v in row) + ")" for row in rows)


def _catalogue(count: int) -> str:
    rows = [(number, *row) for number, row in enumerate(BASE_CHANNELS)]
    for k in range(count - len(BASE_CHANNELS)):
        rate, shape = SYNTHETIC_RATES[k % len(SYNTHETIC_RATES)], SYNTHETIC_SHAPES[k % len(SYNTHETIC_SHAPES)]
        rows.append((len(BASE_CHANNELS) + k, f"aux-channel-{k:03d}", "unit", 0.0, 100.0, rate, shape))
    return (
        f"catalogue AS (SELECT * FROM (VALUES {_values(rows)}) AS "
        "t(number, sensor_id, unit, minimum_value, maximum_value, rate_hz, shape))"
    )


def _rules(rules: list[tuple[str, float]]) -> str:
    return f"rules AS (SELECT * FROM (VALUES {_values(rules)}) AS t(sensor_id, maximum))"


READINGS = """readings AS (
  SELECT format('CAR-{:02d}', user_id % 5 + 1) AS car_id, event_type AS sensor_id,
         ts AS event_time, value, event_id AS sequence_no, event_id AS arrival
  FROM events)"""
CHANNELS = (
    _catalogue(len(BASE_CHANNELS))
    + """, laps AS (
  SELECT format('CAR-{:02d}', user_id % 5 + 1) AS car_id, c.sensor_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(event_id * 30) AS event_time,
         c.minimum_value + (c.maximum_value - c.minimum_value) * (e.value / 207.0::DOUBLE) AS value,
         event_id AS sequence_no, event_id AS arrival
  FROM events e JOIN catalogue c ON c.number = event_id % 40)"""
)


def _replay(source: str) -> str:
    """A dropout and its replay over ``source``, as ``replayed``."""
    columns = "car_id, sensor_id, event_time, value, sequence_no"
    return f"""span AS (
  SELECT min(arrival) AS first_held, max(arrival) AS last_held FROM {source}
  WHERE event_time >= TIMESTAMP '{DROPOUT["start"]}' AND event_time < TIMESTAMP '{DROPOUT["end"]}'),
held AS (SELECT r.* FROM {source} r, span WHERE arrival BETWEEN first_held AND last_held),
direct AS (
  SELECT r.* FROM {source} r, span WHERE arrival < first_held
     OR (arrival > last_held AND event_time < TIMESTAMP '{DROPOUT["replay_at"]}')),
rest AS (
  SELECT r.* FROM {source} r, span
  WHERE arrival > last_held AND event_time >= TIMESTAMP '{DROPOUT["replay_at"]}'),
again AS (SELECT * FROM direct ORDER BY arrival DESC LIMIT {DROPOUT["overlap"]}),
kept AS (SELECT * FROM held ORDER BY arrival LIMIT {DROPOUT["capacity"]}),
moves AS (
  SELECT cut, copies_up, cut + copies_up - first_held + 1 AS held_up,
         last_held + (cut + copies_up - first_held + 1) - greatest(cut, last_held) AS rest_up
  FROM (SELECT (SELECT max(arrival) FROM direct) AS cut,
               (SELECT max(arrival) FROM direct) - (SELECT min(arrival) FROM again) + 1 AS copies_up) x, span),
replayed AS (
  SELECT {columns}, arrival, false AS replayed FROM direct
  UNION ALL SELECT {columns}, arrival + copies_up, true FROM again, moves
  UNION ALL SELECT {columns}, arrival + held_up, true FROM kept, moves
  UNION ALL SELECT {columns}, arrival + rest_up, false FROM rest, moves)"""


REPLAYED = CHANNELS + ", " + _replay("laps")
MINUTES = """minutes AS (
  SELECT car_id, sensor_id, time_bucket(INTERVAL '1 minute', event_time) AS bucket, count(*) AS samples,
         avg(value) AS average, min(value) AS minimum, max(value) AS maximum
  FROM {source} GROUP BY ALL)"""
HOURS = """hours AS (
  SELECT car_id, sensor_id, time_bucket(INTERVAL '1 hour', bucket) AS bucket,
         CAST(sum(samples) AS BIGINT) AS samples, sum(average * samples) / sum(samples) AS average,
         min(minimum) AS minimum, max(maximum) AS maximum
  FROM minutes GROUP BY 1, 2, 3)"""
LENGTHS = {"PT1S": "1 second", "PT1M": "1 minute"}


def _window(source: str, code: str) -> str:
    width = LENGTHS[code]
    return f"""SELECT car_id, sensor_id, '{code}' AS window_length,
       time_bucket(INTERVAL '{width}', event_time) AS window_start,
       time_bucket(INTERVAL '{width}', event_time) + INTERVAL '{width}' AS window_end,
       count(*) AS "count", avg(value) AS average, min(value) AS minimum, max(value) AS maximum
FROM {source} GROUP BY ALL"""


SPREAD = f"""{READINGS}, spread AS (
  SELECT * REPLACE (TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(sequence_no * 7000) AS event_time)
  FROM readings)"""
LIVE = f"{CHANNELS}, lives AS ({_window('laps', 'PT1S')} UNION ALL {_window('laps', 'PT1M')})"
SECONDS = f"{CHANNELS}, seconds AS ({_window('laps', 'PT1S')})"
ALERTS = """alerts AS (
  SELECT r.car_id, r.sensor_id, r.window_start, r.window_end, r.maximum AS observed_maximum, u.maximum AS threshold
  FROM {rollups} r JOIN rules u ON r.sensor_id = u.sensor_id AND r.maximum > u.maximum)"""
RAISED = f"{LIVE}, {_rules(RULES)}, {ALERTS.format(rollups='lives')}"
BREACHES = """breaches AS (
  SELECT car_id, sensor_id, observed_maximum, threshold, observed_maximum - threshold AS excess, window_end AS "at"
  FROM alerts QUALIFY row_number() OVER (
    PARTITION BY car_id ORDER BY window_end DESC, window_start DESC, sensor_id DESC, threshold DESC) = 1)"""
ROLLUP = "car_id, sensor_id, bucket, samples, round(average, 6) AS average, minimum, maximum"
ROUNDED = (
    "car_id, sensor_id, bucket, samples, round(average, 6) AS average, "
    "round(minimum, 6) AS minimum, round(maximum, 6) AS maximum"
)
LIVE_ROW = (
    'car_id, sensor_id, window_length, window_start, window_end, "count", '
    "round(average, 6) AS average, round(minimum, 6) AS minimum, round(maximum, 6) AS maximum"
)
ALERT = "car_id, sensor_id, window_start, window_end, round(observed_maximum, 6) AS observed_maximum, threshold"
READING = "car_id, sensor_id, event_time, round(value, 6) AS value, sequence_no"
EVENT_MINUTES = f"WITH {READINGS}, {MINUTES.format(source='readings')}"
LAP_MINUTES = f"WITH {CHANNELS}, {MINUTES.format(source='laps')}"
KEYED = "copies AS (SELECT car_id, sensor_id, event_time, count(*) AS copies FROM replayed GROUP BY 1, 2, 3)"
FIRST = """firsts AS (
  SELECT * FROM replayed QUALIFY row_number() OVER (
    PARTITION BY car_id, sensor_id, event_time ORDER BY arrival) = 1)"""
LATE = """timed AS (
  SELECT *, max(event_time) OVER (
    PARTITION BY car_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stream_time,
    time_bucket(INTERVAL '1 second', event_time) + INTERVAL '1 second' AS window_end
  FROM replayed),
audited AS (
  SELECT car_id, sensor_id, event_time, arrival, window_end, stream_time,
         window_end <= stream_time - INTERVAL '2 seconds' AS late,
         epoch_us(stream_time) - epoch_us(event_time) AS lateness_us
  FROM timed)"""
COUNTERS = """per_second AS (
  SELECT car_id, time_bucket(INTERVAL '1 second', event_time) AS "at", count(*) AS n FROM laps GROUP BY 1, 2),
counters AS (
  SELECT car_id, "at", CAST(sum(n) OVER (PARTITION BY car_id ORDER BY "at") AS BIGINT) AS counter FROM per_second),
steps AS (
  SELECT *, counter - lag(counter) OVER (PARTITION BY car_id ORDER BY "at") AS step FROM counters),
rates AS (
  SELECT car_id, "at", counter, CAST(sum(coalesce(step, 0)) OVER (
    PARTITION BY car_id ORDER BY "at"
    RANGE BETWEEN INTERVAL '29999999 microseconds' PRECEDING AND CURRENT ROW) AS DOUBLE) / 30 AS rate
  FROM steps)"""
OFFSETS = """latest AS (SELECT user_id % 12 AS "partition", max(event_id) AS "offset" FROM events GROUP BY 1),
done AS (
  SELECT user_id % 12 AS "partition", max(event_id) AS "offset" FROM events
  WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1),
lags AS (
  SELECT l."partition", l."offset" - coalesce(d."offset", 0) AS lag
  FROM latest l LEFT JOIN done d ON l."partition" = d."partition")"""


def _varint(number: str) -> str:
    steps = " ".join(f"WHEN {number} < {1 << (7 * k)} THEN {k}" for k in range(1, 9))
    return f"CASE {steps} ELSE 9 END"


def _sizes() -> str:
    return f"""parts AS (
  SELECT *, epoch_us(event_time) // 1000 AS ms, (epoch_us(event_time) % 1000) * 1000 AS ns FROM readings),
sizes AS (
  SELECT 2 + octet_length(encode(car_id)) + 2 + octet_length(encode(sensor_id)) + 1 + {_varint("ms")}
         + CASE WHEN ns = 0 THEN 0 ELSE 1 + {_varint("ns")} END + CASE WHEN value = 0 THEN 0 ELSE 9 END
         + CASE WHEN sequence_no = 0 THEN 0 ELSE 1 + {_varint("sequence_no")} END AS protobuf,
         octet_length(encode('{{"carId":"' || car_id || '","sensorId":"' || sensor_id || '","timestamp":"'
           || strftime(event_time, '%Y-%m-%dT%H:%M:%S')
           || CASE WHEN epoch_us(event_time) % 1000000 = 0 THEN ''
                   WHEN ns = 0 THEN '.' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0')
                   ELSE '.' || lpad(CAST(epoch_us(event_time) % 1000000 AS VARCHAR), 6, '0') END
           || 'Z","value":' || CAST(value AS VARCHAR) || ',"sequenceNo":' || CAST(sequence_no AS VARCHAR) || '}}')) AS json
  FROM parts)"""


def _dense() -> str:
    ranges = {name: (low, high) for name, _, low, high, _, _ in BASE_CHANNELS}
    rows = [(name, *ranges[name]) for name in SEED_CHANNELS]
    return f"""seed(sensor_id, low, high) AS (VALUES {_values(rows)}),
dense AS (
  SELECT format('CAR-{{:02d}}', user_id % 5 + 1) AS car_id, sensor_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(event_id * 30) AS event_time,
         low + (high - low) * (0.5::DOUBLE + 0.45::DOUBLE * sin(event_id / 3000.0::DOUBLE + (user_id % 5 + 1))) AS value
  FROM events, seed)"""


def _closed(grace: str) -> str:
    return f"window_end <= (SELECT max(event_time) FROM laps) - INTERVAL '{grace}'"


def _on_time(source: str) -> str:
    """Readings whose window is still open by the stream time of the part before."""
    return f"""turn AS (SELECT min(arrival) AS turn FROM replayed WHERE replayed),
past AS (SELECT max(event_time) - INTERVAL '2 seconds' AS mark FROM replayed, turn WHERE arrival < turn),
on_time AS (
  SELECT s.* FROM {source} s, turn, past
  WHERE arrival < turn OR time_bucket(INTERVAL '1 second', event_time) + INTERVAL '1 second' > mark)"""


def _current(sensor: str, column: str = "average") -> str:
    return f"arg_max({column}, window_end) FILTER (WHERE sensor_id = '{sensor}')"


def _peak(sensor: str) -> str:
    return f"max(maximum) FILTER (WHERE sensor_id = '{sensor}')"


ANOMALY = """CASE WHEN l.car_id = '{car}' AND l.sensor_id = '{sensor}'
       THEN c.maximum_value + 0.25::DOUBLE * (c.maximum_value - c.minimum_value) ELSE l.value END"""


def _board(raised: str) -> str:
    return f"""WITH {raised}, {BREACHES},
      now_at AS (SELECT max(window_end) AS now_at FROM lives WHERE window_length = 'PT1S'),
      cards AS (SELECT car_id, max(window_end) FILTER (WHERE sensor_id = 'speed') AS last_seen,
          {_current('speed')} AS speed, {_current('engine-rpm')} AS engine_rpm,
          CAST(floor({_current('gear')} + 0.5) AS BIGINT) AS gear,
          {_current('throttle-position')} AS throttle, {_current('brake-pressure')} AS brake,
          sum(average * "count") FILTER (WHERE sensor_id = 'speed')
            / sum("count") FILTER (WHERE sensor_id = 'speed') AS average_speed,
          {_peak('speed')} AS top_speed, {_peak('brake-temperature-front-left')} AS brake_fl_peak
        FROM lives WHERE window_length = 'PT1S' GROUP BY 1),
      held_breaches AS (SELECT b.* FROM breaches b, now_at WHERE "at" + INTERVAL '30 seconds' >= now_at)
      SELECT c.car_id, round(speed, 6) AS speed, round(engine_rpm, 6) AS engine_rpm, gear,
        round(throttle, 6) AS throttle, round(brake, 6) AS brake, round(average_speed, 6) AS average_speed,
        round(top_speed, 6) AS top_speed, round(brake_fl_peak, 6) AS brake_fl_peak,
        coalesce(last_seen + INTERVAL '6 seconds' >= now_at, false) AS has_signal, b.sensor_id AS breach_sensor,
        round(b.observed_maximum, 6) AS breach_observed, b.threshold AS breach_threshold
      FROM cards c CROSS JOIN now_at LEFT JOIN held_breaches b ON b.car_id = c.car_id"""


def _by_arrival(n: int) -> str:
    """The alerts that came last, each car's some seconds after its windows."""
    return f"""WITH {RAISED}, arrived AS (
        SELECT *, window_end + to_seconds(7 * CAST(car_id[5:6] AS INTEGER)) AS arrived_at FROM alerts)
      SELECT {ALERT}, arrived_at FROM (SELECT * FROM arrived
        ORDER BY arrived_at DESC, car_id, sensor_id, window_start, threshold LIMIT {n})"""


def _third(rows: str, column: str, part: int) -> str:
    """The end of a part of ``rows`` when its time is cut into three."""
    return f"""(SELECT make_timestamp(epoch_us(min({column})) + (epoch_us(max({column})) - epoch_us(min({column}))) * {part} // 3)
      FROM {rows})"""


def _raised_until(part: int) -> str:
    every = LIVE.replace("lives AS (", "every_live AS (")
    return f"""{every}, lives AS (SELECT * FROM every_live WHERE window_end <= {_third("every_live", "window_end", part)}),
      {_rules(RULES)}, {ALERTS.format(rollups="lives")}"""


def _changes(events: str, hold: int, payload: str, every: bool) -> str:
    """On and off of what an event holds for some seconds; the last off needs stream time to pass it."""
    turns = "true" if every else f"before IS NULL OR before + INTERVAL '{hold} seconds' < \"at\""
    none = ", ".join(f"NULL AS {name}" for name in payload.split(", ") if name)
    comma = ", " if payload else ""
    return f"""steps AS (
        SELECT *, lag("at") OVER w AS before, lead("at") OVER w AS after FROM {events} WINDOW w AS (PARTITION BY car_id ORDER BY "at")),
      ends AS (SELECT max("at") - INTERVAL '10 seconds' AS watermark FROM {events}),
      changes AS (
        SELECT car_id, "at", true AS active{comma}{payload} FROM steps
        WHERE {turns}
        UNION ALL SELECT car_id, "at" + INTERVAL '{hold} seconds', false{comma}{none} FROM steps, ends
        WHERE coalesce(after, watermark) > "at" + INTERVAL '{hold} seconds')"""


ORACLES: dict[str, str] = {
    "rollup_1m": f"{EVENT_MINUTES} SELECT {ROLLUP} FROM minutes",
    "rollup_1h": f"{EVENT_MINUTES}, {HOURS} SELECT {ROLLUP} FROM hours",
    "live_rollups": f"WITH {LIVE} SELECT {LIVE_ROW} FROM lives",
    "rollups_emitted": f"WITH {LIVE} SELECT window_length, count(*) AS rollups FROM lives GROUP BY 1",
    "dense_series_1m": f"WITH {_dense()}, {MINUTES.format(source='dense')} SELECT {ROUNDED} FROM minutes",
    "threshold_alerts": f"WITH {RAISED} SELECT {ALERT} FROM alerts",
    "alerts_fired": f"WITH {RAISED} SELECT sensor_id, count(*) AS alerts FROM alerts GROUP BY 1",
    "recent_alerts": f"""WITH {RAISED} SELECT {ALERT} FROM (SELECT * FROM alerts
        ORDER BY window_end DESC, car_id, sensor_id, window_start, threshold LIMIT 200)""",
    "breach_list": f"""WITH {RAISED} SELECT {ALERT} FROM (SELECT * FROM alerts
        ORDER BY window_end DESC, car_id, sensor_id, window_start, threshold LIMIT 100)""",
    "latest_breach": f"""WITH {RAISED}, {BREACHES} SELECT car_id, sensor_id,
        round(observed_maximum, 6) AS observed_maximum, threshold, round(excess, 6) AS excess, "at" FROM breaches""",
    "active_breach": f"""WITH {RAISED}, {BREACHES} SELECT car_id, sensor_id,
        round(observed_maximum, 6) AS observed_maximum, threshold, round(excess, 6) AS excess, "at" FROM breaches
        WHERE "at" + INTERVAL '30 seconds'
          >= (SELECT max(window_end) FROM lives WHERE window_length = 'PT1S')""",
    "anomaly_alerts": f"""WITH {CHANNELS}, flagged AS (
        SELECT l.* REPLACE ({ANOMALY.format(car='CAR-02', sensor='engine-rpm')} AS value)
        FROM laps l JOIN catalogue c ON l.sensor_id = c.sensor_id),
      windows AS ({_window('flagged', 'PT1M')}), {_rules(DEFAULT_RULES)}, {ALERTS.format(rollups='windows')}
      SELECT {ALERT} FROM alerts""",
    "session_stats": f"""WITH {SECONDS} SELECT car_id, sensor_id, round(max(maximum), 6) AS peak,
        round(sum(average * "count") / sum("count"), 6) AS mean, CAST(sum("count") AS BIGINT) AS samples
        FROM seconds GROUP BY 1, 2""",
    "latest_reading": f"""WITH {SECONDS} SELECT car_id, sensor_id, window_start, "count",
        round(average, 6) AS average, round(minimum, 6) AS minimum, round(maximum, 6) AS maximum, window_end
        FROM seconds QUALIFY row_number() OVER (PARTITION BY car_id, sensor_id ORDER BY window_end DESC) = 1""",
    "live_signal": f"""WITH {SECONDS}, seen AS (
        SELECT car_id, max(window_end) FILTER (WHERE sensor_id = 'speed') AS last_seen FROM seconds GROUP BY 1)
      SELECT car_id, last_seen, coalesce(last_seen + INTERVAL '6 seconds'
        >= (SELECT max(window_end) FROM seconds), false) AS has_signal FROM seen""",
    "live_board": _board(RAISED),
    "other_cars": f"""WITH {SECONDS} SELECT car_id, round({_current('speed')}, 6) AS speed FROM seconds
        WHERE car_id NOT IN ('CAR-01', 'CAR-02') GROUP BY 1""",
    "channel_context": f"""{LAP_MINUTES} SELECT m.car_id, m.sensor_id, bucket, samples,
        round(average, 6) AS average, round(minimum, 6) AS minimum, round(maximum, 6) AS maximum,
        unit, minimum_value, maximum_value,
        round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (average - minimum_value) / (maximum_value - minimum_value))), 6)
          AS fraction
      FROM minutes m LEFT JOIN catalogue c ON m.sensor_id = c.sensor_id""",
    "lane_scale": f"""{EVENT_MINUTES}, spans AS (
        SELECT car_id, sensor_id, min(average) AS low, max(average) AS high FROM minutes GROUP BY 1, 2)
      SELECT m.car_id, m.sensor_id, bucket, samples, round(average, 6) AS average, minimum, maximum,
        round(low, 6) AS low, round(high, 6) AS high,
        round((average - low) / coalesce(nullif(high - low, 0), 1), 6) AS lane
      FROM minutes m JOIN spans s ON m.car_id = s.car_id AND m.sensor_id = s.sensor_id""",
    "find_rollups_1m": f"""{EVENT_MINUTES} SELECT {ROLLUP}, false AS truncated FROM minutes
        WHERE car_id = 'CAR-01' AND sensor_id = 'click' AND bucket >= TIMESTAMP '2024-01-08 00:00:00'
          AND bucket < TIMESTAMP '2024-01-12 00:00:00'""",
    "find_rollups_1h": f"""{EVENT_MINUTES}, {HOURS} SELECT {ROLLUP}, count(*) OVER () > 100 AS truncated FROM hours
        WHERE car_id = 'CAR-03' AND sensor_id = 'view' AND bucket >= TIMESTAMP '2024-01-05 12:00:00'
          AND bucket < TIMESTAMP '2024-01-20 07:00:00' ORDER BY bucket LIMIT 100""",
    "find_channels": f"""{EVENT_MINUTES} SELECT {ROLLUP}, truncated FROM (
        SELECT *, count(*) OVER (PARTITION BY car_id, sensor_id) > 50 AS truncated FROM minutes
        WHERE car_id = 'CAR-02' AND sensor_id IN ('click', 'view', 'purchase')
          AND bucket >= TIMESTAMP '2024-01-03 00:00:00' AND bucket < TIMESTAMP '2024-01-25 00:00:00'
        QUALIFY row_number() OVER (PARTITION BY car_id, sensor_id ORDER BY bucket) <= 50)""",
    "cars": f"WITH {READINGS} SELECT DISTINCT car_id FROM readings ORDER BY 1",
    "sensors": f"WITH {READINGS} SELECT DISTINCT sensor_id FROM readings ORDER BY 1",
    "channel_order": f"""WITH {_catalogue(60)}, {READINGS}, seen AS (SELECT DISTINCT sensor_id FROM readings)
      SELECT sensor_id FROM (SELECT sensor_id FROM seen UNION SELECT sensor_id FROM catalogue)
      ORDER BY starts_with(sensor_id, 'aux-channel-'), sensor_id""",
    "search_channels": f"""WITH {READINGS} SELECT DISTINCT sensor_id FROM readings
        WHERE contains(lower(sensor_id), 'ie')""",
    "integrity_check": f"""WITH {REPLAYED}, {KEYED} SELECT CAST(sum(copies) AS BIGINT) AS "rows",
        count(*) AS distinct_readings, CAST(sum(copies - 1) AS BIGINT) AS duplicates FROM copies""",
    "duplicated_readings": f"WITH {REPLAYED}, {KEYED} SELECT * FROM copies WHERE copies > 1",
    "first_arrival": f"WITH {REPLAYED}, {FIRST} SELECT {READING}, arrival, replayed FROM firsts",
    "dedupe_existing": f"WITH {REPLAYED}, {FIRST} SELECT {READING} FROM firsts",
    "reject_stored": f"""WITH {REPLAYED} SELECT {READING}, arrival FROM replayed r WHERE replayed
        AND NOT EXISTS (SELECT 1 FROM replayed s WHERE NOT s.replayed AND s.car_id = r.car_id
          AND s.sensor_id = r.sensor_id AND s.event_time = r.event_time)""",
    "replay_audit": f"""WITH {REPLAYED}, {KEYED}, totals AS (
        SELECT CAST(sum(copies) AS BIGINT) AS published, count(*) AS distinct_readings FROM copies)
      SELECT published, distinct_readings, 'unkeyed' AS layout, published AS written,
        CAST(0 AS BIGINT) AS rejected, published - distinct_readings AS duplicates_stored FROM totals
      UNION ALL SELECT published, distinct_readings, 'keyed', distinct_readings, published - distinct_readings,
        CAST(0 AS BIGINT) FROM totals""",
    "dropout_replay": f"WITH {REPLAYED} SELECT {READING}, arrival, replayed FROM replayed",
    "dropped_by_buffer": f"""WITH {REPLAYED} SELECT {READING}, arrival FROM held
        WHERE arrival > (SELECT max(arrival) FROM kept) OR (SELECT count(*) FROM kept) = 0""",
    "last_delivered": f"""WITH {CHANNELS} SELECT {READING}, arrival FROM (SELECT * FROM laps
        WHERE arrival < (SELECT max(arrival) // 2 FROM laps) ORDER BY arrival DESC LIMIT 500)""",
    "inject_anomaly": f"""WITH {CHANNELS} SELECT {READING}, arrival FROM (
        SELECT l.* REPLACE ({ANOMALY.format(car='CAR-04', sensor='speed')} AS value)
        FROM laps l JOIN catalogue c ON l.sensor_id = c.sensor_id)""",
    "late_audit": f"WITH {REPLAYED}, {LATE} SELECT * FROM audited",
    "late_summary": f"""WITH {REPLAYED}, {LATE} SELECT car_id, count(*) AS readings,
        count(*) FILTER (WHERE late) AS late_readings, max(lateness_us) / 1e6::DOUBLE AS worst_lateness_s
        FROM audited GROUP BY 1""",
    "sequence_gaps": f"""WITH {CHANNELS}, sent AS (
        SELECT * REPLACE (row_number() OVER (PARTITION BY car_id, sensor_id,
          event_time >= TIMESTAMP '2024-01-01 00:00:22' ORDER BY arrival) AS sequence_no) FROM laps),
      {_replay('sent')}, {FIRST}, steps AS (
        SELECT *, lag(sequence_no) OVER (PARTITION BY car_id, sensor_id ORDER BY event_time) AS previous_no
        FROM firsts)
      SELECT car_id, sensor_id, event_time, previous_no, sequence_no,
        CASE WHEN sequence_no - previous_no > 1 THEN 'gap' ELSE 'restart' END AS kind,
        CASE WHEN sequence_no - previous_no > 1 THEN sequence_no - previous_no - 1 ELSE 0 END AS missing
      FROM steps WHERE sequence_no - previous_no > 1 OR sequence_no < previous_no""",
    "systematic_sample": f"""WITH {CHANNELS} SELECT {READING}, arrival FROM (SELECT * FROM laps
        QUALIFY row_number() OVER (PARTITION BY car_id, sensor_id ORDER BY arrival) % 3 = 0)""",
    "count_by_sensor": f"WITH {READINGS} SELECT sensor_id, count(*) AS readings FROM readings GROUP BY 1",
    "car_summary": f"""WITH {READINGS} SELECT car_id, count(*) AS readings, max(event_time) AS latest
        FROM readings GROUP BY 1 ORDER BY 1""",
    "events_per_second": f"""WITH {CHANNELS} SELECT time_bucket(INTERVAL '1 second', event_time) AS second,
        count(*) AS readings FROM laps GROUP BY 1""",
    "nan_audit": f"""WITH {READINGS} SELECT sensor_id, count(*) AS readings,
        count(*) FILTER (WHERE isnan(value)) AS nan_values FROM readings GROUP BY 1""",
    "counter_rate": f"""WITH {CHANNELS}, {COUNTERS}
        SELECT car_id, "at", counter, round(rate, 6) AS rate FROM rates""",
    "rate_by_label": f"""WITH {CHANNELS}, {COUNTERS}
        SELECT "at", round(sum(rate), 6) AS rate FROM rates GROUP BY 1""",
    "consumer_lag": f"WITH {OFFSETS} SELECT * FROM lags",
    "max_lag": f"WITH {OFFSETS} SELECT max(lag) AS max_lag FROM lags",
    "skew_report": f"""WITH {READINGS}, counts AS (
        SELECT car_id, sensor_id, count(*) AS readings FROM readings GROUP BY 1, 2)
      SELECT car_id, sensor_id, readings,
        round(readings / CAST((SELECT sum(readings) FROM counts) AS DOUBLE), 6) AS share,
        round(readings / (SELECT avg(readings) FROM counts), 6) AS to_mean FROM counts""",
    "partition_skew": """WITH counts AS (SELECT user_id % 12 AS "partition", count(*) AS readings FROM events GROUP BY 1)
      SELECT "partition", readings,
        round(readings / CAST((SELECT sum(readings) FROM counts) AS DOUBLE), 6) AS share,
        round(readings / (SELECT avg(readings) FROM counts), 6) AS to_mean FROM counts""",
    "target_rate": f"""WITH {CHANNELS} SELECT CAST(floor(1.5 * (SELECT count(DISTINCT car_id) FROM laps)
        * sum(rate_hz) + 0.5) AS BIGINT) AS target_events_per_second
        FROM catalogue WHERE sensor_id IN (SELECT sensor_id FROM laps)""",
    "scaled_channel_rates": f"""WITH {_catalogue(60)}, counted AS (
        SELECT event_id % 40 AS number, count(*) AS readings FROM events GROUP BY 1)
      SELECT sensor_id, unit, minimum_value, maximum_value, CAST(rate_hz AS INTEGER) AS rate_hz, shape,
        rate_hz * 6.0::DOUBLE AS effective_rate_hz,
        greatest(CAST(trunc((1000000000 // rate_hz) / 6.0::DOUBLE) AS BIGINT), 1000) AS period_ns,
        coalesce(readings, 0) AS readings
      FROM catalogue c LEFT JOIN counted n ON n.number = c.number""",
    "catalogue_coverage": f"""WITH {_catalogue(60)}, counted AS (
        SELECT event_id % 40 AS number, count(*) AS readings FROM events GROUP BY 1)
      SELECT sensor_id, unit, minimum_value, maximum_value, CAST(rate_hz AS INTEGER) AS rate_hz, shape,
        coalesce(readings, 0) AS readings FROM catalogue c LEFT JOIN counted n ON n.number = c.number""",
    "wire_size_audit": f"""WITH {READINGS}, {_sizes()}, totals AS (
        SELECT count(*) AS events, CAST(sum(protobuf) AS BIGINT) AS protobuf_bytes,
          CAST(sum(json) AS BIGINT) AS json_bytes FROM sizes)
      SELECT *, round(protobuf_bytes / events, 6) AS protobuf_per_event,
        round(json_bytes / events, 6) AS json_per_event, round(json_bytes / protobuf_bytes, 6) AS ratio FROM totals""",
    "dead_letter_counts": f"""WITH {READINGS} SELECT
        CASE WHEN sensor_id = 'error' THEN 'truncated message' END AS error, count(*) AS records
        FROM readings GROUP BY 1""",
    "event_time_fallback": f"WITH {READINGS} SELECT car_id, sensor_id, event_time, sequence_no FROM readings",
    "published_partitions": f"""WITH {READINGS} SELECT car_id, count(*) AS records,
        CAST(1 AS BIGINT) AS partitions, min(arrival) AS first_offset, max(arrival) AS last_offset
        FROM readings GROUP BY 1""",
    "stored_readings": f"WITH {REPLAYED}, {FIRST} SELECT {READING}, arrival FROM firsts",
    "ingest_metrics": f"""WITH {REPLAYED}, {FIRST}, bounds AS (
        SELECT min(arrival) AS low, max(arrival) - min(arrival) + 1 AS width FROM replayed),
      parts(batch_id) AS (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT))),
      edges AS (SELECT batch_id, low + width * batch_id // 3 AS start_at, low + width * (batch_id + 1) // 3 AS end_at
        FROM parts, bounds)
      SELECT batch_id,
        (SELECT count(*) FROM replayed WHERE arrival >= start_at AND arrival < end_at) AS consumed,
        (SELECT count(*) FROM firsts WHERE arrival >= start_at AND arrival < end_at) AS written,
        (SELECT count(*) FROM replayed WHERE arrival >= start_at AND arrival < end_at)
          - (SELECT count(*) FROM firsts WHERE arrival >= start_at AND arrival < end_at) AS duplicates
      FROM edges""",
    "ingest_summary": f"""WITH {REPLAYED}, {FIRST}, bounds AS (
        SELECT min(arrival) AS low, max(arrival) - min(arrival) + 1 AS width FROM replayed),
      parts(batch_id) AS (VALUES (0), (1), (2)),
      edges AS (SELECT low + width * batch_id // 3 AS start_at, low + width * (batch_id + 1) // 3 AS end_at
        FROM parts, bounds),
      batches AS (SELECT (SELECT count(*) FROM replayed WHERE arrival >= start_at AND arrival < end_at) AS consumed
        FROM edges),
      totals AS (SELECT CAST(sum(consumed) AS BIGINT) AS consumed, max(consumed) AS largest_batch,
          quantile_cont(consumed, 0.5) AS batch_p50, quantile_cont(consumed, 0.95) AS batch_p95 FROM batches)
      SELECT consumed AS received, CAST(0 AS BIGINT) AS null_records, CAST(0 AS BIGINT) AS dead_letters, consumed,
        (SELECT count(*) FROM firsts) AS written, consumed - (SELECT count(*) FROM firsts) AS duplicates,
        largest_batch, CAST(batch_p50 AS DOUBLE) AS batch_p50, CAST(batch_p95 AS DOUBLE) AS batch_p95 FROM totals""",
    "record_accounting": f"""WITH {READINGS}, goods AS (SELECT * FROM readings WHERE sequence_no % 8 NOT IN (1, 3, 5)),
      totals AS (SELECT (SELECT count(*) FROM readings) AS received,
        (SELECT count(*) FROM readings WHERE sequence_no % 8 = 3) AS null_records,
        (SELECT count(*) FROM readings WHERE sequence_no % 8 IN (1, 5)) AS dead_letters,
        (SELECT count(*) FROM goods) AS consumed,
        (SELECT count(*) FROM (SELECT DISTINCT car_id, sensor_id, event_time FROM goods)) AS written)
      SELECT *, consumed - written AS duplicates FROM totals""",
    "stored_dead_letters": f"""WITH {READINGS} SELECT
        CASE sequence_no % 8 WHEN 1 THEN 'truncated message' ELSE 'invalid time' END AS error,
        count(*) AS records, CAST(sum(sequence_no) AS BIGINT) AS offsets
      FROM readings WHERE sequence_no % 8 IN (1, 5) GROUP BY 1""",
    "unkeyed_append": f"""WITH {REPLAYED}, {KEYED} SELECT CAST(sum(copies) AS BIGINT) AS "rows",
        count(*) AS distinct_readings, CAST(sum(copies - 1) AS BIGINT) AS duplicates FROM copies""",
    "migrated_readings": f"WITH {REPLAYED}, {FIRST} SELECT {READING} FROM firsts",
    "refreshed_rollup_1m": f"""{LAP_MINUTES} SELECT {ROUNDED} FROM minutes
        WHERE bucket < time_bucket(INTERVAL '1 minute',
          (SELECT max(event_time) FROM laps) - INTERVAL '1 minute')
        OR (bucket < TIMESTAMP '2024-01-01 00:01:00')""",
    "refreshed_rollup_1h": f"""{EVENT_MINUTES}, {HOURS}, ends AS (SELECT max(event_time) AS now_at FROM readings)
      SELECT {ROLLUP} FROM hours, ends
        WHERE bucket >= now_at - INTERVAL '7 days'
          AND bucket < time_bucket(INTERVAL '1 hour', now_at - INTERVAL '1 hour')""",
    "stepwise_rollup_1m": f"""WITH {SPREAD}, {MINUTES.format(source='spread')},
      ends AS (SELECT max(event_time) AS now_at FROM spread)
      SELECT {ROLLUP} FROM minutes, ends WHERE bucket < time_bucket(INTERVAL '1 minute', now_at - INTERVAL '1 minute')""",
    "stepwise_rollup_1h": f"""WITH {SPREAD}, {MINUTES.format(source='spread')}, {HOURS},
      ends AS (SELECT max(event_time) AS now_at FROM spread)
      SELECT {ROLLUP} FROM hours, ends WHERE bucket < time_bucket(INTERVAL '1 hour', now_at - INTERVAL '1 hour')""",
    "archived_twice": f"""WITH {READINGS}, ends AS (SELECT max(event_time) - INTERVAL '7 days' AS cut FROM readings),
      both_batches AS (SELECT CAST(0 AS BIGINT) AS batch_id, car_id, event_time, sequence_no FROM readings
        UNION ALL SELECT 1, 'CAR-77', event_time, sequence_no FROM readings WHERE sequence_no % 10 = 0
          QUALIFY row_number() OVER (PARTITION BY sensor_id, event_time ORDER BY arrival) = 1)
      SELECT batch_id, car_id, count(*) AS readings, CAST(sum(sequence_no) AS BIGINT) AS numbers
      FROM both_batches, ends WHERE time_bucket(INTERVAL '1 day', event_time) + INTERVAL '1 day' <= cut GROUP BY 1, 2""",
    "storage_report": f"""{EVENT_MINUTES}, {HOURS} SELECT 'raw' AS layout,
        (SELECT count(*) FROM (SELECT DISTINCT car_id, sensor_id, event_time FROM readings)) AS "rows",
        true AS has_files, true AS has_bytes
      UNION ALL SELECT 'rollup_1m', (SELECT count(*) FROM minutes), true, true
      UNION ALL SELECT 'rollup_1h', (SELECT count(*) FROM hours), true, true""",
    "backfilled_rollup_1h": f"{EVENT_MINUTES}, {HOURS} SELECT {ROLLUP} FROM hours",
    "compacted_readings": f"WITH {REPLAYED}, {FIRST} SELECT {READING}, arrival, 1 AS batches FROM firsts",
    "retained_readings": f"""WITH {READINGS}, ends AS (SELECT max(event_time) - INTERVAL '7 days' AS cut FROM readings)
      SELECT CASE WHEN time_bucket(INTERVAL '1 day', event_time) + INTERVAL '1 day' <= cut
                  THEN 'archive' ELSE 'raw' END AS tier,
        sensor_id, count(*) AS readings, min(event_time) AS oldest, max(event_time) AS latest
      FROM readings, ends GROUP BY 1, 2""",
    "protobuf_round_trip": f"""WITH {READINGS} SELECT car_id, sensor_id, event_time, value, sequence_no,
        CAST((epoch_us(event_time) % 1000) * 1000 AS INTEGER) AS ts_ns_remainder FROM readings""",
    "json_round_trip": f"""WITH {READINGS} SELECT car_id, sensor_id, event_time, value, sequence_no,
        CAST((epoch_us(event_time) % 1000) * 1000 AS INTEGER) AS ts_ns_remainder FROM readings""",
    "stream_rollups_1s": f"WITH {LIVE} SELECT {LIVE_ROW} FROM lives WHERE window_length = 'PT1S' AND {_closed('10 seconds')}",
    "stream_rollups_1m": f"WITH {LIVE} SELECT {LIVE_ROW} FROM lives WHERE window_length = 'PT1M' AND {_closed('10 seconds')}",
    "stream_alerts": f"""WITH {LIVE}, closed AS (
        SELECT * FROM lives WHERE {_closed('10 seconds')}),
      {_rules(RULES)}, {ALERTS.format(rollups='closed')} SELECT {ALERT} FROM alerts""",
    "stream_session_stats": f"""WITH {LIVE} SELECT car_id, sensor_id, round(max(maximum), 6) AS peak,
        round(sum(average * "count") / sum("count"), 6) AS mean, CAST(sum("count") AS BIGINT) AS samples
        FROM lives WHERE window_length = 'PT1S' AND {_closed('10 seconds')} GROUP BY 1, 2""",
    "stream_ingest": f"WITH {CHANNELS} SELECT {READING} FROM laps",
    "stream_late_rollups": f"""WITH {REPLAYED}, {_on_time('replayed')}, seconds AS ({_window('on_time', 'PT1S')})
      SELECT {LIVE_ROW} FROM seconds WHERE {_closed('2 seconds')}""",
    "stream_dedup_rollups": f"""WITH {REPLAYED}, {FIRST}, {_on_time('firsts')},
      seconds AS ({_window('on_time', 'PT1S')}) SELECT {LIVE_ROW} FROM seconds WHERE {_closed('2 seconds')}""",
    "stream_dropped": f"""WITH {REPLAYED}, {_on_time('replayed')}
      SELECT (SELECT count(*) FROM replayed) - (SELECT count(*) FROM on_time) AS dropped""",
    "series_slice": f"""{EVENT_MINUTES}, kept AS (SELECT * FROM minutes WHERE car_id = 'CAR-01' AND sensor_id = 'click'
        AND bucket >= TIMESTAMP '2024-01-08 06:30:00' AND bucket < TIMESTAMP '2024-01-12 00:00:00') SELECT {ROLLUP} FROM kept""",
    "unordered_rollup_1m": f"""WITH {SPREAD}, {MINUTES.format(source='spread')},
      ends AS (SELECT max(event_time) AS now_at FROM spread)
      SELECT {ROLLUP} FROM minutes, ends WHERE bucket < time_bucket(INTERVAL '1 minute', now_at - INTERVAL '1 minute')""",
    "unordered_rollup_1h": f"""WITH {SPREAD}, {MINUTES.format(source='spread')}, {HOURS},
      ends AS (SELECT max(event_time) AS now_at FROM spread)
      SELECT {ROLLUP} FROM hours, ends WHERE bucket < time_bucket(INTERVAL '1 hour', now_at - INTERVAL '1 hour')""",
    "exact_stream_rollups": f"""WITH {REPLAYED}, {LATE}, stream_ends AS (
        SELECT car_id, max(stream_time) AS now_at FROM audited GROUP BY 1),
      on_time AS (SELECT r.* FROM replayed r JOIN audited a USING (car_id, sensor_id, event_time, arrival) WHERE NOT a.late),
      seconds AS ({_window('on_time', 'PT1S')})
      SELECT {LIVE_ROW} FROM seconds JOIN stream_ends USING (car_id) WHERE window_end <= now_at - INTERVAL '2 seconds'""",
    "exact_stream_late": f"""WITH {REPLAYED}, {LATE} SELECT car_id AS stream_partition, count(*) AS readings,
        count(*) FILTER (WHERE late) AS late_readings, max(lateness_us) / 1e6 AS worst_lateness_s,
        max(stream_time) AS stream_time FROM audited GROUP BY 1""",
    "stream_signal_changes": f"""WITH {SECONDS}, seen AS (
        SELECT DISTINCT car_id, window_end AS "at" FROM seconds WHERE sensor_id = 'speed'), {_changes("seen", 6, "", False)}
      SELECT car_id, "at", active AS has_signal FROM changes""",
    "stream_breach_changes": f"""WITH {RAISED}, seen AS (
        SELECT car_id, window_end AS "at", sensor_id, observed_maximum, threshold FROM alerts
        QUALIFY row_number() OVER (
          PARTITION BY car_id, window_end ORDER BY window_start DESC, sensor_id DESC, threshold DESC) = 1),
      {_changes("seen", 30, "sensor_id, observed_maximum, threshold", True)}
      SELECT car_id, "at", active, sensor_id, round(observed_maximum, 6) AS observed_maximum, threshold FROM changes""",
    "recent_alerts_by_arrival": _by_arrival(200),
    "breach_list_by_arrival": _by_arrival(100),
    "stream_board": " UNION ALL ".join(
        f"SELECT {part} AS slice, * FROM ({_board(_raised_until(part))})" for part in (1, 2, 3)
    ),
    "session_after_lost_checkpoint": f"""WITH {SECONDS} SELECT car_id, sensor_id, round(max(maximum), 6) AS peak,
        round(sum(average * "count") / sum("count"), 6) AS mean, CAST(sum("count") AS BIGINT) AS samples
        FROM seconds GROUP BY 1, 2""",
    "stream_from_latest": f"""WITH {CHANNELS} SELECT {READING} FROM laps
        WHERE arrival > (SELECT max(event_id) // 3 FROM events)""",
    "not_found_rule": f"""{EVENT_MINUTES}, asked AS (
        SELECT * FROM (VALUES ('click'), ('view'), ('no-such-sensor')) AS t(sensor_id))
      SELECT a.sensor_id, count(m.bucket) AS "rows", count(m.bucket) > 0 AS found FROM asked a
      LEFT JOIN minutes m ON m.sensor_id = a.sensor_id AND m.car_id = 'CAR-01'
        AND m.bucket >= TIMESTAMP '2024-01-08 00:00:00' AND m.bucket < TIMESTAMP '2024-01-12 00:00:00' GROUP BY 1""",
    "created_empty": f"""{EVENT_MINUTES}, {HOURS}, stored AS (
        SELECT 'raw' AS name, (SELECT count(*) FROM (SELECT DISTINCT car_id, sensor_id, event_time FROM readings)) AS "rows"
        UNION ALL SELECT 'rollup_1m', (SELECT count(*) FROM minutes)
        UNION ALL SELECT 'rollup_1h', (SELECT count(*) FROM hours))
      SELECT name, 'again' AS state, "rows" FROM stored UNION ALL SELECT name, 'new', 0 FROM stored""",
}
