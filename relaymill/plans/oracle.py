"""The registered queries as SQL for DuckDB, written from the same row rules."""

from __future__ import annotations


def _uuid(key: str) -> str:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return " || '-' || ".join(f"substr(md5({key}), {start}, {n})" for start, n in cuts)


def _text(clock: str) -> str:
    return f"strftime({clock}, '%Y-%m-%d %H:%M:%S')"


def _entry(stage: str, clock: str, *rest: tuple[str, str]) -> str:
    members = [f"'{{\"stage\":\"{stage}\",\"timestamp\":\"' || {_text(clock)} || '\"'"]
    members += [f"',\"{key}\":\"' || {value} || '\"'" for key, value in rest]
    return " || ".join([*members, "'}'"])


def _entries(flow: int, clock: str = "clock", start: str = "clock") -> list[str]:
    """JSON texts of the audit entries of a flow, one for each stage."""
    created = _entry(
        "process1_created", start, ("status", "'prepared'"), ("source", "'rest_api'")
    )
    saved = _entry(
        "process4_saved_to_mariadb",
        clock,
        ("database_action", "'INSERT/UPDATE processed_messages'"),
    )
    if flow == 1:
        middle = [
            _entry(
                "process2_reflected",
                clock,
                ("modification", "'Added +10 to counter and flagged reflected'"),
            ),
            _entry(
                "process3_received_and_forwarded", clock, ("status", "'forwarded_to_process4'")
            ),
        ]
    else:
        middle = [
            _entry(
                "process2_examined_and_forwarded",
                clock,
                ("status_assigned", "CASE WHEN v > 30.0 THEN 'HIGH' ELSE 'NORMAL' END"),
                ("modification", "'Applied 15% scaling factor and assigned status'"),
            ),
            _entry(
                "process3_reflected",
                clock,
                ("modification", "'Added verification seal and marked completed'"),
            ),
        ]
    return [created, *middle, saved]


def _trail(flow: int, steps: int, clock: str = "clock", start: str = "clock") -> str:
    """JSON text of the first ``steps`` audit entries of a flow."""
    return "'[' || " + " || ',' || ".join(_entries(flow, clock, start)[:steps]) + " || ']'"


_SCALED = "CAST(format('{:.2f}', v * 1.15) AS DOUBLE)"
_STATUS = "CASE WHEN v > 30.0 THEN 'HIGH' ELSE 'NORMAL' END"
_MESSAGE_ID = _uuid("'msg-' || seq")

_E = """e AS (
  SELECT event_id AS seq, ts AS clock, event_type, value AS v,
         CASE WHEN event_type IN ('purchase', 'error') THEN 2 ELSE 1 END AS flow,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events)"""

# One row per request: what its path and body amount to.
_REQUESTS = f"""{_E}, r AS (
  SELECT *,
         CASE WHEN seq % 101 = 0 THEN '/api/unknown'
              WHEN flow = 1 THEN '/api/flow1' ELSE '/api/flow2' END
           || CASE WHEN seq % 7 = 0 THEN '/' ELSE '' END AS path,
         CASE WHEN seq % 97 = 0 THEN 400
              WHEN seq % 101 = 0 THEN 404
              WHEN seq % 89 = 0 THEN 200
              WHEN seq % 83 = 0 THEN 500
              WHEN seq % 79 = 0 THEN 500
              ELSE 200 END AS status_code,
         seq % 89 = 0 AS is_empty,
         (epoch_us(clock) // 1000) % 100000 AS clock_item
  FROM e), m AS (
  SELECT seq, flow, clock,
         CASE WHEN is_empty OR seq % 73 = 0 THEN clock_item ELSE seq END AS item_id,
         is_empty, event_type, k AS given_k, v AS given_v
  FROM r WHERE status_code = 200), made AS (
  SELECT seq, flow, clock, {_MESSAGE_ID} AS message_id, item_id,
         CASE WHEN NOT is_empty THEN event_type
              WHEN flow = 1 THEN 'Flow-1 original payload for item #' || item_id
              ELSE 'Flow-2 raw metric for item #' || item_id END AS initial_data,
         CASE WHEN flow = 1 THEN CASE WHEN is_empty THEN 100 + item_id ELSE given_k END END AS k,
         CASE WHEN flow = 2 THEN CASE WHEN is_empty THEN 25.0 + (item_id % 10) * 1.5
                                      ELSE given_v END END::DOUBLE AS v
  FROM m)"""

_BATCHES = f"""{_E}, b AS (
  SELECT seq, clock,
         CASE WHEN seq % 13 = 0 THEN 3
              WHEN seq % 11 = 0 THEN NULL
              WHEN seq % 7 = 0 THEN k % 8
              WHEN seq % 5 = 0 THEN -(k % 8)
              ELSE k % 8 END AS n
  FROM e), u AS (
  SELECT seq, clock, unnest(range(1, n + 1)) AS item_id FROM b WHERE n >= 1), g AS (
  SELECT seq, item_id AS position, flow, clock,
         {_uuid("'msg-' || seq || '-' || item_id || '-' || flow")} AS message_id,
         item_id,
         CASE flow WHEN 1 THEN 'Flow-1 original payload for item #' || item_id
                   ELSE 'Flow-2 raw metric for item #' || item_id END AS initial_data,
         CASE flow WHEN 1 THEN 100 + item_id END AS counter,
         CASE flow WHEN 2 THEN 25.0 + (item_id % 10) * 1.5 END::DOUBLE AS value
  FROM u, (VALUES (1), (2)) f(flow))"""
# The same batch requests under later arrival numbers, beside the single ones.
_ALL = f"""{_REQUESTS},
  {_BATCHES.removeprefix(_E).lstrip(', ').replace('SELECT seq, clock, unnest', 'SELECT seq + 1000000000 AS seq, clock, unnest')}, every AS (
  SELECT seq, CAST(0 AS BIGINT) AS position, flow, clock, message_id, item_id, initial_data, k, v
  FROM made UNION ALL
  SELECT seq, position, flow, clock, message_id, item_id, initial_data, counter, value FROM g)"""

# Faulty documents: the first matching divisor decides.
_FAULTS = f"""{_E}, x AS (
  SELECT *, {_MESSAGE_ID} AS message_id,
         CASE WHEN seq % 61 = 0 THEN 61 WHEN seq % 59 = 0 THEN 59 WHEN seq % 53 = 0 THEN 53
              WHEN seq % 47 = 0 THEN 47 WHEN seq % 43 = 0 THEN 43 WHEN seq % 41 = 0 THEN 41
              WHEN seq % 37 = 0 THEN 37 WHEN seq % 31 = 0 THEN 31 WHEN seq % 29 = 0 THEN 29
              WHEN seq % 23 = 0 THEN 23 ELSE 0 END AS fault
  FROM e)"""


def _saved(source: str, extra: str = "", start: str = "clock") -> str:
    """Table cells of messages after all stages; ``source`` has seq, flow, k, v, ..."""
    return f"""
  SELECT seq, message_id, CAST(flow AS INTEGER) AS flow_id,
         CAST(item_id AS INTEGER) AS item_id, initial_data,
         CASE WHEN flow = 1 THEN CAST(k + 10 AS INTEGER) END AS counter_value,
         CASE WHEN flow = 2 THEN CAST({_SCALED} AS DECIMAL(10,2)) END AS metric_value,
         CASE WHEN flow = 2 THEN {_STATUS} END AS examined_status,
         CASE WHEN flow = 2 THEN 'process3' END AS verified_by,
         CASE WHEN flow = 1 THEN {_trail(1, 4, start=start)}
              ELSE {_trail(2, 4, start=start)} END AS history_trail,
         clock AS created_at,
         CASE WHEN flow = 1 THEN k + 10.0 ELSE {_SCALED} END::DOUBLE AS payload_number,
         true AS payload_flag, CAST(4 AS INTEGER) AS payload_steps{extra}
  FROM {source}"""


_MESSAGES = f"""{_E}, w AS (
  SELECT seq, clock, flow, {_MESSAGE_ID} AS message_id, seq AS item_id,
         event_type AS initial_data, k, v, clock AS started
  FROM e), s AS ({_saved("w", start="started")})"""

_REDELIVERED = f"""{_MESSAGES}, w2 AS (
  SELECT seq + 1000000000 AS seq, clock + INTERVAL 1 HOUR AS clock, flow, message_id,
         item_id + 1 AS item_id, 'changed' AS initial_data, k + 1 AS k, v + 1.0 AS v,
         clock AS started
  FROM w WHERE seq % 10 = 0), s2 AS ({_saved("w2", start="started")}), d AS (
  SELECT * FROM s UNION ALL
  SELECT * REPLACE (
    CASE WHEN (seq - 1000000000) % 30 <> 0 THEN counter_value END AS counter_value,
    CASE WHEN (seq - 1000000000) % 30 <> 0 THEN metric_value END AS metric_value)
  FROM s2), p AS (
  SELECT f.seq AS id, f.message_id, f.flow_id, f.item_id, f.initial_data,
         l.counter_value, l.metric_value, l.examined_status, l.verified_by,
         l.history_trail, f.created_at, l.payload_number, l.payload_flag, l.payload_steps
  FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY seq) = 1) f
  JOIN (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY seq DESC) = 1) l
  USING (message_id))"""

_P = f"WITH {_REDELIVERED} "
_SUMMARY = (
    "id, flow_id, item_id, counter_value, metric_value, examined_status, verified_by, created_at"
)
_COMPARED = "id, message_id, flow_id, item_id, counter_value, metric_value"


_DIFF = f"""{_P}, q AS (
    SELECT id, message_id, flow_id, item_id,
           CASE WHEN id % 700 = 1 AND flow_id = 1 THEN counter_value + 1
        ELSE counter_value END AS counter_value,
           CASE WHEN id % 700 = 1 AND flow_id = 2 THEN CAST(metric_value + 1 AS DECIMAL(10,2))
        ELSE metric_value END AS metric_value
    FROM p WHERE id % 500 <> 0)
  SELECT *, CAST(1 AS BIGINT) AS in_left, CAST(0 AS BIGINT) AS in_right
  FROM (SELECT {_COMPARED} FROM p EXCEPT ALL SELECT * FROM q)
  UNION ALL
  SELECT *, CAST(0 AS BIGINT), CAST(1 AS BIGINT)
  FROM (SELECT * FROM q EXCEPT ALL SELECT {_COMPARED} FROM p)"""


def _end_to_end(flow: int) -> str:
    return (
        f"WITH {_REQUESTS}, z AS ({_saved('made')}) "
        f"SELECT seq AS id, * EXCLUDE (seq) FROM z WHERE flow_id = {flow}"
    )


def _rejects() -> str:
    return f"""WITH {_FAULTS}
      SELECT seq,
             CAST(CASE WHEN fault IN (61, 59) THEN 2 ELSE 4 END AS INTEGER) AS stage,
             CASE fault WHEN 61 THEN 'history_not_a_list'
                        WHEN 59 THEN CASE flow WHEN 1 THEN 'counter' ELSE 'value' END || '_not_a_number'
                        WHEN 47 THEN 'initial_data_too_long'
                        WHEN 37 THEN CASE flow WHEN 1 THEN 'counter' ELSE 'value' END || '_unusable'
                        WHEN 43 THEN 'item_id_missing'
                        ELSE 'item_id_unusable' END AS reason
      FROM x WHERE fault IN (61, 59, 47, 43, 37, 31, 29, 23)"""


def _in_order(flow: int) -> str:
    """Texts of ordered documents after stages 2 and 3."""
    key, number, zero = ("counter", "k + 10", "10") if flow == 1 else ("value", _SCALED, "0.0")
    first, *later = _entries(flow)[:3]
    grown = " || ',' || ".join(later)
    scored = "CASE WHEN seq % 5 = 0 THEN 0.0 ELSE v END"
    grown = grown.replace(_STATUS, f"CASE WHEN {scored} > 30.0 THEN 'HIGH' ELSE 'NORMAL' END")
    status = f"""',"examined_status":"' || CASE WHEN {scored} > 30.0 THEN 'HIGH' ELSE 'NORMAL' END || '"'"""
    absent = f"""CASE WHEN seq % 5 = 0 THEN ',"{key}":{zero}' ELSE '' END"""
    behind = f"{absent} || ',\"process2_flow1_reflected\":true,\"process3_acknowledged\":true'" if flow == 1 else (
        f"{status} || {absent} || ',\"verified_by\":\"process3\",\"completed\":true'"
    )
    return f"""SELECT seq, '{{ "tag" : {{"b":[1, 2.50 ,"counter"], "value": {{"history":[]}}, "a":"x\\"counter\\":\\\\"}} , "history":'
             || CASE WHEN seq % 3 = 0 THEN '[ ' ELSE '[' || {first} || ',' END || {grown} || ']'
             || CASE WHEN seq % 5 = 0 THEN '' ELSE ',  "{key}":' || chr(9) || CAST({number} AS VARCHAR) || ' ' END
             || ',"\u00e9":"\\u00e9\\/", "flow":{flow},"message_id":"' || message_id || '","item_id": ' || seq
             || ', "zero":1.500E+2' || {behind} || '}}' AS body
      FROM w WHERE flow = {flow}"""


def _latest_of(flow: int) -> str:
    columns = {
        1: "message_id, initial_data, counter_value",
        2: "message_id, initial_data, metric_value, examined_status, verified_by",
    }[flow]
    return (
        f"{_P} SELECT {columns}, history_trail AS audit_trail "
        f"FROM p WHERE flow_id = {flow} ORDER BY id DESC LIMIT 1"
    )


def statements() -> dict[str, str]:
    table = f"{_P} SELECT * FROM p"
    return {
        "request_outcome": f"""WITH {_REQUESTS}
          SELECT seq, path, status_code,
                 CASE WHEN status_code = 200 THEN 'success' END AS status,
                 CASE status_code WHEN 400 THEN 'Invalid JSON body' WHEN 404 THEN 'Not Found'
                                  WHEN 500 THEN 'Internal Server Error' END AS error,
                 CASE WHEN status_code = 200 THEN flow END AS flow,
                 CASE WHEN status_code = 200 THEN
                   CASE flow WHEN 1 THEN 'flow1_p1_to_p2' ELSE 'flow2_p1_to_p2' END
                 END AS target_queue,
                 CAST(CASE WHEN status_code = 200 THEN 1 ELSE 0 END AS BIGINT) AS messages
          FROM r""",
        "ingest_flow1": f"""WITH {_REQUESTS}
          SELECT seq, flow, message_id, item_id, initial_data, k AS counter,
                 {_trail(1, 1)} AS history FROM made WHERE flow = 1""",
        "ingest_flow2": f"""WITH {_REQUESTS}
          SELECT seq, flow, message_id, item_id, initial_data, v AS value,
                 {_trail(2, 1)} AS history FROM made WHERE flow = 2""",
        "ingest_odd_numbers": f"""WITH {_E}, o AS (
            SELECT seq, flow, k, CASE WHEN seq % 11 = 0 THEN 'bare' WHEN seq % 7 = 0 THEN 'bare' ELSE 'number' END AS given
            FROM e)
          SELECT seq, CAST(CASE WHEN flow = 1 AND given = 'bare' THEN 500 ELSE 200 END AS INTEGER) AS status_code,
                 CASE WHEN flow = 2 OR given = 'number' THEN CAST(seq AS INTEGER) END AS item_id,
                 CASE WHEN flow = 1 AND given = 'number' THEN CAST(k + 10 AS INTEGER) END AS counter_value,
                 CASE WHEN flow = 2 AND given = 'number' THEN CAST(format('{{:.2f}}', k * 1.15::DOUBLE) AS DECIMAL(10,2)) END AS metric_value,
                 CASE WHEN flow = 2 OR given = 'number' THEN 'NaN, "Infinity" and \\' END AS initial_data,
                 CASE WHEN flow = 2 AND given = 'bare' THEN 'value_unusable' END AS reject_reason
          FROM o""",
        "batch_outcome": f"""WITH {_BATCHES}
          SELECT seq, CASE WHEN n IS NULL THEN 500 ELSE 200 END AS status_code,
                 CAST(CASE WHEN n > 0 THEN 2 * n ELSE 0 END AS BIGINT) AS messages FROM b""",
        "batch_generate": f"""WITH {_BATCHES}
          SELECT seq, position, flow, message_id, item_id, initial_data, counter, value FROM g""",
        "batch_large": f"""WITH {_E}, b AS (
            SELECT CASE WHEN seq % 2000 = 0 THEN seq + 1099511627776 ELSE seq END AS seq,
                   k * 100 + 25000 AS n FROM e WHERE seq % 1000 = 0)
          SELECT seq, flow, n AS messages, CAST(1 AS BIGINT) AS first, n AS last,
                 CAST(n * (n + 1) // 2 AS BIGINT) AS items
          FROM b, (VALUES (1), (2)) f(flow)""",
        "ingest_all": f"""WITH {_ALL}
          SELECT seq, position, flow, message_id, item_id, initial_data, k AS counter, v AS value,
                 {_trail(1, 1)} AS history FROM every""",
        "queue_routing": f"""WITH {_REQUESTS}
          SELECT seq, message_id, flow, stage, consumed_from, forwarded_to
          FROM made JOIN (VALUES
            (1, 2, 'flow1_p1_to_p2', 'flow1_p2_to_p3'),
            (1, 3, 'flow1_p2_to_p3', 'flow1_p3_to_p4'),
            (1, 4, 'flow1_p3_to_p4', NULL),
            (2, 2, 'flow2_p1_to_p2', 'flow2_p2_to_p3'),
            (2, 3, 'flow2_p2_to_p3', 'flow2_p3_reflected'),
            (2, 4, 'flow2_p3_reflected', NULL)
          ) h(flow, stage, consumed_from, forwarded_to) USING (flow)""",
        "flow1_reflect": f"""WITH {_MESSAGES}
          SELECT seq, message_id, item_id, k + 10 AS counter,
                 true AS process2_flow1_reflected, {_trail(1, 2)} AS history
          FROM w WHERE flow = 1""",
        "flow2_examine": f"""WITH {_MESSAGES}
          SELECT seq, message_id, item_id, {_SCALED} AS value,
                 {_STATUS} AS examined_status, {_trail(2, 2)} AS history
          FROM w WHERE flow = 2""",
        "flow1_acknowledge": f"""WITH {_MESSAGES}
          SELECT seq, message_id, k + 10 AS counter, true AS process3_acknowledged,
                 {_trail(1, 3)} AS history FROM w WHERE flow = 1""",
        "flow2_seal": f"""WITH {_MESSAGES}
          SELECT seq, message_id, {_SCALED} AS value, {_STATUS} AS examined_status,
                 'process3' AS verified_by, true AS completed, {_trail(2, 3)} AS history
          FROM w WHERE flow = 2""",
        "extra_fields_kept": f"""WITH {_FAULTS}
          SELECT seq, message_id, CASE WHEN fault = 41 THEN event_type END AS tag,
                 CAST(CASE flow WHEN 1 THEN 8 ELSE 9 END
                      + CASE WHEN fault = 41 THEN 1 ELSE 0 END AS INTEGER) AS keys
          FROM x WHERE fault IN (0, 41, 53)""",
        "documents_in_order": f"WITH {_MESSAGES} {_in_order(1)} UNION ALL {_in_order(2)}",
        "missing_vs_null": f"""WITH {_FAULTS}
          SELECT seq, flow,
                 CASE fault WHEN 59 THEN 'null' WHEN 53 THEN 'absent' ELSE 'given' END AS received,
                 CASE WHEN fault IN (59, 61) THEN NULL
                      WHEN fault = 37 THEN CASE WHEN flow = 2 THEN 'Infinity'::DOUBLE END
                      WHEN flow = 1 THEN CASE WHEN fault = 53 THEN 0 ELSE k END + 10.0
                      ELSE CASE WHEN fault = 53 THEN 0.0 ELSE {_SCALED} END END::DOUBLE AS result,
                 CASE fault WHEN 61 THEN 'history_not_a_list'
                            WHEN 59 THEN CASE flow WHEN 1 THEN 'counter' ELSE 'value' END
                                         || '_not_a_number' END AS reject_reason
          FROM x""",
        "rejected_messages": _rejects(),
        "persist_projection": f"""WITH {_MESSAGES}
          SELECT s.* EXCLUDE (payload_number, payload_flag, payload_steps),
                 CASE WHEN flow_id = 1 THEN true END AS reflected,
                 CASE WHEN flow_id = 1 THEN true END AS acknowledged,
                 CASE WHEN flow_id = 2 THEN true END AS completed,
                 CAST(coalesce(counter_value, metric_value) AS DOUBLE) AS number
          FROM s""",
        "upsert_latest": table,
        "upsert_bucketed": table,
        "upsert_collated": table,
        "table_current": table,
        "table_recompacted": table,
        "redelivered_same_seq": table,
        "end_to_end_flow1": _end_to_end(1),
        "end_to_end_flow2": _end_to_end(2),
        "table_scan": table,
        "table_declared": table,
        "latest_n": f"{_P} SELECT {_SUMMARY} FROM p ORDER BY id DESC LIMIT 10",
        "latest_flow1": _latest_of(1),
        "latest_flow2": _latest_of(2),
        "flow_rows": f"{_P} SELECT * FROM p WHERE flow_id = 2",
        "lookup_message": f"{_P} SELECT * FROM p WHERE message_id = {_uuid(chr(39) + 'msg-41' + chr(39))}",
        "lookup_flow_item": f"{_P} SELECT * FROM p WHERE flow_id = 1 AND item_id = 41",
        "created_range": f"""{_P} SELECT * FROM p
          WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-12'""",
        "audit_step_count": f"""{_P}
          SELECT id, message_id, CAST(json_array_length(history_trail) AS INTEGER) AS steps FROM p""",
        "audit_steps": f"""{_P}, t AS (
            SELECT id, message_id, step, json_extract(history_trail, '$[' || (step - 1) || ']') AS h
            FROM p, (VALUES (1), (2), (3), (4)) n(step)), l AS (
            SELECT id, message_id, step, json_extract_string(h, '$.stage') AS stage,
                   json_extract_string(h, '$.timestamp') AS timestamp,
                   coalesce(json_extract_string(h, '$.modification'),
                            json_extract_string(h, '$.status'),
                            json_extract_string(h, '$.database_action')) AS description
            FROM t)
          SELECT *, '[' || stage || '] at ' || timestamp || ': ' || description AS line FROM l""",
        "audit_pretty": f"""{_P}
          SELECT message_id, history_trail AS audit_trail FROM p""",
        "replica_diff": _DIFF,
        "replica_digest_diff": _DIFF,
        "replica_latest": f"""{_P}, a AS (SELECT {_COMPARED} FROM p ORDER BY id DESC LIMIT 5),
          c AS (SELECT {_COMPARED} FROM p WHERE id % 3 <> 0 ORDER BY id DESC LIMIT 5)
          SELECT *, CAST(1 AS BIGINT) AS in_node1, CAST(1 AS BIGINT) AS in_node2,
                 CAST(0 AS BIGINT) AS in_node3 FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM c)
          UNION ALL
          SELECT *, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT)
          FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM a)""",
        "stream_end_to_end": f"WITH {_MESSAGES} SELECT seq AS id, * EXCLUDE (seq) FROM s",
        "stream_bucketed": f"""WITH {_FAULTS}
          SELECT seq AS id, message_id, CAST(seq AS INTEGER) AS item_id,
                 CASE WHEN flow = 1 THEN CAST(CASE WHEN fault = 53 THEN 0 ELSE k END + 10 AS INTEGER) END AS counter_value,
                 CASE WHEN flow = 2 THEN CAST(CASE WHEN fault = 53 THEN 0 ELSE {_SCALED} END AS DECIMAL(10,2)) END AS metric_value,
                 NULL AS reason
          FROM x WHERE fault IN (0, 41, 53)
          UNION ALL
          SELECT seq, NULL, NULL, NULL, NULL, reason FROM ({_rejects()}) WHERE stage = 4""",
        "stream_competing": f"WITH {_MESSAGES} SELECT seq AS id, * EXCLUDE (seq) FROM s",
        "stream_ingest_end_to_end": f"""WITH {_ALL}, z AS ({_saved("every", ", position")})
          SELECT seq AS id, * EXCLUDE (seq) FROM z""",
        "stream_json_queues": f"""WITH {_MESSAGES}
          SELECT seq, message_id, CASE WHEN flow = 1 THEN k + 10 END AS counter,
                 CASE WHEN flow = 2 THEN {_SCALED} END AS value,
                 CASE WHEN flow = 1 THEN {_trail(1, 2)} ELSE {_trail(2, 2)} END AS history, clock
          FROM w""",
        "stream_rejected": _rejects(),
        "stream_upsert": table,
        "stream_upsert_collated": table,
    }
