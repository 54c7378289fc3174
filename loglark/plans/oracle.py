"""SQL that gives the expected rows of the registered queries, for an independent engine."""

from __future__ import annotations

from loglark.plans.registry import DAY, HOUR, PREFIX, SPLIT

# Fixed value: the line pattern, here with four groups.
R = r'^([^\s]+)\s+[^\s]+\s+[^\s]+\s+\[[^\]]+\]\s+"(\S+)\s+([^"\s]+)\s+\S+"\s+(\d{3})'

LOGS = """
logs AS (
  SELECT event_id, ts,
    CASE WHEN event_id % 50 = 0 THEN concat('bad ', event_id) ELSE
      concat('10.0.', cast(user_id % 4 AS varchar), '.', cast(user_id AS varchar),
             ' - - [', strftime(ts, '%d/%b/%Y:%H:%M:%S'), ' +0000] "',
             CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END,
             ' /', event_type, '?k=', json_extract_string(props, '$.k'), ' HTTP/1.1" ',
             CASE WHEN event_type = 'error' THEN '500' ELSE '200' END, ' ',
             cast(cast(floor(value * 100) AS bigint) AS varchar)) END AS value
  FROM events)"""

PARSED = f"""{LOGS},
parsed AS (
  SELECT event_id, ts, value, regexp_matches(value, '{R}') AS ok,
    CASE WHEN ok THEN regexp_extract(value, '{R}', 1) END AS ip,
    CASE WHEN ok THEN regexp_extract(value, '{R}', 2) END AS method,
    CASE WHEN ok THEN regexp_extract(value, '{R}', 3) END AS endpoint,
    CASE WHEN ok THEN cast(regexp_extract(value, '{R}', 4) AS integer) END AS status,
    CASE WHEN ok THEN date_trunc('second', ts) END AS sec
  FROM logs),
good AS (SELECT * FROM parsed WHERE ok)"""

COUNTS = f"""{PARSED},
counts AS (
  SELECT 'total' AS dim, '' AS key, count(*) AS n FROM good HAVING count(*) > 0
  UNION ALL SELECT 'error', '', count(*) FROM parsed WHERE NOT ok HAVING count(*) > 0
  UNION ALL SELECT 'ip', ip, count(*) FROM good GROUP BY ip
  UNION ALL SELECT 'endpoint', endpoint, count(*) FROM good GROUP BY endpoint
  UNION ALL SELECT 'status', cast(status AS varchar), count(*) FROM good GROUP BY status)"""

BUCKETS = "buckets AS (SELECT date_trunc('second', ts) AS sec, count(*) AS n FROM events GROUP BY 1)"


def _top(column: str, k: int) -> str:
    return f"SELECT {column}, count(*) AS n FROM good GROUP BY 1 ORDER BY n DESC, {column} LIMIT {k}"


def _ranked(column: str, k: int) -> str:
    return (
        f"WITH {PARSED} SELECT cast(row_number() OVER (ORDER BY n DESC, key) AS integer) AS rank, key, n "
        f"FROM (SELECT {column} AS key, count(*) AS n FROM good GROUP BY 1) ORDER BY n DESC, key LIMIT {k}"
    )


def _param(key: str) -> str:
    """First match wins; a parameter without ``=`` is empty."""

    def decoded(sql: str) -> str:
        return f"url_decode(replace({sql}, '+', '%20'))"

    name = decoded("CASE WHEN instr(p, '=') > 0 THEN substr(p, 1, instr(p, '=') - 1) ELSE p END")
    pairs = "string_split(substr(url, instr(url, '?') + 1), '&')"
    found = f"list_filter({pairs}, lambda p: {name} = '{key}')[1]"
    value = decoded(f"CASE WHEN instr({found}, '=') > 0 THEN substr({found}, instr({found}, '=') + 1) ELSE '' END")
    return f"CASE WHEN instr(url, '?') > 0 AND {found} IS NOT NULL THEN {value} END"


SKEWED = """
keyed AS (
  SELECT CASE WHEN l_quantity <= 20 THEN concat(l_returnflag, l_linestatus)
              ELSE concat('p', cast(l_partkey AS varchar)) END AS key,
         cast(floor(l_quantity) AS bigint) AS w
  FROM lineitem)"""

FLAGGED = """
keyed AS (
  SELECT CASE WHEN l_returnflag = 'N' THEN concat('p', cast(l_partkey AS varchar)) ELSE l_returnflag END AS key
  FROM lineitem)"""

MG_FLAGS = "true AS not_over, true AS close, true AS heavy_listed"
SS_FLAGS = "true AS not_under, true AS close, true AS guaranteed_ok, true AS heavy_listed"


def _bounds(keyed: str, amount: str, flags: str) -> str:
    return f"WITH {keyed} SELECT key, cast({amount} AS bigint) AS n, {flags} FROM keyed GROUP BY key"


def _hops(size: int, slide: int, by: str = "") -> str:
    """Every event in each of the windows that hold it."""
    key = f"{by}, " if by else ""
    return f"""
WITH placed AS (
  SELECT {key}unnest(range(cast(floor((e - {size}) / {slide}) + 1 AS bigint), cast(floor(e / {slide}) AS bigint) + 1))
         * {slide} AS s
  FROM (SELECT {key}epoch(ts) AS e FROM events))
SELECT {key}make_timestamp(s * 1000000) AS window_start, make_timestamp((s + {size}) * 1000000) AS window_end,
       count(*) AS n
FROM placed GROUP BY ALL"""


def _series(buckets: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""
SELECT {key}sec, cast(sum(n) OVER (
  {part}ORDER BY sec RANGE BETWEEN INTERVAL {HOUR - 1} SECOND PRECEDING AND CURRENT ROW) AS double) / {HOUR} AS rate
FROM {buckets}"""


LATE = """
flagged AS (
  SELECT event_id, ts, epoch(date_trunc('second', ts)) AS s,
    max(epoch(date_trunc('second', ts))) OVER (
      ORDER BY event_id + CASE WHEN event_id % 10 = 0 THEN 7 ELSE 0 END, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
  FROM events)"""
IS_LATE = "coalesce(s < newest - 1799, false)"


def _recent(column: str, n: int) -> str:
    """Valid lines of the last n seconds, per second."""
    return (
        f"(SELECT count(*) / {n}.0 FROM good WHERE {column} > (SELECT max({column}) FROM good) - INTERVAL {n} SECOND)"
    )


def _metric_rows(n: int) -> str:
    rate = _recent("sec", n)
    return f"""{COUNTS},
tops AS (
  SELECT dim, key, n, row_number() OVER (PARTITION BY dim ORDER BY n DESC, key) AS rank
  FROM counts WHERE dim IN ('ip', 'endpoint')),
items AS (
  SELECT 0 AS part, 1 AS pos, 'total_lines' AS metric, '' AS labels, cast((SELECT count(*) FROM good) AS double) AS value
  UNION ALL SELECT 1, 1, 'parse_errors', '', cast((SELECT count(*) FROM parsed WHERE NOT ok) AS double)
  UNION ALL SELECT 2, 1, 'lines_per_second', '', cast({rate} AS double)
  UNION ALL SELECT 3, cast(key AS integer), 'status_count', concat('code="', key, '"'), cast(n AS double)
    FROM counts WHERE dim = 'status'
  UNION ALL SELECT CASE dim WHEN 'ip' THEN 4 ELSE 5 END, rank, concat('top_', dim),
    concat('rank="', rank, '",', dim, '="', key, '"'), cast(n AS double)
    FROM tops WHERE rank <= 10),
metrics AS (
  SELECT cast(row_number() OVER (ORDER BY part, pos) AS integer) AS seq, metric, labels, value FROM items)"""


def _metric_lines(n: int) -> str:
    return f"""{_metric_rows(n)},
samples AS (
  SELECT seq * 10 + 5 AS place, concat('{PREFIX}_', metric,
    CASE WHEN labels = '' THEN '' ELSE concat('{{', labels, '}}') END, ' ',
    CASE WHEN metric = 'lines_per_second' THEN printf('%.6f', value)
         ELSE cast(cast(value AS bigint) AS varchar) END) AS value
  FROM metrics),
firsts AS (SELECT metric, min(seq) AS seq FROM metrics GROUP BY metric),
heads AS (
  SELECT seq * 10 AS place, concat('# HELP {PREFIX}_', metric, ' ', CASE metric WHEN 'total_lines' THEN 'Total parsed lines'
    WHEN 'parse_errors' THEN 'Parse errors' WHEN 'lines_per_second' THEN 'Lines/sec' ELSE 'Status counts' END) AS value
  FROM firsts WHERE metric IN ('total_lines', 'parse_errors', 'lines_per_second', 'status_count')
  UNION ALL
  SELECT seq * 10 + 1, '# TYPE {PREFIX}_status_count gauge' FROM firsts WHERE metric = 'status_count'),
exposition AS (SELECT * FROM samples UNION ALL SELECT * FROM heads)"""


STATE = f"""{COUNTS},
state AS (
  SELECT dim, key, n FROM counts
  UNION ALL SELECT 'second', cast(cast(epoch(sec) AS bigint) AS varchar), count(*) FROM good GROUP BY sec
  UNION ALL SELECT 'cms_row', cast(r AS varchar), (SELECT count(*) FROM good) FROM range(4) t(r)
  UNION ALL SELECT concat('mg_', dim), key, n FROM counts WHERE dim IN ('ip', 'endpoint')
  UNION ALL SELECT concat('ss_', dim), key, n FROM counts WHERE dim IN ('ip', 'endpoint'))"""

ALL_COUNTS = f"WITH {COUNTS} SELECT dim, key, n FROM counts"
ESTIMATE_ALL = f"WITH {PARSED} SELECT ip, count(*) AS n, count(*) AS est FROM good GROUP BY ip"
TOTALS = """SELECT count(*) FILTER (WHERE ok) AS total_lines, count(*) FILTER (WHERE NOT ok) AS parse_errors FROM parsed"""
TOP_IPS = f"WITH {PARSED} {_top('ip', 10)}"
TOP_ENDPOINTS = f"WITH {PARSED} {_top('endpoint', 10)}"
SECONDS = "SELECT sec, count(*) AS n FROM good GROUP BY sec"


def _keyed(column: str) -> str:
    return f"{PARSED}, keyed AS (SELECT {column} AS key FROM good)"


LISTED = "true AS same, true AS not_over"


def _per_dim(flags: str) -> str:
    return f"WITH {COUNTS} SELECT dim, key, n, {flags} FROM counts WHERE dim IN ('ip', 'endpoint')"


def _json_list(dim: str) -> str:
    return (
        f"(SELECT string_agg(concat('{{\"{dim}\":\"', key, '\",\"count\":', n, '}}'), ',' ORDER BY rank) "
        f"FROM tops WHERE dim = '{dim}' AND rank <= 10)"
    )


def _json(n: int) -> str:
    return f"""
        WITH {_metric_rows(n)}
        SELECT concat('{{"total_lines":', (SELECT count(*) FROM good), ',"parse_errors":',
          (SELECT count(*) FROM parsed WHERE NOT ok), ',"rate_lps":',
          printf('%.6f', cast({_recent("sec", n)} AS double)), ',"status_counts":{{',
          (SELECT string_agg(concat('"', key, '":', n), ',' ORDER BY cast(key AS integer)) FROM counts WHERE dim = 'status'),
          '}},"top_ips":[', {_json_list("ip")}, '],"top_endpoints":[', {_json_list("endpoint")}, ']}}') AS json"""


ORACLES: dict[str, str] = {
    "parse_log": f"WITH {PARSED} SELECT event_id, ok, ip, method, endpoint, status FROM parsed",
    "parse_ok_flags": f"WITH {PARSED} SELECT event_id, ok FROM parsed",
    "parse_event_time": f"WITH {PARSED} SELECT event_id, sec AS event_ts FROM parsed",
    "parse_arrival": f"WITH {PARSED} SELECT event_id, sec AS ts_received FROM parsed",
    "parse_rejects": f"WITH {PARSED} SELECT value, event_id FROM parsed WHERE NOT ok",
    "decode_endpoint": f"""
        WITH {PARSED}, texts AS (SELECT url_decode(replace(endpoint, '+', '%20')) AS decoded FROM good
                                 UNION ALL SELECT url FROM pages)
        SELECT decoded, count(*) AS n FROM texts GROUP BY decoded""",
    "query_param": "SELECT page_id, "
    + ", ".join(f"{_param(p)} AS {p}" for p in ("page", "ref", "utm_source"))
    + " FROM pages",
    "count_by_query_param": f"""
        WITH {PARSED}, found AS (SELECT {_param("k")} AS param_value FROM (SELECT endpoint AS url FROM good))
        SELECT param_value, count(*) AS n FROM found WHERE param_value IS NOT NULL GROUP BY 1""",
    "count_pages_by_query_param": f"""
        WITH found AS (SELECT {_param("ref")} AS param_value FROM pages)
        SELECT param_value, count(*) AS n FROM found WHERE param_value IS NOT NULL GROUP BY 1""",
    "count_by_path": f"WITH {PARSED} SELECT split_part(endpoint, '?', 1) AS path, count(*) AS n FROM good GROUP BY 1",
    "log_scan": f"WITH {PARSED} {TOTALS}",
    "totals": f"WITH {PARSED} {TOTALS}",
    "observed_totals": f"WITH {PARSED} {TOTALS}",
    "status_counts": f"WITH {PARSED} SELECT status, count(*) AS n FROM good GROUP BY 1",
    "ip_counts": f"WITH {PARSED} SELECT ip, count(*) AS n FROM good GROUP BY 1",
    "endpoint_counts": f"WITH {PARSED} SELECT endpoint, count(*) AS n FROM good GROUP BY 1",
    "all_counts": ALL_COUNTS,
    "weighted_counts": """
        SELECT l_returnflag, cast(sum(cast(floor(l_quantity) AS bigint)) AS bigint) AS n FROM lineitem GROUP BY 1""",
    "count_orders_by_priority": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "top_ips": TOP_IPS,
    "top_endpoints": TOP_ENDPOINTS,
    "ranked_top_ips": _ranked("ip", 25),
    "ranked_top_endpoints": _ranked("endpoint", 25),
    "top_per_dim": f"""
        WITH {COUNTS}
        SELECT dim, cast(row_number() OVER (PARTITION BY dim ORDER BY n DESC, key) AS integer) AS rank, key, n
        FROM counts QUALIFY rank <= 5""",
    "top_all_keys": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1",
    "top_customers": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 20",
    "top_parts_by_quantity": """
        SELECT l_partkey, cast(sum(cast(floor(l_quantity) AS bigint)) AS bigint) AS n
        FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20""",
    "cms_cells": f"""
        WITH {PARSED} SELECT cast(r AS integer) AS row, true AS inside, true AS any, (SELECT count(*) FROM good) AS n
        FROM range(4) t(r)""",
    "cms_row_totals": f"""
        WITH {PARSED} SELECT cast(r AS integer) AS row, (SELECT count(*) FROM good) AS n FROM range(4) t(r)""",
    "cms_estimate_point": f"""
        WITH {PARSED} SELECT ip, n AS est FROM ({_top("ip", 1)}) UNION ALL SELECT 'nobody', 0""",
    "cms_estimate_all": ESTIMATE_ALL,
    "cms_estimate_by_shuffle": ESTIMATE_ALL,
    "cms_never_under": """
        SELECT cast(l_partkey AS varchar) AS part, count(*) AS n, true AS not_under FROM lineitem GROUP BY 1""",
    "cms_merge": f"""
        WITH {PARSED} SELECT cast(r AS integer) AS row, (SELECT count(*) FROM good) AS n, cast(0 AS bigint) AS different_cells
        FROM range(4) t(r)""",
    "cms_weighted": """
        SELECT l_returnflag, count(*) AS n, cast(sum(cast(floor(l_quantity) AS bigint)) AS bigint) AS est
        FROM lineitem GROUP BY 1""",
    "mg_top_ips": _bounds(_keyed("ip"), "count(*)", MG_FLAGS),
    "mg_top_endpoints": _bounds(_keyed("endpoint"), "count(*)", MG_FLAGS),
    "mg_estimate": _bounds(_keyed("ip"), "count(*)", LISTED),
    "mg_bounds": _bounds(SKEWED, "count(*)", MG_FLAGS),
    "mg_weighted_bounds": _bounds(SKEWED, "sum(w)", MG_FLAGS),
    "mg_merge_bounds": _bounds(FLAGGED, "count(*)", MG_FLAGS),
    "ss_top_ips": _bounds(_keyed("ip"), "count(*)", SS_FLAGS),
    "ss_top_endpoints": _bounds(_keyed("endpoint"), "count(*)", SS_FLAGS),
    "ss_estimate": _bounds(_keyed("ip"), "count(*)", LISTED),
    "ss_bounds": _bounds(SKEWED, "count(*)", SS_FLAGS),
    "ss_weighted_bounds": _bounds(SKEWED, "sum(w)", SS_FLAGS),
    "ss_merge_bounds": _bounds(FLAGGED, "count(*)", SS_FLAGS),
    "heavy_hitters_per_dim": _per_dim("true AS mg_ok, true AS ss_ok"),
    "approx_top_k_builtin": f"""
        WITH {PARSED} SELECT status, count(*) AS n FROM good GROUP BY 1""",
    "per_second_counts": f"WITH {BUCKETS} SELECT sec, n FROM buckets",
    "per_second_by_status": f"WITH {PARSED} SELECT status, sec, count(*) AS n FROM good GROUP BY ALL",
    "rate_last_n": f"""
        WITH {BUCKETS} SELECT cast(sum(n) AS double) / {HOUR} AS rate FROM buckets
        WHERE sec > (SELECT max(sec) FROM buckets) - INTERVAL {HOUR} SECOND""",
    "rate_last_n_default": f"""
        WITH {BUCKETS} SELECT cast(sum(n) AS double) / {HOUR} AS rate FROM buckets
        WHERE sec > (SELECT max(sec) FROM buckets) - INTERVAL {HOUR} SECOND""",
    "rate_text": f"""
        WITH {BUCKETS} SELECT printf('%.2f', cast(sum(n) AS double) / {HOUR}) AS rate FROM buckets
        WHERE sec > (SELECT max(sec) FROM buckets) - INTERVAL {HOUR} SECOND""",
    "rate_series": f"WITH {BUCKETS} {_series('buckets')}",
    "rate_series_by_status": f"""
        WITH {PARSED}, buckets AS (SELECT status, sec, count(*) AS n FROM good GROUP BY ALL)
        {_series("buckets", "status")}""",
    "hopping_counts": _hops(3_600, 1_800),
    "hopping_counts_by_type": _hops(5_400, 3_600, "event_type"),
    "window_retention": f"""
        WITH {BUCKETS} SELECT sec, n FROM buckets
        WHERE sec > (SELECT max(sec) FROM buckets) - INTERVAL {7 * DAY} SECOND""",
    "late_events": f"WITH {LATE} SELECT event_id FROM flagged WHERE {IS_LATE}",
    "per_second_without_late": f"""
        WITH {LATE} SELECT date_trunc('second', ts) AS sec, count(*) AS n FROM flagged WHERE NOT {IS_LATE} GROUP BY 1""",
    "stats_summary": f"""
        WITH {COUNTS} SELECT CASE dim WHEN 'total' THEN 'total_lines' WHEN 'error' THEN 'parse_errors'
                             ELSE concat('status ', key) END AS item, n
        FROM counts WHERE dim IN ('total', 'error', 'status')""",
    "metrics_rows": f"WITH {_metric_rows(HOUR)} SELECT seq, metric, labels, value FROM metrics",
    "metrics_text": f"""
        WITH {_metric_lines(HOUR)}
        SELECT cast(row_number() OVER (ORDER BY place) AS integer) AS seq, value FROM exposition""",
    "stats_json": _json(HOUR),
    "stream_stats_json": _json(60),
    "snapshot_resume_old_version": f"WITH {PARSED} SELECT ip AS key, count(*) AS n, true AS not_under FROM good GROUP BY 1",
    "snapshot_first_start": f"""
        WITH {PARSED} SELECT cast(r AS integer) AS row, (SELECT count(*) FROM good) AS n FROM range(4) t(r)""",
    "snapshot_roundtrip": f"WITH {STATE} SELECT dim, key, n FROM state",
    "snapshot_resume": f"WITH {STATE} SELECT dim, key, n FROM state",
    "stream_state": f"WITH {STATE} SELECT dim, key, n FROM state",
    "snapshot_resize_window": f"""
        WITH {PARSED}, seconds AS ({SECONDS}) SELECT sec, n FROM seconds
        WHERE sec > (SELECT max(sec) FROM seconds) - INTERVAL {3 * DAY} SECOND""",
    "stream_all_counts": ALL_COUNTS,
    "stream_file_counts": ALL_COUNTS,
    "stream_tail_rotated": ALL_COUNTS,
    "stream_tail_counts": ALL_COUNTS,
    "stream_restart": ALL_COUNTS,
    "stream_top_ips": f"WITH {PARSED} SELECT ip AS key, n FROM ({_top('ip', 10)})",
    "stream_reset": "WITH " + COUNTS.replace("FROM events)", f"FROM events WHERE ts >= TIMESTAMP '{SPLIT}')") + " SELECT * FROM counts",
    "stream_top_incremental": f"""
        WITH {COUNTS}
        SELECT dim, cast(row_number() OVER (PARTITION BY dim ORDER BY n DESC, key) AS integer) AS rank, key, n
        FROM counts WHERE dim IN ('ip', 'endpoint') QUALIFY rank <= 10""",
    "stream_window_retention": f"""
        WITH {PARSED}, seconds AS ({SECONDS}) SELECT sec, n FROM seconds
        WHERE sec > (SELECT max(sec) FROM seconds) - INTERVAL {7 * DAY} SECOND""",
    "stream_rate": f"WITH {PARSED}, buckets AS ({SECONDS}) {_series('buckets')}",
    "stream_rate_running": f"WITH {PARSED}, buckets AS ({SECONDS}) {_series('buckets')}",
    "stream_late_per_event": """
        WITH a AS (
          SELECT event_id, event_type, date_trunc('second', ts) AS sec,
                 event_id + CASE WHEN event_id % 10 = 0 THEN 7 ELSE 0 END AS arrival FROM events
        ), m AS (
          SELECT event_id, sec, max(sec) OVER (PARTITION BY event_type ORDER BY arrival, event_id
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a
        )
        SELECT event_id FROM m WHERE sec < newest - INTERVAL 1799 SECOND""",
    "stream_late_drop": f"""
        WITH {PARSED} SELECT sec, count(*) AS n FROM good WHERE ts >= TIMESTAMP '{SPLIT}' GROUP BY sec""",
    "stream_cms": ESTIMATE_ALL,
    "stream_mg": _per_dim("true AS mg_ok"),
    "stream_ss": _per_dim("true AS ss_ok"),
    "stream_report": f"""
        WITH {_metric_lines(60)}
        SELECT cast(row_number() OVER (ORDER BY place) AS integer) AS seq, value FROM exposition""",
    "lines_from_table": f"""
        WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents),
        parsed AS (SELECT regexp_matches(value, '{R}') AS ok FROM lines)
        {TOTALS}""",
}
