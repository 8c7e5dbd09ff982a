"""The queries of :mod:`deltaboard.plans.stream_queries` as plain SQL; all constants are written out."""

from __future__ import annotations

from deltaboard.plans.oracles import CAND, EV, PRESENCE, ring

_MODE = "CASE user_id % 5 WHEN 0 THEN 'tube' WHEN 1 THEN 'dlr' WHEN 2 THEN 'bus' WHEN 3 THEN 'overground' WHEN 4 THEN 'elizabeth-line' END"

BARRIER = f"""WITH {EV}, raw AS (SELECT {_MODE} AS mode, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS cycle, event_type FROM ev),
  s AS (SELECT mode, cycle, count(*) AS n, count(*) FILTER (event_type = 'view') AS views FROM raw GROUP BY ALL),
  log AS (SELECT mode, cycle, n + CASE WHEN cycle % 7 = 0 THEN 1 ELSE 0 END AS expected,
    CASE WHEN cycle % 5 = 0 THEN views + CASE WHEN cycle % 10 = 0 THEN 1 ELSE 0 END END AS boards FROM s WHERE cycle % 11 <> 3),
  fence AS (SELECT mode, min(cycle) + 2 AS last FROM s WHERE mode IN ('tube', 'bus') GROUP BY mode),
  j AS (SELECT s.mode, s.cycle, s.n AS seen, l.expected, coalesce(s.cycle <= f.last, false) AS late,
    coalesce(s.n >= l.expected, false) AND coalesce(s.views >= l.boards, true) AS whole
    FROM s LEFT JOIN log l ON l.mode = s.mode AND l.cycle = s.cycle LEFT JOIN fence f ON f.mode = s.mode),
  lost AS (SELECT j.*, NOT whole AND NOT late AND EXISTS (SELECT 1 FROM j k WHERE k.mode = j.mode AND k.whole AND NOT k.late AND k.cycle >= j.cycle + 3) AS given_up FROM j)
  SELECT mode, cycle, seen, expected, CASE WHEN late THEN 'late_cycle' WHEN given_up THEN 'incomplete_cycle'
    WHEN whole AND NOT EXISTS (SELECT 1 FROM lost b WHERE b.mode = lost.mode AND NOT b.whole AND NOT b.late AND NOT b.given_up AND b.cycle < lost.cycle)
    THEN 'released' ELSE 'waiting' END AS verdict FROM lost"""

LATE = f"""WITH {PRESENCE}, state AS (SELECT station_key, max(cycle) - 4 AS judged FROM seen GROUP BY station_key),
  settled AS (SELECT max(cycle) - 10 AS c FROM polls)
  SELECT s.station_key, s.cycle, s.digest, CASE WHEN s.cycle <= t.judged THEN 'late_station' ELSE 'late_cycle' END AS reason
  FROM seen s JOIN state t ON t.station_key = s.station_key, settled WHERE s.cycle <= t.judged OR s.cycle <= c"""


def _batch(n: int) -> str:
    """CTEs of one micro-batch: what comes, the queue with it, and its places."""
    before = f"(SELECT * FROM placed{n - 1} WHERE place > cap)" if n else "(SELECT * FROM new0 WHERE false)"
    since = "NULL" if not n else "o.since"
    return f"""new{n} AS (SELECT channel, cap, topic, 'e' || max(e) AS payload FROM m WHERE batch = {n} GROUP BY ALL),
    queue{n} AS (SELECT coalesce(w.channel, o.channel) AS channel, coalesce(w.cap, o.cap) AS cap, coalesce(w.topic, o.topic) AS topic,
      coalesce(w.payload, o.payload) AS payload, CAST(coalesce({since}, {n}) AS BIGINT) AS since
      FROM new{n} w FULL JOIN {before} o ON o.channel = w.channel AND o.topic = w.topic),
    placed{n} AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY since, md5(topic), topic) AS place FROM queue{n})"""


QUEUE = f"""WITH m AS (SELECT channel, cap, CAST(floor(epoch(ts) / 21600) AS BIGINT) % 3 AS batch,
    'Station_940G' || lpad(CAST(user_id AS VARCHAR), 6, '0') || '_' || upper(event_type) AS topic, event_id AS e
    FROM events, (VALUES ('push', 500), ('stream', 250), ('stream_lines', 100)) v(channel, cap)), {_batch(0)}, {_batch(1)}, {_batch(2)}
  {" UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS batch, channel, topic, payload, since, CAST((place - 1) // cap AS BIGINT) AS batch_no FROM placed{n} WHERE place <= cap" for n in range(3))}
  UNION ALL SELECT CAST(NULL AS INTEGER), channel, topic, payload, since, CAST(NULL AS BIGINT) FROM placed2 WHERE place > cap"""

_WANTED = "(SELECT 'p' || p_partkey FROM part WHERE p_size >= 5)"

PLAN = f"""WITH RECURSIVE {CAND}, asked AS (SELECT c.*, CASE WHEN mode = 'elizabeth-line' THEN 7
      ELSE 7 + (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM cand x WHERE x.mode = 'elizabeth-line' AND x.is_terminus = 0 AND x.naptan_id IN {_WANTED}) END AS rotation
    FROM cand c WHERE mode IN ('elizabeth-line', 'overground') AND naptan_id IN {_WANTED}),
  {ring("asked", "is_terminus = 1", "rotation")},
  ordered AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY place, naptan_id) AS rn FROM ringed),
  walk AS (SELECT mode, naptan_id, rn, cost <= 60 AS taken, CASE WHEN cost <= 60 THEN 60 - cost ELSE 60 END AS budget_left FROM ordered WHERE rn = 1
    UNION ALL SELECT o.mode, o.naptan_id, o.rn, o.cost <= w.budget_left, CASE WHEN o.cost <= w.budget_left THEN w.budget_left - o.cost ELSE w.budget_left END
    FROM walk w JOIN ordered o ON o.mode = w.mode AND o.rn = w.rn + 1)
  SELECT DISTINCT f.mode, CAST(9 AS BIGINT) AS cycle, f.naptan_id, f.common_name, f.line_id, 'Line ' || f.line_id AS line_name, f.naptan_id AS source_id,
    CAST(7 + (SELECT count(DISTINCT mode) FROM asked WHERE is_terminus = 0) AS INTEGER) AS rotation_after
  FROM walk w JOIN fit f ON f.mode = w.mode AND f.naptan_id = w.naptan_id WHERE taken"""


def _ways(lists: str, source: str) -> str:
    return f"""SELECT t.line_id, t.id AS naptan_id, x.name AS departing, '{source}' AS source
      FROM (SELECT DISTINCT line_id, id FROM {lists} WHERE id IS NOT NULL) t JOIN (SELECT DISTINCT line_id, name FROM {lists}) x ON x.line_id = t.line_id
      WHERE NOT EXISTS (SELECT 1 FROM {lists} p WHERE p.line_id = t.line_id AND p.id = t.id AND p.name = x.name)
      QUALIFY count(*) OVER (PARTITION BY t.line_id, t.id) = 1"""


def _lists(where: str) -> str:
    """Rows (line_id, name, id) of the last list under each name; an empty list is one row without id."""
    return f"""SELECT line_id, name, id FROM (SELECT *, max(place) OVER (PARTITION BY line_id, name) AS last FROM items WHERE {where}) WHERE place = last"""


ROUTES = f"""WITH items AS (SELECT DISTINCT l_suppkey AS k, 's' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS line_id,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 1 WHEN 'NF' THEN 2 WHEN 'NO' THEN 3 WHEN 'RF' THEN 4 END AS place,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'outbound' WHEN 'NF' THEN 'inbound' WHEN 'NO' THEN 'loop' WHEN 'RF' THEN 'inbound' END AS name,
    CASE WHEN l_returnflag || l_linestatus = 'NO' AND l_suppkey % 5 = 0 THEN NULL ELSE 'p' || l_partkey END AS id
    FROM lineitem WHERE l_returnflag || l_linestatus IN ('AF', 'NF', 'NO', 'RF') AND NOT (l_returnflag || l_linestatus = 'AF' AND l_suppkey % 7 = 0)),
  boot AS ({_lists("true")}), fed AS ({_lists("k % 4 <> 0 AND NOT (k % 3 = 0 AND place = 3)")})
  {_ways("boot", "boot")} UNION ALL {_ways("fed", "feed")}"""


def all_sql() -> dict[str, str]:
    return {"cycle_barrier": BARRIER, "late_stations": LATE, "pending_queue": QUEUE, "board_plan": PLAN, "route_departures": ROUTES}
