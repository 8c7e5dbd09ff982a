"""The queries of :mod:`deltaboard.plans.queries` once more, as plain SQL.

Written for another engine and, where it can be, in another form: recursion in
place of block folds, NOT EXISTS in place of sums, correlated minima in place of
carried values.
"""

from __future__ import annotations

# Of the queries only their own set-up is shared; what the engine knows is written out.
from deltaboard.plans.queries import ALIASES, CYCLE_SECONDS, MODES, NOW, PLATFORMS, STAMP_FORMS

# Stop type that a mode's stations must have.
STOP_TYPE_BY_MODE = {
    "bus": "NaptanPublicBusCoachTram",
    "tube": "NaptanMetroStation",
    "underground": "NaptanMetroStation",
    "overground": "NaptanRailStation",
    "elizabeth-line": "NaptanRailStation",
    "dlr": "NaptanMetroStation",
    "national-rail": "NaptanRailStation",
    "tram": "NaptanPublicBusCoachTram",
    "river-bus": "NaptanFerryPort",
    "cable-car": "NaptanCableCarStation",
}
# Display priority of a severity code; codes not listed have 0.
CODES_BY_PRIORITY = {
    9: [1, 2, 16, 20],
    8: [4],
    7: [3, 5, 11],
    6: [6],
    5: [7, 8, 15],
    4: [9, 14, 17],
    2: [12, 13, 19],
    1: [0],
}
# Messages shown for a good service that comes without a reason.
GOOD_SERVICE_MESSAGES = [
    "Please mind the gap between the train and the platform. Mind the gap.",
    "Please stand behind the yellow line and stay back from the platform edge.",
    "See it, say it, sorted. Text the British Transport Police on 61016.",
    "Please hold the handrail on the escalators and always stand on the right.",
    "Please move down inside the carriages and use all available space.",
    "Please offer your seat to those who may need it more than you. Thank you.",
    "Please keep all personal belongings with you at all times. Thank you.",
    "Check before you travel. Plan your journey at tfl.gov.uk or on the TfL Go app.",
    "Please have your tickets or contactless cards ready before the barriers.",
    "Follow the signs for a way out and keep to the left when on the stairs.",
    "For a more comfortable journey, please carry a bottle of water with you.",
    "Please keep the doorways clear to allow other customers to board the train.",
]

NOW_TS = f"TIMESTAMP '{NOW}'"
BUS = "NaptanPublicBusCoachTram"


def q(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def pick(index: str, values: list[str | None]) -> str:
    whens = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values))
    return f"CASE {index} {whens} END"


def station(number: str) -> str:
    return f"('940G' || lpad(CAST({number} AS VARCHAR), 6, '0'))"


def trimmed(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13))"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {trimmed(x)} = '')"


def clean(x: str) -> str:
    return trimmed(f"replace(replace(replace({x}, ' Underground Station', ''), ' Station', ''), ' DLR', '')")


def display(towards: str, dest: str) -> str:
    return clean(
        f"(CASE WHEN {towards} IS NOT NULL AND {trimmed(towards)} <> '' AND lower({trimmed(towards)}) <> 'null' "
        f"THEN {trimmed(towards)} ELSE {dest} END)"
    )


def unassigned(raw: str) -> str:
    return f"({blank(raw)} OR lower({trimmed(raw)}) IN ('null', 'unknown', 'platform unknown', 'no platform'))"


def label(mode: str, raw: str) -> str:
    t = trimmed(raw)
    second = trimmed(f"split_part({t}, ' - ', 2)")
    return f"""CASE
      WHEN {unassigned(raw)} THEN CASE WHEN {mode} = 'bus' THEN '' ELSE 'Platform not assigned' END
      WHEN {mode} = 'bus' THEN 'Stop ' || upper(CASE WHEN starts_with(lower({t}), 'stop ') THEN {trimmed(f"substr({t}, 6)")} ELSE {t} END)
      WHEN contains({t}, ' - ') THEN (CASE WHEN starts_with(lower({second}), 'platform') THEN {second} ELSE 'Platform ' || {second} END)
        || ' (' || {trimmed(f"split_part({t}, ' - ', 1)")} || ')'
      WHEN regexp_full_match({t}, '[0-9]+') THEN 'Platform ' || {t}
      WHEN regexp_full_match(lower({t}), 'plat [0-9]+') THEN 'Platform ' || substr({t}, 6)
      WHEN regexp_full_match({t}, '[A-Za-z]|[0-9]+[A-Za-z]+') THEN 'Platform ' || upper({t})
      ELSE {t} END"""


def iso(ts: str, suffix: str = "Z") -> str:
    micros = f"(CAST(extract(microsecond FROM {ts}) AS BIGINT) % 1000000)"
    return f"""(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {micros} = 0 THEN ''
      WHEN {micros} % 1000 = 0 THEN '.' || lpad(CAST({micros} // 1000 AS VARCHAR), 3, '0')
      ELSE '.' || lpad(CAST({micros} AS VARCHAR), 6, '0') END || '{suffix}')"""


def direction(d: str, platform: str) -> str:
    return (
        f"CASE WHEN {blank(d)} THEN CASE WHEN lower({platform}) LIKE '%inbound%' THEN 'inbound' ELSE 'outbound' END "
        f"ELSE lower({d}) END"
    )


def minutes(later: str, earlier: str) -> str:
    return f"CAST(trunc((epoch_us({later}) - epoch_us({earlier})) / 60000000.0) AS BIGINT)"


EV = "ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"

ARR = f"""{EV}, arr AS (SELECT
  {pick("user_id % 5", MODES)} AS mode, CAST(0 AS BIGINT) AS cycle, event_id AS feed_seq, {NOW_TS} AS fetched_at,
  {station("user_id")} AS naptan_id, 'Halt ' || user_id || ' Underground Station' AS station_name,
  CASE WHEN k <> 98 THEN event_type END AS line_id, CASE WHEN k % 7 <> 0 THEN 'Line ' || event_type END AS line_name,
  {pick("k % 12", PLATFORMS)} AS platform, {pick("k % 4", [None, "Inbound", "outbound", " "])} AS direction,
  CASE WHEN k % 13 = 0 THEN {station("user_id")} WHEN k % 11 <> 0 THEN {station("k")} END AS dest_id,
  'Place ' || k || {pick("k % 3", [" Underground Station", " DLR Station", ""])} AS dest_name,
  CASE k % 6 WHEN 0 THEN 'End ' || k || ' Station' WHEN 1 THEN 'null' WHEN 2 THEN ' ' WHEN 3 THEN ' Via ' || k || ' DLR' END AS towards,
  CASE WHEN k <> 97 THEN ts END AS eta, k, event_type FROM ev)"""

DEP = f"""pairs AS (SELECT DISTINCT line_id, lower(direction) AS d, {station("k")} AS dest FROM arr
  WHERE NOT {blank("direction")} AND line_id IS NOT NULL),
dep AS (SELECT t.line_id, t.dest AS naptan_id, min(x.d) AS departing
  FROM (SELECT DISTINCT line_id, dest FROM pairs) t JOIN (SELECT DISTINCT line_id, d FROM pairs) x ON x.line_id = t.line_id
  WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.line_id = t.line_id AND p.dest = t.dest AND p.d = x.d)
  GROUP BY t.line_id, t.dest HAVING count(*) = 1)"""

BRD = f"""brd AS (SELECT mode, cycle, feed_seq, naptan_id, event_type AS line_id,
  CASE WHEN k % 17 = 0 THEN upper(event_type) WHEN k % 19 = 0 THEN 'other' END AS entry_line_id, platform, dest_id, dest_name,
  {pick("k % 9", ["Cancelled", "NotStoppingAtStation", "Delayed", None, "OnTime", "OnTime", "OnTime", "Delayed", "OnTime"])} AS status,
  CASE WHEN k % 5 <> 0 THEN date_trunc('hour', eta) END AS estimated,
  CASE WHEN k % 10 <> 0 THEN date_trunc('hour', eta) END AS scheduled FROM arr WHERE k >= 50)"""

WHOLE_BRD = BRD.replace(" WHERE k >= 50", "")

HALF = "half AS (SELECT * FROM arr WHERE k < 50)"

PLAN = f"""plan AS (SELECT DISTINCT {pick("user_id % 5", MODES)} AS mode, {station("user_id")} AS naptan_id,
  'Common ' || user_id AS common_name, event_type AS line_id, CASE WHEN user_id % 3 = 0 THEN 'Known ' || event_type END AS line_name
  FROM ev WHERE user_id % 4 <> 0 AND event_type <> 'view')"""


def usable(source: str) -> str:
    """CTE ``brows``: usable board rows of ``source``, each working once."""
    return f"""bsel AS (SELECT *, coalesce(estimated, scheduled) AS eta,
    coalesce({trimmed("platform")}, '') AS raw_platform, coalesce(dest_id, 'unknown') AS dest FROM {source}),
  brows AS (SELECT mode, cycle, naptan_id, line_id, feed_seq, eta, raw_platform, dest_id AS match_dest, dest AS dest_id,
    {label("mode", "raw_platform")} AS platform, {clean("dest_name")} AS display FROM bsel
    WHERE (entry_line_id IS NULL OR lower(entry_line_id) = lower(line_id))
      AND (status IS NULL OR status NOT IN ('Cancelled', 'NotStoppingAtStation'))
      AND eta IS NOT NULL AND (dest_id IS NULL OR dest_id <> naptan_id)
      AND (coalesce(status, '') = 'Delayed' OR eta >= {NOW_TS} - INTERVAL 2 MINUTE)
    QUALIFY row_number() OVER (PARTITION BY mode, naptan_id, line_id, dest, eta, raw_platform ORDER BY feed_seq) = 1)"""


def learned(source: str) -> str:
    return f"""taught AS (SELECT naptan_id, dest_id, coalesce({trimmed("platform")}, '') AS raw_platform,
    lower({trimmed("direction")}) AS d FROM {source} WHERE NOT {blank("direction")}),
  ldest AS (SELECT naptan_id, dest_id, min(d) AS d FROM taught WHERE dest_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT d) = 1),
  lplat AS (SELECT naptan_id, raw_platform, min(d) AS d FROM taught WHERE NOT {unassigned("raw_platform")}
    GROUP BY naptan_id, raw_platform HAVING count(DISTINCT d) = 1)"""


RESOLVED = f"""r1 AS (SELECT b.*, coalesce(ld.d, CASE WHEN lower(b.raw_platform) LIKE '%inbound%' THEN 'inbound' END,
    CASE WHEN NOT {unassigned("b.raw_platform")} THEN lp.d END) AS d1
  FROM brows b LEFT JOIN ldest ld ON ld.naptan_id = b.naptan_id AND ld.dest_id = b.match_dest
  LEFT JOIN lplat lp ON lp.naptan_id = b.naptan_id AND lp.raw_platform = b.raw_platform),
r2 AS (SELECT *, coalesce(d1, CASE WHEN NOT {unassigned("raw_platform")}
    AND count(DISTINCT d1) OVER (PARTITION BY naptan_id, raw_platform) = 1 THEN max(d1) OVER (PARTITION BY naptan_id, raw_platform) END) AS d2 FROM r1),
r3 AS (SELECT *, coalesce(d2, CASE WHEN count(DISTINCT d2) OVER (PARTITION BY naptan_id, line_id) = 1
    THEN max(d2) OVER (PARTITION BY naptan_id, line_id) END) AS d3 FROM r2),
dirs AS (SELECT r3.* EXCLUDE (d1, d2, d3), coalesce(d3, dep.departing, 'outbound') AS direction
  FROM r3 LEFT JOIN dep ON dep.line_id = lower(r3.line_id) AND dep.naptan_id = r3.naptan_id)"""

BOARD_ITEMS = f"""bitems AS (SELECT mode, cycle, naptan_id, line_id, direction, pos, dest_id, platform, {iso("eta")} AS eta_text, display FROM (
  SELECT *, row_number() OVER (PARTITION BY mode, cycle, naptan_id, line_id, direction ORDER BY eta NULLS LAST, feed_seq) AS pos FROM dirs)
  WHERE pos <= 10)"""


def relabelled(source: str) -> str:
    ends = "coalesce(a.dest_id = a.naptan_id, false)"
    return f"""turned AS (SELECT a.* EXCLUDE (towards, dest_name, direction, dest_id),
    CASE WHEN {ends} THEN 'Check Front of Train' ELSE a.towards END AS towards,
    CASE WHEN NOT {ends} THEN a.dest_name END AS dest_name,
    CASE WHEN {ends} AND {blank("a.direction")} THEN dep.departing ELSE a.direction END AS direction,
    CASE WHEN {ends} THEN 'unknown' ELSE a.dest_id END AS dest_id
    FROM {source} a LEFT JOIN dep ON dep.line_id = lower(a.line_id) AND dep.naptan_id = a.naptan_id WHERE a.line_id IS NOT NULL)"""


def citems(source: str, now: str = NOW_TS) -> str:
    """CTE ``citems``: countdown items of ``source``."""
    late = "mode IN ('overground', 'dlr', 'elizabeth-line')"
    return f"""{relabelled(source)},
  citems AS (SELECT mode, cycle, naptan_id, line_id, direction, pos, dest_id, platform, eta_text, display FROM (
    SELECT mode, cycle, naptan_id, line_id, {direction("direction", "platform")} AS direction, dest_id,
      {label("mode", "platform")} AS platform, {iso("eta")} AS eta_text, {display("towards", "dest_name")} AS display,
      row_number() OVER (PARTITION BY mode, cycle, naptan_id, line_id, {direction("direction", "platform")}
        ORDER BY eta NULLS LAST, feed_seq) AS pos
    FROM turned WHERE (eta IS NULL OR eta >= {now} - INTERVAL 2 MINUTE)
      AND NOT ({late} AND {unassigned("platform")} AND (eta IS NULL OR {minutes("eta", now)} > 20))) WHERE pos <= 10)"""


def documents(items: str, lines: str, stations: str, lut: str) -> str:
    """CTEs ``kept`` (rows that fit), ``dtext`` (documents as JSON), both pruned to 4000 bytes."""
    js = lambda x: f"coalesce('\"' || {x} || '\"', 'null')"
    item = (
        f"'{{\"destId\":' || {js('dest_id')} || ',\"platform\":' || {js('platform')} || ',\"eta\":' || {js('eta_text')} "
        f"|| ',\"displayName\":' || {js('display')} || '}}'"
    )
    key = "mode, cycle, naptan_id"
    line_json = f"'\"' || line_id || '\":{{\"id\":\"' || line_id || '\",\"name\":' || {js('line_name')} || ',\"dirs\":{{'"
    doc = (
        f"'{{\"id\":\"' || s.naptan_id || '\",\"name\":' || {js('s.name')} || ',\"lut\":\"' || {lut} || '\",\"lines\":{{' "
        "|| coalesce(l.txt, '') || '}}'"
    )

    def build(tag: str, preds: str) -> str:
        return f"""d_{tag} AS (SELECT {key}, line_id, direction,
      '"' || direction || '":{{"preds":[' || {preds} || ']}}' AS txt FROM ijson GROUP BY {key}, line_id, direction),
    l_{tag} AS (SELECT {key}, string_agg({line_json} || coalesce(x.txt, '') || '}}}}', ',' ORDER BY line_id) AS txt
      FROM {lines} LEFT JOIN (SELECT {key}, line_id, string_agg(txt, ',' ORDER BY direction) AS txt FROM d_{tag} GROUP BY {key}, line_id) x
        USING ({key}, line_id) GROUP BY {key}),
    t_{tag} AS (SELECT s.mode, s.cycle, s.naptan_id, s.name, coalesce(l.txt, '') AS content, {doc} AS txt
      FROM {stations} s LEFT JOIN l_{tag} l ON l.mode = s.mode AND l.cycle = s.cycle AND l.naptan_id = s.naptan_id)"""

    full = build("full", "string_agg(item, ',' ORDER BY pos)").replace("d_full", "d_pruned").replace("l_full", "l_pruned").replace("t_full", "dtext").replace("FROM ijson", "FROM marked")
    full = full.replace("string_agg(item, ',' ORDER BY pos)", "coalesce(string_agg(item, ',' ORDER BY pos) FILTER (WHERE fits), '')")
    return f"""ijson AS (SELECT *, {item} AS item FROM {items}),
  {build("empty", "''")},
  marked AS (SELECT i.*, strlen(e.txt) + sum(strlen(i.item) + CASE WHEN i.pos > 1 THEN 1 ELSE 0 END) OVER (
      PARTITION BY i.mode, i.cycle, i.naptan_id ORDER BY replace(i.eta_text, 'Z', '') NULLS LAST, i.line_id, i.direction, i.pos
      ROWS UNBOUNDED PRECEDING) <= 4000 AS fits
    FROM ijson i JOIN t_empty e ON e.mode = i.mode AND e.cycle = i.cycle AND e.naptan_id = i.naptan_id),
  {full},
  kept AS (SELECT m.*, s.name, n.line_name FROM marked m
    JOIN {stations} s ON s.mode = m.mode AND s.cycle = m.cycle AND s.naptan_id = m.naptan_id
    JOIN {lines} n ON n.mode = m.mode AND n.cycle = m.cycle AND n.naptan_id = m.naptan_id AND n.line_id = m.line_id WHERE m.fits)"""


def spines(source: str, suffix: str = "") -> str:
    return f"""lines{suffix} AS (SELECT mode, cycle, naptan_id, line_id, line_name FROM {source} WHERE line_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY mode, cycle, naptan_id, line_id ORDER BY feed_seq) = 1),
  stations{suffix} AS (SELECT mode, cycle, naptan_id, station_name AS name FROM {source}
    QUALIFY row_number() OVER (PARTITION BY mode, cycle, naptan_id ORDER BY feed_seq) = 1)"""


SNAPSHOT_DOCS = f"""{ARR}, {DEP}, {citems("arr")}, {spines("arr")}, {documents("citems", "lines", "stations", "'2024-01-05T00:00:00'")}"""

DOC_COLUMNS = "line_id, line_name, direction, CAST(pos AS INTEGER) AS pos, dest_id AS \"destId\", platform, eta_text AS eta, display AS \"displayName\""

PRESENCE = f"""{EV}, raw AS (SELECT 'Station_490' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS station_key,
    CAST(floor(epoch(ts) / {CYCLE_SECONDS}) AS BIGINT) AS cycle, event_type = 'error' AS error FROM ev),
  seen AS (SELECT station_key, cycle, CASE WHEN bool_or(error) THEN 'true' ELSE 'false' END AS digest FROM raw GROUP BY station_key, cycle),
  polls AS (SELECT cycle, count(*) AS arrivals FROM raw GROUP BY cycle)"""


def history(guard: int | None, seen: str = "seen") -> str:
    """CTEs ``walked`` (rows with changed, beat, wiped_at, last)."""
    wiped = (
        "CAST(NULL AS BIGINT)"
        if guard is None
        else f"(SELECT min(p.cycle) FROM polls p WHERE p.arrivals > {guard} AND p.cycle > s.cycle AND (s.nxt IS NULL OR p.cycle < s.nxt))"
    )
    return f"""ahead AS (SELECT *, lead(cycle) OVER w AS nxt, lag(digest) OVER w AS prev, row_number() OVER w AS rn
    FROM {seen} WINDOW w AS (PARTITION BY station_key ORDER BY cycle)),
  gone AS (SELECT s.*, {wiped} AS wiped_at FROM ahead s),
  judged AS (SELECT *, rn = 1 OR prev IS DISTINCT FROM digest OR lag(wiped_at) OVER (PARTITION BY station_key ORDER BY cycle) IS NOT NULL AS changed FROM gone),
  walked AS (SELECT j.*, j.cycle AS last, false AS beat FROM judged j WHERE rn = 1
    UNION ALL SELECT j.*, CASE WHEN j.changed OR j.cycle - w.last >= 5 THEN j.cycle ELSE w.last END,
      NOT j.changed AND j.cycle - w.last >= 5 FROM walked w JOIN judged j ON j.station_key = w.station_key AND j.rn = w.rn + 1),
  emitted AS (SELECT station_key, cycle, 'changed' AS reason, digest FROM walked WHERE changed
    UNION ALL SELECT station_key, cycle, 'heartbeat', digest FROM walked WHERE beat
    UNION ALL SELECT station_key, wiped_at, 'wipe', NULL FROM walked WHERE wiped_at IS NOT NULL)"""


MSG = pick("{0} % 12", GOOD_SERVICE_MESSAGES)

STAT = """st AS (SELECT CAST(o_orderkey // 10 AS BIGINT) AS sync_id, o_orderkey AS feed_seq, 'tube' AS mode,
    'line-' || (o_custkey % 60) AS id, 'Line ' || (o_custkey % 60) AS name,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'Severe Delays' WHEN o_orderpriority = '2-HIGH' THEN 'Minor Delays'
      WHEN o_orderkey % 50 = 0 THEN 'GOOD SERVICE' ELSE 'Good Service' END AS description,
    CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN CASE o_orderkey % 9 WHEN 0 THEN 'Extra trains' WHEN 1 THEN '' END
      WHEN o_orderstatus = 'F' THEN 'Signal failure' WHEN o_orderstatus = 'P' THEN ' ' END AS reason FROM orders)"""

# Line items as status entries; the best readable one, else the first.
PRIORITY = " ".join(
    f"WHEN code IN ({', '.join(map(str, codes))}) THEN {p}" for p, codes in CODES_BY_PRIORITY.items()
)
RAWSTAT = f"""ent AS (SELECT l_orderkey, 'Status ' || l_returnflag AS description, CASE WHEN l_suppkey % 3 = 0 THEN 'Works' END AS reason,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_suppkey) AS pos, l_partkey % 21 AS code FROM lineitem),
  best AS (SELECT * FROM ent QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE {PRIORITY} ELSE 0 END DESC, pos) = 1),
  st AS (SELECT CAST(o_orderkey // 10 AS BIGINT) AS sync_id, o_orderkey AS feed_seq, 'tube' AS mode, 'line-' || (o_custkey % 60) AS id,
    'Line ' || (o_custkey % 60) AS name, coalesce(b.description, 'Unknown') AS description, b.reason
    FROM orders LEFT JOIN best b ON b.l_orderkey = o_orderkey)"""


def status_walk(source: str) -> str:
    said, good = f"NOT {blank('{0}.reason')}", "lower({0}.description) = 'good service'"
    msg = MSG.format("{0}.feed_seq")
    s = lambda a: said.format(a)
    g = lambda a: good.format(a)
    m = lambda a: msg.format(a)
    return f"""{source},
  base AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sync_id) AS rn FROM (
    SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY id, sync_id ORDER BY feed_seq DESC) = 1)),
  chain AS (SELECT b.id, b.rn, b.sync_id, b.description, CASE WHEN {s('b')} THEN b.reason WHEN {g('b')} THEN {m('b')} ELSE b.reason END AS eff
      FROM base b WHERE rn = 1
    UNION ALL SELECT b.id, b.rn, b.sync_id, b.description, CASE WHEN {s('b')} THEN b.reason WHEN {g('b')} AND {g('c')} THEN c.eff
      WHEN {g('b')} THEN {m('b')} ELSE b.reason END FROM chain c JOIN base b ON b.id = c.id AND b.rn = c.rn + 1),
  hist AS (SELECT t.*, CASE WHEN {s('t')} THEN t.reason WHEN {g('t')} AND c.id IS NOT NULL AND {g('c')} THEN c.eff WHEN {g('t')} THEN {m('t')} ELSE t.reason END AS shown_reason,
      CASE WHEN c.id IS NULL OR c.description IS DISTINCT FROM t.description
        OR ({s('t')} AND c.eff IS DISTINCT FROM t.reason) OR (NOT ({s('t')}) AND {g('t')} AND NOT ({g('c')}))
        OR (NOT ({s('t')}) AND NOT ({g('t')}) AND NOT {blank('c.eff')}) THEN 1 ELSE 0 END AS changed
    FROM st t JOIN base b ON b.id = t.id AND b.sync_id = t.sync_id LEFT JOIN chain c ON c.id = t.id AND c.rn = b.rn - 1)"""


def stop_type(mode: str) -> str:
    whens = " ".join(f"WHEN {q(m)} THEN {q(t)}" for m, t in STOP_TYPE_BY_MODE.items())
    return f"CASE {mode} {whens} END"


STOPS = f"""stops AS (SELECT {pick("l_suppkey % 5", MODES)} AS mode, 's' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS line_id,
    l_suppkey, p_partkey, 'p' || p_partkey AS naptan_id, p_name AS common_name, p_retailprice / 100 AS lat, CAST(p_size AS DOUBLE) AS lon,
    {pick("p_partkey % 4", ["NaptanPublicBusCoachTram", "NaptanMetroStation", "NaptanRailStation", "NaptanFerryPort"])} AS stop_type,
    p_brand AS indicator, 'via ' || l_suppkey AS compass_point
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON p_partkey = l_partkey),
  fit AS (SELECT * FROM stops WHERE stop_type = {stop_type("mode")}),
  routes AS (SELECT DISTINCT 's' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS line_id,
    CASE l_returnflag WHEN 'A' THEN 'inbound' WHEN 'R' THEN 'outbound' ELSE 'loop' END AS direction, 'p' || l_partkey AS naptan_id
    FROM lineitem)"""


def folded(source: str, tag: str) -> str:
    """CTEs of stations after a sync of ``source`` into an empty table."""
    return f"""ld_{tag} AS (SELECT f.naptan_id, f.mode, f.line_id, string_agg(DISTINCT r.direction, ',' ORDER BY r.direction) AS directions
      FROM {source} f LEFT JOIN routes r ON r.line_id = f.line_id AND r.naptan_id = f.naptan_id GROUP BY ALL),
    sc_{tag} AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY naptan_id ORDER BY line_id DESC) = 1)"""


def keys_of(lines: str) -> str:
    """Search keys of rows (naptan_id, mode, line_id, directions)."""
    return f"""SELECT naptan_id, mode AS search_key FROM {lines} UNION SELECT naptan_id, line_id FROM {lines}
      UNION SELECT naptan_id, mode || '_' || line_id FROM {lines}
      UNION SELECT naptan_id, line_id || '_' || d FROM (SELECT *, unnest(string_split(directions, ',')) AS d FROM {lines} WHERE directions IS NOT NULL)
      UNION SELECT naptan_id, mode || '_' || line_id || '_' || d FROM (SELECT *, unnest(string_split(directions, ',')) AS d FROM {lines} WHERE directions IS NOT NULL)"""


DIFF = f"""{STOPS}, {folded("fit", "new")},
  known AS (SELECT * REPLACE (CASE WHEN p_partkey % 5 = 0 THEN 'old name' ELSE common_name END AS common_name) FROM fit
    WHERE p_partkey % 3 <> 0 AND l_suppkey % 7 <> 0),
  {folded("known", "old")},
  nkeys AS ({keys_of("ld_new")}),
  diff AS (SELECT n.naptan_id, CASE WHEN o.naptan_id IS NULL THEN 'new' ELSE 'changed' END AS change,
      (SELECT CAST(count(*) AS INTEGER) FROM nkeys k WHERE k.naptan_id = n.naptan_id) AS n_keys
    FROM sc_new n LEFT JOIN sc_old o ON o.naptan_id = n.naptan_id
    WHERE o.naptan_id IS NULL OR n.common_name <> o.common_name OR n.compass_point <> o.compass_point
      OR (SELECT count(*) FROM ld_new x WHERE x.naptan_id = n.naptan_id) <> (SELECT count(*) FROM ld_old x WHERE x.naptan_id = n.naptan_id))"""

CAND = f"""{STOPS}, wayrows AS (SELECT line_id, direction, naptan_id AS dest FROM routes),
  ways AS (SELECT t.line_id, t.dest AS naptan_id FROM (SELECT DISTINCT line_id, dest FROM wayrows) t
    JOIN (SELECT DISTINCT line_id, direction FROM wayrows) x ON x.line_id = t.line_id
    WHERE NOT EXISTS (SELECT 1 FROM wayrows p WHERE p.line_id = t.line_id AND p.dest = t.dest AND p.direction = x.direction)
    GROUP BY ALL HAVING count(*) = 1),
  cand AS (SELECT f.mode, f.naptan_id, count(*) AS cost, CAST(max(CASE WHEN w.line_id IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS is_terminus
    FROM (SELECT DISTINCT mode, naptan_id, line_id FROM fit) f LEFT JOIN ways w ON w.line_id = f.line_id AND w.naptan_id = f.naptan_id GROUP BY f.mode, f.naptan_id)"""


def ring(source: str, terminus: str, rotation: int) -> str:
    return f"""ringed AS (SELECT *, CAST(-1 AS BIGINT) AS place FROM {source} WHERE {terminus}
    UNION ALL SELECT * EXCLUDE (seq, n), CAST((seq - {rotation} % n + n) % n AS BIGINT) FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY md5(naptan_id), naptan_id) - 1 AS seq,
      count(*) OVER (PARTITION BY mode) AS n FROM {source} WHERE NOT ({terminus})))"""


STAMPS = f"""stamps AS (SELECT o_orderkey, o_custkey, form, CASE form WHEN 'ms' THEN ms WHEN 'padded ms' THEN ' ' || ms || chr(9)
    WHEN 'instant' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.250Z' WHEN 'zoneless' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.0326'
    WHEN 'minutes' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M') WHEN 'date' THEN strftime(o_orderdate, '%Y-%m') WHEN 'word' THEN 'v' || ms
    WHEN 'signed' THEN '-' || ms END AS stamp,
    CAST(CASE form WHEN 'ms' THEN epoch_ms(o_orderdate) WHEN 'padded ms' THEN epoch_ms(o_orderdate) WHEN 'instant' THEN epoch_ms(o_orderdate) + 250
      WHEN 'zoneless' THEN epoch_ms(o_orderdate) + 32 WHEN 'minutes' THEN epoch_ms(o_orderdate) WHEN 'signed' THEN -epoch_ms(o_orderdate) ELSE 0 END AS BIGINT) AS epoch_ms,
    CAST(CASE form WHEN 'ms' THEN epoch_ms(o_orderdate) WHEN 'padded ms' THEN epoch_ms(o_orderdate) WHEN 'signed' THEN -epoch_ms(o_orderdate)
      WHEN 'word' THEN 0 WHEN 'none' THEN 0 ELSE extract(year FROM o_orderdate) END AS BIGINT) AS prefix
    FROM (SELECT *, {pick("o_orderkey % 9", STAMP_FORMS)} AS form, CAST(epoch_ms(o_orderdate) AS VARCHAR) AS ms FROM orders))"""

COUNTS = f"counts AS (SELECT {station('user_id')} AS naptan_id, CASE WHEN count(*) % 7 <> 0 THEN count(*) % 3 - 1 END AS n FROM events GROUP BY user_id)"

ALIAS_DROP = " OR ".join(f"(mode = {q(m)} AND naptan_id = {q(p)})" for m, p, _, _ in ALIASES)
ALIAS_ID = "CASE " + " ".join(f"WHEN mode = {q(m)} AND naptan_id = {q(s)} THEN {q(p)}" for m, p, s, _ in ALIASES) + " ELSE naptan_id END"
ALIAS_NAME = "CASE " + " ".join(f"WHEN mode = {q(m)} AND naptan_id = {q(s)} THEN {q(n)}" for m, _, s, n in ALIASES) + " ELSE station_name END"


def geohash_sql(lat: str, lon: str) -> str:
    lonc = f"CAST(least(8388607, floor(({lon} + 180) / 360 * 8388608)) AS BIGINT)"
    latc = f"CAST(least(4194303, floor(({lat} + 90) / 180 * 4194304)) AS BIGINT)"
    letters = []
    for start in range(0, 45, 5):
        bits = []
        for place in range(5):
            at = start + place
            cell, width = ("lonc", 23) if at % 2 == 0 else ("latc", 22)
            bits.append(f"(({cell} // {1 << (width - 1 - at // 2)}) % 2) * {1 << (4 - place)}")
        letters.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST({' + '.join(bits)} AS INTEGER) + 1, 1)")
    return lonc, latc, " || ".join(letters)


def _geo() -> str:
    lonc, latc, text = geohash_sql("lat", "lon")
    return f"""SELECT c_custkey, {text} AS geo_hash FROM (SELECT c_custkey, {lonc} AS lonc, {latc} AS latc FROM (
      SELECT c_custkey, c_acctbal / 120 AS lat, c_acctbal / 60 - c_nationkey AS lon FROM customer))"""


MERGED = f"""{ARR}, {DEP}, {HALF}, {PLAN}, {BRD},
  asked AS (SELECT * FROM brd WHERE EXISTS (SELECT 1 FROM plan p WHERE p.mode = brd.mode AND p.naptan_id = brd.naptan_id AND p.line_id = brd.line_id)),
  athome AS (SELECT * FROM half WHERE EXISTS (SELECT 1 FROM plan p WHERE p.mode = half.mode AND p.naptan_id = half.naptan_id)),
  {usable("asked")}, {learned("athome")}, {RESOLVED}, {BOARD_ITEMS},
  rest AS (SELECT * FROM half WHERE NOT EXISTS (SELECT 1 FROM brows b WHERE b.mode = half.mode AND b.naptan_id = half.naptan_id AND b.line_id = half.line_id)),
  {citems("rest")}"""

BOARD_NAMES = """bnames AS (SELECT l.*, coalesce(
    (SELECT arg_min(h.line_name, h.feed_seq) FROM half h WHERE h.naptan_id = l.naptan_id AND lower(h.line_id) = lower(l.line_id) AND h.line_name IS NOT NULL),
    (SELECT min(p.line_name) FROM plan p WHERE p.naptan_id = l.naptan_id AND p.line_id = l.line_id AND trim(p.line_name) <> ''),
    upper(substr(l.line_id, 1, 1)) || substr(l.line_id, 2)) AS line_name
  FROM (SELECT DISTINCT mode, cycle, naptan_id, line_id FROM brows) l)"""


def all_sql() -> dict[str, str]:
    sql = {}

    sql["topk_departures"] = f"""WITH {ARR} SELECT naptan_id, line_id, direction, CAST(pos AS INTEGER) AS pos, feed_seq, {iso("eta")} AS eta FROM (
      SELECT *, row_number() OVER (PARTITION BY naptan_id, line_id, direction ORDER BY eta NULLS LAST, feed_seq) AS pos FROM (
        SELECT * REPLACE ({direction("direction", "platform")} AS direction) FROM arr
        WHERE line_id IS NOT NULL AND (eta IS NULL OR eta >= {NOW_TS} - INTERVAL 2 MINUTE))) WHERE pos <= 10"""
    sql["presentable_platforms"] = f"""WITH {ARR} SELECT mode, platform AS raw, {label("mode", "platform")} AS label,
      CASE WHEN {unassigned("platform")} THEN 1 ELSE 0 END AS unassigned, count(*) AS n FROM arr GROUP BY ALL"""
    sql["display_names"] = f"""WITH {ARR} SELECT source, display, count(*) AS n FROM (
      SELECT 'nation' AS source, {display("'NULL'", "(n_name || ' Station')")} AS display FROM nation
      UNION ALL SELECT 'supplier', {display("CAST(NULL AS VARCHAR)", "(chr(9) || s_name || ' DLR Underground Station ')")} FROM supplier
      UNION ALL SELECT 'events', {display("towards", "dest_name")} FROM arr) GROUP BY ALL"""
    sql["far_future_filter"] = f"""WITH {ARR} SELECT feed_seq, mode, {minutes("eta", NOW_TS)} AS minutes FROM arr
      WHERE mode IN ('overground', 'dlr', 'elizabeth-line') AND {unassigned("platform")} AND (eta IS NULL OR {minutes("eta", NOW_TS)} > 20)"""
    sql["subscribed_arrivals"] = f"""WITH {ARR}, {COUNTS} SELECT feed_seq, naptan_id FROM arr
      WHERE naptan_id IN (SELECT naptan_id FROM counts WHERE n > 0)"""
    sql["nap_mode"] = f"WITH {ARR} SELECT DISTINCT mode, CAST(0 AS BIGINT) AS arrivals FROM arr"
    sql["live_or_mirror"] = f"""WITH {COUNTS} SELECT naptan_id, 'live' AS source FROM counts WHERE n > 0
      UNION ALL SELECT {station("c_custkey")}, 'mirror' FROM customer"""
    sql["alias_remap"] = f"""WITH {ARR} SELECT feed_seq, {ALIAS_ID} AS naptan_id, {ALIAS_NAME} AS station_name FROM arr WHERE NOT ({ALIAS_DROP})"""
    source = "CASE " + " ".join(f"WHEN mode = {q(m)} AND naptan_id = {q(p)} THEN {q(s)}" for m, p, s, _ in ALIASES) + " ELSE naptan_id END"
    sql["board_aliases"] = f"WITH {ARR}, {WHOLE_BRD} SELECT feed_seq, {ALIAS_ID} AS naptan_id, {source} AS source_id FROM brd WHERE NOT ({ALIAS_DROP})"
    sql["terminus_relabel"] = f"WITH {ARR}, {DEP}, {relabelled('arr')} SELECT feed_seq, towards, dest_name, direction, dest_id FROM turned"
    sql["countdown_items"] = f"""WITH {ARR}, {DEP}, {citems("arr")} SELECT mode, naptan_id, line_id, direction, CAST(pos AS INTEGER) AS pos,
      dest_id, platform, eta_text, display FROM citems"""
    sql["board_rows"] = f"""WITH {ARR}, {WHOLE_BRD}, {usable("brd")} SELECT naptan_id, line_id, feed_seq, {iso("eta")} AS eta, raw_platform, dest_id, platform, display FROM brows"""
    sql["learned_directions"] = f"""WITH {ARR}, {learned("arr")} SELECT naptan_id, 'destination' AS kind, dest_id AS value, d AS direction FROM ldest
      UNION ALL SELECT naptan_id, 'platform', raw_platform, d FROM lplat"""
    sql["direction_resolution"] = f"""WITH {ARR}, {DEP}, {HALF}, {BRD}, {usable("brd")}, {learned("half")}, {RESOLVED}
      SELECT naptan_id, line_id, feed_seq, direction FROM dirs"""
    sql["line_fallback"] = f"""WITH {MERGED} SELECT path, naptan_id, line_id, direction, CAST(pos AS INTEGER) AS pos, dest_id, platform, eta_text, display FROM (
      SELECT 'board' AS path, * FROM bitems UNION ALL SELECT 'countdown', * FROM citems)"""
    sql["line_names"] = f"WITH {ARR}, {HALF}, {PLAN}, {BRD}, {usable('brd')}, {BOARD_NAMES} SELECT naptan_id, line_id, line_name FROM bnames"
    sql["terminus_directions"] = """WITH p AS (SELECT DISTINCT lower(n_name) AS line_id, lower(l_returnflag) AS d, CAST(l_partkey AS VARCHAR) AS dest
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
      SELECT t.line_id, t.dest AS naptan_id, min(x.d) AS departing FROM (SELECT DISTINCT line_id, dest FROM p) t
        JOIN (SELECT DISTINCT line_id, d FROM p) x ON x.line_id = t.line_id
      WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.line_id = t.line_id AND p.dest = t.dest AND p.d = x.d) GROUP BY ALL HAVING count(*) = 1"""
    sql["terminus_directions"] = sql["terminus_directions"].replace("GROUP BY ALL HAVING", "GROUP BY t.line_id, t.dest HAVING")

    sql["grouped_lines"] = f"""WITH {ARR}, {spines("arr")} SELECT s.mode, s.naptan_id, s.name, l.line_id, l.line_name FROM stations s
      LEFT JOIN lines l ON l.naptan_id = s.naptan_id AND l.mode = s.mode"""
    sql["pruned_payload_rows"] = f"WITH {SNAPSHOT_DOCS} SELECT mode, naptan_id, {DOC_COLUMNS} FROM kept"
    sql["station_payloads"] = f"""WITH {SNAPSHOT_DOCS} SELECT 'Station_' || naptan_id AS station_key, CAST(strlen(txt) AS INTEGER) AS bytes,
      md5(txt) AS payload_md5 FROM dtext"""
    sql["merged_documents"] = f"""WITH {MERGED}, {BOARD_NAMES}, {spines("rest", "_rest")}, {spines("half", "_half")},
      mlines AS (SELECT mode, cycle, naptan_id, line_id, line_name FROM bnames UNION ALL SELECT * FROM lines_rest),
      mitems AS (SELECT * FROM bitems UNION ALL SELECT * FROM citems),
      mstations AS (SELECT * FROM stations_half UNION ALL SELECT DISTINCT mode, CAST(0 AS BIGINT), naptan_id, common_name FROM plan
        WHERE NOT EXISTS (SELECT 1 FROM stations_half h WHERE h.naptan_id = plan.naptan_id)),
      {documents("mitems", "mlines", "mstations", "'2024-01-05T00:00:00'")}
      SELECT mode, naptan_id, name, {DOC_COLUMNS} FROM kept"""

    sql["emitted_updates"] = f"WITH RECURSIVE {PRESENCE}, {history(50)} SELECT station_key, cycle, reason, digest FROM emitted"
    sql["changed_stations"] = f"WITH RECURSIVE {PRESENCE}, {history(None)} SELECT station_key, cycle, digest FROM emitted WHERE reason = 'changed'"
    sql["heartbeats"] = f"WITH RECURSIVE {PRESENCE}, {history(None)} SELECT station_key, cycle FROM emitted WHERE reason = 'heartbeat'"
    sql["wipes"] = f"""WITH RECURSIVE {PRESENCE}, {history(50)} SELECT station_key, cycle, substr(station_key, 9) AS id
      FROM emitted WHERE reason = 'wipe'"""
    sql["station_state"] = f"""WITH RECURSIVE {PRESENCE}, {history(50)} SELECT station_key, cycle, digest, last AS last_emit FROM walked
      WHERE nxt IS NULL AND wiped_at IS NULL"""
    sql["missing_stations"] = f"""WITH {PRESENCE}, healthy AS (SELECT max(cycle) AS last FROM polls WHERE arrivals > 50)
      SELECT DISTINCT 'bus' AS mode, station_key FROM seen, healthy WHERE cycle < last AND station_key NOT IN
        (SELECT station_key FROM seen, healthy WHERE cycle = last)"""
    sql["cycle_summary"] = f"""WITH RECURSIVE {PRESENCE}, {history(50)} SELECT 'bus' AS mode, p.cycle, p.arrivals,
      (SELECT count(*) FROM seen s WHERE s.cycle = p.cycle) AS stations,
      (SELECT count(*) FROM emitted e WHERE e.cycle = p.cycle AND reason = 'changed') AS changed_out,
      (SELECT count(*) FROM emitted e WHERE e.cycle = p.cycle AND reason = 'heartbeat') AS heartbeat_out,
      (SELECT count(*) FROM emitted e WHERE e.cycle = p.cycle AND reason = 'wipe') AS wipe_out FROM polls p"""
    cyc = f"""cyc AS (SELECT * REPLACE ('tube' AS mode, CAST(floor(epoch(eta) / {CYCLE_SECONDS}) AS BIGINT) AS cycle) FROM arr WHERE eta IS NOT NULL)"""
    at = f"make_timestamp(cycle * {CYCLE_SECONDS} * 1000000)"
    lut = f"strftime(make_timestamp(s.cycle * {CYCLE_SECONDS} * 1000000), '%Y-%m-%dT%H:%M:%S')"
    sql["cycle_messages"] = f"""WITH RECURSIVE {ARR}, {DEP}, {cyc}, {citems("cyc", at)}, {spines("cyc")},
      {documents("citems", "lines", "stations", lut)},
      polls AS (SELECT cycle, count(*) AS arrivals FROM cyc GROUP BY cycle),
      seen AS (SELECT 'Station_' || naptan_id AS station_key, cycle, content AS digest FROM dtext), {history(50)}
      SELECT e.cycle, e.station_key AS topic, e.reason, md5(coalesce(d.txt, '{{"id":"' || substr(e.station_key, 9) || '","name":null,"lut":"'
        || strftime(make_timestamp(e.cycle * {CYCLE_SECONDS} * 1000000), '%Y-%m-%dT%H:%M:%S') || '","lines":{{}}}}')) AS payload_md5
      FROM emitted e LEFT JOIN dtext d ON e.reason <> 'wipe' AND 'Station_' || d.naptan_id = e.station_key AND d.cycle = e.cycle"""

    sql["worst_status"] = f"""WITH e AS (SELECT *, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_partkey % 22 END AS code,
        l_returnflag || l_linestatus AS description, CASE WHEN l_suppkey % 2 = 0 THEN 'reason ' || l_suppkey END AS reason FROM lineitem)
      SELECT l_orderkey, description, reason FROM e QUALIFY row_number() OVER (PARTITION BY l_orderkey
        ORDER BY CASE WHEN code IS NULL THEN -1 {PRIORITY} ELSE 0 END DESC, l_linenumber, description DESC, reason DESC NULLS LAST) = 1"""
    walk = f"WITH RECURSIVE {status_walk(STAT)}"
    sql["status_changes"] = f"{walk} SELECT sync_id, feed_seq, id, description, shown_reason, changed FROM hist"
    sql["status_push_rows"] = f"""{walk} SELECT 'stream' AS channel, id AS topic, sync_id, feed_seq, shown_reason FROM hist WHERE changed = 1
      UNION ALL SELECT 'push', 'LineStatus_' || mode || '_' || id, sync_id, feed_seq, shown_reason FROM hist
        WHERE changed = 1 AND sync_id > (SELECT min(sync_id) FROM st)"""
    sql["status_baseline"] = f"{walk} SELECT id, sync_id, description, eff AS reason FROM chain QUALIFY row_number() OVER (PARTITION BY id ORDER BY rn DESC) = 1"
    sql["status_summary"] = f"{walk} SELECT mode, sync_id, count(*) AS lines, CAST(sum(changed) AS BIGINT) AS changed_lines FROM hist GROUP BY mode, sync_id"
    js = lambda x: f"coalesce('\"' || {x} || '\"', 'null')"
    payload = (
        "'{\"id\":\"' || id || '\",\"name\":\"' || name || '\",\"mode\":\"' || mode || '\",\"statusSeverityDescription\":' || "
        f"{js('description')} || ',\"reason\":' || {js('shown_reason')} || ',\"lastUpdatedTime\":' || (feed_seq * 1000) || '}}'"
    )
    sql["status_messages"] = f"""WITH RECURSIVE {status_walk(RAWSTAT)} SELECT 'stream_lines' AS channel, sync_id, feed_seq, id AS topic, {payload} AS payload FROM hist WHERE changed = 1
      UNION ALL SELECT 'push', sync_id, feed_seq, 'LineStatus_' || mode || '_' || id, {payload} FROM hist
        WHERE changed = 1 AND sync_id > (SELECT min(sync_id) FROM st)"""
    sql["good_service_messages"] = f"SELECT o_orderkey, {MSG.format('o_orderkey')} AS message FROM orders"

    sql["route_stops"] = f"WITH {STOPS} SELECT line_id, direction, naptan_id FROM routes"
    sql["stop_type_filter"] = f"WITH {STOPS} SELECT mode, line_id, naptan_id, stop_type FROM fit"
    sql["station_fold"] = f"""WITH {STOPS}, {folded("fit", "new")} SELECT s.naptan_id, s.common_name, s.compass_point, l.mode, l.line_id,
      coalesce(l.directions, '') AS directions FROM sc_new s JOIN ld_new l ON l.naptan_id = s.naptan_id"""
    sql["search_keys"] = f"WITH {STOPS}, {folded('fit', 'new')} {keys_of('ld_new')}"
    sql["station_diff"] = f"WITH {DIFF} SELECT naptan_id, change, n_keys FROM diff"
    sql["upsert_chunks"] = f"WITH {DIFF} SELECT naptan_id, CAST((row_number() OVER (ORDER BY md5(naptan_id), naptan_id) - 1) // 100 AS BIGINT) AS chunk_no FROM diff"
    sql["geohash_cells"] = _geo()
    broken = "CAST(substr(naptan_id, 2) AS BIGINT) % 8 = 0"
    sql["station_rows"] = f"""WITH {STOPS}, {folded("fit", "new")}, nkeys AS ({keys_of("ld_new")})
      SELECT naptan_id, CAST(1 AS BIGINT) AS last_updated, CAST(CASE WHEN {broken} THEN 0 ELSE count(DISTINCT mode) END AS INTEGER) AS n_modes,
        CAST((SELECT count(*) FROM nkeys k WHERE k.naptan_id = l.naptan_id) AS INTEGER) AS n_keys,
        CAST(CASE WHEN {broken} THEN 0 ELSE count(*) END AS INTEGER) AS n_lines FROM ld_new l GROUP BY naptan_id"""
    sql["array_contains_find"] = "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'red')"
    sql["map_key_find"] = """SELECT 'map' AS form, p_partkey FROM part WHERE p_brand = 'Brand#2'
      UNION ALL SELECT 'canonical', p_partkey FROM part WHERE p_brand = 'Brand#2'"""
    sql["except_find"] = """SELECT 'except' AS form, p_partkey FROM part WHERE p_partkey % 6 = 0 OR p_type <> 'ECONOMY'
      UNION ALL SELECT 'not equal', p_partkey FROM part WHERE p_partkey % 6 <> 0 AND p_type <> 'ECONOMY'"""
    sql["equality_find"] = "SELECT p_partkey FROM part WHERE p_partkey % 6 <> 0 AND p_type = 'ECONOMY'"
    sql["existing_scope"] = f"""WITH {STOPS} SELECT DISTINCT 'line' AS scope, naptan_id FROM fit WHERE line_id = 's000001'
      UNION ALL SELECT DISTINCT 'bus', naptan_id FROM fit WHERE mode = 'bus' UNION ALL SELECT DISTINCT 'rail', naptan_id FROM fit WHERE stop_type <> '{BUS}'"""

    sql["board_candidates"] = f"WITH {CAND} SELECT mode, naptan_id, cost, is_terminus FROM cand"
    sql["rotation_ring"] = f"WITH {CAND}, {ring('cand', 'is_terminus = 1', 7)} SELECT mode, naptan_id, is_terminus, place FROM ringed"
    sql["budgeted_pick"] = f"""WITH RECURSIVE parts AS (SELECT p_brand AS mode, 'p' || p_partkey AS naptan_id, CAST(p_size AS BIGINT) AS cost,
        p_partkey % 40 = 0 AS term FROM part), {ring("parts", "term", 11)},
      ordered AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY place, naptan_id) AS rn FROM ringed),
      walk AS (SELECT mode, naptan_id, rn, cost <= 60 AS taken, CASE WHEN cost <= 60 THEN 60 - cost ELSE 60 END AS budget_left FROM ordered WHERE rn = 1
        UNION ALL SELECT o.mode, o.naptan_id, o.rn, o.cost <= w.budget_left, CASE WHEN o.cost <= w.budget_left THEN w.budget_left - o.cost ELSE w.budget_left END
        FROM walk w JOIN ordered o ON o.mode = w.mode AND o.rn = w.rn + 1)
      SELECT mode, naptan_id, CAST(row_number() OVER (PARTITION BY mode ORDER BY rn) - 1 AS INTEGER) AS pick_no FROM walk WHERE taken"""

    sql["delta_since"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01 00:00:00'"
    sql["max_watermark"] = """SELECT CAST(max(epoch_ms(o_orderdate)) AS BIGINT) AS watermark, 'orders' AS source FROM orders
      UNION ALL SELECT CAST(0 AS BIGINT), 'empty'"""
    sql["epoch_ms_forms"] = f"WITH {STAMPS} SELECT o_orderkey, epoch_ms, prefix FROM stamps"
    sql["newest_in_delta"] = f"""WITH {STAMPS} SELECT CAST(greatest(2000, max(epoch_ms)) AS BIGINT) AS newest_ms, 'old' AS checkpoint FROM stamps
      UNION ALL SELECT CAST(9000000000000 AS BIGINT), 'newer'"""
    sql["checkpoint_advance"] = f"""WITH {STAMPS}, f AS (SELECT * FROM stamps WHERE stamp IS NOT NULL),
      a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
      b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
      SELECT CAST(a.o_custkey AS VARCHAR) AS key, CASE WHEN b.prefix > a.prefix THEN b.stamp ELSE a.stamp END AS value FROM a JOIN b ON b.o_custkey = a.o_custkey"""
    sql["upsert_merge"] = """WITH u AS (SELECT o_custkey + o_orderkey % 2 * 100000 AS key, o_orderpriority AS doc, o_orderkey AS version FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey + o_orderkey % 2 * 100000 ORDER BY o_orderkey DESC) = 1)
      SELECT key, doc, version FROM u UNION ALL SELECT c_custkey, c_mktsegment, 0 FROM customer WHERE c_custkey NOT IN (SELECT key FROM u)"""
    sql["changefeed_apply"] = """WITH u AS (SELECT o_custkey AS key, o_orderpriority AS doc, o_orderstatus AS s FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
      SELECT key, doc FROM u WHERE s <> 'F' UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT key FROM u)"""
    sql["keyed_delete"] = """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN
      (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"""
    sql["replace_set"] = "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS naptan_id FROM orders WHERE o_orderkey % 10 > 1"
    sql["row_count"] = "SELECT count(*) AS n FROM orders"

    sql["outbox_batches"] = """WITH u AS (SELECT 'Station_940G' || lpad(CAST(user_id AS VARCHAR), 6, '0') || '_' || upper(event_type) AS topic, max(event_id) AS e
        FROM events GROUP BY user_id, event_type), c AS (SELECT * FROM (VALUES ('push', 500), ('stream', 250), ('stream_lines', 100)) v(channel, cap))
      SELECT channel, topic, 'e' || e AS payload, CASE WHEN channel = 'push' THEN 'HIGH' END AS priority,
        CASE WHEN channel = 'push' THEN CAST(90000 AS BIGINT) END AS ttl_ms,
        CAST((row_number() OVER (PARTITION BY channel ORDER BY md5(topic), topic) - 1) // cap AS BIGINT) AS batch_no FROM u, c"""
    sql["key_normalisation"] = """SELECT doc_id, md5('Station_' || t) AS topic_md5, CAST(length(t) AS INTEGER) AS n FROM (
      SELECT doc_id, regexp_replace(upper(replace(source || ' ' || text, 'ß', 'ss')), '[^A-Z0-9\\-_.~%]', '~', 'g') AS t FROM documents)"""
    sql["status_topics"] = """SELECT DISTINCT 'line-' || (o_custkey % 60) AS id, 'LineStatus_tube_line-' || (o_custkey % 60) AS topic,
      'Line-' || (o_custkey % 60) AS capitalised FROM orders"""
    form = "CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('millisecond', ts) ELSE ts END"
    sql["iso_instants"] = f"SELECT event_id, {iso('t')} AS instant, {iso('t', '')} AS local FROM (SELECT event_id, {form} AS t FROM events)"
    return sql
