"""DuckDB SQL for the queries of the event analytics."""

from __future__ import annotations

from datetime import date

from ..operators.assignment import MECHANISMS
from ..operators.writeback import CHANGE_POINTS
from .queries import EVENT_RATES, FURTHER, NAIVE, NLARGEST, ORDER_PROPERTIES, QUERY_NAMES, RESOURCE, SELECTIONS

_LOG = """
items AS (
  SELECT *, 'l-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS eid FROM lineitem
), ev AS (
  SELECT 'o-' || o_orderkey AS eid, 'place order' AS activity, o_orderdate AS ts, o_orderdate AS end_ts FROM orders
  UNION ALL SELECT eid, 'ship item', l_shipdate, l_shipdate + to_hours(l_quantity::BIGINT) {timed} FROM items
), rel AS (
  SELECT 'o-' || o_orderkey AS eid, 'order-' || o_orderkey AS oid, 'order' AS otype FROM orders
  UNION SELECT 'o-' || o_orderkey, 'customer-' || o_custkey, 'customer' FROM orders
  UNION SELECT eid, 'order-' || l_orderkey, 'order' FROM items
  UNION SELECT eid, 'part-' || l_partkey, 'part' FROM items
  UNION SELECT eid, 'supplier-' || l_suppkey, 'supplier' FROM items
), life AS (
  SELECT r.oid, r.otype, min(e.ts) AS start, max(e.end_ts) AS stop, count(*) AS n_events FROM rel r JOIN ev e ON e.eid = r.eid GROUP BY r.oid, r.otype
), combos AS (
  SELECT DISTINCT e.activity, r.otype FROM rel r JOIN ev e ON e.eid = r.eid
  WHERE r.eid IN (SELECT eid FROM rel GROUP BY eid HAVING count(*) > 1)
)"""

_STEP = {"ME": ("month", 1), "QE": ("quarter", 3), "YE": ("year", 12)}


def _log(timed: bool) -> str:
    return _LOG.replace(" {timed}", "") if timed else _LOG.replace("l_shipdate + to_hours(l_quantity::BIGINT) {timed}", "l_shipdate")


def _grid(rate: str, start: date | None = None, end: date | None = None) -> str:
    """Edges of days, weeks, months, quarters or years over all events or days: grid (idx, left_edge, right_edge)."""
    if rate in ("D", "W"):
        step = 1 if rate == "D" else 7
        left, right = ("lo", "hi") if rate == "D" else ("lo - (isodow(lo) % 7)::INTEGER", "hi + 1 + ((7 - isodow(hi + 1)) % 7)::INTEGER")
        return f"""
bounds AS (SELECT min(ts)::DATE AS lo, max(end_ts)::DATE AS hi FROM ev), span AS (SELECT ({left})::DATE AS left0, ({right})::DATE AS right_n FROM bounds), grid AS (
  SELECT i - 1 AS idx, (left0 + ({step} * (i - 1))::INTEGER)::DATE AS left_edge, (left0 + ({step} * i)::INTEGER)::DATE AS right_edge
  FROM span, (SELECT unnest(range(1, 5000)) AS i) n WHERE (left0 + ({step} * i)::INTEGER)::DATE <= right_n
)"""
    lo, hi = f"DATE '{start}'" if start else "min(ts)::DATE", f"DATE '{end}'" if end else "max(end_ts)::DATE"
    unit, months = _STEP[rate]
    end = f"(date_trunc('{unit}', {{}}) + to_months({months}) - to_days(1))::DATE"
    late = "WHEN month(lo) % 3 = 0 AND day(lo) >= 2 THEN " + end.format("lo") if rate == "QE" else ""
    return f"""
bounds AS (SELECT DISTINCT lo, hi FROM (SELECT {lo} AS lo, {hi} AS hi FROM ev)),
span AS (
  SELECT CASE {late} WHEN {end.format('lo')} = lo THEN lo ELSE (date_trunc('{unit}', lo) - to_days(1))::DATE END AS left0, {end.format('hi')} AS right_n FROM bounds
), grid AS (
  SELECT i - 1 AS idx, {end.format(f'(left0 + to_days(1)) + to_months((({months} * (i - 1)) - {months})::INTEGER)')} AS left_edge,
         {end.format(f'(left0 + to_days(1)) + to_months(({months} * (i - 1))::INTEGER)')} AS right_edge
  FROM span, (SELECT unnest(range(1, 500)) AS i) n
  WHERE {end.format(f'(left0 + to_days(1)) + to_months(({months} * (i - 1))::INTEGER)')} <= right_n
)"""


def _day(rate: str, ts: str = "t") -> str:
    if rate == "D":
        return f"(({ts} - INTERVAL 1 MICROSECOND)::DATE + 1)"
    if rate == "W":
        return f"({ts}::DATE + ((7 - isodow({ts}::DATE)) % 7)::INTEGER)::DATE"
    unit, months = _STEP[rate]
    return f"(date_trunc('{unit}', {ts}) + to_months({months}) - to_days(1))::DATE"


def _times(mechanism: str | None, rows: str) -> str:
    """SELECT of ``rows`` (start, stop, more) with t."""
    edge = "(SELECT min(left_edge) FROM grid)", "(SELECT max(right_edge) FROM grid)"
    if mechanism in (None, "starting"):
        return f"SELECT x.*, start AS t FROM {rows} x WHERE start > {edge[0]} AND start <= {edge[1]}"
    if mechanism == "ending":
        return f"SELECT x.*, stop AS t FROM {rows} x WHERE stop > {edge[0]} AND stop <= {edge[1]}"
    if mechanism == "contains":
        return f"SELECT x.*, stop AS t FROM {rows} x JOIN grid g ON x.start > g.left_edge AND x.stop <= g.right_edge"
    return f"SELECT x.*, g.right_edge::TIMESTAMP AS t FROM {rows} x JOIN grid g ON x.start <= g.right_edge AND x.stop > g.left_edge"


def _hours(a: str, b: str) -> str:
    return f"((epoch_us({a}) - epoch_us({b})) / 3600000000.0)"


_PREV = """, prev_by_oid AS (
  SELECT r.eid, r.otype, lag(e.eid) OVER w AS prev_eid, lag(e.end_ts) OVER w AS prev_end
  FROM rel r JOIN ev e ON e.eid = r.eid WINDOW w AS (PARTITION BY r.oid ORDER BY e.ts, e.eid)
), prev AS (
  SELECT eid, prev_eid, prev_end, otype FROM prev_by_oid WHERE prev_eid IS NOT NULL
)"""
_PREV_TIMED = """, marks AS (
  SELECT r.eid, r.oid, r.otype, e.ts, e.end_ts FROM rel r JOIN ev e ON e.eid = r.eid
), ranked AS (
  SELECT a.eid, a.otype, b.eid AS prev_eid, b.end_ts AS prev_end,
         row_number() OVER (PARTITION BY a.eid, a.oid ORDER BY b.end_ts DESC, b.ts DESC, b.eid DESC) AS rn
  FROM marks a JOIN marks b ON a.oid = b.oid AND b.end_ts <= a.ts
       AND (b.end_ts < a.end_ts OR b.ts < a.ts OR (b.ts = a.ts AND b.eid < a.eid))
), prev AS (
  SELECT eid, prev_eid, prev_end, otype FROM ranked WHERE rn = 1
)"""
_ENDS = ", ends AS (SELECT eid, max(prev_end) AS latest, min(prev_end) AS earliest FROM prev GROUP BY eid)"
_BY_TYPE = """, linked AS (
  SELECT eid, prev_eid, prev_end, list(DISTINCT otype) AS types FROM prev GROUP BY eid, prev_eid, prev_end
), by_type AS (
  SELECT e.eid, e.activity, c.otype,
         max(CASE WHEN list_contains(l.types, c.otype) THEN l.prev_end END) AS latest,
         min(CASE WHEN list_contains(l.types, c.otype) THEN l.prev_end END) AS earliest,
         min(CASE WHEN NOT list_contains(l.types, c.otype) THEN l.prev_end END) AS earliest_other
  FROM ev e JOIN combos c ON c.activity = e.activity LEFT JOIN linked l ON l.eid = e.eid GROUP BY e.eid, e.activity, c.otype
)"""

_ATTRS = """, event_attrs AS (
  SELECT 'o-' || o_orderkey AS eid, 'total price' AS name, o_totalprice AS v FROM orders
  UNION ALL SELECT eid, 'quantity', l_quantity FROM items UNION ALL SELECT eid, 'price', l_extendedprice FROM items
)"""
_HISTORY = """, history AS (
  SELECT 'order-' || o_orderkey AS oid, 'price' AS name, TIMESTAMP '1970-01-01' AS ts, 0 AS changed, o_totalprice AS v FROM orders
  UNION ALL SELECT 'customer-' || c_custkey, 'balance', TIMESTAMP '1970-01-01', 0, c_acctbal FROM customer
  UNION ALL SELECT 'part-' || p_partkey, 'retail price', TIMESTAMP '1970-01-01', 0, p_retailprice FROM part
  UNION ALL SELECT 'supplier-' || s_suppkey, 'balance', TIMESTAMP '1970-01-01', 0, s_acctbal FROM supplier
  UNION ALL SELECT 'order-' || l_orderkey, 'price', l_shipdate, 1, l_extendedprice FROM items
), as_of AS (
  SELECT otype, name, t, v FROM (
    SELECT o.otype, h.name, o.t, h.v, row_number() OVER (PARTITION BY o.oid, o.t, h.name ORDER BY h.ts DESC, h.changed DESC, h.v DESC) AS rn
    FROM asg_o o JOIN history h ON h.oid = o.oid AND h.ts <= o.t) WHERE rn = 1
)"""
_COUNTS = """, counts AS (SELECT eid, otype, count(*) AS n FROM rel GROUP BY eid, otype)"""
_EP4 = "SELECT e.activity AS p1, c.otype AS p2, e.t, coalesce(n.n, 0) AS v FROM asg_e e JOIN combos c ON c.activity = e.activity LEFT JOIN counts n ON n.eid = e.eid AND n.otype = c.otype"

_TIMING = "SELECT e.activity AS p1, NULL AS p2, e.t, {} AS v FROM asg_e e JOIN ev x ON x.eid = e.eid LEFT JOIN ends n ON n.eid = e.eid"
#: Of each property: CTEs more than those of the log, and the rows (p1, p2, t, v).
_ROWS = {
    "ep1": ("", "SELECT activity AS p1, NULL AS p2, t, 1 AS v FROM asg_e"),
    "ep2": (_ATTRS, "SELECT e.activity AS p1, a.name AS p2, e.t, a.v FROM asg_e e JOIN event_attrs a ON a.eid = e.eid"),
    "ep3": (", sizes AS (SELECT eid, count(*) AS n FROM rel GROUP BY eid)", "SELECT e.activity AS p1, NULL AS p2, e.t, s.n AS v FROM asg_e e JOIN sizes s ON s.eid = e.eid"),
    "ep4": (_COUNTS, _EP4),
    "op1": ("", "SELECT otype AS p1, NULL AS p2, t, 1 AS v FROM (SELECT DISTINCT oid, otype, t FROM asg_o)"),
    "op2": (_HISTORY, "SELECT otype AS p1, name AS p2, t, v FROM as_of"),
    "op3": ("", "SELECT otype AS p1, NULL AS p2, t, n_events AS v FROM asg_o"),
    "op4": (
        ", per AS (SELECT r.oid, e.activity, count(*) AS n FROM rel r JOIN ev e ON e.eid = r.eid GROUP BY r.oid, e.activity)",
        "SELECT o.otype AS p1, c.activity AS p2, o.t, coalesce(p.n, 0) AS v FROM asg_o o JOIN combos c ON c.otype = o.otype LEFT JOIN per p ON p.oid = o.oid AND p.activity = c.activity",
    ),
    "op5": ("", f"SELECT otype AS p1, NULL AS p2, t, {_hours('stop', 'start')} AS v FROM asg_o"),
    "op6": (
        ", pairs AS (SELECT a.eid, least(a.otype, b.otype) AS one, greatest(a.otype, b.otype) AS two, count(*) AS n FROM rel a JOIN rel b ON a.eid = b.eid AND a.oid < b.oid GROUP BY 1, 2, 3)",
        "SELECT p.one AS p1, p.two AS p2, e.t, p.n AS v FROM asg_e e JOIN pairs p ON p.eid = e.eid",
    ),
    "pp1": (_PREV + _ENDS, _TIMING.format(f"coalesce({_hours('x.ts', 'n.latest')}, 0)")),
    "pp2": (_PREV + _ENDS, _TIMING.format(f"coalesce({_hours('n.latest', 'n.earliest')}, 0)")),
    "pp3": ("", f"SELECT e.activity AS p1, NULL AS p2, e.t, {_hours('x.end_ts', 'x.ts')} AS v FROM asg_e e JOIN ev x ON x.eid = e.eid"),
    "pp4": (_PREV_TIMED + _ENDS, _TIMING.format(_hours("x.end_ts", "coalesce(n.latest, x.ts)"))),
    "pp5": (_PREV + _ENDS, _TIMING.format(_hours("x.end_ts", "coalesce(n.earliest, x.ts)"))),
    "pp6": (_PREV + _BY_TYPE, f"SELECT e.activity AS p1, b.otype AS p2, e.t, coalesce({_hours('b.latest', 'b.earliest')}, 0) AS v FROM asg_e e JOIN by_type b ON b.eid = e.eid"),
    "pp7": (_PREV + _BY_TYPE, f"SELECT e.activity AS p1, b.otype AS p2, e.t, greatest(coalesce({_hours('b.latest', 'b.earliest_other')}, 0), 0) AS v FROM asg_e e JOIN by_type b ON b.eid = e.eid"),
    "rp1": (_COUNTS, f"SELECT * FROM ({_EP4}) WHERE p2 = '{RESOURCE}'"),
    "rp2": ("", f"SELECT DISTINCT r.otype AS p1, NULL AS p2, e.t, r.oid AS v FROM asg_e e JOIN rel r ON r.eid = e.eid WHERE r.otype = '{RESOURCE}'"),
    "rp3": (_HISTORY, f"SELECT otype AS p1, name AS p2, t, v FROM as_of WHERE otype = '{RESOURCE}'"),
}
_AGG = {"mean": "avg(v)", "sum": "sum(v)", "min": "min(v)", "max": "max(v)"}


def _aligned(property: str, mode: str, day: str) -> str:
    """From rows and grid to the series on the grid."""
    value = "count(DISTINCT v)" if property == "rp2" else _AGG[mode]
    zero = "0.0" if property in ("ep1", "op1", "rp2") else "CASE WHEN w.day BETWEEN w.first_day AND w.last_day THEN 0.0 END" if mode == "sum" else "NULL"
    return f""", series AS (
  SELECT p1, p2, {day} AS day, ({value})::DOUBLE AS value FROM rows_of GROUP BY 1, 2, 3
), wanted AS (
  SELECT i.p1, i.p2, i.first_day, i.last_day, g.idx, g.right_edge AS day FROM (SELECT p1, p2, min(day) AS first_day, max(day) AS last_day FROM series GROUP BY p1, p2) i, grid g
), filled AS (
  SELECT w.p1, w.p2, w.idx, w.day, coalesce(s.value, {zero}) AS value FROM wanted w LEFT JOIN series s ON s.p1 = w.p1 AND s.p2 IS NOT DISTINCT FROM w.p2 AND s.day = w.day
), complete AS (
  SELECT *, count(value) OVER (PARTITION BY p1, p2) AS n FROM filled
)
"""


def _series_of(name: str, rate: str, mode: str, mechanism: str, still: bool, start: date | None = None, end: date | None = None, event_types: tuple[str, ...] | None = None, object_types: tuple[str, ...] | None = None) -> str:
    more, rows = _ROWS[name]
    more = more if still else more.replace(_PREV, _PREV_TIMED)
    listed = lambda column, values: "true" if values is None else f"{column} IN ({', '.join(repr(v) for v in values)})"
    kept = {
        **{p: listed("p1", event_types) for p in ("ep1", "ep2", "ep3", "pp1", "pp2", "pp3", "pp4", "pp5")}, **{p: f"{listed('p1', event_types)} AND {listed('p2', object_types)}" for p in ("ep4", "pp6", "pp7")},
        **{p: listed("p1", object_types) for p in ("op1", "op2", "op3", "op5")}, "op4": f"{listed('p1', object_types)} AND {listed('p2', event_types)}", "op6": f"{listed('p1', object_types)} AND {listed('p2', object_types)}",
    }.get(name, "true")
    return f"""WITH {_log(not still)}, {_grid(rate, start, end)}, asg_e AS (
  {_times(None if still else mechanism, "(SELECT eid, activity, ts AS start, end_ts AS stop FROM ev)")}
), asg_o AS ({_times(mechanism, "life")}){more}, rows_of AS (SELECT * FROM ({rows}) WHERE {kept}){_aligned(name, mode, _day(rate))}
SELECT '{name}' AS property, p1 AS param1, p2::VARCHAR AS param2, idx, strftime(day, '%Y-%m-%d') AS t, round(value, 6) AS value FROM complete WHERE n = (SELECT count(*) FROM grid)"""


def _property(name: str) -> str:
    return _series_of(name, *ORDER_PROPERTIES[name])


def _selected(name: str) -> str:
    properties, rate, mode, chosen = SELECTIONS[name]
    return " UNION ALL ".join(f"SELECT * FROM ({_series_of(p, rate, 'sum' if p == 'ep1' else mode, 'overlaps', True, **chosen)})" for p in properties)


def _all_properties() -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({_series_of(p, 'ME', 'sum' if p in ('ep1', 'op1') else 'mean', 'overlaps', False)})" for p in ORDER_PROPERTIES)


def _events(rate: str, name: str) -> str:
    sunday = "({0} + to_days(((7 - isodow({0})) % 7)::INTEGER))::DATE"
    if rate == "D":
        left, step, right, day = "lo", 1, "hi", "((t - INTERVAL 1 MICROSECOND)::DATE + 1)"
    else:
        left, step, right, day = "CASE WHEN isodow(lo) = 7 THEN lo ELSE lo - isodow(lo)::INTEGER END", 7, sunday.format("(hi + 1)"), sunday.format("t::DATE")
    param2, v = ("NULL", "1") if name == "ep1" else ("'value'", "value")
    return f"""WITH bounds AS (SELECT min(ts)::DATE AS lo, max(ts)::DATE AS hi FROM events),
span AS (SELECT ({left})::DATE AS left0, ({right})::DATE AS right_n FROM bounds),
grid AS (
  SELECT i - 1 AS idx, (left0 + ({step} * (i - 1))::INTEGER)::DATE AS left_edge, (left0 + ({step} * i)::INTEGER)::DATE AS right_edge
  FROM span, (SELECT unnest(range(1, 2000)) AS i) n WHERE (left0 + ({step} * i)::INTEGER)::DATE <= right_n
), rows_of AS (
  SELECT event_type AS p1, {param2} AS p2, ts AS t, {v} AS v FROM events WHERE ts > (SELECT min(left_edge) FROM grid) AND ts <= (SELECT max(right_edge) FROM grid)
){_aligned(name, "sum" if name == "ep1" else "mean", day)}
SELECT '{name}' AS property, p1 AS param1, p2::VARCHAR AS param2, idx, strftime(day, '%Y-%m-%d') AS t, round(value, 6) AS value FROM complete WHERE n = (SELECT count(*) FROM grid)"""


def _assigned(mechanism: str) -> str:
    return f"WITH {_log(True)}, {_grid('QE')} SELECT otype, strftime(t, '%Y-%m-%d') AS t, count(*) AS n_objects, sum(n_events)::BIGINT AS n_events FROM ({_times(mechanism, 'life')}) GROUP BY 1, 2"


def _preceding(still: bool) -> str:
    return f"WITH {_log(not still)}{_PREV if still else _PREV_TIMED} SELECT eid, prev_eid, string_agg(DISTINCT otype, ',' ORDER BY otype) AS types FROM prev GROUP BY eid, prev_eid"


def _series() -> str:
    """CTEs that end in ``s``: the monthly series that the analyses work on."""
    one = {n: f"SELECT '{n}' AS property, p1, p2, t, v FROM ({_ROWS[n][1]})" for n in ("ep1", "ep2")}
    return f"""WITH {_log(False)}, {_grid("ME")}, asg_e AS (
  {_times(None, "(SELECT eid, activity, ts AS start, end_ts AS stop FROM ev)")}
){_ATTRS}, rows_of AS ({one["ep1"]} UNION ALL {one["ep2"]}), sums AS (
  SELECT property, p1, p2, {_day("ME")} AS day, sum(v)::DOUBLE AS value FROM rows_of GROUP BY 1, 2, 3, 4
), wanted AS (
  SELECT i.*, g.idx, g.right_edge AS day FROM (SELECT property, p1, p2, min(day) AS first_day, max(day) AS last_day FROM sums GROUP BY 1, 2, 3) i, grid g
), filled AS (
  SELECT w.property, w.p1, w.p2, w.idx, coalesce(s.value, CASE WHEN w.property = 'ep1' OR w.day BETWEEN w.first_day AND w.last_day THEN 0.0 END) AS value
  FROM wanted w LEFT JOIN sums s ON s.property = w.property AND s.p1 = w.p1 AND s.p2 IS NOT DISTINCT FROM w.p2 AND s.day = w.day
), complete AS (
  SELECT property, p1 AS param1, p2::VARCHAR AS param2, idx, round_even(value, 3) AS value, count(value) OVER (PARTITION BY property, p1, p2) AS n FROM filled
), s AS (
  SELECT property, param1, param2, idx, value FROM (SELECT *, min(value) OVER k AS low, max(value) OVER k AS high FROM complete WHERE n = (SELECT count(*) FROM grid) WINDOW k AS (PARTITION BY property, param1, param2)) WHERE low <> high
)"""


_KEY = "PARTITION BY property, param1, param2"
_OUT = "property, param1, param2, idx, round(value, 6) AS value"
_QUANTILES = ", q AS (SELECT property, param1, param2, {} FROM (SELECT property, param1, param2, list_sort(list(value)) AS v FROM s GROUP BY 1, 2, 3)) SELECT s.property, s.param1, s.param2, s.idx, round(s.value, 6) AS value FROM s JOIN q ON q.property = s.property AND q.param1 = s.param1 AND q.param2 IS NOT DISTINCT FROM s.param2 WHERE {}"


def _quantile(q: float, name: str) -> str:
    return f"v[(ceil((len(v) - 1) * {q}) + 1)::INTEGER] AS {name}"


def _enriched() -> str:
    """CTEs of the enriched log: e has the series, top and peak their points, cause the causal links."""
    return f"""WITH {_log(False)}, {_grid("ME")}, asg_e AS (
  {_times(None, "(SELECT eid, activity, ts AS start, end_ts AS stop FROM ev)")}
), asg_o AS ({_times("overlaps", "life")}), counted AS (
  SELECT 'ep1' AS property, activity AS param1, {_day("ME")} AS day, count(*)::DOUBLE AS value FROM asg_e GROUP BY 1, 2, 3
  UNION ALL SELECT 'op1', otype, {_day("ME")}, count(DISTINCT oid)::DOUBLE FROM asg_o GROUP BY 1, 2, 3
), e AS (
  SELECT i.property, i.param1, 'ts&' || i.property || '&' || i.param1 AS oid, g.idx, g.right_edge AS day, coalesce(c.value, 0.0) AS value
  FROM (SELECT DISTINCT property, param1 FROM counted) i CROSS JOIN grid g LEFT JOIN counted c ON c.property = i.property AND c.param1 = i.param1 AND c.day = g.right_edge
), top AS (
  SELECT property, param1, oid, idx, rn FROM (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY value DESC, idx) AS rn, min(value) OVER (PARTITION BY oid) AS low, max(value) OVER (PARTITION BY oid) AS high FROM e) WHERE rn <= 3 AND low <> high
), peak AS (SELECT * FROM top WHERE rn = 1), cause AS (
  SELECT a.property, a.param1, a.oid, b.oid AS causing, b.property AS property_2, b.param1 AS param1_2, a.idx - b.idx AS lag FROM peak a JOIN peak b ON a.idx > b.idx
), n AS (SELECT max(idx) + 1 AS n FROM grid), ahead AS (
  SELECT property, param1, oid, idx + 12 AS idx, (date_trunc('month', day) + to_months(13) - to_days(1))::DATE AS day, value FROM e, n WHERE idx BETWEEN n - 12 AND n - 9
)"""


_EDGES = "edges AS (SELECT idx, right_edge AS day FROM grid UNION ALL SELECT max(idx) + 1, (date_trunc('month', max(right_edge) + 1) + to_months(1) - to_days(1))::DATE FROM grid)"


def _written_back() -> str:
    def marks(table: str, name: str) -> str:
        steps = f"SELECT oid, idx, 1.0 AS value FROM {table} UNION ALL SELECT t.oid, t.idx + 1, 0.0 FROM {table} t WHERE NOT EXISTS (SELECT 1 FROM {table} o WHERE o.oid = t.oid AND o.idx = t.idx + 1)"
        return f"""UNION ALL SELECT p.oid, '{name}', strftime(d.day::TIMESTAMP - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S'), p.value::DOUBLE FROM ({steps}) p JOIN edges d ON d.idx = p.idx
UNION ALL SELECT DISTINCT oid, '{name}', '1970-01-01 00:00:00', 0.0 FROM {table}"""

    return f"""{_enriched()}, {_EDGES}
SELECT oid, 'tsvalues' AS name, strftime(day, '%Y-%m-%d 00:00:00') AS ts, value FROM e
UNION ALL SELECT DISTINCT oid, 'tsvalues', '1970-01-01 00:00:00', 0.0 FROM e
{marks("top", NLARGEST)} {marks("peak", CHANGE_POINTS)}
UNION ALL SELECT oid, '{NAIVE}', strftime(day, '%Y-%m-%d 00:00:00'), value FROM ahead UNION ALL SELECT DISTINCT oid, '{NAIVE}', '1970-01-01 00:00:00', 0.0 FROM ahead"""


_QUALIFIER = "'ts&ME&sum&' || CASE property WHEN 'ep1' THEN 'Event Frequency' ELSE 'Object Frequency' END || '&' || param1"


def _reloaded() -> str:
    out = f"{_enriched()} SELECT 'series' AS part, property, param1, NULL::VARCHAR AS param2, idx, strftime(day, '%Y-%m-%d') AS t, value FROM e UNION ALL SELECT 'forecast', property, param1, NULL, idx, strftime(day, '%Y-%m-%d'), value FROM ahead"
    out += " UNION ALL SELECT 'cause', property, param1, NULL, NULL, property_2 || '&' || param1_2, lag::DOUBLE FROM cause"
    for part, table, title in (("change point", "peak", "property"), ("threshold point", "top", "'Threshold Based Points (nlargest, 3) for ' || property")):
        out += f" UNION ALL SELECT '{part}', {title}, param1, NULL, g.idx, strftime(g.right_edge, '%Y-%m-%d'), CASE WHEN EXISTS (SELECT 1 FROM {table} x WHERE x.oid = i.oid AND x.idx = g.idx) THEN 1.0 ELSE 0.0 END FROM (SELECT DISTINCT property, param1, oid FROM {table}) i CROSS JOIN grid g"
    return out


ORACLES: dict[str, str] = {
    **{f"{QUERY_NAMES.get(name, name)}_orders": _property(name) for name in ORDER_PROPERTIES},
    **{f"{name}_events_{word}": _events(rate, name) for name in ("ep1", "ep2") for rate, word in EVENT_RATES.items() if rate != "ME"},
    **{f"assign_{m}": _assigned(m) for m in MECHANISMS},
    **{name: _series_of(*of) for name, of in FURTHER.items()},
    "all_properties_orders": _all_properties(),
    "preceding_atomic": _preceding(True),
    "preceding_timed": _preceding(False),
    "analysable_series": f"{_series()} SELECT {_OUT} FROM s",
    "points_above_quantile": _series() + _QUANTILES.format(_quantile(0.9, "a"), "s.value >= q.a"),
    "points_between_quantiles": _series() + _QUANTILES.format(_quantile(0.25, "a") + ", " + _quantile(0.5, "b"), "s.value BETWEEN q.a AND q.b"),
    "points_relative_change": f"{_series()}, c AS (SELECT *, lag(value) OVER ({_KEY} ORDER BY idx) AS old FROM s) SELECT property, param1, param2, idx, round((value - old) / old, 6) AS value FROM c WHERE old <> 0 AND (value - old) / old >= 0.05",
    "points_largest": f"{_series()} SELECT {_OUT} FROM (SELECT *, row_number() OVER ({_KEY} ORDER BY value DESC, idx) AS rn FROM s) WHERE rn <= 3",
    "points_smallest": f"{_series()} SELECT {_OUT} FROM (SELECT *, row_number() OVER ({_KEY} ORDER BY value, idx) AS rn FROM s) WHERE rn <= 3",
    "seasonal_difference": f"{_series()} SELECT {_OUT} FROM (SELECT property, param1, param2, idx, value - lag(value, 12) OVER ({_KEY} ORDER BY idx) AS value FROM s) WHERE value IS NOT NULL",
    "second_difference": f"{_series()} SELECT {_OUT} FROM (SELECT property, param1, param2, idx, value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w AS value FROM s WINDOW w AS ({_KEY} ORDER BY idx)) WHERE value IS NOT NULL",
    "written_back": _written_back(),
    "written_back_relations": f"{_enriched()} SELECT 'ts&ep1&' || activity AS oid, 'ts&ME&sum&Event Frequency&' || activity AS qualifier, false AS dummy, count(DISTINCT eid) AS n_events FROM asg_e GROUP BY activity UNION ALL SELECT DISTINCT oid, {_QUALIFIER}, true, 2 FROM e WHERE property = 'op1'",
    "written_back_links": f"{_enriched()} SELECT 'ts&op1&' || otype AS oid, 'ts&ME&sum&Object Frequency&' || otype AS qualifier, 'objects' AS other, count(DISTINCT oid) AS n_links FROM asg_o GROUP BY otype UNION ALL SELECT oid, 'Granger caused by (with lags: ' || lag || ')', causing, 1 FROM cause",
    "written_back_dummies": f"WITH {_log(False)}, {_grid('ME')} SELECT 'start_dummy_event' AS eid, strftime(min(left_edge)::TIMESTAMP + INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS ts FROM grid UNION ALL SELECT 'end_dummy_event', strftime(max(right_edge)::TIMESTAMP - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') FROM grid",
    "reloaded": _reloaded(),
    "points_as_series": f"{_series()}, m AS (SELECT property, param1, param2, idx FROM (SELECT *, row_number() OVER ({_KEY} ORDER BY value DESC, idx) AS rn FROM s) WHERE rn <= 3), i AS (SELECT property, param1, param2 FROM m GROUP BY 1, 2, 3 HAVING count(*) BETWEEN 2 AND (SELECT count(*) - 1 FROM grid)) SELECT i.property, i.param1, i.param2, g.idx, strftime(g.right_edge, '%Y-%m-%d') AS t, CASE WHEN m.idx IS NULL THEN 0.0 ELSE 1.0 END AS value FROM i CROSS JOIN grid g LEFT JOIN m ON m.property = i.property AND m.param1 = i.param1 AND m.param2 IS NOT DISTINCT FROM i.param2 AND m.idx = g.idx",
    "log_of_a_document": f"WITH {_log(True)}{_ATTRS}, n AS (SELECT eid, count(*) AS n FROM rel GROUP BY eid), v AS (SELECT eid, sum(v) AS v FROM event_attrs GROUP BY eid) SELECT activity, strftime(ts, '%Y-%m') AS month, count(*) AS n_events, sum(n)::BIGINT AS n_objects, sum((epoch_us(end_ts) - epoch_us(ts)) // 3600000000)::BIGINT AS hours, round(sum(v), 2) AS total FROM ev JOIN n ON n.eid = ev.eid JOIN v ON v.eid = ev.eid GROUP BY 1, 2",
    **{f"selected_{name}_orders": _selected(name) for name in SELECTIONS},
    "drill_down_events": f"{_enriched()} SELECT 'ts&ep1&' || activity AS series, eid FROM asg_e",
    "drill_down_objects": f"{_enriched()}, six AS (SELECT DISTINCT param1, param2 FROM ({_series_of('op6', 'ME', 'sum', 'overlaps', True)})) SELECT DISTINCT 'ts&op1&' || otype AS series, oid FROM asg_o UNION ALL SELECT DISTINCT 'ts&op6&' || param1 || '|' || param2, oid FROM six JOIN asg_o ON otype IN (param1, param2)",
}
