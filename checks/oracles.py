"""The registered queries in SQL, written from the definitions.

The SQL expands every pair of states on its own and finds every draw by its
interval, so it shares no shortcut with the library. Before rounding, 5e-12 is added as
in the queries: summation order could tip an exact half either way.
"""

from __future__ import annotations

from trackweave.settings import OD_HORIZON_SECONDS, RING_WEIGHTS

from .inputs import USERS_PER_DISTRICT
from .queries import PHASE_ROWS, PROPAGATE_ROWS, RANDOM_STEPS, SHUFFLED_ROWS, SLOT_1, SLOT_2, WALK_STEPS

_W = RING_WEIGHTS

_INPUTS = f"""
ev AS (
  SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(user_id // {USERS_PER_DISTRICT} AS INTEGER) AS district
  FROM events
),
obs AS (
  SELECT event_id, user_id, ts, CAST(isodow(ts) AS INTEGER) AS weekday,
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(hour(ts) AS INTEGER) END AS hour,
         CAST(10 * (k % 10) + 5 + 100 * district AS DOUBLE) AS coord_x,
         CAST(10 * (k // 10) + 5 AS DOUBLE) AS coord_y, k
  FROM ev
),
obs_dup AS (
  SELECT user_id, ts, weekday, hour, coord_x, coord_y FROM obs
  UNION ALL
  SELECT user_id, ts, weekday, hour,
         CASE WHEN k % 10 = 9 THEN coord_x - 90 ELSE coord_x + 10 END, coord_y
  FROM obs WHERE event_id % 50 = 0
),
points AS (
  SELECT DISTINCT k, CAST(1000 + 100 * district + k AS VARCHAR) AS cell_id,
         CAST(10 * (k % 10) + 5 + 100 * district AS DOUBLE) AS coord_x,
         CAST(10 * (k // 10) + 5 AS DOUBLE) AS coord_y,
         k % 10 + 10 * district AS col, k // 10 AS line
  FROM ev
),
cells AS MATERIALIZED (
  SELECT cell_id, coord_x, coord_y,
         CAST(row_number() OVER (ORDER BY cell_id) AS INTEGER) AS cell_no
  FROM points WHERE k < 96
),
adjacency AS MATERIALIZED (
  SELECT a.cell_id, b.cell_id AS neighbor_id,
         CAST(greatest(abs(a.col - b.col), abs(a.line - b.line)) AS INTEGER) AS ring_order
  FROM points a JOIN points b ON abs(a.col - b.col) <= 3 AND abs(a.line - b.line) <= 3
),
traj AS MATERIALIZED (
  SELECT user_id, ts, weekday, hour, cell_id, cell_no
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts
                                     ORDER BY coord_x, coord_y, hour NULLS FIRST) AS rn FROM obs)
  JOIN cells USING (coord_x, coord_y) WHERE rn = 1
),
ring_sized AS (
  SELECT cell_id, neighbor_id, ring_order,
         count(*) OVER (PARTITION BY cell_id, ring_order) AS n,
         CASE ring_order WHEN 0 THEN {_W[0]} WHEN 1 THEN {_W[1]} WHEN 2 THEN {_W[2]}
                         ELSE {_W[3]} END AS w
  FROM adjacency
),
rings AS (
  SELECT cell_id,
         CAST(max(n) FILTER (ring_order = 1) AS INTEGER) AS n_1,
         CAST(max(n) FILTER (ring_order = 2) AS INTEGER) AS n_2,
         CAST(max(n) FILTER (ring_order = 3) AS INTEGER) AS n_3,
         string_agg(neighbor_id, ' ' ORDER BY neighbor_id) FILTER (ring_order = 1) AS members_1,
         string_agg(neighbor_id, ' ' ORDER BY neighbor_id) FILTER (ring_order = 2) AS members_2,
         string_agg(neighbor_id, ' ' ORDER BY neighbor_id) FILTER (ring_order = 3) AS members_3
  FROM ring_sized GROUP BY cell_id
),
ring_props AS (
  SELECT *, {_W[0]} AS self_prop, round({_W[1]} / n_1 + 5e-12, 9) AS prop_1,
         round({_W[2]} / n_2 + 5e-12, 9) AS prop_2, round({_W[3]} / n_3 + 5e-12, 9) AS prop_3
  FROM rings
)"""


def _ring(order: int) -> str:
    total = " + ".join(f"CAST({w} AS DOUBLE)" for w in _W[: order + 1])
    return f"""
ring{order} AS MATERIALIZED (
  SELECT cell_id, neighbor_id, CAST(w AS DOUBLE) / n / ({total}) AS prop
  FROM ring_sized WHERE ring_order <= {order}
),
links{order} AS MATERIALIZED (
  SELECT a.cell_no, b.cell_no AS link_no, r.prop
  FROM ring{order} r JOIN cells a ON a.cell_id = r.cell_id
                     JOIN cells b ON b.cell_id = r.neighbor_id
)"""


def _lagged(name: str, where: str = "true") -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT *, lag(cell_no) OVER day AS prev_cell_no, lag(cell_id) OVER day AS prev_cell_id
  FROM traj WHERE {where}
  WINDOW day AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts)
)"""


_DESTINATIONS = f"""
trips AS MATERIALIZED (
  SELECT *, last_value(cell_no) OVER (
           PARTITION BY user_id, CAST(ts AS DATE) ORDER BY epoch_us(ts)
           RANGE BETWEEN CURRENT ROW
                 AND ({(OD_HORIZON_SECONDS + 1) * 1000000 - 1} - epoch_us(ts) % 1000000) FOLLOWING
         ) AS dest_cell_no
  FROM traj
)"""


def _matrix(name: str, pairs: str, order: int, frm="prev_cell_no", to="cell_no", where="") -> str:
    """Weights pair by pair, then probabilities."""
    if order:
        body = f"""SELECT a.link_no AS from_no, b.link_no AS to_no, sum(a.prop * b.prop) AS weight
  FROM {pairs} p JOIN links{order} a ON a.cell_no = p.{frm}
                 JOIN links{order} b ON b.cell_no = p.{to} {where} GROUP BY ALL"""
    else:
        body = f"""SELECT {frm} AS from_no, {to} AS to_no, CAST(count(*) AS DOUBLE) AS weight
  FROM {pairs} p {where} GROUP BY ALL"""
    return f"""
{name} AS MATERIALIZED (
  SELECT from_no, to_no, weight, weight / sum(weight) OVER (PARTITION BY from_no) AS prob
  FROM ({body})
)"""


_COMPLETE = "WHERE p.prev_cell_no IS NOT NULL AND p.hour IS NOT NULL"


def _tm(name: str, pairs: str, order: int) -> str:
    return _matrix(name, pairs, order, where=_COMPLETE)


def _slot(slot: tuple[int, int, int, int]) -> str:
    return (
        f"weekday BETWEEN {slot[0]} AND {slot[1]} AND hour >= {slot[2]} AND hour < {slot[3]}"
    )


def _first(name: str, where: str = "true") -> str:
    return f"""
{name} AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn
    FROM traj WHERE {where}) WHERE rn = 1
)"""


def _start(name: str, first: str, order: int = 1) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT l.link_no AS cell_no,
         sum(l.prop) / (SELECT count(DISTINCT user_id) FROM {first}
                        JOIN links{order} USING (cell_no)) AS p
  FROM {first} f JOIN links{order} l ON l.cell_no = f.cell_no GROUP BY l.link_no
)"""


def _trace(name: str, start: str, matrix: str, rows: int) -> str:
    return f"""
{name} AS (
  SELECT 0 AS step, cell_no, p FROM {start}
  UNION ALL
  SELECT v.step + 1, m.to_no, sum(v.p * m.prob)
  FROM {name} v JOIN {matrix} m ON m.from_no = v.cell_no
  WHERE v.step < {rows - 1} GROUP BY v.step + 1, m.to_no
)"""


_CDF = """
cdf AS MATERIALIZED (
  SELECT from_no, to_no, cum, coalesce(lag(cum) OVER o, 0.0) AS lo,
         CASE WHEN lead(cum) OVER o IS NULL THEN 'infinity'::DOUBLE ELSE cum END AS hi
  FROM (SELECT from_no, to_no, round(sum(prob) OVER (PARTITION BY from_no ORDER BY to_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 12) AS cum FROM tm)
  WINDOW o AS (PARTITION BY from_no ORDER BY to_no)
)"""


def _uniform(*parts: str) -> str:
    text = "concat_ws('|', " + ", ".join(parts) + ", 0)"
    return f"((CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE)"


_WALK = f"""
walk AS (
  SELECT user_id, 1 AS i, cell_no FROM first_rows
  UNION ALL
  SELECT w.user_id, w.i + 1, c.to_no
  FROM (SELECT *, {_uniform("user_id", "i")} AS r FROM walk WHERE i <= {WALK_STEPS}) w
  JOIN cdf c ON c.from_no = w.cell_no AND w.r > c.lo AND w.r <= c.hi
)"""

_SEQUENCE = """
seq AS MATERIALIZED (
  SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) AS INTEGER) AS i, cell_no
  FROM traj
)"""

_STEP_MEANS = """
step_means AS MATERIALIZED (
  SELECT w.i, l.link_no AS cell_no, sum(l.prop) / any_value(t.n) AS p
  FROM seq w JOIN links1 l USING (cell_no)
  JOIN (SELECT i, count(*) AS n FROM seq GROUP BY i) t ON t.i = w.i
  GROUP BY w.i, l.link_no
)"""

_RUNNING = """
running AS (
  SELECT g.i, m.cell_no, sum(m.p) / g.i AS p
  FROM (SELECT DISTINCT i FROM seq) g JOIN step_means m ON m.i <= g.i GROUP BY g.i, m.cell_no
)"""


def _sql(select: str, *parts: str) -> str:
    return "WITH RECURSIVE" + ",".join((_INPUTS, *parts)) + "\n" + select


_LAG = _lagged("lagged")
_TM1 = (_ring(1), _LAG, _tm("tm", "lagged", 1))
_WALKS = (*_TM1, _first("first_rows"), _CDF, _WALK)
_SEQ = (_ring(1), _SEQUENCE)
# Observed sequences and drawn walks.
_STEPS = (
    *_WALKS,
    _SEQUENCE,
    """
steps AS MATERIALIZED (
  SELECT false AS drawn, user_id, i, cell_no FROM seq
  UNION ALL
  SELECT true, user_id, i, cell_no FROM walk
)""",
    """
step_pairs AS MATERIALIZED (
  SELECT *, lag(cell_no) OVER (PARTITION BY drawn, user_id ORDER BY i) AS prev_cell_no FROM steps
)""",
)
_MEANS = (*_SEQ, _STEP_MEANS)
_UPDATES = (
    _ring(1),
    _LAG,
    """
updates AS (
  SELECT p.user_id, p.ts, a.neighbor_id AS from_cell, b.neighbor_id AS to_cell,
         a.prop * b.prop AS weight
  FROM lagged p JOIN ring1 a ON a.cell_id = p.prev_cell_id JOIN ring1 b ON b.cell_id = p.cell_id
  WHERE p.prev_cell_id IS NOT NULL AND p.hour IS NOT NULL
)""",
)
_CHAIN = (
    _ring(1),
    _lagged("lagged_1", _slot(SLOT_1)),
    _lagged("lagged_2", _slot(SLOT_2)),
    _tm("tm_1", "lagged_1", 1),
    _tm("tm_2", "lagged_2", 1),
    _first("first_rows", _slot(SLOT_1)),
    _start("start_1", "first_rows"),
    _trace("trace_1", "start_1", "tm_1", PHASE_ROWS[0]),
    f"""
start_2 AS (SELECT cell_no, p FROM trace_1 WHERE step = {PHASE_ROWS[0] - 1})""",
    _trace("trace_2", "start_2", "tm_2", PHASE_ROWS[1]),
    """
chain AS (
  SELECT 1 AS phase, * FROM trace_1 UNION ALL SELECT 2, * FROM trace_2
)""",
)
_START = (_ring(1), _first("first_rows"), _start("start_v", "first_rows"))
_PROPAGATE = (
    *_START,
    _LAG,
    _tm("tm", "lagged", 1),
    _trace("trace", "start_v", "tm", PROPAGATE_ROWS),
)

_MATRIX_ROWS = "SELECT from_no, to_no, round(weight + 5e-12, 9) AS weight, round(prob + 5e-12, 9) AS prob FROM tm"
_GIS_ROWS = """SELECT round(prob + 5e-12, 9) AS prob, a.cell_id AS from_cell, a.coord_x AS from_x,
  a.coord_y AS from_y, b.cell_id AS to_cell, b.coord_x AS to_x, b.coord_y AS to_y
FROM tm JOIN cells a ON a.cell_no = from_no JOIN cells b ON b.cell_no = to_no"""
_OBS_ROWS = "SELECT user_id, epoch_us(ts) AS ts_us, weekday, hour, coord_x, coord_y FROM obs"
_TRAJ_COLUMNS = "user_id, epoch_us(ts) AS ts_us, weekday, hour, cell_id, cell_no"


def _ring_rows(order: int) -> str:
    return _sql(f"SELECT cell_id, neighbor_id, round(prop + 5e-12, 9) AS prop FROM ring{order}", _ring(order))


ORACLES: dict[str, str] = {
    "read_observations": _sql(
        "SELECT user_id AS uid, epoch_us(ts) AS ts_us, hour AS tidenhnum, "
        "coord_x AS xtr10, coord_y AS ytr10 FROM obs"
    ),
    "read_cells": _sql("SELECT cell_id AS locid, coord_x AS xtr10, coord_y AS ytr10 FROM cells"),
    "read_ring_adjacency": _sql("SELECT cell_id, neighbor_id, ring_order FROM adjacency"),
    "write_matrix": _sql(_MATRIX_ROWS, _LAG, _tm("tm", "lagged", 0)),
    "normalize_observations": _sql(_OBS_ROWS),
    "dedup_observations": _sql(
        """SELECT user_id, epoch_us(ts) AS ts_us, weekday, hour, coord_x, coord_y
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY coord_x, coord_y) AS rn
      FROM obs_dup) WHERE rn = 1"""
    ),
    "sort_observations": _sql(_OBS_ROWS + " ORDER BY user_id, ts"),
    "number_cells": _sql("SELECT cell_id, coord_x, coord_y, cell_no FROM cells"),
    "filter_time_slot": _sql(f"SELECT {_TRAJ_COLUMNS} FROM traj WHERE {_slot(SLOT_1)}"),
    "drop_incomplete": _sql(
        f"SELECT {_TRAJ_COLUMNS}, prev_cell_no FROM lagged p {_COMPLETE}", _LAG
    ),
    "align_ring_counts": _sql("SELECT cell_id, n_1, n_2, n_3 FROM rings"),
    "ring_probability": _sql(
        "SELECT cell_id, n_1, n_2, n_3, CAST(self_prop AS DOUBLE) AS self_prop, "
        "prop_1, prop_2, prop_3 FROM ring_props"
    ),
    "align_ring_members": _sql("SELECT cell_id, members_1, members_2, members_3 FROM rings"),
    "join_ring_parts": _sql(
        "SELECT cell_id, n_1, n_2, n_3, CAST(self_prop AS DOUBLE) AS self_prop, "
        "prop_1, prop_2, prop_3, members_1, members_2, members_3 FROM ring_props"
    ),
    "ring_repeat_weights": _sql(
        """SELECT cell_id, ring_order,
  CAST(row_number() OVER (PARTITION BY cell_id, ring_order) - 1 AS INTEGER) AS pos,
  round(CAST(w AS DOUBLE) / n + 5e-12, 9) AS prop
FROM ring_sized WHERE ring_order >= 1"""
    ),
    "ring_states_1": _ring_rows(1),
    "ring_states_2": _ring_rows(2),
    "ring_states_3": _ring_rows(3),
    "zip_states": _sql(
        "SELECT cell_id, neighbor_id, round(CAST(w AS DOUBLE) / n + 5e-12, 9) AS prop "
        "FROM ring_sized WHERE ring_order = 1"
    ),
    "locate_observations": _sql(f"SELECT {_TRAJ_COLUMNS} FROM traj"),
    "probabilistic_states": _sql(
        "SELECT user_id, epoch_us(ts) AS ts_us, cell_no, neighbor_id, round(prop + 5e-12, 9) AS prop "
        "FROM traj JOIN ring2 USING (cell_id)",
        _ring(2),
    ),
    "simplify_matrix_ids": _sql(
        """SELECT a.cell_no AS from_no, b.cell_no AS to_no, round(sum(weight) + 5e-12, 9) AS weight
FROM updates JOIN cells a ON a.cell_id = from_cell JOIN cells b ON b.cell_id = to_cell
GROUP BY ALL""",
        *_UPDATES,
    ),
    "gis_export": _sql(_GIS_ROWS, _LAG, _tm("tm", "lagged", 0)),
    "simplify_vector_ids": _sql(
        "SELECT user_id, link_no AS cell_no, round(prop + 5e-12, 9) AS prop "
        "FROM first_rows JOIN links1 USING (cell_no)",
        _ring(1),
        _first("first_rows"),
    ),
    "start_cell_lookup": _sql("SELECT user_id, cell_no FROM first_rows", _first("first_rows")),
    "add_ring_noise": _sql(
        """SELECT drawn, user_id, i, cell_no, neighbor_id, round(prop + 5e-12, 9) AS prop
FROM steps JOIN cells USING (cell_no) JOIN ring1 USING (cell_id)""",
        *_STEPS,
    ),
    "deterministic_states": _sql(
        "SELECT user_id, epoch_us(ts) AS ts_us, weekday, hour, cell_id AS neighbor_id, "
        "CAST(1 AS DOUBLE) AS prop FROM traj"
    ),
    "outer_product": _sql(
        "SELECT user_id, epoch_us(ts) AS ts_us, from_cell, to_cell, round(weight + 5e-12, 9) AS weight "
        "FROM updates",
        *_UPDATES,
    ),
    "explode_updates": _sql(
        "SELECT from_cell, to_cell, round(weight + 5e-12, 9) AS weight FROM updates", *_UPDATES
    ),
    "explode_states": _sql(
        "SELECT user_id, epoch_us(ts) AS ts_us, neighbor_id AS cell_id, round(prop + 5e-12, 9) AS prop "
        "FROM traj JOIN ring1 USING (cell_id)",
        _ring(1),
    ),
    "sort_states": _sql(
        """SELECT cell_id, neighbor_id, round(prop + 5e-12, 9) AS prop,
  CAST(row_number() OVER (PARTITION BY cell_id ORDER BY neighbor_id) - 1 AS INTEGER) AS pos
FROM ring2""",
        _ring(2),
    ),
    "walk_to_rows": _sql("SELECT user_id, i, cell_no FROM walk", *_WALKS),
    "collect_pairs": _sql(
        "SELECT from_cell, to_cell, round(sum(weight) + 5e-12, 9) AS weight FROM updates GROUP BY ALL",
        *_UPDATES,
    ),
    "initial_distribution": _sql("SELECT cell_no, round(p + 5e-12, 9) AS p FROM start_v", *_START),
    "vector_collect": _sql(
        """SELECT string_agg(cell_no::VARCHAR, ' ' ORDER BY cell_no) AS cells,
  string_agg(CAST(round(p * 1e9) AS BIGINT)::VARCHAR, ' ' ORDER BY cell_no) AS props
FROM start_v""",
        *_START,
    ),
    "step_mean": _sql(
        """SELECT s.drawn, s.i, l.link_no AS cell_no, round(sum(l.prop) / any_value(t.n) + 5e-12, 9) AS p
FROM steps s JOIN links1 l USING (cell_no)
JOIN (SELECT drawn, i, count(*) AS n FROM steps GROUP BY ALL) t ON t.drawn = s.drawn AND t.i = s.i
GROUP BY s.drawn, s.i, l.link_no""",
        *_STEPS,
    ),
    "lag_state_by_day": _sql(f"SELECT {_TRAJ_COLUMNS}, prev_cell_no FROM lagged", _LAG),
    "lag_state_by_step": _sql(
        "SELECT drawn, user_id, i, cell_no, prev_cell_no FROM step_pairs", *_STEPS
    ),
    "number_steps": _sql("SELECT user_id, i, cell_no FROM seq", *_SEQ),
    "od_destination": _sql(f"SELECT {_TRAJ_COLUMNS}, dest_cell_no FROM trips", _DESTINATIONS),
    "row_normalize": _sql(_MATRIX_ROWS, *_TM1),
    "first_observation": _sql(f"SELECT {_TRAJ_COLUMNS} FROM first_rows", _first("first_rows")),
    "arbitrary_start": _sql("SELECT user_id, cell_no FROM first_rows", _first("first_rows")),
    "running_mean": _sql(
        "SELECT i, cell_no, round(p + 5e-12, 9) AS p FROM running", *_MEANS, _RUNNING
    ),
    "transition_matrix_deterministic": _sql(_MATRIX_ROWS, _LAG, _tm("tm", "lagged", 0)),
    "transition_matrix_1ring": _sql(_MATRIX_ROWS, *_TM1),
    "transition_matrix_2ring": _sql(_MATRIX_ROWS, _ring(2), _LAG, _tm("tm", "lagged", 2)),
    "transition_matrix_3ring": _sql(_MATRIX_ROWS, _ring(3), _LAG, _tm("tm", "lagged", 3)),
    "transition_matrix_gis": _sql(_GIS_ROWS, *_TM1),
    "od_matrix": _sql(
        _MATRIX_ROWS,
        _ring(1),
        _DESTINATIONS,
        _matrix("tm", "trips", 1, frm="cell_no", to="dest_cell_no"),
    ),
    "od_matrix_gis": _sql(
        _GIS_ROWS,
        _ring(1),
        _DESTINATIONS,
        _matrix("tm", "trips", 1, frm="cell_no", to="dest_cell_no"),
    ),
    "transition_matrix_slot": _sql(
        _MATRIX_ROWS, _ring(1), _lagged("lagged", _slot(SLOT_1)), _tm("tm", "lagged", 1)
    ),
    "transition_matrix_walks": _sql(
        _MATRIX_ROWS.replace("SELECT", "SELECT false AS drawn,").replace("FROM tm", "FROM seq_tm")
        + " UNION ALL "
        + _MATRIX_ROWS.replace("SELECT", "SELECT true AS drawn,").replace("FROM tm", "FROM walk_tm"),
        *_STEPS,
        _matrix("seq_tm", "step_pairs", 1, where="WHERE p.prev_cell_no IS NOT NULL AND NOT p.drawn"),
        _matrix("walk_tm", "step_pairs", 1, where="WHERE p.prev_cell_no IS NOT NULL AND p.drawn"),
    ),
    "transition_matrix_by_second": _sql(_MATRIX_ROWS, *_TM1),
    "transition_matrix_raw": _sql(_MATRIX_ROWS, *_TM1),
    "od_matrix_by_second": _sql(
        _MATRIX_ROWS,
        _ring(1),
        _DESTINATIONS,
        _matrix("tm", "trips", 1, frm="cell_no", to="dest_cell_no"),
    ),
    "slot_matrices": _sql(
        _MATRIX_ROWS.replace("SELECT", "SELECT 0 AS slot,").replace("FROM tm", "FROM tm_1")
        + " UNION ALL "
        + _MATRIX_ROWS.replace("SELECT", "SELECT 1 AS slot,").replace("FROM tm", "FROM tm_2"),
        _ring(1),
        _lagged("lagged_1", _slot(SLOT_1)),
        _lagged("lagged_2", _slot(SLOT_2)),
        _tm("tm_1", "lagged_1", 1),
        _tm("tm_2", "lagged_2", 1),
    ),
    "matrix_coo": _sql("SELECT from_no, to_no, round(prob + 5e-12, 9) AS prob FROM tm", *_TM1),
    "to_vector": _sql("SELECT cell_no, round(p + 5e-12, 9) AS p FROM start_v", *_START),
    "propagate": _sql("SELECT step, cell_no, round(p + 5e-12, 9) AS p FROM trace", *_PROPAGATE),
    "propagate_shuffled": _sql(
        f"SELECT step, cell_no, round(p + 5e-12, 9) AS p FROM trace WHERE step < {SHUFFLED_ROWS}",
        *_PROPAGATE,
    ),
    "chain_phases": _sql(
        "SELECT phase, step, cell_no, round(p + 5e-12, 9) AS p FROM chain", *_CHAIN
    ),
    "convergence_trace": _sql(
        f"""SELECT CAST(g.step AS INTEGER) AS step, c.cell_no, round(coalesce(t.p, 0) + 5e-12, 9) AS p,
  round(abs(coalesce(t.p, 0) - lag(coalesce(t.p, 0)) OVER (PARTITION BY c.cell_no
        ORDER BY g.step)) + 5e-12, 9) AS change
FROM range({PROPAGATE_ROWS}) g(step) CROSS JOIN (SELECT DISTINCT cell_no FROM trace) c
LEFT JOIN trace t ON t.step = g.step AND t.cell_no = c.cell_no""",
        *_PROPAGATE,
    ),
    "mobility_trend": _sql(
        f"""SELECT cell_no,
  round(coalesce(sum(p) FILTER (phase = 1 AND step = 0), 0) + 5e-12, 9) AS "initial",
  round(coalesce(sum(p) FILTER (phase = 1 AND step = {PHASE_ROWS[0] - 1}), 0) + 5e-12, 9) AS "middle",
  round(coalesce(sum(p) FILTER (phase = 2 AND step = {PHASE_ROWS[1] - 1}), 0) + 5e-12, 9) AS "end"
FROM chain
WHERE (phase = 1 AND step IN (0, {PHASE_ROWS[0] - 1}))
   OR (phase = 2 AND step = {PHASE_ROWS[1] - 1})
GROUP BY cell_no""",
        *_CHAIN,
    ),
    "transition_cdf": _sql(
        "SELECT from_no, to_no, round(cum + 5e-12, 9) AS cum, round(lo + 5e-12, 9) AS lo FROM cdf", *_TM1, _CDF
    ),
    "next_state_draw": _sql(
        f"""SELECT f.user_id, f.cell_no, c.to_no AS next_no
FROM (SELECT *, {_uniform("user_id", "1")} AS r FROM first_rows) f
LEFT JOIN cdf c ON c.from_no = f.cell_no AND f.r > c.lo AND f.r <= c.hi""",
        *_TM1,
        _first("first_rows"),
        _CDF,
    ),
    "synthesize_walks": _sql(
        "SELECT user_id, string_agg(cell_no::VARCHAR, ' ' ORDER BY i) AS walk "
        "FROM walk GROUP BY user_id",
        *_WALKS,
    ),
    "last_step_distribution": _sql(
        "SELECT cell_no, round(p + 5e-12, 9) AS p FROM running WHERE i = (SELECT max(i) FROM seq)",
        *_MEANS,
        _RUNNING,
    ),
    "walk_vectors": _sql(
        """SELECT drawn, user_id, i, neighbor_id AS cell_id, round(prop + 5e-12, 9) AS prop
FROM steps JOIN cells USING (cell_no) JOIN ring1 USING (cell_id)""",
        *_STEPS,
    ),
    "random_states": _sql(
        f"""SELECT user_id, CAST(i AS INTEGER) AS i,
  CAST(floor({_uniform("user_id", "i")} * (SELECT count(*) FROM cells)) + 1 AS INTEGER) AS cell_no
FROM (SELECT DISTINCT user_id FROM events), range(1, {RANDOM_STEPS + 1}) g(i)"""
    ),
}
