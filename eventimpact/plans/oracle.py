"""DuckDB text of the fixture views (FIXTURES.md §2) and the helper that prefixes them to an oracle query.

The oracle is written independently of the Spark plans: plain SQL over the pre-registered driver tables.
"""

from __future__ import annotations

import re

_STR = "VARCHAR"


def _wd(x: str) -> str:
    return f"(isodow({x})-1)"


INC = f"""
SELECT event_id AS id, ts AS start_datetime,
  CASE event_type WHEN 'error' THEN 'accident' WHEN 'click' THEN 'vehicle_breakdown' WHEN 'view' THEN 'water_logging'
    WHEN 'signup' THEN 'tree_fall' ELSE 'protest' END AS event_cause,
  CASE WHEN k % 10 = 0 THEN 'planned' ELSE 'unplanned' END AS event_type,
  CASE WHEN user_id % 8 = 7 THEN 'Non-corridor' ELSE concat('C', CAST(user_id % 8 AS {_STR})) END AS corridor,
  CAST(CASE WHEN user_id % 8 = 7 THEN 0 WHEN user_id % 8 <= 1 THEN 1 WHEN user_id % 8 <= 4 THEN 2 ELSE 3 END AS INT) AS corridor_tier,
  CASE WHEN user_id % 54 = 53 THEN NULL ELSE concat('S', CAST(user_id % 54 AS {_STR})) END AS police_station,
  CASE WHEN user_id % 10 = 9 THEN NULL ELSE concat('J', CAST(user_id % 97 AS VARCHAR)) END AS junction,
  CASE k % 5 WHEN 0 THEN 'bmtc_bus' WHEN 1 THEN 'truck' WHEN 2 THEN 'private_car' WHEN 3 THEN 'ksrtc_bus' ELSE NULL END AS veh_type,
  CAST(CASE WHEN k < 8 THEN 1 ELSE 0 END AS INT) AS requires_road_closure,
  CAST(hour(ts) AS INT) AS hour, CAST({_wd('ts')} AS INT) AS weekday, CAST(month(ts) AS INT) AS month,
  CASE WHEN k >= 90 THEN NULL ELSE value * 4 END AS duration_minutes,
  12.5 + ((user_id * 37) % 1000) / CAST(1000 AS DOUBLE) AS latitude,
  77.0 + ((user_id * 91) % 1000) / CAST(1000 AS DOUBLE) AS longitude, k
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
"""

# Density clusters by definition (needs WITH RECURSIVE): core points reach each other over core neighbours, a border
# point takes the smallest neighbouring cluster, clusters are numbered by their smallest core row.
GEO_SQL = """
gp AS MATERIALIZED (SELECT latitude AS lat, longitude AS lon, count(*) AS w, min(id) AS pid FROM inc
       WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY latitude, longitude),
ge AS MATERIALIZED (SELECT a.pid AS a, b.pid AS b, b.w FROM gp a JOIN gp b
       ON sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)) <= CAST(0.01 AS DOUBLE)),
gc AS MATERIALIZED (SELECT a AS pid FROM ge GROUP BY a HAVING sum(w) >= 5),
gn AS MATERIALIZED (SELECT a, b FROM ge WHERE a IN (SELECT pid FROM gc) AND b IN (SELECT pid FROM gc)),
gr AS (SELECT pid AS src, pid AS node FROM gc UNION SELECT gr.src, gn.b FROM gr JOIN gn ON gr.node = gn.a WHERE gr.src <= gn.b),
gl AS MATERIALIZED (SELECT node, min(src) AS label FROM gr GROUP BY node),
gl2 AS MATERIALIZED (SELECT node, dense_rank() OVER (ORDER BY label) - 1 AS cid FROM gl),
gb AS MATERIALIZED (SELECT ge.a AS node, min(gl2.cid) AS cid FROM ge JOIN gl2 ON ge.b = gl2.node GROUP BY ge.a),
geo AS MATERIALIZED (SELECT i.id, CAST(coalesce(gl2.cid, gb.cid, -1) AS INT) AS geo_cluster FROM inc i
       LEFT JOIN gp ON i.latitude = gp.lat AND i.longitude = gp.lon
       LEFT JOIN gl2 ON gl2.node = gp.pid LEFT JOIN gb ON gb.node = gp.pid)"""

SCORED = """
SELECT s.*, least(100, greatest(0, least(40, greatest(0, dur / 10)) + requires_road_closure * 30
    + corridor_tier * 5 + is_peak_hour * 15)) AS impact_score
FROM (SELECT i.*, coalesce(duration_minutes, m) AS dur,
        CASE WHEN hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 19 THEN 1 ELSE 0 END AS is_peak_hour
      FROM inc i CROSS JOIN (SELECT median(duration_minutes) AS m FROM inc) t) s
"""

PLAN = f"""
SELECT o_orderkey AS event_id, concat('event ', CAST(o_orderkey AS {_STR})) AS event_name,
  CASE o_orderkey % 6 WHEN 0 THEN 'festival' WHEN 1 THEN 'sports' WHEN 2 THEN 'rally' WHEN 3 THEN 'procession'
    WHEN 4 THEN 'public_event' ELSE 'construction' END AS event_type,
  CAST(o_orderdate AS DATE) AS event_date, CAST(o_orderkey % 24 AS INT) AS hour,
  CAST({_wd('o_orderdate')} AS INT) AS weekday, CAST(month(o_orderdate) AS INT) AS month,
  CASE WHEN o_custkey % 8 = 7 THEN 'Non-corridor' ELSE concat('C', CAST(o_custkey % 8 AS {_STR})) END AS corridor,
  CAST(CASE WHEN o_custkey % 8 = 7 THEN 0 WHEN o_custkey % 8 <= 1 THEN 1 WHEN o_custkey % 8 <= 4 THEN 2 ELSE 3 END AS INT) AS corridor_tier,
  CAST(floor(o_totalprice / 5) AS INT) AS expected_crowd,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS closure_required
FROM orders
"""

PLOG = f"""
SELECT o_orderkey AS prediction_id, o_orderdate AS ts, o_orderpriority AS cause,
  CASE WHEN o_custkey % 8 = 7 THEN 'Non-corridor' ELSE concat('C', CAST(o_custkey % 8 AS {_STR})) END AS corridor,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS closure, CAST(o_orderkey % 24 AS INT) AS hour,
  CASE WHEN o_orderkey % 50 = 0 THEN CAST(0 AS DOUBLE) ELSE 10 + (o_orderkey * 7919 % 9000) / CAST(100 AS DOUBLE) END AS predicted_impact,
  CASE WHEN o_orderstatus = 'P' OR d IS NULL THEN NULL
    ELSE least(100, greatest(0, 10 + (o_orderkey * 7919 % 9000) / CAST(100 AS DOUBLE) + (d - 0.05) * 200)) END AS actual_impact
FROM orders LEFT JOIN (SELECT l_orderkey, avg(l_discount) AS d FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey
"""

WX = """
SELECT corridor, CAST(start_datetime AS DATE) AS day, CAST(floor(hour / 3) AS INT) AS slot,
  sum(duration_minutes) / 100 AS rain_3h_mm, avg(k) / 100 AS rain_prob
FROM inc WHERE corridor <> 'Non-corridor'
GROUP BY corridor, CAST(start_datetime AS DATE), CAST(floor(hour / 3) AS INT)
"""

VIEWS = [("inc", INC), ("scored", SCORED), ("plan", PLAN), ("plog", PLOG), ("wx", WX)]


def with_views(body: str) -> str:
    """Prefix the fixture views a query uses as CTEs (in dependency order); merge the query's own WITH."""
    body = body.strip()
    used: list[tuple[str, str]] = []
    text = body
    for name, sql in reversed(VIEWS):
        if re.search(rf"\b{name}\b", text):
            used.append((name, sql))
            text += sql
    used.sort(key=lambda v: [n for n, _ in VIEWS].index(v[0]))
    ctes = ",\n".join(f"{n} AS ({s.strip()})" for n, s in used)
    if not ctes:
        return body
    m = re.match(r"(?is)^with\s+(recursive\s+)?", body)
    if m:
        return f"WITH {m.group(1) or ''}{ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"


def sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def sql_case_map(expr: str, mapping: dict, default=None) -> str:
    """A CASE expression over a fixed mapping (the oracle's form of a literal map lookup)."""
    whens = " ".join(f"WHEN {sql_lit(k)} THEN {sql_lit(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE {sql_lit(default)} END)"


def sql_values(rows: list[tuple], cols: list[str]) -> str:
    body = ", ".join("(" + ", ".join(sql_lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


def _tie_safe_rounds(sql: str, digits: int = 6) -> str:
    """Rewrite ``round(x, 6)`` in oracle text as ``round(x + 1e-9·sign(x), 6)`` — the same tie-safe rounding
    the Spark side applies — by matching parentheses (our own SQL text only)."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, last_comma = 0, j + 5, -1
        while k < len(sql):
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    break
            elif ch == "," and depth == 1:
                last_comma = k
            k += 1
        inner = sql[j + 6:last_comma] if last_comma > 0 else None
        arg = sql[last_comma + 1:k].strip() if last_comma > 0 else ""
        if inner is not None and arg == str(digits):
            out.append(sql[i:j] + f"round(({_tie_safe_rounds(inner, digits)}) + 1e-9 * sign({_tie_safe_rounds(inner, digits)}), {digits})")
        else:
            out.append(sql[i:k + 1])
        i = k + 1


_DUCK_TYPES = {"integer": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "tinyint": "TINYINT",
               "string": "VARCHAR", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
               "boolean": "BOOLEAN", "float": "DOUBLE", "double": "DOUBLE"}


def round_wrap(sql: str, schema: list[list[str]], digits: int = 6) -> str:
    """Give the oracle output the Spark output's column types, and round its doubles exactly as the Spark
    side does (``registry.round_doubles``). Values are still computed by the oracle text alone."""
    sql = _tie_safe_rounds(sql, digits)
    if not schema:
        return sql
    cols = []
    for name, typ in schema:
        q = f'"{name}"'
        if typ in ("double", "float"):
            x = f"CAST({q} AS DOUBLE)"
            cols.append(f"round({x} + 1e-9 * sign({x}), {digits}) + 0.0 AS {q}")
        elif typ in _DUCK_TYPES:
            cols.append(f"CAST({q} AS {_DUCK_TYPES[typ]}) AS {q}")
        else:
            cols.append(q)
    return "SELECT " + ", ".join(cols) + f" FROM (\n{sql}\n) AS oracle_out"
