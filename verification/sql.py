"""Independent SQL for the registered queries, in the DuckDB dialect.

The SQL takes the direct road (window ranks, crossed iterations, sorted
quantiles) where the Spark side takes the one that scales.
"""

from __future__ import annotations

from statistics import NormalDist

# Stated here on their own, not taken from the code they check.
P = 2147483647
#: floor(P * P(X <= k)) for X ~ Poisson(1), k = 0, 1, …
POISSON = (790015083, 1580030167, 1975037709, 2106706890, 2139624185, 2146207644, 2147304887, 2147461637, 2147481230, 2147483407, 2147483625, 2147483645, 2147483646)
DURATION_EDGES = (5, 10, 15, 20, 30, 45, 60, 90, 120, 240)
DURATION_LABELS = ("0-5", "5-10", "10-15", "15-20", "20-30", "30-45", "45-60", "60-90", "90-120", "120-240", "240+")

SEED = 20250801
ZA = NormalDist().inv_cdf(0.975)
ZS = ZA + NormalDist().inv_cdf(0.8)
PRE1 = "date BETWEEN DATE '2024-01-01' AND DATE '2024-01-10'"
PRE2 = "date BETWEEN DATE '2024-01-11' AND DATE '2024-01-20'"
POST = "date BETWEEN DATE '2024-01-21' AND DATE '2024-01-30'"


# --- fragments --------------------------------------------------------------------------

def r(x: str, digits: int = 6) -> str:
    """Decimal rounding, half away from zero, without negative zero."""
    return f"(CAST(round(CAST(({x}) AS DECIMAL(38,10)), {digits}) AS DOUBLE) + 0.0)"


def total(x: str, cond: str = "") -> str:
    return f"sum(CAST({x} AS DECIMAL(18,6))){f' FILTER (WHERE {cond})' if cond else ''}"


def mean(x: str, cond: str = "") -> str:
    flt = f" FILTER (WHERE {cond})" if cond else ""
    return f"(CAST({total(x, cond)} AS DOUBLE) / count({x}){flt})"


def cnt(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def nsum(cond: str) -> str:
    return f"coalesce(sum(n) FILTER (WHERE {cond}), 0)::BIGINT"


def pct(num: str, den: str, scale: float = 100, digits: int = 1) -> str:
    return r(f"CASE WHEN coalesce({den}, 0) = 0 THEN 0 ELSE {float(scale)} * CAST({num} AS DOUBLE)"
             f" / CAST({den} AS DOUBLE) END", digits)


def _simpson(body: str, steps: int = 2000) -> str:
    """Weighted sum of ``body`` (a function of i) over 0 … steps."""
    return (f"list_sum(list_transform(range(0, {steps + 1}), lambda i: "
            f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {body}))")


def t_p(t: str, df: str) -> str:
    """Two-sided t tail by numerical integration of the density."""
    front = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi())"
    body = f"pow(1 + pow({t} * i / 2000.0, 2) / {df}, -({df} + 1) / 2)"
    p = f"greatest(0.0, 1 - 2 * abs({t}) / 6000.0 * {front} * {_simpson(body)})"
    return f"(CASE WHEN {t} IS NOT NULL AND {df} IS NOT NULL THEN {p} END)"


def normal_p(z: str) -> str:
    body = f"exp(-pow({z} * i / 2000.0, 2) / 2)"
    p = f"least(1.0, greatest(0.0, 1 - 2 * {z} / 6000.0 / sqrt(2 * pi()) * {_simpson(body)}))"
    return f"(CASE WHEN {z} IS NOT NULL THEN {p} END)"


def chi2_p(x: str, dof: int) -> str:
    if dof == 1:
        return normal_p(f"sqrt({x})")
    front = f"exp(-lgamma({dof} / 2.0)) / pow(2, {dof} / 2.0)"
    body = f"pow({x} * i / 2000.0, {dof} / 2.0 - 1) * exp(-{x} * i / 4000.0)"
    p = f"greatest(0.0, 1 - {x} / 6000.0 * {front} * {_simpson(body)})"
    return f"(CASE WHEN {x} IS NOT NULL THEN {p} END)"


def digest(*keys: str, seed: int | str = SEED, purpose: str = "") -> str:
    marked = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '\\N')" for k in keys)
    return f"md5(concat_ws('|', '{seed}{purpose}', {marked}))"


def hex_int(text: str) -> str:
    return f"CAST(concat('0x', {text}) AS BIGINT)"


def slope(dig: str) -> str:
    return f"({hex_int(f'substr({dig}, 1, 8)')} % {P - 1} + 1)"


def offset(dig: str) -> str:
    return f"({hex_int(f'substr({dig}, 9, 8)')} % {P})"


def poisson(h: str) -> str:
    whens = " ".join(f"WHEN {h} < {b} THEN {k}" for k, b in enumerate(POISSON))
    return f"(CASE {whens} ELSE {len(POISSON)} END)"


def bucket_case(x: str, as_label: bool) -> str:
    whens = " ".join(
        f"WHEN {x} < {edge} THEN {repr(DURATION_LABELS[i]) if as_label else i}"
        for i, edge in enumerate(DURATION_EDGES))
    last = repr(DURATION_LABELS[-1]) if as_label else len(DURATION_EDGES)
    return f"(CASE WHEN {x} IS NULL THEN NULL {whens} ELSE {last} END)"


def permuted(purpose: str) -> str:
    dig = digest("unit", purpose=purpose)
    return f"""
        SELECT i AS iteration, unit, row_number() OVER (PARTITION BY i ORDER BY h, unit) AS rn,
          count(*) OVER (PARTITION BY i) AS total
        FROM (SELECT i, unit, ({slope(dig)} * (2 * i + 1) + {offset(dig)}) % {P}
              AS h FROM panel, range(0, 2000) AS it(i))"""


# --- common tables -------------------------------------------------------------------------

DAY_TYPE = "CASE isodow({0}) WHEN 6 THEN 'saturday' WHEN 7 THEN 'sunday' ELSE 'weekday' END"

CTE = {
    "ev": f"""
        SELECT event_id, ts, value, user_id,
          CASE WHEN user_id % 5 < 3 THEN 'member' ELSE 'casual' END AS rider_class,
          CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'electric_bike'
               ELSE 'classic_bike' END AS vehicle_class,
          CAST(k AS VARCHAR) AS origin,
          CASE WHEN s % 3 <> 0 THEN CAST((k + s) % 100 AS VARCHAR) END AS destination,
          least(3, (day(ts) - 1) // 10 + 1)::BIGINT AS period,
          CAST(ts AS DATE) AS date, hour(ts)::BIGINT AS hour, isodow(ts)::BIGINT AS dow,
          {DAY_TYPE.format('ts')} AS day_type
        FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k,
                     CAST(floor(value) AS BIGINT) AS s FROM events)""",
    "raw_or": """
        SELECT concat_ws('-', l_orderkey, l_linenumber) AS trip_key,
          CASE l_linestatus WHEN 'O' THEN 'electric_bike' WHEN 'F' THEN 'classic_bike' END
            AS status_class,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'member' WHEN '2' THEN 'member'
            WHEN '3' THEN 'member' WHEN '5' THEN 'casual' END AS priority_class,
          o_orderdate AS ordered_ts, l_shipdate AS shipped_ts,
          CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE)
            AS days_open,
          month(o_orderdate)::BIGINT AS month, year(o_orderdate)::BIGINT AS year,
          CAST(s_nationkey AS VARCHAR) AS supply_id, sn.n_name AS supply_name,
          c_acctbal AS supply_y, s_acctbal AS supply_x,
          CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(c_nationkey AS VARCHAR) END AS demand_id,
          CASE WHEN c_mktsegment <> 'MACHINERY' THEN cn.n_name END AS demand_name,
          CASE WHEN c_mktsegment <> 'MACHINERY' THEN s_acctbal END AS demand_y,
          CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal END AS demand_x
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
        LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey
        LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey""",
    "classed": """
        SELECT *, CASE WHEN ordered_ts IS NULL OR shipped_ts IS NULL THEN 'bad_time'
          WHEN days_open IS NULL OR days_open <= 0 OR days_open > 1440 THEN 'bad_duration'
          WHEN priority_class IS NULL OR status_class IS NULL THEN 'bad_enum' ELSE 'good' END AS cls
        FROM raw_or""",
    "oc": f"""
        SELECT * EXCLUDE (cls, pick), CAST(ordered_ts AS DATE) AS date,
          hour(ordered_ts)::BIGINT AS hour, isodow(ordered_ts)::BIGINT AS dow,
          {DAY_TYPE.format('ordered_ts')} AS day_type
        FROM (SELECT *, row_number() OVER (PARTITION BY trip_key ORDER BY
            ordered_ts NULLS FIRST, shipped_ts NULLS FIRST, status_class NULLS FIRST,
            priority_class NULLS FIRST, days_open NULLS FIRST, month NULLS FIRST,
            year NULLS FIRST, supply_id NULLS FIRST, supply_name NULLS FIRST,
            supply_y NULLS FIRST, supply_x NULLS FIRST, demand_id NULLS FIRST,
            demand_name NULLS FIRST, demand_y NULLS FIRST, demand_x NULLS FIRST) AS pick
          FROM classed WHERE cls = 'good') WHERE pick = 1""",
    "cube": """
        SELECT period AS month, dow, hour, rider_class AS member, vehicle_class AS bike,
          count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(18,6))), 1) AS DOUBLE) AS sum_min
        FROM ev GROUP BY ALL""",
    "ocube": """
        SELECT month, dow, hour, priority_class AS member, status_class AS bike,
          count(*) AS n, CAST(round(sum(CAST(days_open AS DECIMAL(18,6))), 1) AS DOUBLE) AS sum_min
        FROM oc GROUP BY ALL""",
    "daily": f"""
        SELECT CAST(date AS VARCHAR) AS date, dow, day_type, count(*) AS n,
          {cnt("rider_class = 'member'")} AS n_member, {cnt("rider_class = 'casual'")} AS n_casual
        FROM ev GROUP BY ALL""",
    "odaily": f"""
        SELECT CAST(date AS VARCHAR) AS date, dow, day_type, count(*) AS n,
          {cnt("priority_class = 'member'")} AS n_member,
          {cnt("priority_class = 'casual'")} AS n_casual
        FROM oc GROUP BY ALL""",
    "hist": f"""
        SELECT period AS month, rider_class AS member, vehicle_class AS bike,
          {bucket_case('value', True)} AS bucket, {bucket_case('value', False)}::BIGINT AS bucket_ord,
          count(*) AS n FROM ev GROUP BY ALL""",
    "sides": """
        SELECT supply_id AS station_id, supply_name AS name, supply_x AS x, supply_y AS y,
          priority_class = 'member' AS m, true AS is_start FROM oc WHERE supply_id IS NOT NULL
        UNION ALL
        SELECT demand_id, NULL, NULL, NULL, priority_class = 'member', false
        FROM oc WHERE demand_id IS NOT NULL""",
    "station_name": """
        SELECT station_id, name FROM (
          SELECT station_id, name, row_number() OVER (
            PARTITION BY station_id ORDER BY count(*) DESC, name DESC) AS k
          FROM sides WHERE name IS NOT NULL GROUP BY station_id, name) WHERE k = 1""",
    "all_st": f"""
        SELECT station_id, any_value(sn.name) AS name,
          {r("CAST(sum(CAST(y AS DECIMAL(18,7))) AS DOUBLE) / count(y)", 5)} AS lat,
          {r("CAST(sum(CAST(x AS DECIMAL(18,7))) AS DOUBLE) / count(x)", 5)} AS lng,
          {cnt("is_start")} AS starts, {cnt("is_start AND m")} AS starts_member,
          {cnt("NOT is_start")} AS ends, {cnt("NOT is_start AND m")} AS ends_member,
          {cnt("NOT is_start")} - {cnt("is_start")} AS net,
          {pct(cnt("is_start AND m"), cnt("is_start"), 1, 3)} AS member_share
        FROM sides LEFT JOIN station_name sn USING (station_id) GROUP BY station_id
        HAVING count(x) > 0 AND count(y) > 0""",
    "st": "SELECT * FROM all_st WHERE starts > 0",
    "od": f"""
        SELECT e.*, s.name AS s_name, s.lat AS s_lat, s.lng AS s_lng,
          d.name AS e_name, d.lat AS e_lat, d.lng AS e_lng
        FROM (SELECT supply_id AS start_id, demand_id AS end_id, count(*) AS n,
            {cnt("priority_class = 'member'")} AS n_member, {r(mean("days_open"), 1)} AS avg_min
          FROM oc WHERE supply_id IS NOT NULL AND demand_id IS NOT NULL
          GROUP BY ALL HAVING count(*) >= 30) e
        JOIN st s ON s.station_id = start_id JOIN st d ON d.station_id = end_id
        ORDER BY n DESC, start_id, end_id LIMIT 1000""",
    "okpi": f"""
        SELECT count(*) AS n_rides, {cnt("priority_class = 'member'")} AS n_member,
          {cnt("priority_class = 'casual'")} AS n_casual,
          {cnt("status_class = 'classic_bike'")} AS n_classic,
          {cnt("status_class = 'electric_bike'")} AS n_electric,
          {r(mean("days_open"), 1)} AS avg_min, {r("median(days_open)", 1)} AS p50_min,
          (SELECT count(DISTINCT supply_id) FROM oc
           WHERE supply_x IS NOT NULL AND supply_y IS NOT NULL) AS active_stations,
          {pct(cnt("status_class = 'electric_bike' AND demand_id IS NULL"),
               cnt("status_class = 'electric_bike'"))} AS electric_offstation_pct,
          (SELECT date FROM odaily ORDER BY n DESC, date LIMIT 1) AS peak_date,
          (SELECT max(n) FROM odaily) AS peak_day_rides, (SELECT count(*) FROM odaily) AS n_days
        FROM oc""",
    # experiment
    "days": "SELECT origin AS unit, date, count(*) AS n FROM ev WHERE origin IS NOT NULL GROUP BY ALL",
    "panel": f"""
        SELECT unit, y_pre1, y_pre2, y_post FROM (
          SELECT unit, sum(n) FILTER (WHERE {PRE1}) AS n_sel,
            avg(n) FILTER (WHERE {PRE1}) AS y_pre1, avg(n) FILTER (WHERE {PRE2}) AS y_pre2,
            avg(n) FILTER (WHERE {POST}) AS y_post FROM days GROUP BY unit)
        WHERE n_sel >= 30 AND y_pre1 IS NOT NULL AND y_pre2 IS NOT NULL AND y_post IS NOT NULL""",
    "fit": """
        SELECT count(*) AS n_units, avg(y_pre1) AS mu0, stddev_samp(y_pre1) AS sd0,
          covar_samp(y_pre2, y_pre1) / var_samp(y_pre1) AS theta, corr(y_pre2, y_pre1) AS rho
        FROM panel""",
    "resid": """
        SELECT stddev_samp(y_pre2 - theta * (y_pre1 - mu0)) AS resid_sd FROM panel, fit""",
    "pow": f"""
        SELECT mu0, sd0, {2 * ZS * ZS!r} / pow(0.05 * mu0 / sd0, 2) + {ZA * ZA / 4!r} AS n_needed,
          n_per_arm, es * sd0 AS mde_abs, es * sd0 / mu0 AS mde_pct, theta, rho, resid_sd,
          es * resid_sd AS mde_abs_adj, es * resid_sd / mu0 AS mde_pct_adj
        FROM (SELECT *, {ZS!r} * sqrt(2 / (n_per_arm - {ZA * ZA / 4!r})) AS es FROM (
          SELECT *, CASE WHEN n_units >= 12 THEN n_units // 2 - 5 END::BIGINT AS n_per_arm FROM fit, resid))""",
    "adj": "SELECT unit, y_post - theta * (y_pre1 - mu0) AS y_adj FROM panel, fit",
    "ordered": """
        SELECT *, row_number() OVER (ORDER BY y_pre1, unit) AS rn, count(*) OVER () AS total
        FROM panel""",
    "arms": f"""
        SELECT unit, pair, CASE WHEN (rn % 2 = 1) =
            ({hex_int(f"substr({digest('pair', purpose='coin')}, 1, 1)")} % 2 = 0)
          THEN 'treat' ELSE 'control' END AS arm
        FROM (SELECT *, ((rn + 1) // 2)::BIGINT AS pair FROM ordered) WHERE pair * 2 <= total""",
    "scn": """
        SELECT unit, arm, y_pre1, y_scn, y_scn - theta * (y_pre1 - mu0) AS y_adj FROM (
          SELECT p.unit, a.arm, p.y_pre1, f.theta, f.mu0,
            p.y_post * CASE WHEN arm = 'treat' THEN 1 + 1.25 * mde_pct_adj ELSE 1 END AS y_scn
          FROM panel p JOIN arms a USING (unit), pow, fit f)""",
    "chg": f"""
        SELECT unit, arm, post * CASE WHEN arm = 'treat' THEN 0.98 ELSE 1 END - pre AS change FROM (
          SELECT origin AS unit, {mean("value", PRE1)} AS pre, {mean("value", POST)} AS post
          FROM ev GROUP BY origin) JOIN arms USING (unit)
        WHERE pre IS NOT NULL AND post IS NOT NULL""",
    "perm": permuted("split"),
    "gap_perm": permuted("gap"),
    "rate": f"""
        SELECT arm, count(*) AS n_all, count(*) FILTER (WHERE destination IS NULL) AS n_event
        FROM ev JOIN arms ON origin = unit
        WHERE {POST} AND vehicle_class = 'electric_bike' GROUP BY arm""",
}

# Each common table's direct needs.
NEEDS = {
    "ev": (), "raw_or": (), "classed": ("raw_or",), "oc": ("classed",), "cube": ("ev",),
    "ocube": ("oc",), "daily": ("ev",), "odaily": ("oc",), "hist": ("ev",), "sides": ("oc",),
    "station_name": ("sides",), "all_st": ("sides", "station_name"), "st": ("all_st",),
    "od": ("oc", "st"), "okpi": ("oc", "odaily"), "days": ("ev",), "panel": ("days",),
    "fit": ("panel",), "resid": ("panel", "fit"), "pow": ("fit", "resid"), "adj": ("panel", "fit"),
    "ordered": ("panel",), "arms": ("ordered",), "scn": ("panel", "arms", "pow", "fit"),
    "chg": ("ev", "arms"), "perm": ("panel",), "gap_perm": ("panel",), "rate": ("ev", "arms"),
}


def sql(body: str, *tables: str, **local: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS[name]:
            visit(need)
        if name not in order:
            order.append(name)

    for t in tables:
        visit(t)
    parts = [f"{t} AS MATERIALIZED ({CTE[t]})" for t in order]
    parts += [f"{k} AS MATERIALIZED ({v})" for k, v in local.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def weekend_hours() -> str:
    return "SELECT dow >= 6 AS weekend, hour FROM ev"


RULES = ("'(0, 1440] minutes' AS duration, 'one row kept per trip id' AS dup, "
         "'missing stations and coordinates are kept as null' AS null_station_keep")


# --- tests ---------------------------------------------------------------------------------------

def welch_sql(source: str, value: str, group: str, a: str, b: str, extra: str = "",
              rename: str = "diff", source_tables: tuple[str, ...] = (), **local: str) -> str:
    def side(s: str, label: str) -> str:
        cond = f"FILTER (WHERE {group} = '{label}')"
        return (f"count({value}) {cond} AS n_{s}, avg({value}) {cond} AS mean_{s}, "
                f"var_samp({value}) {cond} AS var_{s}")
    moments = f"SELECT {side('a', a)}, {side('b', b)} FROM {source}"
    tested = """SELECT *, mean_a - mean_b AS diff, sqrt(var_a / n_a + var_b / n_b) AS se,
        (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS t,
        pow(var_a / n_a + var_b / n_b, 2) / (pow(var_a / n_a, 2) / (n_a - 1)
          + pow(var_b / n_b, 2) / (n_b - 1)) AS df,
        (mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2))
          AS cohen_d FROM moments"""
    body = f"""SELECT n_a, n_b, {r('mean_a')} AS mean_a, {r('mean_b')} AS mean_b,
        {r('var_a')} AS var_a, {r('var_b')} AS var_b, {r('diff')} AS {rename}, {r('se')} AS se,
        {r('t')} AS t, {r('df')} AS df, {r('cohen_d')} AS cohen_d,
        {r(f'diff - {ZA!r} * se')} AS ci_lo, {r(f'diff + {ZA!r} * se')} AS ci_hi,
        {r(t_p('t', 'df'))} AS p {extra} FROM tested"""
    return sql(body, *source_tables, **local, moments=moments, tested=tested)


CHI2 = {
    "r_tot": "SELECT rk, sum(n) AS rn FROM tab GROUP BY rk",
    "c_tot": "SELECT ck, sum(n) AS cn FROM tab GROUP BY ck",
    "grid": """SELECT coalesce(n, 0) AS o, rn * cn / (SELECT sum(n) FROM tab)::DOUBLE AS e
        FROM (SELECT * FROM r_tot, c_tot) LEFT JOIN tab USING (rk, ck)""",
}


def chi2_value(yates: bool) -> str:
    gap = "greatest(abs(o - e) - 0.5, 0)" if yates else "(o - e)"
    return f"(SELECT sum(pow({gap}, 2) / e) FROM grid)"


def chi2_sql(tab: str, dof: int, *tables: str) -> str:
    body = f"""SELECT (SELECT sum(n) FROM tab)::BIGINT AS n, {dof}::BIGINT AS dof, {r('chi2')} AS chi2,
        {r('sqrt(chi2 / (SELECT sum(n) FROM tab))')} AS cramers_v, {r(chi2_p('chi2', dof))} AS p
        FROM (SELECT {chi2_value(dof == 1)} AS chi2)"""
    return sql(body, *tables, tab=tab, **CHI2)


def bootstrap_sql(metric_sql: str, value: str, agg: str, name: str, *tables: str) -> str:
    """n-of-n draws per arm with the keyed generator."""
    dig = digest("arm", "rn", purpose="draw")
    local = {
        "src": metric_sql,
        "num": f"SELECT *, row_number() OVER (PARTITION BY arm ORDER BY {digest('unit', purpose='slot')}, unit) AS rn, "
               "count(*) OVER (PARTITION BY arm) AS total FROM src",
        "slots": f"SELECT arm, total, {slope(dig)} AS sl, {offset(dig)} AS os FROM num",
        "draws": f"SELECT arm, i, (sl * (2 * i + 1) + os) % {P} % total + 1 AS rn "
                 "FROM slots, range(0, 2000) AS it(i)",
        "means": f"SELECT i, arm, avg({value}) AS m FROM draws JOIN num USING (arm, rn) GROUP BY ALL",
        "reps": f"SELECT i, {agg} AS v FROM (SELECT i, max(m) FILTER (WHERE arm = 'treat') AS mt, "
                "max(m) FILTER (WHERE arm = 'control') AS mc FROM means GROUP BY i)",
    }
    return sql(interval_body("reps", "v"), *tables, **local)


def interval_body(source: str, v: str) -> str:
    return f"""SELECT count({v}) AS iterations, {r(f'avg({v})')} AS boot_mean,
        {r(f'stddev_samp({v})')} AS boot_sd, {r(f'quantile_cont({v}, 0.025)')} AS ci_lo,
        {r(f'quantile_cont({v}, 0.975)')} AS ci_hi FROM {source}"""


RATE_TAB = """SELECT arm AS rk, true AS ck, n_event AS n FROM rate
    UNION ALL SELECT arm, false, n_all - n_event FROM rate"""
RATE_ROW = f"""SELECT
    (SELECT n_event::DOUBLE / n_all FROM rate WHERE arm = 'treat') AS rate_treat,
    (SELECT n_event::DOUBLE / n_all FROM rate WHERE arm = 'control') AS rate_control,
    {chi2_value(True)} AS chi2"""


def welch_row(value: str, source: str) -> str:
    """Two-arm moments, t, df and p in one row."""
    cond = {s: f"FILTER (WHERE arm = '{a}')" for s, a in (("a", "treat"), ("b", "control"))}
    m = ", ".join(f"count({value}) {c} AS n_{s}, avg({value}) {c} AS mean_{s}, "
                  f"var_samp({value}) {c} AS var_{s}" for s, c in cond.items())
    return f"""SELECT *, {t_p('t', 'df')} AS p FROM (
        SELECT *, (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS t,
          pow(var_a / n_a + var_b / n_b, 2) / (pow(var_a / n_a, 2) / (n_a - 1)
            + pow(var_b / n_b, 2) / (n_b - 1)) AS df
        FROM (SELECT {m} FROM {source}))"""


DECISION_TABLES = ("scn", "chg", "rate", "pow")
DECISION_LOCAL = {
    "tab": RATE_TAB, **CHI2, "rr": RATE_ROW,
    "rrp": f"SELECT *, {chi2_p('chi2', 1)} AS p FROM rr",
    "wa": welch_row("y_adj", "scn"), "wn": welch_row("y_scn", "scn"),
    "wd": welch_row("change", "chg"),
    "dec": """
      SELECT 1 AS ord, 'primary: daily starts per unit, adjusted' AS metric, wn.mean_b AS control,
        wn.mean_b * wa.mean_a / wa.mean_b AS treatment, wa.mean_a / wa.mean_b - 1 AS change, wa.p,
        'positive, design effect ' || CAST(round(CAST(100 * mde_pct_adj AS DECIMAL(38,10)), 1)::DOUBLE
          AS VARCHAR) || '%' AS threshold,
        CASE WHEN wa.p < 0.05 AND wa.mean_a / wa.mean_b - 1 > 0 THEN 'pass' ELSE 'fail' END AS verdict
      FROM wa, wn, pow
      UNION ALL SELECT 2, 'reference: unadjusted', mean_b, mean_a, mean_a / mean_b - 1, p, 'none',
        'not used for the decision' FROM wn
      UNION ALL SELECT 3, 'guardrail: mean minutes, change before to after', mean_b, mean_a,
        mean_a - mean_b, p, 'absolute difference at most 0.5 minutes',
        CASE WHEN abs(mean_a - mean_b) <= 0.5 THEN 'pass' ELSE 'violated' END FROM wd
      UNION ALL SELECT 4, 'guardrail: electric off-station rate', rate_control, rate_treat,
        rate_treat / rate_control - 1, p, 'at most 5% worse',
        CASE WHEN p > 0.05 OR rate_treat <= rate_control OR abs(rate_treat / rate_control - 1) <= 0.05
          THEN 'pass' ELSE 'violated' END FROM rrp""",
}
SRM_CHI2 = ("(pow(n_treat - (n_treat + n_control) / 2.0, 2) + pow(n_control - (n_treat + n_control) / 2.0, 2))"
            " / nullif((n_treat + n_control) / 2.0, 0)")
SRM_ROW = """SELECT count(*) FILTER (WHERE arm = 'treat') AS n_treat,
    count(*) FILTER (WHERE arm = 'control') AS n_control FROM arms"""

AA_LOCAL = {
    "halves": "SELECT iteration, y_adj, rn <= total // 2 AS first FROM perm JOIN adj USING (unit)",
    "aam": """SELECT iteration, count(*) FILTER (WHERE first) AS n_a,
        count(*) FILTER (WHERE NOT first) AS n_b,
        avg(y_adj) FILTER (WHERE first) - avg(y_adj) FILTER (WHERE NOT first) AS diff,
        var_samp(y_adj) FILTER (WHERE first) AS va, var_samp(y_adj) FILTER (WHERE NOT first) AS vb
        FROM halves GROUP BY iteration""",
    "aat": """SELECT *, diff / sqrt(va / n_a + vb / n_b) AS t,
        pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1))
        AS df FROM aam""",
    "aap": f"SELECT *, {t_p('t', 'df')} AS p FROM aat",
}

WEEKEND_TAB = "SELECT weekend AS rk, hour AS ck, count(*) AS n FROM (" + weekend_hours() + ") GROUP BY ALL"


def describe(value: str, by: str, source: str) -> str:
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}count({value}) AS n, {r(mean(value))} AS mean,
        {r(f'stddev_samp({value})')} AS sd, {r(f'min({value})')} AS min,
        {r(f'quantile_cont({value}, 0.25)')} AS p25, {r(f'quantile_cont({value}, 0.5)')} AS p50,
        {r(f'quantile_cont({value}, 0.75)')} AS p75, {r(f'quantile_cont({value}, 0.9)')} AS p90,
        {r(f'max({value})')} AS max FROM {source} {'GROUP BY ' + by if by else ''}"""


def month_axis(cols: str, source: str, where: str = "true") -> str:
    names = [c.split(" AS ")[-1].strip() for c in cols.split(";")]
    filled = ", ".join(f"coalesce({n}, 0) AS {n}" for n in names)
    inner = ", ".join(cols.split(";"))
    return f"""SELECT m AS month, {filled} FROM range(1, 13) AS ax(m) LEFT JOIN (
        SELECT month, {inner} FROM {source} WHERE {where} GROUP BY month) g ON g.month = ax.m"""


def cards(period: int, rider: str) -> str:
    sel = "true" if rider == "all" else f"member = '{rider}'"
    day = {"all": "n", "casual": "n - n_member", "member": "n_member"}[rider]
    scope = f"month = {period}" if period else "true"
    in_days = f"month(CAST(date AS DATE)) = {period}" if period else "true"
    return sql(f"""SELECT {nsum(sel)} AS n_rides, {pct(nsum("member = 'member'"), 'sum(n)')} AS member_share,
        {pct(f"sum(CAST(sum_min AS DECIMAL(18,1))) FILTER (WHERE {sel})", nsum(sel), 1)} AS avg_min,
        {pct(nsum(f"{sel} AND bike = 'electric_bike'"), nsum(sel))} AS electric_share,
        (SELECT {pct(f'sum({day})', 'count(*)', 1, 0)} FROM odaily WHERE {in_days}) AS avg_per_day,
        any_value(p50_min) AS p50_min, any_value(active_stations) AS active_stations,
        any_value(peak_date) AS peak_date, any_value(peak_day_rides) AS peak_day_rides
        FROM ocube, okpi WHERE {scope}""", "ocube", "odaily", "okpi")


ROLLUP = "sum(n)::BIGINT AS n, CAST(sum(CAST(sum_min AS DECIMAL(18,1))) AS DOUBLE) AS sum_min"
AVG = pct("sum(CAST(sum_min AS DECIMAL(18,1)))", "sum(n)", 1)
AXIS168 = """SELECT d AS dow, h AS hour, coalesce(n, 0)::BIGINT AS n
    FROM range(1, 8) AS a(d), range(0, 24) AS b(h)
    LEFT JOIN (SELECT dow, hour, sum(n) AS n FROM cube WHERE {0} GROUP BY ALL) g
      ON g.dow = d AND g.hour = h"""

ORACLE: dict[str, str] = {
    # --- cleaning and sources
    "clean_trips": sql("""SELECT trip_key, status_class, priority_class, ordered_ts, shipped_ts, days_open,
        date, hour, dow, day_type, month, year, supply_id, supply_name, supply_y, supply_x,
        demand_id, demand_name, demand_y, demand_x FROM oc""", "oc"),
    "audit_classes": sql("SELECT cls AS audit_class, count(*) AS n FROM classed GROUP BY cls", "classed"),
    "quality_report": sql(f"""SELECT 2024::BIGINT AS year, n_raw, n_distinct_ride_id, dropped_bad_time,
        dropped_bad_duration, dropped_bad_enum, n_raw - n_distinct_ride_id AS n_duplicate_rides,
        n_good - n_clean AS n_removed_as_duplicate, n_clean,
        {pct('n_raw - n_clean', 'n_raw', 100, 3)} AS drop_rate_pct, {RULES} FROM (
        SELECT count(*) AS n_raw, count(DISTINCT trip_key) AS n_distinct_ride_id,
          {cnt("cls = 'bad_time'")} AS dropped_bad_time,
          {cnt("cls = 'bad_duration'")} AS dropped_bad_duration,
          {cnt("cls = 'bad_enum'")} AS dropped_bad_enum, {cnt("cls = 'good'")} AS n_good,
          (SELECT count(*) FROM oc) AS n_clean FROM classed)""", "classed", "oc"),
    "dup_keys": sql("""SELECT copies, count(*) AS n_keys FROM (
        SELECT trip_key, count(*) AS copies FROM raw_or GROUP BY trip_key) GROUP BY copies""", "raw_or"),
    "distinct_trips": sql("SELECT count(DISTINCT trip_key) AS n_distinct FROM raw_or", "raw_or"),
    "landing_audit": """SELECT count(*) AS n_rows, 0::BIGINT AS n_bad_files, 0::BIGINT AS max_missing
        FROM events""",
    "landed_clean": sql(f"""SELECT event_id AS ride_id, rider_class AS member_casual,
        floor(value) AS duration_min, date, hour, dow, day_type, period AS month, 2024::BIGINT AS year,
        origin AS start_station_id, value AS start_lat
        FROM ev WHERE event_id % 97 <> 0 AND floor(value) > 0 AND floor(value) <= 1440""", "ev"),
    "partition_filtered_read": sql(
        "SELECT trip_key, month, days_open FROM oc WHERE month IN (1, 7)", "oc"),
    "metric_round_trip": sql("SELECT * FROM cube", "cube"),
    "sample_trips": sql(f"""SELECT event_id, period, value FROM ev WHERE period IN (1, 3)
        AND {hex_int(f"substr({digest('event_id', seed=42)}, 1, 8)")} / 4294967296.0 < 0.1""", "ev"),
    # --- metric tables
    "fact_cube": sql("SELECT * FROM cube", "cube"),
    "cube_from_facts": sql("SELECT * FROM cube", "cube"),
    "cube_rollups": sql(
        f"SELECT member, dow >= 6 AS weekend, hour, {ROLLUP} FROM cube GROUP BY ALL", "cube"),
    "cube_grouping_sets": sql(f"""SELECT month, hour, dow, member, bike,
        grouping(month, hour, dow, member, bike)::BIGINT AS level, {ROLLUP} FROM cube GROUP BY GROUPING SETS
        ((month), (hour), (dow, hour), (month, member, bike), (member, bike), ())""", "cube"),
    "period_summary": sql(f"""SELECT month, count(*) AS n, {r(mean('days_open'), 1)} AS avg_min,
        {r('median(days_open)', 1)} AS p50_min, {cnt("priority_class = 'casual'")} AS n_casual,
        {cnt("priority_class = 'member'")} AS n_member,
        {cnt("status_class = 'classic_bike'")} AS n_classic,
        {cnt("status_class = 'electric_bike'")} AS n_electric,
        {pct(cnt("status_class = 'electric_bike'"), 'count(*)')} AS electric_share
        FROM oc GROUP BY month""", "oc"),
    "daily_summary": sql("SELECT * FROM daily", "daily"),
    "duration_hist": sql("SELECT * FROM hist", "hist"),
    "bucket_labels": sql("SELECT DISTINCT bucket, bucket_ord FROM hist", "hist"),
    "station_profile": sql("SELECT * FROM st", "st"),
    "station_profile_full": sql("SELECT * FROM all_st", "all_st"),
    "od_flows": sql("SELECT * FROM od", "od"),
    "kpi": sql("SELECT * FROM okpi", "okpi"),
    # --- dashboard and report
    "heat_week_hour": sql(AXIS168.format("true"), "cube"),
    "heat_week_hour_slice": sql(AXIS168.format("month = 2 AND member = 'member'"), "cube"),
    "kpi_cards": cards(0, "all"),
    "kpi_cards_period_rider": cards(3, "casual"),
    "monthly_stack": sql(month_axis(
        f"""{nsum("member = 'member'")} AS n_member;{nsum("member = 'casual'")} AS n_casual;"""
        f"""{pct(nsum("bike = 'electric_bike'"), 'sum(n)')} AS electric_share""", "ocube"), "ocube"),
    "monthly_stack_sparse": sql(month_axis(
        f"""{nsum("member = 'member'")} AS n_member;{nsum("member = 'casual'")} AS n_casual;"""
        f"""{pct(nsum("bike = 'electric_bike'"), 'sum(n)')} AS electric_share""",
        "cube", "member = 'member'"), "cube"),
    "daily_split": sql("""SELECT date, CASE WHEN day_type = 'weekday' THEN n - n_member END AS weekday,
        CASE WHEN day_type <> 'weekday' THEN n - n_member END AS weekend FROM daily""", "daily"),
    "hour_curves": sql(f"""SELECT h AS hour, coalesce(a, 0) AS member_weekday, coalesce(b, 0) AS member_weekend,
        coalesce(c, 0) AS casual_weekday, coalesce(d, 0) AS casual_weekend
        FROM range(0, 24) AS ax(h) LEFT JOIN (SELECT hour,
          {nsum("member = 'member' AND dow < 6")} AS a, {nsum("member = 'member' AND dow >= 6")} AS b,
          {nsum("member = 'casual' AND dow < 6")} AS c, {nsum("member = 'casual' AND dow >= 6")} AS d
          FROM cube GROUP BY hour) g ON g.hour = h""", "cube"),
    "hour_avg": sql(f"""SELECT h AS hour, coalesce(v, 0) AS avg_min FROM range(0, 24) AS ax(h) LEFT JOIN (
        SELECT hour, {AVG} AS v FROM cube WHERE month = 1 AND member = 'member' GROUP BY hour) g
        ON g.hour = h""", "cube"),
    "bucket_by_rider": sql(f"""SELECT bucket, bucket_ord,
        {nsum("month = 2 AND member = 'member'")} AS n_member,
        {nsum("month = 2 AND member = 'casual'")} AS n_casual FROM hist GROUP BY ALL""", "hist"),
    "top_stations": sql("""SELECT station_id, name, starts - starts_member AS starts_value FROM st
        ORDER BY starts_value DESC, station_id LIMIT 15""", "st"),
    "net_extremes": sql("""(SELECT station_id, name, ends_member - starts_member AS net_value FROM st
        ORDER BY net_value DESC, station_id LIMIT 6) UNION ALL
        (SELECT station_id, name, ends_member - starts_member AS net_value FROM st
        ORDER BY net_value, station_id LIMIT 6)""", "st"),
    "top_corridors": sql(f"""SELECT start_id, end_id, s_name || ' → ' || e_name AS label,
        s_lng, s_lat, e_lng, e_lat, n - n_member AS volume,
        {r("greatest(1, CASE WHEN n > n_member THEN log2(n - n_member) ELSE 0 END - 3)")} AS weight
        FROM (SELECT * FROM od ORDER BY n DESC, start_id, end_id LIMIT 60)""", "od"),
    "station_map": sql(f"""SELECT station_id, name, lat, lng, starts_member AS starts_value,
        ends_member - starts_member AS net_value, {r('sqrt(starts_member)')} AS weight FROM st""", "st"),
    "station_bbox": sql(f"""SELECT {r('min(lng) - 0.01')} AS x_min, {r('max(lng) + 0.01')} AS x_max,
        {r('min(lat) - 0.01')} AS y_min, {r('max(lat) + 0.01')} AS y_max FROM st""", "st"),
    "net_scale": sql("""SELECT greatest(1, max(abs((ends - ends_member) - (starts - starts_member))))
        AS net_max FROM st""", "st"),
    "class_structure": sql(month_axis(
        ";".join(f"""{nsum(f"member = '{m}' AND bike = '{b}_bike'")} AS {m}_{b}"""
                 for m in ("member", "casual") for b in ("classic", "electric")),
        "cube", "month = 2"), "cube"),
    "avg_grid": sql(f"SELECT member, bike, {AVG} AS avg_min FROM cube GROUP BY ALL", "cube"),
    "share_by_daytype": sql(
        f"SELECT dow >= 6 AS weekend, {pct('sum(n - n_member)', 'sum(n)', 100, 2)} AS share FROM daily GROUP BY ALL",
        "daily"),
    "share_by_period": sql(
        f"""SELECT month, {pct(nsum("bike = 'electric_bike'"), 'sum(n)', 100, 2)} AS share
        FROM cube GROUP BY month""", "cube"),
    "first_last_share": sql(
        "SELECT (SELECT share FROM s ORDER BY month LIMIT 1) AS first_share, "
        "(SELECT share FROM s ORDER BY month DESC LIMIT 1) AS last_share",
        "ocube", s=f"""SELECT month, {pct(nsum("bike = 'electric_bike'"), 'sum(n)', 100, 2)} AS share
        FROM ocube GROUP BY month"""),
    "peak_hours": sql("""(SELECT hour, n, 'weekday' AS scope FROM wd ORDER BY n DESC, hour LIMIT 1)
        UNION ALL (SELECT hour, n, 'weekday morning' FROM wd WHERE hour BETWEEN 6 AND 10
        ORDER BY n DESC, hour LIMIT 1)""", "cube",
        wd="SELECT hour, sum(n)::BIGINT AS n FROM cube WHERE dow <= 5 GROUP BY hour"),
    "busiest_day_by_type": sql("""SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (
        PARTITION BY day_type ORDER BY n DESC, date) AS k FROM daily) WHERE k = 1""", "daily"),
    "insight": sql(f"""SELECT n_rides, {pct('n_member', 'n_member + n_casual')} AS member_share,
        {pct('n_electric', 'n_rides')} AS electric_share, electric_offstation_pct FROM okpi""", "okpi"),
    "narrative_numbers": sql(f"""SELECT
        {pct(nsum("member = 'member'"), 'sum(n)')} AS member_share,
        {pct(nsum("bike = 'electric_bike'"), 'sum(n)')} AS electric_share,
        {pct("sum(CAST(sum_min AS DECIMAL(18,1))) FILTER (WHERE member = 'member')", nsum("member = 'member'"), 1)}
          AS member_avg_min,
        {pct("sum(CAST(sum_min AS DECIMAL(18,1))) FILTER (WHERE member = 'casual')", nsum("member = 'casual'"), 1)}
          AS casual_avg_min,
        {pct(nsum("member = 'casual' AND dow < 6"), nsum("dow < 6"))} AS weekday_casual_share,
        {pct(nsum("member = 'casual' AND dow >= 6"), nsum("dow >= 6"))} AS weekend_casual_share,
        (SELECT hour FROM ocube WHERE dow < 6 GROUP BY hour ORDER BY sum(n) DESC, hour LIMIT 1) AS peak_hour,
        (SELECT hour FROM ocube WHERE dow < 6 AND hour BETWEEN 6 AND 10 GROUP BY hour
         ORDER BY sum(n) DESC, hour LIMIT 1) AS am_peak_hour,
        {pct(nsum("hour >= 22 OR hour <= 4"), 'sum(n)')} AS night_share,
        (SELECT s_name || ' → ' || e_name FROM od ORDER BY n DESC, start_id, end_id LIMIT 1) AS top_flow,
        (SELECT month FROM mm ORDER BY n DESC, month LIMIT 1) AS peak_month,
        (SELECT month FROM mm ORDER BY n, month LIMIT 1) AS low_month,
        (SELECT {pct('max(n)', 'min(n)', 1, 2)} FROM mm) AS peak_ratio,
        (SELECT e FROM mm ORDER BY month LIMIT 1) AS first_electric_share,
        (SELECT e FROM mm ORDER BY month DESC LIMIT 1) AS last_electric_share,
        (SELECT name FROM st ORDER BY starts DESC, station_id LIMIT 1) AS top_station,
        (SELECT name FROM st ORDER BY net DESC, station_id LIMIT 1) AS top_inflow,
        (SELECT name FROM st ORDER BY net, station_id LIMIT 1) AS top_outflow
        FROM ocube""", "ocube", "st", "od",
        mm=f"""SELECT month, sum(n)::BIGINT AS n, {pct(nsum("bike = 'electric_bike'"), 'sum(n)')} AS e
        FROM ocube GROUP BY month"""),
    # --- description and tests
    "describe_by": sql(describe("value", "rider_class", "ev"), "ev"),
    "describe_periods": sql(describe("days_open", "", "(SELECT * FROM oc WHERE month IN (1, 7))"), "oc"),
    "group_stats": sql(f"""SELECT vehicle_class, rider_class, count(value) AS n, {r(mean('value'))} AS mean,
        {r('median(value)')} AS median FROM ev GROUP BY ALL""", "ev"),
    "row_numbers": sql("""SELECT event_id, value, count(*) OVER () AS total,
        row_number() OVER (ORDER BY value, event_id) AS rn FROM ev""", "ev"),
    "density_hist": sql(f"""SELECT rider_class, b AS bin, b * 1.5::DOUBLE AS lower, coalesce(n, 0) AS n,
        {r('coalesce(n, 0) / (total * 1.5)')} AS density
        FROM (SELECT rider_class, count(*) AS total FROM inr GROUP BY ALL), range(0, 40) AS ax(b)
        LEFT JOIN (SELECT rider_class AS rc, bin, count(*) AS n FROM inr GROUP BY ALL) c
          ON rc = rider_class AND bin = b""", "ev",
        inr="SELECT rider_class, least(39, floor(value / 1.5)) AS bin FROM ev WHERE value BETWEEN 0 AND 60"),
    "welch_t": welch_sql("ev", "value", "rider_class", "member", "casual", source_tables=("ev",)),
    "mann_whitney": sql(f"""SELECT n_a, n_b, {r('rs')} AS rank_sum_a, {r('tie')} AS tie_term, {r('u')} AS u,
        {r('z')} AS z, {r(f"CASE WHEN z <= 0 THEN 1 ELSE {normal_p('z')} END")} AS p FROM (
        SELECT *, (greatest(u, n_a::DOUBLE * n_b - u) - n_a::DOUBLE * n_b / 2 - 0.5) / sqrt(
          n_a::DOUBLE * n_b / 12 * (n_a + n_b + 1 - tie / ((n_a + n_b)::DOUBLE * (n_a + n_b - 1)))) AS z
        FROM (SELECT *, rs - n_a::DOUBLE * (n_a + 1) / 2 AS u FROM (
          SELECT {cnt("rider_class = 'member'")} AS n_a, {cnt("rider_class = 'casual'")} AS n_b,
            sum(mid) FILTER (WHERE rider_class = 'member') AS rs, sum(pow(k::DOUBLE, 2) - 1) AS tie
          FROM ranked)))""", "ev",
        ranked="""SELECT rider_class, count(*) OVER (PARTITION BY value) AS k,
          rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS mid FROM ev"""),
    "bootstrap_diff": sql(interval_body("reps", "v"), "ev",
        cells=f"""SELECT rider_class = 'member' AS a, cell, count(*) AS n, sum(x) AS x FROM (
          SELECT rider_class, CAST(floor(value * 1e6 + 0.5) AS BIGINT) AS x,
            {hex_int(f"substr({digest('event_id', purpose='cell')}, 25, 8)")} % 50000 AS cell FROM ev) GROUP BY ALL""",
        keyed=f"""SELECT a, n, x, {slope('dig')} AS sl, {offset('dig')} AS os FROM (
          SELECT *, {digest('a', 'cell', purpose='weight')} AS dig FROM cells)""",
        drawn=f"""SELECT i, a, sum(w * n) AS w, sum(w * x) AS wx FROM (
          SELECT i, a, n, x, {poisson(f'((sl * (2 * i + 1) + os) % {P})')} AS w
          FROM keyed, range(0, 2000) AS it(i)) GROUP BY ALL""",
        reps="""SELECT i, (max(wx) FILTER (WHERE a))::DOUBLE / (max(w) FILTER (WHERE a))::DOUBLE / 1e6
          - (max(wx) FILTER (WHERE NOT a))::DOUBLE / (max(w) FILTER (WHERE NOT a))::DOUBLE / 1e6 AS v
          FROM drawn GROUP BY i"""),
    # a property, not a recomputation: the bootstrap's spread is the standard error
    "bootstrap_vs_welch": "SELECT unnest(['all rows', 'sub-sample']) AS form, true AS agrees",
    "chi2_hours": chi2_sql(WEEKEND_TAB, 23, "ev"),
    "hour_share": sql(f"""SELECT weekend, hour, n, {r('n / sum(n) OVER (PARTITION BY weekend)')} AS share
        FROM (SELECT weekend, hour, count(*) AS n FROM ({weekend_hours()}) GROUP BY ALL)""", "ev"),
    "chi2_2x2_yates": chi2_sql(
        "SELECT rider_class AS rk, vehicle_class AS ck, count(*) AS n FROM ev GROUP BY ALL", 1, "ev"),
    "stratified_diff": sql(f"""SELECT {r('ma')} AS mean_a, {r('mb')} AS mean_b, {r('d0')} AS diff_stratum_0,
        {r('d1')} AS diff_stratum_1, {r('xa')} AS mix_a, {r('xb')} AS mix_b, {r('ma - mb')} AS diff_overall,
        (ma - mb > 0) <> (d0 > 0 OR d1 > 0) AS simpson_reversed,
        (ma - mb > 0) <> (d0 > 0) AND (ma - mb > 0) <> (d1 > 0) AS all_reversed FROM (
        SELECT avg(value) FILTER (WHERE e) AS ma, avg(value) FILTER (WHERE NOT e) AS mb,
          avg(value) FILTER (WHERE e AND m) - avg(value) FILTER (WHERE NOT e AND m) AS d0,
          avg(value) FILTER (WHERE e AND NOT m) - avg(value) FILTER (WHERE NOT e AND NOT m) AS d1,
          {cnt('e AND NOT m')} / {cnt('e')} AS xa, {cnt('NOT e AND NOT m')} / {cnt('NOT e')} AS xb
        FROM (SELECT value, vehicle_class = 'electric_bike' AS e, rider_class = 'member' AS m FROM ev))""", "ev"),
    # --- experiment
    "select_pool": sql(f"""SELECT origin AS unit, count(*) AS n_selection FROM ev
        WHERE origin IS NOT NULL AND {PRE1} GROUP BY origin HAVING count(*) >= 30""", "ev"),
    "pool_trips": sql(f"""SELECT origin, destination, count(*) AS n FROM ev WHERE origin IN (
        SELECT origin FROM ev WHERE {PRE1} GROUP BY origin HAVING count(*) >= 30) GROUP BY ALL""", "ev"),
    "unit_daily_mean": sql(f"""SELECT unit, {r('avg(n)')} AS y, {r('sum(n) / 10.0')} AS y_calendar
        FROM days WHERE {POST} GROUP BY unit""", "days"),
    "common_units": sql(" INTERSECT ".join(
        f"SELECT origin AS unit FROM ev WHERE vehicle_class = 'classic_bike' AND {w} "
        "GROUP BY origin HAVING count(*) >= 12" for w in (PRE1, PRE2, POST)), "ev"),
    "pool_panel": sql(f"""SELECT unit, {r('y_pre1')} AS y_pre1, {r('y_pre2')} AS y_pre2, {r('y_post')} AS y_post
        FROM panel""", "panel"),
    "panel_summary": sql(f"""SELECT count(*) AS pool_size, {r('avg(y_post)')} AS mean_post,
        {r('stddev_samp(y_post)')} AS sd_post, {r('avg(y_pre1)')} AS mean_pre,
        {r('stddev_samp(y_pre1)')} AS sd_pre FROM panel""", "panel"),
    "cuped": sql(f"""SELECT n_units, {r('mu0')} AS mu0, {r('sd0')} AS sd0, {r('theta')} AS theta,
        {r('rho')} AS rho, {r('resid_sd')} AS resid_sd FROM fit, resid""", "fit", "resid"),
    "cuped_adjusted": sql(f"SELECT unit, {r('y_adj')} AS y_adj FROM adj", "adj"),
    "power_table": sql("SELECT n_per_arm, " + ", ".join(
        f"{r(c)} AS {c}" for c in ("mu0", "sd0", "n_needed", "mde_abs", "mde_pct", "theta", "rho",
                                   "resid_sd", "mde_abs_adj", "mde_pct_adj")) + " FROM pow", "pow"),
    "mde_curve": sql(f"""SELECT k AS n_per_arm,
        {r(f'{ZS!r} * sqrt(2 / (k - {ZA * ZA / 4!r})) * sd0 / mu0')} AS mde_pct
        FROM fit, range(20, 801, 10) AS ax(k)""", "fit"),
    "aa_splits": sql(f"""SELECT iteration, n_a, n_b, {r('diff')} AS diff, {r('t')} AS t, {r('df')} AS df,
        {r('p')} AS p FROM aap""", "perm", "adj", **AA_LOCAL),
    "aa_calibration": sql(f"""SELECT count(*) AS aa_iterations,
        {r('count(*) FILTER (WHERE p < 0.05) / nullif(count(*), 0)')} AS aa_fp_rate,
        {r('median(p)')} AS aa_p_median FROM aap""", "perm", "adj", **AA_LOCAL),
    "randomisation_gap": sql(f"""SELECT {r('stddev_pop(g)')} AS pure_random_sd,
        {r('max(abs(g))')} AS pure_random_max FROM (
        SELECT iteration, avg(y_pre1) FILTER (WHERE rn <= k)
          - avg(y_pre1) FILTER (WHERE rn > k AND rn <= 2 * k) AS g
        FROM (SELECT iteration, rn, y_pre1, CASE WHEN total >= 12 THEN total // 2 - 5 END AS k
              FROM gap_perm JOIN panel USING (unit) WHERE iteration < 200)
        GROUP BY iteration)""", "gap_perm", "panel"),
    "pair_neighbours": sql(f"""SELECT unit, {r('y_pre1')} AS y_pre1, ((rn + 1) // 2)::BIGINT AS pair,
        rn % 2 = 1 AS is_lower FROM ordered WHERE (rn + 1) // 2 * 2 <= total""", "ordered"),
    "block_randomise": sql("SELECT unit, pair, arm FROM arms", "arms"),
    "srm": sql(f"""SELECT n_treat, n_control, {r('c')} AS srm_chi2, {r(chi2_p('c', 1))} AS srm_p,
        {chi2_p('c', 1)} > 0.05 AS srm_ok FROM (SELECT *, {SRM_CHI2} AS c FROM srow)""", "arms", srow=SRM_ROW),
    "baseline_gap": sql(f"""SELECT {r("avg(y_pre1) FILTER (WHERE arm = 'treat') - avg(y_pre1) FILTER (WHERE arm = 'control')")}
        AS blocked_base_gap FROM panel JOIN arms USING (unit)""", "panel", "arms"),
    "readout": welch_sql("scn", "y_adj", "arm", "treat", "control",
                         f", {r('mean_a / mean_b - 1')} AS lift", source_tables=("scn",)),
    "readout_unadjusted": welch_sql("scn", "y_scn", "arm", "treat", "control",
                                    f", {r('mean_a / mean_b - 1')} AS lift", source_tables=("scn",)),
    "bootstrap_ratio": bootstrap_sql("SELECT unit, arm, y_adj FROM scn", "y_adj", "mt / mc - 1", "lift", "scn"),
    "did": welch_sql("chg", "change", "arm", "treat", "control", rename="did", source_tables=("chg",)),
    "bootstrap_did": bootstrap_sql("SELECT unit, arm, change FROM chg", "change", "mt - mc", "diff", "chg"),
    "rate_guardrail": sql(f"""SELECT {r('rate_treat')} AS rate_treat, {r('rate_control')} AS rate_control,
        {r('chi2')} AS chi2, 1::BIGINT AS dof, {r(chi2_p('chi2', 1))} AS p FROM rr""",
        "rate", tab=RATE_TAB, **CHI2, rr=RATE_ROW),
    "guardrails": sql(f"""SELECT {r('mean_a - mean_b')} AS did, {r('wd.p')} AS did_p,
        {r('rate_treat')} AS rate_treat, {r('rate_control')} AS rate_control, {r('rrp.p')} AS rate_p,
        abs(mean_a - mean_b) <= 0.5 AS duration_pass,
        rrp.p > 0.05 OR rate_treat <= rate_control OR abs(rate_treat / rate_control - 1) <= 0.05 AS rate_pass
        FROM wd, rrp""", *DECISION_TABLES, **DECISION_LOCAL),
    "decision_table": sql(f"""SELECT ord::BIGINT AS ord, metric, {r('control')} AS control,
        {r('treatment')} AS treatment, {r('change')} AS change, {r('p')} AS p, threshold, verdict
        FROM dec""", *DECISION_TABLES, **DECISION_LOCAL),
    "launch_decision": sql(f"""SELECT (SELECT bool_and(verdict = 'pass') FROM dec WHERE ord <> 2)
        AND (SELECT {chi2_p(f'({SRM_CHI2})', 1)} > 0.05 FROM srow) AS launch""",
        *DECISION_TABLES, "arms", **DECISION_LOCAL, srow=SRM_ROW),
}

# all twelve periods occur, so a shorter axis changes nothing
ORACLE["monthly_stack_short_axis"] = ORACLE["monthly_stack"]

DAY_PARTS = """SELECT unnest([hour // 5, NULL]) AS day_part, unnest([false, true]) AS pooled, value,
    vehicle_class = 'electric_bike' AS e FROM ev"""
STAGED = "event_id % 97 <> 0 AND floor(value) > 0 AND floor(value) <= 1440"
ORACLE |= {
    "landing_audit_periods": sql("""SELECT period AS month, count(*) AS n_rows, 0::BIGINT AS n_missing,
        true AS all_ok FROM ev GROUP BY period""", "ev"),
    "landing_audit_quoted": sql("""SELECT period, count(*) AS n_rows, 'extra' AS missing FROM ev GROUP BY period""", "ev"),
    "metric_round_trip_csv": sql("SELECT * FROM cube", "cube"),
    "metric_order": sql("""SELECT unnest(['parquet', 'json', 'csv']) AS format, date, n,
        row_number() OVER (ORDER BY n DESC, date) AS position FROM daily""", "daily"),
    "stratified_diff_k": sql(f"""SELECT day_part, pooled, {cnt('e')} AS n_a, {cnt('NOT e')} AS n_b,
        {r(mean('value', 'e'))} AS mean_a, {r(mean('value', 'NOT e'))} AS mean_b,
        {r(mean('value', 'e') + ' - ' + mean('value', 'NOT e'))} AS diff,
        {r(f"{cnt('e')} / (SELECT {cnt('e')} FROM parts WHERE pooled)")} AS share_a,
        {r(f"{cnt('NOT e')} / (SELECT {cnt('NOT e')} FROM parts WHERE pooled)")} AS share_b
        FROM parts GROUP BY ALL""", "ev", parts=DAY_PARTS),
    "stratified_verdict_k": sql(f"""SELECT (SELECT count(*) FROM d WHERE NOT pooled) AS n_strata,
        (SELECT count(*) FROM d WHERE NOT pooled AND diff > 0) AS n_positive, {r('p.diff')} AS diff_overall,
        (p.diff > 0) <> EXISTS (SELECT 1 FROM d WHERE NOT pooled AND diff > 0) AS simpson_reversed,
        NOT EXISTS (SELECT 1 FROM d WHERE NOT pooled AND (diff > 0) = (p.diff > 0)) AS all_reversed
        FROM d AS p WHERE p.pooled""", "ev", parts=DAY_PARTS,
        d=f"SELECT day_part, pooled, {mean('value', 'e')} - {mean('value', 'NOT e')} AS diff FROM parts GROUP BY ALL"),
    "read_fallback": sql("SELECT trip_key, month, days_open FROM oc", "oc"),
    "clean_stage_report": f"""SELECT 2024::BIGINT AS year, n_raw, n_distinct_ride_id, dropped_bad_time,
        dropped_bad_duration, 0::BIGINT AS dropped_bad_enum, n_raw - n_distinct_ride_id AS n_duplicate_rides,
        n_good - n_clean AS n_removed_as_duplicate, n_clean,
        {pct('n_raw - n_clean', 'n_raw', 100, 3)} AS drop_rate_pct, {RULES} FROM (
        SELECT count(*) AS n_raw, count(DISTINCT event_id) AS n_distinct_ride_id,
          {cnt('event_id % 97 = 0')} AS dropped_bad_time,
          {cnt('event_id % 97 <> 0 AND (floor(value) <= 0 OR floor(value) > 1440)')} AS dropped_bad_duration,
          {cnt(STAGED)} AS n_good, count(DISTINCT event_id) FILTER (WHERE {STAGED}) AS n_clean FROM events)""",
    "metric_stage_tables": sql("""SELECT 'cube' AS name, count(*) AS n_rows FROM ocube
        UNION ALL SELECT 'daily', count(*) FROM odaily UNION ALL SELECT 'kpi', 1
        UNION ALL SELECT 'monthly', count(DISTINCT month) FROM oc
        UNION ALL SELECT 'stations', count(*) FROM st UNION ALL SELECT 'od', count(*) FROM od""",
        "ocube", "odaily", "oc", "st", "od"),
    "experiment_record": sql("""SELECT (SELECT count(*) FROM ev) AS n_rides, n_treat, n_control,
        '2024-01-21' AS window_first, 30::BIGINT AS pool_min_starts FROM srow""", "ev", "arms", srow=SRM_ROW),
    "experiment_decision_csv": ORACLE["decision_table"],
    "approx_medians_within": sql("""SELECT DISTINCT month, true AS within FROM oc
        UNION ALL SELECT NULL, true""", "oc"),
    "approx_distinct_within": "SELECT true AS within",
    "sample_native_within": "SELECT 0::BIGINT AS n_outside, true AS size_within",
}
