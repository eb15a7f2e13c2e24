"""Registered queries over the fixture tables, with equivalent SQL.

Results are rounded so that two engines' last bits do not differ.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar import constants as c
from isobar.field import Field, FieldMeta, duplicate_keys, missing_keys
from isobar.functions import atmo
from isobar.operators import checked, columns, dynamics, gis, lateral, projections, stagger, timeops, triangles, vertical
from isobar.sources import catalog as runs
from isobar.__main__ import regrid
from isobar.session import scratch
from isobar.sources import fixtures as fx
from isobar.sources import gridmsg, slabs
from isobar.streaming import runs as streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

CUBE = """
with src as (select vec_id, embedding from embeddings where len(embedding) = 64),
long as (select (vec_id % 20)::int as x, (vec_id // 20)::int as y, generate_subscripts(embedding, 1)::int as k, unnest(embedding)::double as e,
         list_reverse(embedding) as back from src),
half as (select x, y, k, e, back[k]::double as e_up, 20155 - 310 * k + 5 * e as hhl, e as w, 20000 * (1 - k / 64.0::double) as ak,
         (k / 64.0::double) * (k / 64.0::double) as bk from long),
mid as (select *, 0.5 * (hhl + lead(hhl) over (partition by x, y order by k)) as hfl from half),
every as (select *, 288.15::double - 0.0065::double * hfl + 10 * e as t, 100000 * exp(-hfl / 8000) as p, 10 * e as u, 10 * e_up as v,
         0.005::double * exp(-hfl / 2500) * (1 + abs(e)) as qv, 1e-5 * abs(e) as qc, 5e-6 * abs(e) as qi from mid),
cube as (select * from every where hfl is not null),
surf as (select x, y, hhl as hsurf, 288.15::double - 0.0065::double * hhl + 10 * e as t, 100000 * exp(-hhl / 8000) as ps,
         case when (y * 20 + x) % 7 <> 0 then hhl end as gap from half where k = 64)
"""
HOURLY = """
with ev as (select date_trunc('day', ts)::timestamp as ref_time, hour(ts)::int as lead_h, sum(value) as amount from events group by all),
days as (select unnest(generate_series(min(ref_time), max(ref_time), interval 1 day)) as ref_time from ev),
grid as (select ref_time, h::int as lead_h from days, range(24) s(h)),
filled as (select g.ref_time, g.lead_h, (g.lead_h * 3600)::bigint as lead_s, coalesce(amount, 0)::double as amount from grid g left join ev using (ref_time, lead_h)),
acc as (select *, sum(amount) over (partition by ref_time order by lead_h) as acc from filled),
series as (select strftime(ref_time, '%Y-%m-%d') as day, *, acc / (lead_h + 1) as avg from acc)
"""
CELLS = """
with cells as (select c_custkey as cell, 5.5::double + (c_custkey * 37 % 1140) / 100.0::double as lon, 43.6::double + (c_custkey * 91 % 640) / 100.0::double as lat,
               c_acctbal::double as value, c_custkey % 20 as strip from customer)
"""


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return put


def _rounded(df: DataFrame, keys: list[str], values: dict[str, object], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(v) if isinstance(v, str) else v, digits).alias(n) for n, v in values.items()])


def _cube_query(name: str, spark_value, sql_value: str, digits: int = 6) -> None:
    """A column expression on the full-level cube."""
    @query(name, f"{CUBE} select x, y, k, round({sql_value}, {digits}) as value from cube")
    def run(spark, sf_dir):
        return _rounded(fx.full_levels(spark, sf_dir), ["x", "y", "k"], {"value": spark_value()}, digits)


# --- scalar functions -------------------------------------------------------------------------

SQL_WATER = "611.21::double * exp(17.502::double * (t - 273.16::double) / (t - 32.19::double))"
SQL_ICE = "611.21::double * exp(22.587::double * (t - 273.16::double) / (t + 0.7::double))"
SQL_BLEND = "pow((t - 250.16::double) / 23, 2)"
SQL_MIXED = f"case when t > 273.16 then {SQL_WATER} when t < 250.16 then {SQL_ICE} else {SQL_BLEND} * {SQL_WATER} + (1 - {SQL_BLEND}) * {SQL_ICE} end"
SQL_THETA = f"(t * pow(1e5 / p, {c.KAPPA}::double))"
SQL_THETA_V = f"({SQL_THETA} * (1 + (1 - {c.EPSILON}::double) / {c.EPSILON}::double * qv))"
SQL_RHO = f"(p / ({c.R_D}::double * t * (1 + {c.RVD_O!r}::double * qv - (qc + qi))))"


def _sql_relhum(es: str) -> str:
    q = "(qv / (1 + qv))"
    return f"least(100, greatest(0, 100 * ({q} * p / ({c.EPSILON}::double + (1 - {c.EPSILON}::double) * {q})) / ({es})))"


def col(name: str):
    return F.col(name)


_cube_query("svp_water", lambda: atmo.vapour_pressure_water(col("t")), SQL_WATER)
_cube_query("svp_ice", lambda: atmo.vapour_pressure_ice(col("t")), SQL_ICE)
_cube_query("svp_mixed", lambda: atmo.vapour_pressure_mixed(col("t")), SQL_MIXED)
_cube_query("qv_from_pv", lambda: atmo.specific_humidity(atmo.vapour_pressure_water(col("t")), col("p")),
            f"{c.RDV!r}::double * ({SQL_WATER}) / greatest(p - {c.O_RDV!r}::double * ({SQL_WATER}), 1)", 9)
_cube_query("pv_from_qv", lambda: atmo.vapour_pressure(col("qv"), col("p")), f"qv * p / ({c.RDV!r}::double + {c.O_RDV!r}::double * qv)")
_cube_query("theta", lambda: atmo.potential_temperature(col("t"), col("p")), SQL_THETA)
_cube_query("theta_internal", lambda: atmo.potential_temperature_internal(col("t"), col("p")), f"t * pow(1e5 / p, {c.RDOCP!r}::double)")
_cube_query("theta_v", lambda: atmo.virtual_potential_temperature(col("t"), col("p"), col("qv")), SQL_THETA_V)
_cube_query("density", lambda: atmo.density(col("t"), col("p"), col("qv"), col("qc"), col("qi")), SQL_RHO, 9)
for _name, _phase, _es in (("relhum_water", "water", SQL_WATER), ("relhum_ice", "ice", SQL_ICE), ("relhum_mixed", "water+ice", SQL_MIXED)):
    _cube_query(_name, lambda phase=_phase: atmo.relative_humidity(col("qv"), col("t"), col("p"), phase=phase), _sql_relhum(_es))
_cube_query("wind_speed", lambda: atmo.wind_speed(col("u"), col("v")), "sqrt(u * u + v * v)")
_cube_query("wind_direction", lambda: atmo.wind_direction(col("u"), col("v")), "degrees(atan2(u, v)) + 180")


@query("athd_s", f"{HOURLY} select day, lead_h, round(avg / 0.996::double + 5.6697e-8 * pow(250 + lead_h, 4), 6) as value from series")
def _athd_s(spark, sf_dir):
    s = _series(spark, sf_dir)
    return _rounded(s, ["day", "lead_h"], {"value": atmo.thermal_down(col("avg"), (250 + col("lead_h")).cast("double"))})


@query("swdown", f"{HOURLY} select day, lead_h, round(case when lead_h % 5 <> 0 then greatest(avg - 100 + amount, 0) end, 6) as value from series")
def _swdown(spark, sf_dir):
    s = _series(spark, sf_dir)
    return _rounded(s, ["day", "lead_h"], {"value": atmo.shortwave_down(col("avg") - 100, F.when(col("lead_h") % 5 != 0, col("amount")))})


# --- staggering and differences ---------------------------------------------------------------

def _window(dim: str) -> str:
    return f"over (partition by {', '.join(d for d in ('k', 'y', 'x') if d != dim)} order by {dim})"


for _d in ("x", "y"):
    @query(f"destagger_{_d}", f"{CUBE} select x, y, k, round(case when row_number() {_window(_d)} = 1 then u else 0.5 * (lag(u) {_window(_d)} + u) end, 6) as value from cube")
    def _destagger(spark, sf_dir, d=_d):
        return _rounded(stagger.destagger(fx.full_levels(spark, sf_dir), d, ["u"]), ["x", "y", "k"], {"value": "u"})

    @query(f"diff_{_d}", f"{CUBE} select x, y, k, round(0.5 * (lead(t) {_window(_d)} - lag(t) {_window(_d)}), 6) as value from cube")
    def _diff(spark, sf_dir, d=_d):
        f = stagger.diff_x if d == "x" else stagger.diff_y
        return _rounded(f(fx.full_levels(spark, sf_dir), "t", "value"), ["x", "y", "k"], {"value": "value"})


@query("destagger_z", f"{CUBE} select * from (select x, y, k, round(0.5 * (w + lead(w) {_window('k')}), 6) as value from half) where value is not null")
def _destagger_z(spark, sf_dir):
    return _rounded(stagger.destagger(fx.half_levels(spark, sf_dir), "k", ["w"]), ["x", "y", "k"], {"value": "w"})


@query("diff_z", f"""{CUBE} select x, y, k, round(case when k = 1 then lead(t) {_window('k')} - t when k = 63 then t - lag(t) {_window('k')}
  else 0.5 * (lead(t) {_window('k')} - lag(t) {_window('k')}) end, 6) as value from cube""")
def _diff_z(spark, sf_dir):
    return _rounded(stagger.diff_z(fx.full_levels(spark, sf_dir), "t", "value"), ["x", "y", "k"], {"value": "value"})


@query("diff_z_staggered", f"{CUBE} select * from (select x, y, k, round(lead(hhl) {_window('k')} - hhl, 6) as value from half) where value is not null")
def _diff_z_staggered(spark, sf_dir):
    return _rounded(stagger.diff_z_staggered(fx.half_levels(spark, sf_dir), "hhl", "value"), ["x", "y", "k"], {"value": "value"})


DLAM = math.radians(fx.STEP)
METRIC = f""",
flat as (select *, 0.5 * (lead(hhl) {_window('x')} - lag(hhl) {_window('x')}) as hx, 0.5 * (lead(hhl) {_window('y')} - lag(hhl) {_window('y')}) as hy from every),
metric0 as (select *, -1 / (lead(hhl) {_window('k')} - hhl) as sqrtg, 0.5 * (hx + lead(hx) {_window('k')}) as mx, 0.5 * (hy + lead(hy) {_window('k')}) as my,
   0.5 * (w + lead(w) {_window('k')}) as wm, lead(w) {_window('k')} - w as z_wm, radians(-1 + y * {fx.STEP}::double) as rlat, radians(46 + y * {fx.STEP}::double) as lat from flat),
metric as (select *, sqrtg / {DLAM!r}::double * mx as zl, sqrtg / {DLAM!r}::double * my as zp, {SQL_THETA} as th, {SQL_RHO} as rho from metric0 where hfl is not null)
"""


def _sql_total(n: str, given: bool = False) -> str:
    z = f"z_{n}" if given else (f"case when k = 1 then lead({n}) {_window('k')} - {n} when k = 63 then {n} - lag({n}) {_window('k')} "
                                f"else 0.5 * (lead({n}) {_window('k')} - lag({n}) {_window('k')}) end")
    return (f"0.5 * (lead({n}) {_window('x')} - lag({n}) {_window('x')}) as x_{n}, 0.5 * (lead({n}) {_window('y')} - lag({n}) {_window('y')}) as y_{n}"
            + ("" if given else f", {z} as z_{n}"))


CURL = METRIC + f""",
diffs as (select *, {_sql_total('u')}, {_sql_total('v')}, {_sql_total('th')}, {_sql_total('wm', True)} from metric),
totals as (select *, {', '.join(f"x_{n} / {DLAM!r}::double + z_{n} * zl as l_{n}, y_{n} / {DLAM!r}::double + z_{n} * zp as p_{n}, z_{n} * sqrtg as s_{n}" for n in ('u', 'v', 'th', 'wm'))},
  1 / {c.RADIUS}::double as r, 1 / ({c.RADIUS}::double * cos(rlat)) as cr from diffs),
curls as (select *, cr * (r * p_wm + s_v - r * v) as c1, r * (-s_u - cr * l_wm + r * u) as c2, cr * l_v + r * (-p_u + tan(rlat) * u) as c3 from totals)
"""


def _with_latitudes(spark, sf_dir) -> DataFrame:
    cube = fx.with_fields(fx.half_levels(spark, sf_dir))
    return cube.withColumns({"rlat": F.radians(-1 + col("y") * fx.STEP), "lat": F.radians(46 + col("y") * fx.STEP),
                             "theta": atmo.potential_temperature(col("t"), col("p")), "rho": atmo.density(col("t"), col("p"), col("qv"), col("qc"), col("qi"))})


@query("metric_terms", f"{CUBE}{METRIC} select x, y, k, round(sqrtg, 9) as sqrtg, round(zl, 6) as dzeta_dlam, round(zp, 6) as dzeta_dphi from metric")
def _metric_terms(spark, sf_dir):
    out = dynamics.metric_terms(fx.half_levels(spark, sf_dir), "hhl", fx.STEP, fx.STEP)
    return out.select("x", "y", "k", F.round("sqrtg", 9).alias("sqrtg"), F.round("dzeta_dlam", 6).alias("dzeta_dlam"), F.round("dzeta_dphi", 6).alias("dzeta_dphi"))


@query("curl", f"{CUBE}{CURL} select x, y, k, round(c1, 9) as curl_1, round(c2, 9) as curl_2, round(c3, 9) as curl_3 from curls")
def _curl(spark, sf_dir):
    cube = _with_latitudes(spark, sf_dir)
    return _rounded(dynamics.curl(cube, "u", "v", "w", "hhl", "rlat", fx.STEP, fx.STEP), ["x", "y", "k"], {f"curl_{i}": f"curl_{i}" for i in (1, 2, 3)}, 9)


@query("curl_alt", f"{CUBE}{CURL} select x, y, k, round(c1, 9) as curl_1, round(c2, 9) as curl_2, round(c3, 9) as curl_3 from curls where x between 1 and 18 and y between 1 and (select max(y) from surf) - 1")
def _curl_alt(spark, sf_dir):
    """The other formulation agrees with the curl at all points that have neighbours."""
    cube = _with_latitudes(spark, sf_dir)
    out = dynamics.curl_alt(cube, "u", "v", "w", "hhl", "rlat", fx.STEP, fx.STEP)
    last = fx.surface(spark, sf_dir).agg(F.max("y").alias("last"))  # one row
    inside = out.crossJoin(F.broadcast(last)).where("x between 1 and 18 and y between 1 and last - 1")
    return _rounded(inside, ["x", "y", "k"], {f"curl_{i}": f"curl_{i}" for i in (1, 2, 3)}, 9)


@query("pot_vortic", f"""{CUBE}{CURL} select x, y, k, round(1e6 * (l_th * c1 + p_th * (c2 + 2 * {c.OMEGA!r}::double * cos(lat) / {c.RADIUS}::double)
  - s_th * (c3 + 2 * {c.OMEGA!r}::double * sin(lat))) / rho, 6) as value from curls""")
def _pot_vortic(spark, sf_dir):
    pv = dynamics.potential_vorticity(_with_latitudes(spark, sf_dir), "u", "v", "w", "theta", "rho", "hhl", "rlat", "lat", fx.STEP, fx.STEP)
    return _rounded(pv, ["x", "y", "k"], {"value": 1e6 * col("value")})


@query("brn", f"""{CUBE}, v as (select *, {SQL_THETA_V} as thv from cube), b as (select *, last_value(thv) over c as low, sum(thv) over c as total, count(*) over c as n from v
  window c as (partition by x, y order by k rows between current row and unbounded following))
select b.x, b.y, b.k, round({c.G}::double * (hfl - hsurf) * (thv - low) * n / nullif(total * (u * u + v * v), 0), 4) as value from b join surf using (x, y)""")
def _brn(spark, sf_dir):
    cube = fx.full_levels(spark, sf_dir).withColumn("thv", atmo.virtual_potential_temperature(col("t"), col("p"), col("qv")))
    out = dynamics.bulk_richardson(cube.join(fx.surface(spark, sf_dir).select("x", "y", "hsurf"), ["x", "y"]), "thv", "u", "v", "hfl", "hsurf")
    return _rounded(out, ["x", "y", "k"], {"value": "value"}, 4)


@query("omega_slope", f"""{CUBE}, d as (select x, y, k, e, lead(ak) {_window('k')} - ak as da, lead(bk) {_window('k')} - bk as db from half),
a as (select d.*, 2 * e * ps * (da / ps + db) / (da / {c.P_REF}::double + db) as a from d join surf using (x, y) where da is not null)
select x, y, k, round((case when k % 2 = 0 then 1 else -1 end) * sum((case when k % 2 = 0 then 1 else -1 end) * a) over (partition by x, y order by k), 4) as value from (select x, y, k, a from a)""")
def _omega(spark, sf_dir):
    half = fx.half_levels(spark, sf_dir).join(fx.surface(spark, sf_dir).select("x", "y", "ps"), ["x", "y"])
    return _rounded(dynamics.omega_slope(half, "e", "ps", "ak", "bk"), ["x", "y", "k"], {"value": "value"}, 4)


# --- vertical ---------------------------------------------------------------------------------

P_TARGETS = (200.0, 300.0, 850.0)
TH_TARGETS = (300.0, 320.0, 340.0)
NEAR = f""", near as (select x, y, k, t as f2, lag(t) {_window('k')} as f1, p as p2, lag(p) {_window('k')} as p1, {SQL_THETA} as t2, lag({SQL_THETA}) {_window('k')} as t1, hfl as h2 from cube)"""


def _sql_k2p(mode: str) -> str:
    ratio = {"linear_in_p": "(target - p1) / (p2 - p1)", "linear_in_lnp": "(ln(target) - ln(p1)) / (ln(p2) - ln(p1))",
             "nearest_sfc": "case when abs(target - p1) >= abs(target - p2) then 1.0::double else 0.0::double end"}[mode]
    return f"""{CUBE}{NEAR}, goal as (select unnest([{', '.join(f'{t * 100}::double' for t in P_TARGETS)}]) as target)
select x, y, target, round(arg_min((1 - {ratio}) * f1 + ({ratio}) * f2, k) filter (p2 > target and p1 <= target), 6) as value from near, goal group by x, y, target"""


for _mode, _name in (("linear_in_p", "k2p_linear_p"), ("linear_in_lnp", "k2p_linear_lnp"), ("nearest_sfc", "k2p_nearest")):
    @query(_name, _sql_k2p(_mode))
    def _k2p(spark, sf_dir, mode=_mode):
        return _rounded(vertical.interpolate_k2p(fx.full_levels(spark, sf_dir), "t", "p", P_TARGETS, mode, "hPa"), ["x", "y", "target"], {"value": "value"})


def _sql_k2any(mode: str, field: str = "t", targets=TH_TARGETS) -> str:
    inside = f"(({field}2 >= target and {field}1 <= target) or ({field}2 <= target and {field}1 >= target))"
    ratio = f"(case when {field}2 = {field}1 then 0 else (target - {field}1) / nullif({field}2 - {field}1, 0) end)"
    pick = f"{'arg_max' if mode == 'high' else 'arg_min'}((1 - {ratio}) * f1 + {ratio} * f2, h2) filter ({inside})"
    if mode == "undef":
        pick = f"case when count(*) filter ({inside}) = 1 then {pick} end"
    return f"""{CUBE}{NEAR}, goal as (select unnest([{', '.join(f'{t}::double' for t in targets)}]) as target)
select x, y, target, round({pick}, 6) as value from near, goal group by x, y, target"""


for _m in ("low", "high", "undef"):
    @query(f"k2theta_{_m}", _sql_k2any(_m))
    def _k2theta(spark, sf_dir, m=_m):
        cube = fx.full_levels(spark, sf_dir).withColumn("theta", atmo.potential_temperature(col("t"), col("p")))
        return _rounded(vertical.interpolate_k2theta(cube, "t", "theta", TH_TARGETS, "hfl", f"{m}_fold"), ["x", "y", "target"], {"value": "value"})

for _m in ("low", "high"):
    @query(f"k2any_{_m}", _sql_k2any(_m, "p", (25000.0, 60000.0)))
    def _k2any(spark, sf_dir, m=_m):
        return _rounded(vertical.interpolate_k2any(fx.full_levels(spark, sf_dir), "t", "p", (25000.0, 60000.0), "hfl", f"{m}_fold"), ["x", "y", "target"], {"value": "value"})

BOUNDS = (1500.0, 9000.0)
for _name, _op, _pick in (("minmax_max", "maximum", "greatest"), ("minmax_min", "minimum", "least")):
    @query(_name, f"""{CUBE}, n as (select *, lead(t) {_window('k')} as fl, lead(hfl) {_window('k')} as hl from cube),
m as (select x, y, {_pick}(case when hfl between {BOUNDS[0]} and {BOUNDS[1]} then t end,
  case when hfl > {BOUNDS[0]} and hl < {BOUNDS[0]} then t + (t - fl) / (hfl - hl) * ({BOUNDS[0]}::double - hfl) end,
  case when hfl > {BOUNDS[1]} and hl < {BOUNDS[1]} then t + (t - fl) / (hfl - hl) * ({BOUNDS[1]}::double - hfl) end) as v from n)
select x, y, round({'max' if _op == 'maximum' else 'min'}(v), 6) as value from m group by x, y""")
    def _minmax(spark, sf_dir, op=_op):
        cube = fx.full_levels(spark, sf_dir).withColumns({"bottom": F.lit(BOUNDS[0]), "top": F.lit(BOUNDS[1])})
        return _rounded(vertical.minmax_k(cube, "t", "hfl", "bottom", "top", op), ["x", "y"], {"value": "value"})

for _name, _op in (("integral", "integral"), ("normed_integral", "normed_integral")):
    @query(_name, f"""{CUBE}, n as (select x, y, k, t, hhl as up, lead(hhl) {_window('k')} as low from every),
d as (select *, case when low < {BOUNDS[0]} and up > {BOUNDS[0]} then up - {BOUNDS[0]}::double when up > {BOUNDS[1]} and low < {BOUNDS[1]} then {BOUNDS[1]}::double - low else up - low end as dh from n)
select x, y, round(sum(case when 0.5 * (up + low) between {BOUNDS[0]} and {BOUNDS[1]} then t * dh end){f' / {BOUNDS[1] - BOUNDS[0]}::double' if _op != 'integral' else ''}, 4) as value from d group by x, y""")
    def _integral(spark, sf_dir, op=_op):
        cube = fx.with_fields(fx.half_levels(spark, sf_dir)).withColumns({"bottom": F.lit(BOUNDS[0]), "top": F.lit(BOUNDS[1])})
        return _rounded(vertical.integrate_k(cube, "t", "hhl", "bottom", "top", op), ["x", "y"], {"value": "value"}, 4)


def _sql_zero(shift: float, extrapolate: bool) -> str:
    value = "(h1 + (h2 - h1) * (273.15::double - t1) / nullif(t2 - t1, 0))"
    found = f"arg_min({value}, k) filter (t2 >= 273.15 and t1 < 273.15)"
    if extrapolate:
        found = f"case when bool_and(t2 < 273.15) then arg_max(case when t2 - t1 > 1e-10 and {value} > 0 then {value} end, k) filter (k = 63) else {found} end"
    return (f"{CUBE}, n as (select x, y, k, t - {shift}::double as t2, hfl as h2, lag(t - {shift}::double) {_window('k')} as t1, lag(hfl) {_window('k')} as h1 from cube) "
            f"select x, y, round({found}, 6) as value from n group by x, y")


for _name, _shift, _ex in (("zero_isotherm", 0.0, False), ("zero_isotherm_extrapolated", 20.0, True)):
    @query(_name, _sql_zero(_shift, _ex))
    def _zero(spark, sf_dir, shift=_shift, ex=_ex):
        cube = fx.full_levels(spark, sf_dir).withColumn("ts", col("t") - shift)
        return _rounded(vertical.zero_isotherm(cube, "ts", "hfl", ex), ["x", "y"], {"value": "value"})


SQL_LNP = "ln(95000 / ps)"
SQL_BASE = "(t + 0.0065::double * h)"
SQL_CHOSEN = f"(case when h > 2500 then least({SQL_BASE}, 298) else (least({SQL_BASE}, 298) + {SQL_BASE}) / 2 end)"
SQL_Y = f"((case when h < 2000 then 0.0065::double else greatest({SQL_CHOSEN} - t, 0) / nullif(h, 0) end) * {c.R_D}::double / {c.G}::double * {SQL_LNP})"
SQL_Y0 = f"(0.0065::double * {c.R_D}::double / {c.G}::double * {SQL_LNP})"
TERRAIN = f"{CUBE}, land as (select x, y, t, ps, hsurf * m as h, m::int as m from surf, (values (1), (7), (8)) v(m))"


def _terrain(spark, sf_dir) -> DataFrame:
    s = fx.surface(spark, sf_dir)
    return s.withColumn("m", F.explode(F.array(F.lit(1), F.lit(7), F.lit(8)))).withColumn("h", col("hsurf") * col("m"))


@query("extrap_temperature", f"{TERRAIN} select x, y, m, round(t * (1 + {SQL_Y} + {SQL_Y} * {SQL_Y} / 2 + {SQL_Y} * {SQL_Y} * {SQL_Y} / 6), 6) as value from land")
def _extrap_t(spark, sf_dir):
    return _rounded(_terrain(spark, sf_dir), ["x", "y", "m"], {"value": atmo.extrapolated_temperature(col("t"), col("ps"), col("h"), F.lit(95000.0))})


@query("extrap_geopotential", f"{TERRAIN} select x, y, m, round(h * {c.G}::double - {c.R_D}::double * t * {SQL_LNP} * (1 + {SQL_Y0} / 2 + {SQL_Y0} * {SQL_Y0} / 6), 4) as value from land")
def _extrap_g(spark, sf_dir):
    return _rounded(_terrain(spark, sf_dir), ["x", "y", "m"], {"value": atmo.extrapolated_geopotential(col("t"), col("ps"), col("h"), F.lit(95000.0))}, 4)


@query("extrap_constant", f"{CUBE} select x, y, 100000.0::double as target, round(t, 6) as value from cube where k = 63")
def _extrap_c(spark, sf_dir):
    return _rounded(vertical.extrapolate_k2p(fx.full_levels(spark, sf_dir), "t", 100000.0), ["x", "y", "target"], {"value": "value"})


# --- columns ----------------------------------------------------------------------------------

@query("columns_k2p", ORACLE["k2p_linear_lnp"])
def _columns_k2p(spark, sf_dir):
    return _rounded(columns.interpolate_k2p(fx.columns(spark, sf_dir), "t", "p", P_TARGETS, "linear_in_lnp", "hPa"), ["x", "y", "target"], {"value": "value"})


@query("columns_integral", ORACLE["integral"])
def _columns_integral(spark, sf_dir):
    return _rounded(columns.integrate_k(fx.columns(spark, sf_dir), "t", "hhl", F.lit(BOUNDS[0]), F.lit(BOUNDS[1])), ["x", "y"], {"value": "value"}, 4)


@query("columns_minmax_max", ORACLE["minmax_max"])
def _columns_minmax(spark, sf_dir):
    return _rounded(columns.minmax_k(fx.columns(spark, sf_dir), "t", "hfl", F.lit(BOUNDS[0]), F.lit(BOUNDS[1]), "maximum"), ["x", "y"], {"value": "value"})


@query("columns_zero_isotherm", ORACLE["zero_isotherm_extrapolated"])
def _columns_zero(spark, sf_dir):
    cold = fx.columns(spark, sf_dir).withColumn("t", F.transform("t", lambda t: t - 20.0))
    return _rounded(columns.zero_isotherm(cold, "t", "hfl", True), ["x", "y"], {"value": "value"})


# --- members and times ------------------------------------------------------------------------

MEMBERS = f"""{CUBE}, two as (select x, y, k, eps::int as eps, lead_s::bigint as lead_s, p, hfl, t + eps * 10 + lead_s / 3600.0::double as t from cube, (values (0), (1)) e(eps), (values (0), (3600)) l(lead_s))"""
IN_COLUMN = "over (partition by eps, lead_s, x, y order by k)"


@query("k2p_members", f"""{MEMBERS}, near as (select *, lag(t) {IN_COLUMN} as t1, lag(p) {IN_COLUMN} as p1 from two), goal as (select unnest([30000::double, 85000::double]) as target)
select eps, lead_s, x, y, target, round(arg_min(t1 + (target - p1) / (p - p1) * (t - t1), k) filter (p > target and p1 <= target), 6) as value from near, goal group by all""")
def _k2p_members(spark, sf_dir):
    cube = fx.members(fx.full_levels(spark, sf_dir).select("x", "y", "k", "t", "p"), "t")
    return _rounded(vertical.interpolate_k2p(cube, "t", "p", (300.0, 850.0), "linear_in_p", "hPa"), ["eps", "lead_s", "x", "y", "target"], {"value": "value"})


@query("destagger_members", f"""{MEMBERS} select eps, lead_s, x, y, k, round(case when x = 0 then t else 0.5 * (lag(t) over (partition by eps, lead_s, k, y order by x) + t) end, 6) as value from two""")
def _destagger_members(spark, sf_dir):
    cube = fx.members(fx.full_levels(spark, sf_dir).select("x", "y", "k", "t"), "t")
    return _rounded(stagger.destagger(cube, "x", ["t"]), ["eps", "lead_s", "x", "y", "k"], {"value": "t"})


@query("zero_isotherm_members", f"""{MEMBERS}, n as (select *, lag(t) {IN_COLUMN} as t1, lag(hfl) {IN_COLUMN} as h1 from two)
select eps, lead_s, x, y, round(arg_min(h1 + (hfl - h1) * (273.15::double - t1) / (t - t1), k) filter (t >= 273.15 and t1 < 273.15), 6) as value from n group by all""")
def _zero_members(spark, sf_dir):
    cube = fx.members(fx.full_levels(spark, sf_dir).select("x", "y", "k", "t", "hfl"), "t")
    return _rounded(vertical.zero_isotherm(cube, "t", "hfl"), ["eps", "lead_s", "x", "y"], {"value": "value"})


# --- time -------------------------------------------------------------------------------------

def _series(spark, sf_dir) -> DataFrame:
    return fx.hourly(spark, sf_dir).withColumn("day", F.date_format("ref_time", "yyyy-MM-dd"))


def _time_query(name: str, sql: str, f) -> None:
    @query(name, f"{HOURLY} {sql}")
    def run(spark, sf_dir):
        return _rounded(f(_series(spark, sf_dir)), ["day", "lead_h"], {"value": "value"})


IN_DAY = "over (partition by day order by lead_h)"
_time_query("time_rate", f"select * from (select day, lead_h, round(acc - lag(acc) {IN_DAY}, 6) as value from series) where value is not null", lambda s: timeops.time_rate(s, "acc", 3600))
_time_query("delta_3h", f"select day, lead_h, round(acc - lag(acc, 3) {IN_DAY}, 6) as value from series", lambda s: timeops.delta(s, "acc", 10800))
_time_query("resample_3h", "select day, lead_h, round(amount, 6) as value from series where lead_h % 3 = 0", lambda s: timeops.resample(s, 10800).withColumn("value", col("amount")))
_time_query("resample_average_3h", f"select day, lead_h, round(avg * lead_h / 3.0::double - lag(avg * lead_h / 3.0::double, 3) {IN_DAY}, 6) as value from series",
            lambda s: timeops.resample_average(s, "avg", 10800))
_time_query("rolling_max_12h", "select day, lead_h, round(case when lead_h >= 11 then max(amount) over (partition by day order by lead_h rows 11 preceding) end, 6) as value from series",
            lambda s: timeops.rolling_max(s, "amount", 12))


# --- neighbourhoods ---------------------------------------------------------------------------

def _sql_stencil(radius: int, kind: str, column: str) -> str:
    values = ", ".join(f"({dx}, {dy}, {w!r}::double)" for dx, dy, w in lateral.kernel_weights(2 * radius + 1, kind, "disk") if w > 0)
    return f"""{CUBE}, st(dx, dy, w) as (values {values}),
near as (select a.x, a.y, sum(w) filter (b.v is not null) as w, sum(w * b.v) as s, count(*) filter (b.v is null) as gaps, count(*) as n
  from (select x, y from surf) a, st, (select x, y, {column} as v from surf) b where b.x = a.x + dx and b.y = a.y + dy group by a.x, a.y)"""


@query("disk_avg", f"{_sql_stencil(2, 'const', 'hsurf')} select x, y, round(case when n = 13 then s / w end, 6) as value from near")
def _disk_avg(spark, sf_dir):
    return _rounded(lateral.disk_avg(fx.surface(spark, sf_dir), "hsurf", 2), ["x", "y"], {"value": "value"})


@query("disk_avg_with_gaps", f"{_sql_stencil(2, 'const', 'gap')} select x, y, round(case when gap is not null then s / w end, 6) as value from near join surf using (x, y)")
def _disk_avg_gaps(spark, sf_dir):
    return _rounded(lateral.disk_avg(fx.surface(spark, sf_dir), "gap", 2), ["x", "y"], {"value": "value"})


@query("fill_undef", f"{_sql_stencil(2, 'exp', 'gap')} select x, y, round(coalesce(gap, case when gaps / n::double <= 0.16 then s / w end), 6) as value from near join surf using (x, y)")
def _fill_undef(spark, sf_dir):
    return _rounded(lateral.fill_undef(fx.surface(spark, sf_dir), "gap", 2, 0.16), ["x", "y"], {"value": "value"})


@query("kernel_weights", f"{_sql_stencil(2, 'exp', 'hsurf')} select x, y, n::bigint as n, round(w, 9) as w from near")
def _kernel(spark, sf_dir):
    """What a kernel weighs around each point of the field."""
    kernel = spark.createDataFrame([w for w in lateral.kernel_weights(5, "exp", "disk") if w[2] > 0], "dx int, dy int, w double")
    field = fx.surface(spark, sf_dir).select("x", "y")
    around = field.crossJoin(F.broadcast(kernel)).select("x", "y", "w", (col("x") + col("dx")).alias("nx"), (col("y") + col("dy")).alias("ny"))  # 13 weights
    inside = around.join(field.select(col("x").alias("nx"), col("y").alias("ny")), ["nx", "ny"])
    return inside.groupBy("x", "y").agg(F.count("*").alias("n"), F.round(F.sum("w"), 9).alias("w"))


# --- grids ------------------------------------------------------------------------------------

LON0, SIN0, COS0 = math.radians(fx.POLE[0]), math.sin(math.radians(fx.POLE[1])), math.cos(math.radians(fx.POLE[1]))
GEO = f""", rot as (select x, y, radians(-1 + x * {fx.STEP}::double) as l, radians(-1 + y * {fx.STEP}::double) as b from surf),
q as (select *, {COS0!r}::double * sin(b) - {SIN0!r}::double * cos(l) * cos(b) as q, sin(l) * cos(b) as side from rot),
geo0 as (select x, y, degrees(atan2({math.sin(LON0)!r}::double * q - {math.cos(LON0)!r}::double * side, {math.cos(LON0)!r}::double * q + {math.sin(LON0)!r}::double * side)) as lon0,
   degrees(asin({COS0!r}::double * cos(b) * cos(l) + {SIN0!r}::double * sin(b))) as lat from q),
geo as (select x, y, case when lon0 < 0 then lon0 + 360 else lon0 end as lon, lat from geo0)
"""


def _geo(df: DataFrame) -> DataFrame:
    lon, lat = gis.rotated_to_geographic(-1 + col("x") * fx.STEP, -1 + col("y") * fx.STEP, fx.POLE)
    return df.withColumns({"lon": lon, "lat": lat})


@query("rot2geo", f"{CUBE}{GEO} select x, y, round(lon, 6) as lon, round(lat, 6) as lat from geo")
def _rot2geo(spark, sf_dir):
    return _rounded(_geo(fx.surface(spark, sf_dir)), ["x", "y"], {"lon": "lon", "lat": "lat"})


@query("geo2rot", f"{CUBE} select x, y, round(-1 + x * {fx.STEP}::double, 6) as rlon, round(-1 + y * {fx.STEP}::double, 6) as rlat from surf")
def _geo2rot(spark, sf_dir):
    g = _geo(fx.surface(spark, sf_dir))
    rlon, rlat = gis.geographic_to_rotated(col("lon"), col("lat"), fx.POLE)
    return _rounded(g, ["x", "y"], {"rlon": rlon, "rlat": rlat})


@query("geo2swiss", f"""{CELLS}, s as (select cell, (3.6::double * lat - 169.02866::double) / 10 as phi, (3.6::double * lon - 26.7825::double) / 10 as lam from cells)
select cell, round(600072.37::double + lam * (211455.93::double - 10938.51::double * phi - 0.36::double * phi * phi - 44.54::double * lam * lam), 3) as sx,
 round(200147.07::double + 3745.25::double * lam * lam + phi * (308807.95::double + 76.63::double * phi - 194.56::double * lam * lam + 119.79::double * phi * phi), 3) as sy from s""")
def _geo2swiss(spark, sf_dir):
    sx, sy = gis.geographic_to_swiss(col("lon"), col("lat"))
    return _rounded(fx.cells(spark, sf_dir), ["cell"], {"sx": sx, "sy": sy}, 3)


@query("rotate_vector", f"""{CUBE}{GEO}, a as (select cube.x, cube.y, cube.k, u, v, {COS0!r}::double * sin({LON0!r}::double - radians(lon)) as a1,
 {SIN0!r}::double * cos(radians(lat)) - {COS0!r}::double * sin(radians(lat)) * cos({LON0!r}::double - radians(lon)) as a2 from cube join geo using (x, y))
select x, y, k, round((a2 * u + a1 * v) / sqrt(a1 * a1 + a2 * a2), 6) as u_geo, round((a2 * v - a1 * u) / sqrt(a1 * a1 + a2 * a2), 6) as v_geo from a""")
def _rotate(spark, sf_dir):
    cube = _geo(fx.full_levels(spark, sf_dir))
    u, v = gis.rotate_vector(col("u"), col("v"), col("lon"), col("lat"), fx.POLE)
    return _rounded(cube, ["x", "y", "k"], {"u_geo": u, "v_geo": v})


@query("crop", f"{CUBE} select x - 3 as x, y - 2 as y, round(hsurf, 6) as value from surf where x between 3 and 12 and y between 2 and 9")
def _crop(spark, sf_dir):
    return _rounded(gis.crop(fx.surface(spark, sf_dir), 3, 12, 2, 9, 20, 25), ["x", "y"], {"value": "hsurf"})


@query("clip_strip", f"{CELLS} select cell, round(value, 6) as value from cells where not strip between 1 and 4")
def _clip(spark, sf_dir):
    cells = fx.cells(spark, sf_dir)
    return _rounded(gis.clip_strip(cells, cells.select("cell", "strip"), 4), ["cell"], {"value": "value"})


SOURCE = gis.RegularGrid(20, 25, 0.0, 0.0, 1.0, 1.0)
TARGET = gis.RegularGrid(30, 37, 0.3, 0.2, 0.6, 0.6)
AT = f"""{CUBE}, n as (select max(y) as top, greatest(1, floor((max(y) - 2.4::double) / 0.6::double + 1e-9)::int + 1) as ny from surf),
goal as (select (i % {TARGET.nx})::int as x, (i // {TARGET.nx})::int as y, top from n, range({TARGET.nx}::bigint * 100000) r(i) where i < {TARGET.nx} * ny),
pt as (select x, y, round(round(0.3::double + x * 0.6::double, 6), 9) as i, round(round(0.2::double + y * 0.6::double, 6), 9) as j, top from goal),
pts as (select * from pt where i between 0 and 19 and j between 0 and top)"""


def _grids(rows: int) -> tuple[gis.RegularGrid, gis.RegularGrid]:
    """``SOURCE`` and ``TARGET`` for a field of so many rows; the target's last row is as far from the field's as that of ``TARGET``."""
    source = replace(SOURCE, ny=rows)
    last = SOURCE.ny - (TARGET.y0 + (TARGET.ny - 1) * TARGET.dy)
    return source, replace(TARGET, ny=max(1, math.floor((rows - last - TARGET.y0) / TARGET.dy + 1e-9) + 1))


def _regrid(method: str):
    def run(spark, sf_dir):
        field = fx.surface(spark, sf_dir)
        rows = field.agg(F.max("y")).first()[0]  # one number
        source, target = _grids(0 if rows is None else rows + 1)
        return _rounded(gis.regrid(field, "hsurf", source, target, method), ["x", "y"], {"value": "value"})
    return run


def _sql_regrid(reach: str, weight) -> str:
    return f"""{AT}, tap as (select x, y, (floor(i) + a)::int as sx, (floor(j) + b)::int as sy, abs(i - floor(i) - a) as dx, abs(j - floor(j) - b) as dy from pts, range({reach}) ra(a), range({reach}) rb(b)),
wt as (select x, y, sx, sy, ({weight('dx')}) * ({weight('dy')}) as w from tap)
select wt.x, wt.y, round(sum(w * hsurf) / sum(w), 6) as value from wt join surf on surf.x = sx and surf.y = sy where w <> 0 group by wt.x, wt.y"""


def _sql_cubic(d: str) -> str:
    return f"case when {d} <= 1 then 1.5::double * {d} ** 3 - 2.5::double * {d} ** 2 + 1 when {d} < 2 then -0.5::double * {d} ** 3 + 2.5::double * {d} ** 2 - 4 * {d} + 2 else 0 end"


query("regrid_nearest", f"""{AT} select pts.x, pts.y, round(hsurf, 6) as value from pts join surf on surf.x = floor(i + 0.5)::int and surf.y = floor(j + 0.5)::int""")(_regrid("nearest"))
query("regrid_bilinear", _sql_regrid("2", lambda d: f"1 - {d}"))(_regrid("bilinear"))
query("regrid_cubic", _sql_regrid("-1, 3", _sql_cubic))(_regrid("cubic"))


def _weights(spark, sf_dir) -> DataFrame:
    """A target for every cell, each with three cells as its stencil."""
    n = fx.cells(spark, sf_dir).agg(F.count("*").alias("n"))
    slots = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(w).alias("w")) for i, w in enumerate((0.5, 0.3, 0.2))]))
    rows = fx.cells(spark, sf_dir).select(col("cell").alias("dst"), slots.alias("s")).select("dst", "s.*").crossJoin(F.broadcast(n))  # one row
    return rows.select("dst", "slot", ((col("dst") * 37 + col("slot") * 101) % col("n")).alias("cell"), "w", (col("dst") != 0).alias("found"))


WEIGHTS = f"""{CELLS}, wt as (select dst, slot, (dst * 37 + slot * 101) % (select count(*) from cells) as cell, [0.5::double, 0.3::double, 0.2::double][slot + 1] as w
 from (select cell as dst from cells), range(3) b(slot))"""


@query("remap_weighted", f"""{WEIGHTS}
select dst, round(case when dst <> 0 then greatest(min(value), least(max(value), sum(w * value))) end, 6) as value from wt join cells using (cell) group by dst""")
def _remap(spark, sf_dir):
    return _rounded(gis.remap(fx.cells(spark, sf_dir).select("cell", "value"), "value", _weights(spark, sf_dir)), ["dst"], {"value": "value"})


@query("remap_named_grid", f"""{WEIGHTS}, k as (select greatest(1, floor(sqrt(count(*)))::int) as k from cells),
done as (select dst, case when dst <> 0 then greatest(min(value), least(max(value), sum(w * value))) end as v from wt join cells using (cell) group by dst)
select (dst // k)::int as y, (dst % k)::int as x, round(6 + (dst % k) * (4.0::double / greatest(k - 1, 1)), 6) as lon, round(44 + (dst // k) * (3.0::double / greatest(k - 1, 1)), 6) as lat, round(v, 6) as value
 from done, k where dst < k * k""")
def _remap_named(spark, sf_dir):
    """Weights and grid by the identifier of the field's own grid; the points by the new header."""
    n = fx.cells(spark, sf_dir).count()
    k = max(1, math.isqrt(n))
    grids = spark.createDataFrame([("g", "geolatlon", k, k, 6.0, 44.0, 10.0, 47.0, None, None), ("g", "rotlatlon", k, k, -1.0, -1.0, 1.0, 1.0, 190.0, 43.0)],
                                  "grid_id string, goal string, nx int, ny int, xmin double, ymin double, xmax double, ymax double, pole_lon double, pole_lat double")
    weights = _weights(spark, sf_dir).where(col("dst") < k * k).withColumns({"grid_id": F.lit("g"), "goal": F.lit("geolatlon")})
    field = Field(fx.cells(spark, sf_dir).select("cell", "value"), FieldMeta("T", grid_id="g", keys={"gridType": "unstructured_grid"}))
    out = slabs.located(checked.remap_to_grid(field, "geolatlon", weights, grids))
    return _rounded(out.df, ["y", "x"], {"lon": "lon", "lat": "lat", "value": "value"})


@query("remap_members", f"""{WEIGHTS}, m as (select cell, eps::int as eps, lead_s::bigint as lead_s, value + eps * 10 + lead_s / 3600.0::double as value from cells, (values (0), (1)) e(eps), (values (0), (3600)) l(lead_s)
  where not (eps = 1 and cell % 50 = 7)),
s as (select eps, lead_s, dst, count(*) as n, sum(w * value) as s, min(value) as low, max(value) as high from wt join m using (cell) group by all),
every as (select eps::int as eps, lead_s::bigint as lead_s, cell as dst from cells, (values (0), (1)) e(eps), (values (0), (3600)) l(lead_s))
select eps, lead_s, dst, round(case when dst <> 0 and n = 3 then greatest(low, least(high, s)) end, 6) as value from every left join s using (eps, lead_s, dst)""")
def _remap_members(spark, sf_dir):
    field = fx.members(fx.cells(spark, sf_dir).select("cell", "value"), "value").where("not (eps = 1 and cell % 50 = 7)")
    return _rounded(gis.remap(field, "value", _weights(spark, sf_dir)), ["eps", "lead_s", "dst"], {"value": "value"})


def _barycentric_target(n: int) -> gis.RegularGrid:
    k = max(2, math.isqrt(n // 4))
    return gis.RegularGrid(k, k, 6.5, 44.5, 9.0 / (k - 1), 4.5 / (k - 1))


_N3 = projections._N
_SQL_E = 2 * math.sqrt(_N3) / (1 + _N3)


@query("remap_barycentric", f"""with n as (select greatest(2, floor(sqrt(count(*) // 4))::int) as k from customer),
goal as (select (i % k)::int as x, (i // k)::int as y, k from n, range(10000000) r(i) where i < k * k),
pt as (select x, y, radians(round(6.5::double + x * (9.0::double / (k - 1)), 6) - 9) as d, sin(radians(round(44.5::double + y * (4.5::double / (k - 1)), 6))) as s from goal),
t as (select x, y, d, sinh(atanh(s) - {_SQL_E!r}::double * atanh({_SQL_E!r}::double * s)) as t from pt),
xe as (select x, y, atan2(t, cos(d)) as xi, atanh(sin(d) / sqrt(1 + t * t)) as eta from t)
select x, y, round(1e-3 * (500000 + {projections._RADIUS!r}::double * (eta + {' + '.join(f'{c!r}::double * cos({2 * j} * xi) * sinh({2 * j} * eta)' for j, c in enumerate(projections._FORTH, 1))}))
  - 2e-3 * {projections._RADIUS!r}::double * (xi + {' + '.join(f'{c!r}::double * sin({2 * j} * xi) * cosh({2 * j} * eta)' for j, c in enumerate(projections._FORTH, 1))}), 4) as value from xe""")
def _barycentric(spark, sf_dir):
    """A field that is a plane in projected metres comes back as that plane."""
    cells = fx.cells(spark, sf_dir)
    px, py = triangles.PLANE.from_geographic(col("lon"), col("lat"))
    field = cells.select("cell", (1e-3 * px - 2e-3 * py).alias("value"))
    target = _barycentric_target(cells.count())
    return _rounded(triangles.iconremap(field, "value", cells, target), ["x", "y"], {"value": "value"}, 4)


# --- requests and catalogs --------------------------------------------------------------------

@query("load_density", """with e as (select distinct date_trunc('day', ts)::timestamp as d, hour(ts)::int as lead_h from events where not (hour(ts) = 5 and day(ts) % 3 = 0))
select strftime(d, '%Y-%m-%d') as day, lead_h from (select d from (select distinct d from e)) cross join (select distinct lead_h from e) except select strftime(d, '%Y-%m-%d'), lead_h from e""")
def _load_density(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_trunc("day", "ts").alias("ref_time"), F.hour("ts").alias("lead_h"))
    e = e.where("not (lead_h = 5 and day(ref_time) % 3 = 0)")  # an irregular series
    return missing_keys(e, ["ref_time", "lead_h"]).select(F.date_format("ref_time", "yyyy-MM-dd").alias("day"), "lead_h")


@query("slab_round_trip", f"""{CUBE}, r as (select x, y, k, t, min(t) over (partition by k) as low, (max(t) over (partition by k) - min(t) over (partition by k)) / 65535.0::double as step from cube)
select x, y, k, round(low + floor((t - low) / step + 0.5::double) * step, 6) as value from r""")
def _slabs(spark, sf_dir):
    field = Field(fx.full_levels(spark, sf_dir).select("x", "y", "k", "t"), FieldMeta("T", "K"))
    return _rounded(slabs.from_slabs(slabs.to_slabs(field, "t")), ["x", "y", "k"], {"value": "value"})


def _packed(values: str, by: str, bits: int, more: str) -> str:
    """SQL of ``values`` as a slab of so many bits gives them back."""
    step = f"((max(v) over (partition by {by}) - min(v) over (partition by {by})) / {2 ** bits - 1}.0::double)"
    return f"select {more}, case when step > 0 then low + floor((v - low) / step + 0.5::double) * step else v end as v from (select *, min(v) over (partition by {by}) as low, {step} as step from ({values}))"


@query("pressure_round_trip", f"""{CUBE}{NEAR}, goal as (select unnest([30000::double, 85000::double]) as target),
raw as (select x, y, target, arg_min(f1 + (target - p1) / (p2 - p1) * (f2 - f1), k) filter (p2 > target and p1 <= target) as v from near, goal group by all)
select x, y, target, round(v, 6) as value from ({_packed('select * from raw', 'target', 24, 'x, y, target')}) where target = 85000""")
def _pressure_round_trip(spark, sf_dir):
    """Interpolated to pressure levels, written to files of messages, and one level asked for again."""
    cube = fx.full_levels(spark, sf_dir)
    t, p = (Field(cube.select("x", "y", "k", col(n).alias("value")), FieldMeta(name, units)) for n, name, units in (("t", "T", "K"), ("p", "P", "Pa")))
    path = scratch(spark, "messages")
    gridmsg.write(slabs.to_slabs(checked.interpolate_k2p(t, p, [300.0, 850.0], "linear_in_p", "hPa"), bits=24), path)
    out = slabs.load_single(slabs.DataSource(gridmsg.read(spark, path)), {"param": "T", "levtype": "pl", "levelist": 850})
    return _rounded(out.df, ["x", "y", "target"], {"value": "value"})


@query("load_duplicates", f"""with r as (select l_linenumber::int as k, (l_partkey % 20)::int as y, (l_suppkey % 20)::int as x, (l_orderkey % 5)::int as written, l_quantity::double as q from lineitem),
s as (select k, y, x, written, avg(q) as v from r group by all), last as (select k, max(written) as written from s group by k)
select k, y, x, round(v, 6) as value from ({_packed('select s.* from s join last using (k, written)', 'k', 32, 'k, y, x')})""")
def _load_duplicates(spark, sf_dir):
    """Slabs of a level written five times: the last counts."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        col("l_linenumber").cast("int").alias("k"), (col("l_partkey") % 20).cast("int").alias("y"), (col("l_suppkey") % 20).cast("int").alias("x"), (col("l_orderkey") % 5).cast("int").alias("eps"), "l_quantity")
    each = rows.groupBy("eps", "k", "y", "x").agg(F.avg(col("l_quantity").cast("double")).alias("value"))
    table = slabs.to_slabs(Field(each, FieldMeta("Q")), bits=32).withColumn("written", col("eps")).withColumn("eps", F.lit(None).cast("int"))
    out = slabs.load(table, "Q", order="written")["Q"]
    return _rounded(out.df, ["k", "y", "x"], {"value": "value"})


def _sql_geographic(rows: str, more: str) -> str:
    """Longitude (-180 to 180) and latitude of rotated points ``rx, ry`` in degrees."""
    return f"""select {more}, degrees(asin({COS0!r}::double * cos(b) * cos(l) + {SIN0!r}::double * sin(b))) as lat,
 degrees(atan2({math.sin(LON0)!r}::double * q - {math.cos(LON0)!r}::double * side, {math.cos(LON0)!r}::double * q + {math.sin(LON0)!r}::double * side)) as lon
 from (select *, {COS0!r}::double * sin(b) - {SIN0!r}::double * cos(l) * cos(b) as q, sin(l) * cos(b) as side from (select *, radians(rx) as l, radians(ry) as b from ({rows})))"""


@query("regrid_job", f"""{CUBE}, n as (select max(x) + 1 as nx, max(y) + 1 as ny from surf),
ends as (select nx, ny, -1.0::double - 0.005::double as x0, -1.0::double - 0.005::double as y0, -1.0::double + (nx - 0.5::double) * {fx.STEP}::double as x1, -1.0::double + (ny - 0.5::double) * {fx.STEP}::double as y1 from n),
ring as (select nx, ny, x0 + (x1 - x0) * i / 20.0::double as rx, case when s = 0 then y0 else y1 end as ry from ends, range(21) a(i), range(2) b(s)
  union all select nx, ny, case when s = 0 then x0 else x1 end as rx, y0 + (y1 - y0) * i / 20.0::double as ry from ends, range(21) a(i), range(2) b(s)),
box as (select any_value(nx) as nx, any_value(ny) as ny, min(lon) as w, max(lon) as e, min(lat) as s, max(lat) as n from ({_sql_geographic('select * from ring', 'nx, ny')})),
step as (select *, sqrt((e - w) * (e - w) + (n - s) * (n - s)) / sqrt(nx * nx + ny * ny) as d from box),
size as (select *, greatest(1, round((e - w) / d))::int as gx, greatest(1, round((n - s) / d))::int as gy from step),
goal as (select (i % gx)::int as x, (i // gx)::int as y, nx, ny, radians(round(w + d / 2 + (i % gx) * d, 6)) - {LON0!r}::double as dl, radians(round(s + d / 2 + (i // gx) * d, 6)) as b from size, range(10000000) r(i) where i < gx * gy),
back as (select x, y, nx, ny, (degrees(atan2(-cos(b) * sin(dl), {COS0!r}::double * sin(b) - {SIN0!r}::double * cos(b) * cos(dl))) + 1) / {fx.STEP}::double as i,
  (degrees(asin({SIN0!r}::double * sin(b) + {COS0!r}::double * cos(b) * cos(dl))) + 1) / {fx.STEP}::double as j from goal),
near as (select x, y, case when round(i, 9) between 0 and nx - 1 and round(j, 9) between 0 and ny - 1 then floor(round(i, 9) + 0.5)::int end as sx, floor(round(j, 9) + 0.5)::int as sy from back)
select near.x, near.y, round(h.hsurf, 2) as value from near left join surf h on h.x = sx and h.y = sy""")
def _regrid_job(spark, sf_dir):
    """A rotated field written as slabs, through the job, and its output loaded."""
    field = fx.surface(spark, sf_dir).select("x", "y", col("hsurf").alias("value"))
    rows = field.agg(F.max("y")).first()[0]  # one number
    grid = gis.RegularGrid(20, (rows or 0) + 1, -1.0, -1.0, fx.STEP, fx.STEP, fx.POLE)
    source, goal = scratch(spark, "slabs"), scratch(spark, "regridded")
    slabs.save([Field(field, FieldMeta("HSURF", "m", "surface").on_grid(grid))], source, bits=32)
    regrid(spark, [source], goal, "HSURF")
    out = slabs.load_single(slabs.DataSource.of_files(spark, [goal]), "HSURF")
    return _rounded(out.df, ["x", "y"], {"value": "value"}, 2)


@query("stream_complete_runs", None)
def _stream_runs(spark, sf_dir):
    """The same runs as ``complete_runs``, by the gate over a stream of the table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").where("event_type = 'error'")
    assets = events.select(F.date_trunc("day", "ts").cast("timestamp").alias("ref_time"), F.hour("ts").alias("lead_h"))
    out, check = scratch(spark, "runs"), scratch(spark, "gate")
    done = streams.complete_runs(assets, [0, 6, 12, 18]).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema("ref_time timestamp").parquet(out).select(F.date_format("ref_time", "yyyy-MM-dd").alias("day"))


@query("request_interval", """select strftime(d, '%Y-%m-%d') as day, count(*)::bigint as n from (select date_trunc('day', ts) as d from events) where d between timestamp '2024-01-05' and timestamp '2024-01-07' group by d""")
def _interval(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_trunc("day", "ts").cast("timestamp").alias("ref_time"))
    own = runs.Request(ref_time="2024-01-05/2024-01-07T00:00:00+00:00").read(rows)
    return own.groupBy(F.date_format("ref_time", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("request_latest", """select count(*)::bigint as n from (select date_trunc('day', ts) as d from events) where d = (select max(date_trunc('day', ts)) from events)""")
def _latest_request(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_trunc("day", "ts").cast("timestamp").alias("ref_time"))
    return runs.Request(ref_time="latest").read(rows).agg(F.count("*").alias("n"))


@query("duplicate_keys", """select l_linenumber as z, (l_partkey % 20)::int as y, (l_suppkey % 20)::int as x, count(*)::bigint as n from lineitem group by all having count(*) > 1""")
def _duplicates(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(col("l_linenumber").alias("z"), (col("l_partkey") % 20).cast("int").alias("y"), (col("l_suppkey") % 20).cast("int").alias("x"))
    return duplicate_keys(rows, ["z", "y", "x"])


RUNS = """with a as (select distinct date_trunc('day', ts)::timestamp as d, hour(ts) as h from events where event_type = 'error' and hour(ts) in (0, 6, 12, 18)),
done as (select d from a group by d having count(*) = 4)"""


@query("complete_runs", f"{RUNS} select strftime(d, '%Y-%m-%d') as day from done")
def _complete(spark, sf_dir):
    return runs.complete_runs(fx.assets(spark, sf_dir), [0, 6, 12, 18]).select(F.date_format("ref_time", "yyyy-MM-dd").alias("day"))


ORACLE["stream_complete_runs"] = ORACLE["complete_runs"]


@query("latest_complete_run", f"{RUNS} select strftime(max(d), '%Y-%m-%d') as day from done")
def _latest(spark, sf_dir):
    return runs.latest_complete_run(fx.assets(spark, sf_dir), [0, 6, 12, 18]).select(F.date_format("ref_time", "yyyy-MM-dd").alias("day"))


@query("filter_request", f"{CUBE} select x, y, k, round(e, 6) as value from half where k in (10, 20, 64)")
def _filter(spark, sf_dir):
    table = fx.half_levels(spark, sf_dir).withColumns({"levelist": col("k"), "param": F.lit("W")})
    return _rounded(runs.Request(param="W", levelist=[10, 20, 64]).read(table), ["x", "y", "k"], {"value": "e"})


MODELS, ASKED = ("COSMO-1E", "COSMO-2E", "ICON-CH1-EPS", "OTHER"), ("U", "W", "HHL", "T", "NONE")


@query("level_expansion", f"""with r as (select {list(MODELS)!r}[1 + p_partkey % 4] as model, {list(ASKED)!r}[1 + p_partkey % 5] as param from part),
known as (select r.*, id as param_id, n + stag as top from r join (values ('U', 500028, 0), ('W', 500032, 1), ('HHL', 500008, 1), ('T', 500014, 0)) p(param, id, stag) using (param)
  join (values ('COSMO-1E', 80), ('COSMO-2E', 60), ('ICON-CH1-EPS', 80)) m(model, n) using (model))
select model, param, param_id::int as param_id, k::int as k, count(*)::bigint as n from known, range(1, 82) s(k) where k <= top group by all""")
def _levels(spark, sf_dir):
    """A request for each row of a table."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (col("p_partkey") % n).cast("int"))
    asked = part.select(pick(MODELS, 4).alias("model"), pick(ASKED, 5).alias("param"))
    return runs.expand_levels(asked).groupBy("model", "param", "param_id", "k").agg(F.count("*").alias("n"))


@query("asset_keys", """select strftime(timestamp '2024-01-01' + to_hours((event_id % 600)::int), '%Y-%m-%d %H:%M') as ref_time, (event_id % 121)::int as lead_h, count(*)::bigint as n from events group by all""")
def _asset_keys(spark, sf_dir):
    at = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(event_id % 600 as int))")
    url = F.concat(F.lit("field-"), F.date_format(at, "yyyyMMddHHmm"), F.lit("-"), (col("event_id") % 121).cast("string"), F.lit("-v.grib2"))
    ref, lead = runs.asset_keys(url)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_format(ref, "yyyy-MM-dd HH:mm").alias("ref_time"), lead.alias("lead_h"))
    return rows.groupBy("ref_time", "lead_h").agg(F.count("*").alias("n"))
