"""Independent SQL for every registered query (DuckDB dialect), written from
the operator definitions, over the same tables. Doubles are rounded to 6
places as in the registry."""

from __future__ import annotations

from tidemark.operators.attribution import MODERATE_SHARE as MODERATE, STRONG_SHARE as STRONG
from tidemark.operators.context import INSIGHT_FIELDS, SCORE_LABEL
from tidemark.operators.requests import MSG_FORMAT, MSG_FRIDAY, MSG_RANGE, REPORT_END, REPORT_START
from tidemark.plans import roles as R

H, LAG = R.HORIZON, R.LAG
CUT, BND = R.TRAIN_CUTOFF, R.EVAL_BOUNDARY
IDX = R.INDEX_DRIVERS


def reven(e: str, digits: int) -> str:
    """NumPy-style half-even rounding of the binary value."""
    if digits == 0:
        return f"round_even({e}, 0)"
    return f"(round_even(({e}) * {float(10 ** digits)!r}, 0) / {float(10 ** digits)!r})"


def r6(e: str, alias: str) -> str:
    return f"{reven(e, 6)} AS {alias}"


# ---- shared CTEs ------------------------------------------------------------

SPOT1 = """spot1 AS (SELECT CAST(o_orderdate AS DATE) AS ssd, avg(o_totalprice) AS price
  FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)"""

SPOTM = """spotm AS (SELECT l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS ssd,
  avg(l_extendedprice) AS price FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2)"""

IDXL = f"""idxl AS (SELECT CAST(l_shipdate AS DATE) AS ssd, l_returnflag || '_' || l_linestatus AS driver,
  l_extendedprice AS value FROM lineitem
  WHERE l_shipdate IS NOT NULL AND (l_returnflag || '_' || l_linestatus) <> '{R.EXCLUDED_DRIVER}')"""

IDXW = "idxw AS (SELECT ssd, " + ", ".join(
    f"avg(CASE WHEN driver = '{c}' THEN value END) AS \"{c}\"" for c in IDX) + \
    " FROM idxl WHERE value IS NOT NULL AND driver IN (" + ", ".join(f"'{c}'" for c in IDX) + \
    ") GROUP BY ssd)"

INV = """inv AS (SELECT CAST(l_shipdate AS DATE) AS ssd, sum(l_quantity) AS inventory
  FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1)"""

FRT = """frt AS (SELECT CAST(l_shipdate AS DATE) AS ssd, avg(l_tax) AS freight FROM lineitem
  WHERE l_linenumber = 1 AND l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1)"""

GCOLS = [*IDX, "inventory", "freight"]
FEATS = R.FEATURES


def q(c: str) -> str:
    return f'"{c}"'


# Single-series merged frame (union calendar) and its fill.
MERGED1 = "m1 AS (SELECT coalesce(s.ssd, i.ssd, v.ssd, f.ssd) AS ssd, s.price, " + \
    ", ".join(f"i.{q(c)}" for c in IDX) + """, v.inventory, f.freight
  FROM spot1 s FULL JOIN idxw i ON s.ssd = i.ssd
  FULL JOIN inv v ON coalesce(s.ssd, i.ssd) = v.ssd
  FULL JOIN frt f ON coalesce(s.ssd, i.ssd, v.ssd) = f.ssd)"""


def filled(name: str, src: str, cols: list[str], part: str = "") -> str:
    pb = f"PARTITION BY {part} " if part else ""
    keep = f"{part}, " if part else ""
    exprs = ", ".join(
        f"coalesce(last_value({q(c)} IGNORE NULLS) OVER wf, first_value({q(c)} IGNORE NULLS) OVER wb) AS {q(c)}"
        for c in cols)
    return (f"{name} AS (SELECT {keep}ssd, {exprs} FROM {src} "
            f"WINDOW wf AS ({pb}ORDER BY ssd ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"wb AS ({pb}ORDER BY ssd ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")


FF1 = filled("ff1", "m1", FEATS)
FRAME1 = ",\n".join([SPOT1, IDXL, IDXW, INV, FRT, MERGED1, FF1])

# Many-series frame: own dates, date-only drivers from a filled daily calendar.
GM = "gm AS (SELECT coalesce(i.ssd, v.ssd, f.ssd) AS ssd, " + \
    ", ".join(f"i.{q(c)}" for c in IDX) + """, v.inventory, f.freight
  FROM idxw i FULL JOIN inv v ON i.ssd = v.ssd
  FULL JOIN frt f ON coalesce(i.ssd, v.ssd) = f.ssd)"""
CALD = """cald AS (SELECT CAST(unnest(generate_series(min(ssd), max(ssd), INTERVAL 1 DAY)) AS DATE) AS ssd FROM gm),
calj AS (SELECT c.ssd, """ + ", ".join(f"g.{q(c)}" for c in GCOLS) + """ FROM cald c LEFT JOIN gm g ON c.ssd = g.ssd)"""
CALF = filled("calf", "calj", GCOLS)
FRAMEM = ",\n".join([SPOTM, IDXL, IDXW, INV, FRT, GM, CALD, CALF]) + """,
ffm AS (SELECT s.series_id, s.ssd, s.price, """ + ", ".join(f"c.{q(c)}" for c in GCOLS) + """
  FROM spotm s LEFT JOIN calf c
  ON c.ssd = least(greatest(s.ssd, (SELECT min(ssd) FROM cald)), (SELECT max(ssd) FROM cald)))"""


def labels_cte(spot: str, part: str = "") -> str:
    pb = f"PARTITION BY {part} " if part else ""
    keep = f"a.{part}, " if part else ""
    on = f"b.{part} = a.{part} AND " if part else ""
    return f"""nn AS (SELECT *, row_number() OVER ({pb}ORDER BY ssd) AS rn FROM {spot}),
lab AS (SELECT {keep}a.ssd, a.price AS current_spot_price, b.ssd AS predicted_for,
  CAST(h.k AS INTEGER) AS days_ahead, (b.price - a.price) / nullif(a.price, 0) AS y
  FROM nn a CROSS JOIN (SELECT unnest(range(1, {H + 1})) AS k) h
  LEFT JOIN nn b ON {on}b.rn = a.rn + h.k)"""


def baseline_rows(spot: str, part: str = "") -> str:
    pb = f"PARTITION BY {part} " if part else ""
    keep = f"l.{part}, " if part else ""
    on = f"p.{part} = l.{part} AND " if part else ""
    return labels_cte(spot, part) + f""",
bp AS (SELECT {part + ', ' if part else ''}ssd, CASE WHEN count(*) OVER w = {LAG}
  THEN avg(price) OVER w / nullif(price, 0) - 1 END AS prediction FROM {spot}
  WINDOW w AS ({pb}ORDER BY ssd ROWS BETWEEN {LAG - 1} PRECEDING AND CURRENT ROW)),
ev AS (SELECT {keep}l.ssd, l.current_spot_price, l.predicted_for, l.days_ahead, l.y, p.prediction,
  l.current_spot_price * l.y + l.current_spot_price AS actual_price,
  l.current_spot_price * p.prediction + l.current_spot_price AS predicted_price
  FROM lab l JOIN bp p ON {on}p.ssd = l.ssd
  WHERE p.prediction IS NOT NULL AND l.y IS NOT NULL),
er AS (SELECT *, abs(predicted_price - actual_price) / nullif(actual_price, 0) AS ape,
  CASE WHEN sign(y) = sign(prediction) THEN 1 ELSE 0 END AS da,
  CASE WHEN ssd >= DATE '{BND}' THEN 'validation' ELSE 'train' END AS period FROM ev)"""


def summary(part: str = "") -> str:
    keep = f"{part}, " if part else ""
    return f"""SELECT {keep}days_ahead, period, {r6('avg(ape)', 'mape')}, {r6('avg(da)', 'da')},
  count(*) AS n,
  {r6('avg(pow(y - prediction, 2)) * 2 / (1 + avg(CASE WHEN sign(y) = sign(prediction) THEN 1.0 ELSE 0.0 END))', 'directional_loss')}
  FROM er GROUP BY ALL"""


def pivot(metric: str) -> str:
    return f"""SELECT days_ahead,
  {r6(f"avg(CASE WHEN period = 'train' THEN {metric} END)", 'train_mean')},
  nullif(count(CASE WHEN period = 'train' THEN {metric} END), 0) AS train_count,
  {r6(f"avg(CASE WHEN period = 'validation' THEN {metric} END)", 'validation_mean')},
  nullif(count(CASE WHEN period = 'validation' THEN {metric} END), 0) AS validation_count
  FROM er GROUP BY days_ahead"""


ORACLE: dict[str, str] = {}

ORACLE["spot_daily"] = f"WITH {SPOT1} SELECT ssd, {r6('price', 'price')} FROM spot1"

ORACLE["labels_long"] = f"""WITH {SPOT1}, {labels_cte('spot1')}
SELECT ssd, {r6('current_spot_price', 'current_spot_price')}, predicted_for, days_ahead, {r6('y', 'y')} FROM lab"""

ORACLE["baseline_eval"] = f"WITH {SPOT1}, {baseline_rows('spot1')}\n{summary()}"
ORACLE["baseline_eval_many"] = f"WITH {SPOTM}, {baseline_rows('spotm', 'series_id')}\n{summary('series_id')}"
ORACLE["eval_rows"] = f"""WITH {SPOT1}, {baseline_rows('spot1')}
SELECT ssd, {r6('current_spot_price', 'current_spot_price')}, predicted_for, days_ahead, {r6('y', 'y')},
  {r6('prediction', 'prediction')}, {r6('actual_price', 'actual_price')}, {r6('predicted_price', 'predicted_price')},
  {r6('ape', 'ape')}, da, period FROM er"""
ORACLE["eval_mape"] = f"WITH {SPOT1}, {baseline_rows('spot1')}\n{pivot('ape')}"
ORACLE["eval_da"] = f"WITH {SPOT1}, {baseline_rows('spot1')}\n{pivot('da')}"

# ---- scans, pivot, merge, fills ---------------------------------------------

ORACLE["index_scan"] = f"WITH {IDXL} SELECT ssd, driver, {r6('value', 'value')} FROM idxl"
ORACLE["index_pivot"] = f"WITH {IDXL}, {IDXW} SELECT ssd, " + ", ".join(
    r6(q(c), q(c)) for c in IDX) + " FROM idxw"
ORACLE["inventory_scan"] = f"WITH {INV} SELECT ssd, {r6('inventory', 'inventory')} FROM inv"
ORACLE["freight_scan"] = f"WITH {FRT} SELECT ssd, {r6('freight', 'freight')} FROM frt"

_PREFIX = r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"


def lenient(e: str) -> str:
    return (f"CASE WHEN ({e}) IS NULL THEN NULL ELSE coalesce(TRY_CAST(nullif("
            f"regexp_extract({e}, '{_PREFIX}', 1), '') AS DOUBLE), 0.0) END")


_PTXT = "printf('%.2f', o_totalprice)"
ORACLE["real_cast"] = f"""SELECT o_orderkey,
  {r6(lenient('o_orderpriority'), 'r_priority')},
  {r6(lenient('o_orderstatus'), 'r_status')},
  {r6(lenient(f"' ' || {_PTXT} || 'x'"), 'r_padded')},
  {r6(lenient(f"replace({_PTXT}, '.', ',')"), 'r_comma')},
  {r6(lenient(f"'.' || substr({_PTXT}, 1, 2) || 'e2'"), 'r_exp')},
  {r6(lenient("CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END"), 'r_null')},
  {r6('TRY_CAST(o_orderpriority AS DOUBLE)', 's_priority')},
  {r6(f'TRY_CAST({_PTXT} AS DOUBLE)', 's_price')}
  FROM orders"""

ORACLE["outer_merge"] = f"WITH {FRAME1} SELECT ssd, " + ", ".join(r6(q(c), q(c)) for c in FEATS) + " FROM m1"
ORACLE["ffill"] = f"WITH {FRAME1} SELECT ssd, " + ", ".join(
    r6(f"last_value({q(c)} IGNORE NULLS) OVER (ORDER BY ssd ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", q(c))
    for c in FEATS) + " FROM m1"
ORACLE["feature_frame"] = f"WITH {FRAME1} SELECT ssd, " + ", ".join(r6(q(c), q(c)) for c in FEATS) + " FROM ff1"
ORACLE["feature_frame_many"] = f"WITH {FRAMEM} SELECT series_id, ssd, " + ", ".join(
    r6(q(c), q(c)) for c in FEATS) + " FROM ffm"

UNIONM = FRAMEM + """,
ud AS (SELECT series_id, ssd FROM spotm UNION SELECT s.series_id, g.ssd FROM (SELECT DISTINCT series_id FROM spotm) s CROSS JOIN gm g),
um AS (SELECT u.series_id, u.ssd, s.price, """ + ", ".join(f"g.{q(c)}" for c in GCOLS) + """ FROM ud u
  LEFT JOIN spotm s ON s.series_id = u.series_id AND s.ssd = u.ssd LEFT JOIN gm g ON g.ssd = u.ssd),
""" + filled("ffu", "um", FEATS, "series_id")
ORACLE["feature_frame_union_many"] = f"WITH {UNIONM} SELECT series_id, ssd, " + ", ".join(r6(q(c), q(c)) for c in FEATS) + " FROM ffu"

ORACLE["feature_order"] = f"WITH {FRAME1} " + " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS driver, count({q(c)}) AS n_known FROM m1" for i, c in enumerate(FEATS))

ORACLE["label_profile"] = f"""WITH {SPOT1}, {labels_cte('spot1')}
SELECT min(ssd) AS first_ssd, count(DISTINCT ssd) AS n_dates, count(*) AS n_rows, count(y) AS n_labelled FROM lab"""

TEXT_ORDERS = """tx AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS ssd, o_orderdate IS NULL AS no_date,
  CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE CAST(printf('%.2f', o_totalprice) AS DOUBLE) END AS price, o_orderpriority LIKE '5%' AS bad FROM orders),
spot1 AS (SELECT ssd, avg(price) AS price FROM tx WHERE ssd IS NOT NULL GROUP BY ssd)"""
_FRAMET = ",\n".join([TEXT_ORDERS, IDXL, IDXW, INV, FRT, MERGED1, FF1, labels_cte("spot1")])
ORACLE["stage_profile"] = f"WITH {_FRAMET} " + " UNION ALL ".join(
    f"SELECT '{stage}' AS stage, '{metric}' AS metric, {e} AS n FROM {src}" for stage, src, metric, e in [
        ("spot_scan", "tx", "rows", "count(*)"), ("spot_scan", "tx", "null_dates", "count(*) FILTER (no_date)"),
        ("spot_scan", "tx", "bad_dates", "count(*) FILTER (ssd IS NULL AND NOT no_date)"),
        ("spot_scan", "tx", "bad_values", "count(*) FILTER (bad)"),
        ("spot", "spot1", "rows", "count(*)"), ("spot", "spot1", "price", "count(price)"),
        *[(st, src, m, "count(*)" if m == "rows" else f"count({q(m)})") for st, src in (("merged", "m1"), ("frame", "ff1")) for m in ["rows", *FEATS]],
        *[("labels", "lab", m, "count(*)" if m == "rows" else f"count({m})") for m in ("rows", "y", "predicted_for")]])

ORACLE["csv_roundtrip"] = ORACLE["labels_long"]
ORACLE["snapshot"] = ORACLE["spot_daily"]

REQ_DAYS = """rq AS (SELECT DISTINCT ssd FROM (SELECT CAST(o_orderdate AS DATE) AS ssd FROM orders
  UNION ALL SELECT CAST(o_orderdate AS DATE) + 1 FROM orders) t WHERE ssd IS NOT NULL)"""
ORACLE["current_spot"] = f"""WITH {SPOT1}, {REQ_DAYS}
SELECT r.ssd, {reven('s.price', 2)} AS current_spot,
  CASE WHEN s.price IS NULL THEN 'missing' ELSE 'ok' END AS status
  FROM rq r LEFT JOIN spot1 s ON r.ssd = s.ssd"""

# ---- windows, training set, scaling -----------------------------------------

FR1 = FRAME1 + ",\nfr AS (SELECT *, row_number() OVER (ORDER BY ssd) AS rn FROM ff1)"
FRM = FRAMEM + ",\nfrm AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ssd) AS rn FROM ffm)"
VALS = ", ".join(r6(f"r.{q(c)}", q(c)) for c in FEATS)

ORACLE["lag_windows"] = f"""WITH {FR1}
SELECT e.ssd, CAST(r.rn - e.rn + {LAG - 1} AS INTEGER) AS step, r.ssd AS lag_date, {VALS}
  FROM fr e JOIN fr r ON r.rn BETWEEN e.rn - {LAG - 1} AND e.rn WHERE e.rn >= {LAG}"""

ORACLE["lag_window_sums_many"] = f"""WITH {FRM},
wd AS (SELECT series_id, ssd, rn, lag(ssd, {LAG - 1}) OVER w AS first_lag_date, """ + ", ".join(
    " + ".join(f"lag({q(c)}, {k}) OVER w * {LAG - k}" for k in range(LAG - 1, -1, -1)) + f" AS {q(c)}" for c in FEATS) + f"""
  FROM frm WINDOW w AS (PARTITION BY series_id ORDER BY ssd))
SELECT series_id, ssd, first_lag_date, """ + ", ".join(f"{reven(q(c) + ' + 1e-7', 3)} AS {q(c)}" for c in FEATS) + f" FROM wd WHERE rn >= {LAG}"

ORACLE["lag_window_rows_many"] = f"""WITH {FRM}
SELECT e.series_id, e.ssd, CAST(r.rn - e.rn + {LAG - 1} AS INTEGER) AS step, r.ssd AS lag_date, {VALS}
  FROM (SELECT series_id, ssd, rn, rn - unnest(range(0, {LAG})) AS at FROM frm WHERE rn >= {LAG}) e
  JOIN frm r ON r.series_id = e.series_id AND r.rn = e.at"""
ORACLE["lag_windows_many"] = ORACLE["lag_window_rows_many"]

ORACLE["asof_windows"] = f"""WITH {FR1},
pb AS (SELECT DISTINCT CAST(o_orderdate AS DATE) + 3 AS ssd FROM orders WHERE o_orderdate IS NOT NULL),
pe AS (SELECT p.ssd, max(f.rn) AS e FROM pb p JOIN fr f ON f.ssd <= p.ssd GROUP BY p.ssd)
SELECT p.ssd, CAST(r.rn - greatest(p.e - {LAG - 1}, 1) AS INTEGER) AS step, r.ssd AS lag_date, {VALS}
  FROM pe p JOIN fr r ON r.rn BETWEEN p.e - {LAG - 1} AND p.e"""

SAMPLES1 = FR1 + ",\n" + labels_cte("spot1") + f""",
smp AS (SELECT f.* FROM fr f WHERE f.rn >= {LAG} AND f.ssd IN (SELECT ssd FROM spot1))"""

ORACLE["training_set"] = f"""WITH {SAMPLES1}
SELECT s.ssd, s.ssd < DATE '{CUT}' AS is_train, {r6('s.price', 'x_last_price')}, l.days_ahead, {r6('l.y', 'y')}
  FROM smp s JOIN lab l ON l.ssd = s.ssd"""

ORACLE["train_split"] = f"""WITH {SAMPLES1}
SELECT ssd < DATE '{CUT}' AS is_train, count(*) AS n_samples, min(ssd) AS first_ssd, max(ssd) AS last_ssd
  FROM smp GROUP BY 1"""

ORACLE["fit_split"] = f"""WITH {SAMPLES1},
t AS (SELECT ssd, row_number() OVER (ORDER BY ssd) AS k, count(*) OVER () AS n FROM smp WHERE ssd < DATE '{CUT}')
SELECT ssd, k > floor(n * 0.75) AS is_val FROM t"""

PARAMS1 = SAMPLES1 + f""",
xr AS (SELECT r.* FROM smp e JOIN fr r ON r.rn BETWEEN e.rn - {LAG - 1} AND e.rn WHERE e.ssd < DATE '{CUT}'),
pw AS (SELECT """ + ", ".join(
    f"quantile_cont({q(c)}, 0.5) AS \"c_{c}\", "
    f"CASE WHEN quantile_cont({q(c)}, 0.75) - quantile_cont({q(c)}, 0.25) = 0 THEN 1.0 "
    f"ELSE quantile_cont({q(c)}, 0.75) - quantile_cont({q(c)}, 0.25) END AS \"s_{c}\"" for c in FEATS) + " FROM xr)"

ORACLE["robust_params"] = f"WITH {PARAMS1} " + " UNION ALL ".join(
    f"SELECT '{c}' AS driver, {r6(q('c_' + c), 'center')}, {r6(q('s_' + c), 'scale')} FROM pw" for c in FEATS)

ORACLE["scaled_windows"] = f"""WITH {PARAMS1},
sf AS (SELECT f.ssd, f.rn, """ + ", ".join(
    f"(f.{q(c)} - pw.{q('c_' + c)}) / pw.{q('s_' + c)} AS {q(c)}" for c in FEATS) + f""" FROM fr f CROSS JOIN pw)
SELECT e.ssd, CAST(r.rn - e.rn + {LAG - 1} AS INTEGER) AS step, r.ssd AS lag_date, {VALS}
  FROM sf e JOIN sf r ON r.rn BETWEEN e.rn - {LAG - 1} AND e.rn WHERE e.rn >= {LAG}"""

FRIDAYS = """fri AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ssd FROM orders
  WHERE o_orderdate IS NOT NULL AND isodow(CAST(o_orderdate AS DATE)) = 5)"""

ORACLE["recent_history"] = f"""WITH {FR1}, {FRIDAYS},
pe AS (SELECT p.ssd, max(f.rn) AS e FROM fri p JOIN fr f ON f.ssd <= p.ssd GROUP BY p.ssd),
h AS (SELECT p.ssd, CAST(r.rn - greatest(p.e - {LAG - 1}, 1) AS INTEGER) AS step, r.ssd AS hist_date, r.*
  FROM pe p JOIN fr r ON r.rn BETWEEN p.e - {LAG - 1} AND p.e)
""" + " UNION ALL ".join(
    f"SELECT ssd, '{c}' AS driver, step, hist_date, {r6(reven(q(c), 2), 'value')} FROM h" for c in FEATS)

ORACLE["history_many"] = f"""WITH {FRM},
pe AS (SELECT series_id, ssd, rn FROM frm WHERE isodow(ssd) = 5),
h AS (SELECT p.series_id, p.ssd, CAST(r.rn - greatest(p.rn - {LAG - 1}, 1) AS INTEGER) AS step, r.ssd AS hist_date, """ + \
    ", ".join(f"r.{q(c)}" for c in FEATS) + f"""
  FROM (SELECT series_id, ssd, rn, rn - unnest(range(0, {LAG})) AS at FROM pe) p
  JOIN frm r ON r.series_id = p.series_id AND r.rn = p.at)
""" + " UNION ALL ".join(
    f"SELECT series_id, ssd, '{c}' AS driver, step, hist_date, {r6(reven(q(c), 2), 'value')} FROM h" for c in FEATS)

# ---- fitted ridge models (closed form of one input) ---------------------------


def ridge(spot: str, part: str = "") -> str:
    keep = f"{part}, " if part else ""
    on = f"USING ({part})" if part else "ON true"
    iqr = "quantile_cont(price, 0.75) - quantile_cont(price, 0.25)"
    return labels_cte(spot, part) + f""",
rp AS (SELECT {keep}quantile_cont(price, 0.5) AS c, CASE WHEN {iqr} = 0 THEN 1.0 ELSE {iqr} END AS s
  FROM {spot} WHERE ssd < DATE '{CUT}' {"GROUP BY " + part if part else ""}),
sx AS (SELECT t.*, (t.current_spot_price - rp.c) / rp.s AS x FROM lab t JOIN rp {on}),
rm AS (SELECT {keep}days_ahead, covar_pop(y, x) / (var_pop(x) + {R.RIDGE}) AS slope, avg(y) AS my, avg(x) AS mx, count(*) AS n
  FROM sx WHERE ssd < DATE '{CUT}' AND y IS NOT NULL GROUP BY ALL)"""


def ridge_models(spot: str, part: str = "") -> str:
    return (f"SELECT {part + ', ' if part else ''}days_ahead, {r6('slope', 'slope')}, "
            f"{r6('my - slope * mx', 'intercept')}, n, 1 AS dim FROM rm")


ORACLE["fit_ridge"] = f"WITH {SPOT1}, {ridge('spot1')}\n{ridge_models('spot1')}"
ORACLE["fit_ridge_many"] = f"WITH {SPOTM}, {ridge('spotm', 'series_id')}\n{ridge_models('spotm', 'series_id')}"
ORACLE["ridge_eval_many"] = f"""WITH {SPOTM}, {ridge('spotm', 'series_id')},
ev AS (SELECT sx.*, slope * x + my - slope * mx AS prediction,
  current_spot_price * y + current_spot_price AS actual_price,
  current_spot_price * (slope * x + my - slope * mx) + current_spot_price AS predicted_price
  FROM sx JOIN rm USING (series_id, days_ahead) WHERE y IS NOT NULL),
er AS (SELECT *, abs(predicted_price - actual_price) / nullif(actual_price, 0) AS ape,
  CASE WHEN sign(y) = sign(prediction) THEN 1 ELSE 0 END AS da,
  CASE WHEN ssd >= DATE '{BND}' THEN 'validation' ELSE 'train' END AS period FROM ev)
{summary('series_id')}"""

# the gradient of the penalised error at its minimum; the split is that of fit_split
ORACLE["fit_gradient"] = f"""WITH {SAMPLES1},
t AS (SELECT ssd, row_number() OVER (ORDER BY ssd) AS k, count(*) OVER () AS n FROM smp WHERE ssd < DATE '{CUT}'),
fitted AS (SELECT l.days_ahead, count(*) AS n FROM t JOIN lab l USING (ssd) WHERE t.k <= floor(t.n * 0.75) AND l.y IS NOT NULL GROUP BY ALL)
SELECT days_ahead, CAST(i.input AS INTEGER) AS input, n, 0.0::DOUBLE AS gradient
  FROM fitted CROSS JOIN (SELECT unnest(range(-1, {LAG * len(FEATS)})) AS input) i"""

ORACLE["momentum_eval"] = f"WITH {SPOT1}, " + baseline_rows("spot1").replace(
    f"THEN avg(price) OVER w / nullif(price, 0) - 1 END", f"THEN price / nullif(first_value(price) OVER w, 0) - 1 END") + f"\n{summary()}"

# ---- linear scoring ------------------------------------------------------------

NF = len(FEATS)


def fixed_w(j: str, h: str) -> str:
    return f"((((({j}) * 7 + {h}) % 11) - 5) / 1000.0)"


def score_sql(src: str, part: str = "") -> str:
    """Σ x·w over the window, + b (the engine sums in BLAS order; values are
    compared after 6-place rounding)."""
    on = f"r.{part} = e.{part} AND " if part else ""
    keep = f"e.{part}, " if part else ""
    prods = ", ".join(f"r.{q(c)} * {fixed_w(f'(r.rn - e.rn + {LAG - 1}) * {NF} + {i}', 'h.k')}"
                      for i, c in enumerate(FEATS))
    return f"""sc AS (SELECT {keep}e.ssd, CAST(h.k AS INTEGER) AS days_ahead,
  list_reduce(list(list_reduce([{prods}], lambda a, b: a + b) ORDER BY r.rn), lambda a, b: a + b)
    + h.k / 1000.0 AS prediction
  FROM {src} e JOIN {src} r ON {on}r.rn BETWEEN e.rn - {LAG - 1} AND e.rn
  CROSS JOIN (SELECT unnest(range(1, {H + 1})) AS k) h
  WHERE e.rn >= {LAG} GROUP BY {keep}e.ssd, h.k)"""


SCALED1 = PARAMS1 + """,
sf AS (SELECT f.ssd, f.rn, """ + ", ".join(
    f"(f.{q(c)} - pw.{q('c_' + c)}) / pw.{q('s_' + c)} AS {q(c)}" for c in FEATS) + " FROM fr f CROSS JOIN pw)"

ORACLE["score_linear"] = f"""WITH {SCALED1}, {score_sql('sf')}
SELECT ssd, days_ahead, {r6('prediction', 'prediction')} FROM sc"""

PARAMSM = FRM + f""",
xrm AS (SELECT r.* FROM frm e JOIN frm r ON r.series_id = e.series_id AND r.rn BETWEEN e.rn - {LAG - 1} AND e.rn
  WHERE e.rn >= {LAG} AND e.ssd < DATE '{CUT}'),
pwm AS (SELECT series_id, """ + ", ".join(
    f"quantile_cont({q(c)}, 0.5) AS \"c_{c}\", "
    f"CASE WHEN quantile_cont({q(c)}, 0.75) - quantile_cont({q(c)}, 0.25) = 0 THEN 1.0 "
    f"ELSE quantile_cont({q(c)}, 0.75) - quantile_cont({q(c)}, 0.25) END AS \"s_{c}\"" for c in FEATS) + \
    " FROM xrm GROUP BY series_id)"

ORACLE["robust_params_many"] = f"WITH {PARAMSM} " + " UNION ALL ".join(
    f"SELECT series_id, '{c}' AS driver, {r6(q('c_' + c), 'center')}, {r6(q('s_' + c), 'scale')} FROM pwm"
    for c in FEATS)

SCALEDM = PARAMSM + """,
sfm AS (SELECT f.series_id, f.ssd, f.rn, """ + ", ".join(
    f"(f.{q(c)} - p.{q('c_' + c)}) / p.{q('s_' + c)} AS {q(c)}" for c in FEATS) + \
    " FROM frm f LEFT JOIN pwm p ON p.series_id = f.series_id)"

ORACLE["predictions_long"] = f"""WITH {SCALEDM}, {score_sql('sfm', 'series_id')}
SELECT series_id, ssd, days_ahead, {r6('prediction', 'prediction')} FROM sc"""

ORACLE["predictions_wide"] = f"""WITH {SCALED1}, {score_sql('sf')}
SELECT ssd, """ + ", ".join(
    r6(f"max(CASE WHEN days_ahead = {h} THEN prediction END)", f"h{h}") for h in range(1, H + 1)) + \
    " FROM sc GROUP BY ssd"

ORACLE["directional_loss"] = f"""WITH {SPOT1}, {baseline_rows('spot1')}
SELECT days_ahead, period, {r6('avg(pow(y - prediction, 2))', 'mse')},
  {r6('avg(pow(y - prediction, 2)) * 2 / (1 + avg(CASE WHEN sign(y) = sign(prediction) THEN 1.0 ELSE 0.0 END))', 'directional_loss')}
  FROM er GROUP BY ALL"""

# ---- calendar, forecast path, requests ---------------------------------------

ORACLE["business_days"] = f"""WITH dd AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS ssd FROM orders WHERE o_orderdate IS NOT NULL),
c AS (SELECT ssd, CAST(ssd + CAST(t.i AS INTEGER) AS DATE) AS bday FROM dd CROSS JOIN range(1, 15) t(i)
  WHERE isodow(CAST(ssd + CAST(t.i AS INTEGER) AS DATE)) <= 5),
k AS (SELECT ssd, CAST(row_number() OVER (PARTITION BY ssd ORDER BY bday) AS INTEGER) AS k, bday FROM c)
SELECT ssd, k, bday, strftime(bday, '%Y-%m-%d') AS bday_text FROM k WHERE k <= {H}"""

PATH1 = f"""{SPOT1}, {FRIDAYS},
bp AS (SELECT ssd, CASE WHEN count(*) OVER w = {LAG} THEN avg(price) OVER w / nullif(price, 0) - 1 END AS prediction
  FROM spot1 WINDOW w AS (ORDER BY ssd ROWS BETWEEN {LAG - 1} PRECEDING AND CURRENT ROW)),
cs AS (SELECT f.ssd, {reven('s.price', 2)} AS current_spot FROM fri f JOIN spot1 s ON s.ssd = f.ssd WHERE s.price IS NOT NULL),
bd AS (SELECT ssd, CAST(ssd + CAST(t.i AS INTEGER) AS DATE) AS bday FROM cs CROSS JOIN range(1, 15) t(i)
  WHERE isodow(CAST(ssd + CAST(t.i AS INTEGER) AS DATE)) <= 5),
bk AS (SELECT ssd, CAST(row_number() OVER (PARTITION BY ssd ORDER BY bday) AS INTEGER) AS k, bday FROM bd),
fp AS (SELECT c.ssd, CAST(h.k AS INTEGER) AS days_ahead, b.bday AS future_date,
  CAST({reven(f"c.current_spot * {reven('p.prediction', 2)} + c.current_spot", 0)} AS BIGINT) AS forecast_price,
  c.current_spot
  FROM cs c JOIN bp p ON p.ssd = c.ssd CROSS JOIN (SELECT unnest(range(1, {H + 1})) AS k) h
  JOIN bk b ON b.ssd = c.ssd AND b.k = h.k WHERE p.prediction IS NOT NULL)"""

ORACLE["forecast_path"] = f"""WITH {PATH1}
SELECT ssd, days_ahead, future_date, forecast_price, {r6('current_spot', 'current_spot')} FROM fp"""

REQS = """rqs AS (SELECT DISTINCT friday_date FROM (
  SELECT strftime(ts, '%Y-%m-%d') AS friday_date FROM events
  UNION ALL SELECT strftime(ts, '%Y/%m/%d') FROM events
  UNION ALL SELECT CAST(year(ts) AS VARCHAR) || '-' || CAST(month(ts) AS VARCHAR) || '-' || CAST(day(ts) AS VARCHAR) FROM events
  UNION ALL SELECT '2024-02-' || strftime(ts, '%d') FROM events
  UNION ALL SELECT strftime(ts - INTERVAL 120 MONTH, '%Y-%m-%d') FROM events
  UNION ALL SELECT strftime(ts + INTERVAL 36 MONTH, '%Y-%m-%d') FROM events
  UNION ALL SELECT props FROM events) t),
rv AS (SELECT friday_date AS request,
  CASE WHEN regexp_matches(friday_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')
    THEN CAST(try_strptime(friday_date, '%Y-%m-%d') AS DATE) END AS report_date FROM rqs),
rr AS (SELECT request, report_date, CASE WHEN report_date IS NULL THEN '""" + MSG_FORMAT + """'
  WHEN isodow(report_date) <> 5 THEN '""" + MSG_FRIDAY + """'
  WHEN report_date NOT BETWEEN DATE '""" + REPORT_START + """' AND DATE '""" + REPORT_END + """'
    THEN '""" + MSG_RANGE.format(start=REPORT_START, end=REPORT_END) + """' END AS reason FROM rv)"""

ORACLE["request_validation"] = f"""WITH {REQS}
SELECT request, report_date, reason IS NULL AS is_valid,
  CASE WHEN reason IS NULL THEN 200 ELSE 400 END AS status_code, reason FROM rr"""

# ---- attribution -------------------------------------------------------------

ATTR1 = SCALED1 + f""", {FRIDAYS},
bgk AS (SELECT s.ssd, s.rn FROM sf s WHERE s.rn >= {LAG} AND s.ssd IN (SELECT ssd FROM spot1)
  ORDER BY md5(strftime(s.ssd, '%Y-%m-%d') || ':{R.SEED}'), s.ssd LIMIT {R.BACKGROUND_N}),
bgm AS (SELECT r.rn - b.rn + {LAG - 1} AS step, """ + ", ".join(f"avg(r.{q(c)}) AS {q('m_' + c)}" for c in FEATS) + \
    f""" FROM bgk b JOIN sf r ON r.rn BETWEEN b.rn - {LAG - 1} AND b.rn GROUP BY 1),
aw AS (SELECT e.ssd, r.rn - e.rn + {LAG - 1} AS step, r.ssd AS lag_date, """ + \
    ", ".join(f"r.{q(c)}" for c in FEATS) + f""" FROM sf e JOIN sf r ON r.rn BETWEEN e.rn - {LAG - 1} AND e.rn
  WHERE e.rn >= {LAG} AND e.ssd IN (SELECT ssd FROM fri)),
sc AS (""" + " UNION ALL ".join(
    f"""SELECT a.ssd, CAST(h.k AS INTEGER) AS days_ahead, '{c}' AS driver, CAST(a.step AS INTEGER) AS lag_step,
  a.lag_date, {fixed_w(f'a.step * {NF} + {i}', 'h.k')} * (a.{q(c)} - m.{q('m_' + c)}) AS score
  FROM aw a JOIN bgm m ON m.step = a.step CROSS JOIN (SELECT unnest(range(1, {H + 1})) AS k) h"""
    for i, c in enumerate(FEATS)) + ")"

ORACLE["background_sample"] = f"WITH {ATTR1} SELECT ssd FROM bgk"
ORACLE["attribution_long"] = f"""WITH {ATTR1}
SELECT ssd, days_ahead, driver, lag_step, lag_date, {r6('score', 'score')} FROM sc"""

ORACLE["attribution_driver"] = f"""WITH {ATTR1},
bd AS (SELECT ssd, CAST(ssd + CAST(t.i AS INTEGER) AS DATE) AS bday FROM fri CROSS JOIN range(1, 15) t(i)
  WHERE isodow(CAST(ssd + CAST(t.i AS INTEGER) AS DATE)) <= 5),
bk AS (SELECT ssd, CAST(row_number() OVER (PARTITION BY ssd ORDER BY bday) AS INTEGER) AS k, bday FROM bd)
SELECT s.ssd, s.days_ahead, '{SCORE_LABEL}' || strftime(b.bday, '%Y-%m-%d') AS label, s.lag_step, s.lag_date,
  {r6('s.score', 'score')}, s.driver
  FROM sc s JOIN bk b ON b.ssd = s.ssd AND b.k = s.days_ahead"""

SUMM1 = ATTR1 + """,
sm AS (SELECT ssd, days_ahead, driver, sum(score) AS total, sum(abs(score)) AS abs_total FROM sc GROUP BY ALL),
sm2 AS (SELECT *, abs_total / nullif(sum(abs_total) OVER (PARTITION BY ssd, days_ahead), 0) AS share FROM sm)"""

ORACLE["attribution_summary"] = f"""WITH {SUMM1}
SELECT ssd, days_ahead, driver, {r6('total + 1e-9', 'total')}, {r6('abs_total + 1e-9', 'abs_total')}, {r6('share + 1e-9', 'share')} FROM sm2"""

ORACLE["driver_role"] = f"""WITH {SUMM1},
{score_sql('sf').replace('WHERE e.rn >= ' + str(LAG), 'WHERE e.rn >= ' + str(LAG) + ' AND e.ssd IN (SELECT ssd FROM fri)').replace('sc AS (', 'pr AS (', 1)},
cs AS (SELECT f.ssd, {reven('s.price', 2)} AS current_spot FROM fri f JOIN spot1 s ON s.ssd = f.ssd),
lastp AS (SELECT c.ssd, c.current_spot,
  {reven(f"c.current_spot * {reven('p.prediction', 2)} + c.current_spot", 0)} AS last_price
  FROM cs c JOIN pr p ON p.ssd = c.ssd AND p.days_ahead = {H}),
dd AS (SELECT ssd, driver, count(*) AS n, sum(CASE WHEN total > 0 THEN 1 ELSE 0 END) AS npos,
  sum(CASE WHEN total < 0 THEN 1 ELSE 0 END) AS nneg, sum(abs_total) AS a FROM sm2 GROUP BY ALL),
de AS (SELECT d.*, d.a / nullif(sum(d.a) OVER (PARTITION BY d.ssd), 0) AS share,
  CASE WHEN npos = n THEN 'UPWARD' WHEN nneg = n THEN 'DOWNWARD' ELSE 'MIXED' END AS attribution_direction,
  CASE WHEN l.last_price > l.current_spot THEN 'UPWARD' WHEN l.last_price < l.current_spot THEN 'DOWNWARD'
    ELSE 'FLAT' END AS forecast_direction
  FROM dd d JOIN lastp l ON l.ssd = d.ssd)
SELECT ssd, driver, attribution_direction, forecast_direction,
  CASE WHEN attribution_direction IN ('UPWARD', 'DOWNWARD') AND attribution_direction = forecast_direction THEN 'SUPPORTING'
    WHEN attribution_direction IN ('UPWARD', 'DOWNWARD') AND forecast_direction IN ('UPWARD', 'DOWNWARD') THEN 'OPPOSING'
    ELSE 'NEUTRAL' END AS role,
  CASE WHEN share >= {STRONG} THEN 'STRONG' WHEN share >= {MODERATE} THEN 'MODERATE' ELSE 'LOW' END AS strength,
  {r6('share', 'share')} FROM de"""

# every supplier on its own Fridays; windows by equal row numbers, not ranges
ATTRM = SCALEDM + f""",
frim AS (SELECT series_id, ssd FROM spotm WHERE isodow(ssd) = 5),
lagk AS (SELECT unnest(range(0, {LAG})) AS step),
bgkm AS (SELECT series_id, rn FROM sfm WHERE rn >= {LAG}
  QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY md5(strftime(ssd, '%Y-%m-%d') || ':{R.SEED}'), ssd) <= {R.BACKGROUND_N}),
bgmm AS (SELECT b.series_id, k.step, """ + ", ".join(f"avg(r.{q(c)}) AS {q('m_' + c)}" for c in FEATS) + \
    f""" FROM bgkm b CROSS JOIN lagk k JOIN sfm r ON r.series_id = b.series_id AND r.rn = b.rn - {LAG - 1} + k.step GROUP BY ALL),
awm AS (SELECT e.series_id, e.ssd, k.step, """ + ", ".join(f"r.{q(c)}" for c in FEATS) + \
    f""" FROM sfm e JOIN frim USING (series_id, ssd) CROSS JOIN lagk k
  JOIN sfm r ON r.series_id = e.series_id AND r.rn = e.rn - {LAG - 1} + k.step WHERE e.rn >= {LAG}),
hk AS (SELECT unnest(range(1, {H + 1})) AS k),
smm AS (""" + " UNION ALL ".join(
    f"""SELECT a.series_id, a.ssd, CAST(hk.k AS INTEGER) AS days_ahead, '{c}' AS driver,
  sum({fixed_w(f'a.step * {NF} + {i}', 'hk.k')} * (a.{q(c)} - m.{q('m_' + c)})) AS total,
  sum(abs({fixed_w(f'a.step * {NF} + {i}', 'hk.k')} * (a.{q(c)} - m.{q('m_' + c)}))) AS abs_total
  FROM awm a JOIN bgmm m ON m.series_id = a.series_id AND m.step = a.step CROSS JOIN hk GROUP BY ALL"""
    for i, c in enumerate(FEATS)) + ")"

ORACLE["attribution_many"] = f"""WITH {ATTRM}
SELECT series_id, ssd, days_ahead, driver, {r6('total + 1e-9', 'total')}, {r6('abs_total + 1e-9', 'abs_total')},
  {r6('abs_total / nullif(sum(abs_total) OVER (PARTITION BY series_id, ssd, days_ahead), 0) + 1e-9', 'share')} FROM smm"""

ORACLE["driver_role_many"] = f"""WITH {ATTRM},
prm AS (SELECT a.series_id, a.ssd, sum(""" + " + ".join(
    f"a.{q(c)} * {fixed_w(f'a.step * {NF} + {i}', str(H))}" for i, c in enumerate(FEATS)) + f""") + {H} / 1000.0 AS prediction
  FROM awm a GROUP BY ALL),
csm AS (SELECT series_id, ssd, {reven('price', 2)} AS current_spot FROM spotm JOIN frim USING (series_id, ssd) WHERE price IS NOT NULL),
lpm AS (SELECT c.series_id, c.ssd, c.current_spot,
  {reven(f"c.current_spot * {reven('p.prediction', 2)} + c.current_spot", 0)} AS last_price
  FROM csm c JOIN prm p ON p.series_id = c.series_id AND p.ssd = c.ssd),
ddm AS (SELECT series_id, ssd, driver, count(*) AS n, count(*) FILTER (total > 0) AS npos,
  count(*) FILTER (total < 0) AS nneg, sum(abs_total) AS a FROM smm GROUP BY ALL),
dem AS (SELECT d.*, d.a / nullif(sum(d.a) OVER (PARTITION BY d.series_id, d.ssd), 0) AS share,
  CASE WHEN npos = n THEN 'UPWARD' WHEN nneg = n THEN 'DOWNWARD' ELSE 'MIXED' END AS attribution_direction,
  CASE WHEN l.last_price > l.current_spot THEN 'UPWARD' WHEN l.last_price < l.current_spot THEN 'DOWNWARD'
    ELSE 'FLAT' END AS forecast_direction
  FROM ddm d JOIN lpm l ON l.series_id = d.series_id AND l.ssd = d.ssd)
SELECT series_id, ssd, driver, attribution_direction, forecast_direction,
  CASE WHEN attribution_direction IN ('UPWARD', 'DOWNWARD') AND attribution_direction = forecast_direction THEN 'SUPPORTING'
    WHEN attribution_direction IN ('UPWARD', 'DOWNWARD') AND forecast_direction IN ('UPWARD', 'DOWNWARD') THEN 'OPPOSING'
    ELSE 'NEUTRAL' END AS role,
  CASE WHEN share >= {STRONG} THEN 'STRONG' WHEN share >= {MODERATE} THEN 'MODERATE' ELSE 'LOW' END AS strength,
  {r6('share + 1e-9', 'share')} FROM dem"""

# ---- dictionary, context, report ---------------------------------------------

def _dictionary_values() -> str:
    import json
    from tidemark.sources.dictionary import DEFAULT_PATH, INFO_FIELDS
    doc = json.load(open(DEFAULT_PATH))

    def lit(s):
        return "'" + s.replace("'", "''") + "'"
    rows = ", ".join("(" + ", ".join([lit(k)] + [lit(v[f]) for f in INFO_FIELDS]) + ")" for k, v in doc.items())
    return f"dct AS (SELECT * FROM (VALUES {rows}) t(driver, " + ", ".join(INFO_FIELDS) + "))"


DICT = _dictionary_values()

ORACLE["driver_dictionary"] = f"WITH {FRAME1}, {DICT}, kd AS (" + " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS driver, count({q(c)}) AS n_known FROM m1" for i, c in enumerate(FEATS)) + \
    """) SELECT k.pos, k.driver, k.n_known, d.business_name, d.asset_class, d.macro_role, d.relationship_to_target
  FROM kd k LEFT JOIN dct d ON d.driver = k.driver"""

NL = "chr(10)"


def table_text(header: str, line: str, order: str) -> str:
    return (f"'[' || CAST(count(*) AS VARCHAR) || ']{{{header}}}:' || {NL} || "
            f"string_agg('  ' || {line}, {NL} ORDER BY {order})")


HIST = f"""pe AS (SELECT p.ssd, max(f.rn) AS e FROM fri p JOIN fr f ON f.ssd <= p.ssd GROUP BY p.ssd),
h AS (SELECT p.ssd, CAST(r.rn - greatest(p.e - {LAG - 1}, 1) AS INTEGER) AS step, r.ssd AS hist_date, r.*
  FROM pe p JOIN fr r ON r.rn BETWEEN p.e - {LAG - 1} AND p.e),
hl AS (""" + " UNION ALL ".join(
    f"SELECT ssd, '{c}' AS driver, step, hist_date, {reven(q(c), 2)} AS value FROM h" for c in FEATS) + f"""),
ht AS (SELECT ssd, driver, {table_text('ssd,value', "strftime(hist_date, '%Y-%m-%d') || ',' || printf('%.2f', value)", 'step')} AS history
  FROM hl GROUP BY ssd, driver)"""

ORACLE["table_encode"] = f"WITH {FR1}, {FRIDAYS}, {HIST} SELECT ssd, driver, history FROM ht"

_ROLE_SQL = ORACLE["driver_role"]
_ROLE_BODY = _ROLE_SQL[len("WITH "):]
_ROLE_CTES, _ROLE_SELECT = _ROLE_BODY.rsplit("\nSELECT ssd, driver, attribution_direction", 1)
CTX = _ROLE_CTES + f""",
rl AS (SELECT ssd, driver, attribution_direction{_ROLE_SELECT}),
bd AS (SELECT ssd, CAST(ssd + CAST(t.i AS INTEGER) AS DATE) AS bday FROM cs CROSS JOIN range(1, 15) t(i)
  WHERE isodow(CAST(ssd + CAST(t.i AS INTEGER) AS DATE)) <= 5),
bk AS (SELECT ssd, CAST(row_number() OVER (PARTITION BY ssd ORDER BY bday) AS INTEGER) AS k, bday FROM bd),
fpt AS (SELECT c.ssd, c.current_spot, p.days_ahead, b.bday AS future_date,
  CAST({reven(f"c.current_spot * {reven('p.prediction', 2)} + c.current_spot", 0)} AS BIGINT) AS forecast_price
  FROM cs c JOIN pr p ON p.ssd = c.ssd JOIN bk b ON b.ssd = c.ssd AND b.k = p.days_ahead),
ftx AS (SELECT ssd, first(current_spot) AS current_spot,
  {table_text('day,price', "strftime(future_date, '%Y-%m-%d') || ',' || printf('%d', forecast_price)", 'days_ahead')} AS forecast
  FROM fpt GROUP BY ssd),
atx AS (SELECT s.ssd, s.driver,
  {table_text('horizon,score', f"'{SCORE_LABEL}' || strftime(f.future_date, '%Y-%m-%d') || ',' || printf('%.4f', " + reven(reven('s.total', 9), 4) + ")", 's.days_ahead')} AS attribution
  FROM sm2 s JOIN fpt f ON f.ssd = s.ssd AND f.days_ahead = s.days_ahead GROUP BY s.ssd, s.driver),
stl AS (SELECT ssd, driver, days_ahead, string_agg(strftime(lag_date, '%Y-%m-%d') || ':' || printf('%.4f', {reven(reven('score', 9), 4)}), ' ' ORDER BY lag_step) AS t
  FROM sc GROUP BY ALL),
stx AS (SELECT s.ssd, s.driver,
  {table_text('horizon,scores', f"'{SCORE_LABEL}' || strftime(f.future_date, '%Y-%m-%d') || ',' || s.t", 's.days_ahead')} AS step_scores
  FROM stl s JOIN fpt f ON f.ssd = s.ssd AND f.days_ahead = s.days_ahead GROUP BY s.ssd, s.driver),
{HIST},
ctx AS (SELECT ht.ssd, ht.driver, ht.history, atx.attribution, stx.step_scores, rl.attribution_direction, rl.forecast_direction,
  rl.role, rl.strength, ftx.forecast, ftx.current_spot, d.business_name, d.asset_class, d.macro_role,
  d.relationship_to_target
  FROM ht JOIN atx ON atx.ssd = ht.ssd AND atx.driver = ht.driver
  JOIN stx ON stx.ssd = ht.ssd AND stx.driver = ht.driver
  JOIN rl ON rl.ssd = ht.ssd AND rl.driver = ht.driver
  JOIN ftx ON ftx.ssd = ht.ssd LEFT JOIN dct d ON d.driver = ht.driver)"""

ORACLE["driver_context"] = f"""WITH {CTX.replace(FRIDAYS + ',', FRIDAYS + ', ' + DICT + ',', 1)}
SELECT ssd, driver, history, attribution, step_scores, attribution_direction, forecast_direction, role, strength, forecast,
  {r6('current_spot', 'current_spot')}, business_name, asset_class, macro_role, relationship_to_target FROM ctx"""

_PROMPT = f" || {NL} || ".join(f"({x})" for x in [
    f"'[driver] id=' || driver || ' on=' || strftime(ssd, '%Y-%m-%d') || ' spot=' || printf('%.1f', {reven('current_spot', 1)})",
    "'stance=' || coalesce(role, '-') || '; weight=' || coalesce(strength, '-') || '; pushes=' || "
    "coalesce(attribution_direction, '-') || '; path=' || coalesce(forecast_direction, '-')",
    "'title=' || coalesce(business_name, '-') || '; class=' || coalesce(asset_class, '-') || '; theme=' || "
    "coalesce(macro_role, '-') || '; link=' || coalesce(relationship_to_target, '-')",
    "'[scores] total per horizon'", "attribution", "'[steps] score per horizon and lag date, oldest first'", "step_scores", "'[path] price per business day'", "forecast",
    "'[series] latest values, oldest first'", "history"])

ORACLE["context_render"] = f"""WITH {CTX.replace(FRIDAYS + ',', FRIDAYS + ', ' + DICT + ',', 1)}
SELECT ssd, driver, {_PROMPT} AS prompt FROM ctx"""

REPORTS = CTX.replace(FRIDAYS + ',', FRIDAYS + ', ' + DICT + ',', 1) + f""",
rp AS (SELECT f.ssd, cs.current_spot, ftx.forecast, coalesce(st.n, 0) AS n_steps, coalesce(nd.n, 0) AS n_drivers,
  coalesce(nd.told, 0) AS n_insights,
  CASE WHEN cs.current_spot IS NULL THEN 'missing current price' WHEN coalesce(st.n, 0) < {H} THEN 'missing forecast path'
    WHEN coalesce(nd.n, 0) = 0 THEN 'missing driver context' END AS reason
  FROM fri f LEFT JOIN cs ON cs.ssd = f.ssd LEFT JOIN ftx ON ftx.ssd = f.ssd
  LEFT JOIN (SELECT ssd, count(forecast_price) AS n FROM fpt GROUP BY ssd) st ON st.ssd = f.ssd
  LEFT JOIN (SELECT ssd, count(*) AS n, count(*) FILTER (strength <> 'LOW') AS told FROM ctx GROUP BY ssd) nd ON nd.ssd = f.ssd)"""

ORACLE["report_context"] = f"""WITH {REPORTS}
SELECT rp.ssd, {r6('rp.current_spot', 'current_spot')}, rp.forecast, rp.n_steps, rp.n_drivers, rp.n_insights,
  rp.reason IS NULL AS is_valid, rp.reason, c.driver, c.business_name, c.role, c.strength,
  CASE WHEN c.strength <> 'LOW' THEN c.driver || ' ' || c.role || ' ' || c.strength END AS explanation
  FROM rp LEFT JOIN ctx c ON c.ssd = rp.ssd"""

ORACLE["report_text"] = f"""WITH {REPORTS},
dl AS (SELECT ssd, string_agg('- ' || coalesce(business_name, driver) || ' (' || coalesce(role, '-') || ', ' || coalesce(strength, '-') || ')' ||
  CASE WHEN strength <> 'LOW' THEN ': ' || driver || ' ' || role || ' ' || strength ELSE '' END, {NL} ORDER BY driver) AS said FROM ctx GROUP BY ssd)
SELECT rp.ssd, '[report] on=' || strftime(rp.ssd, '%Y-%m-%d') || ' spot=' || coalesce(printf('%.2f', rp.current_spot), '-') || ' state=' ||
  coalesce(rp.reason, 'complete') || {NL} || '[path] price per business day' || {NL} || coalesce(rp.forecast, '-') || {NL} ||
  '[drivers] ' || rp.n_drivers || ', explained ' || rp.n_insights || coalesce({NL} || dl.said, '') AS report
  FROM rp LEFT JOIN dl ON dl.ssd = rp.ssd"""

ORACLE["request_outcome"] = f"""WITH {REPORTS},
asked AS (SELECT ssd AS day FROM fri UNION ALL SELECT CAST(ssd + 7301 AS DATE) FROM fri UNION ALL SELECT CAST(ssd + 1 AS DATE) FROM fri),
ck AS (SELECT day, CASE WHEN isodow(day) <> 5 THEN '{MSG_FRIDAY}'
  WHEN day NOT BETWEEN DATE '{R.REQUEST_START}' AND DATE '{R.REQUEST_END}'
    THEN '{MSG_RANGE.format(start=R.REQUEST_START, end=R.REQUEST_END)}' END AS reason FROM asked),
oc AS (SELECT ck.day, ck.reason, rp.reason AS why, rp.ssd IS NOT NULL AS n, rp.ssd IS NOT NULL AND rp.reason IS NULL AS whole
  FROM ck LEFT JOIN rp ON rp.ssd = ck.day)
SELECT strftime(day, '%Y-%m-%d') AS request, day AS report_date, reason IS NULL AS is_valid,
  CASE WHEN reason IS NULL THEN 200 ELSE 400 END AS status_code, reason, CAST(n AS BIGINT) AS n_reports, CAST(whole AS BIGINT) AS n_complete,
  CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN whole THEN 'done' ELSE 'failed' END AS status,
  CASE WHEN reason IS NULL AND NOT whole THEN coalesce(why, 'no spot for the date') END AS outcome_reason FROM oc"""

_INS = INSIGHT_FIELDS

ORACLE["insight_parse"] = f"""WITH {_ROLE_CTES},
rl AS (SELECT ssd, driver, attribution_direction{_ROLE_SELECT}),
fl AS (SELECT ssd, driver, 'full' AS variant, driver AS feature_name, attribution_direction AS feature_behavior,
  role AS shap_interpretation, forecast_direction AS forecast_alignment, strength AS influence_strength,
  driver || ' ' || role || ' ' || strength AS analyst_explanation, TRUE AS valid FROM rl),
cut AS (SELECT ssd, driver, 'cut' AS variant, """ + ", ".join(f"CAST(NULL AS VARCHAR) AS {f}" for f in _INS) + """,
  FALSE AS valid FROM rl),
wrapped AS (SELECT fl.* REPLACE (v.variant AS variant, CASE WHEN v.variant = 'odd' THEN '}{"' || fl.feature_name ELSE fl.feature_name END AS feature_name)
  FROM fl CROSS JOIN (VALUES ('fenced'), ('told'), ('odd')) v(variant)),
ev AS (SELECT CAST(ts AS DATE) AS ssd, 'props' AS driver, 'props' AS variant, """ + ", ".join(
    f"CASE WHEN json_valid(props) THEN json_extract_string(props, '$.{f}') END AS {f}" for f in _INS) + """,
  json_valid(props) AS valid FROM events),
allr AS (SELECT * FROM fl UNION ALL SELECT * FROM wrapped UNION ALL SELECT * FROM cut UNION ALL SELECT * FROM ev)
SELECT ssd, driver, variant, """ + ", ".join(_INS) + """, CASE WHEN NOT valid THEN 'malformed' WHEN """ + \
    " AND ".join(f"{f} IS NOT NULL" for f in _INS) + """ THEN 'ok' ELSE 'incomplete' END AS parse_status FROM allr"""

# ---- scalable paths: identical results to the global window ------------------

ORACLE["feature_frame_two_pass"] = ORACLE["feature_frame"]
ORACLE["lag_windows_halo"] = ORACLE["lag_windows"]
ORACLE["labels_halo"] = ORACLE["labels_long"]
ORACLE["fit_split_blocks"] = ORACLE["fit_split"]

# ---- artifacts and incremental ingest -------------------------------------------

ORACLE["windows_dataset"] = ORACLE["training_set"].rstrip() + f"\n  WHERE s.ssd < DATE '{CUT}'"
ORACLE["scaler_artifact"] = ORACLE["robust_params"]
ORACLE["model_artifact"] = ORACLE["score_linear"]
ORACLE["snapshot_stream"] = ORACLE["spot_daily"]
ORACLE["frame_csv"] = ORACLE["feature_frame"]
ORACLE["windows_splits"] = ORACLE["training_set"]
ORACLE["predictions_bucketed"] = ORACLE["predictions_long"]
ORACLE["robust_params_histogram"] = ORACLE["robust_params"]

# ---- end-to-end jobs ------------------------------------------------------------

ORACLE["job_labels"] = ORACLE["labels_long"]
ORACLE["job_features"] = ORACLE["feature_frame"]
ORACLE["job_windows"] = ORACLE["training_set"]
ORACLE["job_scaler"] = ORACLE["robust_params"]
ORACLE["job_outcomes"] = ORACLE["request_outcome"]
ORACLE["job_backtest"] = f"""WITH {SAMPLES1}
SELECT l.days_ahead, CASE WHEN s.ssd >= DATE '{BND}' THEN 'validation' ELSE 'train' END AS period, count(*) AS n, count(*) AS n_ape,
  count(*) AS n_da, min(s.ssd) AS first_ssd, max(s.ssd) AS last_ssd
  FROM smp s JOIN lab l ON l.ssd = s.ssd WHERE l.y IS NOT NULL GROUP BY ALL"""
