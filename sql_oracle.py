"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each function returns one SQL string over the pre-registered views
(region nation customer supplier part orders lineitem events ...). The
derived panels are CTEs built with the same integer formulas as
``lakeshift.sources.derived``; double literals are written ``0.8e0`` so
DuckDB does not make them DECIMAL.
"""

from __future__ import annotations

DW_COLUMNS = ("water", "trees", "grass", "flooded_vegetation", "crops",
              "shrub_and_scrub", "built", "bare", "snow_and_ice")
DW_SUM = "bare + water + snow_and_ice + trees + grass + flooded_vegetation + crops + shrub_and_scrub + built"
JRC_SUM = "area_land + area_water_permanent + area_water_seasonal"

STATS = ("mean", "median", "std", "min", "max")
_AGG = {"mean": "avg", "median": "median", "std": "stddev_samp", "min": "min", "max": "max"}


def rnd(expr: str, places: int = 4) -> str:
    """numpy rounding: half to even on the scaled double."""
    scale = f"{10 ** places}.0e0"
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


def rounded(sql: str, cols, places: int = 4) -> str:
    """Wrap ``sql`` and round the listed DOUBLE columns half away from zero."""
    scale = f"{10 ** places}.0e0"
    rep = ", ".join(f"round({c} * {scale}, 0) / {scale} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) q" if cols else sql


# --------------------------------------------------------------------------- panels

def planted_rows() -> str:
    return """
 pa_k AS (SELECT s_suppkey AS k FROM supplier),
 pa_g AS (SELECT k, unnest(range(60)) AS m FROM pa_k),
 pa_b AS (SELECT k, m, CAST(100 + (k % 7) * 10 AS DOUBLE) AS total,
                 CASE WHEN k % 3 = 0 THEN 20 + k % 20 END AS brk FROM pa_g),
 pa_v AS (SELECT k, m, total,
                 total * ((CASE WHEN brk IS NULL OR m < brk THEN 0.8e0 ELSE 0.3e0 END)
                          + CAST((k * 37 + m * 17) % 5 AS DOUBLE) * 0.005e0) AS water,
                 total * (CASE WHEN (k + m) % 12 = 0 THEN 0.1e0 ELSE 0.01e0 END) AS snow
          FROM pa_b)"""


def planted_panel() -> str:
    """CTE list defining ``panel`` (DW) from supplier x 60 months."""
    return planted_rows() + """,
 panel AS (SELECT 'lk' || lpad(CAST(k AS VARCHAR), CAST(greatest(length(CAST(k AS VARCHAR)), 6) AS INTEGER), '0') AS id_geohash,
                  CAST(DATE '2017-01-01' + to_months(CAST(m AS INTEGER)) AS DATE) AS date,
                  water, 0.0e0 AS trees, 0.0e0 AS grass, 0.0e0 AS flooded_vegetation, 0.0e0 AS crops,
                  0.0e0 AS shrub_and_scrub, 0.0e0 AS built,
                  CASE WHEN (k + m * 5) % 23 = 0 THEN 0.0e0 ELSE total - water - snow END AS bare,
                  snow AS snow_and_ice
           FROM pa_v)"""


def planted_jrc() -> str:
    """CTE list defining ``panel`` (JRC twin)."""
    return planted_rows() + """,
 panel AS (SELECT 'lk' || lpad(CAST(k AS VARCHAR), CAST(greatest(length(CAST(k AS VARCHAR)), 6) AS INTEGER), '0') AS id_geohash,
                  make_date(CAST(1962 + m AS INTEGER), 1, 1) AS date,
                  CASE WHEN (k + m * 5) % 23 = 0 THEN 0.0e0 ELSE total - water - snow END AS area_land,
                  snow AS area_water_seasonal,
                  water AS area_water_permanent
           FROM pa_v)"""


def ship_panel() -> str:
    """CTE list defining ``panel`` from lineitem (supplier x ship month x class)."""
    cols = ",\n".join(
        f"  coalesce(sum(CASE WHEN cls = {i} THEN l_quantity END), 0.0e0) AS {c}"
        for i, c in enumerate(DW_COLUMNS))
    return f"""
 sp_rows AS (SELECT 'sp' || lpad(CAST(l_suppkey AS VARCHAR), CAST(greatest(length(CAST(l_suppkey AS VARCHAR)), 6) AS INTEGER), '0') AS id_geohash,
                    CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
                    CAST(l_partkey % 9 AS INTEGER) AS cls, l_quantity FROM lineitem),
 panel AS (SELECT id_geohash, date,
{cols}
           FROM sp_rows GROUP BY id_geohash, date)"""


def prepared(family: str = "dw", nodata_max: str = "0.0e0", mask: bool = True, src: str = "panel") -> str:
    """CTEs ``pr_a``..``prep`` on top of ``panel``: area, max, nodata, norm, valid."""
    if family == "dw":
        total, classes, limits = DW_SUM, DW_COLUMNS, " AND snow_and_ice / max_area <= 0.05e0"
    else:
        total = JRC_SUM
        classes = ("area_land", "area_water_seasonal", "area_water_permanent")
        limits = ""
    variables = list(classes) + ["area_data", "area_nodata"]
    valid = f"coalesce(area_nodata / max_area <= {nodata_max}{limits}, false)" if mask else "true"
    water = "water" if family == "dw" else "area_water_permanent"
    raw = ", ".join(f"CASE WHEN valid THEN {v} END AS {v}" for v in variables)
    nrm = ", ".join(f"CASE WHEN valid THEN {v} / max_area END AS {v}_norm" for v in variables)
    return f""",
 pr_a AS (SELECT *, {total} AS area_data, {water} IS NOT NULL AS raw_ok FROM {src}),
 pr_b AS (SELECT *, max(area_data) OVER (PARTITION BY id_geohash) AS max_area FROM pr_a),
 pr_c AS (SELECT *, {rnd("max_area - area_data")} AS area_nodata FROM pr_b),
 pr_d AS (SELECT *, {valid} AS valid FROM pr_c),
 prep AS (SELECT id_geohash, date, {raw}, max_area, {nrm}, valid, raw_ok FROM pr_d)"""


# --------------------------------------------------------------------------- detectors

def simple_breaks(panel_ctes: str, water: str, window: int = 3, method: str = "median",
                  threshold: str = "-0.25e0") -> str:
    stat = {"median": "quantile_cont({v}, 0.5)", "mean": "avg({v})", "max": "max({v})"}[method]
    s1 = stat.format(v="wn")
    pre = ", ".join(f"{_AGG[s]}(CASE WHEN date <= brk THEN wa END) AS pre_break_{s}" for s in STATS)
    post = ", ".join(f"{_AGG[s]}(CASE WHEN date > brk THEN wa END) AS post_break_{s}" for s in STATS)
    return f"""WITH {panel_ctes},
 sb_r AS (SELECT id_geohash, date, {water} AS wa, {water}_norm AS wn,
                 row_number() OVER w AS rn,
                 {s1} OVER (w ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS r1,
                 {s1} OVER (w ROWS BETWEEN {window + 1} PRECEDING AND CURRENT ROW) AS r2,
                 lag(date) OVER w AS prev_date, lead(date) OVER w AS next_date
          FROM prep WHERE valid
          WINDOW w AS (PARTITION BY id_geohash ORDER BY date)),
 sb_f AS (SELECT *, coalesce(rn >= {window} AND wn - r1 < {threshold}, false) AS hit_p,
                    coalesce(rn >= {window + 2} AND wn - r2 < {threshold}, false) AS hit_s FROM sb_r),
 sb_g AS (SELECT *, hit_p AND lead(hit_s, 1, false) OVER (PARTITION BY id_geohash ORDER BY date) AS is_break
          FROM sb_f),
 sb_h AS (SELECT *, min(CASE WHEN is_break THEN date END) OVER (PARTITION BY id_geohash) AS brk FROM sb_g),
 sb_a AS (SELECT id_geohash, min(brk) AS date_break,
                 max(CASE WHEN date = brk THEN prev_date END) AS date_before_break,
                 max(CASE WHEN date = brk THEN next_date END) AS date_after_break,
                 'simple' AS break_method, {pre}, {post}
          FROM sb_h WHERE brk IS NOT NULL GROUP BY id_geohash)
SELECT id_geohash, date_break, date_before_break, date_after_break, break_method,
       pre_break_mean, nullif(pre_break_median, 0) AS pre_break_median, pre_break_std, pre_break_min, pre_break_max,
       post_break_mean, nullif(post_break_median, 0) AS post_break_median, post_break_std, post_break_min,
       post_break_max,
       CAST(year(date_break) AS INTEGER) AS date_break_year, CAST(month(date_break) AS INTEGER) AS date_break_month,
       nullif(post_break_median, 0) - nullif(pre_break_median, 0) AS water_change_ha,
       (nullif(post_break_median, 0) - nullif(pre_break_median, 0)) / nullif(pre_break_median, 0) * 100.0e0
           AS water_change_perc
FROM sb_a"""


BREAK_DOUBLES = ([f"pre_break_{s}" for s in STATS] + [f"post_break_{s}" for s in STATS]
                 + ["water_change_ha", "water_change_perc"])


# --------------------------------------------------------------------------- NRT

Z90 = "1.6448536269514722e0"
HIST = ("mean", "median", "std", "min", "max")
NRT_VALUES = ["water_observed", "water_predicted", "water_residual", "water_predicted_lower_90",
              "water_predicted_upper_90"] + [f"water_historical_{s}" for s in HIST]
NRT_DOUBLES = NRT_VALUES + [f"{c}_absolute" for c in NRT_VALUES]


def _norm_vars(family: str) -> str:
    classes = DW_COLUMNS if family == "dw" else ("area_land", "area_water_seasonal", "area_water_permanent")
    return ", ".join(f"{c}_norm" for c in list(classes) + ["area_data", "area_nodata"])


def _ci(lo: str, hi: str) -> str:
    return (f"coalesce(CAST({rnd(lo, 2)} AS VARCHAR), 'nan') || ' : ' || "
            f"coalesce(CAST({rnd(hi, 2)} AS VARCHAR), 'nan')")


def _nrt_finish(src: str, date_expr: str, valid: str) -> str:
    """Final projection shared by the single-date and the range NRT SQL."""
    absolutes = ", ".join(f"{c} * scale AS {c}_absolute" for c in NRT_VALUES)
    hist = ", ".join(f"{rnd('h_' + s)} AS water_historical_{s}" for s in HIST)
    return f"""
 nf_p AS (SELECT *, CASE WHEN n_hist >= 3 THEN CASE WHEN ar_slope IS NOT NULL
                      THEN ar_intercept + ar_slope * x_last ELSE x_last END END AS pred,
                 CASE WHEN ar_slope IS NULL THEN 0.0e0
                      WHEN n_pairs <= 2 THEN 0.0e0
                      WHEN ar_syy - ar_slope * ar_sxy <= 1e-12 * ar_syy THEN 0.0e0
                      ELSE sqrt((ar_syy - ar_slope * ar_sxy) / n_pairs) END AS sigma
          FROM {src}),
 nf_q AS (SELECT id_geohash, {date_expr} AS date, scale, {valid} AS v_ok,
                 {rnd(f"CASE WHEN {valid} THEN obs END")} AS water_observed,
                 {rnd(f"CASE WHEN {valid} THEN pred END")} AS water_predicted,
                 {rnd(f"CASE WHEN {valid} THEN pred - {Z90} * sigma END")} AS water_predicted_lower_90,
                 {rnd(f"CASE WHEN {valid} THEN pred + {Z90} * sigma END")} AS water_predicted_upper_90,
                 {hist}
          FROM nf_p),
 nf_r AS (SELECT *, {rnd("water_observed - water_predicted")} AS water_residual FROM nf_q),
 nf_s AS (SELECT *, CASE WHEN v_ok THEN CAST(
                   CAST(coalesce(water_residual < -0.25e0, false) AS INTEGER)
                 + CAST(coalesce(water_observed < water_predicted_lower_90, false) AS INTEGER)
                 + CAST(coalesce(water_observed < water_historical_min, false) AS INTEGER) AS INTEGER) END
                   AS drainage_confidence,
                 {absolutes}
          FROM nf_r)
SELECT id_geohash, date, {", ".join(NRT_VALUES[:5])}, {", ".join(NRT_VALUES[5:])}, drainage_confidence,
       {", ".join(c + "_absolute" for c in NRT_VALUES)},
       {_ci("water_predicted_lower_90", "water_predicted_upper_90")} AS water_predicted_ci,
       {_ci("water_predicted_lower_90_absolute", "water_predicted_upper_90_absolute")} AS water_predicted_ci_absolute
FROM nf_s"""


def nrt(panel_ctes: str, water: str, d: str, family: str = "dw", period: str = "all",
        keep_nans: bool = False) -> str:
    """Single analysis date ``d`` ('YYYY-MM-DD')."""
    in_hist = f"date < DATE '{d}'"
    if period == "monthly":
        in_hist += f" AND month(date) = month(DATE '{d}')"
    where = "" if keep_nans else "WHERE valid_at"
    return f"""WITH {panel_ctes},
 nr_r AS (SELECT id_geohash, date, {water}_norm AS wn, area_data,
                 coalesce({_norm_vars(family)}) IS NOT NULL AS any_value,
                 CASE WHEN {in_hist} THEN {water}_norm END AS hw FROM prep),
 nr_x AS (SELECT *, last_value(hw IGNORE NULLS) OVER (PARTITION BY id_geohash ORDER BY date
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS xp FROM nr_r),
 nr_a AS (SELECT id_geohash,
                 max(CASE WHEN date = DATE '{d}' THEN wn END) AS obs,
                 coalesce(bool_or(CASE WHEN date = DATE '{d}' THEN any_value END), false) AS valid_at,
                 max(area_data) AS scale,
                 count(hw) AS n_hist, regr_count(hw, xp) AS n_pairs, regr_slope(hw, xp) AS ar_slope,
                 regr_intercept(hw, xp) AS ar_intercept, regr_syy(hw, xp) AS ar_syy, regr_sxy(hw, xp) AS ar_sxy,
                 max_by(hw, date) FILTER (WHERE hw IS NOT NULL) AS x_last,
                 avg(hw) AS h_mean, median(hw) AS h_median, stddev_samp(hw) AS h_std,
                 min(hw) AS h_min, max(hw) AS h_max
          FROM nr_x GROUP BY id_geohash),
 nr_b AS (SELECT * FROM nr_a {where}),""" + _nrt_finish("nr_b", f"CASE WHEN valid_at THEN DATE '{d}' END",
                                                      "valid_at")


def nrt_range(panel_ctes: str, water: str, start: str, end: str, family: str = "dw",
              period: str = "all") -> str:
    """Every date in [start, end]; the running mean is a left fold in date
    order (as Spark's running sum), not a segment-tree sum."""
    part = "id_geohash" if period == "all" else "id_geohash, month(date)"
    b = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""WITH {panel_ctes},
 rg_r AS (SELECT id_geohash, date, {water}_norm AS y, area_data, raw_ok,
                 coalesce({_norm_vars(family)}) IS NOT NULL AS any_value,
                 max(area_data) OVER (PARTITION BY id_geohash) AS scale FROM prep),
 rg_x AS (SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY date {b}) AS xp FROM rg_r),
 rg_s AS (SELECT id_geohash, date, y AS obs, any_value, raw_ok, scale,
                 count(y) OVER w AS n_hist, regr_count(y, xp) OVER w AS n_pairs,
                 regr_slope(y, xp) OVER w AS ar_slope, regr_intercept(y, xp) OVER w AS ar_intercept,
                 regr_syy(y, xp) OVER w AS ar_syy, regr_sxy(y, xp) OVER w AS ar_sxy,
                 last_value(y IGNORE NULLS) OVER w AS x_last,
                 list_filter(list(y) OVER w, lambda v: v IS NOT NULL) AS hl,
                 quantile_cont(y, 0.5) OVER w AS h_median,
                 stddev_samp(y) OVER w AS h_std, min(y) OVER w AS h_min, max(y) OVER w AS h_max
          FROM rg_x WINDOW w AS (PARTITION BY {part} ORDER BY date {b})),
 rg_m AS (SELECT *, CASE WHEN len(hl) > 0 THEN list_reduce(hl, lambda a, b: a + b) / len(hl) END AS h_mean
          FROM rg_s),
 rg_f AS (SELECT * FROM rg_m WHERE any_value AND raw_ok AND date >= DATE '{start}' AND date <= DATE '{end}'),""" + \
        _nrt_finish("rg_f", "date", "true")


# --------------------------------------------------------------------------- NRT reports

def _q(name: str) -> str:
    return '"' + name + '"'


def drained_month(d: str) -> str:
    ctes = planted_panel() + f""",
 panel_ok AS (SELECT * FROM panel WHERE id_geohash IN
              (SELECT id_geohash FROM panel WHERE date = DATE '{d}' AND water IS NOT NULL))""" + \
        prepared(src="panel_ok")
    return (f"SELECT strftime(date, '%Y-%m') AS analysis_month, * FROM ({nrt(ctes, 'water', d)}) x "
            f"WHERE water_residual < -0.25e0")


def range_drained(start: str, end: str) -> str:
    return (f"SELECT strftime(date, '%Y-%m') AS analysis_month, * FROM "
            f"({nrt_range(planted_panel() + prepared(), 'water', start, end)}) x WHERE water_residual < -0.25e0")


def monthly_counts(start: str, end: str) -> str:
    return f"""WITH months AS (SELECT strftime(unnest(generate_series(DATE '{start}', DATE '{end}',
                                                             INTERVAL 1 MONTH)), '%Y-%m') AS analysis_month),
 d AS ({range_drained(start, end)})
SELECT m.analysis_month, CAST(count(d.id_geohash) AS INTEGER) AS drained_lake_count
FROM months m LEFT JOIN d ON d.analysis_month = m.analysis_month GROUP BY m.analysis_month"""


def counts_matrix(start: str, end: str) -> str:
    cols = ", ".join(f"coalesce(avg(n) FILTER (WHERE month = {m}), 0.0e0) AS m{m:02d}" for m in range(1, 13))
    return f"""WITH c AS ({monthly_counts(start, end)}),
 ym AS (SELECT CAST(substr(analysis_month, 1, 4) AS INTEGER) AS year,
               CAST(substr(analysis_month, 6, 2) AS INTEGER) AS month,
               CAST(drained_lake_count AS DOUBLE) AS n FROM c)
SELECT year, {cols} FROM ym GROUP BY year"""


def ranked_drained(start: str, end: str) -> str:
    return f"""SELECT analysis_month, id_geohash, water_residual AS "Water Residual [%]", water_observed,
       water_predicted, date,
       CAST(row_number() OVER (PARTITION BY analysis_month ORDER BY water_residual ASC NULLS LAST, id_geohash)
            AS INTEGER) AS rank
FROM ({range_drained(start, end)}) r"""


def history_stats(before: str) -> str:
    return f"""WITH {planted_panel()}{prepared()}
SELECT id_geohash, avg(water_norm) AS water_historical_mean, median(water_norm) AS water_historical_median,
       stddev_samp(water_norm) AS water_historical_std, min(water_norm) AS water_historical_min,
       max(water_norm) AS water_historical_max
FROM prep WHERE date < DATE '{before}' GROUP BY id_geohash"""


HIST_DOUBLES = [f"water_historical_{s}" for s in HIST]


# --------------------------------------------------------------------------- panel operations

PREP_DW_DOUBLES = (list(DW_COLUMNS) + ["area_data", "area_nodata", "max_area"]
                   + [c + "_norm" for c in list(DW_COLUMNS) + ["area_data", "area_nodata"]])


def prepare_panel() -> str:
    return f"WITH {ship_panel()}{prepared(nodata_max='1.0e0')} SELECT * EXCLUDE (raw_ok) FROM prep"


def mask_panel() -> str:
    return (f"WITH {planted_panel()}{prepared()} SELECT id_geohash, date, water, water_norm, snow_and_ice_norm, "
            f"area_nodata, valid FROM prep")


def gap_report() -> str:
    return f"""WITH {ship_panel()}{prepared()},
 n AS (SELECT count(DISTINCT date) AS n_dates FROM prep),
 g AS (SELECT id_geohash, count(water) AS n_present FROM prep GROUP BY id_geohash)
SELECT id_geohash, CAST(n_dates - n_present AS BIGINT) AS missing_count,
       (n_dates - (n_dates - n_present)) / n_dates * 100.0e0 AS completion_pct
FROM g, n WHERE (n_dates - (n_dates - n_present)) / n_dates * 100.0e0 < 50.0e0"""


def rolling_sql(method: str) -> str:
    def stat(n):
        fr = f"OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        if method == "mean":
            # left fold in row order, as Spark's frame aggregate
            return f"list_reduce(list(water_norm) {fr}, lambda a, b: a + b) / {n}"
        if method == "max":
            return f"max(water_norm) {fr}"
        return f"quantile_cont(water_norm, 0.5) {fr}"
    return f"""WITH {ship_panel()}{prepared(nodata_max='1.0e0')}
SELECT id_geohash, date, water_norm,
       CASE WHEN row_number() OVER w >= 3 THEN {stat(3)} END AS roll_3,
       CASE WHEN row_number() OVER w >= 5 THEN {stat(5)} END AS roll_5
FROM prep WHERE valid WINDOW w AS (PARTITION BY id_geohash ORDER BY date)"""


def _split(how: str) -> str:
    if how in ("both", "date"):
        return """,
 a AS (SELECT * FROM panel WHERE date < DATE '1998-01-01'),
 b AS (SELECT * FROM panel WHERE date >= DATE '1997-01-01')"""
    return """,
 a AS (SELECT * FROM panel WHERE CAST(substr(id_geohash, 3) AS BIGINT) % 2 = 0
                             OR CAST(substr(id_geohash, 3) AS BIGINT) % 5 = 0),
 b AS (SELECT * FROM panel WHERE CAST(substr(id_geohash, 3) AS BIGINT) % 2 = 1
                             OR CAST(substr(id_geohash, 3) AS BIGINT) % 5 = 0)"""


def merge_sql(how: str) -> str:
    cols = ", ".join(DW_COLUMNS)
    if how == "both":
        vals = ", ".join(f"coalesce(a.{c}, b.{c}) AS {c}" for c in DW_COLUMNS)
        return f"""WITH {ship_panel()}{_split(how)}
SELECT coalesce(a.id_geohash, b.id_geohash) AS id_geohash, coalesce(a.date, b.date) AS date, {vals}
FROM a FULL OUTER JOIN b ON a.id_geohash = b.id_geohash AND a.date = b.date"""
    source = ship_panel() if how == "date" else planted_panel()
    return f"""WITH {source}{_split(how)},
 u AS (SELECT id_geohash, date, {cols}, 0 AS prio FROM a UNION ALL SELECT id_geohash, date, {cols}, 1 FROM b)
SELECT id_geohash, date, {cols} FROM u
QUALIFY row_number() OVER (PARTITION BY id_geohash, date ORDER BY prio DESC) = 1"""


def long_dw(src: str, with_nodata: bool) -> str:
    nd = ", area_nodata" if with_nodata else ""
    return f"""SELECT id_geohash, date, variable, value FROM (SELECT id_geohash, date, water,
        flooded_vegetation + grass + shrub_and_scrub + trees AS vegetation, crops, built, bare, snow_and_ice{nd}
      FROM {src}) s
      UNPIVOT INCLUDE NULLS (value FOR variable IN (water, vegetation, crops, built, bare, snow_and_ice{nd}))"""


def to_long() -> str:
    return f"WITH {ship_panel()} " + long_dw("panel", False)


def relative_percent() -> str:
    return f"""WITH {ship_panel()}{prepared(nodata_max='1.0e0')},
 s AS (SELECT id_geohash, max(max_area) AS max_area FROM prep GROUP BY id_geohash),
 l AS ({long_dw("panel", False)})
SELECT l.id_geohash, l.date, l.variable, l.value, l.value / s.max_area * 100.0e0 AS value_pct
FROM l LEFT JOIN s ON l.id_geohash = s.id_geohash"""


def compare_sources() -> str:
    dw = long_dw("prep", True)
    jrc = """SELECT id_geohash, date, variable, value FROM (SELECT id_geohash, date, area_water_permanent,
        area_water_seasonal, area_land, area_nodata, area_data + area_nodata AS area_total FROM prep) s
      UNPIVOT INCLUDE NULLS (value FOR variable IN (area_water_permanent, area_water_seasonal, area_land,
                                                    area_nodata, area_total))"""
    return f"""WITH dw AS (WITH {planted_panel()}{prepared()} {dw}),
 jrc AS (WITH {planted_jrc()}{prepared(family='jrc')} {jrc})
SELECT *, 'dynamic_world' AS source FROM dw UNION ALL SELECT *, 'jrc' AS source FROM jrc"""


def series_with_break() -> str:
    return f"""WITH b AS ({simple_breaks(planted_panel() + prepared(), 'water')}),
 p AS (WITH {planted_panel()} SELECT id_geohash, date, water FROM panel)
SELECT p.id_geohash, p.date, p.water, b.date_break AS first_break
FROM p LEFT JOIN b ON p.id_geohash = b.id_geohash"""


# --------------------------------------------------------------------------- geometry

ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash_encode(lat: str, lon: str, precision: int = 12) -> str:
    """Geohash of (lat, lon) as a DuckDB expression (bits written out)."""
    lon_bits, lat_bits = (5 * precision + 1) // 2, (5 * precision) // 2
    qlon = (f"least(greatest(CAST(floor(({lon} - (-180.0e0)) / 360.0e0 * {float(1 << lon_bits)}e0) AS BIGINT), 0),"
            f" {(1 << lon_bits) - 1})")
    qlat = (f"least(greatest(CAST(floor(({lat} - (-90.0e0)) / 180.0e0 * {float(1 << lat_bits)}e0) AS BIGINT), 0),"
            f" {(1 << lat_bits) - 1})")

    def bit(i):
        if i % 2 == 0:
            return f"(({qlon} >> {lon_bits - 1 - i // 2}) & 1)"
        return f"(({qlat} >> {lat_bits - 1 - (i - 1) // 2}) & 1)"

    chars = []
    for j in range(precision):
        val = " + ".join(f"{bit(5 * j + t)} * {1 << (4 - t)}" for t in range(5))
        chars.append(f"substr('{ALPHABET}', CAST({val} AS INTEGER) + 1, 1)")
    return "(" + " || ".join(chars) + ")"


def geohash_decode(gh: str, n_chars: int = 12) -> tuple[str, str]:
    """(lat, lon) centre of a fixed-length geohash as DuckDB expressions."""
    n_bits = 5 * n_chars
    lon_bits, lat_bits = (n_bits + 1) // 2, n_bits // 2

    def bit(i):
        return f"(((strpos('{ALPHABET}', substr({gh}, {i // 5 + 1}, 1)) - 1) >> {4 - i % 5}) & 1)"

    qlon = " + ".join(f"{bit(2 * j)} * {1 << (lon_bits - 1 - j)}" for j in range(lon_bits))
    qlat = " + ".join(f"{bit(2 * j + 1)} * {1 << (lat_bits - 1 - j)}" for j in range(lat_bits))
    lon = f"(-180.0e0 + (CAST({qlon} AS DOUBLE) + 0.5e0) * (360.0e0 / {float(1 << lon_bits)}e0))"
    lat = f"(-90.0e0 + (CAST({qlat} AS DOUBLE) + 0.5e0) * (180.0e0 / {float(1 << lat_bits)}e0))"
    return lat, lon


def square_x(key: str) -> str:
    return f"(-165.0e0 + CAST({key} % 33000 AS DOUBLE) * 0.01e0)"


def square_y(key: str) -> str:
    return (f"(60.0e0 + CAST(({key} % 100 + {key} // 1650000) % 100 AS DOUBLE) * 0.05e0"
            f" + CAST(({key} // 33000) % 10 AS DOUBLE) * 0.005e0 + CAST(({key} // 330000) % 5 AS DOUBLE) * 5.0e0)")


def square_rows(source: str = "customer") -> str:
    """CTE ``sq``: one square per customer (or supplier) with exact corner, centre and attributes."""
    key, table = ("c_custkey", "customer") if source == "customer" else ("s_suppkey", "supplier")
    lake_id = geohash_encode("cy", "cx") if source == "customer" else "'lk' || lpad(CAST(k AS VARCHAR), CAST(greatest(length(CAST(k AS VARCHAR)), 6) AS INTEGER), '0')"
    return f"""
 sq0 AS (SELECT {key} AS k, {square_x(key)} AS x0, {square_y(key)} AS y0 FROM {table}),
 sq1 AS (SELECT *, x0 + 0.004e0 AS x1, y0 + 0.004e0 AS y1, x0 + 0.002e0 AS cx, y0 + 0.002e0 AS cy,
                CAST(100 + (k % 7) * 10 AS DOUBLE) AS Area_start_ha FROM sq0),
 sq AS (SELECT {lake_id} AS id_geohash, k AS lake_key, Area_start_ha,
               Area_start_ha - CAST((k % 5) * 3 AS DOUBLE) AS Area_end_ha,
               (Area_start_ha - CAST((k % 5) * 3 AS DOUBLE)) - Area_start_ha AS NetChange_ha,
               ((Area_start_ha - CAST((k % 5) * 3 AS DOUBLE)) - Area_start_ha) / Area_start_ha * 100.0e0
                   AS NetChange_perc,
               x0, y0, x1, y1, cx, cy, (x1 - x0) * (y1 - y0) AS area_deg2 FROM sq1)"""


LAKE_FLAT = "id_geohash, lake_key, Area_start_ha, Area_end_ha, NetChange_ha, NetChange_perc, cx, cy, area_deg2"
LAKE_DOUBLES = ["Area_start_ha", "Area_end_ha", "NetChange_ha", "NetChange_perc", "cx", "cy", "area_deg2"]


def square_lakes() -> str:
    return f"WITH {square_rows()} SELECT {LAKE_FLAT} FROM sq"


def bbox_filter(west, south, east, north) -> str:
    return (f"WITH {square_rows()} SELECT {LAKE_FLAT} FROM sq WHERE cx >= {west}e0 AND cx <= {east}e0 "
            f"AND cy >= {south}e0 AND cy <= {north}e0")


def grid_counts(dlon: float, dlat: float) -> str:
    return f"""WITH {square_rows()}
SELECT -180.0e0 + floor((cx - (-180.0e0)) / {dlon}e0) * {dlon}e0 AS cell_lon,
       60.0e0 + floor((cy - 60.0e0) / {dlat}e0) * {dlat}e0 AS cell_lat, count(*) AS n_lakes
FROM sq GROUP BY ALL"""


def total_bounds() -> str:
    return f"""WITH {square_rows()}, b AS (SELECT min(x0) AS minx, min(y0) AS miny, max(x1) AS maxx, max(y1) AS maxy FROM sq)
SELECT minx, miny, maxx, maxy, (minx + maxx) / 2 AS center_x, (miny + maxy) / 2 AS center_y FROM b"""


def polar(lon: str, lat: str) -> tuple[str, str]:
    import math
    a, f = 6378137.0, 1.0 / 298.257223563
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    phic = math.radians(71.0)
    tc = math.tan(math.pi / 4 - phic / 2) / ((1 - e * math.sin(phic)) / (1 + e * math.sin(phic))) ** (e / 2)
    mc = math.cos(phic) / math.sqrt(1 - e2 * math.sin(phic) ** 2)
    phi = f"radians({lat})"
    t = (f"(tan({math.pi / 4!r}e0 - {phi} / 2) / pow((1 - {e!r}e0 * sin({phi})) / (1 + {e!r}e0 * sin({phi})), "
         f"{e / 2!r}e0))")
    rho = f"({a * mc / tc!r}e0 * {t})"
    return f"({rho} * sin(radians({lon})))", f"(-{rho} * cos(radians({lon})))"


def bbox_area_km2() -> str:
    px, py = polar("vx", "vy")
    return f"""WITH {square_rows()},
 v AS (SELECT x0 AS vx, y0 AS vy FROM sq UNION ALL SELECT x1, y0 FROM sq UNION ALL SELECT x1, y1 FROM sq
       UNION ALL SELECT x0, y1 FROM sq),
 p AS (SELECT {px} AS x, {py} AS y FROM v)
SELECT (max(x) - min(x)) * (max(y) - min(y)) / 1000000.0e0 AS bbox_area_km2 FROM p"""


def largest_lakes(n: int) -> str:
    return (f"WITH {square_rows()} SELECT id_geohash, lake_key, Area_start_ha FROM sq "
            f"ORDER BY Area_start_ha DESC, id_geohash LIMIT {n}")


def lake_at_points() -> str:
    return f"""WITH {square_rows()},
 pts AS (SELECT o_orderkey AS point_id,
                {square_y("o_custkey")} + 0.002e0
                    + CAST((o_orderkey % 5) - 2 AS DOUBLE) * 0.0013e0 AS lat,
                {square_x("o_custkey")} + 0.002e0
                    + CAST((o_orderkey % 7) - 3 AS DOUBLE) * 0.0013e0 AS lon FROM orders),
 hit AS (SELECT point_id, min(sq.id_geohash) AS id_geohash FROM pts JOIN sq
         ON pts.lon > sq.x0 AND pts.lon < sq.x1 AND pts.lat > sq.y0 AND pts.lat < sq.y1 GROUP BY point_id)
SELECT pts.point_id, hit.id_geohash FROM pts LEFT JOIN hit ON pts.point_id = hit.point_id"""


def geohash_decode_sql() -> str:
    lat, lon = geohash_decode("id_geohash")
    return f"""WITH {square_rows()}, d AS (SELECT id_geohash, {lat} AS lat, {lon} AS lon FROM sq)
SELECT id_geohash, lat, lon, printf('%s | %.3f : %.3f', id_geohash, lat, lon) AS label,
       {geohash_encode("lat", "lon", 12)} AS reencoded, {geohash_encode("lat", "lon", 5)} AS prefix5 FROM d"""


def split_in_chunks(size: int) -> str:
    return (f"WITH {square_rows()} SELECT id_geohash, CAST((row_number() OVER (ORDER BY id_geohash) - 1) "
            f"// {size} + 1 AS INTEGER) AS chunk FROM sq")


# --------------------------------------------------------------------------- pixels and scenes

LABELS = ("click", "error", "purchase", "signup", "view")


def pixel_rows() -> str:
    label = "CASE " + " ".join(f"WHEN event_type = '{n}' THEN {i}" for i, n in enumerate(LABELS)) + " END"
    return f"""
 px AS (SELECT 'px' || lpad(CAST(user_id % 10 AS VARCHAR), CAST(greatest(length(CAST(user_id % 10 AS VARCHAR)), 6) AS INTEGER), '0') AS id_geohash, user_id AS pixel_id, ts,
               CAST({label} AS INTEGER) AS label, value AS pixel_area_m2 FROM events),
 scn AS (SELECT 'px' || lpad(CAST(user_id % 10 AS VARCHAR), CAST(greatest(length(CAST(user_id % 10 AS VARCHAR)), 6) AS INTEGER), '0') AS id_geohash,
                'sc' || CAST(event_id AS VARCHAR) AS scene_id, ts AS time,
                CAST(event_id % 41 AS DOUBLE) AS cloud_pct, event_id % 7 AS missing_red FROM events)"""


def _mode_sql(src: str, keys: str, label: str) -> str:
    """Most frequent label per key group, ties to the smallest label."""
    return f"""(SELECT {keys}, first(lb ORDER BY n DESC, lb ASC) AS label_mode, max(area) AS pixel_area_m2
        FROM (SELECT {keys}, {label} AS lb, count(*) AS n, max(pixel_area_m2) AS area FROM {src}
              WHERE label IS NOT NULL GROUP BY ALL) c GROUP BY {keys})"""


def monthly_mode_sql() -> str:
    src = "(SELECT *, CAST(date_trunc('month', ts) AS DATE) AS date FROM px)"
    return f"WITH {pixel_rows()} SELECT * FROM {_mode_sql(src, 'id_geohash, pixel_id, date', 'label')} m"


def range_mode_sql(start: str, end: str) -> str:
    src = f"(SELECT * FROM px WHERE CAST(ts AS DATE) >= DATE '{start}' AND CAST(ts AS DATE) < DATE '{end}')"
    return (f"WITH {pixel_rows()} SELECT *, DATE '{start}' AS date FROM "
            f"{_mode_sql(src, 'id_geohash, pixel_id', 'label')} m")


def class_areas_sql() -> str:
    src = "(SELECT *, CAST(date_trunc('month', ts) AS DATE) AS date FROM px)"
    cols = ", ".join(f"coalesce(sum(pixel_area_m2) FILTER (WHERE label_mode = {i}), 0.0e0) * 0.0001e0 AS {c}"
                     for i, c in enumerate(DW_COLUMNS))
    return (f"WITH {pixel_rows()}, m AS {_mode_sql(src, 'id_geohash, pixel_id, date', 'label')} "
            f"SELECT id_geohash, date, {cols} FROM m GROUP BY id_geohash, date")


def class_areas_jrc_sql(year: int) -> str:
    src = f"(SELECT * REPLACE (label % 4 AS label), year(ts) AS year FROM px WHERE year(ts) = {year})"
    names = ("area_nodata", "area_land", "area_water_seasonal", "area_water_permanent")
    cols = ", ".join(f"coalesce(sum(pixel_area_m2) FILTER (WHERE label_mode = {i}), 0.0e0) * 0.0001e0 AS {c}"
                     for i, c in enumerate(names) if c != "area_nodata")
    return (f"WITH {pixel_rows()}, m AS {_mode_sql(src, 'id_geohash, pixel_id, year', 'label')} "
            f"SELECT id_geohash, make_date(CAST(year AS INTEGER), 1, 1) AS date, {cols} FROM m GROUP BY id_geohash, year")


def select_scenes_sql() -> str:
    return f"""WITH {pixel_rows()} SELECT * FROM scn
WHERE time >= TIMESTAMP '2024-01-01' AND time < TIMESTAMP '2024-02-01' AND cloud_pct <= 20.0e0
  AND month(time) IN (1)
  AND ((time >= TIMESTAMP '2024-01-03' AND time <= TIMESTAMP '2024-01-10')
       OR (time >= TIMESTAMP '2024-01-15 12:00:00' AND time <= TIMESTAMP '2024-01-25'))"""


def best_scene_sql() -> str:
    return f"""WITH {pixel_rows()} SELECT id_geohash, CAST(time AS DATE) AS day,
       arg_min(scene_id, (missing_red, scene_id)) AS scene_id, min(missing_red) AS missing_red
FROM scn GROUP BY id_geohash, CAST(time AS DATE)"""


def scene_dates_sql() -> str:
    return f"WITH {pixel_rows()} SELECT DISTINCT id_geohash, CAST(time AS DATE) AS day FROM scn"


def nearest_scene_sql() -> str:
    return f"""WITH {pixel_rows()},
 req AS (SELECT o_orderkey AS request_id, 'px' || lpad(CAST(o_custkey % 10 AS VARCHAR), CAST(greatest(length(CAST(o_custkey % 10 AS VARCHAR)), 6) AS INTEGER), '0') AS id_geohash,
                TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 30 AS INTEGER))
                    + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS "at" FROM orders),
 pairs AS (SELECT r.request_id, r.id_geohash, r."at", s.scene_id, s.time,
                  abs(epoch_us(r."at") - epoch_us(s.time)) AS d FROM req r JOIN scn s ON r.id_geohash = s.id_geohash)
SELECT request_id, id_geohash, "at", arg_min(scene_id, (d, time, scene_id)) AS scene_id,
       arg_min(time, (d, time, scene_id)) AS scene_time
FROM pairs GROUP BY ALL"""


# --------------------------------------------------------------------------- plans

def historical_breaks(west: float, east: float, polygons: str = "supplier") -> str:
    """Lakes with polygon, panel and centroid in the box. With a polygon per customer the ids are made alike."""
    squares = square_rows(polygons)
    if polygons == "customer":
        squares += f""",
 sqk AS (SELECT * EXCLUDE (id_geohash), {padded_key("lk", "lake_key")} AS id_geohash FROM sq)"""
    lakes = "sqk" if polygons == "customer" else "sq"
    ctes = planted_panel() + f""",{squares},
 inbox AS (SELECT id_geohash FROM {lakes} WHERE cx >= {west}e0 AND cx <= {east}e0),
 panel_f AS (SELECT * FROM panel WHERE id_geohash IN (SELECT id_geohash FROM inbox))""" + prepared(src="panel_f")
    brk = simple_breaks(ctes, "water")
    return f"""WITH {squares}, b AS ({brk}), ids AS (WITH {planted_panel()} SELECT DISTINCT id_geohash FROM panel)
SELECT l.id_geohash, l.lake_key, l.Area_start_ha, l.Area_end_ha, l.NetChange_ha, l.NetChange_perc,
       b.* EXCLUDE (id_geohash)
FROM {lakes} l LEFT JOIN b ON l.id_geohash = b.id_geohash
WHERE l.cx >= {west}e0 AND l.cx <= {east}e0 AND l.id_geohash IN (SELECT id_geohash FROM ids)"""


def padded_key(prefix: str, key: str) -> str:
    return (f"'{prefix}' || lpad(CAST({key} AS VARCHAR), CAST(greatest(length(CAST({key} AS VARCHAR)), 6) AS INTEGER), "
            "'0')")


def lake_point_reads() -> str:
    return f"""WITH {square_rows()}
SELECT id_geohash, lake_key, Area_start_ha, CAST(1 AS BIGINT) AS n_groups FROM sq ORDER BY md5(id_geohash || '42'), id_geohash LIMIT 30"""


def grid_cells() -> str:
    return f"""WITH n AS ({grid_counts(1.0, 0.5)}),
 g AS (SELECT -166.0e0 + x AS lon, 60.0e0 + y * 0.5e0 AS lat FROM range(6) a(x), range(12) b(y))
SELECT lon, lat, coalesce(n_lakes, 0) AS n_lakes FROM g LEFT JOIN n ON n.cell_lon = g.lon AND n.cell_lat = g.lat"""


def consolidated_months() -> str:
    return f"""WITH {square_rows("supplier")}, d AS ({range_drained("2019-03-01", "2019-08-01")}),
 c AS ({monthly_counts("2019-03-01", "2019-08-01")})
SELECT d.analysis_month, d.id_geohash, sq.lake_key, d.water_residual, c.drained_lake_count
FROM d JOIN sq ON sq.id_geohash = d.id_geohash JOIN c ON c.analysis_month = d.analysis_month"""


def request_windows() -> str:
    day = "CAST(o_orderdate AS DATE)"
    return f"""SELECT o_orderkey, {day} - 45 AS each_start, {day} + 45 AS each_end,
       {day} - 22 AS total_start, {day} + 23 AS total_end FROM orders"""


def clipped_change() -> str:
    return f"""WITH {square_rows()} SELECT id_geohash,
       least(greatest(CASE WHEN lake_key % 4 <> 0 THEN NetChange_ha ELSE 0.0e0 END, -8.0e0), 8.0e0) AS colour,
       1.5e0 AS no_column FROM sq"""


def usable_polygons() -> str:
    return f"WITH {square_rows()} SELECT {LAKE_FLAT} FROM sq WHERE lake_key % 10 NOT IN (3, 6)"


def site_values() -> str:
    return f"""WITH {planted_panel()}{prepared()}
SELECT * FROM ({long_dw("(SELECT * FROM prep WHERE id_geohash = 'lk000003' AND area_nodata = 0)", True)}) l
WHERE variable IN ('water', 'bare')"""


def panel_keys() -> str:
    return f"""WITH {ship_panel()}
SELECT CAST(year(date) AS VARCHAR) AS key, count(DISTINCT date) AS n FROM panel GROUP BY ALL
UNION ALL SELECT 'lakes', count(DISTINCT id_geohash) FROM panel"""


def described_panel() -> str:
    each = " UNION ALL ".join(f"SELECT '{c}' AS variable, 'ha' AS unit, 'dynamic_world' AS family, sum({c}) AS total "
                              "FROM panel" for c in DW_COLUMNS)
    return f"WITH {ship_panel()} {each}"


def geojson_written() -> str:
    half_even = lambda c: f"round_even({c} * 100.0e0, 0) / 100.0e0"
    return f"""WITH {square_rows()} SELECT id_geohash, lake_key, {half_even("Area_start_ha")} AS Area_start_ha,
       {half_even("NetChange_perc")} AS NetChange_perc, cx, cy, area_deg2, cx AS px, cy AS py FROM sq"""


def best_scene_of_pixels() -> str:
    lake = padded_key("px", "(user_id % 10)")
    return f"""WITH p AS (SELECT {lake} AS id_geohash, CAST(ts AS DATE) AS day,
   {lake} || '-' || strftime(ts, '%Y%m%d') || '-' || CAST(hour(ts) // 12 AS VARCHAR) AS scene_id,
   event_type = 'error' OR value IS NULL AS gone FROM events),
 s AS (SELECT id_geohash, day, scene_id, count(*) FILTER (WHERE gone) AS missing_red FROM p GROUP BY ALL)
SELECT id_geohash, day, arg_min(scene_id, (missing_red, scene_id)) AS scene_id, min(missing_red) AS missing_red
FROM s GROUP BY ALL"""


def forecast_lines() -> str:
    return f"""SELECT {padded_key("ln", "s_suppkey")} AS id_geohash,
       0.9e0 - CAST(48 * (s_suppkey % 5) AS DOUBLE) * 0.002e0 AS water_predicted, 0.0e0 AS width FROM supplier"""


def gridded_nrt(d: str, dlon: float, dlat: float) -> str:
    ctes = planted_panel() + f""",
 panel_h AS (SELECT * FROM panel WHERE date <= DATE '{d}')""" + prepared(src="panel_h")
    return f"""WITH {square_rows("supplier")},
 cells AS (SELECT id_geohash, -180.0e0 + floor((cx - (-180.0e0)) / {dlon}e0) * {dlon}e0 AS cell_lon,
                  60.0e0 + floor((cy - 60.0e0) / {dlat}e0) * {dlat}e0 AS cell_lat FROM sq),
 r AS ({nrt(ctes, "water", d)})
SELECT cells.cell_lon, cells.cell_lat, r.* FROM cells JOIN r ON cells.id_geohash = r.id_geohash"""


def rescale_attach(d: str) -> str:
    total = " + ".join(f"coalesce({c}, 0.0e0)" for c in DW_COLUMNS)
    absolutes = ", ".join(f"r.{c} * s.scale AS {c}_absolute" for c in NRT_VALUES)
    return f"""WITH {square_rows("supplier")},
 s AS (WITH {planted_panel()} SELECT id_geohash, max({total}) AS scale FROM panel GROUP BY id_geohash),
 r AS ({nrt(planted_panel() + prepared(), "water", d)})
SELECT sq.id_geohash, r.date, {", ".join("r." + c for c in NRT_VALUES)}, {absolutes},
       {_ci("r.water_predicted_lower_90", "r.water_predicted_upper_90")} AS water_predicted_ci,
       {_ci("r.water_predicted_lower_90 * s.scale", "r.water_predicted_upper_90 * s.scale")}
           AS water_predicted_ci_absolute,
       r.drainage_confidence
FROM sq LEFT JOIN r ON sq.id_geohash = r.id_geohash LEFT JOIN s ON sq.id_geohash = s.id_geohash"""


def valid_keys() -> str:
    return f"""WITH {square_rows()},
 pts AS (SELECT o_orderkey AS point_id, o_orderdate,
                {square_y("o_custkey")} + 0.002e0
                    + CAST((o_orderkey % 5) - 2 AS DOUBLE) * 0.0013e0 AS lat,
                {square_x("o_custkey")} + 0.002e0
                    + CAST((o_orderkey % 7) - 3 AS DOUBLE) * 0.0013e0 AS lon FROM orders),
 f AS (SELECT coalesce(lat BETWEEN -90 AND 90, false) AS lat_ok, coalesce(lon BETWEEN -180 AND 180, false) AS lon_ok,
              coalesce(regexp_full_match(strftime(o_orderdate, '%Y-%m'), '\\d{{4}}-\\d{{2}}'), false) AS month_ok,
              coalesce(regexp_full_match(CAST(point_id AS VARCHAR), '\\d{{4}}-\\d{{2}}'), false) AS key_is_month
       FROM pts),
 g AS (SELECT coalesce(regexp_full_match(id_geohash, '[0-9a-zA-Z]{{1,12}}'), false) AS id_ok,
              coalesce(regexp_full_match(id_geohash || 'x', '[0-9a-zA-Z]{{1,12}}'), false) AS id13_ok FROM sq)
SELECT lat_ok, lon_ok, month_ok, key_is_month, NULL::BOOLEAN AS id_ok, NULL::BOOLEAN AS id13_ok, count(*) AS count
FROM f GROUP BY ALL
UNION ALL
SELECT NULL, NULL, NULL, NULL, id_ok, id13_ok, count(*) FROM g GROUP BY ALL"""


# --------------------------------------------------------------------------- registry

def _breaks(panel: str, water: str, method: str = "median", family: str = "dw", nodata_max: str = "0.0e0",
            threshold: str = "-0.25e0"):
    return rounded(simple_breaks(panel + prepared(family, nodata_max), water, method=method, threshold=threshold),
                   BREAK_DOUBLES)


def user_detector() -> str:
    """First valid date whose share is below half of the lake's first: the rolling rule replaced, the rest the same."""
    base = simple_breaks(planted_panel() + prepared(), "water")
    rule = "hit_p AND lead(hit_s, 1, false) OVER (PARTITION BY id_geohash ORDER BY date) AS is_break"
    assert rule in base
    own = "wn < first_value(wn) OVER (PARTITION BY id_geohash ORDER BY date) / 2 AS is_break"
    return base.replace(rule, own).replace("'simple' AS break_method", "'half_drop' AS break_method")


def bayes_first_break() -> str:
    """Planted lakes break at their planted month, or at the first valid month after it; neighbours are calendar ones."""
    pre = ", ".join(f"{_AGG[s]}(CASE WHEN date <= brk THEN wa END) AS pre_break_{s}" for s in STATS)
    post = ", ".join(f"{_AGG[s]}(CASE WHEN date > brk THEN wa END) AS post_break_{s}" for s in STATS)
    base = simple_breaks(planted_panel() + prepared(), "water")
    head, tail = base[: base.index(" sb_r AS")], base[base.index("SELECT id_geohash, date_break, date_before_break"):]
    return head + f""" sb_k AS (SELECT id_geohash, date, water AS wa, valid, CAST(substr(id_geohash, 3) AS BIGINT) AS k,
                 lag(date) OVER w AS prev_date, lead(date) OVER w AS next_date
          FROM prep WINDOW w AS (PARTITION BY id_geohash ORDER BY date)),
 sb_h AS (SELECT *, min(CASE WHEN valid AND date >= DATE '2017-01-01' + to_months(CAST(20 + k % 20 AS INTEGER))
                        THEN date END) OVER (PARTITION BY id_geohash) AS brk FROM sb_k WHERE k % 3 = 0),
 sb_a AS (SELECT id_geohash, min(brk) AS date_break,
                 max(CASE WHEN date = brk THEN prev_date END) AS date_before_break,
                 max(CASE WHEN date = brk THEN next_date END) AS date_after_break,
                 'bayes' AS break_method, {pre}, {post} FROM sb_h GROUP BY id_geohash)
""" + tail


def spatial_chunks(size: int) -> str:
    px, py = polar("cx", "cy")

    def cell(v: str) -> str:
        return (f"CAST(least(greatest(floor((({v}) + 12500000.0e0) / 25000000.0e0 * 65536.0e0), 0), 65535) AS BIGINT)")

    def spaced(v: str) -> str:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = f"(({v} | ({v} << {shift})) & {mask})"
        return v

    return f"""WITH {square_rows()},
 c AS (SELECT id_geohash, {cell(px)} AS ix, {cell(py)} AS iy FROM sq),
 k AS (SELECT id_geohash, {spaced("ix")} | ({spaced("iy")} << 1) AS curve FROM c),
 p AS (SELECT id_geohash, row_number() OVER (ORDER BY curve, id_geohash) AS pos FROM k)
SELECT id_geohash, 0 AS cluster, CAST((pos - 1) // {size} AS INTEGER) AS piece,
       '0-' || CAST((pos - 1) // {size} AS VARCHAR) AS chunk FROM p"""


def break_files_union() -> str:
    a = _breaks(planted_panel(), "water")
    b = simple_breaks(planted_panel() + prepared(), "water", window=5)
    return f"""SELECT id_geohash, date_break, break_method, water_change_ha, CAST(NULL AS INTEGER) AS date_break_year
FROM ({a}) a UNION ALL
SELECT id_geohash, date_break, break_method, CAST(CAST(round(water_change_ha) AS INTEGER) AS DOUBLE), date_break_year
FROM ({b}) b"""


def geojson_roundtrip() -> str:
    return f"SELECT id_geohash, lake_key, cx, cy, area_deg2 FROM ({square_lakes()}) x"


def lake_lookup() -> str:
    return (f"WITH {square_rows()} SELECT {LAKE_FLAT} FROM sq WHERE lake_key IN "
            f"(SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995)")


def date_lists() -> str:
    return """WITH lists AS (
  SELECT 'months' AS list, make_date(y, m, 1) AS date FROM (VALUES (1994), (1995)) a(y), (VALUES (6), (7), (8)) b(m)
  UNION ALL SELECT 'steps', CAST(d AS DATE) FROM
    (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1996-12-31', INTERVAL 10 DAY)) AS d)
  UNION ALL SELECT 'years', make_date(y, 1, 1) FROM (VALUES (1993), (1997)) c(y)),
n AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT list, date, coalesce(n, 0) AS n_orders FROM lists LEFT JOIN n ON day = date"""


def row_shares() -> str:
    return f"""WITH {ship_panel() + prepared(nodata_max="1.0e0")}
SELECT id_geohash, date, water / nullif(area_data + area_nodata, 0) AS water,
       area_data / nullif(area_data + area_nodata, 0) AS area_data,
       area_nodata / nullif(area_data + area_nodata, 0) AS area_nodata,
       CASE WHEN date = DATE '1997-06-01' THEN 'at' ELSE 'before' END AS part
FROM prep WHERE date <= DATE '1997-06-01'"""


def break_views() -> str:
    b = simple_breaks(planted_panel() + prepared(), "water")
    return f"""SELECT b.id_geohash, CAST(substr(b.id_geohash, 3) AS BIGINT) AS lake_key,
       CAST(100 + (CAST(substr(b.id_geohash, 3) AS BIGINT) % 7) * 10 AS DOUBLE) AS Area_start_ha,
       date_break, date_break_year FROM ({b}) b"""


def month_view() -> str:
    r = nrt_range(planted_panel() + prepared(), "water", "2019-06-01", "2019-06-01")
    return f"""SELECT id_geohash, '2019-06' AS analysis_month, 2019 AS year, 6 AS month, drainage_confidence
FROM ({r}) r WHERE drainage_confidence > 0"""


def availability() -> str:
    return f"""WITH {ship_panel()},
 early AS (SELECT id_geohash, count(*) AS n FROM panel WHERE date < DATE '1992-04-01' GROUP BY 1),
 late AS (SELECT DISTINCT id_geohash FROM panel WHERE date >= DATE '1998-01-01')
SELECT late.id_geohash, n IS NOT NULL AS available, coalesce(n, 0) AS n_rows
FROM late LEFT JOIN early ON late.id_geohash = early.id_geohash"""


ORACLE: dict[str, str] = {
    "panel_io": rounded(f"WITH {ship_panel()} SELECT id_geohash, date, {', '.join(DW_COLUMNS)} FROM panel", DW_COLUMNS),
    "lake_lookup": rounded(lake_lookup(), LAKE_DOUBLES, 6),
    "date_lists": date_lists(),
    "row_shares": rounded(row_shares(), ["water", "area_data", "area_nodata"]),
    "break_views": break_views(),
    "month_view": month_view(),
    "availability": availability(),
    "area_tables": rounded(class_areas_sql(), DW_COLUMNS, 6),
    "simple_breaks": _breaks(planted_panel(), "water"),
    "simple_breaks_mean": _breaks(planted_panel(), "water", "mean"),
    "simple_breaks_max": _breaks(planted_panel(), "water", "max"),
    "simple_breaks_jrc": _breaks(planted_jrc(), "area_water_permanent", family="jrc"),
    "simple_breaks_ship": _breaks(ship_panel(), "water", nodata_max="1.0e0", threshold="-0.1e0"),
    "nrt_ar1": rounded(nrt(planted_panel() + prepared(), "water", "2019-06-01"), NRT_DOUBLES),
    "nrt_monthly_period": rounded(nrt(planted_panel() + prepared(), "water", "2019-06-01", period="monthly"),
                                  NRT_DOUBLES),
    "nrt_keep_nans": rounded(nrt(planted_panel() + prepared(), "water", "2019-06-01", keep_nans=True),
                             NRT_DOUBLES),
    "nrt_ship": rounded(nrt(ship_panel() + prepared(nodata_max="1.0e0"), "water", "1998-06-01"), NRT_DOUBLES),
    "history_stats": rounded(history_stats("2019-06-01"), HIST_DOUBLES),
    "drained_month": rounded(drained_month("2019-06-01"), NRT_DOUBLES),
    "nrt_range": rounded(range_drained("2018-01-01", "2021-12-01"), NRT_DOUBLES),
    "nrt_range_monthly": rounded(
        f"SELECT strftime(date, '%Y-%m') AS analysis_month, * FROM "
        f"({nrt_range(planted_panel() + prepared(), 'water', '2018-01-01', '2021-12-01', period='monthly')}) x",
        NRT_DOUBLES),
    "monthly_counts": monthly_counts("2018-01-01", "2021-12-01"),
    "counts_matrix": rounded(counts_matrix("2018-01-01", "2021-12-01"), [f"m{m:02d}" for m in range(1, 13)]),
    "ranked_drained": rounded(ranked_drained("2018-01-01", "2021-12-01"),
                              [_q("Water Residual [%]"), "water_observed", "water_predicted"]),
    "prepare_panel": rounded(prepare_panel(), PREP_DW_DOUBLES),
    "mask_panel": rounded(mask_panel(), ["water", "water_norm", "snow_and_ice_norm", "area_nodata"]),
    "gap_report": rounded(gap_report(), ["completion_pct"]),
    "rolling_median": rounded(rolling_sql("median"), ["water_norm", "roll_3", "roll_5"]),
    "rolling_mean": rounded(rolling_sql("mean"), ["water_norm", "roll_3", "roll_5"]),
    "rolling_max": rounded(rolling_sql("max"), ["water_norm", "roll_3", "roll_5"]),
    "merge_both": rounded(merge_sql("both"), DW_COLUMNS),
    "merge_date": rounded(merge_sql("date"), DW_COLUMNS),
    "merge_id": rounded(merge_sql("id"), DW_COLUMNS),
    "to_long": rounded(to_long(), ["value"]),
    "relative_percent": rounded(relative_percent(), ["value", "value_pct"]),
    "compare_sources": rounded(compare_sources(), ["value"]),
    "series_with_break": rounded(series_with_break(), ["water"]),
    "square_lakes": rounded(square_lakes(), LAKE_DOUBLES, 6),
    "bbox_filter": rounded(bbox_filter(-164.5, 61.0, -160.0, 63.0), LAKE_DOUBLES, 6),
    "grid_counts": grid_counts(1.0, 0.5),
    "bounds": rounded(total_bounds(), ["minx", "miny", "maxx", "maxy", "center_x", "center_y"], 6),
    "bbox_area_km2": rounded(bbox_area_km2(), ["bbox_area_km2"], 2),
    "largest_lakes": largest_lakes(20),
    "lake_at_points": lake_at_points(),
    "geohash_decode": rounded(geohash_decode_sql(), ["lat", "lon"], 6),
    "split_in_chunks": split_in_chunks(100),
    "monthly_mode": rounded(monthly_mode_sql(), ["pixel_area_m2"]),
    "range_mode": rounded(range_mode_sql("2024-01-08", "2024-01-22"), ["pixel_area_m2"]),
    "class_areas": rounded(class_areas_sql(), DW_COLUMNS, 6),
    "class_areas_jrc": rounded(class_areas_jrc_sql(2024),
                               ["area_land", "area_water_seasonal", "area_water_permanent"], 6),
    "select_scenes": rounded(select_scenes_sql(), ["cloud_pct"]),
    "best_scene": best_scene_sql(),
    "scene_dates": scene_dates_sql(),
    "nearest_scene": nearest_scene_sql(),
    "historical_breaks": rounded(historical_breaks(-164.9, -164.3),
                                 BREAK_DOUBLES + ["Area_start_ha", "Area_end_ha", "NetChange_ha", "NetChange_perc"]),
    "historical_run": rounded(historical_breaks(-164.9, -164.3, "customer"),
                              BREAK_DOUBLES + ["Area_start_ha", "Area_end_ha", "NetChange_ha", "NetChange_perc"]),
    "lakes_in_box": rounded(bbox_filter(-164.5, 61.0, -160.0, 63.0), LAKE_DOUBLES, 6),
    "lake_point_reads": lake_point_reads(),
    "grid_cells": grid_cells(),
    "consolidated_months": rounded(consolidated_months(), ["water_residual"]),
    "request_windows": request_windows(),
    "clipped_change": rounded(clipped_change(), ["colour", "no_column"]),
    "usable_polygons": rounded(usable_polygons(), LAKE_DOUBLES, 6),
    "site_values": rounded(site_values(), ["value"]),
    "panel_keys": panel_keys(),
    "described_panel": rounded(described_panel(), ["total"]),
    "geojson_written": rounded(geojson_written(), ["Area_start_ha", "NetChange_perc", "cx", "cy", "area_deg2", "px", "py"], 6),
    "best_scene_of_pixels": best_scene_of_pixels(),
    "forecast_lines": rounded(forecast_lines(), ["water_predicted", "width"]),
    "bayes_trend_breaks": rounded(bayes_first_break(), BREAK_DOUBLES),
    "gridded_nrt": rounded(gridded_nrt("2019-06-01", 0.5, 1.0), NRT_DOUBLES + ["cell_lon", "cell_lat"]),
    "clustered_roundtrip": rounded(square_lakes(), LAKE_DOUBLES, 6),
    "month_files_roundtrip": rounded(range_drained("2018-01-01", "2021-12-01"), NRT_DOUBLES),
    "rescale_attach": rounded(rescale_attach("2019-06-01"), NRT_DOUBLES),
    "valid_keys": valid_keys(),
    "user_detector": rounded(user_detector(), BREAK_DOUBLES),
    "bayes_first_break": rounded(bayes_first_break(), BREAK_DOUBLES),
    "spatial_chunks": spatial_chunks(100),
    "wkb_roundtrip": rounded(square_lakes(), LAKE_DOUBLES, 6),
    "geojson_roundtrip": rounded(geojson_roundtrip(), ["cx", "cy", "area_deg2"], 6),
    "break_files_union": rounded(break_files_union(), ["water_change_ha"]),
    "nrt_job_rerun": monthly_counts("2019-03-01", "2019-08-01"),
    "stream_replay": monthly_counts("2019-05-01", "2019-06-01"),
}
