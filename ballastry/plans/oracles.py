"""SQL of the registered queries for DuckDB, written from the definitions, not from the Spark code."""

from __future__ import annotations

from ballastry.schema import COIN_IDS, STABLE_PAIRS, STABLE_TICKERS

TRAIN, STEP = 104, 4

BRAND_WEEK = """
panel AS (SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, avg(l_extendedprice / l_quantity) AS close
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
INDEX = """
cal AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS t FROM (SELECT DISTINCT d FROM panel)),
px AS (SELECT t, d, symbol, close FROM panel JOIN cal USING (d)),
ret AS (SELECT a.t, a.d, a.symbol, a.close / b.close - 1 AS r FROM px a JOIN px b ON a.symbol = b.symbol AND a.t = b.t + 1)"""


def windows(train: int = TRAIN, step: int = STEP, periods: str | None = None) -> str:
    count = periods or f"(SELECT (count(*) - {train} - {step}) // {step} FROM cal)"
    return f"""
per AS (SELECT unnest(range(0, {count})) AS p),
tr AS (SELECT p, t, symbol, r FROM ret JOIN per ON t > p * {step} AND t <= p * {step} + {train}),
te AS (SELECT p, t, symbol, r FROM ret JOIN per ON t > p * {step} + {train} AND t <= p * {step} + {train + step}),
uni AS (SELECT p, symbol FROM tr GROUP BY 1, 2 HAVING count(*) = {train}),
cov AS (SELECT a.p, a.symbol AS i, b.symbol AS j, covar_samp(a.r, b.r) AS c
        FROM tr a JOIN tr b ON a.p = b.p AND a.t = b.t JOIN uni u ON u.p = a.p AND u.symbol = a.symbol JOIN uni v ON v.p = b.p AND v.symbol = b.symbol GROUP BY ALL),
sc AS (SELECT p, symbol, product(1 + r) FILTER (WHERE t > p * {step} + {train} - 22 AND t < p * {step} + {train}) - 1 AS score,
              product(1 + r) FILTER (WHERE t > p * {step} + {train} - 21) - 1 AS abs_score, stddev_samp(r) AS sd, var_samp(r) AS v
       FROM tr JOIN uni USING (p, symbol) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY score DESC, symbol) AS rn, count(*) OVER (PARTITION BY p) AS nn FROM sc),
grow AS (SELECT p, t, symbol, product(1 + r) OVER (PARTITION BY p, symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM tr JOIN uni USING (p, symbol)),
ma AS (SELECT p, symbol, avg(g) FILTER (WHERE t > p * {step} + {train} - 7) > avg(g) FILTER (WHERE t > p * {step} + {train} - 28) AS up FROM grow GROUP BY ALL),
ivp AS (SELECT p, symbol, (1 / v) / sum(1 / v) OVER (PARTITION BY p) AS w FROM sc),
csm0 AS (SELECT *, rn <= least(greatest(1, floor(nn * 0.3::DOUBLE)), nn - floor(nn * 0.2::DOUBLE)) AS pick FROM rk),
csm AS (SELECT p, symbol, pick, CASE WHEN pick THEN 1.0::DOUBLE / sum(pick::INT) OVER (PARTITION BY p) ELSE 0 END AS eq,
   CASE WHEN pick THEN (score - min(score) FILTER (WHERE pick) OVER (PARTITION BY p) + 0.001) / (sum(score) FILTER (WHERE pick) OVER (PARTITION BY p)
     - (min(score) FILTER (WHERE pick) OVER (PARTITION BY p) - 0.001) * sum(pick::INT) OVER (PARTITION BY p)) ELSE 0 END AS mo,
   CASE WHEN pick THEN (1 / sd) / sum(1 / sd) FILTER (WHERE pick) OVER (PARTITION BY p) ELSE 0 END AS iv FROM csm0),
tsm0 AS (SELECT sc.p, sc.symbol, sd, up, abs_score > 0 AS pos, 1.0::DOUBLE / count(*) OVER (PARTITION BY sc.p) AS e FROM sc JOIN ma USING (p, symbol)),
tsm AS (SELECT p, symbol,
   coalesce(up::INT / nullif(sum(up::INT) OVER (PARTITION BY p), 0), e) AS ma_eq, coalesce(up::INT / sd / nullif(sum(up::INT / sd) OVER (PARTITION BY p), 0), e) AS ma_vt,
   coalesce(pos::INT / nullif(sum(pos::INT) OVER (PARTITION BY p), 0), e) AS ab_eq, coalesce(pos::INT / sd / nullif(sum(pos::INT / sd) OVER (PARTITION BY p), 0), e) AS ab_vt FROM tsm0),
rmm0 AS (SELECT p, symbol, CASE WHEN rn <= greatest(1, floor(nn * 0.3::DOUBLE)) THEN 1 / greatest(1, floor(nn * 0.3::DOUBLE)) ELSE 0 END AS raw FROM rk),
rmv AS (SELECT p, stddev_samp(x) * sqrt(365) AS vol FROM (SELECT p, t, sum(r * raw) AS x FROM tr JOIN rmm0 USING (p, symbol) WHERE t > p * {step} + {train} - 63 GROUP BY 1, 2) GROUP BY 1),
rmm AS (SELECT p, symbol, raw, vol, least(greatest(0.12 / vol, 0.25), 2.0) AS scale FROM rmm0 JOIN rmv USING (p))"""


PLAIN_W = """
w AS (SELECT 'IVP' AS strategy, p, symbol, w FROM ivp UNION ALL SELECT 'CS_MOM', p, symbol, eq FROM csm
      UNION ALL SELECT 'TS_MOM', p, symbol, ma_eq FROM tsm UNION ALL SELECT 'RM_MOM', p, symbol, raw FROM rmm)"""
SEVEN_W = """
w AS (SELECT 'IVP' AS strategy, p, symbol, w FROM ivp UNION ALL SELECT 'CS_MOM', p, symbol, eq FROM csm
      UNION ALL SELECT 'TS_MOM', p, symbol, ma_eq FROM tsm UNION ALL SELECT 'RM_MOM', p, symbol, raw FROM rmm
      UNION ALL SELECT 'HRP', p, symbol, weight FROM hrp UNION ALL SELECT 'MVP', p, symbol, weight FROM mvp
      UNION ALL SELECT 'MOM_HRP', p, uni.symbol, coalesce(weight, 0) FROM uni LEFT JOIN wonhrp USING (p, symbol))"""
CARRIED_W = """
w AS (SELECT 'IVP' AS strategy, p, symbol, w FROM ivp UNION ALL SELECT 'HRP', p, symbol, weight FROM hrp UNION ALL SELECT 'MVP', p, symbol, weight FROM mvp)"""


def held(step: int = STEP, train: int = TRAIN) -> str:
    return f"""
prev AS (SELECT strategy, p, symbol, w FROM w WHERE p = 0 UNION ALL SELECT strategy, p + 1, symbol, w FROM w WHERE p + 1 IN (SELECT p FROM per)),
ser AS (SELECT s.strategy, q.t, coalesce(sum(r * w), 0) AS r
        FROM (SELECT DISTINCT strategy FROM w) s CROSS JOIN (SELECT p, t FROM cal JOIN per ON t > p * {step} + {train} AND t <= p * {step} + {train + step}) q
        LEFT JOIN (te JOIN w USING (p, symbol)) x ON x.strategy = s.strategy AND x.t = q.t GROUP BY 1, 2)"""


SERIES = """
cum AS (SELECT strategy, t, r, product(1 + r) OVER (PARTITION BY strategy ORDER BY t ROWS UNBOUNDED PRECEDING) AS cum FROM ser),
dd AS (SELECT *, cum / max(cum) OVER (PARTITION BY strategy ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM cum),
qv AS (SELECT strategy, quantile_cont(r, 1 - 0.95::DOUBLE) AS v FROM ser GROUP BY 1),
mo AS (SELECT strategy, avg(r) AS m, avg(r * r) AS m2, avg(r * r * r) AS m3 FROM ser GROUP BY 1),
agg AS (SELECT strategy, count(*) AS n, arg_max(cum, t) AS last, avg(r) AS mean, stddev_samp(r) AS sd, sqrt(avg(r * r) FILTER (WHERE r < 0)) AS down, min(dd) AS mdd,
  sqrt(avg(dd * dd * 10000)) AS ulcer, any_value(v) AS v, avg(r) FILTER (WHERE r <= v) AS cvar, kurtosis_pop(r) AS kurt,
  avg((r - m) * (r - m) * (r - m)) / pow(avg((r - m) * (r - m)), 1.5) AS skew, count(*) FILTER (WHERE r > 0) AS wins, coalesce(sum(r) FILTER (WHERE r > 0), 0) AS gains, coalesce(-sum(r) FILTER (WHERE r < 0), 0) AS losses
  FROM dd JOIN qv USING (strategy) JOIN mo USING (strategy) GROUP BY 1),
met AS (SELECT strategy, (last - 1) * 100 AS total_return_pct, (pow(last, 365.0 / n) - 1) * 100 AS annualized_return_pct, sd * sqrt(365) * 100 AS annualized_vol_pct, mdd * 100 AS max_drawdown_pct,
  v * 100 AS var95_pct, cvar * 100 AS cvar95_pct, ulcer AS ulcer_index, CASE WHEN sd = 0 THEN 0 ELSE sqrt(365) * mean / sd END AS sharpe,
  CASE WHEN down IS NULL THEN 'inf'::DOUBLE ELSE sqrt(365) * mean / down END AS sortino,
  CASE WHEN mdd = 0 THEN 'inf'::DOUBLE ELSE (pow(last, 365.0 / n) - 1) * 100 / abs(mdd * 100) END AS calmar, skew AS skewness, kurt AS kurtosis,
  wins / n * 100.0 AS win_rate_pct, CASE WHEN losses = 0 THEN 'inf'::DOUBLE ELSE gains / losses END AS profit_factor FROM agg)"""

COSTS = """
tov AS (SELECT strategy, p, sum(abs(coalesce(b.w, 0) - coalesce(a.w, 0))) AS tov FROM prev a FULL JOIN w b USING (strategy, p, symbol) GROUP BY 1, 2),
cst AS (SELECT b.strategy, b.p, sum(abs(b.w - coalesce(a.w, 0))) AS turnover, sum(abs(b.w - coalesce(a.w, 0))) * 0.001 AS cost
        FROM w b LEFT JOIN prev a USING (strategy, p, symbol) GROUP BY 1, 2)"""

DYNAMIC = """
dyn AS (SELECT met.*, x.avg_turnover FROM met JOIN (SELECT strategy, avg(tov) AS avg_turnover FROM tov GROUP BY 1) x USING (strategy))"""



def tree(leaves: str, x: str = "") -> str:
    """Clustering of every period at once: x names the tables, leaves has (p, s, id). Each recursion merges one pair a period."""
    return f"""
{x}u AS ({leaves}),
{x}nn AS (SELECT p, count(*) AS n FROM {x}u GROUP BY p),
{x}dist AS (SELECT cov.p, a.id AS x, b.id AS y, CASE WHEN a.id = b.id THEN 0 ELSE sqrt(greatest(0, (1 - cov.c / sqrt(va.c * vb.c)) / 2)) END AS dd, cov.c AS cv
         FROM cov JOIN {x}u a ON a.p = cov.p AND a.s = cov.i JOIN {x}u b ON b.p = cov.p AND b.s = cov.j
         JOIN cov va ON va.p = cov.p AND va.i = cov.i AND va.j = cov.i JOIN cov vb ON vb.p = cov.p AND vb.i = cov.j AND vb.j = cov.j),
{x}st(p, step, id, cid, pos, ml, mg, md, ms) AS (
  SELECT p, 0, id, id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::BIGINT FROM {x}u
  UNION ALL
  (WITH best AS (SELECT a.p, least(a.cid, b.cid) AS l, greatest(a.cid, b.cid) AS g, dd
                 FROM {x}st a JOIN {x}st b ON a.p = b.p AND a.cid <> b.cid JOIN {x}dist d ON d.p = a.p AND d.x = a.id AND d.y = b.id
                 QUALIFY row_number() OVER (PARTITION BY a.p ORDER BY dd, least(a.cid, b.cid), greatest(a.cid, b.cid)) = 1),
        sz AS (SELECT s.p, count(*) FILTER (WHERE s.cid = l) AS k, count(*) FILTER (WHERE s.cid = g) AS k2 FROM {x}st s JOIN best ON best.p = s.p GROUP BY 1)
   SELECT s.p, step + 1, id, CASE WHEN cid IN (l, g) THEN n + step ELSE cid END, CASE WHEN cid = g THEN pos + k ELSE pos END, l, g, best.dd, k + k2
   FROM {x}st s JOIN best ON best.p = s.p JOIN sz ON sz.p = s.p JOIN {x}nn m ON m.p = s.p)),
{x}o AS (SELECT p, id, pos FROM {x}st JOIN {x}nn USING (p) WHERE step = n - 1),
{x}seg(p, node, lo, hi) AS (
  SELECT p, 1::BIGINT, 0::BIGINT, n FROM {x}nn
  UNION ALL
  SELECT p, node * 2 + h, CASE WHEN h = 0 THEN lo ELSE lo + (hi - lo) // 2 END, CASE WHEN h = 0 THEN lo + (hi - lo) // 2 ELSE hi END FROM {x}seg, (VALUES (0), (1)) z(h) WHERE hi - lo > 1),
{x}mem AS (SELECT g.p, node, o.id FROM {x}seg g JOIN {x}o o ON o.p = g.p AND pos >= lo AND pos < hi),
{x}iv AS (SELECT m.p, node, m.id, (1 / cv) / sum(1 / cv) OVER (PARTITION BY m.p, node) AS w FROM {x}mem m JOIN {x}dist d ON d.p = m.p AND x = m.id AND y = m.id),
{x}cvar AS (SELECT a.p, a.node, sum(a.w * b.w * cv) AS v FROM {x}iv a JOIN {x}iv b ON a.p = b.p AND a.node = b.node JOIN {x}dist d ON d.p = a.p AND x = a.id AND y = b.id GROUP BY 1, 2),
{x}al AS (SELECT a.p, a.node, 1 - a.v / (a.v + b.v) AS f FROM {x}cvar a JOIN {x}cvar b ON a.p = b.p AND b.node = CASE WHEN a.node % 2 = 0 THEN a.node + 1 ELSE a.node - 1 END WHERE a.node > 1),
{x}hrp AS (SELECT u.p, u.s AS symbol, product(f) AS weight FROM {x}mem m JOIN {x}al a USING (p, node) JOIN {x}u u ON u.p = m.p AND u.id = m.id GROUP BY 1, 2)"""


LABELS = "SELECT p, symbol AS s, row_number() OVER (PARTITION BY p ORDER BY symbol) - 1 AS id FROM uni"
TREE = tree(LABELS)
#: Least variance without shorts by coordinate descent, one asset of every period a recursion, 60 rounds of all assets.
MVP = """
mc0 AS (SELECT p, i, list(c ORDER BY j) AS row, max(c) FILTER (WHERE i = j) AS d FROM cov GROUP BY 1, 2),
mcr AS (SELECT p, i, row, d, row_number() OVER (PARTITION BY p ORDER BY i) AS k, count(*) OVER (PARTITION BY p) AS n FROM mc0),
cd(p, step, x) AS (
  SELECT p, 0, list(0.0::DOUBLE) FROM mcr GROUP BY p
  UNION ALL
  SELECT cd.p, step + 1, list_concat(list_concat(x[1:k - 1], [greatest(0, (1 - list_dot_product(row, x) + d * x[k]) / d)]), x[k + 1:])
  FROM cd JOIN mcr ON mcr.p = cd.p AND k = step % n + 1 WHERE step < 60 * n),
mvp AS (SELECT mcr.p, i AS symbol, x[k] / list_sum(x) AS weight FROM mcr JOIN cd ON cd.p = mcr.p AND step = 60 * n)"""
MH = """
mh0 AS (SELECT *, least(greatest(5, floor(nn * 0.4::DOUBLE)), nn - floor(nn * 0.2::DOUBLE)) AS k0 FROM rk),
mh AS (SELECT p, symbol, rn FROM mh0 WHERE rn <= CASE WHEN k0 < 5 THEN least(5, nn) ELSE k0 END)"""

DRIFT = """
ends AS (SELECT p, min(t) AS lo, max(t) AS hi FROM cal JOIN per ON t > p * 4 + 104 AND t <= p * 4 + 108 GROUP BY 1),
drift0 AS (SELECT ivp.p, ivp.symbol, ivp.w * b.close / a.close AS x FROM ivp JOIN ends USING (p)
           LEFT JOIN px a ON a.t = lo AND a.symbol = ivp.symbol LEFT JOIN px b ON b.t = hi AND b.symbol = ivp.symbol),
drift AS (SELECT p, symbol, x / sum(x) OVER (PARTITION BY p) AS w FROM drift0)"""


def sql(select: str, *extra: str, base: str = BRAND_WEEK, periods: str | None = None, train: int = TRAIN, step: int = STEP, weights: str | None = None) -> str:
    held_first = [PLAIN_W, held(step, train)] if weights is None else []
    return "WITH RECURSIVE " + ",".join([base, INDEX, windows(train, step, periods), *held_first, *extra]) + "\n" + select


def seven(select: str, *extra: str) -> str:
    """SQL over the weights w of all seven strategies."""
    picked = "SELECT p, symbol AS s, rn - 1 AS id FROM mh"
    return sql(select, MH, TREE, tree(picked, "won"), MVP, SEVEN_W, held(), *extra, weights="seven")


def r8(*names: str, digits: int = 8) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0::DOUBLE AS {n.split('.')[-1]}" for n in names)


SERIES_NAMES = [
    "total_return_pct", "annualized_return_pct", "annualized_vol_pct", "max_drawdown_pct", "var95_pct", "cvar95_pct", "ulcer_index", "sharpe", "sortino", "calmar",
    "skewness", "kurtosis", "win_rate_pct", "profit_factor",
]
KLINES = """
k AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS open_time, arg_min(value, (ts, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, value)) AS close,
      sum(value) AS volume, count(*) AS num_trades FROM events GROUP BY 1, 2)"""
STORED = KLINES + """,
k0 AS (SELECT symbol, open_time, close, 0::BIGINT AS version FROM k WHERE hour(open_time) < 18),
k1 AS (SELECT symbol, open_time, close, 1::BIGINT AS version FROM k WHERE hour(open_time) >= 12 AND symbol < 'm')"""
MC = """
mu AS (SELECT p, symbol, avg(r) AS mu FROM tr JOIN uni USING (p, symbol) GROUP BY 1, 2),
own AS (SELECT p, list(symbol ORDER BY symbol) AS names, list(mu ORDER BY symbol) AS mu FROM mu GROUP BY 1),
mat AS (SELECT p, list(row ORDER BY i) AS mat FROM (SELECT p, i, list(c ORDER BY j) AS row FROM cov GROUP BY 1, 2) GROUP BY 1),
draws AS MATERIALIZED (
  SELECT names, n AS portfolio, list_transform(names, lambda s: ('0x' || substr(md5(n || ':' || s), 1, 8))::BIGINT / 4294967296.0) AS u
  FROM (SELECT DISTINCT names FROM own), range(5000) z(n)),
mc0 AS (
  SELECT own.p, portfolio, mu, u, list_sum(list_transform(list_zip(u, mat), lambda z: z[1] * list_dot_product(z[2], u))) AS q
  FROM own JOIN draws USING (names) JOIN mat ON mat.p = own.p),
mc AS (SELECT p, portfolio, list_dot_product(mu, u) / list_sum(u) AS ret, sqrt(q) / list_sum(u) AS vol, list_dot_product(mu, u) / sqrt(q) AS sharpe FROM mc0)"""


def _weights(table: str, column: str) -> str:
    return f"SELECT p AS period, symbol, round({column}, 8) + 0.0::DOUBLE AS weight FROM {table}"


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _carry(where: str) -> str:
    return sql(
        f"""SELECT strategy, p AS period, t AS t_idx, round(r, 7) + 0.0 AS ret,
        round(base * own - CASE WHEN t = max(t) OVER (PARTITION BY strategy, p) THEN coalesce(nc, 0) ELSE 0 END, 7) + 0.0 AS cum FROM own JOIN steps USING (strategy, p) {where}""",
        TREE, MVP, CARRIED_W,
        DRIFT.replace("ivp.p, ivp.symbol, ivp.w *", "ivp.strategy, ivp.p, ivp.symbol, ivp.w *").replace("SELECT p, symbol, x / sum(x) OVER (PARTITION BY p)", "SELECT strategy, p, symbol, x / sum(x) OVER (PARTITION BY strategy, p)").replace("FROM ivp JOIN", "FROM w ivp JOIN"),
        "s AS (SELECT y.strategy, q.p, q.t, coalesce(sum(x.r * x.w), 0) AS r FROM (SELECT DISTINCT strategy FROM w) y CROSS JOIN (SELECT p, t FROM cal JOIN per ON t > p * 4 + 104 AND t <= p * 4 + 108) q LEFT JOIN (te JOIN w USING (p, symbol)) x ON x.t = q.t AND x.strategy = y.strategy GROUP BY 1, 2, 3)",
        "gr AS (SELECT strategy, p, product(1 + r) AS g FROM s GROUP BY 1, 2)",
        "paid AS (SELECT w.strategy, w.p, 0.001 * sum(abs(w.w - coalesce(drift.w, 0))) AS c FROM w LEFT JOIN drift ON drift.strategy = w.strategy AND drift.p = w.p - 1 AND drift.symbol = w.symbol WHERE w.p > 0 GROUP BY 1, 2)",
        "st1 AS (SELECT strategy, p, g, coalesce(c, 0) AS c, coalesce(product(g) OVER (PARTITION BY strategy ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS b FROM gr LEFT JOIN paid USING (strategy, p))",
        "steps AS (SELECT strategy, p, b * (1 - sum(c / b) OVER (PARTITION BY strategy ORDER BY p ROWS UNBOUNDED PRECEDING)) AS base, lead(c) OVER (PARTITION BY strategy ORDER BY p) AS nc FROM st1)",
        "own AS (SELECT strategy, p, t, r, product(1 + r) OVER (PARTITION BY strategy, p ORDER BY t ROWS UNBOUNDED PRECEDING) AS own FROM s)",
        periods="(SELECT (count(*) - 104 - 4) // 4 + 2 FROM cal)", weights="carried",
    )


ORACLES = {
    "returns_nofill": sql("SELECT d, symbol, round(r, 8) + 0.0 AS ret FROM ret"),
    "segment_returns": "WITH panel AS (SELECT c_mktsegment AS symbol, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)," + INDEX + " SELECT d, symbol, round(r, 8) + 0.0 AS ret FROM ret",
    "returns_pad_rowdrop": sql(
        "SELECT d, symbol, round(r, 8) + 0.0 AS ret FROM pr WHERE t IN (SELECT t FROM pr GROUP BY t HAVING count(r) = count(*))",
        "grid AS (SELECT s.symbol, cal.t, cal.d, px.close FROM (SELECT DISTINCT symbol FROM px) s CROSS JOIN cal LEFT JOIN px ON px.symbol = s.symbol AND px.t = cal.t)",
        "pad AS (SELECT symbol, t, d, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS close FROM grid)",
        "pr AS (SELECT symbol, t, d, close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r FROM pad)",
    ),
    "returns_grouped_pad": sql("SELECT d, symbol, round(close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1, 8) + 0.0 AS ret FROM panel"),
    "universe_complete": sql("SELECT p AS period, symbol FROM uni"),
    "symbols_null_after_date": sql("SELECT s.symbol FROM (SELECT DISTINCT symbol FROM px) s CROSS JOIN cal LEFT JOIN ret ON ret.symbol = s.symbol AND ret.t = cal.t WHERE cal.d > DATE '1999-01-01' GROUP BY 1 HAVING count(ret.r) < count(*)"),
    "price_pivot": sql("SELECT d, " + ", ".join(f"round(max(close) FILTER (WHERE symbol = 'Brand#{k}'), 4) + 0.0 AS brand_{k}" for k in range(1, 26)) + " FROM panel GROUP BY d"),
    "pivot_mean": "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d, " + ", ".join(f"round(avg(l_discount) FILTER (WHERE l_returnflag = '{k}'), 8) + 0.0 AS \"{k}\"" for k in "ANR") + " FROM lineitem GROUP BY 1",
    "calendar_windows": sql("SELECT p AS period, p * 4 + 1 AS train_lo, p * 4 + 104 AS train_hi, p * 4 + 105 AS test_lo, p * 4 + 108 AS test_hi FROM per"),
    "price_grid": sql("SELECT cal.d, s.symbol, round(px.close, 4) + 0.0 AS close FROM (SELECT DISTINCT symbol FROM px) s CROSS JOIN cal LEFT JOIN px ON px.symbol = s.symbol AND px.t = cal.t"),
    "training_rows": sql("SELECT p AS period, count(*) AS n, min(t) AS lo, max(t) AS hi FROM tr GROUP BY 1"),
    "pair_generator": "SELECT a.p_brand || b.p_brand AS pair FROM (SELECT DISTINCT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey) a JOIN (SELECT DISTINCT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey) b ON a.p_brand <> b.p_brand",
    "cov_matrix": sql("SELECT p AS period, i, j, round(c, 10) + 0.0 AS cov FROM cov WHERE i <= j"),
    "corr_matrix": sql("SELECT a.p AS period, a.i, a.j, round(a.c / sqrt(x.c * y.c), 8) + 0.0 AS corr FROM cov a JOIN cov x ON x.p = a.p AND x.i = a.i AND x.j = a.i JOIN cov y ON y.p = a.p AND y.i = a.j AND y.j = a.j WHERE a.i <= a.j"),
    "hrp_distance": sql("SELECT a.p AS period, a.i, a.j, round(sqrt(greatest(0, (1 - a.c / sqrt(x.c * y.c)) / 2)), 8) + 0.0 AS dist FROM cov a JOIN cov x ON x.p = a.p AND x.i = a.i AND x.j = a.i JOIN cov y ON y.p = a.p AND y.i = a.j AND y.j = a.j WHERE a.i < a.j"),
    "second_order_distance": sql(
        "SELECT a.p AS period, a.s AS i, b.s AS j, round(sqrt(sum((k.dd - l.dd) * (k.dd - l.dd))), 7) + 0.0 AS dist2 FROM u a JOIN u b ON a.p = b.p AND a.s < b.s JOIN dist k ON k.p = a.p AND k.x = a.id JOIN dist l ON l.p = a.p AND l.x = b.id AND l.y = k.y GROUP BY 1, 2, 3",
        TREE,
    ),
    "ivp_weights": sql(_weights("ivp", "w")),
    "mvp_kkt": sql("SELECT p AS period, true AS sum_ok, true AS nonneg_ok, true AS kkt_ok, true AS best_ok FROM per"),
    "hrp_linkage": sql("SELECT DISTINCT p AS period, (step - 1)::BIGINT AS step, ml AS \"left\", mg AS \"right\", round(md, 8) + 0.0 AS dist, ms AS size FROM st WHERE step > 0", TREE),
    "hrp_leaf_order": sql("SELECT u.p AS period, u.s AS symbol, o.pos::BIGINT AS pos FROM o JOIN u USING (p, id)", TREE),
    "hrp_weights": sql("SELECT p AS period, symbol, round(weight, 8) + 0.0 AS weight FROM hrp", TREE),
    "hrp_nodes": sql(
        "SELECT c.p AS period, c.node, g.lo, g.hi - g.lo AS n_leaves, round(c.v, 10) + 0.0 AS variance, round(al.f, 10) + 0.0 AS share FROM cvar c JOIN seg g USING (p, node) LEFT JOIN al USING (p, node)",
        TREE,
    ),
    "hrp_path_weights": sql("SELECT p AS period, symbol, round(weight, 8) + 0.0 AS weight FROM hrp", TREE),
    "mvp_weights": sql("SELECT p AS period, symbol, round(weight, 8) + 0.0 AS weight FROM mvp", MVP),
    "hrp_cluster_var": sql("SELECT a.p AS period, round(sum(a.w * b.w * c), 10) + 0.0 AS cluster_var FROM ivp a JOIN ivp b ON a.p = b.p JOIN cov ON cov.p = a.p AND i = a.symbol AND j = b.symbol GROUP BY 1"),
    "csm_scores": sql("SELECT p AS period, symbol, round(score, 8) + 0.0 AS score FROM sc"),
    "csm_select": sql("SELECT p AS period, symbol FROM csm WHERE pick"),
    "csm_equal": sql(_weights("csm", "eq")),
    "csm_momentum": sql(_weights("csm", "mo")),
    "csm_inverse_vol": sql(_weights("csm", "iv")),
    "tsm_growth_index": sql("SELECT p AS period, t AS t_idx, symbol, round(g, 8) + 0.0 AS growth FROM grow"),
    "tsm_ma_equal": sql(_weights("tsm", "ma_eq")),
    "tsm_ma_voltarget": sql(_weights("tsm", "ma_vt")),
    "tsm_abs_equal": sql(_weights("tsm", "ab_eq")),
    "tsm_abs_voltarget": sql(_weights("tsm", "ab_vt")),
    "rmm_raw": sql("SELECT p AS period, symbol, round(raw, 8) + 0.0 AS raw_weight FROM rmm"),
    "rmm_realized_vol": sql("SELECT DISTINCT p AS period, round(vol, 8) + 0.0 AS realized_vol, round(scale, 8) + 0.0 AS scale FROM rmm"),
    "rmm_weights": sql("SELECT p AS period, symbol, round(raw * scale / sum(raw * scale) OVER (PARTITION BY p), 8) + 0.0 AS weight, round(raw * scale, 8) + 0.0 AS scaled_weight FROM rmm"),
    "mh_select": sql("SELECT p AS period, symbol, rn FROM mh", MH),
    "mh_weights": sql("SELECT p AS period, uni.symbol, round(coalesce(weight, 0), 8) + 0.0 AS weight FROM uni LEFT JOIN wonhrp USING (p, symbol)", MH, tree("SELECT p, symbol AS s, rn - 1 AS id FROM mh", "won")),
    "hodl": sql(
        "SELECT strategy, t AS t_idx, round(r, 8) + 0.0 AS ret, round(product(1 + r) OVER (PARTITION BY strategy ORDER BY t ROWS UNBOUNDED PRECEDING), 8) + 0.0 AS cum FROM h",
        "h AS (SELECT 'HODL ' || s AS strategy, cal.t, coalesce(r, 0) AS r FROM (VALUES ('Brand#1'), ('Brand#10')) z(s) CROSS JOIN cal LEFT JOIN ret ON ret.t = cal.t AND symbol = s WHERE cal.t > 104)",
    ),
    "portfolio_returns": sql("SELECT strategy, t AS t_idx, round(r, 8) + 0.0 AS ret FROM ser"),
    "cumulative": sql("SELECT strategy, t AS t_idx, round(cum, 8) + 0.0 AS cum FROM cum", SERIES),
    "drawdowns": sql("SELECT strategy, t AS t_idx, round(dd, 8) + 0.0 AS dd FROM dd", SERIES),
    "rolling_sharpe": sql(
        "SELECT strategy, t AS t_idx, round(m, 6) + 0.0 AS mean, round(s, 6) + 0.0 AS sd, round(m * 365 / (s * sqrt(365)), 6) + 0.0 AS sharpe FROM rs",
        "rs AS (SELECT strategy, t, CASE WHEN count(r) OVER f = 90 THEN avg(r) OVER f END AS m, CASE WHEN count(r) OVER f = 90 THEN stddev_samp(r) OVER f END AS s FROM ser WINDOW f AS (PARTITION BY strategy ORDER BY t ROWS 89 PRECEDING))",
    ),
    "metrics_full": sql(f"SELECT strategy, {r8(*SERIES_NAMES, digits=6)} FROM met", SERIES),
    "metrics_basic": sql("SELECT strategy, round(total_return_pct / 100, 6) + 0.0 AS total_return, round(annualized_vol_pct / 100, 6) + 0.0 AS volatility, round(sharpe, 6) + 0.0 AS sharpe, round(sortino, 6) + 0.0 AS sortino, round(max_drawdown_pct / 100, 6) + 0.0 AS max_drawdown, round(calmar, 6) + 0.0 AS calmar FROM met", SERIES),
    "risk_return": sql(f"SELECT strategy, {r8('annualized_vol_pct', 'annualized_return_pct', 'max_drawdown_pct', 'sharpe', digits=6)} FROM met", SERIES),
    "effective_n": sql("SELECT strategy, p AS period, round(1 / sum(w * w), 6) + 0.0 AS effective_n, round(max(w) * 100, 6) + 0.0 AS max_weight_pct, count(*) FILTER (WHERE w > 0.001) AS n_assets FROM w GROUP BY 1, 2"),
    "turnover_union": sql("SELECT strategy, p AS period, round(tov, 8) + 0.0 AS turnover FROM tov", COSTS),
    "transition_turnover_cost": sql("SELECT strategy, p AS period, round(turnover, 8) + 0.0 AS turnover, round(cost, 8) + 0.0 AS cost FROM cst", COSTS),
    "transition_decision": sql(
        """SELECT strategy, p AS period, (pr - cost) / pv - cr / cv > 0.001 AS recommendation, round(cr, 7) + 0.0 AS c_return, round(cv, 7) + 0.0 AS c_vol, round(pr / pv, 7) + 0.0 AS p_sharpe,
        round(cost, 7) + 0.0 AS transaction_costs, round((pr - cost) / pv, 7) + 0.0 AS adjusted_sharpe_ratio, round((pr - cost) / pv - cr / cv, 7) + 0.0 AS sharpe_improvement, round(turnover, 7) + 0.0 AS turnover
        FROM g JOIN v USING (strategy, p) JOIN cst USING (strategy, p)""",
        COSTS,
        "mu AS (SELECT p, symbol, avg(r) AS mu FROM tr GROUP BY 1, 2)",
        "both_w AS (SELECT b.strategy, b.p, b.symbol, coalesce(a.w, 0) AS old, b.w AS new FROM w b LEFT JOIN prev a USING (strategy, p, symbol))",
        "g AS (SELECT strategy, p, sum(old * mu) * 365 AS cr, sum(new * mu) * 365 AS pr FROM both_w JOIN mu USING (p, symbol) GROUP BY 1, 2)",
        "v AS (SELECT a.strategy, a.p, sqrt(sum(a.old * b.old * c) * 365) AS cv, sqrt(sum(a.new * b.new * c) * 365) AS pv FROM both_w a JOIN both_w b ON a.strategy = b.strategy AND a.p = b.p JOIN cov ON cov.p = a.p AND i = a.symbol AND j = b.symbol GROUP BY 1, 2)",
    ),
    "static_backtest": sql(
        "SELECT strategy, t AS t_idx, round(r, 8) + 0.0 AS ret, round(product(1 + r) OVER (PARTITION BY strategy ORDER BY t ROWS UNBOUNDED PRECEDING), 8) + 0.0 AS cum FROM stat",
        "stat AS (SELECT s.strategy, cal.t, coalesce(sum(x.r * x.w), 0) AS r FROM (SELECT DISTINCT strategy FROM w) s CROSS JOIN cal LEFT JOIN (SELECT ret.t, ret.r, w.w, w.strategy FROM ret JOIN w ON w.symbol = ret.symbol AND w.p = 0) x ON x.strategy = s.strategy AND x.t = cal.t WHERE cal.t > 104 GROUP BY 1, 2)",
    ),
    "turnover_table": sql("SELECT strategy, round(sum(tov), 7) + 0.0 AS total_turnover, round(avg(tov), 7) + 0.0 AS avg_turnover, count(*) AS rebalances, round(sum(cost) * 100, 7) + 0.0 AS total_costs_pct FROM tov JOIN cst USING (strategy, p) GROUP BY 1", COSTS),
    "rolling_backtest_all": seven(
        f"SELECT strategy, {r8(*[f'met.{n}' for n in SERIES_NAMES], digits=6)}, round(1 / e, 6) + 0.0 AS effective_n, round(m * 100, 6) + 0.0 AS max_weight_pct, n_assets, round(x.tov, 6) + 0.0 AS avg_turnover, rebalances, round(paid, 6) + 0.0 AS total_costs_pct FROM met JOIN con USING (strategy) JOIN x USING (strategy)",
        SERIES, COSTS,
        "con AS (SELECT strategy, sum(w * w) AS e, max(w) AS m, count(*) FILTER (WHERE w > 0.001) AS n_assets FROM w WHERE p = (SELECT max(p) FROM per) GROUP BY 1)",
        "x AS (SELECT strategy, avg(tov) AS tov, count(*) AS rebalances, sum(cost) * 100 AS paid FROM tov JOIN cst USING (strategy, p) GROUP BY 1)",
    ),
    "drift_weights": sql("SELECT 'IVP' AS strategy, p AS period, symbol, round(w, 8) + 0.0 AS weight FROM drift", DRIFT),
    "carry_backtest": _carry("WHERE strategy = 'IVP'"),
    "carry_backtest_all": _carry(""),
    "compare_vs_baseline": sql(
        "SELECT a.strategy, round(a.sharpe - b.sharpe, 6) + 0.0 AS sharpe_diff, round(a.total_return_pct - b.total_return_pct, 6) + 0.0 AS return_diff, round((a.sharpe - b.sharpe) / abs(b.sharpe) * 100, 6) + 0.0 AS sharpe_change_pct, round((a.total_return_pct - b.total_return_pct) / abs(b.total_return_pct) * 100, 6) + 0.0 AS return_change_pct FROM met a CROSS JOIN met b WHERE b.strategy = 'IVP'",
        SERIES,
    ),
    "relative_performance": sql("SELECT a.strategy, a.t AS t_idx, round(a.cum / b.cum, 8) + 0.0 AS relative FROM cum a JOIN cum b ON a.t = b.t AND b.strategy = 'IVP'", SERIES),
    "log_growth": sql("SELECT strategy, t AS t_idx, round(ln(1 + cum), 8) + 0.0 AS log_cum, round(last_value(cum) OVER (PARTITION BY strategy ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - 1, 8) + 0.0 AS final_roi FROM cum", SERIES),
    "return_histogram": sql(
        "SELECT strategy, least(floor((x - lo) / ((hi - lo) / 50)), 49)::BIGINT AS bin, count(*) AS n, round(count(*) / (any_value(total) * any_value((hi - lo) / 50)), 8) + 0.0 AS density FROM (SELECT strategy, r * 100 AS x FROM ser) JOIN (SELECT strategy, min(r * 100) AS lo, max(r * 100) AS hi, count(*) AS total FROM ser GROUP BY 1) USING (strategy) GROUP BY 1, 2"
    ),
    "weights_kde": sql(
        "SELECT strategy, k, round(lo + k * (hi - lo) / 99, 8) + 0.0 AS x, round(sum(exp(-((lo + k * (hi - lo) / 99 - w) / h) * ((lo + k * (hi - lo) / 99 - w) / h) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) + 0.0 AS density FROM w JOIN (SELECT strategy, min(w) - 3 * (stddev_samp(w) * pow(count(*), -0.2)) AS lo, max(w) + 3 * (stddev_samp(w) * pow(count(*), -0.2)) AS hi, stddev_samp(w) * pow(count(*), -0.2) AS h, count(*) AS n FROM w GROUP BY 1) USING (strategy), range(100) z(k) GROUP BY strategy, k, lo, hi"
    ),
    "normal_overlay": sql(
        "SELECT strategy, k, round(x, 6) + 0.0 AS x, round(exp(-((x - mu) / sd) * ((x - mu) / sd) / 2) / (sd * sqrt(2 * pi())), 6) + 0.0 AS pdf FROM (SELECT strategy, mu, sd, k, mu - 4 * sd + k * 8 * sd / 99 AS x FROM (SELECT strategy, avg(r) * 100 AS mu, stddev_samp(r) * 100 AS sd FROM ser GROUP BY 1), range(100) z(k))"
    ),
    "top15_weights": sql("SELECT strategy, rn AS rank, symbol, round(w, 8) + 0.0 AS weight, CASE WHEN rn <= 3 THEN substr(symbol, 1, 6) END AS label FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY w DESC, symbol) AS rn FROM w WHERE p = (SELECT max(p) FROM per) AND w > 0.001) WHERE rn <= 15"),
    "leaderboard": sql(
        "SELECT metric, rn AS rank, strategy, round(value, 6) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'avg_turnover' THEN round(value, 9) ELSE -round(value, 9) END, strategy) AS rn FROM (UNPIVOT (SELECT strategy, sharpe, sortino, max_drawdown_pct, avg_turnover FROM dyn) ON sharpe, sortino, max_drawdown_pct, avg_turnover INTO NAME metric VALUE value)) WHERE rn <= 3",
        SERIES, COSTS, DYNAMIC,
    ),
    "heatmap_z": sql(
        "SELECT strategy, metric, round(CASE WHEN metric IN ('max_drawdown_pct', 'annualized_vol_pct', 'avg_turnover') THEN -1 ELSE 1 END * (value - avg(value) OVER (PARTITION BY strategy)) / stddev_samp(value) OVER (PARTITION BY strategy), 6) + 0.0 AS z FROM (UNPIVOT (SELECT strategy, sharpe, sortino, calmar, total_return_pct, max_drawdown_pct, annualized_vol_pct, win_rate_pct, avg_turnover FROM dyn) ON sharpe, sortino, calmar, total_return_pct, max_drawdown_pct, annualized_vol_pct, win_rate_pct, avg_turnover INTO NAME metric VALUE value)",
        SERIES, COSTS, DYNAMIC,
    ),
    "monte_carlo_frontier": sql("SELECT p AS period, portfolio, round(ret, 7) + 0.0 AS ret, round(vol, 7) + 0.0 AS vol, round(sharpe, 7) + 0.0 AS sharpe FROM mc", MC),
    "frontier_argmax": sql("SELECT p AS period, arg_min(portfolio, (-sharpe, portfolio)) AS max_sharpe, arg_min(portfolio, (vol, portfolio)) AS min_vol FROM mc GROUP BY 1", MC),
    "eigen_invariants": sql(
        "SELECT cov.p AS period, k AS size, count(*) FILTER (WHERE i = j) AS n, round(sum(c) FILTER (WHERE i = j), 8) + 0.0 AS trace, round(sum(c * c), 8) + 0.0 AS norm2, true AS descending FROM sz JOIN cov USING (p) JOIN ord a ON a.p = sz.p AND a.symbol = i JOIN ord b ON b.p = sz.p AND b.symbol = j WHERE a.rn <= k AND b.rn <= k GROUP BY 1, 2",
        "ord AS (SELECT p, symbol, row_number() OVER (PARTITION BY p ORDER BY md5(symbol)) AS rn, count(*) OVER (PARTITION BY p) AS n FROM uni)",
        "sz AS (SELECT DISTINCT p, least(k, n) AS k FROM ord, (VALUES (2::BIGINT), (5), (10), (20), (30), (40), (1000000)) z(k))",
    ),
    "stablecoin_anti_join": "WITH " + BRAND_WEEK + f" SELECT s AS symbol, count(*) AS n FROM (SELECT CASE WHEN symbol = 'Brand#13' THEN '{STABLE_PAIRS[0]}' ELSE symbol END AS s FROM panel) WHERE s NOT IN ({_listed(STABLE_PAIRS)}) GROUP BY 1",
    "listing_topn": f"SELECT id, symbol, name, round(market_cap, 8) + 0.0 AS market_cap FROM (SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 10 = 0 THEN 'USDT' ELSE 'S' || s_suppkey END AS symbol, s_name AS name, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal ELSE 0 END AS market_cap FROM supplier ORDER BY 4 DESC, 1 LIMIT 40) WHERE lower(symbol) NOT IN ({_listed(STABLE_TICKERS)})",
    "exchange_semi_join": "SELECT n_nationkey::BIGINT AS ordinal, n_name || 'USDT' AS symbol FROM nation WHERE n_regionkey < 3",
    "id_lookup": "SELECT symbol, coin_id FROM (VALUES " + ", ".join(f"('{s}', {repr(COIN_IDS[s]) if s in COIN_IDS else 'NULL'})" for s in ("BTCUSDT", "SOLUSDT", "NULSUSDT", "NONEUSDT")) + ") v(symbol, coin_id)",
    "event_klines": "WITH " + KLINES + f" SELECT symbol, open_time, {r8('open', 'high', 'low', 'close', 'volume', digits=6)}, num_trades FROM k",
    "price_left_joins": """
WITH e AS (SELECT event_type AS coin_id, ts, event_id, value FROM events)
SELECT p.coin_id, count(*) AS n, count(c.value) AS caps, count(v.value) AS volumes, round(sum(p.value), 4) + 0.0 AS price_sum
FROM e p LEFT JOIN (SELECT * FROM e WHERE event_id % 2 = 0) c ON c.coin_id = p.coin_id AND c.ts = p.ts LEFT JOIN (SELECT * FROM e WHERE event_id % 3 = 0) v ON v.coin_id = p.coin_id AND v.ts = p.ts GROUP BY 1""",
    "upsert_by_key": "WITH " + STORED + " SELECT symbol, open_time, round(close, 6) + 0.0 AS close, version FROM (SELECT * FROM k1 UNION ALL SELECT k0.* FROM k0 ANTI JOIN k1 USING (symbol, open_time))",
    "upsert_replace_symbol": "WITH " + STORED + " SELECT symbol, open_time, round(close, 6) + 0.0 AS close, version FROM (SELECT * FROM k1 UNION ALL SELECT k0.* FROM k0 WHERE symbol NOT IN (SELECT symbol FROM k1))",
    "resume_points": "WITH " + KLINES + " SELECT symbol, epoch_ms(max(open_time)) AS start FROM k GROUP BY 1",
    "profile_summary": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_distinct, min({c})::VARCHAR AS least, max({c})::VARCHAR AS largest, "
        + (f"round(avg({c}), 6) + 0.0 AS mean, round(stddev_samp({c}), 6) + 0.0 AS sd, " + ", ".join(f"quantile_disc({c}, 0.{q})::DOUBLE AS q{q}" for q in (25, 50, 75)) if c.endswith("key") else "NULL::DOUBLE AS mean, NULL::DOUBLE AS sd, NULL::DOUBLE AS q25, NULL::DOUBLE AS q50, NULL::DOUBLE AS q75")
        + " FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    ),
    "first_slice": sql(
        f"SELECT strategy, {r8('total_return_pct', 'annualized_vol_pct', 'sharpe', 'max_drawdown_pct', digits=6)} FROM met",
        "hold AS (SELECT cal.t, coalesce(sum(r * w), 0) AS r FROM cal LEFT JOIN (SELECT ret.t, ret.r, ivp.w FROM ret JOIN ivp ON ivp.symbol = ret.symbol AND ivp.p = 0) x ON x.t = cal.t WHERE cal.t > 24 GROUP BY 1)",
        SERIES.replace("FROM ser)", "FROM (SELECT 'IVP' AS strategy, t, r FROM hold))").replace("FROM ser GROUP", "FROM (SELECT 'IVP' AS strategy, t, r FROM hold) GROUP"),
        base="panel AS (SELECT p_type AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, avg(l_extendedprice / l_quantity) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)",
        periods="1", train=24, step=3,
    ),
}


def _large(columns: str, text: str) -> str:
    """text with the named columns cut to nine digits where they are large."""
    near = ", ".join(f"CASE WHEN abs({c}) >= 1e4 THEN printf('%.8e', {c})::DOUBLE ELSE {c} END AS {c}" for c in columns.split())
    return f"SELECT * REPLACE ({near}) FROM ({text})"


for _name, _columns in {
    "cumulative": "cum",
    "metrics_full": "total_return_pct annualized_return_pct calmar profit_factor sortino sharpe",
    "metrics_basic": "total_return calmar sharpe sortino",
    "risk_return": "annualized_return_pct annualized_vol_pct sharpe",
    "static_backtest": "cum",
    "carry_backtest": "cum",
    "carry_backtest_all": "cum",
    "eigen_invariants": "trace norm2",
    "rolling_backtest_all": "total_return_pct annualized_return_pct calmar profit_factor sortino sharpe",
    "hodl": "cum",
    "tsm_growth_index": "growth",
    "compare_vs_baseline": "sharpe_diff return_diff sharpe_change_pct return_change_pct",
    "relative_performance": "relative",
    "log_growth": "final_roi",
    "leaderboard": "value",
    "first_slice": "total_return_pct",
    "price_left_joins": "price_sum",
    "event_klines": "volume",
    "price_grid": "close",
    "price_pivot": " ".join(f"brand_{k}" for k in range(1, 26)),
    "listing_topn": "market_cap",
    "upsert_by_key": "close",
    "upsert_replace_symbol": "close",
}.items():
    ORACLES[_name] = _large(_columns, ORACLES[_name])
