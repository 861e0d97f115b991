"""DuckDB SQL for the queries: written on its own, with another formula where there is one."""

from __future__ import annotations

from foliospark.operators import text as T

#: Raw holdings, holdings with reported weights, and holdings without.
RAW = """
li AS (
  SELECT *, l_suppkey % nf AS fund, l_partkey % ns AS sec
  FROM lineitem, (SELECT greatest(20, count(*) // 5) AS nf FROM supplier), (SELECT greatest(200, count(*) // 10) AS ns FROM part)),
raw0 AS (
  SELECT 'F' || lpad(CAST(fund AS VARCHAR), CASE WHEN nf <= 100 THEN 2 ELSE 9 END, '0') AS fund_id,
         CAST(last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH) AS DATE) AS snapshot_date,
         'cusip:P' || lpad(CAST(sec AS VARCHAR), 8, '0') AS security_id, l_quantity AS quantity,
         CASE WHEN l_returnflag = 'A' AND l_linenumber = 6 THEN NULL WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN -1 ELSE 1 END
           * l_extendedprice * (1 - l_discount) AS market_value,
         'N' || CAST(CASE WHEN sec < 20 THEN l_linenumber ELSE sec END AS VARCHAR) AS security_name,
         'T' || CAST(sec % 150 AS VARCHAR) AS security_ticker,
         'C' || CAST(sec % 25 AS VARCHAR) AS country,
         CASE WHEN sec % 10 = 0 THEN NULL ELSE 'Sector' || CAST(sec % 8 AS VARCHAR) END AS sector
  FROM li),
raw AS (SELECT *, market_value / sum(market_value) OVER (PARTITION BY fund_id, snapshot_date) AS portfolio_weight FROM raw0),
h AS (
  SELECT fund_id, snapshot_date, security_id, sum(quantity) AS quantity, sum(market_value) AS market_value, sum(portfolio_weight) AS portfolio_weight,
         CASE WHEN count(DISTINCT security_name) = 1 THEN any_value(security_name) END AS security_name,
         CASE WHEN count(DISTINCT security_ticker) = 1 THEN any_value(security_ticker) END AS security_ticker,
         CASE WHEN count(DISTINCT country) = 1 THEN any_value(country) END AS country,
         CASE WHEN count(DISTINCT sector) = 1 THEN any_value(sector) END AS sector, count(*) AS n_rows,
         count(DISTINCT security_name) > 1 AS name_conflict
  FROM raw GROUP BY ALL)"""

CONC = """
conc AS (
  SELECT fund_id, snapshot_date, count(*) AS holdings_count, count(portfolio_weight) AS weighted_count, sum(portfolio_weight) AS weight_sum,
         sum(portfolio_weight) FILTER (rk <= 1) AS top_1_weight, sum(portfolio_weight) FILTER (rk <= 5) AS top_5_weight,
         sum(portfolio_weight) FILTER (rk <= 10) AS top_10_weight,
         CASE WHEN min(portfolio_weight) < 0 THEN sum(pow(abs(portfolio_weight) / nullif(gross, 0), 2)) ELSE sum(pow(portfolio_weight / nullif(net, 0), 2)) END AS hhi,
         CASE WHEN min(portfolio_weight) < 0 THEN 'absolute_weights' WHEN count(portfolio_weight) > 0 THEN 'reported_weights' END AS hhi_method
  FROM (SELECT *, row_number() OVER (PARTITION BY fund_id, snapshot_date ORDER BY portfolio_weight DESC NULLS LAST, security_id) AS rk,
               sum(abs(portfolio_weight)) OVER (PARTITION BY fund_id, snapshot_date) AS gross, sum(portfolio_weight) OVER (PARTITION BY fund_id, snapshot_date) AS net FROM h)
  GROUP BY fund_id, snapshot_date)"""

#: Drift by an outer join of the two snapshots.
PAIRS = """
days AS (SELECT DISTINCT fund_id, snapshot_date FROM h),
pairs AS (SELECT a.fund_id, max(b.snapshot_date) AS from_date, a.snapshot_date AS to_date FROM days a JOIN days b ON a.fund_id = b.fund_id AND b.snapshot_date < a.snapshot_date GROUP BY ALL)"""


def dist(name: str, weights: str, pairs: str = "pairs") -> str:
    """Distances of all pairs over ``weights`` (fund_id, snapshot_date, key, weight)."""
    return f"""
{name}_keys AS (
  SELECT p.*, w.key FROM {pairs} p JOIN {weights} w ON w.fund_id = p.fund_id AND w.snapshot_date = p.from_date WHERE weight IS NOT NULL
  UNION SELECT p.*, w.key FROM {pairs} p JOIN {weights} w ON w.fund_id = p.fund_id AND w.snapshot_date = p.to_date WHERE weight IS NOT NULL),
{name}_pq AS (
  SELECT k.*, coalesce(a.weight, 0) AS p, coalesce(b.weight, 0) AS q FROM {name}_keys k
  LEFT JOIN {weights} a ON a.fund_id = k.fund_id AND a.snapshot_date = k.from_date AND a.key = k.key
  LEFT JOIN {weights} b ON b.fund_id = k.fund_id AND b.snapshot_date = k.to_date AND b.key = k.key),
{name}_n AS (SELECT *, p / nullif(sum(p) OVER w, 0) AS pp, q / nullif(sum(q) OVER w, 0) AS qq FROM {name}_pq WINDOW w AS (PARTITION BY fund_id, from_date, to_date)),
{name} AS (
  SELECT fund_id, from_date, to_date, CASE WHEN min(least(p, q)) < 0 THEN 'cosine' ELSE 'jensen_shannon' END AS metric,
         CASE WHEN min(least(p, q)) < 0 THEN CASE WHEN sum(p * p) > 0 AND sum(q * q) > 0 THEN 1 - greatest(-1, least(1, sum(p * q) / sqrt(sum(p * p) * sum(q * q)))) END
              WHEN count(pp) = count(*) AND count(qq) = count(*) THEN sqrt(greatest(0,
                sum(CASE WHEN pp > 0 THEN pp / 2 * log2(2 * pp / (pp + qq)) ELSE 0 END) + sum(CASE WHEN qq > 0 THEN qq / 2 * log2(2 * qq / (pp + qq)) ELSE 0 END))) END AS distance
  FROM {name}_n GROUP BY ALL)"""


HELD_W = "hw AS (SELECT fund_id, snapshot_date, security_id AS key, portfolio_weight AS weight FROM h)"
SECTOR_W = "sw AS (SELECT fund_id, snapshot_date, coalesce(sector, 'UNCLASSIFIED') AS key, sum(portfolio_weight) AS weight FROM h GROUP BY ALL)"


def rnd(sql: str, columns: str, digits: int = 8) -> str:
    """``sql`` with the named columns rounded, negative zeros plain."""
    shown = ", ".join(f"CASE WHEN round({c}, {digits}) = 0 THEN 0.0 ELSE round({c}, {digits}) END::DOUBLE AS {c}" for c in columns.split())
    return f"SELECT * REPLACE ({shown}) FROM ({sql})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


FILINGS = """
f AS (
  SELECT fund_id || '-' || CAST(snapshot_date AS VARCHAR) || '-' || n AS accession, fund_id, snapshot_date AS report_date,
         CAST(snapshot_date + CAST(45 + (CAST(substr(fund_id, 2) AS INTEGER) * 7 + month(snapshot_date) * 3) % 20 + (n - 1) * 10 AS INTEGER) AS DATE) AS filed_at
  FROM (SELECT DISTINCT fund_id, snapshot_date FROM raw0), (VALUES (1), (2)) AS v(n) WHERE n = 1 OR CAST(substr(fund_id, 2) AS INTEGER) % 5 = 0)"""

CONC_COLS = "weight_sum top_1_weight top_5_weight top_10_weight hhi"

TIMELINE = """
fo AS (SELECT *, row_number() OVER o AS nth, lead(filed_at) OVER o AS superseded_by FROM f WINDOW o AS (PARTITION BY fund_id ORDER BY filed_at, report_date, accession)),
us AS (SELECT fo.*, c.* EXCLUDE (fund_id, snapshot_date), lag(report_date) OVER (PARTITION BY fo.fund_id ORDER BY nth) AS previous
       FROM fo JOIN conc c ON c.fund_id = fo.fund_id AND c.snapshot_date = fo.report_date WHERE weighted_count > 0),
tp AS (SELECT DISTINCT fund_id, previous AS from_date, report_date AS to_date FROM us WHERE previous < report_date)"""

TIMELINE_ROWS = """
tl AS (
  SELECT us.fund_id, us.report_date, filed_at AS publication_date, filed_at AS available_from, superseded_by, accession, us.holdings_count AS holding_count,
         us.weight_sum AS reported_weight_sum, us.top_1_weight, us.top_5_weight AS top_5_concentration, us.top_10_weight AS top_10_concentration, us.hhi,
         d.distance AS holdings_drift, CASE WHEN d.fund_id IS NOT NULL THEN us.top_10_weight - c.top_10_weight END AS top_10_delta,
         CASE WHEN d.fund_id IS NOT NULL THEN us.hhi - c.hhi END AS hhi_delta,
         CASE WHEN d.fund_id IS NOT NULL THEN us.holdings_count - c.holdings_count END AS holding_count_delta
  FROM us LEFT JOIN td d ON d.fund_id = us.fund_id AND d.from_date = us.previous AND d.to_date = us.report_date
  LEFT JOIN conc c ON c.fund_id = us.fund_id AND c.snapshot_date = us.previous)"""

DRIFT = with_(RAW, CONC, PAIRS, HELD_W, SECTOR_W, dist("hd", "hw"), dist("sd", "sw"))
TL = with_(RAW, CONC, FILINGS, HELD_W, TIMELINE, dist("td", "hw", "tp"), TIMELINE_ROWS)
TL_COLS = "reported_weight_sum top_1_weight top_5_concentration top_10_concentration hhi holdings_drift top_10_delta hhi_delta"

ORACLES = {
    "normalize_holdings": with_(RAW) + rnd(rnd("SELECT fund_id, snapshot_date, security_id, security_name, security_ticker, country, sector, quantity, market_value, portfolio_weight FROM h", "quantity market_value", 4), "portfolio_weight"),
    "reject_report": with_(RAW) + "SELECT snapshot_date, count(*) AS rejected, count(*) FILTER (quantity <= 3) AS no_fund, count(*) FILTER (quantity <= 1) AS no_security FROM raw0 WHERE quantity <= 3 GROUP BY ALL",
    "conflict_warnings": with_(RAW, "sn AS (SELECT fund_id, snapshot_date, bool_and(market_value IS NOT NULL) AS whole, sum(market_value) AS total, sum(n_rows - 1) AS extra, count(*) AS n FROM h GROUP BY ALL)")
    + """SELECT 'conflict' AS kind, NULL::VARCHAR AS fund_id, NULL::DATE AS snapshot_date, 'security_name' AS "column", count(*) AS n FROM h WHERE name_conflict
UNION ALL SELECT CASE WHEN whole AND total <> 0 THEN 'weights_derived' ELSE 'weights_blocked' END, fund_id, snapshot_date, NULL, 1 FROM sn
UNION ALL SELECT 'missing_weight', fund_id, snapshot_date, NULL, n FROM sn WHERE NOT (whole AND total <> 0)
UNION ALL SELECT 'duplicates', fund_id, snapshot_date, NULL, CAST(extra AS BIGINT) FROM sn WHERE extra > 0""",
    "derived_weights": with_(RAW) + rnd("""SELECT fund_id, snapshot_date, security_id,
  CASE WHEN bool_and(market_value IS NOT NULL) OVER w AND sum(market_value) OVER w <> 0 THEN market_value / sum(market_value) OVER w END AS portfolio_weight
FROM h WINDOW w AS (PARTITION BY fund_id, snapshot_date)""", "portfolio_weight"),
    "summary_sql": with_(RAW) + rnd("SELECT fund_id, snapshot_date, count(*) AS holdings, sum(portfolio_weight) AS weight_sum FROM h GROUP BY ALL", "weight_sum"),
    "concentration": with_(RAW, CONC) + rnd("SELECT * FROM conc", CONC_COLS),
    "sector_allocation": with_(RAW) + rnd("SELECT fund_id, snapshot_date, coalesce(sector, 'UNCLASSIFIED') AS label, sum(portfolio_weight) AS weight, count(*) AS holdings_count FROM h GROUP BY ALL", "weight"),
    "country_allocation": with_(RAW) + rnd("SELECT fund_id, snapshot_date, coalesce(country, 'UNCLASSIFIED') AS label, sum(portfolio_weight) AS weight, count(*) AS holdings_count FROM h GROUP BY ALL", "weight"),
    "largest_positions": with_(RAW) + rnd("""SELECT fund_id, snapshot_date, CAST(rk AS INTEGER) AS rank, security_id, security_name, portfolio_weight FROM (
  SELECT *, row_number() OVER (PARTITION BY fund_id, snapshot_date ORDER BY portfolio_weight DESC NULLS LAST, security_id) AS rk FROM h) WHERE rk <= 10""", "portfolio_weight"),
    "snapshot_report": with_(RAW, CONC) + rnd("""SELECT c.fund_id, c.snapshot_date, c.holdings_count, c.hhi, s.label AS top_sector, CAST(k.n AS INTEGER) AS countries, t.security_id AS top_security, CAST(least(10, c.holdings_count) AS INTEGER) AS listed
FROM conc c JOIN (SELECT fund_id, snapshot_date, label FROM (SELECT fund_id, snapshot_date, coalesce(sector, 'UNCLASSIFIED') AS label, sum(portfolio_weight) AS w FROM h GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY fund_id, snapshot_date ORDER BY w DESC NULLS LAST, label) = 1) s USING (fund_id, snapshot_date)
JOIN (SELECT fund_id, snapshot_date, count(DISTINCT coalesce(country, 'UNCLASSIFIED')) AS n FROM h GROUP BY ALL) k USING (fund_id, snapshot_date)
JOIN (SELECT fund_id, snapshot_date, security_id FROM h QUALIFY row_number() OVER (PARTITION BY fund_id, snapshot_date ORDER BY portfolio_weight DESC NULLS LAST, security_id) = 1) t USING (fund_id, snapshot_date)""", "hhi"),
    "drift_consecutive": DRIFT + rnd("""SELECT p.fund_id, p.from_date, p.to_date, b.top_10_weight - a.top_10_weight AS top_10_delta, b.hhi - a.hhi AS hhi_delta, b.holdings_count - a.holdings_count AS holdings_count_delta,
  hd.distance AS holdings_distance, hd.metric AS holdings_metric
FROM pairs p JOIN conc a ON a.fund_id = p.fund_id AND a.snapshot_date = p.from_date JOIN conc b ON b.fund_id = p.fund_id AND b.snapshot_date = p.to_date
LEFT JOIN hd ON hd.fund_id = p.fund_id AND hd.from_date = p.from_date AND hd.to_date = p.to_date""", "top_10_delta hhi_delta holdings_distance", 7),
    "sector_drift": DRIFT + rnd("""SELECT p.fund_id, p.from_date, p.to_date, CASE WHEN classified THEN sd.distance END AS sector_distance, CASE WHEN classified THEN sd.metric ELSE 'unavailable' END AS sector_metric
FROM pairs p LEFT JOIN sd ON sd.fund_id = p.fund_id AND sd.from_date = p.from_date AND sd.to_date = p.to_date
LEFT JOIN (SELECT fund_id, from_date, to_date, bool_or(key <> 'UNCLASSIFIED') AS classified FROM sd_keys GROUP BY ALL) c ON c.fund_id = p.fund_id AND c.from_date = p.from_date AND c.to_date = p.to_date""", "sector_distance", 7),
    "weight_changes": with_(RAW, PAIRS, """
ch AS (
  SELECT p.*, coalesce(a.security_id, b.security_id) AS security_id, coalesce(b.security_name, a.security_name) AS security_name,
         coalesce(a.portfolio_weight, 0) AS from_weight, coalesce(b.portfolio_weight, 0) AS to_weight,
         (a.security_id IS NOT NULL AND a.portfolio_weight IS NULL) OR (b.security_id IS NOT NULL AND b.portfolio_weight IS NULL) AS unknown
  FROM (SELECT p.*, s.security_id AS sid FROM pairs p, LATERAL (SELECT DISTINCT security_id FROM h WHERE h.fund_id = p.fund_id AND h.snapshot_date IN (p.from_date, p.to_date)) s) p
  LEFT JOIN h a ON a.fund_id = p.fund_id AND a.snapshot_date = p.from_date AND a.security_id = p.sid
  LEFT JOIN h b ON b.fund_id = p.fund_id AND b.snapshot_date = p.to_date AND b.security_id = p.sid)""")
    + rnd("""SELECT fund_id, from_date, to_date, direction, CAST(rk AS INTEGER) AS rank, security_id, security_name, from_weight, to_weight, delta FROM (
  SELECT *, row_number() OVER (PARTITION BY fund_id, from_date, to_date, direction ORDER BY round(abs(delta), 9) DESC, security_id) AS rk FROM (
    SELECT *, to_weight - from_weight AS delta, CASE WHEN to_weight > from_weight THEN 'increase' ELSE 'decrease' END AS direction FROM ch WHERE NOT unknown AND to_weight <> from_weight)) WHERE rk <= 5""", "from_weight to_weight delta"),
    "latest_fund_view": DRIFT + rnd("""SELECT c.fund_id, c.snapshot_date, c.holdings_count, c.top_10_weight, c.hhi, p.from_date, hd.distance AS holdings_distance, c.top_10_weight - a.top_10_weight AS top_10_delta, CAST(DATE '2002-03-01' - c.snapshot_date AS INTEGER) AS age_days, DATE '2002-03-01' - c.snapshot_date > 120 AS stale
FROM conc c JOIN (SELECT fund_id, max(snapshot_date) AS snapshot_date FROM h GROUP BY ALL) m USING (fund_id, snapshot_date)
LEFT JOIN pairs p ON p.fund_id = c.fund_id AND p.to_date = c.snapshot_date LEFT JOIN hd ON hd.fund_id = p.fund_id AND hd.to_date = p.to_date
LEFT JOIN conc a ON a.fund_id = p.fund_id AND a.snapshot_date = p.from_date""", "top_10_weight hhi holdings_distance top_10_delta", 7),
    "holdings_timeline": TL + rnd("SELECT * FROM tl", TL_COLS, 7),
}

BARS = """
b AS (SELECT CASE WHEN k > 1 THEN o_orderstatus || CAST(o_custkey % k AS VARCHAR) ELSE o_orderstatus END AS instrument_id, CAST(o_orderdate AS DATE) AS trading_date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
             min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
      FROM orders, (SELECT count(*) // 1500 AS k FROM customer) GROUP BY ALL)"""


def fall(path: str) -> str:
    """Largest fall of a list: over every place, from the largest value up to it."""
    return f"list_max(list_transform(range(1, len({path}) + 1), lambda j: (list_max({path}[1:j]) - {path}[j]) / list_max({path}[1:j])))"


def full(agg: str, of: str, n: int) -> str:
    frame = f"OVER (PARTITION BY instrument_id ORDER BY trading_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({of}) {frame} = {n} THEN {agg}({of}) {frame} END"


_ret = lambda n: f"close / lag(close, {n}) OVER w - 1"
FEATURES = f"""
f1 AS (SELECT *, {", ".join(f"{_ret(n)} AS return_{n}d" for n in (1, 5, 20, 60))}, ln(close) - ln(lag(close) OVER w) AS log_return_1d,
  {", ".join(f"{_ret(n)} AS momentum_{n}d" for n in (20, 60, 120))}, (high - low) / close AS high_low_range, (close - open) / open AS close_open_range,
  volume / lag(volume) OVER w - 1 AS volume_change FROM b WINDOW w AS (PARTITION BY instrument_id ORDER BY trading_date)),
f2 AS (SELECT *, {", ".join(f"{full('stddev_samp', 'log_return_1d', n)} * sqrt(252) AS realized_vol_{n}d" for n in (5, 20, 60))},
  {", ".join(f"(volume - {full('avg', 'volume', n)}) / nullif(round({full('stddev_samp', 'volume', n)}, 10), 0) AS volume_zscore_{n}d" for n in (20, 60))},
  1 - close / max(close) OVER (PARTITION BY instrument_id ORDER BY trading_date) AS rolling_drawdown,
  {", ".join(f"{full('list', 'close', n)} AS path_{n}" for n in (20, 60))},
  CASE WHEN count(close) OVER a = 20 THEN list(close) OVER (PARTITION BY instrument_id ORDER BY trading_date ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) END AS path_ahead,
  CASE WHEN count(close) OVER a = 20 THEN stddev_samp(log_return_1d) OVER a * sqrt(252) END AS forward_realized_vol_20d,
  CASE WHEN count(close) OVER a = 20 THEN max(trading_date) OVER a END AS label_end_date
  FROM f1 WINDOW a AS (PARTITION BY instrument_id ORDER BY trading_date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
mf AS (SELECT * EXCLUDE (path_20, path_60, path_ahead), {fall("path_20")} AS rolling_max_drawdown_20d, {fall("path_60")} AS rolling_max_drawdown_60d, {fall("path_ahead")} AS forward_max_drawdown_20d FROM f2)"""
F_NAMES = (
    "return_1d return_5d return_20d return_60d log_return_1d momentum_20d momentum_60d momentum_120d high_low_range close_open_range volume_change "
    "realized_vol_5d realized_vol_20d realized_vol_60d volume_zscore_20d volume_zscore_60d rolling_drawdown rolling_max_drawdown_20d rolling_max_drawdown_60d"
)
FUNDS = """
fu AS (
  SELECT CASE WHEN k > 1 THEN kind || i ELSE kind END AS instrument_id, 'F' || lpad(CAST((3 * i + o) % nf AS VARCHAR), CASE WHEN nf <= 100 THEN 2 ELSE 9 END, '0') AS fund_id
  FROM (VALUES ('F', 0), ('O', 1), ('P', 2)) AS v(kind, o), (SELECT greatest(20, count(*) // 5) AS nf FROM supplier),
       (SELECT k, unnest(range(k)) AS i FROM (SELECT greatest(1, count(*) // 1500) AS k FROM customer)))"""
ASOF = """
tl1 AS (SELECT * FROM tl QUALIFY row_number() OVER (PARTITION BY fund_id, available_from ORDER BY report_date DESC, accession DESC) = 1),
rk AS (
  SELECT m.*, t.* EXCLUDE (fund_id) FROM (SELECT mf.*, fu.fund_id FROM mf JOIN fu USING (instrument_id)) m
  ASOF LEFT JOIN tl1 t ON m.fund_id = t.fund_id AND m.trading_date >= t.available_from),
rs AS (SELECT *, CASE WHEN momentum_120d IS NULL THEN 'warmup' WHEN label_end_date IS NULL THEN 'no_target'
  WHEN trading_date <= DATE '1999-12-31' THEN CASE WHEN label_end_date > DATE '1999-12-31' THEN 'purged_train' ELSE 'train' END
  WHEN trading_date <= DATE '2000-12-31' THEN CASE WHEN label_end_date > DATE '2000-12-31' THEN 'purged_validation' ELSE 'validation' END ELSE 'test' END AS split FROM rk)"""
MARKET = with_(BARS, FEATURES)
RISK = with_(RAW, CONC, FILINGS, HELD_W, TIMELINE, dist("td", "hw", "tp"), TIMELINE_ROWS, BARS, FEATURES, FUNDS, ASOF)
#: Ridge regression of one feature on standardised columns: the plain slope over 1 + penalty / deviation
#: of the target; no fit where a split has too few rows.
RIDGE = RISK + """,
k AS (SELECT fund_id, trading_date, split, return_1d, holding_count, realized_vol_20d AS x, realized_vol_60d AS z, forward_realized_vol_20d AS y FROM rs WHERE realized_vol_20d IS NOT NULL AND realized_vol_60d IS NOT NULL),
ft AS (SELECT avg(y) AS my, avg(x) AS mx, avg(z) AS mz, covar_pop(y, x) / var_pop(x) / (1 + 0.001 / stddev_pop(y)) AS bm, covar_pop(y, z) / var_pop(z) / (1 + 0.001 / stddev_pop(y)) AS bh
  FROM k WHERE split = 'train' AND y IS NOT NULL HAVING count(*) >= 50 AND (SELECT least(count(*) FILTER (split = 'validation'), count(*) FILTER (split = 'test')) FROM k WHERE y IS NOT NULL) >= 20)
"""
EDGES = """
ch0 AS (SELECT * FROM f WHERE filed_at <= DATE '2000-01-15' QUALIFY row_number() OVER (PARTITION BY fund_id ORDER BY filed_at DESC, report_date DESC, accession DESC) = 1),
e AS (SELECT DATE '2000-01-15' AS as_of, h.fund_id AS etf_node_id, security_id AS security_node_id, coalesce(portfolio_weight, 0) AS portfolio_weight,
             CAST(portfolio_weight IS NULL AS BIGINT) AS missing_weights, security_ticker, security_name, country, snapshot_date AS report_date, filed_at AS available_from, accession
      FROM h JOIN ch0 ON h.fund_id = ch0.fund_id AND h.snapshot_date = ch0.report_date)"""
GRAPH = with_(RAW, FILINGS, EDGES)
TICKS = """
tk AS (SELECT 'price' AS type, event_id AS sequence, event_id + (event_id * 7) % 5 AS arrival, copy, epoch_us(ts) * 1000 AS sent, epoch_us(ts) * 1000 + (event_id * 7919) % 100003 - 50 AS decoded,
              user_id % m AS instrument_id, CAST(round(value * 100) AS BIGINT) AS price_ticks, 'cusip:P' || lpad(CAST(user_id % m AS VARCHAR), 8, '0') AS security_node_id
       FROM events, (SELECT greatest(200, count(*) // 10) * 8 // 25 AS m FROM part), (VALUES (0), (1)) AS v(copy) WHERE copy = 0 OR event_id % 97 = 0)"""
SHOCKS = """
sh AS (
  SELECT 'scenario-' || CAST(n % 7 AS VARCHAR) AS scenario_id, CAST(n * 10 AS INTEGER) AS ord, key, -0.05 * (n % 7 + 1) AS shock FROM (SELECT DISTINCT security_node_id AS key, CAST(substr(security_node_id, 8) AS INTEGER) AS n FROM e)
  UNION ALL SELECT 'scenario-' || CAST(k AS VARCHAR), ord, key, shock FROM range(7) AS r(k), (VALUES (5001, 't100', -0.2), (5002, 'T7', -0.3), (5003, 'T9999', -0.4)) AS v(ord, key, shock)),
sr AS (
  SELECT s.*, CASE WHEN d.key IS NOT NULL OR n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS status,
         CASE WHEN d.key IS NOT NULL THEN s.key WHEN n = 1 THEN one END AS security_node_id
  FROM sh s LEFT JOIN (SELECT DISTINCT security_node_id AS key FROM e) d ON d.key = s.key
  LEFT JOIN (SELECT upper(security_ticker) AS t, count(DISTINCT security_node_id) AS n, min(security_node_id) AS one FROM e GROUP BY 1) t ON t.t = upper(s.key))"""
BINARY = "bn AS (SELECT instrument_id, trading_date, CAST(forward_max_drawdown_20d >= 0.97 AS INTEGER) AS y, round(rolling_max_drawdown_20d, 9) AS score FROM mf WHERE forward_max_drawdown_20d IS NOT NULL AND rolling_max_drawdown_20d IS NOT NULL)"
_LINES = r"string_split_regex(text, '\r\n|[\n\x0b\f\r\x{85}\x{2028}\x{2029}]')"
_quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"


def redacted_sql() -> str:
    """text.scrub without look-around or back references: one pass a kind of quote, for texts that
    hold no mark yet."""
    out = "text"
    for q in "\"'":
        out = f"regexp_replace({out}, {_quoted(T._ASSIGNED + q + T._SCHEME + rf'(?:\\.|[^{q}\\])+' + q)}, {_quoted(rf'\1{q}\2{T.MARK}{q}')}, 'g')"
    bare = T._ASSIGNED + T._SCHEME + r"[^\s\"',;&)}\]\[][^\s\"',;&)}\]]*"
    for pattern, new in ((bare, rf"\1\2{T.MARK}"), (T.BEARER, rf"\1{T.MARK}"), ("|".join(T.issued_pattern(*f) for _, *f in T.ISSUED), T.MARK), (T.EMAIL, "[REDACTED_EMAIL]")):
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(new)}, 'g')"
    return out



ORACLES |= {
    "market_features": MARKET + rnd(f"SELECT instrument_id, trading_date, open, high, low, close, volume, {F_NAMES.replace(" ", ", ")} FROM mf", F_NAMES, 6),
    "forward_targets": MARKET + rnd("SELECT instrument_id, trading_date, forward_realized_vol_20d, forward_max_drawdown_20d, label_end_date, forward_max_drawdown_20d >= 0.97 AS tail_event_20d FROM mf", "forward_realized_vol_20d forward_max_drawdown_20d", 7),
    "asof_holdings": RISK + rnd("""SELECT fund_id, trading_date, accession, report_date, available_from, superseded_by, holding_count, CAST(trading_date - report_date AS INTEGER) AS days_since_holdings_report_date,
  CAST(trading_date - available_from AS INTEGER) AS days_since_holdings_publication, hhi FROM rs""", "hhi", 7),
    "risk_dataset": RISK + rnd("SELECT fund_id, instrument_id, trading_date, momentum_120d, realized_vol_60d, label_end_date, accession, holdings_drift, split FROM rs", "momentum_120d realized_vol_60d holdings_drift", 7),
    "split_counts": RISK + "SELECT fund_id, split, count(*) AS row_count FROM rs GROUP BY ALL",
    "dataset_profile": RISK + "SELECT fund_id, count(*) AS row_count, count(return_1d) AS market_rows, count(holding_count) AS holdings_rows, min(trading_date) AS first_date, max(trading_date) AS last_date, count(DISTINCT accession) AS filings_used, " + ", ".join(f"count(*) FILTER (split = '{p}') AS {p}_rows" for p in ("train", "validation", "test", "purged_train", "purged_validation", "warmup", "no_target")) + " FROM rs GROUP BY fund_id",
    "first_use": RISK + "SELECT t.fund_id, t.accession, t.available_from, min(r.trading_date) AS first_session FROM tl t LEFT JOIN rs r ON r.accession = t.accession GROUP BY ALL",
    "leak_gate": RISK + "SELECT fund_id, count(*) AS row_count, count(*) FILTER (holding_count IS NOT NULL AND available_from > trading_date) AS leaked FROM rs GROUP BY fund_id",
    "provider_comparison": with_(BARS, """
b2 AS (SELECT instrument_id, trading_date, volume, close * (1 + (day(trading_date) % 7 - 3) / 1000.0) AS close FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY trading_date) AS nth FROM b) WHERE nth % 11 <> 0),
j AS (SELECT coalesce(l.instrument_id, r.instrument_id) AS instrument_id, coalesce(l.trading_date, r.trading_date) AS trading_date, l.close AS a, r.close AS c, abs(l.close - r.close) AS gap, abs(l.volume - r.volume) AS vol
      FROM b l FULL JOIN b2 r ON l.instrument_id = r.instrument_id AND l.trading_date = r.trading_date)""")
    + rnd("""SELECT instrument_id, count(gap) AS common_sessions, count(*) FILTER (c IS NULL) AS missing_on_right, count(*) FILTER (a IS NULL) AS missing_on_left, median(gap) AS median_absolute, max(gap) AS max_absolute,
  median(gap / a) AS median_relative, max(gap / a) AS max_relative, max(vol) AS max_volume, min(trading_date) FILTER (gap IS NOT NULL) AS overlap_start, max(trading_date) FILTER (gap IS NOT NULL) AS overlap_end FROM j GROUP BY ALL""", "median_absolute max_absolute median_relative max_relative max_volume", 4),
    "bars_upsert": with_(BARS, """
b2 AS (SELECT instrument_id, trading_date, close * (1 + (day(trading_date) % 7 - 3) / 1000.0) AS close FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY trading_date) AS nth FROM b) WHERE nth % 11 <> 0 AND day(trading_date) > 10),
m AS (SELECT instrument_id, trading_date, close, 'two' AS provider FROM b2 UNION ALL SELECT instrument_id, trading_date, close, 'one' FROM b WHERE day(trading_date) <= 20 AND (instrument_id, trading_date) NOT IN (SELECT (instrument_id, trading_date) FROM b2))""")
    + rnd("SELECT instrument_id, provider, count(*) AS bars, min(trading_date) AS first_date, max(trading_date) AS last_date, sum(close) AS closes FROM m GROUP BY ALL", "closes", 4),
    "graph_edges": GRAPH + rnd("SELECT * FROM e", "portfolio_weight"),
    "graph_nodes": GRAPH + """SELECT as_of, etf_node_id AS node_id, max(report_date) AS report_date, max(available_from) AS available_from, max(accession) AS accession, 'ETF' AS node_type, NULL::VARCHAR AS ticker, NULL::VARCHAR AS name, NULL::VARCHAR AS country FROM e GROUP BY ALL
UNION ALL SELECT as_of, security_node_id, NULL, NULL, NULL, 'SECURITY', min(security_ticker), min(security_name), min(country) FROM e GROUP BY as_of, security_node_id""",
    "node_index": GRAPH + "SELECT DISTINCT security_node_id AS node_id, dense_rank() OVER (ORDER BY security_node_id) - 1 AS \"index\" FROM e",
    "overlap_pairs": with_(RAW, FILINGS, EDGES, """
fs AS (SELECT DISTINCT as_of, etf_node_id AS x FROM e),
fx AS (SELECT a.as_of, a.x AS l, b.x AS r FROM fs a JOIN fs b ON a.x < b.x),
un AS (SELECT as_of, l, r, security_node_id AS s FROM fx JOIN e USING (as_of) WHERE etf_node_id IN (l, r) GROUP BY ALL),
al AS (SELECT u.*, a.etf_node_id IS NOT NULL AND b.etf_node_id IS NOT NULL AS shared, coalesce(a.portfolio_weight, 0) AS x, coalesce(b.portfolio_weight, 0) AS y
       FROM un u LEFT JOIN e a ON a.etf_node_id = l AND a.security_node_id = s LEFT JOIN e b ON b.etf_node_id = r AND b.security_node_id = s)""")
    + rnd("""SELECT as_of, l AS left_etf, r AS right_etf, count(*) FILTER (shared) AS shared_holding_count, count(*) FILTER (shared) / count(*) AS jaccard, sum(least(x, y)) AS weighted_overlap,
  min(x) >= 0 AND min(y) >= 0 AS weighted_overlap_is_long_only, sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0) AS cosine_similarity FROM al GROUP BY ALL HAVING count(*) FILTER (shared) >= 1""", "jaccard weighted_overlap cosine_similarity"),
    "crowding": GRAPH + rnd("""SELECT as_of, security_node_id, count(DISTINCT etf_node_id) AS etf_count, sum(portfolio_weight) AS total_reported_weight, avg(portfolio_weight) AS average_holding_weight, max(portfolio_weight) AS maximum_holding_weight,
  min(security_ticker) AS security_ticker, min(security_name) AS security_name, (SELECT count(DISTINCT etf_node_id) FROM e) AS universe_etf_count FROM e GROUP BY as_of, security_node_id""", "total_reported_weight average_holding_weight maximum_holding_weight"),
    "fund_degree": GRAPH + rnd("SELECT as_of, etf_node_id, count(*) AS holding_count, sum(portfolio_weight) AS weight_sum, sum(abs(portfolio_weight)) AS absolute_weighted_degree FROM e GROUP BY ALL", "weight_sum absolute_weighted_degree"),
    "graph_quality": GRAPH + "SELECT as_of, count(*) AS edges, count(*) AS cusip_edges, 0::BIGINT AS isin_edges, 0::BIGINT AS ticker_edges, 0::BIGINT AS name_edges, count(*) FILTER (portfolio_weight < 0) AS negative_edges, count(*) FILTER (missing_weights > 0) AS missing_weight_edges, count(DISTINCT etf_node_id) AS funds, count(DISTINCT security_node_id) AS securities FROM e GROUP BY as_of",
    "hash_split": GRAPH + """SELECT etf_node_id, security_node_id, CASE WHEN k < 7 THEN 'train' WHEN k < 9 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, CAST('0x' || substr(sha256('7:' || etf_node_id || ':' || security_node_id), 1, 2) AS INTEGER) % 10 AS k FROM e)""",
    "shock_resolution": with_(RAW, FILINGS, EDGES, SHOCKS) + rnd("SELECT * FROM sr", "shock"),
    "shock_impacts": with_(RAW, FILINGS, EDGES, SHOCKS, "ef AS (SELECT scenario_id, security_node_id, arg_max(shock, ord) AS shock FROM sr WHERE status = 'resolved' GROUP BY ALL)")
    + rnd("""SELECT scenario_id, etf_node_id, coalesce(sum(portfolio_weight * shock) FILTER (missing_weights = 0), 0) AS direct_shock, coalesce(sum(portfolio_weight) FILTER (missing_weights = 0 AND shock IS NOT NULL), 0) AS covered_weight,
  coalesce(sum(portfolio_weight) FILTER (missing_weights = 0), 0) AS weight_sum, count(*) FILTER (missing_weights > 0 AND shock IS NOT NULL) AS missing_weight_count
FROM (SELECT DISTINCT scenario_id FROM sh) s CROSS JOIN e LEFT JOIN ef USING (scenario_id, security_node_id) GROUP BY ALL""", "direct_shock covered_weight weight_sum"),
    "shock_replay": with_(RAW, FILINGS, EDGES, TICKS) + rnd("SELECT sequence, t.security_node_id, count(e.etf_node_id) AS funds, coalesce(sum(e.portfolio_weight * (sequence % 201 - 100) * 0.0001), 0) AS impact FROM tk t LEFT JOIN e USING (security_node_id) WHERE copy = 0 GROUP BY ALL", "impact"),
    "universe_resolution": """WITH c AS (SELECT upper(n_name) AS ticker, CAST(s_nationkey AS VARCHAR) AS cik, 'S' || CAST(CASE WHEN s_nationkey % 3 = 0 THEN s_suppkey % 2 ELSE 0 END AS VARCHAR) AS series FROM supplier JOIN nation ON s_nationkey = n_nationkey),
n AS (SELECT ticker, count(DISTINCT (cik, series)) AS k, min(cik) AS cik, min(series) AS series FROM c GROUP BY 1)
SELECT upper(n_name) AS ticker, 'R' || CAST(n_regionkey AS VARCHAR) AS category, CASE WHEN k IS NULL THEN 'unresolved' WHEN k = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
  CASE WHEN k = 1 THEN lpad(n.cik, 10, '0') END AS cik, CASE WHEN k = 1 THEN series END AS series_id, CASE WHEN k = 1 THEN 'C1' END AS class_id, CASE WHEN k = 1 THEN 'Fund' END AS fund_name
FROM nation LEFT JOIN n ON n.ticker = upper(n_name) WHERE n_nationkey % 6 <> 5""",
    "ingest_antijoin": with_(RAW, FILINGS) + "SELECT accession, fund_id, filed_at FROM f WHERE day(filed_at) % 2 <> 0",
    "newest_n": with_(RAW, FILINGS) + "SELECT fund_id, accession, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY fund_id ORDER BY report_date DESC, accession DESC) AS nth FROM f) WHERE nth <= 3",
    "weight_gate": with_(RAW) + rnd("SELECT *, CASE WHEN weight_sum IS NULL THEN 'no_weights' WHEN weight_sum < 0 OR weight_sum > 5 THEN 'reject' WHEN weight_sum < 0.5 OR weight_sum > 1.5 THEN 'warn' ELSE 'ok' END AS status FROM (SELECT fund_id, snapshot_date, sum(portfolio_weight) AS weight_sum FROM h GROUP BY ALL)", "weight_sum"),
    "coverage_profile": with_(RAW) + " UNION ALL ".join(f"SELECT 'filled:{c}' AS item, count({c}) AS n FROM h" for c in ("security_id", "security_name", "sector", "market_value", "portfolio_weight")) + " UNION ALL SELECT 'key:cusip', count(*) FROM h",
    "audit_top": with_(RAW) + "SELECT true AS weight_ok, true AS value_ok, count(*) AS n FROM (SELECT 1 FROM h QUALIFY row_number() OVER (PARTITION BY fund_id, snapshot_date ORDER BY portfolio_weight DESC NULLS LAST) <= 10)",
    "cusip_check": """SELECT p_partkey, cusip, (10 - s % 10) % 10 = CAST(cusip[9] AS INTEGER) AS valid FROM (
  SELECT *, list_sum(list_transform(range(1, 9), lambda i: CAST(floor(CAST(cusip[i] AS INTEGER) * (2 - i % 2) / 10) + CAST(cusip[i] AS INTEGER) * (2 - i % 2) % 10 AS INTEGER))) AS s
  FROM (SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS cusip FROM part))""",
    "freshness": """SELECT 'feed' AS provider, CAST(u AS VARCHAR) AS entity_id,
  CASE WHEN u % 11 = 0 THEN 'CHECKING' WHEN u % 7 = 0 THEN 'OFFLINE' WHEN u % 5 = 0 THEN 'ERROR' WHEN u % 13 = 0 THEN 'NO_DATA' WHEN TIMESTAMP '2024-01-31' - t > INTERVAL 6 HOURS THEN 'STALE' ELSE 'CURRENT' END AS status,
  CAST(least(21600, 900 * pow(2, greatest(fails, 1) - 1)) AS BIGINT) AS delay_seconds, fails = 0 OR epoch(TIMESTAMP '2024-01-31' - t) >= least(21600, 900 * pow(2, greatest(fails, 1) - 1)) AS due
FROM (SELECT user_id % 50 AS u, max(ts) AS t, count(*) FILTER (event_type = 'error') % 8 AS fails FROM events GROUP BY 1)""",
    "price_exposure": with_(RAW, FILINGS, EDGES, TICKS, "sr AS (SELECT security_node_id, arg_max(price_ticks, sequence) / arg_min(price_ticks, sequence) - 1 AS r, count(*) AS updates FROM tk WHERE price_ticks > 0 GROUP BY 1)")
    + rnd("SELECT etf_node_id, sum(portfolio_weight * r) AS impact, count(*) AS links, CAST(sum(updates) AS BIGINT) AS updates FROM e JOIN sr USING (security_node_id) GROUP BY 1", "impact"),
    "sequence_accounting": with_(TICKS, "sq AS (SELECT *, coalesce(max(sequence) OVER (ORDER BY arrival, sequence, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS high FROM tk)") + "SELECT type, count(*) AS observations, CAST(sum(greatest(sequence - high - 1, 0)) AS BIGINT) AS gaps, count(*) FILTER (sequence = high) AS duplicates, count(*) FILTER (sequence < high) AS out_of_order FROM sq GROUP BY type",
    "latency_histogram": with_(TICKS, """
v AS (SELECT decoded - sent AS ns FROM tk WHERE decoded >= sent),
x AS (SELECT ns, CAST(CASE WHEN ns < 1024 THEN ns ELSE pow(2, floor(log2(ns))) + (floor((ns - pow(2, floor(log2(ns)))) / pow(2, floor(log2(ns)) - 4)) + 1) * pow(2, floor(log2(ns)) - 4) - 1 END AS BIGINT) AS top, row_number() OVER (ORDER BY ns) AS rk, count(*) OVER () AS total, max(ns) OVER () AS most FROM v)""")
    + "SELECT 'transport' AS stage, CAST(p AS DOUBLE) AS percent, CASE WHEN greatest(1, ceil(total * p / 100)) >= total THEN most ELSE least(top, most) END AS ns, total AS samples FROM x, (VALUES (50.0::DOUBLE), (90.0), (95.0), (99.0), (99.9)) AS q(p) WHERE rk = greatest(1, ceil(total * p / 100))",
    "feed_counters": with_(TICKS) + "SELECT type, count(*) AS messages FROM tk GROUP BY type",
    "neighbours": rnd("""SELECT query_id, id, cosine, CAST(rk AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) AS rk FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS id, coalesce(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 0) AS cosine FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)) WHERE rk <= 5""", "cosine"),
    "neighbours_index": "SELECT count(*) AS queries, 5 * count(*) AS neighbours, true AS enough FROM embeddings WHERE vec_id % 20 = 0",
    "naive_scores": MARKET + rnd("""SELECT instrument_id, count(*) AS n, avg(abs(y - x)) AS mae, sqrt(avg((y - x) * (y - x))) AS rmse, 1 - sum((y - x) * (y - x)) / nullif(sum((y - m) * (y - m)), 0) AS r2
FROM (SELECT instrument_id, forward_realized_vol_20d AS y, realized_vol_20d AS x, avg(forward_realized_vol_20d) OVER (PARTITION BY instrument_id) AS m FROM mf WHERE forward_realized_vol_20d IS NOT NULL AND realized_vol_20d IS NOT NULL) GROUP BY 1""", "mae rmse r2", 7),
    "roc_auc": with_(BARS, FEATURES, BINARY) + rnd("""SELECT instrument_id, (SELECT sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*) FROM bn p JOIN bn n ON p.instrument_id = n.instrument_id AND p.y = 1 AND n.y = 0 WHERE p.instrument_id = b0.instrument_id) AS roc_auc,
  CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives FROM bn b0 GROUP BY 1""", "roc_auc"),
    "average_precision": with_(BARS, FEATURES, BINARY) + rnd("""SELECT instrument_id, sum(CASE WHEN y = 1 THEN hits / rk END) / nullif(sum(y), 0) AS average_precision
FROM (SELECT *, row_number() OVER o AS rk, sum(y) OVER o AS hits FROM bn WINDOW o AS (PARTITION BY instrument_id ORDER BY score DESC, trading_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1""", "average_precision"),
    "classification_scores": with_(BARS, FEATURES, BINARY) + rnd("""SELECT instrument_id, avg(y) AS prevalence, avg((score - y) * (score - y)) AS brier, coalesce(count(*) FILTER (score >= 0.95 AND y = 1) / nullif(count(*) FILTER (score >= 0.95), 0), 0) AS "precision",
  coalesce(count(*) FILTER (score >= 0.95 AND y = 1) / nullif(sum(y), 0), 0) AS recall FROM bn GROUP BY 1""", 'prevalence brier "precision" recall'),
    "tail_counts": RISK + """SELECT *, min(positives) OVER () >= 15 AND count(*) OVER () = 3 AS usable FROM (
  SELECT split, count(*) AS labelled, count(*) FILTER (forward_max_drawdown_20d >= 0.97) AS positives FROM rs WHERE split IN ('train', 'validation', 'test') AND forward_max_drawdown_20d IS NOT NULL GROUP BY split)""",
    "missingness": MARKET + rnd(" UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CAST({c} IS NULL AS INTEGER)) AS missing FROM mf" for c in F_NAMES.split()), "missing"),
    "secret_scan": f"WITH l AS (SELECT doc_id AS id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS nr FROM documents)\n"
    + " UNION ALL ".join(f"SELECT id, CAST(nr AS INTEGER) AS line, '{reason}' AS reason FROM l WHERE regexp_matches(line, {_quoted(p)})" for reason, p in T.RULES)
    + f" UNION ALL SELECT id, CAST(nr AS INTEGER), 'email address' FROM l WHERE len(list_filter(regexp_extract_all(line, {_quoted(T.EMAIL)}), lambda m: NOT regexp_matches(lower(m), {_quoted(T.RESERVED_MAIL)}))) > 0"
    + f" UNION ALL SELECT doc_id, 0, 'large text' FROM documents WHERE length(text) >= {T.LARGE} UNION ALL SELECT doc_id, 0, 'zero byte' FROM documents WHERE contains(text, chr(0))",
    "redact_text": f"WITH c AS (SELECT doc_id, text, {redacted_sql()} AS clean FROM documents) SELECT doc_id, text <> clean AS changed, CAST(length(clean) AS INTEGER) AS chars, CAST(len(regexp_extract_all(clean, '\\[REDACTED')) AS INTEGER) AS marks FROM c",
}

#: Sources: the tables themselves, from which the payloads were rendered.
P2 = "p2 AS (SELECT instrument_id, trading_date, open, high, low, volume, close * (1 + (day(trading_date) % 7 - 3) / 1000.0) AS close FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY trading_date) AS nth FROM b) WHERE nth % 11 <> 0)"
PROVIDERS = "pv AS (SELECT 'one' AS provider, 'raw' AS adjustment_mode, instrument_id, trading_date, close FROM b UNION ALL SELECT 'two', 'raw', instrument_id, trading_date, close FROM p2 WHERE instrument_id LIKE 'O%')"
VENDOR = """vb AS (SELECT ['twelvedata', 'tiingo', 'massive', 'alphavantage', 'yahoo'][CAST(year(trading_date) % 5 + 1 AS INTEGER)] AS provider, *, year(trading_date) AS y FROM b)"""
EPOCH = """
em AS (SELECT * FROM tk WHERE copy = 0),
ep AS (SELECT * FROM em WHERE sequence > coalesce((SELECT max(sequence) FROM em WHERE sequence % 3001 = 3000), -1) AND price_ticks > 0),
er AS (SELECT security_node_id, arg_max(price_ticks, sequence) / arg_min(price_ticks, sequence) - 1 AS r, count(*) AS updates FROM ep GROUP BY 1)"""
EPOCH_SQL = with_(RAW, FILINGS, EDGES, TICKS, EPOCH) + rnd("SELECT etf_node_id, sum(portfolio_weight * r) AS impact, count(*) AS links, CAST(sum(updates) AS BIGINT) AS updates FROM e JOIN er USING (security_node_id) GROUP BY 1", "impact")
_place = lambda n, value: f"CASE p_partkey % {n} WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE {value} END"
_HEX = "CAST('0x' || substr(hx, {}, 15) AS BIGINT)"

ORACLES |= {
    "xml_holdings": """SELECT CAST(l_orderkey AS VARCHAR) AS accession, count(*) AS holdings, count(*) FILTER (l_linenumber <> 7 AND l_partkey <> 0) AS cusips, count(*) FILTER (l_linenumber % 3 <> 2) AS isins,
  max('US' || lpad(CAST(l_partkey AS VARCHAR), 9, '0')) FILTER (l_linenumber % 3 <> 2) AS last_isin, round(sum(l_quantity * 1000), 1) AS quantity, round(sum(l_extendedprice), 2) AS market_value, round(sum(round(l_discount, 4)), 6) AS weight
FROM lineitem GROUP BY l_orderkey""",
    "filing_quarantine": """SELECT reason, count(DISTINCT l_orderkey) AS filings, CAST(sum(CASE WHEN reason = 'sound' THEN 1 ELSE 0 END) AS BIGINT) AS holdings FROM (
  SELECT l_orderkey, CASE WHEN l_orderkey % 64 >= 8 THEN 'sound' ELSE ['empty', 'not XML', 'root', 'submission type', 'no report date', 'report date', 'no records', 'sound'][1 + l_orderkey % 8] END AS reason FROM lineitem) GROUP BY reason""",
    "scrub_json": """SELECT o_orderkey, '{"lines":[{"status":"' || o_orderstatus || '"},{"deep":{"cents":' || CAST(CAST(o_totalprice * 100 AS DECIMAL(20, 0)) AS VARCHAR) || ',"note":"mail [REDACTED_EMAIL]"}}],"order":' || o_orderkey || '}' AS config FROM orders""",
    "keyed_table": """SELECT 'first' AS version, o_orderstatus, count(*) AS orders FROM orders GROUP BY ALL UNION ALL
SELECT 'last', CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END, count(*) FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY ALL""",
    "submission_index": """SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(o_orderkey AS VARCHAR) AS accession, CAST(o_orderdate AS DATE) AS filed_at, CAST(o_orderdate AS DATE) AS report_date, 'primary_doc.xml' AS primary_document
FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 10 <> 0""",
    "primary_documents": "SELECT CAST(p_partkey AS VARCHAR) AS accession, CASE p_partkey % 3 WHEN 0 THEN 'primary_doc.xml' WHEN 1 THEN 'my_primary.xml' ELSE 'a.XML' END AS primary_document FROM part WHERE p_partkey % 7 <> 0",
    "vendor_bars": with_(BARS, VENDOR) + """SELECT provider, instrument_id, trading_date, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, volume,
  CASE WHEN provider = 'tiingo' THEN round(open / 2, 4) END AS adjusted_open, round(close / CASE provider WHEN 'tiingo' THEN 2 WHEN 'yahoo' THEN 4 ELSE 1 END, 4) AS continuity,
  CASE WHEN provider IN ('twelvedata', 'yahoo') THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN provider IN ('twelvedata', 'yahoo') THEN 'XETR' ELSE 'XNYS' END AS exchange
FROM vb WHERE NOT (y BETWEEN 1993 AND 1997 AND instrument_id LIKE 'O%')""",
    "vendor_status": with_(BARS, VENDOR) + """SELECT provider, status, count(*) AS payloads, CAST(sum(CASE WHEN status = 'ok' OR y IN (1996, 1997) THEN n ELSE 0 END) AS BIGINT) AS items FROM (
  SELECT provider, instrument_id, y, count(*) AS n, CASE WHEN instrument_id NOT LIKE 'O%' THEN 'ok' WHEN y IN (1993, 1995, 1996) THEN 'rate_limit' WHEN y = 1994 THEN 'error' WHEN y = 1997 THEN 'error' ELSE 'ok' END AS status
  FROM vb GROUP BY ALL) GROUP BY ALL""",
    "fund_catalogue": "SELECT DISTINCT upper(s_name) AS ticker, lpad(CAST(s_nationkey AS VARCHAR), 10, '0') AS cik, 'S' || s_suppkey % 5 AS series_id, 'C1' AS class_id FROM supplier WHERE s_suppkey % 9 <> 0",
    "fixture_snapshots": "SELECT 'F' || l_suppkey AS fund_id, '2024-03-31' AS snapshot_date, CASE WHEN l_linenumber = 1 THEN 'EUR' ELSE 'USD' END AS currency, count(*) AS holdings, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL",
    "snapshot_store": with_(RAW) + "SELECT fund_id, count(*) AS holdings, count(DISTINCT snapshot_date) AS snapshots, round(sum(portfolio_weight * CASE WHEN fund_id = (SELECT 'F' || lpad('3', CASE WHEN greatest(20, count(*) // 5) <= 100 THEN 2 ELSE 9 END, '0') FROM supplier) THEN 2 ELSE 1 END), 6) AS weight FROM h GROUP BY fund_id",
    "snapshot_read": with_(RAW) + "SELECT security_id, snapshot_date, round(portfolio_weight, 8) AS portfolio_weight FROM h WHERE fund_id = (SELECT 'F' || lpad('7', CASE WHEN greatest(20, count(*) // 5) <= 100 THEN 2 ELSE 9 END, '0') FROM supplier) AND snapshot_date = (SELECT max(snapshot_date) FROM h WHERE fund_id = (SELECT 'F' || lpad('7', CASE WHEN greatest(20, count(*) // 5) <= 100 THEN 2 ELSE 9 END, '0') FROM supplier))",
    "graph_files": with_(RAW, FILINGS, EDGES, SHOCKS) + """SELECT etf_node_id, count(*) AS edges, count(k.key) AS shocked, round(sum(portfolio_weight), 6) AS weight, min(security_ticker) AS first_ticker
FROM e LEFT JOIN (SELECT DISTINCT key FROM sh WHERE scenario_id = 'scenario-1') k ON k.key = security_node_id GROUP BY etf_node_id""",
    "impact_file": with_(RAW, FILINGS, EDGES, SHOCKS, "ef AS (SELECT scenario_id, security_node_id, arg_max(shock, ord) AS shock FROM sr WHERE status = 'resolved' GROUP BY ALL)")
    + """SELECT scenario_id, count(DISTINCT etf_node_id) AS funds, round(sum(portfolio_weight * shock) FILTER (missing_weights = 0), 6) AS direct_shock, round(sum(portfolio_weight) FILTER (missing_weights = 0), 6) AS covered_weight
FROM e JOIN ef USING (security_node_id) GROUP BY scenario_id""",
    "scenario_file": with_(RAW, FILINGS, EDGES, SHOCKS) + "SELECT 'from-file' AS scenario_id, row_number() OVER (ORDER BY key) - 1 AS ord, key, CAST(round(shock, 6) AS DOUBLE) AS shock FROM sh WHERE scenario_id = 'scenario-2' AND ord < 5000",
    "safe_names": r"""SELECT o_orderkey, nullif(regexp_replace(regexp_replace(CASE WHEN o_orderkey % 11 = 0 THEN '../' ELSE '..' || o_orderpriority || '/' || o_orderstatus || ' é' || o_custkey END, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[.]{2,}', '', 'g'), '') AS folder FROM orders""",
    "tuning_splits": RISK + "SELECT split, count(*) AS row_count FROM rs WHERE split <> 'test' GROUP BY split",
    "vector_table": "SELECT CAST(vec_id AS VARCHAR) AS node_id, CAST(len(embedding) AS INTEGER) AS width, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings",
    "published_graph": GRAPH + """SELECT 'edges' AS name, count(*) AS in_manifest, count(*) AS row_count FROM e
UNION ALL SELECT 'nodes', count(DISTINCT etf_node_id) + count(DISTINCT security_node_id), count(DISTINCT etf_node_id) + count(DISTINCT security_node_id) FROM e""",
    "whole_graph": GRAPH + f"""SELECT name, n AS in_manifest, n AS row_count FROM (
  SELECT 'edges' AS name, count(*) AS n FROM e UNION ALL SELECT 'nodes', count(DISTINCT etf_node_id) + count(DISTINCT security_node_id) FROM e UNION ALL SELECT 'degree', count(DISTINCT etf_node_id) FROM e
  UNION ALL SELECT 'crowding', count(DISTINCT security_node_id) FROM e UNION ALL SELECT 'manifest', 1
  UNION ALL SELECT 'overlap', count(*) FROM (SELECT DISTINCT l.etf_node_id, r.etf_node_id AS other FROM e l JOIN e r ON l.security_node_id = r.security_node_id AND l.etf_node_id < r.etf_node_id))""",
    "series_meta": with_(BARS, P2, PROVIDERS) + "SELECT provider, instrument_id, adjustment_mode, min(trading_date) AS first_date, max(trading_date) AS last_date, count(*) AS bars FROM pv GROUP BY ALL",
    "authoritative_closes": with_(BARS, P2, PROVIDERS) + "SELECT instrument_id, trading_date, round(close, 2) AS close, provider, adjustment_mode FROM pv WHERE provider = 'two'",
    "bar_gate": with_(BARS, P2, PROVIDERS) + """SELECT provider, instrument_id, adjustment_mode, count(*) AS bars, count(*) - count(DISTINCT trading_date) AS repeated, count(*) FILTER (trading_date < before) AS out_of_order
FROM (SELECT *, lag(trading_date) OVER (PARTITION BY provider, instrument_id, adjustment_mode ORDER BY day(trading_date), trading_date) AS before FROM pv) GROUP BY ALL""",
    "provenance_gate": with_(BARS, P2, PROVIDERS) + "SELECT instrument_id, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers FROM pv GROUP BY 1 HAVING bool_or(provider <> 'one')",
    "filing_validation": """SELECT *, NOT (html OR cik_mismatch OR series_mismatch OR no_holdings) AS clean, sha256((CASE WHEN html THEN ' <!DOCTYPE html>' ELSE '<xml>' END) || accession) AS content_hash
FROM (SELECT CAST(o_orderkey AS VARCHAR) AS accession, o_orderkey % 10 = 0 AS html, o_orderkey % 6 = 0 AS cik_mismatch, o_orderkey % 8 = 0 AS series_mismatch, o_orderkey % 5 = 0 AS no_holdings FROM orders)""",
    "load_range": with_(BARS) + """SELECT instrument_id, count(*) AS bars, min(trading_date) AS first_date, max(trading_date) AS last_date FROM b
LEFT JOIN (SELECT instrument_id, max(trading_date) AS latest FROM b WHERE day(trading_date) < 10 AND instrument_id <> 'P' AND trading_date < DATE '1998-06-01' GROUP BY 1) USING (instrument_id)
WHERE trading_date > coalesce(latest, DATE '0001-01-01') AND trading_date <= DATE '1998-11-01' GROUP BY 1""",
    "ingest_summary": with_(RAW, FILINGS) + """SELECT status, reason, count(*) AS filings FROM (
  SELECT *, CASE WHEN status = 'failed' THEN CASE WHEN day(filed_at) % 7 = 0 THEN 'html' WHEN day(filed_at) % 5 = 0 THEN 'cik_mismatch' ELSE 'no_holdings' END END AS reason FROM (
    SELECT filed_at, CASE WHEN day(filed_at) % 4 = 0 THEN 'skipped' WHEN day(filed_at) % 7 = 0 OR day(filed_at) % 5 = 0 OR day(filed_at) % 6 = 0 THEN 'failed' ELSE 'ingested' END AS status FROM f)) GROUP BY ALL""",
    "filing_fields": "SELECT 'F' || l_suppkey % 20 AS fund_id, count(*) AS names, count(*) AS tickers, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS thousands, round(sum(l_discount / 100), 8) AS weight FROM lineitem GROUP BY 1",
    "filing_context": "SELECT 'C' || o_custkey AS fund_id, CAST(o_orderdate AS DATE) AS snapshot_date, 'filing' AS source, count(*) AS rows, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "universe_manifest": f"""WITH r AS ({ORACLES['universe_resolution']}),
x AS (SELECT status, sha256(concat_ws('|', ticker, status, coalesce(cik, ''), coalesce(series_id, ''), coalesce(class_id, ''))) AS hx FROM r)
SELECT status, count(*) AS n, CASE WHEN (SELECT count(*) FILTER (status <> 'resolved') FROM r) = 0 THEN 'PASSED' ELSE 'INCOMPLETE' END AS gate,
  (SELECT sha256(concat_ws('|', count(*), sum({_HEX.format(1)}))) FROM x) AS fingerprint FROM r GROUP BY status""",
    "enabled_universe": "SELECT upper(n_name) AS ticker, 'R' || n_regionkey AS category, true AS enabled FROM nation WHERE n_nationkey % 6 <> 5",
    "dataset_manifest": RISK + """SELECT count(*) AS row_count, count(holding_count) AS holdings_rows, min(trading_date) AS market_from, max(trading_date) AS market_through, count(*) FILTER (available_from > trading_date AND holding_count IS NOT NULL) AS leaked,
  (SELECT max(publication_date) FROM tl) AS holdings_through, (SELECT count(*) FROM tl) AS filings, CASE WHEN count(*) FILTER (available_from > trading_date AND holding_count IS NOT NULL) = 0 THEN 'PASSED' ELSE 'FAILED' END AS validation_status,
  sha256(concat_ws('|', count(*), concat_ws(',', count(*) FILTER (split = 'train'), count(*) FILTER (split = 'validation'), count(*) FILTER (split = 'test'), count(*) FILTER (split = 'purged_train'), count(*) FILTER (split = 'purged_validation'),
    count(*) FILTER (split = 'warmup'), count(*) FILTER (split = 'no_target')), min(trading_date), max(trading_date), (SELECT count(*) FROM tl), (SELECT sum(CAST('0x' || substr(sha256(accession), 1, 15) AS BIGINT)) FROM tl))) AS fingerprint FROM rs""",
    "node_keys": f"""SELECT p_partkey, coalesce('cusip:' || {_place(5, "'C' || p_partkey")}, 'isin:' || {_place(6, "'I' || p_partkey")}, 'ticker:' || {_place(7, 'upper(p_brand)')}, 'name:' || upper(p_name) || ' ' || p_partkey) AS node FROM part""",
    "completed_sessions": """SELECT event_id, CAST(CASE WHEN hour(l) * 60 + minute(l) < 990 THEN CAST(l AS DATE) - 1 ELSE CAST(l AS DATE) END AS DATE) AS session, round(CASE WHEN event_id % 3 <> 0 THEN value ELSE value + 1 END, 4) AS price
FROM (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS l FROM events)""",
    "epoch_exposure": EPOCH_SQL,
    "stream_exposure": EPOCH_SQL,
    "strict_stream": with_(TICKS) + """, em AS (SELECT *, max(sequence) OVER (PARTITION BY instrument_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM tk WHERE copy = 0 AND sequence % 3001 <> 3000 AND price_ticks > 0)
SELECT CAST(instrument_id AS INTEGER) AS instrument_id, count(*) AS seen, CAST(sum(greatest(0, sequence - coalesce(high, -1) - 1)) AS BIGINT) AS gaps, count(*) FILTER (sequence = high) AS duplicates, count(*) FILTER (sequence < high) AS late,
  greatest(0, count(*) FILTER (sequence > st[1] AND arrival > st[2]) - 1) AS changes
FROM em, (SELECT coalesce(max([sequence, arrival]), [-1, -1]) AS st FROM tk WHERE sequence % 3001 = 3000) GROUP BY 1""",
    "stream_latencies": f"SELECT *, (SELECT sum(messages)::BIGINT FROM ({ORACLES['feed_counters']})) AS messages FROM ({ORACLES['latency_histogram']})",
    "negative_pairs": GRAPH + """, pr AS (SELECT DISTINCT etf_node_id, security_node_id FROM e),
nu AS (SELECT security_node_id, row_number() OVER (ORDER BY security_node_id, etf_node_id) - 1 AS number FROM pr),
dr AS (SELECT fu.etf_node_id, k, security_node_id FROM (SELECT DISTINCT etf_node_id FROM pr) fu, (SELECT unnest(range(640)) AS k) JOIN nu
       ON number = CAST('0x' || substr(sha256('7:' || etf_node_id || ':' || k), 1, 15) AS BIGINT) % (SELECT count(*) FROM pr)),
mn AS (SELECT etf_node_id, security_node_id, min(k) AS k FROM dr GROUP BY ALL)
SELECT etf_node_id, security_node_id FROM mn ANTI JOIN pr USING (etf_node_id, security_node_id) QUALIFY row_number() OVER (PARTITION BY etf_node_id ORDER BY k) <= 10""",
    "replay_summary": with_(RAW, FILINGS, EDGES, TICKS) + "SELECT (SELECT count(*) FROM tk WHERE copy = 0) AS events, round(sum(portfolio_weight * (sequence % 201 - 100) * 0.0001), 6) AS checksum, (SELECT count(DISTINCT sequence) = count(*) AND min(sequence) = 0 AND max(sequence) = count(*) - 1 FROM tk WHERE copy = 0) AS dense FROM tk JOIN e USING (security_node_id) WHERE copy = 0",
    "impact_checksum": f"SELECT round(sum(impact), 6) AS checksum, count(*) AS funds FROM ({ORACLES['price_exposure']})",
    "alias_warnings": "SELECT 'ignored_alias' AS kind, unnest(['report_date', 'holding_ticker']) AS \"column\", 1::BIGINT AS n",
    "upsert_columns": """SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus, count(*) AS orders, round(sum(CASE WHEN o_orderkey % 4 < 2 THEN o_totalprice ELSE 0 END), 2) AS total FROM orders GROUP BY 1""",
    "new_keys": with_(BARS, P2) + "SELECT instrument_id, trading_date FROM p2 WHERE day(trading_date) > 20",
    "newest_needed": with_(RAW, FILINGS) + "SELECT fund_id, accession FROM (SELECT *, row_number() OVER (PARTITION BY fund_id ORDER BY report_date DESC, accession DESC) AS nth FROM f) WHERE nth <= 3 AND day(filed_at) % 2 <> 0",
    "graph_fingerprint": GRAPH + f""", g AS (SELECT as_of, sha256(etf_node_id || '|' || security_node_id || '|' || CAST(CAST(round(portfolio_weight, 8) AS DECIMAL(20, 8)) AS VARCHAR)) AS hx FROM e)
SELECT as_of, sha256(concat_ws('|', count(*), {", ".join(f"sum({_HEX.format(15 * k + 1)})" for k in range(4))})) AS fingerprint FROM g GROUP BY as_of""",
    "mean_scores": RISK + rnd("""SELECT split, count(*) AS n, avg(abs(y - m)) AS mae, sqrt(avg((y - m) * (y - m))) AS rmse, 1 - sum((y - m) * (y - m)) / nullif(sum((y - a) * (y - a)), 0) AS r2
FROM (SELECT split, forward_realized_vol_20d AS y, (SELECT avg(forward_realized_vol_20d) FROM rs WHERE split = 'train') AS m, avg(forward_realized_vol_20d) OVER (PARTITION BY split) AS a FROM rs WHERE split IN ('validation', 'test') AND forward_realized_vol_20d IS NOT NULL) GROUP BY split""", "mae rmse r2", 7),
    "ridge_scores": RIDGE + rnd("""SELECT split, count(*) AS n, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, 1 - sum((y - yhat) * (y - yhat)) / nullif(sum((y - m) * (y - m)), 0) AS r2
FROM (SELECT k.split, y, my + bm * (x - mx) AS yhat, avg(y) OVER (PARTITION BY k.split) AS m FROM k, ft WHERE k.split IN ('validation', 'test') AND y IS NOT NULL) GROUP BY split""", "mae rmse r2", 7),
    "scored_rows": RIDGE + rnd("""SELECT fund_id, trading_date, CASE WHEN holding_count IS NULL THEN 'market' ELSE 'holdings' END AS family,
  CASE WHEN holding_count IS NULL THEN my + bm * (x - mx) ELSE my + bh * (z - mz) END AS yhat FROM k, ft WHERE return_1d IS NOT NULL""", "yhat", 7),
    "target_profile": RISK + rnd("SELECT split, count(*) AS row_count, count(forward_realized_vol_20d) AS labelled, avg(forward_realized_vol_20d) AS mean, min(forward_realized_vol_20d) AS least, max(forward_realized_vol_20d) AS most FROM rs GROUP BY split", "mean least most", 7),
}
ORACLES["graph_manifest"] = f"SELECT q.*, f.fingerprint FROM ({ORACLES['graph_quality']}) q JOIN ({ORACLES['graph_fingerprint']}) f USING (as_of)"
