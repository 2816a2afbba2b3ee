"""The shared views as common table expressions, put together by name."""

from __future__ import annotations

import re

from panelforge.functions.mathx import norm_cdf_sql
from panelforge.plans.views import COSTS, DAYS, LOOKBACK, MONEYNESS, RATE, REBALANCE, SKIP, VOL

T = "PARTITION BY ticker ORDER BY date"


def window(n: int, by: str = "ticker") -> str:
    return f"(PARTITION BY {by} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rolling(fn: str, x: str, n: int, by: str = "ticker", least: int | None = None) -> str:
    return f"(CASE WHEN count({x}) OVER {window(n, by)} >= {n if least is None else least} THEN {fn}({x}) OVER {window(n, by)} END)"


def expanding(fn: str, x: str, by: str = "ticker", least: int = 1) -> str:
    w = f"(PARTITION BY {by} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) OVER {w} >= {least} THEN {fn}({x}) OVER {w} END)"


def _gross(inner: str) -> str:
    return f"SELECT date, ticker, coalesce(w * least(1.0, 1.0 / nullif(sum(abs(w)) OVER (PARTITION BY date), 0)), 0) AS w FROM ({inner})"


def trade_cost(dw: str, capital: str) -> str:
    c = COSTS
    part = f"(CASE WHEN adv > 0 THEN (CASE WHEN close > 0 THEN abs({dw}) * {capital} / close ELSE 0 END) / adv ELSE 0 END)"
    return f"(CASE WHEN abs({dw}) > 0 THEN abs({dw}) * ({c.half_spread_bps} / 1e4) + abs({dw}) * ({c.impact_eta} * (CASE WHEN sigma > 0 THEN sigma ELSE {c.default_vol} END) * sqrt(greatest(0, {part}))) END)"


def bars(grain: str) -> str:
    return f"""SELECT p_brand AS ticker, CAST(date_trunc('{grain}', l_shipdate) AS DATE) AS date,
  100 * (1 + avg(l_discount) - avg(l_tax)) AS close, 100 * (1 + min(l_discount) - max(l_tax)) AS open, CAST(sum(l_quantity) AS DOUBLE) AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""


CTE = {
    "bars": bars("week"),
    "filled": """SELECT d.date, n.ticker,
  last_value(b.close IGNORE NULLS) OVER (PARTITION BY n.ticker ORDER BY d.date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS close,
  last_value(b.open IGNORE NULLS) OVER (PARTITION BY n.ticker ORDER BY d.date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS open,
  last_value(b.volume IGNORE NULLS) OVER (PARTITION BY n.ticker ORDER BY d.date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS volume
FROM (SELECT DISTINCT date FROM bars) d CROSS JOIN (SELECT DISTINCT ticker FROM bars) n LEFT JOIN bars b ON b.date = d.date AND b.ticker = n.ticker""",
    "panel": "SELECT * FROM filled WHERE date IN (SELECT date FROM filled WHERE close IS NOT NULL)",
    "rets": f"SELECT *, close / lag(close) OVER ({T}) - 1 AS r, row_number() OVER ({T}) - 1 AS pos FROM panel",
    "formed": f"SELECT *, lag(close, {SKIP}) OVER ({T}) / lag(close, {LOOKBACK}) OVER ({T}) - 1 AS mom FROM rets",
    "ranked": """SELECT *, count(mom) OVER (PARTITION BY date) AS n,
  row_number() OVER (PARTITION BY date ORDER BY mom DESC NULLS LAST, ticker) AS up, row_number() OVER (PARTITION BY date ORDER BY mom ASC NULLS LAST, ticker) AS down FROM formed""",
    "w_mom": f"""SELECT date, ticker, coalesce(last_value(w IGNORE NULLS) OVER ({T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS w FROM (
  SELECT date, ticker, CASE WHEN pos >= {LOOKBACK} AND (pos - {LOOKBACK}) % {REBALANCE} = 0 AND n >= 5 THEN
    CASE WHEN mom IS NOT NULL AND down <= greatest(1, round_even(n * 0.2, 0)) THEN -0.5 / greatest(1, round_even(n * 0.2, 0))
         WHEN mom IS NOT NULL AND up <= greatest(1, round_even(n * 0.2, 0)) THEN 0.5 / greatest(1, round_even(n * 0.2, 0)) ELSE 0.0 END END AS w FROM ranked)""",
    "w_tsm": _gross(f"SELECT date, ticker, CASE WHEN raw IS NOT NULL THEN greatest(-0.1, least(0.1, raw)) END AS w FROM (SELECT date, ticker, sign(mom) * CASE WHEN v IS NOT NULL THEN least(0.2, 0.004 / nullif(v, 0)) END AS raw FROM (SELECT *, {rolling('stddev_samp', 'r', VOL, least=VOL // 2)} AS v FROM formed))"),
    "w_rev": _gross(f"SELECT date, ticker, CASE WHEN z IS NOT NULL THEN greatest(-0.1, least(0.1, -z)) END AS w FROM (SELECT date, ticker, (close - {rolling('avg', 'close', VOL)}) / nullif({rolling('stddev_samp', 'close', VOL)}, 0) AS z FROM rets)"),
    "weights": "SELECT 'mom' AS book, * FROM w_mom UNION ALL SELECT 'rev', * FROM w_rev UNION ALL SELECT 'tsm', * FROM w_tsm",
    "liq": f"""SELECT date, ticker, close, open, volume, r, lag(a) OVER ({T}) AS adv, lag(s) OVER ({T}) AS sigma FROM (
  SELECT *, coalesce({rolling('avg', 'volume', COSTS.adv_lookback, least=5)}, {expanding('avg', 'volume')}) AS a,
    coalesce({rolling('stddev_samp', 'r', COSTS.vol_lookback, least=5)}, {expanding('stddev_samp', 'r', least=2)}) AS s FROM rets)""",
    "aimed": """SELECT w.book, w.date, w.ticker, l.close, l.open, l.volume, l.r, l.adv, l.sigma,
  coalesce(lag(w.w) OVER (PARTITION BY w.book, w.ticker ORDER BY w.date), 0) AS target FROM weights w JOIN liq l ON l.date = w.date AND l.ticker = w.ticker""",
    "traded": "SELECT *, target - coalesce(lag(target) OVER (PARTITION BY book, ticker ORDER BY date), 0) AS trade FROM aimed",
    "daily": """SELECT book, date, coalesce(sum(target * r), 0) AS ret, sum(abs(trade)) AS turnover FROM traded GROUP BY 1, 2""",
    "costed": f"""SELECT book, date, coalesce(sum(target * r), 0) AS gross, coalesce(sum({trade_cost('trade', repr(COSTS.capital))}), 0) AS cost, sum(abs(trade)) AS turnover FROM traded GROUP BY 1, 2""",
    "proxy": "SELECT date, avg(r) AS r FROM rets GROUP BY 1",
    "grown": "SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY book ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS equity FROM daily",
    "under": "SELECT *, equity / max(equity) OVER (PARTITION BY book ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM grown",
    "falls": """SELECT book, min(dd) AS max_drawdown, max(n) AS max_dd_duration FROM (
  SELECT book, g, min(dd) AS dd, sum(u) AS n FROM (
    SELECT book, dd, u, sum(1 - u) OVER (PARTITION BY book ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (SELECT *, CASE WHEN dd < -1e-12 THEN 1 ELSE 0 END AS u FROM under)) GROUP BY 1, 2) GROUP BY 1""",
    "moments": """SELECT book, n, CASE WHEN n >= 3 AND s > 0 THEN m / s END AS sr,
  CASE WHEN n >= 3 AND s > 0 THEN m3 / pow(m2, 1.5) * sqrt(n * (n - 1.0)) / (n - 2) ELSE 0 END AS skew,
  CASE WHEN n >= 3 AND s > 0 THEN (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * (m4 / (m2 * m2) - 3) + 6) + 3 ELSE 3 END AS kurtosis
  FROM (SELECT d.book, count(*) AS n, any_value(a.m) AS m, any_value(a.s) AS s, avg(pow(ret - a.m, 2)) AS m2, avg(pow(ret - a.m, 3)) AS m3, avg(pow(ret - a.m, 4)) AS m4
    FROM daily d JOIN (SELECT book, avg(ret) AS m, stddev_samp(ret) AS s FROM daily GROUP BY 1) a ON a.book = d.book GROUP BY 1)""",
    "cal": "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM panel)",
    "quotes0": f"""SELECT *, CASE WHEN defect = 4 AND days = 30 THEN -5.0 ELSE days END / 365.0 AS tte, round(spot * exp(m), 4) AS strike, CAST('1998-01-02' AS DATE) AS as_of, CAST(CAST('1998-01-02' AS DATE) + days AS DATE) AS expiry FROM (
  SELECT p_partkey AS underlying, CAST(p_retailprice AS DOUBLE) AS spot, p_partkey % 10 AS defect, d.days, k.mi, k.m, o.option_type FROM part
  CROSS JOIN (SELECT unnest([{', '.join(map(str, DAYS))}]) AS days) d
  CROSS JOIN (SELECT unnest([{', '.join(str(i) for i in range(len(MONEYNESS)))}]) AS mi, unnest([{', '.join(f'CAST({m} AS DOUBLE)' for m in MONEYNESS)}]) AS m) k
  CROSS JOIN (SELECT unnest(['call', 'put']) AS option_type) o) WHERE NOT (defect = 5 AND days = 365 AND mi > 2)""",
    "quotes1": f"""SELECT *, (0.20 + 0.1 * k * k - 0.05 * k + 0.01 * tte) * CASE WHEN defect = 6 AND mi = 4 THEN 1.3 WHEN defect = 7 AND days = 365 THEN 0.5 ELSE 1.0 END AS true_vol FROM (SELECT *, ln(strike / spot) - {RATE} * tte AS k FROM quotes0)""",
    "quotes2": f"""SELECT *, CASE WHEN tte <= 0 THEN greatest(0, CASE WHEN option_type = 'call' THEN spot - strike ELSE strike - spot END)
  WHEN option_type = 'call' THEN spot * {norm_cdf_sql('d1')} - strike * exp(-{RATE} * tte) * {norm_cdf_sql('d2')} ELSE strike * exp(-{RATE} * tte) * {norm_cdf_sql('(-d2)')} - spot * {norm_cdf_sql('(-d1)')} END AS fair
  FROM (SELECT *, d1 - true_vol * sqrt(greatest(tte, 0)) AS d2 FROM (SELECT *, (ln(spot / strike) + ({RATE} + true_vol * true_vol / 2) * tte) / nullif(true_vol * sqrt(greatest(tte, 0)), 0) AS d1 FROM quotes1))""",
    "quotes": """SELECT underlying, as_of, spot, expiry, tte, strike, option_type, true_vol, mi, fair,
  CASE WHEN defect = 1 AND mi = 0 THEN 0 WHEN defect = 2 AND mi = 0 THEN fair + 1 WHEN defect = 3 AND mi = 0 THEN fair * 0.4 ELSE fair - (0.02 + 0.01 * fair) END AS bid,
  CASE WHEN defect = 3 AND mi = 0 THEN fair * 1.6 ELSE fair + (0.02 + 0.01 * fair) END AS ask,
  underlying % 50 + mi AS volume, CASE WHEN mi = 7 THEN NULL ELSE underlying % 7 * 10 END AS open_interest FROM quotes2""",
    "flagged": """SELECT *, (bid + ask) / 2 AS mid, CASE WHEN bid < 0.01 THEN 'zero_or_low_bid' WHEN ask <= bid THEN 'crossed_or_locked' WHEN (ask - bid) / nullif((bid + ask) / 2, 0) > 0.6 THEN 'spread_too_wide'
  WHEN tte <= 0 THEN 'expired' WHEN tte * 365 < 1 THEN 'too_near_expiry' END AS reason FROM quotes""",
    "otm": f"""SELECT *, spot * exp({RATE} * tte) AS forward, ln(strike / (spot * exp({RATE} * tte))) AS log_moneyness FROM flagged WHERE reason IS NULL
  AND CASE WHEN option_type = 'call' THEN strike >= spot * exp({RATE} * tte) ELSE strike < spot * exp({RATE} * tte) END""",
    "points": f"""SELECT underlying, as_of, expiry, tte, strike, option_type, forward, log_moneyness, mid, ask - bid AS spread, true_vol AS implied_vol, true_vol * true_vol * tte AS total_variance,
  spot * {norm_cdf_sql('d1')} - strike * exp(-{RATE} * tte) * {norm_cdf_sql('d2')} AS call_price FROM (
    SELECT *, d1 - true_vol * sqrt(tte) AS d2 FROM (SELECT *, (ln(spot / strike) + ({RATE} + true_vol * true_vol / 2) * tte) / (true_vol * sqrt(tte)) AS d1, count(*) OVER (PARTITION BY underlying, as_of, expiry) AS cnt FROM otm)) WHERE cnt >= 4""",
}



def rounded(columns: dict[str, str], source: str, digits: int = 6) -> str:
    """A select list: kinds are k (as it is), f (rounded double), i (bigint)."""
    out = []
    for c, kind in columns.items():
        if kind == "f":
            out.append(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}")
        elif kind == "i":
            out.append(f"CAST({c} AS BIGINT) AS {c}")
        else:
            out.append(c)
    return f"SELECT {', '.join(out)} FROM ({source})"


def with_(query: str, **own: str) -> str:
    """query with the shared and own expressions that it needs, in order."""
    texts = {**CTE, **own}
    needs = {n: [m for m in texts if m != n and re.search(rf"\b(?:FROM|JOIN)\s+{m}\b", t)] for n, t in texts.items()}
    order: list[str] = []

    def add(n: str) -> None:
        for m in needs[n]:
            if m not in order:
                add(m)
        if n not in order:
            order.append(n)

    for n in texts:
        if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", query):
            add(n)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED (\n{texts[n]}\n)" for n in order) + "\n" if order else "") + query
