"""SQL building blocks of the oracles (DuckDB dialect).

These restate the adapters and the common window idioms independently of the
Spark code, so that a query and its oracle share nothing but the definition.
"""

from __future__ import annotations

NATIONS = """
nations AS (
  SELECT n_nationkey, n_name AS symbol, r_name AS sector
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

BARS = (
    NATIONS
    + """,
bars AS MATERIALIZED (
  SELECT symbol, any_value(sector) AS sector, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ts,
    min(struct_pack(o := l_orderkey, n := l_linenumber, p := l_extendedprice / l_quantity)).p AS open,
    max(l_extendedprice / l_quantity) AS high,
    min(l_extendedprice / l_quantity) AS low,
    max(struct_pack(o := l_orderkey, n := l_linenumber, p := l_extendedprice / l_quantity)).p AS close,
    sum(l_quantity) AS volume,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nations ON s_nationkey = n_nationkey
  GROUP BY symbol, CAST(l_shipdate AS DATE)),
cal AS MATERIALIZED (
  SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM bars)),
syms AS MATERIALIZED (
  SELECT DISTINCT symbol, sector FROM supplier JOIN nations ON s_nationkey = n_nationkey)"""
)

HEDGES = """
hedges AS (SELECT * FROM (SELECT symbol, lead(symbol) OVER (PARTITION BY sector ORDER BY symbol) AS hedge FROM syms) WHERE hedge IS NOT NULL)"""

PANEL = (
    BARS
    + """,
grid AS (SELECT symbol, sector, ts, pos FROM syms CROSS JOIN cal),
dense AS MATERIALIZED (
  SELECT g.symbol, g.sector, g.ts, g.pos, b.open, b.high, b.low, b.close, b.volume, b.value
  FROM grid g LEFT JOIN bars b ON g.symbol = b.symbol AND g.ts = b.ts),
panel0 AS (
  SELECT symbol, sector, ts, pos, volume, value,
    CASE WHEN pos >= 62 THEN
      CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS DOUBLE)
        / nullif(CAST(sum(CAST(volume AS BIGINT)) OVER w AS DOUBLE) * 100, 0) END AS close,
    coalesce((high - low) / nullif(high + low, 0), 0) AS rng,
    count(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS traded
  FROM dense
  WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
panel1 AS (
  SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS open FROM panel0),
panel AS MATERIALIZED (
  SELECT symbol, sector, ts, pos, volume, value, open, close, close AS tr,
    close / nullif(open, 0) - 1 AS ret,
    CASE WHEN open IS NULL THEN close ELSE greatest(open, close) END * (1 + 0.01::DOUBLE * rng) AS high,
    CASE WHEN open IS NULL THEN close ELSE least(open, close) END * (1 - 0.01::DOUBLE * rng) AS low,
    traded >= 8 AND close IS NOT NULL AS in_universe
  FROM panel1)"""
)

TICKS = """
ticks AS (SELECT event_type AS symbol, ts, event_id, value AS price FROM events)"""

EVENTS = """,
cev AS (
  SELECT symbol, sector, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS event_date,
    o_totalprice AS magnitude, o_orderstatus AS status, o_orderkey AS event_id, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nations ON c_nationkey = n_nationkey)"""


MEMBERS = """
qv AS (
  SELECT symbol, date_trunc('quarter', ts) AS q, sum(CAST(round(value * 100) AS BIGINT)) AS v, max(ts) AS ts
  FROM bars GROUP BY 1, 2),
membership AS (
  SELECT date, symbol FROM (
    SELECT symbol, max(ts) OVER (PARTITION BY q) AS date,
      row_number() OVER (PARTITION BY q ORDER BY v DESC, symbol) AS rk FROM qv) WHERE rk <= 15)"""

DIVS = """
divs AS (SELECT symbol, event_date AS ex_date, magnitude / 1e6 AS value FROM cev)"""

SPLITS = """
splits AS (
  SELECT symbol, CAST(max(event_date) AS DATE) - CAST(min(event_id) % 900 + 200 AS INTEGER) AS ex_date,
    CAST(2 + min(event_id) % 2 AS DOUBLE) AS value FROM cev GROUP BY symbol)"""

BASIS = """
basis0 AS (
  SELECT *, CASE WHEN volume IS NOT NULL THEN
    (close / nullif(lag(close, 21) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1) * (365.0::DOUBLE / 30) END AS b0
  FROM panel),
basis AS (
  SELECT *, last_value(b0 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts
    ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS basis FROM basis0)"""

CURVE = """
curve0 AS (
  SELECT ts, sector, sum(CAST(round(value * 100) AS BIGINT)) AS c, sum(CAST(volume AS BIGINT)) AS v
  FROM bars GROUP BY 1, 2),
curve1 AS (
  SELECT ts, CAST(sum(c) OVER w AS DOUBLE) / nullif(CAST(sum(v) OVER w AS DOUBLE) * 100, 0) / 100 AS settle,
    dense_rank() OVER (PARTITION BY ts ORDER BY sector) AS slot
  FROM curve0 WINDOW w AS (PARTITION BY sector ORDER BY ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
curve AS (
  SELECT ts, CAST(date_trunc('month', ts) + to_months(CAST(slot - 1 AS INTEGER)) AS DATE) + 14 AS expiry, settle
  FROM curve1)"""

SURFACE = """
surface0 AS (
  SELECT ts, symbol, close AS strike, unnest([1, 2]) AS m,
    0.05::DOUBLE + (high - low) / nullif(high + low, 0) * 0.4::DOUBLE AS iv0 FROM bars),
surface1 AS (
  SELECT ts, symbol, strike, iv0, CAST(date_trunc('month', ts) + to_months(m) AS DATE) + 14 AS expiry FROM surface0),
surface AS (
  SELECT *, CASE WHEN month(expiry) % 2 = 0 THEN iv0 ELSE iv0 * 1.1::DOUBLE END AS iv FROM surface1)"""

# The book most portfolio queries run on: 252-21 momentum, monthly, top and
# bottom fifth, dollar neutral.
BOOK_SRC = """
book_src AS (
  SELECT *, lag(tr, 21) OVER (PARTITION BY symbol ORDER BY ts)
    / nullif(lag(tr, 252) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS signal FROM panel)"""


def book() -> str:
    """``book``: the panel with the sample weights ``w``."""
    return (
        rebalance()
        + ","
        + BOOK_SRC
        + ","
        + xs_weights("bw", "book_src", 0.2, 0.2, False)
        + """,
book AS (SELECT p.*, b.w FROM panel p JOIN bw b ON p.symbol = b.symbol AND p.ts = b.ts)"""
    )


def accounts(
    src: str = "book",
    lag: int = 1,
    c: tuple = (4.0, 0.6, 3.0, 10.0, 0.5, 300.0),
    nav: float = 1.0,
    prefix: str = "",
) -> str:
    """``held``, ``positions`` and ``daily`` of a weight table."""
    com, fee, spr, coef, ex, bor = c
    p = prefix
    held = f"coalesce(lag(m, {lag}) OVER (PARTITION BY symbol ORDER BY ts), 0)" if lag else "m"
    return f"""
{p}held0 AS (SELECT *, CASE WHEN in_universe THEN coalesce(w, 0) ELSE 0 END AS m,
    {roll("avg", "value", 20, 6, 1)} AS adv FROM {src}),
{p}held1 AS (SELECT symbol, sector, ts, pos, close, adv, coalesce(ret, 0) AS r, {held} AS w FROM {p}held0),
{p}held AS (SELECT *, w - coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY ts), 0) AS dw FROM {p}held1),
{p}g AS (SELECT ts, sum(w * r) AS g FROM {p}held GROUP BY ts),
{p}nav AS (SELECT ts, {nav} * coalesce(product(1 + g) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS nav_prev FROM {p}g),
{p}positions AS (
  SELECT h.*, nav_prev,
    CASE WHEN abs(dw) * nav_prev > 0 THEN {com} + {fee} ELSE 0 END AS commission_bps,
    CASE WHEN abs(dw) * nav_prev > 0 THEN {spr} ELSE 0 END AS spread_bps,
    CASE WHEN abs(dw) * nav_prev > 0 AND adv > 0 THEN {coef} * pow(abs(dw) * nav_prev / adv, {ex}) ELSE 0 END AS impact_bps,
    CASE WHEN w < 0 THEN {bor} / 252.0::DOUBLE ELSE 0 END AS borrow_bps
  FROM {p}held h JOIN {p}nav n ON h.ts = n.ts),
{p}daily0 AS (
  SELECT ts, pos, sum(w * r) AS gross, sum(abs(dw) * commission_bps / 1e4) AS commission,
    sum(abs(dw) * spread_bps / 1e4) AS spread, sum(abs(dw) * impact_bps / 1e4) AS impact,
    sum(abs(w) * borrow_bps / 1e4) AS borrow FROM {p}positions GROUP BY ts, pos),
{p}daily1 AS (SELECT *, gross - commission - spread - impact - borrow AS net FROM {p}daily0),
{p}daily AS (SELECT *, {nav} * product(1 + net) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM {p}daily1)"""


SHARPE = (
    "CASE WHEN count({x}) >= 3 AND stddev_samp({x}) > 0 THEN avg({x}) * 252 / (stddev_samp({x}) * sqrt(252)) END"
)


def sharpe(x: str) -> str:
    return SHARPE.format(x=x)


def ewm(x: str, decay: str, mp: int, keys: str = "symbol") -> str:
    w = over(None, 0, keys, "pos")
    k = f"pow({decay}, -CAST(pos AS DOUBLE))"
    return (
        f"CASE WHEN count({x}) {w} >= {mp} THEN sum(({x}) * {k}) {w}"
        f" / nullif(sum(CASE WHEN ({x}) IS NOT NULL THEN {k} END) {w}, 0) END"
    )


def with_(base: str, *more: str) -> str:
    """``WITH`` prefix from a base and further ``name AS (...)`` parts."""
    parts = [base.strip().rstrip(",")] + [m.strip().strip(",") for m in more if m.strip()]
    return "WITH RECURSIVE " + ",\n".join(parts)


def rnd(x: str, dp: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE), {dp}) + 0.0)"


def over(n: int | None = None, lag: int = 0, keys: str = "symbol", order: str = "ts") -> str:
    """Trailing frame of ``n`` rows (None = cumulative) ending ``lag`` rows back."""
    start = "UNBOUNDED PRECEDING" if n is None else f"{n - 1 + lag} PRECEDING"
    end = "CURRENT ROW" if lag == 0 else f"{lag} PRECEDING"
    part = f"PARTITION BY {keys} " if keys else ""
    return f"OVER ({part}ORDER BY {order} ROWS BETWEEN {start} AND {end})"


def roll(fn: str, x: str, n: int, mp: int | None = None, lag: int = 0, keys: str = "symbol") -> str:
    w = over(n, lag, keys)
    return f"CASE WHEN count({x}) {w} >= {n if mp is None else mp} THEN {fn}({x}) {w} END"


def shift(x: str, k: int = 1, keys: str = "symbol", order: str = "ts") -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {keys} ORDER BY {order})"


def pct(x: str, n: int = 1, keys: str = "symbol") -> str:
    return f"({x} / nullif({shift(x, n, keys)}, 0) - 1)"


def ffill(x: str, limit: int | None = None, keys: str = "symbol") -> str:
    w = over(None if limit is None else limit + 1, 0, keys)
    return f"last_value({x} IGNORE NULLS) {w}"


def clip(x: str, lo: float | str, hi: float | str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END"


def period(ts: str, freq: str) -> str:
    unit = {"W": "week", "ME": "month", "QE": "quarter"}[freq]
    return f"date_trunc('{unit}', CAST({ts} AS DATE))"


def next_bday(d: str) -> str:
    return (
        f"(CAST({d} AS DATE) + CASE isodow(CAST({d} AS DATE)) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)"
    )


def rebalance(name: str = "rebal", freq: str = "ME", cal: str = "cal") -> str:
    """CTE of rebalance dates, trailing incomplete period dropped."""
    return f"""
{name} AS (
  SELECT ts FROM (
    SELECT max(ts) AS ts, {period('ts', freq)} AS p FROM {cal} GROUP BY 2)
  WHERE NOT (ts = (SELECT max(ts) FROM {cal})
    AND {period(next_bday('ts'), freq)} = p))"""


def xs_weights(
    name: str,
    src: str,
    top: float,
    bottom: float,
    long_only: bool,
    sector_neutral: bool = False,
    weighting: str = "equal",
    min_names: int = 5,
    gross: float = 1.0,
    rebal: str = "rebal",
) -> str:
    """CTEs turning ``src(symbol, sector, ts, in_universe, signal[, vol])`` into
    held fractile weights ``name(symbol, ts, w)``."""
    pool_key = "ts, sector" if sector_neutral else "ts"
    valid = "signal IS NOT NULL AND in_universe"
    if weighting == "inverse_vol":
        valid += " AND vol > 0"
    raw = {"equal": "1.0::DOUBLE", "inverse_vol": "1.0 / vol", "signal": "greatest(least(abs(coalesce(z, 0)), 3), 1e-6)"}[
        weighting
    ]
    nbot = "0" if long_only else f"greatest(1, round_even(n * {bottom}, 0))"
    budget = f"CASE WHEN bool_or(is_short) OVER (PARTITION BY ts) THEN {gross} / 2 ELSE {gross} END"
    return f"""
{name}_pool AS (
  SELECT s.*, count(*) OVER (PARTITION BY {pool_key}) AS n,
    row_number() OVER (PARTITION BY {pool_key} ORDER BY signal DESC, symbol) AS rk
    {", (signal - avg(signal) OVER (PARTITION BY ts)) / nullif(stddev_pop(signal) OVER (PARTITION BY ts), 0) AS z" if weighting == "signal" else ""}
  FROM {src} s WHERE ts IN (SELECT ts FROM {rebal}) AND {valid}),
{name}_cut AS (
  SELECT *, least(n, greatest(1, round_even(n * {top}, 0))) AS nt, {nbot} AS nb FROM {name}_pool
  WHERE n >= {min_names}),
{name}_leg AS (
  SELECT *, rk <= nt AS is_long, rk > nt AND rk > n - least(nb, greatest(0, n - nt)) AS is_short, {raw} AS raw
  FROM {name}_cut),
{name}_sel AS (
  SELECT symbol, ts, CASE WHEN is_short THEN -1 ELSE 1 END * raw
      / sum(raw) OVER (PARTITION BY ts, is_short)
      * CASE WHEN is_short THEN {gross} / 2 ELSE {budget} END AS w
  FROM (SELECT *, {budget} AS b FROM {name}_leg) WHERE is_long OR is_short),
{name} AS (
  SELECT symbol, ts, CASE WHEN in_universe THEN coalesce(held, 0) ELSE 0 END AS w FROM (
    SELECT s.symbol, s.ts, s.in_universe,
      last_value(CASE WHEN s.ts IN (SELECT ts FROM {rebal}) THEN coalesce(e.w, 0) END IGNORE NULLS)
        {over(None, 0, 's.symbol', 's.ts')} AS held
    FROM {src} s LEFT JOIN {name}_sel e ON s.symbol = e.symbol AND s.ts = e.ts))"""
