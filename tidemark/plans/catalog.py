"""Named queries over the bundled tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.ewm import ewma_vol_series, rsi_series
from tidemark.functions.windows import compounded, every_kth, fill_forward, lag_return, lead_return, rolling_mean, rolling_std, rows_of
from tidemark.operators import coverage, evaluate, fundamental, macro, pit, rag, risk, scoring, technical, text, tiles
from tidemark.lineage import cut
from tidemark.sources.surrogates import fundamentals, headlines, holdings, market_prices, positions, prices, region_prices, sectors, table, vintages
from tidemark.streaming import events as streams

AS_OF = "2000-06-30"
HORIZON = 5

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Shared pieces of the SQL: the surrogate tables.
_BARS = """CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close,
    sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) AS adj_close, CAST(sum(l_quantity) AS BIGINT) AS volume"""
_P = f"prices AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, {_BARS} FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))"
_LOC = "loc AS (SELECT s_suppkey, s_acctbal, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_R = f"{_LOC}, rp AS (SELECT r_name AS symbol, {_BARS} FROM lineitem JOIN loc ON l_suppkey = s_suppkey GROUP BY r_name, CAST(l_shipdate AS DATE))"
_DAYS = "days AS (SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT date FROM rp))"
_RET = f"""{_R}, {_DAYS}, lagged AS (SELECT symbol, rp.date, adj_close AS p, day, lag(adj_close) OVER w AS bp, lag(day) OVER w AS bd FROM rp JOIN days
    ON rp.date = days.date
    WINDOW w AS (PARTITION BY symbol ORDER BY rp.date)),
    rets AS (SELECT symbol, date, CASE WHEN bd = day - 1 THEN ln(p) - ln(bp) END AS log_ret, CASE WHEN bd = day - 1 THEN p / bp - 1 END AS ret FROM
    lagged)"""
_EWMA = """wt0 AS (SELECT date, pow(0.94, row_number() OVER (ORDER BY date DESC) - 1) AS raw FROM full_days), wt AS (SELECT date, raw / (SELECT sum(raw) FROM
    wt0) AS w FROM wt0),
    mu AS (SELECT symbol, sum(w * x) AS mu FROM cs JOIN wt USING (date) GROUP BY symbol), cen AS (SELECT symbol, date, w, x - mu AS x FROM cs JOIN wt
    USING (date) JOIN mu USING (symbol)),
    cov AS (SELECT p.symbol AS a, q.symbol AS b, sum(p.w * p.x * q.x) AS cov FROM cen p JOIN cen q ON p.date = q.date GROUP BY p.symbol, q.symbol)"""
_COMMON = f"""{_RET}, full_days AS (SELECT date FROM rets WHERE log_ret IS NOT NULL GROUP BY date HAVING count(*) = (SELECT count(DISTINCT symbol)
    FROM rets WHERE log_ret IS NOT NULL)),
    cs AS (SELECT symbol, date, log_ret AS x, ret FROM rets WHERE date IN (SELECT date FROM full_days)), {_EWMA}"""
_W = """pos AS (SELECT r_name AS symbol, sum(s_acctbal) AS quantity FROM loc WHERE s_acctbal > 0 GROUP BY r_name),
    wts AS (SELECT symbol, lc * quantity AS mv, lc * quantity / sum(lc * quantity) OVER () AS weight, quantity, lc FROM pos JOIN (SELECT symbol,
    arg_max(close, date) AS lc FROM rp GROUP BY symbol) USING (symbol))"""
_PORT = "port AS (SELECT date, sum(weight * ret) AS ret FROM cs JOIN wts USING (symbol) GROUP BY date)"
_F = """q AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS period_end,
    sum(l_extendedprice * (1 - l_discount)) AS total_revenue, sum(l_extendedprice * (1 - l_discount)) - sum(l_extendedprice * 0.7) AS
    operating_income,
    sum(l_extendedprice * (1 - l_discount)) - sum(l_quantity * p_retailprice * 0.9) AS net_income FROM lineitem JOIN part ON l_partkey = p_partkey
    GROUP BY 1, 2)"""
_G = lambda new, old: f"CASE WHEN {old} > 0 THEN ({new} / {old} - 1) * 100 END"
_RATIOS = f"""{_F}, rat AS (SELECT c.symbol, c.period_end, c.total_revenue, c.net_income, {_G('c.total_revenue', 'y.total_revenue')} AS
    revenue_yoy_pct,
    {_G('c.total_revenue', 'c.pq')} AS revenue_qoq_pct, {_G('c.net_income', 'y.net_income')} AS net_income_yoy_pct, c.net_income /
    nullif(c.total_revenue, 0) * 100 AS net_margin_pct,
    c.operating_income / nullif(c.total_revenue, 0) * 100 AS op_margin_pct, c.net_income / nullif(c.total_revenue, 0) * 100 - y.net_income /
    nullif(y.total_revenue, 0) * 100 AS net_margin_change_pp
    FROM (SELECT *, lag(total_revenue) OVER (PARTITION BY symbol ORDER BY period_end) AS pq FROM q) c
    LEFT JOIN q y ON y.symbol = c.symbol AND year(y.period_end) + 1 = year(c.period_end) AND month(y.period_end) = month(c.period_end))"""
_GB = lambda x: f"CASE WHEN {x} >= 15 THEN 'strong' WHEN {x} >= 5 THEN 'growing' WHEN {x} >= -5 THEN 'flat' WHEN {x} IS NOT NULL THEN 'declining' END"
_IN = lambda words: ", ".join(f"'{w}'" for w in words)
_TOK = lambda t: f"regexp_extract_all(lower(coalesce({t}, '')), '[a-z'']+')"
_CNT = lambda t, words: f"len(list_filter({_TOK(t)}, lambda x: x IN ({_IN(words)})))"
_NEWS = f"""news0 AS (SELECT 'S' || CAST(doc_id % 10 AS VARCHAR) AS symbol, doc_id, split_part(text, chr(10), 1) AS title, source AS publisher,
    CASE WHEN doc_id % 17 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) END AS published, text FROM documents),
    news1 AS (SELECT *, CAST({_CNT('text', text.POSITIVE)} AS DOUBLE) AS p, CAST({_CNT('text', text.NEGATIVE)} AS DOUBLE) AS n FROM news0),
    news AS (SELECT symbol, doc_id, title, publisher, published, text, CASE WHEN p + n = 0 THEN 0.0 ELSE (p - n) / (p + n) END AS polarity FROM
    news1)"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = " ".join(sql.split("\n"))
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, as sums in another order differ in their last digits; negative zero is zero."""
    return df.select(*[(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(x: str, name: str | None = None, places: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {places}) + 0.0 AS {name or x}"


# Scans and point-in-time reads


@query(f"WITH {_P} SELECT symbol, date, {_r('close')}, {_r('adj_close')}, volume FROM prices WHERE date <= DATE '{AS_OF}'")
def price_panel(spark, d):
    return rounded(pit.panel(prices(spark, d), AS_OF))


@query(f"WITH {_P} SELECT symbol, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM prices GROUP BY symbol")
def data_check(spark, d):
    return coverage.data_check(prices(spark, d))


_V = """v AS (SELECT CAST(user_id AS VARCHAR) AS symbol, DATE '2024-01-01' + CAST(length(event_type) % 5 AS INTEGER) AS date, CAST(ts AS DATE) AS
    vintage_date, value AS close, event_id FROM events)"""


@query(f"""WITH {_V}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY vintage_date DESC, event_id DESC) AS rn FROM v WHERE
    vintage_date <= DATE '2024-01-15' AND date <= DATE '2024-01-04')
    SELECT symbol, date, vintage_date, {_r('close')}, event_id FROM k WHERE rn = 1""")
def vintage_asof(spark, d):
    return rounded(pit.known_at(vintages(spark, d), "2024-01-15", "2024-01-04", tie="event_id"))


@query(f"""WITH {_V}, o AS (SELECT symbol, date, arg_max(close, (vintage_date, event_id)) AS close FROM v WHERE vintage_date <= DATE '2024-01-10'
    GROUP BY ALL),
    n AS (SELECT symbol, date, arg_max(close, (vintage_date, event_id)) AS close FROM v WHERE vintage_date <= DATE '2024-01-20' GROUP BY ALL)
    SELECT n.symbol, n.date, {_r('n.close', 'close')} FROM n LEFT JOIN o ON n.symbol = o.symbol AND n.date = o.date
    WHERE o.close IS NULL OR abs(o.close - n.close) > greatest(1e-9 * greatest(abs(o.close), abs(n.close)), 1e-12)""")
def vintage_changes(spark, d):
    v = vintages(spark, d)
    old, new = (pit.known_at(v, day, tie="event_id").select("symbol", "date", "close") for day in ("2024-01-10", "2024-01-20"))
    return rounded(pit.changed_rows(old, new, ["symbol", "date"], ["close"]))


@query(f"WITH {_V} SELECT symbol, date, max(event_id) AS event_id, {_r('arg_max(close, event_id)', 'close')} FROM v GROUP BY symbol, date")
def upsert_latest(spark, d):
    v = vintages(spark, d).select("symbol", "date", "event_id", "close")
    old, new = v.where("event_id % 2 = 0"), v.where("event_id % 2 = 1")
    return rounded(pit.upsert(old, new, ["symbol", "date"], "event_id"))


@query(f"""WITH {_V}, o AS (SELECT DISTINCT symbol, date FROM v WHERE vintage_date <= DATE '2024-01-05') SELECT DISTINCT v.symbol, v.date FROM v
    LEFT JOIN o ON v.symbol = o.symbol AND v.date = o.date WHERE o.symbol IS NULL""")
def append_missing(spark, d):
    v = vintages(spark, d).select("symbol", "date", "vintage_date")
    return pit.append_new(v.where("vintage_date <= date'2024-01-05'"), v, ["symbol", "date"]).select("symbol", "date")


@query(f"""WITH {_P}, {_RATIOS}, f AS (SELECT symbol, period_end + 45 AS available, net_margin_pct FROM rat WHERE net_margin_pct IS NOT NULL)
    SELECT p.symbol, p.date, {_r('f.net_margin_pct', 'net_margin_pct')} FROM prices p ASOF LEFT JOIN f ON p.symbol = f.symbol AND p.date >=
    f.available""")
def fund_asof(spark, d):
    f = fundamental.features(fundamentals(spark, d)).where("feature = 'net_margin'").select("symbol", "available",
        F.col("value").alias("net_margin_pct"))
    return rounded(pit.as_of_join(prices(spark, d).select("symbol", "date"), f, "symbol", "date", "available", "net_margin_pct"))


@query(f"""WITH {_P}, m AS (SELECT symbol, date, adj_close / max(adj_close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS dd FROM prices) SELECT
    symbol, {_r('min(dd) * 100', 'max_drawdown_pct')} FROM m GROUP BY symbol""")
def max_drawdown(spark, d):
    return rounded(pit.drawdown(prices(spark, d)))


@query(f"""WITH {_P}, {_F}, {_NEWS}, pr AS (SELECT symbol, count(*) AS price_rows, min(date) AS price_start, max(date) AS price_end FROM prices GROUP
    BY symbol),
    fu AS (SELECT symbol, count(*) AS quarters, max(period_end) AS latest_quarter FROM q GROUP BY symbol), ne AS (SELECT symbol, count(*) AS news,
    max(published) AS latest_news FROM news GROUP BY symbol),
    ch AS (SELECT symbol, count(DISTINCT publisher) AS doc_sources, count(*) AS doc_chunks, max(published) AS latest_doc_period FROM news GROUP BY
    symbol),
    sy AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier UNION SELECT symbol FROM news)
    SELECT symbol, coalesce(price_rows, 0) AS price_rows, price_start, price_end, coalesce(quarters, 0) AS quarters, latest_quarter, coalesce(news, 0)
    AS news, latest_news,
    coalesce(doc_sources, 0) AS doc_sources, coalesce(doc_chunks, 0) AS doc_chunks, latest_doc_period FROM sy LEFT JOIN pr USING (symbol) LEFT JOIN fu
    USING (symbol) LEFT JOIN ne USING (symbol) LEFT JOIN ch USING (symbol)""")
def coverage_matrix(spark, d):
    n = headlines(spark, d)
    symbols = sectors(spark, d).select("symbol").union(n.select("symbol")).distinct()
    return coverage.coverage_matrix(symbols, prices(spark, d), fundamentals(spark, d), n, n.select("symbol",
        F.col("publisher").alias("source"), F.col("published").alias("period")))


@query(f"""WITH {_F}, {_NEWS}, e AS (SELECT symbol, max(period_end) AS expected FROM q GROUP BY symbol),
    c AS (SELECT CAST(doc_id % 150 AS VARCHAR) AS symbol, CASE WHEN doc_id % 3 <> 0 THEN published END AS period, publisher FROM news),
    g AS (SELECT symbol, count(*) AS chunks, count(DISTINCT publisher) AS docs, max(period) AS latest_period FROM c GROUP BY symbol),
    s AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier)
    SELECT symbol, expected, coalesce(chunks, 0) AS chunks, coalesce(docs, 0) AS docs, latest_period,
    CASE WHEN coalesce(chunks, 0) = 0 THEN 'MISSING' WHEN expected IS NULL THEN 'UNCHECKED' WHEN latest_period IS NULL THEN 'UNTAGGED' WHEN
    latest_period < expected THEN 'STALE' ELSE 'OK' END AS flag
    FROM s LEFT JOIN e USING (symbol) LEFT JOIN g USING (symbol)""")
def transcript_coverage(spark, d):
    n = headlines(spark, d)
    c = n.select((F.col("doc_id") % 150).cast("string").alias("symbol"), F.when(F.col("doc_id") % 3 != 0,
        F.col("published")).alias("period"), F.col("publisher").alias("source"))
    return coverage.transcript_coverage(sectors(spark, d), fundamentals(spark, d), c)


@query(f"""WITH {_NEWS} SELECT symbol, publisher AS source, count(*) AS chunks, max(published) AS period, max(published) AS filing_date FROM news
    GROUP BY symbol, publisher""")
def document_list(spark, d):
    n = headlines(spark, d)
    return coverage.list_documents(n.select("symbol", F.col("publisher").alias("source"), F.col("published").alias("period"),
        F.col("published").alias("filing_date")))


@query(f"""WITH {_NEWS}, g AS (SELECT symbol, publisher AS source, doc_id, published AS period FROM news), c AS (SELECT symbol, publisher AS source,
    max(published) AS filing FROM news WHERE doc_id % 2 = 0 GROUP BY ALL),
    k AS (SELECT g.*, row_number() OVER (PARTITION BY symbol ORDER BY period DESC NULLS LAST, doc_id DESC) AS rn FROM g LEFT JOIN c USING (symbol,
    source) WHERE coalesce(filing, period + 45) <= DATE '2024-12-15')
    SELECT symbol, source, doc_id, period FROM k WHERE rn = 1""")
def latest_guidance(spark, d):
    n = headlines(spark, d)
    filing = n.where("doc_id % 2 = 0").groupBy("symbol", "publisher").agg(F.max("published").alias("filing"))
    known = n.join(filing, ["symbol", "publisher"], "left").where(F.coalesce("filing",
        F.date_add("published", 45)) <= F.lit("2024-12-15").cast("date"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc_nulls_last("published"), F.desc("doc_id")))
    return known.withColumn("rn", rank).where("rn = 1").select("symbol", F.col("publisher").alias("source"), "doc_id",
        F.col("published").alias("period"))


# Technicals

_SMA = lambda n: f"CASE WHEN count(close) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING) = {n} THEN avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING) END"
_SERIES = f"""ser AS (SELECT symbol, date, close, volume, {_SMA(20)} AS sma20, {_SMA(50)} AS sma50, {_SMA(200)} AS sma200, row_number() OVER
    (PARTITION BY symbol ORDER BY date DESC) AS back FROM prices)"""


@query(f"""WITH {_P}, {_SERIES} SELECT symbol, {_r('close', 'last_close')}, {_r('sma20')}, {_r('sma50')}, {_r('sma200')},
    CASE WHEN sma200 IS NOT NULL THEN CASE WHEN abs(close / sma200 - 1) < 0.02 THEN 'sideways' WHEN close > sma200 THEN 'uptrend' ELSE 'downtrend' END
    WHEN sma50 IS NOT NULL THEN CASE WHEN close > sma50 THEN 'uptrend' ELSE 'downtrend' END ELSE '—' END AS trend FROM ser WHERE back = 1 AND (SELECT
    count(*) FROM prices p WHERE p.symbol = ser.symbol) >= 30""")
def sma_dials(spark, d):
    return rounded(technical.technical(prices(spark, d)).select("symbol", "last_close", "sma20", "sma50", "sma200", "trend"))


@query(f"WITH {_P}, {_SERIES} SELECT symbol, date, {_r('close')}, {_r('sma20')}, {_r('sma50')}, {_r('sma200')} FROM ser WHERE back <= 60")
def chart_series(spark, d):
    return rounded(technical.price_series(prices(spark, d), 60))


_EWM = lambda col, alpha, n: f"sum({col} * CASE WHEN i = 1 THEN pow(1 - {alpha}, {n} - 1) ELSE {alpha} * pow(1 - {alpha}, {n} - i) END)"
_DELTA = """dl AS (SELECT symbol, date, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS dx FROM prices),
    di AS (SELECT symbol, greatest(dx, 0) AS g, greatest(-dx, 0) AS l, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, count(*) OVER
    (PARTITION BY symbol) AS n FROM dl WHERE dx IS NOT NULL)"""


@query(f"""WITH {_P}, {_DELTA}, e AS (SELECT symbol, max(n) AS n, {_EWM('g', '1.0/14', 'n')} AS ag, {_EWM('l', '1.0/14', 'n')} AS al FROM di GROUP BY
    symbol)
    SELECT symbol, {_r('CASE WHEN al = 0 THEN CASE WHEN ag > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + ag / al) END', 'rsi_14')} FROM e WHERE n >=
    29""")
def rsi_terminal(spark, d):
    return rounded(technical.technical(prices(spark, d)).select("symbol", "rsi_14"))


@query(f"""WITH RECURSIVE {_P}, o AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, count(*) OVER (PARTITION BY
    symbol) AS n FROM prices),
    m AS (SELECT symbol, i, n, close AS f, close AS s, CAST(0 AS DOUBLE) AS g FROM o WHERE i = 1
    UNION ALL SELECT o.symbol, o.i, o.n, m.f * (11.0/13) + o.close * (2.0/13), m.s * (25.0/27) + o.close * (2.0/27),
    m.g * 0.8 + 0.2 * ((m.f * (11.0/13) + o.close * (2.0/13)) - (m.s * (25.0/27) + o.close * (2.0/27))) FROM m JOIN o ON o.symbol = m.symbol AND o.i =
    m.i + 1)
    SELECT symbol, {_r('f - s', 'macd')}, {_r('f - s - g', 'macd_hist')} FROM m WHERE i = n AND n >= 30""")
def macd_terminal(spark, d):
    return rounded(technical.technical(prices(spark, d)).select("symbol", "macd", "macd_hist"))


@query(f"""WITH {_P}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM prices),
    a AS (SELECT symbol, max(close) FILTER (k = 1) AS lc, max(close) FILTER (k <= 252) AS hi, max(close) FILTER (k = 22) AS b1, max(close) FILTER (k =
    64) AS b3, avg(volume) FILTER (k <= 20) AS v1, avg(volume) FILTER (k > 20 AND k <= 40) AS v2, count(*) AS n FROM b GROUP BY symbol)
    SELECT symbol, {_r('(lc / hi - 1) * 100', 'pct_from_52w_high')}, {_r('(lc / b1 - 1) * 100', 'ret_1m_pct')},
    {_r('(lc / b3 - 1) * 100', 'ret_3m_pct')},
    CASE WHEN n >= 40 THEN CASE WHEN v1 > v2 * 1.05 THEN 'rising' WHEN v1 < v2 * 0.95 THEN 'falling' ELSE 'flat' END END AS volume_trend,
    CASE WHEN lc / hi - 1 >= -0.05 THEN 'at highs' WHEN lc / hi - 1 <= -0.25 THEN 'near lows' ELSE 'mid-range' END AS level FROM a WHERE n >= 30""")
def high_52w_volume(spark, d):
    return rounded(technical.technical(prices(spark, d)).select("symbol", "pct_from_52w_high", "ret_1m_pct", "ret_3m_pct", "volume_trend", "level"))


@query(f"""WITH {_P} SELECT symbol, date, {_r('adj_close / lag(adj_close, 63) OVER w - 1', 'momentum_3m')},
    {_r('lead(adj_close, 5) OVER w / adj_close - 1', 'fwd_5')} FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def fwd_returns(spark, d):
    w, x = rows_of(), F.col("adj_close")
    return rounded(prices(spark, d).select("symbol", "date", lag_return(x, 63, w).alias("momentum_3m"), lead_return(x, 5, w).alias("fwd_5")))


@query(f"""WITH {_P}, r AS (SELECT symbol, date, adj_close, adj_close / lag(adj_close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM prices)
    SELECT symbol, date, {_r('CASE WHEN count(r) OVER w = 63 THEN -stddev_samp(r) OVER w END', 'low_vol')},
    {_r('CASE WHEN count(r) OVER v = 10 THEN product(1 + r) OVER v - 1 END', 'ret_10')} FROM r
    WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING), v AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING)""")
def momentum_low_vol(spark, d):
    w = rows_of()
    r = prices(spark, d).select("symbol", "date", lag_return(F.col("adj_close"), 1, w).alias("r"))
    return rounded(r.select("symbol", "date", (-rolling_std(F.col("r"), 63, w)).alias("low_vol"), compounded(F.col("r"), 10, w).alias("ret_10")))


@query(f"""WITH {_P}, x AS (SELECT symbol, date, CASE WHEN volume % 3 <> 0 THEN close END AS c FROM prices), y AS (SELECT symbol, date, last_value(c
    IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS c,
    row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM x) SELECT symbol, date, {_r('c', 'filled')} FROM y WHERE (n - 1) % 7 = 0""")
def filled_every_7th(spark, d):
    p = prices(spark, d).withColumn("c", F.when(F.col("volume") % 3 != 0, F.col("close")))
    return rounded(every_kth(p.select("symbol", "date", fill_forward(F.col("c"), rows_of()).alias("filled")), ["date"], 7, ["symbol"]))


_RSI = lambda rows, x: f"""od AS (SELECT symbol, date, row_number() OVER w AS i, {x} - lag({x}) OVER w AS dx FROM {rows} WINDOW w AS (PARTITION BY
    symbol ORDER BY date)),
    og AS (SELECT symbol, i, greatest(dx, 0) AS g, greatest(-dx, 0) AS l FROM od WHERE dx IS NOT NULL),
    ew AS (SELECT a.symbol, a.i, sum(b.g * pow(13.0 / 14, a.i - b.i) * CASE WHEN b.i = 2 THEN 1 ELSE 1.0 / 14 END) AS ag, sum(b.l * pow(13.0 / 14, a.i
    - b.i) * CASE WHEN b.i = 2 THEN 1 ELSE 1.0 / 14 END) AS al
    FROM og a JOIN og b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY a.symbol, a.i),
    rsi AS (SELECT symbol, date, 100 - 100 / (1 + ag / nullif(al, 0)) AS rsi FROM od LEFT JOIN ew USING (symbol, i))"""  # noqa: E731


@query(f"WITH {_P}, {_RSI('prices', 'close')} SELECT symbol, date, {_r('rsi')} FROM rsi")
def rsi_path(spark, d):
    return rounded(rsi_series(prices(spark, d)))


# Fundamentals


@query(f"""WITH {_RATIOS} SELECT symbol, period_end, {", ".join(_r(c) for c in ("total_revenue", "net_income", "revenue_yoy_pct", "revenue_qoq_pct", "net_income_yoy_pct", "net_margin_pct", "op_margin_pct", "net_margin_change_pp"))} FROM rat""")
def yoy_fundamentals(spark, d):
    return rounded(fundamental.ratios(fundamentals(spark, d)))


@query(f"""WITH {_RATIOS}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS n, count(*) OVER (PARTITION BY symbol)
    AS k FROM rat WHERE period_end <= DATE '{AS_OF}' - 45)
    SELECT symbol, period_end, {_r('revenue_yoy_pct')}, {_r('net_income_yoy_pct')}, {_GB('revenue_yoy_pct')} AS revenue_growth,
    {_GB('net_income_yoy_pct')} AS earnings_growth,
    CASE WHEN net_margin_change_pp > 0.5 THEN 'expanding' WHEN net_margin_change_pp < -0.5 THEN 'contracting' WHEN net_margin_change_pp IS NOT NULL
    THEN 'stable' END AS margin_trend FROM l WHERE n = 1 AND k >= 2""")
def fundamental_dials(spark, d):
    f = fundamental.fundamental(pit.announced(fundamentals(spark, d), AS_OF))
    return rounded(f.select("symbol", "period_end", "revenue_yoy_pct", "net_income_yoy_pct", "revenue_growth", "earnings_growth", "margin_trend"))


@query(f"""WITH {_F}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS n FROM q)
    SELECT symbol, period_end, {_r('total_revenue')}, {_r('net_income')}, {_r('net_income / nullif(total_revenue, 0) * 100', 'net_margin_pct')} FROM l
    WHERE n <= 6""")
def quarterly_trend(spark, d):
    return rounded(fundamental.quarterly_trend(fundamentals(spark, d)))


# Sectors

_SW = f"""{_P}, {_LOC}, hw AS (SELECT symbol, s_acctbal * lc AS mv, s_acctbal * lc / sum(s_acctbal * lc) OVER () AS weight, r_name AS sector FROM
    (SELECT symbol, arg_max(close, date) AS lc FROM prices GROUP BY symbol)
    JOIN loc ON symbol = CAST(s_suppkey AS VARCHAR) WHERE s_acctbal > 0)"""


@query(f"WITH {_SW} SELECT sector, {_r('sum(weight) * 100', 'weight_pct')}, count(*) AS n_holdings FROM hw GROUP BY sector")
def sector_exposure(spark, d):
    return rounded(macro.sector_weights(macro.weights(holdings(spark, d), prices(spark, d)), sectors(spark, d)))


@query(f"""WITH {_SW}, s AS (SELECT CASE WHEN sector = 'AFRICA' THEN 'Unknown' ELSE sector END AS sector, sum(weight) * 100 AS w FROM hw GROUP BY 1)
    SELECT arg_max(sector, w) AS top_sector, {_r('max(w)', 'top_sector_pct')}, count(*) FILTER (sector <> 'Unknown') AS num_sectors,
    {_r('1 / sum(w / 100 * w / 100)', 'effective_sectors')},
    {_r("coalesce(sum(w) FILTER (sector = 'Unknown'), 0)", 'unknown_pct')},
    CASE WHEN max(w) FILTER (sector <> 'Unknown') >= 40 THEN 'high' WHEN max(w) FILTER (sector <> 'Unknown') >= 25 THEN 'moderate' WHEN max(w) FILTER
    (sector <> 'Unknown') IS NOT NULL THEN 'low' END AS concentration FROM s""")
def sector_summary(spark, d):
    """One region's names have no sector on file."""
    known = sectors(spark, d).withColumn("sector", F.when(F.col("sector") != "AFRICA", F.col("sector")))
    return rounded(macro.macro_portfolio(macro.sector_weights(macro.weights(holdings(spark, d), prices(spark, d)), known)))


# News


@query(f"""WITH {_NEWS}, s AS (SELECT symbol, count(*) AS n_articles, avg(polarity) AS m, avg(CASE WHEN polarity > 0 THEN 1.0 ELSE 0 END) AS ps,
    avg(CASE WHEN polarity < 0 THEN 1.0 ELSE 0 END) AS ns FROM news GROUP BY symbol)
    SELECT symbol, n_articles, {_r('m', 'mean_polarity')}, {_r('ps', 'positive_share')}, {_r('ns', 'negative_share')}, CASE WHEN m > 0.15 THEN
    'positive' WHEN m < -0.15 THEN 'negative' ELSE 'neutral' END AS label FROM s""")
def sentiment_scores(spark, d):
    return rounded(text.sentiment(headlines(spark, d).withColumn("polarity", text.polarity(F.col("text")))))


def _event_sql(t: str) -> str:
    cases = []
    for label, words in text.EVENT_RULES:
        hits = [f"contains({t}, '{w}')" for w in words if len(w) >= 5]
        short = [w for w in words if len(w) < 5]
        if short:
            hits.append(f"list_has_any(regexp_extract_all({t}, '[a-z&/''-]+'), [{_IN(short)}])")
        cases.append(f"WHEN {' OR '.join(hits)} THEN '{label}'")
    return f"CASE {' '.join(cases)} END"


@query(f"""WITH {_NEWS}, e AS (SELECT symbol, doc_id, {_event_sql('lower(text)')} AS event FROM news) SELECT symbol, doc_id, event FROM e WHERE event
    IS NOT NULL""")
def event_tags(spark, d):
    return text.catalysts(headlines(spark, d), "text").select("symbol", "doc_id", "event")


@query(f"""WITH {_NEWS}, k AS (SELECT symbol, doc_id, published, round(polarity, 3) AS polarity, row_number() OVER (PARTITION BY symbol ORDER BY
    published DESC NULLS LAST, doc_id) AS n FROM news WHERE published <= DATE '2024-10-01')
    SELECT symbol, doc_id, published, polarity + 0.0 AS polarity FROM k WHERE n <= 12""")
def news_flow(spark, d):
    n = pit.as_of_filter(headlines(spark, d), "published", "2024-10-01").withColumn("polarity", text.polarity(F.col("text")))
    return rounded(text.newest_headlines(n, 12, "doc_id").select("symbol", "doc_id", "published", "polarity"), 3)


@query(f"""WITH {_NEWS}, o AS (SELECT symbol, publisher, max(published) AS seen, arg_max(doc_id % 100, doc_id) / 100.0 AS inst FROM news WHERE
    published <= DATE '2024-06-30' GROUP BY ALL),
    l AS (SELECT symbol, arg_max(inst, (seen, inst)) AS inst FROM o GROUP BY symbol)
    SELECT symbol, round(inst * 100, 1) AS institutional_pct, CASE WHEN round(inst * 100, 1) >= 50 THEN 'high' WHEN round(inst * 100, 1) >= 20 THEN
    'moderate' ELSE 'low' END AS institutional FROM l""")
def ownership_dials(spark, d):
    n = pit.as_of_filter(headlines(spark, d), "published", "2024-06-30")
    o = n.groupBy("symbol", "publisher").agg(F.max("published").alias("at"),
        (F.max_by(F.col("doc_id") % 100, "doc_id") / 100.0).cast("double").alias("held_pct_institutions"))
    snaps = o.select("symbol", "held_pct_institutions", F.lit(None).cast("double").alias("held_pct_insiders"),
        F.lit(None).cast("int").alias("n_institutions"), F.struct("at", "held_pct_institutions").alias("snapshot_at"))
    return text.ownership(snaps).select("symbol", "institutional_pct", "institutional")


# Risk


def _book(spark, d):
    """Bars of the book's names, computed once, its weights and returns."""
    p = cut(region_prices(spark, d))
    return p, macro.weights(positions(spark, d, p), p), risk.returns(p)


def _tiles(rets):
    """The covariance of the book's common sample; so few names are one tile."""
    return tiles.covariance_tiles(risk.common_sample(rets), n_tiles=1)


@query(f"WITH {_COMMON} SELECT a, b, {_r('cov', places=10)} FROM cov")
def ewma_cov(spark, d):
    return rounded(tiles.entries(_tiles(_book(spark, d)[2])), 10)


@query(f"""WITH {_COMMON} SELECT c.a, c.b, {_r('c.cov / sqrt(x.cov * y.cov)', 'rho')} FROM cov c JOIN cov x ON x.a = c.a AND x.b = c.a JOIN cov y ON
    y.a = c.b AND y.b = c.b""")
def corr_matrix(spark, d):
    return rounded(tiles.correlation(_tiles(_book(spark, d)[2])))


_LW_STEPS = """va AS (SELECT a, cov AS v FROM cov WHERE a = b), fullc AS (SELECT c.a, c.b, c.cov, x.v AS va, y.v AS vb FROM cov c JOIN va x ON
    x.a = c.a JOIN va y ON y.a = c.b),
    rb AS (SELECT avg(cov / sqrt(va * vb)) AS rbar FROM fullc WHERE a <> b), gm AS (SELECT sum(pow(CASE WHEN a = b THEN cov ELSE rbar * sqrt(va * vb)
    END - cov, 2)) AS gamma FROM fullc, rb),
    fl AS (SELECT symbol, date, x - avg(x) OVER (PARTITION BY symbol) AS x FROM cs), pj AS (SELECT p.symbol AS a, q.symbol AS b, avg(pow(p.x * q.x -
    cov, 2)) AS pi FROM fl p JOIN fl q ON p.date = q.date JOIN cov ON cov.a = p.symbol AND cov.b = q.symbol GROUP BY ALL),
    ps AS (SELECT sum(pi) AS pi, sum(pi) FILTER (a = b) AS rho FROM pj), lw AS (SELECT rbar, gamma, pi, rho, least(1, greatest(0, (pi - rho) / gamma /
    (SELECT count(*) FROM full_days))) AS delta FROM rb, gm, ps)"""
_LW = f"{_COMMON}, {_LW_STEPS}"


@query(f"WITH {_LW} SELECT {_r('rbar')}, {_r('gamma', places=12)}, {_r('pi', places=9)}, {_r('rho', places=9)}, {_r('delta')} FROM lw")
def ledoit_wolf(spark, d):
    out = tiles.shrinkage(_tiles(_book(spark, d)[2]))
    return out.select(*[(F.round(c, n) + F.lit(0.0)).alias(c) for c, n in (("rbar", 6), ("gamma", 12), ("pi", 9), ("rho", 9), ("delta", 6))])


_SH = "sh AS (SELECT a, b, delta * CASE WHEN a = b THEN cov ELSE rbar * sqrt(va * vb) END + (1 - delta) * cov AS cov FROM fullc, lw)"


@query(f"""WITH {_LW}, {_W}, {_SH},
    sw AS (SELECT a, sum(cov * weight) AS sw, sum(cov) FILTER (a = b) AS v FROM sh JOIN wts ON b = symbol GROUP BY a), tot AS (SELECT sum(weight * sw)
    AS pv FROM sw JOIN wts ON a = symbol)
    SELECT a AS symbol, {_r('weight * 100', 'weight_pct')}, {_r('sqrt(v) * sqrt(252) * 100', 'vol_pct')}, {_r('sw / sqrt(pv)', 'mctr')},
    {_r('weight * sw / pv * 100', 'risk_contribution_pct')}, {_r('sqrt(pv) * sqrt(252) * 100', 'portfolio_vol_pct')} FROM sw JOIN wts ON a = symbol,
    tot""")
def risk_contrib(spark, d):
    _, w, r = _book(spark, d)
    return rounded(tiles.risk_contribution(tiles.shrunk(_tiles(r)), w))


@query(f"""WITH {_RET}, mp AS (SELECT {_BARS} FROM lineitem GROUP BY CAST(l_shipdate AS DATE)), md AS (SELECT date, adj_close / lag(adj_close) OVER
    (ORDER BY date) - 1 AS m FROM mp)
    SELECT symbol, {_r('regr_slope(ret, m) * 0.67 + 0.33', 'beta')} FROM rets JOIN md USING (date) WHERE ret IS NOT NULL AND m IS NOT NULL GROUP BY
    symbol HAVING count(*) >= 60""")
def beta(spark, d):
    return rounded(risk.betas(_book(spark, d)[2], risk.returns(market_prices(spark, d)).select("date", "ret")))


@query(f"""WITH {_COMMON}, {_W}, {_PORT}, c AS (SELECT unnest([0.95, 0.99]) AS confidence), q AS (SELECT 0.95 AS confidence, quantile_cont(ret, 0.05)
    AS q FROM port UNION ALL SELECT 0.99, quantile_cont(ret, 0.01) FROM port)
    SELECT {_r('confidence')}, {_r('-max(q)', 'var')}, {_r('-avg(ret) FILTER (ret <= q)', 'cvar')} FROM q LEFT JOIN port ON true GROUP BY confidence""")
def var_cvar(spark, d):
    _, w, r = _book(spark, d)
    p = risk.portfolio_returns(r, w)
    one = lambda c: risk.var_cvar(p, c).select(F.lit(c).alias("confidence"), "var", "cvar")
    return rounded(one(0.95).unionByName(one(0.99)))


@query(f"""WITH RECURSIVE {_COMMON}, {_W}, {_PORT}, o AS (SELECT date, ret, ret - avg(ret) OVER () AS e, row_number() OVER (ORDER BY date) AS i,
    count(*) OVER () AS n FROM port),
    g AS (SELECT i, n, ret, e * e AS v FROM o WHERE i = 1 UNION ALL SELECT o.i, o.n, o.ret, 0.94 * g.v + (1 - 0.94) * o.e * o.e FROM g JOIN o ON o.i =
    g.i + 1),
    z AS (SELECT ret / nullif(sqrt(v), 0) * (SELECT sqrt(v) FROM g WHERE i = n) AS ret FROM g), q AS (SELECT quantile_cont(ret, 0.01) AS q FROM z)
    SELECT {_r('-max(q)', 'var')}, {_r('-avg(ret) FILTER (ret <= q)', 'cvar')} FROM z, q""")
def fhs_var(spark, d):
    _, w, r = _book(spark, d)
    sig = ewma_vol_series(risk.portfolio_returns(r, w).withColumn("key", F.lit("book")))
    return rounded(risk.var_cvar(risk.fhs(sig), 0.99, least=risk.MIN_FHS_ROWS))


@query(f"""WITH {_COMMON}, {_W}, {_PORT}, {", ".join(f"s{n} AS (SELECT CASE WHEN count(*) OVER w = {n} THEN product(1 + ret) OVER w - 1 END AS r FROM port WINDOW w AS (ORDER BY date ROWS {n - 1} PRECEDING))" for n in risk.STRESS_DAYS)}
    {" UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS days, {_r('min(r)', 'worst')} FROM s{n}" for n in risk.STRESS_DAYS)}""")
def worst_windows(spark, d):
    _, w, r = _book(spark, d)
    return rounded(risk.worst_windows(risk.portfolio_returns(r, w)))


@query(f"WITH {_R}, {_W} SELECT {_r('sum(weight * weight)', 'hhi')}, {_r('1 / sum(weight * weight)', 'effective_holdings')} FROM wts")
def hhi(spark, d):
    return rounded(risk.effective_number(_book(spark, d)[1]))


_DTL = """tv AS (SELECT symbol, median(v) AS median_traded FROM (SELECT symbol, close * volume AS v, row_number() OVER (PARTITION BY symbol ORDER BY
    date DESC) AS n FROM rp) WHERE n <= 20 GROUP BY symbol)"""


@query(f"""WITH {_R}, {_W}, {_DTL} SELECT symbol, {_r('median_traded', places=4)}, {_r('mv / (0.20 * median_traded)', 'days_to_liquidate')} FROM wts
    LEFT JOIN tv USING (symbol)""")
def dtl(spark, d):
    p, w, _ = _book(spark, d)
    return risk.liquidity(w, p).select("symbol", (F.round("median_traded", 4) + F.lit(0.0)).alias("median_traded"),
        (F.round("days_to_liquidate", 6) + F.lit(0.0)).alias("days_to_liquidate"))


@query(f"""WITH {_R}, {_W}, c AS (SELECT r_name AS symbol, arg_min(close, date) AS cost FROM (SELECT symbol AS r_name, close, date FROM rp) GROUP BY
    1)
    SELECT symbol, {_r('mv', 'market_value', 4)}, {_r('weight * 100', 'weight_pct', 4)}, {_r('(lc / cost - 1) * 100', 'unrealised_pct', 4)} FROM wts
    JOIN c USING (symbol)""")
def position_values(spark, d):
    w = _book(spark, d)[1]
    return rounded(w.select("symbol", "market_value", (F.col("weight") * 100).alias("weight_pct"),
        ((F.col("last_close") / F.col("avg_cost") - 1) * 100).alias("unrealised_pct")), 4)


@query(f"""WITH {_LW}, {_W}, {_PORT}, {_DTL}, {_SH}, sw AS (SELECT a, sum(cov * weight) AS sw FROM sh JOIN wts ON b = symbol GROUP BY a), tot AS
    (SELECT sum(weight * sw) AS pv FROM sw JOIN wts ON a = symbol),
    rc AS (SELECT a AS symbol, weight * 100 AS w, weight * sw / pv * 100 AS r, sqrt(pv) * sqrt(252) * 100 AS vol FROM sw JOIN wts ON a = symbol, tot),
    q AS (SELECT quantile_cont(ret, 0.01) AS q FROM port), ch AS (
    SELECT 'max single-name weight %' AS metric, max(w) AS value, 30.0 AS limit_, max(w) <= 30 AS ok, arg_max(symbol, w) AS note FROM rc
    UNION ALL SELECT 'max single-name risk %', max(r), 40.0, max(r) <= 40, arg_max(symbol, r) FROM rc UNION ALL SELECT 'annualised vol %', max(vol),
    25.0, max(vol) <= 25, '' FROM rc
    UNION ALL SELECT '1-day 99% VaR %', -q * 100, 4.0, -q * 100 <= 4, '' FROM q UNION ALL SELECT 'effective holdings', 1 / sum(weight * weight), 3.0,
    1 / sum(weight * weight) >= 3, '' FROM wts
    UNION ALL SELECT 'max days-to-liquidate', max(mv / (0.20 * median_traded)), 5.0, max(mv / (0.20 * median_traded)) <= 5, '' FROM wts JOIN tv USING
    (symbol))
    SELECT metric, {_r('value')}, CAST(limit_ AS DOUBLE) AS "limit", ok, note FROM ch WHERE value IS NOT NULL""")
def limits(spark, d):
    p, w, r = _book(spark, d)
    return rounded(risk.limit_checks(tiles.risk_contribution(tiles.shrunk(_tiles(r)), w), risk.var_cvar(risk.portfolio_returns(r, w), 0.99),
        risk.effective_number(w), risk.liquidity(w, p)))


# Signals

_SIG = f"""{_P}, own AS (SELECT symbol, date, adj_close AS x FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS k FROM prices) WHERE k >= 250),
    rr AS (SELECT symbol, date, x, x / lag(x) OVER w - 1 AS r, x / lag(x, 63) OVER w - 1 AS momentum_3m, CASE WHEN count(x) OVER v = 50 THEN x /
    avg(x) OVER v - 1 END AS sma50_ratio, lead(x, {HORIZON}) OVER w / x - 1 AS fwd FROM own
    WINDOW w AS (PARTITION BY symbol ORDER BY date), v AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING)),
    wide AS (SELECT *, CASE WHEN count(r) OVER u = 63 THEN -stddev_samp(r) OVER u END AS low_vol FROM rr WINDOW u AS (PARTITION BY symbol ORDER BY
    date ROWS 62 PRECEDING)),
    sig AS (SELECT * FROM (SELECT 'momentum_3m' AS signal, symbol, date, momentum_3m AS sig, fwd FROM wide UNION ALL SELECT 'sma50_ratio', symbol,
    date, sma50_ratio, fwd FROM wide UNION ALL SELECT 'low_vol', symbol, date, low_vol, fwd FROM wide) WHERE sig IS NOT NULL AND fwd IS NOT NULL)"""
_AVG = lambda x, k: f"rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0"
_IC = f"""{_SIG}, rk AS (SELECT *, {_AVG('sig', 'signal, date')} AS rs, {_AVG('fwd', 'signal, date')} AS rf FROM sig),
    ic AS (SELECT signal, date, corr(rs, rf) AS ic, count(*) AS n FROM rk GROUP BY signal, date HAVING count(*) >= 4 AND min(rs) < max(rs) AND min(rf)
    < max(rf))"""
_NW = f"""{_IC}, b AS (SELECT signal, count(*) AS m, avg(ic) AS mean_ic, stddev_samp(ic) AS ic_std FROM ic GROUP BY signal),
    e AS (SELECT signal, row_number() OVER (PARTITION BY signal ORDER BY date) AS i, ic - mean_ic AS e, m FROM ic JOIN b USING (signal)),
    sv AS (SELECT p.signal, sum(p.e * q.e * CASE WHEN p.i = q.i THEN 1.0 ELSE 2 * (1 - (p.i - q.i) / (least({HORIZON - 1}, p.m - 1) + 1.0)) END) /
    max(p.m) AS s FROM e p JOIN e q ON p.signal = q.signal AND p.i - q.i BETWEEN 0 AND {HORIZON - 1} GROUP BY p.signal)"""
_TS = f"""tr AS (SELECT signal, date, fwd, row_number() OVER (PARTITION BY signal, date ORDER BY sig, symbol) AS lo, row_number() OVER (PARTITION BY
    signal, date ORDER BY sig DESC, symbol DESC) AS hi, count(*) OVER (PARTITION BY signal, date) AS n FROM sig),
    td AS (SELECT signal, date, avg(fwd) FILTER (hi <= greatest(1, round_even(n / 3.0, 0))) - avg(fwd) FILTER (lo <= greatest(1, round_even(n / 3.0,
    0))) AS d FROM tr WHERE n >= 4 GROUP BY signal, date), ts AS (SELECT signal, avg(d) AS spread FROM td GROUP BY signal)"""
_TH = f"th AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY date, symbol) - 1 AS k FROM sig) WHERE k % {HORIZON} = 0)"
_HB = """md AS (SELECT signal, median(sig) AS ms, median(fwd) AS mf FROM th GROUP BY signal), hb AS (SELECT signal, avg(CASE WHEN (sig > ms) = (fwd >
    mf) THEN 1.0 ELSE 0 END) AS hit, avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END) AS base FROM th JOIN md USING (signal) GROUP BY signal)"""
_PI = f"""pr AS (SELECT signal, {_AVG('sig', 'signal')} AS rs, {_AVG('fwd', 'signal')} AS rf FROM th), pc AS (SELECT signal, corr(rs, rf) AS pooled_ic
    FROM pr GROUP BY signal)"""


def _signals(spark, d):
    return evaluate.price_signals(prices(spark, d), HORIZON, with_rsi=False)


@query(f"WITH {_IC} SELECT signal, date, {_r('ic')}, n FROM ic")
def xs_ic(spark, d):
    return rounded(evaluate.cross_sectional_ic(_signals(spark, d)))


@query(f"""WITH {_NW} SELECT signal, m, {_r('mean_ic')}, {_r('ic_std')}, {_r('mean_ic / ic_std', 'icir')},
    {_r('CASE WHEN m >= 8 AND s > 0 THEN mean_ic / sqrt(s / m) END', 't')} FROM b JOIN sv USING (signal)""")
def ic_newey_west(spark, d):
    return rounded(evaluate.newey_west(evaluate.cross_sectional_ic(_signals(spark, d)), HORIZON - 1))


@query(f"WITH {_SIG}, {_TS} SELECT signal, {_r('spread')} FROM ts")
def tercile_spread(spark, d):
    return rounded(evaluate.tercile_spread(_signals(spark, d)))


@query(f"WITH {_SIG}, {_TH}, {_HB} SELECT signal, {_r('hit')}, {_r('base')} FROM hb")
def hit_base(spark, d):
    return rounded(evaluate.hit_and_base(_signals(spark, d), HORIZON))


@query(f"WITH {_SIG}, {_TH}, {_PI} SELECT signal, {_r('pooled_ic')} FROM pc")
def pooled_ic(spark, d):
    return rounded(evaluate.pooled_ic(_signals(spark, d), HORIZON))


@query(f"""WITH {_NW}, {_TS}, {_TH}, {_HB}, {_PI} SELECT signal, m, {_r('mean_ic')}, {_r('ic_std')}, {_r('mean_ic / ic_std', 'icir')},
    {_r('mean_ic / sqrt(s / m)', 't')}, {_r('spread')}, {_r('abs(spread) - 4 * 15 / 1e4', 'net')},
    {_r('hit')}, {_r('base')}, {_r('pooled_ic')} FROM b JOIN sv USING (signal) LEFT JOIN ts USING (signal) LEFT JOIN hb USING (signal) LEFT JOIN pc
    USING (signal)""")
def signal_scorecard(spark, d):
    return rounded(evaluate.scorecard(evaluate.dealt(_signals(spark, d)), HORIZON))


def _chain(sig: str, lag: int, p: str) -> str:
    """The scores of a table of signals, in CTEs whose names begin with ``p``; the last one is ``{p}sc``."""
    avg = lambda x, k: f"rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0"
    third = "greatest(1, round_even(n / 3.0, 0))"
    bartlett = f"CASE WHEN p.i = q.i THEN 1.0 ELSE 2 * (1 - (p.i - q.i) / (least({lag}, p.m - 1) + 1.0)) END"
    return f"""{p}rk AS (SELECT *, {avg('sig', 'signal, date')} AS rs, {avg('fwd', 'signal, date')} AS rf FROM {sig}),
    {p}ic AS (SELECT signal, date, corr(rs, rf) AS ic FROM {p}rk GROUP BY signal, date HAVING count(*) >= 4 AND min(rs) < max(rs) AND min(rf) <
    max(rf)),
    {p}b AS (SELECT signal, count(*) AS m, avg(ic) AS mean_ic, stddev_samp(ic) AS ic_std FROM {p}ic GROUP BY signal),
    {p}e AS (SELECT signal, row_number() OVER (PARTITION BY signal ORDER BY date) AS i, ic - mean_ic AS e, m FROM {p}ic JOIN {p}b USING (signal)),
    {p}sv AS (SELECT p.signal, sum(p.e * q.e * {bartlett}) / max(p.m) AS s FROM {p}e p JOIN {p}e q ON p.signal = q.signal AND p.i - q.i BETWEEN 0 AND
    {lag} GROUP BY p.signal),
    {p}tr AS (SELECT signal, date, fwd, row_number() OVER (PARTITION BY signal, date ORDER BY sig, symbol) AS lo, row_number() OVER (PARTITION BY
    signal, date ORDER BY sig DESC, symbol DESC) AS hi,
    count(*) OVER (PARTITION BY signal, date) AS n FROM {sig}),
    {p}td AS (SELECT signal, date, avg(fwd) FILTER (hi <= {third}) - avg(fwd) FILTER (lo <= {third}) AS d FROM {p}tr WHERE n >= 4 GROUP BY signal,
    date),
    {p}ts AS (SELECT signal, avg(d) AS spread FROM {p}td GROUP BY signal),
    {p}th AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY date, symbol) - 1 AS k FROM {sig}) WHERE k % {HORIZON} = 0),
    {p}md AS (SELECT signal, median(sig) AS ms, median(fwd) AS mf FROM {p}th GROUP BY signal),
    {p}hb AS (SELECT signal, CASE WHEN count(*) >= 10 THEN avg(CASE WHEN (sig > ms) = (fwd > mf) THEN 1.0 ELSE 0 END) END AS hit, CASE WHEN count(*)
    >= 10 THEN avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0 END) END AS base
    FROM {p}th JOIN {p}md USING (signal) GROUP BY signal),
    {p}pr AS (SELECT signal, {avg('sig', 'signal')} AS rs, {avg('fwd', 'signal')} AS rf FROM {p}th),
    {p}pc AS (SELECT signal, CASE WHEN count(*) >= 3 AND min(rs) < max(rs) AND min(rf) < max(rf) THEN corr(rs, rf) END AS pooled_ic FROM {p}pr GROUP
    BY signal),
    {p}sc AS (SELECT signal, m, mean_ic, ic_std, mean_ic / ic_std AS icir, CASE WHEN m >= 8 AND s > 0 THEN mean_ic / sqrt(s / m) END AS t, spread,
    abs(spread) - 4 * 15 / 1e4 AS net, hit, base, pooled_ic
    FROM {p}b JOIN {p}sv USING (signal) LEFT JOIN {p}ts USING (signal) LEFT JOIN {p}hb USING (signal) LEFT JOIN {p}pc USING (signal))"""


_FUND = f"""{_RATIOS}, fl AS (SELECT 'net_margin' AS signal, symbol, period_end + 45 AS available, net_margin_pct AS v FROM rat WHERE total_revenue <>
    0 AND net_margin_pct IS NOT NULL
    UNION ALL SELECT 'revenue_yoy', symbol, period_end + 45, revenue_yoy_pct FROM rat WHERE total_revenue <> 0 AND revenue_yoy_pct IS NOT NULL
    UNION ALL SELECT 'net_income_yoy', symbol, period_end + 45, net_income_yoy_pct FROM rat WHERE total_revenue <> 0 AND net_income_yoy_pct IS NOT
    NULL),
    fw AS (SELECT n.signal, rr.symbol, rr.date, rr.fwd FROM rr CROSS JOIN (SELECT unnest(['net_margin', 'revenue_yoy', 'net_income_yoy']) AS signal)
    n),
    fj AS (SELECT fw.signal, fw.symbol, fw.date, fl.v AS sig, fw.fwd FROM fw ASOF JOIN fl ON fw.signal = fl.signal AND fw.symbol = fl.symbol AND
    fw.date >= fl.available WHERE fw.fwd IS NOT NULL),
    fd AS (SELECT signal, date, row_number() OVER (PARTITION BY signal ORDER BY date) - 1 AS k FROM (SELECT DISTINCT signal, date FROM fj)),
    fsig AS (SELECT fj.* FROM fj JOIN fd USING (signal, date) WHERE k % {HORIZON} = 0)"""
_SCORES = ("mean_ic", "ic_std", "icir", "t", "spread", "net", "hit", "base", "pooled_ic")
_ALL_SIG = f"""{_SIG}, {_RSI('own', 'x')}, psig AS (SELECT * FROM sig UNION ALL SELECT 'rsi', symbol, date, rsi, fwd FROM rsi JOIN rr USING (symbol,
    date) WHERE rsi IS NOT NULL AND fwd IS NOT NULL)"""


@query(f"WITH {_SIG}, {_FUND}, {_chain('fsig', 1, 'f')} SELECT signal, m, {', '.join(_r(c) for c in _SCORES)} FROM fsc")
def fundamental_scorecard(spark, d):
    long = evaluate.fundamental_signals(prices(spark, d), fundamentals(spark, d), HORIZON)
    return rounded(evaluate.scorecard(evaluate.dealt(long), HORIZON, lag=1))


_BEYOND = f"CASE n {' '.join(f'WHEN {n} THEN {evaluate.t_for(round(0.05 / n, 4))!r}' for n in range(1, 8))} END"


@query(f"""WITH {_ALL_SIG}, {_FUND}, {_chain('psig', HORIZON - 1, 'p')}, {_chain('fsig', 1, 'f')},
    u AS (SELECT *, 'price' AS kind FROM psc UNION ALL SELECT *, 'fundamental' FROM fsc), n AS (SELECT *, count(*) OVER () AS n FROM u)
    SELECT signal, kind, m, {', '.join(_r(c) for c in _SCORES)}, CAST(n AS INTEGER) AS n_signals, round(0.05 / n, 4) AS bonferroni_alpha,
    coalesce(abs(t) > {evaluate.t_for(0.05)!r}, false) AS significant, coalesce(abs(t) > {_BEYOND}, false) AS survives,
    '{evaluate.SURVIVORSHIP[False]}' AS survivorship FROM n""")
def evaluation(spark, d):
    return rounded(evaluate.evaluate(prices(spark, d, by_symbol=True), fundamentals(spark, d), HORIZON))


REPLAYED, RESTATED, STEP = "2000-01-15", "2000-01-01", 3
_BARS_THEN = f"""prices AS (SELECT symbol, date, close, CASE WHEN volume % 5 = 0 AND date < DATE '1999-06-30' THEN adj_close * 1.01 ELSE adj_close END AS
    adj_close, volume FROM ({_P.removeprefix('prices AS (').removesuffix(')')}) WHERE date <= DATE '{REPLAYED}' AND CAST(symbol AS INTEGER) % 4 <> 3)"""


def _then(sql: str) -> str:
    """SQL of the back-test on the bars known then, its pooled scores thinned by the step."""
    line = lambda text: " ".join(text.split("\n"))
    sql = line(sql).replace(line(_P), line(_BARS_THEN))
    for p in "pf":
        sql = sql.replace(f"WHERE k % {HORIZON} = 0),     {p}md", f"WHERE k % {STEP} = 0), {p}md")
    return sql


@query(_then(ORACLE_SQL["evaluation"]))
def evaluation_replayed(spark, d):
    """The back-test of three quarters of the names on bars as they were known on one day, with a step of its own."""
    p = prices(spark, d, by_symbol=True)
    first = p.withColumn("vintage_date", F.col("date"))
    later = p.where("volume % 5 = 0 and date < date'1999-06-30'").withColumns({"adj_close": F.col("adj_close") * 1.01,
        "vintage_date": F.lit(RESTATED).cast("date")})
    lost = later.withColumns({"adj_close": F.col("adj_close") * 2, "vintage_date": F.lit("2000-03-01").cast("date")})
    names = table(spark, d, "lineitem").where("l_suppkey % 4 <> 3").select(F.col("l_suppkey").cast("string").alias("symbol"))
    seen = first.unionByName(later).unionByName(lost)
    return rounded(evaluate.evaluate(seen, fundamentals(spark, d), HORIZON, as_of=AS_OF, step=STEP, vintage_asof=REPLAYED, universe=names))


@query(f"""WITH {_ALL_SIG}, {_chain('psig', HORIZON - 1, 'p')}, n AS (SELECT *, count(*) OVER () AS n FROM psc)
    SELECT signal, {_r('t')}, coalesce(abs(t) > {evaluate.t_for(0.05)!r}, false) AS significant, round(0.05 / n, 4) AS bonferroni_alpha,
    coalesce(abs(t) > {_BEYOND}, false) AS survives FROM n""")
def significance(spark, d):
    rows = evaluate.with_bonferroni(evaluate.price_scorecard(prices(spark, d, by_symbol=True), HORIZON))
    fields = "signal string, t double, significant boolean, bonferroni_alpha double, survives boolean"
    return rounded(spark.createDataFrame([tuple(r[c.split()[0]] for c in fields.split(", ")) for r in rows], fields))


@query(f"""WITH {_SIG}, {_LOC} SELECT signal, symbol, date, {_r('sig - avg(sig) OVER (PARTITION BY signal, date, r_name)', 'sig')} FROM sig JOIN loc
    ON symbol = CAST(s_suppkey AS VARCHAR)""")
def sector_neutral(spark, d):
    return rounded(evaluate.sector_neutral(_signals(spark, d), sectors(spark, d)).select("signal", "symbol", "date", "sig"))


@query(f"""WITH {_SIG} SELECT signal, symbol, date, {_r('(sig - avg(sig) OVER w) / nullif(stddev_pop(sig) OVER w, 0)', 'z')} FROM sig WINDOW w AS
    (PARTITION BY signal, date)""")
def xs_zscore(spark, d):
    return rounded(evaluate.xs_zscore(_signals(spark, d)).select("signal", "symbol", "date", "z"))


@query(f"""WITH {_SIG}, z AS (SELECT signal, symbol, date, (sig - avg(sig) OVER w) / nullif(stddev_pop(sig) OVER w, 0) AS z FROM sig WINDOW w AS
    (PARTITION BY signal, date))
    SELECT symbol, date, {_r("sum(CASE signal WHEN 'sma50_ratio' THEN -z ELSE z END) / count(z)", 'sig')} FROM z GROUP BY symbol, date HAVING count(z)
    > 0""")
def composite(spark, d):
    return rounded(evaluate.composite(_signals(spark, d), {"momentum_3m": 1, "sma50_ratio": -1, "low_vol": 1}).select("symbol", "date", "sig"))


# Cards


def _cards(spark, d, as_of: str | None = None):
    p = pit.panel(prices(spark, d), as_of)
    w = macro.weights(holdings(spark, d), p)
    n = headlines(spark, d).select((F.col("doc_id") % 100).cast("string").alias("symbol"), text.polarity(F.col("text")).alias("polarity"))
    shares = w.select("symbol", (F.col("weight") * 100).alias("weight_pct"))
    return scoring.build_cards(technical.technical(p), shares, fundamental.fundamental(pit.announced(fundamentals(spark, d), as_of)),
        macro.macro_by_symbol(w, sectors(spark, d)), text.sentiment(n))


_CARD = """c AS (SELECT CAST(c_custkey AS VARCHAR) AS symbol, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal / 200 END AS rc, CASE WHEN c_custkey % 5 = 0
    THEN NULL WHEN c_custkey % 5 = 1 THEN 'downtrend' WHEN c_custkey % 5 = 2 THEN 'sideways' ELSE 'uptrend' END AS trend,
    CASE c_custkey % 6 WHEN 0 THEN 'overbought' WHEN 1 THEN 'oversold' WHEN 2 THEN 'strong' WHEN 3 THEN 'weak' WHEN 4 THEN 'neutral' END AS momentum,
    CASE c_custkey % 4 WHEN 0 THEN 'at highs' WHEN 1 THEN 'near lows' WHEN 2 THEN 'mid-range' END AS level,
    CASE c_custkey % 3 WHEN 0 THEN 'declining' WHEN 1 THEN 'growing' END AS eg, CASE c_custkey % 8 WHEN 0 THEN 'contracting' WHEN 1 THEN 'expanding'
    WHEN 2 THEN 'stable' END AS mt, CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_nationkey * 4 AS DOUBLE) END AS sw,
    CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 21 - 10) / 10.0 END AS mp, CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_custkey % 100 AS DOUBLE) END
    AS ip FROM customer)"""
_PTS = lambda table, col: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}.0" for k, v in table.items()) + " END"
_CLAMP = lambda x: f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0, least(100.0, {x})) END"


def _made_cards(spark, d):
    """Cards of every state from the customer table."""
    k = F.col("c_custkey")

    def pick(n, *states):
        out = F.lit(None).cast("string")
        for i, s in enumerate(states):
            out = F.when(k % n == i, F.lit(s)).otherwise(out)
        return out

    mp = F.when(k % 11 != 0, (k % 21 - 10) / 10.0)
    return table(spark, d, "customer").select(
        k.cast("string").alias("symbol"), F.when(k % 7 != 0, F.col("c_acctbal") / 200).alias("risk_contribution_pct"),
            F.lit(None).cast("double").alias("weight_pct"), pick(5, None, "downtrend", "sideways", "uptrend", "uptrend").alias("trend"),
        pick(6, "overbought", "oversold", "strong", "weak", "neutral").alias("momentum"), pick(4, "at highs", "near lows",
            "mid-range").alias("level"), F.lit(None).cast("string").alias("revenue_growth"),
        pick(3, "declining", "growing").alias("earnings_growth"), pick(8, "contracting", "expanding", "stable").alias("margin_trend"),
            F.lit(None).cast("double").alias("net_income_yoy_pct"), F.lit(None).cast("double").alias("rsi_14"),
        F.lit(None).cast("double").alias("pct_from_52w_high"), F.lit(None).cast("double").alias("sma200"), F.when(k % 3 != 2,
            F.lit("2024-03-31").cast("date")).alias("latest_quarter"), F.lit(False).alias("guidance"), F.lit(None).cast("string").alias("sector"),
        F.when(k % 9 != 0, (F.col("c_nationkey") * 4).cast("double")).alias("sector_weight_pct"), mp.cast("double").alias("mean_polarity"),
            text.sentiment_label(mp).alias("sentiment"), F.lit(5).cast("bigint").alias("n_articles"),
        F.when(k % 13 != 0, (k % 100).cast("double")).alias("institutional_pct"), F.when(k % 13 != 0,
            text.ownership_level((k % 100).cast("double"))).alias("institutional"),
    )


@query(f"""WITH {_CARD}, s AS (SELECT symbol, round({_CLAMP('100 * rc / 40')}, 1) AS s_risk,
    round(list_avg(list_filter([{_PTS(scoring.MOMENTUM_POINTS, 'momentum')}, {_PTS(scoring.LEVEL_POINTS, 'level')},
    {_PTS(scoring.TREND_POINTS, 'trend')}], lambda x: x IS NOT NULL)), 1) AS s_technical,
    round(list_avg(list_filter([{_PTS(scoring.GROWTH_POINTS, 'eg')}, {_PTS(scoring.MARGIN_POINTS, 'mt')}], lambda x: x IS NOT NULL)), 1) AS
    s_fundamental, round({_CLAMP('100 * sw / 40')}, 1) AS s_macro, round({_CLAMP('abs(mp) * 100')}, 1) AS s_sentiment,
    round({_CLAMP('abs(ip - 50) * 1.4')}, 1) AS s_ownership FROM c)
    SELECT symbol, {", ".join(f"CAST({x} AS DOUBLE) AS {x}" for x in ("s_risk", "s_technical", "s_fundamental", "s_macro", "s_sentiment", "s_ownership"))},
    CAST(round((coalesce(s_risk, 0) + coalesce(s_technical, 0) + coalesce(s_fundamental, 0) + coalesce(s_macro, 0) + 0.5 * coalesce(s_sentiment, 0) +
    0.5 * coalesce(s_ownership, 0))
    / nullif((s_risk IS NOT NULL)::INT + (s_technical IS NOT NULL)::INT + (s_fundamental IS NOT NULL)::INT + (s_macro IS NOT NULL)::INT + 0.5 *
    (s_sentiment IS NOT NULL)::INT + 0.5 * (s_ownership IS NOT NULL)::INT, 0) + 1e-9, 1) AS DOUBLE) AS attention FROM s""")
def attention_scores(spark, d):
    return scoring.attention(_made_cards(spark, d)).select("symbol",
        *[f"s_{x}" for x in ("risk", "technical", "fundamental", "macro", "sentiment", "ownership")], "attention")


@query(f"""WITH {_CARD}, s AS (SELECT symbol, list_filter([{_PTS(scoring.TREND_SIGNS, 'trend')}, {_PTS(scoring.MOMENTUM_SIGNS, 'momentum')},
    {_PTS(scoring.LEVEL_SIGNS, 'level')}, {_PTS(scoring.GROWTH_SIGNS, 'eg')}, {_PTS(scoring.MARGIN_SIGNS, 'mt')},
    CASE WHEN mp > 0.15 THEN 1.0 WHEN mp < -0.15 THEN -1.0 WHEN mp IS NOT NULL THEN 0.0 END], lambda x: x IS NOT NULL) AS g, CAST(symbol AS BIGINT) %
    3 <> 2 AS q,
    (rc IS NOT NULL)::INT + (trend IS NOT NULL)::INT + (CAST(symbol AS BIGINT) % 3 <> 2)::INT + (sw IS NOT NULL)::INT + (mp IS NOT NULL)::INT + (ip IS
    NOT NULL)::INT AS n_present FROM c),
    t AS (SELECT symbol, n_present, round(0.4 * n_present / 6 + 0.3 * q::INT / 3 + 0.3 * CASE WHEN len(g) < 2 OR list_sum(list_transform(g, lambda x:
    abs(x))) = 0 THEN 0.5 ELSE abs(list_sum(g)) / list_sum(list_transform(g, lambda x: abs(x))) END, 2) AS confidence FROM s)
    SELECT symbol, n_present, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN confidence >= 0.66 THEN 'high' WHEN confidence >= 0.4 THEN 'medium'
    ELSE 'low' END AS confidence_level FROM t""")
def confidence(spark, d):
    return scoring.confidence(_made_cards(spark, d)).select("symbol", "n_present", "confidence", "confidence_level")


def _two_runs(spark, d):
    now = scoring.snapshot(scoring.attention(_made_cards(spark, d)))
    before = now.select((F.col("symbol").cast("bigint") + 1).cast("string").alias("symbol"),
        *[c for c in now.columns if c != "symbol"])
    return now, before


_ARROW = " → "


_FLIPS = (("trend", "trend"), ("momentum", "momentum"), ("level", "level"), ("eg", "earnings_growth"), ("mt", "margin_trend"), ("se",
    "sentiment"), ("io", "institutional"))
_ZERO = lambda x: f"CASE WHEN {x} < 0 AND round_even({x}, 0) = 0 THEN '-0' ELSE CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR) END"
_CHANGES = f"""WITH {_CARD}, att AS ({ORACLE_SQL['attention_scores']}),
    n AS (SELECT CAST(c.symbol AS BIGINT) AS k, trend, momentum, level, eg, mt, rc, attention,
    CASE WHEN mp > 0.15 THEN 'positive' WHEN mp < -0.15 THEN 'negative' WHEN mp IS NOT NULL THEN 'neutral' END AS se,
    CASE WHEN ip >= 50 THEN 'high' WHEN ip >= 20 THEN 'moderate' WHEN ip IS NOT NULL THEN 'low' END AS io FROM c JOIN att ON c.symbol = att.symbol),
    p AS (SELECT * FROM n) SELECT CAST(n.k AS VARCHAR) AS symbol, array_to_string(list_filter([
    {", ".join(f"CASE WHEN n.{c} <> p.{c} THEN '{name} ' || p.{c} || '{_ARROW}' || n.{c} END" for c, name in _FLIPS)},
    CASE WHEN abs(n.attention - p.attention) >= 5 THEN 'attention ' || {_ZERO('p.attention')} || '{_ARROW}' || {_ZERO('n.attention')} END,
    CASE WHEN abs(n.rc - p.rc) >= 3 THEN 'risk contribution ' || {_ZERO('p.rc')} || '%{_ARROW}' || {_ZERO('n.rc')} || '%' END], lambda x: x IS NOT NULL), '; ') AS changes
    FROM n LEFT JOIN p ON p.k + 1 = n.k"""


@query(_CHANGES)
def deltas(spark, d):
    now, before = _two_runs(spark, d)
    return scoring.changes(now, before).select("symbol", F.concat_ws("; ", "changes").alias("changes"))


@query(f"""WITH {_CARD} SELECT symbol, array_to_string(list_filter([
    CASE WHEN rc >= 40 THEN 'top risk contributor — ' || CAST(CAST(round_even(rc, 0) AS BIGINT) AS VARCHAR) || '% of book risk (≥ 40% limit)' END,
    CASE WHEN trend = 'downtrend' AND level = 'near lows' THEN 'in a downtrend and near 52-week lows' END, CASE WHEN eg = 'declining' THEN
    'earnings declining' END,
    CASE WHEN mt = 'contracting' THEN 'margins contracting' END, CASE WHEN mp < -0.15 THEN 'negative news flow (5 headlines)' END], lambda x: x IS NOT
    NULL), ' | ') AS alerts FROM c""")
def alerts(spark, d):
    return scoring.alerts(_made_cards(spark, d)).select("symbol", F.concat_ws(" | ", "alerts").alias("alerts"))


@query(f"""WITH att AS ({ORACLE_SQL['attention_scores']}), con AS ({ORACLE_SQL['confidence']}), al AS ({ORACLE_SQL['alerts']}), de AS ({ORACLE_SQL['deltas']}),
    t AS (SELECT symbol, attention, confidence_level, concat_ws(' | ', nullif(alerts, ''), 'changed since last run — ' || nullif(changes, '')) AS alerts
    FROM att JOIN con USING (symbol) JOIN al USING (symbol) JOIN de USING (symbol))
    SELECT symbol, attention, confidence_level, alerts, alerts <> '' AS flagged FROM t""")
def briefing(spark, d):
    now, before = _two_runs(spark, d)
    made = scoring.confidence(scoring.attention(_made_cards(spark, d)))
    out = scoring.briefing(made.join(scoring.changes(now, before).select("symbol", "changes"), "symbol"))
    return out.withColumn("alerts", F.concat_ws(" | ", "alerts"))


@query(f"""WITH {_CARD}, n AS (SELECT trend AS label, count(*) AS n FROM c WHERE trend IS NOT NULL GROUP BY trend) SELECT string_agg(n || ' ' ||
    label, ' · ' ORDER BY n DESC, label) AS line FROM n""")
def label_line(spark, d):
    return coverage.label_line(_made_cards(spark, d), "trend")


@query("""SELECT user_id, arg_max(CAST(json_extract(props, '$.k') AS BIGINT), event_id) AS k, count(*) AS n_runs, max(event_id) AS last_run FROM
    events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY user_id""")
def latest_payload(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).where("k is not null")
    return e.groupBy("user_id").agg(F.max_by("k", "event_id").alias("k"), F.count(F.lit(1)).alias("n_runs"), F.max("event_id").alias("last_run"))


# Retrieval


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qv, label FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, round(1
    - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6) + 0.0 AS distance,
    row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), vec_id) AS rank
    FROM embeddings JOIN q USING (label))
    SELECT query_id, vec_id, distance, CAST(rank AS INTEGER) AS rank FROM s WHERE rank <= 5""")
def knn_cosine(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")  # the stated questions; all rows are searched
    return rounded(rag.knn(q, e, 5, "query_id", "vec_id", "embedding", "label"))


@query("""WITH h AS (SELECT item_id % 7 AS g, text FROM benchmark), b AS (SELECT g, lower(string_agg(text, ' ' ORDER BY text)) AS blob FROM h GROUP BY
    g),
    m AS (SELECT item_id, (item_id + item_id % 2) % 7 AS g, [text, 'zzz' || text, lower(text)] AS must FROM benchmark)
    SELECT item_id, round(len(list_filter(must, lambda x: contains(blob, lower(x)))) / 3.0, 6) AS recall FROM m JOIN b USING (g)""")
def rag_recall(spark, d):
    """Expected texts of each item against the texts of a group: its own for even items, the next one for odd items."""
    b, i = table(spark, d, "benchmark"), F.col("item_id")
    hits = b.groupBy((i % 7).alias("g")).agg(F.array_sort(F.collect_list("text")).alias("contents"))
    must = F.array(F.col("text"), F.concat(F.lit("zzz"), F.col("text")), F.lower("text"))
    asked = b.select("item_id", ((i + i % 2) % 7).alias("g"), must.alias("must"))
    return rounded(asked.join(hits, "g").select("item_id", rag.retrieval_score(F.col("contents"), F.col("must"))["recall"].alias("recall")))


@query()
def chunks(spark, d):
    return rag.chunks(table(spark, d, "documents").select("doc_id", "text"))


# Extensions that the engine has at hand: streaming windows on a finished table, grouping sets, set operations


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, {_r('sum(value)', 'total', 4)} FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    return rounded(streams.tumbling(_events(spark, d)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), 4)


@query(f"""WITH w AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s, event_type, value FROM events) SELECT
    CAST(s AS TIMESTAMP) AS window_start, event_type, count(*) AS n, {_r('sum(value)', 'total', 4)} FROM w GROUP BY 1, 2""")
def sliding(spark, d):
    return rounded(streams.sliding(_events(spark, d)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), 4)


@query(f"""WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new
    FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM o)
    SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS session_start, count(*) AS n, {_r('sum(value)', 'total', 4)} FROM g GROUP BY user_id, sid""")
def sessions(spark, d):
    return rounded(streams.sessions(_events(spark, d)).withColumn("session_start", F.col("session_start").cast("timestamp_ntz")), 4)


@query(f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {_r('sum(l_quantity)', 'qty', 2)}, CAST(grouping(l_returnflag) * 2 +
    grouping(l_linestatus) AS BIGINT) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def rollup_cube(spark, d):
    return rounded(table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"),
        F.sum("l_quantity").alias("qty"), F.grouping_id().alias("g")), 2)


@query("""WITH a AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
    SELECT 'both' AS part, o_custkey FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', o_custkey FROM (SELECT * FROM a EXCEPT
    SELECT * FROM b)""")
def set_ops(spark, d):
    o = table(spark, d, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select("o_custkey") for s in ("F", "O"))
    return a.intersect(b).select(F.lit("both").alias("part"), "o_custkey").unionByName(a.subtract(b).select(F.lit("first").alias("part"),
        "o_custkey"))


@query("""SELECT 'semi' AS part, c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'anti', c_custkey FROM
    customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def semi_anti(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").select(F.lit("semi").alias("part"), "c_custkey").unionByName(c.join(o, "c_custkey",
        "left_anti").select(F.lit("anti").alias("part"), "c_custkey"))
