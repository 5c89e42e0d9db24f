"""Named queries for histories, guidance, narration, retrieval and views, each with its SQL; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import sql as sql_functions
from tidemark.operators import analysis, coverage, evaluate, guidance, history, macro, narrative, pit, rag, risk, scoring, text, tiles
from tidemark.plans import runtime
from tidemark.plans.catalog import _BARS, _CARD, _COMMON, _F, _GB, _LOC, _LW, _NEWS, _P, _PORT, _RATIOS, _RET, _SERIES, _SH, _SIG, _SW, _W, AS_OF
from tidemark.plans.catalog import _book, _cards, _event_sql, _made_cards, _r, _signals, _tiles, query, rounded
from tidemark.sources import files, sinks
from tidemark.sources.sinks import replaced_news
from tidemark.sources.surrogates import fundamentals, headlines, holdings, market_prices, prices, region_prices, sectors, table

# Run history: events as runs


def _runs(spark, d):
    e = table(spark, d, "events")
    deep = F.format_string('{"deep": {"headline": "h%d", "bottom_line": "%s"}}', "event_id", "event_type")
    return e.select(
        F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), F.col("ts").alias("run_at"), F.col("event_type").alias("model"),
            (F.col("value") / 1000).alias("cost_usd"),
        F.format_string("%s %d", "event_type", "event_id").alias("one_line"), F.when(F.col("event_id") % 3 == 0,
            deep).otherwise(F.col("props")).alias("payload"), "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


_RUNS = """runs AS (SELECT 'U' || user_id AS symbol, ts AS run_at, event_type AS model, value / 1000 AS cost_usd, event_type || ' ' || event_id AS
    one_line, * FROM events)"""


@query(f"WITH {_RUNS} SELECT symbol, run_at, one_line FROM runs WHERE symbol = 'U8' ORDER BY run_at DESC LIMIT 20")
def run_history(spark, d):
    return history.runs_of(_runs(spark, d), "u8", 20).select("symbol", "run_at", "one_line")


@query(f"WITH {_RUNS} SELECT symbol, run_at, one_line FROM runs ORDER BY run_at DESC, symbol LIMIT 30")
def recent_runs(spark, d):
    return history.recent_runs(_runs(spark, d), 30).select("symbol", "run_at", "one_line")


@query(f"WITH {_RUNS} SELECT symbol, arg_max('h' || event_id || ' — ' || event_type, run_at) AS summary FROM runs WHERE event_id % 3 = 0 GROUP BY symbol")
def deep_summaries(spark, d):
    return history.deep_summaries(_runs(spark, d))


@query(f"WITH {_RUNS} SELECT count(*) AS runs, {_r('sum(coalesce(cost_usd, 0))', 'cost_usd', 4)} FROM runs")
def total_run_cost(spark, d):
    return rounded(history.total_cost(_runs(spark, d)), 4)


@query("""WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT event_id, round((k * 137 + 5.0 * (k * 29 + 3)) / 1e6 + CASE WHEN event_type = 'error' THEN (k * 400 + 5.0 * 21) / 1e6 + 0.02 ELSE 0 END, 4)
    AS cost_usd FROM e""")
def run_costs(spark, d):
    k, searched = F.col("k"), F.col("model") == "error"
    cost = history.run_cost(k * 137, k * 29 + 3, k * 400, F.lit(21), searched, 1.0, 5.0)
    return _runs(spark, d).select("event_id", cost.alias("cost_usd"))


@query("""SELECT url, coalesce(nullif(arg_min(coalesce(nullif(CASE WHEN page_id % 3 <> 0 THEN 'page ' || page_id END, ''), url), page_id), ''), url)
    AS title, min(page_id) AS ord
    FROM pages WHERE url IS NOT NULL AND url <> '' GROUP BY url""")
def web_sources(spark, d):
    title = F.when(F.col("page_id") % 3 != 0, F.format_string("page %d", "page_id"))
    return history.web_sources(table(spark, d, "pages").select("url", title.alias("title"), F.col("page_id").alias("ord")))


# Guidance: documents as records of what was promised


def _records(spark, d):
    n = headlines(spark, d)
    i = F.col("doc_id") % 4
    data = (
        F.when(i == 1, F.format_string('{"revenue_outlook": "grow %d"}', "doc_id"))
        .when(i == 2, F.lit('{"other_guidance": ["capex up", "hiring"], "revenue_outlook": ""}'))
        .when(i == 3, F.lit('{"margin_outlook": "stable"}')).otherwise(F.lit("{}"))
    )
    return n.select("symbol", F.col("publisher").alias("source"), F.col("published").alias("period"), F.col("doc_id").alias("extracted_at"),
        data.alias("data"))


def _filings(spark, d):
    n = headlines(spark, d)
    return n.select("symbol", F.col("publisher").alias("source"), F.when(F.col("doc_id") % 2 == 0, F.col("published")).alias("filing_date"))


_DATA = """CASE doc_id % 4 WHEN 1 THEN '{"revenue_outlook": "grow ' || doc_id || '"}' WHEN 2 THEN
    '{"other_guidance": ["capex up", "hiring"], "revenue_outlook": ""}'
    WHEN 3 THEN '{"margin_outlook": "stable"}' ELSE '{}' END"""
_KNOWN = f"""{_NEWS}, gd AS (SELECT symbol, publisher AS source, doc_id, published AS period, {_DATA} AS data FROM news),
    fl AS (SELECT symbol, publisher AS source, max(published) AS filed FROM news WHERE doc_id % 2 = 0 GROUP BY ALL)"""


@query(f"""WITH {_KNOWN}, k AS (SELECT gd.*, row_number() OVER (PARTITION BY symbol ORDER BY period DESC NULLS LAST, doc_id DESC) AS rn FROM gd LEFT
    JOIN fl USING (symbol, source)
    WHERE coalesce(filed, period + 45) <= DATE '2024-12-15') SELECT symbol, source, doc_id AS extracted_at, period, data FROM k WHERE rn = 1""")
def known_guidance(spark, d):
    return guidance.latest_guidance(_records(spark, d), _filings(spark, d), "2024-12-15")


@query(f"""WITH {_KNOWN} SELECT symbol, source, doc_id AS extracted_at, period,
    CASE WHEN data = '{{}}' THEN '{{"source":"' || source || '","period":"' || period || '"}}' ELSE '{{"source":"' || source || '","period":"' ||
    period || '",' || data[2:] END AS record
    FROM gd LEFT JOIN fl USING (symbol, source) WHERE symbol = 'S3' AND coalesce(filed, period + 45) <= DATE '2024-12-15' ORDER BY period DESC NULLS
    LAST, doc_id DESC LIMIT 1""")
def guidance_of_one(spark, d):
    one = guidance.guidance_of(_records(spark, d), _filings(spark, d), "s3", "2024-12-15")
    return one.select("symbol", "source", "extracted_at", "period", guidance.merged_record(F.col("data"), F.col("source"),
        F.col("period")).alias("record"))


_HIST = f"""{_KNOWN}, hi AS (SELECT symbol, doc_id, period, CASE WHEN doc_id % 4 = 1 THEN 'grow ' || doc_id END AS revenue_outlook, CASE WHEN doc_id %
    4 = 3 THEN 'stable' END AS margin_outlook,
    CASE WHEN doc_id % 4 = 2 THEN 2 END AS n_other, row_number() OVER (PARTITION BY symbol ORDER BY period NULLS LAST, doc_id) AS nth
    FROM gd WHERE doc_id % 4 <> 0 AND (period IS NULL OR period <= DATE '2024-10-01'))"""


@query(f"WITH {_HIST} SELECT symbol, nth, doc_id AS extracted_at, period, revenue_outlook, margin_outlook, n_other FROM hi")
def guidance_history(spark, d):
    out = guidance.guidance_history(_records(spark, d), "2024-10-01")
    return out.select("symbol", F.col("nth").cast("long").alias("nth"), "extracted_at", "period", "revenue_outlook", "margin_outlook",
        F.size("other_guidance").alias("n_other")).withColumn(
        "n_other", F.when(F.col("n_other") >= 0, F.col("n_other"))
    )


@query(f"""WITH {_HIST}, {_F}, g AS (SELECT CAST(CAST(substr(symbol, 2) AS INTEGER) + 1 AS VARCHAR) AS symbol, count(*) AS n_guidance,
    string_agg('period ' || coalesce(CAST(period AS VARCHAR), 'unknown')
    || coalesce(' | revenue_outlook=' || revenue_outlook, '') || coalesce(' | margin_outlook=' || margin_outlook, '') || CASE WHEN n_other = 2 THEN
    ' | other=capex up; hiring' ELSE '' END, chr(10) ORDER BY nth) AS promised
    FROM hi GROUP BY symbol),
    l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS back FROM q),
    a AS (SELECT symbol, string_agg(period_end || ': revenue ₹' || format('{{:,.0f}}', total_revenue * 1e4 / 1e7) || 'cr, net income ₹' ||
    format('{{:,.0f}}', net_income * 1e4 / 1e7) || 'cr', chr(10) ORDER BY period_end) AS actual
    FROM l WHERE back <= 8 GROUP BY symbol) SELECT symbol, n_guidance, promised, coalesce(actual, '') AS actual FROM g LEFT JOIN a USING (symbol)""")
def promised_and_actual(spark, d):
    told = guidance.guidance_history(_records(spark, d), "2024-10-01")
    told = told.withColumn("symbol", (F.substring("symbol", 2, 9).cast("int") + 1).cast("string"))
    quarters = fundamentals(spark, d).withColumns({c: F.col(c) * 1e4 for c in ("total_revenue", "net_income")})
    out = guidance.promised_and_actual(told, guidance.actuals(quarters))
    lines = F.transform("actual", lambda x: F.regexp_replace(x, ", net margin .*$", ""))
    return out.select("symbol", "n_guidance", F.concat_ws("\n", "promised").alias("promised"), F.concat_ws("\n", lines).alias("actual"))


# A book's risk as it is shown

_MKT = f"""mp AS (SELECT {_BARS} FROM lineitem GROUP BY CAST(l_shipdate AS DATE)), md AS (SELECT date, adj_close / lag(adj_close) OVER (ORDER BY date)
    - 1 AS m FROM mp)"""
_BETA = """bt AS (SELECT symbol, regr_slope(ret, m) * 0.67 + 0.33 AS beta FROM rets JOIN md USING (date) WHERE ret IS NOT NULL AND m IS NOT NULL GROUP
    BY symbol HAVING count(*) >= 60)"""


@query(f"WITH {_RET}, {_W}, {_MKT}, {_BETA} SELECT {_r('sum(weight * beta)', 'beta')} FROM bt JOIN wts USING (symbol)")
def portfolio_beta(spark, d):
    _, w, r = _book(spark, d)
    return rounded(risk.portfolio_beta(risk.betas(r, risk.returns(market_prices(spark, d)).select("date", "ret")), w))


@query(f"""WITH {_COMMON}, {_W}, {_PORT}, q AS (SELECT quantile_cont(ret, 0.01) AS q FROM port)
    SELECT 'weekly' AS horizon, {_r('-max(q) * sqrt(5) * 100', 'var_99_pct')}, {_r('-avg(ret) FILTER (ret <= q) * sqrt(5) * 100', 'cvar_99_pct')},
    {_r('-max(q) * 100', 'var_99_1d_pct')} FROM port, q""")
def horizon_risk(spark, d):
    _, w, r = _book(spark, d)
    days, label = risk.horizon("w")
    tail = risk.var_cvar(risk.portfolio_returns(r, w), 0.99)
    scaled = [(risk.at_horizon(F.col(c), days) * 100).alias(f"{c}_99_pct") for c in ("var", "cvar")]
    return rounded(tail.select(F.lit(label).alias("horizon"), *scaled, (F.col("var") * 100).alias("var_99_1d_pct")))


@query(f"""WITH {_LW}, {_W}, {_SH}, {_MKT}, {_BETA}, sw AS (SELECT a, sum(cov * weight) AS sw FROM sh JOIN wts ON b = symbol GROUP BY a), tot AS
    (SELECT sum(weight * sw) AS pv FROM sw JOIN wts ON a = symbol),
    c AS (SELECT symbol, arg_min(close, date) AS cost FROM rp GROUP BY symbol), o AS (SELECT wts.symbol, weight * sw / pv * 100 AS rc, beta, (lc /
    cost - 1) * 100 AS pnl FROM sw JOIN wts ON a = wts.symbol, tot, c, bt
    WHERE c.symbol = wts.symbol AND bt.symbol = wts.symbol)
    SELECT symbol, {_r('rc', 'risk_contribution_pct')}, {_r('beta')}, {_r('pnl', 'unrealised_pct', 4)}, row_number() OVER (ORDER BY rc DESC, symbol)
    AS place FROM o""")
def positions_by_risk(spark, d):
    """Positions as listed, with their place in the list."""
    p, w, r = _book(spark, d)
    shares = tiles.risk_contribution(tiles.shrunk(_tiles(r)), w).select("symbol", "risk_contribution_pct")
    beta = risk.betas(r, risk.returns(market_prices(spark, d)).select("date", "ret"))
    pnl = w.select("symbol", risk.unrealised_pct(F.col("last_close"), F.col("avg_cost")).alias("unrealised_pct"))
    placed = analysis.placed(shares.join(beta, "symbol", "left").join(pnl, "symbol", "left"))
    places = {"risk_contribution_pct": 6, "beta": 6, "unrealised_pct": 4}
    return placed.withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in places.items()}).select("symbol", *places, "place")


@query(f"""WITH {_SW}, s AS (SELECT sector, sum(weight) * 100 AS w FROM hw GROUP BY sector) SELECT row_number() OVER (ORDER BY w DESC, sector) AS
    place, sector, {_r('w', 'weight_pct')} FROM s""")
def sectors_by_weight(spark, d):
    by = macro.by_weight(macro.sector_weights(macro.weights(holdings(spark, d), prices(spark, d)), sectors(spark, d)))
    return rounded(by.coalesce(1).select((F.monotonically_increasing_id() + 1).alias("place"), "sector", "weight_pct"))


@query(f"""WITH {_SIG}, {_LOC}, k AS (SELECT signal, symbol, date, sig, r_name AS sector FROM sig JOIN loc ON symbol = CAST(s_suppkey AS VARCHAR)
    WHERE r_name <> 'AFRICA')
    SELECT signal, symbol, date, {_r('sig - avg(sig) OVER (PARTITION BY signal, date, sector)', 'sig')} FROM k""")
def sector_neutral_known(spark, d):
    """Names without a sector on file are left out."""
    known = sectors(spark, d).withColumn("sector", F.when(F.col("sector") != "AFRICA", F.col("sector")))
    return rounded(evaluate.sector_neutral(_signals(spark, d), known).select("signal", "symbol", "date", "sig"))


@query(f"""WITH {_RET}, b AS (SELECT symbol, date, adj_close AS p, last_value(adj_close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM rp)
    SELECT symbol, date, {_r('p / base - 1', 'ret')} FROM b""")
def padded_returns(spark, d):
    """Simple returns that span the gaps of a panel."""
    return rounded(risk.returns(region_prices(spark, d), gap_fill="pad").select("symbol", "date", "ret"))


# News


@query(f"WITH {_NEWS} SELECT symbol, published, title FROM news ORDER BY published DESC NULLS LAST, symbol, title NULLS FIRST LIMIT 200")
def news_feed(spark, d):
    return text.feed(headlines(spark, d).select("symbol", "published", "title"), 200)


@query(f"WITH {_NEWS} SELECT symbol, published, title, {_r('polarity', places=3)} FROM news WHERE published IS NOT NULL")
def polarity_timeline(spark, d):
    n = headlines(spark, d).withColumn("polarity", text.polarity(F.col("text")))
    return rounded(text.polarity_line(n.select("symbol", "published", "title", "polarity")), 3)


@query(f"""WITH {_NEWS}, o AS (SELECT symbol, title, CAST(published AS TIMESTAMP) AS published FROM news), n AS (SELECT CASE WHEN doc_id % 10 < 3 THEN
    symbol ELSE 'N' END AS symbol, trim(title, ' ')[1:500] AS title,
    CAST(published AS TIMESTAMP) AS published FROM news WHERE title IS NOT NULL), s AS (SELECT symbol, title, max(published) AS published FROM n WHERE
    title <> '' GROUP BY symbol, title)
    SELECT symbol, title, published FROM o WHERE symbol NOT IN (SELECT symbol FROM s) UNION ALL SELECT * FROM s""")
def news_replaced(spark, d):
    """News of some symbols fetched anew, and of a new one."""
    n = headlines(spark, d)
    old = n.select("symbol", "title", F.col("published").cast("timestamp").alias("published"))
    new = n.select(F.when(F.col("doc_id") % 10 < 3, F.col("symbol")).otherwise("N").alias("symbol"), "title",
        F.col("published").cast("string").alias("published"))
    return replaced_news(old, new).select("symbol", "title", F.col("published").cast("timestamp_ntz").alias("published"))


# Texts and views


@query(f"""WITH {_P}, {_F}, {_NEWS}, h AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier WHERE s_acctbal > 0)
    SELECT (SELECT count(*) FROM h) AS n_holdings, (SELECT count(DISTINCT date) FROM prices) AS price_rows, (SELECT count(DISTINCT symbol) FROM q
    WHERE symbol IN (SELECT symbol FROM h)) AS n_fundamentals,
    (SELECT count(DISTINCT CAST(doc_id % 100 AS VARCHAR)) FROM news WHERE CAST(doc_id % 100 AS VARCHAR) IN (SELECT symbol FROM h)) AS n_sentiment""")
def provenance(spark, d):
    news = headlines(spark, d).select((F.col("doc_id") % 100).cast("string").alias("symbol"))
    return narrative.provenance(holdings(spark, d).select("symbol"), prices(spark, d), fundamentals=fundamentals(spark, d), sentiment=news)


_N = lambda x: f"coalesce(CAST({x} AS VARCHAR), 'None')"
_SENT = "CASE WHEN mp > 0.15 THEN 'positive' WHEN mp < -0.15 THEN 'negative' WHEN mp IS NOT NULL THEN 'neutral' END"


def _full_cards(spark, d):
    return _made_cards(spark, d).withColumn("last_close", F.lit(None).cast("double"))


@query(f"""WITH {_CARD} SELECT symbol, concat_ws(chr(10), symbol || ' ₹None sector=None', 'TECH: trend=' || {_N('trend')} || ' mom=' ||
    {_N('momentum')} || '(RSI None) level=' || {_N('level')},
    CASE WHEN CAST(symbol AS BIGINT) % 3 <> 2 THEN 'FUND: rev None · earn ' || {_N('eg')} || ' (NI YoY None%) · margin ' || {_N('mt')} END,
    'OWN: inst ' || {_N('ip')} || '%',
    'NEWS: ' || {_N(_SENT)} || ' (5 headlines)') AS digest FROM c""")
def digests(spark, d):
    return narrative.digest(_full_cards(spark, d))


@query(f"""WITH {_CARD} SELECT symbol, concat_ws('; ', CASE WHEN trend IS NOT NULL THEN 'technically ' || trend || '/' || {_N('momentum')} || ' at '
    || {_N('level')} END,
    CASE WHEN CAST(symbol AS BIGINT) % 3 <> 2 THEN 'fundamentals None rev / ' || {_N('eg')} || ' earnings / ' || {_N('mt')} || ' margins' END, {_SENT}
    || ' news') || '.' AS verdict FROM c""")
def verdict_lines(spark, d):
    return narrative.verdict_line(_full_cards(spark, d))


@query(f"""WITH {_CARD} SELECT symbol, trend, momentum, CAST(NULL AS DOUBLE) AS risk_contribution_pct, CAST(NULL AS DOUBLE) AS sector_weight_pct, ip
    AS institutional_pct FROM c WHERE symbol = '42'""")
def single_name(spark, d):
    one = narrative.single_name(_full_cards(spark, d), "42")
    return one.select("symbol", "trend", "momentum", "risk_contribution_pct", "sector_weight_pct", "institutional_pct")


@query(f"WITH {_CARD} SELECT symbol, row_number() OVER (ORDER BY rc DESC NULLS LAST, symbol) AS place FROM c")
def ranked_cards(spark, d):
    return analysis.placed(_made_cards(spark, d)).select("symbol", "place")


@query(f"WITH {_P} SELECT symbol, count(*) AS n_rows FROM prices WHERE contains(lower(symbol), '1') GROUP BY symbol")
def coverage_search(spark, d):
    return coverage.matching(coverage.data_check(prices(spark, d)), "1").select("symbol", "n_rows")


@query("""SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN '+' ELSE '' END || format('{:,.1f}', c_acctbal) || '%', '—') AS shown,
    CASE WHEN abs(c_acctbal) / 100 >= 66 THEN 'high' WHEN abs(c_acctbal) / 100 >= 40 THEN 'medium' ELSE 'low' END AS attention_class,
    CAST(greatest(0.0, 100 - c_nationkey * 3 - c_custkey % 50) AS DOUBLE) AS public_float FROM customer""")
def displayed_values(spark, d):
    x = F.col("c_acctbal")
    left = narrative.shares_left((F.col("c_nationkey") * 3).cast("double"), (F.col("c_custkey") % 50).cast("double"))
    c = table(spark, d, "customer")
    return rounded(c.select("c_custkey", narrative.displayed(x, 1, "%", True).alias("shown"),
        narrative.level(F.abs(x) / 100).alias("attention_class"), left.alias("public_float")))


@query("""SELECT c_custkey, round(CASE WHEN c_custkey - 500 > 0 THEN (c_acctbal / (c_custkey - 500) - 1) * 100 END, 6) + 0.0 AS growth, CASE WHEN
    c_acctbal / 100 >= 15 THEN 'strong' WHEN c_acctbal / 100 >= 5 THEN 'growing'
    WHEN c_acctbal / 100 >= -5 THEN 'flat' ELSE 'declining' END AS bucket, round(abs(c_acctbal) - 0.006, 6) + 0.0 AS net FROM customer""")
def sql_functions_used(spark, d):
    """The engine's functions by name in SQL."""
    sql_functions.register(spark)
    table(spark, d, "customer").createOrReplaceTempView("tm_customer")
    body = "tm_growth_pct(c_acctbal, c_custkey - 500) AS growth, tm_growth_bucket(c_acctbal / 100) AS bucket, tm_net_spread(c_acctbal, 15D) AS net"
    return rounded(spark.sql(f"SELECT c_custkey, {body} FROM tm_customer"))


# Retrieval: from questions to evidence

_HITS = """qs AS (SELECT vec_id AS question, embedding AS qv, label AS ql FROM embeddings WHERE vec_id % 20 = 0),
    ds AS (SELECT question, ql, vec_id, label, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])) AS distance FROM
    embeddings, qs),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(distance, 12), vec_id) AS rank FROM ds) WHERE rank <=
    3)"""


def _hits(spark, d):
    """The three nearest vectors of each question: every twentieth vector is one, and all are searched."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), "embedding")
    return rag.knn(asked, e, 3, "question", "vec_id", "embedding").join(e.select("vec_id", "label"), "vec_id")


@query(f"WITH {_HITS} SELECT question, CAST(max(CASE WHEN label = (ql + question) % 10 THEN 1.0 ELSE 0 END) AS DOUBLE) AS recall FROM hits GROUP BY question")
def golden_recall(spark, d):
    """Questions searched for and scored in one flow: the text expected names a label, the texts found name theirs."""
    name = lambda x: F.format_string("about label %d here", x)
    found = _hits(spark, d).groupBy("question").agg(F.collect_list(name(F.col("label"))).alias("contents"))
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"),
        F.array(name(((F.col("label") + F.col("vec_id")) % 10).cast("int"))).alias("must"))
    return rounded(asked.join(found, "question").select("question", rag.retrieval_score(F.col("contents"), F.col("must"))["recall"].alias("recall")))


@query(f"""WITH {_HITS}, b AS (SELECT question, min(distance) AS best FROM hits GROUP BY question)
    SELECT question, 'as said in [2], [9] and [' || question % 5 || ']' AS answer, CASE WHEN question % 5 IN (1, 3) THEN '2,' || question % 5 ELSE '2'
    END AS citations, {_r('best')}, best > 0.45 AS weak FROM b""")
def cited_answers(spark, d):
    """Answers held to their evidence: citations beyond the hits go, and evidence that is far is marked."""
    hits = _hits(spark, d)
    said = hits.select("question").distinct().withColumn("answer", F.format_string("as said in [2], [9] and [%d]", F.col("question") % 5))
    out = rag.answered(hits, said).withColumn("citations", F.concat_ws(",", F.col("citations").cast("array<string>")))
    return rounded(out.select("question", "answer", "citations", "best", "weak"))


@query(f"""WITH {_HITS}, g AS (SELECT label AS source, vec_id AS chunk_index, round(arg_min(distance, question), 9) + 0.0 AS distance FROM hits GROUP
    BY ALL)
    SELECT source, chunk_index, {_r('distance')} FROM g ORDER BY g.distance, source, chunk_index LIMIT 6""")
def gathered_hits(spark, d):
    hits = _hits(spark, d).select("question", F.col("label").alias("source"), F.col("vec_id").alias("chunk_index"),
        (F.round("distance", 9) + F.lit(0.0)).alias("distance"))
    return rounded(rag.gather(hits, 6))


# Small reads and views


@query(f"""WITH {_P} SELECT symbol, date, {_r('close')}, {_r('adj_close')}, volume FROM prices
    WHERE symbol IN ('1', '2', '3') AND date <= DATE '{AS_OF}'""")
def panel_of_symbols(spark, d):
    return rounded(pit.panel(prices(spark, d), AS_OF, ["1", "2", "3"]))


@query(f"""WITH {_NEWS}, e AS (SELECT symbol, doc_id, polarity, {_event_sql('lower(text)')} AS event FROM news)
    SELECT symbol, doc_id, event FROM e WHERE symbol = 'S4' AND sign(polarity) = 0 AND event IS NOT NULL""")
def newsroom(spark, d):
    """Catalysts of one name that are neither good nor bad news."""
    n = headlines(spark, d).withColumns({"polarity": text.polarity(F.col("text")), "event": text.event_class(F.col("text"))})
    return text.newsroom(n, "S4", 0, catalysts_only=True).select("symbol", "doc_id", "event")


@query(f"""WITH {_P}, n AS (SELECT symbol, count(*) AS n FROM prices GROUP BY symbol)
    SELECT symbol, concat_ws('; ', CASE WHEN n < 252 THEN 'only ' || n || ' observations for VaR' END,
    CASE WHEN n % 97 < 60 THEN 'only ' || n % 97 || ' observations for covariance' END) AS warnings FROM n""")
def data_warnings(spark, d):
    n = prices(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return n.select("symbol", F.concat_ws("; ", risk.data_warnings(F.col("n"), F.col("n") % 97)).alias("warnings"))


@query("SELECT 'U' || user_id AS symbol, false AS this_hour, true AS this_century FROM events GROUP BY user_id")
def freshness(spark, d):
    e = _runs(spark, d).select("symbol", F.col("run_at").cast("timestamp").alias("ingested_at"))
    hour, century = sinks.is_fresh(e, 1), sinks.is_fresh(e, 876_000)
    return hour.select("symbol", F.col("fresh").alias("this_hour")).join(century.select("symbol", F.col("fresh").alias("this_century")), "symbol")


@query("""WITH h AS (SELECT 'U' || user_id AS symbol, event_type AS trend, value AS attention, ts AS run_at FROM events)
    SELECT symbol, arg_max(trend, run_at) AS trend, round(arg_max(attention, run_at), 6) + 0.0 AS attention FROM h GROUP BY symbol""")
def prior_snapshots(spark, d):
    """The last snapshot of every name at once."""
    e = table(spark, d, "events")
    runs = e.select(F.concat(F.lit("U"), "user_id").alias("symbol"), F.col("event_type").alias("trend"), F.col("value").alias("attention"),
        F.col("ts").alias("run_at"))
    return rounded(scoring.latest_snapshots(runs))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'SYM' || c_custkey || '.NS' ELSE 'sym' || c_custkey || '.bo' END AS symbol,
    CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'SYM' || c_custkey END AS name FROM customer""")
def company_names(spark, d):
    """Names on file, else the symbol without its exchange."""
    k = F.col("c_custkey")
    symbol = F.when(k % 3 == 0, F.format_string("SYM%d.NS", k)).otherwise(F.format_string("sym%d.bo", k))
    c = table(spark, d, "customer").withColumn("symbol", symbol)
    known = c.select("symbol", F.when(k % 3 == 0, F.col("c_name")).alias("name"))
    return files.company_names(c.select("c_custkey", "symbol"), known).select("c_custkey", "symbol", "name")


@query("""SELECT event_id, 'h' || event_id AS headline, event_type AS publisher FROM events
    UNION ALL SELECT event_id, 'second', NULL FROM events WHERE event_type = 'click'""")
def news_in_replies(spark, d):
    """Items read out of a model's reply, with prose around them and items that are none."""
    second = F.when(F.col("event_type") == "click", F.lit('{"headline": "second"}')).otherwise(F.lit('{"title": "no headline"}'))
    reply = F.format_string('Here you are:\n[{"headline": "h%d", "publisher": "%s"}, %s]\nThat is all.', "event_id", "event_type", second)
    items = F.explode(sinks.parse_news(reply)).alias("item")
    return table(spark, d, "events").select("event_id", items).select("event_id", "item.headline", "item.publisher")


@query("""WITH a AS (SELECT n_name AS symbol, 0 AS list, n_nationkey AS ord FROM nation), b AS (SELECT upper(r_name) AS symbol, 1 AS list, r_regionkey AS ord FROM region),
    u AS (SELECT symbol, min({'list': list, 'ord': ord}) AS first_at FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT symbol, 2, ord FROM a) GROUP BY symbol)
    SELECT symbol, row_number() OVER (ORDER BY first_at) AS place FROM u""")
def universe(spark, d):
    """Three lists as one, each symbol where it first appears."""
    a = table(spark, d, "nation").select(F.col("n_name").alias("symbol"), F.col("n_nationkey").alias("ord"))
    b = table(spark, d, "region").select(F.upper("r_name").alias("symbol"), F.col("r_regionkey").alias("ord"))
    return files.universe(a, b, a).coalesce(1).select("symbol", (F.monotonically_increasing_id() + 1).alias("place"))


_CALLS = """calls AS (SELECT event_type || '-large' AS model, CAST(json_extract(props, '$.k') AS BIGINT) * 10 AS input_tokens, CAST(json_extract(props, '$.k') AS BIGINT) AS output_tokens, value AS latency_ms FROM events),
    priced AS (SELECT *, CASE WHEN model LIKE 'click%' THEN input_tokens / 1e6 * 3 + output_tokens / 1e6 * 15 WHEN model LIKE 'error%' THEN input_tokens / 1e6 * 1 + output_tokens / 1e6 * 5 END AS cost FROM calls)"""


@query(f"""WITH {_CALLS} SELECT count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    {_r('sum(latency_ms)', 'latency_ms', 2)}, {_r('sum(cost)', 'cost')}, bool_and(cost IS NOT NULL) AS complete FROM priced""")
def trace_totals(spark, d):
    """Calls priced by the longest prefix of their model's name; models without a price leave the total incomplete."""
    e, k = table(spark, d, "events"), F.get_json_object("props", "$.k").cast("bigint")
    calls = e.select(F.concat("event_type", F.lit("-large")).alias("model"), (k * 10).alias("input_tokens"), k.alias("output_tokens"),
        F.col("value").alias("latency_ms"))
    rates = spark.createDataFrame([("cl", 9.0, 9.0), ("click", 3.0, 15.0), ("error-", 1.0, 5.0)], "prefix string, per_m_in double, per_m_out double")
    out = runtime.trace_summary(runtime.priced(calls, rates))
    return out.withColumns({"latency_ms": F.round("latency_ms", 2) + F.lit(0.0), "cost": F.round("cost", 6) + F.lit(0.0)})


# Cards


_TRENDS = f"""{_P}, {_SERIES}, te AS (SELECT symbol, close AS last_close, CASE WHEN sma200 IS NOT NULL THEN CASE WHEN abs(close / sma200 - 1) < 0.02 THEN 'sideways' WHEN close > sma200 THEN 'uptrend' ELSE 'downtrend' END
    WHEN sma50 IS NOT NULL THEN CASE WHEN close > sma50 THEN 'uptrend' ELSE 'downtrend' END ELSE '—' END AS trend FROM ser WHERE back = 1 AND (SELECT count(*) FROM prices p WHERE p.symbol = ser.symbol) >= 30)"""


@query(f"""WITH {_TRENDS}, {_LOC}, hw AS (SELECT symbol, s_acctbal * lc AS mv, s_acctbal * lc / sum(s_acctbal * lc) OVER () AS weight, r_name AS sector
    FROM (SELECT symbol, arg_max(close, date) AS lc FROM prices GROUP BY symbol) JOIN loc ON symbol = CAST(s_suppkey AS VARCHAR) WHERE s_acctbal > 0),
    ma AS (SELECT symbol, weight * 100 AS weight_pct, sector, sum(weight) OVER (PARTITION BY sector) * 100 AS sector_weight_pct FROM hw), {_RATIOS},
    fu AS (SELECT symbol, period_end AS latest_quarter, {_GB('net_income_yoy_pct')} AS earnings_growth FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period_end DESC) AS n, count(*) OVER (PARTITION BY symbol) AS k FROM rat) WHERE n = 1 AND k >= 2),
    {_NEWS}, se AS (SELECT CAST(doc_id % 100 AS VARCHAR) AS symbol, count(*) AS n_articles, avg(polarity) AS mean_polarity FROM news GROUP BY 1)
    SELECT symbol, {_r('last_close', places=4)}, trend, {_r('weight_pct', places=4)}, latest_quarter, earnings_growth, sector, {_r('sector_weight_pct', places=4)}, n_articles, {_r('mean_polarity', places=4)}
    FROM te LEFT JOIN ma USING (symbol) LEFT JOIN fu USING (symbol) LEFT JOIN se USING (symbol)""")
def card_fields(spark, d):
    """Cards of all names with a technical reading, the other readings joined on."""
    fields = ("symbol", "last_close", "trend", "weight_pct", "latest_quarter", "earnings_growth", "sector", "sector_weight_pct",
        "n_articles", "mean_polarity")
    return rounded(_cards(spark, d).select(*fields), 4)


_PCT = lambda x: f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


@query(f"""WITH {_CARD} SELECT symbol, array_to_string(list_filter([CASE WHEN rc >= 40 THEN 'top risk contributor — ' || {_PCT('rc')} || '% of book risk (≥ 40% limit)' WHEN rc >= 25 THEN {_PCT('rc')} || '% of book risk' END,
    CASE WHEN momentum IN ('overbought', 'oversold') THEN momentum END, CASE WHEN trend = 'downtrend' THEN 'in a downtrend' END, CASE WHEN mt = 'contracting' THEN 'margins contracting' END,
    CASE WHEN sw >= 40 THEN 'sector is ' || {_PCT('sw')} || '% of the book' END, CASE WHEN abs(mp) >= 0.3 THEN {_SENT} || ' news flow (5 headlines)' END,
    CASE WHEN ip >= 70 OR ip <= 15 THEN 'institutional holding ' || {_PCT('ip')} || '%' END], lambda x: x IS NOT NULL)[1:4], ' | ') AS drivers FROM c""")
def attention_drivers(spark, d):
    return scoring.attention(_made_cards(spark, d)).select("symbol", F.concat_ws(" | ", "drivers").alias("drivers"))


@query(f"""WITH {_CARD} SELECT symbol, coalesce(rc >= 40, false) OR coalesce(trend = 'downtrend' AND level = 'near lows', false) OR coalesce(eg = 'declining', false)
    OR coalesce(mt = 'contracting', false) OR coalesce(mp < -0.15, false) AS flagged FROM c""")
def briefing_flags(spark, d):
    """Which names a briefing flags; its order is tested elsewhere."""
    made = scoring.confidence(scoring.attention(_made_cards(spark, d)))
    return scoring.briefing(made).select("symbol", "flagged")


@query(f"""WITH {_CARD} SELECT symbol, CAST(round((coalesce(CASE WHEN rc IS NOT NULL THEN round(greatest(0.0, least(100.0, 100 * rc / 40)), 1) END, 0) * 2 + coalesce(CASE WHEN sw IS NOT NULL THEN round(greatest(0.0, least(100.0, 100 * sw / 40)), 1) END, 0))
    / nullif((rc IS NOT NULL)::INT * 2 + (sw IS NOT NULL)::INT, 0) + 1e-9, 1) AS DOUBLE) AS attention FROM c""")
def attention_reweighted(spark, d):
    """Attention by weights of one's own: the book's risk twice, its sector once, nothing else."""
    own = {"risk": 2.0, "macro": 1.0, "technical": 0.0, "fundamental": 0.0, "sentiment": 0.0, "ownership": 0.0}
    return scoring.attention(_made_cards(spark, d), own).select("symbol", "attention")


@query(f"""WITH {_CARD} SELECT symbol, CASE WHEN mt = 'expanding' AND mp > 0.5 THEN 'margins and news both up' END AS alert FROM c""")
def own_alert_rules(spark, d):
    """Alerts by a rule of one's own."""
    rule = F.when((F.col("margin_trend") == "expanding") & (F.col("mean_polarity") > 0.5), F.lit("margins and news both up"))
    return scoring.alerts(_made_cards(spark, d), [rule]).select("symbol", F.get("alerts", F.lit(0)).alias("alert"))
