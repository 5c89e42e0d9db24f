"""Schemas of the stored tables, as DDL. No inference; new columns come in by mergeSchema."""

PRICES = "symbol string, date date, open double, high double, low double, close double, adj_close double, volume bigint, ingested_at timestamp"
FUNDAMENTALS = "symbol string, period_end date, total_revenue double, operating_income double, net_income double, gross_profit double, ingested_at timestamp"
SECURITY_META = "symbol string, sector string, industry string, name string"
DOC_CHUNKS = "symbol string, source string, chunk_index int, content string, embedding array<float>, period date, filing_date date, source_url string, ingested_at timestamp"
GUIDANCE_DATA = "struct<revenue_outlook: string, margin_outlook: string, demand_commentary: string, other_guidance: array<string>, quotes: array<string>>"
GUIDANCE = f"symbol string, source string, period date, data {GUIDANCE_DATA}, extracted_at timestamp"
SENTIMENT = "symbol string, title string, publisher string, published timestamp, polarity double"
OWNERSHIP = "symbol string, held_pct_institutions double, held_pct_insiders double, n_institutions int, snapshot_at timestamp"
SNAPSHOT_PAYLOAD = "struct<attention: double, trend: string, momentum: string, level: string, revenue_growth: string, earnings_growth: string, margin_trend: string, sentiment: string, institutional: string, risk_contribution_pct: double>"
RUN_SNAPSHOTS = f"symbol string, as_of date, run_at timestamp, payload {SNAPSHOT_PAYLOAD}"
PRICE_VINTAGES = "symbol string, date date, vintage_date date, close double, adj_close double, volume bigint"
ANALYST_RUNS = "symbol string, run_at timestamp, model string, cost_usd double, one_line string, payload string"
POSITIONS = "symbol string, quantity double, avg_cost double"
