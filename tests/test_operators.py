"""Unit vectors of the analytics operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ewm import terminal_macd, terminal_rsi
from tidemark.functions.windows import average_rank
from tidemark.operators import coverage, evaluate, fundamental, macro, pit, rag, risk, scoring, technical, text
from tidemark.plans import runtime
from tidemark.sources import files, sinks

DAY = dt.date(2024, 1, 1)


def days(n):
    return [DAY + dt.timedelta(i) for i in range(n)]


def series(spark, values, symbol="A"):
    return spark.createDataFrame([(symbol, d, float(v), float(v), 1000) for d, v in zip(days(len(values)), values)],
        "symbol string, date date, close double, adj_close double, volume bigint")


def test_technical_dials(spark):
    up = technical.technical(series(spark, range(1, 260))).first()
    assert (up.trend, up.momentum, up.level, up.rsi_14, up.volume_trend) == ("uptrend", "overbought", "at highs", 100.0, "flat")
    assert technical.technical(series(spark, range(1, 11))).count() == 0
    one = technical.technical(series(spark, range(1, 61))).first()
    assert one.sma20 == 50.5 and one.sma200 is None and one.ret_1m_pct == pytest.approx((60 / 39 - 1) * 100)
    assert technical.technical(series(spark, range(60, 1, -1))).first().rsi_14 == 0


def test_folds_equal_pandas(spark):
    x = pd.Series(np.random.default_rng(0).normal(100, 5, 80))
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    m = df.select(terminal_macd(F.col("x")).alias("m"), terminal_rsi(F.col("x")).alias("r")).first()
    line = x.ewm(span=12, adjust=False).mean() - x.ewm(span=26, adjust=False).mean()
    assert m.m.macd == pytest.approx(line.iloc[-1]) and m.m.signal == pytest.approx(line.ewm(span=9, adjust=False).mean().iloc[-1])
    d = x.diff()
    up, down = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean().iloc[-1], (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean().iloc[-1]
    assert m.r == pytest.approx(100 - 100 / (1 + up / down))


def test_fundamental_growth(spark):
    rows = [("A", dt.date(2024, 3, 31), 100.0, 10.0, -100.0), ("A", dt.date(2024, 6, 30), 110.0, 11.0, 10.0), ("A", dt.date(2024, 12, 31),
        130.0, 13.0, 10.0), ("A", dt.date(2025, 3, 31), 150.0, 15.0, 50.0)]
    df = spark.createDataFrame(rows, "symbol string, period_end date, total_revenue double, operating_income double, net_income double")
    r = fundamental.ratios(df).orderBy("period_end").collect()
    assert [x.revenue_yoy_pct and round(x.revenue_yoy_pct, 6) for x in r] == [None, None, None, 50.0] and r[3].net_income_yoy_pct is None
    assert fundamental.fundamental(df).first().revenue_growth == "strong"
    assert pit.announced(df, "2025-05-14").count() == 3 and pit.announced(df, "2025-05-15").count() == 4
    b = spark.createDataFrame([(20.0,), (8.0,), (0.0,), (-10.0,), (None,)], "x double").select(fundamental.growth_bucket(F.col("x")).alias("b"))
    assert [x.b for x in b.collect()] == ["strong", "growing", "flat", "declining", None]


def test_bitemporal_and_changes(spark):
    d = dt.date(2025, 1, 10)
    v = spark.createDataFrame([("AAA", d, dt.date(2025, 1, 11), 100.0), ("AAA", d, dt.date(2025, 3, 1), 50.0)],
        "symbol string, date date, vintage_date date, close double")
    assert [pit.known_at(v, k).first() and pit.known_at(v, k).first().close for k in ("2025-02-01", "2025-06-01", "2025-01-01")] == [100.0,
        50.0, None]
    schema = "symbol string, date date, close double, volume bigint"
    a, b, c = days(3)
    old = spark.createDataFrame([("A", a, 100.0, 10), ("A", b, 200.0, 20)], schema)
    new = spark.createDataFrame([("A", a, 100.0 + 1e-9, 10), ("A", b, 250.0, 20), ("A", c, 300.0, 1)], schema)
    assert {r.date for r in pit.changed_rows(old, new, ["symbol", "date"], ["close"], ("volume",)).collect()} == {b, c}


def test_as_of_join(spark):
    left = spark.createDataFrame([("A", d) for d in days(5)], "symbol string, date date")
    right = spark.createDataFrame([("A", days(5)[1], 1.0), ("A", days(5)[3], 2.0)], "symbol string, at date, v double")
    assert [r.v for r in pit.as_of_join(left, right, "symbol", "date", "at", "v").orderBy("date").collect()] == [None, 1.0, 1.0, 2.0, 2.0]


def test_tails_stress_beta(spark):
    x = np.random.default_rng(2).normal(0, 0.01, 1000)
    s = spark.createDataFrame([(float(v),) for v in x], "ret double")
    r = risk.var_cvar(s, 0.95).first()
    q = np.quantile(x, 0.05)
    assert r["var"] == pytest.approx(-q) and r.cvar == pytest.approx(-x[x <= q].mean()) and r.cvar >= r["var"]
    assert risk.var_cvar(s.limit(5), 0.95).first()["var"] is None
    dated = spark.createDataFrame(list(zip(days(5), [0.0, -0.1, -0.1, 0.05, 0.05])), "date date, ret double")
    worst = {r.days: r.worst for r in risk.worst_windows(dated, (1, 2, 10)).collect()}
    assert worst[1] == pytest.approx(-0.1) and worst[2] == pytest.approx(0.9 * 0.9 - 1) and worst[10] is None
    b = x[:300]
    pair = spark.createDataFrame([("A", d, float(2 * v)) for d, v in zip(days(300), b)], "symbol string, date date, ret double")
    bench = spark.createDataFrame([(d, float(v)) for d, v in zip(days(300), b)], "date date, ret double")
    assert risk.betas(pair, bench).first().beta == pytest.approx(0.67 * 2 + 0.33) and risk.betas(pair.where("date < '2024-01-11'"),
        bench).first().beta is None


@pytest.mark.parametrize("token, want", [("weekly", (5, "weekly")), ("1y", (252, "annual")), ("d", (1, "daily")), ("10", (10, "10d")),
    ("10d", (10, "10d")), (21, (21, "monthly")), (None, (252, "annual"))])
def test_horizon(token, want):
    assert risk.horizon(token) == want
    with pytest.raises(ValueError):
        risk.horizon("banana")


def test_signal_scores(spark):
    rows = [("s", d, f"N{k}", float(k), 0.1 * k - 0.3) for d in days(2) for k in range(1, 6)]
    long = spark.createDataFrame(rows, "signal string, date date, symbol string, sig double, fwd double")
    assert [r.ic for r in evaluate.cross_sectional_ic(long).collect()] == pytest.approx([1.0, 1.0])
    assert evaluate.cross_sectional_ic(long.where("sig <= 3")).count() == 0
    assert evaluate.tercile_spread(long).first().spread == pytest.approx((0.1 + 0.2) / 2 - (-0.2 - 0.1) / 2)
    assert evaluate.p_two_sided(0.0) == 1 and evaluate.p_two_sided(1.96) == pytest.approx(0.05,
        abs=1e-3) and evaluate.t_for(0.05) == pytest.approx(1.96, abs=1e-3)
    r = np.random.default_rng(3)
    e = [0.0]
    for _ in range(199):
        e.append(0.85 * e[-1] + r.normal())
    ics = spark.createDataFrame([("s", d, float(v + 0.5)) for d, v in zip(days(200), e)], "signal string, date date, ic double")
    x = np.array(e) + 0.5
    c, n, lag = x - x.mean(), 200, 10
    s = (c @ c) / n + sum(2 * (1 - k / (lag + 1)) * (c[k:] @ c[:-k]) / n for k in range(1, lag + 1))
    assert evaluate.newey_west(ics, lag).first().t == pytest.approx(x.mean() / math.sqrt(s / n))
    assert abs(evaluate.newey_west(ics, 60).first().t) < abs(evaluate.newey_west(ics, 0).first().t)
    ties = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0)], "k int, x double").select(average_rank("x", ["k"]).alias("r"))
    assert sorted(v.r for v in ties.collect()) == [1.5, 1.5, 3.0]


def test_macro(spark):
    p = series(spark, [1, 1], "A").union(series(spark, [9, 1], "B")).union(series(spark, [5, 1], "C"))
    held = spark.createDataFrame([("A", 1.0), ("B", 1.0), ("C", 1.0), ("Z", 4.0)], "symbol string, quantity double")
    meta = spark.createDataFrame([("A", "Tech"), ("B", "Tech"), ("C", "Energy")], "symbol string, sector string")
    w = macro.weights(held, p)
    top = macro.macro_portfolio(macro.sector_weights(w, meta)).first()
    assert (top.top_sector, round(top.top_sector_pct, 2), top.concentration, top.num_sectors) == ("Tech", 66.67, "high", 2)
    assert macro.macro_portfolio(macro.sector_weights(w, meta.limit(2))).first().unknown_pct == pytest.approx(100 / 3)


def test_text(spark):
    rows = [("Company beats estimates, profit surges to a record",), ("Stock to plunge on fraud probe and analyst downgrade",),
        ("AGM to be held",), (None,), ("Q3 numbers",), ("They define terms",)]
    r = spark.createDataFrame(rows, "t string").select(text.polarity(F.col("t")).alias("p"), text.event_class(F.col("t")).alias("e"),
        text.event_class(F.col("t"), True).alias("d")).collect()
    assert r[0].p > 0 > r[1].p and r[2].p == 0 and r[3].p == 0
    assert [x.e for x in r] == ["results", "legal/probe", None, None, None, None] and r[4].d == "results"
    o = spark.createDataFrame([("A", 0.63, 0.18, 3, 1), ("B", None, None, 3, 1)],
        "symbol string, held_pct_institutions double, held_pct_insiders double, n_institutions int, snapshot_at int")
    assert [(x.symbol, x.institutional_pct, x.insider_pct, x.institutional) for x in text.ownership(o).collect()] == [("A", 63.0, 18.0, "high")]


def card(spark, **values):
    return spark.createDataFrame([tuple(values.get(c) for c in scoring.CARD)], ", ".join(f"{c} {t}" for c, t in scoring.CARD.items()))


def test_scoring(spark):
    loud = card(spark, symbol="A", risk_contribution_pct=45.0, weight_pct=30.0, trend="downtrend", momentum="oversold", level="near lows",
        earnings_growth="declining", margin_trend="contracting", net_income_yoy_pct=-20.0, sentiment="negative", mean_polarity=-0.5, n_articles=4)
    r = scoring.attention(loud).first()
    assert r.attention > 60 and len(r.drivers) == 4 and r.s_risk == 100 and r.s_macro is None
    none = card(spark, symbol="B")
    assert scoring.attention(none).first().attention is None and scoring.confidence(none).first().confidence <= 0.3
    assert scoring.attention(loud, {d: 0.0 for d in scoring.WEIGHTS if d != "risk"}).first().attention == 100
    found = scoring.alerts(loud).first().alerts
    assert len(found) == 5 and found[0].startswith("top risk contributor — 45% of book risk") and scoring.alerts(none).first().alerts == []
    now = scoring.snapshot(scoring.attention(loud))
    before = now.withColumns({"trend": F.lit("uptrend"), "momentum": F.lit(None).cast("string"), "attention": F.col("attention") - 2,
        "risk_contribution_pct": F.lit(40.0)})
    assert scoring.changes(now, before).first().changes == ["trend uptrend → downtrend", "risk contribution 40% → 45%"]
    assert scoring.changes(now, before.limit(0)).first().changes == []
    flagged = scoring.briefing(scoring.confidence(scoring.attention(loud.union(none)))).collect()
    assert [r.flagged for r in flagged] == [True, False]


def test_chunks_and_retrieval(spark):
    words = [f"w{i:04d}" for i in range(400)]
    got = rag.chunk(" ".join(words), 200, 40)
    assert all(w in words for c in got for w in c.split()) and {w for c in got for w in c.split()} == set(words)
    assert len(rag.chunk("x" * 5000)) >= 4 and rag.chunk("  ") == [] == rag.chunk(None)
    df = spark.createDataFrame([(["Alpha beta", "gamma"], ["alpha", "GAMMA"]), (["alpha"], ["alpha", "z"]), ([], ["a"]), (["a"], [])],
        "c array<string>, m array<string>")
    assert [tuple(r.s) for r in df.select(rag.retrieval_score(F.col("c"), F.col("m")).alias("s")).collect()] == [(1.0, True), (0.5, False),
        (0.0, False), (None, None)]
    cited = spark.createDataFrame([([1, 2, 2, 3], 3), ([0, 4, 9], 3)], "c array<int>, k int").select(rag.valid_citations(F.col("c"),
        F.col("k")).alias("v"))
    assert [r.v for r in cited.collect()] == [[1, 2, 3], []]
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>").select(rag.cosine_distance(F.col("a"),
        F.col("b")).alias("d"), rag.cosine_distance(F.col("a"), F.col("a")).alias("z")).first()
    assert v.d == 1 and v.z == 0
    hit = [{"distance": 0.5}, {"distance": 0.6}]
    assert rag.ask("q", hit)["weak"] and rag.ask("q", hit, lambda q, h: {"answer": "x", "citations": [1, 1, 9, "a"]})["citations"] == [1]


def test_coverage_flags(spark):
    rows = [(None, None, False), (None, DAY, True), (DAY, None, True), (DAY, DAY - dt.timedelta(1), True), (DAY, DAY, True)]
    got = spark.createDataFrame(rows, "e date, l date, h boolean").select(coverage.coverage_flag(F.col("e"), F.col("l"), F.col("h")).alias("f"))
    assert [r.f for r in got.collect()] == ["MISSING", "UNCHECKED", "UNTAGGED", "STALE", "OK"]


def test_books_and_feeds(spark, tmp_path):
    book = tmp_path / "book.csv"
    book.write_text("# mine\nsymbol,quantity,avg_cost\nINFY.NS,20,1300 # core\ntcs.ns,5,\nitc.ns,,\n\n")
    got = sorted(tuple(r) for r in files.read_positions(spark, str(book)).collect())
    assert got == [("INFY.NS", 20.0, 1300.0), ("ITC.NS", 0.0, None), ("TCS.NS", 5.0, None)]
    files.write_positions(files.edited(files.edited(got, "infy.ns", 30.0, 1.5), "TCS.NS", None), str(book))
    assert sorted(tuple(r) for r in files.read_positions(spark, str(book)).collect()) == [("INFY.NS", 30.0, 1.5), ("ITC.NS", 0.0, None)]
    book.write_text("# nothing\n")
    with pytest.raises(ValueError):
        files.read_positions(spark, str(book))
    names = tmp_path / "u.csv"
    names.write_text("symbol\nYESBANK.NS\npnb.ns\nYESBANK.NS\n")
    listed = files.read_symbols(spark, str(names))
    assert [r.symbol for r in files.universe(listed, listed).collect()] == ["YESBANK.NS", "PNB.NS"]
    raw = spark.createDataFrame([('noise [{"headline": "A"}, {"publisher": "p"}] tail',), ("none",)],
        "t string").select(sinks.parse_news(F.col("t")).alias("n"))
    assert [r.n and [x.headline for x in r.n] for r in raw.collect()] == [["A"], None]
    wide = spark.createDataFrame([("A", "total_revenue", 1.0, None), ("A", "net_income", 2.0, 3.0)],
        "symbol string, item string, `2024-03-31` double, `2024-06-30` double")
    assert [(str(r.period_end), r.net_income) for r in sinks.shaped_quarters(wide).collect()] == [("2024-03-31", 2.0)]
    ran = []
    errors = sinks.ingest(["A", "B", "A"], {"news": lambda s: ran.append(("news", s)),
        "bars": lambda s: ran.append(("bars", s)) if s == "A" else 1 / 0})
    assert ran == [("bars", "A"), ("news", "A")] and list(errors) == ["B"]


def test_runtime(spark):
    calls = spark.createDataFrame([("a", "big-1", 1000, 500, 100.0), ("b", "odd", 2000, 1000, 100.0)],
        "label string, model string, input_tokens bigint, output_tokens bigint, latency_ms double")
    rates = spark.createDataFrame([("big", 3.0, 15.0), ("big-1", 1.0, 5.0)], "prefix string, per_m_in double, per_m_out double")
    s = runtime.trace_summary(runtime.priced(calls, rates)).first()
    assert (s.calls, s.input_tokens, s.output_tokens, s.latency_ms, s.complete) == (2, 3000, 1500, 200.0,
        False) and s.cost == pytest.approx(0.001 + 0.0025)
    now = [0.0]
    memo = runtime.Memo(10, lambda: now[0])
    first = memo.get("k", lambda: [1])
    first.append(2)
    assert memo.get("k", lambda: [9]) == [1]
    now[0] = 11
    assert memo.get("k", lambda: [9]) == [9]
    seen = []
    reg = runtime.Registry([runtime.Agent("x", lambda t: t["p"])])
    reg.register(runtime.Agent("y", lambda t: None))
    assert list(reg.analyse({"p": calls}, lambda k, w: seen.append(k))) == ["x"] and seen[0] == "run_start" and seen[-1] == "run_complete"
