"""The analysis of a book from its feeds: parts against their operators, and no look ahead."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import analysis, scoring
from tidemark.operators.analysis import Feeds, Options

DAY = dt.date(2020, 1, 1)


def bars(spark, paths):
    rows = [(s, DAY + dt.timedelta(days=i), float(x), float(x), 1000 + i) for s, xs in paths.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "symbol string, date date, close double, adj_close double, volume long")


@pytest.fixture(scope="module")
def book(spark):
    rng = np.random.default_rng(1)
    market = rng.normal(0, 0.01, 300)
    moves = {s: b * market + rng.normal(0, v, 300) for s, b, v in (("A", 1.0, 0.01), ("B", 0.5, 0.005), ("C", 1.5, 0.03))}
    paths = {s: 100 * np.exp(np.cumsum(m)) for s, m in moves.items()}
    p = bars(spark, paths | {"other": 50 + np.arange(300) % 7})
    quarters = spark.createDataFrame([(s, dt.date(2019, 3, 31) + dt.timedelta(days=91 * k), 100.0 + 10 * k, 20.0, 10.0 - k) for s in "AB" for k in range(7)],
        "symbol string, period_end date, total_revenue double, operating_income double, net_income double")
    news = spark.createDataFrame([("A", DAY + dt.timedelta(days=k), "profit surges to a record" if k < 250 else "fraud probe") for k in range(0, 300, 25)],
        "symbol string, published date, text string")
    own = spark.createDataFrame([("B", 0.8, 0.1, 5, dt.datetime(2020, 2, 1)), ("B", 0.1, 0.1, 5, dt.datetime(2020, 10, 20))],
        "symbol string, held_pct_institutions double, held_pct_insiders double, n_institutions int, snapshot_at timestamp")
    told = spark.createDataFrame([("C", "f1", dt.date(2020, 6, 30), "{}", 1)], "symbol string, source string, period date, data string, extracted_at int")
    meta = spark.createDataFrame([("A", "Tech"), ("B", "Tech"), ("C", "Energy")], "symbol string, sector string")
    held = spark.createDataFrame([("A", 10.0, 90.0), ("B", 30.0, None), ("C", 5.0, 0.0), ("gone", 5.0, 1.0)],
        "symbol string, quantity double, avg_cost double")
    return held, Feeds(p, bars(spark, {"M": 100 * np.exp(np.cumsum(market))}), quarters, meta, news, own, told)


def test_position_risk(spark, book):
    held, feeds = book
    rows = {r.symbol: r for r in analysis.position_risk(held, feeds).collect()}
    assert set(rows) == {"A", "B", "C"} and sum(r.weight_pct for r in rows.values()) == pytest.approx(100)
    assert sum(r.risk_contribution_pct for r in rows.values()) == pytest.approx(100)
    assert rows["C"].beta > rows["A"].beta > rows["B"].beta and rows["C"].vol_pct > rows["A"].vol_pct > rows["B"].vol_pct
    assert rows["B"].unrealised_pct is None and rows["C"].unrealised_pct is None and rows["A"].unrealised_pct is not None
    assert all(r.max_drawdown_pct < 0 for r in rows.values())
    monthly = analysis.position_risk(held, feeds, Options(horizon="monthly")).where("symbol = 'A'").first()
    assert monthly.vol_pct == pytest.approx(rows["A"].vol_pct * np.sqrt(21 / 252))
    assert monthly.risk_contribution_pct == pytest.approx(rows["A"].risk_contribution_pct)
    bare = analysis.position_risk(held.drop("avg_cost"), Feeds(feeds.prices)).where("symbol = 'A'").first()
    assert bare.beta is None and bare.unrealised_pct is None and bare.vol_pct == pytest.approx(rows["A"].vol_pct)


def test_cards_join_all_readings(spark, book):
    held, feeds = book
    rows = {r.symbol: r for r in analysis.cards(held, feeds).collect()}
    assert set(rows) == {"A", "B", "C", "other"} and sorted(r.place for r in rows.values()) == [1, 2, 3, 4] and rows["other"].place == 4
    shares = sorted((r for r in rows.values() if r.symbol != "other"), key=lambda r: -r.risk_contribution_pct)
    assert [r.place for r in shares] == [1, 2, 3]
    a, b, c, other = (rows[s] for s in ("A", "B", "C", "other"))
    assert a.sentiment == "positive" and a.n_articles == 12 and a.earnings_growth == "declining" and b.institutional == "low"
    assert c.guidance and a.guidance is None and c.latest_quarter is None and a.sector == "Tech" and c.sector_weight_pct < 100
    assert other.attention is not None and other.risk_contribution_pct is None and other.n_present == 1
    assert all(r.attention is not None and 0 <= r.confidence <= 1 for r in rows.values())
    alone = analysis.cards(held, Feeds(feeds.prices)).where("symbol = 'A'").first()
    assert alone.sentiment is None and alone.risk_contribution_pct == pytest.approx(a.risk_contribution_pct)


def test_no_look_ahead(spark, book):
    """What came after the date changes nothing, and a feed cut there gives the same cards."""
    held, feeds = book
    then = Options(as_of="2020-08-01")
    cut = DAY + dt.timedelta(days=213)
    rows = {r.symbol: r for r in analysis.cards(held, feeds, then).collect()}
    late = lambda df, c: None if df is None else df.where(F.col(c) <= F.lit(cut))
    short = Feeds(late(feeds.prices, "date"), late(feeds.market, "date"), feeds.quarters.where(F.date_add("period_end", 45) <= F.lit(cut)), feeds.sectors,
        late(feeds.news, "published"), late(feeds.ownership, "snapshot_at"), feeds.guidance.limit(0), None)
    want = {r.symbol: r for r in analysis.cards(held, short, then).collect()}
    fields = ("risk_contribution_pct", "vol_pct", "beta", "max_drawdown_pct", "trend", "momentum", "sentiment", "institutional", "attention", "confidence")
    for s in rows:
        assert all(rows[s][f] == (pytest.approx(want[s][f]) if isinstance(want[s][f], float) else want[s][f]) for f in fields), s
    assert rows["B"].institutional == "high" and rows["A"].n_articles == 9 and not rows["C"].guidance


def test_changes_since_a_run(spark, book):
    held, feeds = book
    before = scoring.snapshot(analysis.cards(held, feeds, Options(as_of="2020-06-01")))
    rows = {r.symbol: r for r in analysis.cards(held, feeds, prior=before).collect()}
    assert "institutional high → low" in rows["B"].changes and any(x.startswith("changed since last run") for x in rows["B"].alerts)


def test_portfolio(spark, book):
    held, feeds = book
    r = analysis.portfolio(held, feeds).first()
    risk = {x.symbol: x for x in analysis.position_risk(held, feeds).collect()}
    assert r.n_positions == 3 and r.top_symbol == max(risk, key=lambda s: risk[s].risk_contribution_pct)
    assert r.portfolio_beta == pytest.approx(sum(x.weight_pct / 100 * x.beta for x in risk.values())) and r.top_sector == "Tech"
    assert r.effective_holdings == pytest.approx(1 / r.hhi) and "top_sector" not in analysis.portfolio(held, Feeds(feeds.prices)).columns


def test_places_over_ranges(spark):
    rows = [(f"S{i:03}", None if i % 9 == 0 else float(i * 7 % 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, risk_contribution_pct double").repartition(5)
    got = {r.symbol: r.place for r in analysis.placed(df).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {s: k + 1 for k, (s, _) in enumerate(want)}


def test_events_carry_what_the_run_counted(spark, book):
    """Rows and labels come from the run that makes the cards, read once; a reading no card needs is read for itself."""
    from tidemark.plans import runtime

    held, feeds = book
    seen = []
    cards = runtime.analyse_book(held, feeds, on_event=lambda kind, what: seen.append((kind, what)), first=2)
    done = {w["agent"]: w for k, w in seen if k == "agent_done"}
    rows = {r.symbol: r for r in cards.collect()}
    assert done["technical"]["rows"] == 4 and sum(done["technical"]["measures"].values()) == sum(r.trend != "—" for r in rows.values())
    assert done["technical"]["note"].startswith("4 names · ") and done["fundamental"]["measures"]["declining"] == 2
    assert done["risk"]["measures"]["top_symbol"] == min(rows.values(), key=lambda r: r.place).symbol and done["sentiment"]["measures"]["headlines"] == 12
    assert [w["symbol"] for k, w in seen if k == "card"] == [r.symbol for r in sorted(rows.values(), key=lambda r: r.place)][:2]
    assert [k for k, _ in seen][-1] == "run_complete" and all("plan_ms" in w for k, w in seen if k == "agent_planned")
    reg = runtime.Registry([runtime.Agent("used", lambda t: spark.range(5), measures={"most": F.max("id")}), runtime.Agent("unused", lambda t: spark.range(7))])
    seen.clear()
    reg.analyse({}, lambda kind, what: seen.append((kind, what)), cards=lambda out: [{"symbol": str(r.id)} for r in out["used"].collect()])
    assert [(w["rows"], w["measures"]) for k, w in seen if k == "agent_done"] == [(5, {"most": 4}), (7, {})]
