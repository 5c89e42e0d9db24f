"""Histories, guidance, narration, vendor feeds and evaluation: what their queries' SQL doesn't show."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import sql as sql_functions
from tidemark.functions.windows import compounded, rows_of, value_ranks
from tidemark.operators import evaluate, guidance, history, narrative, pit, rag, risk, scoring
from tidemark.plans import runtime
from tidemark.sources import files, sinks, vendor

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def dated(spark, values):
    return spark.createDataFrame([("A", DAY + dt.timedelta(i), v) for i, v in enumerate(values)], "symbol string, date date, ret double")


def test_a_loss_of_all_is_the_worst_window(spark):
    got = {r.days: r.worst for r in risk.worst_windows(dated(spark, [0.1, -1.0, 0.1, 0.05, 0.02, 0.01])).collect()}
    assert got[1] == -1.0 and got[5] == -1.0 and got[10] is None
    last = dated(spark, [0.1, 0.2, None, 0.1, 0.1]).select("date", compounded(F.col("ret"), 2, rows_of()).alias("c")).orderBy("date").collect()
    assert [r.c and round(r.c, 9) for r in last] == [None, 0.32, None, None, 0.21]


def test_value_ranks_and_pooled_scores(spark):
    rng = np.random.default_rng(3)
    sig, fwd = rng.integers(0, 40, 600) / 7, rng.normal(size=600).round(1)
    rows = [("s", f"N{i % 20:02d}", DAY + dt.timedelta(i // 20), float(a), float(b)) for i, (a, b) in enumerate(zip(sig, fwd))]
    long = spark.createDataFrame(rows, "signal string, symbol string, date date, sig double, fwd double")
    ranks = {r.sig: (r.k, r.before) for r in value_ranks(long, "sig", ["signal"]).collect()}
    assert ranks == {float(v): (int((sig == v).sum()), int((sig < v).sum())) for v in np.unique(sig)}
    got = evaluate.pooled(long, 1).first()
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    assert got.pooled_ic == pytest.approx(np.corrcoef(rank(sig), rank(fwd))[0, 1])
    assert got.hit == pytest.approx(((sig > np.median(sig)) == (fwd > np.median(fwd))).mean()) and got.base == pytest.approx((fwd > 0).mean())


def test_newey_west_by_hand(spark):
    x = np.random.default_rng(4).normal(0.02, 0.1, 30)
    ics = spark.createDataFrame([("s", DAY + dt.timedelta(i), float(v)) for i, v in enumerate(x)] + [("one", DAY, 0.5)],
        "signal string, date date, ic double")
    got = {r.signal: r for r in evaluate.newey_west(ics, 4).collect()}
    e = x - x.mean()
    s = (e @ e + 2 * sum((1 - k / 5) * (e[k:] @ e[:-k]) for k in range(1, 5))) / 30
    assert got["s"].t == pytest.approx(x.mean() / math.sqrt(s / 30)) and got["s"].ic_std == pytest.approx(x.std(ddof=1))
    assert got["one"].t is None and got["one"].ic_std is None


def test_chunks_split_no_word():
    words = [f"w{i:04d}" for i in range(900)]
    got = rag.chunk("  " + " ".join(words) + "\n", 300, 60)
    assert all(len(c) <= 300 and set(c.split()) <= set(words) for c in got) and set(" ".join(got).split()) == set(words)
    assert all(set(a.split()) & set(b.split()) for a, b in zip(got, got[1:]))
    assert rag.chunk(None) == [] and rag.chunk(" \n ") == [] and rag.chunk("x" * 25, 10, 4) == ["x" * 10, "x" * 10, "x" * 10, "x" * 7]


def test_chunks_query(spark):
    from tidemark.plans.catalog import QUERIES

    out = QUERIES["chunks"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in out} == {d for d, t in texts.items() if (t or "").strip()} and all(r.content in texts[r.doc_id] for r in out)


def test_latest_of_rows_without_a_stamp(spark):
    rows = [("a", None, 1), ("a", None, 2), ("b", 5, 3), ("b", None, 4)]
    got = {r.k: (r.at, r.v) for r in pit.latest_by(spark.createDataFrame(rows, "k string, at int, v int"), ["k"], F.col("at")).collect()}
    assert got["b"] == (5, 3) and got["a"][0] is None and got["a"][1] in (1, 2)


def test_two_quarters_in_a_month(spark):
    from tidemark.operators.fundamental import ratios

    rows = [("A", dt.date(2023, 3, 30), 50.0, 1.0, 1.0), ("A", dt.date(2023, 3, 31), 100.0, 1.0, 1.0), ("A", dt.date(2024, 3, 31), 150.0, 1.0, 1.0)]
    out = ratios(spark.createDataFrame(rows,
        "symbol string, period_end date, total_revenue double, operating_income double, net_income double")).collect()
    assert len(out) == 3 and max(out, key=lambda r: r.period_end).revenue_yoy_pct == pytest.approx(50.0)


def test_history_round_trip(spark, tmp_path):
    from tidemark.plans.catalog import _made_cards

    cards = scoring.attention(_made_cards(spark, SF))
    path = str(tmp_path / "runs")
    history.save_run(cards, "2024-06-30", path)
    history.save_run(cards.withColumn("trend", F.lit("uptrend")), None, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 2 * cards.count() and stored.where("as_of is null").count() == cards.count()
    moved = history.with_changes(cards, stored, scoring.changes).where(F.size("changes") > 0)
    assert moved.count() == cards.where("trend <> 'uptrend'").count()


def test_briefs_are_stored_and_read_back(spark):
    facts = spark.createDataFrame([("A", 10.0, None)], "symbol string, last_close double, rsi double")
    said = spark.createDataFrame([("A", "up", "well", 1000, 500, 2000, 100, True)],
        "symbol string, headline string, bottom_line string, input_tokens long, output_tokens long, news_input long, news_output long, searched boolean")
    rows = history.brief_rows(said, facts, "m", 3.0, 15.0)
    one = rows.first()
    assert one.cost_usd == pytest.approx(0.003 + 0.0075 + 0.006 + 0.0015 + 0.02) and one.one_line == "up" and '"rsi"' not in one.payload
    assert history.deep_summaries(rows).first().summary == "up — well"
    brief = history.brief_rows(said.drop("headline", "bottom_line").withColumn("one_line", F.lit("flat")), facts, "m", 3.0, 15.0)
    assert history.deep_summaries(brief).count() == 0 and brief.first().one_line == "flat"


def test_guidance_and_credibility(spark):
    rows = [("A", "s", dt.date(2024, 3, 31), 1, '{"revenue_outlook": "up"}'), ("A", "s", None, 2, '{"other_guidance": ["x"]}'), ("A", "s",
        dt.date(2024, 1, 1), 3, "{}"), ("B", "s", dt.date(2025, 1, 1), 4, '{"margin_outlook": "m"}')]
    records = spark.createDataFrame(rows, "symbol string, source string, period date, extracted_at int, data string")
    told = guidance.guidance_history(records, "2024-12-31")
    assert [(r.symbol, r.nth, r.extracted_at) for r in told.orderBy("symbol", "nth").collect()] == [("A", 1, 1), ("A", 2, 2)]
    results = spark.createDataFrame([("A", dt.date(2024, 6, 30), 2.5e10, 1e9)],
        "symbol string, period_end date, total_revenue double, net_income double")
    pairs = guidance.promised_and_actual(told, guidance.actuals(results)).persist()
    one = pairs.first()
    assert one.promised == ["period 2024-03-31 | revenue_outlook=up",
        "period unknown | other=x"] and one.actual == ["2024-06-30: revenue ₹2,500cr, net income ₹100cr, net margin 4.0%"]
    assert guidance.credibility(pairs, "zz") is None and guidance.credibility(pairs, "a")["n_guidance"] == 2
    assert guidance.credibility(pairs, "a", lambda p, a: {"caveat": f"{len(p)}/{len(a)}"})["caveat"] == "2/1"
    assert "boom" in guidance.credibility(pairs, "a", lambda p, a: {}["boom"])["caveat"]
    assert guidance.extract_guidance("A", [], None)["note"] == "no documents" and guidance.extract_guidance("A", [{"source": "s"}], "q",
        lambda h: {"k": 1})["stored"]


def test_news_are_replaced_and_refreshed(spark):
    now = dt.datetime.now()
    old = spark.createDataFrame([("A", "old", None, now - dt.timedelta(days=3)), ("B", "kept", None, now)],
        "symbol string, title string, published timestamp, ingested_at timestamp")
    made = lambda symbol: spark.createDataFrame([(" new " + "x" * 600, "2024-01-02"), ("dup", "2024-01-01"), ("dup", "bad"), ("  ",
        "2024-01-01")], "title string, published string")
    out, status = sinks.refresh_news("A", old, made)
    got = sorted((r.symbol, len(r.title), str(r.published)[:10]) for r in out.collect())
    assert status["fetched"] and got == [("A", 3, "2024-01-01"), ("A", 500, "2024-01-02"), ("B", 4, "None")]
    assert sinks.refresh_news("B", old, made)[1] == {"fetched": False, "reason": "newer than 24 hours"}
    assert sinks.refresh_news("A", old, None)[1]["reason"] == "no source of news" and not sinks.refresh_news("A", old, lambda s: 1 / 0)[1]["fetched"]


def test_run_events_in_order(spark):
    seen = []
    agents = runtime.Registry([runtime.Agent("technical", lambda t: t["p"]), runtime.Agent("none", lambda t: None)])
    cards = lambda out: [{"symbol": "A"}, {"symbol": "B"}]
    narrate = lambda card: {"said": card["symbol"]} if card["symbol"] == "A" else 1 / 0
    agents.analyse({"p": spark.range(1)}, lambda kind, what: seen.append(kind), lambda: {"n_holdings": 2}, cards, narrate)
    assert seen[:2] == ["run_start", "context_loaded"] and seen[2:6] == ["agent_start", "agent_planned"] * 2
    assert seen[6:8] == ["agent_done"] * 2 and seen[8:11] == ["ranking", "card", "card"]
    assert sorted(seen[11:]) == sorted(["narration_start", "narration_done", "narration_error", "narration_summary",
        "run_complete"]) and seen[-1] == "run_complete"
    seen.clear()
    agents.analyse({"p": spark.range(1)}, lambda kind, what: seen.append(kind))
    assert "narration_skipped" in seen and "ranking" not in seen
    trace = runtime.Trace()
    assert trace.timed("a", "m", lambda: ("said", 3, 4)) == "said" and trace.calls[0][:4] == ("a", "m", 3, 4)


def test_events_as_a_stream():
    def run(emit):
        emit("run_start", {})
        emit("card", {"rank": 1})
        raise ValueError("no prices")

    got = list(runtime.streamed(run, 0.0))
    assert [kind for kind, _ in got] == ["run_start", "card", "error", "end"] and got[2][1] == {"error": "no prices"}


def test_command_line(capsys):
    from tidemark.__main__ import main

    assert main(["list"]) == 0 and "price_panel" in capsys.readouterr().out
    assert main(["brief", SF, "3"]) == 0 and len(capsys.readouterr().out.splitlines()) == 3
    assert main(["nothing"]) == 2


def test_deep_read_and_research():
    out = narrative.deep_read("facts", {"bull": lambda f: {"summary": "b"}, "bear": lambda f: 1 / 0}, lambda f,
        words: {"headline": sorted(k for k, w in words.items() if w)})
    assert out["deep"] == {"headline": ["bull"]} and out["debate"]["bear"] is None
    assert narrative.deep_read("facts", {"bear": lambda f: 1 / 0}, lambda f, w: {"headline": 1})["deep"] is None
    asked = []
    answer = lambda q, f, d, h, web: asked.append(web) or {"answer": "x"}
    assert narrative.ask_research("q", "f", None, [], answer, "2024-01-01", web=print)["answer"] == "x" and asked == [None]
    assert narrative.ask_research("q", "f", None, [], None)["answer"] is None
    assert narrative.case_text("s", [("p", "e")]) == "s\n  - p [e]" and narrative.case_text(None, []) == "(no data)"


class Feed:
    def bars(self, symbol):
        yield {"date": DAY, "close": 1.5, "volume": 7}

    def quarters(self, symbol):
        return []

    def news(self, symbol):
        return [{"title": "t"}]


def test_vendor_source(spark):
    vendor.register(spark)
    read = lambda feed: spark.read.format("vendor").option("source", "tests.test_flows:Feed").option("symbols", "A,B").option("feed",
        feed).load()
    assert sorted((r.symbol, r.close, r.volume, r.open) for r in read("bars").collect()) == [("A", 1.5, 7, None), ("B", 1.5, 7, None)]
    assert read("quarters").count() == 0 and read("news").count() == 2
    raw = ['{"content": {"title": "a", "provider": {"displayName": "p"}, "pubDate": "2024-01-01T00:00:00Z"}}',
        '{"title": "b", "publisher": "q", "providerPublishTime": 1704067200}', "{}"]
    got = spark.createDataFrame([(x,) for x in raw], "raw string").select(vendor.news_item(F.col("raw")).alias("n")).select("n.*").collect()
    assert [(r.title, r.publisher) for r in got] == [("a", "p"), ("b", "q"), (None,
        None)] and got[0].published == got[1].published and got[2].published is None


def test_sql_functions(spark):
    names = sql_functions.register(spark)
    assert spark.sql("SELECT count(*) AS n FROM tm_chunks('one two three four', 9, 2)").first().n == 3 and "tm_chunks" in names
    assert spark.sql("SELECT tm_max_drawdown(v) AS d FROM VALUES (10D), (5D), (8D) AS t(v)").first().d == -0.5


def test_documents_of_a_parser(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one|two")
    got = files.read_binary_documents(spark, str(tmp_path), lambda data: data.decode().split("|")).first()
    assert (got.source, got.text) == ("a.bin", "one\ntwo")
    empty = spark.createDataFrame([], "symbol string")
    assert files.book_or_universe(empty, spark.createDataFrame([("A",)], "symbol string")).count() == 1


def test_retrieval_from_questions_to_answers(spark):
    corpus = spark.createDataFrame([("a", "revenue growth was strong"), ("b", "the margin fell"), ("c", "weather in spring")],
        "chunk string, content string")
    hits = rag.retrieve(spark.createDataFrame([("revenue growth",)], "question string"), corpus, 2, lambda c: rag.hashed_embedding(c, 64)).persist()
    best = hits.where("rank = 1").first()
    assert best.chunk == "a" and best.weak == (best.distance > 0.45) and hits.count() == 2
    said = spark.createDataFrame([("revenue growth", "it grew [1], [7] and [1]")], "question string, answer string")
    assert rag.answered(hits, said).first().citations == [1] and rag.answered(hits, said.limit(0)).first().citations == []


def test_payloads_are_read_as_variants(spark):
    """JSON text and variants alike; what isn't JSON, or holds null or empty texts, tells nothing."""
    texts = ['{"deep": {"headline": "h", "bottom_line": "b"}}', '{"deep": null}', '{"deep": {"headline": ""}}', "{broken", None, "[1]"]
    rows = spark.createDataFrame([(f"S{i}", i, t) for i, t in enumerate(texts)], "symbol string, run_at int, payload string")
    want = {"S0": "h — b", "S2": None}
    assert {r.symbol: r.summary for r in history.deep_summaries(rows).collect()} == want
    as_variant = rows.withColumn("payload", F.try_parse_json("payload"))
    assert {r.symbol: r.summary for r in history.deep_summaries(as_variant).collect()} == want
    said = ['{"revenue_outlook": "up", "other_guidance": ["a", "b"]}', '{"revenue_outlook": "", "other_guidance": []}', '{"margin_outlook": 3}', "x", None]
    records = spark.createDataFrame([("A", DAY, i, t) for i, t in enumerate(said)], "symbol string, period date, extracted_at int, data string")
    got = guidance.guidance_history(records).orderBy("extracted_at").collect()
    assert [(r.extracted_at, r.revenue_outlook, r.margin_outlook, r.other_guidance, r.nth) for r in got] == [(0, "up", None, ["a", "b"], 1), (2, None, "3",
        None, 2)]
