"""Commands over a store, from an empty book to an analysis."""

import datetime as dt
import math
import random

import pytest

from tidemark import commands

DAY = dt.date(2023, 1, 2)


class Feeds:
    """A vendor of any name; C has no ownership."""

    def bars(self, symbol):
        rng = random.Random(symbol)
        close = 100.0
        for k in range(300):
            close *= math.exp(rng.gauss(0, 0.01 * (1 + ord(symbol[0]) % 3)))
            yield {"date": DAY + dt.timedelta(days=k), "Close": close, "Volume": 1000 + k}

    def quarters(self, symbol):
        return [{"period_end": dt.date(2021 + k // 4, 3 * (k % 4) + 3, 28), "total_revenue": 100.0 - 4 * k, "operating_income": 10.0,
            "net_income": 9.0 - k} for k in range(8)]

    def news(self, symbol):
        return [{"title": "fraud probe", "published": dt.datetime(2023, 3, 1)}] if symbol == "A" else []

    def meta(self, symbol):
        return [{"sector": "Tech"}]

    def ownership(self, symbol):
        if symbol == "C":
            raise OSError("no feed")
        return []


def test_from_an_empty_store_to_an_analysis(spark, tmp_path, capsys):
    store = str(tmp_path)
    run = lambda *args: (commands.main(spark, [args[0], store, *args[1:]]), capsys.readouterr().out)[1]
    assert run("holdings") == ""
    for s, q in (("a", "10"), ("B", "5.5"), ("C", "1"), ("D", "2"), ("E", "3")):
        run("add", s, q, "90")
    run("remove", "D")
    with pytest.raises(SystemExit, match="not held"):
        run("remove", "D")
    assert [x.split() for x in run("holdings").splitlines()] == [["A", "10", "90"], ["B", "5.5", "90"], ["C", "1", "90"], ["E", "3", "90"]]
    with pytest.raises(SystemExit, match="ingest"):
        run("risk")
    out = run("ingest", "--source", "tests.test_commands:Feeds")
    assert "ownership:" in out and out.strip().endswith("1200 bars")
    shown = run("risk", "--horizon", "monthly").splitlines()
    assert len(shown) == 5 and shown[-1].startswith("book: 4 positions")
    first = run("analyze")
    assert "technical: 4 names" in first and "margins contracting" in first and "negative news flow (1 headlines)" in first
    assert "changed since last run" not in run("analyze", "--no-snapshot")
    then = run("analyze", "--as-of", "2023-02-20", "--no-snapshot")
    assert "negative news" not in then and "changed since last run" in then
    assert "earnings declining" in run("briefing")
    assert "low_vol" in run("eval", "--horizon", "5")
    assert "300" in run("coverage")
    (tmp_path / "notes.txt").write_text("The plant in the north was closed. " * 50)
    assert "chunks" in run("docs", "a", f"{store}/notes.txt") and run("docs", "a").startswith("notes.txt: ")
    assert run("ask", "a", "plant closed in the north", "-k", "1").startswith("[1] ")
