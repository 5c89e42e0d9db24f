"""Running an analysis: the plug-in registry, progress events, memo of results, call traces."""

from __future__ import annotations

import copy
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field
from queue import Queue
from threading import Thread

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.lineage import cut
from tidemark.operators import analysis, scoring


@dataclass(frozen=True)
class Agent:
    """A named reading: a function of the run's tables that gives a DataFrame by symbol. ``measures`` are aggregates over
    its rows, taken while the run reads them; ``note`` words what they and ``rows`` say."""

    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame | None]
    scope: str = "per_stock"
    measures: dict[str, Column] = field(default_factory=dict)
    note: Callable[[dict], str] | None = None


def _aggregates(measures: dict[str, Column]) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in measures.items()]]


def _seen(df: DataFrame, measures: dict[str, Column], watched: Observation, wait: float = 5.0) -> dict:
    """What a run saw of a table's rows; it tells so a moment after its end. A table that the run didn't read, or that
    it left out as it knew it to be empty, is read for its own sake."""
    until, there = time.monotonic() + wait, watched._jo.future()
    while not there.isCompleted() and time.monotonic() < until:
        time.sleep(0.02)
    if there.isCompleted() and watched._jo.getRow().size():
        return watched.get
    return df.agg(*_aggregates(measures)).first().asDict()


class Registry:
    """Agents in the order they run."""

    def __init__(self, agents: list[Agent] | None = None):
        self.agents = list(agents or [])

    def register(self, agent: Agent) -> None:
        self.agents = [a for a in self.agents if a.name != agent.name] + [agent]

    def analyse(
        self, tables: dict[str, DataFrame], on_event: Callable[[str, dict], None] = lambda kind, what: None, context: Callable[[],
            dict] | None = None,
        cards: Callable[[dict[str, DataFrame]], list[dict]] | None = None, narrate: Callable[[dict], dict] | None = None,
    ) -> dict[str, DataFrame]:
        """Plans of all agents. Events tell the run's progress: run_start, context_loaded with what ``context`` says,
        agent_start when an agent's plan is made; then, with ``cards``, the plans run, and agent_done tells the rows
        and measures that this very run counted; ranking and a card for each of ``cards``, the narration of each card,
        and run_complete; or error. Without ``cards`` nothing runs, and agent_done only says that there is a plan."""
        began = time.monotonic()
        on_event("run_start", {"agents": [a.name for a in self.agents], "narrate": narrate is not None})
        if context is not None:
            on_event("context_loaded", context())
        out: dict[str, DataFrame] = {}
        watched: dict[str, Observation] = {}
        bare: dict[str, DataFrame] = {}
        for a in self.agents:
            planning = time.monotonic()
            on_event("agent_start", {"agent": a.name, "scope": a.scope})
            try:
                got = a.run(tables | out)
            except Exception as e:
                on_event("error", {"agent": a.name, "error": str(e)})
                raise
            if got is not None:
                bare[a.name], watched[a.name] = got, Observation()
                out[a.name] = got.observe(watched[a.name], *_aggregates(a.measures)) if cards is not None else got
            on_event("agent_planned", {"agent": a.name, "there": got is not None, "plan_ms": round((time.monotonic() - planning) * 1000, 1)})
        made: list[dict] = []
        if cards is not None:
            try:
                made = cards(out)
            except Exception as e:
                on_event("error", {"error": str(e)})
                raise
        for a in self.agents:
            told = {"agent": a.name, "scope": a.scope, "there": a.name in out}
            if a.name in out and cards is not None:
                counted = _seen(bare[a.name], a.measures, watched[a.name])
                told |= {"rows": counted["rows"], "measures": {k: counted[k] for k in a.measures}, "note": a.note(counted) if a.note else "done"}
            on_event("agent_done", told)
        if cards is not None:
            on_event("ranking", {"order": [c["symbol"] for c in made]})
            for rank, card in enumerate(made, 1):
                on_event("card", {"rank": rank, **card})
        told = narrated(made, narrate, on_event)
        on_event("run_complete", {"agents": list(out), "n_cards": len(made), "n_narrated": len(told),
            "run_ms": round((time.monotonic() - began) * 1000, 1)})
        return out


# The analysis of a book as a run


def _labels(column: str, states) -> dict[str, Column]:
    return {state: F.count_if(F.col(column) == state) for state in states}


def _counted(states) -> Callable[[dict], str]:
    """Counts such as ``2 uptrend · 1 downtrend``, the largest first, those of none left out."""
    return lambda seen: " · ".join(f"{seen[s]} {s}" for s in sorted(states, key=lambda s: (-seen[s], s)) if seen[s])


def _risk_note(seen: dict) -> str:
    vol, share = (f"{seen[k]:.1f}" if seen[k] is not None else "—" for k in ("vol_pct", "top_risk_pct"))
    return f"book vol {vol}% · top risk {seen['top_symbol'] or '—'} {share}%"


def book_agents(read: dict[str, DataFrame]) -> list[Agent]:
    """Agents that give the readings of a book (:func:`analysis.readings`), with what a monitor shows of each."""
    trends, quarters, moods, levels = list(scoring.TREND_SIGNS), list(scoring.GROWTH_SIGNS), list(scoring.SENTIMENT_SIGNS), ["high", "moderate", "low"]
    risk = {"vol_pct": F.max("portfolio_vol_pct"), "top_risk_pct": F.max("risk_contribution_pct"), "top_symbol": F.max_by("symbol",
        F.struct("risk_contribution_pct", "symbol")), "beta": F.sum(F.col("weight_pct") / 100 * F.col("beta"))}
    known = {
        "risk": (risk, _risk_note),
        "technical": (_labels("trend", trends), lambda s: f"{s['rows']} names · {_counted(trends)(s)}"),
        "fundamental": (_labels("earnings_growth", quarters), lambda s: f"{s['rows']} names with quarters on file · earnings {_counted(quarters)(s)}"),
        "macro": ({"top_sector": F.max_by("sector", F.struct("sector_weight_pct", "sector")), "top_sector_pct": F.max("sector_weight_pct")},
            lambda s: f"top sector {s['top_sector'] or '—'} {s['top_sector_pct'] or 0:.1f}%"),
        "sentiment": (_labels("label", moods) | {"headlines": F.sum("n_articles")}, lambda s: f"news flow on {s['rows']} names · {_counted(moods)(s)}"),
        "ownership": (_labels("institutional", levels), lambda s: f"holdings of {s['rows']} names · {_counted(levels)(s)}"),
        "guidance": ({}, lambda s: f"guidance of {s['rows']} names"),
    }
    scopes = {"risk": "portfolio", "macro": "portfolio"}
    return [Agent(name, lambda tables, df=df: df, scopes.get(name, "per_stock"), *known.get(name, ({}, None))) for name, df in read.items()]


def analyse_book(
    positions: DataFrame, feeds: analysis.Feeds, options: analysis.Options = analysis.Options(), on_event: Callable[[str, dict],
        None] = lambda kind, what: None,
    prior: DataFrame | None = None, first: int = 100, narrate: Callable[[dict], dict] | None = None,
) -> DataFrame:
    """The cards of a book (:func:`analysis.cards`), kept as a table, with a run's events: what each reading says in short,
    then the ``first`` cards by share of risk. Only these cards and a few figures of each reading reach the driver."""
    made: list[DataFrame] = []

    def ranked(read: dict[str, DataFrame]) -> list[dict]:
        made.append(cut(analysis.cards_of(read, options, prior)))
        return [r.asDict(True) for r in made[0].where(F.col("place") <= first).orderBy("place").collect()]

    held = lambda: {"as_of": options.as_of or "latest", "horizon": options.horizon}
    Registry(book_agents(analysis.readings(positions, feeds, options))).analyse({}, on_event, held, ranked, narrate)
    return made[0]


def narrated(cards: list[dict], narrate: Callable[[dict], dict] | None, on_event: Callable[[str, dict], None], at_once: int = 5) -> dict[str, dict]:
    """Narration by symbol, some cards at once. A card that fails is told and left out; without a callable, or cards,
    it is skipped."""
    if narrate is None or not cards:
        on_event("narration_skipped", {"reason": "no model" if narrate is None else "no cards"})
        return {}
    on_event("narration_start", {"count": len(cards)})
    out: dict[str, dict] = {}
    with ThreadPoolExecutor(min(at_once, len(cards))) as pool:
        calls = {pool.submit(narrate, card): card["symbol"] for card in cards}
        for call in as_completed(calls):
            if call.exception() is None:
                out[calls[call]] = call.result()
                on_event("narration_done", {"symbol": calls[call], "card": call.result()})
            else:
                on_event("narration_error", {"symbol": calls[call], "error": str(call.exception())})
    on_event("narration_summary", {"narrated": len(out), "failed": len(cards) - len(out)})
    return out


def streamed(run: Callable[[Callable[[str, dict], None]], object], pace: float = 0.14) -> Iterator[tuple[str, dict]]:
    """Events of ``run`` as they come, at least ``pace`` seconds apart, and ``end`` last. ``run`` works in a thread and
    is given the callback; what it raises becomes an ``error`` event."""
    waiting: Queue[tuple[str, dict] | None] = Queue()

    def work() -> None:
        try:
            run(lambda kind, what: waiting.put((kind, what)))
        except Exception as e:  # noqa: BLE001  told to the reader
            waiting.put(("error", {"error": str(e)}))
        waiting.put(None)

    Thread(target=work, daemon=True).start()
    while (event := waiting.get()) is not None:
        yield event
        time.sleep(pace)
    yield "end", {}


class Memo:
    """Results by key for a time; a caller gets a copy of its own. Cleared on writes."""

    def __init__(self, seconds: float = 300, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.held = seconds, clock, {}

    def get(self, key, make: Callable[[], object]):
        at, value = self.held.get(key, (None, None))
        if at is None or self.clock() - at >= self.seconds:
            value = make()
            self.held[key] = (self.clock(), value)
        return copy.deepcopy(value)

    def clear(self) -> None:
        self.held.clear()


@dataclass
class Trace:
    """Calls to outside models: label, model, tokens, latency."""

    calls: list[tuple[str, str, int, int, float]] = field(default_factory=list)

    def record(self, label: str, model: str, tokens_in: int, tokens_out: int, ms: float) -> None:
        self.calls.append((label, model, tokens_in, tokens_out, ms))

    def timed(self, label: str, model: str, call: Callable[[], tuple[object, int, int]]):
        """The first thing that ``call`` gives, its tokens (the other two) and time recorded, also when it fails."""
        began, tokens = time.monotonic(), (0, 0)
        try:
            value, *tokens = call()
            return value
        finally:
            self.record(label, model, *tokens, (time.monotonic() - began) * 1000)


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """``calls`` with ``cost``, by the longest price prefix that the model's name begins with; null if there is none.
    Prices (``prefix, per_m_in, per_m_out``) are a handful of rows."""
    joined = calls.withColumn("__id", F.monotonically_increasing_id()).join(F.broadcast(prices), F.col("model").startswith(F.col("prefix")), "left")
    cost = F.col("input_tokens") / 1e6 * F.col("per_m_in") + F.col("output_tokens") / 1e6 * F.col("per_m_out")
    best = joined.withColumn("cost", cost).groupBy("__id").agg(F.max_by(F.struct(*calls.columns, "cost"), F.coalesce(F.length("prefix"),
        F.lit(0))).alias("r"))
    return best.select(*[F.col(f"r.{c}").alias(c) for c in (*calls.columns, "cost")])


def trace_summary(costed: DataFrame) -> DataFrame:
    return costed.agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
            F.sum("latency_ms").alias("latency_ms"),
        F.sum("cost").alias("cost"), F.bool_and(F.col("cost").isNotNull()).alias("complete"),
    )
