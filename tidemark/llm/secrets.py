"""Secret scans by grammar inference.

Labelled credentials of each format become a frequency prefix tree whose statistically compatible states are merged
into a probabilistic automaton; ordinary tokens give a background automaton in the same way. Every candidate token is
scored by its likelihood under the formats against the background. Fixed rules run beside, and their spans stay.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_arrow_batches, written

# The base rules' patterns, the least lengths, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "model")

#: Least length of a candidate, as of the value that the base rules ask for.
LEAST_LENGTH = 8
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
PIECE = re.compile(r"[A-Za-z0-9+_-]{8,}")
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Bound of the sample that the automata are fitted on: documents, first by a hash of their id, and strings of a format.
SAMPLE_DOCUMENTS = 4000
SAMPLE_STRINGS = 1500
#: States merge when their branching differs by less than the Hoeffding bound at this confidence.
ALPHA = 0.05
#: Longer strings are no examples to learn a format from: the sample is bounded by this too. All are scored.
LONGEST_EXAMPLE = 256
#: Texts whose candidates are scored together.
JUDGED_TEXTS = 200
#: A candidate is a secret when its best format beats the background by so many nats a character.
MARGIN = 0.75
REPEATED = 1.0
#: And by so many nats in all, as most tokens aren't secrets: short ones have to be likelier by far.
EVIDENCE = 24.0
MIN_CREDENTIALS = 8
#: Tokens longer than this are scored one by one, others many at once.
MANY_LENGTH = 512
MANY_CELLS = 1 << 21


# Public credential formats as (name, literal and (alphabet, length) parts). Labelled examples are drawn from them.
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM = _LOWER + _UPPER + _DIGITS
FORMATS = (
    ("access_key", "AKIA", (_UPPER + _DIGITS, 16)),
    ("secret_key", (_ALNUM + "+/", 40)),
    ("hosting_token", "ghp_", (_ALNUM, 36)),
    ("hosting_pat", "glpat-", (_ALNUM + "_-", 20)),
    ("chat_bot", "xoxb-", (_DIGITS, 12), "-", (_DIGITS, 12), "-", (_ALNUM, 24)),
    ("maps_key", "AIza", (_ALNUM + "_-", 35)),
    ("payment_key", "sk_live_", (_ALNUM, 24)),
    ("digest", (_DIGITS + "abcdef", 40)),
)
#: Labelled examples drawn of each format.
EXAMPLES = 400


def drawn_examples(n: int = EXAMPLES, seed: int = 5) -> dict[str, list[str]]:
    """``n`` labelled credentials of each format, the same on each call."""
    rng = random.Random(seed)
    return {name: ["".join(p if isinstance(p, str) else "".join(rng.choices(p[0], k=p[1])) for p in parts) for _ in range(n)] for name,
        *parts in FORMATS}


END = ""


class _Tree:
    """Frequency prefix tree: counts of passing and ending strings, and children by symbol."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.moves: list[Counter] = [Counter()]

    def add(self, symbols: str) -> None:
        at = 0
        for s in symbols:
            self.moves[at][s] += 1
            if s not in self.next[at]:
                self.next.append({})
                self.moves.append(Counter())
                self.next[at][s] = len(self.next) - 1
            at = self.next[at][s]
        self.moves[at][END] += 1


def _differ(f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
    return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


_CODE = np.full(128, len(SYMBOLS), np.int64)
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))


class Automaton:
    """Deterministic probabilistic automaton: log probability and next state by state and symbol, the last symbol
    being the end."""

    def __init__(self, steps: list[dict[str, tuple[float, int]]], unseen: float):
        self.log_p = np.full((len(steps), len(SYMBOLS) + 1), unseen)
        self.next = np.zeros((len(steps), len(SYMBOLS) + 1), np.int64)
        for state, found in enumerate(steps):
            for symbol, (log_p, to) in found.items():
                at = len(SYMBOLS) if symbol == END else SYMBOLS.index(symbol)
                self.log_p[state, at], self.next[state, at] = log_p, to

    def log_likelihoods(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Mean log probability of a character, the end included, of strings as rows of symbol numbers. Rows are in
        order of falling length."""
        state, total = np.zeros(len(codes), np.int64), np.zeros(len(codes))
        for k in range(codes.shape[1]):
            n = int(np.searchsorted(-lengths, -k))  # rows longer than k
            c = codes[:n, k]
            total[:n] += self.log_p[state[:n], c]
            state[:n] = self.next[state[:n], c]
        return (total + self.log_p[state, -1]) / (lengths + 1)


def infer(strings: list[str], alpha: float = ALPHA) -> Automaton:
    """Red-blue state merging: each frontier state of the prefix tree joins the first kept state that it and its
    whole subtree are compatible with by the Hoeffding test, else it is kept."""
    tree = _Tree()
    for s in strings:
        tree.add(s)
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    nxt, moves = tree.next, tree.moves

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n1, n2 = sum(moves[x].values()), sum(moves[y].values())
            if not n1 or not n2:
                continue
            for s in moves[x].keys() | moves[y].keys():
                if _differ(moves[x][s], n1, moves[y][s], n2, bound):
                    return False
                if s in nxt[x] and s in nxt[y] and nxt[x][s] != nxt[y][s]:
                    todo.append((nxt[x][s], nxt[y][s]))
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            moves[x].update(moves[y])
            for s, child in nxt[y].items():
                if s in nxt[x]:
                    if nxt[x][s] != child:
                        todo.append((nxt[x][s], child))
                else:
                    nxt[x][s] = child

    red = [0]
    blue = [(0, s) for s in sorted(nxt[0])]
    while blue:
        parent, s = blue.pop(0)
        state = nxt[parent][s]
        if state in red:
            continue
        mate = next((r for r in red if compatible(r, state)), None)
        if mate is None:
            red.append(state)
            blue.extend((state, c) for c in sorted(nxt[state]))
        else:
            nxt[parent][s] = mate
            fold(mate, state)
            blue.extend((mate, c) for c in sorted(nxt[mate]) if nxt[mate][c] not in red and (mate, c) not in blue)
    place = {r: i for i, r in enumerate(red)}
    steps = []
    for r in red:
        total = sum(moves[r].values()) + 1
        steps.append({s: (math.log(n / total), place.get(nxt[r].get(s, -1), 0)) for s, n in moves[r].items() if n})
    return Automaton(steps, math.log(1e-4))


@dataclass(frozen=True)
class SecretModel:
    """Automata of the credential formats by name, and of ordinary tokens."""

    formats: dict[str, Automaton]
    background: Automaton

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Nats a character by which the best format beats the background; minus infinity where that is less than
        EVIDENCE in all, and where a token's own symbol counts beat the format by REPEATED: what repeats itself so much
        is no credential."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        order, out, at = np.argsort(-lengths, kind="stable"), np.zeros(len(tokens)), 0
        while at < len(order):
            longest = max(1, int(lengths[order[at]]))
            part = order[at : at + max(1, MANY_CELLS // longest if longest <= MANY_LENGTH else 1)]
            joined = np.frombuffer("".join(tokens[i] for i in part).encode("ascii"), np.uint8)
            codes = np.full((len(part), longest), len(SYMBOLS), np.int64)
            codes[np.arange(longest) < lengths[part, None]] = _CODE[joined]
            best = np.max([a.log_likelihoods(codes, lengths[part]) for a in self.formats.values()], axis=0)
            out[part] = best - self.background.log_likelihoods(codes, lengths[part])
            out[part[out[part] * (lengths[part] + 1) < EVIDENCE]] = -np.inf
            for k in np.flatnonzero(out[part] >= MARGIN).tolist():
                if own_log_likelihood(tokens[part[k]]) > best[k] + REPEATED:
                    out[part[k]] = -np.inf
            at += len(part)
        return out


def own_log_likelihood(token: str) -> float:
    """Mean log probability of a character of ``token`` when each symbol's chance is learned from those before it
    (half a count for each symbol to begin with)."""
    half = len(SYMBOLS) / 2
    total = math.lgamma(half) - math.lgamma(len(token) + half) + sum(math.lgamma(n + 0.5) - math.lgamma(0.5) for n in Counter(token).values())
    return total / len(token)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the fixed rules' matches, in code points."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _covered(spans: list[tuple[int, int, int]]):
    """A test whether ``start, end`` meets one of the spans (sorted by start), in the logarithm of their number."""
    starts, ends, furthest = [a for a, _, _ in spans], [], 0
    for _, _, b in spans:
        furthest = max(furthest, b)
        ends.append(furthest)
    return lambda a, b: (k := bisect_left(starts, b)) > 0 and ends[k - 1] > a


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    """``(start, end)`` of what may be a credential where no span lies: for each run of token characters first the
    run without punctuation at its ends, then its pieces between ``/``, ``.`` and ``=``."""
    met, out = _covered(spans), []
    for m in RUN.finditer(text):
        run = m.group()
        a = m.start() + len(run) - len(run.lstrip("+/_.=-"))
        b = m.end() - len(run) + len(run.rstrip("+/_.=-"))
        each = [(a, b)] if b - a >= LEAST_LENGTH else []
        if "/" in run or "." in run or "=" in run:
            each += [p.span() for p in PIECE.finditer(text, m.start(), m.end()) if p.span() != (a, b)]
        each = [x for x in each if not met(*x)] if spans else each
        if each:
            out.append(each)
    return out


def labelled_strings(text: str) -> list[tuple[str, str]]:
    """``(format, string)``: what the fixed rules label as a credential, and ``ordinary`` for all other candidates."""
    spans = base_spans(text)
    out = [(KINDS[kind], ASSIGN.match(text, start).group(2) if kind == 0 else text[start:end]) for start, kind, end in spans]
    return out + [("ordinary", text[a:b]) for each in candidates(text, spans) for a, b in each]


def fit_on_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SecretModel:
    """Automata of the drawn formats, and of what the fixed rules label in a bounded sample: SAMPLE_DOCUMENTS whole
    documents, SAMPLE_STRINGS strings of each kind. A kind with under MIN_CREDENTIALS strings gives no automaton;
    all other candidates of the sample and drawn numbers give the background."""
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    chosen = ids.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCUMENTS)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def found(batches):
        for batch in batches:
            got = [x for t in batch.column(0).to_pylist() for x in dict.fromkeys(labelled_strings(t or "")) if len(x[1]) <= LONGEST_EXAMPLE]
            yield pa.record_batch([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.string())], ["format", "value"])

    each = written(picked.select("text").mapInArrow(found, "format string, value string").distinct(), "secret-strings")
    strings: dict[str, list[str]] = defaultdict(list)
    for name in (*KINDS[:3], "ordinary"):
        for r in each.where(F.col("format") == name).orderBy(F.xxhash64("value"), "value").limit(SAMPLE_STRINGS).collect():
            strings[name].append(r.value)
    return fit(strings)


def drawn_numbers(n: int = EXAMPLES, seed: int = 6) -> list[str]:
    """Numbers that are no secrets by their form: long plain ones as of cards and orders, groups between dots or
    hyphens as of network addresses, dates and telephones."""
    rng = random.Random(seed)
    group = lambda k: "".join(rng.choices(_DIGITS, k=k))
    plain = [group(rng.randint(8, 20)) for _ in range(n)]
    addresses = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(n)]
    return plain + addresses + ["-".join(group(rng.randint(2, 4)) for _ in range(rng.randint(3, 5))) for _ in range(n)]


def drawn_names(n: int = EXAMPLES // 4, seed: int = 7) -> list[str]:
    """Made names that are no secrets by their form: hosts with numbered parts, as in mail addresses, and files."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfghjklmnprstvwxz") + rng.choice("aeiouy") + rng.choice(("", "", "l", "n", "r", "s")) for _ in range(
        rng.randint(1, 4)))
    digits = lambda: "".join(rng.choices(_DIGITS, k=rng.choice((0, 0, 1, 1, 2, 4))))
    hosts = [".".join([word() + digits() for _ in range(rng.randint(1, 3))] + [rng.choice(("com", "org", "net", "info", word()[:2]))]) for _ in range(n)]
    files = [word() + word() + digits() + "." + rng.choice(("txt", "html", "pdf", "py", "json")) for _ in range(n)]
    return [x for x in hosts + files if len(x) >= LEAST_LENGTH]


def fit(strings: dict[str, list[str]]) -> SecretModel:
    """Automata of the drawn formats and of the labelled ``strings`` by kind; kind ``ordinary`` is the background, in
    capitals too, as headings are, and with drawn numbers and names, which a small sample may hold none of."""
    labelled = drawn_examples() | {n: strings[n] for n in KINDS[:3] if len(strings.get(n, [])) >= MIN_CREDENTIALS}
    ordinary = strings.get("ordinary", [])
    return SecretModel({n: infer(x) for n, x in labelled.items()}, infer(ordinary + [s.upper() for s in ordinary] + drawn_numbers() + drawn_names()))


class Scanner:
    """Spans of texts: the fixed rules' and, where none of those lies, candidates that the model takes for secrets: of
    a run of token characters and its pieces those that score best and don't overlap."""

    def __init__(self, model: SecretModel):
        self.model = model
        self.known: dict[str, float] = {}

    def judge(self, tokens: set[str]) -> None:
        if len(self.known) >= 1 << 17:
            self.known.clear()
        new = sorted(t for t in tokens if t not in self.known)
        self.known.update(zip(new, self.model.scores(new).tolist()))

    def spans(self, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
        """``(base, all)`` of each text, each by start and then kind."""
        base = [base_spans(t) for t in texts]
        found = [candidates(t, spans) for t, spans in zip(texts, base)]
        out = []
        for at in range(0, len(texts), JUDGED_TEXTS):
            here = range(at, min(at + JUDGED_TEXTS, len(texts)))
            self.judge({texts[i][a:b] for i in here for each in found[i] for a, b in each})
            for i in here:
                more: list[tuple[int, int, int]] = []
                for each in found[i]:
                    taken: list[tuple[int, int, int]] = []
                    for score, a, b in sorted((-self.known[texts[i][a:b]], a, b) for a, b in each):
                        if -score >= MARGIN and all(b <= x or y <= a for x, _, y in taken):
                            taken.append((a, 3, b))
                    more += taken
                out.append((base[i], sorted(base[i] + more)))
        return out


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SecretModel | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model``.

    ``spans`` lists kind:start:end in code points, ends exclusive, by start and then kind. Null and empty texts have
    no spans; repeated rows are rows of their own; an empty table gives no rows; other columns are ignored. A text of
    any length is scanned whole, by the task that reads it.
    """
    bound_arrow_batches(docs.sparkSession)
    model = model or fit_on_sample(docs, id_col, text_col)

    def run(batches):
        scanner = Scanner(model)
        for batch in batches:
            got = scanner.spans([t or "" for t in batch.column(1).to_pylist()])
            counts = [Counter(k for _, k, _ in found) for _, found in got]
            yield pa.record_batch(
                [
                    batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)),
                    pa.array([hashlib.sha256(_shown(base).encode()).hexdigest() for base, _ in got], pa.string()),
                    pa.array([_shown(found) for _, found in got], pa.string()), pa.array([c[3] for c in counts], pa.int64()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")
