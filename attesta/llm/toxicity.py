"""Toxicity by a weighted finite-state pattern grammar.

A text is read as clauses of token classes: insults (a lexicon of words and word beginnings learned
from labels, each with a weight), threats, targets, negations, reported speech. Small transducers
each follow one phenomenon: they pass classes on and mark the insults and threats within their
scope. Composed into two machines, of which one reads a clause forwards and the other what the first
passes on backwards, they turn a clause into matched patterns, such as a negated insult or a threat
with a target. What a pattern counts for, for or against, is learned by logistic regression; of a
pattern that the labels say nothing of, a prior weight stays.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, crc_mod, documents_of, parts

FOLDS, HELD_OUT = 5, 0
#: The bounded sample of labelled documents that is learned from.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 5000
#: Bytes of its texts, of either kind (but one text at least).
SAMPLE_BYTES = 32_000_000
SEED = 11
#: Lengths of word beginnings that can be learned, the least number of toxic documents with a
#: lexicon entry, and the largest chance that it is there by accident.
PREFIXES = range(4, 9)
LEAST_DOCUMENTS, BY_CHANCE = 4, 1e-6
#: Words whose class a worker remembers.
CACHE_WORDS = 500_000

#: Words that have a class whatever the labels, in English, German, French and Spanish.
THREATS = frozenset("kill hurt destroy beat burn shoot stab töten umbringen schlagen vernichten tuer frapper détruire brûler matar golpear destruir quemar".split())
TARGETS = frozenset("you your yours yourself he she they them him her du dich dir ihr euch sie tu toi te vous ils elle ustedes vosotros usted ellos ellas ti".split())
NEGATIONS = frozenset("not no never none nobody nothing neither isn't aren't don't kein keine nicht nie niemals jamais aucun nunca tampoco ningún pas ne".split())
REPORTS = frozenset("said says wrote writes quoted claimed claims reported reportedly alleged called sagte schrieb behauptete zitierte déclaré écrit selon dijo escribió según afirmó".split())

#: Classes of tokens: other, insult, threat, target, negation, report, quotation mark.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»]")
_QUOTES = frozenset('"“”„«»')
#: Ends a clause; a line feed also ends a quotation.
_CLAUSE = re.compile(r"[.!?;]+|\n+")


@dataclass(frozen=True)
class Symbol:
    """A token class, and the marks that transducers have put on it."""

    kind: int
    marks: frozenset[str] = frozenset()

    def marked(self, mark: str) -> "Symbol":
        return Symbol(self.kind, self.marks | {mark})


class Transducer:
    """A deterministic finite-state transducer: ``step(state, symbol)`` is the next state and the
    symbol passed on. Arcs are worked out once and kept."""

    start: object = 0

    def __init__(self) -> None:
        self._arcs: dict[tuple, tuple] = {}

    def arc(self, state, symbol: Symbol) -> tuple[object, Symbol]:
        raise NotImplementedError

    def step(self, state, symbol: Symbol) -> tuple[object, Symbol]:
        key = (state, symbol)
        found = self._arcs.get(key)
        if found is None:
            found = self._arcs[key] = self.arc(state, symbol)
        return found


class Scope(Transducer):
    """For ``reach`` tokens after a trigger, symbols of the kinds in ``over`` get a mark."""

    def __init__(self, trigger: int, over: Iterable[int], mark: str, reach: int):
        super().__init__()
        self._trigger, self._over, self._mark, self._reach = trigger, frozenset(over), mark, reach

    def arc(self, state, symbol):
        out = symbol.marked(self._mark) if state and symbol.kind in self._over else symbol
        return self._reach if symbol.kind == self._trigger else max(0, state - 1), out


class Reported(Transducer):
    """Between quotation marks, and after a word of reporting to the end of the clause, insults and
    threats are somebody else's. A state is (after such a word, inside a quotation)."""

    start = (False, False)

    def arc(self, state, symbol):
        after, inside = state
        if symbol.kind == QUOTE:
            return (after, not inside), symbol
        if symbol.kind == REPORT:
            return (True, inside), symbol
        return state, symbol.marked("reported") if (after or inside) and symbol.kind in (INSULT, THREAT) else symbol


class Composed(Transducer):
    """a, whose output b reads: its states are pairs."""

    def __init__(self, a: Transducer, b: Transducer):
        super().__init__()
        self._a, self._b, self.start = a, b, (a.start, b.start)

    def arc(self, state, symbol):
        one, symbol = self._a.step(state[0], symbol)
        two, symbol = self._b.step(state[1], symbol)
        return (one, two), symbol


#: In how many tokens a target before or after, another insult before, and a negation before counts.
TARGET_BEFORE, TARGET_AFTER, REPEATED_WITHIN, NEGATED_WITHIN, REPORT_AFTER = 5, 3, 4, 3, 8


class Grammar:
    """Insult and threat clauses with their targets, negations and reported speech: one machine reads
    a clause forwards, the other reads what that passes on backwards."""

    def __init__(self) -> None:
        both = (INSULT, THREAT)
        targeted, repeated = Scope(TARGET, both, "targeted", TARGET_BEFORE), Scope(INSULT, (INSULT,), "repeated", REPEATED_WITHIN)
        self._unquoted = Composed(Composed(targeted, repeated), Scope(NEGATION, both, "negated", NEGATED_WITHIN))
        self._forwards = Composed(self._unquoted, Reported())
        self._backwards = Composed(Scope(TARGET, both, "targeted", TARGET_AFTER), Scope(REPORT, both, "reported", REPORT_AFTER))

    def read(self, kinds: list[int], inside: bool = False) -> list[Symbol]:
        """The symbols of a clause with their marks. inside: whether it begins within a quotation."""
        state, symbols = (self._unquoted.start, (False, inside)), []
        for kind in kinds:
            state, symbol = self._forwards.step(state, Symbol(kind))
            symbols.append(symbol)
        state = self._backwards.start
        for i in range(len(symbols) - 1, -1, -1):
            state, symbols[i] = self._backwards.step(state, symbols[i])
        return symbols


#: What a matched pattern is counted as, and its weight before anything is learned of it.
PATTERNS = {
    "insult": 1.0, "insult targeted": 1.2, "insult repeated": 1.0, "insult negated": 0.0, "insult reported": 0.0,
    "threat": 0.0, "threat targeted": 2.0, "threat negated": 0.0, "threat reported": 0.0,
}
#: How firmly the prior weights hold, in documents.
STIFFNESS = 0.3
#: Patterns that nobody asserts.
UNASSERTED = frozenset(p for p in PATTERNS if p.endswith(("negated", "reported")))


def pattern_of(symbol: Symbol) -> str:
    name = "insult" if symbol.kind == INSULT else "threat"
    for mark in ("reported", "negated", "targeted", "repeated"):
        if mark in symbol.marks and f"{name} {mark}" in PATTERNS:
            return f"{name} {mark}"
    return name


def _lower(text: str) -> str:
    return text.lower().replace("’", "'")


def words_of(text: str) -> list[str]:
    return _WORD.findall(_lower(text))


def beginnings(word: str) -> list[str]:
    return [word[:k] + "*" for k in PREFIXES if len(word) > k]


def _tail(n: float, k: float, p: float) -> float:
    """An upper bound of the chance of k or more hits in n draws of chance p (Chernoff)."""
    q = k / n
    if q <= p:
        return 1.0
    d = q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0)
    return math.exp(-n * d)


def learn_lexicon(rows: list[tuple[str, int]], words_in: Callable[[str], list[str]] = words_of) -> dict[str, float]:
    """Words and word beginnings that mark toxic documents, with their smoothed log odds.

    Copies of a document would make any of its words look like a mark. So a toxic document counts
    for an entry in the proportion of the entry's occurrences that have neighbours of their own."""
    toxic_words = [words_in(t) for t, y in rows if y]
    n_toxic, n_clean = len(toxic_words), len(rows) - len(toxic_words)
    if not n_toxic or not n_clean:
        return {}
    share = n_toxic / (n_toxic + n_clean)
    entries = lambda words: words.union(*map(beginnings, words))
    toxic: Counter = Counter()
    for words in toxic_words:
        toxic.update(entries(set(words)))
    candidates = {f for f, n in toxic.items() if n >= LEAST_DOCUMENTS and _tail(n, n, share) < BY_CHANCE}
    clean = Counter(f for t, y in rows if not y for f in entries(set(words_in(t))) & candidates)
    candidates = {f for f in candidates if _tail(toxic[f] + clean[f], toxic[f], share) < BY_CHANCE}
    occurrences: Counter = Counter()
    neighbours: dict[str, set] = {f: set() for f in candidates}
    for words in toxic_words:
        for before, word, after in zip(["", *words], words, [*words[1:], ""]):
            for f in (word, *beginnings(word)):
                if f in candidates:
                    occurrences[f] += 1
                    neighbours[f].add((before, after))
    out = {}
    for f in candidates:
        k, other = toxic[f] * len(neighbours[f]) / occurrences[f], clean[f]
        if k >= LEAST_DOCUMENTS and _tail(k + other, k, share) < BY_CHANCE:
            odds = math.log((k + 0.5) / (n_toxic + 1)) - math.log((other + 0.5) / (n_clean + 1))
            if odds > 1.5:
                out[f] = odds
    return out


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: np.array([*PATTERNS.values(), 0.0, 0.0]))
    bias: float = -6.0
    _grammar: Grammar = field(default_factory=Grammar, repr=False)
    _known: dict[str, tuple[int, float]] = field(default_factory=dict, repr=False)

    def classify(self, word: str) -> tuple[int, float]:
        """The class and the weight of a lower-case word."""
        found = self._known.get(word)
        if found is None:
            weight = max((self.lexicon.get(f, 0.0) for f in (word, *beginnings(word))), default=0.0)
            kind = INSULT if weight else THREAT if word in THREATS else TARGET if word in TARGETS else NEGATION if word in NEGATIONS else REPORT if word in REPORTS else OTHER
            if len(self._known) >= CACHE_WORDS:
                self._known.clear()
            found = self._known[word] = (kind, weight or 1.0)
        return found

    def clauses(self, text: str) -> Iterator[tuple[str, list[tuple[str, str, float]]]]:
        """Each clause with a match, and its matches: (word, pattern, weight)."""
        classify = self.classify
        lower = _lower(text)
        if not any(classify(w)[0] in (INSULT, THREAT) for w in set(_WORD.findall(lower))):
            return
        inside, at = False, 0
        for end in (*_CLAUSE.finditer(lower), None):
            clause = lower[at : end.start() if end else len(lower)]
            tokens = [(t, *((QUOTE, 0.0) if t in _QUOTES else classify(t))) for t in _TOKEN.findall(clause)]
            if any(kind in (INSULT, THREAT) for _, kind, _ in tokens):
                symbols = self._grammar.read([kind for _, kind, _ in tokens], inside)
                yield clause, [(token, pattern_of(symbol), weight) for (token, kind, weight), symbol in zip(tokens, symbols) if kind in (INSULT, THREAT)]
            if end:
                inside = end[0][0] != "\n" and inside ^ sum(kind == QUOTE for _, kind, _ in tokens) % 2
                at = end.end()

    def features(self, text: str) -> np.ndarray:
        """log(1 + the clauses' weights) by pattern; of what is asserted, neither negated nor
        reported, the heaviest clause's insults, and in how many clauses there is any."""
        sums, heaviest, count = dict.fromkeys(PATTERNS, 0.0), 0.0, 0
        for _, found in self.clauses(text):
            asserted = [(pattern, weight) for _, pattern, weight in found if pattern not in UNASSERTED]
            for _, pattern, weight in found:
                sums[pattern] += weight
            heaviest = max(heaviest, sum(weight for pattern, weight in asserted if pattern.startswith("insult")))
            count += bool(asserted)
        return np.log1p(np.array([*sums.values(), heaviest, count]))

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.features(text or "") @ self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def __getstate__(self):
        return {"lexicon": self.lexicon, "weights": self.weights, "bias": self.bias}

    def __setstate__(self, state):
        self.__init__(**state)


def fit(rows: list[tuple[str, int]], share: float | None = None, rounds: int = 40) -> ToxicityModel:
    """A model from (text, toxic). share: of toxic documents among all, if rows are not in that
    proportion. The patterns' weights are fitted on half of the rows with the lexicon of the other
    half, both ways round, by Newton's method with a normal prior around ``PATTERNS``; what speaks
    against toxicity gets a negative weight."""
    y = np.array([label for _, label in rows], float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(learn_lexicon(rows), bias=30.0 if len(y) and y[0] else -30.0)
    words: dict[str, list[str]] = {}

    def words_in(text: str) -> list[str]:
        if text not in words:
            words[text] = words_of(text)
        return words[text]

    half = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % 2 for t, _ in rows]
    halves = [ToxicityModel(learn_lexicon([r for r, k in zip(rows, half) if k != h], words_in)) for h in (0, 1)]
    model = ToxicityModel(learn_lexicon(rows, words_in))
    x = np.array([[*halves[k].features(t), 1.0] for (t, _), k in zip(rows, half)])
    share = y.mean() if share is None else share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    prior = np.array([*model.weights, math.log(share / (1 - share))])
    stiff = np.array([*np.full(len(prior) - 1, STIFFNESS), 1e-6])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (stiff * (w - prior) ** 2).sum())

    w, now = prior.copy(), loss(prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        down = x.T @ (weight * (p - y)) + stiff * (w - prior)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(stiff), down)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        before, w = now, w - size * step
        now = loss(w)
        if before - now < 1e-9 * (1 + abs(now)):
            break
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def training_sample(documents: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, most_bytes: int = SAMPLE_BYTES) -> tuple[list[tuple[str, int]], float | None]:
    """Up to so many labelled documents of each kind, those of the least hashes outside the held-out
    fold, of ``most_bytes`` of text (but one), and the share of toxic ones among all of these. Of a
    repeated doc_id one text is taken, so no number of its rows enlarges the sample; labelled twice,
    it counts as toxic if either label says so."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where((crc_mod("doc_id", FOLDS) != HELD_OUT) & F.col("toxic").isin(0, 1))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return [], None
    limits = {1: toxic, 0: clean}
    turn = F.xxhash64("doc_id", F.lit(SEED))
    drawn = F.lit(False)
    for kind, count in counts.items():
        # over-drawn, so that with chance there are enough
        drawn |= (F.col("toxic") == kind) & (F.pmod(turn, F.lit(1_000_000)) < int(1_000_000 * min(1.0, (1.2 * limits[kind] + 50) / count)))
    # at most about 1.2 * (toxic + clean) + 100 rows of two numbers
    chosen = known.where(drawn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = documents_of(documents).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    by_turn = Window.partitionBy("toxic").orderBy("turn", "doc_id")
    texts = texts.withColumn("turn", turn).withColumn("nth", F.row_number().over(by_turn)).withColumn("bytes", F.sum(F.octet_length("text")).over(by_turn))
    limit = F.when(F.col("toxic") == 1, toxic).otherwise(clean)
    rows = texts.where((F.col("nth") == 1) | (F.col("nth") <= limit) & (F.col("bytes") <= most_bytes)).select("doc_id", "text", "toxic").collect()
    return [(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: r["doc_id"])], counts.get(1, 0) / sum(counts.values())


def score_toxicity(documents: DataFrame, labels: DataFrame | None = None, model: ToxicityModel | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, clause (the heaviest matched clause, or null), patterns.

    Unless a model is given, one is learned from a bounded sample of the labelled documents outside
    the held-out fold. Scores are from the text alone, which is read whole however long it is; a null
    text is scored as an empty one. A score of exactly one half is predicted toxic; of clauses of
    equal weight the first is shown. Repeated doc_ids are scored row by row, a null doc_id is not
    held out, extra columns are ignored, and an empty table gives an empty one. Without labels of
    both kinds all scores agree.
    """
    if model is None:
        rows, share = training_sample(documents, labels)
        model = fit(rows, share)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, predicted int, clause string, patterns array<string>"
    fields = arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in parts(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = model.score(text)
                matched = list(model.clauses(text or "")) if s >= 0.5 else []
                heaviest = max(matched, key=lambda m: sum(w for *_, w in m[1]), default=(None, []))
                rows.append((doc_id, s, int(s >= 0.5), heaviest[0], [f"{word}: {pattern}" for word, pattern, _ in heaviest[1]]))
            if rows:
                yield arrow_batch(zip(*rows), fields)

    held_out = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return documents_of(documents).mapInArrow(score, schema).select("doc_id", held_out.alias("held_out"), "score", "predicted", "clause", "patterns")
