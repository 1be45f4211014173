"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols of six classes by their longest lexicon beginning: insult and threat, target (a person addressed),
negation, reported speech, filler. Five transducers read a clause's symbols and write them with a coefficient: insult and
threat give them one, negation and reported speech lower it within their reach, target raises insults and settles
threats, which count only with a target. Composed, they are one transducer; a clause's weight is the sum of its
coefficients times the insults' weights on the one path that reads the clause to its end. Clauses end at . ! ? ; : and
line ends. A document's score is a logistic function of its clauses' total, by the total and by its rate per word.

The grammar starts from a small lexicon (below) and learns more word beginnings with weights, and the logistic
function's coefficients, from labels: the training rows are a bounded sample (MAX_TOXIC and MAX_CLEAN rows, chosen by
the hash of their ids among rows whose crc32(id) mod 3 is not 1). Scores use the text alone.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Hashable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import materialize, small_batches

#: Bounds of the training sample.
MAX_TOXIC, MAX_CLEAN = 6000, 12000
#: Lengths in characters of the words' beginnings that are learned; a beginning is shorter than its word, and whole words
#: are learned at any length.
LENGTHS = (3, 4, 5, 6, 7, 8)
#: Least weight of what is learned.
LEAST = 1.25
#: Words whose weight a task remembers.
MAX_KNOWN = 100_000
#: A document is rejected from this score on.
THRESHOLD = 0.7

#: The lexicon before learning: whole words.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile dumb idiota imbécil estúpido idiotin dumm dummkopf abschaum connard crétin débile".split()
THREATS = "kill hurt destroy shoot stab strangle töten umbringen matar matarte tuer".split()
TARGETS = "you your you're u they them he she du dich ihr euch tú te vosotros usted tu toi vous".split()
NEGATIONS = "not no never without isn't aren't nicht kein keine nie nunca sin pas jamais".split()
REPORTS = "said says say called wrote claims reported quoted sagte schrieb dijo dit écrit".split()

#: Weights of the grammar: of a seed insult, the factors of target, negation and report, and of a threat with a target.
SEED_WEIGHT, WITH_TARGET, NEGATED, REPORTED, THREAT_WEIGHT = 3.0, 1.25, 0.5, 0.5, 2.5
#: Words over which a negation and a target reach.
REACH = 3

_CLAUSE = re.compile(r"[.!?;:\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_PIECE = re.compile(rf"{_TOKEN.pattern}|[.!?;:\n]")
_ENDS = frozenset(".!?;:\n")

CLASSES = ("insult", "threat", "target", "negation", "report", "filler")


@dataclass(frozen=True)
class Transducer:
    """Arcs by state and class: (factor, next state) each. Reading a symbol multiplies its coefficient by the factor."""

    start: Hashable
    finals: frozenset
    arcs: dict[tuple[Hashable, str], tuple[tuple[float, Hashable], ...]]

    def compose(self, other: Transducer) -> Transducer:
        """The transducer that reads as `self` and passes what it writes to `other`; only states that can be reached."""
        start = (self.start, other.start)
        arcs, waiting, known = {}, [start], {start}
        while waiting:
            state = waiting.pop()
            for c in CLASSES:
                ways = [(f * g, (x, y)) for f, x in self.arcs.get((state[0], c), ()) for g, y in other.arcs.get((state[1], c), ())]
                if ways:
                    arcs[state, c] = tuple(ways)
                    waiting += [y for y in dict.fromkeys(y for _, y in ways) if y not in known]
                    known.update(y for _, y in ways)
        return Transducer(start, frozenset(x for x in known if x[0] in self.finals and x[1] in other.finals), arcs)

    def numbered(self) -> Transducer:
        """The same with numbers as states."""
        number: dict[Hashable, int] = {self.start: 0}
        for (x, _), ways in self.arcs.items():
            for state in (x, *(y for _, y in ways)):
                number.setdefault(state, len(number))
        return Transducer(0, frozenset(number[x] for x in self.finals if x in number), {(number[x], c): tuple((f, number[y]) for f, y in ways) for (x, c), ways in self.arcs.items()})

    def weigh(self, symbols: Iterable[tuple[str, float]]) -> float:
        """The sum of coefficients times weights of (class, weight) symbols, on the path that ends in a final state; the most if there are several."""
        states = {self.start: 0.0}
        for c, weight in symbols:
            after: dict[Hashable, float] = {}
            for state, total in states.items():
                for factor, y in self.arcs.get((state, c), ()):
                    found = total + factor * weight
                    if found > after.get(y, -1.0):
                        after[y] = found
            states = after
        return max((total for state, total in states.items() if state in self.finals), default=0.0)


def _one_state(factors: dict[str, float]) -> Transducer:
    return Transducer(0, frozenset([0]), {(0, c): ((factors.get(c, 1.0), 0),) for c in CLASSES})


def insult_transducer() -> Transducer:
    """Insults keep their weight; what is neither insult nor threat weighs nothing."""
    return _one_state({c: 0.0 for c in CLASSES if c not in ("insult", "threat")})


def threat_transducer() -> Transducer:
    return _one_state({"threat": THREAT_WEIGHT})


def negation_transducer() -> Transducer:
    """States are the words that a negation still reaches."""
    arcs = {}
    for left in range(REACH + 1):
        for c in CLASSES:
            factor = NEGATED if left and c in ("insult", "threat") else 1.0
            arcs[left, c] = ((factor, REACH if c == "negation" else max(0, left - 1)),)
    return Transducer(0, frozenset(range(REACH + 1)), arcs)


def report_transducer() -> Transducer:
    """Reported speech lasts to the clause's end."""
    arcs = {}
    for open_ in (False, True):
        for c in CLASSES:
            arcs[open_, c] = ((REPORTED if open_ and c in ("insult", "threat") else 1.0, open_ or c == "report"),)
    return Transducer(False, frozenset([False, True]), arcs)


def target_transducer() -> Transducer:
    """A target raises insults within its reach and the last insult before it, and lets threats count, within its reach or before it.

    What comes later decides about an insult or threat without a target in reach, so the transducer guesses, and its
    states promise what has to come: (words that a target reaches, promise for the last insult, promise for the last
    threat). True promises a target before the next insult (or undecided threat), False promises none, None nothing.
    """
    arcs: dict = {}
    for reach, insult, threat in itertools.product(range(REACH + 1), (None, True, False), (None, True, False)):
        state = (reach, insult, threat)
        less = max(0, reach - 1)
        for c in ("negation", "report", "filler"):
            arcs[state, c] = ((1.0, (less, insult, threat)),)
        if insult is not False and threat is not False:
            arcs[state, "target"] = ((1.0, (REACH, None, None)),)
        if insult is not True:
            arcs[state, "insult"] = ((WITH_TARGET, (less, None, threat)),) if reach else ((WITH_TARGET, (less, True, threat)), (1.0, (less, False, threat)))
        if reach:
            arcs[state, "threat"] = ((1.0, (less, insult, threat)),)
        elif threat is not True:
            arcs[state, "threat"] = ((1.0, (less, insult, True)), (0.0, (less, insult, False)))
    finals = frozenset((reach, insult, threat) for reach in range(REACH + 1) for insult in (None, False) for threat in (None, False))
    return Transducer((0, None, None), finals, arcs)


@functools.cache
def composed() -> Transducer:
    """The grammar of clauses: all five transducers."""
    return functools.reduce(Transducer.compose, (insult_transducer(), threat_transducer(), negation_transducer(), report_transducer(), target_transducer())).numbered()


class Grammar:
    """The composed transducers with a lexicon of weighted insults: word beginnings and whole words."""

    def __init__(self, beginnings: dict[str, float], words: dict[str, float], bias: float = -5.0, slope: float = 2.5, rate: float = 1.0):
        self.beginnings, self.words, self.bias, self.slope, self.rate = beginnings, words, bias, slope, rate
        self.classes = dict.fromkeys(THREATS, "threat") | dict.fromkeys(TARGETS, "target") | dict.fromkeys(NEGATIONS, "negation") | dict.fromkeys(REPORTS, "report")
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def insult(self, word: str) -> float:
        weight = self.words.get(word, 0.0)
        for n in LENGTHS:
            if n < len(word):
                weight = max(weight, self.beginnings.get(word[:n], 0.0))
        return weight

    def cue(self, word: str) -> float:
        """Above 0 for words without which a clause weighs nothing: insults and threats."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= MAX_KNOWN:
                self.known.clear()
            found = self.known[word] = self.insult(word) or float(self.classes.get(word) == "threat")
        return found

    def symbol(self, word: str) -> tuple[str, float]:
        weight = self.insult(word)
        return ("insult", weight) if weight else (self.classes.get(word, "filler"), 1.0)

    def clause(self, words: Iterable[str]) -> float:
        """The weight that the composed transducer gives one clause."""
        return composed().weigh(map(self.symbol, words))

    def weigh(self, text: str) -> float:
        """The sum over the clauses. Only clauses with a cue are read: no other has a weight."""
        pieces = _PIECE.findall(text.lower())
        if not any(map(self.cue, pieces)):
            return 0.0
        clauses = (list(words) for ends, words in itertools.groupby(pieces, _ENDS.__contains__) if not ends)
        return sum(self.clause(words) for words in clauses if any(map(self.cue, words)))

    def matches(self, text: str) -> list[tuple[int, str, float]]:
        """Start, text and weight of the clauses that weigh anything."""
        out, at = [], 0
        for end in [m.span() for m in _CLAUSE.finditer(text)] + [(len(text), len(text))]:
            weight = self.clause(w.lower() for w in _TOKEN.findall(text[at : end[0]]))
            out += [(at, text[at : end[0]], weight)] if weight else []
            at = end[1]
        return out

    def features(self, text: str) -> tuple[float, float]:
        """The logarithms of the total weight and of the weight per thousand words."""
        total = self.weigh(text)
        return (math.log1p(total), math.log1p(1000 * total / (1 + text.count(" ")))) if total else (0.0, 0.0)

    def score(self, text: str) -> float:
        x, rate = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * x + self.rate * rate))))


def held_out(id_: int | None) -> bool:
    """Whether a row is kept from training; a null id, which no label has, is not."""
    return id_ is not None and zlib.crc32(str(id_).encode()) % 3 == 1


def _keys(text: str | None) -> set[str]:
    """A text's words, and their beginnings with an asterisk."""
    words = set(_TOKEN.findall((text or "").lower()))
    return {f"{w[:n]}*" for w in words for n in LENGTHS if n < len(w)} | words


def _counts(wanted):
    """How many texts of a task have each key (each of `wanted`), by half of the sample."""

    def run(batches):
        import pyarrow as pa

        counts = [Counter(), Counter()]
        for batch in batches:
            for text, half in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[half].update(_keys(text) & wanted.value if wanted else _keys(text))
        keys = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], names=["key", "n0", "n1"])

    return run


def learn(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> Grammar:
    """A grammar with the beginnings and words whose rate in toxic texts exceeds that in clean ones for certain.

    The weight is the lower end of the 95 % interval of the rates' log ratio, SEED_WEIGHT at most; LEAST is the least.
    """

    def low(key: str) -> float:
        a, b = toxic[key] + 0.5, clean.get(key, 0) + 0.5
        return math.log(a / (n_toxic + 1)) - math.log(b / (n_clean + 1)) - 1.96 * math.sqrt(1 / a + 1 / b)

    least = max(3, n_toxic // 200)
    scored = sorted(((low(k), k) for k, n in toxic.items() if n >= least), key=lambda x: (-x[0], x[1]))
    found = [(min(s, SEED_WEIGHT), k) for s, k in scored if s >= LEAST]
    return Grammar({k[:-1]: s for s, k in found if k.endswith("*")}, dict.fromkeys(INSULTS, SEED_WEIGHT) | {k: s for s, k in found if not k.endswith("*")})


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Bias and coefficients by Newton's method, with weak ridge terms that keep separable data finite."""
    a = np.c_[np.ones(len(x)), x]
    prior, strength = np.array([-5.0, 2.5, 1.0]), np.array([0.02, 0.05, 0.05])
    sign = 2 * y - 1
    loss = lambda v: np.logaddexp(0, -sign * (a @ v)).sum() + (strength * (v - prior) ** 2).sum() / 2
    w = prior.copy()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(strength), a.T @ (p - y) + strength * (w - prior))
        if np.abs(step).max() < 1e-8:
            break
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:  # a whole step may overshoot where most p are near 0 or 1
            size /= 2
        w = w - size * step
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Grammar:
    """A grammar from the labelled rows of `docs`.

    The sample's ids are bounded, so they may be broadcast; texts are read once, where they lie. Without labelled
    rows the lexicon and the default coefficients remain. Null ids and null labels are passed over; a row that is
    labelled 0 and 1 is in both samples, repeated labels count once, repeated documents as often as they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    train = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1) AND crc32(CAST(CAST(id AS STRING) AS BINARY)) % 3 <> 1")
    drawn = lambda y, n: train.where(F.col("y") == y).distinct().orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = materialize(drawn(1, max_toxic).unionByName(drawn(0, max_clean)), "toxicity-sample")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    sample = materialize(rows.join(F.broadcast(chosen), "id").select("text", half, "y"), "toxicity-texts")
    n = {(y, h): count for y, h, count in sample.groupBy("y", "half").count().collect()}
    n_toxic, n_clean = [n.get((1, h), 0) for h in (0, 1)], [n.get((0, h), 0) for h in (0, 1)]
    if not sum(n_toxic) or not sum(n_clean):
        return Grammar({}, dict.fromkeys(INSULTS, SEED_WEIGHT))
    summed = lambda y, wanted: sample.where(F.col("y") == y).select("text", "half").mapInArrow(_counts(wanted), "key string, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # a text has a bounded part of what is counted often, so this many keys are bounded like the sample
    toxic = {r.key: (r.n0, r.n1) for r in summed(1, None).where(F.col("n0") + F.col("n1") >= max(3, sum(n_toxic) // 200)).collect()}
    clean = {r.key: (r.n0, r.n1) for r in summed(0, spark.sparkContext.broadcast(frozenset(toxic))).collect()}
    part = lambda counts, h: {k: v[h] for k, v in counts.items()}
    # the coefficients come from texts that the grammar which weighs them hasn't seen
    halves = [learn(part(toxic, 1 - h), part(clean, 1 - h), n_toxic[1 - h], n_clean[1 - h]) for h in (0, 1)]
    measured = sample.mapInArrow(_features(spark.sparkContext.broadcast(halves)), "x double, rate double, y int").toPandas()
    grammar = learn({k: sum(v) for k, v in toxic.items()}, {k: sum(v) for k, v in clean.items()}, sum(n_toxic), sum(n_clean))
    grammar.bias, grammar.slope, grammar.rate = _logistic(measured[["x", "rate"]].to_numpy(), measured.y.to_numpy().astype(float))
    return grammar


def _features(halves):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [halves.value[h].features(t or "") for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)), batch.column(2)], names=["x", "rate", "y"])

    return run


def _scores(grammar):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = [grammar.value.score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return run


def _below(grammar, at: int, threshold: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([grammar.value.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return run


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) for each row of `docs`.

    A null text counts as empty; it has the score of a text without findings. Texts are read whole. Rows are
    independent, so ties, repeated rows and an empty table need no rule. Only the two named columns are read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scores(shared), "id long, score double")


def _matched(grammar):
    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("text", pa.string()), ("weight", pa.float64())]))
        for batch in batches:
            clauses = [[dict(zip(("start", "text", "weight"), m, strict=True)) for m in grammar.value.matches(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clauses, kind)], names=["id", "clauses"])

    return run


def matched_clauses(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and clauses (start in characters, text, weight) for each row of `docs`; rules as in score()."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_matched(shared), "id long, clauses array<struct<start:long,text:string,weight:double>>")


def drop_toxic(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score is below the threshold, with all their columns; rules as in score(), null texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_below(shared, docs.columns.index(text_col), threshold), docs.schema)
