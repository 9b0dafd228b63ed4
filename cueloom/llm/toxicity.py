"""Toxicity by a weighted finite-state pattern grammar whose weights are learned from labelled documents.

A clause is what lies between punctuation marks. Five transducers read a clause's
words as symbols: insults and threats (a match), targets, negations and reported
speech (what a match stands under). They are composed into one table, which
gives each clause a kind and a weight: plain, aimed at somebody, negated,
reported, or a threat. A document's score is a logistic function of its clauses'
weights by kind and of its length, so a word by itself scores nothing.

Insults are stems (beginnings of words). Stems and weights come from a bounded
sample of labelled documents: stems that stand in more clauses of toxic
documents than chance allows. Scoring reads every text whole.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches, written

#: Labelled documents of each label that the model is fitted on, about (they are drawn by a hash of their id).
SAMPLE_PER_LABEL = 8000
#: Stems that are considered at most, the most telling first; what is chosen of them is far less.
CANDIDATES = 5000
#: Letters of a stem.
SHORTEST, LONGEST = 3, 10
#: Clauses of toxic documents that a stem must stand in.
SUPPORT = 4
#: How much more often words of toxic documents must have a stem.
RATIO = 4

#: Words that say who is meant, that negate, that report, and that threaten.
TARGETS = "you your yours yourself ur du dich dir dein deine deinen ihr euch euer toi vous votre vos tú ti tus usted ustedes vosotros".split()
NEGATIONS = "not never no nor cannot don't isn't aren't wasn't doesn't didn't won't nicht nie niemals kein keine keinen ne pas jamais aucun nunca jamás ningún tampoco".split()
REPORTS = "said says wrote writes called calls quoted claimed according sagte sagt schrieb nannte laut dit écrit appelé selon dijo dice escribió llamó según".split()
THREATS = "kill murder strangle slaughter destroy töten umbringen erschießen vernichten tuer étrangler massacrer matar asesinar estrangular".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
KINDS = ("plain", "aimed", "negated", "reported", "threat")
#: What a clause's weight counts for by its kind, before anything is learned.
PRIOR = {"plain": 1.0, "aimed": 1.2, "negated": 0.6, "reported": 0.6, "threat": 1.0}
THREAT_WEIGHT = 3.0
#: A negation reaches this many words.
REACH = 3

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE = re.compile(r"[^.,;:!?…\n|()\"“”«»]+")


class Transducer:
    """States from 0 and what a symbol makes of them; symbols without an entry leave a state."""

    def __init__(self, states: int, moves: dict[tuple[int, int], int], says: dict[int, str]):
        self.states, self.moves, self.says = states, moves, says

    def next(self, state: int, symbol: int) -> int:
        return self.moves.get((state, symbol), state)


def negation() -> Transducer:
    """Negated for REACH words after a negation."""
    fades = {(s, x): s - 1 for s in range(1, REACH + 1) for x in (OTHER, INSULT, THREAT, TARGET, REPORT)}
    return Transducer(REACH + 1, fades | {(s, NEGATION): REACH for s in range(REACH + 1)}, {s: "negated" for s in range(1, REACH + 1)})


def flag(symbol: int, name: str) -> Transducer:
    """On from the symbol to the clause's end."""
    return Transducer(2, {(0, symbol): 1}, {1: name})


def composed(*parts: Transducer) -> tuple[list[list[int]], list[frozenset[str]]]:
    """(moves by state and symbol, what each state says) of transducers that read the same symbols side by side."""
    places, moves, todo = {(0,) * len(parts): 0}, [], [(0,) * len(parts)]
    for at in todo:
        row = []
        for symbol in range(6):
            to = tuple(p.next(s, symbol) for p, s in zip(parts, at))
            if to not in places:
                places[to] = len(places)
                todo.append(to)
            row.append(places[to])
        moves.append(row)
    says = [frozenset(p.says[s] for p, s in zip(parts, at) if s in p.says) for at in todo]
    return moves, says


GRAMMAR = composed(negation(), flag(REPORT, "reported"), flag(TARGET, "aimed"), flag(THREAT, "threat"))
_SYMBOLS = {w: s for words, s in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)) for w in words}


@dataclass(frozen=True)
class Model:
    """stems: their weights; factors by kind, per word and constant of the logistic function. Without stems a constant."""

    stems: dict[str, float] = field(default_factory=dict)
    factors: tuple[float, ...] = (0.0,) * len(KINDS)
    per_word: float = 0.0
    constant: float = -20.0


class Grammar:
    """A model's transducers at work on texts."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        import ahocorasick

        self.scan = ahocorasick.Automaton()  # passes over what holds no match; the transducers decide
        for s in [*stems, *THREATS]:
            self.scan.add_word(s, 1)
        self.scan.make_automaton()

    def _any(self, text: str) -> bool:
        return next(self.scan.iter(text), None) is not None

    def weight(self, word: str) -> float:
        return next((self.stems[word[:n]] for n in self.lengths if word[:n] in self.stems), 0.0)

    def clause(self, clause: str) -> tuple[str, float] | None:
        """(kind, weight) of a clause, lower-cased, or None. A word counts once a clause."""
        moves, says = GRAMMAR
        state, matched = 0, {}
        for word in WORD.findall(clause):
            weight = self.weight(word)
            state = moves[state][INSULT if weight else _SYMBOLS.get(word, OTHER)]
            if weight:
                matched.setdefault(word, (weight, says[state] & {"negated", "reported"}))
        end = says[state]
        if {"threat", "aimed"} <= end:
            return "threat", THREAT_WEIGHT + sum(w for w, _ in matched.values())
        if not matched:
            return None
        under = frozenset.intersection(*[u for _, u in matched.values()])
        kind = "reported" if "reported" in under else "negated" if "negated" in under else "aimed" if "aimed" in end else "plain"
        return kind, sum(w for w, _ in matched.values())

    def matches(self, text: str | None) -> list[tuple[str, float, str]]:
        """(kind, weight, clause lower-cased) of a text's matched clauses, in order."""
        lower = text.lower() if text else ""
        if not self._any(lower):
            return []
        return [(*found, m[0]) for m in CLAUSE.finditer(lower) if self._any(m[0]) and (found := self.clause(m[0]))]


def features(matches: list[tuple[str, float, str]], text: str | None) -> list[float]:
    """A text's clause weights by kind, and its number of words."""
    out = [0.0] * len(KINDS) + [float(len(text.split())) if text else 0.0]
    for kind, weight, _ in matches:
        out[KINDS.index(kind)] += weight
    return out


def score_of(model: Model, found: list[float]) -> float:
    x = model.constant + model.per_word * found[-1] + sum(f * v for f, v in zip(model.factors, found))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def held_out(id_col: Column) -> Column:
    """Whether a document is one of the third that no model learns from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """(text, toxic 0 or 1) of about per_label labelled documents of each label, none of them held out; written.

    Which ones are drawn is a matter of a hash of the id. Rows that share an id
    count once a label.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    share = F.when(F.col("toxic") == 1, min(1.0, per_label / max(1, counts.get(1, 0)))).otherwise(min(1.0, per_label / max(1, counts.get(0, 0))))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < share * (1 << 20))
    met = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # bounded by per_label
    return written(met.dropDuplicates(["doc_id", "toxic"]).select(F.coalesce("text", F.lit("")).alias("text"), "toxic"), "toxicity-sample")


def telling_stems(sample: DataFrame, candidates: int = CANDIDATES) -> dict[str, float]:
    """Stems with their weights: the logarithm of how much more often a word of a toxic document's clauses has them.

    Clauses that are alike count once a label, so that copies of a document prove
    nothing. A stem is taken if its clauses differ from chance by more than the
    number of stems tried makes likely (likelihood ratio, Bonferroni); of stems
    that begin each other the most telling is taken, the longer among equals.
    """
    text_batches(sample.sparkSession)
    marks = r'[.,;:!?…\n|()"“”«»]+'
    clauses = sample.select("toxic", F.explode(F.split(F.lower("text"), marks)).alias("clause")).distinct()

    def count(batches):
        import pyarrow as pa

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([c[1] for c in found.values()], pa.int64()), pa.array([c[0] for c in found.values()], pa.int64())], ["stem", "n1", "n0"])

        found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for b in batches:
            for toxic, clause in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                stems = {""}  # stands for the words of all clauses
                words = set(WORD.findall(clause))
                for w in words:
                    stems.update(w[:k] for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
                for s in stems:
                    found[s][toxic] += 1 if s else len(words)
            if len(found) > 200_000:
                yield rows(found)
                found.clear()
        yield rows(found)

    n = clauses.mapInArrow(count, "stem string, n1 long, n0 long").groupBy("stem").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    n = written(n, "toxicity-stems")
    every = n.where("stem = ''").first()
    if not every or not every.n1 or not every.n0:
        return {}
    p1, p0 = F.col("n1") / every.n1, (F.col("n0") + 0.5) / every.n0
    expected = (F.col("n1") + F.col("n0")) * every.n1 / (every.n1 + every.n0)
    surprise = 2 * (F.col("n1") * F.log(F.col("n1") / expected) - (F.col("n1") - expected))
    least = 2 * math.log(n.count()) + 4
    ranked = n.where((F.col("stem") != "") & (F.col("n1") >= SUPPORT) & (p1 > RATIO * p0)).select("stem", surprise.alias("surprise"), F.log(p1 / p0).alias("weight")).where(F.col("surprise") > least)
    out: dict[str, float] = {}
    for r in ranked.orderBy(F.desc("surprise"), F.desc(F.length("stem")), "stem").limit(candidates).collect():
        if not any(r.stem.startswith(s) or s.startswith(r.stem) for s in out):
            out[r.stem] = r.weight
    return out


def _features(sample: DataFrame, stems: dict[str, float]) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        grammar = Grammar(stems)
        for b in batches:
            found = [features(grammar.matches(t), t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.float64()))], ["toxic", "x"])

    return sample.select("text", "toxic").mapInArrow(run, "toxic int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model:
    """The model of documents (doc_id, text) and labels (doc_id, toxic), fitted on about per_label documents of each label.

    Held-out documents, null labels and labels other than 0 and 1 are passed
    over. Without labels of both kinds the model is a constant: a score near 0.
    """
    sample = training_sample(docs, labels, per_label)
    stems = telling_stems(sample)
    if not stems:
        return Model()
    rows = _features(sample, stems).collect()  # a few numbers for each document of the bounded sample
    return Model(stems, *_logistic([r.x for r in rows], [r.toxic for r in rows]))


def _logistic(xs: list[list[float]], ys: list[int], ridge: float = 2.0) -> tuple[tuple[float, ...], float, float]:
    """(factors, per word, constant) by Newton steps; factors are drawn to PRIOR and stay at zero or above, words count at most zero."""
    import numpy as np

    unit = np.array([1.0] * len(KINDS) + [100.0, 1.0])  # words by the hundred
    x = np.c_[np.array(xs, "f8"), np.ones(len(xs))] / unit
    y, prior = np.array(ys, "f8"), np.array([PRIOR[k] for k in KINDS] + [0.0, 0.0])
    strength = np.array([ridge] * len(KINDS) + [ridge, 1e-3])
    low, high = np.array([0.0] * len(KINDS) + [-np.inf, -np.inf]), np.array([np.inf] * len(KINDS) + [0.0, np.inf])
    b = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        gradient = x.T @ (p - y) + strength * (b - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(strength)
        step = np.linalg.solve(curve, gradient)
        size = max(1.0, float(np.abs(step).max()))
        b = np.clip(b - step / size, low, high)
        if np.abs(step).max() < 1e-6:
            break
    b = b / unit
    return tuple(float(v) for v in b[: len(KINDS)]), float(b[-2]), float(b[-1])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and clauses: the matched ones as (kind, weight, text), in order.

    Every text is read whole, however long; one without punctuation is one
    clause. Null and empty texts have no clause and the score of a document of
    no words. Rows are judged one by one: repeated ones alike. Other columns pass
    through, but columns named score or clauses are replaced.
    """
    from .common import own

    docs = own(docs, "score", "clauses")
    text_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        grammar = Grammar(model.stems)
        for b in batches:
            scores, clauses = [], []
            for text in b.column(at).to_pylist():
                found = grammar.matches(text)
                scores.append(score_of(model, features(found, text)))
                clauses.append([{"kind": k, "weight": w, "text": t} for k, w, t in found])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array(clauses, schema.field("clauses").type)], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

    match = StructType().add("kind", StringType()).add("weight", DoubleType()).add("text", StringType())
    kind = StructType(list(docs.schema.fields)).add("score", DoubleType()).add("clauses", ArrayType(match))
    schema = to_arrow_schema(kind)
    return docs.mapInArrow(run, kind)
