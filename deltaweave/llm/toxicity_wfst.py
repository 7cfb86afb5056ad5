"""Toxicity from a weighted finite-state pattern grammar.

Five small weighted automata read a clause's token classes: insults, threats, targets, negation and reported
speech. `compose` multiplies them into one machine whose weights are feature counts (an insult, one near a target, one
under negation, one inside reported speech, ...), and only clauses that hold an insult or threat are run through
it. A document's score is a logistic function of what its matched clauses add up to.

Insult terms are words and word beginnings whose labelled documents are toxic far more often than others, with their log odds as weights; the
logistic weights are fitted with them. The fit reads about `sample` labelled documents (chosen by
a hash of their id, at most `most_chars` long; this bounds the fit only) outside the held-out quarter; a score reads nothing but the text, and all of it.

Scoring is one pass without a shuffle: an Aho-Corasick automaton finds terms in the whole text, and the grammar runs on their
clauses. The model is a few hundred terms, whatever the corpus.

Defined cases: null and empty texts have the score of no match; repeated rows score alike; an empty table
gives no rows; with no labelled rows only the fixed terms count; labels given twice count as their
maximum; columns other than those named are not read.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm.common import bounded_sample, held_out, table

#: Word lists of the grammar. Fixed values.
THREATS = "kill hurt destroy shoot stab töten schlagen tuer frapper matar golpear".split()
TARGETS = "you your they them he she people du ihr euch vous tu ils ellos usted tú".split()
NEGATIONS = "not no never nor without isn't aren't nicht kein nie pas jamais nunca sin".split()
REPORTS = "said says wrote quoted claimed called told sagte schrieb dit écrit dijo escribió".split()
INSULTS = "idiot moron stupid scum loser trash clown pathetic worthless disgusting dumb fool jerk coward garbage filthy".split()

#: Classes of tokens, and features that the machine counts.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
FEATURES = ("insult", "threat", "aimed", "negated", "reported")
CLAUSE = re.compile(r"[.!?;:,|\n]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")

Arcs = dict[tuple[int, int], tuple[int, tuple[float, ...]]]


def _weights(**own: float) -> tuple[float, ...]:
    return tuple(own.get(f, 0.0) for f in FEATURES)


def counter(kind: int, feature: str) -> Arcs:
    """One state; each token of the class counts."""
    return {(0, c): (0, _weights(**{feature: 1.0}) if c == kind else _weights()) for c in range(6)}


def window(opener: int, feature: str, reach: int, backwards: bool = False) -> Arcs:
    """After `opener`, an insult or threat within `reach` tokens counts. Backwards: an opener after it."""
    first, then = ((INSULT, THREAT), (opener,)) if backwards else ((opener,), (INSULT, THREAT))
    arcs: Arcs = {}
    for state in range(reach + 1):
        for c in range(6):
            to = reach if c in first else max(state - 1, 0)
            arcs[state, c] = (to, _weights(**{feature: 1.0}) if state and c in then else _weights())
    return arcs


def compose(a: Arcs, b: Arcs) -> Arcs:
    """Both machines reading the same classes; weights add. Only reachable states are built."""
    out: Arcs = {}
    number = {(0, 0): 0}
    todo = [(0, 0)]
    while todo:
        pair = todo.pop()
        for c in range(6):
            (p, x), (q, y) = a[pair[0], c], b[pair[1], c]
            if (p, q) not in number:
                number[p, q] = len(number)
                todo.append((p, q))
            out[number[pair], c] = (number[p, q], tuple(i + j for i, j in zip(x, y)))
    return out


def grammar() -> Arcs:
    machine = counter(INSULT, "insult")
    for other in (counter(THREAT, "threat"), window(TARGET, "aimed", 4), window(TARGET, "aimed", 3, backwards=True), window(NEGATION, "negated", 2), window(REPORT, "reported", 6)):
        machine = compose(machine, other)
    return machine


class Model:
    """terms: word or beginning -> weight. coef: of the document's features, the first for none."""

    def __init__(self, terms: dict[str, float], coef: np.ndarray | None = None):
        self.terms, self.coef = terms, coef
        self.fixed = {w: c for c, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.machine = self.finder = None

    def __getstate__(self):
        return {**self.__dict__, "machine": None, "finder": None}

    def ready(self) -> None:
        if self.machine is None:
            import ahocorasick

            self.machine = grammar()
            self.finder = ahocorasick.Automaton()
            for t in {*self.terms, *THREATS}:
                self.finder.add_word(t, len(t))
            self.finder.make_automaton()
            self.longest = max(map(len, self.terms), default=0)

    def weight(self, word: str) -> float | None:
        """Of the longest term that the word begins with."""
        for n in range(min(len(word), self.longest), 2, -1):
            w = self.terms.get(word[:n])
            if w is not None:
                return w
        return None

    def features(self, text: str | None) -> np.ndarray:
        """Sums over matched clauses: the grammar's counts (capped by a logarithm), weights, best clause."""
        self.ready()
        out = np.zeros(len(FEATURES) + 4)
        out[0] = 1
        if not text:
            return out
        low = text.lower()
        hits_at = [end - n + 1 for end, n in self.finder.iter(low)]
        hits_at = sorted({s for s in hits_at if not (s and low[s - 1].isalpha())})
        spans: list[tuple[int, int]] = []
        if hits_at:  # whole clauses, each once however many hits it holds
            marks = [m.span() for m in CLAUSE.finditer(low)]
            starts = [0, *(e for _, e in marks)]
            ends = [*(s for s, _ in marks), len(low)]
            held = sorted({bisect.bisect_right(starts, s) - 1 for s in hits_at})
            spans = [(starts[i], ends[i]) for i in held]
        counts = np.zeros(len(FEATURES))
        total = best = hits = 0.0
        for lo, hi in spans:
            state, clause = 0, 0.0
            own = np.zeros(len(FEATURES))
            for m in TOKEN.finditer(low, lo, hi):
                word = m.group()
                kind, w = self.fixed.get(word), None
                if kind is None:
                    w = self.weight(word)
                    kind = OTHER if w is None else INSULT
                state, x = self.machine[state, kind]
                own += x
                if w is not None:
                    clause += w
                    hits += 1
            clause += 0.5 * own[1] + 0.25 * own[2] - 0.5 * own[3] - 0.5 * own[4]
            counts += own
            total += clause
            best = max(best, clause)
        out[1 : 1 + len(FEATURES)] = np.log1p(counts)
        out[-3:] = math.copysign(math.log1p(abs(total)), total), best, math.log1p(hits)
        return out

    def score(self, text: str | None) -> float:
        z = float(self.features(text) @ self.coef)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def mine_terms(texts: list[str], toxic: np.ndarray, *, least: int = 6, z: float = 6.0, most: int = 400) -> dict[str, float]:
    """Words and beginnings (4 letters or more) far more frequent in toxic documents, with log odds against the base rate."""
    base = float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < base < 1:
        return {}
    found: dict[str, list[int]] = defaultdict(list)
    for i, t in enumerate(texts):
        for w in set(TOKEN.findall(t.lower())):
            found[w].append(i)
    beginnings: dict[str, list[list[int]]] = defaultdict(list)
    for w, rows in found.items():
        for n in range(4, min(len(w), 8)):
            beginnings[w[:n]].append(rows)
        beginnings[w].append(rows)
    spread = math.sqrt(base * (1 - base))
    picked = {}
    for term, lists in beginnings.items():
        if sum(map(len, lists)) < least:
            continue
        rows = set().union(*lists)
        n = len(rows)
        if n < least:
            continue
        k = int(toxic[list(rows)].sum())
        if (k - n * base) / (spread * math.sqrt(n)) >= z:
            picked[term] = (n, k, math.log((k + 8 * base) / (n - k + 8 * (1 - base))) - math.log(base / (1 - base)))
    # A beginning whose documents are those of a longer one adds nothing.
    kept = {t: v for t, v in picked.items() if not any(len(o) > len(t) and o.startswith(t) and picked[o][:2] == v[:2] for o in picked)}
    top = sorted(kept, key=lambda t: -kept[t][2] * math.sqrt(kept[t][1]))[:most]
    return {t: kept[t][2] for t in top if kept[t][2] > 0}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], toxic: list[int]) -> Model:
    y = np.array(toxic, float)
    terms = {w: 2.0 for w in INSULTS} | mine_terms(texts, y)
    model = Model(terms)
    if not len(y) or y.min() == y.max():
        model.coef = np.zeros(len(FEATURES) + 4)
        model.coef[0], model.coef[-3] = -3.0 if not len(y) or y.max() == 0 else 3.0, 2.0
        return model
    model.coef = logistic(np.array([model.features(t) for t in texts]), y)
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 6000, most_chars: int = 20_000) -> Model:
    """Fits on about `sample` labelled documents outside the held-out quarter; of them those of at most `most_chars` characters."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where("_y is not null and _id is not null").where(~held_out("_id"))
    chosen = bounded_sample(known.groupBy("_id").agg(F.max("_y").alias("_y")), sample, id_col="_id")
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).where(F.length("_text") <= most_chars)
    rows = texts.join(F.broadcast(chosen), "_id").dropDuplicates(["_id"]).collect()  # both the sample's rows and their lengths are bounded
    rows.sort(key=lambda r: r._id)
    return fit([r._text for r in rows], [int(r._y > 0) for r in rows])


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", at: float = 0.3) -> DataFrame:
    """doc_id, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            scores: list[float] = []
            for lo in range(0, b.num_rows, 128):
                scores += [m.score(t) for t in b.column(1).slice(lo, 128).to_pylist()]
            s = pa.array(scores, pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), s, pa.array([int(x >= at) for x in scores], pa.int32())], ["doc_id", "score", "predicted"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op4_toxicity_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
