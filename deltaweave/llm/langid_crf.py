"""Language identification by a linear-chain conditional random field over words.

Each word of a text is labelled with a language; affixes, character 2- and 3-grams and a lexicon of frequent words give its
score for each, and learned transitions tie neighbours together, so that a switch of language inside a text is found by
forward-backward. A document's language has the largest sum of word posteriors, and its score is that sum's share.

Training maximises the likelihood of about `sample` labelled texts outside the held-out quarter (chosen by a hash of
their id; texts over `most_chars` are not used for training). Runs of words of different documents are
spliced into training sequences, as labels for whole documents alone would show no switch.

Inference is exact on whole texts and vectorised: the words of many documents form one chain, cut into equal chunks
whose transfer matrices are multiplied in step; a document's first word forgets what came before. Word scores are
kept in a bounded cache for each worker. One pass, no shuffle.

Defined cases: null texts and texts without a letter are `und` with score 0; repeated rows get equal results;
an empty table gives no rows; without labelled rows every text is `und`; columns other than those named are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm.common import bounded_sample, give_back, held_out, table

WORDS = re.compile(r"[^\W\d_]+")
CHUNK = 128


def word_features(word: str) -> set[str]:
    w = f"^{word}$"
    out = {w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)}
    out.update((w[:4], w[:5], w[-4:], w[-5:], "=" + word))
    return out


class Crf:
    """labels; feature -> row of `weights` (features, labels); `moves` (labels, labels) and `first` are log weights."""

    def __init__(self, labels: list[str], features: dict[str, int], weights: np.ndarray, moves: np.ndarray, first: np.ndarray):
        self.labels, self.features, self.weights, self.moves, self.first = labels, features, weights, moves, first
        self.reset()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "scores")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.labels)))

    def rows(self, words: list[str], most: int = 250_000) -> np.ndarray:
        """Row of each word in `scores`; new words are scored together."""
        if len(self.known) > most:
            self.reset()
        known = self.known
        got = [known.get(w, -1) for w in words]
        if -1 in got:
            new = list(dict.fromkeys(w for w, i in zip(words, got) if i < 0))
            at = len(known)
            while at + len(new) > len(self.scores):
                self.scores = np.vstack([self.scores, np.zeros_like(self.scores)])
            ids, counts = feature_rows(new, self.features)
            self.scores[at : at + len(new)] = summed(self.weights[ids], counts)
            known.update(zip(new, range(at, at + len(new))))
            got = [known[w] for w in words]
        return np.array(got, np.int64)

    def posterior_sums(self, docs: list[list[str]]) -> np.ndarray:
        """For each document (each has words) the sums of its words' posteriors, by label."""
        sizes = np.array([len(d) for d in docs])
        rows = self.rows([w for d in docs for w in d])  # may replace `scores`
        emit = self.scores[rows]
        emit = np.exp(emit - emit.max(1, keepdims=True))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        begins = np.zeros(len(emit), bool)
        begins[starts] = True
        gamma = posteriors(emit, begins, np.exp(self.moves), np.exp(self.first))
        return np.add.reduceat(gamma, starts, axis=0)


def feature_rows(words: list[str], features: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    ids: list[int] = []
    counts = np.zeros(len(words), np.int64)
    get = features.get
    for i, w in enumerate(words):
        own = [f for f in map(get, word_features(w)) if f is not None]
        ids += own
        counts[i] = len(own)
    return np.array(ids, np.int64), counts


def summed(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs, empty ones 0."""
    total = np.vstack([np.zeros((1, values.shape[1])), np.cumsum(values, 0)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def posteriors(emit: np.ndarray, begins: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Exact label posteriors of one long chain in which some words begin a document."""
    n, k = emit.shape
    c = -(-n // CHUNK)
    pad = c * CHUNK - n
    emit = np.vstack([emit, np.ones((pad, k))]).reshape(c, CHUNK, k)
    begins = np.concatenate([begins, np.ones(pad, bool)]).reshape(c, CHUNK)
    fresh = np.broadcast_to(first, (k, k))  # the step into a document's first word forgets the state
    whole = np.broadcast_to(np.eye(k), (c, k, k)).copy()
    for t in range(CHUNK):
        b = begins[:, t]
        step = whole @ moves
        if b.any():
            step[b] = whole[b] @ fresh
        whole = step * emit[:, None, t]
        whole /= whole.max((1, 2), keepdims=True)
    into, out = np.empty((c, k)), np.empty((c, k))  # before each chunk's first word; after its last
    a = np.full(k, 1 / k)
    for i in range(c):
        into[i] = a
        a = a @ whole[i]
        a /= a.sum()
    b_ = np.ones(k)
    for i in range(c - 1, -1, -1):
        out[i] = b_
        b_ = whole[i] @ b_
        b_ /= b_.sum()
    alpha = np.empty((CHUNK, c, k))
    a = into
    for t in range(CHUNK):
        b = begins[:, t]
        step = a @ moves
        if b.any():
            step[b] = first
        a = step * emit[:, t]
        a /= a.sum(1, keepdims=True)
        alpha[t] = a
    beta = out
    for t in range(CHUNK - 1, -1, -1):
        alpha[t] *= beta
        b = begins[:, t]
        back = emit[:, t] * beta
        step = back @ moves.T
        if b.any():
            step[b] = (back[b] @ first)[:, None]
        beta = step / step.sum(1, keepdims=True)
    gamma = alpha.transpose(1, 0, 2).reshape(-1, k)[:n]
    return gamma / gamma.sum(1, keepdims=True)


def fit(texts: list[str], langs: list[str], *, least: int = 4, lexicon: int = 3000, rounds: int = 25, rate: float = 0.25, ridge: float = 1e-4, seed: int = 5, length: int = 64) -> Crf:
    labels = sorted(set(langs))
    k = len(labels)
    docs = [(WORDS.findall(t.lower()), labels.index(g)) for t, g in zip(texts, langs)]
    docs = [d for d in docs if d[0]]
    if not docs:
        return Crf(labels or ["und"], {}, np.zeros((1, max(k, 1))), np.zeros((max(k, 1),) * 2), np.zeros(max(k, 1)))
    seen = Counter(w for ws, _ in docs for w in ws)
    frequent = {"=" + w for w, _ in seen.most_common(lexicon)}
    counts = Counter()
    for w, n in seen.items():
        counts.update({f: n for f in word_features(w)})
    names = sorted(f for f, n in counts.items() if n >= least and (f[0] != "=" or f in frequent))
    features = {f: i for i, f in enumerate(names)}
    words = list(seen)
    place = {w: i for i, w in enumerate(words)}
    ids, sizes = feature_rows(words, features)

    rng = np.random.default_rng(seed)
    runs = []
    for ws, g in docs:
        row, at = [place[w] for w in ws], 0
        while at < len(row):
            n = int(rng.integers(10, 60))
            runs.append((row[at : at + n], g))
            at += n
    order = rng.permutation(len(runs))
    x = np.array([w for i in order for w in runs[i][0]])
    y = np.array([runs[i][1] for i in order for _ in runs[i][0]])
    n = max(len(x) // length, 1)
    pad = max(n * length - len(x), 0)
    x, y = np.pad(x, (0, pad), mode="edge")[: n * length].reshape(n, length), np.pad(y, (0, pad), mode="edge")[: n * length].reshape(n, length)
    gold = np.zeros((len(words), k))
    np.add.at(gold, (x.ravel(), y.ravel()), 1)
    gold_moves, gold_first = np.zeros((k, k)), np.bincount(y[:, 0], minlength=k).astype(float)
    np.add.at(gold_moves, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)

    params = [np.zeros((len(features) + 1, k)), np.zeros((k, k)), np.zeros(k)]
    first_m, second_m = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    owner = np.repeat(np.arange(len(words)), sizes)
    for r in range(1, rounds + 1):
        weights, moves, first = params
        emit = summed(weights[ids], sizes)
        emit = np.exp(emit - emit.max(1, keepdims=True))[x]  # n, length, k
        m = np.exp(moves - moves.max())
        alpha, scale = np.empty((length, n, k)), np.empty((length, n, 1))
        a = np.exp(first - first.max()) * emit[:, 0]
        for t in range(length):
            if t:
                a = (a @ m) * emit[:, t]
            scale[t] = a.sum(1, keepdims=True)
            a = a / scale[t]
            alpha[t] = a
        post, pairs = np.empty((n, length, k)), np.zeros((k, k))
        b = np.ones((n, k))
        for t in range(length - 1, -1, -1):
            post[:, t] = alpha[t] * b
            if t:
                back = emit[:, t] * b / scale[t]
                pairs += alpha[t - 1].T @ back
                b = back @ m.T
        post /= post.sum(2, keepdims=True)
        expected = np.stack([np.bincount(x.ravel(), post[..., j].ravel(), len(words)) for j in range(k)], 1)
        diff = gold - expected
        grad_w = np.zeros_like(weights)
        for j in range(k):
            grad_w[:, j] = np.bincount(ids, diff[owner, j], len(weights))
        total = x.size
        grads = [grad_w / total - ridge * weights, (gold_moves - pairs * m) / total - ridge * moves, (gold_first - post[:, 0].sum(0)) / total - ridge * first]
        for i, g in enumerate(grads):
            first_m[i] = 0.9 * first_m[i] + 0.1 * g
            second_m[i] = 0.99 * second_m[i] + 0.01 * g * g
            params[i] = params[i] + rate * (first_m[i] / (1 - 0.9**r)) / (np.sqrt(second_m[i] / (1 - 0.99**r)) + 1e-8)
    weights, moves, first = params
    return Crf(labels, features, weights, moves - moves.max(), first - first.max())


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 700, most_chars: int = 20_000) -> Crf:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    known = rows.where(F.col("_lang").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id"))
    chosen = bounded_sample(known, sample, id_col="_id", also=F.col("_text").isNotNull() & (F.length("_text") <= most_chars))
    rows = sorted(chosen.collect(), key=lambda r: r._id)
    return fit([r._text for r in rows], [r._lang for r in rows])


def identify(docs: DataFrame, model: Crf, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, the columns of `keep`, lang_pred and score for each row. The text itself can be kept too and crosses to Python once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    keep = list(keep or [])
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep) if c != text_col])
    kept = ["_text" if c == text_col else f"_keep_{i}" for i, c in enumerate(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                langs, scores = label(crf, b.column("_text").to_pylist())
                own = [b.column(c) for c in ["_id", *kept]] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(own, ["_id", *kept, "_lang_pred", "_score"])
        crf.reset()  # the worker may keep the model
        give_back()

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in ["_id", *kept]) + ", _lang_pred string, _score double")
    return out.select(F.col("_id").alias("doc_id"), *[F.col(k).alias(c) for k, c in zip(kept, keep)], F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def label(crf: Crf, texts: list[str | None], words_at_once: int = 200_000) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    waiting: list[tuple[int, list[str]]] = []
    held = 0

    def settle() -> None:
        if waiting:
            sums = crf.posterior_sums([w for _, w in waiting])
            for (i, _), s in zip(waiting, sums):
                j = int(s.argmax())
                langs[i], scores[i] = crf.labels[j], float(min(1.0, s[j] / s.sum()))
            waiting.clear()

    for i, t in enumerate(texts):
        words = WORDS.findall(t.lower()) if t and crf.features else []
        if words:
            waiting.append((i, words))
            held += len(words)
            if held >= words_at_once:
                settle()
                held = 0
    settle()
    return langs, scores


def op9_langid_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
