"""Toxic spans and document scores from a linear-chain conditional random field.

Each word is toxic or not; the field has a weight for each word, for each four-byte beginning of a
word, a bias and four transitions.  Labels come per document, so tokens are labelled first: a word of
a toxic training document counts as toxic when its document frequency among toxic training documents
exceeds that among the others with a likelihood-ratio statistic of ``EVIDENCE`` or more.  The field
is fitted to these tokens by gradient ascent over forward-backward marginals; a logistic curve over
two aggregates of the marginals (their largest log odds, their expected count) is fitted to the
document labels and gives the score.

Fitting uses at most ``per_class`` documents of each label, those of least id hash; that bound is the
operator's parameter and the only sample here.  Scoring covers every word of every text, one pass,
no shuffle; only the model is broadcast.

Defined cases: null and empty texts have no marginals and get the score of a document without
suspicion; repeated rows each get a row; labels of null ids or null value are ignored and of several
labels of one id the largest counts; without toxic or without other labels the score is one constant
below one half; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cueloom.llm.winnow import fold_words
from cueloom.shared import ship

PER_CLASS, EVIDENCE, STEPS, RATE = 1500, 16.0, 80, 0.25
PIECE = 128  # words of a training sequence
SLICE = 1024  # sequences held at once while fitting
SPANS = "array<struct<first:int,last:int>>"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
CACHED_WORDS = 100_000


def _g_square(a: int, b: int, n1: int, n0: int) -> float:
    """Likelihood-ratio statistic of a word in ``a`` of ``n1`` toxic and ``b`` of ``n0`` other documents."""
    total = n1 + n0
    cells = ((a, n1, a + b), (b, n0, a + b), (n1 - a, n1, total - a - b), (n0 - b, n0, total - a - b))
    return 2 * sum(x * np.log(x * total / (row * col)) for x, row, col in cells if x)


def toxic_words(texts: list[list[bytes]], toxic: np.ndarray) -> set[bytes]:
    """Words whose document frequency speaks for toxicity."""
    with_it, without = Counter(), Counter()
    for words, bad in zip(texts, toxic, strict=True):
        (with_it if bad else without).update(set(words))
    n1 = int(toxic.sum())
    n0 = len(toxic) - n1
    return {
        w for w, a in with_it.items()
        if n0 and a * n0 > without[w] * n1 and _g_square(a, without[w], n1, n0) >= EVIDENCE
    }


class Field:
    """Weights of the chain and of the document curve; ``marginals`` runs forward-backward."""

    def __init__(self):
        self.word: dict[bytes, float] = {}
        self.start: dict[bytes, float] = {}
        self.bias = -6.0
        self.step = np.zeros((2, 2))  # log weight of (from, to)
        self.curve = np.array([-2.0, 0.0, 0.0])
        self._cache: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": {}}

    def _odds(self, words: list[bytes]) -> list[float]:
        cache = self._cache
        try:
            return [cache[w] for w in words]
        except KeyError:
            pass
        if len(cache) > CACHED_WORDS:
            cache.clear()
        for w in set(words).difference(cache):
            logit = self.bias + self.word.get(w, 0.0) + self.start.get(w[:4], 0.0)
            cache[w] = float(np.exp(np.clip(logit, -30, 30)))
        return [cache[w] for w in words]

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """Probability that each word is toxic, given the whole text."""
        if not words:
            return np.empty(0)
        odds = self._odds(words)
        (a, b), (c, d) = np.exp(self.step).tolist()
        ahead = list(itertools.accumulate(odds, lambda r, e: e * (b + d * r) / (a + c * r)))
        back = list(itertools.accumulate(
            odds[:0:-1], lambda q, e: (c + d * e * q) / (a + b * e * q), initial=1.0
        ))[::-1]
        both = np.array(ahead) * np.array(back)
        return both / (1 + both)

    def aggregates(self, p: np.ndarray) -> tuple[float, float]:
        if not len(p):
            return -8.0, 0.0
        top = min(max(float(p.max()), 3.4e-4), 1 - 3.4e-4)
        return float(np.log(top / (1 - top))), float(np.log1p(p.sum()))

    def score(self, p: np.ndarray) -> float:
        top, count = self.aggregates(p)
        z = self.curve[0] + self.curve[1] * top + self.curve[2] * count
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _chain_gradient(emit, gold, real, step):
    """Marginals of padded sequences, and the gradient of the log likelihood in the transitions."""
    n, t = emit.shape
    (a, b), (c, d) = np.exp(step)
    e = np.exp(np.clip(emit, -30, 30))
    ahead, back = np.empty((n, t)), np.ones((n, t))
    ahead[:, 0] = e[:, 0]
    for k in range(1, t):
        ahead[:, k] = e[:, k] * (b + d * ahead[:, k - 1]) / (a + c * ahead[:, k - 1])
    for k in range(t - 2, -1, -1):
        onward = e[:, k + 1] * back[:, k + 1]
        back[:, k] = np.where(real[:, k + 1], (c + d * onward) / (a + b * onward), 1.0)
    both = ahead * back
    p = both / (1 + both)
    pair = real[:, 1:]
    r, onward = ahead[:, :-1], e[:, 1:] * back[:, 1:]
    cells = np.stack([np.full_like(r, a), b * onward, c * r, d * r * onward])
    expected = (cells / cells.sum(0) * pair).sum((1, 2)).reshape(2, 2)
    x, y = gold[:, :-1], gold[:, 1:]
    seen = np.array([
        ((1 - x) * (1 - y) * pair).sum(), ((1 - x) * y * pair).sum(), (x * (1 - y) * pair).sum(), (x * y * pair).sum(),
    ]).reshape(2, 2)
    return p, seen - expected


def fit(texts: list[list[bytes]], toxic: np.ndarray) -> Field:
    """Fit the field to labelled tokens and the curve to document labels."""
    field = Field()
    if not toxic.any() or toxic.all():
        return field
    lexicon = toxic_words(texts, toxic)
    frequency = Counter(w for words in texts for w in set(words))
    words = {w: i for i, w in enumerate(sorted(w for w, n in frequency.items() if n > 1), 1)}
    starts = {s: i for i, s in enumerate(sorted({w[:4] for w in words}), 1)}
    pieces = [
        (piece, bad) for own, bad in zip(texts, toxic, strict=True)
        for piece in (own[k : k + PIECE] for k in range(0, len(own), PIECE))
    ]
    shape = (len(pieces), PIECE)
    w_at, s_at = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
    gold, real = np.zeros(shape, bool), np.zeros(shape, bool)
    for n, (piece, bad) in enumerate(pieces):
        m = len(piece)
        w_at[n, :m] = [words.get(w, 0) for w in piece]
        s_at[n, :m] = [starts.get(w[:4], 0) for w in piece]
        real[n, :m] = True
        if bad:
            gold[n, :m] = [w in lexicon for w in piece]
    flat = np.zeros(len(words) + len(starts) + 7)
    w_end, s_end = len(words) + 1, len(words) + len(starts) + 2
    flat[s_end] = field.bias
    moment, square = np.zeros_like(flat), np.zeros_like(flat)
    for turn in range(1, STEPS + 1):
        gradient = -0.05 * flat
        for low in range(0, len(pieces), SLICE):
            cut = slice(low, low + SLICE)
            emit = flat[:w_end][w_at[cut]] + flat[w_end:s_end][s_at[cut]] + flat[s_end]
            p, d_step = _chain_gradient(emit, gold[cut].astype(float), real[cut], flat[s_end + 1 :].reshape(2, 2))
            miss = np.where(real[cut], gold[cut] - p, 0.0)
            gradient[:w_end] += np.bincount(w_at[cut].ravel(), miss.ravel(), w_end)
            gradient[w_end:s_end] += np.bincount(s_at[cut].ravel(), miss.ravel(), s_end - w_end)
            gradient[s_end] += miss.sum()
            gradient[s_end + 1 :] += d_step.ravel()
        gradient[[0, w_end]] = 0.0
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        flat += RATE * (moment / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    field.word = {w: float(flat[i]) for w, i in words.items()}
    field.start = {s: float(flat[w_end + i]) for s, i in starts.items()}
    field.bias, field.step = float(flat[s_end]), flat[s_end + 1 :].reshape(2, 2).copy()
    seen = np.array([[1.0, *field.aggregates(field.marginals(own))] for own in texts])
    field.curve = _logistic(seen, toxic.astype(float))
    return field


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * w)
    return w


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, text, toxic) of at most ``per_class`` labelled documents of each label."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(
        "doc_id IS NOT NULL AND toxic IS NOT NULL"
    ).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = [
        marked.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for value in (0, 1)
    ]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))
    return docs.select("doc_id", "text").join(few, "doc_id").filter("text IS NOT NULL").dropDuplicates(["doc_id"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Field:
    """The field fitted to ``labels`` (doc_id, toxic), which hold nothing but training rows."""
    rows = sorted(training_rows(docs, labels, per_class).collect(), key=lambda r: r.doc_id)
    return fit([fold_words(r.text) for r in rows], np.array([r.toxic for r in rows], int))


def score_toxicity(
    docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: doc_id, the ``carry`` columns as struct ``own``, ``score`` and ``spans``:
    code points ``first`` to ``last - 1`` of words with a marginal of one half or more, neighbours joined."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Field = sent.value
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("text").to_pylist():
                p = model.marginals(fold_words(text))
                scores.append(model.score(p))
                spans.append(_spans(text, np.flatnonzero(p >= 0.5)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("own"), pa.array(scores, pa.float64()), pa.array(spans, _SPANS)], ["own", "score", "spans"]
            )

    fed = docs.select(
        F.struct(F.col(id_col).alias("doc_id"), *[F.col(c) for c in carry]).alias("own"),
        F.col(text_col).cast("string").alias("text"),
    )
    kind = fed.schema["own"].dataType.simpleString()
    return fed.mapInArrow(run, f"own {kind}, score double, spans {SPANS}")


def _spans(text: str | None, at: np.ndarray) -> list[dict]:
    if not text or not len(at):
        return []
    found = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out: list[dict] = []
    for k in at.tolist():
        if out and at_before == k - 1:
            out[-1]["last"] = found[k][1]
        else:
            out.append({"first": found[k][0], "last": found[k][1]})
        at_before = k
    return out
