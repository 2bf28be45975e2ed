"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is labelled good or bad from its own features and those of the lines
before and after it; forward-backward gives each line's probability of being good,
and their mean, weighted by line length and calibrated on the training texts, is
the document's quality.  Lines of a labelled text take its label in training.

The model is fitted on at most ``TRAIN_DOCS`` labelled texts of at most
``TRAIN_CHARS`` characters, those with the lowest hashes of their ids; scoring reads
every text whole.  Only the text is an input of a score.

Rows: a null or empty text is one empty line and gets the score of such a line;
null labels and ids teach nothing; a repeated label row counts again; repeated
rows are scored one by one; if the labels have fewer than two classes, every score
is the smoothed share of good labels; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotgrid.llm.quality_rules import STOP_WORDS, SYMBOLS
from spotgrid.llm.registry import query, table

#: Bounds of the training sample.
TRAIN_DOCS, TRAIN_CHARS = 4000, 20_000
ROUNDS, RATE, RIDGE = 300, 0.05, 1e-3
THRESHOLD = 0.3
#: Texts scored in one vectorised pass hold about so many characters.
PASS_CHARS = 4_000_000

_STOP = frozenset(w.encode() for w in STOP_WORDS)
_CLASSES = np.zeros((256, 5))  # symbol, digit, upper case, letter, anything but white space
for _byte in range(256):
    _char = chr(_byte)
    _CLASSES[_byte] = (_char in SYMBOLS, 48 <= _byte < 58, 65 <= _byte < 91, _byte > 127 or 65 <= _byte < 91 or 97 <= _byte < 123, not (_byte == 32 or 9 <= _byte < 14))
OWN_FEATURES = 13


def _line_features(lines: list[bytes]) -> list[tuple[float, ...]]:
    """Features of words and repeats of each line of one text."""
    seen: dict[bytes, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    earlier: set[bytes] = set()
    out = []
    for line in lines:
        words = line.split()
        n = len(words)
        after = words[1:]
        pairs = len(set(zip(words, after)))
        some = max(n, 1)
        out.append((
            np.log1p(len(line)), np.log1p(n), sum(map(_STOP.__contains__, words)) / some, float(n > 0 and line in earlier), float(n > 0 and seen[line] > 1),
            sum(map(eq, words, after)) / some, 1 - len(set(words)) / some if n else 0.0, 1 - pairs / (n - 1) if n > 1 else 0.0,
        ))
        earlier.add(line)
    return out


def featurize(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (own, previous, next), lines per text, and bytes per line."""
    rows: list[tuple[float, ...]] = []
    counts, blobs, sizes = [], [], []
    for text in texts:
        blob = (text or "").encode()
        lines = [line for line in blob.split(b"\n") if line and not line.isspace()] or [b""]
        rows += _line_features(lines)
        counts.append(len(lines))
        sizes += [len(line) + 1 for line in lines]
        blobs += lines
    lengths = np.array(sizes)
    data = np.frombuffer(b" ".join(blobs) + b" ", dtype=np.uint8)
    starts = np.cumsum(lengths) - lengths
    shares = np.stack([np.add.reduceat(_CLASSES[:, k].astype(np.int64)[data], starts) for k in range(5)], axis=1)
    own = np.empty((len(rows), OWN_FEATURES))
    own[:, :8] = rows
    own[:, 8:12] = shares[:, :4] / np.maximum(shares[:, 4:5], 1)
    own[:, 12] = shares[:, 4] / np.maximum(np.expm1(own[:, 1]), 1) / 10
    n_lines = np.array(counts)
    firsts = np.cumsum(n_lines) - n_lines
    before, after = np.zeros((len(own), OWN_FEATURES + 1)), np.zeros((len(own), OWN_FEATURES + 1))
    before[1:, :-1], before[1:, -1] = own[:-1], 1
    after[:-1, :-1], after[:-1, -1] = own[1:], 1
    before[firsts], after[firsts + n_lines - 1] = 0, 0
    return np.hstack([own, before, after]), n_lines, lengths


@dataclass
class Chains:
    """Lines of many texts, walked step by step for all texts at once."""

    n_lines: np.ndarray

    def __post_init__(self) -> None:
        self.firsts = np.cumsum(self.n_lines) - self.n_lines
        order = np.argsort(-self.n_lines, kind="stable")
        self.by_length = self.firsts[order]
        longest = int(self.n_lines.max(initial=0))
        self.active = np.searchsorted(-self.n_lines[order], -np.arange(longest), side="left")  # texts of more than t lines
        self.text_of = np.repeat(np.arange(len(self.n_lines)), self.n_lines)

    def forward_backward(self, unary: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log forward and backward scores of both states, and each text's log normaliser."""
        scores = np.stack([np.zeros_like(unary), unary], axis=1)
        forward, backward = scores.copy(), np.zeros_like(scores)
        for t in range(1, len(self.active)):
            i = self.by_length[: self.active[t]] + t
            forward[i] = scores[i] + np.logaddexp(forward[i - 1, :1] + trans[0], forward[i - 1, 1:] + trans[1])
        for t in range(len(self.active) - 2, -1, -1):
            i = self.by_length[: self.active[t + 1]] + t
            ahead = scores[i + 1] + backward[i + 1]
            backward[i] = np.logaddexp(ahead[:, :1] + trans[:, 0], ahead[:, 1:] + trans[:, 1])
        lasts = self.firsts + self.n_lines - 1
        return forward, backward, np.logaddexp(forward[lasts, 0], forward[lasts, 1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Fitted field: feature scaling, line weights, transitions and calibration; or a constant score."""

    constant: float | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    trans: np.ndarray | None = None
    slope: float = 1.0
    shift: float = 0.0

    def scaled(self, features: np.ndarray) -> np.ndarray:
        """Standardised features and a constant."""
        return np.hstack([(features - self.mean) / self.scale, np.ones((len(features), 1))])

    def line_marginals(self, features: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        """Probability of being good, per line."""
        chains = Chains(n_lines)
        forward, backward, norm = chains.forward_backward(self.scaled(features) @ self.weights, self.trans)
        return np.exp(np.minimum(forward[:, 1] + backward[:, 1] - norm[chains.text_of], 0))

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """Log odds of the length-weighted mean of the lines' marginals."""
        features, n_lines, lengths = featurize(texts)
        good = self.line_marginals(features, n_lines)
        firsts = np.cumsum(n_lines) - n_lines
        mean = np.add.reduceat(good * lengths, firsts) / np.add.reduceat(lengths, firsts)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of quality 1 per text."""
        if not texts:
            return np.zeros(0)
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return _sigmoid(self.slope * self.raw(texts) + self.shift)


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Penalised maximum likelihood by full-batch Adam; then a logistic calibration of documents."""
    y = np.array(labels, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return Model(constant=float((y.sum() + 1) / (len(y) + 2)))
    features, n_lines, _ = featurize(texts)
    model = Model(mean=features.mean(axis=0), scale=np.maximum(features.std(axis=0), 1e-6))
    x, chains = model.scaled(features), Chains(n_lines)
    truth = y[chains.text_of]
    inner = np.ones(len(x), dtype=bool)
    inner[chains.firsts] = False
    inner = np.flatnonzero(inner)
    seen_pairs = np.array([[np.sum(truth[inner] == 0), 0], [0, np.sum(truth[inner] == 1)]], dtype=float)
    theta = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        weights, trans = theta[:-4], theta[-4:].reshape(2, 2)
        unary = x @ weights
        forward, backward, norm = chains.forward_backward(unary, trans)
        good = np.exp(np.minimum(forward[:, 1] + backward[:, 1] - norm[chains.text_of], 0))
        ahead = np.stack([np.zeros_like(unary), unary], axis=1)[inner] + backward[inner] - norm[chains.text_of[inner], None]
        pairs = np.exp(np.minimum(forward[inner - 1][:, :, None] + trans[None] + ahead[:, None, :], 0)).sum(axis=0)
        slope = np.concatenate([x.T @ (truth - good), (seen_pairs - pairs).ravel()]) / len(x) - RIDGE * theta
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta = theta + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.weights, model.trans = theta[:-4], theta[-4:].reshape(2, 2)
    raw = model.raw(texts)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method on two parameters, with a ridge
        p = _sigmoid(a * raw + b)
        w = p * (1 - p)
        gradient = np.array([np.sum((y - p) * raw) - 0.1 * a, np.sum(y - p) - 0.1 * b])
        hessian = np.array([[np.sum(w * raw * raw) + 0.1, np.sum(w * raw)], [np.sum(w * raw), np.sum(w) + 0.1]])
        move = np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        a, b = a + move[0], b + move[1]
    model.slope, model.shift = max(float(a), 1e-3), float(b)
    return model


def held_out(doc_id: Column) -> Column:
    """True for rows that never teach: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_chars: int = TRAIN_CHARS) -> Model:
    """Fit on the rows of ``labels`` (``doc_id, quality``) that may teach; at most ``most`` texts reach the driver."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("quality")]
    chosen = usable.orderBy(*order).limit(most)
    texts = docs.select("doc_id", "text").where(F.length(F.coalesce("text", F.lit(""))) <= most_chars)
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(*order, "text").limit(2 * most).collect()
    return fit([r["text"] for r in rows], [r["quality"] for r in rows])


def score_texts(model: Model, text: Column) -> Column:
    """Quality of every text of a column, as a double."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            passes = np.cumsum([len(t or "") for t in texts]) // PASS_CHARS
            cuts = np.flatnonzero(np.diff(passes, prepend=-1)) if texts else []
            parts = [model.score(texts[a:b]) for a, b in zip(cuts, [*cuts[1:], len(texts)])]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return scored(text)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, taught_by: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` scored ``threshold`` or more, with their columns and nothing else.

    The labelled texts come from ``taught_by``, or else from ``docs``.
    """
    model = train(docs if taught_by is None else taught_by, labels)
    return docs.where(score_texts(model, F.col("text")) >= threshold)


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_texts(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
